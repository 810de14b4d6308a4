"""Thresholds and odd values."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from leafstack import rules as R
from leafstack.functions import names as N
from leafstack.functions import values as V
from leafstack.operators import classify, fieldset, learning, quality, queues, trimatch
from leafstack.plans import flow, stages
from leafstack.sources import sinks, tables

AT = datetime(2024, 1, 1)
FIELD = "field_id long, document_id string, ordinal int, field_name string, field_value string, field_type string, confidence double, human_corrected boolean, corrected_value string"


def fields(spark, docs):
    """{doc: {name: value}} -> field rows"""
    rows, n = [], 0
    for d, named in docs.items():
        for i, (k, v) in enumerate(named.items()):
            rows.append((n, d, i, k, v, "scalar", 0.9, False, None))
            n += 1
    return spark.createDataFrame(rows, FIELD)


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("value,ok", [
    ("2026-06-08", True), ("8/6/2026", True), ("08 Jun 2026", True), ("8 june 2026", True), ("31/02/2026", False),
    ("26-05-07", True), ("26.05.07", True), ("2026/06/08", True), ("6/28/2026", True), ("soon", False), ("", False)])
def test_dates(spark, value, ok):
    assert one(spark, value, V.is_valid_date) is ok


@pytest.mark.parametrize("value,ok", [("1,234.50", True), ("166 825,00", True), ("1e5", True), ("NaN", False), ("-", False), ("12kg", False)])
def test_numbers(spark, value, ok):
    assert one(spark, value, V.is_valid_number) is ok


@pytest.mark.parametrize("value,kind", [
    ("FOB Shanghai", "incoterm"), ("EUR", "currency_code"), ("GB", "country_code"), ("yes", "boolean"), ("2024-01-02T10:00", "datetime"),
    ("1/2/2024", "date"), ("2024.1.2", "date"), ("3 March 2024", "text"), ("3 Mar 2024", "date"), ("12.5%", "percentage"), ("12.5", "decimal"),
    ("€1,234.50", "currency_amt"), ("1,234.50", "currency_amt"), ("1234EUR", "currency_amt"), ("12.50 EUR", "currency_amt"), ("1,234", "integer"),
    ("12345678", "code"), ("1234.75", "decimal"), ("TSL/58001", "code"), ("ABC", "code"), ("some words here", "text"), ("", "text")])
def test_value_formats(spark, value, kind):
    assert one(spark, value, V.classify_value).type == kind


@pytest.mark.parametrize("n,stage", [(2, "ZERO_SHOT"), (3, "LEARNING"), (9, "LEARNING"), (10, "LEARNED_PROPOSED"), (49, "LEARNED_PROPOSED"), (50, "OPTIMISED")])
def test_stage_ladder(spark, n, stage):
    r = spark.range(1).select(N.learning_stage(F.lit(n)).alias("a"), N.learning_stage(F.lit(n), F.lit("LEARNED")).alias("b")).first()
    assert (r.a, r.b) == (stage, "LEARNED")


def match(spark, po, inv, classes=("dc_003", "dc_006")):
    members = spark.createDataFrame([("s", "p", classes[0], AT), ("s", "i", classes[1], AT)], "shipment_id string, document_id string, class_id string, created_at timestamp")
    return trimatch.match_checks(members, fields(spark, {"p": po, "i": inv})).first()


PO = {"supplier_name": "Acme Ltd", "currency": "EUR", "total_order_value": "100.00", "po_number": "TSL/58001", "po_date": "2024-01-02"}


@pytest.mark.parametrize("change,check,want", [
    ({"total_amount": "102.00"}, "amount_tolerance", "PASS"), ({"total_amount": "102.01"}, "amount_tolerance", "FAIL"),
    ({"total_amount": "0"}, "amount_tolerance", "SKIP"), ({"total_amount": "n/a"}, "amount_tolerance", "SKIP"),
    ({"total_amount": "", "total_invoice_value": "90"}, "amount_tolerance", "PASS"),
    ({"supplier_name": "ACME-LTD gmbh"}, "supplier_name", "PASS"), ({"supplier_name": "-"}, "supplier_name", "PASS"),
    ({"supplier_name": "Other"}, "supplier_name", "FAIL"), ({"freight_agent": "acme ltd"}, "supplier_name", "PASS"),
    ({"currency": "eur"}, "currency", "PASS"), ({"currency": "USD"}, "currency", "FAIL"), ({}, "currency", "SKIP"),
    ({"tll_reference": "TSL 58001/2"}, "po_reference", "PASS"), ({"customer_po_ref": "X"}, "po_reference", "FAIL"),
    ({"invoice_date": "20240102"}, "date_order", "PASS"), ({"invoice_date": "2024-01-01"}, "date_order", "FAIL"), ({"invoice_date": "1 Jan"}, "date_order", "SKIP")])
def test_match_checks(spark, change, check, want):
    assert match(spark, PO, change)[check] == want


def test_deferred_match_and_routing(spark):
    members = spark.createDataFrame([("s", "p", "dc_003", AT)], "shipment_id string, document_id string, class_id string, created_at timestamp")
    r = trimatch.three_way_match(members, fields(spark, {"p": PO})).first()
    assert r.outcome == "PASS_PARTIAL" and "missing a Invoice" in r.summary
    routed = spark.createDataFrame([("FAIL", "REQUIRED"), ("FAIL", "ADVISORY"), ("PASS", None), ("FAIL", None)], "o string, m string")
    assert [x.r for x in routed.select(trimatch.match_routing(F.col("o"), F.col("m")).alias("r")).collect()] == ["NEEDS_REVIEW", "POSTING", "POSTING", "NEEDS_REVIEW"]


INVOICE = {"invoice_number": "A1", "invoice_date": "2024-01-02", "supplier_name": "Acme", "currency": "EUR", "customer_po_ref": "TSL/58001"}


@pytest.mark.parametrize("amounts,valid,warnings", [
    ({"subtotal": "100", "vat_amount": "20", "total_amount": "120.02"}, True, 0), ({"subtotal": "100", "vat_amount": "20", "total_amount": "120.03"}, False, 0),
    ({"total_amount": "120"}, True, 1), ({"subtotal": "x", "vat_amount": "20", "total_amount": "120"}, False, 1)])
def test_invoice_total(spark, amounts, valid, warnings):
    docs = spark.createDataFrame([("d", "dc_006")], "document_id string, class_id string")
    r = quality.validate(docs, fields(spark, {"d": {**INVOICE, **amounts}})).first()
    assert (r.is_valid, len(r.warnings)) == (valid, warnings)


def test_validation_of_odd_documents(spark):
    docs = spark.createDataFrame([("none", None), ("goods", "dc_009"), ("empty", "dc_015")], "document_id string, class_id string")
    f = fields(spark, {"goods": {"un_number": "1", "shipper_name": "S", "shipper_declaration_signed": "False"}})
    got = {r.document_id: r.nigo for r in quality.validate(docs, f).collect()}
    assert "No Document Class" in got["none"][0] and "explicitly false" in got["goods"][0]
    assert got["empty"] == ["Required field missing or empty: 'rfq_number'."]


def test_proofreading_tiers(spark):
    docs = spark.createDataFrame([("d", "dc_015")], "document_id string, class_id string")
    f = fields(spark, {"d": {"rfq_number": "R-1"}}).withColumn("confidence", F.lit(0.55))
    assert not quality.proofread(docs, f, tier=1).first().passed
    assert quality.proofread(docs, f, tier=3).first().passed


def test_instructions_stop_at_approval(spark):
    docs = spark.createDataFrame([("d", "dc_006")], "document_id string, class_id string")
    rules = [R.Instruction(3, "FLAG_WARNING", priority=5), R.Instruction(1, "REQUIRE_APPROVAL", None, "total", "gt", "1,000", priority=10),
             R.Instruction(2, "SKIP_POSTING", "dc_006", priority=20), R.Instruction(4, "SKIP_MATCHING", "dc_003", priority=1)]
    f = fields(spark, {"d": {"total": "1000.01"}})
    assert [r.instruction_id for r in quality.fired_instructions(docs, f, rules).orderBy("place").collect()] == [3, 1]
    assert [r.instruction_id for r in quality.fired_instructions(docs, f, rules, True).orderBy("place").collect()] == [3, 1, 2]


RULES = [R.ClassRule("dc_006", ("invoice no", "iban", "vat", "list price", "list price"), priority=3),
         R.ClassRule("dc_010", ("order confirmation", "confirmed", "vat"), priority=7),
         R.ClassRule("dc_013", ("mawb", "freight", "agent", "charges"), priority=9)]


@pytest.mark.parametrize("text,name,want", [
    ("Invoice No 1 IBAN", None, ("dc_006", 0.4)), ("VAT", None, (None, 0.0)), ("VAT confirmed IBAN", None, ("dc_010", 0.6667)),
    ("list price", None, ("dc_006", 0.4)), ("Invoice No 1, IBAN, VAT. MAWB-NO 123", None, ("dc_013", 0.25)),
    ("invoice no iban vat order confirmation", None, ("dc_010", 0.6667)),
    ("iban", "freight_agent.pdf", ("dc_013", 0.5)), ("iban", "freight_agent_scan.pdf", (None, 0.0)),
    ("client invoice tata limited invoice no a2 invoice", None, ("dc_012", 1.0)), ("", None, (None, 0.0))])
def test_classification(spark, text, name, want):
    docs = spark.createDataFrame([("d", text, name)], "document_id string, text string, file_name string")
    r = classify.classify_documents(docs, RULES).first()
    assert (r.class_id, r.confidence) == want


def test_override_wins(spark):
    docs = spark.createDataFrame([("d", "iban vat", "dc_001")], "document_id string, text string, class_override string")
    r = classify.classify_documents(docs, RULES).first()
    assert (r.class_id, r.confidence, r.how) == ("dc_001", 1.0, "override")


def test_enum_and_majority(spark):
    rows = [("e", ["Open", "Closed", "Open", "Closed"]), ("m", ["12.5%", "abc", "7%", "x y"]), ("s", ["12", "7", "13", "x y z"])]
    got = {r.k: (r.format_type, r.format_confidence) for r in learning.infer_formats(spark.createDataFrame(rows, "k string, vals array<string>"), "vals").collect()}
    assert got == {"e": ("enum", 0.8), "m": ("text", 0.4), "s": ("integer", 0.713)}


def test_effective_values(spark):
    rows = [(1, "d", 0, "a", "x", "scalar", 0.5, False, None), (2, "d", 0, "a", "y", "scalar", 0.5, True, None), (3, "d", 1, "b", None, "scalar", 0.5, False, None)]
    df = spark.createDataFrame(rows, FIELD)
    got = {r.field_name: r.value for r in fieldset.last_per_name(df).collect()}
    assert got == {"a": None, "b": ""}


def test_second_decision_is_refused(spark):
    docs = spark.createDataFrame([("d", "NEEDS_REVIEW", "c")], "document_id string, status string, class_id string")
    dec = spark.createDataFrame([("d", "approve", "COMPLETED", "ann", AT), ("d", "reject", None, "bob", datetime(2024, 1, 2)), ("x", "retry", None, "bob", AT)],
                                "document_id string, action string, target string, actor string, decided_at timestamp")
    got = {(r.document_id, r.action): (r.refused, r.new_status) for r in queues.apply_decisions(docs, dec).collect()}
    assert got[("d", "approve")] == (None, "COMPLETED") and got[("d", "reject")][0] == "superseded" and got[("x", "retry")][0] == "document_not_found"


def test_upload_checks(spark):
    rows = [("a", "text/plain", b"%PDF"), ("b", "application/pdf", b""), ("c", "application/pdf", b"GIF8"), ("d", "application/octet-stream", b"%PDF-1.7")]
    df = spark.createDataFrame(rows, "document_id string, mime_type string, content binary")
    assert [r.reject_reason for r in tables.ingest_quarantine(df).orderBy("document_id").collect()] == ["invalid_file_type", "empty_file", "invalid_pdf", None]


def test_schema_json_drops_the_reserved_entry(spark):
    df = spark.createDataFrame([("v", '{"total":{"aliases":["amount","total"]},"iban":{},"__run__":{"aliases":["x"]}}'), ("w", "{broken")], "variant_id string, field_schema_json string")
    assert sorted((r.canonical, r.alias) for r in tables.read_field_schema(df).collect()) == [("iban", "iban"), ("total", "amount"), ("total", "total")]


def test_run_log(spark, tmp_path):
    log = str(tmp_path / "log")
    assert sinks.run_and_log(spark, "ok", lambda: spark.range(3).toDF("n"), str(tmp_path / "a"), log) == "success"
    assert sinks.run_and_log(spark, "bad", lambda: 1 / 0, str(tmp_path / "b"), log) == "error"
    got = {r.report: (r.status, r.summary) for r in spark.read.parquet(log).collect()}
    assert got == {"ok": ("success", "ok: 3 row(s)"), "bad": ("error", "bad: failed")}


def test_stage_registry_and_client_settings():
    assert flow.S is stages and len(stages.list_stages()) == 14
    assert [s["key"] for s in stages.list_stages() if not s["skippable"]] == ["classification", "extraction"]
    c = stages.ClientSettings.from_json('["MATCHING"]', '{"linking": "leafstack.operators.links.link_components"}', "{bad")
    assert c.disabled == {"MATCHING"} and c.params == {}
    assert stages.stage_function("linking", c.overrides["linking"]).__name__ == "link_components"
    assert "cost_optimisation_report" in stages.list_reports()


def test_user_scorer(spark):
    df = spark.createDataFrame([("ab",), ("abcd",)], "t string")
    def score(s: "pd.Series") -> "pd.Series":  # noqa: F821
        return s.str.len() * 1.0
    import pandas as pd
    score.__annotations__ = {"s": pd.Series, "return": pd.Series}
    assert [r.score for r in stages.apply_scorer(df, "t", score).collect()] == [2.0, 4.0]
