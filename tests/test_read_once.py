"""Steps that must not work their input out twice or deal it out by a few keys."""

import contextlib
import io

from leafstack.functions.text import is_shouted
from leafstack.operators import layouts, learning, trimatch
from pyspark.sql import functions as F


def plan(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("simple")
    return out.getvalue()


def test_schema_counts_read_fields_once(spark, tmp_path):
    """counts and examples come from one pass over the fields."""
    docs = spark.createDataFrame([("a", "v", 1), ("b", "v", 2), ("b", "v", 2), ("c", "w", None), ("d", None, 9)], "document_id string, variant_id string, created_at int")
    rows = [("a", "x", "old", 1), ("a", "y", "gone", 2), ("b", "x", "late", 5), ("b", "x", "early", 4), ("b", None, "n", 6), ("c", "x", None, 7), ("d", "x", "no", 8), ("c", "z", "free", None)]
    spark.createDataFrame(rows, "document_id string, field_name string, field_value string, field_id long").write.parquet(f"{tmp_path}/fields")
    got = learning.variant_schema_from_counts(docs, spark.read.parquet(f"{tmp_path}/fields"))
    assert plan(got).count(f"{tmp_path}/fields") == 1
    assert {tuple(r) for r in got.select("variant_id", "field_name", "documents", "example").collect()} == {
        ("v", "x", 5, "early"), ("v", "y", 1, ""), ("v", None, 2, ""), ("w", "x", 1, ""), ("w", "z", 1, "")}


def test_documents_are_not_dealt_out_by_class(spark):
    """few layouts go to the tasks, whatever Spark can tell of their source."""
    docs = spark.createDataFrame(
        [("1", "c", "acme", ["a"], ["l"], 1), ("2", "c", None, ["a"], ["l"], 1), ("3", "c", "other", ["a"], ["l"], 1), ("4", "e", "acme", ["a"], ["l"], 1), ("5", None, None, ["a"], ["l"], 1)],
        "document_id string, class_id string, issuer_slug string, field_names array<string>, labels array<string>, pages_total int")
    known = spark.createDataFrame(
        [("A", "c", "acme", ["a"], ["l"], 1, True), ("U", "c", "unknown", ["a"], ["l"], 1, True), ("N", "c", None, ["a"], ["l"], 1, True), ("O", "c", "off", ["a"], ["l"], 1, True), ("X", "c", "acme", ["a"], ["l"], 1, False)],
        "variant_id string, class_id string, issuer_slug string, field_names array<string>, labels array<string>, page_count_mode int, active boolean")
    got = layouts.variant_candidates(docs, known)
    assert "BroadcastHashJoin" in plan(got) and "Exchange hashpartitioning" not in plan(got)
    assert sorted(tuple(r) for r in got.select("document_id", "variant_id").collect()) == [
        ("1", "A"), ("1", "N"), ("1", "U"), ("2", "A"), ("2", "N"), ("2", "O"), ("2", "U"), ("3", "N"), ("3", "U")]
    assert got.columns == [*docs.columns, "variant_id", "v_issuer", "v_names", "v_labels", "page_count_mode", "field_j", "label_j", "image_like"]


def test_shouted_names(spark):
    words = ["PLANT NAME", "a PLANT", "Plant", "PLANt", "pLANT", "A b", "", "x1Y", "ÄÖ", "ÄBCd", "AB1cd", "AB1c", None]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", is_shouted(F.col("w")).alias("s")).collect()
    assert [r.s for r in got] == [True, True, False, False, False, False, False, False, False, False, False, True, None]


def test_match_derives_its_fields_once(spark, tmp_path):
    """both sides of the match read one stored pivot, so the fields are worked out once."""
    spark.createDataFrame([
        ("p", "currency", "eur", 1), ("p", "po_number", "TSL/1", 2), ("p", "po_number", "TSL/2", 3), ("p", "po_date", "2024-01-02", 4), ("p", None, "x", 5), ("p", "total_order_value", "100", 6),
        ("i", "currency", "EUR", 1), ("i", "customer_po_ref", "tsl 2", 2), ("i", "invoice_date", "2024-01-01", 3), ("i", "total_amount", "102", 4), (None, "currency", "USD", 5)],
        "document_id string, field_name string, field_value string, field_id long").withColumn("human_corrected", F.lit(False)).withColumn(
        "corrected_value", F.lit(None).cast("string")).write.parquet(f"{tmp_path}/fields")
    members = spark.createDataFrame([("s", "p", "dc_003", 1), ("s", "i", "dc_006", 2), ("s", "c", "dc_008", 3), ("t", "q", "dc_003", 1), ("t", "j", "dc_006", 1), (None, "p", "dc_003", 1)],
                                    "shipment_id string, document_id string, class_id string, created_at int")
    got = trimatch.match_checks(members, spark.read.parquet(f"{tmp_path}/fields"))
    assert got.inputFiles() and all("/match-fields-" in f for f in got.inputFiles())
    assert {r.shipment_id: tuple(r)[4:] for r in got.collect()} == {
        "s": ("SKIP", "PASS", "PASS", "PASS", "FAIL", "PASS", "SKIP"), "t": ("SKIP",) * 7}
