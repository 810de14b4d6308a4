"""Queries: field table, search, three-way match, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafstack import rules as R
from leafstack.functions import values as V
from leafstack.operators import fieldset, quality, queues, trimatch
from leafstack.queries import oracle as O
from leafstack.queries import views
from leafstack.queries.registry import query
from leafstack.session import stored
from leafstack.sources import tables

# ---- field table -----------------------------------------------------------------------


@query("effective_value", """
SELECT document_id, field_name, value AS effective_value,
  CASE WHEN human_corrected THEN corrected_value ELSE field_value END AS diff_value,
  coalesce(nullif(corrected_value, ''), nullif(field_value, ''), '—') AS display_value FROM eff""", ("eff",))
def effective_value(spark, sf):
    return fieldset.with_values(views.extracted_fields(spark, sf)).select(
        "document_id", "field_name", "effective_value", "diff_value", "display_value")


@query("field_summary", """
SELECT document_id, count(*) AS field_count, round(CAST(avg(confidence) AS DECIMAL(18,8)), 4)::DOUBLE AS avg_confidence FROM fields GROUP BY 1""", ("fields",))
def field_summary(spark, sf):
    return fieldset.document_field_summary(views.extracted_fields(spark, sf))


@query("field_map", """
SELECT document_id, max(value) FILTER (field_name = 'currency') AS currency, max(value) FILTER (field_name = 'supplier_name') AS supplier_name,
  max(value) FILTER (field_name = 'po_number') AS po_number FROM eff WHERE field_name IN ('currency', 'supplier_name', 'po_number') GROUP BY 1""", ("eff",))
def field_map(spark, sf):
    return fieldset.field_map(views.extracted_fields(spark, sf), ["currency", "supplier_name", "po_number"])


@query("field_last_wins", """
SELECT document_id, field_name, arg_max(value, field_id) AS value FROM (
  SELECT 'grp_' || k AS document_id, field_name, value, field_id FROM eff) GROUP BY 1, 2""", ("eff",))
def field_last_wins(spark, sf):
    f = views.extracted_fields(spark, sf).withColumn("document_id", F.concat(F.lit("grp_"), "k"))
    return fieldset.last_per_name(f)


ALIASES = {"total_order_value": "total", "total_amount": "total", "po_date": "doc_date", "invoice_date": "doc_date"}


@query("canonical_fields", f"""
SELECT document_id, canonical_name, field_name AS source_name, field_value, confidence::DOUBLE AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY document_id, canonical_name ORDER BY confidence DESC, ordinal) AS rn FROM (
    SELECT 'grp_' || k AS document_id, coalesce(canon, field_name) AS canonical_name, field_name, field_value, confidence, slot_ord AS ordinal
    FROM (SELECT *, field_id % 20 AS slot_ord FROM fields) LEFT JOIN {O.values('alias, canon', list(ALIASES.items()))} ON alias = field_name))
WHERE rn = 1""", ("fields",))
def canonical_fields(spark, sf):
    f = views.extracted_fields(spark, sf).withColumn("document_id", F.concat(F.lit("grp_"), "k")).withColumn(
        "ordinal", F.col("field_id") % 20)
    return fieldset.canonicalise(f, ALIASES)


@query("table_explode", """
SELECT 'conv_' || conv_id AS document_id, count(*) OVER (PARTITION BY conv_id) AS row_count, 'role,turn' AS columns,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS row_no, role, CAST(turn AS VARCHAR) AS turn FROM conversations
UNION ALL SELECT 'bad_' || conv_id, 0, NULL, NULL, NULL, NULL FROM (SELECT DISTINCT conv_id FROM conversations)""")
def table_explode(spark, sf):
    c = tables.read_table(spark, sf, "conversations", "conv_id", "turn", "role")
    packed = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("rows"))
    good = packed.select(
        F.concat(F.lit("conv_"), "conv_id").alias("document_id"), F.lit("lines").alias("field_name"), F.lit("table").alias("field_type"),
        F.to_json(F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["turn"].cast("string").alias("turn")))).alias("field_value"))
    bad = packed.select(F.concat(F.lit("bad_"), "conv_id").alias("document_id"), F.lit("lines").alias("field_name"),
                        F.lit("table").alias("field_type"), F.lit("[{not json").alias("field_value"))
    out = fieldset.explode_tables(good.unionByName(bad))
    return out.select("document_id", "row_count", F.array_join("columns", ",").alias("columns"), "row_no",
                      F.try_element_at("row", F.lit("role")).alias("role"), F.try_element_at("row", F.lit("turn")).alias("turn"))


@query("cell_normalise", """
SELECT 'conv_' || conv_id AS document_id, turn, CASE WHEN trim(text) IN ('null', 'None') THEN '' ELSE substr(trim(text), 1, 500) END AS cell FROM conversations""")
def cell_normalise(spark, sf):
    c = tables.read_table(spark, sf, "conversations", "conv_id", "turn", "text")
    return c.select(F.concat(F.lit("conv_"), "conv_id").alias("document_id"), "turn", V.clean_cell(F.col("text")).alias("cell"))


@query("replace_fields", """
SELECT document_id, field_name, field_value FROM fields WHERE field_name <> 'x' AND k % 4 <> 0
UNION ALL SELECT document_id, 'note', 'new ' || k FROM trade_docs WHERE class_id IN ('dc_003', 'dc_006') AND k % 4 = 0""", ("fields", "trade_docs"))
def replace_fields(spark, sf):
    from leafstack.sources.sinks import replace_fields as replace
    f = views.extracted_fields(spark, sf).select("document_id", "field_name", "field_value")
    d = views.trade_docs(spark, sf).filter(F.col("class_id").isin("dc_003", "dc_006") & (F.col("k") % 4 == 0))
    new = d.select("document_id", F.lit("note").alias("field_name"), F.concat(F.lit("new "), "k").alias("field_value"))
    return replace(f, new)


@query("read_profile_json", """
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END AS entries, CASE WHEN event_id % 5 <> 0 THEN json_extract_string(props, '$.k') END AS k FROM events""")
def read_profile_json(spark, sf):
    e = tables.read_table(spark, sf, "events", "event_id", "props")
    broken = F.when(F.col("event_id") % 10 == 0, F.lit(None)).when(F.col("event_id") % 5 == 0, F.lit("{oops")).otherwise(F.col("props"))
    m = tables.read_json_map(broken)
    return e.select("event_id", F.size(m).alias("entries"), F.try_element_at(m, F.lit("k")).alias("k"))


# ---- search ------------------------------------------------------------------------------


@query("doc_search", """
SELECT document_id, class_id, status, created_at FROM trade_docs
WHERE status = 'COMPLETED' AND class_id = 'dc_006' AND created_at >= TIMESTAMP '2024-01-02' AND created_at < TIMESTAMP '2024-01-21'
  AND document_id IN (SELECT document_id FROM fields WHERE field_name = 'currency' AND (field_value = 'EUR' OR corrected_value = 'EUR'))""", ("trade_docs", "fields"))
def doc_search(spark, sf):
    return queues.search_documents(
        views.trade_docs(spark, sf), views.extracted_fields(spark, sf), status="COMPLETED", class_id="dc_006",
        field_name="currency", field_value="EUR", date_from="2024-01-02", date_to="2024-01-20",
    ).select("document_id", "class_id", "status", "created_at")


@query("field_wildcard", """
SELECT DISTINCT document_id FROM fields WHERE field_name = 'supplier_name' AND (field_value ILIKE 'supplier%1%7' OR corrected_value ILIKE 'supplier%1%7')""", ("fields",))
def field_wildcard(spark, sf):
    return queues.field_filter(views.extracted_fields(spark, sf), "supplier_name", "supplier*1*7")


@query("field_exists", "SELECT DISTINCT document_id FROM fields WHERE field_name = 'customer_po_ref'", ("fields",))
def field_exists(spark, sf):
    return queues.field_filter(views.extracted_fields(spark, sf), "customer_po_ref")


@query("date_range", """
SELECT document_id, created_at FROM registry WHERE created_at >= TIMESTAMP '2024-01-01' AND created_at < TIMESTAMP '2024-01-02'""", ("registry",))
def date_range(spark, sf):
    return views.registry(spark, sf).select("document_id", "created_at").filter(queues.date_range("2024-01-01", "2024-01-01"))


@query("paginate", """
SELECT document_id, created_at FROM registry ORDER BY created_at DESC, document_id DESC LIMIT 25 OFFSET 50""", ("registry",))
def paginate(spark, sf):
    return queues.paginate(views.registry(spark, sf).select("document_id", "created_at"), page=3, page_size=25)


@query("page_count", """
SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM registry""", ("registry",))
def page_count(spark, sf):
    return queues.page_count(views.registry(spark, sf))


@query("recent_documents", """
SELECT document_id, created_at FROM registry ORDER BY created_at DESC, document_id DESC LIMIT 15""", ("registry",))
def recent_documents(spark, sf):
    return queues.recent(views.registry(spark, sf).select("document_id", "created_at"), 15)


@query("shipment_search", """
SELECT shipment_id, reference_key, status FROM (
  SELECT shipment_id, 'TSL/' || lpad(CAST(k AS VARCHAR), 6, '0') AS reference_key, status, created_at,
    CASE k % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' WHEN 2 THEN 'PASS_PARTIAL' END AS match_result FROM trade_docs WHERE class_id = 'dc_003')
WHERE match_result IS NULL AND reference_key ILIKE '%00%7%' AND created_at < TIMESTAMP '2024-02-11'""", ("trade_docs",))
def shipment_search(spark, sf):
    s = views.trade_docs(spark, sf).filter(F.col("class_id") == "dc_003").select(
        "shipment_id", F.concat(F.lit("TSL/"), F.lpad(F.col("k").cast("string"), 6, "0")).alias("reference_key"), "status", "created_at",
        F.when(F.col("k") % 4 == 0, "PASS").when(F.col("k") % 4 == 1, "FAIL").when(F.col("k") % 4 == 2, "PASS_PARTIAL").alias("match_result"))
    return queues.search_shipments(s, match_result="null", reference="00%7", date_to="2024-02-10").select(
        "shipment_id", "reference_key", "status")


@query("variant_search", """
SELECT variant_id, learning_stage, created_at FROM variants WHERE active AND class_id = 'dc_006' AND learning_stage = 'LEARNED_PROPOSED'""", ("variants",))
def variant_search(spark, sf):
    return queues.search_variants(views.variants(spark, sf), "dc_006", "LEARNED_PROPOSED").select("variant_id", "learning_stage", "created_at")


@query("fields_available", """
SELECT status, count(*) AS n FROM registry WHERE status NOT IN ('RECEIVED', 'DEDUPLICATING', 'CLASSIFYING', 'UNCLASSIFIED') GROUP BY 1""", ("registry",))
def fields_available(spark, sf):
    return queues.fields_available(views.registry(spark, sf)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# ---- three-way match ---------------------------------------------------------------------

TOLERANCE = {"dc_013": "0.05"}
O.view("m_po", """
SELECT k, max(value) FILTER (field_name = 'po_number') AS po_number, max(value) FILTER (field_name = 'po_date') AS po_date,
  max(value) FILTER (field_name = 'currency') AS currency, max(value) FILTER (field_name = 'total_order_value') AS total,
  max(value) FILTER (field_name = 'supplier_name') AS supplier FROM eff WHERE document_id LIKE 'po_%' GROUP BY k""", "eff")
O.view("m_inv", """
SELECT k, max(value) FILTER (field_name = 'customer_po_ref') AS ref, max(value) FILTER (field_name = 'invoice_date') AS inv_date,
  max(value) FILTER (field_name = 'currency') AS currency, max(value) FILTER (field_name = 'total_amount') AS total,
  max(value) FILTER (field_name = 'supplier_name') AS supplier FROM eff WHERE document_id LIKE 'inv_%' GROUP BY k""", "eff")
O.view("m_pair", """
SELECT p.k, translate(lower(p.supplier), ' /-', '') AS ps, translate(lower(i.supplier), ' /-', '') AS isup, p.currency AS pc, i.currency AS ic,
  TRY_CAST(replace(trim(p.total), ',', '') AS DECIMAL(18,6)) AS pt, TRY_CAST(replace(trim(i.total), ',', '') AS DECIMAL(18,6)) AS it,
  translate(lower(p.po_number), ' /-', '') AS pn, translate(lower(i.ref), ' /-', '') AS rf, TRY_CAST(p.po_date AS DATE) AS pd, TRY_CAST(i.inv_date AS DATE) AS idt
  FROM m_po p JOIN m_inv i USING (k)""", "m_po", "m_inv")
O.view("checks", """
SELECT 'shp_' || k AS shipment_id, k,
  CASE WHEN coalesce(ps, '') = '' OR coalesce(isup, '') = '' THEN 'SKIP' WHEN contains(ps, isup) OR contains(isup, ps) THEN 'PASS' ELSE 'FAIL' END AS supplier_name,
  CASE WHEN coalesce(pc, '') = '' OR coalesce(ic, '') = '' THEN 'SKIP' WHEN upper(pc) = upper(ic) THEN 'PASS' ELSE 'FAIL' END AS currency,
  CASE WHEN coalesce(pt, 0) = 0 OR coalesce(it, 0) = 0 THEN 'SKIP' WHEN it <= pt * 1.02 THEN 'PASS' ELSE 'FAIL' END AS amount_tolerance,
  CASE WHEN coalesce(pn, '') = '' OR coalesce(rf, '') = '' THEN 'SKIP' WHEN contains(pn, rf) OR contains(rf, pn) THEN 'PASS' ELSE 'FAIL' END AS po_reference,
  CASE WHEN pd IS NULL OR idt IS NULL THEN 'SKIP' WHEN idt >= pd THEN 'PASS' ELSE 'FAIL' END AS date_order,
  CASE WHEN k % 5 = 0 THEN 'PASS' ELSE 'SKIP' END AS inspection_cert, CASE WHEN k % 3 = 0 THEN 'PASS' ELSE 'SKIP' END AS packing_list FROM m_pair""", "m_pair")
O.view("outcomes", """
SELECT shipment_id, k, CASE WHEN 'FAIL' IN (supplier_name, currency, amount_tolerance, po_reference, date_order) THEN 'FAIL'
  WHEN 'SKIP' IN (supplier_name, currency, amount_tolerance, po_reference, date_order, inspection_cert, packing_list) THEN 'PASS_PARTIAL' ELSE 'PASS' END AS outcome FROM checks""", "checks")
O.view("all_outcomes", """
SELECT shipment_id, k, outcome FROM outcomes UNION ALL
  SELECT 'shp_' || o_orderkey, o_orderkey, 'PASS_PARTIAL' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""", "outcomes")


@query("match_checks", """
SELECT shipment_id, 'po_' || k AS po_document_id, 'inv_' || k AS invoice_document_id, 2 + CAST(k % 5 = 0 AS INT) + CAST(k % 3 = 0 AS INT) AS document_count,
  supplier_name, currency, amount_tolerance, po_reference, date_order, inspection_cert, packing_list FROM checks""", ("checks",))
def match_checks(spark, sf):
    return trimatch.match_checks(views.trade_docs(spark, sf), views.extracted_fields(spark, sf), TOLERANCE)


@query("match_check_rows", """
SELECT name, status, count(*) AS shipments FROM (
  UNPIVOT checks ON supplier_name, currency, amount_tolerance, po_reference, date_order, inspection_cert, packing_list INTO NAME name VALUE status)
GROUP BY 1, 2""", ("checks",))
def match_check_rows(spark, sf):
    rows = trimatch.check_rows(match_checks(spark, sf))
    return rows.groupBy("name", "status").agg(F.count(F.lit(1)).alias("shipments"))


@query("three_way_match", "SELECT shipment_id, outcome FROM all_outcomes", ("all_outcomes",))
def three_way_match(spark, sf):
    return trimatch.three_way_match(views.trade_docs(spark, sf), views.extracted_fields(spark, sf), TOLERANCE).select(
        "shipment_id", "outcome")


@query("match_outcome_counts", "SELECT outcome, count(*) AS shipments FROM all_outcomes GROUP BY 1", ("all_outcomes",))
def match_outcome_counts(spark, sf):
    return three_way_match(spark, sf).groupBy("outcome").agg(F.count(F.lit(1)).alias("shipments"))


@query("match_summary", """
SELECT shipment_id, passed, 'Three-way match ' || outcome || '. ' || passed || '/7 checks passed. '
  || CASE WHEN failed <> '' THEN 'FAIL: ' || failed || '. ' ELSE '' END
  || CASE WHEN skipped <> '' THEN 'SKIP (awaiting docs): ' || skipped || '.' ELSE '' END AS summary
FROM (SELECT shipment_id, len(list_filter(s, lambda x: x = 'PASS')) AS passed,
    array_to_string([n[i] FOR i IN range(1, 8) IF s[i] = 'FAIL'], ', ') AS failed,
    array_to_string([n[i] FOR i IN range(1, 8) IF s[i] = 'SKIP'], ', ') AS skipped
  FROM (SELECT shipment_id, [supplier_name, currency, amount_tolerance, po_reference, date_order, inspection_cert, packing_list] AS s,
    ['supplier_name', 'currency', 'amount_tolerance', 'po_reference', 'date_order', 'inspection_cert', 'packing_list'] AS n FROM checks)) x
JOIN outcomes USING (shipment_id)""", ("outcomes", "checks"))
def match_summary(spark, sf):
    return trimatch.match_outcome(match_checks(spark, sf)).select("shipment_id", "passed", "summary")


@query("match_routing", """
SELECT document_id, outcome, CASE WHEN outcome = 'FAIL' AND match_mode <> 'ADVISORY' THEN 'NEEDS_REVIEW' ELSE 'POSTING' END AS next_stage
FROM trade_docs JOIN all_outcomes USING (shipment_id)""", ("trade_docs", "all_outcomes"))
def match_routing(spark, sf):
    # read three times below, derived once
    d = stored(views.trade_docs(spark, sf).select("document_id", "shipment_id", "class_id", "created_at", "match_mode"), "documents")
    out = trimatch.match_for_documents(d, trimatch.three_way_match(d, views.extracted_fields(spark, sf), TOLERANCE))
    return out.join(d.select("document_id", "match_mode"), "document_id").select(
        "document_id", "outcome", trimatch.match_routing(F.col("outcome"), F.col("match_mode")).alias("next_stage"))


@query("match_tolerance", """
SELECT class_id, count(*) AS documents, CASE class_id WHEN 'dc_007' THEN 0.05 WHEN 'dc_003' THEN 0.0 ELSE 0.02 END::DOUBLE AS tolerance FROM trade_docs GROUP BY 1""", ("trade_docs",))
def match_tolerance(spark, sf):
    d = views.trade_docs(spark, sf).groupBy("class_id").agg(F.count(F.lit(1)).alias("documents"))
    return d.withColumn("tolerance", trimatch.match_tolerance(F.col("class_id"), {"dc_007": "0.05", "dc_003": "0"}).cast("double"))


@query("shipment_pairs", """
SELECT shipment_id, count(*) AS document_count, min(document_id) FILTER (class_id = 'dc_003') AS po_document_id,
  min(document_id) FILTER (class_id = 'dc_006') AS invoice_document_id, bool_or(class_id = 'dc_008') AS has_ic, bool_or(class_id = 'dc_007') AS has_pl
FROM trade_docs GROUP BY 1""", ("trade_docs",))
def shipment_pairs(spark, sf):
    return trimatch.shipment_pairs(views.trade_docs(spark, sf)).drop("invoice_class_id")


# ---- validation, proofreading, instructions -----------------------------------------------

QUALITY_DOCS = ("dc_003", "dc_006", "dc_007", "dc_008")        # all classes of trade_docs


def _quality_docs(spark, sf, with_variant=False):
    return views.trade_docs(spark, sf).select("document_id", "class_id", *(["variant_id", "created_at"] if with_variant else []))


O.view("wide", """
SELECT d.document_id, d.class_id, d.k, d.variant_id, d.created_at, po_number, invoice_number, po_date, invoice_date, currency, total_order_value, total_amount, customer_po_ref, supplier_name,
  consignee_name, purchase_order_no, ic_number
FROM trade_docs d LEFT JOIN (SELECT document_id, max(value) FILTER (field_name = 'po_number') AS po_number, max(value) FILTER (field_name = 'invoice_number') AS invoice_number,
  max(value) FILTER (field_name = 'po_date') AS po_date, max(value) FILTER (field_name = 'invoice_date') AS invoice_date, max(value) FILTER (field_name = 'currency') AS currency,
  max(value) FILTER (field_name = 'total_order_value') AS total_order_value, max(value) FILTER (field_name = 'total_amount') AS total_amount,
  max(value) FILTER (field_name = 'customer_po_ref') AS customer_po_ref, max(value) FILTER (field_name = 'supplier_name') AS supplier_name, max(value) FILTER (field_name = 'consignee_name') AS consignee_name,
  max(value) FILTER (field_name = 'purchase_order_no') AS purchase_order_no, max(value) FILTER (field_name = 'ic_number') AS ic_number FROM eff GROUP BY 1) f USING (document_id)""", "trade_docs", "eff")


def _missing(cols: list[str]) -> str:
    return "list_filter([" + ", ".join(
        f"CASE WHEN coalesce(trim({c}), '') = '' THEN 'Required field missing or empty: ''{c}''.' END" for c in cols) + "], lambda x: x IS NOT NULL)"


O.view("nigo", f"""
SELECT document_id, class_id, CASE class_id {' '.join(f"WHEN '{c}' THEN {_missing(R.VALIDATION_REQUIRED[c])}" for c in QUALITY_DOCS)} END AS nigo,
  CASE WHEN class_id = 'dc_006' AND total_amount IS NOT NULL THEN 1 ELSE 0 END AS warning_count FROM wide""", "wide")


@query("validate", """
SELECT document_id, class_id, len(nigo) = 0 AS is_valid, len(nigo) AS conditions, warning_count,
  CASE WHEN len(nigo) > 0 THEN 'NIGO - ' || len(nigo) || ' condition(s) failed. ' || array_to_string(nigo, ' | ') END AS reason FROM nigo""", ("nigo",))
def validate(spark, sf):
    v = quality.validate(_quality_docs(spark, sf), views.extracted_fields(spark, sf))
    return v.select("document_id", "class_id", "is_valid", F.size("nigo").alias("conditions"),
                    F.size("warnings").alias("warning_count"), "reason")


DATE_SQL = "['%Y-%m-%d', '%d/%m/%Y', '%d.%m.%Y', '%d-%m-%Y', '%d %b %Y', '%d %B %Y', '%m/%d/%Y', '%Y/%m/%d', '%d-%m-%y', '%d/%m/%y', '%d.%m.%y']"
_MIXED = """CASE event_id % 8 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%d/%m/%Y') WHEN 2 THEN strftime(ts, '%d.%m.%y')
  WHEN 3 THEN CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) WHEN 4 THEN '1,2' || event_id WHEN 5 THEN '31/02/2026' WHEN 6 THEN strftime(ts, '%d %B %Y') ELSE event_type END"""
O.view("mixed", f"SELECT event_id, event_type, value, {_MIXED} AS v FROM events")


def _mixed(spark, sf):
    e = tables.read_table(spark, sf, "events", "event_id", "ts", "event_type", "value")
    n = F.col("event_id") % 8
    v = (F.when(n == 0, F.date_format("ts", "yyyy-MM-dd")).when(n == 1, F.date_format("ts", "dd/MM/yyyy"))
         .when(n == 2, F.date_format("ts", "dd.MM.yy")).when(n == 3, views.cents(F.col("value")).cast("string"))
         .when(n == 4, F.concat(F.lit("1,2"), "event_id")).when(n == 5, "31/02/2026")
         .when(n == 6, F.date_format("ts", "dd MMMM yyyy")).otherwise(F.col("event_type")))
    return e.select("event_id", "event_type", "value", v.alias("v"))


@query("value_typing", f"""
SELECT event_id, v, try_strptime(v, {DATE_SQL}) IS NOT NULL AS is_date,
  TRY_CAST(replace(replace(trim(v), ',', ''), ' ', '') AS DECIMAL(18,6)) IS NOT NULL AS is_number,
  CAST(TRY_CAST(replace(trim(v), ',', '') AS DECIMAL(18,6)) AS DOUBLE) AS amount FROM mixed""", ("mixed",))
def value_typing(spark, sf):
    v = F.col("v")
    return _mixed(spark, sf).select("event_id", "v", V.is_valid_date(v).alias("is_date"), V.is_valid_number(v).alias("is_number"),
                                    V.to_decimal(v).cast("double").alias("amount"))


O.view("bleeds", """
SELECT document_id, field_name, field_value, seen_in FROM (
  SELECT document_id, field_name, trim(field_value) AS field_value, lag(field_name) OVER (PARTITION BY document_id, trim(field_value) ORDER BY ordinal, field_id) AS seen_in FROM (
    SELECT document_id, field_name, field_value, ordinal, field_id FROM fields
    UNION ALL SELECT document_id, 'copy_of_' || field_name, field_value, 50, field_id FROM fields WHERE k % 5 = 0 AND ordinal IN (0, 2)))
WHERE seen_in <> field_name""", "fields")


def _bleeding_fields(spark, sf):
    f = views.extracted_fields(spark, sf)
    extra = f.filter((F.col("k") % 5 == 0) & F.col("ordinal").isin(0, 2)).withColumn(
        "field_name", F.concat(F.lit("copy_of_"), "field_name")).withColumn("ordinal", F.lit(50))
    return f.unionByName(extra)


@query("value_bleed", "SELECT * FROM bleeds", ("bleeds",))
def value_bleed(spark, sf):
    return quality.value_bleed(_bleeding_fields(spark, sf))


O.view("history", """
SELECT w.document_id, 'currency' AS field_name, w.field_value, known FROM (
  SELECT f.document_id, f.field_value, d.variant_id, list_sort(list_distinct(list(upper(trim(h.field_value))))) AS known
  FROM fields f JOIN trade_docs d USING (document_id) JOIN (
    SELECT variant_id, document_id, row_number() OVER (PARTITION BY variant_id ORDER BY created_at DESC, document_id DESC) AS rk FROM trade_docs WHERE variant_id IS NOT NULL
  ) r ON r.variant_id = d.variant_id AND r.document_id <> f.document_id
  LEFT JOIN (SELECT variant_id, document_id, row_number() OVER (PARTITION BY variant_id ORDER BY created_at DESC, document_id DESC) AS own FROM trade_docs WHERE variant_id IS NOT NULL) o
    ON o.document_id = f.document_id
  JOIN fields h ON h.document_id = r.document_id AND h.field_name = 'currency'
  WHERE f.field_name = 'currency' AND r.rk <= CASE WHEN o.own <= 11 THEN 11 ELSE 10 END GROUP BY ALL) w
WHERE NOT list_contains(known, upper(trim(w.field_value)))""", "fields", "trade_docs")


@query("history_check", "SELECT document_id, field_name, field_value, array_to_string(known, ',') AS known FROM history", ("history",))
def history_check(spark, sf):
    h = quality.history_check(_quality_docs(spark, sf, True), views.extracted_fields(spark, sf))
    return h.withColumn("known", F.array_join("known", ","))


_DATE_RE = r"^\d{4}-\d{2}-\d{2}$|^\d{2}[/.\-]\d{2}[/.\-]\d{4}$"
O.view("format_ok", f"""
SELECT *, CASE field_name WHEN 'currency' THEN regexp_matches(v, '(?i)^[A-Z]{{3}}$') WHEN 'po_number' THEN regexp_matches(v, '(?i)^(?:[A-Z]{{2,6}}[/\\-]\\d{{4,8}}|\\d{{7,12}})')
  WHEN 'invoice_number' THEN regexp_matches(v, '(?i)^[A-Z0-9][A-Z0-9/\\-.]{{1,39}}$') WHEN 'po_date' THEN regexp_matches(v, '{_DATE_RE}') WHEN 'invoice_date' THEN regexp_matches(v, '{_DATE_RE}')
  WHEN 'total_amount' THEN regexp_matches(v, '^[\\d,.]+$') WHEN 'total_order_value' THEN regexp_matches(v, '^[\\d,.]+$') END AS ok
FROM (SELECT *, trim(CASE WHEN k % 23 = 0 AND field_name = 'currency' THEN field_value || 'X' WHEN k % 19 = 0 AND ordinal = 0 THEN 'n/a' ELSE field_value END) AS v FROM fields)""", "fields")


def _spoiled_fields(spark, sf):
    """Some currencies too long, some numbers a placeholder."""
    f = views.extracted_fields(spark, sf)
    v = (F.when((F.col("k") % 23 == 0) & (F.col("field_name") == "currency"), F.concat("field_value", F.lit("X")))
         .when((F.col("k") % 19 == 0) & (F.col("ordinal") == 0), "n/a").otherwise(F.col("field_value")))
    return f.withColumn("field_value", v)


@query("format_check", "SELECT document_id, field_name, v AS field_value, ok FROM format_ok", ("format_ok",))
def format_check(spark, sf):
    return _spoiled_fields(spark, sf).select("document_id", "field_name", "field_value",
                                             V.format_check(F.col("field_name"), F.col("field_value")).alias("ok"))


@query("second_opinion", """
SELECT document_id, field_name, CAST(CASE WHEN ok THEN least(confidence + 0.04, 0.97) WHEN NOT ok THEN greatest(confidence - 0.06, 0.50) ELSE confidence END AS DOUBLE) AS new_confidence FROM format_ok""", ("format_ok",))
def second_opinion(spark, sf):
    f = _spoiled_fields(spark, sf)
    return fieldset.second_opinion(f, V.format_check(F.col("field_name"), F.col("field_value"))).select("document_id", "field_name", "new_confidence")


@query("low_confidence", """
SELECT CASE k % 4 WHEN 0 THEN 'ZERO_SHOT' WHEN 1 THEN 'LEARNING' WHEN 2 THEN 'LEARNED' ELSE 'OPTIMISED' END AS stage, count(*) AS low FROM fields
WHERE confidence < 0.85 AND k % 4 IN (0, 1) GROUP BY 1""", ("fields",))
def low_confidence(spark, sf):
    f = views.extracted_fields(spark, sf).withColumn("stage", views.pick(F.col("k") % 4, "ZERO_SHOT", "LEARNING", "LEARNED", "OPTIMISED"))
    return fieldset.low_confidence(f, F.col("stage")).groupBy("stage").agg(F.count(F.lit(1)).alias("low"))


O.view("flags", f"""
SELECT document_id, field_name, 'FORMAT' AS kind, 'ERROR' AS severity FROM format_ok WHERE NOT ok
UNION ALL SELECT document_id, field_name, 'SHORT', 'WARNING' FROM format_ok WHERE length(v) < CASE field_name WHEN 'supplier_name' THEN 3 WHEN 'invoice_number' THEN 3 WHEN 'po_number' THEN 5 END
UNION ALL SELECT document_id, field_name, 'LONG', 'ERROR' FROM format_ok WHERE length(v) > CASE field_name WHEN 'currency' THEN 3 WHEN 'invoice_number' THEN 40 WHEN 'po_number' THEN 30 END
UNION ALL SELECT document_id, field_name, 'PLACEHOLDER', 'WARNING' FROM format_ok WHERE lower(v) IN ('null', 'none', 'n/a', 'n.a.', '-', '–', 'tbd', 'xxx')
UNION ALL SELECT document_id, r.field_name, 'MISSING', 'ERROR' FROM trade_docs JOIN {O.values('class_id, field_name', [(c, f) for c in QUALITY_DOCS for f in R.PROOF_REQUIRED[c]])
    .replace('AS t(', 'AS r(')} USING (class_id) WHERE NOT EXISTS (SELECT 1 FROM fields f WHERE f.document_id = trade_docs.document_id AND f.field_name = r.field_name)""",
       "format_ok", "trade_docs", "fields")


O.view("layout_history", f"""
SELECT r.variant_id, h.field_name, list({{'document_id': r.document_id, 'rk': r.rk, 'v': upper(h.v)}}) AS past FROM (
  SELECT variant_id, document_id, row_number() OVER (PARTITION BY variant_id ORDER BY created_at DESC, document_id DESC) AS rk FROM trade_docs WHERE variant_id IS NOT NULL
) r JOIN format_ok h ON h.document_id = r.document_id WHERE r.rk <= 11 AND h.field_name IN {tuple(R.STABLE_FIELDS)} AND h.v <> '' GROUP BY ALL""", "format_ok", "trade_docs")
O.view("history_flags", """
SELECT document_id, field_name, 'HISTORY' AS kind, 'WARNING' AS severity FROM (
  SELECT f.document_id, f.field_name, upper(f.v) AS v, [p.v FOR p IN y.past IF p.document_id <> f.document_id AND (p.rk <= 10 OR list_contains([q.document_id FOR q IN y.past], f.document_id))] AS known
  FROM format_ok f JOIN trade_docs d ON d.document_id = f.document_id JOIN layout_history y ON y.variant_id = d.variant_id AND y.field_name = f.field_name WHERE f.v <> '')
WHERE len(known) > 0 AND NOT list_contains(known, v)""", "format_ok", "trade_docs", "layout_history")


@query("proof_flags", "SELECT kind, severity, field_name, count(*) AS n FROM (SELECT * FROM flags UNION ALL SELECT document_id, field_name, kind, severity FROM history_flags) GROUP BY ALL", ("flags", "history_flags"))
def proof_flags(spark, sf):
    """All flags, those of the layout's history too."""
    # read five times below, derived once
    rows = stored(_spoiled_fields(spark, sf).select("field_id", "document_id", "ordinal", "field_name", "field_value"), "spoiled-fields")
    f = quality.proof_flags(_quality_docs(spark, sf, True), rows)
    return f.groupBy("kind", "severity", "field_name").agg(F.count(F.lit(1)).alias("n"))


@query("proofread_scores", f"""
SELECT document_id, class_id, missing, bad_formats, anomalies, errors, warnings, avg_confidence::DOUBLE AS avg_confidence,
  round(CAST(0.4 * (need - missing)::DOUBLE / need + 0.3 * avg_confidence::DOUBLE + 0.2 * (19 - bad_formats)::DOUBLE / 19 + 0.1 * (1.0 - least(anomalies * 0.05, 0.10) / 0.10)::DOUBLE AS DECIMAL(20,10)), 4)::DOUBLE AS score,
  (need - missing)::DOUBLE / need >= 0.6 AND avg_confidence >= 0.6 AND errors <= 1 AS passed
FROM (SELECT d.document_id, d.class_id, CASE d.class_id {' '.join(f"WHEN '{c}' THEN {len(R.PROOF_REQUIRED[c])}" for c in QUALITY_DOCS)} END AS need, coalesce(missing, 0) AS missing, coalesce(bad_formats, 0) AS bad_formats,
    coalesce(anomalies, 0) AS anomalies, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(c, 0) AS avg_confidence
  FROM trade_docs d LEFT JOIN (SELECT document_id, round(CAST(avg(confidence) AS DECIMAL(18,8)), 4) AS c FROM fields GROUP BY 1) USING (document_id)
  LEFT JOIN (SELECT document_id, count(*) FILTER (kind = 'MISSING') AS missing, count(*) FILTER (kind = 'FORMAT') AS bad_formats,
    count(*) FILTER (kind IN ('SHORT', 'LONG', 'PLACEHOLDER')) AS anomalies, count(*) FILTER (severity = 'ERROR') AS errors,
    count(*) FILTER (severity = 'WARNING') AS warnings FROM flags GROUP BY 1) USING (document_id))""", ("flags", "trade_docs", "fields"))
def proofread_scores(spark, sf):
    return quality.proofread(_quality_docs(spark, sf), _spoiled_fields(spark, sf)).drop("required_rate")


INSTRUCTIONS = [
    R.Instruction(1, "FLAG_WARNING", "dc_006", "currency", "eq", "chf", "check rate", 10),
    R.Instruction(2, "SKIP_POSTING", "dc_006", "total_amount", "gt", "300000", None, 20),
    R.Instruction(3, "REQUIRE_APPROVAL", None, "supplier_name", "contains", "00000001", None, 30),
    R.Instruction(4, "SKIP_MATCHING", "dc_003", "total_order_value", "lt", "5,000", None, 40),
    R.Instruction(5, "NOTIFY_EMAIL", "dc_003", "po_number", "exists", None, "buyer@example.com", 50),
    R.Instruction(6, "FLAG_WARNING", "dc_006", "customer_po_ref", "neq", "TSL/999999", "own order", 60),
    R.Instruction(7, "FLAG_WARNING", "dc_006", None, None, None, "always", 70),
    R.Instruction(8, "FLAG_WARNING", None, "currency", "between", "1", "unknown operator", 80),
    R.Instruction(9, "REQUIRE_APPROVAL", None, "currency", "exists", None, None, 5, False),
]
O.view("fired_all", """
SELECT document_id, i.* FROM wide w, LATERAL (
  SELECT 0 AS place, 1 AS instruction_id, 'FLAG_WARNING' AS action, 'check rate' AS action_value WHERE class_id = 'dc_006' AND lower(trim(coalesce(currency, ''))) = 'chf'
  UNION ALL SELECT 1, 2, 'SKIP_POSTING', NULL WHERE class_id = 'dc_006' AND TRY_CAST(replace(total_amount, ',', '') AS DECIMAL(18,6)) > 300000
  UNION ALL SELECT 2, 3, 'REQUIRE_APPROVAL', NULL WHERE contains(lower(coalesce(supplier_name, '')), '00000001')
  UNION ALL SELECT 3, 4, 'SKIP_MATCHING', NULL WHERE class_id = 'dc_003' AND TRY_CAST(replace(total_order_value, ',', '') AS DECIMAL(18,6)) < 5000
  UNION ALL SELECT 4, 5, 'NOTIFY_EMAIL', 'buyer@example.com' WHERE class_id = 'dc_003' AND trim(coalesce(po_number, '')) <> ''
  UNION ALL SELECT 5, 6, 'FLAG_WARNING', 'own order' WHERE class_id = 'dc_006' AND lower(trim(coalesce(customer_po_ref, ''))) <> 'tsl/999999'
  UNION ALL SELECT 6, 7, 'FLAG_WARNING', 'always' WHERE class_id = 'dc_006') i""", "wide")
O.view("fired", """
SELECT * FROM fired_all f WHERE place <= coalesce((SELECT min(place) FROM fired_all s WHERE s.document_id = f.document_id AND action = 'REQUIRE_APPROVAL'), 99)""", "fired_all")


@query("instructions_fired", "SELECT * FROM fired", ("fired",))
def instructions_fired(spark, sf):
    return quality.fired_instructions(_quality_docs(spark, sf), views.extracted_fields(spark, sf), INSTRUCTIONS)


@query("instructions_dry_run", "SELECT instruction_id, action, count(*) AS documents FROM fired_all GROUP BY 1, 2", ("fired_all",))
def instructions_dry_run(spark, sf):
    f = quality.fired_instructions(_quality_docs(spark, sf), views.extracted_fields(spark, sf), INSTRUCTIONS, all_fired=True)
    return f.groupBy("instruction_id", "action").agg(F.count(F.lit(1)).alias("documents"))


@query("instruction_effects", """
SELECT document_id, bool_or(action = 'REQUIRE_APPROVAL') AS needs_approval, bool_or(action = 'SKIP_POSTING') AS skip_posting, bool_or(action = 'SKIP_MATCHING') AS skip_matching,
  count(*) FILTER (action = 'FLAG_WARNING') AS warnings, count(*) FILTER (action = 'NOTIFY_EMAIL') AS notifications,
  min(instruction_id) FILTER (action = 'REQUIRE_APPROVAL') AS approval_rule FROM fired GROUP BY 1""", ("fired",))
def instruction_effects(spark, sf):
    return quality.instruction_effects(instructions_fired(spark, sf))
