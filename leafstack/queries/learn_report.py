"""Queries: layouts, learning, linking, reports, queues, outputs, routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafstack import rules as R
from leafstack.functions import names as N
from leafstack.operators import audits, fieldset, layouts, learning, links, outputs, pages, quality, queues, trimatch
from leafstack.plans import flow
from leafstack.plans import stages as S
from leafstack.queries import fields_match as FM
from leafstack.queries import oracle as O
from leafstack.queries import views
from leafstack.queries.registry import query
from leafstack.session import Scratch, stored
from leafstack.sources import sinks, tables

# ---- layouts ---------------------------------------------------------------------------------


@query("issuer_slug", """
SELECT document_id, replace(replace(lower(trim(value)), '#', ' '), ' ', '-') AS issuer_slug FROM eff WHERE field_name = 'supplier_name' AND length(trim(field_value)) > 2""", ("eff",))
def issuer_slug(spark, sf):
    f = views.extracted_fields(spark, sf)
    out = layouts.issuer_slugs(f.withColumn("field_name", F.when(F.col("field_name") == "supplier_name", "entity").otherwise(F.col("field_name"))))
    return out


def _layout_fields(spark, sf):
    """Field names as a layout would show them: some line items, some all capitals."""
    name = (F.when(F.col("ordinal") == 1, "Item 1 Qty").when((F.col("ordinal") == 2) & (F.col("k") % 2 == 0), "PLANT NAME")
            .otherwise(F.col("field_name")))
    return views.extracted_fields(spark, sf).withColumn("field_name", name)


O.view("prints", """
SELECT document_id, list_sort(list(field_name)) AS field_names FROM fields WHERE ordinal <> 1 AND NOT (ordinal = 2 AND k % 2 = 0) GROUP BY 1""", "fields")


@query("fingerprint", "SELECT document_id, array_to_string(field_names, ',') AS fingerprint FROM prints", ("prints",))
def fingerprint(spark, sf):
    return layouts.fingerprints(_layout_fields(spark, sf)).select("document_id", "fingerprint")


KNOWN = [
    ("L1", "dc_006", "unknown", ["currency", "customer_po_ref", "invoice_number", "supplier_name", "total_amount"], ["a", "b", "c", "d"], 2, True),
    ("L2", "dc_006", "unknown", ["customer_po_ref", "invoice_number", "supplier_name", "total_amount"], ["a", "b", "c", "x", "y"], 2, True),
    ("L3", "dc_003", "acme", ["currency", "po_number", "supplier_name", "total_order_value"], ["q", "r", "s"], None, True),
    ("L4", "dc_003", "unknown", ["po_number", "supplier_name", "total_order_value", "extra_one", "extra_two"], [], 9, True),
    ("L5", "dc_006", "unknown", ["invoice_number"], [], 1, False),
]


def _layout_docs(spark, sf):
    f = layouts.fingerprints(_layout_fields(spark, sf)).select("document_id", "field_names")
    d = views.trade_docs(spark, sf)
    labels = F.when(F.col("k") % 3 == 0, F.array(*map(F.lit, "abc"))).when(F.col("k") % 3 == 1, F.array(*map(F.lit, "abcd"))).otherwise(F.array(F.lit("z")))
    return d.join(f, "document_id").select(
        "document_id", "class_id", "k", "field_names", labels.alias("labels"), (F.col("k") % 5 + 1).cast("int").alias("pages_total"),
        F.when(F.col("k") % 2 == 0, "acme").otherwise("other").alias("issuer_slug"))


def _known(spark):
    return spark.createDataFrame(KNOWN, "variant_id string, class_id string, issuer_slug string, field_names array<string>, labels array<string>, page_count_mode int, active boolean")


_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"
O.view("known", " UNION ALL ".join(
    f"SELECT '{v}' AS variant_id, '{c}' AS class_id, '{i}' AS v_issuer, {_list(f)} AS v_names, {_list(lb)} AS v_labels, {m or 'NULL'}::INT AS mode" for v, c, i, f, lb, m, a in KNOWN if a))
O.view("layout_docs", """
SELECT document_id, class_id, field_names, CASE k % 3 WHEN 0 THEN ['a','b','c'] WHEN 1 THEN ['a','b','c','d'] ELSE ['z'] END AS labels, k % 5 + 1 AS pages_total,
  CASE WHEN k % 2 = 0 THEN 'acme' ELSE 'other' END AS issuer_slug FROM trade_docs JOIN prints USING (document_id)""", "trade_docs", "prints")
O.view("cands", """
SELECT * FROM (SELECT d.*, k.variant_id, k.mode, len(d.labels) < 3 AS image_like,
  len(list_intersect(field_names, v_names))::DOUBLE / len(list_distinct(field_names || v_names)) AS field_j,
  CASE WHEN len(v_labels) = 0 THEN 0.0 ELSE len(list_intersect(labels, v_labels))::DOUBLE / len(list_distinct(labels || v_labels)) END AS label_j
  FROM layout_docs d JOIN known k ON d.class_id = k.class_id AND (v_issuer = 'unknown' OR v_issuer = d.issuer_slug))
WHERE field_j >= 0.6 OR label_j >= 0.5 OR (image_like AND NOT coalesce(abs(pages_total - mode) > 3, FALSE))""", "layout_docs", "known")
O.view("decided", """
SELECT d.document_id, d.class_id, d.issuer_slug, d.field_names, b.variant_id, field_j, label_j,
  CASE WHEN b.variant_id IS NULL THEN 'new' WHEN (field_j >= 0.85 OR label_j >= 0.75 OR (field_j >= 0.6 AND label_j >= 0.5)) AND coalesce(abs(d.pages_total - mode) <= 1, TRUE) AND NOT image_like THEN 'accept' ELSE 'needs_confirm' END AS decision
FROM layout_docs d LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY greatest(field_j, label_j) DESC, variant_id) AS rn FROM cands) b ON b.document_id = d.document_id AND rn = 1""", "layout_docs", "cands")


@query("variant_jaccard", "SELECT document_id, variant_id, round(field_j, 9) AS field_j, round(label_j, 9) AS label_j FROM cands", ("cands",))
def variant_jaccard(spark, sf):
    return layouts.variant_candidates(_layout_docs(spark, sf), _known(spark)).select(
        "document_id", "variant_id", F.round("field_j", 9).alias("field_j"), F.round("label_j", 9).alias("label_j"))


@query("discover_variants", "SELECT document_id, variant_id, decision FROM decided", ("decided",))
def discover_variants(spark, sf):
    return layouts.discover_variants(_layout_docs(spark, sf), _known(spark)).select("document_id", "variant_id", "decision")


O.view("fresh", "SELECT * FROM layout_docs", "layout_docs")


@query("new_variants", """
SELECT class_id, issuer_slug, fingerprint, doc_count, substr(issuer_slug || '__' || array_to_string(names[1:4], ','), 1, 200) AS variant_key,
  upper(issuer_slug[1]) || issuer_slug[2:] || ' ' || CASE class_id WHEN 'dc_003' THEN 'Order' ELSE 'Invoice' END || ' — Format ' || chr(CAST(64 + n + 1 AS INT)) AS variant_label,
  CASE WHEN doc_count >= 50 THEN 'OPTIMISED' WHEN doc_count >= 10 THEN 'LEARNED_PROPOSED' WHEN doc_count >= 3 THEN 'LEARNING' ELSE 'ZERO_SHOT' END AS learning_stage
FROM (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY issuer_slug, fingerprint) AS n FROM (
  SELECT class_id, issuer_slug, array_to_string(field_names, ',') AS fingerprint, field_names AS names, count(*) AS doc_count FROM fresh GROUP BY ALL))""", ("fresh",))
def new_variants(spark, sf):
    """Layouts a class would get if none were known yet (one existing per class keeps its letter)."""
    none = _known(spark).limit(0)
    names = spark.createDataFrame([("dc_003", "Order"), ("dc_006", "Invoice")], "class_id string, name string")
    existing = spark.createDataFrame([("dc_003", 1), ("dc_006", 1)], "class_id string, variants int")
    return layouts.new_variants(layouts.discover_variants(_layout_docs(spark, sf), none), names, existing).drop("first_document_id")


@query("template_difference", """
SELECT document_id, array_to_string(list_sort(list_filter(['currency', 'iban', 'po_number'], lambda x: NOT list_contains(field_names, x))), ',') AS missing,
  array_to_string(list_sort(list_filter(field_names, lambda x: NOT list_contains(['currency', 'iban', 'po_number'], x))), ',') AS extra FROM prints""", ("prints",))
def template_difference(spark, sf):
    p = layouts.fingerprints(_layout_fields(spark, sf))
    d = layouts.template_difference(F.col("field_names"), F.array(F.lit("currency"), F.lit("iban"), F.lit("po_number")))
    return p.select("document_id", F.array_join(d["missing"], ",").alias("missing"), F.array_join(d["extra"], ",").alias("extra"))


@query("structural_profile", """
SELECT variant_id, sum(n) AS instances, arg_min(pages_total, (-n, seen)) AS page_count_mode, min(pages_total) AS page_count_min, max(pages_total) AS page_count_max
FROM (SELECT variant_id, pages_total, count(*) AS n, min((created_at, document_id)) AS seen FROM registry WHERE pages_total IS NOT NULL GROUP BY 1, 2) GROUP BY 1""", ("registry",))
def structural_profile(spark, sf):
    return layouts.structural_profile(views.registry(spark, sf).filter(F.col("pages_total").isNotNull()))


@query("filename_patterns", r"""
SELECT variant_id, pattern, documents, place FROM (SELECT variant_id, pattern, count(*) AS documents, row_number() OVER (PARTITION BY variant_id ORDER BY min((created_at, document_id))) AS place
  FROM (SELECT *, CASE doc_id % 13 WHEN 0 THEN 'Scan\ \d+' ELSE chr(CAST(97 + doc_id % 13 AS INT)) || 'xx_\d+' END AS pattern FROM registry) GROUP BY 1, 2) WHERE place <= 10""", ("registry",))
def filename_patterns(spark, sf):
    i = F.col("doc_id")
    name = F.when(i % 13 == 0, F.concat(F.lit("Scan "), i, F.lit(".pdf"))).otherwise(F.concat(F.chr(F.lit(97) + i % 13), F.lit("xx_"), i, F.lit(".pdf")))
    return layouts.filename_patterns(views.registry(spark, sf).withColumn("file_name", name))


O.view("head_lines", """
SELECT variant_id, document_id, CASE page_num WHEN 0 THEN substr(text, 1, 2) ELSE substr(text, 1, 1) END AS text FROM doc_pages WHERE page_num <= 1 AND text <> ''""", "doc_pages")


@query("known_headings", """
SELECT variant_id, text, n, instances FROM (SELECT variant_id, text, count(*) AS n FROM head_lines GROUP BY 1, 2) JOIN (SELECT variant_id, count(DISTINCT document_id) AS instances FROM doc_pages GROUP BY 1) USING (variant_id)
WHERE instances >= 3 AND n >= greatest(1, instances // 8)""", ("head_lines", "doc_pages"))
def known_headings(spark, sf):
    p = views.doc_pages(spark, sf)
    rows = p.filter((F.col("page_num") <= 1) & (F.col("text") != "")).select(
        "variant_id", "document_id", F.lit("heading").alias("kind"),
        F.when(F.col("page_num") == 0, F.substring("text", 1, 2)).otherwise(F.substring("text", 1, 1)).alias("text"))
    inst = p.groupBy("variant_id").agg(F.countDistinct("document_id").alias("real"))
    quarter = inst.select("variant_id", F.floor(F.col("real") / 4).alias("instances"))
    out = layouts.known_lines(rows, quarter.filter(F.col("instances") >= 3))
    low = rows.groupBy("variant_id", "text").agg(F.count(F.lit(1)).alias("n")).join(inst, "variant_id").filter(
        (F.col("real") >= 3) & (F.floor(F.col("real") / 4) < 3) & (F.col("n") >= F.greatest(F.lit(1), F.floor(F.col("real") / 8))))
    return out.select("variant_id", "text", "n").join(inst, "variant_id").unionByName(low).withColumnRenamed("real", "instances")


@query("expected_pages", """
SELECT variant_id, arg_min(pages_total, (-n, seen)) AS expected_pages FROM (SELECT variant_id, pages_total, count(*) AS n, min((created_at, document_id)) AS seen FROM registry WHERE pages_total IS NOT NULL GROUP BY 1, 2)
GROUP BY 1 HAVING sum(n) >= 3""", ("registry",))
def expected_pages(spark, sf):
    return layouts.expected_page_count(structural_profile(spark, sf))


@query("label_fingerprint", "SELECT variant_id, label, count(*) AS documents FROM (SELECT issuer_slug AS variant_id, unnest(labels) AS label FROM layout_docs) GROUP BY ALL", ("layout_docs",))
def label_fingerprint(spark, sf):
    return layouts.label_fingerprint(_layout_docs(spark, sf).withColumnRenamed("issuer_slug", "variant_id"))


@query("signature_location", """
WITH RECURSIVE f AS (
  SELECT variant_id, row_number() OVER (PARTITION BY variant_id ORDER BY created_at, document_id) AS i,
    doc_id * 5 % pages_total AS page, pages_total AS n, [(doc_id * 3) % 100 / 100, (doc_id * 7) % 100 / 100, (doc_id * 11) % 100 / 100, (doc_id * 13) % 100 / 100] AS bbox,
    CASE WHEN doc_id % 3 = 0 THEN 'signed by' END AS label
  FROM registry WHERE pages_total IS NOT NULL),
g AS MATERIALIZED (SELECT *, CASE WHEN page < n - 1 - page THEN 'start' ELSE 'end' END AS a, least(page, n - 1 - page) AS o FROM f),
r AS (
  SELECT variant_id, i, a, CAST(o AS BIGINT) AS off, list_transform(bbox, lambda v: round_even(v, 4)) AS box, label FROM g WHERE i = 1
  UNION ALL
  SELECT g.variant_id, g.i, g.a, CASE WHEN r.a = g.a THEN CAST(round_even((r.off * r.i + g.o) / (r.i + 1), 0) AS BIGINT) ELSE CAST(g.o AS BIGINT) END,
    [CAST(round_even(CAST((r.box[1] * r.i + g.bbox[1]) / (r.i + 1) AS DECIMAL(24, 17)), 4) AS DOUBLE), CAST(round_even(CAST((r.box[2] * r.i + g.bbox[2]) / (r.i + 1) AS DECIMAL(24, 17)), 4) AS DOUBLE),
     CAST(round_even(CAST((r.box[3] * r.i + g.bbox[3]) / (r.i + 1) AS DECIMAL(24, 17)), 4) AS DOUBLE), CAST(round_even(CAST((r.box[4] * r.i + g.bbox[4]) / (r.i + 1) AS DECIMAL(24, 17)), 4) AS DOUBLE)], coalesce(g.label, r.label)
  FROM r JOIN g ON g.variant_id = r.variant_id AND g.i = r.i + 1)
SELECT variant_id, i AS instances, a AS page_anchor, off AS page_offset, round(box[1], 2) AS x0, round(box[2], 2) AS y0, round(box[3], 2) AS x1, round(box[4], 2) AS y1, label AS label_nearby, i >= 3 AS confident
FROM r QUALIFY row_number() OVER (PARTITION BY variant_id ORDER BY i DESC) = 1""", ("registry",))
def signature_location(spark, sf):
    d = views.registry(spark, sf)
    i = F.col("doc_id")
    found = d.filter(F.col("pages_total").isNotNull()).select(
        "variant_id", "document_id", "created_at", (i * 5 % F.col("pages_total")).alias("page"), F.col("pages_total").alias("page_count"),
        F.array(*[((i * m) % 100 / 100).cast("double") for m in (3, 7, 11, 13)]).alias("bbox"), F.when(i % 3 == 0, "signed by").alias("label"))
    return layouts.signature_location(found).select("*", *(F.round(F.col("bbox_hint")[k], 2).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1")))).drop("bbox_hint")


@query("signature_anchor_last", """
SELECT variant_id, count(*) AS instances, arg_max(CASE WHEN page < pages_total - 1 - page THEN 'start' ELSE 'end' END, doc_id) AS page_anchor, count(*) >= 3 AS confident
FROM (SELECT *, doc_id * 5 % pages_total AS page FROM registry WHERE pages_total IS NOT NULL) GROUP BY 1""", ("registry",))
def signature_anchor_last(spark, sf):
    return signature_location(spark, sf).select("variant_id", "instances", "page_anchor", "confident")


# ---- learning ------------------------------------------------------------------------------------

TARGETS = [("dc_003", f) for f in FM.R.VALIDATION_REQUIRED["dc_003"] + ["po_date", "iban"]] + [("dc_006", f) for f in FM.R.VALIDATION_REQUIRED["dc_006"] + ["iban"]]
O.view("field_stats", f"""
SELECT t.class_id, t.field_name, total_seen, coalesce(found_count, 0) AS found_count, coalesce(confidence_sum, 0) AS confidence_sum FROM {O.values('class_id, field_name', TARGETS)}
JOIN (SELECT class_id, count(*) AS total_seen FROM trade_docs GROUP BY 1) USING (class_id)
LEFT JOIN (SELECT class_id, field_name, count(*) AS found_count, sum(confidence) AS confidence_sum FROM fields JOIN trade_docs USING (document_id) GROUP BY 1, 2) USING (class_id, field_name)""", "fields", "trade_docs")
O.view("stat_examples", """
SELECT class_id, field_name, list(field_value ORDER BY i) AS ex FROM (SELECT *, row_number() OVER (PARTITION BY class_id, field_name ORDER BY o, field_value) AS i FROM (
  SELECT class_id, field_name, field_value, min((created_at, document_id)) AS o FROM fields JOIN trade_docs USING (document_id) GROUP BY 1, 2, 3)) WHERE i <= 6 GROUP BY 1, 2""", "fields", "trade_docs")


def _stats(spark, sf):
    t = spark.createDataFrame(TARGETS, "class_id string, field_name string")
    return learning.field_stats(views.trade_docs(spark, sf), views.extracted_fields(spark, sf), t)


@query("field_stats", """
SELECT class_id, field_name, total_seen, found_count, confidence_sum::DOUBLE AS confidence_sum, coalesce(array_to_string(ex, '|'), '') AS examples FROM field_stats LEFT JOIN stat_examples USING (class_id, field_name)""", ("field_stats", "stat_examples"))
def field_stats(spark, sf):
    return _stats(spark, sf).withColumn("examples", F.array_join("examples", "|"))


@query("computed_field_stats", """
SELECT class_id, field_name, total_seen, found_count, CAST(round(CAST(found_count::DOUBLE / total_seen AS DECIMAL(18,10)), 2) AS DOUBLE) AS occurrence_rate,
  CASE WHEN found_count > 0 THEN CAST(round(CAST(confidence_sum::DOUBLE / found_count AS DECIMAL(18,10)), 2) AS DOUBLE) ELSE 0 END AS avg_confidence FROM field_stats""", ("field_stats",))
def computed_field_stats(spark, sf):
    return learning.computed_field_stats(_stats(spark, sf)).drop("examples")


@query("schema_gate", """
SELECT class_id, count(*) AS target_fields, count(*) FILTER (found_count >= 0.4 * total_seen AND confidence_sum >= 0.76 * found_count AND found_count > 0) AS qualifying,
  count(*) FILTER (found_count >= 0.4 * total_seen AND confidence_sum >= 0.76 * found_count AND found_count > 0) >= 0.55 * count(*) AS passed FROM field_stats WHERE class_id IN ('dc_003', 'dc_006') GROUP BY 1""", ("field_stats",))
def schema_gate(spark, sf):
    return learning.schema_quality_gate(_stats(spark, sf))


@query("propose_schema", """
SELECT class_id, field_name, round(CAST(found_count::DOUBLE / total_seen AS DECIMAL(18,10)), 2) >= 0.70 AS required,
  CASE field_name WHEN 'currency' THEN 'ISO 4217 three-letter currency code only (e.g. ' || ex[1] || ').' WHEN 'po_number' THEN 'Reference code — copy verbatim (e.g. ' || ex[1] || ').'
    WHEN 'invoice_number' THEN 'Reference code — copy verbatim (e.g. ' || ex[1] || ').' WHEN 'customer_po_ref' THEN 'Reference code — copy verbatim (e.g. ' || ex[1] || ').'
    WHEN 'po_date' THEN 'Date in YYYY-MM-DD format (e.g. ' || ex[1] || '). No time component.' WHEN 'invoice_date' THEN 'Date in YYYY-MM-DD format (e.g. ' || ex[1] || '). No time component.'
    WHEN 'total_amount' THEN 'DECIMAL number (e.g. ' || ex[1] || '). Digits and decimal point only.' WHEN 'total_order_value' THEN 'DECIMAL number (e.g. ' || ex[1] || '). Digits and decimal point only.' ELSE '' END AS format_hint
FROM field_stats LEFT JOIN stat_examples USING (class_id, field_name)""", ("field_stats", "stat_examples"))
def propose_schema(spark, sf):
    return learning.propose_schema(_stats(spark, sf)).select("class_id", "field_name", "required", "format_hint")


O.view("typed_values", r"""
SELECT *, CASE WHEN upper(v) IN ('EUR', 'GBP', 'USD', 'CHF') THEN 'currency_code' WHEN regexp_matches(v, '^\d{4}-\d{2}-\d{2}$') THEN 'date'
  WHEN regexp_matches(v, '^\d+\.\d+$') AND TRY_CAST(v AS DOUBLE) <= 100 THEN 'decimal' WHEN regexp_matches(v, '^\d+\.\d+$') THEN 'decimal'
  WHEN regexp_matches(upper(v), '^[A-Z0-9][A-Z0-9/\-.]{2,29}$') THEN 'code' ELSE 'text' END AS t FROM (SELECT *, trim(field_value) AS v FROM fields)""", "fields")


@query("value_formats", "SELECT field_name, t AS format_type, count(*) AS values FROM typed_values GROUP BY 1, 2", ("typed_values",))
def value_formats(spark, sf):
    return learning.value_formats(views.extracted_fields(spark, sf))


@query("format_inference", """
SELECT variant_id, field_name, least(count(DISTINCT field_value), 30) AS value_count, CASE field_name WHEN 'currency' THEN 'currency_code' WHEN 'invoice_date' THEN 'date' WHEN 'total_amount' THEN 'decimal' WHEN 'supplier_name' THEN 'text' ELSE 'code' END AS format_type
FROM fields JOIN trade_docs USING (document_id) WHERE variant_id IS NOT NULL GROUP BY 1, 2""", ("fields", "trade_docs"))
def format_inference(spark, sf):
    return learning.majority_format(views.trade_docs(spark, sf), views.extracted_fields(spark, sf)).select(
        "variant_id", "field_name", "value_count", "format_type")


@query("stage_timeline", """
SELECT variant_id, document_id, doc_no, CASE WHEN doc_no >= 50 THEN 'OPTIMISED' WHEN doc_no >= 10 THEN 'LEARNED_PROPOSED' WHEN doc_no >= 3 THEN 'LEARNING' ELSE 'ZERO_SHOT' END AS stage
FROM (SELECT variant_id, document_id, row_number() OVER (PARTITION BY variant_id ORDER BY created_at, document_id) AS doc_no FROM trade_docs WHERE variant_id IS NOT NULL)""", ("trade_docs",))
def stage_timeline(spark, sf):
    return learning.stage_timeline(views.trade_docs(spark, sf)).drop("created_at")


def _corrections(spark, sf):
    f = views.extracted_fields(spark, sf).filter("human_corrected")
    return f.select("document_id", "field_name", F.col("corrected_value").alias("new_value"), F.lit("ann").alias("corrected_by"),
                    views.epoch_plus(F.col("k") + F.col("ordinal")).alias("corrected_at"))


@query("confirmed_instances", """
SELECT variant_id, count(DISTINCT document_id) AS confirmed_instances, min(TIMESTAMP '2024-01-01' + to_minutes(CAST(f.k + ordinal AS BIGINT))) AS first_corrected_at
FROM fields f JOIN trade_docs d USING (document_id) WHERE human_corrected AND variant_id IS NOT NULL GROUP BY 1""", ("fields", "trade_docs"))
def confirmed_instances(spark, sf):
    return learning.confirmed_instances(views.trade_docs(spark, sf), _corrections(spark, sf))


@query("variant_schema_counts", """
SELECT variant_id, field_name, documents, coalesce(example, '') AS example FROM (SELECT variant_id, field_name, count(*) AS documents FROM fields JOIN trade_docs USING (document_id) WHERE variant_id IS NOT NULL GROUP BY 1, 2)
LEFT JOIN (SELECT variant_id, field_name, field_value AS example FROM fields JOIN (SELECT variant_id, document_id, row_number() OVER (PARTITION BY variant_id ORDER BY created_at DESC, document_id DESC) AS rn FROM trade_docs WHERE variant_id IS NOT NULL) USING (document_id) WHERE rn = 1) USING (variant_id, field_name)""", ("fields", "trade_docs"))
def variant_schema_counts(spark, sf):
    return learning.variant_schema_from_counts(views.trade_docs(spark, sf), views.extracted_fields(spark, sf))


@query("variant_field_confidence", """
SELECT variant_id, canonical, coalesce(CAST(floor(sum(s) * 100 / sum(n)) AS INT), 0) AS confidence_pct FROM variant_schema LEFT JOIN (
  SELECT variant_id, field_name AS alias, sum(confidence) AS s, count(*) AS n FROM fields JOIN trade_docs USING (document_id) GROUP BY 1, 2) USING (variant_id, alias) GROUP BY 1, 2""", ("variant_schema", "fields", "trade_docs"))
def variant_field_confidence(spark, sf):
    return learning.variant_field_confidence(views.trade_docs(spark, sf), views.extracted_fields(spark, sf), views.variant_schema(spark, sf))


@query("coverage_matrix", """
SELECT variant_id, document_id, canonical, CASE WHEN c IS NULL THEN 'missing' WHEN c >= 0.70 THEN 'found' ELSE 'low' END AS cell FROM (
  SELECT d.variant_id, d.document_id, s.canonical, max(f.confidence) AS c FROM (
    SELECT variant_id, document_id, row_number() OVER (PARTITION BY variant_id ORDER BY created_at DESC, document_id DESC) AS rn FROM trade_docs WHERE variant_id IS NOT NULL) d
  JOIN variant_schema s ON s.variant_id = d.variant_id LEFT JOIN fields f ON f.document_id = d.document_id AND f.field_name = s.alias WHERE rn <= 8 GROUP BY ALL)""", ("variant_schema", "fields", "trade_docs"))
def coverage_matrix(spark, sf):
    return learning.coverage_matrix(views.trade_docs(spark, sf), views.extracted_fields(spark, sf), views.variant_schema(spark, sf))


CLASS_ROWS = [(c, n, s, t) for c, (n, s, t) in R.CLASSES.items()]
CLASS_SQL = O.values("class_id, name, slug, treatment", CLASS_ROWS)


@query("class_overview", f"""
SELECT class_id, name, coalesce(variant_count, 0) AS variant_count, coalesce(doc_count, 0) AS doc_count, coalesce(best, 'ZERO_SHOT') AS best_stage, coalesce(schema_fields, 0) AS schema_fields, last_activity
FROM {CLASS_SQL} LEFT JOIN (SELECT class_id, count(*) AS variant_count, sum(doc_count) AS doc_count,
  arg_max(learning_stage, CASE learning_stage WHEN 'OPTIMISED' THEN 5 WHEN 'LEARNED_PROPOSED' THEN 3 WHEN 'LEARNING' THEN 2 ELSE 1 END) AS best FROM variants GROUP BY 1) USING (class_id)
LEFT JOIN (SELECT class_id, count(DISTINCT (variant_id, canonical)) AS schema_fields FROM variant_schema JOIN variants USING (variant_id) GROUP BY 1) USING (class_id)
LEFT JOIN (SELECT class_id, max(created_at) AS last_activity FROM trade_docs GROUP BY 1) USING (class_id)""", ("variants", "variant_schema", "trade_docs"))
def class_overview(spark, sf):
    return learning.class_overview(R.class_table(spark), views.variants(spark, sf), views.trade_docs(spark, sf), views.variant_schema(spark, sf))


@query("last_activity", "SELECT variant_id, max(created_at) AS last_activity FROM registry GROUP BY 1", ("registry",))
def last_activity(spark, sf):
    return learning.last_activity(views.registry(spark, sf))


@query("advance_stages", """
SELECT class_id, doc_count, old_stage, CASE WHEN old_stage = 'ZERO_SHOT' AND doc_count >= 3 THEN 'LEARNING' WHEN old_stage = 'LEARNING' AND doc_count >= 10 AND coalesce(passed, FALSE) THEN 'LEARNED_PROPOSED' ELSE old_stage END AS new_stage,
  old_stage = 'LEARNED' AND doc_count >= 25 AS assess_parsability
FROM (SELECT class_id, count(*) AS doc_count, CASE class_id WHEN 'dc_003' THEN 'LEARNING' WHEN 'dc_006' THEN 'LEARNING' WHEN 'dc_007' THEN 'LEARNED' ELSE 'ZERO_SHOT' END AS old_stage FROM trade_docs GROUP BY 1)
LEFT JOIN (SELECT class_id, count(*) FILTER (found_count >= 0.4 * total_seen AND confidence_sum >= 0.76 * found_count AND found_count > 0) >= 0.55 * count(*) AS passed FROM field_stats GROUP BY 1) USING (class_id)""", ("trade_docs", "field_stats"))
def advance_stages(spark, sf):
    p = views.trade_docs(spark, sf).groupBy("class_id").agg(F.count(F.lit(1)).alias("doc_count")).withColumn(
        "learning_stage", F.when(F.col("class_id").isin("dc_003", "dc_006"), "LEARNING").when(F.col("class_id") == "dc_007", "LEARNED").otherwise("ZERO_SHOT"))
    return learning.advance_stages(p, schema_gate(spark, sf))


@query("schema_hints", """
SELECT class_id, field_name, 'examples' AS source, array_to_string(ex[1:3], '|') AS example_values, 'found in ' || CAST(floor(round(found_count::DOUBLE / total_seen, 2) * 100 + 0.5) AS INT) || '% of prior docs' AS occurrence_note
FROM field_stats JOIN stat_examples USING (class_id, field_name) WHERE class_id = 'dc_006' AND found_count > 0
UNION ALL SELECT class_id, field_name, 'schema', 'x', NULL FROM field_stats WHERE class_id = 'dc_003'""", ("field_stats", "stat_examples"))
def schema_hints(spark, sf):
    stats = _stats(spark, sf)
    p = views.trade_docs(spark, sf).groupBy("class_id").agg(F.count(F.lit(1)).alias("doc_count")).withColumn(
        "learning_stage", F.when(F.col("class_id") == "dc_003", "LEARNED").when(F.col("class_id") == "dc_006", "LEARNING").otherwise("ZERO_SHOT"))
    schema = stats.select("class_id", "field_name", F.lit("").alias("format_hint"), F.array(F.lit("x")).alias("example_values"))
    return learning.schema_hints(p, stats, schema).select("class_id", "field_name", "source", F.array_join("example_values", "|").alias("example_values"), "occurrence_note")


@query("rename_schema", """
SELECT variant_id, new_name AS canonical, CASE new_name WHEN 'bill_no' THEN 'inv_no,invoice_number,bill_no' WHEN 'iban' THEN 'iban' WHEN 'total' THEN 'amount,total' END AS aliases FROM (
  SELECT DISTINCT variant_id, CASE canonical WHEN 'invoice_number' THEN 'bill_no' ELSE canonical END AS new_name FROM variant_schema WHERE canonical IN ('invoice_number', 'iban', 'total'))""", ("variant_schema",))
def rename_schema(spark, sf):
    rows = views.variant_schema(spark, sf)
    schema = rows.groupBy("variant_id", "canonical").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("alias_no", "alias"))), lambda a: a["alias"]).alias("aliases"), F.lit("ex").alias("example"))
    c = F.col("canonical")
    edits = schema.select("variant_id", "canonical", c.isin("invoice_number", "iban", "total").alias("keep"),
                          F.when(c == "invoice_number", "Bill No").alias("new_name"),
                          F.when(c == "total", F.array(F.lit("amount"))).alias("aliases"))
    return learning.rename_schema(schema, edits).select("variant_id", "canonical", F.array_join("aliases", ",").alias("aliases"))


# ---- linking -----------------------------------------------------------------------------------------


@query("document_keys", "SELECT document_id, key, rank FROM link_keys", ("link_keys",))
def document_keys(spark, sf):
    return views.link_keys(spark, sf)


O.view("components", """
SELECT document_id, min(label) AS component FROM (
WITH RECURSIVE nodes AS (SELECT document_id, key FROM link_keys),
reach AS (
  SELECT document_id, document_id AS label FROM nodes
  UNION
  SELECT b.document_id, r.label FROM reach r JOIN nodes a ON a.document_id = r.document_id JOIN nodes b ON b.key = a.key)
SELECT document_id, label FROM reach) GROUP BY 1""", "link_keys")


@query("link_components", "SELECT * FROM components", ("components",))
def link_components(spark, sf):
    return links.link_components(views.link_keys(spark, sf))


def _shipments(spark, sf):
    """Shipments known from every third purchase order; each also holds the next order's number."""
    o = tables.read_table(spark, sf, "orders", "o_orderkey").filter(F.col("o_orderkey") % 3 == 0).select(F.col("o_orderkey").alias("k"))
    no = lambda k: F.concat(F.lit("TSL/"), F.lpad(k.cast("string"), 6, "0"))
    s = o.select(F.concat(F.lit("old_"), "k").alias("shipment_id"), no(F.col("k")).alias("reference_key"), views.epoch_plus(F.col("k") % 1000).alias("created_at"), "k")
    keys = s.select("shipment_id", F.explode(F.array(no(F.col("k")), no(F.col("k") + 1), F.concat(F.lit("AWB-"), F.floor(F.col("k") / 4).cast("bigint")))).alias("key"))
    return s.drop("k"), keys


@query("link_incremental", """
SELECT document_id, shipment_id, key, primary_hit FROM (
  SELECT l.document_id, o.shipment_id, l.key, o.kind = 0 AS primary_hit, row_number() OVER (PARTITION BY l.document_id ORDER BY rank, kind, created_at, shipment_id) AS rn
  FROM link_keys l JOIN (
    SELECT 'old_' || o_orderkey AS shipment_id, 0 AS kind, 'TSL/' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS key, TIMESTAMP '2024-01-01' + to_minutes(CAST(o_orderkey % 1000 AS BIGINT)) AS created_at FROM orders WHERE o_orderkey % 3 = 0
    UNION ALL SELECT 'old_' || o_orderkey, 1, unnest(['TSL/' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0'), 'TSL/' || lpad(CAST(o_orderkey + 1 AS VARCHAR), 6, '0'), 'AWB-' || (o_orderkey // 4)]), TIMESTAMP '2024-01-01' + to_minutes(CAST(o_orderkey % 1000 AS BIGINT)) FROM orders WHERE o_orderkey % 3 = 0
  ) o USING (key)) WHERE rn = 1""", ("link_keys",))
def link_incremental(spark, sf):
    s, k = _shipments(spark, sf)
    return links.link_to_shipments(views.link_keys(spark, sf), s, k)


@query("link_arrival_order")
def link_arrival_order(spark, sf):
    return links.link_documents(views.trade_docs(spark, sf), views.link_keys(spark, sf))


@query("reference_key", """
SELECT document_id, coalesce(key, 'unkeyed:' || document_id) AS reference_key FROM trade_docs LEFT JOIN (
  SELECT document_id, key FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY rank, key) AS rn FROM link_keys) WHERE rn = 1) USING (document_id)""", ("trade_docs", "link_keys"))
def reference_key(spark, sf):
    return links.reference_key(views.link_keys(spark, sf), views.trade_docs(spark, sf))


@query("shipment_rollup", """
SELECT shipment_id, reference_key, document_count, coalesce(key_count, 0) AS key_count, class_summary, 'po_' || k AS first_document_id, created_at FROM (
  SELECT shipment_id, k, sum(n) AS document_count, string_agg(class_id || '=' || n, ',' ORDER BY class_id) AS class_summary, min(c) AS created_at
  FROM (SELECT shipment_id, k, class_id, count(*) AS n, min(created_at) AS c FROM trade_docs GROUP BY ALL) GROUP BY ALL)
LEFT JOIN (SELECT shipment_id, count(DISTINCT key) AS key_count FROM trade_docs JOIN link_keys USING (document_id) GROUP BY 1) USING (shipment_id)
LEFT JOIN (SELECT document_id, key AS reference_key FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY rank, key) AS rn FROM link_keys) WHERE rn = 1) r ON r.document_id = 'po_' || k""", ("trade_docs", "link_keys"))
def shipment_rollup(spark, sf):
    d = views.trade_docs(spark, sf)
    return links.shipment_rollup(d, d, views.link_keys(spark, sf))


@query("shipment_keys", """
SELECT shipment_id, key, min(created_at) AS first_seen, arg_min(rank, (created_at, document_id)) AS rank FROM trade_docs JOIN link_keys USING (document_id) GROUP BY 1, 2""", ("trade_docs", "link_keys"))
def shipment_keys(spark, sf):
    d = views.trade_docs(spark, sf)
    return links.shipment_keys_table(d, views.link_keys(spark, sf), d)


@query("shipment_closure", """
SELECT shipment_id, count(*) AS document_count, count(*) FILTER (status IN ('COMPLETED', 'EXACT_DUPLICATE', 'NEEDS_REVIEW', 'CANDIDATE_NEW_CLASS', 'FAILED')) AS terminal_count,
  CASE WHEN bool_and(status IN ('COMPLETED', 'EXACT_DUPLICATE', 'NEEDS_REVIEW', 'CANDIDATE_NEW_CLASS', 'FAILED')) THEN 'COMPLETE' ELSE 'OPEN' END AS status FROM trade_docs GROUP BY 1""", ("trade_docs",))
def shipment_closure(spark, sf):
    d = views.trade_docs(spark, sf)
    return links.shipment_closure(d, d)


@query("shipment_documents", """
SELECT document_id, shipment_id, class_id, status, created_at, coalesce(n, 0) AS field_count FROM trade_docs LEFT JOIN (SELECT document_id, count(*) AS n FROM fields GROUP BY 1) USING (document_id)""", ("trade_docs", "fields"))
def shipment_documents(spark, sf):
    d = views.trade_docs(spark, sf)
    return links.shipment_documents(d, d, views.extracted_fields(spark, sf))


# ---- reports ---------------------------------------------------------------------------------------------


O.view("sampled", """
SELECT document_id, coalesce(variant_id, '(none)') AS variant_id FROM trade_docs WHERE status = 'COMPLETED' ORDER BY created_at DESC, document_id DESC LIMIT 200""", "trade_docs")
O.view("audit", """
SELECT variant_id, doc_count, CAST(round(CAST(conf AS DECIMAL(18,8)), 3) AS DOUBLE) AS avg_confidence, CAST(round(CAST(hit AS DECIMAL(18,8)), 3) AS DOUBLE) AS field_hit_rate, CAST(round(CAST(corr AS DECIMAL(18,8)), 3) AS DOUBLE) AS correction_rate,
  0.0::DOUBLE AS needs_review_rate, coalesce(method, '—') AS primary_method, m AS schema_field_count, CAST(least(greatest(floor(round((conf * 0.4 + hit * 0.4 + (1 - corr) * 0.2) * 100, 5)), 0), 100) AS INT) AS health_score
FROM (SELECT s.variant_id, count(*) AS doc_count, sum(cs)::DOUBLE / sum(cn) AS conf, count(*) FILTER (corrected)::DOUBLE / count(*) AS corr, CASE WHEN any_value(m) IS NULL THEN 1.0 ELSE sum(h)::DOUBLE / count(*) / any_value(m) END AS hit, coalesce(any_value(m), 0) AS m
  FROM (SELECT s.document_id, s.variant_id, sum(confidence) AS cs, count(confidence) AS cn, bool_or(human_corrected) AS corrected, count(v.canonical) AS h FROM sampled s LEFT JOIN fields f USING (document_id)
    LEFT JOIN (SELECT DISTINCT variant_id, canonical FROM variant_schema) v ON v.variant_id = s.variant_id AND v.canonical = f.field_name GROUP BY 1, 2) s
  LEFT JOIN (SELECT variant_id, count(DISTINCT canonical) AS m FROM variant_schema GROUP BY 1) z ON z.variant_id = s.variant_id GROUP BY 1)
LEFT JOIN (SELECT variant_id, arg_min(extraction_method, (-n, seen)) AS method FROM (SELECT variant_id, extraction_method, count(*) AS n, min(field_id) AS seen FROM sampled JOIN fields USING (document_id) GROUP BY 1, 2) GROUP BY 1) USING (variant_id)""", "sampled", "fields", "variant_schema")


@query("quality_audit", "SELECT * FROM audit", ("audit",))
def quality_audit(spark, sf):
    d = views.trade_docs(spark, sf)
    return audits.quality_audit(d, views.extracted_fields(spark, sf), views.variant_schema(spark, sf), last_n=200)


@query("quality_overall", """
SELECT sum(doc_count) AS docs_analysed, count(*) AS variants_seen, CAST(floor(sum(health_score * doc_count) / sum(doc_count)) AS INT) AS overall_health,
  count(*) FILTER (health_score < 70) AS flagged, count(*) FILTER (health_score >= 80) AS good FROM audit""", ("audit",))
def quality_overall(spark, sf):
    return audits.quality_overall(quality_audit(spark, sf))


@query("review_rate", """
SELECT coalesce(variant_id, '(none)') AS variant_id, CAST(round(CAST(count(*) FILTER (status = 'NEEDS_REVIEW')::DOUBLE / count(*) AS DECIMAL(18,10)), 4) AS DOUBLE) AS real_review_rate FROM trade_docs GROUP BY 1""", ("trade_docs",))
def review_rate(spark, sf):
    return audits.review_rate(views.trade_docs(spark, sf))


O.view("newest50", """
SELECT document_id, variant_id FROM (SELECT document_id, variant_id, row_number() OVER (PARTITION BY variant_id ORDER BY created_at DESC, document_id DESC) AS rn FROM trade_docs WHERE status = 'COMPLETED' AND variant_id IS NOT NULL) WHERE rn <= 50""", "trade_docs")
O.view("usage", """
SELECT variant_id, canonical, docs_sampled, coalesce(found_in, 0) AS found_in, CAST(round(CAST(coalesce(found_in, 0)::DOUBLE / docs_sampled AS DECIMAL(18,10)), 3) AS DOUBLE) AS extraction_rate, CAST(round(CAST(coalesce(c, 0) AS DECIMAL(18,10)), 3) AS DOUBLE) AS avg_confidence,
  CASE WHEN coalesce(found_in, 0)::DOUBLE / docs_sampled < 0.10 THEN 'unused' WHEN coalesce(c, 0) < 0.60 AND docs_sampled >= 5 THEN 'unreliable' WHEN found_in::DOUBLE / docs_sampled >= 0.85 AND c >= 0.80 THEN 'healthy' ELSE 'moderate' END AS status
FROM (SELECT DISTINCT variant_id, canonical FROM variant_schema) JOIN (SELECT variant_id, count(*) AS docs_sampled FROM newest50 GROUP BY 1) USING (variant_id)
LEFT JOIN (SELECT n.variant_id, s.canonical, count(*) AS found_in, sum(confidence)::DOUBLE / count(*) AS c FROM newest50 n JOIN fields f ON f.document_id = n.document_id JOIN variant_schema s ON s.variant_id = n.variant_id AND s.alias = f.field_name GROUP BY 1, 2) USING (variant_id, canonical)""", "variant_schema", "newest50", "fields")


@query("usage_audit", "SELECT * FROM usage", ("usage",))
def usage_audit(spark, sf):
    return audits.usage_audit(views.trade_docs(spark, sf), views.extracted_fields(spark, sf), views.variant_schema(spark, sf))


@query("usage_by_severity", "SELECT variant_id, canonical, status, CASE status WHEN 'unused' THEN 0 WHEN 'unreliable' THEN 1 WHEN 'moderate' THEN 2 ELSE 3 END AS severity FROM usage", ("usage",))
def usage_by_severity(spark, sf):
    return audits.by_severity(usage_audit(spark, sf)).select("variant_id", "canonical", "status", "severity")


@query("cost_report", """
SELECT total_docs, completed_docs, docs_with_pages, total_variants, variants_profiled, stage_learned, stage_learning, stage_no_profile, pages_seen, pages_skipped, pages_seen - pages_skipped AS pages_sampled,
  pages_skipped * 300 AS tokens_saved, CAST(saved AS DOUBLE) AS cost_saved_usd, CAST(round(CAST(pages_seen::DOUBLE / docs_with_pages AS DECIMAL(18,8)), 1) AS DOUBLE) AS avg_pages_per_doc,
  CAST(round(CAST((pages_seen - pages_skipped)::DOUBLE / docs_with_pages AS DECIMAL(18,8)), 1) AS DOUBLE) AS avg_pages_sampled, CAST(base AS DOUBLE) AS baseline_cost_per_doc, CAST(act AS DOUBLE) AS actual_cost_per_doc,
  CAST(floor(round((1 - act / base) * 100, 6)) AS INT) AS pct_reduction, greatest(1, completed_docs // 4) AS weekly_docs_avg, CAST(round(CAST(saved::DOUBLE / docs_with_pages * greatest(1, completed_docs // 4) * 52 AS DECIMAL(18,8)), 2) AS DOUBLE) AS annual_projected_saving,
  skip_candidates, CAST(round(CAST(skip_candidates * 3000 AS DECIMAL(20,0)) * 0.000003, 4) AS DOUBLE) AS candidate_saving_usd
FROM (SELECT *, round(CAST(pages_skipped AS DECIMAL(18,0)) * 0.0009, 4) AS saved, round(CAST(pages_seen::DOUBLE / docs_with_pages * 0.0009 AS DECIMAL(18,10)), 4) AS base, round(CAST((pages_seen - pages_skipped)::DOUBLE / docs_with_pages * 0.0009 AS DECIMAL(18,10)), 4) AS act
  FROM (SELECT count(*) AS total_docs, count(*) FILTER (status = 'COMPLETED') AS completed_docs, count(pages_total) AS docs_with_pages, sum(pages_total) AS pages_seen, sum(pages_skipped_count) FILTER (pages_total IS NOT NULL) AS pages_skipped FROM registry),
    (SELECT count(*) AS total_variants, count(*) AS variants_profiled, count(*) FILTER (s > 0) AS stage_learned, count(*) FILTER (s = 0) AS stage_learning, 0 AS stage_no_profile, sum(c) AS skip_candidates FROM (
      SELECT variant_id, count(*) FILTER (skip) AS s, count(*) FILTER (NOT skip AND present_in >= 3 AND contributed_in = 0) AS c FROM page_profile GROUP BY 1)))""", ("registry", "page_profile"))
def cost_report(spark, sf):
    d = views.registry(spark, sf).drop("text")
    return audits.cost_report(d, d.select("variant_id").distinct(), pages.page_profile(views.page_contributions(spark, sf)))


@query("run_stats", """
SELECT event_type AS report, count(*) AS total_runs, count(*) FILTER (CAST(ts AS DATE) = DATE '2024-01-05') AS runs_today, max(ts) AS last_run, arg_max(CASE WHEN event_id % 7 = 0 THEN 'error' ELSE 'success' END, (ts, event_id)) AS last_status FROM events GROUP BY 1""")
def run_stats(spark, sf):
    e = tables.read_table(spark, sf, "events", "event_id", "ts", "event_type")
    runs = e.select(F.col("event_type").alias("report"), F.col("ts").alias("started_at"), F.col("event_id").alias("run_id"),
                    F.when(F.col("event_id") % 7 == 0, "error").otherwise("success").alias("status"))
    return audits.run_stats(runs, F.lit("2024-01-05").cast("date"))


@query("delivery_stats", """
SELECT user_id AS subscription_id, count(*) AS delivery_count, count(*) FILTER (s IS NULL OR s NOT BETWEEN 200 AND 299) AS failure_count, arg_max(coalesce(s, -1), (ts, event_id)) AS last_status
FROM (SELECT *, CASE event_id % 5 WHEN 0 THEN 500 WHEN 1 THEN NULL ELSE 200 END AS s FROM events) GROUP BY 1""")
def delivery_stats(spark, sf):
    e = tables.read_table(spark, sf, "events", "event_id", "ts", "user_id")
    d = e.select(F.col("user_id").alias("subscription_id"), F.col("ts").alias("delivered_at"), F.col("event_id").alias("delivery_id"),
                 F.when(F.col("event_id") % 5 == 0, 500).when(F.col("event_id") % 5 > 1, 200).alias("status_code"))
    return audits.delivery_stats(d).withColumn("last_status", F.coalesce("last_status", F.lit(-1)))


# ---- queues ------------------------------------------------------------------------------------------------


@query("status_summary", """
SELECT count(*) AS total, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'NEEDS_REVIEW') AS review, count(*) FILTER (status = 'CANDIDATE_NEW_CLASS') AS discovery,
  count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status NOT IN ('COMPLETED', 'NEEDS_REVIEW', 'CANDIDATE_NEW_CLASS', 'FAILED')) AS processing FROM registry""", ("registry",))
def status_summary(spark, sf):
    return queues.status_summary(views.registry(spark, sf))


@query("class_registry", f"SELECT class_id, name, slug, treatment, TRUE AS active, coalesce(n, 0) AS variant_count FROM {CLASS_SQL} LEFT JOIN (SELECT class_id, count(*) AS n FROM variants GROUP BY 1) USING (class_id)", ("variants",))
def class_registry(spark, sf):
    return queues.class_registry(R.class_table(spark), views.variants(spark, sf))


@query("class_detail", "SELECT variant_id, confirmed_instances, doc_count FROM variants WHERE class_id = 'dc_006'", ("variants",))
def class_detail(spark, sf):
    return queues.class_detail(views.variants(spark, sf), "dc_006").select("variant_id", "confirmed_instances", "doc_count")


@query("with_names", f"SELECT document_id, name AS class_name, variant_label FROM trade_docs LEFT JOIN {CLASS_SQL} USING (class_id) LEFT JOIN (SELECT variant_id, variant_label FROM variants) USING (variant_id)", ("trade_docs", "variants"))
def with_names(spark, sf):
    return queues.with_names(views.trade_docs(spark, sf), R.class_table(spark), views.variants(spark, sf)).select("document_id", "class_name", "variant_label")


O.view("last_review", """
SELECT document_id, max(created_at) AS review_at, arg_max(detail, (created_at, event_id)) AS detail FROM doc_events WHERE state = 'NEEDS_REVIEW' GROUP BY 1""", "doc_events")


@query("latest_review", "SELECT document_id, review_at, detail, trim(split_part(split_part(detail, 'condition(s) failed.', 2), '|', 1)) || ';B' AS reasons, substr(detail, 1, 120) AS short_detail FROM last_review", ("last_review",))
def latest_review(spark, sf):
    return queues.latest_review(views.document_events(spark, sf)).withColumn("reasons", F.array_join("reasons", ";"))


@query("review_queue", """
SELECT document_id, class_id, updated_at, detail, CASE WHEN detail IS NOT NULL THEN 2 END AS conditions, 0 AS field_count FROM registry LEFT JOIN last_review USING (document_id) WHERE status = 'NEEDS_REVIEW'""", ("registry", "last_review"))
def review_queue(spark, sf):
    q = queues.review_queue(views.registry(spark, sf), views.document_events(spark, sf), views.extracted_fields(spark, sf))
    return q.select("document_id", "class_id", "updated_at", "detail", F.when(F.col("reasons").isNotNull(), F.size("reasons")).alias("conditions"), "field_count")


@query("discovery_queue", """
SELECT document_id, created_at, 'NEW_TYPE' AS verdict, CAST(doc_id % 100 AS DOUBLE) / 100 AS confidence, 'Kind ' || class_id AS suggested_class_name FROM registry WHERE status = 'CANDIDATE_NEW_CLASS'""", ("registry",))
def discovery_queue(spark, sf):
    d = views.registry(spark, sf).withColumn("governance_result", F.to_json(F.struct(
        F.lit("NEW_TYPE").alias("verdict"), (F.col("doc_id") % 100 / 100).alias("confidence"), F.concat(F.lit("Kind "), "class_id").alias("suggested_class_name"))))
    return queues.discovery_queue(d)


@query("event_timeline", """
SELECT document_id, event_id, state, created_at, next_state, CAST(floor(epoch_us(nx) / 1000000.0 - epoch_us(created_at) / 1000000.0) AS BIGINT) AS dwell_seconds FROM (
  SELECT *, lead(state) OVER w AS next_state, lead(created_at) OVER w AS nx FROM doc_events WINDOW w AS (PARTITION BY document_id ORDER BY created_at, event_id))""", ("doc_events",))
def event_timeline(spark, sf):
    return queues.event_timeline(views.document_events(spark, sf))


@query("status_timeline", "SELECT document_id, state, min(created_at) AS entered_at, count(*) AS times FROM doc_events GROUP BY 1, 2", ("doc_events",))
def status_timeline(spark, sf):
    return queues.status_timeline(views.document_events(spark, sf))


MOVES = [(a, b) for a, bs in R.TRANSITIONS.items() for b in bs]


@query("bad_transitions", f"""
SELECT document_id, event_id, prev_state, state, created_at FROM (SELECT *, lag(state) OVER (PARTITION BY document_id ORDER BY created_at, event_id) AS prev_state FROM doc_events) e
WHERE prev_state IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {O.values('a, b', MOVES)} WHERE a = prev_state AND b = state)""", ("doc_events",))
def bad_transitions(spark, sf):
    return queues.bad_transitions(views.document_events(spark, sf), R.transition_table(spark))


@query("apply_corrections", """
SELECT f.document_id, f.field_name, f.human_corrected OR k % 31 = 0 AS human_corrected, CASE WHEN k % 31 = 0 THEN 'second' ELSE corrected_value END AS corrected_value FROM fields f""", ("fields",))
def apply_corrections(spark, sf):
    f = views.extracted_fields(spark, sf)
    c = f.filter(F.col("k") % 31 == 0).select("document_id", "field_name", F.explode(F.array(F.lit("first"), F.lit("second"))).alias("new_value"))
    c = c.withColumn("corrected_by", F.lit("ann")).withColumn("corrected_at", views.epoch_plus(F.when(F.col("new_value") == "second", 2).otherwise(1)))
    return queues.apply_corrections(f, c).select("document_id", "field_name", "human_corrected", "corrected_value")


@query("decisions", """
SELECT document_id, action, CASE WHEN action = 'approve' AND status <> 'NEEDS_REVIEW' THEN 'not_in_needs_review' WHEN action = 'reject' AND status <> 'NEEDS_REVIEW' THEN 'not_in_needs_review'
    WHEN action = 'retry' AND status <> 'FAILED' THEN 'not_in_failed' WHEN action = 'promote' AND status <> 'CANDIDATE_NEW_CLASS' THEN 'not_in_candidate_new_class' WHEN action = 'dismiss' AND status <> 'CANDIDATE_NEW_CLASS' THEN 'not_in_candidate_new_class'
    WHEN action = 'approve' AND target = 'FILING' THEN 'invalid_target_stage' WHEN action = 'undo' THEN 'unknown_action' END AS refused,
  CASE WHEN action = 'approve' AND status = 'NEEDS_REVIEW' AND target <> 'FILING' THEN target WHEN action = 'reject' AND status = 'NEEDS_REVIEW' THEN 'FAILED' WHEN action = 'retry' AND status = 'FAILED' THEN 'RECEIVED'
    WHEN action = 'promote' AND status = 'CANDIDATE_NEW_CLASS' THEN 'EXTRACTING' WHEN action = 'dismiss' AND status = 'CANDIDATE_NEW_CLASS' THEN 'NEEDS_REVIEW' WHEN action = 'reclassify' THEN 'EXTRACTING' ELSE status END AS new_status
FROM (SELECT *, CASE doc_id % 7 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'retry' WHEN 3 THEN 'promote' WHEN 4 THEN 'dismiss' WHEN 5 THEN 'reclassify' ELSE 'undo' END AS action,
  CASE WHEN doc_id % 7 = 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'FILING' ELSE 'MATCHING' END WHEN doc_id % 7 IN (3, 5) THEN 'c_new' END AS target FROM registry)""", ("registry",))
def decisions(spark, sf):
    d = views.registry(spark, sf)
    i = F.col("doc_id")
    dec = d.select("document_id", views.pick(i % 7, "approve", "reject", "retry", "promote", "dismiss", "reclassify", "undo").alias("action"),
                   F.when(i % 7 == 0, F.when(i % 3 == 0, "FILING").otherwise("MATCHING")).when((i % 7).isin(3, 5), "c_new").alias("target"),
                   F.lit("ann").alias("actor"), views.epoch_plus(i).alias("decided_at"))
    return queues.apply_decisions(d, dec).select("document_id", "action", "refused", "new_status")


@query("next_class_id", "SELECT min('dc_' || lpad(CAST(n AS VARCHAR), 3, '0')) AS class_id FROM range(1, (SELECT count(*) + 2 FROM nation)) r(n) WHERE 'dc_' || lpad(CAST(n AS VARCHAR), 3, '0') NOT IN (SELECT DISTINCT 'dc_' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 3, '0') FROM nation)")
def next_class_id(spark, sf):
    c = tables.read_table(spark, sf, "nation", "n_nationkey").select(F.format_string("dc_%03d", F.col("n_nationkey") + 1).alias("class_id"))
    return queues.next_class_id(c)


@query("scoped_purge", """
SELECT 'documents' AS table_name, count(*) AS rows_before, count(*) FILTER (class_id <> 'dc_006') AS rows_after FROM trade_docs
UNION ALL SELECT 'fields', count(*), count(*) FILTER (document_id NOT LIKE 'inv_%') FROM fields
UNION ALL SELECT 'variants', count(*), 0 FROM variants""", ("trade_docs", "fields", "variants"))
def scoped_purge(spark, sf):
    t = {"documents": views.trade_docs(spark, sf), "fields": views.extracted_fields(spark, sf), "variants": views.variants(spark, sf)}
    return sinks.purge_counts(t, class_id="dc_006").select("table_name", "rows_before", F.coalesce("rows_after", F.lit(0)).alias("rows_after"))


@query("ingest_quarantine", """
SELECT document_id, CASE WHEN doc_id % 6 = 0 THEN 'invalid_file_type' WHEN length(text) > 4000 THEN 'file_too_large' WHEN doc_id % 6 = 1 THEN 'empty_file' WHEN doc_id % 6 = 2 THEN 'invalid_pdf' END AS reject_reason FROM (
  SELECT document_id, doc_id, CASE doc_id % 6 WHEN 1 THEN '' WHEN 2 THEN 'GIF' ELSE '%PDF' || doc_id END AS text FROM registry)""", ("registry",))
def ingest_quarantine(spark, sf):
    i = F.col("doc_id")
    raw = views.registry(spark, sf).select(
        "document_id", F.when(i % 6 == 0, "text/html").otherwise("application/pdf").alias("mime_type"),
        F.when(i % 6 == 1, "").when(i % 6 == 2, "GIF").otherwise(F.concat(F.lit("%PDF"), i)).cast("binary").alias("content"))
    return tables.ingest_quarantine(raw).select("document_id", "reject_reason")


@query("register_documents", "SELECT document_id, 'RECEIVED' AS status, file_sha256, octet_length(encode(text)) AS file_size_bytes FROM registry", ("registry",))
def register_documents(spark, sf):
    raw = views.registry(spark, sf).select("document_id", "file_name", "created_at", F.col("text").cast("binary").alias("content"))
    docs, _ = tables.register_documents(raw)
    return docs.select("document_id", "status", "file_sha256", "file_size_bytes")


@query("append_events", """
SELECT state, count(*) AS n FROM (SELECT state FROM doc_events UNION ALL SELECT 'RECEIVED' FROM registry) GROUP BY 1""", ("doc_events", "registry"))
def append_events(spark, sf):
    raw = views.registry(spark, sf).select("document_id", "file_name", "created_at", F.col("text").cast("binary").alias("content"))
    _, first = tables.register_documents(raw)
    return sinks.append_events(views.document_events(spark, sf), first).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


# ---- outputs ---------------------------------------------------------------------------------------------------


@query("posting_payloads", """
SELECT document_id, CASE class_id WHEN 'dc_006' THEN 'purchase_invoice' WHEN 'dc_003' THEN 'order_update' ELSE 'generic' END AS family,
  CASE class_id WHEN 'dc_006' THEN coalesce(currency, 'EUR') WHEN 'dc_003' THEN coalesce(currency, 'EUR') END AS currency_code,
  CASE class_id WHEN 'dc_006' THEN coalesce(total_amount, '') END AS amount, CASE class_id WHEN 'dc_006' THEN coalesce(customer_po_ref, '') WHEN 'dc_003' THEN coalesce(po_number, '') END AS order_number,
  CASE WHEN class_id IN ('dc_003', 'dc_006') THEN coalesce(supplier_name, '') END AS vendor
FROM (SELECT document_id, class_id FROM trade_docs) LEFT JOIN (SELECT document_id, currency, total_amount, customer_po_ref, po_number, supplier_name FROM wide) USING (document_id)""", ("trade_docs", "wide"))
def posting_payloads(spark, sf):
    p = outputs.posting_payloads(views.trade_docs(spark, sf), views.extracted_fields(spark, sf), "2024-06-01")
    g = lambda k: F.get_json_object("payload", f"$.{k}")
    return p.select("document_id", "family", g("currencyCode").alias("currency_code"), g("amount").alias("amount"),
                    g("purchaseOrderNumber").alias("order_number"), g("vendorNumber").alias("vendor"))


O.view("filed", """
SELECT d.document_id, d.shipment_id, d.created_at, 'FY' || CASE WHEN month(created_at) >= 4 THEN year(created_at) + 1 ELSE year(created_at) END AS fiscal_year, d.file_name,
  CASE class_id WHEN 'dc_003' THEN 'tsl-po' WHEN 'dc_006' THEN 'supplier-invoice' WHEN 'dc_007' THEN 'packing-list' ELSE 'inspection-cert' END AS slug,
  CASE WHEN coalesce(e.value, '') <> '' THEN replace(e.value, '/', '-') ELSE d.document_id END AS reference
FROM trade_docs d LEFT JOIN eff e ON e.document_id = d.document_id AND e.field_name = CASE class_id WHEN 'dc_003' THEN 'po_number' WHEN 'dc_006' THEN 'invoice_number' END""", "trade_docs", "eff")


@query("filing_index", "SELECT document_id, fiscal_year, reference, '/documents/' || fiscal_year || '/' || slug || '/' || reference || '/' || file_name AS path FROM filed", ("filed",))
def filing_index(spark, sf):
    return _index(spark, sf).select("document_id", "fiscal_year", "reference", "path")


def _index(spark, sf):
    return outputs.filing_index(views.trade_docs(spark, sf), views.extracted_fields(spark, sf), R.class_table(spark))


@query("shipment_filing", """
SELECT shipment_id, arg_min('/documents/' || fiscal_year || '/' || slug || '/' || reference, (created_at, document_id)) AS folder, CASE WHEN CAST(substr(shipment_id, 5) AS BIGINT) % 3 = 0 THEN 'POSTED' ELSE 'FILED' END AS status FROM filed GROUP BY 1""", ("filed",))
def shipment_filing(spark, sf):
    d = views.trade_docs(spark, sf)
    s = tables.read_table(spark, sf, "orders", "o_orderkey").select(F.concat(F.lit("shp_"), "o_orderkey").alias("shipment_id"),
                                                                  F.when(F.col("o_orderkey") % 3 == 0, "POSTED").otherwise("OPEN").alias("status"))
    return outputs.shipment_filing(_index(spark, sf), d, s)


@query("completion_events", """
SELECT document_id, 'document.completed' AS event, coalesce(n, 0) AS field_count, c::DOUBLE AS avg_confidence, outcome AS match_result FROM trade_docs LEFT JOIN (
  SELECT document_id, count(*) AS n, round(CAST(avg(confidence) AS DECIMAL(18,8)), 4) AS c FROM fields GROUP BY 1) USING (document_id) JOIN all_outcomes USING (shipment_id) WHERE status = 'COMPLETED'""", ("trade_docs", "fields", "all_outcomes"))
def completion_events(spark, sf):
    d = views.trade_docs(spark, sf)
    return outputs.completion_events(d, views.extracted_fields(spark, sf), d, FM.three_way_match(spark, sf), R.class_table(spark), _index(spark, sf)).drop("payload")


SUBSCRIPTIONS = [(1, "https://a.example", [], True), (2, "https://b.example", ["signup", "error"], True), (3, "https://c.example", ["error"], False), (4, "https://d.example", ["purchase"], True)]


@query("event_fanout", """
SELECT event_id, s AS subscription_id FROM events, (VALUES (1), (2), (4)) t(s) WHERE s = 1 OR (s = 2 AND event_type IN ('signup', 'error')) OR (s = 4 AND event_type = 'purchase')""")
def event_fanout(spark, sf):
    subs = spark.createDataFrame(SUBSCRIPTIONS, "subscription_id int, url string, events array<string>, active boolean")
    e = tables.read_table(spark, sf, "events", "event_id", "event_type").withColumnRenamed("event_type", "event")
    return outputs.event_fanout(e, subs).select("event_id", "subscription_id")


@query("active_stages", """
SELECT document_id, array_to_string(list_sort(list_distinct(CASE WHEN skips_posting THEN ['POSTING'] ELSE [] END || CASE WHEN match_mode = 'SKIP' OR store OR nolink THEN ['MATCHING'] ELSE [] END
  || CASE WHEN store THEN ['POSTING'] ELSE [] END || CASE WHEN nolink THEN ['LINKING'] ELSE [] END)), ',') AS skipped FROM (SELECT *, k % 8 = 1 AS store, k % 7 = 2 AS nolink FROM trade_docs)""", ("trade_docs",))
def active_stages(spark, sf):
    d = views.trade_docs(spark, sf)
    client = F.when(F.col("k") % 7 == 2, F.array(F.lit("LINKING")))
    treatment = F.when(F.col("k") % 8 == 1, "STORE").otherwise("PROCESS")
    return d.select("document_id", F.array_join(S.skipped_stages(F.col("skip_stages"), F.col("match_mode"), treatment, client), ",").alias("skipped"))


@query("route_documents", """
SELECT document_id, CASE WHEN n = 0 THEN 'NEEDS_REVIEW' WHEN len(nigo) > 0 THEN 'NEEDS_REVIEW' WHEN needs_approval THEN 'NEEDS_REVIEW'
    WHEN outcome = 'FAIL' AND match_mode <> 'ADVISORY' AND match_mode <> 'SKIP' AND NOT skip_matching THEN 'NEEDS_REVIEW' ELSE 'COMPLETED' END AS status,
  CASE WHEN n = 0 THEN 'extraction' WHEN len(nigo) > 0 THEN 'validation' WHEN needs_approval THEN 'instructions'
    WHEN outcome = 'FAIL' AND match_mode <> 'ADVISORY' AND match_mode <> 'SKIP' AND NOT skip_matching THEN 'matching' ELSE 'completion' END AS decided_by
FROM (SELECT document_id, match_mode, coalesce(n, 0) AS n, nigo, outcome, coalesce(needs_approval, FALSE) AS needs_approval, coalesce(skip_matching, FALSE) AS skip_matching FROM trade_docs
  LEFT JOIN (SELECT document_id, count(*) AS n FROM fields GROUP BY 1) USING (document_id) LEFT JOIN (SELECT document_id, nigo FROM nigo) USING (document_id)
  LEFT JOIN (SELECT document_id, bool_or(action = 'REQUIRE_APPROVAL') AS needs_approval, bool_or(action = 'SKIP_MATCHING') AS skip_matching FROM fired GROUP BY 1) USING (document_id)
  LEFT JOIN (SELECT shipment_id, outcome FROM all_outcomes) USING (shipment_id))""", ("trade_docs", "fields", "nigo", "fired", "all_outcomes"))
def route_documents(spark, sf):
    # fields are derived once and dealt out by document once: validation, instructions and match read the stored maps
    kept = Scratch(spark)
    f = kept.keep(views.extracted_fields(spark, sf).select(
        "field_id", "document_id", "field_name", "field_value", "confidence", "human_corrected", "corrected_value"), "field-rows")
    counts = kept.keep(fieldset.document_field_summary(f), "field-counts")
    maps = kept.keep(fieldset.field_dict(f), "field-maps")
    kept.drop("field-rows")
    d = views.trade_docs(spark, sf).select("document_id", "shipment_id", "class_id", "created_at", "match_mode", "skip_stages")
    d = kept.keep(quality.with_field_dict(d, maps), "documents-with-fields")
    kept.drop("field-maps")
    known = d.filter(F.col("class_id").isin("dc_003", "dc_006"))
    v = quality.validate(known, known)
    e = quality.instruction_effects(quality.fired_instructions(known, known, FM.INSTRUCTIONS))
    m = trimatch.match_for_documents(d, stored(trimatch.three_way_match(d, d, FM.TOLERANCE).select("shipment_id", "outcome"), "outcomes"))
    return flow.route_documents(d, R.class_table(spark), field_counts=counts, validation=v, effects=e, matches=m).select(
        "document_id", "status", "decided_by")


@query("cost_by_stage", """
SELECT CASE WHEN doc_count >= 50 THEN 'OPTIMISED' WHEN doc_count >= 10 THEN 'LEARNED_PROPOSED' WHEN doc_count >= 3 THEN 'LEARNING' ELSE 'ZERO_SHOT' END AS stage, count(*) AS variants FROM variants GROUP BY 1""", ("variants",))
def cost_by_stage(spark, sf):
    return views.variants(spark, sf).groupBy(N.learning_stage(F.col("doc_count")).alias("stage")).agg(F.count(F.lit(1)).alias("variants"))


@query("document_export", "SELECT document_id, status, class_id, variant_id, file_name, file_size_bytes, created_at FROM registry", ("registry",))
def document_export(spark, sf):
    return tables.document_view(views.registry(spark, sf))


@query("field_export", """
SELECT document_id, field_name, field_value, confidence::DOUBLE AS confidence, human_corrected, corrected_value FROM fields""", ("fields",))
def field_export(spark, sf):
    return tables.field_view(views.extracted_fields(spark, sf))


@query("variant_letters", """
SELECT variant_id, class_id, chr(CAST(64 + row_number() OVER (PARTITION BY class_id ORDER BY created_at, variant_id) AS INT)) AS letter FROM variants""", ("variants",))
def variant_letters(spark, sf):
    """Letter of each layout in its class, by age; layouts per class are few, documents are not touched."""
    from pyspark.sql import Window
    w = Window.partitionBy("class_id").orderBy("created_at", "variant_id")
    return views.variants(spark, sf).select("variant_id", "class_id", N.variant_letter(F.row_number().over(w)).alias("letter"))
