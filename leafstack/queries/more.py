"""Queries of operators that the other modules do not reach: key lists, labels, events, cells, user code."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafstack.functions import names, text, values
from leafstack.operators import links, pages, queues
from leafstack.plans import stages
from leafstack.queries import views
from leafstack.queries.registry import query
from leafstack.sources import tables


@query("key_merge", """
WITH k AS (SELECT l_orderkey, 'P' || l_partkey AS key, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END * 1000 + l_linenumber AS place FROM lineitem)
SELECT l_orderkey, string_agg(key, ',' ORDER BY place, key) AS keys FROM (SELECT l_orderkey, key, min(place) AS place FROM k GROUP BY 1, 2) GROUP BY 1""")
def key_merge(spark, sf):
    """Part keys of an order: those of returned lines first, then the others, each once."""
    rows = tables.read_table(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    late = F.col("l_returnflag") == "N"
    one = F.struct("l_linenumber", F.concat(F.lit("P"), "l_partkey").alias("key"))
    lists = rows.groupBy("l_orderkey").agg(*(F.array_sort(F.collect_list(F.when(c, one))).alias(n) for n, c in (("first", ~late), ("then", late))))
    return lists.select("l_orderkey", F.array_join(links.merge_keys(F.col("first.key"), F.col("then.key")), ",").alias("keys"))


@query("stage_labels", """
SELECT variant_id, CASE learning_stage WHEN 'ZERO_SHOT' THEN 'Learning (0–2 docs)' WHEN 'LEARNING' THEN 'Learning (tracking patterns)'
  WHEN 'LEARNED_PROPOSED' THEN 'Ready to confirm' WHEN 'LEARNED' THEN 'Schema confirmed' WHEN 'OPTIMISED' THEN 'Optimised (fast path)' END AS label FROM variants""", ("variants",))
def stage_labels(spark, sf):
    return views.variants(spark, sf).select("variant_id", names.stage_label(F.col("learning_stage")).alias("label"))


@query("correction_events", """
SELECT document_id, 'NEEDS_REVIEW' AS state, 'CorrectionAgent' AS agent, 'Field ''' || field_name || ''' corrected by ann.' AS detail FROM fields""", ("fields",))
def correction_events(spark, sf):
    f = views.extracted_fields(spark, sf).select(
        "document_id", "field_name", F.lit("ann").alias("corrected_by"), views.epoch_plus(F.lit(1)).alias("corrected_at"))
    return queues.correction_events(f).drop("created_at")


@query("user_extractor", "SELECT doc_id, length(text) AS size FROM documents")
def user_extractor(spark, sf):
    """A user's extractor over whole texts."""
    def sizes(frames):
        for frame in frames:
            yield frame.assign(size=frame.text.fillna("").str.len())[["doc_id", "size"]]
    return stages.apply_extractor(tables.read_table(spark, sf, "documents", "doc_id", "text"), sizes, "doc_id long, size long")


@query("table_cells", """
SELECT conv_id, turn - min(turn) OVER (PARTITION BY conv_id) AS row_no, trim(role) AS role, trim(text) AS text FROM conversations
QUALIFY count(*) OVER (PARTITION BY conv_id, turn) = 1""")
def table_cells(spark, sf):
    """Conversations as extracted tables: whole rows of string cells, with rows and cells that must go among them."""
    c = tables.read_table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    w = c.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.first("role").alias("role"), F.first("text").alias("text"))
    row = F.to_json(F.struct(F.col("turn").cast("string").alias(" turn "), F.concat(F.lit(" "), "role").alias("role"),
                             F.concat("text", F.lit(" ")).alias("text"), F.lit("x").alias(" ")))
    packed = w.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "n", row.alias("json")))).alias("rows"))
    value = F.concat(F.lit("[1,{},"), F.array_join("rows.json", ","), F.lit("]"))
    cells = packed.select("conv_id", F.element_at("rows", 1)["turn"].alias("low"), F.explode(values.clean_table(value)).alias("cell"))
    kept = w.filter("n = 1").select("conv_id", "turn")
    out = cells.select("conv_id", F.col("cell.turn").cast("long").alias("turn"), "low", F.col("cell.role").alias("role"), F.col("cell.text").alias("text"))
    return out.join(kept, ["conv_id", "turn"]).select("conv_id", (F.col("turn") - F.col("low")).alias("row_no"), "role", "text")


@query("field_pages_blind", """
SELECT d.document_id, f.field_name, p.page_num FROM (SELECT DISTINCT document_id FROM doc_pages) d
JOIN doc_pages p USING (document_id), (VALUES ('ref_a'), ('ref_b')) f(field_name)""", ("doc_pages",))
def field_pages_blind(spark, sf):
    """Documents of which no page could be read: all scalar fields on all pages."""
    p = views.doc_pages(spark, sf).select("document_id", "page_num", F.when(F.col("page_num") % 2 == 0, " \n").alias("text"))     # blank or null
    kinds = F.array(*(F.struct(F.lit(n).alias("field_name"), F.lit(t).cast("string").alias("field_type"), F.lit("value").alias("field_value"))
                      for n, t in (("ref_a", "scalar"), ("ref_b", None), ("lines", "table"))))
    f = p.select("document_id").distinct().select("document_id", F.explode(kinds).alias("f")).select("document_id", "f.*")
    return pages.attribute_fields(p, f)


@query("density_kinds", r"""
SELECT doc_id, len(regexp_extract_all(text, '\b\d{4,}\b')) AS long_numbers, len(regexp_extract_all(text, '(?i)(?:(?:usd|eur|gbp|inr|chf)\b)')) AS currencies,
  len(regexp_extract_all(text, '\d{2}[/.\-]\d{2}[/.\-]\d{4}')) AS dates FROM documents""")
def density_kinds(spark, sf):
    d = tables.read_table(spark, sf, "documents", "doc_id", "text").select("doc_id", text.data_density_by_kind(F.col("text")).alias("k"))
    return d.select("doc_id", "k.long_numbers", "k.currencies", "k.dates")
