"""Queries: text functions, classification, duplicates, pages, bundles, extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafstack import rules as R
from leafstack.functions import names as N
from leafstack.functions import text as T
from leafstack.functions import values as V
from leafstack.operators import bundles, classify, dedup, extract, pages
from leafstack.queries import oracle as O
from leafstack.queries import views
from leafstack.queries.registry import query
from leafstack.sources import tables

# ---- text ---------------------------------------------------------------------------------


@query("normalise_text", "SELECT document_id, norm FROM norm_text", ("norm_text",))
def normalise_text(spark, sf):
    return views.registry(spark, sf).select("document_id", T.normalise_for_hashing(F.col("text")).alias("norm"))


def _fingerprints(spark, sf):
    return T.simhash64(views.registry(spark, sf))


@query("simhash", "SELECT document_id, CASE WHEN fp > 9223372036854775807 THEN CAST(fp AS HUGEINT) - 18446744073709551616 ELSE fp END::BIGINT AS content_simhash FROM simhash", ("simhash",))
def simhash(spark, sf):
    return _fingerprints(spark, sf)


@query("char_trigrams", """
SELECT gram, count(*) AS n FROM (SELECT substr(norm, CAST(i AS BIGINT), 3) AS gram FROM (SELECT norm, unnest(range(1, greatest(length(norm) - 2, 1) + 1)) AS i FROM norm_text WHERE norm <> '')) GROUP BY 1""", ("norm_text",))
def char_trigrams(spark, sf):
    d = views.registry(spark, sf).select(F.explode(T.char_trigrams(T.normalise_for_hashing(F.col("text")))).alias("gram"))
    return d.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query("canonical_hash", """
SELECT event_id, sha256(array_to_string(list_sort([event_type, CAST(user_id AS VARCHAR), props]), '|')) AS hash FROM events""")
def canonical_hash(spark, sf):
    e = tables.read_table(spark, sf, "events", "event_id", "event_type", "user_id", "props")
    m = F.create_map(F.lit("t"), "event_type", F.lit("u"), F.col("user_id").cast("string"), F.lit("p"), "props")
    return e.select("event_id", T.canonical_hash(m).alias("hash"))


# Keywords of four language classes; a user brings such a table.
RULES = [
    R.ClassRule("c_en", (" the ", " and ", " of ", " is ", " that "), ("ñ",), 5, "English", 5),
    R.ClassRule("c_fr", (" le ", " la ", " en ", "eux", "eau", " que "), ("ß",), 4, "French", 6),
    R.ClassRule("c_de", (" der ", " und ", "sch", "ung", " die ", " das "), (), 3, "German", 6),
    R.ClassRule("c_es", (" el ", " la ", "ción", "ado", " los ", " en "), (), 3, "Spanish", 6),
]
REDIRECTS = [
    R.Redirect("c_fr", "c_es", any_of=("ción", " los "), other_class="c_es", other_min=3),
    R.Redirect("c_de", "c_en", all_of=(" the ",), none_of=(" und ",)),
    R.Redirect("c_en", "c_de", all_of=("sch", " und "), none_pattern=r"(?i)th[aeiou]\s"),
]
PHRASES = [R.PhraseRule("c_special", ("license",), ("mit ", "apache"))]


def _score(rule: R.ClassRule, text: str) -> str:
    plus = " + ".join(f"CAST(contains({text}, '{k}') AS INT)" for k in rule.keywords)
    minus = "".join(f" - CAST(contains({text}, '{k}') AS INT)" for k in rule.negatives)
    return f"greatest({plus}{minus}, 0)"


O.view("scores", f"""
SELECT document_id, t, {', '.join(f"{_score(r, 't')} AS s{i}" for i, r in enumerate(RULES))}
FROM (SELECT document_id, lower(trim(regexp_replace(text, '[\\s\\p{{Z}}]+', ' ', 'g'))) AS t FROM registry)""", "registry")
O.view("long_scores", " UNION ALL ".join(
    f"SELECT document_id, '{r.class_id}' AS class_id, s{i} AS score, {r.priority} AS priority, {i} AS pos, {len(r.keywords)} AS kw FROM scores"
    for i, r in enumerate(RULES)), "scores")


def _class_docs(spark, sf):
    return views.registry(spark, sf).select("document_id", "text")


@query("keyword_scores", "SELECT document_id, class_id, score FROM long_scores WHERE score > 0", ("long_scores",))
def keyword_scores(spark, sf):
    return classify.keyword_scores(_class_docs(spark, sf), RULES)


O.view("winners", """
SELECT document_id, class_id, score, kw FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, priority DESC, pos) AS rn FROM long_scores WHERE score >= 2) WHERE rn = 1""", "long_scores")
CLASSIFY_SQL = r"""
SELECT document_id, class_id, CAST(round(CAST(conf AS DECIMAL(18,10)), 4) AS DOUBLE) AS confidence, score, how FROM (
  SELECT s.document_id, coalesce(w.score, 0) AS score,
    CASE WHEN p THEN 'c_special' WHEN r1 THEN 'c_es' WHEN r2 THEN 'c_en' WHEN r3 THEN 'c_de' ELSE w.class_id END AS class_id,
    CASE WHEN p THEN 1.0 WHEN r1 THEN least(s3 / 6.0, 1) WHEN r2 THEN least(s0 / 5.0, 1) WHEN r3 THEN least(s2 / 6.0, 1)
         WHEN w.class_id IS NULL THEN 0 ELSE least(w.score / CAST(w.kw AS DOUBLE), 1) END AS conf,
    CASE WHEN p THEN 'phrase' WHEN r1 OR r2 OR r3 THEN 'redirect' WHEN w.class_id IS NOT NULL THEN 'keywords' ELSE 'none' END AS how
  FROM (SELECT s.*, contains(t, 'license') AND (contains(t, 'mit ') OR contains(t, 'apache')) AS p,
      coalesce(x.class_id = 'c_fr' AND (contains(t, 'ción') OR contains(t, ' los ')) AND CASE WHEN s3 >= 2 THEN s3 ELSE 0 END >= 3, FALSE) AS r1,
      coalesce(x.class_id = 'c_de' AND contains(t, ' the ') AND NOT contains(t, ' und '), FALSE) AS r2,
      coalesce(x.class_id = 'c_en' AND contains(t, 'sch') AND contains(t, ' und ') AND NOT regexp_matches(t, '(?i)th[aeiou]\s'), FALSE) AS r3
    FROM scores s LEFT JOIN winners x USING (document_id)) s LEFT JOIN winners w USING (document_id))"""


@query("classify", CLASSIFY_SQL, ("scores", "winners"))
def classify_documents(spark, sf):
    return classify.classify_documents(_class_docs(spark, sf), RULES, REDIRECTS, PHRASES)


@query("class_argmax", "SELECT document_id, class_id, score FROM winners", ("winners",))
def class_argmax(spark, sf):
    return classify.classify_documents(_class_docs(spark, sf), RULES, [], []).filter(F.col("class_id").isNotNull()).select(
        "document_id", "class_id", "score")


@query("filename_bonus", r"""
SELECT page_id, stem, CASE WHEN stem = '' THEN 0 ELSE least(CAST(contains(stem, 'thththth') AS INT) + CAST(contains(stem, 'example') AS INT) + CAST(contains(stem, 'th') AS INT) * 0 + CAST(contains(stem, 'http:') AS INT) + CAST(contains(stem, 'https') AS INT), 2) END AS bonus
FROM (SELECT page_id, CASE WHEN len(list_intersect(regexp_split_to_array(trim(s), '\s+'), ['packet', 'bundle', 'combined', 'scan', 'scanned', 'documents', 'files', 'mixed', 'all', 'full'])) > 0 THEN '' ELSE s END AS stem
  FROM (SELECT page_id, lower(regexp_replace(regexp_replace(url || CASE WHEN page_id % 7 = 0 THEN '_all.x' ELSE '.x' END, '\.[^.]*$', ''), '[_\-.]', ' ', 'g')) AS s FROM pages))""")
def filename_bonus(spark, sf):
    p = tables.read_table(spark, sf, "pages", "page_id", "url")
    name = F.concat("url", F.when(F.col("page_id") % 7 == 0, "_all.x").otherwise(".x"))
    stem = T.file_stem(name)
    kws = T.text_array(["thththth", "example", "th", "http:", "https"])
    return p.select("page_id", stem.alias("stem"), F.when(stem == "", 0).otherwise(T.filename_bonus(stem, kws)).alias("bonus"))


@query("governance_triage", """
SELECT document_id, CASE WHEN class_id = 'c_es' THEN 'NEW_TYPE' WHEN conf >= 0.35 AND n = 0 THEN 'CORRECT' WHEN conf < 0.35 THEN 'NEW_TYPE' ELSE 'CORRECT' END AS verdict,
  CASE WHEN class_id = 'c_es' THEN 0.4 WHEN conf >= 0.35 AND n = 0 THEN 0.6 WHEN conf < 0.35 THEN 0.4 ELSE 0.5 END::DOUBLE AS confidence
FROM (SELECT document_id, class_id, doc_id % 100 / 100.0 AS conf, doc_id % 3 AS n FROM registry)""", ("registry",))
def governance_triage(spark, sf):
    d = views.registry(spark, sf)
    g = classify.governance_triage(F.when(F.col("class_id") != "c_es", F.col("class_id")), F.col("doc_id") % 100 / 100.0, F.col("doc_id") % 3)
    return d.select("document_id", g["verdict"].alias("verdict"), g["confidence"].alias("confidence"))


DENSITY_SQL = T.DATA_DENSITY.replace("'", "''")


@query("data_density", f"SELECT document_id, page_num, len(regexp_extract_all(text, '{DENSITY_SQL}')) AS score FROM doc_pages", ("doc_pages",))
def data_density(spark, sf):
    return views.doc_pages(spark, sf).select("document_id", "page_num", T.data_density(F.col("text")).alias("score"))


O.view("html_lines", r"""
SELECT page_id, trim(l) AS l FROM (SELECT page_id, unnest(string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10))) AS l FROM pages)""")
O.view("trade_lines", """
SELECT document_id, unnest(['INVOICE', 'Invoice No.: ' || invoice_number, 'Invoice Date: ' || invoice_date, 'Supplier: ' || coalesce(supplier_name, ''), 'PO No.: ' || coalesce(customer_po_ref, ''),
  'Invoice Total: ' || currency || ' ' || total_amount, 'Payment Terms: 30 days net', 'Thank you']) AS l FROM trade_text""", "trade_text")
O.view("label_lines", r"""
SELECT document_id, trim(coalesce(nullif(regexp_extract(l, '^(.{2,60}?)\s*:-?\s*$', 1), ''), nullif(regexp_extract(l, '^(.{2,60}?)\s*:-?\s+\S', 1), ''))) AS lab
FROM (SELECT document_id, trim(l) AS l FROM trade_lines UNION ALL SELECT 'page_' || page_id, l FROM html_lines)""", "trade_lines", "html_lines")


def _label_docs(spark, sf):
    t = views.trade_text(spark, sf).select("document_id", "text")
    h = tables.read_table(spark, sf, "pages", "page_id", "html").select(
        F.concat(F.lit("page_"), "page_id").alias("document_id"), F.regexp_replace("html", "<[^>]*>", "\n").alias("text"))
    return t.unionByName(h)


@query("label_scan", r"""
SELECT DISTINCT document_id, lower(lab) AS label FROM label_lines WHERE lab <> '' AND NOT (len(regexp_extract_all(lab, '[A-Za-z]{2,}')) > 0
  AND len(list_filter(regexp_extract_all(lab, '[A-Za-z]{2,}'), lambda w: w <> upper(w))) = 0)
  AND len(regexp_split_to_array(lab, '\s+')) <= 7 AND NOT regexp_matches(lab, '^\d+[.\s]*$')""", ("label_lines",))
def label_scan(spark, sf):
    return _label_docs(spark, sf).select("document_id", F.explode(T.labels(F.col("text"))).alias("label"))


@query("colon_scan", """
SELECT document_id, field_name, field_value, 0.65::DOUBLE AS confidence FROM (
  SELECT document_id, 'invoice_no' AS field_name, invoice_number AS field_value FROM trade_text UNION ALL SELECT document_id, 'invoice_date', invoice_date FROM trade_text
  UNION ALL SELECT document_id, 'supplier', supplier_name FROM trade_text WHERE supplier_name IS NOT NULL
  UNION ALL SELECT document_id, 'po_no', customer_po_ref FROM trade_text WHERE customer_po_ref IS NOT NULL
  UNION ALL SELECT document_id, 'invoice_total', currency || ' ' || total_amount FROM trade_text UNION ALL SELECT document_id, 'payment_terms', '30 days net' FROM trade_text)""", ("trade_text",))
def colon_scan(spark, sf):
    return T.colon_scan(views.trade_text(spark, sf).withColumn(
        "text", F.regexp_replace("text", r"(Supplier|PO No\.): \n", "")))


# ---- duplicates ----------------------------------------------------------------------------


@query("exact_dups", """
SELECT document_id, first_id AS original_document_id, file_sha256, copies FROM (SELECT document_id, file_sha256, count(*) OVER w AS copies,
  first_value(document_id) OVER (PARTITION BY file_sha256 ORDER BY created_at, document_id) AS first_id FROM registry WINDOW w AS (PARTITION BY file_sha256))
WHERE document_id <> first_id""", ("registry",))
def exact_dups(spark, sf):
    return dedup.exact_duplicates(views.registry(spark, sf))


O.view("near", """
SELECT document_id, class_id, original_document_id, hamming_distance, CASE WHEN hamming_distance <= 3 THEN 'CONTENT_DUPLICATE' ELSE 'NEAR_DUPLICATE' END AS duplicate_type FROM (
  SELECT a.document_id, a.class_id, b.document_id AS original_document_id, CAST(bit_count(xor(a.fp, b.fp)) AS INTEGER) AS hamming_distance,
    row_number() OVER (PARTITION BY a.document_id ORDER BY bit_count(xor(a.fp, b.fp)), b.created_at, b.document_id) AS rn
  FROM simhash a JOIN simhash b ON a.class_id = b.class_id AND a.document_id <> b.document_id AND b.status IN ('COMPLETED', 'NEEDS_REVIEW', 'CONTENT_DUPLICATE', 'NEAR_DUPLICATE')
    AND a.fp <> 0 AND b.fp <> 0 AND bit_count(xor(a.fp, b.fp)) <= 10) WHERE rn = 1""", "simhash")


def _dedup_docs(spark, sf):
    d = views.registry(spark, sf)
    return d.drop("text").join(T.simhash64(d), "document_id")


@query("near_dups", "SELECT * FROM near", ("near",))
def near_dups(spark, sf):
    return dedup.near_duplicates(_dedup_docs(spark, sf))


@query("dedup_documents", """
SELECT r.document_id, CASE WHEN first_id <> r.document_id THEN 'EXACT_DUPLICATE' ELSE duplicate_type END AS duplicate_type,
  CASE WHEN first_id <> r.document_id THEN first_id ELSE original_document_id END AS original_document_id,
  CASE WHEN first_id <> r.document_id THEN 0 ELSE hamming_distance END AS hamming_distance
FROM (SELECT document_id, first_value(document_id) OVER (PARTITION BY file_sha256 ORDER BY created_at, document_id) AS first_id FROM registry) r LEFT JOIN near n USING (document_id)""", ("registry", "near"))
def dedup_documents(spark, sf):
    return dedup.dedup_documents(_dedup_docs(spark, sf))


@query("similarity_class", """
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN d <= 3 THEN 'CONTENT_DUPLICATE' WHEN d <= 10 THEN 'NEAR_DUPLICATE' ELSE 'DISTINCT' END AS kind
  FROM (SELECT bit_count(xor(event_id, user_id * 37)) AS d FROM events)) GROUP BY 1""")
def similarity_class(spark, sf):
    e = tables.read_table(spark, sf, "events", "event_id", "user_id")
    kind = F.coalesce(T.similarity_class(T.hamming(F.col("event_id"), F.col("user_id") * 37)), F.lit("DISTINCT"))
    return e.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _order_pairs(spark, sf):
    """Invoice of every order against that of the order before it."""
    d = views.trade_docs(spark, sf).filter((F.col("class_id") == "dc_006") & (F.col("k") > 0))
    return d.select("document_id", F.concat(F.lit("inv_"), F.col("k") - 1).alias("original_document_id"))


O.view("diffs", """
SELECT document_id, original_document_id, field_name, incoming_value, original_value FROM (
  SELECT p.document_id, p.original_document_id, n.field_name, a.v AS incoming_value, b.v AS original_value
  FROM (SELECT document_id, 'inv_' || (k - 1) AS original_document_id FROM trade_docs WHERE class_id = 'dc_006' AND k > 0) p,
    (VALUES ('invoice_number'), ('invoice_date'), ('currency'), ('total_amount'), ('customer_po_ref'), ('supplier_name')) n(field_name)
  LEFT JOIN (SELECT document_id, field_name, CASE WHEN human_corrected THEN corrected_value ELSE field_value END AS v FROM fields) a ON a.document_id = p.document_id AND a.field_name = n.field_name
  LEFT JOIN (SELECT document_id, field_name, CASE WHEN human_corrected THEN corrected_value ELSE field_value END AS v FROM fields) b ON b.document_id = p.original_document_id AND b.field_name = n.field_name)
WHERE incoming_value IS DISTINCT FROM original_value""", "trade_docs", "fields")


@query("field_diff", "SELECT * FROM diffs", ("diffs",))
def field_diff(spark, sf):
    from leafstack.operators.fieldset import field_diff as diff
    return diff(_order_pairs(spark, sf), views.extracted_fields(spark, sf))


@query("amendments", """
SELECT document_id, original_document_id, changed_fields, 'NEEDS_REVIEW' AS status, 'NEAR_DUPLICATE - ' || changed_fields || ' field(s) changed vs original ' || original_document_id
  || '. Changed: ' || array_to_string(names[1:10], ', ') || '. Detail: ' || array_to_string(list_transform(d[1:6], lambda x: x.n || ': ' || coalesce('''' || x.o || '''', 'None') || ' -> ' || coalesce('''' || x.i || '''', 'None')), ' | ') AS reason
FROM (SELECT document_id, original_document_id, count(*) AS changed_fields, list(field_name ORDER BY field_name) AS names,
    list({'n': field_name, 'o': original_value, 'i': incoming_value} ORDER BY field_name) AS d FROM diffs GROUP BY 1, 2)""", ("diffs",))
def amendments(spark, sf):
    from leafstack.operators import fieldset
    pairs = _order_pairs(spark, sf)
    return fieldset.amendment_outcome(pairs, fieldset.field_diff(pairs, views.extracted_fields(spark, sf)))


# ---- pages -----------------------------------------------------------------------------------


@query("page_text", """
SELECT document_id, trim(regexp_replace(string_agg(text, ' ' ORDER BY page_num), '\\s+', ' ', 'g')) AS text FROM doc_pages WHERE trim(text) <> '' GROUP BY 1""".replace("\\\\", "\\"), ("doc_pages",))
def page_text(spark, sf):
    return pages.document_text(views.doc_pages(spark, sf).drop("variant_id"))


@query("split_pages", "SELECT document_id, count(*) AS pages, sum(length(text)) AS chars FROM doc_pages GROUP BY 1", ("doc_pages",))
def split_pages(spark, sf):
    p = pages.split_pages(views.registry(spark, sf).select("document_id", "text"))
    return p.groupBy("document_id").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("text")).alias("chars"))


O.view("page_fields", """
SELECT document_id, field_name, lower(trim(v)) AS v, v AS raw FROM (
  SELECT document_id, 'mid' AS field_name, substr(text, length(text) // 2, 12) AS v FROM registry
  UNION ALL SELECT document_id, 'early', substr(text, 5, 9) FROM registry UNION ALL SELECT document_id, 'short', 'EUR' FROM registry)""", "registry")


def _page_fields(spark, sf):
    d = views.registry(spark, sf).select("document_id", "text")
    t = F.col("text")
    cells = F.array(
        F.struct(F.lit("mid").alias("field_name"), F.expr("substring(text, cast(length(text) div 2 as int), 12)").alias("field_value")),
        F.struct(F.lit("early").alias("field_name"), F.substring(t, 5, 9).alias("field_value")),
        F.struct(F.lit("short").alias("field_name"), F.lit("EUR").alias("field_value")))
    return d.select("document_id", F.explode(cells).alias("c")).select("document_id", "c.*", F.lit("scalar").alias("field_type"))


@query("field_pages", """
SELECT f.document_id, f.field_name, min(page_num) AS page_num FROM page_fields f JOIN doc_pages p ON p.document_id = f.document_id AND length(f.v) >= 4 AND contains(lower(p.text), f.v) GROUP BY 1, 2""", ("page_fields", "doc_pages"))
def field_pages(spark, sf):
    return pages.attribute_fields(views.doc_pages(spark, sf).drop("variant_id"), _page_fields(spark, sf))


@query("field_locate", """
SELECT f.document_id, f.field_name, min(page_num) AS page_num FROM (SELECT document_id, field_name, lower(substr(trim(raw), 1, 8)) AS v FROM page_fields WHERE field_name = 'mid') f
JOIN doc_pages p ON p.document_id = f.document_id AND length(v) >= 4 AND regexp_matches(v, '^[a-z]+$') AND contains(lower(p.text), v) GROUP BY 1, 2""", ("page_fields", "doc_pages"))
def field_locate(spark, sf):
    f = _page_fields(spark, sf).filter(F.col("field_name") == "mid").withColumn("value", F.substring(F.trim("field_value"), 1, 8))
    asks = f.filter(F.lower("value").rlike("^[a-z]+$")).select("document_id", "field_name", "value")
    return pages.locate_fields(views.doc_pages(spark, sf).drop("variant_id"), asks).drop("matched")


@query("page_profile", "SELECT variant_id, page_num, instances, present_in, contributed_in, fields_seen, skip FROM page_profile", ("page_profile",))
def page_profile(spark, sf):
    return pages.page_profile(views.page_contributions(spark, sf)).withColumn("fields_seen", F.array_join("fields_seen", ","))


@query("page_profile_summary", """
SELECT variant_id, instances, pages_tracked, skipped_pages, skipped_pages * 300 * instances AS tokens_saved,
  CAST(round(CAST(skipped_pages * 300 * instances AS DECIMAL(20,0)) * 0.000003, 4) AS DOUBLE) AS cost_saved_usd,
  CASE WHEN instances < 3 THEN 'learning' WHEN skipped_pages > 0 THEN 'confident' ELSE 'learning' END AS stage
FROM (SELECT variant_id, max(instances) AS instances, count(*) AS pages_tracked, count(*) FILTER (skip) AS skipped_pages FROM page_profile GROUP BY 1)""", ("page_profile",))
def page_profile_summary(spark, sf):
    return pages.page_profile_summary(pages.page_profile(views.page_contributions(spark, sf)))


@query("pruned_pages", """
SELECT p.variant_id, count(*) AS pages FROM doc_pages p LEFT JOIN page_profile f ON f.variant_id = p.variant_id AND f.page_num = p.page_num AND f.skip WHERE f.page_num IS NULL GROUP BY 1""", ("doc_pages", "page_profile"))
def pruned_pages(spark, sf):
    left = pages.prune_pages(views.doc_pages(spark, sf), pages.page_profile(views.page_contributions(spark, sf)))
    return left.groupBy("variant_id").agg(F.count(F.lit(1)).alias("pages"))


@query("page_audit", """
SELECT variant_id, page_num, instances, present_in, contributed_in, CAST(round(CAST(contributed_in::DOUBLE / present_in AS DECIMAL(18,10)), 2) AS DOUBLE) AS contribution_rate,
  CASE WHEN skip THEN 'skipping' WHEN contributed_in > 0 THEN 'useful' ELSE 'empty' END AS status, NOT skip AND contributed_in = 0 AND present_in >= 3 AS candidate FROM page_profile""", ("page_profile",))
def page_audit(spark, sf):
    return pages.page_audit(pages.page_profile(views.page_contributions(spark, sf)))


@query("page_audit_summary", """
SELECT variant_id, instances, pages_tracked, skipped_pages, candidates, CAST(round(CAST(skipped_pages * 300 * instances AS DECIMAL(20,0)) * 0.000003, 4) AS DOUBLE) AS cost_saved_usd,
  CAST(round(CAST(candidates * 300 * instances AS DECIMAL(20,0)) * 0.000003, 4) AS DOUBLE) AS additional_saving_usd,
  CASE WHEN instances < 3 THEN 'insufficient_data' WHEN candidates > 0 THEN 'candidates_available' ELSE 'optimal' END AS recommendation
FROM (SELECT variant_id, max(instances) AS instances, count(*) AS pages_tracked, count(*) FILTER (skip) AS skipped_pages,
  count(*) FILTER (NOT skip AND contributed_in = 0 AND present_in >= 3) AS candidates FROM page_profile GROUP BY 1)""", ("page_profile",))
def page_audit_summary(spark, sf):
    return pages.page_audit_summary(pages.page_profile(views.page_contributions(spark, sf)))


BUDGET = 3000


@query("page_budget")
def page_budget(spark, sf):
    return pages.page_budget(views.doc_pages(spark, sf).drop("variant_id"), BUDGET)


@query("page_budget_always", f"""
SELECT document_id, page_num FROM (SELECT document_id, page_num, count(*) OVER w AS n, sum(length(text)) OVER w + 2 * (count(*) OVER w - 1) AS total FROM doc_pages WINDOW w AS (PARTITION BY document_id))
WHERE total <= {BUDGET} OR page_num < 3 OR page_num >= n - 10""", ("doc_pages",))
def page_budget_always(spark, sf):
    """Pages every budget keeps: whole documents that fit, else head and tail."""
    p = pages.page_budget(views.doc_pages(spark, sf).drop("variant_id"), BUDGET)
    n = p.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("selected")).alias("out"))
    keep = (F.col("out") == 0) | (F.col("page_num") < 3) | (F.col("page_num") >= F.col("n") - 10)
    fits = views.registry(spark, sf).select("document_id", (F.length("text") + F.size(F.split("text", "\n")) - 1 <= BUDGET).alias("fits"))
    return p.filter("selected").join(n, "document_id").join(fits, "document_id").filter(
        F.col("fits") | (F.col("page_num") < 3) | (F.col("page_num") >= F.col("n") - 10)).filter(keep | F.col("fits")).select("document_id", "page_num")


@query("skip_markers", """
SELECT document_id, after_page, skipped, '[... ' || skipped || ' page(s) skipped ...]' AS marker FROM (
  SELECT document_id, coalesce(lag(page_num) OVER (PARTITION BY document_id ORDER BY page_num), -1) AS after_page,
    page_num - coalesce(lag(page_num) OVER (PARTITION BY document_id ORDER BY page_num), -1) - 1 AS skipped FROM doc_pages WHERE page_num % 5 IN (1, 2)
  UNION ALL SELECT document_id, coalesce(max(page_num) FILTER (page_num % 5 IN (1, 2)), -1), max(page_num) - coalesce(max(page_num) FILTER (page_num % 5 IN (1, 2)), -1) FROM doc_pages GROUP BY 1)
WHERE skipped > 0""", ("doc_pages",))
def skip_markers(spark, sf):
    s = views.doc_pages(spark, sf).select("document_id", "page_num", (F.col("page_num") % 5).isin(1, 2).alias("selected"))
    return pages.skip_markers(s)


# ---- bundles -----------------------------------------------------------------------------------

O.view("page_class", f"""
SELECT document_id, page_num, n_chars, conf AS confidence, CASE WHEN conf >= 0.25 THEN class_id END AS class_id FROM (
  SELECT document_id, page_num, length(trim(t)) AS n_chars, greatest({', '.join(f'c{i}' for i in range(4))}) AS conf,
    CASE {' '.join(f"WHEN c{i} = greatest({', '.join(f'c{j}' for j in range(4))}) THEN '{r.class_id}'" for i, r in enumerate(RULES))} END AS class_id
  FROM (SELECT document_id, page_num, t, {', '.join(f"least({_score(r, 't')} / {len(r.keywords)}.0::DOUBLE, 1.0)::DOUBLE AS c{i}" for i, r in enumerate(RULES))}
    FROM (SELECT document_id, page_num, lower(coalesce(text, '')) AS t FROM bundle_pages)))""", "bundle_pages")


def _page_classes(spark, sf):
    return bundles.page_classes(views.bundle_pages(spark, sf).drop("role"), RULES)


@query("page_classes", "SELECT document_id, page_num, class_id, round(confidence, 9) AS confidence, n_chars FROM page_class", ("page_class",))
def page_classes(spark, sf):
    return _page_classes(spark, sf).withColumn("confidence", F.round("confidence", 9))


# smoothing is order-dependent: the SQL twin walks the pages with a recursive query
O.view("ordered_pages", """
SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY page_num) AS i, count(*) OVER (PARTITION BY document_id) AS n, class_id, confidence, page_num FROM page_class""", "page_class")


def _smooth(prev: str, out: str) -> None:
    O.view(out, f"""
SELECT document_id, i, n, page_num, confidence, class_id FROM (
WITH RECURSIVE walk AS (
  SELECT o.document_id, o.i, o.n, o.page_num, o.confidence, o.class_id FROM {prev} o WHERE o.i = 1
  UNION ALL
  SELECT c.document_id, c.i, c.n, c.page_num, c.confidence, CASE WHEN c.i < c.n AND c.class_id IS DISTINCT FROM w.class_id AND w.class_id IS NOT DISTINCT FROM x.class_id THEN w.class_id ELSE c.class_id END
  FROM walk w JOIN {prev} c ON c.document_id = w.document_id AND c.i = w.i + 1 LEFT JOIN {prev} x ON x.document_id = c.document_id AND x.i = c.i + 1)
SELECT * FROM walk)""", prev)


_smooth("ordered_pages", "smooth1")
_smooth("smooth1", "smooth2")
O.view("segments", """
SELECT document_id, segment_no - 1 AS segment_no, min(page_num) AS start_page, max(page_num) AS end_page, min(class_id) AS class_id, count(*) AS pages,
  CAST(round(avg(CAST(confidence AS DECIMAL(18,10))), 6) AS DOUBLE) AS avg_confidence
FROM (SELECT *, sum(chg) OVER (PARTITION BY document_id ORDER BY i) AS segment_no FROM (
  SELECT *, CASE WHEN i = 1 OR class_id IS DISTINCT FROM lag(class_id) OVER (PARTITION BY document_id ORDER BY i) THEN 1 ELSE 0 END AS chg FROM smooth2)) GROUP BY 1, 2""", "smooth2")


@query("segment_pages", "SELECT * FROM segments", ("segments",))
def segment_pages(spark, sf):
    return bundles.segment_pages(_page_classes(spark, sf))


@query("segment_by_role", """
SELECT document_id, page_num, role FROM bundle_pages WHERE FALSE UNION ALL
SELECT document_id, min(page_num), any_value(role) FROM (SELECT *, page_num - row_number() OVER (PARTITION BY document_id, role ORDER BY page_num) AS g FROM bundle_pages) GROUP BY document_id, role, g""", ("bundle_pages",))
def segment_by_role(spark, sf):
    """Runs of one speaker, without smoothing: pages of two roles never alternate away."""
    p = views.bundle_pages(spark, sf)
    from pyspark.sql import Window
    w = Window.partitionBy("document_id").orderBy("page_num")
    change = F.coalesce((F.col("role") != F.lag("role").over(w)).cast("int"), F.lit(1))
    runs = p.withColumn("c", change).withColumn("run", F.sum("c").over(w))
    return runs.groupBy("document_id", "run").agg(F.min("page_num").alias("page_num"), F.min("role").alias("role")).drop("run")


@query("needs_refine", """
SELECT document_id, count(*) AS pages, count(*) FILTER (confidence < 0.25) AS weak_pages, count(*) FILTER (n_chars < 50) AS empty_pages,
  count(*) FILTER (confidence < 0.25) * 10 > count(*) * 4 OR count(*) FILTER (n_chars < 50) * 10 > count(*) * 3 AS needs_review FROM page_class GROUP BY 1""", ("page_class",))
def needs_refine(spark, sf):
    return bundles.splitting_needs_review(_page_classes(spark, sf))


@query("annotate_segments", """
SELECT document_id, segment_no, start_page, end_page, class_id, pages, CAST(round(coalesce(votes, allv) / pages, 6) AS DOUBLE) AS avg_confidence FROM (
  SELECT document_id, half AS segment_no, min(page_num) AS start_page, max(page_num) AS end_page, count(*) AS pages, sum(CAST(confidence AS DECIMAL(18,10))) AS allv FROM (SELECT *, page_num // 2 AS half FROM page_class) GROUP BY 1, 2) a
LEFT JOIN (SELECT document_id, half AS segment_no, class_id, votes FROM (SELECT *, row_number() OVER (PARTITION BY document_id, half ORDER BY votes DESC, seen, class_id DESC) AS rn FROM (
  SELECT document_id, page_num // 2 AS half, class_id, sum(CAST(confidence AS DECIMAL(18,10))) AS votes, min(page_num) AS seen FROM page_class WHERE class_id IS NOT NULL GROUP BY ALL)) WHERE rn = 1) b USING (document_id, segment_no)""", ("page_class",))
def annotate_segments(spark, sf):
    p = _page_classes(spark, sf)
    seg = p.groupBy("document_id", F.floor(F.col("page_num") / 2).alias("segment_no")).agg(
        F.min("page_num").alias("start_page"), F.max("page_num").alias("end_page"))
    return bundles.annotate_segments(seg, p)


NAMES = [(r.class_id, r.name) for r in RULES]


@query("split_children", f"""
SELECT document_id || '_part' || (segment_no + 1) AS document_id, document_id AS parent_document_id, segment_no, start_page, end_page,
  'bundle ' || document_id || '_part' || (segment_no + 1) || '_' || replace(lower(coalesce(name, 'unknown')), ' ', '_') || '.pdf' AS file_name, 'RECEIVED' AS status,
  end_page - start_page + 1 AS pages_total, (start_page + 1) || '–' || (end_page + 1) AS segment_pages, name AS detected_class
FROM segments LEFT JOIN {O.values('class_id, name', NAMES)} USING (class_id) WHERE document_id IN (SELECT document_id FROM segments GROUP BY 1 HAVING count(*) > 1)""", ("segments",))
def split_children(spark, sf):
    p = views.bundle_pages(spark, sf)
    parents = p.select("document_id").distinct().withColumn("file_name", F.concat(F.lit("bundle "), "document_id", F.lit(".pdf")))
    names = spark.createDataFrame(NAMES, "class_id string, name string")
    return bundles.split_bundles(p.drop("role"), RULES, parents, names)


@query("bundle_children", """
SELECT 'conv_' || conv_id || '.pdf' AS parent_file_name, 'conv_' || conv_id AS parent_document_id, 'turn_' || conv_id || '_' || turn AS document_id FROM conversations""")
def bundle_children(spark, sf):
    p = views.bundle_pages(spark, sf)
    parents = p.select("document_id").distinct().select("document_id", F.concat("document_id", F.lit(".pdf")).alias("file_name"),
                                                      F.lit(None).cast("string").alias("parent_document_id"))
    kids = p.select(F.concat(F.lit("turn_"), F.substring("document_id", 6, 20), F.lit("_"), "page_num").alias("document_id"),
                    F.lit("x").alias("file_name"), F.col("document_id").alias("parent_document_id"))
    return bundles.bundle_children(parents.unionByName(kids))


# ---- extraction -----------------------------------------------------------------------------------

PATTERNS = [
    extract.label_pattern("invoice_number", ["invoice no", "invoice number"], "reference", 0.91),
    extract.label_pattern("invoice_date", ["invoice date"], "date", 0.90),
    R.Pattern("supplier_name", r"^Supplier: (Supplier#\d*[02468])$", 1, 0.95),
    R.Pattern("supplier_name", r"^Supplier:[ ]*(\S[^\n]*)$", 1, 0.80),
    R.Pattern("customer_po_ref", r"\b(TSL/\d{5,6})\b", 1, 0.95),
    extract.label_pattern("total_amount", ["invoice total"], "amount", 0.88),
    R.Pattern("currency", r"\b(EUR|GBP|USD|CHF)\b", 1, 0.87),
    R.Pattern("payment_terms", r"payment\s+terms:\s*([^\n]+)", 1, 0.85),
]
TARGETS = {"dc_006": ["invoice_number", "invoice_date", "supplier_name", "currency", "total_amount", "payment_terms", "iban", "customer_po_ref"]}
STAGE_SQL = "CASE k % 3 WHEN 0 THEN 0.88 WHEN 1 THEN 0.92 ELSE 1.0 END"
O.view("extracted", f"""
SELECT document_id, k, ordinal, field_name, field_value, CAST(round(least(c * f, 1), 4) AS DOUBLE) AS confidence FROM (
  SELECT document_id, k, CAST({STAGE_SQL} AS DECIMAL(4,2)) AS f, unnest([
    {{'ordinal': 0, 'field_name': 'invoice_number', 'field_value': invoice_number, 'c': 0.91}}, {{'ordinal': 1, 'field_name': 'invoice_date', 'field_value': invoice_date, 'c': 0.90}},
    {{'ordinal': 2, 'field_name': 'supplier_name', 'field_value': supplier_name, 'c': CASE WHEN regexp_matches(supplier_name, '[02468]$') THEN 0.95 ELSE 0.80 END}},
    {{'ordinal': 3, 'field_name': 'currency', 'field_value': currency, 'c': 0.87}}, {{'ordinal': 4, 'field_name': 'total_amount', 'field_value': total_amount, 'c': 0.88}},
    {{'ordinal': 5, 'field_name': 'payment_terms', 'field_value': '30 days net', 'c': 0.85}}, {{'ordinal': 7, 'field_name': 'customer_po_ref', 'field_value': customer_po_ref, 'c': 0.95}}], recursive := true)
  FROM trade_text) WHERE field_value IS NOT NULL""", "trade_text")


def _staged_text(spark, sf):
    return views.trade_text(spark, sf).withColumn("stage", views.pick(F.col("k") % 3, "ZERO_SHOT", "LEARNING", "LEARNED"))


@query("extract_fields", "SELECT document_id, ordinal, field_name, field_value, confidence, 'TEXT_LAYER' AS extraction_method, 1 AS extraction_tier FROM extracted", ("extracted",))
def extract_fields(spark, sf):
    return extract.extract_fields(_staged_text(spark, sf), PATTERNS, TARGETS)


LEARNED = {"dc_006": [R.Pattern("invoice_number", r"invoice no\.: (\S+)", 1, 0.9), R.Pattern("supplier_name", r"supplier: (\S+)", 1, 0.88),
                      R.Pattern("customer_po_ref", r"po no\.: (\S+)", 1, 0.86), R.Pattern("currency", r"total: (\w{3})", 1, 0.7)]}


@query("fast_path_gate", """
SELECT document_id, class_id, 2 + h AS found, 1 + h AS good, 8 AS target_count, 1 + h >= 3.2 AS accepted
FROM (SELECT document_id, class_id, CAST(supplier_name IS NOT NULL AS INT) + CAST(customer_po_ref IS NOT NULL AS INT) AS h FROM trade_text)""", ("trade_text",))
def fast_path_gate(spark, sf):
    t = views.trade_text(spark, sf).withColumn("text", F.regexp_replace("text", r"(Supplier|PO No\.): \n", "$1:|\n"))
    return extract.fast_path(t, LEARNED, TARGETS)


@query("resolve_schema", """
SELECT document_id, CASE WHEN v.learning_stage IS NULL THEN CASE WHEN class_id = 'dc_003' THEN 'LEARNING' ELSE 'ZERO_SHOT' END
    WHEN v.learning_stage = 'ZERO_SHOT' THEN 'ZERO_SHOT' ELSE v.learning_stage END AS stage,
  CASE WHEN v.learning_stage <> 'ZERO_SHOT' THEN 'variant' WHEN v.learning_stage IS NULL AND class_id = 'dc_003' THEN 'class' ELSE 'static' END AS source,
  CASE WHEN v.learning_stage <> 'ZERO_SHOT' THEN 5 WHEN v.learning_stage IS NULL AND class_id = 'dc_003' THEN 2 WHEN class_id = 'dc_006' THEN 8 ELSE 0 END AS target_fields
FROM trade_docs LEFT JOIN (SELECT variant_id, learning_stage FROM variants) v USING (variant_id)""", ("trade_docs", "variants"))
def resolve_schema(spark, sf):
    schema = views.variant_schema(spark, sf).groupBy("variant_id").agg(F.collect_set("canonical").alias("schema_fields"))
    v = views.variants(spark, sf).join(schema, "variant_id", "left")
    c = spark.createDataFrame([("dc_003", "LEARNING", ["po_number", "po_date"])], "class_id string, learning_stage string, schema_fields array<string>")
    t = spark.createDataFrame([("dc_006", TARGETS["dc_006"])], "class_id string, fields array<string>")
    r = extract.resolve_schema(views.trade_docs(spark, sf), v, c, t)
    return r.withColumn("target_fields", F.size("target_fields"))


# ---- more scalar functions ---------------------------------------------------------------------------


@query("slugify", r"""
SELECT c_custkey, substr(trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(trim(c_name)), '\b(limited|ltd\.?|gmbh|inc\.?|corp\.?|s\.?a\.?|b\.?v\.?|ag|llc)\b', '', 'g'), '[^\p{L}\p{N}_\s]', ' ', 'g')), '\s+', '-', 'g'), '-+', '-', 'g'), '-'), 1, 80) AS slug
FROM (SELECT c_custkey, c_name || CASE c_custkey % 4 WHEN 0 THEN ' GmbH' WHEN 1 THEN ' & Sons Ltd' WHEN 2 THEN ' (UK) Limited' ELSE '' END AS c_name FROM customer)""")
def slugify(spark, sf):
    c = tables.read_table(spark, sf, "customer", "c_custkey", "c_name")
    name = F.concat("c_name", views.pick(F.col("c_custkey") % 4, " GmbH", " & Sons Ltd", " (UK) Limited", ""))
    return c.select("c_custkey", N.slugify(name).alias("slug"))


@query("abstract_filename", r"""
SELECT doc_id, CASE WHEN length(p) >= 4 THEN p END AS pattern FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'PO\-\d+\-[A-Z]+' WHEN 1 THEN 'a\d+' ELSE 'Rechnung\ \(\d+\)' END AS p FROM registry)""", ("registry",))
def abstract_filename(spark, sf):
    i = F.col("doc_id")
    name = (F.when(i % 3 == 0, F.concat(F.lit("PO-"), i, F.lit("-ABCD.pdf"))).when(i % 3 == 1, F.concat(F.lit("a"), i, F.lit(".txt")))
            .otherwise(F.concat(F.lit("Rechnung ("), i, F.lit(").pdf"))))
    return views.registry(spark, sf).select("doc_id", N.abstract_filename(name).alias("pattern"))


@query("fiscal_year", """
SELECT o_orderkey, 'FY' || CASE WHEN month(o_orderdate) >= 4 THEN year(o_orderdate) + 1 ELSE year(o_orderdate) END AS fiscal_year FROM orders""")
def fiscal_year(spark, sf):
    return tables.read_table(spark, sf, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", N.fiscal_year(F.col("o_orderdate")).alias("fiscal_year"))


@query("stage_progress", """
SELECT k, CASE WHEN n >= 50 THEN 'OPTIMISED' WHEN n >= 10 THEN 'LEARNED_PROPOSED' WHEN n >= 3 THEN 'LEARNING' ELSE 'ZERO_SHOT' END AS stage,
  CASE WHEN n >= 50 THEN 100 WHEN n >= 10 THEN 55 WHEN n >= 3 THEN least(5 + CAST(floor(n * 4.5) AS INT), 49) ELSE 5 END AS pct FROM (SELECT o_orderkey AS k, o_orderkey % 60 AS n FROM orders)""")
def stage_progress(spark, sf):
    o = tables.read_table(spark, sf, "orders", "o_orderkey").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 60).alias("n"))
    s = N.learning_stage(F.col("n"))
    return o.select("k", s.alias("stage"), N.progress_pct(s, F.col("n")).alias("pct"))


@query("class_slugs", r"""
SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS hyphen, substr(replace(translate(lower(p_name || ' / (' || p_brand || ')'), ' /', '__'), '(', '').replace(')', ''), 1, 40) AS underscore FROM part""")
def class_slugs(spark, sf):
    p = tables.read_table(spark, sf, "part", "p_partkey", "p_name", "p_brand")
    return p.select("p_partkey", N.class_slug(F.concat("p_name", F.lit(" / "), "p_brand")).alias("hyphen"),
                    N.class_slug(F.concat("p_name", F.lit(" / ("), "p_brand", F.lit(")")), "_").alias("underscore"))


@query("address_candidates", r"""
SELECT page_id, name, CASE WHEN regexp_matches(name, '(?i)\b(ship to|address|consignee)\b') OR (contains(v, chr(10)) AND length(v) >= 20) THEN TRUE ELSE FALSE END AS is_address,
  upper(regexp_replace('ab ' || page_id || ' x', '\s+', '', 'g')) AS key
FROM (SELECT doc_id AS page_id, CASE doc_id % 4 WHEN 0 THEN 'Ship To' WHEN 1 THEN 'buyer address' WHEN 2 THEN 'total' ELSE 'note' END AS name, text AS v FROM documents)""")
def address_candidates(spark, sf):
    d = tables.read_table(spark, sf, "documents", "doc_id", "text")
    name = views.pick(F.col("doc_id") % 4, "Ship To", "buyer address", "total", "note")
    v = F.col("text")
    return d.select(F.col("doc_id").alias("page_id"), name.alias("name"), V.is_address_field(name, v).alias("is_address"),
                    V.postcode_key(F.concat(F.lit("ab "), "doc_id", F.lit(" x"))).alias("key"))


@query("signature_pages", """
SELECT conv_id, turn, regexp_matches(lower(text), 'signature|signed by|authorised by|authorized by|approved by|signatory|sign here|authorisation|authorization') AS has_label,
  CASE WHEN turn < n - 1 - turn THEN 'start' ELSE 'end' END AS anchor, least(turn, n - 1 - turn) AS offset_pages, turn AS page_again
FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)""")
def signature_pages(spark, sf):
    c = tables.read_table(spark, sf, "conversations", "conv_id", "turn", "text")
    n = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    a = N.signature_anchor(F.col("turn"), F.col("n"))
    return c.join(n, "conv_id").select("conv_id", "turn", N.signature_label_page(F.col("text")).alias("has_label"), a["anchor"].alias("anchor"),
                                       a["offset"].alias("offset_pages"), N.target_page(a["anchor"], a["offset"], F.col("n")).alias("page_again"))


@query("token_cost", """
SELECT document_id, n_chars // 1800 + 1 AS pages, (n_chars // 1800 + 1) * 300 AS tokens, CAST(round(CAST((n_chars // 1800 + 1) * 300 AS DECIMAL(20,0)) * 0.000003, 4) AS DOUBLE) AS usd
FROM (SELECT document_id, file_size_bytes AS n_chars FROM registry)""", ("registry",))
def token_cost(spark, sf):
    d = views.registry(spark, sf).select("document_id", (F.floor(F.col("file_size_bytes") / 1800) + 1).alias("pages"))
    return d.select("document_id", "pages", N.tokens_for(F.col("pages")).alias("tokens"), N.cost_of(N.tokens_for(F.col("pages"))).alias("usd"))
