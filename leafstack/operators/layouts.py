"""Layout variants: issuer, fingerprint, matching to known layouts, new layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafstack.functions import names as N
from leafstack.functions.names import is_layout_field, slugify
from leafstack.operators.common import running_number
from leafstack.session import stored

STRONG_FIELDS, WEAK_FIELDS = 0.85, 0.60
STRONG_LABELS, WEAK_LABELS = 0.75, 0.50


def issuer_slugs(fields: DataFrame, priority: Sequence[str] = N.ISSUER_FIELDS,
                 buyers: Sequence[str] = N.BUYER_SLUGS) -> DataFrame:
    """document_id, issuer_slug: the first naming field with a value of more than 2 characters.

    Buyer slugs are passed over.  Documents without one are absent here ("unknown").
    """
    rank = F.create_map(*[x for i, n in enumerate(priority) for x in (F.lit(n), F.lit(i))])
    rows = fields.select(
        "document_id", F.try_element_at(rank, F.trim("field_name")).alias("rank"),
        F.trim(F.coalesce("field_value", F.lit(""))).alias("v")
    ).filter(F.col("rank").isNotNull() & (F.length("v") > 2))
    slugs = rows.select("document_id", "rank", slugify(F.col("v")).alias("slug")).filter(~F.col("slug").isin(list(buyers)))
    return slugs.groupBy("document_id").agg(F.min_by("slug", "rank").alias("issuer_slug"))


def fingerprints(fields: DataFrame) -> DataFrame:
    """Sorted names of valued layout fields per document, and the comma form."""
    name = F.trim("field_name")
    kept = fields.filter((name != "") & (F.coalesce("field_value", F.lit("")) != "") & is_layout_field(name))
    return kept.groupBy("document_id").agg(F.array_sort(F.collect_list(name)).alias("field_names")).withColumn(
        "fingerprint", F.array_join("field_names", ","))


def jaccard(a: Column, b: Column, both_empty: float) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def template_difference(doc_fields: Column, variant_fields: Column) -> Column:
    """struct<missing,extra>: names only the layout has, names only the document has."""
    return F.struct(F.array_sort(F.array_except(variant_fields, doc_fields)).alias("missing"),
                    F.array_sort(F.array_except(doc_fields, variant_fields)).alias("extra"))


def variant_candidates(docs: DataFrame, variants: DataFrame) -> DataFrame:
    """Scored (document, layout) candidates.

    `docs`: document_id, class_id, issuer_slug, field_names, labels, pages_total;
    `variants`: variant_id, class_id, issuer_slug, field_names, labels, page_count_mode, active.
    Same class; two known issuers must be equal; a candidate needs a weak field or label
    match, unless the document is image-like (under 3 labels) and its page count is within 3.

    Documents of one layout look alike, so equal signatures (class, issuer, names, labels)
    are compared once and the answer is joined back; a document with a known issuer only
    meets layouts of that issuer or of an unknown one.  Layouts are stored, so Spark sees how
    many they are: few go to the tasks, and documents are not dealt out by their few classes.
    """
    v = variants.filter("active").select(
        "variant_id", "class_id", F.coalesce("issuer_slug", F.lit("unknown")).alias("v_issuer"),
        F.col("field_names").alias("v_names"), F.col("labels").alias("v_labels"), "page_count_mode")
    # "=issuer" is met by documents of that issuer, "=unknown" by those of any known one, "*" by those of an unknown one
    named = lambda issuer: F.concat(F.lit("="), issuer)
    v = stored(v.withColumn("look", F.explode(F.array(named(F.col("v_issuer")), F.lit("*")))), "known-layouts")
    d = docs.withColumn("issuer_slug", F.coalesce("issuer_slug", F.lit("unknown"))).withColumn("look", F.explode(
        F.when(F.col("issuer_slug") == "unknown", F.array(F.lit("*"))).otherwise(F.array(named(F.col("issuer_slug")), F.lit("=unknown")))))
    both = d.join(v, (d["class_id"] == v["class_id"]) & (d["look"] == v["look"])).drop(v["class_id"], v["look"]).drop("look")
    image = F.size("labels") < 3
    fj = F.when(F.size("v_names") > 0, jaccard(F.col("field_names"), F.col("v_names"), 1.0)).otherwise(
        F.when(F.size("field_names") == 0, 1.0).otherwise(0.0))
    lj = F.when((F.size("labels") > 0) & (F.size("v_labels") > 0), jaccard(F.col("labels"), F.col("v_labels"), 0.0)).otherwise(0.0)
    scored = both.withColumn("field_j", fj).withColumn("label_j", lj).withColumn("image_like", image)
    far = F.coalesce((F.coalesce("pages_total", F.lit(0)) > 0)
                     & (F.abs(F.col("pages_total") - F.col("page_count_mode")) > 3), F.lit(False))
    return scored.filter((F.col("field_j") >= WEAK_FIELDS) | (F.col("label_j") >= WEAK_LABELS) | (F.col("image_like") & ~far))


def discover_variants(docs: DataFrame, variants: DataFrame) -> DataFrame:
    """Best known layout of each distinct document signature and what to do with it.

    decision: accept (strong or corroborated, page count within 1, not image-like),
    needs_confirm (a candidate, but weaker), new (none).  The candidate with the larger of
    both similarities wins, then the smallest layout id.
    """
    sig = ["class_id", "issuer_slug", "field_names", "labels", "pages_total"]
    shaped = docs.select(
        "document_id", "class_id", F.coalesce("issuer_slug", F.lit("unknown")).alias("issuer_slug"),
        F.coalesce("field_names", F.array().cast("array<string>")).alias("field_names"),
        F.coalesce("labels", F.array().cast("array<string>")).alias("labels"),
        F.coalesce("pages_total", F.lit(0)).alias("pages_total"))
    keyed = stored(shaped.withColumn("sig", F.sha2(F.to_json(F.struct(*sig)), 256)), "signatures")
    distinct = keyed.groupBy("sig").agg(*[F.first(c).alias(c) for c in sig])
    cands = variant_candidates(distinct, variants)
    rank = F.struct(-F.greatest("field_j", "label_j"), F.col("variant_id"))
    best = cands.groupBy("sig").agg(
        F.min_by("variant_id", rank).alias("variant_id"),
        F.min_by(F.struct("field_j", "label_j", "page_count_mode", "image_like"), rank).alias("b"))
    f, lb = F.col("b.field_j"), F.col("b.label_j")
    trusted = (f >= STRONG_FIELDS) | (lb >= STRONG_LABELS) | ((f >= WEAK_FIELDS) & (lb >= WEAK_LABELS))
    pages_ok = F.col("b.page_count_mode").isNull() | (F.col("pages_total") == 0) | (
        F.abs(F.col("pages_total") - F.col("b.page_count_mode")) <= 1)
    return keyed.select("document_id", "class_id", "issuer_slug", "field_names", "pages_total", "sig").join(
        stored(best, "signature-layouts"), "sig", "left").select(
        "document_id", "class_id", "issuer_slug", "field_names", "variant_id",
        f.alias("field_j"), lb.alias("label_j"),
        F.when(F.col("variant_id").isNull(), "new").when(trusted & pages_ok & ~F.col("b.image_like"), "accept")
        .otherwise("needs_confirm").alias("decision"))


def new_variants(decided: DataFrame, class_names: DataFrame, existing: DataFrame) -> DataFrame:
    """One new layout per (class, issuer, fingerprint) of the documents that matched none.

    `class_names`: class_id, name; `existing`: class_id, variants (count per class).  The
    letter continues the class's numbering in (issuer, fingerprint) order.
    """
    groups = decided.filter(F.col("decision") == "new").groupBy(
        "class_id", "issuer_slug", F.array_join("field_names", ",").alias("fingerprint")).agg(
        F.count(F.lit(1)).alias("doc_count"), F.min("document_id").alias("first_document_id"),
        F.first("field_names").alias("field_names"))
    j = running_number(groups, "class_id", ["issuer_slug", "fingerprint"], "n").join(existing, "class_id", "left").join(
        class_names.select("class_id", F.col("name").alias("class_name")), "class_id", "left")
    letter = N.variant_letter(F.col("n") + F.coalesce("variants", F.lit(0)))
    return j.select(
        "class_id", "issuer_slug", "fingerprint", "doc_count", "first_document_id",
        N.variant_key(F.col("issuer_slug"), F.col("field_names")).alias("variant_key"),
        N.variant_label(F.col("issuer_slug"), F.coalesce("class_name", F.lit("")), letter).alias("variant_label"),
        N.learning_stage(F.col("doc_count")).alias("learning_stage"))


def label_fingerprint(labels: DataFrame) -> DataFrame:
    """(variant_id, labels array) per document -> one row per (variant, label) with its document count."""
    return labels.select("variant_id", F.explode("labels").alias("label")).groupBy("variant_id", "label").agg(
        F.count(F.lit(1)).alias("documents"))


def structural_profile(docs: DataFrame) -> DataFrame:
    """Page-count statistics per layout: instances, mode, min, max.

    The mode with equal counts is the one seen first (created_at, document_id).  `docs`:
    variant_id, document_id, created_at, pages_total.
    """
    counts = docs.groupBy("variant_id", "pages_total").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("created_at", "document_id")).alias("seen"))
    return counts.groupBy("variant_id").agg(
        F.sum("n").alias("instances"),
        F.min_by("pages_total", F.struct(-F.col("n"), F.col("seen"))).alias("page_count_mode"),
        F.min("pages_total").alias("page_count_min"), F.max("pages_total").alias("page_count_max"))


def filename_patterns(docs: DataFrame, n: int = 10) -> DataFrame:
    """The first n distinct file-name patterns of each layout, in order of first use."""
    seen = docs.select("variant_id", N.abstract_filename(F.col("file_name")).alias("pattern"),
                       F.struct("created_at", "document_id").alias("o")).filter(F.col("pattern").isNotNull())
    firsts = seen.groupBy("variant_id", "pattern").agg(F.min("o").alias("o"), F.count(F.lit(1)).alias("documents"))
    w = Window.partitionBy("variant_id").orderBy("o")
    return firsts.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).drop("o")


def known_lines(lines: DataFrame, instances: DataFrame, kind: str = "heading") -> DataFrame:
    """Lines (headings, headers, footers) found in at least half of a layout's documents.

    `lines`: variant_id, document_id, kind, text; trusted after 3 documents.
    """
    counts = lines.filter(F.col("kind") == kind).groupBy("variant_id", "text").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(instances.select("variant_id", "instances"), "variant_id").filter(
        (F.col("instances") >= 3) & (F.col("n") >= F.greatest(F.lit(1), F.floor(F.col("instances") / 2))))


def expected_page_count(profile: DataFrame) -> DataFrame:
    """Page count to expect, known after 3 documents."""
    return profile.filter(F.col("instances") >= 3).select(
        "variant_id", F.col("page_count_mode").alias("expected_pages"))


#: Instances after which a rounded running mean of coordinates cannot move.
SETTLED = 20_000


def signature_location(found: DataFrame) -> DataFrame:
    """Where the signature of a layout usually is.

    `found`: variant_id, document_id, created_at, page, page_count, bbox (4 fractions),
    label.  Per document in arrival order: anchor is the nearer end (ties: end); with the
    same anchor the offset is the rounded running mean over all instances, with another
    one it starts anew; each box coordinate is a running mean rounded to 4 decimals; the
    newest label stays; confident after 3.

    Running means rounded at each step stop moving: a box coordinate (0..1, 4 decimals)
    once 1/(n+1) is under half a ten-thousandth, from 20,000 instances on, and a page
    offset once there were twice as many instances as pages.  So the fold needs the first
    20,000 documents of a layout (or twice its largest page count, if that is more); beyond
    them only the start of the last run of one anchor and, where none of them had a box,
    the first box count.  The result is that of the whole fold; no layout is collected whole.
    """
    at = F.struct("created_at", "document_id")
    spot = N.signature_anchor(F.col("page"), F.col("page_count"))
    rows = running_number(found, "variant_id", ["created_at", "document_id"], "i").select(
        "variant_id", "i", at.alias("o"), spot["anchor"].alias("anchor"),
        spot["offset"].alias("offset"), "bbox", "label")
    bounds = found.groupBy("variant_id").agg(F.greatest(F.lit(SETTLED), 2 * F.max("page_count")).alias("settled"))
    head = rows.join(bounds, "variant_id").filter(F.col("i") <= F.col("settled")).groupBy("variant_id").agg(
        F.array_sort(F.collect_list(F.struct("o", "anchor", "offset", "bbox"))).alias("seen"),
        F.max("o").alias("head_end"))
    start = F.from_json(F.lit('{"n":0}'), "n bigint, anchor string, offset bigint, bbox array<double>")

    def half_even(x: Column) -> Column:
        return F.bround(x, 0).cast("bigint")

    def step(a: Column, x: Column) -> Column:
        mean = half_even((a["offset"] * a["n"] + x["offset"]) / (a["n"] + 1))
        offset = F.when(a["anchor"].eqNullSafe(x["anchor"]), mean).otherwise(x["offset"].cast("bigint"))
        box = F.when(x["bbox"].isNull() | (F.size(x["bbox"]) != 4), a["bbox"]).when(
            a["bbox"].isNull(), F.transform(x["bbox"], lambda v: F.bround(v, 4))).otherwise(
            F.zip_with(a["bbox"], x["bbox"], lambda p, q: F.bround((p * a["n"] + q) / (a["n"] + 1), 4)))
        return F.struct((a["n"] + 1).alias("n"), x["anchor"].alias("anchor"), offset.alias("offset"), box.alias("bbox"))

    folded = head.select("variant_id", "head_end", F.aggregate("seen", start, step).alias("s"))
    last = rows.groupBy("variant_id").agg(
        F.count(F.lit(1)).alias("instances"), F.max_by("anchor", "o").alias("last_anchor"),
        F.max_by("label", F.when(F.coalesce("label", F.lit("")) != "", F.col("o"))).alias("label_nearby"),
        F.min_by("bbox", F.when(F.size("bbox") == 4, F.col("o"))).alias("first_box"))
    late = rows.join(folded.select("variant_id", "head_end", F.col("s.anchor").alias("head_anchor")), "variant_id").filter(
        F.col("o") > F.col("head_end"))
    turns = late.join(last.select("variant_id", "last_anchor"), "variant_id")
    other = turns.groupBy("variant_id").agg(
        F.max(F.when(F.col("anchor") != F.col("last_anchor"), F.col("o"))).alias("other_end"),
        F.first("head_anchor").alias("head_anchor"), F.first("last_anchor").alias("last_anchor"))
    restart = turns.join(other.select("variant_id", "other_end"), "variant_id").filter(
        F.col("other_end").isNull() | (F.col("o") > F.col("other_end"))).groupBy("variant_id").agg(
        F.min_by("offset", "o").alias("restart_offset"))
    tail = other.join(restart, "variant_id").filter(
        F.col("other_end").isNotNull() | (F.col("head_anchor") != F.col("last_anchor"))).select("variant_id", "restart_offset")
    return last.join(folded, "variant_id").join(tail, "variant_id", "left").select(
        "variant_id", "instances", F.col("last_anchor").alias("page_anchor"),
        F.coalesce(F.col("restart_offset").cast("bigint"), F.col("s.offset")).alias("page_offset"),
        F.coalesce("s.bbox", F.transform("first_box", lambda v: F.bround(v, 4))).alias("bbox_hint"), "label_nearby", (F.col("instances") >= 3).alias("confident"))
