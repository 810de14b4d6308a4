"""Splitting a bundle of pages into documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafstack.functions.text import keyword_score
from leafstack.operators.classify import rules_column
from leafstack.operators.common import rounded
from leafstack.rules import ClassRule

MIN_PAGE_CONFIDENCE = 0.25


def page_classes(pages: DataFrame, rules: Sequence[ClassRule]) -> DataFrame:
    """Best class per page: document_id, page_num, class_id, confidence, n_chars.

    Score over keyword count, at most 1; the first class of the rule order wins ties;
    below .25 the page has no class but keeps its confidence.
    """
    text = F.lower(F.coalesce("text", F.lit("")))
    staged = pages.select("document_id", "page_num", text.alias("t"))
    scored = F.transform(rules_column(rules), lambda r: F.struct(
        F.least(keyword_score(F.col("t"), r["keywords"], r["negatives"]) / r["keyword_count"], F.lit(1.0)).alias("conf"),
        (-r["position"]).alias("position"), r["class_id"].alias("class_id")))
    best = F.array_max(F.filter(scored, lambda s: s["conf"] > 0))
    return staged.select(
        "document_id", "page_num", F.length(F.trim("t")).alias("n_chars"), best.alias("b")
    ).select(
        "document_id", "page_num",
        F.when(F.col("b.conf") >= MIN_PAGE_CONFIDENCE, F.col("b.class_id")).alias("class_id"),
        F.coalesce(F.col("b.conf"), F.lit(0.0)).alias("confidence"), "n_chars")


def smooth_once(pages: DataFrame, col: str = "class_id") -> DataFrame:
    """A page between two pages of one other class takes that class, left to right.

    Changing a page makes its right neighbour equal to it, so of a row of candidate pages
    the first, third, fifth ... change.  That is a numbering inside islands: no fold needed.
    """
    w = Window.partitionBy("document_id").orderBy("page_num")
    before, after = F.lag(col).over(w), F.lead(col).over(w)
    inner = F.lag(F.lit(1)).over(w).isNotNull() & F.lead(F.lit(1)).over(w).isNotNull()
    marked = pages.withColumn("_no", F.row_number().over(w)).withColumn("_before", before).withColumn(
        "_cand", inner & before.eqNullSafe(after) & ~before.eqNullSafe(F.col(col)))
    last_plain = F.max(F.when(~F.col("_cand"), F.col("_no"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    place = F.col("_no") - F.coalesce("_plain", F.lit(0))
    return marked.withColumn("_plain", last_plain).withColumn(
        col, F.when(F.col("_cand") & (place % 2 == 1), F.col("_before")).otherwise(F.col(col))
    ).drop("_no", "_before", "_cand", "_plain")


def segment_pages(pages: DataFrame) -> DataFrame:
    """Runs of one class after two smoothing passes, with the average page confidence.

    In: document_id, page_num, class_id, confidence.  Out: document_id, segment_no (from 0),
    start_page, end_page, class_id, pages, avg_confidence.  Adjacent segments of one class
    cannot remain, because runs are maximal.
    """
    smooth = smooth_once(smooth_once(pages.select("document_id", "page_num", "class_id", "confidence")))
    w = Window.partitionBy("document_id").orderBy("page_num")
    first = F.row_number().over(w) == 1
    change = (first | ~F.col("class_id").eqNullSafe(F.lag("class_id").over(w))).cast("int")
    runs = smooth.withColumn("_c", change).withColumn("segment_no", F.sum("_c").over(w) - 1)
    return runs.groupBy("document_id", "segment_no").agg(
        F.min("page_num").alias("start_page"), F.max("page_num").alias("end_page"),
        F.min("class_id").alias("class_id"), F.count(F.lit(1)).alias("pages"),
        rounded(F.avg(F.col("confidence").cast("decimal(18,10)")), 6).alias("avg_confidence"))


def splitting_needs_review(pages: DataFrame) -> DataFrame:
    """Documents whose page classes are too unsure: over 40 % weak pages or over 30 % nearly empty ones."""
    shares = pages.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(F.col("confidence") < MIN_PAGE_CONFIDENCE).alias("weak_pages"),
        F.count_if(F.col("n_chars") < 50).alias("empty_pages"))
    flag = (F.col("weak_pages") * 10 > F.col("pages") * 4) | (F.col("empty_pages") * 10 > F.col("pages") * 3)
    return shares.withColumn("needs_review", flag)


def annotate_segments(segments: DataFrame, pages: DataFrame) -> DataFrame:
    """Class of given page ranges: the largest confidence sum (first seen wins a tie).

    The average divides by all pages of the range; without any classed page it is the
    plain average and the class stays null.
    """
    hit = segments.alias("s").join(
        pages.alias("p"), F.col("s.document_id") == F.col("p.document_id")
    ).filter(F.col("p.page_num").between(F.col("s.start_page"), F.col("s.end_page"))).select(
        "s.document_id", "s.segment_no", "s.start_page", "s.end_page",
        "p.page_num", "p.class_id", F.col("p.confidence").cast("decimal(18,10)").alias("c"))
    per_class = hit.groupBy("document_id", "segment_no", "start_page", "end_page", "class_id").agg(
        F.sum("c").alias("votes"), F.count(F.lit(1)).alias("n"), F.min("page_num").alias("seen"))
    best = F.max(F.when(F.col("class_id").isNotNull(),
                        F.struct("votes", (-F.col("seen")).alias("seen"), "class_id")))
    agg = per_class.groupBy("document_id", "segment_no", "start_page", "end_page").agg(
        best.alias("b"), F.sum("n").alias("pages"), F.sum("votes").alias("all_votes"))
    return agg.select(
        "document_id", "segment_no", "start_page", "end_page", F.col("b.class_id").alias("class_id"), "pages",
        rounded(F.coalesce(F.col("b.votes"), F.col("all_votes")) / F.col("pages"), 6).alias("avg_confidence"))


def split_children(segments: DataFrame, parents: DataFrame, names: DataFrame) -> DataFrame:
    """Child documents of bundles with more than one segment.

    `parents`: document_id, file_name; `names`: class_id, name (a small table).
    """
    counts = segments.groupBy("document_id").agg(F.count(F.lit(1)).alias("segments")).filter(F.col("segments") > 1)
    rows = segments.join(counts, "document_id").join(parents.select("document_id", "file_name"), "document_id").join(
        F.broadcast(names.select("class_id", F.col("name").alias("class_name"))), "class_id", "left")
    name = F.coalesce("class_name", F.lit("unknown"))
    stem = F.regexp_replace(F.coalesce("file_name", F.lit("document.pdf")), r"\.[^.]*$", "")
    no = F.col("segment_no") + 1
    return rows.select(
        F.concat("document_id", F.lit("_part"), no).alias("document_id"),
        F.col("document_id").alias("parent_document_id"), "segment_no", "start_page", "end_page",
        F.concat(stem, F.lit("_part"), no, F.lit("_"), F.translate(F.lower(name), " ", "_"), F.lit(".pdf")).alias("file_name"),
        F.lit("RECEIVED").alias("status"), (F.col("end_page") - F.col("start_page") + 1).alias("pages_total"),
        F.concat(F.col("start_page") + 1, F.lit("–"), F.col("end_page") + 1).alias("segment_pages"),
        F.col("class_name").alias("detected_class"))


def bundle_children(docs: DataFrame) -> DataFrame:
    """Parent and child ids through parent_document_id."""
    parents = docs.select(F.col("document_id").alias("parent_document_id"), F.col("file_name").alias("parent_file_name"))
    return docs.filter(F.col("parent_document_id").isNotNull()).select(
        "parent_document_id", "document_id").join(parents, "parent_document_id")


def split_bundles(pages: DataFrame, rules: Sequence[ClassRule], parents: DataFrame, names: DataFrame) -> DataFrame:
    """Page classes -> segments -> child documents."""
    return split_children(segment_pages(page_classes(pages, rules)), parents, names)


