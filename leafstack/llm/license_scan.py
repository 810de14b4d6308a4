"""License scan by diagonal voting. JVM-side only.

All rolling word pairs of a document are joined to the places of the same pairs in the templates. A hit
at document word p and template word q votes for the diagonal p - q. A diagonal with a vote from each of
a template's pairs is a place where its words stand consecutively. For other templates votes are summed
to runs per diagonal first, runs on neighbouring diagonals (words put in or left out) within a template's
reach merge into spans, and a span is verified by the share of the template's pairs found in it. Pairs are compared as words, not only as hashes. Only hits and one row per
document leave the scan; the templates are a parameter, sent to all tasks up to BROADCAST_PAIRS pairs.

Defined cases: a null or empty text has no words and no labels; rows that repeat a doc_id, or have none,
keep one result each; overlapping places all count; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafstack.llm.common import ascii_lower, stored

BROADCAST_PAIRS = 100_000
#: Diagonals this close merge, hits this far apart (in words) still belong to one span, and the share of
#: a template's pairs that a span needs.
BAND, GAP, COVERAGE = 3, 12, 0.85
#: Everything but 0-9, a-z and what is not ASCII separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Template(NamedTuple):
    label: str
    words: str
    #: whether each exact place counts by itself
    base: bool = False


#: The phrases of the base labels, then common public license notices (fixed values).
TEMPLATES = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("cc-by-nc", "licensed under cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa"),
    Template("cc-by-nd", "licensed under cc by nd"),
    Template("cc0", "dedicated to the public domain under cc0"),
    Template("gpl-2.0", "gnu general public license version 2"),
    Template("gpl-3.0", "gnu general public license version 3"),
    Template("lgpl", "gnu lesser general public license"),
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def template_pairs(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    """(template, label, base, q, n_pairs, pair, pair_hash): each template's word pairs and their places."""
    rows = []
    for t, (label, words, base) in enumerate(templates):
        w = words.split()
        rows += [(t, label, base, q, len(w) - 1, f"{a} {b}") for q, (a, b) in enumerate(zip(w, w[1:], strict=False))]
    df = spark.createDataFrame(rows, "template int, label string, base boolean, q int, n_pairs int, pair string")
    df = df.withColumn("pair_hash", F.xxhash64("pair"))
    return F.broadcast(df) if len(rows) <= BROADCAST_PAIRS else df


def hits(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """A row per hit, and one row with p = 0 or null per document, hit or not; `row` numbers the documents."""
    worded = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                         words_of(F.col("text")).alias("words"))
    paired = worded.select("row", "doc_id", F.size("words").cast("long").alias("n_words"),
                           F.expr("zip_with(words, slice(words, 2, greatest(size(words) - 1, 0)), (a, b) -> concat_ws(' ', a, b))").alias("pairs"))
    each = paired.select("row", "doc_id", "n_words", F.posexplode_outer("pairs").alias("p", "found"))
    each = each.withColumn("pair_hash", F.xxhash64("found"))
    pairs = template_pairs(docs.sparkSession, templates)
    met = each.join(pairs, (each["pair_hash"] == pairs["pair_hash"]) & (each["found"] == pairs["pair"]), "left")
    return (met.where("template is not null or p is null or p = 0")
            .select("row", "doc_id", "n_words", "p", "template", "label", "base", "q", "n_pairs"))


def spans(found: DataFrame, band: int = BAND, gap: int = GAP, coverage: float = COVERAGE) -> DataFrame:
    """(row, label, base, first, last, share): exact places of base templates, verified spans of the others.

    Votes are summed per diagonal first: hits of one diagonal no further apart than `gap` are one run. A run
    starts a new span if none of the template's earlier runs ends within `gap` words before it on a
    diagonal within `band`, whatever runs of other diagonals (a pair that stands twice in the template, a
    stray hit) lie between; a span is verified by the template's pairs that its runs hold.
    """
    voted = found.where("template is not null").withColumn("diagonal", F.col("p") - F.col("q"))
    whole = (voted.where("base").groupBy("row", "label", "template", "n_pairs", "diagonal").agg(F.count("*").alias("votes"))
             .where("votes = n_pairs").select("row", "label", F.lit(True).alias("base"), F.col("diagonal").cast("long").alias("first"),
                                              (F.col("diagonal") + F.col("n_pairs")).cast("long").alias("last"), F.lit(1.0).alias("share")))
    keys = ["row", "label", "template", "n_pairs"]
    along = Window.partitionBy("row", "template", "diagonal").orderBy("p")
    far = F.coalesce(F.col("p") - F.lag("p").over(along) > gap, F.lit(True)).cast("int")
    runs = (voted.where("not base").withColumn("starts", far)
            .withColumn("run", F.sum("starts").over(along.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy(*keys, "diagonal", "run").agg(F.min("p").alias("p0"), F.max("p").alias("p1"), F.count("*").alias("votes"), F.collect_list("q").alias("qs")))
    # every run looks for the runs around it, in the bands of its diagonal and the next: a place is anchored on its strongest diagonal
    cell = F.floor(F.col("diagonal") / (band + 1))
    near = runs.select("row", "template", F.col("diagonal").alias("d2"), F.col("p0").alias("o0"), F.col("p1").alias("o1"), "qs",
                       F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    own = runs.select(*keys, "diagonal", "run", "p0", "p1", "votes", cell.alias("cell"))
    # what can belong to the place that the run is part of: from where the template would begin to where it would end
    reach = (F.abs(F.col("diagonal") - F.col("d2")) <= band) & (F.col("o0") <= F.col("diagonal") + F.col("n_pairs") + gap) & (F.col("o1") >= F.col("diagonal") - gap)
    met = own.join(near, ["row", "template", "cell"]).where(reach)
    merged = met.groupBy(*keys, "diagonal", "run", "votes").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("qs")))).alias("pairs"), F.min("o0").cast("long").alias("first"), (F.max("o1") + 1).cast("long").alias("last"))
    good = merged.withColumn("share", F.col("pairs") / F.col("n_pairs")).where(F.col("share") >= coverage)
    # one row per place: of runs that verify the same place, the strongest
    best = Window.partitionBy(*keys, "first", "last").orderBy(F.col("share").desc(), F.col("votes").desc(), "diagonal", "run")
    return whole.unionAll(good.withColumn("nth", F.row_number().over(best)).where("nth = 1").select("row", "label", F.lit(False).alias("base"), "first", "last", "share"))


def license_report(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score (best share of a template found)."""
    found, _ = stored(hits(docs, templates), "license-hits")
    base = F.col("base")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    marks = spans(found).groupBy("row").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"), joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"), F.max("share").alias("score"))
    docs_once = found.where("p is null or p = 0").select("row", "doc_id", "n_words").distinct()
    return docs_once.join(marks, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
