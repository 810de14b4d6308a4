"""Proportional stratified interleaving: every shard holds the mixture of sources. JVM-side only.

Rows of each source are put in a seeded random order; the row at place r of n gets the fraction
(r - 1/2) / n; all rows are sorted by fraction, and the order is cut into shards whose counts differ by
one at most. Within each stretch of that order, each source appears in its share.

Both sorts are done in buckets: the seeded hash is uniform, and so are the fractions, so that equal
ranges of either hold about equal numbers of rows, also where one source holds a third of all. Places
are a bucket's offset plus the place inside it; only bucket counts are summed up. Texts are read once
for their size and checksum and never shuffled.

Defined cases: a null text has size 1 and the checksum of no bytes; rows with a null source are one
source; a null doc_id is hashed as such; repeated rows differ by nothing and take neighbouring places;
columns other than doc_id, text and source are not read. Equal texts are not kept together: this law
spreads rows by source, and groups of thousands of copies would break the equal counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafstack.llm.common import stored

#: Rows that one task sorts, about.
ROWS_PER_BUCKET = 100_000
UNIFORM_BITS = 32


def _uniform(seed: int, *cols: Column) -> Column:
    """A seeded hash from 0 to 2^32 - 1."""
    return F.xxhash64(F.lit(seed), *cols).bitwiseAND(F.lit(2**UNIFORM_BITS - 1))


def _places(rows: DataFrame, group: list[str], bucket: Column, order: list[Column], into: str) -> DataFrame:
    """`rows` with the place from 1 of each row in its group under `order`, and the group's size as n.

    `bucket` must not fall as the order rises.
    """
    rows = rows.withColumn("bucket", bucket)
    counts = rows.groupBy(*group, "bucket").agg(F.count("*").alias("in_bucket"))
    before = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("before"),
                            F.sum("in_bucket").over(Window.partitionBy(*group)).alias("n"))
    inside = Window.partitionBy(*group, "bucket").orderBy(*order)
    ranked = rows.withColumn("inside", F.row_number().over(inside))
    same = [ranked[c].eqNullSafe(offsets[c]) for c in [*group, "bucket"]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    kept = [ranked[c] for c in rows.columns if c not in ("bucket", "n", into)]
    return ranked.join(offsets, on).select(*kept, offsets["n"], (F.col("before") + F.col("inside")).alias(into))


def interleave(docs: DataFrame, shards: int = 16, seed: int = 17, stratum: str = "source",
               rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, source, shard from 0 and slot from 0 in the shard."""
    blob = F.coalesce("text", F.lit("")).cast("binary")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("stratum"),
                         (F.octet_length(blob) + 1).cast("long").alias("size"), F.crc32(blob).alias("text_crc32"))
    narrow = narrow.withColumn("shuffled", _uniform(seed, F.col("doc_id")))
    narrow, _ = stored(narrow, "shard-rows")
    total = narrow.count()
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // rows_per_bucket))
    tie = [F.col("shuffled"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    spread = F.shiftright(F.col("shuffled") * buckets, UNIFORM_BITS)
    ranked = _places(narrow, ["stratum"], spread, tie, "place")
    ranked, _ = stored(ranked.withColumn("fraction", (F.col("place") - 0.5) / F.col("n")), "shard-ranks")
    placed = _places(ranked.withColumn("everything", F.lit(0)), ["everything"], F.floor(F.col("fraction") * buckets),
                     [F.col("fraction"), _uniform(seed + 1, F.col("stratum")), F.col("stratum"), *tie], "spot")
    shard = F.expr(f"int((spot - 1) * {shards} div {max(total, 1)})")
    # the first spot of shard k is ceil(k * total / shards)
    start = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return (placed.withColumn("shard", shard)
            .select("doc_id", "size", "text_crc32", F.col("stratum").alias(stratum), "shard", (F.col("spot") - 1 - start).alias("slot")))


def shard_report(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The placement under the law `rows`; grown_shard is null, as more shards deal all rows anew."""
    done = interleave(docs, shards)
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"), "source")
