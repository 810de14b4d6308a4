"""The corpus pipeline over `documents`: quality rules, line dedup, near-dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last
return the columns of `documents`; the last returns the token ids of each document that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafstack.llm import bpe, decontaminate, line_dedup, near_dedup, quality_rules
from leafstack.llm.common import forget, ordered_id, stored, table, without
from leafstack.llm.queries import TOKENIZER


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or break a certified cutoff go."""
    report = quality_rules.quality_report(docs, table(spark, sf_dir, "labels"))
    return without(docs, report.where("not kept"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; n_chars follows the text. A document may be left empty."""
    done = line_dedup.dedup_lines(docs).withColumn("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*(F.col(f"`{c}`") for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays; rows that repeat it in full go as well."""
    found, _ = stored(near_dedup.near_duplicates(docs), "near-copies")
    kept = without(docs, found.where("not kept"))
    once = found.where("kept").groupBy(ordered_id(F.col("doc_id")), "text_hash").count().where("count > 1")
    return kept if once.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids."""
    return bpe.encode_decode(docs, TOKENIZER).drop("decoded")


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_copies), ("decontamination", decontaminated), ("bpe", tokens)]

#: Certified cutoffs, chosen paths and BPE are not expressible in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again by the next."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last:
            forget(spark, last)
        last = path
    return docs
