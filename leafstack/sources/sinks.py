"""Replacing, appending and removing rows of stored tables."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_fields(stored: DataFrame, new: DataFrame, delete_first: bool = True) -> DataFrame:
    """Stored fields with the new batch: replaced per document, or appended."""
    kept = stored.join(new.select("document_id").distinct(), "document_id", "left_anti") if delete_first else stored
    return kept.unionByName(new, allowMissingColumns=True)


def append_events(*streams: DataFrame) -> DataFrame:
    """Event rows of several sources, by column name."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def scoped_purge(tables: dict[str, DataFrame], class_id: str | None = None,
                 variant_id: str | None = None) -> dict[str, DataFrame]:
    """Every table without the documents of a class or a layout (and that layout itself).

    `tables` may hold documents, fields, events, variants, links.  The learned counters of
    a purged layout go with its row.
    """
    docs = tables["documents"]
    cond = F.col("class_id") == class_id if class_id is not None else F.col("variant_id") == variant_id
    gone = docs.filter(F.coalesce(cond, F.lit(False))).select("document_id")
    out = {}
    for name, table in tables.items():
        if name == "variants":
            out[name] = table.filter(~F.coalesce(cond, F.lit(False)))
        else:
            out[name] = table.join(gone, "document_id", "left_anti")
    return out


def purge_counts(tables: dict[str, DataFrame], **scope: str) -> DataFrame:
    """Rows before and after a purge, per table."""
    after = scoped_purge(tables, **scope)
    parts = [
        t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), F.lit(tag).alias("tag"), "n")
        for tag, group in (("before", tables), ("after", after)) for name, t in group.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("table_name").agg(
        F.sum(F.when(F.col("tag") == "before", F.col("n"))).alias("rows_before"),
        F.sum(F.when(F.col("tag") == "after", F.col("n"))).alias("rows_after"))


def run_and_log(spark: SparkSession, report: str, build: Callable[[], DataFrame], path: str,
                log_path: str) -> str:
    """Run a report into `path` and append one row to the run log; returns the status.

    The log row has report, status, summary, error, started_at, duration_ms.
    """
    started = datetime.now(timezone.utc).replace(tzinfo=None)
    clock, status, error, summary = time.monotonic(), "success", None, ""
    try:
        build().write.mode("overwrite").parquet(path)
        summary = f"{report}: {spark.read.parquet(path).count()} row(s)"
    except Exception as exc:       # the run log must record any failure
        status, error, summary = "error", f"{type(exc).__name__}: {exc}"[:500], f"{report}: failed"
    row = [(report, status, summary, error, started, int((time.monotonic() - clock) * 1000))]
    spark.createDataFrame(
        row, "report string, status string, summary string, error string, started_at timestamp_ntz, duration_ms bigint"
    ).write.mode("append").parquet(log_path)
    return status
