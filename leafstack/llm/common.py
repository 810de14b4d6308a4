"""What several operators of this subpackage need: stored tables, ASCII words, reading inputs."""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafstack.session import scratch_folder

#: ASCII white space as the word and line rules of these operators mean it.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a missing doc_id where ids are compared: after all others.
LAST_ID = 2**63 - 1
#: Rows of two longs that may be sent to every task.
BROADCAST_ROWS = 200_000
#: Rows of the table that sizes a run (documents) for each file of its stored tables.
FILE_ROWS = 20_000


_KEPT: dict[Any, Any] = {}


def worker_returns() -> None:
    """Give memory that a Python worker has freed back to the system; the allocators would hold it for the worker's life."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):      # not the C library of GNU
        ctypes.CDLL(None).malloc_trim(0)


def worker_drops() -> None:
    """Forget what the worker keeps for another step."""
    if _KEPT:
        _KEPT.clear()
        worker_returns()


def returning(run: Callable[[Iterator], Iterator], keeps: bool = True) -> Callable[[Iterator], Iterator]:
    """`run` for mapInArrow, after which its worker gives back what it has freed; without `keeps`, what earlier steps kept goes first.

    An executor's workers take turns, so what an idle one holds adds to the memory of the others.
    """
    def lean(batches: Iterator) -> Iterator:
        if not keeps:
            worker_drops()
        try:
            yield from run(batches)
        finally:
            worker_returns()

    return lean


def worker_keeps(key: Any, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from batch to batch (words it has met, a loaded vocabulary).

    One thing at a time: asking for another drops it, so the stages of a pipeline, which run in the same
    workers one after the other, do not add up in memory.
    """
    if key not in _KEPT:
        worker_drops()
        _KEPT[key] = make()
    return _KEPT[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, files: int | None = None) -> tuple[DataFrame, str]:
    """`df` written once to the shared folder and read back, and the folder.

    What several later jobs read is worked out once, and a lost executor costs no more than reading again.
    At most `files` tasks write it; each may take several partitions.
    """
    path = scratch_folder(df.sparkSession, name)
    df = df.coalesce(files) if files else df
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def files_for(spark: SparkSession, rows: int) -> int:
    """Files for stored tables that grow with `rows`: three for each core, or one for FILE_ROWS rows if these are more.

    Making a file costs more than a few thousand rows in it, so a small table is not written by every shuffle partition.
    """
    return max(3 * spark.sparkContext.defaultParallelism, math.ceil(rows / FILE_ROWS))


def forget(spark: SparkSession, path: str) -> None:
    """Delete a stored table that no later step reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Tables:
    """Stored tables of one run of an operator, of at most `files` files if that is set, deleted together at its end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.files = spark, [], None

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df, path = stored(df, name, self.files)
        self.paths.append(path)
        return df

    def taken(self, kept: tuple[DataFrame, str]) -> DataFrame:
        """A table that another step has stored, to be deleted with the others."""
        df, path = kept
        self.paths.append(path)
        return df

    def drop(self) -> None:
        while self.paths:
            forget(self.spark, self.paths.pop())


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII only take the fast way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def ordered_id(doc_id: Column) -> Column:
    """doc_id for comparisons; a missing one counts as the largest."""
    return F.coalesce(doc_id.cast("long"), F.lit(LAST_ID))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """`docs` without the rows of `gone` (doc_id, text_hash = xxhash64 of the text).

    Up to BROADCAST_ROWS of them are sent to the tasks that read the texts; more are joined by a shuffle.
    """
    gone, _ = stored(gone.select(ordered_id(F.col("doc_id")).alias("gone_doc"), F.col("text_hash").alias("gone_text")).distinct(), "rows-gone")
    few = gone.count() <= BROADCAST_ROWS
    here = (ordered_id(docs["doc_id"]) == F.col("gone_doc")) & (F.xxhash64(docs["text"]) == F.col("gone_text"))
    return docs.join(F.broadcast(gone) if few else gone, here, "left_anti")
