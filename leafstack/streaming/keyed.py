"""State that streams keep in stored tables: keyed rows in hash buckets, merged as batches come.

Every batch adds one run of partial rows. The state of a key is the merge (sums, minima, maxima) of its
rows over all runs. `fan` runs of a level become one run of the next, so after n batches there are at most
fan * log(n) runs, and a batch reads of them only the buckets its keys fall into. Nothing is held in memory
between batches, and no state ever ends.

A repeated batch overwrites its own run and does not see it; runs that were merged are deleted by a later
batch, when the one that merged them is known to be done.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Merge = Mapping[str, Callable[[str], Column]]


@dataclass(frozen=True)
class KeyedRuns:
    """Rows of `keys` and the columns of `merge` under `folder`, in buckets by a hash of `by` (some of the keys, or all)."""

    folder: str
    keys: Sequence[str]
    merge: Merge
    by: Sequence[str] = ()
    buckets: int = 16
    fan: int = 8

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(self.by or self.keys)), F.lit(self.buckets)).cast("int")

    def merged(self, rows: DataFrame) -> DataFrame:
        """One row per key."""
        return rows.groupBy(*self.keys).agg(*(how(c).alias(c) for c, how in self.merge.items()))

    def runs(self, spark: SparkSession, before: int) -> list[tuple[int, int]]:
        """The finished runs (first batch, last batch) of batches under `before`; some may be parts of others."""
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        child = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().getName() for s in fs.listStatus(path) if fs.exists(child(s.getPath(), "_SUCCESS"))
                 and any(b.isDirectory() for b in fs.listStatus(s.getPath()))]        # a batch without rows leaves no bucket
        found = [(int(a), int(z)) for a, z in (n.removeprefix("run-").split("-") for n in names)]
        return sorted(r for r in found if r[1] < before)

    def _path(self, run: tuple[int, int]) -> str:
        return f"{self.folder}/run-{run[0]}-{run[1]}"

    def _read(self, spark: SparkSession, runs: Sequence[tuple[int, int]]) -> DataFrame | None:
        whole = [r for r in runs if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in runs)]
        tables = [spark.read.parquet(self._path(r)) for r in whole]
        out = tables[0] if tables else None
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    def before(self, batch_id: int, asked: DataFrame) -> DataFrame | None:
        """The state that batches before `batch_id` left of the keys (`by`) in `asked`; None before the first batch.

        Only the buckets of these keys are read.
        """
        spark = asked.sparkSession
        past = self._read(spark, self.runs(spark, batch_id))
        if past is None:
            return None
        by = list(self.by or self.keys)
        wanted = asked.select(*by).distinct()
        hit = [r[0] for r in wanted.select(self._bucket()).distinct().collect()]        # at most `buckets` numbers
        near = past.filter(F.col("bucket").isin(hit)).drop("bucket")
        same = [F.col(f"past.{c}").eqNullSafe(F.col(f"wanted.{c}")) for c in by]
        return self.merged(near.alias("past").join(wanted.alias("wanted"), same, "left_semi"))

    def add(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """Write the rows of one batch, one per key, and return them; then merge runs where a level is full, and delete those merged before."""
        spark = rows.sparkSession
        self._drop(spark, batch_id)
        own = self.merged(rows)
        self._write(own, (batch_id, batch_id))
        width = self.fan
        while (batch_id + 1) % width == 0:
            run = (batch_id + 1 - width, batch_id)
            parts = [r for r in self.runs(spark, batch_id + 1) if run[0] <= r[0] and r != run]
            if parts:
                self._write(self.merged(self._read(spark, parts).drop("bucket")), run)
            width *= self.fan
        if (batch_id, batch_id) not in self.runs(spark, batch_id + 1):
            return own.limit(0)
        return spark.read.schema(own.schema).parquet(self._path((batch_id, batch_id))).drop("bucket")

    def now(self, own: DataFrame, batch_id: int) -> DataFrame:
        """The state of the keys in `own`, the rows that `add` returned, after this batch."""
        past = self.before(batch_id, own)
        return own if past is None else self.merged(own.unionByName(past))

    def _write(self, rows: DataFrame, run: tuple[int, int]) -> None:
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(self._path(run))

    def _drop(self, spark: SparkSession, batch_id: int) -> None:
        runs = self.runs(spark, batch_id)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for r in runs:
            if any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in runs):
                fs.delete(path(self._path(r)), True)
