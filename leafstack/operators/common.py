"""Order-dependent steps that stay parallel inside a large group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafstack.session import stored


def newest_n(df: DataFrame, group: str | Sequence[str], n: int, order: Sequence[Column] | None = None,
             rank_col: str = "rank") -> DataFrame:
    """The n newest rows of each group by (created_at, document_id).

    `rank <= n` right above the window lets Spark keep n rows per group in each map task
    before the shuffle, so a group holding most rows does not travel.
    """
    keys = [group] if isinstance(group, str) else list(group)
    by = list(order) if order else [F.col("created_at").desc(), F.col("document_id").desc()]
    ranked = df.withColumn(rank_col, F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))
    return ranked.filter(F.col(rank_col) <= n)


def range_split(df: DataFrame, order: Sequence[str], chunks: int | None = None) -> DataFrame:
    """`df` cut into ranges of `order`, stored, with the number of the range as `_chunk`.

    Spark samples the rows for the bounds, so ranges hold about equally many rows however many share a
    group or a day; only rows equal in all of `order` stay together. Stored, since a range's number must
    not change when a lost task runs again.
    """
    n = chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(n, *order).withColumn("_chunk", F.spark_partition_id()), "ranges")


def carried(edges: DataFrame, group: str, value: Column) -> DataFrame:
    """(_g, _c, _carry): what a range takes over from the other ranges of its group; only where that is not null.

    `edges`: one row per (group, _chunk). Ranges are sorted by group first, so only the group that a range
    starts (or ends) with reaches into another: at most one row per range comes out, few enough to send
    to every task.
    """
    found = edges.select(F.col(group).alias("_g"), F.col("_chunk").alias("_c"), value.alias("_carry"))
    return F.broadcast(found.filter(F.col("_carry").isNotNull()))


def _with_carry(rows: DataFrame, carry: DataFrame, group: str) -> DataFrame:
    return rows.join(carry, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_chunk") == F.col("_c")), "left")


def running_number(df: DataFrame, group: str, order: Sequence[str], out: str, chunks: int | None = None) -> DataFrame:
    """row_number per group by `order` (columns that tell rows apart), with large groups split among tasks.

    Rows are numbered inside their range; the count of the group's earlier ranges is added.
    """
    part = range_split(df, [group, *order], chunks)
    counts = part.groupBy(group, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    local = part.withColumn("_i", F.row_number().over(Window.partitionBy("_chunk", group).orderBy(*order)))
    return _with_carry(local, carried(counts, group, before), group).withColumn(
        out, F.col("_i") + F.coalesce("_carry", F.lit(0))).drop("_chunk", "_i", "_carry", "_g", "_c")


def neighbour(df: DataFrame, group: str, order: Sequence[str], cols: Sequence[str], prefix: str,
              forward: bool = False, chunks: int | None = None) -> DataFrame:
    """Columns of the previous (or next) row of the group by `order`, with large groups split among tasks.

    Inside a range this is lag/lead; its first (last) row takes the last (first) row of the group's
    range before (after) it.
    """
    part = range_split(df, [group, *order], chunks).withColumn("_row", F.struct(*cols))
    step = F.lead if forward else F.lag
    edge = (F.min_by if forward else F.max_by)("_row", F.struct(*order))
    edges = part.groupBy(group, "_chunk").agg(edge.alias("_edge"))
    far = carried(edges, group, step("_edge").over(Window.partitionBy(group).orderBy("_chunk")))
    near = part.withColumn("_near", step("_row").over(Window.partitionBy("_chunk", group).orderBy(*order)))
    found = F.coalesce("_near", "_carry")
    return _with_carry(near, far, group).select(
        *[F.col(c) for c in df.columns],
        *[found[c].alias(f"{prefix}{c}") for c in cols],
    )


def unfold(df: DataFrame, keep: Sequence[str], array: Column, alias: str = "item") -> DataFrame:
    """One row per element of a costly array.

    A plain explode makes the optimiser test the array for emptiness below the generator,
    which works the array out a second time; the outer form is tested above it.
    """
    return df.select(*keep, F.explode_outer(array).alias(alias)).filter(F.col(alias).isNotNull())


def exact_avg(value: Column, scale: int = 6) -> Column:
    """Average that does not depend on the order rows are added in (decimal sum)."""
    return F.avg(value.cast(f"decimal(18,{scale})"))


def rounded(value: Column, digits: int) -> Column:
    return F.round(value, digits).cast("double")
