"""Running numbers and neighbours cut by sampled ranges, against plain windows; one group and one day hold a third of all rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafstack.operators.common import neighbour, range_split, running_number


def crowded(spark, n=30_000):
    i = F.col("id")
    return spark.range(n).select(
        F.when(i % 3 == 0, "hot").when(i % 1000 == 1, F.lit(None)).otherwise(F.concat(F.lit("g"), i % 70)).alias("g"),
        F.when(i % 2 == 0, F.lit("2024-01-01 00:00:00")).otherwise("2024-01-02 00:00:00").cast("timestamp").alias("at"),
        F.format_string("d%d", F.pmod(F.xxhash64(i), F.lit(1_000_000)) * 100_000 + i).alias("d"))


def test_numbers_and_neighbours(spark):
    df = crowded(spark).cache()
    w = Window.partitionBy("g").orderBy("at", "d")
    want = {(r.d, r.n, r.p, r.f) for r in df.select("d", F.row_number().over(w).alias("n"), F.lag("d").over(w).alias("p"), F.lead("d").over(w).alias("f")).collect()}
    got = running_number(df, "g", ["at", "d"], "n", 9).join(neighbour(df, "g", ["at", "d"], ["d"], "p_", chunks=9).select("d", "p_d"), "d").join(
        neighbour(df, "g", ["at", "d"], ["d"], "f_", forward=True, chunks=9).select("d", "f_d"), "d")
    assert {(r.d, r.n, r.p_d, r.f_d) for r in got.collect()} == want
    assert running_number(df.limit(0), "g", ["at", "d"], "n").collect() == []


def test_a_hot_group_of_one_day_is_split(spark):
    cut = range_split(crowded(spark), ["g", "at", "d"], 12)
    rows = cut.groupBy("_chunk").count().collect()
    assert len(rows) == 12 and max(r["count"] for r in rows) < 2 * 30_000 / 12
    assert cut.where("g = 'hot'").select("_chunk").distinct().count() >= 4
