"""Connected components of an edge table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafstack.llm.common import forget, stored


def components(edges: DataFrame, a: str = "a", b: str = "b", files: int | None = None) -> tuple[DataFrame, str]:
    """(node, label): the smallest node of each node's component; only nodes with an edge. And the table's path.

    Each round takes the smallest label among neighbours and then the label of that label, until no node has
    a neighbour with a smaller label (then all of a component are equal): about log2 of the longest chain.
    Rounds are written tables of at most `files` files, the one before is deleted;
    joins are against stored tables with one row per node, so a hub's edges can be split among tasks.
    """
    spark = edges.sparkSession
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both, both_path = stored(both.unionAll(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges", files)
    labels, path = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("label")).withColumnRenamed("u", "node"), "labels", files)
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["u"]).select(
            "node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        lower, lower_path = stored(lower, "labels-near", files)
        forget(spark, path)
        if not lower.where("label <> was").limit(1).count():
            forget(spark, both_path)
            return lower.select("node", "label"), lower_path
        up = lower.select(F.col("node").alias("at"), F.col("label").alias("next"))
        labels, path = stored(lower.join(up, lower["label"] == up["at"]).select("node", F.least("label", "next").alias("label")), "labels", files)
        forget(spark, lower_path)
