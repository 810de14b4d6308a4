"""A key that a third of all rows share is split among tasks: thresholds are lowered and the final plan is read."""

import pytest
from pyspark.sql import functions as F

from leafstack.operators import dedup, links

LOW = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "12", "spark.sql.files.maxPartitionBytes": "256k",
}


@pytest.fixture
def low(spark):
    old = {k: spark.conf.get(k, None) for k in LOW}
    for k, v in LOW.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    rows = df.collect()
    return df._jdf.queryExecution().executedPlan().toString(), rows


def test_exact_duplicates(low):
    i = F.col("id")
    docs = low.range(300_000).select(
        F.format_string("d%07d", i).alias("document_id"), F.sha2(F.when(i % 3 == 0, "hot").otherwise((i - i % 2).cast("string")), 256).alias("file_sha256"),
        F.timestamp_seconds(i).alias("created_at"))
    plan, rows = final_plan(dedup.exact_duplicates(docs))
    assert "skew=true" in plan
    assert sum(r.original_document_id == "d0000000" for r in rows) == 99_999


def test_shipments_of_a_common_key(low):
    i = F.col("id")
    keys = low.range(300_000).select(F.format_string("d%07d", i).alias("document_id"), F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), i % 5000)).alias("key"), F.lit(1).alias("rank"))
    shipments = low.range(6000).select(F.format_string("s%05d", i).alias("shipment_id"), F.when(i == 7, "hot").otherwise(F.concat(F.lit("k"), i)).alias("reference_key"),
                                       F.timestamp_seconds(i).alias("created_at"))
    plan, rows = final_plan(links.link_to_shipments(keys, shipments, shipments.select("shipment_id", F.col("reference_key").alias("key"))))
    assert "skew=true" in plan
    assert sum(r.shipment_id == "s00007" for r in rows) >= 100_000
