"""Queries that run the streaming jobs over the given tables until all input is read.

Each starts a stream on a parquet folder, writes to parquet in the shared folder (never to
driver memory) and returns that table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafstack.operators import queues
from leafstack.queries import learn_report as LR
from leafstack.queries import text_pages as TP
from leafstack.queries import views
from leafstack.queries.registry import query
from leafstack.session import scratch_folder
from leafstack.streaming import streams


def read_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of files: only as a pattern does a path stand for either."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream to the end of its input and return what it wrote, with batch_id.

    Every micro-batch has its own folder that a repeated batch overwrites.
    """
    spark = stream.sparkSession
    out, ckpt = scratch_folder(spark, name), scratch_folder(spark, f"{name}-state")

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    q = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def _event_stream(spark, sf):
    return views.events_of(read_stream(spark, sf, "events")).withColumn("created_at", F.col("created_at").cast("timestamp"))


@query("stream_status_counts", """
SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, state, n FROM (SELECT time_bucket(INTERVAL 1 HOUR, created_at) AS w, state, count(*) AS n FROM doc_events GROUP BY 1, 2)
WHERE w + INTERVAL 1 HOUR <= (SELECT max(created_at) FROM doc_events) - INTERVAL 10 MINUTE""", ("doc_events",))
def stream_status_counts(spark, sf):
    out = drain(streams.stream_status_counts(_event_stream(spark, sf)), "status-counts")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "state", "n")


@query("stream_document_status", "SELECT document_id, arg_max(state, (created_at, event_id)) AS state FROM doc_events GROUP BY 1", ("doc_events",))
def stream_document_status(spark, sf):
    """Over three batches in no order."""
    folder = scratch_folder(spark, "status")
    e = views.events_of(in_batches(spark, sf, "events")).withColumn("created_at", F.col("created_at").cast("timestamp"))
    streams.stream_document_status(e, folder, scratch_folder(spark, "status-state")).awaitTermination()
    return spark.read.parquet(f"{folder}/changes").groupBy("document_id").agg(F.max_by("state", "batch_id").alias("state"))


@query("stream_review_sla", """
SELECT document_id, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS events FROM (
  SELECT *, sum(new) OVER (PARTITION BY document_id ORDER BY created_at, event_id) AS s FROM (
    SELECT *, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY document_id ORDER BY created_at, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM doc_events))
GROUP BY document_id, s HAVING max(created_at) + INTERVAL 6 HOUR <= (SELECT max(created_at) FROM doc_events) - INTERVAL 1 HOUR""", ("doc_events",))
def stream_review_sla(spark, sf):
    out = drain(streams.stream_review_sla(_event_stream(spark, sf)), "sessions")
    return out.select("document_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "events")


@query("stream_event_fanout", """
SELECT event_id, s AS subscription_id FROM events, (VALUES (1), (2), (4)) t(s) WHERE s = 1 OR (s = 2 AND event_type IN ('signup', 'error')) OR (s = 4 AND event_type = 'purchase')""")
def stream_event_fanout(spark, sf):
    subs = spark.createDataFrame(LR.SUBSCRIPTIONS, "subscription_id int, url string, events array<string>, active boolean")
    e = read_stream(spark, sf, "events").select("event_id", F.col("event_type").alias("event"))
    return drain(streams.stream_event_fanout(e, subs), "fanout").select("event_id", "subscription_id")


def _doc_stream(spark, sf):
    return _docs_of(read_stream(spark, sf, "documents"))


def _docs_of(d):
    i = F.col("doc_id")
    return d.select(
        F.concat(F.lit("doc_"), i).alias("document_id"), F.sha2(F.col("text").cast("binary"), 256).alias("file_sha256"),
        views.epoch_plus(i).cast("timestamp").alias("created_at"), F.concat(F.lit("c_"), "lang").alias("class_id"), F.col("source").alias("variant_id"),
        views.pick(i % 10, *views.STATES).alias("status"), F.when(i % 4 != 3, (i % 7 + 1).cast("int")).alias("pages_total"), "text")


def in_batches(spark: SparkSession, sf: str, name: str, batches: int = 3) -> DataFrame:
    """A table as a stream of several micro-batches, dealt by a hash of its rows: late rows come with it.

    A batch has as many files as the table has parts for each batch, so no task writes or reads a whole batch of a large table.
    """
    folder = scratch_folder(spark, f"{name}-arrivals")
    table = spark.read.parquet(f"{sf}/{name}.parquet")
    files = math.ceil(table.rdd.getNumPartitions() / batches)
    table.repartition(batches * files, F.xxhash64(*table.columns)).write.parquet(folder)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(folder)


@query("stream_exact_dedup", "SELECT file_sha256, 1 AS kept FROM registry GROUP BY 1", ("registry",))
def stream_exact_dedup(spark, sf):
    """Over three batches in no order: one document per hash remains."""
    folder = scratch_folder(spark, "exact-dedup")
    s = _docs_of(in_batches(spark, sf, "documents")).select("document_id", "file_sha256", "created_at")
    streams.stream_exact_dedup(s, folder, scratch_folder(spark, "exact-dedup-state")).awaitTermination()
    return spark.read.parquet(f"{folder}/kept").groupBy("file_sha256").agg(F.count(F.lit(1)).alias("kept"))


@query("stream_variant_profile", """
SELECT variant_id, count(*) AS doc_count, min(pages_total) AS page_count_min, max(pages_total) AS page_count_max,
  CASE WHEN count(*) >= 50 THEN 'OPTIMISED' WHEN count(*) >= 10 THEN 'LEARNED_PROPOSED' WHEN count(*) >= 3 THEN 'LEARNING' ELSE 'ZERO_SHOT' END AS stage FROM registry GROUP BY 1""", ("registry",))
def stream_variant_profile(spark, sf):
    """Over three batches in no order."""
    folder = scratch_folder(spark, "layouts")
    streams.stream_variant_profile(_docs_of(in_batches(spark, sf, "documents")), folder, scratch_folder(spark, "layouts-state")).awaitTermination()
    last = spark.read.parquet(f"{folder}/changes").groupBy("variant_id").agg(F.max_by(F.struct("doc_count", "page_count_min", "page_count_max", "stage"), "batch_id").alias("l"))
    return last.select("variant_id", "l.*")


STREAM_TARGETS = {r.class_id: ["first_word", "number"] for r in TP.RULES}
STREAM_PATTERNS = [TP.R.Pattern("first_word", r"^\W*([A-Za-z]+)", 1, 0.9), TP.R.Pattern("number", r"\b(\d{3,})\b", 1, 0.8)]


@query("stream_process")
def stream_process(spark, sf):
    required = {"c_en": ["first_word", "number"], "c_fr": ["first_word"]}
    out = drain(streams.stream_process(_doc_stream(spark, sf), TP.RULES, STREAM_PATTERNS, STREAM_TARGETS, required=required, dates={}, numbers={}), "process")
    return out.select("document_id", "class_id", "is_valid", F.array_join("nigo", "|").alias("nigo"))


@query("stream_near_dup", "SELECT document_id, original_document_id, hamming_distance FROM near", ("near",))
def stream_near_dup(spark, sf):
    """All documents arrive in one batch here, so the answers are those of the batch job."""
    folder = scratch_folder(spark, "near-dup")
    s = _doc_stream(spark, sf).select("document_id", "class_id", "status", "created_at", "text")
    streams.stream_near_dup(s, folder, scratch_folder(spark, "near-dup-state")).awaitTermination()
    return spark.read.parquet(f"{folder}/duplicates").select("document_id", "original_document_id", "hamming_distance")


def _trade_stream(spark, sf):
    """Arrivals over the orders table: a purchase order each, an invoice for most, an inspection for some."""
    o = read_stream(spark, sf, "orders")
    k = F.col("o_orderkey")
    part = lambda p, c, m: F.struct(F.lit(p).alias("p"), F.lit(c).alias("class_id"), F.lit(m).alias("m"))
    parts = F.array_compact(F.array(part("po_", "dc_003", 0), F.when(k % 4 != 1, part("inv_", "dc_006", 1)), F.when(k % 5 == 0, part("ic_", "dc_008", 2))))
    return o.select(k.alias("k"), F.explode(parts).alias("x")).select(
        "k", F.concat(F.lit("shp_"), "k").alias("shipment_id"), F.concat("x.p", "k").alias("document_id"), F.col("x.class_id").alias("class_id"),
        views.epoch_plus(F.col("k") * 5 + F.col("x.m")).cast("timestamp").alias("created_at"))


@query("stream_match_ready", """
SELECT 'shp_' || o_orderkey AS shipment_id, 'po_' || o_orderkey AS po_document_id, CASE WHEN o_orderkey % 4 <> 1 THEN 'inv_' || o_orderkey END AS invoice_document_id, o_orderkey % 5 = 0 AS has_ic,
  CASE WHEN o_orderkey % 4 <> 1 THEN 'READY' ELSE 'DEFERRED' END AS status FROM orders
WHERE o_orderkey % 4 <> 1 OR o_orderkey * 5 + CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 0 END + 60 < (SELECT max(o_orderkey * 5 + CASE WHEN o_orderkey % 5 = 0 THEN 2 WHEN o_orderkey % 4 <> 1 THEN 1 ELSE 0 END) FROM orders) - 10""")
def stream_match_ready(spark, sf):
    s = _trade_stream(spark, sf).select("shipment_id", "document_id", "class_id", "created_at")
    folder = scratch_folder(spark, "match-ready")
    streams.stream_match_ready(s, folder, scratch_folder(spark, "match-ready-state")).awaitTermination()
    return spark.read.parquet(f"{folder}/outcomes").select("shipment_id", "po_document_id", "invoice_document_id", "has_ic", "status")


@query("stream_link", """
SELECT document_id, 'shp_po_' || (k // 4 * 4) AS shipment_id FROM (
  SELECT o_orderkey AS k, 'po_' || o_orderkey AS document_id FROM orders UNION ALL SELECT o_orderkey, 'inv_' || o_orderkey FROM orders WHERE o_orderkey % 4 <> 1 UNION ALL SELECT o_orderkey, 'ic_' || o_orderkey FROM orders WHERE o_orderkey % 5 = 0)""")
def stream_link(spark, sf):
    """Every document carries its order's key; orders of one waybill share another, so they become one shipment."""
    folder = scratch_folder(spark, "link")
    key = lambda c, r: F.struct(c.alias("key"), F.lit(r).alias("rank"))
    s = _trade_stream(spark, sf).select(
        "document_id", "created_at", F.array(key(F.concat(F.lit("K-"), "k"), 0), key(F.concat(F.lit("AWB-"), F.floor(F.col("k") / 4).cast("bigint")), 6)).alias("keys"))
    streams.stream_link(s, folder, scratch_folder(spark, "link-state")).awaitTermination()
    return spark.read.parquet(f"{folder}/links").select("document_id", "shipment_id")


@query("stream_timeline", "SELECT document_id, state, min(created_at) AS entered_at, count(*) AS times FROM doc_events GROUP BY 1, 2", ("doc_events",))
def stream_timeline(spark, sf):
    """The event trail copied by a stream, then summed up in batch."""
    copied = drain(views.events_of(read_stream(spark, sf, "events")), "trail")
    return queues.status_timeline(copied)
