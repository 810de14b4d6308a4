"""The arrival path as Structured Streaming jobs.

Functions take a streaming DataFrame and return one, or a started query where the work
happens per micro-batch.  Batch twins of all of them are in `leafstack.operators`.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafstack.functions.names import learning_stage
from leafstack.functions.text import simhash64
from leafstack.operators.classify import classify_documents
from leafstack.operators.dedup import block_keys, block_masks, near_duplicates
from leafstack.operators.extract import extract_map
from leafstack.operators.links import link_documents
from leafstack.operators.outputs import event_fanout
from leafstack.operators.quality import validate_maps
from leafstack.rules import DEDUP_STATES, INSPECTION_CLASSES, INVOICE_CLASSES, PACKING_CLASSES, PO_CLASSES, ClassRule, Pattern
from leafstack.session import Scratch, passing_shuffles
from leafstack.streaming.keyed import KeyedRuns


def stream_exact_dedup(docs: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """First document of each hash over the whole past; later copies are dropped, however late they come.

    In: document_id, file_sha256, created_at.  Each micro-batch is reduced to its first document per
    hash and looked up in the hashes of earlier batches, which are kept in hash buckets and merged as they
    come; `folder`/kept gets one sub-folder per batch that a repeated batch overwrites.
    """
    seen = KeyedRuns(f"{folder}/seen", ["file_sha256"], {"f": F.min})

    def each(batch: DataFrame, batch_id: int) -> None:
        first = seen.add(batch.select("file_sha256", F.struct("created_at", "document_id").alias("f")), batch_id)
        past = seen.before(batch_id, first)
        new = first if past is None else first.join(past.select("file_sha256"), "file_sha256", "left_anti")
        new.select("file_sha256", "f.document_id", "f.created_at").write.mode("overwrite").parquet(f"{folder}/kept/batch_id={batch_id}")

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _running(stream: DataFrame, state: KeyedRuns, partial: Callable[[DataFrame], DataFrame], shown: Callable[[DataFrame], DataFrame],
             folder: str, checkpoint: str) -> StreamingQuery:
    """Write the state of each batch's keys after it under `folder`/changes; all state is in stored tables."""
    def each(batch: DataFrame, batch_id: int) -> None:
        now = state.now(state.add(partial(batch), batch_id), batch_id)
        shown(now).write.mode("overwrite").parquet(f"{folder}/changes/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_process(docs: DataFrame, rules: Sequence[ClassRule], patterns: Sequence[Pattern],
                   targets: Mapping[str, Sequence[str]], **tables) -> DataFrame:
    """Classify, extract and validate every arriving document; stateless.

    The text stays in its row from classification to extraction: projections only, no join.
    """
    classed = classify_documents(docs, rules, keep=["text"])
    return validate_maps(extract_map(classed, patterns, targets), **tables)


def stream_document_status(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Latest state of each document, by (created_at, event_id), whatever the order of arrival.

    Writes the documents that a batch touched under `folder`/changes; ever new documents cost no memory.
    """
    latest = KeyedRuns(f"{folder}/latest", ["document_id"], {"l": F.max})
    return _running(events, latest, lambda b: b.select("document_id", F.struct("created_at", "event_id", "state").alias("l")),
                    lambda now: now.select("document_id", F.col("l.state").alias("state"), F.col("l.created_at").alias("created_at")), folder, checkpoint)


def stream_status_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per state and tumbling window."""
    return events.withWatermark("created_at", late).groupBy(F.window("created_at", window), "state").agg(
        F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "state", "n")


def stream_variant_profile(docs: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Running document count, stage and page range of each layout.

    Writes the layouts that a batch touched under `folder`/changes.
    """
    profile = KeyedRuns(f"{folder}/profile", ["variant_id"], {"doc_count": F.sum, "page_count_min": F.min, "page_count_max": F.max})
    return _running(docs, profile, lambda b: b.filter(F.col("variant_id").isNotNull()).groupBy("variant_id").agg(
        F.count(F.lit(1)).alias("doc_count"), F.min("pages_total").alias("page_count_min"), F.max("pages_total").alias("page_count_max")),
        lambda now: now.withColumn("stage", learning_stage(F.col("doc_count"))), folder, checkpoint)


def stream_event_fanout(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Stream-static join with the subscription table."""
    return event_fanout(events, subscriptions)


def stream_review_sla(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Activity sessions of each document: start, end, events."""
    return events.withWatermark("created_at", late).groupBy(
        "document_id", F.session_window("created_at", gap).alias("s")).agg(F.count(F.lit(1)).alias("events")).select(
        "document_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events")


def stream_match_ready(docs: DataFrame, folder: str, checkpoint: str, wait: str = "1 hour", late: str = "10 minutes") -> StreamingQuery:
    """Shipments whose purchase order and invoice are both there.

    In: shipment_id, document_id, class_id, created_at (timestamp).  `folder`/outcomes gets READY when the
    pair is complete and again when more documents arrive, however late; DEFERRED when the event time of
    all documents so far, less `late`, is more than `wait` past a shipment's newest document without a
    pair.  The order and the invoice are the first by (created_at, document_id), in whatever order they
    come.  Six small values a shipment are kept in a stored table without end; only shipments that still
    wait are carried from batch to batch.
    """
    idle = sum(int(pd.Timedelta(x).total_seconds() * 1_000_000) for x in (wait, late))
    values = {"po": F.min, "invoice": F.min, "has_ic": F.max, "has_pl": F.max, "newest": F.max}
    state = KeyedRuns(f"{folder}/shipments", ["shipment_id"], values)

    def first(classes: Sequence[str]) -> Column:
        return F.min(F.when(F.col("class_id").isin(*classes), F.struct("created_at", "document_id")))

    def any_of(classes: Sequence[str]) -> Column:
        return F.coalesce(F.max(F.col("class_id").isin(*classes)), F.lit(False))

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = state.add(batch.filter(F.col("shipment_id").isNotNull()).groupBy("shipment_id").agg(
            first(PO_CLASSES).alias("po"), first(INVOICE_CLASSES).alias("invoice"), any_of(INSPECTION_CLASSES).alias("has_ic"),
            any_of(PACKING_CLASSES).alias("has_pl"), F.max("created_at").alias("newest")), batch_id)
        last = {name: _read_or_none(spark, f"{folder}/{name}/batch_id={batch_id - 1}") for name in ("clock", "waiting")}
        # the newest event time so far: one number
        clock = own.select(F.unix_micros(F.max("newest")).alias("clock"))
        clock = clock if last["clock"] is None else clock.unionByName(last["clock"]).agg(F.max("clock").alias("clock"))
        clock.write.mode("overwrite").parquet(f"{folder}/clock/batch_id={batch_id}")
        end = spark.read.parquet(f"{folder}/clock/batch_id={batch_id}").first()[0]
        over = F.lit(False) if end is None else F.unix_micros("newest") < end - idle

        ready = F.col("po").isNotNull() & F.col("invoice").isNotNull()
        now = state.now(own, batch_id)
        if last["waiting"] is not None:
            now = now.unionByName(last["waiting"].drop("status").join(own.select("shipment_id"), "shipment_id", "left_anti"))
        judged = now.withColumn("status", F.when(ready, "READY").when(over, "DEFERRED").otherwise("WAITING"))
        judged.write.mode("overwrite").parquet(f"{folder}/judged/batch_id={batch_id}")
        judged = spark.read.parquet(f"{folder}/judged/batch_id={batch_id}")
        judged.filter("status = 'WAITING'").write.mode("overwrite").parquet(f"{folder}/waiting/batch_id={batch_id}")
        judged.filter("status <> 'WAITING'").select(
            "shipment_id", F.col("po.document_id").alias("po_document_id"), F.col("invoice.document_id").alias("invoice_document_id"),
            "has_ic", "has_pl", "status").write.mode("overwrite").parquet(f"{folder}/outcomes/batch_id={batch_id}")
        for name in ("judged", "waiting", "clock"):
            _forget(spark, f"{folder}/{name}/batch_id={batch_id - 2}")

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _forget(spark, path: str) -> None:
    """Delete a table that only an earlier batch needed."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _read_or_none(spark, path: str) -> DataFrame | None:
    """A table written batch by batch, or None before its first batch."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if fs.exists(hadoop) else None


def stream_link(docs: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Link each micro-batch against the shipments so far, in arrival order within the batch.

    In: document_id, created_at, keys array<struct<key,rank>>.  Writes links, shipments and
    shipment_keys under `folder`, one sub-folder per batch that is overwritten when a batch
    is repeated, so a restart does not double rows.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = lambda name: _before(spark, f"{folder}/{name}", batch_id)
        keys = batch.select("document_id", F.explode("keys").alias("k")).select("document_id", "k.*")
        shipments, held = before("shipments"), before("shipment_keys")
        kept = Scratch(spark)
        linked = link_documents(batch.select("document_id", "created_at"), keys, shipments, held, kept)
        # read three times below, worked out once
        placed = kept.keep(linked.join(batch.select("document_id", "created_at"), "document_id"), "placed")
        kept.drop("documents", "numbered", "guess")
        best = keys.groupBy("document_id").agg(F.min(F.struct("rank", "key")).alias("b"))
        founded = placed.filter(F.col("founder") == F.col("document_id")).join(best, "document_id", "left").select(
            "shipment_id", F.coalesce(F.col("b.key"), F.concat(F.lit("unkeyed:"), F.col("document_id"))).alias("reference_key"), "created_at")
        new_keys = placed.join(keys, "document_id").select("shipment_id", "key").distinct()
        with passing_shuffles(spark):
            for name, table in (("links", placed.select("document_id", "shipment_id")), ("shipments", founded), ("shipment_keys", new_keys)):
                table.write.mode("overwrite").parquet(f"{folder}/{name}/batch_id={batch_id}")
        kept.drop()

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _before(spark, path: str, batch_id: int) -> DataFrame | None:
    """Rows of earlier batches; a repeated batch does not see its own first attempt."""
    table = _read_or_none(spark, path)
    if table is None:
        return None
    return table.filter(F.col("batch_id") < batch_id).drop("batch_id")


def stream_near_dup(docs: DataFrame, folder: str, checkpoint: str, near: int = 10, skip_blank: bool = True, buckets: int = 64, **options) -> StreamingQuery:
    """Look every micro-batch up in the fingerprints of earlier ones and in itself, then add it.

    In: document_id, class_id, status, created_at, text.  Writes fingerprints and duplicates under `folder`,
    one sub-folder per batch.  `folder`/index holds each finished fingerprint of a class once per block mask
    with its first document, in buckets by (class, mask, key): two fingerprints within `near` bits share a key
    under some mask, so a batch reads only the buckets of its own keys and still finds every neighbour.
    """
    masks = block_masks(near, 2)
    index = KeyedRuns(f"{folder}/index", ["class_id", "mask_no", "key", "fp"], {"first_order": F.min}, ["class_id", "mask_no", "key"], buckets)

    def keyed(prints: DataFrame) -> DataFrame:
        known = prints.filter(F.col("class_id").isNotNull() & F.col("content_simhash").isNotNull() & (F.lit(not skip_blank) | (F.col("content_simhash") != 0)))
        return block_keys(known.select("class_id", F.col("content_simhash").alias("fp"), F.struct("created_at", "document_id").alias("first_order")), masks)

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        prints = batch.drop("text").join(simhash64(batch), "document_id")
        prints.write.mode("overwrite").parquet(f"{folder}/fingerprints/batch_id={batch_id}")
        mine = spark.read.parquet(f"{folder}/fingerprints/batch_id={batch_id}")
        past = index.before(batch_id, keyed(mine))
        if past is not None:
            past = past.groupBy("class_id", "fp").agg(F.min("first_order").alias("o")).select(
                "o.document_id", "class_id", F.lit(DEDUP_STATES[0]).alias("status"), "o.created_at", F.col("fp").alias("content_simhash"))
        found = near_duplicates(mine, near=near, skip_blank=skip_blank, history=past, **options)
        found.write.mode("overwrite").parquet(f"{folder}/duplicates/batch_id={batch_id}")
        index.add(keyed(mine.filter(F.col("status").isin(*DEDUP_STATES))), batch_id)

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
