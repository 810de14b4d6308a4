"""Streams over several batches, with late rows and a restart in between."""

import os
import random
import re
import shutil
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from leafstack.queries import QUERIES, stream_jobs
from leafstack.rules import DEDUP_STATES
from leafstack.session import scratch_folder
from leafstack.streaming import streams
from leafstack.streaming.keyed import KeyedRuns

BASE = datetime(2024, 1, 1)


def arrivals(spark, batches, schema):
    """One file per batch in a folder, read one file at a time."""
    folder = scratch_folder(spark, "arrivals")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part={k}")
    s = spark.read.parquet(folder).drop("part").schema
    return folder, spark.readStream.schema(s).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def _documents(spark, files):
    """A folder with a documents table, as one file or as several in a folder."""
    folder = scratch_folder(spark, "tables").removeprefix("file:")
    rows = [(i, " ".join(f"word{i % 7} the and {j % (i % 5 + 2)}" for j in range(30)) if i % 9 else None, "en", "src", 10) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(files, "doc_id").write.parquet(f"{folder}/written")
    parts = [f for f in sorted(os.listdir(f"{folder}/written")) if f.endswith(".parquet")]
    if files == 1:
        shutil.copy(f"{folder}/written/{parts[0]}", f"{folder}/documents.parquet")
    else:
        shutil.copytree(f"{folder}/written", f"{folder}/documents.parquet")
    return folder


def test_streams_read_a_folder_of_files(spark):
    one, many = _documents(spark, 1), _documents(spark, 3)
    for name in ("stream_process", "stream_near_dup"):
        got = [sorted(map(repr, QUERIES[name](spark, folder).collect())) for folder in (one, many)]
        assert got[0] == got[1] and len(got[0]) > 10, name


def test_a_batch_of_a_large_table_is_several_files(spark):
    """Eight parts in three batches: three files a batch, and no file with a third of the rows."""
    folder = scratch_folder(spark, "wide")
    spark.range(9000).selectExpr("id AS doc_id", "repeat(CAST(id AS STRING), 300) AS text").repartition(8).write.option("compression", "none").parquet(f"{folder}/documents.parquet")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        stream = stream_jobs.in_batches(spark, folder, "documents")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    sizes = []
    def each(batch, batch_id):
        sizes.append([r["count"] for r in batch.groupBy(F.input_file_name()).count().collect()])
    stream.writeStream.foreachBatch(each).option("checkpointLocation", scratch_folder(spark, "wide-state")).trigger(availableNow=True).start().awaitTermination()
    assert len(sizes) == 3 and sum(map(sum, sizes)) == 9000
    assert max(map(max, sizes)) < 2000 and min(map(len, sizes)) > 1


def test_exact_dedup_over_restarts(spark):
    schema = "document_id string, file_sha256 string, created_at timestamp"
    at = lambda d: BASE + timedelta(days=d)
    folder, s = arrivals(spark, [[("a", "h1", at(1)), ("b", "h2", at(1)), ("c", "h1", at(0))], [("d", "h2", at(400)), ("e", "h3", at(2))]], schema)
    out, state = scratch_folder(spark, "kept"), scratch_folder(spark, "kept-state")
    streams.stream_exact_dedup(s, out, state).awaitTermination()
    # the job ends, more documents come, and it starts again
    spark.createDataFrame([("f", "h1", at(900)), ("g", "h4", at(3)), ("h", "h4", at(3))], schema).coalesce(1).write.parquet(f"{folder}/part=9")
    streams.stream_exact_dedup(s, out, state).awaitTermination()
    got = {(r.file_sha256, r.document_id) for r in spark.read.parquet(f"{out}/kept").collect()}
    assert got == {("h1", "c"), ("h2", "b"), ("h3", "e"), ("h4", "g")}


def test_match_ready_over_batches(spark):
    schema = "shipment_id string, document_id string, class_id string, created_at timestamp"
    at = lambda m: BASE + timedelta(minutes=m)
    batches = [
        [("s1", "po2", "dc_003", at(5)), ("s2", "po3", "dc_003", at(6))],
        [("s1", "inv1", "dc_006", at(8)), ("s1", "po1", "dc_003", at(4)), ("s3", "inv9", "dc_006", at(9))],      # the earlier order comes later
        [("x", "po5", "dc_003", at(300))], [("y", "po6", "dc_003", at(2000))], [("z", "po7", "dc_003", at(4000))],
    ]
    _, s = arrivals(spark, batches, schema)
    folder = scratch_folder(spark, "ready")
    streams.stream_match_ready(s, folder, scratch_folder(spark, "ready-state")).awaitTermination()
    out = spark.read.parquet(f"{folder}/outcomes").collect()
    ready = {(r.shipment_id, r.po_document_id, r.invoice_document_id) for r in out if r.status == "READY"}
    assert ready == {("s1", "po1", "inv1")}
    assert {r.shipment_id for r in out if r.status == "DEFERRED"} == {"s2", "s3", "x", "y"}


def test_late_documents_of_a_finished_shipment(spark):
    """A certificate days after READY gives READY again, over a restart; an invoice after DEFERRED gives READY; nothing is deferred twice."""
    schema = "shipment_id string, document_id string, class_id string, created_at timestamp"
    at = lambda m: BASE + timedelta(minutes=m)
    arrived, s = arrivals(spark, [[("s1", "po1", "dc_003", at(0)), ("s1", "inv1", "dc_006", at(1)), ("s2", "po2", "dc_003", at(2))],
                                  [("far", "po3", "dc_003", at(10_000))], [("s1", "ic1", "dc_008", at(9_000)), ("s2", "inv2", "dc_006", at(3))]], schema)
    folder, state = scratch_folder(spark, "late"), scratch_folder(spark, "late-state")
    run = lambda: streams.stream_match_ready(s, folder, state).awaitTermination()
    run()
    spark.createDataFrame([("s1", "pl1", "dc_007", at(30_000)), (None, "no", "dc_007", at(1))], schema).coalesce(1).write.parquet(f"{arrived}/part=9")
    run()
    got = sorted((r.batch_id, r.shipment_id, r.po_document_id, r.invoice_document_id, r.has_ic, r.has_pl, r.status) for r in spark.read.parquet(f"{folder}/outcomes").collect())
    assert got == [(0, "s1", "po1", "inv1", False, False, "READY"), (1, "s2", "po2", None, False, False, "DEFERRED"),
                   (2, "s1", "po1", "inv1", True, False, "READY"), (2, "s2", "po2", "inv2", False, False, "READY"),
                   (3, "far", "po3", None, False, False, "DEFERRED"), (3, "s1", "po1", "inv1", True, True, "READY")]


def test_keyed_runs_merge_and_prune(spark):
    """State equals one aggregate over all batches; runs stay few; a lookup reads only its keys' buckets; a repeated batch counts once."""
    runs = KeyedRuns(scratch_folder(spark, "runs"), ["k"], {"n": F.sum, "first": F.min}, buckets=8, fan=3)
    want = {}
    for b in range(11):
        rows = [(k, 1, b * 10 - (k or 0)) for k in (b, b + 1, 99, None)]
        for _ in range(2 if b in (2, 8) else 1):     # once the batch that merges, too
            own = runs.add(spark.createDataFrame(rows, "k int, n long, first int"), b)
            now = {r.k: (r.n, r.first) for r in runs.now(own, b).collect()}
        for k, n, first in rows:
            old = want.get(k, (0, first))
            want[k] = (old[0] + n, min(old[1], first))
        assert now == {k: want[k] for k, *_ in rows}
    assert len(runs.runs(spark, 11)) <= 6
    one = runs.before(11, spark.createDataFrame([(4,)], "k int"))
    assert [(r.k, r.n, r.first) for r in one.collect()] == [(4, *want[4])]
    scans = [x for x in one._jdf.queryExecution().executedPlan().toString().split("FileScan parquet")[1:]]
    assert scans and all(re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = \d", x) for x in scans)
    assert runs.add(spark.createDataFrame([], "k int, n long, first int"), 11).collect() == []


def test_running_state_over_batches(spark):
    at = lambda m: BASE + timedelta(minutes=m)
    schema = "document_id string, event_id int, state string, created_at timestamp"
    _, s = arrivals(spark, [[("a", 1, "NEW", at(1)), ("b", 2, "NEW", at(1)), ("a", 3, "DONE", at(9))], [("a", 4, "LATE", at(5)), ("c", 5, "NEW", at(0))], [("b", 6, "DONE", at(1))]], schema)
    folder = scratch_folder(spark, "latest")
    streams.stream_document_status(s, folder, scratch_folder(spark, "latest-state")).awaitTermination()
    got = {(r.batch_id, r.document_id, r.state) for r in spark.read.parquet(f"{folder}/changes").collect()}
    assert got == {(0, "a", "DONE"), (0, "b", "NEW"), (1, "a", "DONE"), (1, "c", "NEW"), (2, "b", "DONE")}
    _, s = arrivals(spark, [[("v", 3), ("v", None), (None, 4)], [("w", 1)], [("v", 7)]], "variant_id string, pages_total int")
    folder = scratch_folder(spark, "profile")
    streams.stream_variant_profile(s, folder, scratch_folder(spark, "profile-state")).awaitTermination()
    got = {(r.batch_id, r.variant_id, r.doc_count, r.page_count_min, r.page_count_max, r.stage) for r in spark.read.parquet(f"{folder}/changes").collect()}
    assert got == {(0, "v", 2, 3, 3, "ZERO_SHOT"), (1, "w", 1, 1, 1, "ZERO_SHOT"), (2, "v", 3, 3, 7, "LEARNING")}


def test_near_duplicates_over_batches(spark):
    """Each batch against itself and all before it, as comparing every pair gives; few buckets of the index are read for one document."""
    words = "invoice order ship total amount date port vessel goods weight net gross terms bank swift code".split()
    rng = random.Random(4)
    base = [" ".join(rng.choices(words, k=60)) for _ in range(8)]
    text = lambda k: base[k % 8] if k % 3 else base[k % 8].replace(words[k % 16], "changed", 1)
    docs = [(f"d{k:02d}", f"c{k % 2}" if k % 11 else None, ["COMPLETED", "FAILED", "NEEDS_REVIEW"][k % 3 if k % 5 else 0], BASE + timedelta(minutes=97 * k % 40), text(k)) for k in range(40)]
    batches = [docs[:16], docs[16:30], docs[30:39], docs[39:]]
    schema = "document_id string, class_id string, status string, created_at timestamp, text string"
    _, s = arrivals(spark, batches, schema)
    folder = scratch_folder(spark, "near")
    streams.stream_near_dup(s, folder, scratch_folder(spark, "near-state")).awaitTermination()
    got = {(r.document_id, r.original_document_id, r.hamming_distance) for r in spark.read.parquet(f"{folder}/duplicates").collect()}
    prints = {r.document_id: r.content_simhash & (2**64 - 1) for r in spark.read.parquet(f"{folder}/fingerprints").collect()}
    want, seen = set(), []
    for batch in batches:
        seen += batch
        for d in batch:
            near = [((prints[d[0]] ^ prints[o[0]]).bit_count(), o[3], o[0]) for o in seen
                    if d[1] and o[1] == d[1] and o[0] != d[0] and o[2] in DEDUP_STATES and prints[d[0]] and prints[o[0]]]
            best = min(near, default=None)
            if best and best[0] <= 10:
                want.add((d[0], best[2], best[0]))
    assert got == want and len(want) > 20
