"""Prefix trie of rebuilt conversations by collapsing whole sequences.

Every conversation c is rebuilt from the first h turns of conversation c - c % 5 (all if it has fewer,
none if there is none) and its own turns after its first h, h = crc32(decimal c) % 9. Identical rebuilt
conversations become one weighted sequence with the list of those that end there; sequences that are no
proper prefix of another, found by an anti-join, are the leaves; what a trie node holds comes from
aggregating the prefixes of the weighted sequences. Nothing walks the trie level by level.

Texts are read once: a turn becomes 16 bytes of its SHA-256 and its length. Turn numbers, prefixes and
byte sums are running values over ranges of (conversation, turn), so a conversation of any length is cut
among tasks. A prefix is named by its depth and two 64-bit xors of position-bound turn hashes, so a node's
parent follows from the node's own row. The smallest conversation of a sequence stands for it, and of a
node's members the smallest owns it; what a sequence owns are its deepest prefixes, which lets the
subtree sums come from one row per (sequence, prefix) without pairing a node with its ancestors:
over the sequences q through a node, sum(weight * bytes of q below) - sum(bytes of nodes below that q owns).
The ids that end in a node are sorted by range, joined in blocks, and the blocks are hashed in order.

Defined cases: a null conv_id belongs to no conversation and is dropped; null role or text is empty; a null
turn comes first; turns of one number are ordered by their hash, repeated rows stay; % of a negative id
has the id's sign; an empty table gives no node; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafstack.llm.common import forget, stored
from leafstack.operators.common import carried, range_split

#: Conversations of one family share the first one's turns; the most turns that a conversation takes over.
FAMILY, MOST_SHARED = 5, 8
#: Conversation ids in one block of an end list.
BLOCK_IDS = 50_000
KEY = ["depth", "k1", "k2"]


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, t1, t2, row, bytes) of each turn; t1 and t2 name its role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    half = lambda at: F.conv(F.substring("named", at, 16), 16, -10).cast("long")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                named.alias("named"), F.octet_length(text).cast("long").alias("bytes")).where("conv_id is not null")
    return rows.select("conv_id", "turn", half(1).alias("t1"), half(17).alias("t2"), F.monotonically_increasing_id().alias("row"), "bytes")


def _bound(place: Column) -> list[Column]:
    """The turn's hashes bound to its place."""
    return [F.xxhash64(F.lit(k), place, "t1", "t2").alias(f"h{k}") for k in (1, 2)]


def _up_to(window: Window) -> list[Column]:
    """Name of the prefix that ends here and bytes before this turn, over the window's rows."""
    return [F.bit_xor("h1").over(window).alias("x1"), F.bit_xor("h2").over(window).alias("x2"),
            (F.sum("bytes").over(window) - F.col("bytes")).alias("before")]


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(_chunk, conv_id, place, t1, t2, bytes), place from 1."""
    order = ["turn", "t1", "t2", "row"]
    part = range_split(turns, ["conv_id", *order])
    counts = part.groupBy("conv_id", "_chunk").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    local = part.withColumn("i", F.row_number().over(Window.partitionBy("_chunk", "conv_id").orderBy(*order)))
    done = local.join(carried(counts, "conv_id", before), (F.col("conv_id") == F.col("_g")) & (F.col("_chunk") == F.col("_c")), "left")
    return done.select("_chunk", "conv_id", (F.col("i") + F.coalesce("_carry", F.lit(0))).alias("place"), "t1", "t2", "bytes")


def rebuilt_plan(turns: DataFrame, numbered: DataFrame) -> DataFrame:
    """Per conversation: conv_id, shared (h), head (its turns from the family's first, at most eight), length."""
    w = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    heads = numbered.where((F.col("conv_id") % FAMILY == 0) & (F.col("place") <= MOST_SHARED)).select("conv_id", "place", "bytes", *_bound(F.col("place")))
    heads = heads.select("*", *_up_to(w)).groupBy(F.col("conv_id").alias("first")).agg(
        F.sort_array(F.collect_list(F.struct("place", "x1", "x2", "h1", "h2", "before", "bytes"))).alias("head"))
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("shared", F.crc32(F.col("conv_id").cast("string")) % (MOST_SHARED + 1))
    convs = convs.join(heads, F.col("conv_id") - F.col("conv_id") % FAMILY == F.col("first"), "left")
    head = F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), 1, F.col("shared").cast("int"))
    return convs.select("conv_id", "shared", head.alias("head"), (F.size(head) + F.greatest(F.col("n") - F.col("shared"), F.lit(0))).alias("length"))


def prefixes(numbered: DataFrame, plan: DataFrame) -> DataFrame:
    """One row per rebuilt turn: conv_id, length, key of the prefix that it ends, h1, h2, before, bytes."""
    taken = plan.select("conv_id", "length", F.inline("head")).select(
        "conv_id", "length", F.col("place").alias("depth"), F.col("x1").alias("k1"), F.col("x2").alias("k2"), "h1", "h2", "before", "bytes")
    last = F.element_at("head", -1)
    state = [F.when(F.size("head") > 0, c).otherwise(0).alias(n) for n, c in (("s1", last["x1"]), ("s2", last["x2"]), ("sum", last["before"] + last["bytes"]))]
    own = numbered.join(plan.select("conv_id", "shared", "length", F.size("head").alias("taken"), *state), "conv_id").where("place > shared")
    own, path = stored(own.withColumn("depth", F.col("place") - F.col("shared") + F.col("taken")).select(
        "_chunk", "conv_id", "length", "depth", "s1", "s2", "sum", "bytes", *_bound(F.col("depth"))), "own-turns")
    w = Window.partitionBy("conv_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    edges = own.groupBy("conv_id", "_chunk").agg(F.bit_xor("h1").alias("e1"), F.bit_xor("h2").alias("e2"), F.sum("bytes").alias("e3"))
    earlier = F.when(F.count("*").over(w) > 0, F.struct(F.bit_xor("e1").over(w).alias("c1"), F.bit_xor("e2").over(w).alias("c2"), F.sum("e3").over(w).alias("c3")))
    local = own.select("*", *_up_to(Window.partitionBy("_chunk", "conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)))
    local = local.join(carried(edges, "conv_id", earlier), (F.col("conv_id") == F.col("_g")) & (F.col("_chunk") == F.col("_c")), "left")
    carry = lambda n: F.coalesce(F.col(f"_carry.{n}"), F.lit(0))
    return taken.unionByName(local.select(
        "conv_id", "length", "depth", F.col("s1").bitwiseXOR(carry("c1")).bitwiseXOR(F.col("x1")).alias("k1"),
        F.col("s2").bitwiseXOR(carry("c2")).bitwiseXOR(F.col("x2")).alias("k2"), "h1", "h2", (F.col("sum") + carry("c3") + F.col("before")).alias("before"), "bytes"))


# --- end lists --------------------------------------------------------------------------------------

def _joined(batches: Iterator[pa.RecordBatch], block_ids: int) -> Iterator[pa.RecordBatch]:
    """Rows (depth, k1, k2, conv_id) in order, as blocks (depth, k1, k2, first_id, ids)."""
    names = [*KEY, "first_id", "ids"]
    at, ids, out = None, [], []
    for batch in batches:
        for *key, c in zip(*(col.to_pylist() for col in batch.columns), strict=True):
            if key != at or len(ids) >= block_ids:
                if ids:
                    out.append((*at, ids[0], ",".join(map(str, ids))))
                at, ids = key, []
            ids.append(c)
        if out:
            yield pa.record_batch([pa.array(x) for x in zip(*out, strict=True)], names)
            out = []
    if ids:
        yield pa.record_batch([pa.array([x]) for x in (*at, ids[0], ",".join(map(str, ids)))], names)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order as (depth, k1, k2, ends_sha256); a list is never held whole."""
    names = [*KEY, "ends_sha256"]
    at, sha, out = None, None, []
    for batch in batches:
        for *key, _, ids in zip(*(col.to_pylist() for col in batch.columns), strict=True):
            if key == at:
                sha.update(b"," + ids.encode())
                continue
            if at:
                out.append((*at, sha.hexdigest()))
            at, sha = key, hashlib.sha256(ids.encode())
        if out:
            yield pa.record_batch([pa.array(x) for x in zip(*out, strict=True)], names)
            out = []
    if at:
        yield pa.record_batch([pa.array([x]) for x in (*at, sha.hexdigest())], names)


def end_lists(whole: DataFrame, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Of whole(conv_id, depth, k1, k2): (depth, k1, k2, ends_sha256), the ids of a key in ascending order."""
    n = int(whole.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = whole.select(*KEY, "conv_id").repartitionByRange(n, *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    blocks = rows.mapInArrow(functools.partial(_joined, block_ids=block_ids), "depth long, k1 long, k2 long, first_id long, ids string")
    return blocks.repartition(*KEY).sortWithinPartitions(*KEY, "first_id").mapInArrow(_hashed, "depth long, k1 long, k2 long, ends_sha256 string")


# --- the trie ---------------------------------------------------------------------------------------

def weighted_sequences(rows: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(whole(conv_id, key, total), sequences(key, conv_id: the smallest, weight, total)); total is in bytes."""
    none = F.lit(0).cast("long")
    whole = rows.where("depth = length").select("conv_id", *KEY, (F.col("before") + F.col("bytes")).alias("total")).unionByName(
        plan.where("length = 0").select("conv_id", none.alias("depth"), none.alias("k1"), none.alias("k2"), none.alias("total")))
    whole = whole.withColumn("depth", F.col("depth").cast("long"))
    return whole, whole.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight"), F.max("total").alias("total"))


def trie_nodes(conversations: DataFrame, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark, paths = conversations.sparkSession, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        df, path = stored(df, name)
        paths.append(path)
        return df

    turns = kept(turn_rows(conversations), "turns")
    numbered = kept(numbered_turns(turns), "numbered-turns")
    plan = kept(rebuilt_plan(turns, numbered), "rebuilt")
    rows = kept(prefixes(numbered, plan), "prefixes")
    whole, sequences = weighted_sequences(rows, plan)
    sequences = kept(sequences, "sequences")

    # the prefixes of the weighted sequences, the root among them
    none = F.lit(0).cast("long")
    root = sequences.select("conv_id", F.col("depth").alias("length"), *(none.alias(c) for c in [*KEY, "h1", "h2", "before", "bytes"]), "weight", "total")
    entries = kept(rows.join(sequences.select("conv_id", "weight", "total"), "conv_id").withColumn("depth", F.col("depth").cast("long")).unionByName(root), "weighted-prefixes")
    nodes = kept(entries.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max("before").alias("before"),
        F.max("h1").alias("h1"), F.max("h2").alias("h2"), F.sum(F.col("weight") * F.col("total")).alias("all_bytes"), F.sum("total").alias("each_bytes")), "nodes")

    # leaves, and where the prefixes begin that a sequence owns
    proper = entries.where("depth < length").select(*KEY).distinct()
    leaves = sequences.join(proper, KEY, "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    owned = nodes.groupBy("conv_id").agg(F.min_by("before", "depth").alias("own_before"))
    facts = kept(sequences.select("conv_id", "total").join(leaves, "conv_id", "left").join(owned, "conv_id", "left").select(
        "conv_id", F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("own_before", "total").alias("own_before")), "sequence-facts")
    below = entries.select("conv_id", *KEY, "before").join(facts, "conv_id").groupBy(*KEY).agg(
        F.sum("leaf").alias("n_leaves"), F.sum(F.greatest("before", "own_before")).alias("not_owned"))

    parent = [F.col("depth") - 1, F.col("k1").bitwiseXOR(F.col("h1")), F.col("k2").bitwiseXOR(F.col("h2"))]
    links = nodes.where("depth > 0").select("conv_id", "depth", *(c.alias(f"up_{k}") for c, k in zip(parent, KEY, strict=True)))
    children = links.groupBy(*(F.col(f"up_{k}").alias(k) for k in KEY)).agg(F.count("*").alias("n_children"))
    ups = kept(nodes.select(*(F.col(k).alias(f"up_{k}") for k in KEY), F.col("conv_id").alias("parent_conv_id")), "parents")
    parents = kept(links.join(ups, [f"up_{k}" for k in KEY]).select("conv_id", "depth", "parent_conv_id"), "node-parents")
    ends = end_lists(whole, block_ids)

    done = nodes.join(below, KEY).join(children, KEY, "left").join(ends, KEY, "left").join(parents, ["conv_id", "depth"], "left")
    saved = F.col("all_bytes") - F.col("before") * F.col("n_convs") - F.col("each_bytes") + F.col("not_owned")
    result = kept(done.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves",
                              saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")), "trie")
    for path in paths[:-1]:
        forget(spark, path)
    return result
