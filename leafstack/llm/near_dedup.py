"""MinHash near-dedup by a chosen-path set similarity join.

A document's set holds its distinct 5-word shingles, A-Z lower-cased, as 64-bit hashes. Documents with
equal sets are one node, named by a 128-bit fingerprint of the set. Each of `trees` independent trees
starts with all of them. A tree node chooses one of the 64 minwise tokens by its own path and branches
its documents by that token, so two documents stay together with the probability of their similarity.
Nodes of up to `leaf` documents are compared exhaustively inside one task; larger ones branch again.

After the first branching each document is compared with the smallest of each node it came through, and
confirmed links form components. A node of one component is finished: near copies of one text, however
many, go no further. Only mixed nodes are compared, pairs of different components alone, and only large
mixed nodes branch on, where at every level each document first meets the smallest of its node and the
components are joined anew. A node that is one component but for a few documents is finished too: those
few go to each chunk of it. So a crowd costs rows by its size and depth, not by its pairs.

A pair at 75 % is together in one tree with 0.75^branchings. 12 trees miss it with 6e-8 if nodes are
small after one branching, with 5e-5 after two. Where a crowd (many documents that share a long passage
without being copies) goes deeper, its documents are given as many more trees as bring a pair of them to
`recall` at the depth that was measured; that number follows from the depth alone and has no cap.
Candidates are pairs whose 192 minwise tokens agree in 66 % or more (a pair of 75 %: 2.9 standard
deviations above, so 1 in 500 at the very limit is lost); all are confirmed on the full sets, made anew from the texts of just those documents.

Defined cases: null, empty or blank texts have an empty set, size 0, and are linked with nothing, also
not with each other; fewer than five words are one shingle; a null doc_id counts as the largest and comes
back as null; rows that repeat a doc_id are documents of their own sets; other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafstack.llm.common import BROADCAST_ROWS, LAST_ID, Tables, files_for, ordered_id, returning, stored, worker_keeps
from leafstack.llm.components import components

SHINGLE, TOKENS, TREES = 5, 64, 12
#: Documents of a node compared exhaustively after the first branching, where most that meet have little in common, and after later ones.
FIRST_LEAF, LEAF = 32, 512
#: Minwise tokens whose lowest bytes are compared; the first TOKENS of them choose paths.
COMPARED = 192
#: Trees of which each document first meets the smallest of its node, so that copies are one component early.
FIRST_TREES = 4
#: Probability with which a pair at the limit shall meet; share of a crowd whose depth counts for it.
RECALL, MATTERS = 0.99, 0.05
#: Branchings after which a node is compared exhaustively whatever its size: 64 tokens are used up long before (a pair of 75 % is still together with 1e-5).
DEPTH = 40
#: Share of equal minwise tokens from which a pair is confirmed on the full sets.
CLOSE_ENOUGH = 0.66
WORDS_KEPT = 300_000
_ODD = (np.random.default_rng(5).integers(0, 2**63, COMPARED, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
_PLACE = (np.random.default_rng(6).integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1))


# --- sets -------------------------------------------------------------------------------------------

class WordHashes(dict):
    """8-byte hashes of words; a worker keeps those it has met."""

    def __missing__(self, word: bytes) -> bytes:
        import xxhash
        if len(self) >= WORDS_KEPT:
            self.clear()
        got = self[word] = xxhash.xxh3_64_digest(word)
        return got


def word_hashes() -> WordHashes:
    return worker_keeps("word hashes", WordHashes)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = (text or "").encode().lower().split()       # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.frombuffer(b"".join(map(word_hashes().__getitem__, words)), dtype="<u8")
    n = max(1, len(h) - SHINGLE + 1)
    out = np.full(n, len(h) if len(h) < SHINGLE else 0, dtype=np.uint64)
    for k in range(min(SHINGLE, len(h))):
        out += h[k:k + n] * _PLACE[k]
    return np.unique(_mixed(out))


def minwise(found: np.ndarray) -> np.ndarray:
    """COMPARED minwise tokens of a set, 32 bits each."""
    best = np.full(COMPARED, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(found), 512):
        best = np.minimum(best, (found[at:at + 512, None] * _ODD).min(axis=0))
    return (best >> np.uint64(32)).astype(np.uint32)


def set_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, text_hash, n_shingles, fp, tokens, short) of each row; the last three are null for an empty set.

    doc orders ids; doc and text_hash together tell rows apart that share a doc_id. short holds the tokens'
    lowest bytes, for comparing.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [shingles(t.as_py()) for t in part.column(3)]
                fp = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                tokens = [minwise(s).view(np.int32) if len(s) else None for s in sets]
                short = [None if t is None else t.astype(np.uint8).tobytes() for t in tokens]
                yield pa.record_batch([*part.columns[:3], pa.array([len(s) for s in sets], pa.int64()), pa.array(fp, pa.binary()),
                                       pa.array([None if t is None else t[:TOKENS] for t in tokens], pa.list_(pa.int32())), pa.array(short, pa.binary())],
                                      ["doc_id", "doc", "text_hash", "n_shingles", "fp", "tokens", "short"])

    return _told_apart(docs).mapInArrow(
        returning(run), "doc_id long, doc long, text_hash long, n_shingles long, fp binary, tokens array<int>, short binary")


def _told_apart(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), ordered_id(F.col("doc_id")).alias("doc"),
                       F.xxhash64("text").alias("text_hash"), "text")


def full_sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame, tables: Tables) -> DataFrame:
    """(fp, found) of the sets in `wanted` (fp), from one text of each; found is sorted.

    Up to BROADCAST_ROWS wanted sets are sent to the tasks that read texts; more are joined by a shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingles(t.as_py()).view(np.int64) for t in part.column(1)]
                yield pa.record_batch([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["fp", "found"])

    one = (rows.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("doc", "text_hash")).alias("from"))
           .select("fp", "from.doc", "from.text_hash"))
    one = tables.keep(one, "set-sources")
    few = one.count() <= BROADCAST_ROWS
    texts = _told_apart(docs).join(F.broadcast(one) if few else one, ["doc", "text_hash"]).select("fp", "text")
    return texts.mapInArrow(returning(run), "fp binary, found array<bigint>").dropDuplicates(["fp"])


# --- the trees --------------------------------------------------------------------------------------

def _branched(path, tokens):
    """The child path of a node's document: the node's path chooses the token."""
    return F.xxhash64(path, F.element_at(tokens, (F.pmod(F.xxhash64(F.lit(1), path), F.lit(TOKENS)) + 1).cast("int")))


def trees_for(recall: float, percent: int, branchings: int) -> int:
    """Trees after which a pair at the limit has met with probability `recall`, if a tree needs so many branchings."""
    together = (percent / 100) ** branchings
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - together)))


def _close(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose minwise tokens agree well enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, COMPARED) for c in batch.columns[2:])
            near = pa.array((one == two).sum(axis=1) >= CLOSE_ENOUGH * COMPARED)
            yield pa.record_batch([c.filter(near) for c in batch.columns[:2]], ["a", "b"])

    one, two = (nodes.select(F.col("fp").alias(x), F.col("short").alias(f"{x}_short")) for x in "ab")
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "a_short", "b_short")
    return both.mapInArrow(run, "a binary, b binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 |a and b| >= percent |a or b|; only the sets of a pair's end are shuffled for it."""
    one, two = (sets.select(F.col("fp").alias(x), F.col("found").alias(f"{x}_found")).join(pairs.select(x).distinct(), x, "left_semi") for x in "ab")
    both = pairs.join(one, "a").join(two, "b").select(
        "a", "b", F.size(F.array_intersect("a_found", "b_found")).alias("shared"), (F.size("a_found") + F.size("b_found")).alias("total"))
    return both.where(100 * F.col("shared") >= percent * (F.col("total") - F.col("shared"))).select("a", "b")


def _labelled(members: DataFrame, groups: DataFrame) -> DataFrame:
    """`members` (fp) with the label of their component; a set without links is its own."""
    own = groups.select(F.col("node").alias("fp"), "label")
    return members.join(own, "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def _compared(batches: Iterator[pa.RecordBatch], partners: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows (path, chunk, fp, label, short) sorted by path and chunk: the close pairs (a, b) of different labels in each."""
    def pairs(rows: list[tuple]) -> Iterator[tuple[bytes, bytes]]:
        tokens = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, COMPARED)
        code = {label: k for k, label in enumerate({r[1] for r in rows})}
        labels = np.array([code[r[1]] for r in rows])
        has = np.zeros(len(rows), dtype=bool)
        for k in range(len(rows) - 1):
            others = np.flatnonzero(labels[k + 1:] != labels[k]) + k + 1
            others = others[(tokens[others] == tokens[k]).sum(axis=1) >= CLOSE_ENOUGH * COMPARED]
            if partners:
                has[others] = True
                has[k] |= len(others) > 0
                continue
            for j in others:
                yield min(rows[k][0], rows[j][0]), max(rows[k][0], rows[j][0])
        yield from ((rows[k][0], rows[k][0]) for k in np.flatnonzero(has))

    return _by_chunk(batches, pairs)


def _by_chunk(batches: Iterator[pa.RecordBatch], pairs: Callable[[list[tuple]], Iterator[tuple[bytes, bytes]]]) -> Iterator[pa.RecordBatch]:
    """What `pairs` makes of each run of rows with equal path and chunk, the first two columns."""
    at, held, found = None, [], []
    for batch in _with_end(batches):
        for path, chunk, *row in zip(*(_values(c) for c in batch.columns), strict=True) if batch is not None else [(None, None)]:
            if (path, chunk) != at:
                found += pairs(held) if len(held) > 1 else []
                at, held = (path, chunk), []
            held.append(tuple(row))
        if found:
            a, b = zip(*found, strict=True)
            yield pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
            found = []


def _values(column: pa.Array) -> list:
    """Python values, but arrays of numbers as numpy's."""
    return [x.values.to_numpy() for x in column] if pa.types.is_list(column.type) else column.to_pylist()


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _in_chunks(members: DataFrame, facts: DataFrame, leaf: int) -> DataFrame:
    """Members of finished nodes with what `facts` (fp) hold, dealt by (path, chunk) and sorted by it.

    A node over `leaf` is cut into chunks of its main component; the few others go to each.
    """
    chunks = F.ceil(F.col("n") / leaf)
    chunk = F.when(F.col("label") == F.col("main"), F.array(F.pmod(F.xxhash64("fp"), chunks))).otherwise(F.sequence(F.lit(0).cast("long"), chunks - 1))
    rows = members.join(facts, "fp").select("path", F.explode(chunk).alias("chunk"), "fp", "label", *facts.drop("fp").columns)
    return rows.repartition("path", "chunk").sortWithinPartitions("path", "chunk")


def _inside(members: DataFrame, nodes: DataFrame, leaf: int, partners: bool = False) -> DataFrame:
    """The close pairs (a, b) of different labels inside finished nodes of members(path, fp, label, n, main).

    With `partners` each document that has such a pair, with itself.
    """
    return _in_chunks(members, nodes.select("fp", "short"), leaf).mapInArrow(functools.partial(_compared, partners=partners), "a binary, b binary").distinct()


def _linked_inside(members: DataFrame, sets: DataFrame, nodes: DataFrame, leaf: int, percent: int) -> DataFrame:
    """Links (a, b) that join the components inside finished nodes: close pairs are confirmed on the full sets where they meet.

    Pairs that a chunk's earlier links have joined are not tried, so a chunk gives at most one link a row.
    """
    def links(rows: list[tuple]) -> Iterator[tuple[bytes, bytes]]:
        tokens = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, COMPARED)
        code = {label: k for k, label in enumerate({r[1] for r in rows})}
        labels = np.array([code[r[1]] for r in rows])
        for k in range(1, len(rows)):
            agree = (tokens[:k] == tokens[k]).sum(axis=1)
            open_ = (agree >= CLOSE_ENOUGH * COMPARED) & (labels[:k] != labels[k])
            while open_.any():
                j = int(np.where(open_, agree, -1).argmax())
                open_[j] = False
                shared = len(np.intersect1d(rows[j][3], rows[k][3], assume_unique=True))
                if 100 * shared >= percent * (len(rows[j][3]) + len(rows[k][3]) - shared):
                    yield min(rows[k][0], rows[j][0]), max(rows[k][0], rows[j][0])
                    labels[labels == labels[j]] = labels[k]
                    open_ &= labels[:k] != labels[k]

    # full sets travel only for documents that have a close one of another component
    close = _inside(members, nodes, leaf, partners=True).select(F.col("a").alias("fp"))
    return _in_chunks(members, nodes.select("fp", "short").join(close, "fp", "left_semi").join(sets, "fp"), leaf).mapInArrow(
        lambda batches: _by_chunk(batches, links), "a binary, b binary").distinct()


def _mixed_nodes(labelled: DataFrame, tables: Tables) -> DataFrame:
    """Of the nodes of labelled(path, fp, label) that hold more than one component: path, n, centre (the smallest: fp, label), main (label of most), others."""
    parts = labelled.groupBy("path", "label").agg(F.count("*").alias("size"), F.min("fp").alias("fp"))
    nodes = parts.groupBy("path").agg(F.sum("size").alias("n"), F.min(F.struct("fp", "label")).alias("centre"), F.max(F.struct("size", "label")).alias("top"))
    return tables.keep(nodes.where("top.size < n").select("path", "n", "centre", F.col("top.label").alias("main"), (F.col("n") - F.col("top.size")).alias("others")), "mixed-nodes")


def _stars(members: DataFrame) -> DataFrame:
    """Each member with its node's smallest, if their labels differ."""
    return members.where("label <> centre.label").select(F.col("centre.fp").alias("a"), F.col("fp").alias("b")).distinct()


def _merged(groups: DataFrame, links: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame | None]:
    """`groups` (node, label) with the components that `links` (a, b) join, and the moves (node, label) of labels; None if nothing moves."""
    ends = links.join(groups.select(F.col("node").alias("a"), F.col("label").alias("u")), "a", "left").join(
        groups.select(F.col("node").alias("b"), F.col("label").alias("v")), "b", "left")
    edges = tables.keep(ends.select(F.coalesce("u", "a").alias("a"), F.coalesce("v", "b").alias("b")).where("a <> b").distinct(), "label-edges")
    if not edges.limit(1).count():
        return groups, None
    moves = tables.taken(components(edges, files=tables.files))
    to = moves.select(F.col("node").alias("label"), F.col("label").alias("to"))
    moved = groups.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return tables.keep(moved.unionByName(moves.join(groups, "node", "left_anti")), "groups"), moves


def _any(rows: DataFrame) -> bool:
    return bool(rows.limit(1).count())


def _finished(leaf: int) -> Column:
    """Whether a node is compared exhaustively: it is small, or few of its documents are of other components than its main one."""
    return (F.col("n") <= leaf) | (F.col("others") <= leaf)


class Crowd:
    """The sets of large nodes that hold several components, branched on until their nodes are small or of one component."""

    def __init__(self, fps: DataFrame, nodes: DataFrame, groups: DataFrame, sets: DataFrame, percent: int, leaf: int, tables: Tables):
        self.nodes, self.groups, self.sets, self.percent, self.leaf, self.tables = nodes, groups, sets, percent, leaf, tables
        self.rows = tables.keep(_labelled(fps.distinct().join(nodes.select("fp", "tokens"), "fp"), groups), "crowd")

    def descend(self, at: DataFrame) -> tuple[list[int], DataFrame | None]:
        """Branch the nodes at(path, fp). Members of nodes that went on, level by level, and those of the first level here."""
        going, first, left = [], None, at.limit(1).count()
        while left:
            level = self.tables.keep(at.join(self.rows, "fp").select("fp", "label", _branched(F.col("path"), F.col("tokens")).alias("path")), "crowd-branches")
            last = len(going) >= DEPTH
            members = self.tables.keep(level.join(_mixed_nodes(level, self.tables), "path"), "crowd-level")
            self._compare(members, last)
            at = members.where(F.lit(not last) & ~_finished(self.leaf)).select("path", "fp")
            first, left = first or at, at.count()
            going.append(left)
        return going, first

    def _compare(self, members: DataFrame, exhaustive: bool) -> None:
        """Compare each set of an unfinished node with the node's smallest, those of finished nodes with each other, if their labels differ."""
        done = F.lit(exhaustive) | _finished(self.leaf)
        found = []
        if _any(members.where(done)):
            found.append(_linked_inside(members.where(done), self.sets, self.nodes, self.leaf, self.percent))
        if _any(members.where(~done)):
            stars = self.tables.keep(_close(_stars(members.where(~done)), self.nodes), "crowd-stars")
            if _any(stars):
                found.append(_confirmed(stars, self.sets, self.percent))
        if not found:
            return
        links = self.tables.keep(functools.reduce(DataFrame.unionByName, found).distinct(), "crowd-links")
        self.groups, moves = _merged(self.groups, links, self.tables)
        if moves is not None:
            to = moves.select(F.col("node").alias("label"), F.col("label").alias("to"))
            self.rows = self.tables.keep(self.rows.join(to, "label", "left").select("fp", "tokens", F.coalesce("to", "label").alias("label")), "crowd")

def set_components(docs: DataFrame, rows: DataFrame, percent: int, trees: int, leaf: int, recall: float, tables: Tables) -> DataFrame:
    """(node, label) of the sets that are linked with another set; `rows` is set_rows, stored."""
    nodes = tables.keep(rows.where("fp is not null").select("fp", "tokens", "short").dropDuplicates(["fp"]), "sets")
    level = nodes.select("fp", F.explode(F.sequence(F.lit(1), F.lit(trees))).alias("tree"), "tokens")
    level = level.select("fp", "tree", _branched(F.xxhash64("tree"), F.col("tokens")).alias("path"))
    counted = tables.keep(level.groupBy("path").agg(F.count("*").alias("n"), F.min("fp").alias("centre")).where("n > 1"), "tree-nodes")
    members = tables.keep(level.join(counted, "path").select("path", "tree", "fp", "n", "centre"), "tree-members")
    sets = groups = None

    def linked(pairs: DataFrame, name: str, also: DataFrame | None = None) -> None:
        """Confirm pairs on the full sets, made anew where they are not there yet, and join components."""
        nonlocal sets, groups
        wanted = _ends(pairs) if also is None else _ends(pairs).unionByName(also).distinct()
        new = wanted if sets is None else wanted.join(sets.select("fp"), "fp", "left_anti")
        new = tables.keep(full_sets(docs, rows, new, tables), f"{name}-sets")
        sets = new if sets is None else sets.unionByName(new)
        links = tables.keep(_confirmed(pairs, sets, percent), f"{name}-links")
        groups = tables.taken(components(links, files=tables.files)) if groups is None else _merged(groups, links, tables)[0]

    def mixed(members: DataFrame) -> DataFrame:
        labelled = tables.keep(_labelled(members, groups), "labelled-members")
        return tables.keep(labelled.join(_mixed_nodes(labelled, tables), "path"), "mixed-members")

    # each set with the smallest of its nodes in some trees: most copies become components before anything else is compared
    first = members.where(f"fp <> centre and tree <= {FIRST_TREES}").select(F.col("centre").alias("a"), F.col("fp").alias("b")).distinct()
    linked(tables.keep(_close(first, nodes), "first-pairs"), "first")
    # of nodes that hold several components even so, finished ones are compared exhaustively and the others branch on
    left = mixed(members.select("path", "fp"))
    done = _finished(min(FIRST_LEAF, leaf))
    large = left.where(~done).select("path", "fp")
    linked(tables.keep(_inside(left.where(done), nodes, leaf), "small-pairs"), "small", large.select("fp").distinct())
    if not large.limit(1).count():
        return groups
    crowd = Crowd(large.select("fp"), nodes, groups, sets, percent, leaf, tables)
    going, again = crowd.descend(large)
    # what went on past the second level needs more trees: as many as its depth asks for
    deep = 2 + sum(n >= MATTERS * going[0] for n in going) if going and going[0] else 0
    more = trees_for(recall, percent, deep) - trees if deep else 0
    if more > 0:
        start = again.select("fp").distinct().select(F.explode(F.sequence(F.lit(trees + 1), F.lit(trees + more))).alias("tree"), "fp")
        crowd.descend(start.select(F.xxhash64("tree").alias("path"), "fp"))
    return crowd.groups


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("fp")).unionAll(pairs.select("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, trees: int = TREES, leaf: int = LEAF, recall: float = RECALL) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable), kept, and text_hash.

    kept is true for the document of that id; of rows that share it, for one text.
    """
    docs = docs.select("doc_id", "text")
    tables = Tables(docs.sparkSession)
    rows = tables.keep(set_rows(docs), "set-rows")
    tables.files = files_for(docs.sparkSession, rows.count())
    labels = set_components(docs, rows, percent, trees, leaf, recall, tables)
    grouped = rows.join(labels, rows["fp"] == labels["node"], "left").select(
        "doc_id", "doc", "text_hash", "n_shingles", F.coalesce("label", "fp").alias("group"))
    first = tables.keep(grouped.where("group is not null").groupBy("group").agg(F.min(F.struct("doc", "text_hash")).alias("first")), "group-firsts")
    own = F.struct("doc", "text_hash")
    joined = grouped.join(first, "group", "left").withColumn("first", F.coalesce("first", own))
    done, _ = stored(joined.select("doc_id", "n_shingles", F.when(F.col("first.doc") != LAST_ID, F.col("first.doc")).alias("component_id"),
                                   (F.col("first") == own).alias("kept"), "text_hash"), "near-duplicates", tables.files)
    tables.drop()
    return done
