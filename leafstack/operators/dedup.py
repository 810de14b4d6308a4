"""Exact, content and near duplicates."""

from __future__ import annotations

import json
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafstack.functions.text import hamming, similarity_class
from leafstack.operators.fieldset import amendment_outcome, field_diff
from leafstack.rules import DEDUP_STATES
from leafstack.session import cut_lineage, stored


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Later copies of the same bytes, each with the first document that had them.

    First means by (created_at, document_id).  Hashes are read into a narrow table once.  The first
    of each is an aggregate with map-side combining; hashes seen once drop out before the join back,
    which is against a stored table, so a hash of a third of all rows is split among tasks.
    """
    rows = stored(docs.select("document_id", "file_sha256", "created_at"), "hashes")
    firsts = rows.groupBy("file_sha256").agg(
        F.min(F.struct("created_at", "document_id")).alias("f"), F.count(F.lit(1)).alias("copies"),
    ).filter(F.col("copies") > 1).select("file_sha256", F.col("f.document_id").alias("original_document_id"), "copies")
    return rows.select("document_id", "file_sha256").join(stored(firsts, "first-copies"), "file_sha256").filter(
        F.col("document_id") != F.col("original_document_id")
    ).select("document_id", "original_document_id", "file_sha256", "copies")


def _spread(bits: list[int], parts: int) -> list[int]:
    """The bit positions cut into `parts` near-equal masks."""
    cuts = [round(i * len(bits) / parts) for i in range(parts + 1)]
    masks = [sum(1 << b for b in bits[a:z]) for a, z in zip(cuts, cuts[1:])]
    return masks


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def block_masks(distance: int, keep: int, within: int = (1 << 64) - 1) -> list[int]:
    """Masks of which at least one is untouched when at most `distance` bits differ.

    The bits of `within` are cut in distance+keep blocks; any pair leaves `keep` of them
    unchanged, so every combination of `keep` blocks is one mask.
    """
    blocks = _spread([b for b in range(64) if within >> b & 1], distance + keep)
    return [sum(c) for c in combinations(blocks, keep)]


def block_keys(fps: DataFrame, masks: list[int]) -> DataFrame:
    """Every fingerprint once per mask: (class_id, mask_no, key, fp, eligible)."""
    table = F.from_json(F.lit(json.dumps([_signed(m) for m in masks])), "array<bigint>")
    return fps.select("class_id", "fp", "first_order", F.posexplode(table).alias("mask_no", "mask")).select(
        "class_id", "mask_no", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "first_order")


def _best_in_blocks(left: DataFrame, right: DataFrame, distance: int) -> DataFrame:
    """Nearest other fingerprint among those sharing a key, folded while joining."""
    r = right.select("class_id", "mask_no", "key", F.col("fp").alias("other_fp"),
                     F.col("first_order").alias("other_order"))
    d = hamming(F.col("fp"), F.col("other_fp"))
    return (
        left.select("class_id", "mask_no", "key", "fp").join(r, ["class_id", "mask_no", "key"])
        .filter((F.col("fp") != F.col("other_fp")) & (d <= distance))
        .groupBy("class_id", "fp").agg(F.min(F.struct(d.alias("d"), F.col("other_order").alias("o"))).alias("best"))
    )


def _key_counts(prints: DataFrame, masks: list[int], name: str) -> DataFrame:
    return block_keys(prints, masks).groupBy("class_id", "mask_no", "key").agg(F.count(F.lit(1)).alias(name))


def _dense_classes(queries: DataFrame, targets: DataFrame, distance: int, keep: int) -> DataFrame:
    """(class_id, q_rows, t_rows) of the classes where comparing all pairs costs less than joining on block keys.

    Fingerprints of much alike texts share most bits, so a pair meets under many keys. Both costs are
    counted; a joined row costs as much as `JOIN_COST` pairs compared in arrays.
    """
    masks, on = block_masks(distance, keep), ["class_id", "mask_no", "key"]
    joined = _key_counts(queries, masks, "q").join(_key_counts(targets, masks, "t"), on).groupBy("class_id").agg(
        F.sum(F.col("q").cast("double") * F.col("t")).alias("rows"))
    rows = queries.groupBy("class_id").agg(F.count(F.lit(1)).alias("q_rows")).join(
        targets.groupBy("class_id").agg(F.count(F.lit(1)).alias("t_rows")), "class_id")
    return stored(rows.join(joined, "class_id", "left").filter(
        F.col("q_rows").cast("double") * F.col("t_rows") < JOIN_COST * F.coalesce("rows", F.lit(0.0))
    ).select("class_id", "q_rows", "t_rows"), "dense-classes")


#: Pairs compared in arrays in the time of one joined row, about; fingerprints a side of one such comparison.
JOIN_COST, BLOCK = 10, 16_384


def _compare_block(distance: int):
    """Nearest other fingerprint of `right` for each of `left`, within `distance`; the earliest of equally near ones."""
    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right, sort_keys=[("created_at", "ascending"), ("document_id", "ascending")], null_placement="at_start"))
        q, t = (x["fp"].to_numpy().view(np.uint64) for x in (left, right))
        best, at = np.full(len(q), 255, np.uint8), np.zeros(len(q), np.int64)
        for a in range(0, len(q) if len(t) else 0, 64):
            # 0, the fingerprint itself, becomes the largest number
            d = np.bitwise_count(q[a:a + 64, None] ^ t[None, :]) - np.uint8(1)
            at[a:a + 64] = d.argmin(axis=1)
            best[a:a + 64] = np.take_along_axis(d, at[a:a + 64, None], 1)[:, 0]
        hit = np.flatnonzero(best < distance)
        found = right.take(pa.array(at[hit]))
        return pa.table({"class_id": left["class_id"].take(pa.array(hit)), "fp": left["fp"].take(pa.array(hit)),
                         "d": pa.array(best[hit].astype(np.int32) + 1), "created_at": found["created_at"], "document_id": found["document_id"]})
    return compare


def _nearest_in_blocks(queries: DataFrame, targets: DataFrame, classes: DataFrame, distance: int) -> DataFrame:
    """(class_id, fp, best<d,o>) of the fingerprints of `classes`, all pairs of a class compared block by block.

    A block holds about `BLOCK` fingerprints of either side, whatever the size of the class.
    """
    sizes = classes.select("class_id", *(F.ceil(F.col(f"{x}_rows") / BLOCK).cast("int").alias(f"{x}s") for x in "qt"))
    blocks = sizes.agg(F.sum(F.col("qs").cast("long") * F.col("ts"))).first()[0] or 1

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        rows = side.join(sizes, "class_id").withColumn(own, F.pmod(F.xxhash64("fp"), F.col(f"{own}s")).cast("int"))
        rows = rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))
        # as many partitions as blocks: a block is few bytes and much work, so they must not be put together again
        return rows.select("class_id", "q", "t", "fp", "first_order.*").repartition(min(blocks, 100_000), "class_id", "q", "t")

    # both sides may come from one table: new names tell their columns apart
    q, t = (x.toDF(*x.columns) for x in (dealt(queries, "q", "t").select("class_id", "q", "t", "fp"), dealt(targets, "t", "q")))
    kind = {f.name: f.dataType.simpleString() for f in t.schema}
    found = q.groupBy("class_id", "q", "t").cogroup(t.groupBy("class_id", "q", "t")).applyInArrow(
        _compare_block(distance), f"class_id {kind['class_id']}, fp bigint, d int, created_at {kind['created_at']}, document_id {kind['document_id']}")
    return found.groupBy("class_id", "fp").agg(F.min(F.struct("d", F.struct("created_at", "document_id").alias("o"))).alias("best"))


def _nearest(queries: DataFrame, targets: DataFrame, distance: int, keep: int, hot: int) -> DataFrame:
    """(class_id, fp, best<d,o>) of each query fingerprint within `distance`, exactly.

    Keys that no query and target share never reach the join.  A key holding more than
    `hot` targets is cut again: its members get the masks of the bits the key leaves
    open, so a crowded bucket becomes many small ones and still no close pair is lost.
    """
    masks = block_masks(distance, keep)
    q, t = block_keys(queries, masks), block_keys(targets, masks)
    # keys of targets that a query has, written once: sizes, joins and the second level read them
    t = stored(t.join(q.select("class_id", "mask_no", "key").distinct(), ["class_id", "mask_no", "key"], "left_semi"), "target-keys")
    sizes = t.groupBy("class_id", "mask_no", "key").agg(F.count(F.lit(1)).alias("n"))
    wanted = stored(sizes, "key-sizes")
    cold, crowded = wanted.filter(F.col("n") <= hot).drop("n"), wanted.filter(F.col("n") > hot).drop("n")
    on = ["class_id", "mask_no", "key"]
    found = _best_in_blocks(q.join(cold, on, "left_semi"), t.join(cold, on, "left_semi"), distance)

    # second level: for each first mask, masks over the bits it leaves open
    full = (1 << 64) - 1
    finer = F.from_json(F.lit(json.dumps(
        [[_signed(m) for m in block_masks(distance, 2, full & ~first)] for first in masks])), "array<array<bigint>>")

    def recut(side: DataFrame) -> DataFrame:
        rows = side.join(crowded, on, "left_semi")
        cut = rows.select("class_id", "mask_no", "key", "fp", "first_order",
                          F.posexplode(F.get(finer, F.col("mask_no"))).alias("sub_no", "sub"))
        return cut.select(
            "class_id", (F.col("mask_no") * 1000 + F.col("sub_no")).alias("mask_no"),
            F.col("key").bitwiseOR(F.col("fp").bitwiseAND(F.col("sub"))).alias("key"), "fp", "first_order")

    again = _best_in_blocks(recut(q), recut(t), distance)
    return found.unionByName(again).groupBy("class_id", "fp").agg(F.min("best").alias("best"))


def near_duplicates(docs: DataFrame, content: int = 3, near: int = 10, keep: int = 2,
                    hot: int = 2_000, skip_blank: bool = True, history: DataFrame | None = None) -> DataFrame:
    """Nearest finished document of the same class by fingerprint distance, up to `near` bits.

    `docs`: document_id, class_id, status, created_at, content_simhash.  Candidates are
    documents whose status is finished; the smallest distance wins, then the earliest
    (created_at, document_id).  Documents without a class are not compared.  Blank texts
    (fingerprint 0) are left out unless `skip_blank` is False.

    Copies are settled first: documents of one fingerprint collapse into one row per
    class, so a group of copies costs one row in everything that follows.  Fingerprints
    still without an answer look for neighbours within `content` bits through long,
    selective keys, and only the rest within `near` bits.  `keep` sets the key length of
    that last search: 2 for up to some 100,000 fingerprints a class, 3 for ten million, 4 beyond.
    Where texts of a class are so alike that keys tell little, all its pairs are compared instead,
    in blocks of bounded size that the tasks share: counted first, whichever is less work.

    `history` (same columns) only offers candidates: `docs` are looked up in it and among
    themselves, as a micro-batch against the stored fingerprints.
    """
    columns = ["document_id", "class_id", "status", "created_at", "content_simhash"]
    asked = docs.select(*columns, F.lit(True).alias("ask"))
    if history is not None:
        asked = asked.unionByName(history.select(*columns, F.lit(False).alias("ask")))
    base = asked.filter(F.col("class_id").isNotNull() & F.col("content_simhash").isNotNull())
    if skip_blank:
        base = base.filter(F.col("content_simhash") != 0)
    order = F.struct("created_at", "document_id")
    # narrow rows, written once: everything below reads them several times
    rows = cut_lineage(base.select("document_id", "class_id", "ask", F.col("content_simhash").alias("fp"),
                                   F.col("status").isin(DEDUP_STATES).alias("eligible"), order.alias("o")))
    prints = stored(rows.groupBy("class_id", "fp").agg(
        F.min(F.when(F.col("eligible"), F.col("o"))).alias("first_order"),
        F.count_if("eligible").alias("eligible_count"), F.bool_or("ask").alias("asked")), "prints")

    # the first document of a print may not be its own original: its answer is the second one
    crowded = prints.filter(F.col("eligible_count") > 1).select("class_id", "fp", "first_order")
    second = (
        rows.filter("eligible").join(crowded, ["class_id", "fp"])
        .filter(F.col("o") != F.col("first_order"))
        .groupBy("class_id", "fp").agg(F.min("o").alias("second_order"))
    )
    targets = prints.filter(F.col("eligible_count") > 0).select("class_id", "fp", "first_order")
    # prints that some document cannot settle at distance 0
    open_prints = prints.filter("asked").filter(F.col("eligible_count") <= 1).select("class_id", "fp", "first_order")
    answers = None
    for distance, blocks in [(content, 3), (near, keep)]:
        if distance < content or distance > near or (distance == near and blocks != keep):
            continue
        # classes of much alike texts are compared in blocks, up to `near` at once
        dense = _dense_classes(open_prints, targets, distance, blocks)
        in_dense = [x.join(dense, "class_id", "left_semi") for x in (open_prints, targets)]
        open_prints, others = (x.join(dense, "class_id", "left_anti") for x in (open_prints, targets))
        found = stored(_nearest(open_prints, others, distance, blocks, hot).unionByName(
            _nearest_in_blocks(*in_dense, dense, near)), "nearest")
        answers = found if answers is None else answers.unionByName(found)
        open_prints = stored(open_prints.join(found, ["class_id", "fp"], "left_anti"), "open-prints")

    second = stored(second, "second-copies")
    joined = (
        rows.filter("ask").drop("eligible").join(prints, ["class_id", "fp"])
        .join(second, ["class_id", "fp"], "left").join(answers, ["class_id", "fp"], "left")
    )
    is_first = F.col("o").eqNullSafe(F.col("first_order"))
    same = F.when(is_first, F.col("second_order")).otherwise(F.col("first_order"))
    chosen = F.when(same.isNotNull(), F.struct(F.lit(0).alias("d"), same.alias("o"))).otherwise(F.col("best"))
    return joined.select("document_id", "class_id", chosen.alias("c")).filter(F.col("c").isNotNull()).select(
        "document_id", "class_id", F.col("c.o.document_id").alias("original_document_id"),
        F.col("c.d").alias("hamming_distance"),
        similarity_class(F.col("c.d"), content, near).alias("duplicate_type"))


def dedup_documents(docs: DataFrame, **options) -> DataFrame:
    """One row per document: EXACT, CONTENT or NEAR duplicate with its original, or none.

    A class column must be set for the fingerprint comparison; give all documents the same
    class to compare everything with everything.
    """
    # read three times below: fingerprints are worked out once
    docs = stored(docs.select("document_id", "file_sha256", "class_id", "status", "created_at", "content_simhash"), "fingerprinted")
    exact = exact_duplicates(docs).select(
        "document_id", F.col("original_document_id").alias("exact_original"))
    near = near_duplicates(docs, **options).select(
        "document_id", F.col("original_document_id").alias("near_original"), "hamming_distance", "duplicate_type")
    joined = docs.select("document_id").join(exact, "document_id", "left").join(near, "document_id", "left")
    is_exact = F.col("exact_original").isNotNull()
    return joined.select(
        "document_id",
        F.when(is_exact, "EXACT_DUPLICATE").otherwise(F.col("duplicate_type")).alias("duplicate_type"),
        F.coalesce("exact_original", "near_original").alias("original_document_id"),
        F.when(is_exact, F.lit(0)).otherwise(F.col("hamming_distance")).alias("hamming_distance"))


def amendments(duplicates: DataFrame, fields: DataFrame) -> DataFrame:
    """What the field comparison says about each near duplicate."""
    pairs = duplicates.filter(F.col("duplicate_type") == "NEAR_DUPLICATE").select("document_id", "original_document_id")
    return amendment_outcome(pairs, field_diff(pairs, fields))
