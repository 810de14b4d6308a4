"""Token ids on disk: frequency-ranked, byte-aligned variable length, control bytes apart from data.

Ids are replaced by their rank in the corpus (0 for the most frequent), so that the 256 most frequent
take one byte each. A rank takes as many bytes as it needs, one to four; two bits per rank in a separate
control stream say how many, four ranks to a control byte. A reader looks each control byte up in three
tables, its total length and the places and byte masks of its four ranks, and gathers all ranks of a block
with one numpy index.

The files are a Parquet folder of blocks, so that Spark's commit protocol leaves no half-written file
behind when a task or an executor is lost. A block holds whole documents in ascending doc_id order:
part (range of ids), block (number in the part), at (ids in the part before it), n (its ids), doc_ids, lengths,
control, data. `ranks` beside it maps ranks back to ids.

Steps: each text is encoded once into a stored table; ids are counted per task, then summed (as many
rows as the vocabulary has); a range partitioning by doc_id puts documents in order; each task packs its
documents. Start offsets are sums of ids per part, one row per part.

Defined cases: a null text is empty and gives the end id alone; a null doc_id comes first; rows that
repeat a doc_id follow each other, ordered by length and ids; extra columns are not read.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafstack.llm.common import stored
from leafstack.llm.tokens import chunk_ids, vocab_size
from leafstack.session import scratch_folder

#: Ids in a block, about; a longer document is a block of its own.
BLOCK_IDS = 1 << 16
#: MB of encoded ids per part, about.
PART_MB = 64
BLOCK = ("part int, block int, at long, n long, doc_ids binary, missing binary, lengths binary, control binary, data binary")


# --- the coding -------------------------------------------------------------------------------------

def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of ranks below 2^32."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    most = int(ranks.max(initial=0))
    sizes = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    for limit in (0xFF, 0xFFFF, 0xFFFFFF):
        if most > limit:
            sizes[:len(ranks)] += ranks > limit
    four = sizes.view("<u4")
    control = (four | four >> 6 | four >> 12 | four >> 18).astype(np.uint8)
    # the columns of bytes that any rank needs
    raw = ranks.astype("<u2").view(np.uint8).reshape(-1, 2) if most <= 0xFFFF else ranks.view(np.uint8).reshape(-1, 4)
    kept = np.empty(raw.shape, dtype=bool)
    for k in range(raw.shape[1]):
        kept[:, k] = sizes[:len(ranks)] >= k
    return control.tobytes(), raw[kept].tobytes()


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per control byte: bytes of its four ranks, and for each of them where it starts and a mask of its bytes."""
    sizes = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3
    starts = np.cumsum(sizes + 1, axis=1) - (sizes + 1)
    masks = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype="<u4")
    return (sizes + 1).sum(axis=1), starts.astype(np.uint8).view("<u4").ravel(), masks[sizes]


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of a block."""
    if not n:
        return np.zeros(0, dtype="<u4")
    totals, starts, masks = _tables()
    codes = np.frombuffer(control, dtype=np.uint8)
    sizes = totals[codes]
    where = (starts[codes].view(np.uint8).reshape(-1, 4) + (np.cumsum(sizes) - sizes)[:, None]).ravel()[:n]
    # four bytes from each place on, of which the mask leaves the rank's; the slack is for the last ones
    raw = data + b"\0\0\0\0"
    four = np.ndarray(len(raw) - 3, dtype="<u4", buffer=raw, strides=(1,))
    return four.take(where) & masks.take(codes, axis=0).ravel()[:n]


# --- writing ----------------------------------------------------------------------------------------

def encode(docs: DataFrame, tokenizer: str, end_id: int | None = 0) -> DataFrame:
    """(doc_id, n_tokens, ids): each whole text's ids as little-endian integers, with end_id after them."""
    dtype = "<u2" if vocab_size(tokenizer) <= 1 << 16 else "<u4"
    width = int(dtype[-1])
    end = b"" if end_id is None else np.array([end_id], dtype=dtype).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = chunk_ids(tokenizer, dtype)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                made = [x + end for x in ids.batch([t or "" for t in part.column(1).to_pylist()])]
                yield pa.record_batch([part.column(0), pa.array([len(x) // width for x in made], pa.int64()),
                                       pa.array(made, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def id_counts(encoded: DataFrame, vocab: int) -> DataFrame:
    """(id, n) over all ids; each task sums up before the shuffle."""
    dtype = "<u2" if vocab <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocab, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = b"".join(batch.column(0).slice(at, 1000).to_pylist())
                total += np.bincount(np.frombuffer(some, dtype=dtype), minlength=vocab)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    return encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _blocks(by_id: np.ndarray, dtype: str, block_ids: int):
    """A function that packs the ordered documents of one task into blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, block, at = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        n_held = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, at, held, n_held
            ids = np.frombuffer(b"".join(h[1] for h in held), dtype=dtype)
            control, data = pack(by_id[ids])
            lengths = np.array([len(h[1]) // int(dtype[-1]) for h in held], dtype="<i8")
            row = [part, block, at, len(ids), np.array([h[0] or 0 for h in held], dtype="<i8").tobytes(),
                   np.packbits([h[0] is None for h in held]).tobytes(), lengths.tobytes(), control, data]
            block, at, held, n_held = block + 1, at + len(ids), [], 0
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * 5
            names = ["part", "block", "at", "n", "doc_ids", "missing", "lengths", "control", "data"]
            return pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = ids.as_py()
                if held and n_held + len(raw) // int(dtype[-1]) > block_ids:
                    yield flush()
                held.append((doc, raw))
                n_held += len(raw) // int(dtype[-1])
        if held:
            yield flush()
    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 0, block_ids: int = BLOCK_IDS) -> None:
    """Encode all of `docs` and write the token files to `folder` (a new one, shared by all executors)."""
    spark = docs.sparkSession
    vocab = vocab_size(tokenizer)
    dtype = "<u2" if vocab <= 1 << 16 else "<u4"
    encoded, _ = stored(encode(docs, tokenizer, end_id), "encoded")
    counts = id_counts(encoded, vocab).collect()        # at most one row per id of the vocabulary
    order = [r.id for r in sorted(counts, key=lambda r: (-r.n, r.id))]
    by_id = np.zeros(vocab, dtype="<u4")
    by_id[order] = np.arange(len(order), dtype="<u4")
    total_mb = sum(r.n for r in counts) * int(dtype[-1]) / 1e6
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total_mb / PART_MB) + 1)
    ordered = (encoded.repartitionByRange(parts, "doc_id", "n_tokens").sortWithinPartitions("doc_id", "n_tokens", "ids")
               .select("doc_id", "ids"))
    ordered.mapInArrow(_blocks(by_id, dtype, block_ids), BLOCK).write.option("compression", "zstd").parquet(f"{folder}/blocks")
    spark.createDataFrame([(k, i) for k, i in enumerate(order)], "rank long, id long").coalesce(1).write.parquet(f"{folder}/ranks")


# --- reading ----------------------------------------------------------------------------------------

def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) from the files; ids are little-endian unsigned 32-bit integers."""
    ranks = spark.read.parquet(f"{folder}/ranks").collect()     # one row per id of the vocabulary
    ids = np.zeros(max((r["rank"] for r in ranks), default=-1) + 1, dtype="<u4")
    for r in ranks:
        ids[r["rank"]] = r["id"]
    blocks = spark.read.schema(BLOCK).parquet(f"{folder}/blocks")
    totals = blocks.groupBy("part").agg(F.max(F.col("at") + F.col("n")).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)      # one row per part
    starts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = blocks.join(starts, "part").select((F.col("before") + F.col("at")).alias("start"), "doc_ids", "missing", "lengths", "control", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["lengths"], dtype="<i8")
                got = ids[unpack(row["control"], row["data"], int(lengths.sum()))].tobytes()
                docs = np.frombuffer(row["doc_ids"], dtype="<i8")
                none = np.unpackbits(np.frombuffer(row["missing"], dtype=np.uint8), count=len(docs)).astype(bool)
                ends = np.cumsum(lengths)
                each = [got[4 * (e - n):4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                cols = [pa.array(docs, pa.int64(), mask=none), pa.array(row["start"] + ends - lengths, pa.int64()),
                        pa.array(lengths, pa.int64()), pa.array([zlib.crc32(x) for x in each], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                yield pa.record_batch(cols + [pa.array(each, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def token_file_report(docs: DataFrame, tokenizer: str, end_id: int | None = 0, folder: str | None = None) -> DataFrame:
    """Write the token files, read them back, and return each document's place, length and checksum."""
    folder = folder or scratch_folder(docs.sparkSession, "token-files")
    write_tokens(docs, folder, tokenizer, end_id)
    return read_tokens(docs.sparkSession, folder, with_ids=False)
