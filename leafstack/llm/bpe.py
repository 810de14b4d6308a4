"""BPE encoding and decoding with a pair occurrence index.

The chunks of a batch that the worker has not met yet are laid end to end as arrays of symbols with
links to their neighbours. An index maps each pair (by its merge rank) to all its positions. Active
ranks are taken in ascending order; all places of a rank are merged at once, and the pairs that arise on
either side are entered under their own ranks. Each rank is so one set of numpy operations, however many
words hold it. Pre-tokens are the byte-level pattern's; what added tokens match is taken out first.

Defined cases: a null text is empty and has no ids; repeated rows and null doc_ids keep one result per
row; other columns are not read. Runs of one letter merge from the left, as in the tokenizers library.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafstack.llm.common import returning, worker_keeps

#: Code points of text that are worked on together, and pieces that a worker remembers (two generations).
BATCH_CHARS = 4_000_000
PIECES_KEPT = 100_000
#: The byte-level pre-token pattern, a fixed value of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the rest from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Merges and token bytes of a byte-level BPE file."""

    def __init__(self, path: str):
        import regex
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, letters = file["model"], byte_letters()
        ids = model["vocab"]
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.size = max([*ids.values(), *self.added.values()]) + 1
        self.token_bytes = [b""] * self.size
        for token, i in ids.items():
            self.token_bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.added.items():
            self.token_bytes[i] = token.encode()
        self.byte_id = np.array([ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], dtype=np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([ids[a] for a, _ in merges], dtype=np.int64)
        right = np.array([ids[b] for _, b in merges], dtype=np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
        keys = left * self.size + right
        # a pair that is listed twice has the rank of its last line, as a map filled in order has
        last = len(keys) - 1 - np.unique(keys[::-1], return_index=True)[1]
        self.pair_keys, self.pair_ranks = keys[last], last
        self.twins = left == right
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, or -1."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)


def encode_pieces(pieces: list[bytes], vocab: Vocabulary) -> list[np.ndarray]:
    """The ids of each piece."""
    lengths = np.array([len(p) for p in pieces], dtype=np.int64)
    n = int(lengths.sum())
    if not n:
        return [np.zeros(0, dtype=np.int64) for _ in pieces]
    symbol = vocab.byte_id[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    ends = np.cumsum(lengths)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    full = ends[lengths > 0]
    after[full - 1] = -1
    before[full[full < n]] = -1
    here = np.flatnonzero(after >= 0)
    rank = np.full(n, -1, dtype=np.int64)       # of the pair that starts here
    rank[here] = vocab.ranks(symbol[here], symbol[after[here]])
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def enter(at: np.ndarray) -> None:
        """Put positions under the rank of the pair that starts there now."""
        at = at[rank[at] >= 0]
        if not len(at):
            return
        at = at[np.argsort(rank[at], kind="stable")]
        found = rank[at]
        cuts = np.flatnonzero(np.diff(found)) + 1
        for r, some in zip(found[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts), strict=True):
            if r in index:
                index[r].append(some)
            else:
                index[r] = [some]
                heapq.heappush(active, r)

    enter(here)
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        at = at[rank[at] == r]
        if vocab.twins[r] and len(at) > 1:
            # in a run of one symbol, every other place from the left
            starts = np.concatenate(([True], before[at[1:]] != at[:-1]))
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(starts, place, 0))) % 2 == 0]
        if not len(at):
            continue
        gone = after[at]
        symbol[at] = vocab.made[r]
        nxt = after[gone]
        after[at] = nxt
        has = nxt >= 0
        before[nxt[has]] = at[has]
        rank[gone] = -1
        symbol[gone] = -1
        rank[at[~has]] = -1
        right = at[has]
        rank[right] = vocab.ranks(symbol[right], symbol[after[right]])
        left = before[at]
        left = left[left >= 0]
        left = left[symbol[left] >= 0]
        rank[left] = vocab.ranks(symbol[left], symbol[after[left]])
        enter(np.unique(np.concatenate((right, left))) if len(left) else right)
    alive = np.flatnonzero(symbol >= 0)
    cut = np.searchsorted(alive, ends)
    ids = symbol[alive]
    return [ids[b:e] for b, e in zip(np.concatenate(([0], cut[:-1])).tolist(), cut.tolist(), strict=True)]


class Encoder:
    """Encodes batches of texts; keeps (number of ids, decimal ids, bytes of the tokens, ids as 32-bit integers) of pieces it has met."""

    def __init__(self, path: str):
        self.vocab = Vocabulary(path)
        self.known: dict[str, tuple[int, str, bytes, bytes]] = {}
        self.older: dict[str, tuple[int, str, bytes, bytes]] = {}

    def split(self, text: str) -> list[str]:
        """Pre-tokens; an added token is a piece of its own."""
        v = self.vocab
        if v.special is None or not v.special.search(text):
            return v.pattern.findall(text)
        out, at = [], 0
        for m in v.special.finditer(text):
            out += v.pattern.findall(text[at:m.start()])
            out.append(m[0])
            at = m.end()
        return out + v.pattern.findall(text[at:])

    def learn(self, pieces: set[str]) -> None:
        if len(self.known) > PIECES_KEPT:
            self.older, self.known = self.known, {}
        for p in pieces & self.older.keys():
            self.known[p] = self.older[p]
        new = [p for p in pieces if p not in self.known]
        token_bytes = self.vocab.token_bytes
        plain = [p for p in new if p not in self.vocab.added]
        for p, ids in zip(plain, encode_pieces([p.encode() for p in plain], self.vocab), strict=True):
            raw, ids = ids.astype("<i4").tobytes(), ids.tolist()
            self.known[p] = (len(ids), ",".join(map(str, ids)), b"".join(map(token_bytes.__getitem__, ids)), raw)
        for p in new:
            if p in self.vocab.added:
                i = self.vocab.added[p]
                self.known[p] = (1, str(i), token_bytes[i], np.array([i], dtype="<i4").tobytes())

    def batch(self, texts: list[str]) -> Iterator[tuple[int, str, str, np.ndarray]]:
        """Per text: number of ids, decimal ids joined by commas, the text decoded from the ids, and the ids."""
        split = [self.split(t) for t in texts]
        self.learn(set().union(*split))
        for pieces in split:
            got = list(map(self.known.__getitem__, pieces))
            yield (sum(g[0] for g in got), ",".join([g[1] for g in got]),
                   b"".join([g[2] for g in got]).decode("utf-8", errors="replace"),
                   np.frombuffer(b"".join([g[3] for g in got]), dtype="<i4"))


def encoder(path: str) -> Encoder:
    return worker_keeps(("bpe", path), lambda: Encoder(path))


def _groups(texts: list[str]) -> Iterator[list[str]]:
    held, chars = [], 0
    for t in texts:
        if held and chars + len(t) > BATCH_CHARS:
            yield held
            held, chars = [], 0
        held.append(t)
        chars += len(t)
    if held:
        yield held


def encode_decode(docs: DataFrame, tokenizer: str, with_text: bool = True) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, and with `with_text` ids and decoded text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for batch in batches:
            done = 0
            for texts in _groups([t or "" for t in batch.column(1).to_pylist()]):
                n, ids_hash, text_hash, ids, decoded = [], [], [], [], []
                for count, decimal, text, made in enc.batch(texts):
                    n.append(count)
                    ids_hash.append(sha(decimal))
                    text_hash.append(sha(text))
                    if with_text:
                        ids.append(made)
                        decoded.append(text)
                cols = [batch.column(0).slice(done, len(texts)), pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(text_hash)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_text:
                    cols += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded)]
                    names += ["ids", "decoded"]
                done += len(texts)
                yield pa.record_batch(cols, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_text
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(returning(run), schema)
