"""Benchmark decontamination by template canonicalisation.

Words are lower-cased without the punctuation around them; numbers, names (capitals inside a sentence)
and units become typed placeholders. All windows of `window` canonical words of a document are joined by
hash to those of the benchmark items; items under three windows also by windows of SHORTEST words, so that
a word changed in the middle does not hide them. One window makes a candidate. Runs of equal words on
neighbouring diagonals are then merged into one alignment, so words put in, left out or changed only cost
themselves. A document holds an item if the alignment covers enough of it, or has an unbroken run of RUN
words, and the slots are consistent: each value of the item stands for one value in the document wherever
it comes again. So a question whose numbers and names were exchanged is found, and a text that shares only
its shape is not.

Up to BROADCAST_WINDOWS benchmark windows are sent to all tasks, and only windows that meet one leave
them; more are joined by a shuffle. Hashes leave a document's row without its text; only candidates' texts
are read again for the check, once for about ITEMS_TOGETHER of its items. Alignments work through slices
of diagonals, so a long text of numbers needs no more memory than its words.

Defined cases: null or empty texts and items match nothing; an item shorter than the window is one
window; windows that are mostly placeholders, windows with names and items under SHORTEST words are also
joined by their bare words, so every verbatim copy is found; what only those join must have enough of the
item's bare words, a short item all of them, and an item of one word is in every text with that word; a null doc_id or item_id is kept; repeated rows give repeated pairs; other columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import re
import struct
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafstack.llm.common import BROADCAST_ROWS, returning, stored, worker_keeps

WINDOW, COVERAGE, AGREEMENT = 8, 0.5, 0.9
#: Words of a window that must not be placeholders, and the shortest item whose slots may differ.
LITERAL, SHORTEST = 4, 5
#: Equal words in a row that are enough by themselves, the shortest run in an alignment, and how far diagonals of one alignment lie apart at least.
RUN, SHORTEST_RUN, BAND = 40, 3, 8
BROADCAST_WINDOWS = 500_000
WORDS_KEPT = 400_000
#: Bytes of texts whose windows are made in one go, items of a document checked in one row, cells of an alignment held at once.
TOGETHER, ITEMS_TOGETHER, SLICE = 2_000_000, 200, 2_000_000
#: Words on either side that tell whether a capital marks a name.
NEAR = 4
#: Spelled numbers and units that become placeholders (fixed values).
NUMBER_WORDS = frozenset("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
                         "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
UNITS = frozenset("mm cm m km in inch inches ft foot feet yd mi mile miles mg g kg t lb lbs oz ml l litre litres liter liters gallon gallons s sec "
                  "second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kmh km/h m/s % percent "
                  "dollar dollars cent cents euro euros pound pounds usd eur gbp watt watts kw kwh volt volts hz celsius fahrenheit degree degrees".split())
_NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*(st|nd|rd|th)?")
_NUMBER_UNIT = re.compile(r"[$€£]?[+-]?\d[\d.,]*([a-z%/]+)")
_PLACE = np.random.default_rng(8).integers(0, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
NUM, NAME, UNIT, MEASURE = "<number>", "<name>", "<unit>", "<measure>"
#: Of each word: hashes of its canonical form and of the bare word, and bits: 1 capital, 2 ends a sentence, 4 number or unit, 8 empty.
_RECORD = np.dtype([("h", "<u8"), ("bits", "<u8"), ("raw", "<u8")])
_PACK = struct.Struct("<QQQ").pack


_hash = xxhash.xxh3_64_intdigest


def canonical(word: str) -> tuple[str, str, int]:
    """(canonical form without regard to names, bare word, bits) of a word between white space."""
    bare = word.strip(".,;:!?()[]{}\"'“”‘’«»¿¡…-")
    low = bare.lower()
    bits = (1 if bare[:1].isupper() else 0) | (2 if word.rstrip("\"'”’»)")[-1:] in (".", "!", "?", ":") else 0)
    if low.isalpha() and low not in NUMBER_WORDS and low not in UNITS:      # nearly all
        return low, low, bits
    if not bare:
        return "", "", bits | 8
    if _NUMBER.fullmatch(low) or low in NUMBER_WORDS:
        return NUM, low, bits | 4
    if low in UNITS or bare == "%":
        return UNIT, low, bits | 4
    if (m := _NUMBER_UNIT.fullmatch(low)) and m[1] in UNITS:
        return MEASURE, low, bits | 4
    return low, low, bits


class WordRecords(dict):
    """Records of words; a worker keeps those it has met."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= WORDS_KEPT:
            self.clear()
        form, low, bits = canonical(word.decode())
        got = self[word] = _PACK(_hash(form), bits, _hash(low))
        return got


def word_records() -> WordRecords:
    return worker_keeps("word records", WordRecords)


def _raw_words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _counts(marked: np.ndarray) -> np.ndarray:
    """How many are marked before each place, and in all."""
    return np.concatenate(([0], np.cumsum(marked)))


def forms(words: list[bytes], names: bool = True, starts: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(hash, whether a placeholder, place among all words, hash of the bare word, whether a name) of the canonical words; without `names` those stay words.

    `starts` are the places where texts begin, if words are those of several texts; no text looks into the next.
    """
    got = np.frombuffer(b"".join(map(word_records().__getitem__, words)), dtype=_RECORD)
    bits = got["bits"]
    ended = np.empty(len(got), dtype=bool)
    ended[:1] = True
    ended[1:] = bits[:-1] & 2 > 0
    capital = bits & 1 > 0
    # among capitals (a headline, shouting) a capital tells nothing
    sums = _counts(capital)
    asked = capital & (bits & 4 == 0) if names else np.zeros(len(got), dtype=bool)
    starts = np.zeros(1, dtype=np.int64) if starts is None else starts
    ended[starts[starts < len(got)]] = True
    asked = np.flatnonzero(asked & ~ended)
    text = np.searchsorted(starts, asked, side="right")
    lo = np.maximum(asked - NEAR, starts[text - 1])
    hi = np.minimum(asked + NEAR + 1, np.append(starts, len(got))[text])
    name = np.zeros(len(got), dtype=bool)
    name[asked] = 2 * (sums[hi] - sums[lo]) <= hi - lo
    keep = np.flatnonzero(bits & 8 == 0)
    h = np.where(name, np.uint64(_hash(NAME)), got["h"])
    return h[keep], (name | (bits & 4 > 0))[keep], keep, got["raw"][keep], name[keep]


def _finished_hash(out: np.ndarray) -> np.ndarray:
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(32))


def _window_sums(h: np.ndarray, sizes: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(size, hash of each window of that size), sizes ascending, from one running sum."""
    out, done = np.zeros(len(h), dtype=np.uint64), 0
    for size in sorted(sizes):
        n = max(0, len(h) - size + 1)
        out = out[:n]
        for k in range(done, size):
            out += h[k:k + n] * _PLACE[k]
        done = size
        yield size, _finished_hash(out)


def _usable(slot: np.ndarray, size: int) -> np.ndarray:
    """Whether each window has enough words that are not placeholders."""
    sums = _counts(slot)
    return size - (sums[size:] - sums[:-size]) >= min(LITERAL, (size + 1) // 2)


def window_hashes(h: np.ndarray, slot: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """One hash per window; 0 where the window has too few words that are not placeholders."""
    if len(h) < window:
        return np.zeros(0, dtype=np.int64)
    (_, found), = _window_sums(h, [window])
    return np.where(_usable(slot, window), found, np.uint64(0)).view(np.int64)


def bare_windows(raw: np.ndarray, window: int) -> np.ndarray:
    """One hash per window of bare words; where no word is a placeholder, the same as the canonical one."""
    return window_hashes(raw, np.zeros(len(raw), dtype=bool), window)


class Wanted:
    """Hashes to look for. A bit table over their low bits passes over most others, the sorted hashes decide."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        bits = max(16, int(16 * len(self.sorted)).bit_length())
        self.mask = np.uint64(2**bits - 1)
        self.table = np.zeros(2**bits, dtype=bool)
        self.table[self.sorted.view(np.uint64) & self.mask] = True

    def places(self, found: np.ndarray) -> np.ndarray:
        """Places of `found` (unsigned) whose hash is wanted."""
        maybe = np.flatnonzero(self.table[found & self.mask])
        return maybe[np.isin(found[maybe].view(np.int64), self.sorted)]


def _windows_of_texts(texts: list[str | None], wanted: dict[int, Wanted | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, number of the text, hash) of the distinct wanted windows of texts: canonical ones, and bare ones where those are few or hold a name.

    Texts go together, so that short ones cost no calls of their own. Without a `Wanted` all windows count.
    """
    words = [_raw_words(t) for t in texts]
    ends = np.cumsum([len(w) for w in words])
    h, slot, place, raw, name = forms(list(itertools.chain.from_iterable(words)), starts=np.concatenate(([0], ends[:-1])))
    text = np.searchsorted(ends, place, side="right")
    for (size, canon), (_, bare) in zip(_window_sums(h, wanted), _window_sums(raw, wanted), strict=True):
        if not len(canon):
            continue
        inside = text[size - 1:] == text[:len(canon)]
        usable = _usable(slot, size)
        names = _counts(name)
        also = ~usable | (names[size:] > names[:-size])
        look = wanted[size]
        at = [np.flatnonzero(inside & use) if look is None else (hit := look.places(found))[(inside & use)[hit]] for found, use in ((canon, usable), (bare, also))]
        both = np.empty(len(at[0]) + len(at[1]), dtype=[("text", "<i8"), ("hash", "<u8")])
        both["text"], both["hash"] = np.concatenate([text[x] for x in at]), np.concatenate((canon[at[0]], bare[at[1]]))
        both = np.unique(both)
        yield size, both["text"], both["hash"].view(np.int64)


def document_windows(docs: DataFrame, wanted: dict[int, np.ndarray | None]) -> DataFrame:
    """(doc_id, text_hash, size, w) of the distinct windows of each row that are wanted: by size the hashes, None for all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = {size: None if hashes is None else Wanted(hashes) for size, hashes in wanted.items()}
        for part in _parts(batches):
            for size, text, w in _windows_of_texts(part.column(2).to_pylist(), look):
                yield pa.record_batch([part.column(0).take(pa.array(text)), part.column(1).take(pa.array(text)), pa.array(np.full(len(w), size, dtype=np.int32)), pa.array(w)],
                                      ["doc_id", "text_hash", "size", "w"])

    return _told_apart(docs).mapInArrow(returning(run), "doc_id long, text_hash long, size int, w long")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose texts hold about TOGETHER bytes, at least one row; the third column is the text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, side="right")))
            yield batch.slice(at, to - at)
            at = to


def _told_apart(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, size, q, n_windows, hash, bare) of the items' windows; n_windows counts those that are not bare."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                # names as placeholders, and as words for documents without capitals or of capitals only
                both = [forms(_raw_words(text), names)[:2] for names in (True, False)]
                raw = forms(_raw_words(text))[3]
                words = len(raw)
                if not words:
                    continue
                for size in sorted({min(window, words), min(window, words, SHORTEST if words < 3 * window else window)}):
                    found = [window_hashes(h, slot, size) for h, slot in both]
                    places = {(int(q), int(f[q])) for f in found for q in np.flatnonzero(f)}
                    usable = len({q for q, _ in places})
                    rows += [(item, size, q, usable, h, words < SHORTEST) for q, h in sorted(places)]
                    rows += [(item, size, q, usable, h, True) for q, h in enumerate(bare_windows(raw, size).tolist()) if (q, h) not in places]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["item_id", "size", "q", "n_windows", "hash", "bare"])

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(
        run, "item_id long, size int, q int, n_windows int, hash long, bare boolean")


class Words:
    """A text's words, canonical with and without names, for alignments; made once however many items it meets."""

    def __init__(self, text: str | None):
        self.raw = _raw_words(text)
        self.h, self.slot, self.place, self.bare, _ = forms(self.raw)
        self.plain = forms(self.raw, False)[0]

    def __len__(self) -> int:
        return len(self.h)

    def value(self, at: int) -> str:
        return canonical(self.raw[self.place[at]].decode())[1]

    @functools.cached_property
    def windows(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        return {}

    def all_windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """All windows, with and without names; a place is judged by its words, so none is left out."""
        if size not in self.windows:
            self.windows[size] = bare_windows(self.h, size), bare_windows(self.plain, size)
        return self.windows[size]


def _chosen(q: np.ndarray, p: np.ndarray, n: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """(item place, document place, length) of those runs of equal words that make one alignment, the longest first chosen."""
    order, chosen = np.argsort(-n, kind="stable"), []
    q, p, n = q[order], p[order], n[order]
    while len(n):
        at, to, long = int(q[0]), int(p[0]), int(n[0])
        chosen.append((at, to, long))
        q, p, n = q[1:], p[1:], n[1:]
        # the others lose what stands over or across the chosen run
        after, before = (q >= at) & (p >= to), (q <= at) & (p <= to)
        cut = np.where(after, np.maximum(np.maximum(at + long - q, to + long - p), 0), 0)
        n = np.where(after, n - cut, np.where(before, np.minimum(n, np.minimum(at - q, to - p)), 0))
        left = n >= shortest
        q, p, n = (q + cut)[left], (p + cut)[left], n[left]
    return sorted(chosen)


def _runs(doc: Words, item: Words, first: int, last: int) -> list[tuple[int, int, int]]:
    """The alignment of the diagonals first to last, from slices of so many of them as make SLICE cells."""
    shortest, k = min(SHORTEST_RUN, len(item)), np.arange(len(item))
    found, step = [], max(1, SLICE // len(item))
    for low in range(first, last + 1, step):
        at = np.arange(low, min(low + step, last + 1))[:, None] + k
        inside = (at >= 0) & (at < len(doc))
        at = np.clip(at, 0, len(doc) - 1)
        same = ((doc.h[at] == item.h) | (doc.plain[at] == item.plain)) & inside
        edge = np.diff(np.pad(same, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (d, q), (_, end) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        long = np.flatnonzero(end - q >= shortest)
        found.append((q[long].astype(np.int32), (d[long] + q[long] + low).astype(np.int32), (end[long] - q[long]).astype(np.int32)))
    return _chosen(*(np.concatenate(x) for x in zip(*found, strict=True)), shortest)


def alignments(doc: Words, item: Words) -> Iterator[tuple[int, float, int, float, int, float]]:
    """(start word, share of equal words, longest run, share of consistent slots, slots, share of equal bare words) of each place where the item can stand in the document."""
    if not len(doc) or not len(item):
        return
    size, here = min(SHORTEST, len(item)), np.zeros(len(doc) + len(item), dtype=bool)
    for theirs, mine in zip(doc.all_windows(size), item.all_windows(size), strict=True):
        met = np.flatnonzero(np.isin(theirs, mine))
        for q, w in enumerate(mine.tolist()):
            here[met[theirs[met] == w] - q + len(item)] = True
    offs = np.flatnonzero(here) - len(item)
    for part in np.split(offs, np.flatnonzero(np.diff(offs) > max(BAND, len(item) // 4)) + 1) if len(offs) else ():
        runs = _runs(doc, item, int(part[0]), int(part[-1]))
        if not runs:
            continue
        pairs = [(item.value(q + j), doc.value(p + j)) for q, p, n in runs for j in range(n) if item.slot[q + j]]
        best: Counter = Counter()
        for (value, _), n in Counter(pairs).items():
            best[value] = max(best[value], n)
        yield (runs[0][1] - runs[0][0], sum(n for _, _, n in runs) / len(item), max(n for _, _, n in runs),
               sum(best.values()) / len(pairs) if pairs else 1.0, len(pairs),
               sum(int((item.bare[q:q + n] == doc.bare[p:p + n]).sum()) for q, p, n in runs) / len(item))


def slot_check(doc: Words, item: Words, bare: bool = False, coverage: float = COVERAGE, agreement: float = AGREEMENT) -> tuple[int, float, float, int, bool]:
    """(start word, share of equal words, share of consistent slots, slots, whether held to be a copy) of the best of `alignments`.

    With `bare` the words themselves must be there, of a short item all.
    """
    need = 1.0 if len(item) < SHORTEST else coverage

    def held(x) -> bool:
        return x[3] >= agreement and (x[1] >= coverage or x[2] >= RUN) and (not bare or x[5] >= need * (x[1] if x[2] >= RUN else 1))

    got = max(((held(x), x[1], x) for x in alignments(doc, item)), default=(False, 0.0, (0, 0.0, 0, 0.0, 0, 0.0)))
    return got[2][0], got[2][1], got[2][3], got[2][4], got[0]


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, agreement: float = AGREEMENT) -> DataFrame:
    """(doc_id, text_hash, item_id, coverage, slots, slot_agreement, start_word) of the pairs that are held to be copies."""
    items, _ = stored(item_windows(benchmark, window), "item-windows")
    sizes = [r["size"] for r in items.select("size").distinct().collect()] or [window]      # at most `window` values
    one = items.select(F.col("size").alias("i_size"), "hash", "item_id", "q", "n_windows", "bare")
    wanted = dict.fromkeys(sizes)
    if items.count() <= BROADCAST_WINDOWS:
        # so few hashes go to the tasks, and only windows that meet one leave them
        one = F.broadcast(one)
        known = items.select("size", "hash").distinct().toPandas()
        wanted = {size: known.loc[known["size"] == size, "hash"].to_numpy(dtype=np.int64) for size in sizes}
    each = document_windows(docs, wanted)
    met = each.join(one, (each["w"] == one["hash"]) & (each["size"] == one["i_size"]))
    votes = met.select("doc_id", "text_hash", "item_id", "size", "n_windows", "q", "bare").distinct()
    share = votes.groupBy("doc_id", "text_hash", "item_id", "size").agg((F.count(F.when(~F.col("bare"), 1)) / F.greatest(F.first("n_windows"), F.lit(1))).alias("coverage"))
    likely = share.groupBy("doc_id", "text_hash", "item_id").agg(F.max("coverage").alias("coverage"))
    # a document's items go with its text in lists of about ITEMS_TOGETHER, so a preamble of k items does not copy the text k times
    asked = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").alias("item_text"))
    likely = likely.join(asked, F.col("item_id").eqNullSafe(F.col("i"))).drop("i")
    own = Window.partitionBy("doc_id", "text_hash")
    lot = F.pmod(F.xxhash64("item_id"), F.ceil(F.count("*").over(own) / ITEMS_TOGETHER))
    lists = likely.withColumn("lot", lot).groupBy("doc_id", "text_hash", "lot").agg(F.collect_list(F.struct("item_id", "coverage", "item_text")).alias("asked"))
    lists, _ = stored(lists.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "asked"), "contamination-candidates")
    ids = lists.select("d", "t").distinct()
    texts = _told_apart(docs)
    here = texts["doc_id"].eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))
    # the texts of candidates alone are shuffled to their lists
    texts = texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, here, "left_semi")
    both = texts.join(lists, texts["doc_id"].eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))).select("doc_id", "text_hash", "text", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc, rows = Words(batch.column(2)[k].as_py()), []
                for x in batch.column(3)[k].as_py():
                    # no coverage: only bare words have met
                    rows.append((batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), x["item_id"], x["coverage"],
                                 *slot_check(doc, Words(x["item_text"]), not x["coverage"], coverage, agreement)))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.bool_())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                      ["doc_id", "text_hash", "item_id", "coverage", "start_word", "equal_words", "slot_agreement", "slots", "held"])

    checked = both.mapInArrow(run, "doc_id long, text_hash long, item_id long, coverage double, start_word int, equal_words double, slot_agreement double, slots long, held boolean")
    return checked.where("held").drop("held")


def contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """(doc_id, text_hash) of the documents that hold an item."""
    return contaminated_pairs(docs, benchmark, **how).select("doc_id", "text_hash").distinct()
