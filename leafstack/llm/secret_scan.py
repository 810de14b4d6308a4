"""Secrets by patterns and by novelty: what a compressor that knows the surroundings still has to spell out.

Two passes over the texts. The first counts, over all documents, in how many each word of letters stands;
the most frequent words, DICTIONARY_BYTES of them (a parameter of the model: a word it lacks only looks a
little newer), and common words of code make the samples on which a zstandard dictionary is trained, contents
and letter statistics. The second looks for candidates: the pattern matches (assign, access, hex), and
every string of LEAST or more key characters with a run that mixes digits with letters, or cases, near a
word of SENSITIVE; whole texts, any number of them. A candidate's marginal size is what zstandard, primed
with the dictionary, needs for the surrounding text followed by the candidate beyond what it needs for the
surrounding text alone; the surroundings are the characters next to it, without other copies of it. Its
novelty is that size against what a random string of its classes of characters must take. Words, repeated
names and counts come out small, random strings at one or more. Candidates outside the pattern spans are
reported as `novel` from NOVELTY on.

Dictionary words are letters of one case or capitalised, so a secret that thousands of copies of a text
share can't enter it.

Defined cases: null text is empty; empty texts have no span; spans count code points, the end is
exclusive; rows that repeat are scanned one by one; a null doc_id stays null; an empty table gives no row
(its dictionary has the words of code alone); other columns are not read.
"""

from __future__ import annotations

import collections
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns and the least lengths of their matches; hex and access runs are maximal, so a shorter run holds no longer match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGNED = 8
KINDS = ["assign", "access", "hex", "novel"]
#: Words that make what stands near them a candidate.
SENSITIVE = re.compile(r"passw|passphrase|pwd|secret|token|api.?key|access.?key|private.?key|credential|auth|bearer|login|signature", re.IGNORECASE | re.ASCII)
#: Characters after and before a sensitive word in which a candidate may begin.
AFTER, BEFORE = 64, 48
LEAST = 12
KEY_CHARACTER = re.compile(r"[A-Za-z0-9+/_.=-]")
CANDIDATE = re.compile(KEY_CHARACTER.pattern + f"{{{LEAST},}}")
RUN = re.compile(r"[A-Za-z0-9]{8,}")
MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])|(?=.*[a-z].*[A-Z])")
#: Characters of surrounding text on either side; share of a random string's size from which a string counts as incompressible.
AROUND, NOVELTY = 200, 1.1
DICTIONARY_BYTES, LEVEL = 32_768, 3
#: Names of letters alone, and the words in them; parts of strings with digits are no words.
NAME = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z]{4,}(?![A-Za-z0-9+/=])")
WORD = re.compile(r"[A-Za-z]?[a-z]{3,24}|[A-Z]{4,24}")
WORDS_HELD = 200_000
#: Words of code that the dictionary knows beside the corpus's own.
CODE_WORDS = """config configuration manager customer identifier service handler client server session user name value index number length
default parameter request response header content type version path file folder example test string bytes array list object instance class
method function return import package module key token secret password address account message status result""".split()
#: Classes of characters by which a random string's size is counted.
CLASSES = [(re.compile(r"[0-9]"), 10), (re.compile(r"[a-z]"), 26), (re.compile(r"[A-Z]"), 26), (re.compile(r"[+/_.=-]"), 6)]
HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
SPANS = "array<struct<kind:string,start:long,end:long,novelty:double>>"


# --- the identifier dictionary ----------------------------------------------------------------------

def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: collections.Counter = collections.Counter()

    def rows() -> pa.RecordBatch:
        return pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column(0):
            held.update({word for name in set(NAME.findall(text.as_py() or "")) for word in WORD.findall(name)})
            if len(held) >= WORDS_HELD:
                yield rows()
                held.clear()
    if held:
        yield rows()


def identifier_dictionary(docs: DataFrame, dictionary_bytes: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary trained on the words that stand in most documents and on names made of words of code."""
    import zstandard
    counts = docs.select("text").mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # sorted ranges, of which only the first are read: a global sort with a limit would send the driver as many words from every task
    order = [F.col("n").desc(), F.col("word")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    best = counts.repartitionByRange(parts, *order).sortWithinPartitions(*order).limit(dictionary_bytes // 5).collect()     # a word takes five bytes or more
    words, size = [], 0
    for row in best:
        size += len(row.word) + 1
        if size > dictionary_bytes:
            break
        words.append(row.word)
    rng = random.Random(1)
    samples = [" ".join(words[at:at + 12]) for at in range(0, len(words), 12)]
    for k in range(400):
        one, two, three = rng.sample(CODE_WORDS, 3)
        samples.append(f"{one}_{two}_{three} {one}{two.title()}{three.title()} {k}")
    encoded = [x.encode() for x in samples]
    return zstandard.train_dictionary(min(dictionary_bytes, sum(map(len, encoded)) // 2), encoded, level=LEVEL).as_bytes()


# --- novelty ----------------------------------------------------------------------------------------

class Novelty:
    """Marginal compressed sizes of strings, primed with the dictionary."""

    def __init__(self, dictionary: bytes):
        import zstandard
        known = zstandard.ZstdCompressionDict(dictionary)
        known.precompute_compress(level=LEVEL)
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def marginal_bytes(self, text: str, start: int, end: int) -> int:
        """Bytes that text[start:end] adds to its surroundings."""
        what = text[start:end]
        around = (text[max(0, start - AROUND):start] + " " + text[end:end + AROUND]).replace(what, "").encode() + b" "
        return max(0, len(self.compress(around + what.encode())) - len(self.compress(around)))

    def of(self, text: str, start: int, end: int) -> float:
        """The marginal size of text[start:end] against that of a random string of its classes."""
        what = text[start:end]
        letters = 16 if HEX_ONLY.fullmatch(what) else sum(n for pattern, n in CLASSES if pattern.search(what))
        return 8 * self.marginal_bytes(text, start, end) / (len(what) * math.log2(letters))


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, order of the kind, kind, end, where the value starts) of the pattern matches."""
    found = [(m.start(), 0, "assign", m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    found += [(m.start(), 1, "access", m.end(), m.start()) for m in ACCESS.finditer(text)]
    return found + [(m.start(), 2, "hex", m.end(), m.start()) for m in HEX.finditer(text)]


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Strings of key characters that mix classes and begin near a sensitive word, each once, in order."""
    done = 0
    for near in SENSITIVE.finditer(text):
        at, last = max(done, near.start() - BEFORE), near.end() + AFTER
        while at > done and KEY_CHARACTER.match(text, at - 1):      # back to where the string under the edge begins
            at -= 1
        while m := CANDIDATE.search(text, at, last + LEAST):        # whether one begins there; then as far as it goes
            m = CANDIDATE.match(text, m.start())
            if any(MIXED.match(run) for run in RUN.findall(m[0])):
                yield m.span()
            at = done = m.end()


def spans(text: str, novelty: Novelty) -> list[dict]:
    """All spans of a text by start, then kind."""
    found = base_spans(text)
    taken = sorted((s, e) for s, _, _, e, _ in found)
    k = 0
    for start, end in candidates(text):
        while k < len(taken) and taken[k][1] <= start:      # candidates come in order
            k += 1
        covered = k < len(taken) and taken[k][0] < end      # of the spans not ended, the first begins first
        if not covered and novelty.of(text, start, end) >= NOVELTY:
            found.append((start, 3, "novel", end, start))
    return [{"kind": kind, "start": start, "end": end, "novelty": novelty.of(text, value, end)} for start, _, kind, end, value in sorted(found)]


def secret_spans(docs: DataFrame, dictionary: bytes | None = None) -> DataFrame:
    """Per row: doc_id, spans (kind, start, end, novelty). `dictionary`: of zstandard, else trained on the texts' words."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dictionary = dictionary or identifier_dictionary(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())]))
        for batch in batches:
            found = [spans(t.as_py() or "", novelty) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    return docs.mapInArrow(run, f"doc_id long, spans {SPANS}")


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel, most_novel (largest novelty of a span)."""
    found = secret_spans(docs)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(_listed(F.filter("spans", lambda s: s["kind"] != "novel")), 256).alias("base_sha256"),
                        _listed(F.col("spans")).alias("spans"), count("novel"), F.array_max(F.transform("spans", lambda s: s["novelty"])).alias("most_novel"))
