"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding: lower case, look-alike letters of other scripts to Latin ones, digits and signs that stand for
letters inside a word to those letters, and l to i (1 stands for either). Lexicon words count where they stand as whole words and not
inside an exception phrase. A text's weight is divided by a root of its length; a logistic curve turns
both into a score.

The lexicon is learned from labelled rows: a word's weight is its smoothed log odds between toxic and
other texts. Support is counted in distinct contexts (the word with both neighbours), so that copies of
one toxic text do not make all its words toxic, and a word is taken only if its contexts lean to toxic
texts more than chance allows among as many words (Chernoff's bound, Bonferroni). Rows are a sample by hash of at most `sample` labelled rows; word
counts are summed by Spark, the finished lexicon (at most `size` words) is sent to all tasks.

Defined cases: a null or empty text has no match and the lowest score; without labelled toxic rows the
lexicon is empty and all scores are 0; labels that contradict each other for one doc_id count as toxic;
rows with a null doc_id are not learned from and are not held out; repeated rows keep one result each;
lang, source, doc_id and labels are never inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafstack.llm.common import stored, worker_keeps

SAMPLE, SIZE, MIN_CONTEXTS, MIN_ODDS, ERROR = 20_000, 2_000, 3, 2.0, 0.1
#: Look-alikes of Latin letters (fixed values).
LOOK_ALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ӏ": "l",
               "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ο": "o", "ρ": "p", "ν": "v", "τ": "t", "ι": "i", "κ": "k", "ε": "e", "υ": "u",
               "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "ս": "u", "օ": "o"}
#: Digits and signs read as letters beside a letter (fixed values).
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
#: Harmless phrases with words that lexicons often hold (fixed values).
EXCEPTIONS = ("trash can", "trash bag", "trash talk", "clown fish", "clown car", "white trash bin", "idiot proof", "stupid simple", "scum line")

_FOLD = str.maketrans({"l": "i", "ӏ": "i"} | {k: "i" if v == "l" else v for k, v in LOOK_ALIKES.items()} | {chr(0xFF01 + k): "i" if k == 75 else chr(0x21 + k).lower() for k in range(94)} | {"​": None, "‌": None, "‍": None, "­": None})
#: Inside a word, or before two letters at its start.
_STAND_IN = re.compile(r"(?<=[^\W\d_])[0134578@$](?=[^\W\d_])|(?<![^\W_])[0134578@$](?=[^\W\d_]{2})")
WORD = re.compile(r"[^\W_]+")


def fold(text: str | None) -> str:
    low = (text or "").lower().translate(_FOLD)
    before = None
    while before != low:        # neighbours of a stand-in may be stand-ins
        before, low = low, _STAND_IN.sub(lambda m: STAND_INS[m[0]], low)
    return low


class Lexicon(NamedTuple):
    weights: dict[str, float]
    exceptions: tuple[str, ...]
    curve: tuple[float, float, float]


class Matcher:
    """Sums the weights of lexicon words in folded texts."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick
        self.curve, self.auto = lexicon.curve, None
        phrases = {e for e in map(fold, lexicon.exceptions) if set(e.split()) & lexicon.weights.keys()}
        if lexicon.weights:
            self.auto = ahocorasick.Automaton()
            for w, x in lexicon.weights.items():
                self.auto.add_word(w, (len(w), x))
            for e in phrases:
                self.auto.add_word(e, (len(e), None))
            self.auto.make_automaton()

    def weight(self, folded: str) -> tuple[float, int]:
        """(sum of weights, number of matches)."""
        found, safe = [], []
        for end, (n, x) in self.auto.iter(folded) if self.auto is not None else ():
            start = end - n + 1
            if (start and folded[start - 1].isalnum()) or (end + 1 < len(folded) and folded[end + 1].isalnum()):
                continue
            (safe if x is None else found).append((start, end, x))
        hits = [x for a, b, x in found if not any(c <= a and b <= d for c, d, _ in safe)]
        return math.fsum(hits), len(hits)

    def score(self, weight: float, n_words: int) -> float:
        if weight <= 0:
            return 0.0
        a, b, c = self.curve
        z = a + b * math.log1p(weight) + c * math.log1p(1000 * weight / (n_words + 50))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def _matcher(words: tuple, exceptions: tuple, curve: tuple) -> Matcher:
    return worker_keeps(("lexicon", words, exceptions, curve), lambda: Matcher(Lexicon(dict(words), exceptions, curve)))


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the decimal id leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _word_rows(sample: DataFrame) -> DataFrame:
    """(word, before, after, toxic) of each distinct word and context of a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                w = WORD.findall(fold(text.as_py()))
                rows = list({*zip(w, ["", *w[:-1]], [*w[1:], ""], strict=True)})
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.record_batch([*(pa.array(c) for c in cols), pa.array([toxic] * len(rows), pa.int32())], ["word", "before", "after", "toxic"])

    return sample.mapInArrow(run, "word string, before string, after string, toxic int")


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression on two columns with a small ridge, rows balanced by class, by Newton's steps."""
    x = np.column_stack([np.ones(len(x)), x])
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    beta = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (share * (y - p)) - 0.5 * beta
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(3)
        step = np.linalg.solve(curve, slope)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, size: int = SIZE, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon from labels(doc_id, toxic), without held-out rows. At most `sample` rows and `size` words reach the driver."""
    marks = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts, _ = stored(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "toxicity-sample")
    n = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if not n.get(1) or not n.get(0):
        return Lexicon({}, tuple(exceptions), (0.0, 0.0, 0.0))
    rows = _word_rows(texts)
    counted = rows.groupBy("word", "before", "after").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    words = counted.groupBy("word").agg(F.count_if(F.col("t") > 0).alias("contexts"), F.count_if(F.col("t") == 0).alias("others"),
                                        F.sum("t").alias("t"), F.sum("c").alias("c"))
    words, _ = stored(words.where(F.col("contexts") + F.col("others") >= MIN_CONTEXTS), "toxicity-words")
    total = words.agg(F.sum("contexts").alias("toxic"), F.sum("others").alias("other"), F.count("*").alias("words")).first()
    if not total.toxic:
        return Lexicon({}, tuple(exceptions), (0.0, 0.0, 0.0))
    odds = F.log((F.col("t") + 0.5) / (n[1] + 1)) - F.log((F.col("c") + 0.5) / (n[0] + 1))
    p = (total.toxic + 1) / (total.toxic + total.other + 2)
    k, m = F.col("contexts"), F.col("contexts") + F.col("others")
    q = k / m
    lean = k * F.log(q / p) + F.when(q < 1, (m - k) * F.log((1 - q) / (1 - p))).otherwise(0.0)
    best = (words.where(k >= MIN_CONTEXTS).withColumn("odds", odds).where((F.col("odds") >= MIN_ODDS) & (q > p) & (lean >= math.log(total.words / ERROR)))
            .orderBy(F.desc("odds"), "word").limit(size).collect())
    weights = {r.word: float(r.odds) for r in best}
    # how the weights of the learning rows divide: the curve
    got = np.array([(r.toxic, r.weight, r.n_words) for r in _weights(texts, Lexicon(weights, tuple(exceptions), (0.0, 0.0, 0.0)), ["toxic"]).collect()])
    x = np.column_stack([np.log1p(got[:, 1]), np.log1p(1000 * got[:, 1] / (got[:, 2] + 50))])
    return Lexicon(weights, tuple(exceptions), _fit_curve(x, got[:, 0]))


def _weights(rows: DataFrame, lexicon: Lexicon, kept: list[str]) -> DataFrame:
    """`kept` columns, weight, n_matches, n_words and score of each row's text."""
    words, exceptions, curve = tuple(lexicon.weights.items()), lexicon.exceptions, lexicon.curve

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(words, exceptions, curve)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out = []
                for text in part.column(0):
                    folded = fold(text.as_py())
                    weight, matches = matcher.weight(folded)
                    n = len(folded.split())
                    out.append((weight, matches, n, matcher.score(weight, n)))
                cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.float64(), pa.int64(), pa.int64(), pa.float64()), strict=True)]
                yield pa.record_batch([*part.columns[1:], *cols], [*kept, "weight", "n_matches", "n_words", "score"])

    schema = ", ".join(f"{c} {t}" for c, t in rows.select(*kept).dtypes)
    return rows.select("text", *kept).mapInArrow(run, f"{schema}, weight double, n_matches long, n_words long, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **how) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted (1 from `threshold` on), weight and n_matches."""
    lexicon = learn(docs, labels, **how)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    done = _weights(rows, lexicon, ["doc_id"])
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
                       "weight", "n_matches")
