"""Quality rules with risk-controlled thresholds.

Each rule is a ratio of a document's counts with a fixed grid of cutoffs, from the most lenient to the
strictest. A cutoff may be used in a stratum only if the exact (Clopper-Pearson) upper bound of its false
rejection rate, from labelled good documents of that stratum, is at most `risk` divided by the number of
rules. The error level is divided by strata and rules (Bonferroni); within a rule cutoffs are tested in
the fixed order of the grid and testing stops at the first that fails, which needs no further correction.
So with probability 1 - delta, no stratum loses more than `risk` of its good documents to the rules.
Nothing is fitted on the labelled rows, the grids are given; all of them are holdout. Among certified
cutoffs the one with the largest (bad rejected - penalty x good rejected) is used, none if that is not
positive. Copies of a text count once, since the bound needs independent rows.

Defined cases: a null or empty text has no words and fails the base rule; a null stratum is a stratum of
its own, as is one without labels, where no rule is certified; a document labelled twice counts as bad if
either label is bad; null labels and labels of unknown documents count nowhere; repeated rows keep one
result each; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafstack.llm.common import returning, stored

SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_bangs"]
#: Rule: (numerator, denominator, cutoffs from lenient to strict). A document breaks a rule above the cutoff.
RULES: dict[str, tuple[str, str, tuple[float, ...]]] = {
    "symbols": ("n_symbols", "n_words", (1.5, 1.0, 0.75, 0.5, 0.35, 0.25, 0.18, 0.12, 0.08)),
    "dup_lines": ("n_dup_lines", "n_lines", (0.8, 0.65, 0.5, 0.4, 0.3, 0.2)),
    "repeat_words": ("n_repeat_words", "n_words", (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "upper_words": ("n_upper_words", "n_words", (0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.2, 0.12)),
    "bangs": ("n_bangs", "n_words", (1.5, 1.0, 0.7, 0.5, 0.35, 0.25, 0.15, 0.1)),
    "long_words": ("word_chars", "n_words", (30.0, 20.0, 15.0, 12.0, 10.0)),
}
RISK, DELTA, PENALTY = 0.03, 0.05, 20.0


# --- counts -----------------------------------------------------------------------------------------

def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that are found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids, _ = pd.factorize(np.array(words, dtype=object))
    _, pair = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)
    _, triple, times = np.unique(pair[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
    if len(times) == n - 2:
        return 0
    hit = times[triple] > 1
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k:n - 2 + k] |= hit
    return int(covered.sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text."""
    text = text or ""
    words = text.encode().split()       # bytes split at ASCII white space only
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (len(words), len(b"".join(words).decode()), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
            repeat_words(words), len(lines), sum(map(bytes.isupper, words)), text.count("!"))


def count_features(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, text_hash and COUNTS of each whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = [text_counts(t.as_py()) for t in part.column(3)]
                cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.record_batch([part.column(0), part.column(1), part.column(2), *cols], ["doc_id", "stratum", "text_hash", *COUNTS])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"),
                         F.xxhash64("text").alias("text_hash"), "text")
    return narrow.mapInArrow(returning(run, keeps=False), "doc_id long, stratum string, text_hash long, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


# --- certified cutoffs ------------------------------------------------------------------------------

def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), summed from exact terms."""
    if p <= 0:
        return 1.0
    if p >= 1:
        return float(k >= n)
    lp, lq = math.log(p), math.log1p(-p)
    terms = (math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * lp + (n - i) * lq for i in range(k + 1))
    return min(1.0, math.fsum(map(math.exp, terms)))


def certified(k: int, n: int, limit: float, level: float) -> bool:
    """Whether the exact upper bound of the rate, at error `level`, is at most `limit`."""
    return n > 0 and k < limit * n and binomial_cdf(k, n, limit) <= level


def _score(rule: str) -> Column:
    above, below, _ = RULES[rule]
    return F.col(above) / F.greatest(F.col(below), F.lit(1))


def choose_cutoffs(features: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, penalty: float = PENALTY) -> DataFrame:
    """(stratum, cutoffs map<rule, cutoff>) from labels(doc_id, quality): 1 good, 0 bad."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    once = (features.where(~base_failed()).join(marks, "doc_id").groupBy("stratum", "text_hash")
            .agg(F.min("quality").alias("quality"), *(F.first(c).alias(c) for c in COUNTS)))
    # per rule, how many cutoffs of the grid the document breaks; grids fall, so these are the last ones
    broken = [sum((_score(r) > c).cast("int") for c in grid).alias(r) for r, (_, _, grid) in RULES.items()]
    long = once.select("stratum", "quality", *broken).unpivot(["stratum", "quality"], list(RULES), "rule", "n_broken")
    table = long.groupBy("stratum", "quality", "rule", "n_broken").agg(F.count("*").alias("n"))
    n_strata = max(1, table.select("stratum").distinct().count())
    level, limit = delta / (n_strata * len(RULES)), risk / len(RULES)

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        cutoffs = {}
        for rule, own in rows.groupby("rule"):
            grid = RULES[rule][2]
            good, bad = own[own.quality == 1], own[own.quality == 0]
            best, n = 0.0, int(good.n.sum())
            for i, cutoff in enumerate(grid):
                k = int(good.n[good.n_broken >= len(grid) - i].sum())
                if not certified(k, n, limit, level):
                    break
                gain = int(bad.n[bad.n_broken >= len(grid) - i].sum()) - penalty * k
                if gain > best:
                    best, cutoffs[rule] = gain, cutoff
        return pd.DataFrame({"stratum": [rows.stratum.iloc[0]], "cutoffs": [cutoffs]})

    return table.groupBy("stratum").applyInPandas(pick, "stratum string, cutoffs map<string,double>")


def judge(features: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """`features` with base_failed, broken (names of the rules broken) and kept."""
    cutoffs = cutoffs.select(F.col("stratum").alias("of"), "cutoffs")
    both = features.join(cutoffs, F.col("stratum") == F.col("of"), "left")
    broken = F.array_compact(F.array(*(F.when(_score(r) > F.col("cutoffs")[r], F.lit(r)) for r in RULES)))
    return (both.withColumn("base_failed", base_failed()).withColumn("broken", broken)
            .withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0)).drop("of", "cutoffs"))


def quality_report(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **how) -> DataFrame:
    """Counts, base_failed, kept and the broken rules of each document."""
    features, _ = stored(count_features(docs, stratum), "quality-counts")
    cutoffs, _ = stored(choose_cutoffs(features, labels, **how), "quality-cutoffs")
    return judge(features, cutoffs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                           "base_failed", "kept", F.array_join("broken", ",").alias("broken"), "text_hash")
