"""Small tables with every odd case, and brute-force versions to hold the operators against."""

from __future__ import annotations

import collections
import re

SF = "/root/testdata/sf0.001"
#: Names that operators use inside, as extra columns of an input.
CLASHES = ["doc", "row", "rows", "words", "text_hash", "fp", "label", "labels", "n", "p", "q", "path", "chunk", "h1", "keep", "size", "shard", "slot", "bucket",
           "place", "stratum", "n_words", "kept", "kept_text", "n_lines", "ids", "start", "score", "weight", "hash", "item_id", "offset", "toxic", "quality"]
WS = " \t\n\x0b\x0c\r"


def long_text() -> str:
    return " ".join(f"wort{k % 977}x{k % 31}" for k in range(40_000)) + "\n" + "\n".join(f"line number {k % 50} of many" for k in range(400))


def edge_rows() -> list[tuple]:
    base = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix potions in the old tower"
    return [
        (1, base), (2, base), (2, base), (3, base.upper()), (4, None), (5, ""), (6, " \n\t "), (None, "an orphan line that repeats\nsecond"), (7, "an orphan line that repeats\nthird\n\nthird"),
        (7, "another text under the same id\nthird line here"), (8, "All rights reserved. CC BY-NC 4.0\nReleased under the GNU General Public License, version 3"),
        (9, "é ö 你好　世界 <|endoftext|> it's 12,5 km  \n\n x"), (10, long_text()), (11, "one two three"), (12, "one two three"), (13, "A\nA\nA"), (14, "aaaaaaaaaaaa aaaa\naaaaaaaaaaaa aaaa"),
    ]


def docs_of(spark, rows, clashes: bool = True):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(d, t, ["en", "de", None][k % 3], ["a", None, "b"][k % 3], k) for k, (d, t) in enumerate(rows)],
                               "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit(f"other {c}").alias(c) for c in CLASHES)) if clashes else df


def key(line: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(WS))


def brute_lines(rows):
    """Per row (n_lines, n_dropped, kept text)."""
    order = lambda d: (d is None, d or 0)
    holders = collections.defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(order(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == order(d)]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_near(rows, percent: int = 75):
    """Per row (size of the set, smallest doc_id reachable)."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), 2**63), 2**63 if d is None else d)
    return [(len(s), None if low[find(i)] == 2**63 else low[find(i)]) for i, s in enumerate(sets)]


def brute_counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    times = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if times[tuple(w[i:i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def by_count(rows):
    return collections.Counter(rows)
