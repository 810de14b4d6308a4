"""Secret scan, whitening and prefix trie against brute force and on odd input."""

import collections
import hashlib
import math
import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafstack.llm import prefix_trie, secret_scan, whitening
from leafstack.llm.queries import LLM_ORACLES, LLM_QUERIES
from tests.compare import compare, duck
from tests.llm.cases import CLASHES, SF, by_count, docs_of, edge_rows


@pytest.fixture(scope="module", params=["sf0.001", "sf0.01"])
def folder(request):
    return SF.replace("sf0.001", request.param)


# --- secrets ----------------------------------------------------------------------------------------

LITERAL = {
    "assign": r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}


def brute_base(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(LITERAL["assign"], text) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(LITERAL["access"], text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(LITERAL["hex"], text) if len(m[0]) >= 32]
    return sorted(found)


def digest(found):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in found).encode()).hexdigest()


def brute_row(d, text):
    found = brute_base(text)
    kinds = collections.Counter(k for _, _, k, _ in found)
    return d, kinds["assign"], kinds["access"], kinds["hex"], digest(found)


def own_base(r):
    return ",".join(x for x in r.spans.split(",") if x and not x.startswith("novel"))


def odd_texts():
    rng = random.Random(4)
    bits = ["token", "Secret", "api_key", "APIKEY", "paſſword", "toKen", " = ", ":", '"', "'", "abc", "abcdefgh", "AKIA", "AKIA1234567890ABCD", "0123456789abcdef" * 2, "f" * 40, "é", " ", "\n", "password:token : abcdefghijk", "=="]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(3000)]


def test_secret_query_as_by_hand(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = LLM_QUERIES["op11_secret_scan"](spark, folder).collect()
    assert by_count((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == by_count(brute_row(*r) for r in docs)
    assert all(hashlib.sha256(own_base(r).encode()).hexdigest() == r.base_sha256 for r in got)


def test_secrets_of_odd_rows(spark):
    rows = edge_rows() + list(enumerate(odd_texts(), 100))
    got = secret_scan.secret_report(docs_of(spark, rows)).collect()
    assert by_count((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == by_count(brute_row(*r) for r in rows)
    assert secret_scan.secret_report(docs_of(spark, [])).collect() == []


PROSE = "the harvest was brought in before the rain and everybody helped to carry the baskets home "
NAMES = ["configuration_manager_v2", "customerIdentifier", "requestHandlerFactory", "xxxxxxxxxxxx1", "2024-01-02T10:00:00", "path/to/some/file_12.txt", "MAX_RETRY_COUNT_2"]


def planted(n=150):
    """(text, start, end) with a random string near a sensitive word, that no pattern matches."""
    rng = random.Random(6)
    out = []
    for k in range(n):
        letters = [string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "+/"][k % 3]
        what = "".join(rng.choices(letters, k=rng.choice([20, 24, 32, 40])))
        word = rng.choice(["login with bearer ", "the credential ", "Authorization header ", "his login is "])
        text = f"{k} {PROSE}{word}{what} and {PROSE}"
        out.append((text, text.index(what), text.index(what) + len(what)))
    return out


def test_random_strings_are_novel_and_names_are_not(spark):
    cases = planted()
    clean = [f"{k} {PROSE}login with bearer {name} and {PROSE}" for k, name in enumerate(NAMES)] + [f"{k} {PROSE}{w} and {PROSE}" for k, (w, s, e) in enumerate([("Xk29fjQ8zpLm3vTyWq0R", 0, 0)])]
    rows = [(k, t) for k, (t, _, _) in enumerate(cases)] + [(1000 + k, t) for k, t in enumerate(clean)] + [(2000 + k, f"{PROSE}{k}") for k in range(50)]
    got = {r.doc_id: r.spans for r in secret_scan.secret_report(docs_of(spark, rows)).collect()}
    hit = sum(got[k] == f"novel:{s}:{e}" for k, (_, s, e) in enumerate(cases))
    assert hit >= 0.95 * len(cases)
    assert all(not got[k] for k in got if k >= 1000)        # names, and a random string without a sensitive word near


def test_a_secret_in_many_copies_stays_novel(spark):
    what = "q7Zp0LmX4vRt9KsWb2Yc"
    rows = [(k, f"{PROSE} login with bearer {what} and {PROSE}") for k in range(500)]
    assert all(r.n_novel == 1 for r in secret_scan.secret_report(docs_of(spark, rows)).collect())


def test_many_candidates_in_a_long_text():
    novelty = secret_scan.Novelty(_dictionary())
    text = "token " * 50_000 + "x" * 200_000 + " bearer q7Zp0LmX4vRt9KsWb2Yc"
    assert [s["kind"] for s in secret_scan.spans(text, novelty)] == ["novel"]


def _dictionary():
    import zstandard
    return zstandard.train_dictionary(2000, [f"{a}_{b} {a.title()} {k}".encode() for k, (a, b) in enumerate((a, b) for a in secret_scan.CODE_WORDS for b in secret_scan.CODE_WORDS[:8])]).as_bytes()


# --- whitening --------------------------------------------------------------------------------------

def by_hand(rows, k=16):
    """Per (row's place, component): deviation, whitened; and n, eigenvalues, explained, from rows of vectors."""
    good = [(i, v) for i, (c, v) in enumerate(rows) if v is not None and all(e is not None and math.isfinite(e) for e in v)]
    x = {i: tuple(math.floor(64 * float(e)) + 1_000_000 for e in v) for i, v in good}
    fit = sorted(set(x.values()))
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array([[(n * e - t) / n for e, t in zip(v, s, strict=True)] for v in fit])
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    dev = {i: sum((n * a - t) ** 2 for a, t in zip(r, s, strict=True)) for i, r in x.items()}
    white = {i: np.array([(n * a - t) / n for a, t in zip(r, s, strict=True)]) @ u / np.sqrt(np.maximum(e, 1e-300)) for i, r in x.items()}
    return n, e, e / np.trace(v), dev, white


def vectors_of(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.select("*", *(F.lit(f"other {c}").alias(c) for c in [*CLASHES, "component", "whitened", "x", "at", "total"]))


def checked(got, rows, k=16):
    n, e, share, dev, white = by_hand(rows, k)
    kept = int((e > 1e-10 * e[0]).sum())
    by_id = collections.defaultdict(dict)
    for r in got:
        by_id[r.vec_id][r.component] = r
        assert (r.n, r.identity_error <= 1e-4) == (n, True) and abs(r.explained / share[r.component - 1] - 1) < 1e-9
    assert set(by_id) == {rows[i][0] for i in dev} and len(got) == kept * len(dev)
    sign = np.sign(sum(np.array([by_id[rows[i][0]][c + 1].whitened for c in range(kept)]) * white[i][:kept] for i in dev))
    for i, d in dev.items():
        mine = [by_id[rows[i][0]][c + 1] for c in range(kept)]
        assert {r.deviation for r in mine} == {d}
        assert np.abs(np.array([r.whitened for r in mine]) * sign - white[i][:kept]).max() < 1e-6


def test_whitening_query_as_by_hand(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    checked(LLM_QUERIES["op12_whitening"](spark, folder).collect(), rows)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=6).astype("float32").tolist()) for k in range(40)]
    rows = [(k, [*v[:5], v[0] + v[1]]) for k, v in rows]                       # hardly any variance in one direction
    bad = [(100, None), (101, [None] * 6), (102, [float("nan")] * 6), (103, [float("inf"), 1.0, 2.0, 3.0, 4.0, 5.0]), (104, [1.0, 2.0])]
    same = [(200 + k, rows[0][1]) for k in range(30)]                            # a third is one vector: fitted once
    got = whitening.whiten(vectors_of(spark, rows + bad + same)).collect()
    checked(got, rows + same)
    for few in ([], bad, same, [(1, [])]):
        assert whitening.whiten(vectors_of(spark, few)).collect() == []
    null = whitening.whiten(vectors_of(spark, [*rows, (None, rows[3][1])])).where("vec_id is null").collect()
    assert [r.component for r in sorted(null, key=lambda r: r.component)] == [1, 2, 3, 4, 5, 6]
    huge = whitening.whiten(vectors_of(spark, [*rows, (7000, [3e38] * 6)])).where("vec_id = 7000").collect()
    assert huge and all(r.deviation is None for r in huge)


@pytest.mark.parametrize("d", [1, 2, 7, 40])
@pytest.mark.parametrize("kind", ["spread", "equal", "threes", "two clusters", "negative", "zero"])
def test_slicing_against_a_library(d, kind):
    rng = np.random.default_rng(d)
    e = {"spread": rng.random(d), "equal": np.ones(d), "threes": np.repeat(rng.random((d + 2) // 3), 3)[:d], "two clusters": np.where(np.arange(d) < d // 2, 1, 1e-9) + 1e-11 * rng.random(d),
         "negative": rng.normal(size=d), "zero": np.zeros(d)}[kind]
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    v = (q * e) @ q.T
    v = (v + v.T) / 2
    want = np.linalg.eigvalsh(v)[::-1]
    for shift in rng.normal(size=20):
        assert whitening.eigenvalues_above(v, shift) == (want > shift).sum()
    got = whitening.Slicer(v).leading(min(16, d))
    if kind == "zero":
        assert got == []
        return
    u = np.array([x for _, x in got])
    assert np.abs(np.array([x for x, _ in got]) - want[:16]).max() < 1e-13 * max(1, np.abs(want).max())
    assert np.abs(u @ u.T - np.eye(len(got))).max() < 1e-12
    assert np.abs(v @ u.T - u.T * [x for x, _ in got]).max() < 1e-12


# --- prefix trie ------------------------------------------------------------------------------------

def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v, key=lambda z: z[:2])] for c, v in own.items()}
    seqs = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        seqs[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + mine[h:])
    members, kids = collections.defaultdict(list), collections.defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for s in members:
        if s:
            kids[s[:-1]].append(s)
    saved, leaves = {}, {}
    for s in sorted(members, key=len, reverse=True):
        saved[s] = sum(saved[k] for k in kids[s]) + (len(members[s]) - 1) * (len(s[-1][1].encode()) if s else 0)
        leaves[s] = sum(leaves[k] for k in kids[s]) or 1
    return by_count((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(kids[s]), leaves[s], saved[s],
                     hashlib.sha256(",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(s)))).encode()).hexdigest()) for s, m in members.items())


def talks_of(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.select("*", *(F.lit(f"other {c}").alias(c) for c in [*CLASHES, "depth", "weight", "k1", "h2", "place", "shared", "head", "named", "bytes"]))


def test_trie_as_sql(spark):
    ok, message = compare(spark, duck(SF), SF, "op13_prefix_trie", LLM_QUERIES["op13_prefix_trie"], LLM_ORACLES["op13_prefix_trie"])
    assert ok, message


def test_trie_query_as_by_hand(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert by_count(map(tuple, LLM_QUERIES["op13_prefix_trie"](spark, folder).collect())) == brute_trie(rows)


def test_trie_of_odd_rows(spark):
    rng = random.Random(8)
    rows = []
    for c in [*range(-12, 260)]:        # few words, so that prefixes and whole sequences come again; a third is one conversation
        n = rng.randrange(1, 14)
        mine = [("user", "same")] * 9 if c % 3 == 0 else [(rng.choice(["user", None, ""]), rng.choice(["a", "ü", "", None, "yes"])) for _ in range(n)]
        rows += [(c, None if t == 0 and c % 7 == 0 else t, r, x) for t, (r, x) in enumerate(mine)]
    rows += [(1000, t, "user", f"turn {t % 7}") for t in range(900)] + [(1001, t, "user", f"turn {t % 7}") for t in range(850)]     # one conversation of most turns
    rows += [(None, 1, "user", "nobody's"), (50, 3, "user", "a"), (50, 3, "user", "a")]
    got = prefix_trie.trie_nodes(talks_of(spark, rows), block_ids=7).collect()
    assert by_count(map(tuple, got)) == brute_trie(rows)
    assert prefix_trie.trie_nodes(talks_of(spark, [])).collect() == []
    assert by_count(map(tuple, prefix_trie.trie_nodes(talks_of(spark, [(7, 1, None, None)])).collect())) == brute_trie([(7, 1, None, None)])
