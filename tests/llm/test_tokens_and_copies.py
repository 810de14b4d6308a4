"""Token files, BPE, near-dedup, decontamination and the pipeline against brute force and on odd input."""

import collections
import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pytest

import corpus_pipeline
from leafstack.llm import bpe, decontaminate, near_dedup, quality_rules, token_files
from leafstack.llm.common import Tables
from leafstack.llm.components import components
from leafstack.llm.queries import LLM_QUERIES, TOKENIZER
from leafstack.session import scratch_folder
from tests.llm.cases import SF, brute_counts, brute_lines, brute_near, by_count, docs_of, edge_rows


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(TOKENIZER)


def given(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


# --- token files ------------------------------------------------------------------------------------

def test_coding_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype("<u4")
        control, data = token_files.pack(ranks)
        assert (token_files.unpack(control, data, n) == ranks).all()
        assert len(control) == -(-n // 4) and len(data) == sum(max(1, -(-int(r).bit_length() // 8)) for r in ranks)


def test_token_files_query(spark, library):
    at = 0
    got = {r.doc_id: r for r in LLM_QUERIES["op1_token_files"](spark, SF).collect()}
    for d, t in sorted(given(spark)):
        ids = library.encode(t, add_special_tokens=False).ids + [0]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_files_of_odd_rows(spark, library):
    folder = scratch_folder(spark, "test-tokens")
    token_files.write_tokens(docs_of(spark, edge_rows()), folder, TOKENIZER, block_ids=50)
    got = sorted(token_files.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    want = [(d, library.encode(t or "", add_special_tokens=False).ids + [0]) for d, t in edge_rows()]
    assert by_count((r.doc_id, bytes(r.ids)) for r in got) == by_count((d, np.array(i, "<u4").tobytes()) for d, i in want)
    assert [r.doc_id for r in got] == sorted((d for d, _ in want), key=lambda d: (d is not None, d))
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert token_files.token_file_report(docs_of(spark, []), TOKENIZER).collect() == []


# --- BPE --------------------------------------------------------------------------------------------

def test_bpe_is_the_library(library):
    rng = random.Random(2)
    texts = [t or "" for _, t in edge_rows()] + ["".join(rng.choice("ab éÖ\n!1'st .,\t\r÷½ªÿ-_\xa0你“") for _ in range(rng.randrange(50))) for _ in range(2000)]
    texts += ["aaaaaaa", "aaaaaaaaaaaaaaaaa bbbbbbbb", "<|endoftext|>", "x<|endoftext|><|endoftext|> y"]
    from leafstack.llm.tokens import chunk_ids
    chunks = chunk_ids(TOKENIZER, "<u2")
    for t, (n, decimal, decoded, ids) in zip(texts, bpe.encoder(TOKENIZER).batch(texts), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert (n, decimal, ids.tolist()) == (len(want), ",".join(map(str, want)), want)
        assert decoded == library.decode(want, skip_special_tokens=False) == t
        assert np.frombuffer(chunks.ids(t), "<u2").tolist() == want


def test_bpe_query(spark, library):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for d, t in given(spark):
        ids = library.encode(t, add_special_tokens=False).ids
        want[d] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in LLM_QUERIES["op3_bpe"](spark, SF).collect()} == want


def test_bpe_of_odd_rows(spark):
    got = bpe.encode_decode(docs_of(spark, edge_rows()), TOKENIZER).collect()
    assert by_count((r.doc_id, r.decoded) for r in got) == by_count((d, t or "") for d, t in edge_rows())
    assert all(len(r.ids) == r.n_tokens for r in got)
    assert bpe.encode_decode(docs_of(spark, []), TOKENIZER).collect() == []


# --- near-dedup -------------------------------------------------------------------------------------

def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 99), (200, 201), (201, 202)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"))[0].collect()}
    assert got == {**dict.fromkeys(range(41), 0), 99: 99, 100: 99, 200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long"))[0].collect() == []


def test_near_query_as_by_hand(spark):
    rows = given(spark)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in LLM_QUERIES["op10_near_dedup"](spark, SF).collect()}
    assert got == {d: (n, c, c == d) for (d, _), (n, c) in zip(rows, brute_near(rows), strict=True)}


@pytest.mark.parametrize("leaf", [24, near_dedup.LEAF])
def test_large_group_of_near_copies(spark, leaf):
    rng = random.Random(1)
    base = [f"word{k}" for k in range(120)]
    rows = []
    for k in range(260):        # one group that branches again and again, and a chain beside it
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(120)] = f"new{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    chain = [f"link{k}" for k in range(200)]
    rows += [(1000 + k, " ".join(chain[4 * k:4 * k + 100])) for k in range(20)]
    rows += [(2000 + k, " ".join(f"lone{k}x{i}" for i in range(30))) for k in range(20)] + [(3000, rows[5][1])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs_of(spark, rows), leaf=leaf).collect()}
    assert got == {d: x for (d, _), x in zip(rows, brute_near(rows), strict=True)}


def test_pairs_inside_a_crowd(spark):
    """A thousand documents share a long passage (similarity about 0.70); among them are pairs over 0.75."""
    rng = random.Random(7)
    passage = [f"pass{k}" for k in range(112)]
    own = lambda k: [f"own{k}x{i}" for i in range(24)]
    rows = [(k, " ".join(passage + own(k))) for k in range(1000)]
    for k in range(60):         # like document k, with a few of its own words changed
        w = own(k)
        w[-10:] = [f"pair{k}x{i}" for i in range(10)]
        rows.append((2000 + k, " ".join(passage + w)))
    rng.shuffle(rows)
    want = {d: k for k in range(1000) for d in (k, 2000 + k)}
    a, b, c = ({tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (dict(rows)[d].split() for d in (0, 2000, 1)))
    assert 0.65 < len(a & c) / len(a | c) < 0.75 <= len(a & b) / len(a | b)
    got = near_dedup.near_duplicates(docs_of(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: want[d] for d, _ in rows}


@pytest.mark.parametrize("outsider", ["larger id", "similar to none"])
def test_work_on_near_copies_and_an_outsider_is_in_proportion(spark, monkeypatch, outsider):
    """n near copies (95 shared shingles, 5 of their own) and one document that shares their passage only."""
    made = {}
    plain_keep = Tables.keep

    def keep(self, df, name):
        out = plain_keep(self, df, name)
        if name.endswith(("pairs", "members", "level")):
            made[n] = made.get(n, 0) + out.count()
        return out

    monkeypatch.setattr(Tables, "keep", keep)
    passage = [f"pass{k}" for k in range(95)]
    other = [f"out{k}" for k in range(40)] if outsider == "larger id" else [f"out{k}" for k in range(200)]
    for n in (1000, 4000):
        rows = [(k, " ".join([*passage, *(f"own{k}x{i}" for i in range(4))])) for k in range(n)] + [(10**6, " ".join(passage + other))]
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs_of(spark, rows)).collect()}
        assert got == {**dict.fromkeys(range(n), 0), 10**6: 10**6}
    assert made[4000] < 5 * made[1000]


def test_trees_follow_from_depth():
    for deep in (1, 3, 6, 10):
        n = near_dedup.trees_for(0.99, 75, deep)
        assert 1 - (1 - 0.75**deep) ** n >= 0.99 > 1 - (1 - 0.75**deep) ** (n - 1)


def test_near_of_odd_rows(spark):
    rows = edge_rows()
    got = near_dedup.near_duplicates(docs_of(spark, rows)).collect()
    want = by_count((d, n, c if n else d) for (d, _), (n, c) in zip(rows, brute_near(rows), strict=True))
    assert by_count((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert near_dedup.near_duplicates(docs_of(spark, [])).collect() == []


# --- decontamination --------------------------------------------------------------------------------

def plain(text):
    return " ".join((text or "").lower().split())


def test_verbatim_copies(spark):
    items = [(r.item_id, plain(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {(d, i) for d, t in given(spark) for i, x in items if x in plain(t)}
    assert {(r.doc_id, r.item_id) for r in LLM_QUERIES["op5_decontamination"](spark, SF).collect()} == want and want


def test_templates(spark):
    items = spark.createDataFrame([
        (1, "Anna has 3 apples and gives Bob 2 apples while Anna keeps the rest of 3 in her basket at home."), (2, None), (3, ""),
        (4, "to be or not to be"), (None, "a train of 12 wagons drives at 80 km/h over the long bridge near the town")], "item_id long, text string")
    rows = edge_rows() + [
        (101, "Well. Today Carla has 7 apples and gives Dirk 5 apples while Carla keeps the rest of 7 in her basket at home. End"),
        (102, "Carla has 7 apples and gives Dirk 5 apples while Emma keeps the rest of 9 in her basket at home."),
        (103, "ANNA HAS 3 APPLES AND GIVES BOB 2 APPLES WHILE ANNA KEEPS THE REST OF 3 IN HER BASKET AT HOME"),
        (104, "she has many apples and some pears"), (None, "he said to be or not to be there"),
        (105, "A train of 9 wagons drives at 120 mph over the long bridge near the town. A train of 9 wagons drives at 120 mph over the long bridge near the town.")]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(docs_of(spark, rows).drop("item_id"), items).collect()}
    assert got == {(101, 1), (103, 1), (None, 4), (105, None)}
    assert decontaminate.contaminated_pairs(docs_of(spark, []), items).collect() == []
    assert decontaminate.contaminated_pairs(docs_of(spark, rows), items.limit(0)).collect() == []


def test_changed_and_partial_copies(spark):
    """Words changed, put in or left out, and a part of a long item."""
    sizes = {1: 15, 2: 30, 3: 59, 4: 200, 5: 120}
    texts = {i: [f"it{i}w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(n)] for i, n in sizes.items()}
    letters = lambda w: "".join(c if c.isalpha() else chr(103 + int(c)) for c in w)
    texts = {i: [letters(w) for w in ws] for i, ws in texts.items()}
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "item_id long, text string")
    cut = lambda i, *at: " ".join("changed" if k in at else w for k, w in enumerate(texts[i]))
    put = lambda i, *at: " ".join(w for k, x in enumerate(texts[i]) for w in (["extra", x] if k in at else [x]))
    around = lambda x: "some words stand before it " + x + " and others come after it"
    rows = [(1, cut(1, 7)), (2, cut(2, 10, 20)), (3, put(2, 10, 20)), (4, cut(3, 11, 23, 35, 47)), (5, " ".join(texts[4][60:140])),
            (6, put(5, 20, 40, 60, 80, 100)), (7, " ".join(texts[4][:20])), (8, " ".join(reversed(texts[3])))]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(docs_of(spark, [(d, around(x)) for d, x in rows]).drop("item_id"), items).collect()}
    assert got == {(1, 1), (2, 2), (3, 2), (4, 3), (5, 4), (6, 5)}


def test_items_of_numbers_names_and_few_words(spark):
    items = {1: "12 + 7 = 19", 2: "3 5 7 9 11 13 15 17 19 21 23 25", 3: "Who was Ada?", 4: "Berlin", 5: "Paris London Rome Madrid Vienna Prague Oslo Berne Riga Minsk"}
    texts = [(i, f"in the old book we have read: {x} and so on it goes") for i, x in items.items()]
    texts += [(10, "in the old book 4 6 8 10 12 14 16 18 20 22 24 26 stood"), (11, "we know who was he"), (12, "he saw 12 + 8 = 20 there")]
    table = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(docs_of(spark, texts).drop("item_id"), table).collect()}
    assert got == {(i, i) for i in items}


# --- pipeline ---------------------------------------------------------------------------------------

def test_pipeline_as_by_hand(spark, library):
    rows = given(spark)
    cutoffs = quality_rules.choose_cutoffs(quality_rules.count_features(spark.read.parquet(f"{SF}/documents.parquet")),
                                           spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert not any(r.cutoffs for r in cutoffs)      # too few labels here: the base rule alone decides
    rows = [(d, t) for d, t in rows for n, _, _, _, rep in [brute_counts(t)] if n >= 50 and 100 * rep <= 50 * n]
    rows = [(d, kept) for (d, _), (_, _, kept) in zip(rows, brute_lines(rows), strict=True)]
    rows = [r for r, (_, c) in zip(rows, brute_near(rows), strict=True) if c == r[0]]
    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(d, t) for d, t in rows if not any(x in plain(t) for x in items)]
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.ids for r in got} == {d: library.encode(t, add_special_tokens=False).ids for d, t in rows}
    assert len(got) == len(rows)


def test_stages_keep_columns_and_odd_rows(spark):
    docs = docs_of(spark, edge_rows()).drop("words")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    near = corpus_pipeline.near_copies(spark, docs, SF).select("doc_id", "text").collect()
    assert collections.Counter(r.doc_id for r in near)[2] == 0 and sum(r.text is None for r in near) == 1


def test_a_preamble_of_many_items_and_a_long_text_of_numbers(spark):
    """Every item of a shared preamble is checked for itself; a text of a million numbers needs little memory."""
    preamble = "answer the question that follows with one of the four letters below"
    letters = str.maketrans("0123456789", "bcdfghklmn")
    bodies = [" ".join(f"w{k}x{j}".translate(letters) for j in range(20)) for k in range(1000)]
    around = lambda x: f"some words stand before it {x} and others come after it"
    items = spark.createDataFrame([(k, f"{preamble} {body}") for k, body in enumerate(bodies)], "item_id long, text string")
    docs = docs_of(spark, [(1, around(f"{preamble} {bodies[3]}")), (2, around("nothing of the kind stands in this text at all"))]).drop("item_id")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(docs, items).collect()}
    assert got == {(1, 3)}
    doc = decontaminate.Words(" ".join(str(k % 1000) for k in range(300_000)))
    item = decontaminate.Words("12 men have 5 apples and 7 pears for 3 km " * 3 + "1 2 3 4 5 6 7 8 9 10 " * 8)
    tracemalloc.start()
    assert not decontaminate.slot_check(doc, item)[4]
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()


def test_windows_of_texts_together_are_those_of_each(spark):
    texts = [None, "", "one", "In May 5 men of Rome ran 7 km. HOW FAR WAS IT FROM HERE TO THERE", "a b c d e f g h i j", " \n", "... , !", "a b c d e f g h i j"] * 3
    each = {(k, size, int(w)) for k, t in enumerate(texts) for size, _, found in decontaminate._windows_of_texts([t], {5: None, 8: None}) for w in found}
    together = [(int(k), size, int(w)) for size, at, found in decontaminate._windows_of_texts(texts, {5: None, 8: None}) for k, w in zip(at, found, strict=True)]
    assert each == set(together) and len(each) == len(together) and each
    some = {size: np.array(sorted(w for _, s, w in each if s == size)[::3]) for size in (5, 8)}
    look = {size: decontaminate.Wanted(w) for size, w in some.items()}
    met = {(int(k), size, int(w)) for size, at, found in decontaminate._windows_of_texts(texts, look) for k, w in zip(at, found, strict=True)}
    assert met == {(k, s, w) for k, s, w in each if w in set(some[s].tolist())}


def test_reading_ranks_needs_little_memory():
    """A block's ranks are gathered four bytes at a time, not byte by byte through 16 places for each control byte."""
    rng = np.random.default_rng(3)
    ranks = (rng.integers(0, 2**32, 65_537, dtype=np.uint64) >> rng.choice([0, 8, 16, 24], 65_537).astype(np.uint64)).astype("<u4")
    control, data = token_files.pack(ranks)
    token_files.unpack(control, data, len(ranks))
    tracemalloc.start()
    got = token_files.unpack(control, data, len(ranks))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(got, ranks)
    assert peak < 64 * len(ranks)


def test_small_stored_tables_are_few_files(spark):
    tables = Tables(spark)
    tables.files = 2
    kept = tables.keep(spark.range(100).repartition(16), "many-parts")
    assert len(kept.inputFiles()) <= 2
    assert kept.count() == 100
    tables.drop()


def test_new_words_of_many_texts_go_to_the_library_together(library):
    """One call of the model for the words of a group of texts, and none for words that were met before."""
    from leafstack.llm.tokens import ChunkIds
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéñüßXYZ") for _ in range(rng.randrange(1, 12)))
    texts = ["".join(word() + rng.choice([" ", " ", ", ", ".\n", "\t", "'s ", " &&& ", "12 "]) for _ in range(50)) for _ in range(200)]
    texts += ["", " ", "\n", " x", "\n\ny  z", "a \nb", "你好 世界 ok", "x <|endoftext|> y", "a\n b", texts[0] + "  " + texts[1]]
    encoder, calls = ChunkIds(TOKENIZER, "<u2"), []

    class Model:
        def __init__(self, model):
            self.model = model

        def encode_batch_fast(self, *args, **named):
            calls.append(args)
            return self.model.encode_batch_fast(*args, **named)

    encoder.model = Model(encoder.model)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder.batch(texts)] == want
    assert len(calls) < len(texts)
    calls.clear()
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder.batch(texts[::-1])] == want[::-1]
    assert not calls
    assert [np.frombuffer(encoder.ids(t), "<u2").tolist() for t in texts] == want
