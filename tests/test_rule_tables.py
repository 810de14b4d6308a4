"""Rules read from tables, and the default redirects and phrases on texts that need them."""

import pytest

from leafstack import rules as R
from leafstack.operators import classify, extract


def test_rules_from_tables(spark):
    words = spark.createDataFrame(
        [("c_a", 0, "purchase order", False, 1), ("c_a", 1, "buyer", False, 1), ("c_a", 2, "cancelled", True, 1),
         ("c_b", 0, "invoice", False, None), ("c_b", 1, "amount due", False, None)],
        "class_id string, ordinal int, keyword string, negative boolean, priority int")
    rules = R.load_class_rules(words, limit=10)
    assert [(r.class_id, r.keywords, r.negatives) for r in rules] == [("c_a", ("purchase order", "buyer"), ("cancelled",)), ("c_b", ("invoice", "amount due"), ())]
    docs = spark.createDataFrame([("1", "a purchase order of the buyer", "x.pdf"), ("2", "an invoice, amount due 3", "y.pdf"), ("3", "nothing", "z.pdf")],
                                 "document_id string, text string, file_name string")
    got = {r.document_id: r.class_id for r in classify.classify_documents(docs, rules).collect()}
    assert (got["1"], got["2"]) == ("c_a", "c_b") and got["3"] not in ("c_a", "c_b")

    table = spark.createDataFrame([("po_number", 1, r"order (\d+)", 1, 0.8), ("po_number", 0, r"PO (\d+)", 1, 0.9)],
                                  "field_name string, ordinal int, regex string, grp int, base_conf double")
    patterns = R.load_patterns(table, limit=2)
    assert [p.regex for p in patterns] == [r"PO (\d+)", r"order (\d+)"]
    texts = spark.createDataFrame([("1", "c_a", "order 17 for PO 12"), ("2", "c_a", "order 18")], "document_id string, class_id string, text string")
    out = extract.extract_fields(texts, patterns, {"c_a": ["po_number"]}).collect()
    assert {(r.document_id, r.field_value) for r in out} == {("1", "12"), ("2", "18")}
    with pytest.raises(ValueError):
        R.load_patterns(table, limit=1)


def test_default_phrases_settle_first(spark):
    rules = [R.ClassRule("dc_006", ("invoice", "amount due")), R.ClassRule("dc_012", ("nowhere to be found", "nor here"))]
    rule = R.PHRASE_RULES[0]
    text = "invoice amount due " + " ".join([*rule.all_of, *rule.any_of])
    docs = spark.createDataFrame([("1", text, "x.pdf"), ("2", "invoice, amount due", "x.pdf")], "document_id string, text string, file_name string")
    got = {r.document_id: (r.class_id, r.how) for r in classify.classify_documents(docs, rules).collect()}
    assert got == {"1": (rule.target, "phrase"), "2": ("dc_006", "keywords")}
