"""Keyword classification with redirects."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafstack.functions.text import (
    collapse, file_stem, filename_bonus, text_array)
from leafstack.operators.common import unfold
from leafstack.rules import PHRASE_RULES, REDIRECTS, ClassRule, PhraseRule, Redirect

MIN_SCORE = 2


def rules_column(rules: Sequence[ClassRule]) -> Column:
    """All class rules as one literal array, so scoring needs no join and copies no text."""
    return F.array(*[F.struct(
        F.lit(r.class_id).alias("class_id"), F.lit(r.priority).alias("priority"), F.lit(i).alias("position"),
        F.lit(max(len(r.keywords), 1)).alias("keyword_count"),
        text_array(r.keywords).alias("keywords"), text_array(r.negatives).alias("negatives"),
    ) for i, r in enumerate(rules) if r.keywords])


def score_array(text: Column, stem: Column, rules: Sequence[ClassRule]) -> Column:
    """array<struct<class_id,priority,position,keyword_count,score>> over all classes.

    Keywords are spelled out, not looped over: inside a lambda the optimiser may put what `text` is made
    of, and a whole text would be normalised once per keyword.
    """
    def hits(words: Sequence[str]) -> list[Column]:
        return [F.contains(text, F.lit(w)).cast("int") for w in words]

    def scored(i: int, r: ClassRule) -> Column:
        score = F.greatest(reduce(Column.__sub__, hits(r.negatives), reduce(Column.__add__, hits(r.keywords))), F.lit(0))
        bonus = F.when(stem != "", filename_bonus(stem, text_array(r.keywords))).otherwise(F.lit(0))
        return F.struct(
            F.lit(r.class_id).alias("class_id"), F.lit(r.priority).alias("priority"), F.lit(i).alias("position"),
            F.lit(max(len(r.keywords), 1)).alias("keyword_count"), (score + bonus).alias("score"))
    return F.array(*[scored(i, r) for i, r in enumerate(rules) if r.keywords])


def keyword_scores(docs: DataFrame, rules: Sequence[ClassRule]) -> DataFrame:
    """Long scores: document_id, class_id, score (only above 0).

    `docs`: document_id, text[, file_name].
    """
    stem = file_stem(F.col("file_name")) if "file_name" in docs.columns else F.lit("")
    text = F.lower(collapse(F.coalesce("text", F.lit(""))))
    scored = docs.select("document_id", text.alias("t"), stem.alias("stem"))
    out = unfold(scored, ["document_id"], score_array(F.col("t"), F.col("stem"), rules), "s")
    return out.filter(F.col("s.score") > 0).select(
        "document_id", F.col("s.class_id").alias("class_id"), F.col("s.score").alias("score"))


def _contains(text: Column, phrases: Sequence[str], every: bool) -> Column:
    parts = [F.contains(text, F.lit(p)) for p in phrases]
    return reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), parts)


def _phrase_condition(text: Column, rule: PhraseRule) -> Column:
    cond = _contains(text, rule.all_of, True)
    return cond & _contains(text, rule.any_of, False) if rule.any_of else cond


def _redirect_condition(text: Column, winner: Column, score_of, rule: Redirect) -> Column:
    cond = winner == rule.winner
    if rule.all_of:
        cond &= _contains(text, rule.all_of, True)
    if rule.any_of:
        cond &= _contains(text, rule.any_of, False)
    if rule.none_of:
        cond &= ~_contains(text, rule.none_of, False)
    if rule.none_pattern:
        cond &= ~text.rlike(rule.none_pattern)
    if rule.other_class:
        cond &= score_of(rule.other_class, MIN_SCORE) >= rule.other_min
    return cond


def first_true(cases: Sequence[tuple[Column, Column]], otherwise: Column) -> Column:
    """Value of the first condition that holds."""
    out = otherwise
    for cond, value in reversed(list(cases)):
        out = F.when(cond, value).otherwise(out)
    return out


def classify_documents(docs: DataFrame, rules: Sequence[ClassRule],
                       redirects: Sequence[Redirect] = REDIRECTS,
                       phrases: Sequence[PhraseRule] = PHRASE_RULES, keep: Sequence[str] = ()) -> DataFrame:
    """document_id, class_id, confidence, score, how.

    Order: a class set by hand (confidence 1); phrase rules (1); keyword scores plus
    file-name bonus; only scores of 2 or more count; highest (score, priority), then first
    in rule order; the first redirect that fits.  Confidence is score / keyword count,
    at most 1, 4 decimals.  Without a class both are null / 0.

    One projection per document: the text is read once and is not in the output, unless
    `keep` names it among the columns to pass on.
    """
    stem = file_stem(F.col("file_name")) if "file_name" in docs.columns else F.lit("")
    override = F.col("class_override") if "class_override" in docs.columns else F.lit(None).cast("string")
    text = F.lower(collapse(F.coalesce("text", F.lit(""))))
    # the normalised text comes out of a generator: no later filter on the class can put it back into its condition,
    # where each keyword would normalise the text again
    base = docs.select("document_id", *keep, override.alias("override"), F.explode_outer(F.array(F.struct(text.alias("t"), stem.alias("stem")))).alias("n")).select(
        "document_id", *keep, "override", "n.t", "n.stem")
    scored = base.withColumn("scores", score_array(F.col("t"), F.col("stem"), rules))
    passing = F.filter("scores", lambda s: s["score"] >= MIN_SCORE)
    best = F.array_max(F.transform(passing, lambda s: F.struct(
        s["score"].alias("score"), s["priority"].alias("priority"), (-s["position"]).alias("position"),
        s["class_id"].alias("class_id"), s["keyword_count"].alias("keyword_count"))))
    won = scored.withColumn("best", best)

    def score_of(class_id: str, floor: int = 0) -> Column:
        hit = F.get(F.filter("scores", lambda s: (s["class_id"] == class_id) & (s["score"] >= floor)), 0)
        return F.coalesce(hit["score"], F.lit(0))

    static = {r.class_id: max(r.static_count or len(r.keywords), 1) for r in rules}

    def ratio(score: Column, count: Column) -> Column:
        exact = score.cast("decimal(12,0)") / count.cast("decimal(12,0)")
        return F.round(F.least(exact, F.lit(1).cast("decimal(3,0)")), 4).cast("double")

    t, winner = F.col("t"), F.col("best.class_id")
    redirected = first_true(
        [(_redirect_condition(t, winner, score_of, r), F.struct(
            F.lit(r.target).alias("class_id"),
            ratio(score_of(r.target), F.lit(static.get(r.target, 1))).alias("confidence"),
            F.lit("redirect").alias("how"))) for r in redirects],
        F.when(winner.isNotNull(), F.struct(
            winner.alias("class_id"), ratio(F.col("best.score"), F.col("best.keyword_count")).alias("confidence"),
            F.lit("keywords").alias("how"))))
    decided = first_true(
        [(F.col("override").isNotNull(), F.struct(
            F.col("override").alias("class_id"), F.lit(1.0).alias("confidence"), F.lit("override").alias("how")))]
        + [(_phrase_condition(t, p), F.struct(
            F.lit(p.target).alias("class_id"), F.lit(1.0).alias("confidence"), F.lit("phrase").alias("how")))
           for p in phrases],
        redirected)
    return won.select("document_id", *keep, F.col("best.score").alias("score"), decided.alias("d")).select(
        "document_id", *keep, F.col("d.class_id").alias("class_id"),
        F.coalesce(F.col("d.confidence"), F.lit(0.0)).alias("confidence"),
        F.coalesce("score", F.lit(0)).alias("score"),
        F.coalesce(F.col("d.how"), F.lit("none")).alias("how"))


def governance_triage(class_id: Column, confidence: Column, field_count: Column, threshold: float = 0.35) -> Column:
    """struct<verdict,confidence> for a document nothing could be extracted from."""
    def v(verdict: str, conf: float) -> Column:
        return F.struct(F.lit(verdict).alias("verdict"), F.lit(conf).alias("confidence"))
    return (
        F.when(class_id.isNull(), v("NEW_TYPE", 0.4))
        .when((confidence >= threshold) & (field_count == 0), v("CORRECT", 0.6))
        .when(confidence < threshold, v("NEW_TYPE", 0.4))
        .otherwise(v("CORRECT", 0.5))
    )
