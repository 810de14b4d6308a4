"""Pattern extraction of fields from text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafstack.operators.common import rounded, unfold
from leafstack.rules import (
    DEFAULT_STAGE_FACTOR, NUMERIC_FIELDS, PATTERN_EXCLUSIONS, STAGE_FACTOR, Pattern)
from leafstack.session import stored

# Kinds of value a label can announce, for patterns made from labels.
VALUE_SHAPES = {
    "reference": r"([A-Z0-9][A-Z0-9/\-.]{2,29})",
    "date": r"(\d{4}-\d{2}-\d{2}|\d{1,2}[/.\-]\d{1,2}[/.\-]\d{4})",
    "amount": r"(?:[A-Z]{3}\s*)?(\d[\d,.]+)",
    "currency": r"([A-Z]{3})\b",
    "text": r"([^\n]{2,80})",
}


def label_pattern(field_name: str, labels: Sequence[str], shape: str, confidence: float = 0.9) -> Pattern:
    """A pattern for 'Label: value' built from label words and the shape of the value.

    Spaces in a label match any whitespace, and a dot or colon may follow it.
    """
    words = "|".join(r"\s+".join(w for w in label.split()) for label in labels)
    return Pattern(field_name, rf"\b(?:{words})\.?\s*[:\-]?\s*{VALUE_SHAPES[shape]}", 1, confidence)


def stage_factor(stage: Column) -> Column:
    out = F.lit(DEFAULT_STAGE_FACTOR)
    for name, factor in STAGE_FACTOR.items():
        out = F.when(stage == name, factor).otherwise(out)
    return out


def _tidy(field_name: str, value: Column) -> Column:
    v = F.trim(value)
    if field_name in NUMERIC_FIELDS:
        v = F.regexp_replace(F.regexp_replace(v, r"[.,;:]+$", ""), r"(?<=\d)\s+(?=\d)", "")
    return F.nullif(v, F.lit(""))


def first_match(text: Column, field_name: str, patterns: Sequence[Pattern]) -> Column:
    """'confidence|value' of the first pattern with a value; later patterns are not evaluated."""
    return F.coalesce(*[
        F.concat(F.lit(f"{p.confidence}|"), _tidy(field_name, F.regexp_extract(text, "(?im)" + p.regex, p.group)))
        for p in patterns])


def extract_fields(docs: DataFrame, patterns: Sequence[Pattern], targets: Mapping[str, Sequence[str]],
                   exclusions: Mapping[str, Sequence[str]] = PATTERN_EXCLUSIONS) -> DataFrame:
    """Fields found by patterns: document_id, ordinal, field_name, field_value, confidence, method, tier.

    `docs`: document_id, class_id, text[, stage]; `targets`: class -> field names in order.
    Per field the first pattern with a value wins; confidence is the pattern's times the
    stage factor, at most 1, 4 decimals.  The text stays where it is: one projection makes
    an array of hits, and only the hits become rows.
    """
    hits = _with_hits(docs, patterns, targets, exclusions)
    hits = unfold(hits, ["document_id"], F.col("hits"), "h")
    return hits.select("document_id", "h.*", F.lit("TEXT_LAYER").alias("extraction_method"), F.lit(1).alias("extraction_tier"))


def extract_map(docs: DataFrame, patterns: Sequence[Pattern], targets: Mapping[str, Sequence[str]],
                exclusions: Mapping[str, Sequence[str]] = PATTERN_EXCLUSIONS) -> DataFrame:
    """As `extract_fields`, but one row per document: document_id, class_id, fields map, avg_confidence.

    Needs no grouping, so it also runs on a stream.
    """
    d = _with_hits(docs, patterns, targets, exclusions)
    entries = F.transform("hits", lambda h: F.struct(h["field_name"], h["field_value"]))
    total = F.aggregate("hits", F.lit(0).cast("decimal(18,6)"),
                        lambda a, h: (a + h["confidence"].cast("decimal(18,6)")).cast("decimal(18,6)"))
    return d.select("document_id", "class_id", F.map_from_entries(entries).alias("fields"),
                    rounded(total / F.nullif(F.size("hits"), F.lit(0)).cast("decimal(18,0)"), 4).alias("avg_confidence"))


def _with_hits(docs: DataFrame, patterns: Sequence[Pattern], targets: Mapping[str, Sequence[str]],
               exclusions: Mapping[str, Sequence[str]]) -> DataFrame:
    """document_id, class_id, hits: array<struct<ordinal,field_name,field_value,confidence>>."""
    by_field: dict[str, list[Pattern]] = {}
    for p in patterns:
        by_field.setdefault(p.field_name, []).append(p)
    stage = stage_factor(F.col("stage")) if "stage" in docs.columns else F.lit(DEFAULT_STAGE_FACTOR)
    base = docs.select("document_id", "class_id", "text", stage.cast("decimal(4,2)").alias("factor"))
    places: dict[str, dict[int, list[str]]] = {}
    for class_id, names in targets.items():
        kept = [n for n in names if n not in exclusions.get(class_id, ())]
        for i, n in enumerate(kept):
            places.setdefault(n, {}).setdefault(i, []).append(class_id)
    cells = []
    for name, spots in places.items():
        if name not in by_field:
            continue
        ordinal = F.lit(None).cast("int")
        classes = []
        for i, cs in spots.items():
            ordinal = F.when(F.col("class_id").isin(cs), i).otherwise(ordinal)
            classes += cs
        hit = F.when(F.col("class_id").isin(classes), first_match(F.col("text"), name, by_field[name]))
        cells.append(F.struct(ordinal.alias("ordinal"), F.lit(name).alias("field_name"), hit.alias("hit")))
    found = base.select("document_id", "class_id", "factor", F.filter(F.array(*cells), lambda c: c["hit"].isNotNull()).alias("found"))
    one = F.lit(1).cast("decimal(2,0)")
    return found.select("document_id", "class_id", F.transform("found", lambda c: F.struct(
        c["ordinal"].alias("ordinal"), c["field_name"].alias("field_name"),
        F.regexp_replace(c["hit"], r"^[^|]*\|", "").alias("field_value"),
        rounded(F.least(F.substring_index(c["hit"], "|", 1).cast("decimal(6,4)") * F.col("factor"), one), 4).alias("confidence"),
    )).alias("hits"))


def fast_path(docs: DataFrame, learned: Mapping[str, Sequence[Pattern]], targets: Mapping[str, Sequence[str]],
              threshold: float = 0.85, share: float = 0.40) -> DataFrame:
    """Learned patterns per class; a document is accepted when at least 40 % of its targets reach .85.

    Out: document_id, class_id, found, good, target_count, accepted.
    """
    cells = []
    for class_id, patterns in learned.items():
        for p in patterns:
            if p.field_name in targets.get(class_id, ()):
                value = F.trim(F.regexp_replace(F.regexp_extract("text", "(?im)" + p.regex, p.group), r"\s+", " "))
                cells.append(F.when((F.col("class_id") == class_id) & (value != ""), F.lit(p.confidence)))
    counts = F.create_map(*[F.lit(x) for c, fs in targets.items() for x in (c, len(fs))])
    hits = F.filter(F.array(*cells), lambda c: c.isNotNull())
    good = F.size(F.filter(hits, lambda c: c >= threshold))
    n = F.coalesce(F.try_element_at(counts, F.col("class_id")), F.lit(0))
    return docs.select(
        "document_id", "class_id", F.size(hits).alias("found"), good.alias("good"), n.alias("target_count"),
        ((n > 0) & (good >= n * share)).alias("accepted"))


def resolve_schema(docs: DataFrame, variants: DataFrame, class_profiles: DataFrame,
                   targets: DataFrame) -> DataFrame:
    """Target fields and stage of each document.

    Stage: the layout's, else the class's, else ZERO_SHOT.  Past ZERO_SHOT the fields are
    the layout's schema, else the class's; without either the stage falls back to
    ZERO_SHOT.  Else the static list applies.

    `variants`: variant_id, learning_stage, schema_fields; `class_profiles`: class_id,
    learning_stage, schema_fields; `targets`: class_id, fields (the last two are small).
    """
    # a stored table's size is known when the join is planned: few layouts are sent to the tasks, and documents,
    # of which most may have one layout or none, are not dealt out by it
    v = stored(variants.select("variant_id", F.col("learning_stage").alias("v_stage"), F.col("schema_fields").alias("v_fields")), "layouts")
    c = class_profiles.select("class_id", F.col("learning_stage").alias("c_stage"), F.col("schema_fields").alias("c_fields"))
    joined = docs.select("document_id", "class_id", "variant_id").join(v, "variant_id", "left").join(
        F.broadcast(c), "class_id", "left").join(
        F.broadcast(targets.select("class_id", F.col("fields").alias("t_fields"))), "class_id", "left")
    stage = F.coalesce("v_stage", "c_stage", F.lit("ZERO_SHOT"))
    some = lambda a: F.when(F.size(a) > 0, F.col(a))
    confirmed = F.when(stage != "ZERO_SHOT", F.coalesce(some("v_fields"), some("c_fields")))
    return joined.select(
        "document_id", F.when(confirmed.isNull(), "ZERO_SHOT").otherwise(stage).alias("stage"),
        F.coalesce(confirmed, F.col("t_fields"), F.array().cast("array<string>")).alias("target_fields"),
        F.when((stage != "ZERO_SHOT") & some("v_fields").isNotNull(), "variant")
        .when(confirmed.isNotNull(), "class").otherwise("static").alias("source"))


