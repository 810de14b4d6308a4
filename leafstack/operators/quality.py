"""Validation, proofreading and rule instructions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafstack import rules as R
from leafstack.functions.values import (
    FIELD_FORMATS, condition_met, format_check, is_placeholder, is_valid_date, is_valid_number,
    length_anomaly, to_decimal)
from leafstack.operators.common import exact_avg, newest_n, rounded, unfold
from leafstack.operators.fieldset import field_dict, last_per_name
from leafstack.session import stored


def _rule_map(table: Mapping[str, Sequence[str]]) -> Column:
    """{class: fields} as a literal map, looked up per document (20 entries)."""
    return F.create_map(*[x for c, fs in table.items() for x in (F.lit(c), F.array(*map(F.lit, fs)).cast("array<string>"))])


def _rules_of(table: Mapping[str, Sequence[str]]) -> Column:
    return F.coalesce(F.try_element_at(_rule_map(table), F.col("class_id")), F.array().cast("array<string>"))


def with_field_dict(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """Documents with their field map (empty when nothing was extracted); those that carry it keep it."""
    if "fields" in docs.columns:
        return docs
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return docs.join(field_dict(fields), "document_id", "left").withColumn("fields", F.coalesce("fields", empty))


def _judged(docs: DataFrame) -> DataFrame:
    return docs.select("document_id", "class_id", *[c for c in docs.columns if c == "fields"])


def validate(docs: DataFrame, fields: DataFrame,
             required: Mapping[str, Sequence[str]] = R.VALIDATION_REQUIRED,
             dates: Mapping[str, Sequence[str]] = R.DATE_FIELDS,
             numbers: Mapping[str, Sequence[str]] = R.NUMBER_FIELDS) -> DataFrame:
    """document_id, is_valid, nigo (conditions in rule order), warnings.

    Required fields, dates, numbers, subtotal + VAT = total within 0.02 for supplier
    invoices, the shipper declaration of dangerous goods.  One shuffle: the field maps; none where `docs`
    carry theirs (see `with_field_dict`).
    """
    return validate_maps(with_field_dict(_judged(docs), fields), required, dates, numbers)


def validate_maps(docs: DataFrame, required: Mapping[str, Sequence[str]] = R.VALIDATION_REQUIRED,
                  dates: Mapping[str, Sequence[str]] = R.DATE_FIELDS,
                  numbers: Mapping[str, Sequence[str]] = R.NUMBER_FIELDS) -> DataFrame:
    """`validate` on documents that carry their field map: a plain projection, also on a stream."""
    f = F.col("fields")
    value = lambda n: F.try_element_at(f, n if isinstance(n, Column) else F.lit(n))
    filled = lambda n: F.coalesce(value(n), F.lit("")) != ""

    missing = F.transform(
        F.filter(_rules_of(required), lambda n: F.trim(F.coalesce(value(n), F.lit(""))) == ""),
        lambda n: F.concat(F.lit("Required field missing or empty: '"), n, F.lit("'.")))
    bad_dates = F.transform(
        F.filter(_rules_of(dates), lambda n: filled(n) & ~is_valid_date(value(n))),
        lambda n: F.concat(F.lit("Field '"), n, F.lit("' value '"), value(n),
                           F.lit("' is not a recognised date format (expected YYYY-MM-DD).")))
    bad_numbers = F.transform(
        F.filter(_rules_of(numbers), lambda n: filled(n) & ~is_valid_number(value(n))),
        lambda n: F.concat(F.lit("Field '"), n, F.lit("' value '"), value(n), F.lit("' cannot be parsed as a number.")))
    sub, vat, total = (to_decimal(value(n)) for n in ("subtotal", "vat_amount", "total_amount"))
    checked = F.col("class_id").isin(R.TOTAL_CHECK_CLASSES)
    diff = F.abs(sub + vat - total)
    mismatch = F.when(checked & (diff > F.lit("0.02").cast("decimal(4,2)")), F.concat(
        F.lit("Invoice total mismatch: subtotal + VAT = "), (sub + vat).cast("decimal(38,2)"),
        F.lit(", but total_amount = "), total.cast("decimal(38,2)"), F.lit(".")))
    unverified = F.when(
        checked & total.isNotNull() & (sub.isNull() | vat.isNull()),
        F.lit("Cannot verify subtotal + VAT = total: one or more component fields missing."))
    signed = F.lower(F.trim(F.coalesce(value("shipper_declaration_signed"), F.lit(""))))
    goods = F.col("class_id").isin(R.DECLARATION_CLASSES)
    unsigned = F.when(goods & (signed == "false"), F.lit(
        "Dangerous Goods Declaration: shipper_declaration_signed is explicitly false."))
    odd = F.when(goods & ~signed.isin("", "true", "false"), F.concat(
        F.lit("shipper_declaration_signed has unexpected value '"), signed, F.lit("' — manual review advised.")))
    no_class = F.when(F.col("class_id").isNull(), F.lit("No Document Class assigned — cannot validate."))
    compact = lambda *cs: F.array_compact(F.array(*cs))
    nigo = F.when(no_class.isNotNull(), F.array(no_class)).otherwise(
        F.concat(missing, bad_dates, bad_numbers, compact(mismatch, unsigned)))
    out = docs.select("document_id", "class_id", nigo.alias("nigo"), compact(unverified, odd).alias("warnings"))
    return out.select("document_id", "class_id", (F.size("nigo") == 0).alias("is_valid"), "nigo", "warnings",
                      F.when(F.size("nigo") > 0, F.concat(
                          F.lit("NIGO - "), F.size("nigo"), F.lit(" condition(s) failed. "),
                          F.array_join("nigo", " | "))).alias("reason"))


def value_bleed(fields: DataFrame) -> DataFrame:
    """Fields whose trimmed value was already seen under another name earlier in the document."""
    w = Window.partitionBy("document_id", "v").orderBy("ordinal", "field_id")
    rows = fields.filter(
        ~F.col("field_name").isin(R.BLEED_EXEMPT) & (F.coalesce("field_value", F.lit("")) != "")
    ).select("document_id", "field_id", "ordinal", "field_name", F.trim("field_value").alias("v"))
    return rows.withColumn("seen_in", F.lag("field_name").over(w)).filter(
        F.col("seen_in").isNotNull() & (F.col("seen_in") != F.col("field_name"))
    ).select("document_id", "field_name", F.col("v").alias("field_value"), "seen_in")


def history_check(docs: DataFrame, fields: DataFrame, n: int = 10,
                  stable: Sequence[str] = R.STABLE_FIELDS, current: DataFrame | None = None) -> DataFrame:
    """Stable fields whose value none of the n newest other documents of the layout has.

    `docs`: document_id, variant_id, created_at; `current` (document_id, field_name, field_value): the
    values to check, if not all of `fields`.  The n+1 newest of a layout suffice for
    every document: one inside them leaves itself out, one outside leaves the last out.
    The history joined to a document is at most n+1 rows per layout and field, packed in
    one array, so a layout with most documents only repeats a small row.
    """
    named = docs.filter(F.col("variant_id").isNotNull()).select("document_id", "variant_id", "created_at")
    # few rows, stored: their size is known then, and the fields need no shuffle to meet them
    recent = stored(newest_n(named, "variant_id", n + 1).select("document_id", "variant_id", "rank"), "newest")

    def stable_values(rows: DataFrame) -> DataFrame:
        return rows.filter(F.col("field_name").isin(list(stable)) & (F.coalesce("field_value", F.lit("")) != "")).select(
            "document_id", "field_name", "field_value")
    values = stable_values(fields)
    known = stored(recent.join(values, "document_id").groupBy("variant_id", "field_name").agg(
        F.collect_list(F.struct("document_id", "rank", F.upper(F.trim("field_value")).alias("v"))).alias("past")), "layout-history")
    ranks = recent.select("document_id", F.col("rank").alias("own_rank"))
    asked = values if current is None else stable_values(current)
    asked = asked.join(named.select("document_id", "variant_id"), "document_id").join(
        ranks, "document_id", "left").join(known, ["variant_id", "field_name"])
    others = F.array_sort(F.array_distinct(F.transform(F.filter("past", lambda p: (
        (p["document_id"] != F.col("document_id"))
        & (F.col("own_rank").isNotNull() | (p["rank"] <= n)))), lambda p: p["v"])))
    return asked.withColumn("known", others).filter(
        (F.size("known") > 0) & ~F.array_contains("known", F.upper(F.trim("field_value")))
    ).select("document_id", "field_name", "field_value", "known")


def proof_flags(docs: DataFrame, fields: DataFrame,
                required: Mapping[str, Sequence[str]] = R.PROOF_REQUIRED) -> DataFrame:
    """Every finding as a row: document_id, field_name, kind, severity.

    kinds: MISSING, FORMAT (errors); SHORT, PLACEHOLDER, BLEED, HISTORY (warnings); LONG (error).
    HISTORY needs variant_id and created_at in `docs`; the last value of a name counts, once a document.
    """
    classes = docs.select("document_id", "class_id")
    last = last_per_name(fields, F.trim("field_value"), "v").filter(F.coalesce("v", F.lit("")) != "")
    # one row a document, stored: each reader below would deal all fields out for itself
    held = stored(last.groupBy("document_id").agg(F.collect_list(F.struct("field_name", "v")).alias("held")), "filled-fields")
    filled = unfold(held, ["document_id"], F.col("held"), "x").select("document_id", "x.*")
    have = held.select("document_id", F.transform("held", lambda x: x["field_name"]).alias("have"))
    absent = F.array_except(_rules_of(required), F.coalesce("have", F.array().cast("array<string>")))
    missing = unfold(classes.join(have, "document_id", "left"), ["document_id"], absent, "field_name").select(
        "document_id", "field_name", F.lit("MISSING").alias("kind"), F.lit("ERROR").alias("severity"))
    formats = filled.filter(~format_check(F.col("field_name"), F.col("v"))).select(
        "document_id", "field_name", F.lit("FORMAT").alias("kind"), F.lit("ERROR").alias("severity"))
    length = length_anomaly(F.col("field_name"), F.col("field_value"))
    found = F.array_compact(F.array(
        F.when(length == "SHORT", F.struct(F.lit("SHORT").alias("kind"), F.lit("WARNING").alias("severity"))),
        F.when(length == "LONG", F.struct(F.lit("LONG").alias("kind"), F.lit("ERROR").alias("severity"))),
        F.when(is_placeholder(F.col("field_value")), F.struct(
            F.lit("PLACEHOLDER").alias("kind"), F.lit("WARNING").alias("severity")))))
    odd = unfold(fields.filter(F.coalesce("field_value", F.lit("")) != ""), ["document_id", "field_name"], found, "x").select("document_id", "field_name", "x.*")
    bleed = value_bleed(fields).select(
        "document_id", "field_name", F.lit("BLEED").alias("kind"), F.lit("WARNING").alias("severity"))
    flags = missing.unionByName(formats).unionByName(odd).unionByName(bleed)
    if "variant_id" in docs.columns:
        history = history_check(docs, fields, current=filled.withColumnRenamed("v", "field_value"))
        flags = flags.unionByName(history.select("document_id", "field_name").distinct().select(
            "document_id", "field_name", F.lit("HISTORY").alias("kind"), F.lit("WARNING").alias("severity")))
    return flags


def proofread(docs: DataFrame, fields: DataFrame, tier: int = 1,
              required: Mapping[str, Sequence[str]] = R.PROOF_REQUIRED,
              min_rate: float = 0.60, min_confidence: float = 0.60) -> DataFrame:
    """Quality score and verdict per document.

    score = .4 required share + .3 average confidence + .2 share of formats not failed +
    .1 (1 - anomalies * .05 / .1), clamped to 0..1, 4 decimals.  Passed: required share and
    confidence reach their minimum and at most one error.  Tier 3 lowers both minimums by
    .10, not under .40 / .45.
    """
    if tier == 3:
        min_rate, min_confidence = max(0.40, min_rate - 0.10), max(0.45, min_confidence - 0.10)
    counts = proof_flags(docs, fields, required).groupBy("document_id").agg(
        F.count_if(F.col("kind") == "MISSING").alias("missing"),
        F.count_if(F.col("kind") == "FORMAT").alias("bad_formats"),
        F.count_if(F.col("kind").isin("SHORT", "LONG", "PLACEHOLDER", "BLEED")).alias("anomalies"),
        F.count_if(F.col("severity") == "ERROR").alias("errors"),
        F.count_if(F.col("severity") == "WARNING").alias("warnings"))
    confidence = fields.groupBy("document_id").agg(F.round(exact_avg(F.col("confidence")), 4).alias("avg"))
    n_required = F.size(_rules_of(required))
    j = docs.select("document_id", "class_id").join(confidence, "document_id", "left").join(counts, "document_id", "left")
    zero = {c: 0 for c in ("missing", "bad_formats", "anomalies", "errors", "warnings")}
    j = j.fillna(zero).withColumn("n_required", n_required)
    dec = lambda c, p=20, s=10: c.cast(f"decimal({p},{s})")
    rate = F.when(F.col("n_required") == 0, F.lit(1.0)).otherwise(
        (F.col("n_required") - F.col("missing")) / F.col("n_required"))
    avg = F.coalesce(F.col("avg").cast("double"), F.lit(0.0))
    n_formats = len(FIELD_FORMATS)
    fmt = (F.lit(n_formats) - F.col("bad_formats")) / F.lit(n_formats)
    clean = F.lit(1.0) - F.least(F.col("anomalies") * 0.05, F.lit(0.10)) / 0.10
    score = F.round(dec(F.lit(0.4) * rate + F.lit(0.3) * avg + F.lit(0.2) * fmt + F.lit(0.1) * clean), 4).cast("double")
    return j.select(
        "document_id", "class_id", "missing", "bad_formats", "anomalies", "errors", "warnings",
        rounded(dec(rate), 4).alias("required_rate"), avg.alias("avg_confidence"),
        F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("score"),
        ((rate >= min_rate) & (avg >= min_confidence) & (F.col("errors") <= 1)).alias("passed"))


def instructions_column(instructions: Sequence[R.Instruction]) -> Column:
    """Active rules in (priority, id) order as one literal array; what the caller gives is what is applied."""
    ordered = sorted((i for i in instructions if i.active), key=lambda i: (i.priority, i.instruction_id))
    s = lambda v: F.lit(v).cast("string")
    return F.array(*[F.struct(
        F.lit(n).alias("place"), F.lit(i.instruction_id).alias("instruction_id"), s(i.class_id).alias("class_id"),
        s(i.cond_field).alias("cond_field"), s(i.cond_op).alias("cond_op"), s(i.cond_value).alias("cond_value"),
        s(i.action).alias("action"), s(i.action_value).alias("action_value")) for n, i in enumerate(ordered)])


def fired_instructions(docs: DataFrame, fields: DataFrame, instructions: Sequence[R.Instruction],
                       all_fired: bool = False) -> DataFrame:
    """Rules that hold for each document, in order, up to the first REQUIRE_APPROVAL.

    A rule applies to its class, or to all when it has none.  `all_fired=True` is the dry
    run: nothing is cut off.  Out: document_id, place, instruction_id, action, action_value.
    """
    docs = with_field_dict(_judged(docs), fields)
    def holds(i: Column) -> Column:
        applies = i["class_id"].isNull() | (i["class_id"] == F.col("class_id"))
        op = F.when(F.coalesce(i["cond_field"], F.lit("")) == "", F.lit(None)).otherwise(i["cond_op"])
        return F.coalesce(applies, F.lit(False)) & condition_met(op, F.try_element_at("fields", i["cond_field"]), i["cond_value"])
    fired = docs.select("document_id", F.filter(instructions_column(instructions), holds).alias("fired"))
    if not all_fired:
        stop = F.array_min(F.transform(F.filter("fired", lambda i: i["action"] == "REQUIRE_APPROVAL"), lambda i: i["place"]))
        fired = fired.withColumn("stop", stop).select(
            "document_id", F.filter("fired", lambda i: F.col("stop").isNull() | (i["place"] <= F.col("stop"))).alias("fired"))
    return unfold(fired, ["document_id"], F.col("fired"), "i").select(
        "document_id", F.col("i.place").alias("place"), F.col("i.instruction_id").alias("instruction_id"),
        F.col("i.action").alias("action"), F.col("i.action_value").alias("action_value"))


def instruction_effects(fired: DataFrame) -> DataFrame:
    """What the fired rules do to a document: approval stop, skipped stages, counts."""
    return fired.groupBy("document_id").agg(
        F.bool_or(F.col("action") == "REQUIRE_APPROVAL").alias("needs_approval"),
        F.bool_or(F.col("action") == "SKIP_POSTING").alias("skip_posting"),
        F.bool_or(F.col("action") == "SKIP_MATCHING").alias("skip_matching"),
        F.count_if(F.col("action") == "FLAG_WARNING").alias("warnings"),
        F.count_if(F.col("action") == "NOTIFY_EMAIL").alias("notifications"),
        F.min_by("instruction_id", F.when(F.col("action") == "REQUIRE_APPROVAL", F.col("place"))).alias("approval_rule"))


