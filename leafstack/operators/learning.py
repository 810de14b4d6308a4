"""What is learned from processed documents: field statistics, formats, schemas, stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafstack.functions.names import learning_stage, stage_rank
from leafstack.functions.values import build_hint, classify_value, pick_examples
from leafstack.operators.common import newest_n, rounded, running_number
from leafstack.operators.fieldset import by_document
from leafstack.session import stored


def first_distinct(rows: DataFrame, group: list[str], value: str, order: Column, n: int, out: str = "examples") -> DataFrame:
    """The first n distinct non-empty values of each group by `order`, as an array of at most n.

    Values are reduced to their first appearance before they are ranked.
    """
    return _ranked_values(rows.groupBy(*group, value).agg(F.min(order).alias("o")), group, value, n, out)


def _ranked_values(firsts: DataFrame, group: list[str], value: str, n: int, out: str) -> DataFrame:
    """The first n non-empty values by `o`; `firsts` has one row per value."""
    w = Window.partitionBy(*group).orderBy("o", value)
    kept = firsts.filter(F.coalesce(value, F.lit("")) != "").withColumn("i", F.row_number().over(w)).filter(F.col("i") <= n)
    sorted_values = F.array_sort(F.collect_list(F.struct("i", value)))
    return kept.groupBy(*group).agg(F.transform(sorted_values, lambda s: s[value]).alias(out))


def field_stats(docs: DataFrame, fields: DataFrame, targets: DataFrame) -> DataFrame:
    """Per (class, target field): total_seen, found_count, confidence_sum, first 6 examples.

    `docs`: document_id, class_id, created_at; `targets`: class_id, field_name (a rule table).
    total_seen is the class's document count, so no document x field rows are made.
    """
    seen = docs.groupBy("class_id").agg(F.count(F.lit(1)).alias("total_seen"))
    wanted = F.broadcast(targets.select("class_id", "field_name"))
    # only names that some class wants are dealt out, by document, where they meet their document
    named = fields.join(F.broadcast(targets.select("field_name").distinct()), "field_name", "left_semi")
    last = by_document(named, "document_id", "field_name", F.struct("field_id", "field_value", "confidence").alias("v")).groupBy(
        "document_id", "field_name").agg(F.max("v").alias("l"))
    rows = last.join(docs.select("document_id", "class_id", "created_at"), "document_id").join(
        wanted, ["class_id", "field_name"]).select(
        "class_id", "field_name", "document_id", "created_at",
        F.col("l.field_value").alias("field_value"), F.col("l.confidence").alias("confidence"))
    # one stored row per value serves counts and examples, so fields meet their documents once
    group = ["class_id", "field_name"]
    values = stored(rows.groupBy(*group, "field_value").agg(
        F.min(F.struct("created_at", "document_id")).alias("o"), F.count(F.lit(1)).alias("n"),
        F.sum(F.col("confidence").cast("decimal(18,6)")).alias("c")), "field-values")
    found = values.groupBy(*group).agg(F.sum("n").alias("found_count"), F.sum("c").alias("confidence_sum"))
    examples = _ranked_values(values, group, "field_value", 6, "examples")
    return seen.join(wanted, "class_id").join(found, ["class_id", "field_name"], "left").join(
        examples, ["class_id", "field_name"], "left").select(
        "class_id", "field_name", "total_seen", F.coalesce("found_count", F.lit(0)).alias("found_count"),
        F.coalesce(F.col("confidence_sum").cast("double"), F.lit(0.0)).alias("confidence_sum"),
        F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def _rate(found: Column, total: Column) -> Column:
    return found.cast("decimal(18,0)") / F.greatest(total, F.lit(1)).cast("decimal(18,0)")


def _avg(total: Column, found: Column) -> Column:
    return F.when(found > 0, total.cast("decimal(18,6)") / found.cast("decimal(18,0)")).otherwise(F.lit(0).cast("decimal(18,6)"))


def computed_field_stats(stats: DataFrame) -> DataFrame:
    """Occurrence rate and average confidence (2 decimals); most frequent first."""
    return stats.select(
        "class_id", "field_name", "total_seen", "found_count",
        rounded(_rate(F.col("found_count"), F.col("total_seen")), 2).alias("occurrence_rate"),
        rounded(_avg(F.col("confidence_sum"), F.col("found_count")), 2).alias("avg_confidence"),
        F.slice("examples", 1, 3).alias("examples")).orderBy("class_id", F.desc("occurrence_rate"), "field_name")


def schema_quality_gate(stats: DataFrame, occurrence: str = "0.40", confidence: str = "0.76",
                        coverage: str = "0.55") -> DataFrame:
    """Whether enough target fields are frequent and sure enough to propose a schema."""
    d = lambda s: F.lit(s).cast("decimal(6,4)")
    good = (_rate(F.col("found_count"), F.col("total_seen")) >= d(occurrence)) & (
        _avg(F.col("confidence_sum"), F.col("found_count")) >= d(confidence))
    return stats.groupBy("class_id").agg(
        F.count(F.lit(1)).alias("target_fields"), F.count_if(good).alias("qualifying")
    ).withColumn("passed", _rate(F.col("qualifying"), F.col("target_fields")) >= d(coverage))


def propose_schema(stats: DataFrame) -> DataFrame:
    """Proposed schema row per target field: required (occurrence >= .70), rates, hint, 3 examples."""
    occ = F.round(_rate(F.col("found_count"), F.col("total_seen")), 2)
    kind = F.col("format_type")
    unique = F.array_distinct(F.filter(F.transform("examples", lambda v: F.trim(v)), lambda v: v != ""))
    hint = F.when((F.size("examples") > 0) & (kind != "text") & (F.col("format_confidence") >= 0.40), build_hint(kind, unique)).otherwise(F.lit(""))
    return infer_formats(stats, "examples").select(
        "class_id", "field_name", F.initcap(F.translate("field_name", "_", " ")).alias("description"),
        (occ >= F.lit("0.70").cast("decimal(4,2)")).alias("required"), occ.cast("double").alias("occurrence_rate"),
        rounded(_avg(F.col("confidence_sum"), F.col("found_count")), 2).alias("avg_confidence"),
        hint.alias("format_hint"), F.slice("examples", 1, 3).alias("examples"))


def infer_formats(rows: DataFrame, values: str) -> DataFrame:
    """Adds format_type and confidence for a bounded array of values.

    The most frequent format (first seen on ties) must cover 60 %, else text (.40); text,
    code or boolean values that repeat are an enumeration (.80); else the average
    confidence of the values of that format times their share, 3 decimals.

    Steps are separate columns on purpose: a lambda evaluates everything it mentions once
    per element.
    """
    keep = rows.columns
    k = F.col("_kinds")
    staged = (
        rows.withColumn("_typed", F.transform(values, lambda v: classify_value(v)))
        .withColumn("_trimmed", F.transform(values, lambda v: F.trim(v)))
        .withColumn("_kinds", F.transform("_typed", lambda t: t["type"]))
        .withColumn("_unique", F.array_distinct("_trimmed"))
        .withColumn("_top", F.array_max(F.transform(F.array_distinct("_kinds"), lambda t, i: F.struct(
            F.size(F.filter(k, lambda x: x == t)).alias("n"), (-i).alias("i"), t.alias("type")))))
        .withColumn("_type", F.col("_top.type"))
        .withColumn("_n", F.col("_top.n"))
        .withColumn("_sum", F.aggregate(
            F.filter("_typed", lambda t: t["type"] == F.col("_type")), F.lit(0).cast("decimal(18,6)"),
            lambda a, t: (a + t["conf"].cast("decimal(18,6)")).cast("decimal(18,6)")))
        .withColumn("_repeated", F.size(F.filter("_unique", lambda u: F.size(F.filter("_trimmed", lambda t: t == u)) >= 2)))
    )
    n = F.size(values)
    is_enum = (F.col("_type").isin("text", "code", "boolean") & (F.size("_unique") <= 7) & (n >= 4) & (F.col("_repeated") >= 2)
               & F.forall("_unique", lambda u: F.length(u) <= 30))
    out = lambda t, c: F.struct(t.alias("t"), c.cast("double").alias("c"))
    # average of its values times its share = their sum over all values
    f = (
        F.when(n == 0, out(F.lit("text"), F.lit(0.0)))
        .when(F.col("_n") * 10 < n * 6, out(F.lit("text"), F.lit(0.40)))
        .when(is_enum, out(F.lit("enum"), F.lit(0.80)))
        .otherwise(out(F.col("_type"), F.round(F.col("_sum") / n.cast("decimal(18,0)"), 3)))
    )
    return staged.withColumn("_f", f).select(*keep, F.col("_f.t").alias("format_type"), F.col("_f.c").alias("format_confidence"))


def majority_format(docs: DataFrame, fields: DataFrame, n: int = 30) -> DataFrame:
    """Format of each (layout, field) from its n newest distinct scalar values.

    Newest by field_id.  Out: type, confidence, hint, examples, value count.
    """
    rows = fields.filter((F.col("field_type") == "scalar") & (F.coalesce("field_value", F.lit("")) != "")).join(
        docs.filter(F.col("variant_id").isNotNull()).select("document_id", "variant_id"), "document_id")
    values = first_distinct(rows, ["variant_id", "field_name"], "field_value", -F.col("field_id"), n, "vals")
    kind = F.col("format_type")
    return infer_formats(values, "vals").select(
        "variant_id", "field_name", F.size("vals").alias("value_count"), "format_type",
        F.col("format_confidence").alias("confidence"), build_hint(kind, F.col("vals")).alias("format_hint"),
        pick_examples(kind, F.col("vals")).alias("examples"))


def value_formats(fields: DataFrame) -> DataFrame:
    """How many values of each field have which format (no sampling)."""
    typed = fields.filter(F.coalesce("field_value", F.lit("")) != "").select(
        "field_name", classify_value(F.col("field_value")).alias("t"))
    return typed.groupBy("field_name", F.col("t.type").alias("format_type")).agg(F.count(F.lit(1)).alias("values"))


def advance_stages(profiles: DataFrame, gate: DataFrame) -> DataFrame:
    """One step of the class ladder: ZERO_SHOT -> LEARNING at 3, -> LEARNED_PROPOSED at 10 with the gate passed.

    `profiles`: class_id, learning_stage, doc_count[, parsability]; also flags LEARNED
    classes that have 25 documents and an unknown parsability.
    """
    j = profiles.join(F.broadcast(gate.select("class_id", "passed")), "class_id", "left")
    stage, n = F.col("learning_stage"), F.col("doc_count")
    assess = (stage == "LEARNED") & (n >= 25)
    if "parsability" in profiles.columns:
        assess = assess & (F.col("parsability") == "UNKNOWN")
    return j.select(
        "class_id", "doc_count", stage.alias("old_stage"),
        F.when((stage == "ZERO_SHOT") & (n >= 3), "LEARNING")
        .when((stage == "LEARNING") & (n >= 10) & F.coalesce("passed", F.lit(False)), "LEARNED_PROPOSED")
        .otherwise(stage).alias("new_stage"), assess.alias("assess_parsability"))


def schema_hints(profiles: DataFrame, stats: DataFrame, schema: DataFrame) -> DataFrame:
    """Hints per class and field for its stage.

    LEARNED/OPTIMISED: the confirmed schema's entries that are filled; LEARNING/PROPOSED:
    3 examples and how often the field was found; else nothing.
    `schema`: class_id, field_name, format_hint, example_values.
    """
    p = F.broadcast(profiles.select("class_id", "learning_stage", "doc_count"))
    confirmed = schema.join(p, "class_id").filter(F.col("learning_stage").isin("LEARNED", "OPTIMISED")).select(
        "class_id", "field_name", F.lit("schema").alias("source"),
        F.nullif("format_hint", F.lit("")).alias("format_hint"), "example_values",
        F.lit(None).cast("string").alias("occurrence_note"))
    share = F.floor(F.round(F.col("found_count") / F.greatest("doc_count", F.lit(1)), 2) * 100 + 0.5).cast("int")
    learned = stats.join(p, "class_id").filter(
        F.col("learning_stage").isin("LEARNING", "LEARNED_PROPOSED") & (F.col("found_count") > 0) & (F.size("examples") > 0)
    ).select("class_id", "field_name", F.lit("examples").alias("source"), F.lit(None).cast("string").alias("format_hint"),
             F.slice("examples", 1, 3).alias("example_values"),
             F.concat(F.lit("found in "), share, F.lit("% of prior docs")).alias("occurrence_note"))
    return confirmed.unionByName(learned)


def stage_timeline(docs: DataFrame) -> DataFrame:
    """Document number within its layout and the stage the layout had reached with it.

    The numbering is split by ranges, so a layout with most documents is not one task.
    """
    numbered = running_number(docs.filter(F.col("variant_id").isNotNull()), "variant_id", ["created_at", "document_id"], "doc_no")
    return numbered.select("variant_id", "document_id", "created_at", "doc_no",
                           learning_stage(F.col("doc_no")).alias("stage"))


def confirmed_instances(docs: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrected documents per layout; only the first correction of a document counts."""
    first = corrections.groupBy("document_id").agg(F.min("corrected_at").alias("first_corrected_at"))
    return first.join(docs.filter(F.col("variant_id").isNotNull()).select("document_id", "variant_id"), "document_id").groupBy(
        "variant_id").agg(F.count(F.lit(1)).alias("confirmed_instances"), F.min("first_corrected_at").alias("first_corrected_at"))


def variant_schema_from_counts(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """Proposed schema of layouts without a confirmed one: fields by frequency, example from the newest document.

    Fields meet their documents once, for counts and examples: a row of a newest document is counted under
    its value, all others of a name under none. The newest documents are stored, so Spark sees that they are few.
    """
    named = docs.filter(F.col("variant_id").isNotNull()).select("document_id", "variant_id", "created_at")
    newest = stored(newest_n(named, "variant_id", 1).select("document_id", "variant_id", F.lit(True).alias("newest")), "newest-documents")
    marked = named.drop("created_at").join(newest, ["document_id", "variant_id"], "left")
    rows = fields.select("document_id", "field_name", "field_value", "field_id").join(marked, "document_id")
    shown = F.when(F.col("newest") & F.col("field_name").isNotNull(), F.struct("field_id", F.coalesce("field_value", F.lit("")).alias("value")))
    counts = rows.groupBy("variant_id", "field_name", shown.alias("shown")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("variant_id", "field_name").agg(
        F.sum("n").alias("documents"), F.coalesce(F.min_by("shown.value", "shown.field_id"), F.lit("")).alias("example"))


def variant_field_confidence(docs: DataFrame, fields: DataFrame, schema: DataFrame) -> DataFrame:
    """Average confidence per (layout, canonical field) over all its aliases, as whole percent.

    `schema`: variant_id, canonical, alias (one row per alias, the canonical name included).
    """
    rows = fields.select("document_id", "field_name", "confidence").join(
        docs.filter(F.col("variant_id").isNotNull()).select("document_id", "variant_id"), "document_id")
    sums = rows.groupBy("variant_id", "field_name").agg(
        F.sum(F.col("confidence").cast("decimal(18,6)")).alias("s"), F.count("confidence").alias("n"))
    j = schema.join(sums, (schema["variant_id"] == sums["variant_id"]) & (schema["alias"] == sums["field_name"]), "left").select(
        schema["variant_id"], "canonical", "s", "n")
    return j.groupBy("variant_id", "canonical").agg(
        F.coalesce(F.floor(F.sum("s") * 100 / F.sum("n")).cast("int"), F.lit(0)).alias("confidence_pct"))


def coverage_matrix(docs: DataFrame, fields: DataFrame, schema: DataFrame, n: int = 8) -> DataFrame:
    """found (>= .70) / low / missing for the n newest documents of a layout and its schema fields."""
    newest = newest_n(docs.filter(F.col("variant_id").isNotNull()).select("document_id", "variant_id", "created_at"),
                      "variant_id", n).select("document_id", "variant_id", "rank")
    cells = newest.join(schema.select("variant_id", "canonical", "alias"), "variant_id")
    best = cells.join(
        fields.select("document_id", F.col("field_name").alias("alias"), "confidence"), ["document_id", "alias"], "left"
    ).groupBy("variant_id", "document_id", "canonical").agg(F.max("confidence").alias("c"))
    return best.select("variant_id", "document_id", "canonical", F.when(F.col("c").isNull(), "missing").when(
        F.col("c") >= 0.70, "found").otherwise("low").alias("cell"))


def class_overview(classes: DataFrame, variants: DataFrame, docs: DataFrame, schema: DataFrame) -> DataFrame:
    """Per class: layouts, their documents, best stage, schema fields, last activity."""
    per_class = variants.groupBy("class_id").agg(
        F.count(F.lit(1)).alias("variant_count"), F.sum("doc_count").alias("doc_count"),
        F.max_by("learning_stage", stage_rank(F.col("learning_stage"))).alias("best_stage"))
    fields = schema.select("variant_id", "canonical").distinct().join(
        variants.select("variant_id", "class_id"), "variant_id").groupBy("class_id").agg(F.count(F.lit(1)).alias("schema_fields"))
    last = docs.groupBy("class_id").agg(F.max("created_at").alias("last_activity"))
    return classes.select("class_id", "name").join(per_class, "class_id", "left").join(fields, "class_id", "left").join(
        last, "class_id", "left").select(
        "class_id", "name", F.coalesce("variant_count", F.lit(0)).alias("variant_count"),
        F.coalesce("doc_count", F.lit(0)).alias("doc_count"), F.coalesce("best_stage", F.lit("ZERO_SHOT")).alias("best_stage"),
        F.coalesce("schema_fields", F.lit(0)).alias("schema_fields"), "last_activity")


def last_activity(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("variant_id").isNotNull()).groupBy("variant_id").agg(F.max("created_at").alias("last_activity"))


def rename_schema(schema: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply schema edits: drop, rename, merge aliases.

    `schema`: variant_id, canonical, aliases array, example; `edits`: variant_id, canonical,
    keep, new_name, aliases (null = as they are).  Old and new name stay among the aliases;
    fields without an edit row are dropped, as are those with keep = false.  Two fields
    renamed to one name merge, in old-name order.
    """
    e = edits.select("variant_id", "canonical", "keep", "new_name", F.col("aliases").alias("given"))
    j = schema.join(e, ["variant_id", "canonical"]).filter("keep")
    clean = F.translate(F.lower(F.trim(F.coalesce("new_name", F.lit("")))), " ", "_")
    name = F.when(clean == "", F.col("canonical")).otherwise(clean)
    base = F.when(F.size(F.coalesce("given", F.array().cast("array<string>"))) > 0, F.col("given")).otherwise(F.col("aliases"))
    rows = j.select("variant_id", "canonical", name.alias("new_canonical"), "example",
                    F.array_distinct(F.concat(base, F.array("canonical", name))).alias("aliases"))
    merged = F.array_sort(F.collect_list(F.struct("canonical", "aliases", "example")))
    return rows.groupBy("variant_id", "new_canonical").agg(merged.alias("m")).select(
        "variant_id", F.col("new_canonical").alias("canonical"),
        F.array_distinct(F.flatten(F.transform("m", lambda x: x["aliases"]))).alias("aliases"),
        F.element_at("m", -1)["example"].alias("example"))
