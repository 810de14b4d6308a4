"""The long field table: one row per document and field.

Columns: field_id, document_id, ordinal, field_name, field_value, field_type,
confidence, extraction_method, human_corrected, corrected_value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafstack.operators.common import exact_avg, rounded, unfold


def effective_value() -> Column:
    """The correction if there is one, else the value, else ''; a null correction stays null."""
    return F.when(F.col("human_corrected"), F.col("corrected_value")).otherwise(
        F.coalesce("field_value", F.lit("")))


def diff_value() -> Column:
    """As `effective_value`, but a missing value stays null."""
    return F.when(F.col("human_corrected"), F.col("corrected_value")).otherwise(F.col("field_value"))


def display_value() -> Column:
    return F.coalesce(F.nullif("corrected_value", F.lit("")), F.nullif("field_value", F.lit("")), F.lit("—"))


def with_values(fields: DataFrame) -> DataFrame:
    return fields.select("*", effective_value().alias("effective_value"),
                         diff_value().alias("diff_value"), display_value().alias("display_value"))


def by_document(rows: DataFrame, *columns: Column | str) -> DataFrame:
    """`columns` of the rows, dealt out by document.

    Names hardly repeat in a document, so a partial aggregate before the shuffle would sort all rows and
    save none.  Dealt out by document first, rows are sorted once, and what follows by document stays in place.
    """
    return rows.select(*columns).repartition("document_id")


def last_per_name(fields: DataFrame, value: Column | None = None, out: str = "value") -> DataFrame:
    """One row per (document, field name); of repeated names the last field_id wins.

    The rows of a document stay together.
    """
    v = effective_value() if value is None else value
    rows = by_document(fields, "document_id", "field_name", "field_id", v.alias("v"))
    return rows.groupBy("document_id", "field_name").agg(
        F.max(F.struct("field_id", "v")).alias("_last")
    ).select("document_id", "field_name", F.col("_last.v").alias(out))


def field_map(fields: DataFrame, names: Sequence[str], value: Column | None = None) -> DataFrame:
    """One row per document with the named fields as columns (last field_id wins, absent = null).

    Only rows with these names are shuffled, once, by document.  Documents that carry their map (`fields`, as
    of `field_dict`) are read from it, once each; one without fields has no row.
    """
    if "fields" in fields.columns:
        held = fields.filter(F.size("fields") > 0)
        return held.select("document_id", *[F.try_element_at("fields", F.lit(n)).alias(n) for n in names]).dropDuplicates(["document_id"])
    v = effective_value() if value is None else value
    wanted = fields.filter(F.col("field_name").isin(list(names))).select(
        "document_id", "field_name", F.struct(F.col("field_id"), v.alias("v")).alias("fv"))
    agg = wanted.groupBy("document_id").agg(
        *[F.max(F.when(F.col("field_name") == n, F.col("fv"))).alias(n) for n in names])
    return agg.select("document_id", *[F.col(f"`{n}`.v").alias(n) for n in names])


def field_dict(fields: DataFrame, value: Column | None = None) -> DataFrame:
    """One map per document; its size is bounded by the fields one document has.  Rows that are such maps already stay."""
    if "fields" in fields.columns:
        return fields.select("document_id", "fields")
    last = last_per_name(fields, value)
    return last.groupBy("document_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_name", "value")))).alias("fields"))


def document_field_summary(fields: DataFrame) -> DataFrame:
    """field_count and average confidence (4 decimals) per document."""
    return fields.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("field_count"),
        rounded(exact_avg(F.col("confidence")), 4).alias("avg_confidence"))


def canonicalise(fields: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """Aliases become canonical names; of several the highest confidence stays, then the first.

    Names without an alias pass through.  `aliases` is a bounded rule map and becomes a
    literal, so there is no join.
    """
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else None
    name = F.coalesce(F.try_element_at(table, F.col("field_name")), F.col("field_name")) if aliases else F.col("field_name")
    best = F.max_by(F.struct("field_name", "field_value", "confidence"),
                    F.struct(F.col("confidence"), -F.col("ordinal")))
    return fields.groupBy("document_id", name.alias("canonical_name")).agg(best.alias("b")).select(
        "document_id", "canonical_name", F.col("b.field_name").alias("source_name"),
        F.col("b.field_value").alias("field_value"), F.col("b.confidence").alias("confidence"))


def field_diff(pairs: DataFrame, fields: DataFrame) -> DataFrame:
    """Fields that differ between two documents.

    `pairs` has (document_id, original_document_id).  The fields of a document are one array, so
    one row per pair meets its original, and both are compared in the row: null stands for the absent side.
    """
    values = last_per_name(fields, diff_value()).groupBy("document_id").agg(
        F.collect_list(F.struct("field_name", "value")).alias("held"))
    once = by_document(pairs, "document_id", "original_document_id").distinct()
    mine = once.join(values, "document_id", "left").withColumnRenamed("held", "mine")
    both = mine.join(values.select(F.col("document_id").alias("original_document_id"), F.col("held").alias("theirs")),
                     "original_document_id", "left")
    none = F.array().cast(values.schema["held"].dataType)
    both = both.select("document_id", "original_document_id", F.coalesce("mine", none).alias("mine"), F.coalesce("theirs", none).alias("theirs"))
    names = F.array_distinct(F.concat(F.transform("mine", lambda x: x["field_name"]), F.transform("theirs", lambda x: x["field_name"])))

    def value(side: str, name: Column) -> Column:
        return F.get(F.filter(side, lambda x: x["field_name"].eqNullSafe(name)), 0)["value"]

    compared = F.transform(names, lambda n: F.struct(n.alias("field_name"), value("mine", n).alias("incoming_value"), value("theirs", n).alias("original_value")))
    changed = F.filter(compared, lambda c: ~c["incoming_value"].eqNullSafe(c["original_value"]))
    return unfold(both, ["document_id", "original_document_id"], changed, "c").select("document_id", "original_document_id", "c.*")


def amendment_outcome(pairs: DataFrame, diffs: DataFrame) -> DataFrame:
    """A near duplicate with changed fields needs review; without any it is a content duplicate.

    The reason shows the first 10 names and the first 6 changes, as a short display text;
    all changes stay in `diffs`.
    """
    shown = F.array_sort(F.collect_list(F.struct("field_name", "original_value", "incoming_value")))
    grouped = diffs.groupBy("document_id").agg(F.count(F.lit(1)).alias("changed"), shown.alias("d"))
    quoted = lambda v: F.coalesce(F.concat(F.lit("'"), v, F.lit("'")), F.lit("None"))
    lines = F.transform(F.slice("d", 1, 6), lambda d: F.concat(
        d["field_name"], F.lit(": "), quoted(d["original_value"]), F.lit(" -> "), quoted(d["incoming_value"])))
    names = F.transform(F.slice("d", 1, 10), lambda d: d["field_name"])
    joined = pairs.select("document_id", "original_document_id").join(grouped, "document_id", "left")
    return joined.select(
        "document_id", "original_document_id",
        F.coalesce("changed", F.lit(0)).alias("changed_fields"),
        F.when(F.col("changed") > 0, "NEEDS_REVIEW").otherwise("CONTENT_DUPLICATE").alias("status"),
        F.when(F.col("changed") > 0, F.concat(
            F.lit("NEAR_DUPLICATE - "), F.col("changed"), F.lit(" field(s) changed vs original "),
            F.col("original_document_id"), F.lit(". Changed: "), F.array_join(names, ", "),
            F.lit(". Detail: "), F.array_join(lines, " | "))).alias("reason"))


def explode_tables(fields: DataFrame) -> DataFrame:
    """Rows of table-typed fields; columns come from the first row, bad JSON gives no row."""
    parsed = F.from_json("field_value", "array<map<string,string>>")
    tables = fields.filter(F.col("field_type") == "table").select(
        "document_id", "field_name", parsed.alias("rows"))
    tables = tables.select(
        "document_id", "field_name", "rows", F.coalesce(F.size("rows"), F.lit(0)).alias("row_count"),
        F.map_keys(F.get("rows", 0)).alias("columns"))
    return tables.select(
        "document_id", "field_name", F.greatest("row_count", F.lit(0)).alias("row_count"), "columns",
        F.posexplode_outer("rows").alias("row_no", "row"))


def second_opinion(fields: DataFrame, formats_ok: Column) -> DataFrame:
    """Confidence +.04 (at most .97) for a fitting format, -.06 (at least .50) for a bad one."""
    c = F.col("confidence").cast("decimal(10,6)")
    new = (
        F.when(formats_ok, F.least(c + F.lit("0.04").cast("decimal(3,2)"), F.lit("0.97").cast("decimal(3,2)")))
        .when(~formats_ok, F.greatest(c - F.lit("0.06").cast("decimal(3,2)"), F.lit("0.50").cast("decimal(3,2)")))
        .otherwise(c)
    )
    return fields.withColumn("new_confidence", rounded(new, 4))


def low_confidence(fields: DataFrame, stage: Column, threshold: float = 0.85) -> DataFrame:
    """Fields below the threshold of documents in an early stage, before a second opinion."""
    return fields.filter((F.col("confidence") < threshold) & stage.isin("ZERO_SHOT", "LEARNING"))
