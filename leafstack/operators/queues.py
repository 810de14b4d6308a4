"""Search, queues, timelines and operator decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafstack import rules as R
from leafstack.operators.common import neighbour


def field_filter(fields: DataFrame, name: str, value: str | None = None) -> DataFrame:
    """Documents that have a field: by name, by exact value, or by a pattern with '*'.

    Value and correction are both tried.  With '*' the match ignores case, and % and _ in
    the value act as wildcards too.
    """
    rows = fields.filter(F.col("field_name") == name)
    if value is not None:
        test = (lambda c: c.ilike(value.replace("*", "%"))) if "*" in value else (lambda c: c == value)
        rows = rows.filter(F.coalesce(test(F.col("field_value")), F.lit(False))
                           | F.coalesce(test(F.col("corrected_value")), F.lit(False)))
    return rows.select("document_id").distinct()


def date_range(date_from: str | None = None, date_to: str | None = None, column: str = "created_at") -> Column:
    """The end day counts in full."""
    cond = F.lit(True)
    if date_from:
        cond &= F.col(column) >= F.lit(date_from).cast("timestamp_ntz")
    if date_to:
        cond &= F.col(column) < F.lit(date_to).cast("timestamp_ntz") + F.expr("interval 1 day")
    return cond


def search_documents(docs: DataFrame, fields: DataFrame | None = None, status: str | None = None,
                     class_id: str | None = None, shipment_id: str | None = None,
                     field_name: str | None = None, field_value: str | None = None,
                     date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """All given filters at once; scalar ones are pushed into the scan, the field one is a semi join."""
    out = docs.filter(date_range(date_from, date_to))
    for column, value in (("status", status), ("class_id", class_id), ("shipment_id", shipment_id)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    if field_name is not None and fields is not None:
        out = out.join(field_filter(fields, field_name, field_value), "document_id", "left_semi")
    return out


def search_shipments(shipments: DataFrame, status: str | None = None, match_result: str | None = None,
                     reference: str | None = None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """match_result 'null' means none yet; the reference may be any part, case ignored."""
    out = shipments.filter(date_range(date_from, date_to))
    if status is not None:
        out = out.filter(F.col("status") == status)
    if match_result is not None:
        out = out.filter(F.col("match_result").isNull() if match_result == "null" else F.col("match_result") == match_result)
    if reference is not None:
        out = out.filter(F.col("reference_key").ilike(f"%{reference}%"))
    return out


def search_variants(variants: DataFrame, class_id: str | None = None, stage: str | None = None,
                    active_only: bool = True) -> DataFrame:
    out = variants.filter("active") if active_only else variants
    if class_id is not None:
        out = out.filter(F.col("class_id") == class_id)
    if stage is not None:
        out = out.filter(F.col("learning_stage") == stage)
    return out.orderBy(F.desc("created_at"), "variant_id")


def paginate(rows: DataFrame, page: int = 1, page_size: int = 20, order: Sequence[Column] | None = None) -> DataFrame:
    """One page, newest first; the document id makes the order total. Any page size from 1 on is honoured."""
    if page < 1 or page_size < 1:
        raise ValueError(f"page and page_size count from 1, got {page} and {page_size}")
    by = list(order) if order else [F.desc("created_at"), F.desc("document_id")]
    return rows.orderBy(*by).offset((page - 1) * page_size).limit(page_size)


def page_count(rows: DataFrame, page_size: int = 20) -> DataFrame:
    """total and pages (0 when empty)."""
    if page_size < 1:
        raise ValueError(f"page_size counts from 1, got {page_size}")
    return rows.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / page_size))


def recent(rows: DataFrame, n: int = 10) -> DataFrame:
    return rows.orderBy(F.desc("created_at"), F.desc("document_id")).limit(n)


def status_summary(docs: DataFrame) -> DataFrame:
    """Counts by kind of status in one pass; what is left is being processed."""
    one = docs.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "COMPLETED").alias("completed"),
        F.count_if(F.col("status") == "NEEDS_REVIEW").alias("review"),
        F.count_if(F.col("status") == "CANDIDATE_NEW_CLASS").alias("discovery"),
        F.count_if(F.col("status") == "FAILED").alias("failed"))
    return one.withColumn("processing", F.col("total") - F.col("completed") - F.col("review") - F.col("discovery") - F.col("failed"))


def class_registry(classes: DataFrame, variants: DataFrame) -> DataFrame:
    """Classes with their number of layouts, 0 included."""
    n = variants.groupBy("class_id").agg(F.count("variant_id").alias("variant_count"))
    return classes.join(n, "class_id", "left").withColumn("variant_count", F.coalesce("variant_count", F.lit(0)))


def class_detail(variants: DataFrame, class_id: str) -> DataFrame:
    return variants.filter(F.col("class_id") == class_id).orderBy(F.desc("confirmed_instances"), "variant_id")


def with_names(docs: DataFrame, classes: DataFrame, variants: DataFrame) -> DataFrame:
    """Class and layout names beside each document; only the class table is broadcast."""
    return docs.join(F.broadcast(classes.select("class_id", F.col("name").alias("class_name"))), "class_id", "left").join(
        variants.select("variant_id", "variant_label"), "variant_id", "left")


def fields_available(docs: DataFrame) -> DataFrame:
    return docs.filter(~F.col("status").isin(R.EARLY_STATES))


def review_reasons(detail: Column) -> Column:
    """Conditions of a review reason: after 'condition(s) failed.' split at '|', else the whole text."""
    mark = "condition(s) failed."
    parts = F.filter(F.transform(F.split(F.substring_index(detail, mark, -1), r"\|"), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.contains(detail, F.lit(mark)) & (F.size(parts) > 0), parts).otherwise(F.array(detail))


def latest_review(events: DataFrame) -> DataFrame:
    """Last NEEDS_REVIEW event with a detail per document, its conditions, and a 120-character form."""
    rows = events.filter((F.col("state") == "NEEDS_REVIEW") & (F.coalesce("detail", F.lit("")) != ""))
    last = rows.groupBy("document_id").agg(F.max(F.struct("created_at", "event_id", "detail")).alias("l"))
    return last.select("document_id", F.col("l.created_at").alias("review_at"), F.col("l.detail").alias("detail"),
                       review_reasons(F.col("l.detail")).alias("reasons"),
                       F.substring("l.detail", 1, 120).alias("short_detail"))


def review_queue(docs: DataFrame, events: DataFrame, fields: DataFrame) -> DataFrame:
    """Documents in review, oldest change first, with reason and field count."""
    waiting = docs.filter(F.col("status") == "NEEDS_REVIEW").select("document_id", "class_id", "updated_at")
    counts = fields.groupBy("document_id").agg(F.count(F.lit(1)).alias("field_count"))
    return waiting.join(latest_review(events), "document_id", "left").join(counts, "document_id", "left").select(
        "document_id", "class_id", "updated_at", "detail", "reasons",
        F.coalesce("field_count", F.lit(0)).alias("field_count")).orderBy("updated_at", "document_id")


GOVERNANCE = "verdict string, reasoning string, confidence double, suggested_class_name string, suggested_class_description string"


def discovery_queue(docs: DataFrame) -> DataFrame:
    """Candidates for a new class, oldest first, with the parsed triage result."""
    g = F.from_json("governance_result", GOVERNANCE)
    return docs.filter(F.col("status") == "CANDIDATE_NEW_CLASS").select(
        "document_id", "created_at", g["verdict"].alias("verdict"), g["confidence"].alias("confidence"),
        g["suggested_class_name"].alias("suggested_class_name")).orderBy("created_at", "document_id")


def event_timeline(events: DataFrame) -> DataFrame:
    """Events of each document in order, with the next state and the seconds until it.

    Split by ranges, so a document with most events is not one task.
    """
    rows = neighbour(events.select("document_id", "event_id", "state", "created_at"), "document_id",
                     ["created_at", "event_id"], ["state", "created_at"], "next_", forward=True)
    seconds = F.unix_micros(F.col("next_created_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))
    return rows.select("document_id", "event_id", "state", "created_at", "next_state",
                       F.floor(seconds / 1_000_000).alias("dwell_seconds"))


def status_timeline(events: DataFrame) -> DataFrame:
    """When a document first entered each state."""
    return events.groupBy("document_id", "state").agg(F.min("created_at").alias("entered_at"), F.count(F.lit(1)).alias("times"))


def bad_transitions(events: DataFrame, allowed: DataFrame) -> DataFrame:
    """Events whose state may not follow the one before."""
    rows = neighbour(events.select("document_id", "event_id", "state", "created_at"), "document_id",
                     ["created_at", "event_id"], ["state"], "prev_").filter(F.col("prev_state").isNotNull())
    a = F.broadcast(allowed.select(F.col("from_state").alias("prev_state"), F.col("to_state").alias("state")))
    return rows.join(a, ["prev_state", "state"], "left_anti").select(
        "document_id", "event_id", "prev_state", "state", "created_at")


def apply_corrections(fields: DataFrame, corrections: DataFrame) -> DataFrame:
    """Fields with the newest correction of each (document, field) applied.

    `corrections`: document_id, field_name, new_value, corrected_by, corrected_at.
    """
    last = corrections.groupBy("document_id", "field_name").agg(
        F.max(F.struct("corrected_at", "new_value", "corrected_by")).alias("c"))
    j = fields.join(last, ["document_id", "field_name"], "left")
    hit = F.col("c").isNotNull()
    keep = [c for c in fields.columns if c not in ("human_corrected", "corrected_value", "corrected_by", "corrected_at")]
    old = lambda n, t: F.col(n) if n in fields.columns else F.lit(None).cast(t)
    return j.select(
        *keep, F.when(hit, F.lit(True)).otherwise(F.col("human_corrected")).alias("human_corrected"),
        F.when(hit, F.col("c.new_value")).otherwise(F.col("corrected_value")).alias("corrected_value"),
        F.when(hit, F.col("c.corrected_by")).otherwise(old("corrected_by", "string")).alias("corrected_by"),
        F.when(hit, F.col("c.corrected_at")).otherwise(old("corrected_at", "timestamp_ntz")).alias("corrected_at"))


def correction_events(corrections: DataFrame) -> DataFrame:
    return corrections.select(
        "document_id", F.lit("NEEDS_REVIEW").alias("state"), F.lit("CorrectionAgent").alias("agent"),
        F.concat(F.lit("Field '"), F.col("field_name"), F.lit("' corrected by "), F.col("corrected_by"), F.lit(".")).alias("detail"),
        F.col("corrected_at").alias("created_at"))


# Decision -> (state it needs, state it leads to; None = given with the decision).
DECISIONS = {
    "approve": ("NEEDS_REVIEW", None),
    "reject": ("NEEDS_REVIEW", "FAILED"),
    "retry": ("FAILED", "RECEIVED"),
    "promote": ("CANDIDATE_NEW_CLASS", "EXTRACTING"),
    "dismiss": ("CANDIDATE_NEW_CLASS", "NEEDS_REVIEW"),
    "reclassify": (None, "EXTRACTING"),
}


def apply_decisions(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Outcome of operator decisions: accepted with the new state, or refused with the reason.

    `decisions`: document_id, action, target (state for approve, class for promote,
    dismiss, reclassify), actor, decided_at.  Of several for a document the first counts,
    later ones are refused as superseded.
    """
    action, status, target = F.col("action"), F.col("status"), F.col("target")
    first = decisions.groupBy("document_id").agg(F.min(F.struct("decided_at", "action", "actor")).alias("f"))
    j = decisions.join(first, "document_id").join(docs.select("document_id", "status", "class_id"), "document_id", "left")
    need = F.create_map(*[F.lit(x) for a, (s, _) in DECISIONS.items() if s for x in (a, s)])
    goto = F.create_map(*[F.lit(x) for a, (_, s) in DECISIONS.items() if s for x in (a, s)])
    required = F.try_element_at(need, action)
    refused = (
        F.when(~action.isin(list(DECISIONS)), "unknown_action")
        .when(status.isNull(), "document_not_found")
        .when(F.struct("decided_at", "action", "actor") != F.col("f"), "superseded")
        .when(required.isNotNull() & (status != required), F.concat(F.lit("not_in_"), F.lower(required)))
        .when((action == "approve") & ~F.coalesce(target, F.lit("")).isin(R.APPROVE_TARGETS), "invalid_target_stage")
        .when((action == "reclassify") & target.isNull(), "class_not_found"))
    new_state = F.when(action == "approve", target).otherwise(F.try_element_at(goto, action))
    new_class = F.when(action.isin("promote", "dismiss", "reclassify"), F.coalesce(target, F.col("class_id"))).otherwise(F.col("class_id"))
    return j.select(
        "document_id", "action", "actor", "decided_at", F.col("status").alias("previous_status"), refused.alias("refused"),
        F.when(refused.isNull(), new_state).otherwise(status).alias("new_status"),
        F.when(refused.isNull(), new_class).otherwise(F.col("class_id")).alias("new_class_id"))


def next_class_id(classes: DataFrame) -> DataFrame:
    """Smallest unused dc_001, dc_002, ...; after dc_999 come dc_1000 and so on.

    The first number without a class is one more than a used number (or 0) whose successor is unused.
    """
    number = F.regexp_extract("class_id", r"^dc_(\d{3,})$", 1).try_cast("bigint")
    used = classes.select(number.alias("n")).where("n >= 1").distinct()
    before = used.select(F.col("n").alias("p")).unionAll(classes.sparkSession.range(1).select(F.col("id").alias("p")))
    free = before.join(used, F.col("n") == F.col("p") + 1, "left_anti")
    return free.agg(F.format_string("dc_%03d", F.min("p") + 1).alias("class_id"))
