"""Where each document ends up, from the results of all stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafstack.operators import (
    audits, bundles, classify, dedup, extract, layouts, links, outputs, pages, quality, trimatch)
from leafstack.plans import stages as S

for _name, _fn in {
    "splitting": bundles.split_bundles, "deduplication": dedup.dedup_documents,
    "classification": classify.classify_documents, "extraction": extract.extract_fields,
    "variant_discovery": layouts.discover_variants, "signature": layouts.signature_location,
    "validation": quality.validate, "linking": links.link_documents, "matching": trimatch.three_way_match,
    "posting": outputs.posting_payloads, "filing": outputs.filing_index, "notifying": outputs.completion_events,
}.items():
    S.stage(_name)(_fn)
for _name, _fn in {
    "extraction_quality_audit": audits.quality_audit, "page_score_audit": pages.page_audit_summary,
    "field_usage_audit": audits.usage_audit, "cost_optimisation_report": audits.cost_report,
}.items():
    S.report(_name)(_fn)


def route_documents(docs: DataFrame, classes: DataFrame, duplicates: DataFrame | None = None,
                    amendments: DataFrame | None = None, field_counts: DataFrame | None = None,
                    validation: DataFrame | None = None, effects: DataFrame | None = None,
                    matches: DataFrame | None = None, segments: DataFrame | None = None) -> DataFrame:
    """Final status, the stage that decided it, and the reason, per document.

    The first that applies: split into several documents; exact or content duplicate; no
    class or no fields (triage: new type or review); near duplicate with or without changed
    fields; validation; an instruction that asks for approval; a failed match that is not
    advisory; else completed.  Stages a document skips do not decide.

    Every input has one row per document, so this is one chain of left joins on
    document_id and a single `when`: with inputs partitioned by document_id, no reshuffle.
    """
    def attach(df: DataFrame, other: DataFrame | None, **cols: str) -> DataFrame:
        if other is None:
            return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in cols.items()])
        return df.join(other.select("document_id", *cols), "document_id", "left")

    optional = {"skip_stages": "array<string>", "match_mode": "string", "class_confidence": "double"}
    d = docs.select(
        "document_id", "class_id",
        *[F.col(c) if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in optional.items()])
    d = d.join(F.broadcast(classes.select("class_id", "treatment")), "class_id", "left")
    d = attach(d, segments, segments="bigint")
    d = attach(d, duplicates, duplicate_type="string", original_document_id="string")
    d = attach(d, amendments, changed_fields="bigint", reason="string").withColumnRenamed("reason", "diff_reason")
    d = attach(d, field_counts, field_count="bigint")
    d = attach(d, validation, is_valid="boolean", reason="string").withColumnRenamed("reason", "nigo_reason")
    d = attach(d, effects, needs_approval="boolean", approval_rule="int", skip_posting="boolean", skip_matching="boolean")
    d = attach(d, matches, outcome="string")

    skipped = S.skipped_stages(F.col("skip_stages"), F.col("match_mode"), F.col("treatment"))
    skipped = F.when(F.coalesce("skip_matching", F.lit(False)), F.array_union(skipped, F.array(F.lit("MATCHING")))).otherwise(skipped)
    skipped = F.when(F.coalesce("skip_posting", F.lit(False)), F.array_union(skipped, F.array(F.lit("POSTING")))).otherwise(skipped)
    d = d.withColumn("skipped", F.array_sort(F.array_distinct(skipped)))
    runs = lambda s: ~F.array_contains("skipped", s)

    count = F.coalesce("field_count", F.lit(0)) if field_counts is not None else F.lit(1)
    triage = classify.governance_triage(F.col("class_id"), F.coalesce("class_confidence", F.lit(1.0)), count)["verdict"]
    lost = F.when(triage == "NEW_TYPE", "CANDIDATE_NEW_CLASS").otherwise("NEEDS_REVIEW")

    def end(status, stage: str, reason):
        status = F.lit(status) if isinstance(status, str) else status
        reason = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(status.alias("status"), F.lit(stage).alias("decided_by"), reason.alias("reason"))

    near = runs("DEDUPLICATION") & (F.col("duplicate_type") == "NEAR_DUPLICATE")
    final = classify.first_true([
        (runs("SPLITTING") & (F.col("segments") > 1), end("COMPLETED", "splitting", "Split into several documents")),
        (runs("DEDUPLICATION") & F.col("duplicate_type").isin("EXACT_DUPLICATE", "CONTENT_DUPLICATE"),
         end(F.col("duplicate_type"), "deduplication", F.concat(F.lit("Original document: "), "original_document_id"))),
        (F.col("class_id").isNull(), end(lost, "classification", "No document class")),
        (count == 0, end(lost, "extraction", "No fields extracted")),
        (near & (F.col("changed_fields") > 0), end("NEEDS_REVIEW", "amendment", F.col("diff_reason"))),
        (near & (F.coalesce("changed_fields", F.lit(0)) == 0), end("CONTENT_DUPLICATE", "amendment", "No field changes")),
        (runs("VALIDATION") & ~F.coalesce("is_valid", F.lit(True)), end("NEEDS_REVIEW", "validation", F.col("nigo_reason"))),
        (runs("VALIDATION") & F.coalesce("needs_approval", F.lit(False)),
         end("NEEDS_REVIEW", "instructions", F.concat(F.lit("Instruction #"), F.col("approval_rule"), F.lit(" requires manual approval.")))),
        (runs("MATCHING") & (trimatch.match_routing(F.col("outcome"), F.col("match_mode")) == "NEEDS_REVIEW"),
         end("NEEDS_REVIEW", "matching", "NIGO - Three-way match FAIL.")),
    ], end("COMPLETED", "completion", F.lit(None).cast("string")))
    return d.select("document_id", "class_id", F.array_join("skipped", ",").alias("skipped"), final.alias("e")).select(
        "document_id", "class_id", "skipped", F.col("e.status").alias("status"),
        F.col("e.decided_by").alias("decided_by"), F.col("e.reason").alias("reason"))
