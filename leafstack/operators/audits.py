"""Reports: extraction quality, field usage, cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafstack.functions.names import TOKENS_PER_PAGE, cost_of
from leafstack.operators.common import newest_n, rounded


def newest_completed(docs: DataFrame, last_n: int) -> DataFrame:
    """The last_n newest completed documents overall (a top-n, not a full sort)."""
    return docs.filter(F.col("status") == "COMPLETED").orderBy(F.desc("created_at"), F.desc("document_id")).limit(last_n)


def quality_audit(docs: DataFrame, fields: DataFrame, schema: DataFrame, last_n: int = 20) -> DataFrame:
    """Health of each layout among the newest completed documents, worst first.

    Average confidence, field hit rate (1 without a schema), correction rate, most used
    method (first seen on ties), health = int(100 (.4 confidence + .4 hit rate + .2 (1 -
    corrections))), clamped to 0..100.  needs_review_rate is 0 by construction and kept.
    `schema`: variant_id, canonical.
    """
    sample = newest_completed(docs, last_n).select("document_id", F.coalesce("variant_id", F.lit("(none)")).alias("variant_id"))
    scalar = fields.filter(F.coalesce("field_type", F.lit("scalar")) != "table").join(F.broadcast(sample), "document_id")
    names = schema.select("variant_id", F.col("canonical").alias("field_name")).distinct()
    schema_size = names.groupBy("variant_id").agg(F.count(F.lit(1)).alias("schema_fields"))
    per_doc = scalar.groupBy("variant_id", "document_id").agg(
        F.bool_or("human_corrected").alias("corrected"),
        F.sum(F.col("confidence").cast("decimal(18,6)")).alias("conf_sum"), F.count("confidence").alias("conf_n"))
    hits = scalar.filter(F.coalesce("field_value", F.lit("")) != "").select("variant_id", "document_id", "field_name").distinct().join(
        names, ["variant_id", "field_name"]).groupBy("variant_id").agg(F.count(F.lit(1)).alias("hits"))
    method = scalar.groupBy("variant_id", F.coalesce("extraction_method", F.lit("UNKNOWN")).alias("method")).agg(
        F.count(F.lit(1)).alias("n"), F.min("field_id").alias("seen")).groupBy("variant_id").agg(
        F.min_by("method", F.struct(-F.col("n"), F.col("seen"))).alias("primary_method"))
    counts = sample.groupBy("variant_id").agg(F.count(F.lit(1)).alias("doc_count"))
    sums = per_doc.groupBy("variant_id").agg(
        F.count_if("corrected").alias("corrected"), F.sum("conf_sum").alias("s"), F.sum("conf_n").alias("n"))
    j = counts.join(sums, "variant_id", "left").join(hits, "variant_id", "left").join(
        schema_size, "variant_id", "left").join(method, "variant_id", "left")
    d = lambda c: c.cast("decimal(18,8)")
    conf = F.coalesce(d(F.col("s") / F.col("n")), d(F.lit(0)))
    hit = F.when(F.col("schema_fields").isNull(), d(F.lit(1))).otherwise(
        d(F.coalesce("hits", F.lit(0)).cast("decimal(12,0)") / (F.col("doc_count") * F.col("schema_fields")).cast("decimal(12,0)")))
    corr = d(F.coalesce("corrected", F.lit(0)).cast("decimal(12,0)") / F.col("doc_count").cast("decimal(12,0)"))
    point = lambda s: F.lit(s).cast("decimal(3,2)")
    health = F.floor((conf * point("0.40") + hit * point("0.40") + (1 - corr) * point("0.20")) * 100).cast("int")
    return j.select(
        "variant_id", "doc_count", rounded(conf, 3).alias("avg_confidence"), rounded(hit, 3).alias("field_hit_rate"),
        rounded(corr, 3).alias("correction_rate"), F.lit(0.0).alias("needs_review_rate"),
        F.coalesce("primary_method", F.lit("—")).alias("primary_method"),
        F.coalesce("schema_fields", F.lit(0)).alias("schema_field_count"),
        F.least(F.greatest(health, F.lit(0)), F.lit(100)).alias("health_score")).orderBy("health_score", "variant_id")


def quality_overall(audit: DataFrame) -> DataFrame:
    """Document-weighted health and how many layouts are flagged (< 70) or good (>= 80)."""
    return audit.agg(
        F.sum("doc_count").alias("docs_analysed"), F.count(F.lit(1)).alias("variants_seen"),
        F.floor(F.sum(F.col("health_score") * F.col("doc_count")) / F.sum("doc_count")).cast("int").alias("overall_health"),
        F.count_if(F.col("health_score") < 70).alias("flagged"), F.count_if(F.col("health_score") >= 80).alias("good"))


def review_rate(docs: DataFrame) -> DataFrame:
    """Real share of documents in review per layout (beside the audit's constant 0)."""
    return docs.groupBy(F.coalesce("variant_id", F.lit("(none)")).alias("variant_id")).agg(
        rounded(F.avg((F.col("status") == "NEEDS_REVIEW").cast("decimal(2,0)")), 4).alias("real_review_rate"))


def usage_audit(docs: DataFrame, fields: DataFrame, schema: DataFrame, last_n: int = 50) -> DataFrame:
    """How often and how surely each schema field is found in a layout's newest completed documents.

    A document has a field through the first alias that occurs in it.  rate < .10 unused;
    confidence < .60 with 5+ documents unreliable; rate >= .85 and confidence >= .80
    healthy; else moderate.  `schema`: variant_id, canonical, alias, alias_no.
    """
    sample = newest_n(docs.filter((F.col("status") == "COMPLETED") & F.col("variant_id").isNotNull()).select(
        "document_id", "variant_id", "created_at"), "variant_id", last_n).select("document_id", "variant_id")
    counts = sample.groupBy("variant_id").agg(F.count(F.lit(1)).alias("docs_sampled"))
    last = fields.filter(F.coalesce("field_type", F.lit("scalar")) != "table").join(sample, "document_id").groupBy(
        "variant_id", "document_id", F.col("field_name").alias("alias")).agg(
        F.max(F.struct("field_id", "field_value", "confidence")).alias("l"))
    hit = last.join(schema.select("variant_id", "canonical", "alias", "alias_no"), ["variant_id", "alias"]).groupBy(
        "variant_id", "document_id", "canonical").agg(F.min_by("l", "alias_no").alias("l"))
    found = hit.filter(F.coalesce(F.col("l.field_value"), F.lit("")) != "").groupBy("variant_id", "canonical").agg(
        F.count(F.lit(1)).alias("found_in"), F.sum(F.col("l.confidence").cast("decimal(18,6)")).alias("s"),
        F.count("l.confidence").alias("n"))
    names = schema.select("variant_id", "canonical").distinct()
    j = names.join(counts, "variant_id").join(found, ["variant_id", "canonical"], "left")
    rate = F.coalesce("found_in", F.lit(0)).cast("decimal(18,0)") / F.col("docs_sampled").cast("decimal(18,0)")
    conf = F.coalesce(F.col("s") / F.col("n"), F.lit(0).cast("decimal(18,6)"))
    status = (
        F.when(rate < F.lit("0.10").cast("decimal(3,2)"), "unused")
        .when((conf < F.lit("0.60").cast("decimal(3,2)")) & (F.col("docs_sampled") >= 5), "unreliable")
        .when((rate >= F.lit("0.85").cast("decimal(3,2)")) & (conf >= F.lit("0.80").cast("decimal(3,2)")), "healthy")
        .otherwise("moderate"))
    return j.select("variant_id", "canonical", "docs_sampled", F.coalesce("found_in", F.lit(0)).alias("found_in"),
                    rounded(rate, 3).alias("extraction_rate"), rounded(conf, 3).alias("avg_confidence"), status.alias("status"))


def by_severity(usage: DataFrame) -> DataFrame:
    """Unused first, then unreliable, moderate, healthy."""
    rank = (F.when(F.col("status") == "unused", 0).when(F.col("status") == "unreliable", 1)
            .when(F.col("status") == "moderate", 2).otherwise(3))
    return usage.withColumn("severity", rank).orderBy("variant_id", "severity", "canonical")


def cost_report(docs: DataFrame, variants: DataFrame, profile: DataFrame) -> DataFrame:
    """One row: pages read and skipped, tokens and cost saved, layouts by stage, projections.

    `profile` is a page profile (variant_id, page_num, instances, present_in, contributed_in, skip).
    """
    d = docs.agg(
        F.count(F.lit(1)).alias("total_docs"), F.count_if(F.col("status") == "COMPLETED").alias("completed_docs"),
        F.count("pages_total").alias("docs_with_pages"), F.coalesce(F.sum("pages_total"), F.lit(0)).alias("pages_seen"),
        F.coalesce(F.sum(F.when(F.col("pages_total").isNotNull(), F.coalesce("pages_skipped_count", F.lit(0)))), F.lit(0)).alias("pages_skipped"))
    per_variant = profile.groupBy("variant_id").agg(F.count_if("skip").alias("skips"), F.count_if(
        ~F.col("skip") & (F.col("present_in") >= 3) & (F.col("contributed_in") == 0)).alias("candidates"))
    v = variants.select("variant_id").join(per_variant, "variant_id", "left").agg(
        F.count(F.lit(1)).alias("total_variants"), F.count("skips").alias("variants_profiled"),
        F.count_if(F.col("skips") > 0).alias("stage_learned"), F.count_if(F.col("skips") == 0).alias("stage_learning"),
        F.count_if(F.col("skips").isNull()).alias("stage_no_profile"),
        F.coalesce(F.sum("candidates"), F.lit(0)).alias("skip_candidates"))
    both = d.unionByName(v, allowMissingColumns=True)
    both = both.agg(*[F.max(c).alias(c) for c in both.columns])     # two one-row tables side by side
    n = F.greatest("docs_with_pages", F.lit(1)).cast("decimal(18,0)")
    usd = lambda pages: F.round(pages * F.lit("0.0009").cast("decimal(6,4)"), 4)
    dec = lambda c: c.cast("decimal(18,0)")
    sampled = F.col("pages_seen") - F.col("pages_skipped")
    avg_all, avg_read = dec(F.col("pages_seen")) / n, dec(sampled) / n
    baseline, actual = usd(avg_all), usd(avg_read)
    saved = usd(dec(F.col("pages_skipped")))
    weekly = F.when(F.col("completed_docs") >= 4, F.greatest(F.lit(1), F.floor(F.col("completed_docs") / 4))).otherwise(F.col("completed_docs"))
    return both.select(
        "total_docs", "completed_docs", "docs_with_pages", "total_variants", "variants_profiled",
        "stage_learned", "stage_learning", "stage_no_profile", "pages_seen", "pages_skipped",
        sampled.alias("pages_sampled"), (F.col("pages_skipped") * TOKENS_PER_PAGE).alias("tokens_saved"),
        saved.cast("double").alias("cost_saved_usd"), rounded(avg_all, 1).alias("avg_pages_per_doc"),
        rounded(avg_read, 1).alias("avg_pages_sampled"), baseline.cast("double").alias("baseline_cost_per_doc"),
        actual.cast("double").alias("actual_cost_per_doc"),
        F.when(baseline > 0, F.floor((1 - actual / baseline) * 100)).otherwise(0).cast("int").alias("pct_reduction"),
        weekly.cast("bigint").alias("weekly_docs_avg"),
        rounded(saved / n * dec(weekly) * 52, 2).alias("annual_projected_saving"),
        "skip_candidates", cost_of(F.col("skip_candidates") * (TOKENS_PER_PAGE * 10)).alias("candidate_saving_usd"))


def run_stats(runs: DataFrame, today) -> DataFrame:
    """Per report: runs, runs today, last run and its status."""
    at = F.struct("started_at", "run_id")
    return runs.groupBy("report").agg(
        F.count(F.lit(1)).alias("total_runs"), F.count_if(F.to_date("started_at") == today).alias("runs_today"),
        F.max("started_at").alias("last_run"), F.max_by("status", at).alias("last_status"))


def delivery_stats(deliveries: DataFrame) -> DataFrame:
    """Per subscription: deliveries, failures (no or non-2xx answer), last status."""
    failed = F.col("status_code").isNull() | ~F.col("status_code").between(200, 299)
    return deliveries.groupBy("subscription_id").agg(
        F.count(F.lit(1)).alias("delivery_count"), F.count_if(failed).alias("failure_count"),
        F.max_by("status_code", F.struct("delivered_at", "delivery_id")).alias("last_status"))


