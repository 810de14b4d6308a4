"""Pages: text assembly, field location, learned page profiles, budget sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafstack.functions.names import TOKENS_PER_PAGE, cost_of
from leafstack.functions.text import data_density
from leafstack.operators.common import rounded, unfold

MIN_INSTANCES = 3


def split_pages(docs: DataFrame, separator: str = "\n", id_col: str = "document_id") -> DataFrame:
    """One row per page: document_id, page_num (from 0), text."""
    return docs.select(id_col, F.posexplode(F.split("text", separator)).alias("page_num", "text"))


def document_text(pages: DataFrame) -> DataFrame:
    """Whole text of each document: non-empty pages in order, joined by a space, whitespace collapsed."""
    filled = pages.filter(F.coalesce(F.trim("text"), F.lit("")) != "")
    parts = F.array_sort(F.collect_list(F.struct("page_num", "text")))
    return filled.groupBy("document_id").agg(
        F.trim(F.regexp_replace(F.array_join(F.transform(parts, lambda p: p["text"]), " "), r"\s+", " ")).alias("text"))


def attribute_fields(pages: DataFrame, fields: DataFrame) -> DataFrame:
    """First page of the document that contains each field value; of documents without any text (null or
    blank on every page), all scalar fields (a field without a type is one) on all pages.

    Values under 4 characters are not searched; a table field is searched by the values of
    its first row.  The fields of a document travel as one array beside its pages, so a
    page is scanned once and only hits become rows.
    """
    first_row = F.map_values(F.get(F.from_json("field_value", "array<map<string,string>>"), 0))
    needles = F.when(F.col("field_type").eqNullSafe("table"), F.coalesce(first_row, F.array().cast("array<string>"))).otherwise(
        F.array("field_value"))
    cleaned = F.filter(F.transform(needles, lambda v: F.lower(F.trim(v))), lambda v: F.length(v) >= 4)
    wanted = fields.select("document_id", "field_name", cleaned.alias("needles")).filter(F.size("needles") > 0)
    packed = wanted.groupBy("document_id").agg(F.collect_list(F.struct("field_name", "needles")).alias("fs"))
    # lower-cased before the lambdas: what a lambda mentions is evaluated for every element
    low = pages.select("document_id", "page_num", F.lower("text").alias("low"))
    hits = unfold(low.join(packed, "document_id"), ["document_id", "page_num"],
                  F.filter("fs", lambda f: F.exists(f["needles"], lambda n: F.contains(F.col("low"), n))), "f")
    found = hits.groupBy("document_id", F.col("f.field_name").alias("field_name")).agg(
        F.min("page_num").alias("page_num"))
    filled = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")) != ""
    blind = pages.groupBy("document_id").agg(F.count_if(filled).alias("n")).filter("n = 0").select("document_id")
    scalar = fields.filter(F.coalesce("field_type", F.lit("scalar")) != "table").select("document_id", "field_name").distinct()
    everywhere = pages.join(blind, "document_id", "left_semi").select("document_id", "page_num").join(scalar, "document_id")
    return found.unionByName(everywhere.select("document_id", "field_name", "page_num"))


def search_candidates(value: Column) -> Column:
    """Texts to look for, in order: the value, unquoted, separators swapped, right and left part."""
    swaps = [("-", "/"), ("/", "-"), (".", "/"), (",", "")]
    out = [value, F.trim(F.regexp_replace(value, r"^[\"'()\[\]]+|[\"'()\[\]]+$", ""))]
    out += [F.trim(F.replace(value, F.lit(a), F.lit(b))) for a, b in swaps]
    for sep in (" — ", " | ", " / "):
        left = F.trim(F.substring_index(value, sep, 1))
        right = F.trim(F.substring(value, F.locate(sep, value) + len(sep), F.length(value)))
        has = F.contains(value, F.lit(sep))
        out.append(F.when(has & (F.length(right) >= 6), right))
        out.append(F.when(has & (F.length(left) >= 6) & ~F.contains(left, F.lit("/")), left))
    trimmed = F.transform(F.array(*out), lambda c: F.trim(c))
    return F.array_distinct(F.filter(trimmed, lambda c: F.length(c) >= 4))


def locate_fields(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """Page on which a value is found: the requested page first, then the lowest page.

    `requests`: document_id, field_name, value[, page_num wanted].  On a page the first
    search text that occurs is reported.
    """
    wanted = F.col("wanted_page") if "wanted_page" in requests.columns else F.lit(None).cast("int")
    asks = requests.select(
        "document_id", F.struct("field_name", wanted.alias("wanted"),
                                F.transform(search_candidates(F.col("value")), F.lower).alias("cands")).alias("ask"))
    packed = asks.groupBy("document_id").agg(F.collect_list("ask").alias("asks"))
    lowered = pages.select("document_id", "page_num", F.translate(F.lower("text"), "\n", " ").alias("low"))
    rows = unfold(lowered.join(packed, "document_id"), ["document_id", "page_num", "low"],
                  F.filter("asks", lambda a: F.exists(a["cands"], lambda c: F.contains(F.col("low"), c))), "a")
    found = rows.select("document_id", "page_num", F.col("a.field_name").alias("field_name"),
                        F.coalesce(F.col("a.wanted") == F.col("page_num"), F.lit(False)).alias("asked"),
                        F.get(F.filter("a.cands", lambda c: F.contains(F.col("low"), c)), 0).alias("matched"))
    return found.groupBy("document_id", "field_name").agg(
        F.min_by(F.struct("page_num", "matched"), F.struct(~F.col("asked"), F.col("page_num"))).alias("b")
    ).select("document_id", "field_name", F.col("b.page_num").alias("page_num"), F.col("b.matched").alias("matched"))


def page_profile(contributions: DataFrame) -> DataFrame:
    """How often each page of a layout was read and gave a field.

    In: variant_id, document_id, page_num, field_name (null = page read, nothing found).
    Out per (variant, page): instances, present_in, contributed_in, fields_seen, skip.
    A page is skipped after 3 documents of the layout, 3 readings and no field.
    """
    per_page = contributions.groupBy("variant_id", "document_id", "page_num").agg(
        F.count("field_name").alias("found"))
    instances = contributions.groupBy("variant_id").agg(F.countDistinct("document_id").alias("instances"))
    stats = per_page.groupBy("variant_id", "page_num").agg(
        F.count(F.lit(1)).alias("present_in"), F.count_if(F.col("found") > 0).alias("contributed_in"))
    seen = contributions.filter(F.col("field_name").isNotNull()).select(
        "variant_id", "page_num", "field_name").groupBy("variant_id", "page_num").agg(
        F.array_sort(F.collect_set("field_name")).alias("fields_seen"))
    skip = (F.col("instances") >= MIN_INSTANCES) & (F.col("present_in") >= MIN_INSTANCES) & (F.col("contributed_in") == 0)
    return stats.join(instances, "variant_id").join(seen, ["variant_id", "page_num"], "left").select(
        "variant_id", "page_num", "instances", "present_in", "contributed_in",
        F.coalesce("fields_seen", F.array().cast("array<string>")).alias("fields_seen"), skip.alias("skip"))


def page_profile_summary(profile: DataFrame) -> DataFrame:
    """Per layout: instances, skipped pages, tokens and cost saved, stage."""
    agg = profile.groupBy("variant_id").agg(
        F.max("instances").alias("instances"), F.count(F.lit(1)).alias("pages_tracked"),
        F.count_if("skip").alias("skipped_pages"))
    tokens = F.col("skipped_pages") * TOKENS_PER_PAGE * F.col("instances")
    return agg.select("*", tokens.alias("tokens_saved"), cost_of(tokens).alias("cost_saved_usd"),
                      page_profile_stage(F.col("instances"), F.col("skipped_pages")).alias("stage"))


def page_profile_stage(instances: Column, skipped: Column) -> Column:
    return (F.when(instances.isNull(), "none").when(instances < MIN_INSTANCES, "learning")
            .when(skipped > 0, "confident").otherwise("learning"))


def prune_pages(pages: DataFrame, profile: DataFrame) -> DataFrame:
    """Pages that are not on the skip list of their layout (pages has variant_id)."""
    skips = profile.filter("skip").select("variant_id", "page_num")
    return pages.join(skips, ["variant_id", "page_num"], "left_anti")


def page_budget(pages: DataFrame, budget: int = 300_000, skip: DataFrame | None = None,
                head: int = 3, tail: int = 10) -> DataFrame:
    """Pages of each document that fit a character budget.

    Without skips a document that fits is taken whole (pages joined by two line ends).
    Else the first 3 and last 10 pages are always in (minus skips); of the others, by
    (density desc, page desc), those still fitting, until the density is 0; a page that
    does not fit is passed over.  `skip`: document_id, page_num.

    Only page number, length and density of each page go into the per-document fold; the
    text does not move.  Out: document_id, page_num, selected.
    """
    density = data_density(F.coalesce("text", F.lit("")))
    n_chars = F.length(F.coalesce("text", F.lit("")))
    facts = pages.select("document_id", "page_num", n_chars.alias("chars"), density.alias("score"))
    if skip is not None:
        facts = facts.join(skip.select("document_id", "page_num", F.lit(True).alias("skip")),
                           ["document_id", "page_num"], "left").withColumn("skip", F.coalesce("skip", F.lit(False)))
    else:
        facts = facts.withColumn("skip", F.lit(False))
    packed = facts.groupBy("document_id").agg(
        F.collect_list(F.struct("page_num", "chars", "score", "skip")).alias("ps"),
        F.count(F.lit(1)).alias("n"), F.sum("chars").alias("total"), F.bool_or("skip").alias("any_skip"))
    fits = ~F.col("any_skip") & (F.col("total") + (F.col("n") - 1) * 2 <= budget)
    always = lambda p: ~p["skip"] & ((p["page_num"] < head) | (p["page_num"] >= F.col("n") - tail))
    base = F.filter("ps", always)
    middle = F.reverse(F.array_sort(F.transform(
        F.filter("ps", lambda p: ~p["skip"] & ~always(p) & (p["score"] > 0)),
        lambda p: F.struct(p["score"].alias("score"), p["page_num"].alias("page_num"), p["chars"].alias("chars")))))
    used = F.aggregate(base, F.lit(0).cast("bigint"), lambda a, p: a + p["chars"])
    start = F.struct(used.alias("used"), F.transform(base, lambda p: p["page_num"]).alias("chosen"))
    filled = F.aggregate(middle, start, lambda a, p: F.when(
        a["used"] + p["chars"] <= budget,
        F.struct((a["used"] + p["chars"]).alias("used"), F.concat(a["chosen"], F.array(p["page_num"])).alias("chosen"))
    ).otherwise(F.struct(a["used"].alias("used"), a["chosen"].alias("chosen"))))["chosen"]
    chosen = F.when(fits, F.transform("ps", lambda p: p["page_num"])).otherwise(filled)
    return packed.select("document_id", "ps", chosen.alias("chosen")).select(
        "document_id", F.explode(F.transform("ps", lambda p: p["page_num"])).alias("page_num"), "chosen").select(
        "document_id", "page_num", F.array_contains("chosen", F.col("page_num")).alias("selected"))


def skip_markers(selection: DataFrame) -> DataFrame:
    """Where a sampled text leaves pages out: after which page, how many, and the marker line.

    Also at the start (after_page -1) and after the last selected page.
    """
    w = Window.partitionBy("document_id").orderBy("page_num")
    last = selection.groupBy("document_id").agg(
        F.max("page_num").alias("last_page"), F.max(F.when(F.col("selected"), F.col("page_num"))).alias("last_in"))
    gaps = selection.filter("selected").select(
        "document_id", F.coalesce(F.lag("page_num").over(w), F.lit(-1)).alias("after_page"),
        (F.col("page_num") - F.coalesce(F.lag("page_num").over(w), F.lit(-1)) - 1).alias("skipped"))
    ends = last.select("document_id", F.coalesce("last_in", F.lit(-1)).alias("after_page"),
                       (F.col("last_page") - F.coalesce("last_in", F.lit(-1))).alias("skipped"))
    return gaps.unionByName(ends).filter(F.col("skipped") > 0).withColumn(
        "marker", F.concat(F.lit("[... "), F.col("skipped"), F.lit(" page(s) skipped ...]")))


def page_audit(profile: DataFrame) -> DataFrame:
    """Status of every profiled page: skipping, useful or empty; and whether it could be skipped."""
    rate = F.col("contributed_in") / F.col("present_in")
    return profile.select(
        "variant_id", "page_num", "instances", "present_in", "contributed_in",
        rounded(F.round(F.col("contributed_in").cast("decimal(12,0)") / F.col("present_in").cast("decimal(12,0)"), 2), 2).alias("contribution_rate"),
        F.when(F.col("skip"), "skipping").when(rate > 0, "useful").otherwise("empty").alias("status"),
        (~F.col("skip") & (F.col("contributed_in") == 0) & (F.col("present_in") >= 3)).alias("candidate"))


def page_audit_summary(profile: DataFrame) -> DataFrame:
    """Per layout: skipped pages, candidates, saving, recommendation; dearest saving first."""
    rows = page_audit(profile).groupBy("variant_id").agg(
        F.max("instances").alias("instances"), F.count(F.lit(1)).alias("pages_tracked"),
        F.count_if(F.col("status") == "skipping").alias("skipped_pages"),
        F.count_if("candidate").alias("candidates"))
    saved = F.col("skipped_pages") * TOKENS_PER_PAGE * F.col("instances")
    more = F.col("candidates") * TOKENS_PER_PAGE * F.col("instances")
    return rows.select(
        "*", cost_of(saved).alias("cost_saved_usd"), cost_of(more).alias("additional_saving_usd"),
        F.when(F.col("instances") < 3, "insufficient_data").when(F.col("candidates") > 0, "candidates_available")
        .otherwise("optimal").alias("recommendation")
    ).orderBy(F.desc("cost_saved_usd"), "variant_id")
