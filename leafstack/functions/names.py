"""Slugs, fingerprints, keys and stages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafstack.functions.text import WORD, is_shouted

# Legal suffixes that do not tell companies apart.
LEGAL_SUFFIXES = r"\b(limited|ltd\.?|gmbh|inc\.?|corp\.?|s\.?a\.?|b\.?v\.?|ag|llc)\b"

# Fields that name the owner of a layout, best first.
ISSUER_FIELDS = [
    "Issuer", "Issuing Company", "Buyer", "Buyer Name", "Purchaser",
    "Purchaser Name", "From", "From Company", "Company", "Company Name", "Entity",
    "issuer", "issuing_company", "buyer_name", "purchaser_name",
    "from_company", "company_name", "entity",
]
# Buyers that are never the issuer.
BUYER_SLUGS = ["tata-steel", "tata-steel-limited", "tata-steel-uk"]

# Signature wording.
SIGNATURE_LABELS = [
    "signature", "signed by", "authorised by", "authorized by",
    "approved by", "signatory", "sign here", "signature of",
    "authorisation", "authorization",
]

TOKENS_PER_PAGE = 300
USD_PER_TOKEN = 0.000003


def slugify(name: Column) -> Column:
    """Company name -> hyphenated slug without legal suffix, 80 characters."""
    s = F.regexp_replace(F.lower(F.trim(name)), LEGAL_SUFFIXES, "")
    s = F.trim(F.regexp_replace(s, rf"[^{WORD}\s]", " "))
    s = F.regexp_replace(F.regexp_replace(s, r"\s+", "-"), "-+", "-")
    return F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, 80)


def is_line_item_field(name: Column) -> Column:
    """A number standing alone in the name, as in 'Item 1 Qty'."""
    return name.rlike(rf"(?:^|[^{WORD}])\d+(?:[^{WORD}]|$)")


def is_layout_field(name: Column) -> Column:
    """A field name that belongs to the layout: no line item, not all capitals."""
    return ~is_line_item_field(name) & ~is_shouted(name)


def variant_key(issuer: Column, fingerprint: Column) -> Column:
    """issuer__first four names, 200 characters; 'generic' without names."""
    first4 = F.array_join(F.slice(fingerprint, 1, 4), ",")
    return F.substring(F.concat(issuer, F.lit("__"), F.when(first4 == "", "generic").otherwise(first4)), 1, 200)


def variant_letter(n: Column) -> Column:
    """1 -> A ... 26 -> Z, 27 -> AA ..."""
    last = F.chr(F.lit(65) + (n - 1) % 26)
    head = F.when(n > 26, F.chr(F.lit(64) + F.floor((n - 1) / 26).cast("int"))).otherwise(F.lit(""))
    return F.concat(head, last)


def variant_label(issuer: Column, class_name: Column, letter: Column) -> Column:
    who = F.when(issuer == "unknown", F.lit(None)).otherwise(F.initcap(F.regexp_replace(issuer, "-", " ")))
    front = F.concat_ws(" ", who, F.nullif(class_name, F.lit("")))
    return F.when(front == "", F.concat(F.lit("Format "), letter)).otherwise(
        F.concat(front, F.lit(" — Format "), letter))


def abstract_filename(name: Column) -> Column:
    """File name as a pattern: digits -> \\d+, runs of 3+ capitals -> [A-Z]+; short ones are null."""
    base = F.trim(F.regexp_replace(name, r"\.[a-zA-Z0-9]{2,5}$", ""))
    escaped = F.regexp_replace(base, r"([\\.^$*+?{}\[\]|()\-&#~\s])", r"\\$1")
    digits = F.regexp_replace(escaped, r"\\?[0-9]+", r"\\d+")
    caps = F.regexp_replace(digits, rf"(?<![{WORD}])[A-Z]{{3,}}(?![{WORD}])", "[A-Z]+")
    return F.when((base != "") & (F.length(caps) >= 4), caps)


def learning_stage(doc_count: Column, current: Column | None = None) -> Column:
    """Layout ladder 3 / 10 / 50; LEARNED and OPTIMISED are never left."""
    stage = (
        F.when(doc_count >= 50, "OPTIMISED").when(doc_count >= 10, "LEARNED_PROPOSED")
        .when(doc_count >= 3, "LEARNING").otherwise("ZERO_SHOT")
    )
    if current is None:
        return stage
    return F.when(current.isin("LEARNED", "OPTIMISED"), current).otherwise(stage)


def stage_rank(stage: Column) -> Column:
    return (
        F.when(stage == "OPTIMISED", 5).when(stage == "LEARNED", 4).when(stage == "LEARNED_PROPOSED", 3)
        .when(stage == "LEARNING", 2).otherwise(1)
    )


def stage_label(stage: Column) -> Column:
    return (
        F.when(stage == "ZERO_SHOT", "Learning (0–2 docs)")
        .when(stage == "LEARNING", "Learning (tracking patterns)")
        .when(stage == "LEARNED_PROPOSED", "Ready to confirm")
        .when(stage == "LEARNED", "Schema confirmed")
        .when(stage == "OPTIMISED", "Optimised (fast path)")
        .otherwise(stage)
    )


def progress_pct(stage: Column, doc_count: Column) -> Column:
    return (
        F.when(stage == "ZERO_SHOT", 5)
        .when(stage == "LEARNING", F.least(F.lit(5) + F.floor(F.coalesce(doc_count, F.lit(0)) * 4.5).cast("int"), F.lit(49)))
        .when(stage == "LEARNED_PROPOSED", 55).when(stage == "LEARNED", 70).when(stage == "OPTIMISED", 100)
        .otherwise(0)
    )


def fiscal_year(ts: Column) -> Column:
    """April to March, named after the year it ends in."""
    return F.concat(F.lit("FY"), (F.year(ts) + F.when(F.month(ts) >= 4, 1).otherwise(0)).cast("string"))


def class_slug(name: Column, sep: str = "-") -> Column:
    """'-' form: every non-alphanumeric run; '_' form: spaces and slashes, 40 characters."""
    if sep == "-":
        return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.substring(F.translate(F.translate(F.lower(name), " /", "__"), "().", ""), 1, 40)


def signature_label_page(text: Column) -> Column:
    return F.lower(text).rlike("|".join(SIGNATURE_LABELS))


def signature_anchor(page: Column, pages: Column) -> Column:
    """struct<anchor,offset>: the nearer end of the document, ties go to the end."""
    back = pages - 1 - page
    return F.struct(F.when(page < back, "start").otherwise("end").alias("anchor"), F.least(page, back).alias("offset"))


def target_page(anchor: Column, offset: Column, pages: Column) -> Column:
    return F.when(anchor == "start", F.least(offset, pages - 1)).otherwise(F.greatest(F.lit(0), pages - 1 - offset))


def tokens_for(pages: Column) -> Column:
    return pages * TOKENS_PER_PAGE


def cost_of(tokens: Column) -> Column:
    """USD, 4 decimals."""
    return F.round(tokens.cast("decimal(20,0)") * F.lit("0.000003").cast("decimal(7,6)"), 4).cast("double")
