"""Three-way match of purchase order, invoice and supporting documents."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafstack.functions.values import either_contains, iso_date, literal_map, to_decimal
from leafstack.operators.fieldset import field_map
from leafstack.rules import INSPECTION_CLASSES, INVOICE_CLASSES, PACKING_CLASSES, PO_CLASSES
from leafstack.session import stored

DEFAULT_TOLERANCE = "0.02"
CHECKS = ["supplier_name", "currency", "amount_tolerance", "po_reference",
          "date_order", "inspection_cert", "packing_list"]
PO_FIELDS = ["supplier_name", "currency", "total_order_value", "po_number", "po_date"]
INVOICE_FIELDS = ["supplier_name", "freight_agent", "currency", "total_amount", "total_invoice_value",
                  "customer_po_ref", "customer_po_number", "tll_reference", "tll_po_number", "invoice_date"]


def match_tolerance(class_id: Column, overrides: Mapping[str, str] | None = None) -> Column:
    """Tolerance of a class as decimal(10,6): the override, else 0.02."""
    default = F.lit(DEFAULT_TOLERANCE).cast("decimal(10,6)")
    if not overrides:
        return default
    return F.coalesce(F.try_element_at(literal_map(dict(overrides)), class_id).cast("decimal(10,6)"), default)


def shipment_pairs(members: DataFrame) -> DataFrame:
    """First purchase order and first invoice of each shipment, and what else it has.

    `members`: shipment_id, document_id, class_id, created_at.  First means by
    (created_at, document_id).  One partial aggregate per shipment, nothing collected.
    """
    order = F.struct("created_at", "document_id")
    first = lambda classes: F.min(F.when(F.col("class_id").isin(classes), F.struct(order, F.col("class_id"))))
    has = lambda classes: F.coalesce(F.bool_or(F.col("class_id").isin(classes)), F.lit(False))
    return members.groupBy("shipment_id").agg(
        F.count(F.lit(1)).alias("document_count"),
        first(PO_CLASSES).alias("po"), first(INVOICE_CLASSES).alias("inv"),
        has(INSPECTION_CLASSES).alias("has_ic"), has(PACKING_CLASSES).alias("has_pl"),
    ).select(
        "shipment_id", "document_count",
        F.col("po.col1.document_id").alias("po_document_id"),
        F.col("inv.col1.document_id").alias("invoice_document_id"),
        F.col("inv.class_id").alias("invoice_class_id"), "has_ic", "has_pl")


def _present(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def _non_empty(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def match_checks(members: DataFrame, fields: DataFrame,
                 tolerance: Mapping[str, str] | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """One row per shipment that has both documents, one column per check (PASS/FAIL/SKIP).

    `fields`: field rows, or documents that carry their stored map (see `field_map`); `pairs`: the pairs of `members`, if made before.
    """
    pairs = (shipment_pairs(members) if pairs is None else pairs).filter(
        F.col("po_document_id").isNotNull() & F.col("invoice_document_id").isNotNull())
    # one pivot serves both sides; stored, as each side reads other columns, for which Spark would make a pivot of its own
    wide = field_map(fields, sorted({*PO_FIELDS, *INVOICE_FIELDS}))
    if "fields" not in fields.columns:
        wide = stored(wide, "match-fields")
    po = wide.select(
        F.col("document_id").alias("po_document_id"), *[F.col(n).alias(f"po_{n}") for n in PO_FIELDS])
    inv = wide.select(
        F.col("document_id").alias("invoice_document_id"), *[F.col(n).alias(f"inv_{n}") for n in INVOICE_FIELDS])
    both = pairs.join(po, "po_document_id", "left").join(inv, "invoice_document_id", "left")

    def verdict(known: Column, ok: Column) -> Column:
        return F.when(~F.coalesce(known, F.lit(False)), "SKIP").when(ok, "PASS").otherwise("FAIL")

    inv_supplier = F.coalesce("inv_supplier_name", "inv_freight_agent")
    po_amount = to_decimal(F.col("po_total_order_value"))
    inv_amount = to_decimal(_non_empty(F.col("inv_total_amount"), F.col("inv_total_invoice_value")))
    ceiling = po_amount * (F.lit(1) + match_tolerance(F.col("invoice_class_id"), tolerance))
    reference = _non_empty(*[F.col(f"inv_{n}") for n in
                             ("customer_po_ref", "customer_po_number", "tll_reference", "tll_po_number")])
    po_date, inv_date = iso_date(F.col("po_po_date")), iso_date(F.col("inv_invoice_date"))
    return both.select(
        "shipment_id", "po_document_id", "invoice_document_id", "document_count",
        verdict(_present(F.col("po_supplier_name")) & _present(inv_supplier),
                either_contains(F.col("po_supplier_name"), inv_supplier)).alias("supplier_name"),
        verdict(_present(F.col("po_currency")) & _present(F.col("inv_currency")),
                F.upper("po_currency") == F.upper("inv_currency")).alias("currency"),
        verdict((po_amount != 0) & (inv_amount != 0), inv_amount <= ceiling).alias("amount_tolerance"),
        verdict(_present(F.col("po_po_number")) & _present(reference),
                either_contains(F.col("po_po_number"), reference)).alias("po_reference"),
        verdict(po_date.isNotNull() & inv_date.isNotNull(), inv_date >= po_date).alias("date_order"),
        F.when(F.col("has_ic"), "PASS").otherwise("SKIP").alias("inspection_cert"),
        F.when(F.col("has_pl"), "PASS").otherwise("SKIP").alias("packing_list"))


def check_rows(checks: DataFrame) -> DataFrame:
    """Long form: shipment_id, check_no, name, status."""
    rows = F.array(*[F.struct(F.lit(i).alias("check_no"), F.lit(n).alias("name"), F.col(n).alias("status"))
                     for i, n in enumerate(CHECKS, 1)])
    return checks.select("shipment_id", F.explode(rows).alias("c")).select("shipment_id", "c.*")


def match_outcome(checks: DataFrame) -> DataFrame:
    """FAIL if any check fails, else PASS_PARTIAL if any is skipped, else PASS; with a summary.

    The seven checks are columns of one row, so there is nothing to aggregate.
    """
    states = F.array(*[F.struct(F.lit(n).alias("n"), F.col(n).alias("s")) for n in CHECKS])
    named = lambda s: F.transform(F.filter(states, lambda c: c["s"] == s), lambda c: c["n"])
    failed, skipped, passed = named("FAIL"), named("SKIP"), F.size(named("PASS"))
    outcome = F.when(F.size(failed) > 0, "FAIL").when(F.size(skipped) > 0, "PASS_PARTIAL").otherwise("PASS")
    part = lambda title, names, end: F.when(
        F.size(names) > 0, F.concat(F.lit(title), F.array_join(names, ", "), F.lit(end))).otherwise(F.lit(""))
    return checks.select(
        "shipment_id", "po_document_id", "invoice_document_id", outcome.alias("outcome"),
        passed.alias("passed"), F.size(failed).alias("failed"), F.size(skipped).alias("skipped"),
        F.concat(F.lit("Three-way match "), outcome, F.lit(". "), passed, F.lit(f"/{len(CHECKS)} checks passed. "),
                 part("FAIL: ", failed, ". "), part("SKIP (awaiting docs): ", skipped, ".")).alias("summary"))


def three_way_match(members: DataFrame, fields: DataFrame,
                    tolerance: Mapping[str, str] | None = None) -> DataFrame:
    """Outcome of every shipment; without a purchase order or an invoice it is deferred as PASS_PARTIAL."""
    # read twice: by the checks and for what is deferred
    pairs = stored(shipment_pairs(members), "shipment-pairs")
    missing = F.when(F.col("po_document_id").isNull(), "PO").otherwise("Invoice")
    deferred = pairs.filter(F.col("po_document_id").isNull() | F.col("invoice_document_id").isNull()).select(
        "shipment_id", "po_document_id", "invoice_document_id", F.lit("PASS_PARTIAL").alias("outcome"),
        F.lit(0).alias("passed"), F.lit(0).alias("failed"), F.lit(0).alias("skipped"),
        F.concat(F.lit("Three-way match deferred: shipment has "), F.col("document_count"),
                 F.lit(" document(s) but is missing a "), missing,
                 F.lit(". Match will run when the full set arrives.")).alias("summary"))
    return match_outcome(match_checks(members, fields, tolerance, pairs)).unionByName(deferred)


def match_for_documents(documents: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcome per document; one that is in no shipment is SKIP."""
    return documents.select("document_id", "shipment_id").join(
        outcomes.select("shipment_id", "outcome"), "shipment_id", "left"
    ).select("document_id", "shipment_id", F.coalesce("outcome", F.lit("SKIP")).alias("outcome"))


def match_routing(outcome: Column, match_mode: Column) -> Column:
    """A failed match stops the document unless its mode is ADVISORY."""
    return F.when((outcome == "FAIL") & (F.coalesce(match_mode, F.lit("REQUIRED")) != "ADVISORY"),
                  "NEEDS_REVIEW").otherwise("POSTING")
