"""Inputs of the registered queries, derived by Spark from the given tables.

`leafstack.queries.oracle` states the same formulas in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafstack.functions.names import learning_stage
from leafstack.operators.common import unfold
from leafstack.operators.links import document_keys
from leafstack.sources.tables import read_table


def epoch_plus(minutes: Column) -> Column:
    return F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(mins=minutes.cast("int"))


def cents(c: Column) -> Column:
    return c.cast("decimal(18,2)")


def pick(n: Column, *values: str) -> Column:
    """values[n]"""
    return F.get(F.array(*[F.lit(v) for v in values]), n.cast("int"))


STATES = ["COMPLETED"] * 6 + ["NEEDS_REVIEW", "FAILED", "CANDIDATE_NEW_CLASS", "EXTRACTING"]


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """Document rows over `documents`; class = language, layout = source."""
    d = read_table(spark, sf, "documents")
    i = F.col("doc_id")
    return d.select(
        F.concat(F.lit("doc_"), i).alias("document_id"), i.alias("doc_id"),
        F.sha2(F.col("text").cast("binary"), 256).alias("file_sha256"), F.col("n_chars").alias("file_size_bytes"),
        epoch_plus(i).alias("created_at"), epoch_plus(i * 3 % 5000).alias("updated_at"),
        F.concat(F.lit("c_"), "lang").alias("class_id"), F.col("source").alias("variant_id"),
        pick(i % 10, *STATES).alias("status"), F.concat(F.lit("File_"), i, F.lit(".pdf")).alias("file_name"),
        F.when(i % 4 != 3, (i % 7 + 1).cast("int")).alias("pages_total"),
        (i % 3).cast("int").alias("pages_skipped_count"), "text")


def doc_pages(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents", "doc_id", "source", "text")
    return d.select(
        F.concat(F.lit("doc_"), "doc_id").alias("document_id"), F.col("source").alias("variant_id"),
        F.posexplode(F.split("text", "\n")).alias("page_num", "text"))


def bundle_pages(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "conversations")
    return c.select(F.concat(F.lit("conv_"), "conv_id").alias("document_id"),
                    F.col("turn").cast("int").alias("page_num"), "role", "text")


def order_facts(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order: its number, customer country, first supplier and ship date, discounted total.

    Lines are aggregated before the join; orders without lines keep nulls.
    """
    li = read_table(spark, sf, "lineitem", "l_orderkey", "l_suppkey", "l_extendedprice", "l_discount", "l_shipdate")
    agg = li.groupBy("l_orderkey").agg(
        F.min("l_suppkey").alias("suppkey"), F.min("l_shipdate").alias("shipdate"),
        F.sum(cents(F.col("l_extendedprice")) * (1 - F.col("l_discount").cast("decimal(4,2)"))).alias("total"))
    o = read_table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    c = read_table(spark, sf, "customer", "c_custkey", "c_nationkey")
    s = read_table(spark, sf, "supplier", "s_suppkey", "s_name")
    return (
        o.join(agg, o["o_orderkey"] == agg["l_orderkey"], "left")
        .join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(s, F.col("suppkey") == F.col("s_suppkey"), "left")
        .select(F.col("o_orderkey").alias("k"), "o_totalprice", "o_orderdate", "c_nationkey",
                F.col("l_orderkey").isNotNull().alias("has_lines"), "suppkey", "shipdate", "total", "s_name"))


PO_COLUMNS = ["po_number", "po_date", "currency", "total_order_value", "supplier_name"]
INVOICE_COLUMNS = ["invoice_number", "invoice_date", "currency", "total_amount", "customer_po_ref", "supplier_name"]


def _po_number() -> Column:
    return F.concat(F.lit("TSL/"), F.lpad(F.col("k").cast("string"), 6, "0"))


def _po_cells() -> dict[str, Column]:
    return dict(zip(PO_COLUMNS, [
        _po_number(), F.date_format("o_orderdate", "yyyy-MM-dd"), pick(F.col("c_nationkey") % 3, "EUR", "GBP", "USD"),
        cents(F.col("o_totalprice")).cast("string"), F.col("s_name")]))


def _invoice_cells() -> dict[str, Column]:
    k = F.col("k")
    return dict(zip(INVOICE_COLUMNS, [
        F.concat(F.lit("INV-"), F.lpad(k.cast("string"), 6, "0")), F.date_format("shipdate", "yyyy-MM-dd"),
        F.when(k % 17 == 0, "CHF").otherwise(pick(F.col("c_nationkey") % 3, "EUR", "GBP", "USD")),
        F.round("total", 2).cast("decimal(18,2)").cast("string"),
        F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, "TSL/999999").otherwise(_po_number()),
        F.when(k % 7 != 0, F.col("s_name"))]))


def invoices(spark: SparkSession, sf: str) -> DataFrame:
    """Invoices wide: one column per field."""
    return order_facts(spark, sf).filter("has_lines").select(
        "k", F.concat(F.lit("inv_"), "k").alias("document_id"), *[c.alias(n) for n, c in _invoice_cells().items()])


def extracted_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of all purchase orders and invoices (absent values have no row).

    Both documents of an order unfold from one row, so the tables are read and joined once.
    """
    def cells(prefix: str, named: dict[str, Column], base: int) -> Column:
        return F.array(*[F.struct(
            F.lit(prefix).alias("prefix"), F.lit(i).alias("ordinal"), F.lit(base + i).alias("slot"),
            F.lit(n).alias("field_name"), c.alias("field_value")) for i, (n, c) in enumerate(named.items())])
    po, inv = cells("po_", _po_cells(), 0), cells("inv_", _invoice_cells(), 10)
    both = F.when(F.col("has_lines"), F.concat(po, inv)).otherwise(po)
    rows = unfold(order_facts(spark, sf), ["k"], both, "c").select("k", "c.*").filter(
        F.col("field_value").isNotNull())
    n = F.col("k") * 7 + F.col("ordinal") * 13
    corrected = (F.col("k") + F.col("ordinal")) % 29 == 0
    return rows.select(
        (F.col("k") * 20 + F.col("slot")).alias("field_id"), "k", F.concat("prefix", "k").alias("document_id"),
        "ordinal", "field_name", "field_value",
        F.lit("scalar").alias("field_type"), (F.lit(0.5) + (n % 50) / 100).alias("confidence"),
        pick(F.col("k") % 3, "TEXT_LAYER", "AI_TEXT", "FAST_PATTERNS").alias("extraction_method"),
        corrected.alias("human_corrected"), F.when(corrected, F.upper("field_value")).alias("corrected_value"))


TRADE_STATES = ["COMPLETED"] * 7 + ["NEEDS_REVIEW", "FAILED", "EXTRACTING"]


def trade_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Purchase orders, invoices, inspection certificates and packing lists of every order."""
    o = read_table(spark, sf, "orders", "o_orderkey").select(F.col("o_orderkey").alias("k"))
    li = read_table(spark, sf, "lineitem", "l_orderkey", "l_suppkey").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.min("l_suppkey").alias("suppkey"))
    k = F.col("k")

    def part(prefix: str, class_id: str, offset: int) -> Column:
        return F.struct(F.lit(prefix).alias("prefix"), F.lit(class_id).alias("class_id"), F.lit(offset).alias("offset"))

    parts = F.array_compact(F.array(
        part("po_", "dc_003", 0), F.when(F.col("suppkey").isNotNull(), part("inv_", "dc_006", 1)),
        F.when(k % 5 == 0, part("ic_", "dc_008", 2)), F.when(k % 3 == 0, part("pl_", "dc_007", 3))))
    docs = o.join(li, "k", "left").select("k", "suppkey", F.explode(parts).alias("p")).select(
        "k", F.concat("p.prefix", "k").alias("document_id"), F.col("p.class_id").alias("class_id"),
        epoch_plus(k * 5 + F.col("p.offset")).alias("created_at"),
        F.when(F.col("p.class_id") == "dc_006", F.concat(F.lit("v_"), F.col("suppkey") % 20)).alias("variant_id"))
    return docs.select(
        "*", F.concat(F.lit("shp_"), "k").alias("shipment_id"), pick(F.col("k") % 10, *TRADE_STATES).alias("status"),
        F.concat("document_id", F.lit(".pdf")).alias("file_name"),
        F.when(F.col("k") % 4 == 0, "ADVISORY").when(F.col("k") % 9 == 0, "SKIP").otherwise("REQUIRED").alias("match_mode"),
        F.when(F.col("k") % 6 == 0, F.array(F.lit("POSTING"))).otherwise(F.array().cast("array<string>")).alias("skip_stages"))


EVENT_STATES = {"signup": "RECEIVED", "view": "EXTRACTING", "click": "VALIDATING", "purchase": "COMPLETED", "error": "NEEDS_REVIEW"}


def document_events(spark: SparkSession, sf: str) -> DataFrame:
    return events_of(read_table(spark, sf, "events"))


def events_of(e: DataFrame) -> DataFrame:
    states = F.create_map(*[F.lit(x) for kv in EVENT_STATES.items() for x in kv])
    return e.select(
        F.concat(F.lit("doc_"), "user_id").alias("document_id"), "event_id",
        F.try_element_at(states, F.col("event_type")).alias("state"), F.col("ts").alias("created_at"),
        F.when(F.col("event_type") == "error", F.concat(
            F.lit("NIGO - 2 condition(s) failed. A "), "event_id", F.lit(" | B"))).otherwise(F.col("props")).alias("detail"))


def variants(spark: SparkSession, sf: str) -> DataFrame:
    """Layouts of the invoices: supplier number modulo 20."""
    inv = trade_docs(spark, sf).filter(F.col("class_id") == "dc_006")
    return inv.groupBy("variant_id", "class_id").agg(
        F.count(F.lit(1)).alias("doc_count"), F.min("created_at").alias("created_at")).select(
        "variant_id", "class_id", "doc_count", "created_at",
        learning_stage((F.regexp_replace("variant_id", "v_", "").try_cast("int") * 4).cast("bigint")).alias("learning_stage"),
        F.concat(F.lit("Layout "), "variant_id").alias("variant_label"),
        (F.regexp_replace("variant_id", "v_", "").try_cast("int") % 7 != 6).alias("active"),
        (F.regexp_replace("variant_id", "v_", "").try_cast("int") % 5).alias("confirmed_instances"))


def variant_schema(spark: SparkSession, sf: str) -> DataFrame:
    """Confirmed schema of the layouts: two fields have an alias, one never occurs."""
    rows = [("invoice_number", 0, "inv_no"), ("invoice_number", 1, "invoice_number"), ("invoice_date", 0, "invoice_date"),
            ("total", 0, "total_amount"), ("supplier_name", 0, "supplier_name"), ("iban", 0, "iban")]
    return variants(spark, sf).filter(F.col("learning_stage") != "ZERO_SHOT").select("variant_id").withColumn(
        "r", F.explode(F.array(*[F.struct(F.lit(c).alias("canonical"), F.lit(n).alias("alias_no"), F.lit(a).alias("alias"))
                                 for c, n, a in rows]))).select("variant_id", "r.*")


def link_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Reference keys of the trade documents, plus a waybill shared by four neighbouring orders."""
    own = document_keys(extracted_fields(spark, sf)).filter(F.col("key") != "TSL/999999")
    o = read_table(spark, sf, "orders", "o_orderkey").filter(F.col("o_orderkey") % 3 == 0)
    awb = o.select(F.concat(F.lit("po_"), "o_orderkey").alias("document_id"),
                   F.concat(F.lit("AWB-"), F.floor(F.col("o_orderkey") / 4).cast("bigint")).alias("key"), F.lit(6).alias("rank"))
    return own.unionByName(awb)


def page_contributions(spark: SparkSession, sf: str) -> DataFrame:
    """Pages read per layout; a page gives a field when it holds a chosen word."""
    p = doc_pages(spark, sf).select("variant_id", "document_id", "page_num", F.lower("text").alias("t"))
    words = {"ref_a": "ine", "ref_b": "que"}
    hits = F.array_compact(F.array(*[F.when(F.contains("t", F.lit(w)), F.lit(f)) for f, w in words.items()]))
    return p.select("variant_id", "document_id", "page_num", F.explode_outer(hits).alias("field_name"))


def trade_text(spark: SparkSession, sf: str) -> DataFrame:
    """Invoice text per order, in the shape real documents have."""
    inv = invoices(spark, sf)
    line = lambda label, c: F.concat(F.lit(f"\n{label}: "), F.coalesce(c, F.lit("")))
    return inv.select(
        "k", "document_id", F.lit("dc_006").alias("class_id"),
        F.concat(F.lit("INVOICE"), line("Invoice No.", F.col("invoice_number")), line("Invoice Date", F.col("invoice_date")),
                 line("Supplier", F.col("supplier_name")), line("PO No.", F.col("customer_po_ref")),
                 line("Invoice Total", F.concat("currency", F.lit(" "), "total_amount")),
                 F.lit("\nPayment Terms: 30 days net\nThank you")).alias("text"))
