"""What leaves the system: posting payloads, filing paths, completion events, fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafstack import rules as R
from leafstack.functions.names import fiscal_year
from leafstack.operators.fieldset import document_field_summary
from leafstack.operators.quality import with_field_dict

# Payload keys as (key, field, default); another field may stand in for an empty first one.
PURCHASE_INVOICE = [
    ("vendorInvoiceNumber", "invoice_number", ""), ("invoiceDate", "invoice_date", ""),
    ("currencyCode", "currency", "EUR"), ("amount", "total_amount", ""), ("vatAmount", "vat_amount", "0.00"),
    ("paymentTermsCode", "payment_terms", "NET30"), ("shipToAddress", "delivery_address", ""),
    ("purchaseOrderNumber", "customer_po_ref", ""),
]
SALES_INVOICE = [
    ("customerNumber", "customer_name", ""), ("invoiceNumber", "invoice_number", ""), ("invoiceDate", "invoice_date", ""),
    ("currencyCode", "currency", "GBP"), ("totalAmount", "total_invoice_value", ""),
    ("buyingCommissionPct", "buying_commission_pct", ""), ("awbBlNumber", "awb_bl_number", ""),
    ("portOfLoading", "port_of_loading", ""), ("portOfDischarge", "port_of_discharge", ""),
]
ORDER_UPDATE = [
    ("purchaseOrderNumber", "po_number", ""), ("vendorNumber", "supplier_name", ""),
    ("confirmedDeliveryDate", "delivery_date", ""), ("currencyCode", "currency", "EUR"),
    ("confirmedAmount", "total_order_value", ""),
]


def posting_payloads(docs: DataFrame, fields: DataFrame, posting_date: str) -> DataFrame:
    """JSON payload per document, shaped by its class family.

    A field that is absent takes the default; one that is present but empty stays empty.
    """
    d = with_field_dict(docs.select("document_id", "class_id"), fields).withColumn(
        "class_id", F.coalesce("class_id", F.lit("unknown")))

    def get(name: str, default: str = "") -> Column:
        return F.when(F.array_contains(F.map_keys("fields"), name), F.try_element_at("fields", F.lit(name))).otherwise(F.lit(default))

    def shape(kind: str, doc_type: str, keys: list, *extra: Column, dated: bool = True) -> Column:
        cols = [F.lit(kind).alias("type"), F.lit(doc_type).alias("documentType"), *extra]
        cols += [get(f, dflt).alias(k) for k, f, dflt in keys]
        if dated:
            cols.append(F.lit(posting_date).alias("postingDate"))
        cols += [F.col("document_id").alias("externalDocumentNumber"), F.col("class_id").alias("documentClass")]
        return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})

    vendor = F.coalesce(F.nullif(get("supplier_vat"), F.lit("")), get("supplier_name")).alias("vendorNumber")
    generic = F.to_json(F.struct(
        F.lit("Document Notification").alias("type"), F.col("class_id").alias("documentClass"),
        F.col("document_id").alias("documentId"), "fields", F.lit(posting_date).alias("postingDate")))
    family = (
        F.when(F.col("class_id").isin(R.PURCHASE_INVOICE_CLASSES), "purchase_invoice")
        .when(F.col("class_id").isin(R.SALES_INVOICE_CLASSES), "sales_invoice")
        .when(F.col("class_id").isin(R.PO_CLASSES), "order_update").otherwise("generic"))
    payload = (
        F.when(family == "purchase_invoice", shape("Purchase Invoice", "Invoice", PURCHASE_INVOICE, vendor))
        .when(family == "sales_invoice", shape("Sales Invoice", "Invoice", SALES_INVOICE))
        .when(family == "order_update", shape("Purchase Order Update", "PO Acknowledgement", ORDER_UPDATE, dated=False))
        .otherwise(generic))
    return d.select("document_id", "class_id", family.alias("family"), payload.alias("payload"))


def filing_index(docs: DataFrame, fields: DataFrame, classes: DataFrame, root: str = "/documents") -> DataFrame:
    """Filing path of each document: root / fiscal year / class slug / reference / file name.

    The reference is the class's naming field (its first row), slashes, backslashes and
    colons as dashes; without one the document id.  `docs`: document_id, class_id,
    file_name, created_at.
    """
    naming = F.create_map(*[F.lit(x) for kv in R.FILING_FIELDS.items() for x in kv])
    d = docs.select("document_id", "class_id", "file_name", "created_at",
                    F.try_element_at(naming, F.col("class_id")).alias("field_name"))
    value = F.when(F.col("human_corrected"), F.col("corrected_value")).otherwise(F.coalesce("field_value", F.lit("")))
    wanted = fields.filter(F.col("field_name").isin(sorted(set(R.FILING_FIELDS.values())))).groupBy("document_id", "field_name").agg(
        F.min(F.struct(F.col("field_id"), value.alias("v"))).alias("f"))
    j = d.join(wanted, ["document_id", "field_name"], "left").join(
        F.broadcast(classes.select("class_id", "slug")), "class_id", "left")
    v = F.col("f.v")
    ref = F.when(F.coalesce(v, F.lit("")) != "", F.trim(F.translate(v, "/\\:", "---"))).otherwise(F.col("document_id"))
    folder = F.concat_ws("/", F.lit(root), fiscal_year(F.col("created_at")), F.coalesce("slug", F.lit("unclassified")), ref)
    return j.select("document_id", "class_id", "created_at", fiscal_year(F.col("created_at")).alias("fiscal_year"),
                    ref.alias("reference"), folder.alias("folder"), F.concat_ws("/", folder, "file_name").alias("path"))


def shipment_filing(index: DataFrame, links: DataFrame, shipments: DataFrame) -> DataFrame:
    """Folder of a shipment: that of its first filed document; status FILED unless POSTED or COMPLETE."""
    first = index.join(links.select("document_id", "shipment_id"), "document_id").groupBy("shipment_id").agg(
        F.min(F.struct("created_at", "document_id", "folder")).alias("f"))
    return shipments.select("shipment_id", "status").join(first, "shipment_id").select(
        "shipment_id", F.col("f.folder").alias("folder"),
        F.when(F.col("status").isin("POSTED", "COMPLETE"), F.col("status")).otherwise(F.lit("FILED")).alias("status"))


def completion_events(docs: DataFrame, fields: DataFrame, links: DataFrame, matches: DataFrame,
                      classes: DataFrame, index: DataFrame) -> DataFrame:
    """'document.completed' payload per completed document."""
    j = (
        docs.filter(F.col("status") == "COMPLETED").select("document_id", "class_id", "file_name", "created_at")
        .join(document_field_summary(fields), "document_id", "left")
        .join(links.select("document_id", "shipment_id"), "document_id", "left")
        .join(matches.select("shipment_id", F.col("outcome").alias("match_result")), "shipment_id", "left")
        .join(index.select("document_id", "path"), "document_id", "left")
        .join(F.broadcast(classes.select("class_id", F.col("name").alias("class_name"))), "class_id", "left")
    )
    body = F.struct(
        F.lit("document.completed").alias("event"), "document_id", F.lit("COMPLETED").alias("status"),
        F.col("class_id").alias("document_class"), F.col("class_name").alias("document_class_name"), "file_name",
        F.coalesce("field_count", F.lit(0)).alias("field_count"), "avg_confidence", F.col("path").alias("filing_path"),
        "match_result", "shipment_id",
        F.concat(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("created_at"))
    return j.select("document_id", F.lit("document.completed").alias("event"),
                    F.coalesce("field_count", F.lit(0)).alias("field_count"), "avg_confidence", "match_result",
                    F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))


def event_fanout(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """One row per event and active subscription that wants it (an empty list wants all).

    Subscriptions are a small table: their wish lists are unfolded to one row per wanted
    event name ('*' for all), and the events join on their name and on '*', so it stays an
    equi-join.
    """
    active = subscriptions.filter("active").select("subscription_id", "url", F.explode(F.when(
        F.size("events") == 0, F.array(F.lit("*"))).otherwise(F.array_distinct("events"))).alias("want"))
    rows = events.withColumn("want", F.explode(F.array(F.col("event"), F.lit("*"))))
    return rows.join(F.broadcast(active), "want").drop("want")
