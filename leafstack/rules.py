"""Rule tables.

Small fixed tables are stated here.  The keyword and pattern tables are large and
belong to the user: they are parameters everywhere (`ClassRule`, `Pattern`), read from
a table with `load_class_rules` / `load_patterns`, whose size is checked before they
become part of a plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

# The document classes, as id -> (name, slug, treatment).
CLASSES = {
    "dc_001": ("TML Import Contract PO", "tml-po", "PROCESS"),
    "dc_002": ("TMPVL Purchase Order", "tmpvl-po", "PROCESS"),
    "dc_003": ("Tata Steel Purchase Order", "tsl-po", "PROCESS"),
    "dc_004": ("Airway Bill / House AWB", "awb", "PROCESS"),
    "dc_005": ("Dispatch Clearance Certificate", "dcc", "PROCESS"),
    "dc_006": ("Supplier Invoice", "supplier-invoice", "PROCESS"),
    "dc_007": ("Packing List", "packing-list", "PROCESS"),
    "dc_008": ("Inspection Certificate", "inspection-cert", "PROCESS"),
    "dc_009": ("Dangerous Goods Declaration", "dgd", "STORE"),
    "dc_010": ("Order Acknowledgement", "order-ack", "PROCESS"),
    "dc_011": ("TLL Sales Invoice", "tll-sales-invoice", "PROCESS"),
    "dc_012": ("TLL A2 Commission Invoice", "tll-a2-invoice", "PROCESS"),
    "dc_013": ("Freight Agent Invoice", "freight-invoice", "PROCESS"),
    "dc_014": ("Insurance Certificate", "insurance-cert", "STORE"),
    "dc_015": ("RFQ", "rfq", "STORE"),
    "dc_016": ("Customs Release / Bill of Entry", "bill-of-entry", "PROCESS"),
    "dc_017": ("Quality / Test Certificate", "quality-cert", "STORE"),
    "dc_018": ("FTA Certificate / Form I", "fta-cert", "STORE"),
    "dc_019": ("Quotation / RFQ Response", "quotation", "STORE"),
    "dc_020": ("Customer Remittance Advice", "remittance", "STORE"),
}

# Class families.
PO_CLASSES = ["dc_001", "dc_002", "dc_003"]
INVOICE_CLASSES = ["dc_006", "dc_011", "dc_012", "dc_013"]
INSPECTION_CLASSES = ["dc_008"]
PACKING_CLASSES = ["dc_007"]
PURCHASE_INVOICE_CLASSES = ["dc_006", "dc_013"]
SALES_INVOICE_CLASSES = ["dc_011", "dc_012"]

# Tie-breaking priority; 3 for the rest.
CLASS_PRIORITY = {
    "dc_012": 10, "dc_013": 9, "dc_005": 9, "dc_008": 9, "dc_016": 9,
    "dc_014": 8, "dc_018": 8, "dc_009": 8,
    "dc_010": 7, "dc_011": 7, "dc_002": 7, "dc_017": 7,
    "dc_001": 6, "dc_003": 5,
}
DEFAULT_PRIORITY = 3

# Fields validation requires.
VALIDATION_REQUIRED = {
    "dc_001": ["po_number", "total_order_value", "currency"],
    "dc_002": ["po_number", "total_order_value", "currency"],
    "dc_003": ["po_number", "total_order_value", "currency"],
    "dc_004": ["awb_number", "shipper_name", "consignee_name"],
    "dc_005": ["tata_po_number"],
    "dc_006": ["invoice_number", "invoice_date", "supplier_name", "total_amount", "currency", "customer_po_ref"],
    "dc_007": ["supplier_name", "consignee_name", "purchase_order_no"],
    "dc_008": ["ic_number", "supplier_name"],
    "dc_009": ["un_number", "shipper_name"],
    "dc_010": ["confirmation_number", "supplier_name"],
    "dc_011": ["invoice_number", "invoice_date", "total_invoice_value", "currency"],
    "dc_012": ["invoice_number", "invoice_date", "total_invoice_value", "currency"],
    "dc_013": ["invoice_number", "total_amount", "currency", "mawb_number"],
    "dc_014": ["certificate_number"],
    "dc_015": ["rfq_number"],
    "dc_016": ["be_number", "importer_name"],
    "dc_017": ["certificate_number", "supplier_name"],
    "dc_018": ["exporter_name", "country_of_origin"],
    "dc_019": ["supplier_name", "total_amount", "currency"],
    "dc_020": ["currency", "payment_amount"],
}
# Fields that must be dates.
DATE_FIELDS = {
    "dc_001": ["po_date", "delivery_date"],
    "dc_002": ["po_date"],
    "dc_003": ["po_date"],
    "dc_004": ["awb_date"],
    "dc_005": ["dcc_date", "lc_date", "issue_date"],
    "dc_006": ["invoice_date"],
    "dc_008": ["ic_release_date", "po_validity_start", "po_validity_end"],
    "dc_009": ["declaration_date"],
    "dc_010": ["confirmation_date"],
    "dc_011": ["invoice_date", "awb_date"],
    "dc_012": ["invoice_date", "awb_date"],
    "dc_013": ["invoice_date"],
    "dc_014": ["certificate_date", "ship_date"],
    "dc_015": ["rfq_date", "rfq_due_date"],
    "dc_016": ["be_date", "invoice_date", "assessment_date"],
    "dc_017": ["issue_date"],
    "dc_018": ["issue_date", "invoice_date"],
    "dc_019": ["quotation_date", "validity_end_date"],
    "dc_020": ["remittance_date", "payment_date"],
}
# Fields that must be numbers.
NUMBER_FIELDS = {
    "dc_001": ["total_order_value"],
    "dc_002": ["total_order_value"],
    "dc_003": ["total_order_value"],
    "dc_004": ["chargeable_weight", "actual_weight"],
    "dc_006": ["subtotal", "vat_amount", "total_amount"],
    "dc_007": ["total_gross_weight", "total_net_weight", "quantity"],
    "dc_011": ["total_invoice_value", "buying_commission_pct", "buying_commission_amt"],
    "dc_012": ["total_invoice_value", "buying_commission_amt"],
    "dc_013": ["total_amount"],
    "dc_016": ["total_cif_value", "customs_duty"],
    "dc_019": ["total_amount"],
    "dc_020": ["payment_amount"],
}
TOTAL_CHECK_CLASSES = ["dc_006"]
DECLARATION_CLASSES = ["dc_009"]

# Fields proofreading requires (not the same as validation).
PROOF_REQUIRED = {
    "dc_001": ["po_number", "currency", "total_order_value"],
    "dc_002": ["po_number", "currency", "total_order_value"],
    "dc_003": ["po_number", "currency", "total_order_value"],
    "dc_004": ["awb_number", "shipper_name", "consignee_name"],
    "dc_005": ["tata_po_number"],
    "dc_006": ["invoice_number", "supplier_name", "total_amount", "currency"],
    "dc_007": ["supplier_name", "consignee_name", "gross_weight"],
    "dc_008": ["ic_number", "supplier_name"],
    "dc_009": ["un_number", "shipper_name"],
    "dc_010": ["confirmation_number", "supplier_name"],
    "dc_011": ["invoice_number", "total_invoice_value", "currency"],
    "dc_012": ["invoice_number", "total_invoice_value", "currency"],
    "dc_013": ["invoice_number", "currency", "total_amount"],
    "dc_014": ["certificate_number"],
    "dc_015": ["rfq_number"],
    "dc_016": ["be_number", "importer_name"],
    "dc_017": ["certificate_number", "supplier_name"],
    "dc_018": ["exporter_name", "country_of_origin"],
    "dc_019": ["supplier_name", "total_amount", "currency"],
    "dc_020": ["currency", "payment_amount"],
}

# Fields compared with the history of a layout; fields exempt from bleed checks.
STABLE_FIELDS = ["currency", "incoterms", "country_of_origin"]
BLEED_EXEMPT = ["shipper_name", "consignee_name", "origin_airport", "destination_airport"]

# Numeric fields whose extracted value is tidied.
NUMERIC_FIELDS = [
    "total_amount", "total_order_value", "total_invoice_value",
    "net_amount", "subtotal", "vat_amount", "payment_amount",
    "chargeable_weight", "actual_weight", "total_gross_weight", "total_net_weight",
    "buying_commission_pct", "buying_commission_amt", "customs_duty", "total_cif_value",
    "quantity", "pieces",
]

# Fields each class is extracted for (numbers, dates and parties first).
# The table is a parameter of `extract_fields`; fields never taken by patterns are below.
PATTERN_EXCLUSIONS = {"dc_015": ["supplier_name"], "dc_019": ["issuer"]}
STAGE_FACTOR = {"ZERO_SHOT": 0.88, "LEARNING": 0.92, "LEARNED": 1.0, "OPTIMISED": 1.0}
DEFAULT_STAGE_FACTOR = 0.88

# Reference fields, best first.
REFERENCE_FIELDS = [
    "tata_po_number", "po_number", "customer_po_ref", "customer_po_number",
    "tll_reference", "tll_po_number", "awb_number", "mawb_number",
    "hawb_number", "awb_bl_number", "invoice_number", "confirmation_number",
]

# The field that names a filed document.
FILING_FIELDS = {
    "dc_001": "po_number", "dc_002": "po_number", "dc_003": "po_number",
    "dc_004": "awb_number", "dc_005": "tata_po_number", "dc_006": "invoice_number",
    "dc_007": "purchase_order_no", "dc_008": "ic_number", "dc_009": "un_number",
    "dc_010": "confirmation_number", "dc_011": "invoice_number", "dc_012": "invoice_number",
    "dc_013": "invoice_number", "dc_014": "certificate_number", "dc_015": "rfq_number",
    "dc_016": "be_number", "dc_017": "certificate_number", "dc_018": "certificate_number",
    "dc_019": "quotation_number", "dc_020": "remittance_number",
}

# Allowed state changes.
TRANSITIONS = {
    "RECEIVED": ["DEDUPLICATING", "FAILED"],
    "DEDUPLICATING": ["CLASSIFYING", "EXACT_DUPLICATE", "CONTENT_DUPLICATE", "NEAR_DUPLICATE", "FAILED"],
    "EXACT_DUPLICATE": ["COMPLETED"],
    "CONTENT_DUPLICATE": ["NEEDS_REVIEW", "COMPLETED"],
    "NEAR_DUPLICATE": ["EXTRACTING", "NEEDS_REVIEW"],
    "CLASSIFYING": ["EXTRACTING", "UNCLASSIFIED", "NEEDS_REVIEW", "FAILED"],
    "UNCLASSIFIED": ["EXTRACTING", "FAILED"],
    "EXTRACTING": ["PROOFREADING", "AI_REVIEWING", "VALIDATING", "GOVERNING", "NEEDS_REVIEW", "FAILED"],
    "PROOFREADING": ["EXTRACTING", "AI_REVIEWING", "VALIDATING", "GOVERNING", "NEEDS_REVIEW", "FAILED"],
    "AI_REVIEWING": ["VALIDATING", "GOVERNING", "NEEDS_REVIEW", "FAILED"],
    "GOVERNING": ["EXTRACTING", "NEEDS_REVIEW", "CANDIDATE_NEW_CLASS", "FAILED"],
    "VALIDATING": ["LINKING", "NEEDS_REVIEW", "FAILED"],
    "LINKING": ["MATCHING", "POSTING", "FAILED"],
    "MATCHING": ["POSTING", "NEEDS_REVIEW", "FAILED"],
    "POSTING": ["FILING", "NEEDS_REVIEW", "FAILED"],
    "FILING": ["NOTIFYING", "FAILED"],
    "NOTIFYING": ["COMPLETED", "FAILED"],
    "NEEDS_REVIEW": ["EXTRACTING", "VALIDATING", "MATCHING", "POSTING", "COMPLETED", "FAILED"],
    "CANDIDATE_NEW_CLASS": ["EXTRACTING", "NEEDS_REVIEW", "FAILED"],
    "COMPLETED": [],
    "FAILED": ["RECEIVED"],
}
# States that end a document's way, that a duplicate may point to, and before classification.
TERMINAL_STATES = ["COMPLETED", "EXACT_DUPLICATE", "NEEDS_REVIEW", "CANDIDATE_NEW_CLASS", "FAILED"]
DEDUP_STATES = ["COMPLETED", "NEEDS_REVIEW", "CONTENT_DUPLICATE", "NEAR_DUPLICATE"]
EARLY_STATES = ["RECEIVED", "DEDUPLICATING", "CLASSIFYING", "UNCLASSIFIED"]
APPROVE_TARGETS = ["EXTRACTING", "VALIDATING", "MATCHING", "POSTING", "COMPLETED"]


@dataclass(frozen=True)
class ClassRule:
    """Keywords of one class.  `static_count` is the keyword count redirects divide by."""
    class_id: str
    keywords: tuple[str, ...]
    negatives: tuple[str, ...] = ()
    priority: int = DEFAULT_PRIORITY
    name: str = ""
    static_count: int | None = None


@dataclass(frozen=True)
class Redirect:
    """When `winner` won and the text fits, the class becomes `target`."""
    winner: str
    target: str
    all_of: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()
    none_of: tuple[str, ...] = ()
    none_pattern: str | None = None
    other_class: str | None = None
    other_min: int = 0


@dataclass(frozen=True)
class PhraseRule:
    """Checked before scoring; gives `target` with confidence 1."""
    target: str
    all_of: tuple[str, ...]
    any_of: tuple[str, ...] = ()


@dataclass(frozen=True)
class Pattern:
    """One extraction pattern; those of a field are tried in order, group `group` is the value."""
    field_name: str
    regex: str
    group: int = 1
    confidence: float = 0.9


@dataclass(frozen=True)
class Instruction:
    instruction_id: int
    action: str
    class_id: str | None = None
    cond_field: str | None = None
    cond_op: str | None = None
    cond_value: str | None = None
    action_value: str | None = None
    priority: int = 100
    active: bool = True


# Phrases of certificates, of order confirmations and of test reports.
CERTIFICATE_PHRASES = (
    "heat treatment certificate", "heat treatment", "phytosanitary", "certificate of treatment",
    "declaration of conformity", "ce marking", "we hereby certify", "certificate of compliance",
)
CONFIRMATION_PHRASES = (
    "order confirmation", "orderconfirmation", "sales confirmation",
    "order acknowledgement", "order acknowledgment", "orderacknowledgment",
)
TEST_PHRASES = (
    "test certificate", "certificate of conformance", "material test", "test report",
    "quality certificate", "we hereby certify", "chemical composition", "mechanical properties",
)
# Redirects in order; the first that fits wins.
REDIRECTS = [
    Redirect("dc_011", "dc_012", all_of=("client invoice -a2",)),
    Redirect("dc_006", "dc_013", any_of=("mawb-no", "hawb-no")),
    Redirect("dc_006", "dc_019", all_of=("quotation",),
             none_of=("tax invoice", "proforma invoice", "pro-forma invoice"),
             none_pattern=r"(?i)invoice\s*(?:no\.?|number|date|ref\.?|#)\s*[:\-.\s]*\d"),
    Redirect("dc_006", "dc_017", any_of=CERTIFICATE_PHRASES, none_of=("invoice",)),
    Redirect("dc_006", "dc_010", any_of=CONFIRMATION_PHRASES, none_of=("quotation",)),
    Redirect("dc_017", "dc_003", all_of=("please supply and deliver",), any_of=("tsl/", "purchase order no")),
    Redirect("dc_017", "dc_019", all_of=("quotation",), other_class="dc_019", other_min=2),
    Redirect("dc_010", "dc_019", all_of=("quotation",), other_class="dc_019", other_min=2),
    Redirect("dc_007", "dc_001", all_of=("imports contract", "tata motors")),
    Redirect("dc_007", "dc_003", all_of=("tata steel",), any_of=("please supply and deliver", "rate contract")),
    Redirect("dc_003", "dc_007", all_of=("packing list",), none_of=("please supply and deliver",)),
    Redirect("dc_003", "dc_017", any_of=TEST_PHRASES, none_of=("please supply and deliver",),
             other_class="dc_017", other_min=1),
]
# Phrases that settle the class before scoring.
PHRASE_RULES = [
    PhraseRule("dc_012", ("client invoice", "tata limited invoice no"), ("client invoice -a2", "a2 invoice")),
    PhraseRule("dc_011", ("client invoice", "tata limited invoice no")),
]


def _bounded_rows(table: DataFrame, limit: int) -> list:
    """Rows of a rule table that is proven small: more than `limit` rows is an error."""
    rows = table.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a rule table may have at most {limit} rows")
    return rows


def load_class_rules(table: DataFrame, limit: int) -> list[ClassRule]:
    """At most `limit` rows, else an error: (class_id, ordinal, keyword, negative, priority[, name]) -> rules in class order."""
    grouped: dict[str, dict] = {}
    for r in sorted(_bounded_rows(table, limit), key=lambda r: (r["class_id"], r["ordinal"])):
        g = grouped.setdefault(r["class_id"], {"k": [], "n": [], "p": r["priority"]})
        g["n" if r["negative"] else "k"].append(r["keyword"])
    return [ClassRule(c, tuple(g["k"]), tuple(g["n"]),
                      g["p"] if g["p"] is not None else CLASS_PRIORITY.get(c, DEFAULT_PRIORITY),
                      CLASSES.get(c, (c,))[0]) for c, g in grouped.items()]


def load_patterns(table: DataFrame, limit: int) -> list[Pattern]:
    """At most `limit` rows, else an error: (field_name, ordinal, regex, grp, base_conf) -> patterns in order."""
    rows = sorted(_bounded_rows(table, limit), key=lambda r: (r["field_name"], r["ordinal"]))
    return [Pattern(r["field_name"], r["regex"], r["grp"], r["base_conf"]) for r in rows]


def rule_rows(spark, table: dict[str, list[str]]) -> DataFrame:
    """{class: [field, ...]} -> (class_id, rule_no, field_name)."""
    return spark.createDataFrame(
        [(c, i, f) for c, fs in table.items() for i, f in enumerate(fs)],
        "class_id string, rule_no int, field_name string")


def class_table(spark) -> DataFrame:
    return spark.createDataFrame(
        [(c, *v, True) for c, v in CLASSES.items()],
        "class_id string, name string, slug string, treatment string, active boolean")


def transition_table(spark) -> DataFrame:
    return spark.createDataFrame(
        [(a, b) for a, bs in TRANSITIONS.items() for b in bs], "from_state string, to_state string")
