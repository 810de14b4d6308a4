"""The derived inputs of `leafstack.queries.views`, stated in SQL, and a composer for queries."""

from __future__ import annotations

BASE: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, sql: str, *needs: str) -> None:
    BASE[name] = (needs, sql)


def with_views(body: str, *names: str) -> str:
    """`body` behind a WITH clause holding the named views and all they need."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in BASE[n][0]:
            add(d)
        if n not in order:
            order.append(n)
    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({BASE[n][1]})" for n in order)
    if ctes and body.lstrip().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body.lstrip().removeprefix('WITH RECURSIVE ')}"
    return f"WITH {ctes}\n{body}" if ctes else body


def values(columns: str, rows: list[tuple]) -> str:
    """A literal table; None becomes NULL."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return str(v)
        return "'" + str(v).replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({columns})"


view("registry", """
SELECT 'doc_' || doc_id AS document_id, doc_id, sha256(text) AS file_sha256, n_chars AS file_size_bytes,
  TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id AS BIGINT)) AS created_at,
  TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id * 3 % 5000 AS BIGINT)) AS updated_at,
  'c_' || lang AS class_id, source AS variant_id,
  CASE WHEN doc_id % 10 <= 5 THEN 'COMPLETED' WHEN doc_id % 10 = 6 THEN 'NEEDS_REVIEW' WHEN doc_id % 10 = 7 THEN 'FAILED'
       WHEN doc_id % 10 = 8 THEN 'CANDIDATE_NEW_CLASS' ELSE 'EXTRACTING' END AS status,
  'File_' || doc_id || '.pdf' AS file_name,
  CASE WHEN doc_id % 4 <> 3 THEN doc_id % 7 + 1 END AS pages_total, doc_id % 3 AS pages_skipped_count, text
FROM documents""")

view("doc_pages", """
SELECT 'doc_' || doc_id AS document_id, source AS variant_id,
  unnest(range(len(string_split(text, chr(10))))) AS page_num, unnest(string_split(text, chr(10))) AS text
FROM documents""")

view("bundle_pages", """
SELECT 'conv_' || conv_id AS document_id, turn AS page_num, role, text FROM conversations""")

view("order_suppliers", """
SELECT l_orderkey, min(l_suppkey) AS suppkey, min(l_shipdate) AS shipdate,
  sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS total
FROM lineitem GROUP BY l_orderkey""")

view("po", """
SELECT o_orderkey AS k, 'po_' || o_orderkey AS document_id, 'TSL/' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS po_number,
  strftime(o_orderdate, '%Y-%m-%d') AS po_date,
  CASE c_nationkey % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' WHEN 2 THEN 'USD' END AS currency,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS total_order_value, s_name AS supplier_name
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN order_suppliers ON o_orderkey = l_orderkey
  LEFT JOIN supplier ON suppkey = s_suppkey""", "order_suppliers")

view("inv", """
SELECT l_orderkey AS k, 'inv_' || l_orderkey AS document_id, 'INV-' || lpad(CAST(l_orderkey AS VARCHAR), 6, '0') AS invoice_number,
  strftime(shipdate, '%Y-%m-%d') AS invoice_date,
  CASE WHEN l_orderkey % 17 = 0 THEN 'CHF' ELSE CASE c_nationkey % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' WHEN 2 THEN 'USD' END END AS currency,
  CAST(CAST(round(total, 2) AS DECIMAL(18,2)) AS VARCHAR) AS total_amount,
  CASE WHEN l_orderkey % 11 = 0 THEN NULL WHEN l_orderkey % 13 = 0 THEN 'TSL/999999'
       ELSE 'TSL/' || lpad(CAST(l_orderkey AS VARCHAR), 6, '0') END AS customer_po_ref,
  CASE WHEN l_orderkey % 7 <> 0 THEN s_name END AS supplier_name, suppkey
FROM order_suppliers LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN supplier ON suppkey = s_suppkey""", "order_suppliers")


def _unpivot(table: str, columns: list[str], base: int) -> str:
    return " UNION ALL ".join(
        f"SELECT k, document_id, {i} AS ordinal, {base} + {i} AS slot, '{c}' AS field_name, {c} AS field_value FROM {table}"
        for i, c in enumerate(columns))


PO_COLUMNS = ["po_number", "po_date", "currency", "total_order_value", "supplier_name"]
INVOICE_COLUMNS = ["invoice_number", "invoice_date", "currency", "total_amount", "customer_po_ref", "supplier_name"]

view("fields", f"""
SELECT k * 20 + slot AS field_id, k, document_id, ordinal, field_name, field_value, 'scalar' AS field_type,
  0.5 + CAST((k * 7 + ordinal * 13) % 50 AS DECIMAL(4,2)) / 100 AS confidence,
  CASE k % 3 WHEN 0 THEN 'TEXT_LAYER' WHEN 1 THEN 'AI_TEXT' ELSE 'FAST_PATTERNS' END AS extraction_method,
  (k + ordinal) % 29 = 0 AS human_corrected,
  CASE WHEN (k + ordinal) % 29 = 0 THEN upper(field_value) END AS corrected_value
FROM ({_unpivot('po', PO_COLUMNS, 0)} UNION ALL {_unpivot('inv', INVOICE_COLUMNS, 10)}) u
WHERE field_value IS NOT NULL""", "po", "inv")

view("eff", """
SELECT *, CASE WHEN human_corrected THEN corrected_value ELSE coalesce(field_value, '') END AS value FROM fields""", "fields")

view("trade_docs", """
SELECT *, 'shp_' || k AS shipment_id,
  CASE WHEN k % 10 <= 6 THEN 'COMPLETED' WHEN k % 10 = 7 THEN 'NEEDS_REVIEW' WHEN k % 10 = 8 THEN 'FAILED' ELSE 'EXTRACTING' END AS status,
  document_id || '.pdf' AS file_name,
  CASE WHEN k % 4 = 0 THEN 'ADVISORY' WHEN k % 9 = 0 THEN 'SKIP' ELSE 'REQUIRED' END AS match_mode,
  k % 6 = 0 AS skips_posting
FROM (
  SELECT o_orderkey AS k, 'po_' || o_orderkey AS document_id, 'dc_003' AS class_id, TIMESTAMP '2024-01-01' + to_minutes(CAST(o_orderkey * 5 AS BIGINT)) AS created_at, NULL AS variant_id FROM orders
  UNION ALL SELECT l_orderkey, 'inv_' || l_orderkey, 'dc_006', TIMESTAMP '2024-01-01' + to_minutes(CAST(l_orderkey * 5 + 1 AS BIGINT)), 'v_' || suppkey % 20 FROM order_suppliers
  UNION ALL SELECT o_orderkey, 'ic_' || o_orderkey, 'dc_008', TIMESTAMP '2024-01-01' + to_minutes(CAST(o_orderkey * 5 + 2 AS BIGINT)), NULL FROM orders WHERE o_orderkey % 5 = 0
  UNION ALL SELECT o_orderkey, 'pl_' || o_orderkey, 'dc_007', TIMESTAMP '2024-01-01' + to_minutes(CAST(o_orderkey * 5 + 3 AS BIGINT)), NULL FROM orders WHERE o_orderkey % 3 = 0
) d""", "order_suppliers")

view("doc_events", """
SELECT 'doc_' || user_id AS document_id, event_id, ts AS created_at,
  CASE event_type WHEN 'signup' THEN 'RECEIVED' WHEN 'view' THEN 'EXTRACTING' WHEN 'click' THEN 'VALIDATING'
       WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'NEEDS_REVIEW' END AS state,
  CASE WHEN event_type = 'error' THEN 'NIGO - 2 condition(s) failed. A ' || event_id || ' | B' ELSE props END AS detail
FROM events""")

view("variants", """
SELECT variant_id, class_id, doc_count, created_at,
  CASE WHEN n * 4 >= 50 THEN 'OPTIMISED' WHEN n * 4 >= 10 THEN 'LEARNED_PROPOSED' WHEN n * 4 >= 3 THEN 'LEARNING' ELSE 'ZERO_SHOT' END AS learning_stage,
  'Layout ' || variant_id AS variant_label, n % 7 <> 6 AS active, n % 5 AS confirmed_instances
FROM (SELECT variant_id, class_id, count(*) AS doc_count, min(created_at) AS created_at, CAST(replace(variant_id, 'v_', '') AS INTEGER) AS n
      FROM trade_docs WHERE class_id = 'dc_006' GROUP BY ALL) v""", "trade_docs")

view("variant_schema", """
SELECT variant_id, canonical, alias_no, alias FROM variants, (VALUES ('invoice_number', 0, 'inv_no'), ('invoice_number', 1, 'invoice_number'),
  ('invoice_date', 0, 'invoice_date'), ('total', 0, 'total_amount'), ('supplier_name', 0, 'supplier_name'), ('iban', 0, 'iban')) s(canonical, alias_no, alias)
WHERE learning_stage <> 'ZERO_SHOT'""", "variants")

REFERENCE_RANKS = [
    "tata_po_number", "po_number", "customer_po_ref", "customer_po_number",
    "tll_reference", "tll_po_number", "awb_number", "mawb_number",
    "hawb_number", "awb_bl_number", "invoice_number", "confirmation_number",
]
view("link_keys", f"""
SELECT document_id, key, min(rank) AS rank FROM (
  SELECT document_id, trim(CASE WHEN human_corrected THEN corrected_value ELSE field_value END) AS key,
    list_position({REFERENCE_RANKS!r}, field_name) - 1 AS rank
  FROM fields WHERE field_name IN ('po_number', 'customer_po_ref', 'invoice_number')
  UNION ALL SELECT 'po_' || o_orderkey, 'AWB-' || (o_orderkey // 4), 6 FROM orders WHERE o_orderkey % 3 = 0
) r WHERE key <> '' AND key <> 'TSL/999999' GROUP BY document_id, key""", "fields")

view("contributions", """
SELECT variant_id, document_id, page_num, CASE WHEN contains(lower(text), 'ine') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'que') THEN 1 ELSE 0 END AS found,
  contains(lower(text), 'ine') AS has_a, contains(lower(text), 'que') AS has_b
FROM doc_pages""", "doc_pages")

view("page_profile", """
SELECT variant_id, page_num, any_value(instances) AS instances, count(*) AS present_in, count(*) FILTER (found > 0) AS contributed_in,
  CASE WHEN bool_or(has_a) AND bool_or(has_b) THEN 'ref_a,ref_b' WHEN bool_or(has_a) THEN 'ref_a' WHEN bool_or(has_b) THEN 'ref_b' ELSE '' END AS fields_seen,
  any_value(instances) >= 3 AND count(*) >= 3 AND count(*) FILTER (found > 0) = 0 AS skip
FROM contributions JOIN (SELECT variant_id, count(DISTINCT document_id) AS instances FROM contributions GROUP BY 1) USING (variant_id)
GROUP BY variant_id, page_num""", "contributions")

view("trade_text", """
SELECT k, document_id, 'dc_006' AS class_id, invoice_number, invoice_date, supplier_name, customer_po_ref, currency, total_amount FROM inv""", "inv")

_bits = ", ".join(f"sum((h >> {i}) & 1) AS b{i}" for i in range(64))
_word = " | ".join(f"(CASE WHEN b{i} * 2 > n THEN CAST(1 AS UBIGINT) << {i} ELSE CAST(0 AS UBIGINT) END)" for i in range(64))
view("norm_text", r"""
SELECT document_id, doc_id, class_id, status, created_at,
  trim(regexp_replace(regexp_replace(lower(text), '[\s\p{Z}]+', ' ', 'g'), '[^\p{L}\p{N}_\s]', '', 'g')) AS norm
FROM registry""", "registry")
view("simhash_bits", f"""
SELECT document_id, count(*) AS n, {_bits} FROM (
  SELECT document_id, md5_number_upper(gram) AS h FROM (
    SELECT document_id, substr(norm, CAST(i AS BIGINT), 3) AS gram FROM (
      SELECT document_id, norm, unnest(range(1, greatest(length(norm) - 2, 1) + 1)) AS i FROM norm_text WHERE norm <> ''))) GROUP BY document_id""", "norm_text")
view("simhash", f"""
SELECT t.document_id, class_id, status, created_at, coalesce(fp, CAST(0 AS UBIGINT)) AS fp
FROM norm_text t LEFT JOIN (SELECT document_id, {_word} AS fp FROM simhash_bits) s USING (document_id)""", "simhash_bits", "norm_text")
