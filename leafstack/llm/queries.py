"""Registered queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leafstack.llm import (bpe, decontaminate, html_text, license_scan, line_dedup, near_dedup, prefix_trie, quality_rules, secret_scan, sharding,
                           token_files, toxicity, whitening)
from leafstack.llm.common import table

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}
#: The tokenizer of the token queries; each operator takes the path as a parameter.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, sql: str | None = None):
    def add(fn):
        LLM_QUERIES[name] = fn
        if sql:
            LLM_ORACLES[name] = sql
        return fn
    return add


@query("op7_line_dedup", r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i, lines[i] AS line,
             translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
o AS (SELECT k, min(doc_id) AS owner FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT l.doc_id, l.i, l.line, (o.owner IS NOT NULL AND l.doc_id <> o.owner) AS gone
      FROM l LEFT JOIN o ON l.k = o.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""")
def line_dedup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


@query("op4_sharding")
def sharding_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(table(spark, sf_dir, "documents"))


@query("op1_token_files")
def token_file_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_report(table(spark, sf_dir, "documents"), TOKENIZER)


@query("op2_quality_rules")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


@query("op3_bpe")
def bpe_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), TOKENIZER, with_text=False)


@query("op10_near_dedup")
def near_dedup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


@query("op8_license_scan")
def license_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(table(spark, sf_dir, "documents"))


@query("op9_toxicity")
def toxicity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_decontamination")
def contamination_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The (document, item) pairs that are held to be copies."""
    return decontaminate.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


@query("op6_html_text")
def html_text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


@query("op11_secret_scan")
def secret_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


@query("op12_whitening")
def whitening_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op13_prefix_trie", r"""
WITH crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t
             FROM range(256) r(i)),
own AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS s
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hashed AS (SELECT conv_id, s, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                                              lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 9 AS h FROM own, crc),
rebuilt AS (SELECT o.conv_id, list_concat(coalesce(f.s[1:o.h], []), o.s[o.h + 1:]) AS s
            FROM hashed o LEFT JOIN own f ON f.conv_id = o.conv_id - o.conv_id % 5),
members AS (SELECT conv_id, len(s) AS n, d, s[1:d] AS p FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE strlen(any_value(p[d].x)) END AS bytes,
                 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM members GROUP BY p, d),
named AS (SELECT m.conv_id AS member, m.d, v.conv_id FROM members m JOIN nodes v ON m.d = v.d AND m.p = v.p),
below AS (SELECT DISTINCT a.conv_id, a.d, b.conv_id AS low_id, b.d AS low_d FROM named a JOIN named b ON a.member = b.member AND a.d <= b.d),
kids AS (SELECT v.conv_id, v.d, count(*) AS n_children FROM nodes c JOIN nodes v ON v.d = c.d - 1 AND v.p = c.p[1:c.d - 1] GROUP BY v.conv_id, v.d)
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(k.n_children, 0) AS n_children,
       CAST(sum(CASE WHEN lk.n_children IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum((l.n_convs - 1) * l.bytes) AS BIGINT) AS saved_tokens, v.ends_sha256
FROM nodes v LEFT JOIN nodes u ON u.d = v.d - 1 AND u.p = v.p[1:v.d - 1] LEFT JOIN kids k ON k.conv_id = v.conv_id AND k.d = v.d
JOIN below b ON b.conv_id = v.conv_id AND b.d = v.d JOIN nodes l ON l.conv_id = b.low_id AND l.d = b.low_d
LEFT JOIN kids lk ON lk.conv_id = b.low_id AND lk.d = b.low_d
GROUP BY ALL""")
def trie_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_nodes(table(spark, sf_dir, "conversations"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run     # it imports this module
    return run(spark, sf_dir)
