"""Reading raw material: files, pages, tables with tolerant JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_FILE_MB = 50
PDF_MAGIC = "%PDF"
MIME_TYPES = ["application/pdf", "application/octet-stream"]


def read_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One parquet table; naming the columns keeps the scan narrow."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Raw files: document_id (from the path), file_name, mime_type (from the name), content, created_at."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.substring_index("path", "/", -1)
    return files.select(
        F.concat(F.lit("doc_"), F.sha2("path", 256)).alias("document_id"), name.alias("file_name"),
        F.when(F.lower(name).endswith(".pdf"), "application/pdf").otherwise("application/octet-stream").alias("mime_type"),
        "content", F.col("modificationTime").cast("timestamp_ntz").alias("created_at"))


def reject_reason(mime: Column, content: Column, max_mb: int = MAX_FILE_MB) -> Column:
    """First failed upload check: type, size, emptiness, header; null when all pass."""
    size = F.length(content)
    return (
        F.when(~F.coalesce(mime, F.lit("")).isin(MIME_TYPES), "invalid_file_type")
        .when(size > max_mb * 1024 * 1024, "file_too_large")
        .when(F.coalesce(size, F.lit(0)) == 0, "empty_file")
        .when(F.substring(content, 1, 4) != F.lit(PDF_MAGIC).cast("binary"), "invalid_pdf"))


def ingest_quarantine(raw: DataFrame, max_mb: int = MAX_FILE_MB) -> DataFrame:
    """Raw files with reject_reason; filter on it for the accepted and the quarantined part."""
    return raw.withColumn("reject_reason", reject_reason(F.col("mime_type"), F.col("content"), max_mb))


def register_documents(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New document rows (RECEIVED, size, hash) and their first event rows."""
    docs = raw.select(
        "document_id", F.lit("RECEIVED").alias("status"), "file_name",
        F.length("content").cast("bigint").alias("file_size_bytes"), F.sha2("content", 256).alias("file_sha256"),
        "created_at")
    events = raw.select("document_id", F.lit("RECEIVED").alias("state"), F.lit("IngestAgent").alias("agent"),
                        F.concat(F.lit("Received "), "file_name").alias("detail"), "created_at")
    return docs, events


def read_json_map(column: Column) -> Column:
    """JSON object as map<string,string>; null, blank or broken text gives an empty map."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return F.coalesce(F.from_json(column, "map<string,string>"), empty)


PROFILE_SCHEMA = "keywords array<string>, negative_keywords array<string>, priority int, notes string"


def read_classifier_profile(column: Column) -> Column:
    """Classifier profile JSON with the defaults filled in."""
    p = F.from_json(column, PROFILE_SCHEMA)
    none = F.array().cast("array<string>")
    return F.struct(
        F.coalesce(p["keywords"], none).alias("keywords"), F.coalesce(p["negative_keywords"], none).alias("negative_keywords"),
        F.coalesce(p["priority"], F.lit(3)).alias("priority"), F.coalesce(p["notes"], F.lit("")).alias("notes"))


SCHEMA_ENTRY = "map<string, struct<aliases:array<string>, required:boolean, example:string, format_hint:string, format_type:string>>"


def read_field_schema(rows: DataFrame, column: str = "field_schema_json", key: str = "variant_id") -> DataFrame:
    """Schema JSON -> one row per field and alias: key, canonical, alias_no, alias; reserved entries dropped."""
    parsed = rows.select(key, F.explode(F.from_json(column, SCHEMA_ENTRY)).alias("canonical", "m"))
    aliases = F.when(F.size("m.aliases") > 0, F.col("m.aliases")).otherwise(F.array("canonical"))
    return parsed.filter(~F.col("canonical").startswith("__")).select(
        key, "canonical", F.posexplode(aliases).alias("alias_no", "alias"))


def document_view(docs: DataFrame) -> DataFrame:
    """Public columns of a document."""
    keep = ["document_id", "status", "class_id", "variant_id", "file_name", "file_size_bytes", "created_at"]
    return docs.select(*[c for c in keep if c in docs.columns])


def field_view(fields: DataFrame) -> DataFrame:
    """Public columns of a field, with the value shown."""
    return fields.select("document_id", "field_name", "field_value", "confidence", "human_corrected", "corrected_value")
