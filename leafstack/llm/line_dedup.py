"""Line dedup: repeated lines go, except in the first document that holds them. JVM-side only.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. A key of at least
`min_chars` code points found in two documents or more loses all its lines outside the smallest doc_id
that holds it.

Narrow rows (key hash, document, position) are range-partitioned by hash and dealt out by document
chunks, sorted by document and position inside; a window streams over them and keeps the first document
of each key and chunk. A key that a third of all rows share is so cut into as many chunks as the input
has millions of lines. Only first documents meet in a second, small pass. Texts take no part in that;
the result is one keep bitmap per document that loses a line, without the 64-line words kept whole.

Defined cases: a null or empty text is one empty line; a null doc_id is a document after all others;
rows that repeat a doc_id are one document when lines are compared, and each row keeps its own result;
columns other than doc_id and text are not read by `keep_bitmaps` and pass through `apply_keep`.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafstack.llm.common import ASCII_SPACE, ascii_lower, ordered_id, stored

#: Lines that one task sorts, about; sets the number of chunks of a hot key.
LINES_PER_CHUNK = 1_000_000
ALL_KEPT = -1


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(ASCII_SPACE)))


def _text_id(text: Column) -> Column:
    """Tells apart rows that share a doc_id."""
    return F.xxhash64(text)


def line_rows(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc, text_id, pos, h1, h2) for each line with a key long enough; h1 and h2 are 128 bits of the key."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.select(ordered_id(F.col("doc_id")).alias("doc"), _text_id(text).alias("text_id"),
                        F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    keyed = lines.select("doc", "text_id", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select("doc", "text_id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def dropped_lines(rows: DataFrame, lines_per_chunk: int = LINES_PER_CHUNK) -> DataFrame:
    """(doc, text_id, pos) of the lines that go. `rows` is read more than once, so pass a stored table."""
    total = rows.count()
    chunks = max(16, -(-total // lines_per_chunk))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // lines_per_chunk))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64(F.lit(2), "doc"), F.lit(chunks)))
    dealt = dealt.repartitionByRange(parts, "h1", "chunk")
    in_chunk = Window.partitionBy("h1", "h2", "chunk").orderBy("doc", "pos")
    seen = dealt.select("doc", "text_id", "pos", "h1", "h2", F.first("doc").over(in_chunk).alias("first_in_chunk"))
    seen, _ = stored(seen.withColumn("later", F.col("doc") > F.col("first_in_chunk")), "line-firsts")
    # What is left holds one document per key and chunk.
    over_chunks = Window.partitionBy("h1", "h2").orderBy("doc", "pos")
    firsts = seen.where("not later").withColumn("owner", F.first("doc").over(over_chunks))
    return (seen.where("later").select("doc", "text_id", "pos")
            .unionAll(firsts.where(F.col("doc") > F.col("owner")).select("doc", "text_id", "pos")))


def keep_bitmaps(docs: DataFrame, min_chars: int = 10, lines_per_chunk: int = LINES_PER_CHUNK) -> DataFrame:
    """One row per document that loses a line: doc, text_id and `keep`, the 64-line words with a dropped line.

    Bit p of the word n tells whether line 64 n + p stays; words that are not listed stay whole.
    """
    rows, _ = stored(line_rows(docs, min_chars), "line-hashes")
    gone = dropped_lines(rows, lines_per_chunk)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("pos") % 64).cast("int"))
    words = (gone.groupBy("doc", "text_id", F.expr("pos div 64").cast("int").alias("word"))
             .agg(F.bitwise_not(F.bit_or(bit)).alias("bits")))
    return words.groupBy("doc", "text_id").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("keep"))


def apply_keep(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """`docs` with n_lines, n_dropped and kept_text; a column of such a name is replaced."""
    dense = bitmaps.select(
        "doc", "text_id",
        F.expr(f"""transform(sequence(0, element_at(keep, -1).word),
                   w -> coalesce(element_at(map_from_entries(keep), w), {ALL_KEPT}L))""").alias("words"))
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    flat = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"),
                       ordered_id(F.col("doc_id")).alias("doc"), F.coalesce("text", F.lit("")).alias("whole"))
    flat = flat.withColumn("text_id", _text_id(F.col("whole")))
    both = flat.join(dense, ["doc", "text_id"], "left")
    kept = F.expr("""if(words is null, whole, array_join(filter(split(whole, '\n'),
        (line, i) -> i div 64 >= size(words) or bit_get(words[int(i div 64)], int(i % 64)) = 1), '\n'))""")
    n_lines = (F.length("whole") - F.length(F.replace("whole", F.lit("\n"), F.lit(""))) + 1).cast("long")
    lost = F.expr("coalesce(aggregate(words, 0L, (n, w) -> n + bit_count(~w)), 0L)")
    return both.select(*(F.col(f"row.`{c}`").alias(c) for c in own),
                       n_lines.alias("n_lines"), lost.alias("n_dropped"), kept.alias("kept_text"))


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """`docs` with n_lines, n_dropped and kept_text."""
    return apply_keep(docs, keep_bitmaps(docs.select("doc_id", "text"), min_chars))


def line_report(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped and the sha256 of the kept lines."""
    done = dedup_lines(docs.select("doc_id", "text"), min_chars)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
