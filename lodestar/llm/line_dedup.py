"""Line dedup in DataFrame operations only.

Lines become 128-bit hashes of their keys. The hashes are range-partitioned with
a secondary sort by document and position, and a streaming window passes on the
first document of each key. The result is a run-length compressed keep bitmap
for each document that loses lines: start and length of each run of kept lines.
Texts move only in the final join, where each document's bitmap picks its lines.

A key that many documents hold is dealt over chunks by document, about as many
as the square root of all lines: the first window finds each chunk's first
document, and only the rows of those documents meet in the second window. So
neither window holds more rows of a key than that, but for lines which one
document repeats.

Rows: a null text is an empty line. A row whose doc_id is null keeps all its
lines and doesn't count as a document. Rows of one doc_id count as one document,
whatever their texts. A line of any length is one hash; an empty table gives an
empty result. Extra columns stay; the columns added replace any of the
same name."""

from __future__ import annotations

import math
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.shared import digest128, free_name, materialize

#: The documents of one key are dealt over so many chunks at least.
CHUNKS = 64
#: Shorter keys never lose a line, in code points.
LEAST_CHARS = 10
#: What a key loses at both ends.
WHITE = " \t\n\x0b\x0c\r"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(WHITE)), ascii_uppercase, ascii_lowercase)


def _version(text: Column) -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, version, n_lines, bitmap)`` of documents that lose lines;
    ``bitmap`` has the start and length of each run of kept lines, in order."""
    split = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), _version(F.col(text)).alias("version"), split_lines(F.col(text)).alias("lines"))
    lines = split.select("doc_id", "version", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    lines = lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= LEAST_CHARS)
    h1, h2 = digest128(F.col("key"))
    lines = materialize(lines.select(h1.alias("h1"), h2.alias("h2"), "doc_id", "version", "n_lines", "pos"), "lines")
    chunks = max(CHUNKS, math.isqrt(lines.count()))
    order = ("doc_id", "version", "pos")
    chunk = Window.partitionBy("h1", "h2", "chunk").orderBy(*order)
    first = (
        lines.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int")).repartitionByRange("h1", "h2", "chunk")
        .withColumn("first", F.first("doc_id").over(chunk))
        .withColumn("chunk", F.when(F.col("doc_id") == F.col("first"), F.lit(-1)).otherwise(F.col("chunk")))
        .repartitionByRange("h1", "h2", "chunk")
        .withColumn("first", F.first("doc_id").over(chunk))
    )
    drop = first.where((F.col("chunk") >= 0) | (F.col("doc_id") != F.col("first"))).select(*order, "n_lines")
    by_doc = Window.partitionBy("doc_id", "version").orderBy("pos")
    dropped = (
        drop.withColumn("run", F.col("pos") - F.dense_rank().over(by_doc))
        .groupBy("doc_id", "version", "run").agg(F.min("pos").alias("start"), (F.max("pos") - F.min("pos") + 1).alias("len"), F.first("n_lines").alias("n_lines"))
        .groupBy("doc_id", "version").agg(F.first("n_lines").alias("n_lines"), F.sort_array(F.collect_list(F.struct("start", "len"))).alias("runs"))
    )
    return dropped.select("doc_id", "version", "n_lines", between(F.col("runs"), F.col("n_lines")).alias("bitmap"))


def between(runs: Column, n_lines: Column) -> Column:
    """The runs of lines that lie between ``runs``, none of them empty."""
    end = lambda r: r["start"] + r["len"]
    before = F.transform(runs, lambda r, i: F.struct(F.when(i == 0, F.lit(0)).otherwise(end(F.get(runs, i - 1))).alias("start"), r["start"].alias("end")))
    every = F.concat(before, F.array(F.struct(end(F.element_at(runs, -1)).alias("start"), n_lines.alias("end"))))
    return F.transform(F.filter(every, lambda r: r["end"] > r["start"]), lambda r: F.struct(r["start"].alias("start"), (r["end"] - r["start"]).alias("len")))


def kept_text(text: Column, bitmap: Column) -> Column:
    """The lines that the bitmap keeps, joined; without one, all."""
    lines = split_lines(text)
    kept = F.flatten(F.transform(bitmap, lambda r: F.slice(lines, r["start"] + 1, r["len"])))
    return F.when(bitmap.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(kept, "\n"))


def _with_bitmaps(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, str]:
    i, v, b = (free_name(docs, f"_{n}") for n in ("id", "version", "bitmap"))
    bitmaps = keep_bitmaps(docs, doc_id, text).select(F.col("doc_id").alias(i), F.col("version").alias(v), F.col("bitmap").alias(b))
    on = (docs[doc_id] == bitmaps[i]) & (_version(docs[text]) == bitmaps[v])
    return docs.join(bitmaps.hint("shuffle_hash"), on, "left").drop(i, v), b


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Keys of at least ``LEAST_CHARS`` code points that two documents or more
    hold lose all their lines except in the smallest doc_id that holds them.
    Adds ``n_lines`` (before), ``keep_bitmap``, and what follows from it:
    ``n_dropped`` and ``kept``, the kept lines joined by line feeds."""
    out, b = _with_bitmaps(docs, doc_id, text)
    n = F.size(split_lines(F.col(text)))
    out = out.withColumns({"n_lines": n.cast("long"), "keep_bitmap": F.coalesce(F.col(b), F.array(F.struct(F.lit(0).alias("start"), n.alias("len"))))})
    kept = F.aggregate("keep_bitmap", F.lit(0).cast("long"), lambda a, r: a + r["len"])
    return out.withColumns({"n_dropped": F.col("n_lines") - kept, "kept": kept_text(F.col(text), F.col(b))}).drop(b)


def without_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = None) -> DataFrame:
    """``docs`` with the kept lines as texts; ``n_chars`` counts them anew where
    lines went."""
    out, b = _with_bitmaps(docs, doc_id, text)
    changed = F.col(b).isNotNull()
    out = out.withColumn(text, F.when(changed, kept_text(F.col(text), F.col(b))).otherwise(F.col(text)))
    if n_chars:
        out = out.withColumn(n_chars, F.when(changed, F.char_length(text).cast("long")).otherwise(F.col(n_chars)))
    return out.select(*docs.columns)
