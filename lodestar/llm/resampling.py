"""Importance resampling towards a target distribution.

Features are runs of 1 to ``n`` consecutive words, hashed into buckets. A
bucket's gain is the log ratio of its share in the target to that in the corpus; a
document's weight is the mean gain of its features. The documents drawn have the
highest weights after Gumbel noise from their doc_ids, which is sampling without
replacement in proportion to the exponent of the weights.

Long texts are skewed work, so texts are cut into chunks of ``CHUNK`` code points,
each up to the end of the word it ends in. A chunk carries the n - 1 words behind
it, and owns the features that start in its own words: every feature is counted
once. Chunks are counted and weighed on their own, and their counts and gains are
summed by document. Counts by bucket are combined in each task before they meet.

Rows: a null text has no words. Every row is a document of its own, repeated or
not; rows of one doc_id have the same noise. A null doc_id is hashed as "null" and
comes behind others in ties. A word of any length is one word, in one chunk. Of an
empty corpus nothing is drawn; against an empty target all gains are those of an
even target. Extra columns aren't read."""

from __future__ import annotations

import math
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.shared import materialize
from lodestar.operators.ordered import numbered

#: Code points of a chunk, but for the rest of its last word.
CHUNK = 16384
BUCKETS = 10_000
#: Words with fewer than so many words aren't drawn.
LEAST_WORDS = 20
PERCENT, SEED, SCALE = 10, 2024, 1000
#: What words consist of, once lower-cased.
IN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
NOT_IN_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"


def lowered(text: Column) -> Column:
    """The text with A-Z, and no other letters, in lower case."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def chunks(docs: DataFrame, text: str = "text", n: int = 1, size: int = CHUNK) -> DataFrame:
    """``docs`` without the text, a row for each chunk of each text: ``chunk`` with
    its ``own`` words and the words that it ``carry``-s. Texts without words, too,
    have a chunk. ``own`` and ``carry`` are arrays of words."""
    whole = lowered(F.coalesce(F.col(text), F.lit("")))
    rest = [c for c in docs.columns if c != text and c.lower() not in ("own", "carry")]
    pattern = rf"(?s)(.{{1,{size}}}{IN_WORD}*+)"
    words = lambda x: F.regexp_extract_all(x, F.lit(f"{IN_WORD}+"), F.lit(0))
    if n == 1:
        parts = F.when(F.char_length(text) > size, F.regexp_extract_all(whole, F.lit(pattern), F.lit(1))).otherwise(F.array(whole))
        return docs.select(*rest, F.explode(parts).alias("own")).select(*rest, words(F.col("own")).alias("own"), F.array().cast("array<string>").alias("carry"))
    behind = rf"(?=((?:{NOT_IN_WORD}*+{IN_WORD}++){{0,{n - 1}}}))"
    both = F.arrays_zip(F.regexp_extract_all(whole, F.lit(pattern + behind), F.lit(1)).alias("own"), F.regexp_extract_all(whole, F.lit(pattern + behind), F.lit(2)).alias("carry"))
    parts = F.when(F.char_length(text) > 0, both).otherwise(F.array(F.struct(F.lit("").alias("own"), F.lit("").alias("carry"))))
    return docs.select(*rest, F.explode(parts).alias("c")).select(*rest, words(F.col("c.own")).alias("own"), words(F.col("c.carry")).alias("carry"))


def buckets_of(own: Column, carry: Column, n: int = 1, buckets: int = BUCKETS) -> Column:
    """The buckets of all features that start in a chunk's own words."""
    one = lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(buckets)).cast("int")
    if n == 1:
        return F.transform(own, one)
    every = F.concat(own, carry)
    runs = lambda k: F.filter(F.transform(own, lambda w, i: F.when(i + k <= F.size(every), F.array_join(F.slice(every, i + 1, k), " "))), lambda x: x.isNotNull())
    return F.transform(F.concat(own, *(runs(k) for k in range(2, n + 1))), one)


def bucket_counts(docs: DataFrame, text: str = "text", n: int = 1, buckets: int = BUCKETS, size: int = CHUNK) -> list[int]:
    """How many features of all texts fall into each bucket."""
    parts = chunks(docs.select(text), text, n, size)
    counted = parts.select(F.explode(buckets_of(F.col("own"), F.col("carry"), n, buckets)).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    out = [0] * buckets
    for r in counted.collect():  # a row for each bucket at most
        out[r.bucket] = r.n
    return out


def gains(source: list[int], target: list[int], scale: int = SCALE) -> list[int]:
    """The gain of each bucket, from its counts in the corpus and in the target,
    each with one added."""
    s, t, k = sum(source), sum(target), len(source)
    return [math.floor(scale * math.log(float((b + 1) * (s + k)) / float((a + 1) * (t + k)))) for a, b in zip(source, target)]


def weighed(docs: DataFrame, gain: list[int], doc_id: str = "doc_id", text: str = "text", n: int = 1, size: int = CHUNK) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)`` for each row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    parts = chunks(rows, "text", n, size)
    found = parts.select("row", "doc_id", F.size("own").alias("n_words"), buckets_of(F.col("own"), F.col("carry"), n, len(gain)).alias("found"))
    table = F.lit(gain).cast("array<long>")
    each = found.select("row", "doc_id", "n_words", F.size("found").alias("n"), F.aggregate("found", F.lit(0).cast("long"), lambda a, b: a + F.get(table, b)).alias("gain"))
    summed = each.groupBy("row", "doc_id").agg(F.sum("n_words").alias("n_words"), F.sum("n").alias("n_features"), F.sum("gain").alias("gain"))
    least = F.expr("(gain - pmod(gain, n_features)) div n_features")  # rounds down
    return summed.select("doc_id", "n_words", "n_features", F.when(F.col("n_features") > 0, least).otherwise(F.lit(0)).cast("long").alias("weight"))


def noise(doc_id: Column, seed: int = SEED, scale: int = SCALE) -> Column:
    """Gumbel noise from a hash of the doc_id, in whole ``scale``-ths."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", n: int = 1, buckets: int = BUCKETS,
             percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, size: int = CHUNK) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of each row; ``rank`` numbers
    the rows drawn: of those with ``least_words`` words, ``percent`` in a hundred
    (rounded down) with the highest scores, of equal ones the smaller doc_id."""
    gain = gains(bucket_counts(docs, text, n, buckets, size), bucket_counts(target, target_text, n, buckets, size))
    rows = weighed(docs, gain, doc_id, text, n, size)
    rows = rows.withColumns({"score": F.col("weight") + noise(F.col("doc_id"), seed), "open": F.col("n_words") >= least_words})
    rows = materialize(rows, "weighed")
    draws = rows.where("open").count() * percent // 100
    order = [F.col("open").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    rank = F.when(F.col("open") & (F.col("rank") <= draws), F.col("rank"))
    return numbered(rows, order).select("doc_id", F.col("n_features").cast("long").alias("n_features"), "weight", "score", rank.cast("long").alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id is drawn."""
    drawn = resample(docs, target, doc_id, **options).where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(drawn, F.col(doc_id).eqNullSafe(F.col("_drawn")), "left_semi")
