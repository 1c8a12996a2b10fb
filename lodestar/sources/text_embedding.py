"""Static text embeddings: IDF-weighted means of word vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.blocks import BROADCAST_BYTES
from lodestar.sources.shared import materialize


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def idf(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, df, idf): ln((n + 1) / (df + 1)) + 1 over all documents."""
    seen = docs.select(F.explode(F.array_distinct(words(F.col(text)))).alias("word"))
    n = docs.count()
    df = seen.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    return df.withColumn("idf", F.log(F.lit(n + 1.0) / (F.col("df") + 1)) + 1)


def subword_vectors(vocabulary: DataFrame, dimensions: int, least: int = 3, most: int = 6) -> DataFrame:
    """(word, vector) made of hashes of each word's character n-grams: vectors
    for words that no table has, the same at every run."""
    marked = F.concat(F.lit("<"), F.col("word"), F.lit(">"))
    gram = F.flatten(F.transform(F.sequence(F.lit(least), F.lit(most)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(marked) - n + 1)), lambda i: F.substring(marked, i, n))))
    component = lambda d: F.aggregate("grams", F.lit(0.0), lambda a, g: a + F.pmod(F.xxhash64(g, F.lit(d)), F.lit(2001)) / 1000.0 - 1.0) / F.size("grams")
    return vocabulary.select("word").distinct().withColumn("grams", gram).select("word", F.array(*(component(d) for d in range(dimensions))).alias("vector"))


def embed(docs: DataFrame, vectors: DataFrame, weights: DataFrame, dimensions: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, embedding): each document's mean of its words' vectors weighted by
    count and IDF, of unit length; zeros where no word is known. Words are
    counted within each document before the join, which is on words: known words
    go to the documents while their vectors are below ``BROADCAST_BYTES``; beyond
    it, adaptive execution splits what is gathered for words that all documents
    have."""
    counts = docs.select(F.col(id).alias("id"), F.explode(words(F.col(text))).alias("word")).groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"))
    known = materialize(vectors.join(weights.select("word", "idf"), "word").select("word", "vector", "idf"), "known")
    size = known.agg(F.coalesce(F.sum(F.octet_length("word") + 8 * dimensions + 32), F.lit(0))).first()[0]
    known = F.broadcast(known) if size <= BROADCAST_BYTES else known
    weight = F.col("n") * F.col("idf")
    sums = counts.join(known, "word").groupBy("id").agg(F.sum(weight).alias("w"), *(F.sum(weight * F.get("vector", F.lit(d))).alias(f"d{d}") for d in range(dimensions)))
    mean = sums.select("id", F.array(*(F.col(f"d{d}") / F.col("w") for d in range(dimensions))).alias("v"))
    from lodestar.functions.vectors import l2_normalise

    unit = mean.select("id", l2_normalise(F.col("v")).alias("embedding"))
    return docs.select(F.col(id).alias("id")).join(unit, "id", "left").select("id", F.coalesce("embedding", F.array_repeat(F.lit(0.0), dimensions)).alias("embedding"))
