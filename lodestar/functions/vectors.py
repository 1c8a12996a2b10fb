"""Elementwise functions of vector columns: normalisation, padding, bit packing,
statistics of a column of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.metrics import norm


def l2_normalise(v: Column) -> Column:
    """Unit length; zero vectors stay as they are."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / F.when(n > 0, n))).otherwise(v.cast("array<double>"))


def center(v: Column, mean: Column) -> Column:
    return F.zip_with(v, mean, lambda x, m: x - m)


def remap(v: Column, source: list[int]) -> Column:
    """Dimension i of the result is dimension source[i], 0 where that is -1."""
    return F.array(*(F.lit(0.0) if i < 0 else F.get(v, F.lit(i)).cast("double") for i in source))


def fma(a: Column, factor: float, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + F.lit(factor) * y)


def argmin(v: Column) -> Column:
    return F.array_position(v, F.array_min(v)).cast("int") - 1


def sign_words(v: Column) -> Column:
    """Bits of v > 0 in 32-bit words of longs, the first dimension lowest."""
    words = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / 32).cast("int"))
    bits = lambda w: F.aggregate(
        F.slice(v, w * 32 + 1, F.lit(32)), F.struct(F.lit(0).cast("long").alias("word"), F.lit(1).cast("long").alias("bit")),
        lambda s, x: F.struct((s["word"] + F.when(x > 0, s["bit"]).otherwise(F.lit(0))).alias("word"), (s["bit"] * 2).alias("bit")),
        lambda s: s["word"])
    return F.transform(words, bits)


def pack_bits(fields: Column, bits: int) -> Column:
    """Fields of ``bits`` bits as one array of bytes, the lowest bits first."""
    joined = F.flatten(F.transform(fields, lambda f: F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.call_function("shiftright", f.cast("long"), i) % 2)))
    n = F.ceil(F.size(joined) / 8).cast("int")
    byte = lambda b: F.aggregate(F.reverse(F.slice(joined, b * 8 + 1, F.lit(8))), F.lit(0).cast("long"), lambda s, x: s * 2 + x)
    return F.transform(F.sequence(F.lit(0), n - 1), byte).cast("array<int>")


def unpack_bits(packed: Column, bits: int, n: int) -> Column:
    """The first n fields of ``bits`` bits of an array of bytes."""
    bit = lambda i: F.call_function("shiftright", F.get(packed, F.floor(i / 8).cast("int")), (i % 8).cast("int")) % 2
    field = lambda f: F.aggregate(F.sequence(f * bits + bits - 1, f * bits, F.lit(-1)), F.lit(0).cast("long"), lambda s, i: s * 2 + bit(i))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), field)


def k_smallest(v: Column, k: int, largest: bool = False) -> Column:
    """The k smallest (or largest) values with their positions, ties by position."""
    pairs = F.transform(v, lambda x, i: F.struct((-x if largest else x).alias("key"), i.alias("pos"), x.alias("value")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct(p["pos"], p["value"]))


def nth_smallest(v: Column, n: Column | int) -> Column:
    """The n-th smallest element that is a number (n from 1); null if there are
    fewer."""
    return F.get(F.array_sort(F.filter(v, lambda x: x.isNotNull() & ~F.isnan(x))), F.lit(n) - 1 if isinstance(n, int) else n - 1)


def partition(v: Column, least: int, most: int) -> Column:
    """A threshold and the positions of ``least`` to ``most`` of the smallest
    elements: all below the threshold, and as many equal to it as there is room
    for, in order of position."""
    limit = nth_smallest(v, least)
    at = F.transform(v, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    below = F.transform(F.filter(at, lambda p: p["x"] < limit), lambda p: p["i"])
    equal = F.transform(F.filter(at, lambda p: p["x"] == limit), lambda p: p["i"])
    return F.struct(limit.alias("threshold"), F.array_sort(F.concat(below, F.slice(equal, F.lit(1), F.lit(most) - F.size(below)))).alias("positions"))


def bucket_sort(rows: DataFrame, value: str = "value", id: str = "id") -> DataFrame:
    """``(value, id, place, n, before)``: each row's place, from 1, in the order of
    values, null first, and ids; how many rows have its value, and how many come
    before all of these. No task holds the rows of a value, nor all values."""
    from lodestar.operators.ordered import numbered
    from lodestar.sources.shared import materialize

    placed = materialize(numbered(rows.select(value, id), [value, id], "place"), "placed")
    n = placed.groupBy(F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("n"), (F.min("place") - 1).alias("before"))
    return placed.join(n, F.col(value).eqNullSafe(F.col("_value"))).select(value, id, "place", "n", "before")


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """``(bin, n)`` of equal ranges from ``low`` to ``high``, this not included;
    values outside are left out, and empty bins have 0."""
    x = F.col(value).cast("double")
    found = rows.where((x >= low) & (x < high)).groupBy(F.least(F.floor((x - low) / (high - low) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def code_counts(rows: DataFrame, code: str = "code") -> DataFrame:
    """``(code, n)`` of codes of any kind."""
    return rows.groupBy(code).agg(F.count(F.lit(1)).alias("n"))


def matrix_stats(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """A row for each dimension: least, most, mean, stddev, and how many values
    are NaN, infinite or zero."""
    x = F.col("x").cast("double")
    finite = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    return vectors.select(F.posexplode(embedding).alias("dim", "x")).groupBy("dim").agg(
        F.count(F.lit(1)).alias("n"), F.min(finite).alias("least"), F.max(finite).alias("most"), F.avg(finite).alias("mean"), F.stddev_pop(finite).alias("stddev"),
        F.count_if(F.isnan(x)).alias("n_nan"), F.count_if(F.abs(x) == float("inf")).alias("n_inf"), F.count_if(x == 0).alias("n_zero"))


def id_lookup(keys: DataFrame, table: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """``keys`` with their value in ``table``, -1 where there is none."""
    return keys.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(-1)))


def bits_to_signs(words: Column, bits: int) -> Column:
    """Binary codes in 32-bit words as vectors of -1 and 1: a float index over
    them ranks as Hamming distances do."""
    bit = lambda i: F.call_function("shiftright", F.get(words, F.floor(i / 32).cast("int")), (i % 32).cast("int")) % 2
    return F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: (bit(i) * 2 - 1).cast("double"))


def random_vectors(rows: DataFrame, d: int, seed: int = 1234, normal: bool = False, id: str = "id") -> DataFrame:
    """``(id, embedding)`` of numbers in [0, 1), or normal ones, that depend only
    on the seed and the id."""
    unit = lambda *k: F.pmod(F.xxhash64(F.col(id), F.lit(seed), *k), F.lit(1 << 53)) / float(1 << 53)
    dims = F.sequence(F.lit(0), F.lit(d - 1))
    if normal:  # Box and Muller
        x = F.transform(dims, lambda i: F.sqrt(-2 * F.log(1 - unit(i, F.lit(0)))) * F.cos(unit(i, F.lit(1)) * 6.283185307179586))
    else:
        x = F.transform(dims, lambda i: unit(i, F.lit(0)))
    return rows.select(id, x.alias("embedding"))


def smooth_vectors(rows: DataFrame, d: int, latent: int = 10, seed: int = 1234, id: str = "id") -> DataFrame:
    """Vectors on a sine-warped surface of fewer dimensions."""
    mix = lambda i, j: F.pmod(F.xxhash64(F.lit(seed), i, j), F.lit(1 << 20)) / float(1 << 20)
    low = random_vectors(rows, latent, seed, True, id).withColumnRenamed("embedding", "low")
    dot = lambda i: F.aggregate(F.transform("low", lambda x, j: x * mix(i, j)), F.lit(0.0), lambda a, x: a + x)
    return low.select(id, F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.sin(dot(i) * (4 * mix(i, F.lit(-1)) + 0.1))).alias("embedding"))


def checksum(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """One number for all vectors, whatever their order."""
    return vectors.agg(F.sum(F.xxhash64(embedding).cast("decimal(38,0)")).alias("checksum"))
