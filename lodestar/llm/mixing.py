"""Mixing sources to target weights at exact budgets.

Each row gets a hash-random key. Rows are range-sorted by it within their source;
sums over key ranges, then within each range, give every row the number of
tokens before it, and each source is cut at its exact budget. A budget beyond a
source's size repeats whole epochs first.

Rows: a null text has no tokens and is taken 0 times. A null source is a source
of its own, the last. Rows of one doc_id share a random key and are ordered by
the rest of the row; rows alike in all columns are interchangeable. A text of
any length is one number, its size. An empty table gives an empty result."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.shared import free_name, materialize

#: A token of the budgets: a run of other than ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"
#: Key ranges of a source aim at so many rows, in at most so many ranges.
RANGE_ROWS, RANGES = 64, 4096


@dataclass(frozen=True)
class Mix:
    """``weights`` repeat over the sources by code point, null last. All sources
    together get ``share`` of all tokens, none more than ``most`` times its own."""

    weights: tuple[float, ...] = (3, 1, 2)
    share: float = 1.5
    most: float = 2
    seed: int = 7


def count_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def first_tokens(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th token, n at least 1."""
    gaps = F.split(text, TOKEN, -1)  # what stands before, between and after the tokens
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), 0)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), n.cast("int")), F.slice(tokens, F.lit(1), n.cast("int")), lambda gap, token: F.concat(gap, token))
    return F.array_join(pairs, "")


def targets(rows: DataFrame, mix: Mix) -> DataFrame:
    """A row for each source: ``source, at, source_size, source_rows, target``.

    What a source can't take goes to the others by weight until none is above
    its cap. That ends at min(cap, level x weight) with one level for all, which
    is found along the sources by cap / weight."""
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in mix.weights)), F.pmod("at", F.lit(len(mix.weights))) + 1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "at").rowsBetween(Window.unboundedPreceding, -1)
    return (
        by_source.withColumn("at", at).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(mix.most)))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(mix.share)))
        .withColumn("caps", F.coalesce(F.sum("cap").over(filled), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("caps")) / F.col("left"))
        # the first source by cap / weight whose cap isn't reached at its level
        .withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "at", "level"))).over(everything)["level"])
        .withColumn("target", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")))
        .select("source", "at", "source_size", "source_rows", "target")
    )


def taken(rows: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``rows`` has doc_id, source, size and ``tie``, a hash of the whole row.
    Adds ``source_size``, ``target`` and ``taken``, the tokens that the mix takes
    of the row: its whole size for each whole epoch, and in the last epoch what
    is left of the budget where the row begins. ``taken`` adds up to the whole
    part of each target."""
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(str(mix.seed))))
    rows = materialize(rows.select("doc_id", "source", "size", "tie", key.alias("key")), "rows")
    plan = materialize(targets(rows, mix), "targets")
    s = plan.withColumnRenamed("source", "of_source")
    ranges = F.greatest(F.lit(1), F.least(F.lit(RANGES), F.ceil(F.col("source_rows") / RANGE_ROWS)))
    high = F.conv(F.substring("key", 1, 7), 16, 10).cast("long")
    rows = rows.join(s, rows["source"].eqNullSafe(s["of_source"])).withColumn("range", F.floor(high * ranges / F.lit(16.0**7)).cast("int"))
    sums = rows.groupBy("at", "range").agg(F.sum("size").alias("in_range"))
    before = Window.partitionBy("at").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("at", "range", F.coalesce(F.sum("in_range").over(before), F.lit(0)).alias("before_range"))
    within = Window.partitionBy("at", "range").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.repartitionByRange("at", "range").withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before_range") - F.col("within")))
    return rows.join(sums, ["at", "range"]).select("doc_id", "source", "size", "tie", "source_size", "target", (epochs * F.col("size") + cut).cast("long").alias("taken"))


def row_hash(docs: DataFrame) -> Column:
    """128 bits of the whole row."""
    return F.struct(F.xxhash64(*docs.columns).alias("a"), F.xxhash64(F.lit("second"), *docs.columns).alias("b"))


def mix_sources(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """For each row of ``docs``: doc_id, source, size, source_size, target, taken."""
    rows = docs.select("doc_id", "source", count_tokens(F.col("text")).alias("size"), row_hash(docs).alias("tie"))
    return taken(rows, mix).drop("tie")


def mixed(docs: DataFrame, mix: Mix = Mix(), n_chars: str | None = None) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as the mix takes them, and the
    row at a source's cut up to its last token that fits. Rows that the mix
    doesn't take are absent."""
    a, b, sizes, one, part = (free_name(docs, f"_{n}") for n in ("a", "b", "sizes", "one", "part"))
    rows = docs.select("doc_id", "source", count_tokens(F.col("text")).alias("size"), row_hash(docs).alias("tie"))
    parts = taken(rows, mix).where("taken > 0").groupBy(F.col("tie.a").alias(a), F.col("tie.b").alias(b)).agg(F.collect_list(F.struct("size", "taken")).alias(sizes))
    whole = F.flatten(F.transform(F.col(sizes), lambda x: F.concat(
        F.array_repeat(F.lit(None).cast("long"), F.floor(x["taken"] / x["size"]).cast("int")),
        F.when(x["taken"] % x["size"] > 0, F.array(x["taken"] % x["size"])).otherwise(F.array().cast("array<long>")),
    )))
    # rows alike in all columns meet here: one of them stands for all, as parts has what the mix takes of each
    alike = Window.partitionBy(a, b).orderBy(F.lit(1))
    h = row_hash(docs)
    out = docs.withColumns({a: h["a"], b: h["b"]}).join(parts, [a, b])
    out = out.withColumn(one, F.row_number().over(alike)).where(F.col(one) == 1).withColumn(part, F.explode(whole))
    out = out.withColumn("text", F.when(F.col(part).isNull(), F.col("text")).otherwise(first_tokens(F.col("text"), F.col(part))))
    if n_chars:
        out = out.withColumn(n_chars, F.when(F.col(part).isNull(), F.col(n_chars)).otherwise(F.char_length("text").cast("long")))
    return out.select(*docs.columns)
