"""Merging of results and of bases: shards, id maps, duplicates, diversity."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.knn import assign, knn_by_group, top


def union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def merge_results(results: Sequence[DataFrame], k: int, larger: bool = False) -> DataFrame:
    """The best k over several results, as over one base."""
    return top(union([r.select("qid", "id", "dist") for r in results]), k, larger)


def successive_ids(shards: Sequence[DataFrame], id: str = "id") -> DataFrame:
    """Shards as one base: each one's ids shifted by the rows before it."""
    out, before = [], 0
    for s in shards:
        out.append(s.withColumn(id, F.col(id) + before))
        before += s.count()
    return union(out)


def combined(range_hits: DataFrame, knn_hits: DataFrame, radius: float, k: int) -> DataFrame:
    """A range result out of a k-NN result where that sufficed, that is, found
    fewer than k within the radius, and out of range hits for the rest."""
    inside = knn_hits.where(F.col("dist") < radius)
    full = inside.groupBy("qid").count().where(F.col("count") >= k).select("qid")
    return inside.join(full, "qid", "left_anti").select("qid", "id", "dist").unionByName(range_hits.join(full, "qid", "left_semi").select("qid", "id", "dist"))


def external_ids(result: DataFrame, id_map: DataFrame) -> DataFrame:
    """Ids of a result by a map (id, external)."""
    return result.join(id_map, "id").select("qid", "rank", F.col("external").alias("id"), "dist")


def duplicate_groups(base: DataFrame, id: str = "id", embedding: str = "embedding") -> DataFrame:
    """(representative, id) of equal vectors; the smallest id represents."""
    groups = base.groupBy(F.md5(F.to_json(embedding)).alias("_key")).agg(F.min(id).alias("representative"))
    return base.select(id, F.md5(F.to_json(embedding)).alias("_key")).join(groups, "_key").select("representative", id)


def expand_duplicates(result: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """A result over representatives with their duplicates back in it."""
    g = groups.toDF("representative", "copy")
    return top(result.join(g, result["id"] == g["representative"]).select("qid", F.col("copy").alias("id"), "dist"), k)


def first_of_each(rows: DataFrame, code: str, id: str = "id") -> DataFrame:
    """Adds ``inserted``: whether the row is the first, by id, with its code."""
    firsts = rows.groupBy(code).agg(F.min(id).alias("_first"))
    return rows.join(firsts, code).withColumn("inserted", F.col(id) == F.col("_first")).drop("_first")


def diverse(queries: DataFrame, base: DataFrame, k: int, per_group: int, name: str = "l2", exclude_self: bool = False) -> DataFrame:
    """The k nearest rows with at most ``per_group`` of each group; the base is
    (id, embedding, group)."""
    return top(knn_by_group(queries, base, per_group, name, exclude_self).select("qid", "id", "dist"), k)


def best_documents(queries: DataFrame, base: DataFrame, k: int, name: str = "l2", exclude_self: bool = False) -> DataFrame:
    """The k best documents by their nearest vector; the base is (id, embedding,
    document)."""
    best = knn_by_group(queries, base, 1, name, exclude_self)
    return top(best.select("qid", F.col("group").alias("id"), "dist"), k)


def split_search(queries: DataFrame, parts: Sequence[tuple[DataFrame, int, int]]) -> DataFrame:
    """1-NN where each part indexes dimensions start to stop of the vectors: the
    distance is the parts' sum, and the id combines theirs, the first part's
    lowest. ``parts`` are (base, start, stop); ids of a part are 0 to its count.
    A query that a part has no row for gets id -1 and a NaN distance."""
    out, factor = queries.select("qid", F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("dist")), 1
    for base, start, stop in parts:
        mine = assign(queries.select("qid", F.slice("qv", start + 1, stop - start).alias("qv")), base).toDF("qid", "part_id", "part_dist")
        out = out.join(mine, "qid", "left").select("qid", (F.col("id") + F.col("part_id") * factor).alias("id"), (F.col("dist") + F.col("part_dist")).alias("dist"))
        factor *= base.count()
    return out.select("qid", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("dist", F.lit(float("nan"))).alias("dist"))


def random_results(queries: DataFrame, n: int, k: int, seed: int = 1234) -> DataFrame:
    """Hits that don't look at the vectors: a floor for evaluations."""
    rows = queries.select("qid", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    pick = F.xxhash64("qid", "rank", F.lit(seed))
    return rows.select("qid", "rank", F.pmod(pick, F.lit(n)).alias("id"), (F.pmod(pick, F.lit(1 << 20)) / (1 << 20)).alias("dist"))
