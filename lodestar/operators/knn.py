"""Exact nearest-neighbour and range searches.

Queries are ``(qid, qv)``, the base is ``(id, embedding)``; a result is
``(qid, rank, id, dist)`` with rank 1 first, ties by id, NaN last. A filter on
the base before the search is the selector of a filtered search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.metrics import Metric, hamming, metric
from lodestar.operators.blocks import tiles
from lodestar.sources.shared import materialize

HITS = "qid long, id long, dist double"
#: Queries of a block whose distances are held at once.
TOGETHER = 64


def _order(larger: bool):
    d = F.col("dist")
    return F.isnan(d), d.desc() if larger else d.asc(), F.col("id").asc_nulls_last()


def top(hits: DataFrame, k: int, larger: bool = False, by: str = "qid") -> DataFrame:
    """The best k hits of each query with their ranks."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*_order(larger)))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select(by, "rank", "id", "dist")


def knn(queries: DataFrame, base: DataFrame, k: int, name: str | Metric = "l2", p: float | None = None, exclude_self: bool = False) -> DataFrame:
    """The k nearest rows of the base, with ``exclude_self`` other than the
    query's own id. Queries with fewer rows than k to find get them all."""
    m = metric(name)

    def some(qids, q, ids, b):
        """A few queries at a time, so that their distances stay in cache."""
        import numpy as np

        d = m.tile(q, b, p)
        key = -d if m.larger_is_better else d
        if (lost := np.isnan(key)).any():
            key = np.where(lost, np.inf, key)
        if exclude_self:
            own = ids[None, :] == qids[:, None]
            if own.any():
                key = np.where(own, np.inf, key)
        n = min(k + exclude_self, len(ids))
        if n < len(ids):
            # all that tie with the n-th, of which the last word is the ranking's
            limit = np.partition(key, n - 1, axis=1)[:, n - 1 : n]
            r, c = np.nonzero(key <= limit)
            if len(r) > 2 * n * len(key):
                c = np.lexsort((np.broadcast_to(ids, key.shape), key))[:, :n].ravel()
                r = np.repeat(np.arange(len(key)), n)
        else:
            r, c = np.indices(key.shape).reshape(2, -1)
        if exclude_self:
            keep = ids[c] != qids[r]
            r, c = r[keep], c[keep]
        return qids[r], ids[c], d[r, c]

    def kernel(qids, q, ids, b):
        import numpy as np

        parts = [some(qids[i : i + TOGETHER], q[i : i + TOGETHER], ids, b) for i in range(0, len(qids), TOGETHER)]
        return dict(zip(("qid", "id", "dist"), map(np.concatenate, zip(*parts))))

    return top(tiles(queries, base, kernel, HITS), k, m.larger_is_better)


def knn_by_group(queries: DataFrame, base: DataFrame, per_group: int, name: str | Metric = "l2", exclude_self: bool = False) -> DataFrame:
    """``(qid, id, group, dist)``: the nearest ``per_group`` rows of each group,
    for a base ``(id, embedding, group)``; rows with a null group are a group of
    their own. A tile returns no more than that of a group, so hits are never all
    pairs."""
    m = metric(name)
    b = base.toDF("id", "v", "group")
    # groups are numbered by ranges of their values, a null one first
    groups = materialize(b.select("group").distinct().repartitionByRange("group").withColumn("part", F.spark_partition_id()), "groups")
    sizes = groups.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("group"))
    codes = groups.withColumn("nth", nth).join(F.broadcast(sizes.select("part", before.alias("before"))), "part")
    codes = materialize(codes.select("group", (F.col("before") + F.col("nth")).alias("code")), "codes")
    coded = b.join(codes.withColumnRenamed("group", "known"), F.col("group").eqNullSafe(F.col("known")))
    # the code travels as one more component, which doubles carry exactly
    b = coded.select("id", F.concat(F.col("v").cast("array<double>"), F.array(F.col("code").cast("double"))))
    q = queries.toDF("qid", "qv").select("qid", F.concat(F.col("qv").cast("array<double>"), F.array(F.lit(0.0))))

    def kernel(qids, q, ids, v):
        import numpy as np

        codes, d = v[:, -1].astype(np.int64), m.tile(q[:, :-1], v[:, :-1], None)
        key, out = np.where(np.isnan(d), np.inf, -d if m.larger_is_better else d), []
        for r, qid in enumerate(qids):
            order = np.lexsort((ids, key[r], codes))
            if exclude_self:
                order = order[ids[order] != qid]
            g = codes[order]
            order = order[np.arange(len(g)) - np.searchsorted(g, g) < per_group]
            out.append((np.full(len(order), qid), ids[order], codes[order], d[r, order]))
        return dict(zip(("qid", "id", "code", "dist"), map(np.concatenate, zip(*out))))

    found = tiles(q, b, kernel, "qid long, id long, code long, dist double")
    nth = F.row_number().over(Window.partitionBy("qid", "code").orderBy(*_order(m.larger_is_better)))
    return found.withColumn("nth", nth).where(F.col("nth") <= per_group).join(codes, "code").select("qid", "id", "group", "dist")


def range_search(queries: DataFrame, base: DataFrame, radius: float, name: str | Metric = "l2", p: float | None = None, exclude_self: bool = False) -> DataFrame:
    """All hits strictly within the radius (beyond it for similarities)."""
    m = metric(name)

    def kernel(qids, q, ids, b):
        import numpy as np

        d = m.tile(q, b, p)
        r, c = np.nonzero(d > radius if m.larger_is_better else d < radius)
        if exclude_self:
            keep = ids[c] != qids[r]
            r, c = r[keep], c[keep]
        return {"qid": qids[r], "id": ids[c], "dist": d[r, c]}

    return tiles(queries, base, kernel, HITS)


def within_budget(hits: DataFrame, most: int, larger: bool = False) -> tuple[DataFrame, float | None]:
    """A range result shrunk to a radius at which no more than ``most`` hits are
    left, and that radius (None: nothing had to go)."""
    order = F.col("dist").desc() if larger else F.col("dist").asc()
    first = hits.select("dist").orderBy(order).limit(most + 1)
    last = first.agg(F.count(F.lit(1)), F.min("dist") if larger else F.max("dist")).first()
    if last[0] <= most:
        return hits, None
    return at_radius(hits, last[1], larger), last[1]


def at_radius(hits: DataFrame, radius: float, larger: bool = False) -> DataFrame:
    """A range result at a smaller radius."""
    return hits.where(F.col("dist") > radius if larger else F.col("dist") < radius)


def distances_by_id(queries: DataFrame, base: DataFrame, lists: DataFrame, name: str = "l2", p: float | None = None) -> DataFrame:
    """Distances to the ids listed for each query; ``lists`` is (qid, ids). An id
    that the base lacks has a null distance, -1 included."""
    m = metric(name)
    pairs = lists.select("qid", F.posexplode("ids").alias("pos", "id"))
    q, b = queries.toDF("qid", "qv"), base.toDF("id", "v")
    out = pairs.join(b, "id", "left").join(q, "qid")
    return out.select("qid", "pos", "id", F.when(F.col("v").isNotNull(), m.column(F.col("qv"), F.col("v"), p)).alias("dist"))


def knn_by_id(queries: DataFrame, base: DataFrame, lists: DataFrame, k: int, name: str = "l2", p: float | None = None) -> DataFrame:
    """The k nearest among the ids listed for each query."""
    hits = distances_by_id(queries, base, lists, name, p).where("dist is not null").select("qid", "id", "dist").dropDuplicates(["qid", "id"])
    return top(hits, k, metric(name).larger_is_better)


def pair_distances(pairs: DataFrame, left: DataFrame, right: DataFrame, name: str = "l2", p: float | None = None) -> DataFrame:
    """One distance for each row of ``pairs`` (ix, iy)."""
    x, y = left.toDF("ix", "x"), right.toDF("iy", "y")
    return pairs.join(x, "ix").join(y, "iy").select("ix", "iy", metric(name).column(F.col("x"), F.col("y"), p).alias("dist"))


def assign(queries: DataFrame, base: DataFrame, name: str = "l2") -> DataFrame:
    """The nearest row of the base for each query."""
    m = metric(name)
    key = F.struct(F.isnan("dist"), -F.col("dist") if m.larger_is_better else F.col("dist"), "id")

    def kernel(qids, q, ids, b):
        import numpy as np

        order = np.argsort(ids, kind="stable")
        d = m.tile(q, b, None)[:, order]
        c = np.argmin(np.where(np.isnan(d), np.inf, -d if m.larger_is_better else d), axis=1)
        return {"qid": qids, "id": ids[order][c], "dist": d[np.arange(len(qids)), c]}

    hits = tiles(queries, base, kernel, HITS)
    return hits.groupBy("qid").agg(F.min_by(F.struct("id", "dist"), key).alias("best")).select("qid", "best.id", "best.dist")


def reconstructed(result: DataFrame, base: DataFrame) -> DataFrame:
    """A result with the vectors of its hits."""
    return result.join(base.toDF("id", "embedding"), "id")


def padded(result: DataFrame, queries: DataFrame, k: int, larger: bool = False) -> DataFrame:
    """k rows for each query: where hits are missing, id -1 and an infinite
    distance."""
    slots = queries.select("qid").withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(k))))
    worst = F.lit(float("-inf") if larger else float("inf"))
    return slots.join(result, ["qid", "rank"], "left").select("qid", "rank", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("dist", worst).alias("dist"))


def _hamming_tile(qids, q, ids, b):
    """Words hold 32 bits each, which doubles carry exactly."""
    import numpy as np

    d = np.zeros((len(q), len(b)), np.int64)
    for w in range(q.shape[1]):
        d += np.bitwise_count(q[:, w].astype(np.uint64)[:, None] ^ b[:, w].astype(np.uint64)[None, :])
    return d


HAMMING = Metric("hamming", lambda x, y, p=None: hamming(x, y), lambda x, y, p=None: _hamming_tile(None, x, None, y).astype(float))


def hamming_knn(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """Nearest codes by differing bits; codes are arrays of 32-bit words."""
    return knn(queries, base, k, HAMMING)


def hamming_range(queries: DataFrame, base: DataFrame, radius: int) -> DataFrame:
    return range_search(queries, base, radius, HAMMING)


def hamming_counts(queries: DataFrame, base: DataFrame, threshold: int) -> DataFrame:
    """How many codes are within the threshold of each query, it included."""
    return range_search(queries, base, threshold + 1, HAMMING).groupBy("qid").agg(F.count(F.lit(1)).alias("n"))


def hamming_matches(queries: DataFrame, base: DataFrame, threshold: int) -> DataFrame:
    """``(qid, id, dist)`` of the codes within the threshold, it included."""
    return hamming_range(queries, base, threshold + 1)


def handled(queries: DataFrame, base: DataFrame, handler: Callable, schema: str, name: str = "l2", p: float | None = None) -> DataFrame:
    """A search whose results are whatever ``handler(query ids, ids, distances)``
    makes of each tile, a dict of the columns of ``schema``: what it needs from
    several tiles has to be put together afterwards."""
    m = metric(name)
    return tiles(queries, base, lambda qids, q, ids, b: handler(qids, ids, m.tile(q, b, p)), schema)


def distance_rows(queries: DataFrame, base: DataFrame, name: str = "l2", p: float | None = None) -> DataFrame:
    """The matrix of all distances, a row for each query: ``(qid, distances)`` in
    the order of the base's ids. For bases whose distances fit in a row."""
    def kernel(qids, ids, d):
        import numpy as np

        return {"qid": np.repeat(qids, len(ids)), "id": np.tile(ids, len(qids)), "dist": d.ravel()}

    found = handled(queries, base, kernel, HITS, name, p)
    return found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("id", "dist"))).alias("x")).select("qid", F.col("x.dist").alias("distances"))


def nearest_on_line(queries: DataFrame, base: DataFrame) -> DataFrame:
    """The nearest scalar for each query scalar, by one sort: queries
    ``(qid, x)``, base ``(id, x)``. Ties go to the smaller value, then id.

    The values are range-partitioned; what a partition lacks to either side is
    carried over from the closest partition that has it."""
    both = queries.select(F.lit(None).cast("long").alias("id"), F.col("qid"), "x").unionByName(base.select("id", F.lit(None).cast("long").alias("qid"), "x"))
    parts = materialize(both.repartitionByRange("x").withColumn("part", F.spark_partition_id()), "parts")  # bounds are sampled: once
    point = F.when(F.col("id").isNotNull(), F.struct("x", "id"))
    edges = parts.groupBy("part").agg(F.max(F.when(F.col("id").isNotNull(), F.struct(F.col("x"), -F.col("id")))).alias("high"), F.min(point).alias("low"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select("part", F.last("high", True).over(before).alias("carried_high"), F.last("low", True).over(after).alias("carried_low"))
    up = Window.partitionBy("part").orderBy("x", F.col("id").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("part").orderBy(F.col("x").desc(), F.col("id").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    near = parts.withColumn("below", F.last(point, True).over(up)).withColumn("above", F.last(point, True).over(down)).where("qid is not null").join(edges, "part", "left")
    below = F.coalesce("below", F.struct(F.col("carried_high.x").alias("x"), (-F.col("carried_high.col2")).alias("id")))
    near = near.withColumn("below", below).withColumn("above", F.coalesce("above", "carried_low"))
    pick = F.array_min(F.array(
        F.when(F.col("below.x").isNotNull(), F.struct(F.abs(F.col("x") - F.col("below.x")).alias("dist"), F.col("below.x").alias("y"), F.col("below.id").alias("id"))),
        F.when(F.col("above.x").isNotNull(), F.struct(F.abs(F.col("x") - F.col("above.x")).alias("dist"), F.col("above.x").alias("y"), F.col("above.id").alias("id")))))
    return near.withColumn("p", pick).select("qid", "p.id", "p.dist")
