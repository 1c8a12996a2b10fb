"""k-means over sparse rows ``(id, indices, values)``.

Entries of rows and of centroids are packed in blocks, without zeros. Each block of
rows meets each block of centroids; inner products of their rows are sums over the
dimensions that both have, made where the blocks meet, so pairs of rows and lists are
never rows of a table: a row leaves a block of centroids with the nearest of it.
Lists that share no dimension with a row have inner product 0.

Centroids stay a table, and nothing of them goes to the driver. Rows without entries
belong to the centroid of least length; a list that gets no rows keeps its centroid.
Null rows are left out; entries of one row and dimension are added up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.blocks import BROADCAST_BYTES, GROUP_BLOCKS
from lodestar.sources.shared import materialize

#: Rows and lists of a block.
ROWS, LISTS = 1024, 1024


def entries(rows: DataFrame) -> DataFrame:
    """``(id, dim, x)`` for each entry that isn't 0."""
    each = rows.where("id is not null").select("id", F.explode(F.arrays_zip(F.col("indices").alias("dim"), F.col("values").cast("array<double>").alias("x"))).alias("e"))
    return each.select("id", F.col("e.dim").alias("dim"), F.col("e.x").alias("x")).where("x <> 0").groupBy("id", "dim").agg(F.sum("x").alias("x"))


def _blocks(rows: DataFrame, n: int, name: str) -> DataFrame:
    """Rows ``(key, dims, xs)`` in about ``n`` blocks: their keys, how many entries
    each has, and the entries."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n)).cast("int"))
    packed = rows.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("key", "dims", "xs"))).alias("r"))
    return packed.select(F.col("block").alias(name), F.col("r.key").alias(f"{name}_keys"), F.transform("r", lambda x: F.size(x["dims"])).alias(f"{name}_sizes"), F.flatten("r.dims").alias(f"{name}_dims"), F.flatten("r.xs").alias(f"{name}_xs"))


def _by_dimension(dims, owners, xs):
    """``{dimension: (owners, values)}``."""
    import numpy as np

    order = np.argsort(dims, kind="stable")
    dims, owners, xs = dims[order], owners[order], xs[order]
    each, first = np.unique(dims, return_index=True)
    return {int(d): (owners[i:j], xs[i:j]) for d, i, j in zip(each, first, [*first[1:], len(dims)])}


def assign(cells: DataFrame, ids: DataFrame, centroids: DataFrame, n: int) -> DataFrame:
    """``(id, list_no, dist)``: the nearest of ``n`` centroids ``(list_no, dim, c)``
    by squared L2, of equal ones (to 12 digits) the first. ``cells`` are the rows'
    entries, ``ids`` has a row for each of them."""
    spark = cells.sparkSession
    of = lambda t, key, x: t.groupBy(F.col(key).cast("long").alias("key")).agg(F.collect_list(F.struct("dim", x)).alias("e")).select("key", F.col("e.dim").cast("array<long>").alias("dims"), F.col(f"e.{x}").cast("array<double>").alias("xs"))
    none = [F.array().cast("array<long>").alias("dims"), F.array().cast("array<double>").alias("xs")]
    with_all = lambda keys, t: keys.join(t, "key", "left").select("key", *(F.coalesce(c, e).alias(c) for c, e in zip(("dims", "xs"), none)))
    rows = with_all(ids.select(F.col("id").cast("long").alias("key")).distinct(), of(cells, "id", "x"))
    lists = with_all(spark.range(n).select(F.col("id").alias("key")), of(centroids.where("c <> 0"), "list_no", "c"))
    many, groups = max(1, -(-ids.count() // ROWS)), max(1, -(-n // LISTS))
    # a task has few blocks of rows, and all lists while they are small
    b, c = _blocks(rows, many, "b").repartition(many, "b"), _blocks(lists, groups, "c")
    b = b.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    if centroids.count() * 16 + n * 16 <= BROADCAST_BYTES:
        work = b.join(F.broadcast(c), "c")
    else:  # each block of lists meets chunks of the rows, each under a key of its own
        chunks = max(1, many // GROUP_BLOCKS)
        c = c.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        work = b.withColumn("chunk", F.pmod("b", F.lit(chunks))).join(c, ["c", "chunk"])
    work = work.select("b_keys", "b_sizes", "b_dims", "b_xs", "c_keys", "c_sizes", "c_dims", "c_xs")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for r in range(batch.num_rows):
                ids, sizes, dims, xs, lists, c_sizes, c_dims, cs = (batch.column(i)[r].values.to_numpy(zero_copy_only=False) for i in range(8))
                at, c_at = np.repeat(np.arange(len(ids)), sizes), np.repeat(np.arange(len(lists)), c_sizes)
                dot, theirs = np.zeros((len(ids), len(lists))), _by_dimension(c_dims, c_at, cs)
                for d, (i, x) in _by_dimension(dims, at, xs).items():
                    if d in theirs:
                        j, c = theirs[d]
                        dot[np.ix_(i, j)] += x[:, None] * c
                length, own = np.bincount(c_at, cs * cs, len(lists)), np.bincount(at, xs * xs, len(ids))
                dist = length - 2 * dot + own[:, None]
                best = np.argmin(np.where(np.isnan(dist), np.inf, np.round(dist, 12)), axis=1)  # lists are in order
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(lists[best].astype(np.int32)), pa.array(dist[np.arange(len(ids)), best])], names=["id", "list_no", "dist"])

    near = work.mapInArrow(run, "id long, list_no int, dist double")
    return near.groupBy("id").agg(F.min_by(F.struct("list_no", "dist"), F.struct(F.round("dist", 12), "list_no")).alias("best")).select("id", "best.list_no", "best.dist")


def moved(cells: DataFrame, assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """The means of the rows assigned to each list, as ``(list_no, dim, c)``."""
    sizes = assigned.groupBy("list_no").agg(F.count(F.lit(1)).alias("n"))
    total = cells.join(assigned.select("id", "list_no"), "id").groupBy("list_no", "dim").agg(F.sum("x").alias("x"))
    new = total.join(sizes, "list_no").select("list_no", "dim", (F.col("x") / F.col("n")).alias("c"))
    return new.unionByName(centroids.join(sizes.select("list_no"), "list_no", "left_anti").select("list_no", "dim", "c"))


def kmeans(rows: DataFrame, centroids: DataFrame, n: int, iterations: int = 10) -> tuple[DataFrame, DataFrame]:
    """Centroids and assignments after ``iterations`` from the given centroids:
    ``(list_no, dim, c)`` and ``(id, list_no, dist)`` by the centroids returned."""
    cells = materialize(entries(rows), "cells")
    ids = rows.select("id").where("id is not null")
    for _ in range(iterations):
        found = materialize(assign(cells, ids, centroids, n), "assigned")
        centroids = materialize(moved(cells, found, centroids), "centroids")
    return centroids, assign(cells, ids, centroids, n)
