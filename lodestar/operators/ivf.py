"""Inverted lists: a base partitioned by its nearest centroid. A search takes
each query's nearest lists; the rows of a list and the queries that probe it are
packed into blocks, and each pair of blocks of a list is one tile, reduced to its
best hits where it is computed. Written lists are partitioned by list, so that
scans prune."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from lodestar.functions.metrics import metric
from lodestar.operators.blocks import BASE_ROWS, BROADCAST_BYTES, QUERY_ROWS, tiles
from lodestar.operators.codecs import RowCodec, best_of_tile
from lodestar.operators.knn import HITS, knn, top
from lodestar.sources.shared import materialize

#: Distances between rows and centroids that are held at once.
CELLS = 1 << 22


def centroid_matrix(centroids: DataFrame):
    """The list numbers and the centroids, as a matrix."""
    import numpy as np

    t = centroids.select("list_no", F.col("centroid").cast("array<double>")).toArrow().combine_chunks()
    c = t.column(1).combine_chunks()
    m = c.flatten().to_numpy().reshape(len(t), -1) if len(t) else np.zeros((0, 1))
    order = np.argsort(t.column(0).to_numpy(), kind="stable")
    return t.column(0).to_numpy()[order].astype(np.int32), m[order]


def nearest_rows(v, c, name: str):
    """For each row of ``v`` the number of its nearest row of ``c``, and how far
    that is; a bounded number of distances at a time."""
    import numpy as np

    m, step = metric(name), max(1, CELLS // max(1, len(c)))
    near, far = [np.zeros(0, np.int64)], [np.zeros(0)]
    for at in range(0, len(v), step):
        d = m.tile(v[at : at + step], c)
        near.append(np.argmin(np.where(np.isnan(d), np.inf, -d if m.larger_is_better else d), axis=1))
        far.append(d[np.arange(len(d)), near[-1]])
    return np.concatenate(near), np.concatenate(far)


def matrix_of(column):
    """An Arrow column of lists of numbers as a matrix of doubles."""
    import numpy as np

    return np.stack([x.values.to_numpy(zero_copy_only=False) for x in column]).astype(float)


def assign_lists(base: DataFrame, centroids: DataFrame, name: str = "l2") -> DataFrame:
    """``(id, embedding, list_no)``: every row in its nearest list. Centroids go
    to the rows while they are below ``BROADCAST_BYTES``; beyond it they meet the
    rows in tiles, and the nearest of each block's nearest is joined back."""
    b = base.toDF("id", "embedding").where("embedding is not null")
    size = centroids.agg(F.coalesce(F.sum(F.size("centroid") * 8), F.lit(0))).first()[0]
    if size > BROADCAST_BYTES:
        return _assigned_by_tiles(b, centroids, name)
    shared = b.sparkSession.sparkContext.broadcast(centroid_matrix(centroids))
    schema = b.select("*", F.lit(0).alias("list_no")).schema

    def run(batches):
        import pyarrow as pa

        numbers, c = shared.value
        for batch in batches:
            if batch.num_rows:
                near = numbers[nearest_rows(matrix_of(batch.column(1)), c, name)[0]]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near)], names=["id", "embedding", "list_no"])

    return b.mapInArrow(run, schema)


def _assigned_by_tiles(b: DataFrame, centroids: DataFrame, name: str) -> DataFrame:
    m = metric(name)

    def kernel(numbers, c, ids, v):
        import numpy as np

        order = np.argsort(numbers, kind="stable")
        near, d = nearest_rows(v, c[order], name)
        return {"id": ids, "list_no": numbers[order][near], "dist": -d if m.larger_is_better else d}

    near = tiles(centroids.select(F.col("list_no").cast("long").alias("id"), F.col("centroid").alias("v")), b, kernel, "id long, list_no long, dist double")
    best = near.groupBy("id").agg(F.min(F.struct(F.isnan("dist"), "dist", "list_no")).alias("b")).select("id", F.col("b.list_no").cast("int").alias("list_no"))
    return b.join(best, "id").select("id", "embedding", "list_no")


def save_lists(lists: DataFrame, path: str) -> None:
    """One folder for each list, with one file or more; rows of a large list are
    spread over tasks by their ids."""
    lists.repartition("list_no", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("list_no").parquet(path)


def probes(queries: DataFrame, centroids: DataFrame, nprobe: int, name: str = "l2") -> DataFrame:
    """``(qid, list_no, probe, coarse)``: each query's nearest lists."""
    c = centroids.select(F.col("list_no").cast("long").alias("id"), F.col("centroid").alias("embedding"))
    found = knn(queries, c, nprobe, name)
    return found.select("qid", F.col("id").cast("int").alias("list_no"), F.col("rank").alias("probe"), F.col("dist").alias("coarse"))


def scan(queries: DataFrame, chosen: DataFrame, lists: DataFrame, name: str = "l2", p: float | None = None, distance: Column | None = None) -> DataFrame:
    """Distances of each query to all rows of the lists chosen for it, as rows:
    for distances that only columns can say. ``distance`` may use qv, embedding
    and all columns of both sides in place of the metric. Searches by a metric
    take ``list_tiles``."""
    q = queries.toDF("qid", "qv").join(chosen, "qid")
    d = distance if distance is not None else metric(name).column(F.col("qv"), F.col("embedding"), p)
    return q.join(lists, "list_no").select("qid", "id", d.alias("dist"), "list_no")


def in_blocks(rows: DataFrame, most: int, row_key: str) -> DataFrame:
    """``rows`` with a number ``block`` within their list, so that a block has
    about ``most`` rows: a list of any size is dealt over as many blocks as it
    needs."""
    n = rows.groupBy("list_no").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_n"))
    return rows.join(n, "list_no").withColumn("block", F.pmod(F.xxhash64(row_key), F.col("_n")).cast("int")).drop("_n")


def list_blocks(lists: DataFrame, value: str = "embedding", most: int = BASE_ROWS) -> DataFrame:
    """``(list_no, block, ids, data)`` of ``lists``, whose ``value`` are vectors or
    the bytes of codes."""
    kind = dict(lists.dtypes)[value]
    v = F.col(value) if kind == "binary" else F.col(value).cast("array<double>")
    rows = in_blocks(lists.select("id", "list_no", v.alias("v")).where("v is not null"), most, "id")
    return rows.groupBy("list_no", "block").agg(F.collect_list(F.struct("id", "v")).alias("x")).select("list_no", "block", F.col("x.id").alias("ids"), F.col("x.v").alias("data"))


def list_tiles(queries: DataFrame, chosen: DataFrame, blocks: DataFrame, kernel: Callable, schema: str, codec: RowCodec | None = None, width: int = 0) -> DataFrame:
    """``kernel(query ids, query matrix, ids, matrix, list number)`` for each block
    of the lists chosen for the queries with each block of their queries, which go
    to the blocks where they are below ``BROADCAST_BYTES``. The matrix has the
    vectors, or with a ``codec`` the codes, ``width`` elements each."""
    q = queries.toDF("qid", "qv").select("qid", F.col("qv").cast("array<double>").alias("qv")).join(chosen.select("qid", "list_no"), "qid")
    q = in_blocks(q, QUERY_ROWS, "qid").groupBy("list_no", F.col("block").alias("q_block")).agg(F.collect_list(F.struct("qid", "qv")).alias("q"))
    q = materialize(q, "probes")
    size = q.agg(F.sum(F.size("q") * (F.size(F.col("q")[0]["qv"]) * 8 + 64))).first()[0] or 0
    q = F.broadcast(q) if size <= BROADCAST_BYTES else q  # then the blocks aren't moved
    work = blocks.join(q, "list_no").select(F.col("q.qid").alias("qids"), F.col("q.qv").alias("qv"), "ids", "data", "list_no")
    kind = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for r in range(batch.num_rows):
                qids, qv, ids, data, list_no = (batch.column(i)[r] for i in range(5))
                ids = ids.values.to_numpy(zero_copy_only=False)
                m = matrix_of(data.values) if codec is None else codec.from_bytes(b"".join(data.values.to_pylist()), len(ids), width)
                yield pa.RecordBatch.from_pydict(kernel(qids.values.to_numpy(zero_copy_only=False), matrix_of(qv.values), ids, m, list_no.as_py()), schema=arrow)

    return work.mapInArrow(run, kind)


def search_blocks(queries: DataFrame, chosen: DataFrame, blocks: DataFrame, k: int, name: str = "l2") -> DataFrame:
    """The k nearest rows among the blocks of the chosen lists."""
    m = metric(name)
    return top(list_tiles(queries, chosen, blocks, lambda qids, q, ids, b, list_no: best_of_tile(qids, ids, m.tile(q, b), k, m.larger_is_better), HITS), k, m.larger_is_better)


def search(queries: DataFrame, centroids: DataFrame, lists: DataFrame, k: int, nprobe: int, name: str = "l2") -> DataFrame:
    return search_preassigned(queries, probes(queries, centroids, nprobe, name), lists, k, name)


def probed(lists: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of the lists that some query has chosen: others are neither
    shuffled nor packed, and of lists that lie in folders (``save_lists``) not read."""
    return lists.join(chosen.select("list_no").distinct(), "list_no", "left_semi")


def search_preassigned(queries: DataFrame, chosen: DataFrame, lists: DataFrame, k: int, name: str = "l2") -> DataFrame:
    """The k nearest rows among the lists chosen for each query."""
    return search_blocks(queries, chosen, list_blocks(probed(lists, chosen)), k, name)


def big_batch_search(queries: DataFrame, chosen: DataFrame, lists: DataFrame, k: int, name: str = "l2", batches: int = 4, done: DataFrame | None = None) -> DataFrame:
    """The same list by list in ``batches`` of lists, each written before the
    next begins; ``done`` are the hits ``(qid, id, dist, batch)`` of a run that
    broke off, whose batches aren't computed again."""
    m, of = metric(name), F.pmod(F.xxhash64("list_no"), F.lit(batches)).cast("int")
    blocks = materialize(list_blocks(probed(lists, chosen)), "blocks")
    have = {r.batch for r in done.select("batch").distinct().collect()} if done is not None else set()
    found = [] if done is None else [done.select("qid", "id", "dist", "batch")]
    for i in range(batches):
        if i not in have:
            part = search_blocks(queries, chosen.where(of == i), blocks.where(of == i), k, name)
            found.append(materialize(part.select("qid", "id", "dist", F.lit(i).alias("batch")), f"batch{i}"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return top(out, k, m.larger_is_better)


def limited_probes(chosen: DataFrame, lists: DataFrame, max_codes: int, ensure: int = 0) -> DataFrame:
    """The probes whose lists begin before ``max_codes`` rows have been scanned;
    with ``ensure``, also those before so many rows were seen at all. ``lists``
    has a row for each row of a list, or blocks of them."""
    sizes = lists.groupBy("list_no").agg((F.sum(F.size("ids")) if "ids" in lists.columns else F.count(F.lit(1))).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("qid").orderBy("probe").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sized = chosen.join(sizes, "list_no", "left").na.fill(0, ["n"]).withColumn("before", before)
    return sized.where((F.col("before") < max_codes) | (F.col("before") < ensure)).drop("n", "before")


def range_search(queries: DataFrame, chosen: DataFrame, lists: DataFrame, radius: float, name: str = "l2", max_empty: int | None = None) -> DataFrame:
    """Hits strictly within the radius; with ``max_empty``, a query's probes end
    once so many in a row have found nothing."""
    m = metric(name)
    blocks = list_blocks(probed(lists, chosen))

    def kernel(qids, q, ids, b, list_no):
        import numpy as np

        d = m.tile(q, b)
        i, j = np.nonzero(d > radius if m.larger_is_better else d < radius)
        return {"qid": qids[i], "id": ids[j], "dist": d[i, j]}

    found = list_tiles(queries, chosen, blocks, kernel, HITS)
    if max_empty is not None:
        found = found.join(lists.select("id", "list_no"), "id")
        hit = found.groupBy("qid", "list_no").agg(F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy("qid").orderBy("probe")
        p = chosen.join(hit, ["qid", "list_no"], "left").withColumn("last_hit", F.coalesce(F.max(F.when(F.col("n").isNotNull(), F.col("probe"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        idle = F.col("probe") - F.col("last_hit") - 1
        p = p.withColumn("over", F.max((idle >= max_empty).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        found = found.join(p.where("over = 0").select("qid", "list_no"), ["qid", "list_no"], "left_semi")
    return found.select("qid", "id", "dist")


def residuals(lists: DataFrame, centroids: DataFrame) -> DataFrame:
    """The lists with each vector's difference from its centroid."""
    return lists.join(centroids, "list_no").select("id", "list_no", F.zip_with("embedding", "centroid", lambda x, c: x.cast("double") - c).alias("embedding"))


def stacked(tables: list[DataFrame], vertical: bool = False) -> DataFrame:
    """Lists of several tables: side by side (the rows of equal lists together),
    or one after the other (list numbers shifted)."""
    from lodestar.operators.merge import union

    if not vertical:
        return union(tables)
    out, shift = [], 0
    for t in tables:
        out.append(t.withColumn("list_no", F.col("list_no") + shift))
        shift += (t.agg(F.max("list_no")).first()[0] or 0) + 1
    return union(out)


def sliced(lists: DataFrame, low: int, high: int) -> DataFrame:
    return lists.where((F.col("list_no") >= low) & (F.col("list_no") < high)).withColumn("list_no", F.col("list_no") - low)


def masked(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first table's lists, and the second's where the first has none."""
    return first.unionByName(second.join(first.select("list_no").distinct(), "list_no", "left_anti").select(first.columns))


def without_large(lists: DataFrame, most: int) -> DataFrame:
    """Lists over ``most`` rows are treated as stop words."""
    large = lists.groupBy("list_no").count().where(F.col("count") > most).select("list_no")
    return lists.join(large, "list_no", "left_anti")


def permuted(lists: DataFrame, permutation: DataFrame) -> DataFrame:
    p = permutation.toDF("list_no", "new")
    return lists.join(p, "list_no").withColumn("list_no", F.col("new")).drop("new").select(lists.columns)


def sharded(lists: DataFrame, n: int) -> DataFrame:
    """Adds the shard of each row: its list number modulo n."""
    return lists.withColumn("shard", F.pmod("list_no", F.lit(n)))


def window(slices: DataFrame, size: int, slice_id: str = "slice_id") -> DataFrame:
    """The newest ``size`` slices of a table that grows by slices."""
    newest = slices.select(slice_id).distinct().orderBy(F.col(slice_id).desc()).limit(size)
    return slices.join(newest, slice_id, "left_semi")


def multi_index(queries: DataFrame, books: list[DataFrame], k: int) -> DataFrame:
    """Cells of a product of sub-quantizers by the sum of their distances: each
    book is ``(id, embedding)`` over its slice of dimensions, with ids from 0. The
    best k cells use only the best k of each book. A cell's number has the first
    book's id lowest."""
    out, at, factor = None, 0, 1
    for book in books:
        d = len(book.first()[1])
        q = queries.toDF("qid", "qv").select("qid", F.slice("qv", at + 1, d).alias("qv"))
        near = knn(q, book, k).select("qid", "id", "dist")
        if out is None:
            out = near
        else:
            n = near.toDF("qid", "id2", "dist2")
            out = top(out.join(n, "qid").select("qid", (F.col("id") + F.col("id2") * factor).alias("id"), (F.col("dist") + F.col("dist2")).alias("dist")), k).select("qid", "id", "dist")
        at, factor = at + d, factor * book.count()
    return top(out, k)


def hash_buckets(codes: DataFrame, bits: int, flips: int = 0, tables: int = 1, width: int = 32) -> DataFrame:
    """``(id, table, key)`` of binary codes (arrays of 32-bit words): the first
    bits of each table's words, and all keys within ``flips`` bits of them."""
    from itertools import combinations

    masks = [sum(1 << b for b in c) for f in range(flips + 1) for c in combinations(range(bits), f)]
    t = codes.toDF("id", "code").withColumn("table", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))))
    word = F.get("code", F.pmod("table", F.size("code")))
    key = word.bitwiseAND(F.lit((1 << bits) - 1))
    return t.withColumn("mask", F.explode(F.array(*map(F.lit, masks)))).select("id", "table", key.bitwiseXOR(F.col("mask").cast("long")).alias("key"), "code")


def hash_search(queries: DataFrame, base: DataFrame, k: int, bits: int, flips: int = 0, tables: int = 1) -> DataFrame:
    """Nearest codes among those that share a bucket with the query."""
    from lodestar.functions.metrics import hamming

    q = hash_buckets(queries, bits, flips, tables).select(F.col("id").alias("qid"), "table", "key", F.col("code").alias("qc"))
    b = hash_buckets(base, bits, 0, tables)
    hit = q.join(b, ["table", "key"]).select("qid", "id", hamming(F.col("qc"), F.col("code")).cast("double").alias("dist")).distinct()
    return top(hit, k)


def binary_centroids(codes: DataFrame, k: int, bits: int, iterations: int = 10) -> DataFrame:
    """``(list_no, centroid)`` of codes in 32-bit words: k-means over vectors of -1
    and 1, whose centroids' signs are the centroid's bits. With the metric
    ``knn.HAMMING``, everything above works on such centroids and codes."""
    import numpy as np

    from lodestar.functions.vectors import bits_to_signs
    from lodestar.operators import cluster

    c = codes.toDF("id", "code")
    m, _ = cluster.kmeans(c.select("id", bits_to_signs(F.col("code"), bits).alias("v")), cluster.KMeans(k, iterations, init="hash"))
    pad = np.zeros((len(m), -bits % 32), bool)
    words = (np.concatenate([m > 0, pad], axis=1).reshape(len(m), -1, 32).astype(np.int64) << np.arange(32)).sum(axis=2)
    return cluster.centroid_frame(codes.sparkSession, words)


def nn_descent(base: DataFrame, k: int, rounds: int = 4, seed: int = 7, reverse: int | None = None) -> DataFrame:
    """An approximate k-NN graph: starting from neighbours picked by hash, each row
    tries the neighbours of its neighbours, in both directions. Of the
    rows that have it as a neighbour, each takes ``reverse`` of the nearest (2 k
    unless told otherwise), so that a row which very many others are close to
    makes no more pairs than any other."""
    from lodestar.sources.shared import materialize, settled

    spark, back = base.sparkSession, reverse or 2 * k
    rows = materialize(base.toDF("id", "v"), "rows")
    order = materialize(rows.select("id", F.xxhash64("id", F.lit(seed)).alias("key")).repartitionByRange("key", "id").withColumn("part", F.spark_partition_id()), "order")
    sizes = order.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("key", "id")) - 1
    order = materialize(order.withColumn("nth", nth).join(F.broadcast(before), "part").select("id", (F.col("before") + F.col("nth")).alias("at")), "numbers")
    n = order.count()
    start = order.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k)))).select(F.col("id").alias("qid"), F.pmod(F.xxhash64("id", "step", F.lit(seed)), F.lit(n)).alias("at"))
    graph = settled(spark, lambda: _ranked(start.join(order, "at").select("qid", "id").where("qid <> id").distinct(), rows, k), "graph")
    for _ in range(rounds):
        reversed_ = top(graph.select(F.col("id").alias("qid"), F.col("qid").alias("id"), "dist"), back).select("qid", "id")
        e = materialize(graph.select("qid", "id").unionAll(reversed_).distinct(), "both")
        two = e.toDF("qid", "mid").join(e.toDF("mid", "id"), "mid").select("qid", "id").where("qid <> id")
        graph = settled(spark, lambda: _ranked(two.unionAll(e).distinct(), rows, k), "graph")  # noqa: B023  called at once
    return graph


def _ranked(pairs: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    m = metric("l2")
    x, y = rows.toDF("qid", "x"), rows.toDF("id", "y")
    return top(pairs.join(x, "qid").join(y, "id").select("qid", "id", m.column(F.col("x"), F.col("y")).alias("dist")), k)
