"""Queries of inverted lists and codecs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import vectors
from lodestar.functions.metrics import distance
from lodestar.operators import cluster, codecs, ivf, knn
from lodestar.plans.registry import L2, VECTORS, base_of, queries_of, query, result, sql_hits, sql_sum, sql_top, table

# --- clustering and inverted lists, with the 16 rows of least id as centroids ---

_C = "c AS (SELECT row_number() OVER (ORDER BY id) - 1 AS list_no, v AS c FROM (SELECT * FROM v ORDER BY id LIMIT 16))"
_LISTS = f"WITH {VECTORS}, {_C}, l AS (SELECT id, v, arg_min(list_no, ({sql_sum('(z[1] - z[2]) * (z[1] - z[2])', 'v', 'c')}, list_no)) AS list_no FROM v JOIN c ON true GROUP BY id, v)"
_SCAN = f"""{_LISTS}, d AS (SELECT qid, list_no, row_number() OVER (PARTITION BY qid ORDER BY {sql_sum('(z[1] - z[2]) * (z[1] - z[2])', 'q.v', 'c')}, list_no)::INT AS probe FROM q JOIN c ON true),
h AS (SELECT q.qid, b.id, {L2} AS dist, b.list_no, probe FROM q JOIN d ON d.qid = q.qid AND probe <= 4 JOIN l b ON b.list_no = d.list_no)"""


def _lists(spark, sf_dir):
    base = base_of(spark, sf_dir)
    c = cluster.centroid_frame(spark, cluster.initial(base, cluster.KMeans(16)))
    return base, c, ivf.assign_lists(base, c)


@query(f"{_LISTS} SELECT id, list_no::INT AS list_no FROM l")
def ivf_assign(spark, sf_dir):
    return _lists(spark, sf_dir)[2].select("id", "list_no")


@query(f"{_LISTS}, n AS (SELECT list_no, count(*) AS n FROM l GROUP BY list_no) SELECT round(count(*) * sum(n * n) / (sum(n) * sum(n))::DOUBLE, 6) AS imbalance FROM n")
def ivf_imbalance(spark, sf_dir):
    return cluster.imbalance(_lists(spark, sf_dir)[2]).select(F.round("imbalance", 6).alias("imbalance"))


@query(f"{_LISTS} SELECT list_no::INT AS list_no, count(*)::BIGINT AS n, round(sum(v[1]) / count(*), 6) AS first, round(sum(v[64]) / count(*), 6) AS last FROM l GROUP BY list_no")
def kmeans_step(spark, sf_dir):
    """One Lloyd step: sizes and new centroids."""
    base, c, _ = _lists(spark, sf_dir)
    out = cluster.lloyd_step(base, c)
    return out.select("list_no", "n", F.round(F.col("centroid")[0], 6).alias("first"), F.round(F.element_at("centroid", -1), 6).alias("last"))


@query(f"{_SCAN}, {sql_top()} SELECT qid, rank, id, round(dist, 5) AS dist FROM r")
def ivf_search(spark, sf_dir):
    base, c, lists = _lists(spark, sf_dir)
    return result(ivf.search(queries_of(base), c, lists, 10, 4))


@query(f"{_SCAN}, {sql_top()} SELECT qid, rank, id, round(dist, 5) AS dist FROM r")
def ivf_big_batch_search(spark, sf_dir):
    base, c, lists = _lists(spark, sf_dir)
    q = queries_of(base)
    return result(ivf.big_batch_search(q, ivf.probes(q, c, 4), lists, 10))


@query(f"{_SCAN} SELECT qid, id, round(dist, 5) AS dist FROM h WHERE dist < 1.5")
def ivf_range_search(spark, sf_dir):
    base, c, lists = _lists(spark, sf_dir)
    q = queries_of(base)
    return ivf.range_search(q, ivf.probes(q, c, 4), lists, 1.5).select("qid", "id", F.round("dist", 5).alias("dist"))


@query(f"{_SCAN}, n AS (SELECT list_no, count(*) AS n FROM l GROUP BY list_no), p AS (SELECT d.*, coalesce(sum(n) OVER (PARTITION BY qid ORDER BY probe ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT * FROM d WHERE probe <= 4) d LEFT JOIN n USING (list_no)), h2 AS (SELECT h.* FROM h JOIN p ON p.qid = h.qid AND p.list_no = h.list_no WHERE before < 60), {sql_top(source='h2')} SELECT qid, rank, id, round(dist, 5) AS dist FROM r")
def ivf_max_codes(spark, sf_dir):
    """Probes end once 60 rows have been scanned."""
    from lodestar.operators.knn import top

    base, c, lists = _lists(spark, sf_dir)
    q = queries_of(base)
    p = ivf.limited_probes(ivf.probes(q, c, 4), lists, 60)
    return result(top(ivf.scan(q, p, lists), 10))


@query(f"{_LISTS} SELECT (list_no % 4)::INT AS shard, count(*)::BIGINT AS n FROM l GROUP BY list_no % 4")
def ivf_shards(spark, sf_dir):
    return ivf.sharded(_lists(spark, sf_dir)[2], 4).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_LISTS} SELECT l.id, round({sql_sum('(z[1] - z[2]) * (z[1] - z[2])', 'l.v', 'c')}, 5) AS residual FROM l JOIN c USING (list_no)")
def ivf_residuals(spark, sf_dir):
    _, c, lists = _lists(spark, sf_dir)
    r = ivf.residuals(lists, c)
    return r.select("id", F.round(distance("ip", F.col("embedding"), F.col("embedding")), 5).alias("residual"))


@query("WITH e AS (SELECT *, (epoch_us(ts) // 86400000000)::BIGINT AS slice_id FROM events), n AS (SELECT DISTINCT slice_id FROM e ORDER BY slice_id DESC LIMIT 3) SELECT slice_id, count(*)::BIGINT AS n FROM e JOIN n USING (slice_id) GROUP BY slice_id")
def sliding_window(spark, sf_dir):
    """The three newest days of events as slices."""
    slices = table(spark, sf_dir, "events").withColumn("slice_id", F.floor(F.unix_timestamp("ts") / 86400))
    return ivf.window(slices, 3).groupBy("slice_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {VECTORS}, s AS (SELECT id, list_reduce([((v[i] > 0)::BIGINT << (i - 1))::BIGINT for i in range(1, 9)], lambda a, x: a + x) AS key FROM v) SELECT id, key FROM s")
def binary_hash_buckets(spark, sf_dir):
    codes = base_of(spark, sf_dir).select("id", vectors.sign_words(F.col("embedding")))
    return ivf.hash_buckets(codes, 8).select("id", "key")


@query(f"{sql_hits(sql_sum('CASE WHEN (z[1] > 0) <> (z[2] > 0) THEN 1 ELSE 0 END') + '::DOUBLE', where='list_sum([CASE WHEN (z[1] > 0) <> (z[2] > 0) THEN 1 ELSE 0 END for z in list_zip(q.v[1:8], b.v[1:8])]) <= 1')}, {sql_top()} SELECT qid, rank, id, dist FROM r")
def binary_hash_search(spark, sf_dir):
    """Codes whose first eight bits differ in one place at most."""
    codes = base_of(spark, sf_dir).select("id", vectors.sign_words(F.col("embedding")).alias("embedding"))
    return ivf.hash_search(queries_of(codes), codes, 10, 8, 1)


@query(f"""WITH {VECTORS}, a1 AS (SELECT id AS i1, v[1:32] AS x FROM v ORDER BY id LIMIT 8), a2 AS (SELECT id AS i2, v[33:64] AS y FROM v ORDER BY id LIMIT 8),
h AS (SELECT qid, (row_number() OVER (PARTITION BY qid, i2 ORDER BY i1) - 1) + (dense_rank() OVER (PARTITION BY qid ORDER BY i2) - 1) * 8 AS id, {sql_sum('(z[1] - z[2]) * (z[1] - z[2])', 'q.v[1:32]', 'x')} + {sql_sum('(z[1] - z[2]) * (z[1] - z[2])', 'q.v[33:64]', 'y')} AS dist FROM q JOIN a1 ON true JOIN a2 ON true), {sql_top(5)} SELECT qid, rank, id, round(dist, 5) AS dist FROM r""")
def multi_index_cells(spark, sf_dir):
    """The best cells of a product of two books of eight rows."""
    base = base_of(spark, sf_dir)
    first = [r.embedding for r in base.orderBy("id").limit(8).collect()]
    book = lambda a: spark.createDataFrame([(i, [float(x) for x in v[a : a + 32]]) for i, v in enumerate(first)], "id long, embedding array<double>")
    return result(ivf.multi_index(queries_of(base), [book(0), book(32)], 5))


# --- codecs ---

_SQ8 = f"WITH {VECTORS}, x AS (SELECT id, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM v), s AS (SELECT i, min(x) AS a, (max(x) - min(x)) / 256 AS s FROM x GROUP BY i), e AS (SELECT id, i, least(255, greatest(0, floor((x - a) / s)))::INT AS c, a, s FROM x JOIN s USING (i))"


@query(f"{_SQ8} SELECT id, sum(c)::BIGINT AS code_sum, round(sum(a + (c + 0.5) * s), 5) AS decoded_sum FROM e GROUP BY id")
def sq8_codes(spark, sf_dir):
    base = base_of(spark, sf_dir)
    sq = codecs.scalar_quantizer(base)
    coded = base.select("id", sq.encode(F.col("embedding")).alias("c"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return coded.select("id", F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + x).alias("code_sum"), F.round(total(sq.decode(F.col("c"))), 5).alias("decoded_sum"))


@query(f"{_SQ8}, w AS (SELECT id, list(a + (c + 0.5) * s ORDER BY i) AS v FROM e GROUP BY id), h AS (SELECT q.qid, b.id, {L2} AS dist FROM q JOIN w b ON b.id <> q.qid), {sql_top()} SELECT qid, rank, id, round(dist, 5) AS dist FROM r")
def sq8_search(spark, sf_dir):
    base = base_of(spark, sf_dir)
    sq = codecs.scalar_quantizer(base)
    coded = base.select("id", sq.decode(sq.encode(F.col("embedding"))).alias("embedding"))
    return result(knn.knn(queries_of(base), coded, 10, exclude_self=True))


@query(f"""{sql_hits(sql_sum('CASE WHEN (z[1] > 0) <> (z[2] > 0) THEN 1 ELSE 0 END') + '::DOUBLE')}, {sql_top(40).replace('r AS', 'w AS', 1)}, g AS (SELECT w.qid, w.id, {L2} AS dist FROM w JOIN q ON q.qid = w.qid JOIN v b ON b.id = w.id), {sql_top(source='g')} SELECT qid, rank, id, round(dist, 5) AS dist FROM r""")
def lsh_refined(spark, sf_dir):
    """Forty candidates by sign codes, ranked by exact distances."""
    base = base_of(spark, sf_dir)
    codes = base.select("id", codecs.lsh(F.col("embedding")).alias("embedding"))
    found = knn.knn(queries_of(codes), codes, 40, knn.HAMMING, exclude_self=True)
    return result(codecs.refined(found, queries_of(base), base, 10))


@query("WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT id, v, list_min(v) AS low, (list_max(v) - list_min(v)) / 255 AS step FROM v) SELECT id, round(low, 6) AS low, round(step, 8) AS step, list_sum([round_even((x - low) / step, 0)::BIGINT for x in v])::BIGINT AS code_sum FROM m")
def row_min_max_codes(spark, sf_dir):
    code = codecs.row_min_max(F.col("embedding"))
    rows = base_of(spark, sf_dir).select("id", code.alias("c"))
    return rows.select("id", F.round("c.low", 6).alias("low"), F.round("c.step", 8).alias("step"), F.aggregate("c.codes", F.lit(0).cast("long"), lambda s, x: s + x).alias("code_sum"))
