"""Queries of evaluation, calibration and analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import vectors
from lodestar.operators import calibrate, evaluate, knn
from lodestar.plans.registry import base_of, queries_of, query, sql_hits, sql_sum, sql_top, table
from lodestar.sources import datasets, text_embedding
from lodestar.sources.shared import materialize

_SIGN = sql_sum("CASE WHEN (z[1] > 0) <> (z[2] > 0) THEN 1 ELSE 0 END") + "::DOUBLE"
_H = sql_hits().removeprefix("WITH ")
#: Truth ``t`` (exact) and result ``a`` (by sign codes), both with ranks to 10.
_BOTH = f"WITH {_H}, {sql_top()}, t AS (SELECT qid, rank, id, dist FROM r), h2 AS (SELECT q.qid, b.id, {_SIGN} AS dist FROM q JOIN v b ON b.id <> q.qid), {sql_top(source='h2').replace('r AS', 'a AS', 1)}"


def _result_and_truth(spark, sf_dir):
    base = base_of(spark, sf_dir)
    codes = base.select("id", vectors.sign_words(F.col("embedding")).alias("embedding"))
    truth = knn.knn(queries_of(base), base, 10, exclude_self=True)
    return knn.knn(queries_of(codes), codes, 10, knn.HAMMING, exclude_self=True), truth


@query(f"{_BOTH} SELECT t.qid, count(a.id)::BIGINT AS hits, round(count(a.id) / 10.0::DOUBLE, 6) AS recall FROM t LEFT JOIN a ON a.qid = t.qid AND a.id = t.id GROUP BY t.qid")
def recall_at_10(spark, sf_dir):
    out = evaluate.recall(*_result_and_truth(spark, sf_dir), 10)
    return out.select("qid", "hits", F.round("recall", 6).alias("recall"))


@query(f"{_BOTH} SELECT (SELECT count(*) FROM a JOIN t ON a.qid = t.qid AND a.id = t.id)::BIGINT AS shared, (SELECT count(*) FROM a)::BIGINT AS n")
def result_intersection(spark, sf_dir):
    return evaluate.intersection(*_result_and_truth(spark, sf_dir)).select("shared", "n")


@query(f"{_BOTH} SELECT round(avg(CASE WHEN a.id IS NULL THEN 0.0 ELSE 1.0 END)::DOUBLE, 6) AS recall FROM t LEFT JOIN a ON a.qid = t.qid AND a.id = t.id WHERE t.rank = 1")
def one_recall_at_10(spark, sf_dir):
    return evaluate.one_recall(*_result_and_truth(spark, sf_dir), 10).select(F.round("recall", 6).alias("recall"))


_RANGE = f"{sql_hits()}, res AS (SELECT qid, id, dist FROM h WHERE dist < 1.5 AND id % 3 <> 0), tru AS (SELECT qid, id, dist FROM h WHERE dist < 1.4)"


def _ranges(spark, sf_dir):
    base = base_of(spark, sf_dir)
    hits = knn.range_search(queries_of(base), base, 1.5, exclude_self=True)
    return hits.where("id % 3 <> 0"), hits.where("dist < 1.4"), queries_of(base)


@query(f"""{_RANGE}, n AS (SELECT qid, (SELECT count(*) FROM res WHERE res.qid = q.qid)::BIGINT AS n_result, (SELECT count(*) FROM tru WHERE tru.qid = q.qid)::BIGINT AS n_truth,
(SELECT count(*) FROM res JOIN tru ON res.qid = tru.qid AND res.id = tru.id WHERE res.qid = q.qid)::BIGINT AS n_both FROM q)
SELECT *, round(CASE WHEN n_result = 0 THEN 1.0 ELSE n_both / n_result END::DOUBLE, 6) AS precision, round(CASE WHEN n_truth = 0 THEN CASE WHEN n_result = 0 THEN 1.0 ELSE 0.0 END ELSE n_both / n_truth END::DOUBLE, 6) AS recall FROM n""")
def range_precision_recall(spark, sf_dir):
    out = evaluate.range_scores(*_ranges(spark, sf_dir))
    return out.select("qid", "n_result", "n_truth", "n_both", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"""{_RANGE}, s AS (SELECT unnest([1.2, 1.3, 1.35, 1.45])::DOUBLE AS threshold), n AS (SELECT threshold, (SELECT count(*) FROM res WHERE dist < threshold)::BIGINT AS n_result, (SELECT count(*) FROM tru WHERE dist < threshold)::BIGINT AS n_truth,
(SELECT count(*) FROM res JOIN tru ON res.qid = tru.qid AND res.id = tru.id WHERE res.dist < threshold)::BIGINT AS n_both FROM s)
SELECT threshold, n_result, n_truth, n_both, round(CASE WHEN n_result = 0 THEN 1.0 ELSE n_both / n_result END::DOUBLE, 6) AS precision, round(CASE WHEN n_truth = 0 THEN CASE WHEN n_result = 0 THEN 1.0 ELSE 0.0 END ELSE n_both / n_truth END::DOUBLE, 6) AS recall FROM n""")
def range_precision_recall_curve(spark, sf_dir):
    res, tru, _ = _ranges(spark, sf_dir)
    out = evaluate.range_curve(res, tru, [1.2, 1.3, 1.35, 1.45])
    return out.select("threshold", "n_result", "n_truth", "n_both", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("SELECT event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS mean_ms, round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, min(value) AS min_ms, max(value) AS max_ms FROM events GROUP BY event_type")
def latency_report(spark, sf_dir):
    out = evaluate.latencies(table(spark, sf_dir, "events"), ["event_type"], "value")
    return out.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean_ms", "p50_ms", "p95_ms")), "min_ms", "max_ms")


@query("WITH w AS (SELECT p_partkey, p_brand, p_size, p_retailprice, min(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM part) SELECT p_brand, p_size, p_retailprice FROM w WHERE least IS NULL OR p_retailprice < least")
def pareto_points(spark, sf_dir):
    """Of each brand, parts for which no larger one costs as little."""
    return evaluate.pareto(table(spark, sf_dir, "part"), "p_size", "p_retailprice", ["p_brand"]).select("p_brand", "p_size", "p_retailprice")


@query("WITH b AS (SELECT p_size::DOUBLE / 50 AS r, max(p_retailprice) AS qps FROM part GROUP BY p_size), w AS (SELECT round(r, 10) AS recall, qps, max(qps) OVER (ORDER BY r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM b) SELECT recall, qps FROM w WHERE most IS NULL OR qps > most")
def recall_qps_frontier(spark, sf_dir):
    points = table(spark, sf_dir, "part").select((F.col("p_size") / 50).alias("recall"), F.col("p_retailprice").alias("qps"))
    return evaluate.recall_qps_frontier(points)


_CURVE = "c AS (SELECT l_returnflag AS f, l_quantity / 50 AS recall, min(l_extendedprice) AS v FROM lineitem GROUP BY ALL), n AS (SELECT *, lead(recall) OVER (PARTITION BY f ORDER BY recall) AS r1, lead(v) OVER (PARTITION BY f ORDER BY recall) AS v1 FROM c)"


@query(f"WITH {_CURVE} SELECT f AS l_returnflag, round(max(v + (0.515 - recall) / (r1 - recall) * (v1 - v)), 4) AS price FROM n WHERE recall <= 0.515 AND r1 > 0.515 GROUP BY f")
def value_at_recall(spark, sf_dir):
    """A curve of least prices by quantity, read between its points."""
    curve = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") / 50).alias("recall"), F.col("l_extendedprice").alias("price"))
    return evaluate.at_recall(curve, 0.515, "price", ["l_returnflag"]).select("l_returnflag", F.round("price", 4).alias("price"))


@query("SELECT p_partkey, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_retailprice), 8) AS ecdf FROM part")
def price_ecdf(spark, sf_dir):
    return evaluate.ecdf(table(spark, sf_dir, "part"), "p_retailprice", ["p_brand"]).select("p_partkey", F.round("ecdf", 8).alias("ecdf"))


_RANKS = "x AS (SELECT p_size AS a, p_retailprice AS b FROM part), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb FROM x)"


@query(f"WITH {_RANKS} SELECT round(corr(ra, rb), 6) AS rho FROM r")
def rank_correlation(spark, sf_dir):
    return evaluate.rank_correlation(table(spark, sf_dir, "part"), "p_size", "p_retailprice").select(F.round("rho", 6).alias("rho"))


_LABELLED = "d AS (SELECT n_chars AS s, quality = 1 AS p FROM documents JOIN labels USING (doc_id))"


@query(f"WITH {_LABELLED}, r AS (SELECT p, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r FROM d), n AS (SELECT sum(r) FILTER (p) AS s, count(*) FILTER (p) AS n1, count(*) FILTER (NOT p) AS n0 FROM r) SELECT round((s - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS auc FROM n")
def length_auc(spark, sf_dir):
    """How well a document's length tells its quality."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("n_chars", (F.col("quality") == 1).alias("good"))
    return evaluate.auc(rows, "n_chars", "good").select(F.round("auc", 6).alias("auc"))


@query(f"WITH {_LABELLED}, c AS (SELECT s, count(*) FILTER (p) AS n1, count(*) FILTER (NOT p) AS n0 FROM d GROUP BY s), f AS (SELECT abs(sum(n1) OVER (ORDER BY s) / (SELECT sum(n1) FROM c) - sum(n0) OVER (ORDER BY s) / (SELECT sum(n0) FROM c)) AS gap FROM c) SELECT round(max(gap)::DOUBLE, 6) AS ks FROM f")
def length_ks(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("n_chars", (F.col("quality") == 1).alias("good"))
    return evaluate.ks(rows, "n_chars", "good").select(F.round("ks", 6).alias("ks"))


# --- calibration over exact neighbours ---

_ALL = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), q AS (SELECT id AS qid, v, label FROM v)"
_LID = f"{sql_hits(vectors=_ALL)}, {sql_top(20)}, lid AS (SELECT qid AS id, -count(*) / sum(ln(dist / far)) AS lid FROM (SELECT *, max(dist) OVER (PARTITION BY qid) AS far FROM r) GROUP BY qid)"


def _lids(spark, sf_dir):
    base = base_of(spark, sf_dir)
    near = knn.knn(base.toDF("qid", "qv"), base, 20, exclude_self=True)
    return calibrate.lid(near, 20)


@query(f"{_LID} SELECT id, round(lid, 4) AS lid FROM lid")
def local_dimension(spark, sf_dir):
    """The local intrinsic dimension at every vector."""
    return _lids(spark, sf_dir).select("id", F.round("lid", 4).alias("lid"))


_TRIM = f"{_LID}, b AS (SELECT quantile_cont(lid, 0.01) AS a, quantile_cont(lid, 0.99) AS z FROM lid), trimmed AS (SELECT lid.* FROM lid, b WHERE lid BETWEEN a AND z)"


def _trimmed(spark, sf_dir):
    """The dimensions of all vectors within their percentiles, computed once."""
    return calibrate.trimmed(materialize(_lids(spark, sf_dir), "lids"))


@query(f"{_TRIM}, c AS (SELECT *, ntile(50) OVER (ORDER BY lid, id) AS chunk FROM trimmed), p AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY lid, id) AS place, count(*) OVER (PARTITION BY chunk) AS n, min(lid) OVER (PARTITION BY chunk) AS low, max(lid) OVER (PARTITION BY chunk) AS high FROM c) SELECT (chunk - 1)::INT AS selection_rank, id, round(lid, 4) AS lid, round(low, 4) AS bucket_lower, round(high, 4) AS bucket_upper FROM p WHERE place = n // 2 + 1")
def quantile_probes(spark, sf_dir):
    """Fifty calibration probes along the trimmed dimensions."""
    out = calibrate.quantile_probes(_trimmed(spark, sf_dir), 50)
    return out.select("selection_rank", "id", F.round("lid", 4).alias("lid"), F.round("bucket_lower", 4).alias("bucket_lower"), F.round("bucket_upper", 4).alias("bucket_upper"))


@query("WITH e AS (SELECT DISTINCT (p_size * 16)::INT AS ef FROM part), r AS (SELECT ef, j - 1 AS route_idx, greatest(1, ef * j // 4)::INT AS route_ef FROM e, range(1, 4) t(j)) SELECT ef, route_idx::INT AS route_idx, route_ef, greatest(1, route_ef // 2)::INT AS pair_ef FROM r")
def route_table(spark, sf_dir):
    """Routes of the widths that sizes of parts stand for."""
    return calibrate.routes(table(spark, sf_dir, "part").select((F.col("p_size") * 16).alias("ef")).distinct())


#: Orders as probes: a recall and a ratio for each, at two widths.
_PROBES = "pr AS (SELECT o_orderkey AS qid, e AS ef, CASE WHEN (o_orderkey * 7 + e) % 10 < 8 THEN 1.0 ELSE 0.5 END AS recall FROM orders, (SELECT unnest([32, 64, 96, 128, 192])::INT AS e)), cf AS (SELECT o_orderkey AS qid, e AS ef, 0.5 + (o_totalprice / 1000000) AS cfr_mean FROM orders, (SELECT unnest([256, 128])::INT AS e) WHERE o_orderkey % 11 <> 0)"


@query(f"""WITH {_PROBES}, rt AS (SELECT ef, j - 1 AS route_idx, (ef * j // 4)::INT AS route_ef, (ef * j // 4 // 2)::INT AS pair_ef FROM (SELECT unnest([256, 128])::INT AS ef), range(1, 4) t(j)),
a AS (SELECT rt.ef, route_idx, route_ef, rt.pair_ef, avg(CASE WHEN recall >= 0.9 THEN 1.0 ELSE 0.0 END)::DOUBLE AS rate FROM rt JOIN cf ON cf.ef = rt.ef JOIN pr ON pr.ef = rt.pair_ef AND pr.qid = cf.qid GROUP BY ALL),
s AS (SELECT ef, list(cfr_mean ORDER BY cfr_mean) AS v, count(*) AS n FROM cf GROUP BY ef),
t AS (SELECT a.*, rate * (n - 1) AS at, v FROM a JOIN s USING (ef)),
x AS (SELECT *, v[floor(at)::BIGINT + 1] + (v[ceil(at)::BIGINT + 1] - v[floor(at)::BIGINT + 1]) * (at - floor(at)) AS theta FROM t),
y AS (SELECT *, max(theta) OVER (PARTITION BY ef ORDER BY route_idx) AS theta2 FROM x)
SELECT ef, route_idx::INT AS route_idx, route_ef, pair_ef, round(rate, 6) AS rate, round(theta2, 6) AS theta, round(max(theta2) OVER (PARTITION BY ef), 6) AS tau, round(theta2 / max(theta2) OVER (PARTITION BY ef), 6) AS gamma FROM y""".replace("AS at, v", "AS place, v").replace("floor(at)", "floor(place)").replace("ceil(at)", "ceil(place)").replace("(at - ", "(place - "))
def policy_thresholds(spark, sf_dir):
    """The threshold rule over orders as probes."""
    orders = table(spark, sf_dir, "orders")
    at = lambda *e: F.explode(F.array(*map(F.lit, e))).alias("ef")
    recalls = orders.select(F.col("o_orderkey").alias("qid"), at(32, 64, 96, 128, 192)).withColumn("recall", F.when((F.col("qid") * 7 + F.col("ef")) % 10 < 8, 1.0).otherwise(0.5))
    cfr = orders.where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("qid"), (F.lit(0.5) + F.col("o_totalprice") / 1000000).alias("cfr_mean"), at(256, 128))
    route = calibrate.routes(spark.createDataFrame([(256,), (128,)], "ef int"))
    out = calibrate.thresholds(route, recalls, cfr, 0.9)
    return out.select("ef", "route_idx", "route_ef", "pair_ef", *(F.round(c, 6).alias(c) for c in ("rate", "theta", "tau", "gamma")))


@query("WITH c AS (SELECT p_size AS ef, 1 - 1.0::DOUBLE / (p_size + 1 + count(*) % 3) AS recall FROM part GROUP BY p_size), w AS (SELECT *, max(recall) OVER (ORDER BY ef) AS cumulative, max(recall) OVER () AS most FROM c) SELECT ef, round(recall, 6) AS recall, round(cumulative, 6) AS cumulative, (SELECT min(ef) FROM w WHERE most - cumulative <= 0.001)::INT AS recommended_ef FROM w")
def recommended_width(spark, sf_dir):
    curve = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("ef")).agg(F.count(F.lit(1)).alias("n"))
    curve = curve.select("ef", (1 - 1.0 / (F.col("ef") + 1 + F.col("n") % 3)).alias("recall"))
    out = calibrate.recommended(curve)
    return out.select("ef", F.round("recall", 6).alias("recall"), F.round("cumulative", 6).alias("cumulative"), F.col("recommended_ef").cast("int").alias("recommended_ef"))


@query("WITH q AS (SELECT o_orderkey AS qid, (o_orderkey * 13 % 11) / 10.0::DOUBLE AS recall, o_custkey AS first_step FROM orders), r AS (SELECT *, row_number() OVER (ORDER BY recall DESC, first_step, qid) AS rank, count(*) OVER () AS n FROM q) SELECT qid, rank::INT AS rank, round((rank - 1) / (n - 1)::DOUBLE, 8) AS percentile, CASE WHEN rank <= floor(n * 0.3) THEN 'easy' WHEN rank > n - floor(n * 0.3) THEN 'hard' ELSE 'medium' END AS \"group\" FROM r")
def difficulty_groups(spark, sf_dir):
    q = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qid"), (F.col("o_orderkey") * 13 % 11 / 10.0).alias("recall"), F.col("o_custkey").alias("first_step"))
    return calibrate.difficulty(q).select("qid", "rank", F.round("percentile", 8).alias("percentile"), "group")


_RUNS = "u AS (SELECT o_orderkey AS qid, 1 - (o_orderkey % 7) / 10.0::DOUBLE AS full_recall, 1 - (o_orderkey % 9) / 10.0::DOUBLE AS low_recall, (CASE WHEN o_orderkey % 4 = 0 THEN 256 ELSE 64 * (o_orderkey % 4) END)::INT AS effective_ef, o_orderpriority AS g FROM orders)"


def _runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    wide = o.select(k.alias("qid"), F.lit(256).alias("ef"), F.lit("vanilla").alias("method"), (1 - k % 7 / 10.0).alias("recall"), (k % 100 + 1000).alias("ndis"), F.lit(256).alias("effective_ef"))
    low = o.select(k.alias("qid"), F.lit(256).alias("ef"), F.lit("adaptive").alias("method"), (1 - k % 9 / 10.0).alias("recall"), (k % 100 + 500).alias("ndis"), F.when(k % 4 == 0, 256).otherwise(64 * (k % 4)).cast("int").alias("effective_ef"))
    groups = o.select(k.alias("qid"), F.when(F.col("o_orderpriority").startswith("1"), "hard").otherwise("easy").alias("group"))
    return groups, wide.unionByName(low)


@query(f"WITH {_RUNS} SELECT 256::INT AS ef, effective_ef, count(*)::BIGINT AS n, count(*) FILTER (full_recall - low_recall > 0)::BIGINT AS n_lost, round(avg(full_recall - low_recall), 6) AS mean_drop, round(quantile_cont(full_recall - low_recall, 0.5), 6) AS median_drop FROM u WHERE effective_ef < 256 AND starts_with(g, '1') GROUP BY effective_ef")
def false_easy(spark, sf_dir):
    """Hard queries that were routed below their width."""
    out = calibrate.false_easy(*_runs(spark, sf_dir))
    return out.select("ef", "effective_ef", "n", "n_lost", F.round("mean_drop", 6).alias("mean_drop"), F.round(F.col("drop_quartiles")[1], 6).alias("median_drop"))


@query("WITH u AS (SELECT CASE WHEN starts_with(o_orderpriority, '1') THEN 'hard' ELSE 'easy' END AS g, o_orderkey % 7 AS a, o_orderkey % 9 AS b, o_orderkey % 100 AS d FROM orders) SELECT g AS \"group\", count(*)::BIGINT AS n, round(avg(1 - a / 10.0::DOUBLE), 6) AS vanilla, round(avg(1 - b / 10.0::DOUBLE), 6) AS adaptive, round(1 - avg(d + 500) / avg(d + 1000), 6) AS saved FROM u GROUP BY g")
def drill_down(spark, sf_dir):
    d = calibrate.drill_down(*_runs(spark, sf_dir)).where("method = 'adaptive'")
    return d.select("group", "n", F.round(F.col("recall") - F.col("recall_delta"), 6).alias("vanilla"), F.round("recall", 6).alias("adaptive"), F.round("ndis_saved", 6).alias("saved"))


@query("WITH s AS (SELECT l_orderkey AS qid, l_linenumber AS step, count(*) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS found FROM lineitem), s1 AS (SELECT qid, step, max(found) AS found FROM s GROUP BY ALL), n AS (SELECT *, found - coalesce(lag(found) OVER (PARTITION BY qid ORDER BY step), 0) AS new FROM s1), g AS (SELECT *, CASE WHEN step - lag(step) OVER (PARTITION BY qid ORDER BY step) <= 2 THEN 0 ELSE 1 END AS begins FROM n WHERE new > 0), b AS (SELECT *, sum(begins) OVER (PARTITION BY qid ORDER BY step) AS burst FROM g) SELECT qid, burst::BIGINT AS burst, min(step)::INT AS first, max(step)::INT AS last, sum(new)::BIGINT AS found FROM b GROUP BY qid, burst")
def hit_bursts(spark, sf_dir):
    """Order lines as steps of a walk at which neighbours are found."""
    from pyspark.sql import Window

    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("step")).agg(F.count(F.lit(1)).alias("n"))
    found = F.sum("n").over(Window.partitionBy("qid").orderBy("step"))
    return calibrate.hit_bursts(lines.select("qid", "step", found.alias("found")), 2)


@query("WITH t AS (SELECT event_type AS run, user_id % 5 AS step, quantile_cont(value, 0.5) AS seconds, count(*)::BIGINT AS repeats FROM events GROUP BY ALL) SELECT run, step, repeats, round(seconds, 6) AS seconds, round(seconds / sum(seconds) OVER (PARTITION BY run), 6) AS share FROM t")
def offline_cost(spark, sf_dir):
    """Events as timed steps of runs."""
    times = table(spark, sf_dir, "events").select(F.col("event_type").alias("run"), (F.col("user_id") % 5).alias("step"), F.col("event_id").alias("repeat"), F.col("value").alias("seconds"))
    out = calibrate.cost_by_step(times)
    return out.select("run", "step", "repeats", F.round("seconds", 6).alias("seconds"), F.round("share", 6).alias("share"))


@query("WITH r AS (SELECT l_returnflag AS v, l_linenumber::INT AS ef, avg(l_quantity) / 50 AS a, avg(l_discount) * 10 AS b, sum(l_extendedprice) AS s, sum(l_extendedprice * (1 - l_discount)) AS t FROM lineitem GROUP BY ALL) SELECT v AS variant, ef, round(s / t, 6) AS speedup, round((a - b) / a, 6) AS loss FROM r")
def ablation_summary(spark, sf_dir):
    """Line items as runs of two methods by variant and width."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("variant"), F.col("l_linenumber").alias("ef"))
    r = g.agg((F.avg("l_quantity") / 50).alias("a"), (F.avg("l_discount") * 10).alias("b"), F.sum("l_extendedprice").alias("s"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("t"))
    runs = r.select("variant", "ef", F.lit("vanilla").alias("method"), F.col("a").alias("recall"), F.col("s").alias("seconds")).unionByName(r.select("variant", "ef", F.lit("adaptive").alias("method"), F.col("b").alias("recall"), F.col("t").alias("seconds")))
    return calibrate.ablation(runs).select("variant", "ef", F.round("speedup", 6).alias("speedup"), F.round("loss", 6).alias("loss"))


# --- text embeddings ---

_WORDS = r"w AS (SELECT doc_id, unnest([x for x in regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') if x <> '']) AS word FROM documents)"


@query(f"WITH {_WORDS}, f AS (SELECT word, count(DISTINCT doc_id)::BIGINT AS df FROM w GROUP BY word) SELECT word, df, round(ln(((SELECT count(*) FROM documents) + 1.0::DOUBLE) / (df + 1)) + 1, 6) AS idf FROM f")
def word_idf(spark, sf_dir):
    return text_embedding.idf(table(spark, sf_dir, "documents")).select("word", "df", F.round("idf", 6).alias("idf"))


@query("SELECT doc_id FROM documents JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) USING (doc_id)")
def query_subset(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return datasets.query_subset(docs, labels.where("quality = 1"), "doc_id").select("doc_id")


