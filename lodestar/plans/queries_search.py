"""Queries of exact searches, filters, merges and vector functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import vectors
from lodestar.functions.metrics import distance, generalized_hamming, l2_from_ip, norm
from lodestar.operators import filters, knn, merge
from lodestar.plans.registry import L2, RESULT, VECTORS, base_of, queries_of, query, result, sql_hits, sql_sum, sql_top, table

# --- nearest neighbours by each metric ---

_ABS = "v AS (SELECT vec_id AS id, [abs(x::DOUBLE) + 0.001 for x in embedding] AS v, label FROM embeddings), q AS (SELECT id AS qid, v, label FROM v WHERE id % 100 = 0)"
_NANS = "v AS (SELECT vec_id AS id, [CASE WHEN abs(x) < 0.02 THEN 'nan'::DOUBLE ELSE x::DOUBLE END for x in embedding] AS v, label FROM embeddings), q AS (SELECT id AS qid, v, label FROM v WHERE id % 100 = 0)"
_PRESENT = "[z for z in list_zip(q.v, b.v) if NOT isnan(z[1]) AND NOT isnan(z[2])]"

#: Name: how vectors are changed first, Lp's power, SQL of the distance, SQL of the vectors.
_METRICS = {
    "l2": (None, None, L2, VECTORS),
    "ip": (None, None, sql_sum("z[1] * z[2]"), VECTORS),
    "ip_distance": (None, None, f"1 - {sql_sum('z[1] * z[2]')}", VECTORS),
    "cosine": (None, None, f"1 - {sql_sum('z[1] * z[2]')} / (sqrt({sql_sum('z[1] * z[2]', 'q.v', 'q.v')}) * sqrt({sql_sum('z[1] * z[2]', 'b.v', 'b.v')}))", VECTORS),
    "l1": (None, None, sql_sum("abs(z[1] - z[2])"), VECTORS),
    "linf": (None, None, "list_max([abs(z[1] - z[2]) for z in list_zip(q.v, b.v)])", VECTORS),
    "lp": (None, 3.0, sql_sum("pow(abs(z[1] - z[2]), 3)"), VECTORS),
    "canberra": (None, None, sql_sum("abs(z[1] - z[2]) / (abs(z[1]) + abs(z[2]))"), VECTORS),
    "braycurtis": ("abs", None, f"{sql_sum('abs(z[1] - z[2])')} / {sql_sum('abs(z[1] + z[2])')}", _ABS),
    "jensenshannon": ("abs", None, f"{sql_sum('-z[1] * ln((z[1] + z[2]) / 2 / z[1]) - z[2] * ln((z[1] + z[2]) / 2 / z[2])')} / 2", _ABS),
    "jaccard": ("abs", None, f"{sql_sum('least(z[1], z[2])')} / {sql_sum('greatest(z[1], z[2])')}", _ABS),
    "nan_euclidean": ("nan", None, f"64.0::DOUBLE / len({_PRESENT}) * list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in {_PRESENT}])", _NANS),
    "gower": ("abs", None, f"{sql_sum('abs(z[1] - z[2])')} / 64", _ABS),
}


def _changed(base, how: str | None):
    x = {"abs": lambda x: F.abs(x.cast("double")) + 0.001, "nan": lambda x: F.when(F.abs(x) < F.lit(0.02).cast("float"), F.lit(float("nan"))).otherwise(x.cast("double"))}.get(how)
    return base.withColumn("embedding", F.transform("embedding", x)) if x else base


def _metric_query(metric: str, how: str | None, p: float | None):
    def run(spark, sf_dir):
        base = _changed(base_of(spark, sf_dir), how)
        return result(knn.knn(queries_of(base), base, 10, metric, p, exclude_self=True))

    return run


for _n, (_how, _p, _sql, _vectors) in _METRICS.items():
    query(f"{sql_hits(_sql, vectors=_vectors.replace('< 0.02', '< 0.02::FLOAT'))}, {sql_top(10, _n in ('ip', 'jaccard'))} {RESULT}", f"exact_knn_{_n}")(_metric_query(_n, _how, _p))


@query(f"""WITH {VECTORS}, q2 AS (SELECT * FROM q), p AS (SELECT q.qid AS ix, b.id AS iy, q.v AS x, b.v AS y FROM q JOIN v b ON b.id = (q.qid * 7 + 13) % (SELECT count(*) FROM v))
SELECT ix, iy, round({sql_sum('(z[1] - z[2]) * (z[1] - z[2])', 'x', 'y')}, 6) AS l2, round({sql_sum('z[1] * z[2]', 'x', 'y')}, 6) AS ip,
round({sql_sum('z[1] * z[1]', 'x', 'y')} + {sql_sum('z[2] * z[2]', 'x', 'y')} - 2 * {sql_sum('z[1] * z[2]', 'x', 'y')}, 6) AS l2_by_norms,
round({sql_sum('abs(z[1] - z[2])', 'x', 'y')}, 6) AS l1, list_max([abs(z[1] - z[2]) for z in list_zip(x, y)]) AS linf,
round({sql_sum('pow(abs(z[1] - z[2]), 3)', 'x', 'y')}, 6) AS lp3, round({sql_sum('abs(z[1] - z[2]) / (abs(z[1]) + abs(z[2]))', 'x', 'y')}, 6) AS canberra FROM p""")
def pair_metrics(spark, sf_dir):
    """Column forms of the metrics on a pair for each query."""
    base = base_of(spark, sf_dir)
    n = base.count()
    pairs = queries_of(base).select(F.col("qid").alias("ix"), ((F.col("qid") * 7 + 13) % n).alias("iy"))
    rows = pairs.join(base.toDF("ix", "x"), "ix").join(base.toDF("iy", "y"), "iy")
    x, y = F.col("x"), F.col("y")
    d = lambda m, p=None: F.round(distance(m, x, y, p), 6)
    by_norms = l2_from_ip(norm(x) * norm(x), norm(y) * norm(y), distance("ip", x, y))
    return rows.select("ix", "iy", d("l2").alias("l2"), d("ip").alias("ip"), F.round(by_norms, 6).alias("l2_by_norms"), d("l1").alias("l1"), distance("linf", x, y).alias("linf"), d("lp", 3.0).alias("lp3"), d("canberra").alias("canberra"))


# --- filters ---

@query(f"{sql_hits(where='b.id <> q.qid AND b.id >= 100 AND b.id < 400')}, {sql_top()} {RESULT}")
def knn_in_id_range(spark, sf_dir):
    base = base_of(spark, sf_dir)
    return result(knn.knn(queries_of(base), base.where(filters.in_range(F.col("id"), 100, 400)), 10, exclude_self=True))


@query(f"{sql_hits(where='b.id <> q.qid AND (b.label IN (1, 3, 5)) AND NOT (b.id % 8 IN (0, 1) AND b.id < 256)')}, {sql_top()} {RESULT}")
def knn_with_selectors(spark, sf_dir):
    """A list selector and the complement of a bitmap of bits 0 and 1 of each byte."""
    base = base_of(spark, sf_dir, "label")
    keep = filters.in_list(F.col("label"), [1, 3, 5]) & ~filters.in_bitmap(F.col("id"), b"\x03" * 32)
    return result(knn.knn(queries_of(base), base.where(filters.check_selector(keep)).select("id", "embedding"), 10, exclude_self=True))


@query(f"{sql_hits(where='b.label <> q.label')}, {sql_top(5)} {RESULT}")
def knn_by_lists(spark, sf_dir):
    """Each query searches a list of ids of its own: rows of other labels."""
    base = base_of(spark, sf_dir, "label")
    q = base.where(F.col("id") % 100 == 0).select(F.col("id").alias("qid"), F.col("label").alias("own"))
    by_label = base.select("label", "id")
    lists = q.join(by_label.select("label").distinct(), q["own"] != F.col("label")).join(by_label, "label").groupBy("qid").agg(F.collect_list("id").alias("ids"))
    vecs = base.select("id", "embedding")
    return result(knn.knn_by_id(queries_of(vecs), vecs, lists, 5))


@query("SELECT count(*)::BIGINT AS n, min(vec_id) AS least, sum(vec_id)::BIGINT AS total, max(vec_id) AS most FROM embeddings WHERE label <> 3")
def remove_ids(spark, sf_dir):
    base = base_of(spark, sf_dir, "label")
    left = filters.removed(base, base.where("label = 3").select("id"))
    return left.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.sum("id").alias("total"), F.max("id").alias("most"))


@query("SELECT vec_id AS id, (row_number() OVER (ORDER BY vec_id) - 1)::BIGINT AS new_id FROM embeddings WHERE label <> 3")
def remove_and_renumber(spark, sf_dir):
    base = table(spark, sf_dir, "embeddings").where("label <> 3").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("old"))
    return filters.renumbered(base).select(F.col("old").alias("id"), F.col("id").alias("new_id"))


@query("SELECT vec_id AS id, label = 2 AS deleted FROM embeddings")
def mark_deleted(spark, sf_dir):
    base = base_of(spark, sf_dir, "label").select("id", "label")
    return filters.marked_deleted(base, base.where("label = 2").select("id")).select("id", "deleted")


@query("SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN label + 100 ELSE label END AS label FROM embeddings")
def upsert(spark, sf_dir):
    base = base_of(spark, sf_dir, "label").select("id", "label")
    return filters.upserted(base, base.where("id % 5 = 0").withColumn("label", F.col("label") + 100))


# --- radius searches ---

@query(f"{sql_hits()} SELECT qid, id, round(dist, 5) AS dist FROM h WHERE dist < 1.4")
def range_l2(spark, sf_dir):
    base = base_of(spark, sf_dir)
    return knn.range_search(queries_of(base), base, 1.4, exclude_self=True).select("qid", "id", F.round("dist", 5).alias("dist"))


@query(f"{sql_hits(sql_sum('z[1] * z[2]'))} SELECT qid, id, round(dist, 5) AS dist FROM h WHERE dist > 0.25")
def range_ip(spark, sf_dir):
    base = base_of(spark, sf_dir)
    return knn.range_search(queries_of(base), base, 0.25, "ip", exclude_self=True).select("qid", "id", F.round("dist", 5).alias("dist"))


@query(f"{sql_hits()}, w AS (SELECT * FROM h WHERE dist < 1.6), t AS (SELECT dist FROM w ORDER BY dist LIMIT 201), c AS (SELECT count(*) AS n, max(dist) AS m FROM t) SELECT qid, id, round(dist, 5) AS dist FROM w, c WHERE n <= 200 OR dist < m")
def range_within_budget(spark, sf_dir):
    """A radius that leaves no more than 200 hits."""
    base = base_of(spark, sf_dir)
    hits, _ = knn.within_budget(knn.range_search(queries_of(base), base, 1.6, exclude_self=True), 200)
    return hits.select("qid", "id", F.round("dist", 5).alias("dist"))


# --- assignment, lines, padding, reconstruction ---

@query(f"{sql_hits(where='b.id <> q.qid AND b.label = 0')}, {sql_top(1)} SELECT qid, id, round(dist, 5) AS dist FROM r")
def assign_to_label(spark, sf_dir):
    base = base_of(spark, sf_dir, "label")
    to = base.where("label = 0").select("id", "embedding")
    q = queries_of(base.select("id", "embedding"))
    # a query that is one of the targets looks at the others
    other = knn.knn(q, to, 1, exclude_self=True)
    return other.select("qid", "id", F.round("dist", 5).alias("dist"))


@query("WITH p AS (SELECT p_partkey AS id, p_retailprice AS x FROM part), q AS (SELECT c_custkey AS qid, abs(c_acctbal) AS x FROM customer), h AS (SELECT qid, (SELECT max(x) FROM p WHERE p.x <= q.x) AS below, (SELECT min(x) FROM p WHERE p.x >= q.x) AS above, x FROM q), b AS (SELECT qid, CASE WHEN below IS NULL OR above - x < x - below THEN above ELSE below END AS y, x FROM h) SELECT qid, (SELECT min(id) FROM p WHERE p.x = b.y) AS id, round(abs(x - y), 5) AS dist FROM b")
def nearest_scalar(spark, sf_dir):
    """The part whose price is nearest to each customer's balance."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("x"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("qid"), F.abs("c_acctbal").alias("x"))
    return knn.nearest_on_line(customer, part).select("qid", "id", F.round("dist", 5).alias("dist"))


@query(f"{sql_hits(where='b.id <> q.qid AND b.label = q.label AND b.id < 200')}, {sql_top()}, s AS (SELECT qid, rank::INT AS rank FROM q, range(1, 11) t(rank)) SELECT s.qid, s.rank, coalesce(r.id, -1) AS id, coalesce(round(r.dist, 5), 'inf'::DOUBLE) AS dist FROM s LEFT JOIN r USING (qid, rank)")
def padded_knn(spark, sf_dir):
    """Rows of the query's label with small ids: fewer than k hits, padded."""
    base = base_of(spark, sf_dir, "label")
    q = base.where(F.col("id") % 100 == 0).select(F.col("id").alias("qid"), "label")
    lists = q.join(base.where("id < 200").select("label", "id"), "label").where("id <> qid").groupBy("qid").agg(F.collect_list("id").alias("ids"))
    vecs = base.select("id", "embedding")
    found = knn.knn_by_id(queries_of(vecs), vecs, lists, 10)
    return result(knn.padded(found, queries_of(vecs), 10))


@query(f"{sql_hits()}, {sql_top(3)} SELECT r.qid, r.rank, r.id, round(list_sum(v.v), 4) AS component_sum FROM r JOIN v ON v.id = r.id")
def search_and_reconstruct(spark, sf_dir):
    base = base_of(spark, sf_dir)
    out = knn.reconstructed(knn.knn(queries_of(base), base, 3, exclude_self=True), base)
    return out.select("qid", "rank", "id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("component_sum"))


# --- binary codes ---

_BITS = f"{sql_hits(sql_sum('CASE WHEN (z[1] > 0) <> (z[2] > 0) THEN 1 ELSE 0 END') + '::DOUBLE')}"


@query(f"{_BITS}, {sql_top()} SELECT qid, rank, id, dist FROM r")
def hamming_knn(spark, sf_dir):
    """Nearest sign codes."""
    codes = base_of(spark, sf_dir).select("id", vectors.sign_words(F.col("embedding")).alias("embedding"))
    return knn.knn(queries_of(codes), codes, 10, knn.HAMMING, exclude_self=True)


@query(f"{_BITS} SELECT qid, count(*)::BIGINT AS n FROM h WHERE dist <= 28 GROUP BY qid")
def hamming_count(spark, sf_dir):
    codes = base_of(spark, sf_dir).select("id", vectors.sign_words(F.col("embedding")).alias("embedding"))
    found = knn.range_search(queries_of(codes), codes, 29, knn.HAMMING, exclude_self=True)
    return found.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {VECTORS} SELECT q.qid, list_sum([CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END for z in list_zip([floor((x + 1) * 8)::INT for x in q.v], [floor((x + 1) * 8)::INT for x in b.v])])::INT AS differ FROM q JOIN v b ON b.id = q.qid + 1")
def generalized_hamming_pairs(spark, sf_dir):
    levels = base_of(spark, sf_dir).select("id", F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 8).cast("int")).alias("c"))
    a, b = levels.where("id % 100 = 0").toDF("qid", "x"), levels.select((F.col("id") - 1).alias("qid"), F.col("c").alias("y"))
    return a.join(b, "qid").select("qid", generalized_hamming(F.col("x"), F.col("y")).alias("differ"))


@query(f"{sql_hits('4 * ' + sql_sum('CASE WHEN (z[1] > 0) <> (z[2] > 0) THEN 1 ELSE 0 END') + '::DOUBLE')}, {sql_top()} SELECT qid, rank, id, dist FROM r")
def binary_from_float(spark, sf_dir):
    """Sign codes as vectors of -1 and 1 under L2."""
    signs = base_of(spark, sf_dir).select("id", vectors.bits_to_signs(vectors.sign_words(F.col("embedding")), 64).alias("embedding"))
    return knn.knn(queries_of(signs), signs, 10, exclude_self=True)


# --- merges ---

@query(f"{sql_hits()}, {sql_top()} {RESULT}")
def merged_shards(spark, sf_dir):
    """Four shards searched apart and merged."""
    base = base_of(spark, sf_dir)
    q = queries_of(base)
    return result(merge.merge_results([knn.knn(q, base.where(F.col("id") % 4 == i), 10, exclude_self=True) for i in range(4)], 10))


@query(f"{sql_hits()}, g AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY dist, id) AS nth FROM h), {sql_top(10, source='(SELECT * FROM g WHERE nth <= 2)')} {RESULT}")
def diverse_knn(spark, sf_dir):
    """At most two hits of each label."""
    base = base_of(spark, sf_dir, "label")
    vecs = base.select("id", "embedding")
    return result(merge.diverse(queries_of(vecs), base, 10, 2, exclude_self=True))


@query(f"{sql_hits()}, d AS (SELECT qid, label::BIGINT AS id, min(dist) AS dist FROM h GROUP BY qid, label), {sql_top(4, source='d')} {RESULT}")
def multi_vector_documents(spark, sf_dir):
    """Labels as documents of many vectors: the nearest by their best vector."""
    base = base_of(spark, sf_dir, "label")
    vecs = base.select("id", "embedding")
    return result(merge.best_documents(queries_of(vecs), base, 4, exclude_self=True))


@query(f"{sql_hits()}, {sql_top(5)} SELECT qid, rank, id * 10 + 1 AS id, round(dist, 5) AS dist FROM r")
def external_ids(spark, sf_dir):
    base = base_of(spark, sf_dir)
    found = knn.knn(queries_of(base), base, 5, exclude_self=True)
    return result(merge.external_ids(found, base.select("id", (F.col("id") * 10 + 1).alias("external"))))


@query("WITH g AS (SELECT label, min(vec_id) AS representative FROM embeddings GROUP BY label) SELECT vec_id AS id, label, vec_id = representative AS inserted FROM embeddings JOIN g USING (label)")
def code_set_inserts(spark, sf_dir):
    base = base_of(spark, sf_dir, "label").select("id", "label")
    return merge.first_of_each(base, "label").select("id", "label", "inserted")


@query("SELECT min(doc_id) OVER (PARTITION BY text) AS representative, doc_id AS id FROM documents")
def duplicate_groups(spark, sf_dir):
    """Equal values collapse to the one of least id, as equal vectors do."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.struct("text").alias("embedding"))
    return merge.duplicate_groups(docs)


@query(f"""WITH {VECTORS}, h AS (SELECT q.qid, b.id, {sql_sum('(z[1] - z[2]) * (z[1] - z[2])', 'q.v[1:32]', 'b.v[1:32]')} AS d1, {sql_sum('(z[1] - z[2]) * (z[1] - z[2])', 'q.v[33:64]', 'b.v[33:64]')} AS d2 FROM q JOIN v b ON true),
a AS (SELECT qid, arg_min(id, (d1, id)) AS i1, min(d1) AS d1 FROM h GROUP BY qid), b AS (SELECT qid, arg_min(id, (d2, id)) AS i2, min(d2) AS d2 FROM h GROUP BY qid)
SELECT qid, (i1 + i2 * (SELECT count(*) FROM v))::BIGINT AS id, round(d1 + d2, 5) AS dist FROM a JOIN b USING (qid)""")
def split_vectors(spark, sf_dir):
    base = base_of(spark, sf_dir)
    part = lambda a: base.select("id", F.slice("embedding", a + 1, 32).alias("embedding"))
    return merge.split_search(queries_of(base), [(part(0), 0, 32), (part(32), 32, 64)]).select("qid", "id", F.round("dist", 5).alias("dist"))


# --- functions ---

@query("WITH x AS (SELECT generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT dim::INT AS dim, count(*)::BIGINT AS n, min(x) AS least, max(x) AS most, round(avg(x), 8) AS mean, round(stddev_pop(x), 8) AS stddev, count(*) FILTER (isnan(x))::BIGINT AS n_nan, count(*) FILTER (isinf(x))::BIGINT AS n_inf, count(*) FILTER (x = 0)::BIGINT AS n_zero FROM x GROUP BY dim")
def matrix_stats(spark, sf_dir):
    out = vectors.matrix_stats(base_of(spark, sf_dir))
    return out.select("dim", "n", "least", "most", F.round("mean", 8).alias("mean"), F.round("stddev", 8).alias("stddev"), "n_nan", "n_inf", "n_zero")


@query("WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT id, v, sqrt(list_sum([x * x for x in v])) AS n FROM v) SELECT id, round(list_sum([x / n for x in v]), 6) AS unit_sum, (list_position(v, list_min(v)) - 1)::INT AS argmin, round(list_max(v), 6) AS most FROM m")
def vector_functions(spark, sf_dir):
    v = F.col("embedding")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return base_of(spark, sf_dir).select("id", F.round(total(vectors.l2_normalise(v)), 6).alias("unit_sum"), vectors.argmin(v).alias("argmin"), F.round(F.array_max(v).cast("double"), 6).alias("most"))


@query("WITH x AS (SELECT vec_id AS id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS value FROM embeddings) SELECT id, nth::INT AS nth, pos::INT AS pos, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY value, pos) AS nth FROM x) WHERE nth <= 3")
def k_smallest_components(spark, sf_dir):
    rows = base_of(spark, sf_dir).select("id", F.posexplode(vectors.k_smallest(F.col("embedding"), 3)).alias("nth", "c"))
    return rows.select("id", (F.col("nth") + 1).alias("nth"), F.col("c.pos").alias("pos"), F.col("c.value").cast("double").alias("value"))


@query("SELECT o_orderkey, coalesce(c_nationkey, -1)::INT AS nation FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON o_custkey = c_custkey")
def id_map_lookup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    known = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"))
    return vectors.id_lookup(orders, known, value="nation").select("o_orderkey", "nation")


@query("WITH f AS (SELECT o_orderkey, [o_orderkey % 16, o_custkey % 16, (o_orderkey + o_custkey) % 16]::BIGINT[] AS f FROM orders) SELECT o_orderkey, (f[1] + f[2] * 16) || ' ' || f[3] AS packed_bytes, f[1] || ' ' || f[2] || ' ' || f[3] AS unpacked FROM f")
def bit_fields(spark, sf_dir):
    """Fields of four bits packed into bytes and back."""
    fields = F.array((F.col("o_orderkey") % 16), F.col("o_custkey") % 16, (F.col("o_orderkey") + F.col("o_custkey")) % 16)
    out = table(spark, sf_dir, "orders").select("o_orderkey", vectors.pack_bits(fields, 4).alias("packed"))
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), " ")
    return out.select("o_orderkey", text("packed").alias("packed_bytes"), text(vectors.unpack_bits(F.col("packed"), 4, 3)).alias("unpacked"))
