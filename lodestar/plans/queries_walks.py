"""Queries of walks that Spark runs as joins, of ends that are learned from logs,
and of k-means over sparse rows."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.operators import coded_walk, evaluate, graph, joined_walk, knn, sparse, stops
from lodestar.operators.blocks import tiles
from lodestar.operators.codecs import RaBitQ
from lodestar.plans import factory
from lodestar.plans.queries_indexes import _COSINE
from lodestar.plans.registry import RESULT, base_of, queries_of, query, result, sql_hits, sql_top, table
from lodestar.sources.shared import materialize, together

#: Neighbours from which links are made.
NEAR = 16


def _near(base, name: str = "cosine"):
    return materialize(knn.knn(base.toDF("qid", "qv"), base, NEAR, name, exclude_self=True), "near")


def _linked(base):
    """Links of all rows to their nearest ones, and entry points."""
    return materialize(joined_walk.links_of(_near(base)), "links"), materialize(joined_walk.entry_points(base), "entries")


#: Rows of a list, lists that a row's neighbours are looked for in, and width and
#: candidates a round of walks whose misses are looked for afterwards.
LIST_ROWS, LISTS, BEAM, AHEAD = 2048, 4, 64, 16


def _linked_by_lists(base, name: str = "cosine"):
    """Links of all rows to near ones, and entry points. Of more rows than that many
    lists hold, near ones are those in the lists next to a row: work that grows as the
    rows, for walks that need no exact links."""
    lists = base.count() // LIST_ROWS
    if lists <= LISTS:
        near = _near(base, name)
    else:
        near = factory.build(base, f"IVF{lists},Flat", name).search(base.toDF("qid", "qv"), NEAR + 1, nprobe=LISTS)
        near = materialize(near.where("qid <> id"), "near")
    return materialize(joined_walk.links_of(near), "links"), materialize(joined_walk.entry_points(base), "entries")


#: Kind of links, how many, width of beams, least recall.
WALKS = (("near", 32, 64, 0.95), ("near, as codes", 16, 24, 0.8), ("random", 16, 24, 0.8))


@query(f"SELECT links, degree, ef, count(*)::BIGINT AS queries, links <> 'random' AS enough, true AS ended FROM embeddings, (VALUES {', '.join(f'({k!r}, {d}, {e})' for k, d, e, _ in WALKS)}) AS t(links, degree, ef) WHERE vec_id % 5 = 0 GROUP BY ALL")
def joined_walk_recall(spark, sf_dir):
    """A fifth of all rows as queries: by 32 links to near rows beams of 64 find
    nineteen of twenty hits; by 16 links and with a byte a component in place of
    vectors, beams of 24 find four of five, which links to random rows don't."""
    base, out = base_of(spark, sf_dir), []
    probes = base.where("id % 5 = 0").toDF("qid", "qv")
    truth = materialize(knn.knn(probes, base, 10, "cosine", exclude_self=True), "truth")
    near, entries = _near(base), materialize(joined_walk.entry_points(base), "entries")
    codes = materialize(factory.build(base, "SQ8", "cosine").kept(), "codes")
    for kind, degree, ef, floor in WALKS:
        links = materialize(joined_walk.random_links(base, degree) if kind == "random" else joined_walk.links_of(near, degree), "links")
        found, log = joined_walk.walk(probes, codes if "codes" in kind else base, links, entries, 10, ef, "cosine", pops=ef // 2, hide_self=True)
        got = evaluate.recall(materialize(found, "found"), truth, 10).agg(F.avg("recall")).first()[0]
        out.append((kind, degree, ef, got >= floor, 1 < len(log) < joined_walk.ROUNDS))
    rows = spark.createDataFrame(out, "links string, degree int, ef int, enough boolean, ended boolean")
    return rows.join(probes.agg(F.count(F.lit(1)).alias("queries")), F.lit(True)).select("links", "degree", "ef", "queries", "enough", "ended")


@query(f"{sql_hits(_COSINE)}, {sql_top()} {RESULT}")
def joined_walk_hits(spark, sf_dir):
    """Walks with a beam of 64, and what they missed: the hits are the nearest rows."""
    base = base_of(spark, sf_dir)
    links, entries = _linked_by_lists(base)
    q = queries_of(base)
    found = materialize(joined_walk.walk(q, base, links, entries, 10, BEAM, "cosine", pops=AHEAD, hide_self=True)[0], "found")
    return result(joined_walk.completed(found, q, base, 10, "cosine", hide_self=True))


@query(f"{sql_hits(_COSINE)} SELECT qid, id, round(dist, 5) AS dist FROM h WHERE dist < 0.72")
def joined_walk_epsilon(spark, sf_dir):
    """Walks that end once nothing nearer than epsilon is left and three quarters of the
    rows have been met: their hits are those of an exact range search."""
    base = base_of(spark, sf_dir)
    links, entries = _linked(base)
    n = base.count()
    found, _ = joined_walk.walk(queries_of(base), base, links, entries, name="cosine", stop=joined_walk.Epsilon(0.72, 3 * n // 4, n), pops=32, hide_self=True)
    return found.select("qid", "id", F.round("dist", 5).alias("dist"))


@query(f"""{sql_hits(_COSINE)}, d AS (SELECT qid, id // 4 AS doc, min(dist) AS near FROM h GROUP BY ALL),
    p AS (SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY near, doc) AS place FROM d)
    SELECT h.qid, h.id, round(h.dist, 5) AS dist FROM h JOIN p ON p.qid = h.qid AND p.doc = h.id // 4 WHERE place <= 5""")
def joined_walk_documents(spark, sf_dir):
    """Walks that count documents, of four rows each, and what they missed: all rows
    of a query's five nearest documents, by each one's nearest row."""
    base = base_of(spark, sf_dir)
    links, entries = _linked_by_lists(base)
    q, of = queries_of(base), base.select("id", F.floor(F.col("id") / 4).alias("doc"))
    found, _ = joined_walk.walk(q, base, links, entries, name="cosine", stop=joined_walk.Documents(of, 5, BEAM), pops=AHEAD, hide_self=True)
    rows = joined_walk.completed_documents(materialize(found, "found"), q, base, of, 5, "cosine", hide_self=True)
    return rows.select("qid", "id", F.round("dist", 5).alias("dist"))


# --- walks over codes ---

@query(f"{sql_hits()}, {sql_top()} {RESULT}")
def coded_walk_hits(spark, sf_dir):
    """Walks by estimates from codes of two bits with certain bounds, whose pools are
    measured by vectors, and what they missed: the hits are the nearest rows."""
    base = base_of(spark, sf_dir)
    links, entries = _linked_by_lists(base, "l2")
    codes, q = coded_walk.coded(base, RaBitQ.train(base, 2), None), queries_of(base)
    found = materialize(coded_walk.walk(q.withColumn("ef", F.lit(BEAM)), base, codes, links, entries, 10, pops=AHEAD, hide_self=True)[0], "found")
    return result(joined_walk.completed(found, q, base, 10, hide_self=True))


#: Bits of a component whose estimates are held against distances.
CODE_BITS = (1, 2, 4, 8)


@query(f"WITH q AS (SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0) SELECT bits, count(*)::BIGINT AS pairs, true AS within, true AS mostly, true AS falls FROM q, embeddings b, (VALUES {', '.join(f'({b})' for b in CODE_BITS)}) AS t(bits) GROUP BY bits")
def code_estimates(spark, sf_dir):
    """Estimates of all distances of the query set by 1 to 8 bits a component: none
    is farther off than the certain bound, nine of ten lie within the probable one,
    and twice the bits have less than the error of half."""
    base = base_of(spark, sf_dir)
    codecs = {bits: RaBitQ.train(base, bits) for bits in CODE_BITS}
    kinds = "bits int, pairs long, within long, mostly long, off double"

    def kernel(qids, q, ids, b):
        import numpy as np

        exact = ((q * q).sum(1)[:, None] + (b * b).sum(1) - 2 * (q @ b.T)).clip(0)
        out = []
        for bits, codec in codecs.items():
            codes = codec.encode(b)
            off = np.abs(codec.estimate(q, codes) - exact)
            bound = 2 * np.linalg.norm(q - codec.center, axis=1)[:, None] * coded_walk.slack(codes, None)
            out.append((bits, off.size, int((off <= bound + 1e-6).sum()), int((off <= bound * coded_walk.share(b.shape[1], 1.9) + 1e-6).sum()), float(off.sum())))
        return dict(zip(("bits", "pairs", "within", "mostly", "off"), map(np.array, zip(*out))))

    sums = tiles(queries_of(base), base, kernel, kinds).groupBy("bits").agg(*(F.sum(c).alias(c) for c in ("pairs", "within", "mostly", "off")))
    error = F.col("off") / F.col("pairs")
    falls = F.coalesce(error < F.lag(error).over(Window.orderBy("bits")), F.lit(True))  # four rows
    return sums.select("bits", "pairs", (F.col("within") == F.col("pairs")).alias("within"), (F.col("mostly") >= 0.9 * F.col("pairs")).alias("mostly"), falls.alias("falls"))


#: Widths whose policy is calibrated over codes and over vectors, and their routes.
CODED_EFS = (24, 48)


@query(f"SELECT ef, j - 1 AS route_idx, ef * j // 4 AS route_ef, count(*)::BIGINT AS queries, true AS differs, true AS kept, true AS narrower FROM embeddings, (VALUES {', '.join(f'({e})' for e in CODED_EFS)}) AS t(ef), (VALUES (1), (2), (3)) AS r(j) WHERE vec_id % 10 = 5 GROUP BY ALL")
def coded_walk_policy(spark, sf_dir):
    """Thresholds calibrated for walks over codes of one bit: they differ from those
    of exact distances by over a hundredth; walks of a tenth of all rows under them
    keep the part of the hits that the policy was calibrated for, nine of ten of what
    whole walks find, and some are narrowed."""
    base = base_of(spark, sf_dir)
    near = materialize(knn.knn(base.toDF("qid", "qv"), base, 20, "l2", exclude_self=True), "near")
    links, entries = materialize(joined_walk.links_of(near.where(F.col("rank") <= NEAR)), "links"), materialize(joined_walk.entry_points(base), "entries")
    kinds = {"codes": coded_walk.coded(base, RaBitQ.train(base, 1)), "vectors": coded_walk.uncoded(base)}
    calibrated = together(*(partial(coded_walk.calibrated, base, codes, links, entries, near, CODED_EFS, n_probes=50) for codes in kinds.values()))
    policies = {kind: out["policy"] for kind, out in zip(kinds, calibrated)}
    q = base.where("id % 10 = 5").select(F.col("id").alias("qid"), F.col("embedding").alias("qv"), F.explode(F.array(*map(F.lit, CODED_EFS))).alias("ef"))
    found, log = coded_walk.walks(q, base, kinds["codes"], links, entries, 10, [None, policies["codes"]], hide_self=True)
    found, runs = materialize(found, "found"), {}
    for way, kind in enumerate(("whole", "routed")):
        hits, did = (rows.where(F.col("way") == way).drop("way") for rows in (found, log))
        r = coded_walk.recalls(hits, q, near, 10).join(did, ["qid", "ef"])
        runs[kind] = r.groupBy("ef").agg(F.count(F.lit(1)).alias("queries"), F.avg("recall").alias(f"{kind}_recall"), F.count_if(F.col("effective_ef") < F.col("ef")).alias(f"{kind}_narrowed"))
    both = runs["routed"].join(runs["whole"].drop("queries"), "ef")
    vectors = policies["vectors"].select("ef", "route_idx", F.col("theta").alias("vectors_theta"))
    rows = policies["codes"].join(vectors, ["ef", "route_idx"]).join(both, "ef")
    differs = F.abs(F.col("theta") - F.col("vectors_theta")) > 0.01
    return rows.select("ef", "route_idx", "route_ef", "queries", differs.alias("differs"), (F.col("routed_recall") >= 0.9 * F.col("whole_recall")).alias("kept"), (F.col("routed_narrowed") > 0).alias("narrower"))


# --- ends that are learned ---

def _log(spark, sf_dir, shards: int = 2):
    """Logs of walks of all rows over all shards, half to learn from and half held
    out."""
    base = base_of(spark, sf_dir)
    index = materialize(graph.build(base, "cosine", shards=shards), "graph")
    probes = base.toDF("qid", "qv")
    truth = materialize(knn.knn(probes, base, 10, "cosine", exclude_self=True), "truth")
    log = materialize(stops.walk_log(probes, index, truth, graph.Walk(k=10, ef=64, hide_self=True)), "log")
    return base, index, truth, log.where("qid % 2 = 0"), log.where("qid % 2 = 1")


@query("SELECT target, count(*)::BIGINT * 2 AS walks, true AS kept, true AS saves FROM embeddings, (VALUES (0.9::DOUBLE), (0.95::DOUBLE)) AS t(target) WHERE vec_id % 2 = 1 GROUP BY target")
def offline_stops(spark, sf_dir):
    """Boosted trees over the logs of even rows, asked at intervals tuned by label,
    end the walks of odd rows: the part of the hits kept reaches the target less a
    twentieth, and at least a tenth of the distances is saved."""
    _, _, _, train, held = _log(spark, sf_dir)
    groups = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), F.coalesce("label", F.lit(-1)).alias("group"))
    model, out = stops.train_trees(train), None
    for target in (0.9, 0.95):
        when = stops.intervals(train, target, groups)
        ends = stops.replayed(held, model, when, target, groups)
        row = stops.saved(ends).join(ends.agg(F.count(F.lit(1)).alias("walks")), F.lit(True)).select(F.lit(target).alias("target"), "walks", (F.col("kept") >= target - 0.05).alias("kept"), (F.col("saved") >= 0.1).alias("saves"))
        out = row if out is None else out.unionAll(row)
    return out


@query("SELECT 'budget' AS kind, count(*)::BIGINT * 2 AS walks, true AS follows, true AS kept, true AS saves FROM embeddings WHERE vec_id % 2 = 1 UNION ALL SELECT 'inside the walk', count(*)::BIGINT * 2, true, true, true FROM embeddings WHERE vec_id % 2 = 1")
def trained_budgets(spark, sf_dir):
    """A model of the distances needed, asked after 80: on held-out rows its budgets
    rise with what walks needed (correlation over a fifth), and one and a half times
    them keep nine of ten hits and save a fifth of the distances; so does the model
    inside new walks."""
    base, index, truth, train, held = _log(spark, sf_dir)
    fit, _ = stops.train_budget(train, 80.0, 0.8)
    given = materialize(stops.budgets(held, fit, 80.0), "budgets")
    follows = given.join(stops.needed(held, 0.8), ["qid", "shard"]).agg((F.corr("budget", "needed") > 0.2).alias("follows"))
    ends = stops.within_budgets(held, given.withColumn("budget", F.col("budget") * 1.5))
    one = stops.saved(ends).join(ends.agg(F.count(F.lit(1)).alias("walks")), F.lit(True)).join(follows, F.lit(True)).select(F.lit("budget").alias("kind"), "walks", "follows", (F.col("kept") >= 0.9).alias("kept"), (F.col("saved") >= 0.2).alias("saves"))
    inside = stops.budget_of(fit.coefficients.toArray().tolist(), float(fit.intercept), 1.5)
    q = base.where("id % 2 = 1").toDF("qid", "qv")
    walks = materialize(graph.search(q, index, graph.Walk(k=10, ef=64, hide_self=True, after=80, predict=inside)), "walks")
    whole = materialize(graph.search(q, index, graph.Walk(k=10, ef=64, hide_self=True)), "whole")
    kept = evaluate.recall(graph.hits(walks, 10, "cosine"), graph.hits(whole, 10, "cosine"), 10).agg((F.avg("recall") >= 0.9).alias("kept"))
    n = walks.agg(F.count(F.lit(1)).alias("walks"), F.sum("ndis").alias("ndis")).join(whole.agg(F.sum("ndis").alias("all")), F.lit(True))
    two = n.join(kept, F.lit(True)).join(follows, F.lit(True)).select(F.lit("inside the walk").alias("kind"), "walks", "follows", "kept", (F.col("ndis") <= 0.8 * F.col("all")).alias("saves"))
    return one.unionAll(two)


# --- sparse k-means ---

_SPARSE = "v AS (SELECT vec_id AS id, [CASE WHEN x > 0.1 THEN x::DOUBLE ELSE 0 END for x in embedding] AS e FROM embeddings), c0 AS (SELECT (id // 50)::INT AS list_no, e AS c FROM v WHERE id % 50 = 7)"


def _dense_step(i: int) -> str:
    d = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(e, c)])"
    return f"""a{i} AS (SELECT * FROM (SELECT id, e, list_no, {d} AS dist, row_number() OVER (PARTITION BY id ORDER BY round({d}, 12), list_no) AS k FROM v, c{i}) WHERE k = 1),
    m{i} AS (SELECT list_no, list(x ORDER BY dim) AS c FROM (SELECT list_no, dim, avg(x) AS x FROM (SELECT list_no, generate_subscripts(e, 1) AS dim, unnest(e) AS x FROM a{i}) GROUP BY ALL) GROUP BY list_no),
    c{i + 1} AS (SELECT c{i}.list_no, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (list_no))"""


@query(f"WITH {_SPARSE}, {_dense_step(0)}, {_dense_step(1)}, {_dense_step(2)} SELECT id, list_no, round(dist, 5) AS dist FROM a2")
def sparse_kmeans(spark, sf_dir):
    """Components over a tenth as sparse rows, in lists after two rounds from given
    rows: those of k-means over the same rows with zeros."""
    s = F.filter(F.transform("embedding", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"] > 0.1)
    rows = base_of(spark, sf_dir).select("id", s.alias("s")).select("id", F.col("s.i").alias("indices"), F.col("s.x").alias("values"))
    start = rows.where("id % 50 = 7")
    given = sparse.entries(start).select(F.floor(F.col("id") / 50).cast("int").alias("list_no"), "dim", F.col("x").alias("c"))
    _, found = sparse.kmeans(rows, given, start.agg(F.max(F.floor(F.col("id") / 50)) + 1).first()[0], 2)
    return found.select("id", "list_no", F.round("dist", 5).alias("dist"))
