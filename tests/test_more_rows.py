"""Queries over more rows or shards than the small tables have."""

import numpy as np
import pytest

from lodestar.operators import coded_walk, evaluate, graph, joined_walk, knn, sparse, stops
from lodestar.plans import factory, queries_indexes, ranked
from lodestar.plans.catalog import QUERIES
from lodestar.sources.shared import clear
from tests.conftest import SMALL


def embeddings(spark, path, n, seed=3):
    """A folder with a table of n vectors around ten centres."""
    random = np.random.default_rng(seed)
    centres = random.normal(size=(10, 64))
    v = centres[np.arange(n) % 10] + 2 * random.normal(size=(n, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    spark.createDataFrame([(i, x.tolist(), i % 10) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.fixture
def three_shards(monkeypatch):
    one = queries_indexes._graph
    monkeypatch.setattr(queries_indexes, "_graph", lambda spark, sf_dir, **options: one(spark, sf_dir, **{"shards": 3, **options}))


def test_adaptive_widths_are_those_of_each_walk(spark, tmp_path, three_shards):
    rows = QUERIES["adaptive_search"](spark, embeddings(spark, tmp_path, 1800)).collect()
    assert len(rows) == 18 and all(r.routed and r.no_more and r.counted for r in rows)
    clear(spark)


def test_traces_are_those_of_each_walk(spark, tmp_path, three_shards):
    rows = QUERIES["adaptive_trace"](spark, embeddings(spark, tmp_path, 600)).collect()
    assert len(rows) == 6 and all(r.in_order and r.ratios and r["mean"] and r.hits for r in rows)
    clear(spark)


def test_three_levels_of_a_million_nodes(spark):
    rows = QUERIES["hnsw_levels"](spark, SMALL).collect()
    assert sorted((r.level, r.about) for r in rows) == [(0, True), (1, True), (2, True)]


#: Searches that are fitted to nine tenths of the hits.
REACH = ["factory_hnsw_pq", "factory_ivf_lsh", "factory_ivf_pq", "factory_ivf_pq_ip", "factory_ivf_pq_refine_sq8", "factory_ivf_prq", "factory_ivf_rabitq", "factory_ivf_rq", "factory_ivf_spectral", "factory_ivf_spectral_refine", "factory_ivf_sq0", "factory_ivf_tqmse2", "factory_ivf_two_stage", "factory_ivf_two_stage_ip", "factory_lsh_refine", "factory_lsh_rotated", "factory_lsq", "factory_opq_narrow", "factory_opq_pq", "factory_pca_flat", "factory_plsq", "factory_pq", "factory_pq_refine", "factory_prq", "factory_prq_ip", "factory_rabitq"]


@pytest.mark.parametrize("name", REACH)
def test_searches_reach_nine_tenths(spark, tmp_path, name):
    row = next(r for r in queries_indexes.FACTORY if r[0] == name)
    [got] = queries_indexes._factory(spark, embeddings(spark, tmp_path, 1500), row[1], 0.9, *row[3:]).collect()
    assert (got.queries, got.hits, got.sound, got.enough) == (15, 150, True, True)
    clear(spark)


@pytest.mark.parametrize("name", ["l2", "ip"])
def test_beams_with_room_for_all_compute_distances_at_once(name, monkeypatch):
    v = np.random.default_rng(5).normal(size=(300, 8))
    g = graph.random_links(graph.build_graph(np.arange(300) * 3, v, name, 4, 16), 3)
    calls = []
    one = graph.Graph.distances
    monkeypatch.setattr(graph.Graph, "distances", lambda self, q, nodes: calls.append(len(nodes)) or one(self, q, nodes))
    for hidden in (-1, 7):
        # a filter that lets all pass takes the way of one candidate after the other
        slow = graph.walk(g, v[7], graph.Walk(k=10, ef=301, allowed=lambda i: True), hidden)
        calls.clear()
        fast = graph.walk(g, v[7], graph.Walk(k=10, ef=301), hidden)
        assert len(calls) < 60
        assert fast["ids"] == slow["ids"] and np.allclose(fast["dists"], slow["dists"])
        assert {k: x for k, x in fast.items() if k not in ("ids", "dists")} == {k: x for k, x in slow.items() if k not in ("ids", "dists")}
        assert hidden >= 0 or fast["nhops"] >= 300


@pytest.mark.parametrize("small", [True, False])
def test_sparse_assignment_makes_no_row_for_each_pair(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(sparse, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(sparse, "GROUP_BLOCKS", 1)
    monkeypatch.setattr(sparse, "ROWS", 16)
    monkeypatch.setattr(sparse, "LISTS", 7)
    dense = np.random.default_rng(2).normal(size=(60, 9)) * (np.random.default_rng(4).random((60, 9)) < 0.4)
    cells = spark.createDataFrame([(i, int(j), float(x)) for i, v in enumerate(dense) for j, x in enumerate(v) if x], "id long, dim int, x double")
    given = cells.where("id < 20").selectExpr("int(id) AS list_no", "dim", "x AS c")
    found = sparse.assign(cells, spark.range(60), given, 20)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "id#" in plan and "dot" not in plan  # sums by row and list
    got, d = {r.id: r for r in found.collect()}, ((dense[:, None] - dense[:20]) ** 2).sum(2)
    assert len(got) == 60
    for i, row in enumerate(d):
        assert got[i].list_no == min(range(20), key=lambda k: (round(row[k], 9), k)) and np.isclose(got[i].dist, row.min())


def near_rows(v, q, qid, k):
    d = ((v - q) ** 2).sum(1)
    return [(i, d[i]) for i in sorted((i for i in range(len(v)) if i != qid), key=lambda i: (d[i], i))[:k]]


def test_what_walks_missed_is_found(spark):
    v = np.random.default_rng(8).normal(size=(200, 6))
    base = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    q = base.where("id < 6").toDF("qid", "qv")
    # poor hits for some queries, too few for one, and none for the last
    poor = [(i, r + 1, 100 + r, float(((v[100 + r] - v[i]) ** 2).sum())) for i in range(5) for r in range(2 if i == 4 else 3)]
    poor = [(i, r, j, d) for i in range(5) for r, (d, j) in enumerate(sorted((d, j) for a, _, j, d in poor if a == i), 1)]
    found = spark.createDataFrame(poor, "qid long, rank int, id long, dist double")
    got = joined_walk.completed(found, q, base, 3, hide_self=True).orderBy("qid", "rank").collect()
    want = [(i, *x) for i in range(6) for x in near_rows(v, v[i], i, 3)]
    assert [(r.qid, r.id) for r in got] == [x[:2] for x in want] and np.allclose([r.dist for r in got], [x[2] for x in want])
    docs = base.selectExpr("id", "id div 4 AS doc")
    rows = joined_walk.completed_documents(found, q, base, docs, 2, hide_self=True).collect()
    for i in range(6):
        order = list(dict.fromkeys(j // 4 for j, _ in near_rows(v, v[i], i, 200)))[:2]
        assert sorted(r.id for r in rows if r.qid == i) == sorted(j for j in range(200) if j // 4 in order and j != i)
    clear(spark)


@pytest.mark.parametrize("name, module", [("joined_walk_hits", joined_walk), ("joined_walk_documents", joined_walk), ("coded_walk_hits", coded_walk)])
def test_beams_are_bounded(spark, monkeypatch, name, module):
    seen, one = [], module.walk

    def walk(q, base, *more, stop=None, **options):
        seen.append(stop.collect if stop else q.agg({"ef": "max"}).first()[0] if "ef" in q.columns else more[3])
        return one(q, base, *more, **({"stop": stop} if stop else {}), **options)

    monkeypatch.setattr(module, "walk", walk)
    assert QUERIES[name](spark, SMALL).count() > 0
    assert seen == [64]
    clear(spark)


def test_candidates_of_walks_widen_until_hits_are_among_them(spark, tmp_path):
    base = queries_indexes.base_of(spark, embeddings(spark, tmp_path, 300))
    index = factory.build(base, "HNSW16,PQ8x3")
    few, more = (ranked.fitted_walk(index, base, 10, reach, ef=10) for reach in (0.3, 0.95))
    assert 1 <= few.wide <= 40 < more.wide <= 300
    truth = knn.knn(base.toDF("qid", "qv"), base, 10)
    r = evaluate.recall(more.search(base.toDF("qid", "qv"), 10), truth, 10).agg({"recall": "avg"}).first()[0]
    assert r >= 0.95
    clear(spark)


def test_what_refining_codes_lose_is_made_up_for(spark, tmp_path):
    base = queries_indexes.base_of(spark, embeddings(spark, tmp_path, 1500))
    q = queries_indexes.queries_of(base)
    index = factory.build(base, "IVF4,PQ8x4,Refine(SQ4)")
    found = ranked.fitted(index, base, 10, 0.8, nprobe=2)
    assert found.part > ranked.fitted(factory.build(base, "IVF4,PQ8x4,Refine(Flat)"), base, 10, 0.8, nprobe=2).part
    kept = {r.id: np.array(r.embedding) for r in index.refining().collect()}
    vectors = {r.qid: np.array(r.qv) for r in q.collect()}
    rows = found.search(q, 10).collect()
    assert len(rows) == 150 and all(np.isclose(r.dist, ((vectors[r.qid] - kept[r.id]) ** 2).sum()) for r in rows)
    clear(spark)


def test_links_are_made_of_bounded_blocks(monkeypatch):
    v = np.random.default_rng(6).normal(size=(300, 8))
    whole = graph.link(v, "cosine", 8, 16)
    cells, one = [], graph._rank_distance

    def counted(vectors, name):
        dist = one(vectors, name)
        return lambda a, b: cells.append(len(a) * len(b)) or dist(a, b)

    monkeypatch.setattr(graph, "_rank_distance", counted)
    monkeypatch.setattr(graph, "CELLS", 1 << 14)
    assert (graph.link(v, "cosine", 8, 16) == whole).all()
    assert max(cells) <= 1 << 14


def test_budgets_follow_what_walks_need(spark, tmp_path, monkeypatch):
    budgets, one = [], graph.search
    monkeypatch.setattr(graph, "search", lambda q, index, w=graph.Walk(), *more: budgets.append(w.budget) or one(q, index, w, *more))
    rows = QUERIES["learned_stops"](spark, embeddings(spark, tmp_path, 1600)).collect()
    assert sorted(r.kind for r in rows) == ["budget", "learned stop", "predicted budget"] and all(r.kept and r.saves for r in rows)
    [budget] = [b for b in budgets if b is not None]
    log = spark.createDataFrame([(i, 0, 10.0 * j, j / 10, True) for i in range(10) for j in range(1, 11) if j != 8 or i < 9], "qid long, shard int, ndis double, recall double, useful boolean")
    assert stops.enough(log, 0.8, 0.9) == 81 and stops.enough(log, 0.8, 0.5) == 80
    assert 150 < budget < 700
    clear(spark)
