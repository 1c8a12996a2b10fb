import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import calibrate, evaluate, graph, knn
from lodestar.plans import sweep
from tests.test_search import frame

RANDOM = np.random.default_rng(11)
VECTORS = RANDOM.normal(size=(400, 12))
G = graph.build_graph(np.arange(400), VECTORS, "l2", 8, 48)
QUERIES = RANDOM.normal(size=(20, 12))
TRUTH = [set(np.argsort(((VECTORS - q) ** 2).sum(1), kind="stable")[:10].tolist()) for q in QUERIES]


def recall(w):
    return np.mean([len(TRUTH[i] & set(graph.walk(G, q, w)["ids"])) / 10 for i, q in enumerate(QUERIES)])


def test_recall_and_order():
    assert recall(graph.Walk(k=10, ef=128)) >= 0.95
    found = graph.walk(G, QUERIES[0], graph.Walk(k=10, ef=64))
    assert found["dists"] == sorted(found["dists"])
    assert np.allclose(found["dists"], ((VECTORS[found["ids"]] - QUERIES[0]) ** 2).sum(1))


def test_nan_tau_is_vanilla():
    for q in QUERIES:
        a, b = graph.walk(G, q, graph.Walk(ef=64)), graph.walk(G, q, graph.Walk(ef=64, adaptive=graph.Adaptive(tau=math.nan)))
        assert a == b


def test_everything_easy_gets_the_smallest_width():
    always = graph.Adaptive(tau=1e9, gammas=(1.0, 1.0, 1.0))
    for q in QUERIES:
        plain, short = graph.walk(G, q, graph.Walk(ef=64)), graph.walk(G, q, graph.Walk(ef=64, adaptive=always))
        assert short["effective_ef"] == (16 if short["full_pops"] >= 16 else 64)
        assert short["ndis"] <= plain["ndis"]


def test_widths_are_buckets():
    a = graph.Adaptive(tau=0.9, gammas=(0.5, 0.8, 1.0))
    assert {a.width(64, 10, m) for m in np.linspace(0, 2, 50)} <= {16, 32, 48, 64}
    assert a.width(64, 40, 0.1) == 40
    for bad in ({"buckets": 1}, {"gammas": (0.5, 0.4)}, {"start": -1}, {"end": 0}, {"decay": 2}):
        with pytest.raises(ValueError):
            graph.Adaptive(**bad)


def test_hidden_node_is_absent():
    for i in (0, 5, G.entry):
        found = graph.walk(G, VECTORS[i], graph.Walk(ef=64), hidden=i)
        assert i not in found["ids"] and len(found["ids"]) == 10


def test_filter_budget_and_radius():
    assert all(i % 2 == 0 for i in graph.walk(G, QUERIES[0], graph.Walk(ef=64, allowed=lambda i: i % 2 == 0))["ids"])
    assert graph.walk(G, QUERIES[0], graph.Walk(ef=64, budget=50))["ndis"] < 90
    inside = graph.walk(G, QUERIES[0], graph.Walk(ef=200, radius=12.0))
    assert set(inside["ids"]) <= set(np.flatnonzero(((VECTORS - QUERIES[0]) ** 2).sum(1) < 12).tolist())


def test_all_nodes_are_reached():
    assert graph._reached(G.links[0], G.entry).all()


def test_cfr_of_trace_matches_kernel(spark):
    from pyspark.sql import functions as F

    found = graph.walk(G, QUERIES[1], graph.Walk(ef=32, trace=True))
    ratios = [t["cfr"] for t in found["trace"] if t["is_full"]]
    mean = spark.createDataFrame([(ratios,)], "c array<double>").select(calibrate.cfr_of_trace(F.col("c"))).first()[0]
    assert mean == pytest.approx(found["cfr_mean"])


def test_shards_search_as_one(spark):
    base, q = frame(spark, VECTORS), frame(spark, QUERIES).toDF("qid", "qv")
    index = graph.build(base, "l2", 8, 48, shards=3)
    found = graph.search(q, index, graph.Walk(k=10, ef=96))
    r = evaluate.recall(graph.hits(found, 10), knn.knn(q, base, 10), 10)
    assert r.groupBy().avg("recall").first()[0] >= 0.95
    assert graph.stats(found).count() == 20
    ok = graph.integrity(graph.edges(index), base).first()
    assert (ok.self_links, ok.unknown, ok.unlinked) == (0, 0, 0)


def test_learned_stop():
    log = graph.recall_log(G, QUERIES[:6], graph.Walk(ef=64), 40, [frozenset(t) for t in TRUTH])
    stop = graph.stop_at(graph.train_stop(log), 0.9, 10)
    plain, early = recall(graph.Walk(ef=64)), recall(graph.Walk(ef=64, interval=40, stop=stop))
    assert 0.5 < early <= plain


def test_calibration_end_to_end(spark):
    base = frame(spark, VECTORS)
    out = sweep.calibrated(base, graph.build(base, "l2", 8, 48), [32, 64], 10, "l2", n_probes=20, least_recall=0.8)
    policy = sorted((r.ef, r.route_idx, r.gamma, r.theta) for r in out["policy"].collect())
    for ef in (32, 64):
        gammas = [p[2] for p in policy if p[0] == ef]
        assert gammas == sorted(gammas) and gammas[-1] == 1.0
    assert out["recommended"].first().recommended_ef in (32, 64)
    assert sweep.adaptive_of(out["policy"], 64).buckets == 4


def test_recommended_on_plateau_and_dip(spark):
    rule = lambda rows: calibrate.recommended(spark.createDataFrame(rows, "ef int, recall double")).first().recommended_ef
    assert rule([(10, 0.9), (20, 0.9999), (40, 1.0)]) == 20
    assert rule([(10, 0.9), (20, 0.8), (40, 0.95)]) == 40
    assert rule([(10, 0.5), (20, 0.6), (40, 0.7)]) == 40


def test_lid_of_duplicates_is_zero(spark):
    rows = spark.createDataFrame([(1, i, i, 0.0) for i in range(1, 5)], "qid long, rank int, id long, dist double")
    assert calibrate.lid(rows, 4).first().lid == 0.0


def test_policy_cache(spark, tmp_path):
    p = spark.createDataFrame([(64, 0, 0.5)], "ef int, route_idx int, gamma double")
    calibrate.save_policy(p, {"k": 10}, f"file://{tmp_path}/p")
    assert calibrate.load_policy(spark, {"k": 10}, f"file://{tmp_path}/p", [64]).count() == 1
    with pytest.raises(ValueError):
        calibrate.load_policy(spark, {"k": 11}, f"file://{tmp_path}/p")
    with pytest.raises(ValueError):
        calibrate.load_policy(spark, {"k": 10}, f"file://{tmp_path}/p", [128])


def test_explore_prunes_and_keeps_the_frontier():
    seen = []

    def run(p):
        seen.append(p)
        return min(1.0, p["nprobe"] / 8), float(p["nprobe"])

    points = sweep.explore({"nprobe": [1, 2, 4, 8, 16, 32]}, run)
    assert [p["params"]["nprobe"] for p in points][-1] == 8
    assert sweep.time_for(points, 0.5) == 4.0


def test_index_is_built_once(spark, tmp_path):
    base, path = frame(spark, VECTORS[:50]), f"file://{tmp_path}/index"
    first = graph.load_or_build(base, path).count()
    assert graph.load_or_build(base.limit(0), path).count() == first == 1


def test_ndis_savings(spark):
    a, b = spark.createDataFrame([(64, 100), (64, 300)], "ef int, ndis int"), spark.createDataFrame([(64, 100)], "ef int, ndis int")
    assert calibrate.ndis_savings(a, b).first().saved == 0.5


def test_entries_and_predicted_budget():
    best = int(np.argmin(((VECTORS - QUERIES[0]) ** 2).sum(1)))
    found = graph.walk(G, QUERIES[0], graph.Walk(ef=64, entries=(best, 5)))
    assert found["ids"][0] == best
    assert graph.walk(G, QUERIES[0], graph.Walk(ef=64, entries=(10**6,)))["ids"] == []
    asked = []
    found = graph.walk(G, QUERIES[0], graph.Walk(ef=64, after=60, predict=lambda f: asked.append(f) or 100))
    assert len(asked) == 1 and asked[0]["ndis"] >= 60 and found["ndis"] < 140


def test_binary_graph(spark):
    from pyspark.sql import functions as F

    from lodestar.functions.vectors import bits_to_signs, sign_words

    codes = frame(spark, VECTORS).select("id", sign_words(F.col("embedding")).alias("embedding"))
    q = codes.where("id < 5").select("id", bits_to_signs(F.col("embedding"), 12)).toDF("qid", "qv")
    found = graph.hits(graph.search(q, graph.build_binary(codes, 12, m=8, candidates=48), graph.Walk(k=5, ef=100)), 5)
    exact = {(r.qid, r.rank): r.dist for r in knn.hamming_knn(codes.where("id < 5").toDF("qid", "qv"), codes, 5).collect()}
    got = {(r.qid, r.rank): r.dist / 4 for r in found.collect()}
    assert np.mean([got[k] == exact[k] for k in exact]) >= 0.9


def test_inserted_and_removed_nodes():
    g = graph.build_graph(np.arange(150), VECTORS[:150], "l2")
    g = graph.inserted(g, np.arange(150, len(VECTORS)), VECTORS[150:], 48)
    assert len(g.ids) == len(VECTORS) and recall_of(g, VECTORS) >= 0.95
    gone = set(range(0, len(VECTORS), 3))
    g = graph.without(g, gone)
    assert not set(g.ids.tolist()) & gone and all((x < len(g.ids)).all() for x in g.links)
    left = np.array([i for i in range(len(VECTORS)) if i not in gone])
    assert graph._reached(g.links[0], g.entry).all() and recall_of(g, VECTORS[left], left) >= 0.95
    empty = graph.without(graph.build_graph(np.arange(5), VECTORS[:5], "l2"), range(5))
    assert not len(empty.ids) and graph.walk(empty, VECTORS[0], graph.Walk())["ids"] == []
    again = graph.inserted(empty, np.arange(3), VECTORS[:3])
    assert sorted(graph.walk(again, VECTORS[0], graph.Walk(k=3))["ids"]) == [0, 1, 2]


def recall_of(g, vectors, ids=None):
    ids = np.arange(len(vectors)) if ids is None else ids
    hits = 0
    for i in range(0, len(vectors), 10):
        true = set(ids[np.argsort(((vectors - vectors[i]) ** 2).sum(1), kind="stable")[:10]].tolist())
        hits += len(true & set(graph.walk(g, vectors[i], graph.Walk(k=10, ef=64))["ids"]))
    return hits / (10 * len(range(0, len(vectors), 10)))


def test_other_links():
    g = graph.build_graph(np.arange(len(VECTORS)), VECTORS, "l2")
    near = {i: np.argsort(((VECTORS - VECTORS[i]) ** 2).sum(1), kind="stable")[1:25].tolist() for i in range(len(VECTORS))}
    assert recall_of(graph.relinked(g, near), VECTORS) >= 0.95
    short = graph.reordered(g, 8)
    assert ((short.links[0] >= 0).sum(1) <= 8).all()
    own = [((VECTORS[i] - VECTORS[x[x >= 0]]) ** 2).sum(1) for i, x in enumerate(short.links[0])]
    assert all((np.diff(d) >= 0).all() for d in own)
    r = graph.random_links(g, 6)
    assert ((r.links[0] >= 0).sum(1) == 6).all() and (r.links[0] != np.arange(len(VECTORS))[:, None]).all()
    n = graph.nsg_graph(np.arange(len(VECTORS)), VECTORS, "l2", 16, 32)
    assert len(n.links) == 1 and graph._reached(n.links[0], n.entry).all() and recall_of(n, VECTORS) >= 0.95


def test_changes_of_an_index(spark):
    base = frame(spark, VECTORS)
    index = graph.build(base.where("id < 200"), "l2", shards=3)
    more = graph.add(index, base.where("id >= 200"))
    assert sorted(r.id for r in graph.members(more).collect()) == list(range(len(VECTORS)))
    moved = base.where("id = 7").select("id", F.transform("embedding", lambda x: x + 100).alias("embedding"))
    new = graph.update(more, moved)
    assert {r.id: r.embedding[0] for r in graph.vectors_of(new, moved).collect()} == {7: VECTORS[7][0] + 100}
    assert graph.members(new).count() == len(VECTORS)
    left = graph.remove(new, base.where("id >= 10"))
    assert sorted(r.id for r in graph.members(left).collect()) == list(range(10))


def test_queries_take_their_routes(spark):
    from lodestar.operators import cluster, ivf

    base = frame(spark, VECTORS)
    c = cluster.centroid_frame(spark, VECTORS[:4])
    index = graph.build(base, "l2", centroids=c, shard_rows=40).cache()
    assert index.count() > 4 and {r.route for r in index.collect()} <= set(range(4))
    q = base.where("id % 20 = 0").toDF("qid", "qv")
    all_routes = graph.hits(graph.search(q, index, graph.Walk(k=5, ef=len(VECTORS)), routes=ivf.probes(q, c, 4)), 5)
    assert sorted((r.qid, r.rank, r.id) for r in all_routes.collect()) == sorted((r.qid, r.rank, r.id) for r in knn.knn(q, base, 5).collect())
    one = graph.search(q, index, graph.Walk(k=5), routes=ivf.probes(q, c, 1))
    assert one.select("qid", "shard").distinct().count() < q.count() * index.count()


def test_annealed_order_is_a_permutation():
    from lodestar.operators import codecs

    b = RANDOM.normal(size=(16, 4))
    order = codecs.annealed_order(b, 3000)
    assert sorted(order.tolist()) == list(range(16)) and codecs.annealed_order(b[:2]).tolist() == [0, 1]
