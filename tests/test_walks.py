"""Walks as joins, learned ends and sparse k-means against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import graph, joined_walk, knn, sparse, stops
from lodestar.sources.shared import materialize

RANDOM = np.random.default_rng(11)
BASE = RANDOM.normal(size=(200, 8))


def frame(spark, m, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, embedding array<double>")


@pytest.fixture(scope="module")
def made(spark):
    base = frame(spark, BASE)
    links = materialize(joined_walk.links_of(knn.knn(base.toDF("qid", "qv"), base, 8, exclude_self=True), 12))
    return base, links, materialize(joined_walk.entry_points(base))


def plain_walk(links, starts, q, ef, pops):
    """The same rounds over lists."""
    dist = lambda i: float(((BASE[i] - q) ** 2).sum())
    beam = {i: False for i in starts}
    while True:
        order = sorted(beam, key=lambda i: (dist(i), i))[:ef]
        beam = {i: beam[i] for i in order}
        front = [i for i in order if not beam[i]][:pops]
        if not front:
            return order
        beam.update({i: True for i in front})
        for i in front:
            for j in links.get(i, ()):
                beam.setdefault(j, False)


@pytest.mark.parametrize("ef,pops", [(12, 1), (20, 4)])
def test_walks_as_joins(spark, made, ef, pops):
    base, links, entries = made
    q = frame(spark, BASE[:6] + 0.05, 1000).toDF("qid", "qv")
    found, log = joined_walk.walk(q, base, links, entries, 10, ef, pops=pops)
    to: dict = {}
    for r in links.collect():
        to.setdefault(r.node, []).append(r.neighbour)
    ids = [r.id for r in entries.collect()]
    got: dict = {}
    for r in sorted(found.collect(), key=lambda r: (r.qid, r["rank"])):
        got.setdefault(r.qid, []).append(r.id)
    for n in range(6):
        x = BASE[n] + 0.05
        starts = sorted(ids, key=lambda i: (float(((BASE[i] - x) ** 2).sum()), i))[:4]
        assert got[1000 + n] == plain_walk(to, starts, x, ef, pops)[:10]
    assert log[0]["walking"] == 6 and log[-1]["walking"] == 0 and len(log) > 2


def test_degrees(spark, made):
    _, links, _ = made
    degree = {r.node: r.n for r in links.groupBy("node").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(degree) == 200 and max(degree.values()) <= 12 and min(degree.values()) >= 8
    drawn = joined_walk.random_links(made[0], 5).collect()
    assert len(drawn) == len(set(drawn)) and all(r.node != r.neighbour for r in drawn) and len({r.node for r in drawn}) == 200


def test_stops(spark, made):
    base, links, entries = made
    q = frame(spark, BASE[:4] + 0.05, 1000).toDF("qid", "qv")
    exact = {n: ((BASE - BASE[n] - 0.05) ** 2).sum(1) for n in range(4)}
    found, log = joined_walk.walk(q, base, links, entries, stop=joined_walk.Epsilon(6.0, 100, 200), pops=16)
    assert {(r.qid - 1000, r.id) for r in found.collect()} == {(n, int(i)) for n in exact for i in np.flatnonzero(exact[n] <= 6.0)}
    few, short = joined_walk.walk(q, base, links, entries, stop=joined_walk.Epsilon(0.001, 2, 200), pops=16)
    assert few.count() == 0 and len(short) <= len(log)
    of = base.select("id", (F.col("id") % 40).alias("doc"))
    found, _ = joined_walk.walk(q, base, links, entries, stop=joined_walk.Documents(of, 3, 40), pops=32)
    for n in exact:
        near = {d: min(exact[n][d::40]) for d in range(40)}
        docs = sorted(near, key=lambda d: (near[d], d))[:3]
        assert {r.id for r in found.collect() if r.qid == 1000 + n} == {i for i in range(200) if i % 40 in docs}


def test_walks_without_rows(spark, made):
    base, links, entries = made
    none = base.limit(0)
    q = base.limit(3).toDF("qid", "qv")
    assert joined_walk.walk(none.toDF("qid", "qv"), base, links, entries)[0].count() == 0
    assert joined_walk.walk(q, none, links, none)[0].count() == 0
    odd = spark.createDataFrame([(1, None), (None, [0.0] * 8), (5, [0.0] * 8)], "qid long, qv array<double>")
    assert {r.qid for r in joined_walk.walk(odd, base, links, entries, 3, 8)[0].collect()} == {5}


# --- learned ends ---

def log_rows(spark, seed=1, walks=60):
    """Walks whose recall grows evenly up to a number of distances that their first
    distance tells."""
    r, rows = np.random.default_rng(seed), []
    for q in range(walks):
        need = float(r.integers(50, 400))
        for s in range(1, 26):
            ndis = 20.0 * s
            part = min(1.0, ndis / need)
            rows.append((q, 0, float(s), ndis, ndis / 4, 30.0, 5.0, need / 100, need / 50, need / 80, 0.5, part, True, 500.0))
    return spark.createDataFrame(rows, "qid long, shard int, steps double, ndis double, inserted double, beam double, full_pops double, nearest double, furthest double, popped double, spread double, recall double, useful boolean, total double")


def test_learned_ends(spark):
    log = materialize(log_rows(spark))
    need = {r.qid: r.needed for r in stops.needed(log, 0.9).collect()}
    rows = log.collect()
    assert need == {q: min(r.ndis for r in rows if r.qid == q and r.recall >= 0.9) for q in need}
    when = stops.intervals(log, 0.9).first()
    mean = np.mean(list(need.values()))
    assert (when.group, when["first"], when.least) == (0, max(1, round(mean / 2)), max(1, round(mean / 10)))
    groups = log.select("qid", (F.col("qid") % 2).alias("group")).distinct()
    assert stops.intervals(log, 0.9, groups).count() == 2
    model = stops.train_trees(log, 10, 4)
    new = materialize(log_rows(spark, 2, 20))
    ends = stops.replayed(new, model, stops.intervals(log, 0.9), 0.9).collect()
    assert len(ends) == 20 and np.mean([r.recall for r in ends]) > 0.85 and np.mean([r.ndis for r in ends]) < 400
    # by a plain loop over the model's answers
    told = {}
    for r in model.transform(stops._vectors(new, stops.SEEN)).collect():
        told.setdefault(r.qid, []).append((r.ndis, r.predicted, r.recall))
    for r in ends:
        due, end = when["first"], None
        for ndis, p, recall in sorted(told[r.qid]):
            if end is None and ndis >= due:
                if p >= 0.9:
                    end = (ndis, recall)
                due = ndis + when.least + (when["first"] - when.least) * min(max((0.9 - p) / 0.9, 0), 1)
        assert (r.ndis, r.recall) == (end or (500.0, 1.0))


def test_trained_budgets(spark):
    log, new = materialize(log_rows(spark)), materialize(log_rows(spark, 3, 30))
    fit, predict = stops.train_budget(log, 60.0)
    given = {r.qid: r.budget for r in stops.budgets(new, fit, 60.0).collect()}
    need = {r.qid: r.needed for r in stops.needed(new, 1.0).collect()}
    assert np.corrcoef([given[q] for q in need], [need[q] for q in need])[0, 1] > 0.9
    for r in stops.at_point(new, 60.0).collect():
        assert np.isclose(predict(r.asDict()), given[r.qid])
    for r in stops.within_budgets(new, stops.budgets(new, fit, 60.0)).collect():
        used = [x for x in range(20, 501, 20) if x >= given[r.qid]]
        assert r.ndis == (used[0] if used else 500)


def test_logs_of_walks(spark, made):
    base, _, _ = made
    index = materialize(graph.build(base, shards=2))
    q = frame(spark, BASE[:5] + 0.01, 1000).toDF("qid", "qv")
    truth = knn.knn(q, base, 10)
    log = stops.walk_log(q, index, truth, graph.Walk(k=10, ef=32)).collect()
    full = {(r.qid, r.shard): r for r in graph.search(q, index, graph.Walk(k=10, ef=32)).collect()}
    assert {(r.qid, r.shard) for r in log} == set(full)
    for key, w in full.items():
        mine = sorted((r for r in log if (r.qid, r.shard) == key), key=lambda r: r.steps)
        assert all(a.recall <= b.recall and a.ndis <= b.ndis for a, b in zip(mine, mine[1:])) and mine[-1].recall == 1.0 and mine[-1].total == mine[-1].ndis <= w.ndis


# --- sparse k-means ---

def test_sparse_kmeans(spark):
    dense = RANDOM.normal(size=(60, 12)) * (RANDOM.random((60, 12)) < 0.3)
    dense[7] = 0
    rows = [(i, np.flatnonzero(v).tolist(), v[v != 0].tolist()) for i, v in enumerate(dense)]
    df = spark.createDataFrame([*rows, (None, [1], [1.0])], "id long, indices array<int>, values array<double>")
    for start in ([3, 9, 20], [7, 3, 7, 11]):  # a centroid without entries, and two alike
        c = dense[start].copy()
        given = spark.createDataFrame([(k, int(j), float(x)) for k, v in enumerate(c) for j, x in enumerate(v) if x], "list_no int, dim int, c double")
        centroids, found = sparse.kmeans(df, given, len(start), 3)
        for _ in range(4):
            d = ((dense[:, None] - c) ** 2).sum(2)
            a = np.array([min(range(len(c)), key=lambda k: (round(row[k], 9), k)) for row in d])
            last, c = c, np.stack([dense[a == k].mean(0) if (a == k).any() else c[k] for k in range(len(c))])
        got = {r.id: r for r in found.collect()}
        assert len(got) == 60 and all(np.isclose(got[i].dist, d[i].min()) for i in range(60))
        table = np.zeros_like(last)
        for r in centroids.collect():
            table[r.list_no, r.dim] = r.c
        assert np.allclose(table, last)
    _, none = sparse.kmeans(df.limit(0), given, 4, 1)
    assert none.count() == 0
