"""Walks over codes as joins against sequential ones, and their calibration."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import coded_walk, joined_walk, knn
from lodestar.operators.codecs import RaBitQ
from lodestar.sources.shared import materialize

RANDOM = np.random.default_rng(23)
BASE = RANDOM.normal(size=(200, 8))
QUERIES = RANDOM.normal(size=(5, 8))


def frame(spark, m, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, embedding array<double>")


def asked(spark, *efs):
    q = frame(spark, QUERIES, 1000).toDF("qid", "qv")
    return q.select("qid", "qv", F.explode(F.array(*map(F.lit, efs))).alias("ef"))


@pytest.fixture(scope="module")
def made(spark):
    base = frame(spark, BASE)
    near = materialize(knn.knn(base.toDF("qid", "qv"), base, 20, exclude_self=True))
    links = materialize(joined_walk.links_of(near.where("rank <= 8"), 12))
    to: dict = {}
    for r in links.collect():
        to.setdefault(r.node, []).append(r.neighbour)
    return base, near, links, materialize(joined_walk.entry_points(base)), to


def plain(to, starts, est, ef, start=4, end=16, decay=0.8, width=lambda mean: None):
    """A sequential walk by estimates: the rows met, its beam, full pops, the mean
    ratio and the width at the end."""
    beam, met = {i: False for i in starts}, set(starts)
    n, s, window, now = 0, None, [], ef
    while True:
        order = sorted(beam, key=lambda i: (est[i], i))[:now]
        beam = {i: beam[i] for i in order}
        front = [i for i in order if not beam[i]][:1]
        if not front:
            return met, order, n, (sum(window) / len(window) if window else None), now
        if len(order) >= now:
            n, ratio = n + 1, max(est[front[0]], 0) / max(est[order[-1]], 1e-6)
            s = ratio if s is None else decay * s + (1 - decay) * ratio
            if start <= n <= end:
                window.append(s)
            if n == end:
                now = width(sum(window) / len(window)) or now
        beam[front[0]] = True
        for j in to.get(front[0], ()):
            met.add(j)
            beam.setdefault(j, False)


def starts_of(entries, q, n=4):
    rows = sorted(entries.collect(), key=lambda r: (float(((np.array(r.embedding) - q) ** 2).sum()), r.id))
    return [r.id for r in rows[:n]]


@pytest.mark.parametrize("bits", [0, 2])
def test_against_sequential_walks(spark, made, bits):
    base, _, links, entries, to = made
    codec = RaBitQ.train(base, bits) if bits else None
    codes = coded_walk.coded(base, codec, None) if bits else coded_walk.uncoded(base)
    est = codec.estimate(QUERIES, codec.encode(BASE)) if bits else ((QUERIES[:, None] - BASE) ** 2).sum(2)
    exact = ((QUERIES[:, None] - BASE) ** 2).sum(2)
    hits, did = coded_walk.walk(asked(spark, 12, 30), base, codes, links, entries, 10, pops=1)
    got = {}
    for r in sorted(hits.collect(), key=lambda r: r["rank"]):
        got.setdefault((r.qid, r.ef), []).append(r.id)
    did = {(r.qid, r.ef): r for r in did.collect()}
    assert len(did) == 10
    for n, q in enumerate(QUERIES):
        for ef in (12, 30):
            met, _, pops, mean, _ = plain(to, starts_of(entries, q), est[n], ef)
            assert got[1000 + n, ef] == sorted(met, key=lambda i: (exact[n, i], i))[:10]
            d = did[1000 + n, ef]
            assert d.full_pops == pops and d.cfr_mean == pytest.approx(mean) and d.effective_ef == ef
            assert d.ndis >= len(met) and 10 <= d.refined <= len(met) and (bits or d.refined == 10)


def test_estimates_and_bounds(spark, made):
    base = made[0]
    q = frame(spark, QUERIES, 1000).toDF("qid", "qv")
    pairs = q.select("qid").crossJoin(base.select("id"))  # five queries
    for bits in (1, 4):
        codec = RaBitQ.train(base, bits)
        plain_estimates, exact = codec.estimate(QUERIES, codec.encode(BASE)), ((QUERIES[:, None] - BASE) ** 2).sum(2)
        for eps, every in ((None, True), (1.9, False)):
            codes = coded_walk.coded(base, codec, eps)
            rows = coded_walk.estimates(pairs, coded_walk.moved_queries(q, codes), codes).collect()
            assert all(r.est == pytest.approx(plain_estimates[r.qid - 1000, r.id]) for r in rows)
            within = [abs(r.est - exact[r.qid - 1000, r.id]) <= r.slack + 1e-9 for r in rows]
            assert all(within) if every else sum(within) >= 0.9 * len(within)


def test_policies_narrow_walks(spark, made):
    base, _, links, entries, to = made
    exact = ((QUERIES[:, None] - BASE) ** 2).sum(2)
    means = [plain(to, starts_of(entries, q), exact[n], 30)[3] for n, q in enumerate(QUERIES)]
    tau = float(sorted(means)[2])
    policy = spark.createDataFrame([(30, 0, 12, tau, 0.9), (30, 1, 20, tau, 1.0)], "ef int, route_idx int, route_ef int, tau double, gamma double")
    _, did = coded_walk.walk(asked(spark, 24, 30), base, coded_walk.uncoded(base), links, entries, 10, policy, pops=1)
    got = {(r.qid, r.ef): r for r in did.collect()}
    width = lambda m: (12 if m / tau <= 0.9 + 1e-12 else 20) if m <= tau else None
    for n, q in enumerate(QUERIES):
        *_, pops, mean, now = plain(to, starts_of(entries, q), exact[n], 30, width=width)
        assert (got[1000 + n, 30].effective_ef, got[1000 + n, 30].full_pops) == (now, pops) and got[1000 + n, 30].cfr_mean == pytest.approx(mean)
        assert got[1000 + n, 24].effective_ef == 24
    assert 0 < sum(r.effective_ef < r.ef for r in got.values()) < 5


def test_calibration(spark, made):
    base, near, links, entries, _ = made
    out = coded_walk.calibrated(base, coded_walk.coded(base, RaBitQ.train(base, 2)), links, entries, near, (20, 40), n_probes=20, least_recall=0.8)
    policy = sorted(out["policy"].collect())
    assert [(r.ef, r.route_idx, r.route_ef) for r in policy] == [(20, 0, 5), (20, 1, 10), (20, 2, 15), (40, 0, 10), (40, 1, 20), (40, 2, 30)]
    for ef in (20, 40):
        rows = [r for r in policy if r.ef == ef]
        assert all(a.theta <= b.theta for a, b in zip(rows, rows[1:])) and rows[-1].gamma == 1.0 and all(r.tau == rows[-1].theta for r in rows)
    recall = {r.ef: r.recall for r in out["recalls"].groupBy("ef").agg(F.avg("recall").alias("recall")).collect()}
    assert recall[40] >= recall[20] >= recall[10] and recall[40] > 0.9
    assert out["recommended"].first().recommended_ef in (20, 40)


def test_odd_tables(spark, made):
    base, _, links, entries, _ = made
    codes, q = coded_walk.uncoded(base), asked(spark, 12)
    none = base.where("false")
    assert coded_walk.walk(q.where("false"), base, codes, links, entries)[0].count() == 0
    hits, did = coded_walk.walk(q, none, coded_walk.uncoded(none), links.where("false"), none)
    assert hits.count() == 0 and {(r.ndis, r.refined, r.cfr_mean) for r in did.collect()} == {(0, 0, None)}
    nulls = spark.createDataFrame([(None, [0.0] * 8), (7000, None)], base.schema)
    want = {tuple(r) for r in coded_walk.walk(q, base, codes, links, entries)[0].collect()}
    odd = q.unionByName(q).unionByName(nulls.select(F.col("id").alias("qid"), F.col("embedding").alias("qv"), F.lit(12).alias("ef"))).unionByName(q.withColumn("ef", F.lit(None).cast("int")))
    more = base.unionByName(nulls)
    again = coded_walk.walk(odd, more, coded_walk.uncoded(more), links.unionByName(links), entries)
    assert {tuple(r) for r in again[0].collect()} == want
    alike = spark.createDataFrame([(i, [1.0] * 8) for i in range(30)], base.schema)
    ring = spark.createDataFrame([(i, (i + 1) % 30) for i in range(30)], "node long, neighbour long")
    flat = coded_walk.coded(alike, RaBitQ.train(alike, 1), None)
    hits, _ = coded_walk.walk(q.limit(1), alike, flat, ring, alike.where("id = 0"), 10)
    assert [r.id for r in sorted(hits.collect(), key=lambda r: r["rank"])] == list(range(10))


def test_walks_of_several_policies_share_rounds(spark, made):
    base, _, links, entries, _ = made
    policy = spark.createDataFrame([(30, 0, 12, 0.9, 1.0)], "ef int, route_idx int, route_ef int, tau double, gamma double")
    codes, q = coded_walk.coded(base, RaBitQ.train(base, 1)), asked(spark, 12, 30)
    both = coded_walk.walks(q, base, codes, links, entries, 5, [None, policy])
    for way, one in enumerate((None, policy)):
        alone = coded_walk.walk(q, base, codes, links, entries, 5, one)
        for rows, want in zip(both, alone):
            got = {tuple(r) for r in rows.where(F.col("way") == way).select(want.columns).collect()}
            # a row that one walk has dropped and another holds isn't estimated again for it
            drop = lambda rows: {r[:2] + r[3:] for r in rows} if "ndis" in want.columns else rows
            assert got and drop(got) == drop({tuple(r) for r in want.collect()})
