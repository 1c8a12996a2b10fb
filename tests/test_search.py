import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import vectors
from lodestar.functions.metrics import METRICS, distance, metric, space_of
from lodestar.operators import evaluate, filters, knn, merge

RANDOM = np.random.default_rng(5)


def frame(spark, m, first=0):
    return spark.createDataFrame([(i + first, [float(x) for x in v]) for i, v in enumerate(m)], "id long, embedding array<double>")


@pytest.fixture(scope="module")
def data(spark):
    base, q = RANDOM.random((60, 6)) - 0.2, RANDOM.random((5, 6)) - 0.2
    return base, q, frame(spark, base).cache(), frame(spark, q).toDF("qid", "qv").cache()


@pytest.mark.parametrize("name", sorted(METRICS))
def test_column_and_tile_agree(spark, data, name):
    base, q, b, qs = data
    if name in ("braycurtis", "jensenshannon", "jaccard"):
        base, q = abs(base) + 0.01, abs(q) + 0.01
    p = 3.0 if name == "lp" else None
    pairs = frame(spark, q).crossJoin(frame(spark, base).toDF("id2", "e2"))
    got = {(r[0], r[1]): r[2] for r in pairs.select("id", "id2", distance(name, F.col("embedding"), F.col("e2"), p)).collect()}
    want = metric(name).tile(q, base, p)
    assert np.allclose([[got[i, j] for j in range(60)] for i in range(5)], want, atol=1e-9, equal_nan=True)


def test_ties_go_by_id_and_nan_last(spark):
    base = spark.createDataFrame([(3, [1.0]), (1, [1.0]), (2, [1.0]), (4, [float("nan")])], "id long, embedding array<double>")
    q = spark.createDataFrame([(9, [0.0])], "qid long, qv array<double>")
    assert [(r.rank, r.id) for r in knn.knn(q, base, 4).orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 3), (4, 4)]
    assert [r.id for r in knn.knn(q, base, 2).orderBy("rank").collect()] == [1, 2]


def test_empty_and_null_vectors(spark):
    base = spark.createDataFrame([(1, None), (2, [0.0])], "id long, embedding array<double>")
    q = spark.createDataFrame([(9, [0.0])], "qid long, qv array<double>")
    assert [r.id for r in knn.knn(q, base, 3).collect()] == [2]
    assert knn.knn(q.limit(0), base, 3).count() == 0
    assert knn.knn(q, base.limit(0), 3).count() == 0


def test_range_is_strict(spark):
    base = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id long, embedding array<double>")
    q = spark.createDataFrame([(9, [0.0])], "qid long, qv array<double>")
    assert [r.id for r in knn.range_search(q, base, 4.0).collect()] == [1]


def test_nearest_on_line_by_brute_force(spark):
    x, y = RANDOM.integers(0, 50, 40) / 2, RANDOM.integers(0, 60, 40) / 3
    base = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, x double")
    q = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "qid long, x double")
    got = {r.qid: (r.id, r.dist) for r in knn.nearest_on_line(q, base).collect()}
    for i, v in enumerate(y):
        best = min((abs(v - w), w, j) for j, w in enumerate(x))
        assert got[i] == (best[2], pytest.approx(best[0]))


def test_distance_of_missing_id_is_null(spark, data):
    _, _, b, q = data
    lists = q.select("qid", F.array(F.lit(3).cast("long"), F.lit(-1).cast("long")).alias("ids"))
    out = {(r.qid, r.pos): r.dist for r in knn.distances_by_id(q, b, lists).collect()}
    assert out[0, 0] is not None and out[0, 1] is None


def test_selectors(spark):
    ids = spark.range(20)
    pick = lambda c: [r.id for r in ids.where(c).orderBy("id").collect()]
    assert pick(filters.in_bitmap(F.col("id"), bytes([0b10000001, 0b10]))) == [0, 7, 9]
    assert pick(filters.in_range(F.col("id"), 3, 5) != filters.in_list(F.col("id"), [4, 5])) == [3, 5]
    with pytest.raises(NotImplementedError):
        filters.check_selector([1, 2])


def test_mark_deleted_twice_fails(spark):
    base = spark.range(4).withColumn("deleted", F.col("id") == 2)
    assert filters.marked_deleted(base, spark.range(1)).where("deleted").count() == 2
    for bad in (spark.range(2, 3), spark.range(9, 10)):
        with pytest.raises(Exception, match="can't mark"):
            filters.marked_deleted(base, bad).collect()


def test_combined_uses_range_where_knn_was_full(spark):
    r = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.2), (1, 3, 0.3), (2, 1, 0.1)], "qid long, id long, dist double")
    k = spark.createDataFrame([(1, 1, 1, 0.1), (1, 2, 2, 0.2), (2, 1, 1, 0.1), (2, 2, 9, 9.0)], "qid long, rank int, id long, dist double")
    assert sorted((x.qid, x.id) for x in merge.combined(r, k, 1.0, 2).collect()) == [(1, 1), (1, 2), (1, 3), (2, 1)]


def test_duplicates_expand(spark):
    base = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [0.0])], "id long, embedding array<double>")
    groups = merge.duplicate_groups(base)
    q = spark.createDataFrame([(9, [0.0])], "qid long, qv array<double>")
    found = knn.knn(q, base.join(groups.select(F.col("representative").alias("id")).distinct(), "id"), 2)
    assert [(r.rank, r.id) for r in merge.expand_duplicates(found, groups, 3).orderBy("rank").collect()] == [(1, 1), (2, 3), (3, 2)]


def test_range_scores_conventions(spark):
    empty = spark.createDataFrame([], "qid long, id long, dist double")
    one = spark.createDataFrame([(1, 5, 0.1)], "qid long, id long, dist double")
    q = spark.createDataFrame([(1,), (2,)], "qid long")
    got = {r.qid: (r.precision, r.recall) for r in evaluate.range_scores(empty, one, q).collect()}
    assert got == {1: (1.0, 0.0), 2: (1.0, 1.0)}
    got = {r.qid: (r.precision, r.recall) for r in evaluate.range_scores(one, empty, q).collect()}
    assert got == {1: (0.0, 0.0), 2: (1.0, 1.0)}


def test_at_recall(spark):
    c = spark.createDataFrame([("a", 0.5, 1.0), ("a", 0.9, 3.0), ("b", 0.2, 7.0)], "d string, recall double, ms double")
    at = lambda t, **k: {r.d: r.ms for r in evaluate.at_recall(c, t, "ms", ["d"], **k).collect()}
    assert at(0.7) == {"a": pytest.approx(2.0), "b": None}
    assert at(0.9)["a"] == pytest.approx(3.0)
    assert at(0.95, clamp=True) == {"a": pytest.approx(3.0), "b": pytest.approx(7.0)}
    assert at(0.7, log=True)["a"] == pytest.approx(3.0**0.5)


def test_bits(spark):
    row = spark.createDataFrame([([5, 0, 7, 2],)], "f array<int>").select(vectors.pack_bits(F.col("f"), 3).alias("p")).select("p", vectors.unpack_bits(F.col("p"), 3, 4).alias("f")).first()
    assert row.f == [5, 0, 7, 2] and len(row.p) == 2


@pytest.mark.parametrize("name,space", [("msmarco-angular", "ip"), ("text2image", "ip"), ("coco-t2i", "cosine"), ("glove-100", "cosine"), ("sift-128", "l2"), ("other", "l2")])
def test_space(name, space):
    assert space_of(name) == space


def test_random_vectors(spark):
    rows = spark.range(500)
    for normal, mean in ((False, 0.5), (True, 0.0)):
        v = vectors.random_vectors(rows, 8, normal=normal)
        m = np.array([r.embedding for r in v.collect()])
        assert abs(m.mean() - mean) < 0.05 and vectors.checksum(v).first() == vectors.checksum(v.repartition(5)).first()
    assert np.abs(np.array([r.embedding for r in vectors.smooth_vectors(rows, 6).collect()])).max() <= 1
