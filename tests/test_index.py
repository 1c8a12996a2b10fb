import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import calibrate, cluster, codecs, evaluate, ivf, knn
from lodestar.plans import factory, queries_evaluation
from lodestar.plans.catalog import QUERIES
from lodestar.sources import datasets, vecs
from lodestar.streaming import ingest
from tests.test_search import frame

RANDOM = np.random.default_rng(3)
BASE = np.concatenate([RANDOM.normal(size=(100, 8)) + 6 * i for i in range(3)])


def test_exact_split_of_numbers():
    x = sorted(RANDOM.integers(0, 40, 9).tolist())
    cost = lambda parts: sum(((np.array(p) - np.mean(p)) ** 2).sum() for p in parts)
    best = min(cost([x[: a], x[a:b], x[b:]]) for a, b in itertools.combinations(range(1, 9), 2))
    c = cluster.kmeans_1d(x, 3)
    assert sum(min((v - k) ** 2 for k in c) for v in x) == pytest.approx(best)


def test_kmeans_finds_clusters(spark):
    base = frame(spark, BASE)
    c, costs = cluster.kmeans(base, cluster.KMeans(3, 10, init="plusplus"))
    assert sorted(np.rint(c.mean(1) / 6).tolist()) == [0, 1, 2] and costs == sorted(costs, reverse=True)
    assert sorted(r["count"] for r in ivf.assign_lists(base, cluster.centroid_frame(spark, c)).groupBy("list_no").count().collect()) == [100, 100, 100]
    sizes = [r["count"] for r in cluster.balanced_assignment(base, c[:2], 5).groupBy("list_no").count().collect()]
    assert sum(sizes) == 300


def test_empty_clusters_split():
    c, n = np.ones((2, 4)), np.array([10.0, 0.0])
    cluster.split_empty(c, n)
    assert n.tolist() == [5, 5] and not np.array_equal(c[0], c[1])


def test_codec_round_trips(spark):
    v = RANDOM.normal(size=(200, 8))
    base = frame(spark, v)
    r = codecs.random_rotation(8, 8)
    assert np.allclose(r.back(r(v)), v)
    p = codecs.pca(base, 8)
    assert np.allclose(p.back(p(v)), v) and np.allclose(p(v).mean(0), 0, atol=1e-9)
    white = codecs.pca(base, 8, -0.5)(v)
    assert np.allclose(np.cov(white.T, bias=True), np.eye(8), atol=1e-6)
    sq = codecs.scalar_quantizer(base)
    back = np.array([x.e for x in base.select("id", sq.decode(sq.encode(F.col("embedding"))).alias("e")).orderBy("id").collect()])
    assert abs(back - v).max() <= max(sq.step)
    rq = codecs.ResidualQuantizer.train(base, 3, 4)
    codes = rq.encode(v)
    one = ((v - codecs.ResidualQuantizer(rq.books[:1]).decode(codes[:, :1])) ** 2).sum()
    assert ((v - rq.decode(codes)) ** 2).sum() < one
    assert ((v - rq.decode(rq.refine(v, codes))) ** 2).sum() <= ((v - rq.decode(codes)) ** 2).sum() + 1e-9
    assert np.allclose(np.linalg.norm(codecs.hadamard_rotation(8)(v), axis=1), np.linalg.norm(v, axis=1))


def test_lattice_is_nearest():
    v = RANDOM.normal(size=(20, 4))
    points = np.array([p for p in itertools.product(range(-3, 4), repeat=4) if sum(x * x for x in p) == 9])
    got = codecs.Lattice(9).encode(v)
    assert np.allclose((got * v).sum(1), (v @ points.T).max(1))


def test_rabitq_estimates(spark):
    v = RANDOM.normal(size=(300, 32))
    base = frame(spark, v)
    true = ((v[:5, None] - v) ** 2).sum(-1)
    for bits, most in ((1, 0.25), (4, 0.06)):
        c = codecs.RaBitQ.train(base, bits)
        assert np.median(abs(c.estimate(v[:5], c.encode(v)) - true)[true > 1] / true[true > 1]) < most


@pytest.mark.parametrize("text", ["Flat", "PCA32,IVF16,PQ8x4,Refine(Flat)", "IDMap,OPQ16_32,IVF256_HNSW32,SQ8", "RR64,RaBitQ4", "HNSW32", "RQ4x6", "LSQ4x6", "LSHrt", "HNSW32,SQ8", "IMI2x4,PQ8x6", "IVF16,FlatDedup", "NSG24", "PQ8x4,Refine(SQ8)"])
def test_factory_strings_come_back(text):
    assert str(factory.parse(text)) == text
    assert factory.code_size(factory.parse(text), 64) > 0


@pytest.mark.parametrize("text", ["", "IVF16", "Flat,Flat,Flat", "PQ", "Refine(Flat", "nonsense", "IVF16,HNSW32", "FlatDedup", "Flat,Refine(LSH)", "HNSW32,LSH", "IMI2x20,Flat", "PQ8x4fs", "IVF16,NSG16"])
def test_factory_rejects(text):
    with pytest.raises(ValueError):
        factory.parse(text)


@pytest.mark.parametrize("text,least", [("Flat", 1.0), ("IVF3,Flat", 0.9), ("PQ4x4,Refine(Flat)", 0.5), ("HNSW16,SQ8", 0.8), ("IVF3,PQ4x4", 0.3), ("IVF3,RaBitQ4", 0.5), ("IVF3,LSH,Refine(Flat)", 0.3), ("IMI2x2,Flat", 0.4), ("NSG16", 0.9)])
def test_factory_builds(spark, text, least):
    base = frame(spark, BASE)
    q = base.where("id % 50 = 0").toDF("qid", "qv")
    found = factory.build(base, text).search(q, 10, nprobe=2)
    assert evaluate.recall(found, knn.knn(q, base, 10), 10).groupBy().avg("recall").first()[0] >= least


def test_steps_that_are_named_make_a_difference(spark):
    # each pair differs in one step, and so do the distances that it finds
    base = frame(spark, BASE + RANDOM.normal(size=BASE.shape))
    q = base.where("id % 50 = 0").toDF("qid", "qv")
    dist = lambda text: [(r.qid, r.rank, round(r.dist, 6)) for r in factory.build(base, text).search(q, 10, nprobe=2).orderBy("qid", "rank").collect()]
    for one, two in (("IVF3,Flat", "IVF3,RaBitQ"), ("IVF3,Flat", "IVF3,LSH"), ("IVF3,PQ4x4", "PQ4x4"), ("PQ4x2,Refine(Flat)", "PQ4x2,Refine(SQ4)"), ("Flat", "SQ4"), ("RQ2x3", "LSQ2x3")):
        assert dist(one) != dist(two), (one, two)


def test_duplicates_of_lists_come_back(spark):
    twice = np.concatenate([BASE[:50]] * 3)
    base = frame(spark, twice)
    index = factory.build(base, "IVF3,FlatDedup")
    assert index.codes.count() == 50
    got = sorted((r.qid, r.id) for r in index.search(base.where("id < 3").toDF("qid", "qv"), 3, nprobe=3).collect())
    assert got == sorted((i, i + 50 * k) for i in range(3) for k in range(3))


@pytest.mark.parametrize("codec,width", [(codecs.RowCodec(), 8), (codecs.Half("fp16"), 8), (codecs.Signs(), 8), (codecs.ScalarRows.train_on(BASE, 4), 8), (codecs.ScalarRows.train_on(BASE, 6), 8), (codecs.ProductQuantizer.train_on(BASE, 4, 3), 4), (codecs.RaBitQ.train_on(BASE, 2), 11)])
def test_codes_are_stored(codec, width):
    codes = codec.encode(BASE)
    back = codec.from_bytes(b"".join(codec.row_bytes(codes)), len(BASE), width)
    assert np.allclose(back, codes, rtol=1e-6)


def test_residual_codes_lose_less(spark):
    base = frame(spark, BASE)
    loss = lambda index: sum(((np.array(r.embedding) - BASE[r.id]) ** 2).sum() for r in index.kept().collect())
    assert loss(factory.build(base, "IVF3,PQ4x3")) < 0.9 * loss(factory.build(base, "PQ4x3"))


def test_index_changes(spark, tmp_path):
    base = frame(spark, BASE)
    index = factory.build(base, "IVF3,SQ8,Refine(Flat)")
    fewer = index.remove(base.where("id % 2 = 0"))
    assert {r.id for r in fewer.codes.collect()} == set(range(1, 300, 2)) == {i for r in fewer.blocks.collect() for i in r.ids}
    fewer.save(f"file://{tmp_path}/x")
    again = factory.load(spark, f"file://{tmp_path}/x").add(base.where("id % 2 = 0"))
    q = base.where("id < 5").toDF("qid", "qv")
    assert {r.qid: r.id for r in again.search(q, 1, nprobe=3).collect()} == {i: i for i in range(5)}
    with pytest.raises(ValueError):
        factory.build(base, "IVF3,SQ8").merge_from(factory.build(base, "IVF2,SQ8"))
    with pytest.raises(ValueError):
        factory.build(base, "HNSW16").add(base)


def test_parts_of_vectors_find_the_same(spark):
    from lodestar.operators import panorama

    v = BASE * np.array([9, 7, 5, 3, 1, 0.5, 0.2, 0.1])
    base, q = frame(spark, v), frame(spark, v).where("id % 50 = 0").toDF("qid", "qv")
    p = codecs.Linear(codecs.pca(base, 8).a)
    got = [(r.qid, r.rank, r.id) for r in panorama.search(q, base, 7, 4, p).orderBy("qid", "rank").collect()]
    assert got == [(r.qid, r.rank, r.id) for r in knn.knn(q, base, 7).orderBy("qid", "rank").collect()]
    n = panorama.looked_at(q, base, 7, 4, p).first()
    assert n.looked < 0.8 * n.every


def test_large_query_sets_meet_the_base_in_groups(spark, monkeypatch):
    from lodestar.operators import blocks

    base = frame(spark, BASE).repartition(3)
    q = base.toDF("qid", "qv")
    want = [(r.qid, r.rank, r.id) for r in knn.knn(q, base, 5).orderBy("qid", "rank").collect()]
    for name, value in (("BROADCAST_BYTES", 0), ("QUERY_ROWS", 32), ("BASE_ROWS", 64), ("GROUP_BLOCKS", 3)):
        monkeypatch.setattr(blocks, name, value)
    monkeypatch.setattr(blocks.query_blocks, "__defaults__", (32,))
    assert [(r.qid, r.rank, r.id) for r in knn.knn(q, base, 5).orderBy("qid", "rank").collect()] == want


def test_lists_without_a_broadcast(spark, monkeypatch):
    base = frame(spark, BASE)
    c = cluster.centroid_frame(spark, BASE[:20])
    want = {r.id: r.list_no for r in ivf.assign_lists(base, c).collect()}
    monkeypatch.setattr(ivf, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(ivf, "CELLS", 64)
    assert {r.id: r.list_no for r in ivf.assign_lists(base, c).collect()} == want
    assert ivf.assign_lists(base.limit(0), c).count() == 0


def test_batches_of_lists_go_on(spark):
    base = frame(spark, BASE)
    c, q = cluster.centroid_frame(spark, BASE[::30]), base.where("id % 20 = 0").toDF("qid", "qv")
    lists, chosen = ivf.assign_lists(base, c), ivf.probes(q, c, 4)
    rows = lambda d: sorted((r.qid, r.rank, r.id) for r in d.collect())
    want = rows(ivf.search_preassigned(q, chosen, lists, 5))
    assert rows(ivf.big_batch_search(q, chosen, lists, 5, batches=3)) == want
    # what a broken run has found isn't computed again: here a batch that found nothing
    done = spark.createDataFrame([(-1, -1, 0.0, 1)], "qid long, id long, dist double, batch int")
    assert len(rows(ivf.big_batch_search(q, chosen, lists, 5, batches=3, done=done))) <= len(want) + 1


def test_offline_run_goes_on(spark, tmp_path):
    from lodestar.plans import offline

    base = frame(spark, np.concatenate([BASE, BASE[:10]]))
    q = base.where("id % 50 = 0").toDF("qid", "qv")
    path = f"file://{tmp_path}/run"
    first = offline.run(base, q, "IVF3,SQ8", path, shards=2, nprobe=3)
    assert first["unique"].count() == 300 and first["scores"].agg(F.min("recall")).first()[0] == 1
    again = offline.run(base.limit(0), q, "IVF3,SQ8", path, shards=2, nprobe=3)  # all steps are there
    assert again["refined"].count() == first["refined"].count() > 0


def test_settled_keeps_only_its_result(spark):
    import os

    from lodestar.sources.shared import _written, clear, materialize, settled

    out = settled(spark, lambda: materialize(spark.range(5), "a").unionAll(materialize(spark.range(3), "b")), "c")
    kept = _written.paths[-1].removeprefix("file://")
    assert out.count() == 8 and os.listdir(kept) == ["c"]
    clear(spark)
    assert not os.path.exists(kept) and not _written.paths


def test_jobs_that_take_too_long_are_cancelled(spark):
    import time

    from lodestar.sources.shared import within

    def slow(batches):
        for b in batches:
            time.sleep(30)
            yield b

    assert within(spark, 60, lambda: spark.range(10).count()) == 10
    start = time.time()
    with pytest.raises(TimeoutError):
        within(spark, 2, lambda: spark.range(4).mapInArrow(slow, "id long").count())
    assert time.time() - start < 25 and spark.range(3).count() == 3


def test_index_paths():
    one = datasets.index_path("/x/", "glove 100", "IVF16,PQ8x4", m=3, ef=64)
    assert one == "/x/glove_100/IVF16_PQ8x4-ef64-m3" != datasets.index_path("/x/", "glove 100", "IVF16,PQ8x4", m=4, ef=64)


def test_running_sums_by_brute_force(spark):
    from lodestar.operators import ordered

    x = RANDOM.permutation(500).tolist()
    rows = spark.createDataFrame([(v, (v * 7) % 11) for v in x], "k int, w int").repartition(7)
    got = {r.k: (r.before, r.least, r.rank) for r in ordered.numbered(ordered.running(rows, ["k"], {"before": ("sum", F.col("w")), "least": ("min", F.col("w"))}), ["k"]).collect()}
    w = [(v * 7) % 11 for v in range(500)]
    assert got == {k: (sum(w[:k]), min(w[:k], default=None), k + 1) for k in range(500)}


def test_list_containers(spark):
    a = spark.createDataFrame([(1, 0), (2, 1)], "id long, list_no int")
    b = spark.createDataFrame([(3, 1), (4, 2)], "id long, list_no int")
    ids = lambda d: sorted((r.id, r.list_no) for r in d.collect())
    assert ids(ivf.stacked([a, b], vertical=True)) == [(1, 0), (2, 1), (3, 3), (4, 4)]
    assert ids(ivf.masked(a, b)) == [(1, 0), (2, 1), (4, 2)]
    assert ids(ivf.sliced(b, 1, 2)) == [(3, 0)]
    assert ids(ivf.without_large(a.unionAll(b), 1)) == [(1, 0), (4, 2)]


def test_vector_files(spark, tmp_path):
    base = frame(spark, np.arange(12).reshape(4, 3))
    for kind in ("fvecs", "bvecs", "ivecs"):
        path = f"file://{tmp_path}/x.{kind}"
        vecs.write_vectors(base, path, kind)
        assert sorted((r.id, r.embedding) for r in vecs.read_vectors(spark, path).collect())[2] == (2, [6.0, 7.0, 8.0])
    (tmp_path / "x.fbin").write_bytes(np.array([2, 2], "<i4").tobytes() + np.arange(4, dtype="<f4").tobytes())
    assert [r.embedding for r in vecs.read_vectors(spark, f"file://{tmp_path}/x.fbin").orderBy("id").collect()] == [[0, 1], [2, 3]]
    (tmp_path / "bad.fvecs").write_bytes(np.array([3], "<i4").tobytes() + b"1234")
    with pytest.raises(Exception, match="whole rows"):
        vecs.read_vectors(spark, f"file://{tmp_path}/bad.fvecs").collect()
    with pytest.raises(ValueError):
        vecs.check_chunks(["a_0", "a_2"])


@pytest.mark.parametrize("kind", sorted(vecs.KINDS))
def test_files_are_cut_and_chunked(spark, tmp_path, kind):
    ids = [16_777_217, 33_554_433, 7, 2**31 - 1] if "i" in kind[:2] and kind != "fbin" else [1, 2, 7, 200]
    n = 41
    rows = spark.createDataFrame([(1000 - i, [float(ids[i % 4]), float(i)]) for i in range(n)] + [(5000, None)], "id long, v array<double>").repartition(3)
    path = f"file://{tmp_path}/many.{kind}"
    names = vecs.write_vectors(rows, path, kind, chunk_bytes=100)
    assert len(names) > 2
    want = [[ids[i % 4], i] for i in range(n - 1, -1, -1)]
    one = tmp_path / f"one.{kind}"
    raw = [open(x.replace("file://", ""), "rb").read() for x in names]
    headed = kind in vecs.HEADED
    one.write_bytes((np.array([n, 2], "<i4").tobytes() if headed else b"") + b"".join(r[8 * headed :] for r in raw))
    whole = vecs._read_whole(spark, str(one), kind)
    for split in (1, 60, 1 << 20):
        for found in (vecs.read_vectors(spark, path, split_bytes=split), vecs.read_vectors(spark, f"file://{one}", split_bytes=split), whole):
            assert [r.embedding for r in found.orderBy("id").collect()] == want
    found = vecs.read_vectors(spark, f"file://{one}", split_bytes=one.stat().st_size // 5)
    assert found.rdd.getNumPartitions() >= 4 and [r.id for r in found.orderBy("id").collect()] == list(range(n))
    assert vecs.read_vectors(spark, path).schema["embedding"].dataType.elementType.simpleString() == ("bigint" if kind in ("ivecs", "ibin") else "float")


def test_vector_files_without_rows(spark, tmp_path):
    (tmp_path / "x.fvecs").write_bytes(b"")
    assert vecs.read_vectors(spark, f"file://{tmp_path}/x.fvecs").count() == 0
    assert vecs.write_vectors(spark.createDataFrame([], "id long, v array<float>"), f"file://{tmp_path}/y.fvecs") == []


def test_sparse_ids_go_on(spark, tmp_path):
    rows = spark.createDataFrame([(i, [i % 3, 5], [float(i), 1.0]) if i % 4 else (i, [], []) for i in range(30)], "id long, indices array<int>, values array<double>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        names = vecs.write_sparse(rows.repartition(4), f"file://{tmp_path}/s")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(names) > 1 and sorted(map(tuple, vecs.read_sparse(spark, f"file://{tmp_path}/s").collect())) == sorted(map(tuple, rows.collect()))


def test_synthetic_is_stable(spark):
    a, b = datasets.synthetic(spark, 8, 20, 5), datasets.synthetic(spark, 8, 20, 5)
    assert sorted(map(str, a.base.collect())) == sorted(map(str, b.base.repartition(3).collect()))
    assert a.ground_truth(3).count() == 15


def test_csv_rows_are_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    one = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    one.write.csv(path, header=True)
    out = datasets.replace_rows(spark, path, spark.createDataFrame([("b", 3)], "k string, v int"), ["k"], ["k"])
    assert [(r.k, r.v) for r in out.orderBy("k").collect()] == [("a", 1), ("b", 3)]


def test_stream_appends_slices_once(spark, tmp_path):
    frame(spark, BASE[:10]).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        stream = spark.readStream.schema("id long, embedding array<double>").parquet(f"{tmp_path}/in")
        ingest.append(stream, f"{tmp_path}/base", f"{tmp_path}/ck").awaitTermination(60)
    base = spark.read.parquet(f"{tmp_path}/base")
    assert base.count() == 10 and ingest.newest(base, 1).count() == 10 and ingest.latest(base).count() == 10


def test_streamed_queries(spark, tmp_path):
    base = frame(spark, BASE)
    base.where("id < 3").toDF("qid", "qv").write.parquet(f"{tmp_path}/q")
    stream = spark.readStream.schema("qid long, qv array<double>").parquet(f"{tmp_path}/q")
    ingest.searched(stream, base, 2, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(60)
    assert sorted((r.qid, r.id) for r in spark.read.parquet(f"{tmp_path}/out").where("rank = 1").collect()) == [(0, 0), (1, 1), (2, 2)]


# --- probes of calibration ---

def plain_uniform(rows, n, low, high):
    rows, out = sorted(rows), []
    edge = [low + (high - low) * i / n for i in range(n)] + [high]
    for i in range(n):
        a, b = edge[i], edge[i + 1]
        inside = [r for r in rows if a <= r[0] and (r[0] <= b if i == n - 1 else r[0] < b)]
        out.append(min(inside or rows, key=lambda r: abs(r[0] - (a + b) / 2)))
        rows.remove(out[-1])
    return [i for _, i in out]


def test_probes_look_at_every_vector(spark, tmp_path):
    n = 11_000  # more than the sample that they once took
    x = np.random.default_rng(4).normal(size=(n, 3)).astype(np.float32)
    spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    x, lid = x.astype(float), np.zeros(n)
    for i in range(n):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        near = np.partition(d, 19)[:20]
        lid[i] = -20 / np.log(near / near.max()).sum()
    low, high = np.percentile(lid, [1, 99])
    rows = sorted((v, i) for i, v in enumerate(lid.tolist()) if low <= v <= high)
    chunks = [c.tolist() for c in np.array_split(np.arange(len(rows)), 50)]
    got = sorted(QUERIES["quantile_probes"](spark, str(tmp_path)).collect())
    assert [r.id for r in got] == [rows[c[len(c) // 2]][1] for c in chunks]
    assert np.allclose([[r.lid, r.bucket_lower, r.bucket_upper] for r in got], [[rows[p][0] for p in (c[len(c) // 2], c[0], c[-1])] for c in chunks], atol=1e-4)
    got = sorted(calibrate.uniform_probes(queries_evaluation._trimmed(spark, str(tmp_path)), 50).collect())
    assert [r.id for r in got] == plain_uniform(rows, 50, low, high)


@pytest.mark.parametrize("n", [1, 7, 40])
def test_uniform_probes_by_brute_force(spark, n):
    r = np.random.default_rng(n)
    lids = np.round(np.concatenate([r.normal(3, 0.1, 300), r.normal(9, 0.5, 15), [20.0] * 5]), 2)  # ties and empty ranges
    rows = [(v, i) for i, v in enumerate(lids.tolist())]
    out = sorted(calibrate.uniform_probes(spark.createDataFrame(rows, "lid double, id long"), n).collect())
    assert [p.id for p in out] == plain_uniform(rows, n, min(lids), max(lids))


def test_index_as_tables(spark):
    from lodestar.plans import inspection

    base = frame(spark, RANDOM.normal(size=(300, 8)))
    index = factory.build(base, "PCA6,IVF4,PQ3x3")
    matrix = np.array([r.weights for r in inspection.projections(index).orderBy("row").collect()])
    added = np.array([r.added for r in inspection.projections(index).orderBy("row").collect()])
    v = {r.id: np.array(r.embedding) for r in base.collect()}
    moved = {r.id: np.array(r.embedding) for r in index.moved(base).collect()}
    assert all(np.allclose(matrix @ v[i] + added, moved[i], atol=1e-6) for i in v)
    kept = {r.id: r.embedding for r in index.kept().collect()}
    again = {r.id: r.embedding for r in inspection.together(index).collect()}
    assert kept.keys() == again.keys() and all(np.allclose(kept[i], again[i]) for i in kept)
    lists = inspection.lists(index).collect()
    assert sorted(r.list_no for r in lists) == [0, 1, 2, 3] and sum(r.n for r in lists) == 300 and sum(r.bytes for r in lists) == 600
    assert inspection.books(index).count() == 3 * 8 and all(0 <= c < 8 for r in inspection.codes(index).collect() for c in r.codes)
    flat = factory.build(base, "SQ8")
    assert inspection.centroids(flat).count() == inspection.books(flat).count() == inspection.projections(flat).count() == 0
    assert [r.n for r in inspection.lists(flat).collect()] == [300]
    with pytest.raises(ValueError):
        inspection.together(flat)


def test_bucket_sort(spark):
    from lodestar.functions import vectors

    rows = spark.createDataFrame([(2, 7), (None, 9), (2, 1), (1, 3), (None, 4), (2, 1)], "value int, id long")
    found = sorted(map(tuple, vectors.bucket_sort(rows).collect()), key=lambda r: r[2])
    assert found == [(None, 4, 1, 2, 0), (None, 9, 2, 2, 0), (1, 3, 3, 1, 2), (2, 1, 4, 3, 3), (2, 1, 5, 3, 3), (2, 7, 6, 3, 3)]
    assert vectors.bucket_sort(rows.where("false")).count() == 0
