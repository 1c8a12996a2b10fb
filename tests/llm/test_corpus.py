"""Quality, mixing, sharding, near-dedup of vectors and documents, pipeline."""

import glob
import math
import sys
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.llm import embed_dedup, minhash, mixing, quality, sharding, shared
from lodestar.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import SMALL
from tests.llm import brute

RANDOM = np.random.default_rng(9)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got, want = QUERIES[name](spark, SMALL).toPandas(), con.sql(ORACLE_SQL[name]).df()
    key = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).to_dict("split")["data"]))
    assert sorted(got.columns) == sorted(want.columns) and key(got) == key(want)


# --- components ---

def test_components(spark):
    edges = [(int(a), int(b)) for a, b in RANDOM.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(40)] + [(200, 300 + i) for i in range(50)]
    got = {r.id: r.component for r in shared.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute.components({x for e in edges for x in e}, edges)
    assert got == {i: c for i, c in want.items() if sum(w == c for w in want.values()) > 1}
    assert shared.connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


@given(st.integers(1, 40), st.lists(st.tuples(st.integers(0, 39), st.integers(0, 39)), max_size=60))
def test_forest(n, pairs):
    pairs = [(a % n, b % n) for a, b in pairs]
    i, j = np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int)
    assert dict(enumerate(embed_dedup.forest(n, i, j).tolist())) == brute.components(range(n), pairs)


# --- quality ---

def test_weak_labels_find_accuracies():
    n, right = 20000, np.array([0.95, 0.9, 0.85, 0.8, 0.9, 0.85, 0.9])
    good = RANDOM.random(n) < 0.7
    says = np.where(RANDOM.random((n, 7)) < right, good[:, None], ~good[:, None])
    votes = np.where(RANDOM.random((n, 7)) < 0.8, np.where(says, quality.GOOD, quality.BAD), quality.NONE)
    patterns = Counter(map(tuple, votes.tolist()))
    model = quality.fit_weak_labels(list(patterns), list(patterns.values()))
    assert np.allclose(list(model.accuracies().values()), right, atol=0.03) and abs(model.prior - 0.7) < 0.03
    assert ((model.posterior(votes) > 0.5) == good).mean() > 0.97


def test_distinct_words_of_whole_texts():
    at = [name for name, *_ in quality.LABELLERS].index("distinct words")
    clean, junk = [f"w{i}" for i in range(3000)], [f"j{i % 7}" for i in range(3000)]
    vote = lambda *parts: quality.votes(" ".join(w for p in parts for w in p))[at]
    assert vote(clean) == quality.GOOD and vote(junk) == quality.BAD
    # junk only in the middle, much of it and little
    assert vote(clean[:200], junk, clean[-200:]) == quality.BAD
    assert vote(clean[:400], junk, clean[-400:]) == vote(clean, junk[:500], clean) == quality.NONE
    assert vote(junk[:200], clean * 6, junk[-200:]) != quality.BAD  # clean but for its ends
    words = [f"w{i}" for i in range(1000)] + ["x"] * 100
    assert quality.distinct_shares(words) == [1.0] * 5 + [101 / 200]
    assert [quality.distinct_shares(words[:n]) for n in (1, 200, 201, 400)] == [[1.0], [1.0], [1.0] * 2, [1.0] * 2]


def test_op2_by_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("hash", F.xxhash64("text")).collect()
    want = dict(zip([r.doc_id for r in docs], brute.quality_scores([r.text for r in docs], [r["hash"] for r in docs])))
    got = QUERIES["op2_quality_classifier"](spark, SMALL).collect()
    assert len(got) == len(docs) and all(abs(r.score - want[r.doc_id]) < 1e-4 and r.kept == (r.score >= 0.5) for r in got)


def test_sample_is_bounded_by_features(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    few, one = quality.fit(docs, features_most=20_000), quality.fit(docs, features_most=1)
    used = [int((m.scorer != 0).sum()) for m in (one, few, quality.fit(docs))]
    assert 1 < used[0] < used[1] < used[2] and few.weak.prior == one.weak.prior


def test_held_out_accuracy(spark):
    # of a few hundred documents only two or three are junk of some kinds, which is too few to learn from
    big = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    model = quality.fit(docs.where("doc_id % 2 = 0"))
    out = quality.score(docs.where("doc_id % 2 = 1"), model).join(labels, "doc_id").select("kept", "quality").collect()
    bad = [not r.kept for r in out if r.quality == 0]
    kept = [r.kept for r in out if r.quality == 1]
    assert np.mean(bad) >= 0.97 and np.mean(kept) >= 0.99


def test_quality_of_odd_rows(spark):
    good = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n"), (-4, "..."), (-5, "word " * 50000), (-6, "a"), (-6, "a")], "doc_id long, text string")
    out = quality.classify(good.unionAll(odd).withColumn("Score", F.lit("x")))
    rows = [r for r in out.collect() if r.doc_id < 0]
    assert len(rows) == 7 and all(r.score == 0 and not r.kept for r in rows if r.doc_id > -5)
    assert len({r.score for r in rows if r.doc_id == -6}) == 1
    kept = quality.keep_good(good.unionAll(odd).withColumn("score", F.lit("x")))
    assert kept.columns == ["doc_id", "text", "score"] and kept.first().score == "x"
    assert quality.classify(odd.limit(0)).count() == 0 and quality.classify(odd.where("doc_id > -4 and doc_id < 0")).where("kept").count() == 0


# --- mixing ---

def mix_rows(spark, n=300):
    rows = [(i, [None, "a", "b", "é", "a"][i % 5], " ".join(["w"] * int(RANDOM.integers(0, 40)))) for i in range(n)] + [(7, "b", "x y z")] * 3 + [(None, "b", "q"), (5, "c", None)]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("key", F.lit("k")).withColumn("size", F.lit(-1))


@pytest.mark.parametrize("m", [mixing.Mix(), mixing.Mix(share=2.5), mixing.Mix(weights=(50, 1), share=1.9), mixing.Mix(weights=(1,), share=0.1)])
def test_mix_by_brute_force(spark, m):
    rows, docs = mix_rows(spark)
    out = mixing.mix_sources(docs, m).collect()
    size = Counter()
    for _, s, t in rows:
        size[s] += len(brute.tokens(t))
    want = brute.targets(size, m.weights, m.share, m.most) if m.share <= m.most else {s: m.most * n for s, n in size.items()}
    taken = Counter()
    for r in out:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= m.most * r.size
        taken[r.source] += r.taken
    assert len(out) == len(rows) and all(taken[s] == math.floor(r.target) for r in out for s in [r.source])
    again = mixing.mix_sources(docs.repartition(7), m).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_mixed_documents(spark):
    rows, docs = mix_rows(spark)
    for m in (mixing.Mix(), mixing.Mix(share=0.4)):
        out = mixing.mixed(docs, m)
        assert out.columns == docs.columns
        words = Counter()
        for r in out.collect():
            words[r.source] += len(brute.tokens(r.text))
        taken = Counter()
        for r in mixing.mix_sources(docs, m).collect():
            taken[r.source] += r.taken
        assert +words == +taken
    assert mixing.mixed(docs.limit(0)).count() == 0 and mixing.mix_sources(docs.limit(0)).count() == 0


def test_first_tokens(spark):
    d = spark.createDataFrame([(" a  b\nc ", n) for n in (1, 2, 3)], "t string, n long")
    assert [r[0] for r in d.select(mixing.first_tokens(F.col("t"), F.col("n"))).collect()] == [" a", " a  b", " a  b\nc"]


# --- sharding ---

def split(rows, limit, depth=0, prefix=0):
    """Splits (hash, bytes, doc_id) bucket by bucket."""
    if sum(r[1] for r in rows) <= limit or len({r[0] for r in rows}) == 1:
        return {r[2]: (depth, prefix) for r in rows}
    out = {}
    for bit in (0, 1):
        part = [r for r in rows if r[0] >> (sharding.BITS - depth - 1) & 1 == bit]
        out |= split(part, limit, depth + 1, prefix * 2 + bit) if part else {}
    return out


@pytest.mark.parametrize("limit", [1, 100, 3000, 10**9])
def test_shards_by_brute_force(spark, limit):
    rows = [(i, "x" * int(RANDOM.integers(0, 90))) for i in range(150)] + [(200, "y" * 5000), (201, None), (None, "null"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("prefix", F.lit(1)).withColumn("cell", F.lit(2))
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", sharding.hash_bits(F.col("doc_id")).alias("h")).collect()}
    want = split([(hashes[i], len(t or ""), i) for i, t in rows], limit)
    out = sharding.assign(docs, limit).collect()
    assert len(out) == len(rows) and all((r.depth, r.prefix) == want[r.doc_id] for r in out)
    assert all(r.oversized == (r.shard_bytes > limit) for r in out)
    assert sum({r.shard: r.shard_bytes for r in out}.values()) == sum(len(t or "") for _, t in rows)
    assert sharding.assign(docs.limit(0), limit).count() == 0


def test_shards_are_written(spark, tmp_path):
    docs = spark.createDataFrame([(i, "t" * 50, "a") for i in range(40)], "doc_id long, text string, shard string")
    sharding.write_shards(docs, f"file://{tmp_path}/s", 400)
    got = spark.read.parquet(f"file://{tmp_path}/s")
    assert got.count() == 40 and got.groupBy("shard_").agg(F.sum(F.length("text")).alias("n")).where("n > 400").count() == 0


@pytest.mark.parametrize("limit", [300, 10**9])
def test_rows_of_written_shards(spark, limit):
    rows = [(i, "é" * int(RANDOM.integers(0, 90)), "a") for i in range(150)] + [(200, "y" * 5000, "b"), (201, None, None), (None, "null", "c"), (3, "again", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    columns = sharding.assign(docs, limit).columns
    out = sharding.shard(docs, limit)
    assert out.columns == columns and sorted(map(str, out.collect())) == sorted(map(str, sharding.assign(docs, limit).collect()))
    assert sharding.shard(docs.limit(0), limit).count() == 0


def test_op4_writes_the_texts(spark):
    root = shared.materialize(spark.range(1), "one").inputFiles()[0].removeprefix("file://").rsplit("/", 3)[0]
    before = set(glob.glob(f"{root}/*/shards/shard=*"))
    got = {r.doc_id: r.shard for r in QUERIES["op4_sharding"](spark, SMALL).collect()}
    new = set(glob.glob(f"{root}/*/shards/shard=*")) - before
    there = Counter((r.doc_id, r.text, path.rsplit("=")[-1]) for path in new for r in spark.read.parquet(f"file://{path}").collect())
    assert there == Counter((r.doc_id, r.text, got[r.doc_id]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())


# --- embedding near-dedup ---

def brute_links(rows):
    ok = [(i, np.array(v, float), c) for i, v, c in rows if i is not None and v and c is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    return [(a, b) for k, (a, x, c) in enumerate(ok) for b, y, d in ok[:k] if c == d and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93]


def test_vectors_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    centres = RANDOM.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + RANDOM.normal(size=8) * 0.28).tolist(), i % 2) for i in range(200)]
    rows += [(300 + i, rows[0][1], 0) for i in range(40)]
    rows += [(400, None, 0), (401, [0.0] * 8, 0), (402, [float("nan")] + [1.0] * 7, 0), (403, [float("inf")] * 8, 0), (404, [], 0), (405, rows[0][1], None), (406, [1.0, 2.0], 0), (407, [None] + [1.0] * 7, 0), (408, [2.0, 4.0], 0), (None, rows[0][1], 0)]
    out = embed_dedup.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, n_links int")).collect()
    links = brute_links(rows)
    n, parts = Counter(x for e in links for x in e), brute.components([r[0] for r in rows if r[0] is not None], links) | {None: None}
    assert len(out) == len(rows) and {r.vec_id: (r.n_links, r.component_id) for r in out} == {i: (n[i], parts[i]) for i, *_ in rows}
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)  # a null one too


def test_bound_holds():
    v = embed_dedup.unit_rows(RANDOM.normal(size=(80, 20)) * RANDOM.lognormal(size=(80, 1)) * RANDOM.lognormal(0, 2, size=(1, 20)))
    q, s, e = x = embed_dedup.quantised(v)
    cosines = np.einsum("ik,jk->ij", v, v)
    assert (abs(cosines - (q.astype(float) @ q.T) * s[:, None] * s) <= e[:, None] * (1 + e) + e + 1e-12).all()
    sure, open_ = embed_dedup.by_bound(x, x, 0.5)
    assert (cosines[sure] >= 0.5).all() and (cosines[~sure & ~open_] < 0.5).all() and 0 < open_.sum() < sure.sum()
    i, j = embed_dedup.exact_pairs(v, v, *np.nonzero(open_), 0.5)
    assert (sure | open_)[cosines >= 0.5].all() and set(zip(i.tolist(), j.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(open_ & (cosines >= 0.5)))))


def test_vectors_of_all_sizes(spark):
    rows = [(1, [1e200, 1e200], 0), (2, [1e200, 1e200], 0), (3, [5e-324, 5e-324], 0), (4, [1e-300, 1e300], 0), (5, [0.0, 2.0], 0), (5, [0.0, 2.0], 0), (5, [3.0, 0.0], 0), (6, [1e308, 0.0], 1)]
    got = sorted(tuple(r) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    # the rows of vec_id 5 have 2, 2 and no links, which their rows of the result all show added up
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 2, 4, True)] + [(5, 4, 4, False)] * 3 + [(6, 0, 6, True)]


def test_no_vectors(spark):
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# --- MinHash near-dedup ---

def near_copies(text, share):
    words = text.split()
    for k in RANDOM.choice(len(words), max(1, int(len(words) * share)), replace=False):
        words[k] = f"new{RANDOM.integers(10**6)}"
    return " ".join(words)


def corpus():
    texts = [" ".join(f"w{x}" for x in RANDOM.integers(0, 3000, 120)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, near_copies(texts[i % 5], 0.01)) for i in range(40)] + [(200 + i, near_copies(texts[7], 0.03)) for i in range(60)]
    rows += [(300, texts[3]), (301, texts[3].upper()), (50, texts[9]), (302, "one two"), (303, "one two"), (304, "Und " * 3000), (305, "Und " * 2000 + "ende")]
    return rows


@pytest.mark.parametrize("block", [128, 8])
def test_near_classes_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = corpus()
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near_classes(rows)


@given(text=st.text(st.sampled_from("ab1_é中 \n-.\ud800\U0001f642²"), max_size=60), piece=st.sampled_from([1, 2, 3, 7, 1 << 16]))
def test_words_are_those_of_the_pattern(text, piece):
    known = {w: minhash.word_hashes(w)[0] for w in minhash.WORD.findall(text)}
    assert len(set(known.values())) == len(known)
    assert minhash.word_hashes(text).tolist() == [known[w] for w in minhash.WORD.findall(text)]
    wide = minhash.PIECE
    try:  # words that are longer than a piece have other hashes, the same wherever they stand
        minhash.PIECE = piece
        found = dict(zip(minhash.WORD.findall(text), minhash.word_hashes(text).tolist()))
        assert minhash.word_hashes(text).tolist() == [found[w] for w in minhash.WORD.findall(text)] and len(set(found.values())) == len(found)
    finally:
        minhash.PIECE = wide


def test_every_code_point_is_a_word_or_not():
    wordy = minhash._tables()[0]
    assert all(wordy[i] == bool(minhash.WORD.match(chr(i))) for i in range(0, sys.maxunicode + 1, 7)) and wordy[:128].sum() == 63


def test_shingles_by_brute_force():
    text = "a b a b a b a b c " * 30 + "long" * 40000 + " a b a b a b"
    words = minhash.WORD.findall(text)
    want = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    h, n = minhash.shingles(text, 5)
    assert sorted(n) == sorted(want.values()) and (np.diff(h.astype(object)) > 0).all()
    assert [len(x) for x in minhash.shingles(None, 5)] == [0, 0] and minhash.shingles("One", 5)[0] == minhash.shingles("one!", 5)[0]


def test_samples_estimate_similarity():
    p = minhash.Params(bands=100, rows=10)
    s, h = minhash.Sampler(p), np.sort(RANDOM.integers(0, 2**62, 400).astype(np.uint64) * np.uint64(3))
    w = RANDOM.random(400) * 3 + 0.2
    other, v = h.copy(), w.copy()
    other[::5], v[::3] = RANDOM.integers(0, 2**62, 80).astype(np.uint64), v[::3] * 1.5
    order = np.argsort(other)
    a, b = (h, w), (other[order], v[order])
    assert abs((s.draw(*a) == s.draw(*b)).mean() - minhash.weighted_jaccard(a, b)) < 0.06


def test_sketches_count_samples(spark):
    s, h = minhash.Sampler(minhash.Params()), RANDOM.integers(0, 2**62, 300).astype(np.uint64)
    w = np.ones(300)
    x, y = s.keys(np.sort(h), w)[1], s.keys(np.sort(h[:250]), w[:250])[1]
    n = sum((a >> 4 * k & 15) != (b >> 4 * k & 15) for a, b in zip(x, y) for k in range(16))
    d = spark.createDataFrame([(x, y)], "x array<long>, y array<long>")
    assert d.select(minhash.samples_apart(F.col("x"), F.col("y"), len(x))).first()[0] == n > 0


def test_odd_documents(spark):
    rows = [(1, None), (2, ""), (3, "..."), (4, "a b c d e f"), (4, "a b c d e f"), (5, "A b, c d e f"), (None, "a b c d e f"), (6, "g h i j k l"), (4, "g h i j k l")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit(0))
    got = sorted((r.doc_id, r.class_id) for r in minhash.near_duplicates(d).collect())
    assert got == [(1, 1), (2, 2), (3, 3), (4, 4), (4, 4), (4, 4), (5, 4), (6, 4)]
    kept = minhash.drop_near_duplicates(d)
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("1", None), ("2", ""), ("3", "..."), ("4", "a b c d e f"), ("None", "a b c d e f")]
    assert minhash.near_duplicates(d.limit(0)).count() == 0


def test_sketches_drop_no_pair(spark, monkeypatch):
    real = minhash.signatures
    differing = lambda *a: real(*a).withColumn("sketch", F.transform("sketch", lambda x: F.xxhash64("doc_id", x)))
    monkeypatch.setattr(minhash, "signatures", differing)
    rows = corpus()
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near_classes(rows)


def test_copies_without_words(spark):
    rows = [(1, "* * *"), (2, "🙂🙂"), (3, "* * *"), (4, "🙂🙂"), (5, "* *"), (6, None), (7, None), (8, ""), (9, ""), (10, "* * *"), (11, " "), (12, " ")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(d).collect()}
    assert got == {i: i for i in (1, 2, 5, 6, 7, 8, 9, 11)} | {3: 1, 4: 2, 10: 1, 12: 11}
    assert {r.doc_id for r in minhash.drop_near_duplicates(d).collect()} == {1, 2, 5, 6, 7, 8, 9, 11}


def test_counts_of_many_tasks(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(9)
    one = minhash.inverse_frequencies(docs, "text", 5)
    monkeypatch.setattr(minhash, "TASKS", 4)
    assert (minhash.inverse_frequencies(docs, "text", 5) == one).all() and 1 < one.min() < one.max() < 2


def test_op10_by_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r.doc_id: r.class_id for r in QUERIES["op10_minhash"](spark, SMALL).collect()}
    assert got == brute.near_classes(docs)


def test_all_plain_near_copies_are_linked(spark):
    # unweighted similarity of five-word shingles, of all pairs, by sets
    folder = SMALL.replace("sf0.001", "sf0.01")
    sets, holders = {}, {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        w = minhash.WORD.findall((r.text or "").lower())
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        for x in sets[r.doc_id]:
            holders.setdefault(x, []).append(r.doc_id)
    shared = Counter((a, b) for ids in holders.values() for k, a in enumerate(ids) for b in ids[:k])
    near = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    got = {r.doc_id: r.class_id for r in QUERIES["op10_minhash"](spark, folder).collect()}
    assert len(near) > 50 and all(got[a] == got[b] for a, b in near)


# --- pipeline ---

def test_stages_of_odd_documents(spark, tmp_path):
    import corpus_pipeline

    kind = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    good = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    text = good.where("text is not null and length(text) > 200").first().text
    odd = [(None, text, "en", None, 3), (9001, None, None, None, None), (9002, "", "en", "web", 0), (9003, text, "en", "web", 5), (9003, text, "en", "web", 5), (9004, "y " * 60000, "en", "web", 120000), (9005, "...", "en", None, 3)]
    for docs in (good.unionAll(spark.createDataFrame(odd, kind)), good.limit(0)):
        docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        # columns that the stages use for themselves, in names that clash
        rows = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("Score", F.lit("s")).withColumn("kept", F.lit("k")).withColumn("_one", F.lit(1))
        n = rows.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = shared.materialize(stage(spark, rows, str(tmp_path)), name)
            assert out.columns == rows.columns and (out.count() > 0) == (n > 0)
            if name != "mixing" and n:
                assert {(r.doc_id, r.Score, r.kept) for r in out.collect()} <= {(r.doc_id, r.Score, r.kept) for r in rows.collect()}
            rows = out
        last = corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path))
        assert last.count() == rows.count()
        assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 0

def test_pipeline_by_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = quality.fit(docs)
    rows = [r.asDict() for r in docs.collect() if model.score(r.text) >= 0.5]
    for r, (_, dropped, kept) in zip(rows, brute.dedup_lines([(r["doc_id"], r["text"]) for r in rows])):
        if dropped:
            r["text"], r["n_chars"] = kept, len(kept)
    classes = brute.near_classes([(r["doc_id"], r["text"]) for r in rows])
    rows = [r for r in rows if classes[r["doc_id"]] == r["doc_id"]]
    taken = {r.doc_id: r for r in mixing.mix_sources(spark.createDataFrame(rows, docs.schema)).collect()}
    want, encoding = Counter(), brute.encoding()
    for r in rows:
        t = taken[r["doc_id"]]
        full, part = divmod(t.taken, t.size) if t.size else (0, 0)
        texts = [r["text"]] * full
        if part:
            ends = [m.end() for m in __import__("re").finditer(mixing.TOKEN, r["text"])]
            texts.append(r["text"][: ends[part - 1]])
        for x in texts:
            ids = encoding.encode_ordinary(x)
            want[r["doc_id"], len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(x)] += 1
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SMALL).collect())
    assert got == want
    assert len({r["doc_id"] for r in rows}) > 100
