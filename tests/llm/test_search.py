"""Fingerprints, importance resampling and lexical search."""

import binascii
import glob
import math
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.llm import fingerprints, lexical, resampling
from lodestar.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import SMALL
from tests.llm import brute

ODD = [(1, None), (2, ""), (3, "\n"), (4, "..."), (5, "No sentence mark here\n\nÉté 中文 🙂 x!"), (6, "a"), (6, "a"), (6, "other text"), (None, "no id"), (9, "\x00\x01 \t")]


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"word{i % 977}." for i in range(400_000))  # over 3 MB
    rows = [*ODD, (7, long), (8, "x" * 300_000), (10, " " * 1_200_000 + "x")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"Root": F.lit(1), "version": F.lit(2), "own": F.lit(3)})


@pytest.mark.parametrize("name", ["op11_fingerprints", "op12_importance_resampling", "op13_lexical_search"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    got, want = QUERIES[name](spark, SMALL), con.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    key = sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select(*key).collect()))) == sorted(map(str, want.project(", ".join(key)).fetchall()))


# --- fingerprints ---

def leaves(text):
    """(paragraph, start, piece) in order, by a plain loop."""
    out, at = [], 0
    for p, line in enumerate(text.split("\n")):
        piece = start = None
        for i, c in enumerate(line):
            if piece is None:
                piece, start = "", at + i
            if c in ".!?":
                out.append((p, start, piece + c))
                piece = None
            elif len(piece) == 64:
                out.append((p, start, piece))
                piece, start = c, at + i
            else:
                piece += c
        if piece:
            out.append((p, start, piece))
        at += len(line) + 1
    return out


def test_edited_by_brute_force(spark, odd):
    got = fingerprints.edited(odd).collect()
    rows = odd.collect()
    ids = sorted({r.doc_id for r in rows}, key=lambda i: (i is not None, i or 0))
    texts = {i: sorted({r.text or "" for r in rows if r.doc_id == i}) for i in ids}
    assert len(got) == len(rows) and {"Root", "own"} < set(got[0].asDict())
    for r in got:
        following = texts[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        fits = []
        for text in texts[r.doc_id]:
            for n in following:
                q = len(text) // 4
                new = text[: len(text) - q] + n[:q]
                fits.append((len(text), brute.sha(new), text, new))
        text, new = next((t, e) for n, h, t, e in fits if (n, h) == (r.n_chars, r.edited_sha256))
        a, b = ({x[2] for x in leaves(y)} for y in (text, new))
        chars = lambda pieces: sum(map(len, pieces))
        if text == new:
            assert r.near_edited == 1 and r.edit_at is None and r.fingerprint == r.edited_fingerprint
        else:
            assert abs(r.near_edited - chars(a & b) / max(chars(a), chars(b), 1)) < 1e-9 and r.fingerprint.split("|")[0] != r.edited_fingerprint.split("|")[0]
            first = next((i for i, (x, y) in enumerate(zip(text, new)) if x != y), min(len(text), len(new)))
            assert r.edit_at <= first and first - r.edit_at <= 65
        assert len(r.fingerprint.split("|")) == 4 and sum(int(x.split(":")[1]) for x in r.fingerprint.split("|")[3].split()) + text.count("\n") == len(text)
    assert len({r.fingerprint for r in got if r.doc_id in (1, 2)}) == 1


def test_next_of_one_and_of_none(spark):
    one = spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")
    r = fingerprints.edited(one).first()
    assert r.edited_sha256 == brute.sha("abcdefab") and r.near_next == 1.0 and r.near_edited == 0.0
    assert fingerprints.edited(one.limit(0)).count() == 0 and fingerprints.fingerprints(one.limit(0)).count() == 0


def test_quarters_of_a_table(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    ids = sorted(docs)
    got = QUERIES["op11_fingerprints"](spark, SMALL).collect()
    assert np.mean([r.near_edited for r in got]) > 0.68 and np.mean([r.near_next for r in got]) < 0.01
    for r in got:
        text, following = docs[r.doc_id], docs[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        q = len(text) // 4
        assert (r.n_chars, r.edited_sha256) == (len(text), brute.sha(text[: len(text) - q] + following[:q]))
        assert r.near_edited > max(0.3, r.near_next) or len(text) < 1000 and r.near_edited >= r.near_next


def test_edits_are_located(spark):
    old = "First one. Second one. Third one.\n\nA new section begins. It goes on!\nLast paragraph? Yes."
    new = old.replace("goes on", "stops here").replace("Second", "2nd")
    rows = spark.createDataFrame([(1, old, new), (2, old, old), (3, old, "Before.\n" + old)], "id long, a string, b string")
    rows = fingerprints.fingerprints(fingerprints.fingerprints(rows, "a", "fa"), "b", "fb")
    spans = sorted((r.id, r.start, r.len) for r in fingerprints.changed_pieces(rows, "id", "fa", "fb").collect())
    assert [(i, {1: new, 3: "Before.\n" + old}[i][s : s + n]) for i, s, n in spans] == [(1, " 2nd one."), (1, " It stops here!"), (3, "Before.")]
    at = {r.id: r.edit_at for r in fingerprints.with_first_edit(rows, "fa", "fb").collect()}
    assert at == {1: old.index(" Second"), 2: None, 3: 0}


def test_fingerprints_stay_native(spark):
    plan = fingerprints.edited(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- importance resampling ---

def features(text, n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def resample(docs, target, n, buckets=10_000):
    bucket = lambda f: binascii.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, d in docs for f in features(d, n)[1]), Counter(bucket(f) for d in target for f in features(d, n)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for i, d in docs:
        words, found = features(d, n)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(brute.sha(f"2024:{'null' if i is None else i}")[:8], 16)
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= 20))
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[: 10 * len(able) // 100]
    return sorted(map(str, [(*r[:4], drawn.index(r) + 1 if r in drawn else None) for r in out]))


@pytest.mark.parametrize("n,size", [(1, 16384), (1, 100), (2, 16384), (3, 64), (3, 1)])
def test_resampling_by_brute_force(spark, odd, n, size):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionAll(odd.select("doc_id", "text").where("length(text) < 500 or text is null"))
    target = spark.read.parquet(f"{SMALL}/benchmark.parquet").select("text")
    if size < 100:
        docs = docs.where("doc_id < 40 or doc_id is null")
    got = resampling.resample(docs, target, n=n, size=size).collect()
    assert sorted(map(str, map(tuple, got))) == resample([tuple(r) for r in docs.collect()], [r.text for r in target.collect()], n)


@pytest.mark.parametrize("n", [1, 2, 4])
def test_chunks_own_every_feature_once(spark, n):
    texts = ["a b c d e f g h", "", None, "one" * 50, "é 中 a-b; C", "x " * 200 + "!" * 90 + " end", "..." * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    for size in (1, 3, 7, 1000):
        parts = resampling.chunks(docs, n=n, size=size)
        got = {r.i: Counter() for r in docs.collect()}
        for r in parts.select("i", resampling.buckets_of(F.col("own"), F.col("carry"), n, 2**31 - 1).alias("b")).collect():
            got[r.i].update(r.b)
        assert got == {i: Counter(binascii.crc32(f.encode()) % (2**31 - 1) for f in features(t, n)[1]) for i, t in enumerate(texts)}


def test_resampling_of_odd_rows(spark, odd):
    target = spark.createDataFrame([("word1 word2",), (None,)], "text string")
    out = resampling.resample(odd, target).collect()
    assert len(out) == odd.count() and {r.n_features for r in out if r.doc_id == 7} == {400_000} and {r.n_features for r in out if r.doc_id == 8} == {1}
    assert resampling.resample(odd.limit(0), target).count() == 0
    assert resampling.resample(odd, target.limit(0)).count() == odd.count()
    many = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("word1 " * 30).alias("text"))
    kept = resampling.resampled(many, target)
    assert kept.columns == many.columns and kept.count() == many.count() // 10


# --- lexical search ---

def ranked(docs, items, k=50):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    bags = [(i, Counter(words(t))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n, length = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item in {i for i, _ in items}:
        asked = {w for i, t in items if i == item for w in words(t)}
        scores = []
        for (i, b), size in zip(bags, sizes):
            m = 100 - 50 + (50 * size * n) // length if length else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * b[w]) // (1000 * b[w] + 20 * m)) for w in asked if w in b)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("shard,most", [(2048, 200_000), (7, 200_000), (1, 40)])
def test_search_by_brute_force(spark, odd, shard, most):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionAll(odd.select("doc_id", "text").where("length(text) < 500 or text is null"))
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").unionAll(spark.createDataFrame([(900, None), (901, "a text 中文 no"), (901, "OTHER"), (None, "été x"), (902, "nowhere_to.be")], "item_id long, text string"))
    if most < 100:
        items = items.where("item_id > 30 or item_id is null")
    got = lexical.ranked_search(docs, items, shard=shard, most_terms=most).collect()
    assert sorted(map(str, map(tuple, got))) == ranked([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])


def test_search_of_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "word5 word6"), (2, "x")], "item_id long, text string")
    got = lexical.ranked_search(odd, items).collect()
    assert {(r.item_id, r.doc_id) for r in got} == {(1, 7), (2, 5), (2, 10)}
    assert lexical.ranked_search(odd.limit(0), items).count() == 0 and lexical.ranked_search(odd, items.limit(0)).count() == 0
    assert lexical.passes([(1, ["a", "b"]), (2, ["b", "c"]), (3, ["d", "e", "f", "g"]), (4, ["d"])], 3) == [[(1, ["a", "b"]), (2, ["b", "c"])], [(3, ["d", "e", "f", "g"])], [(4, ["d"])]]


def test_many_ties_keep_the_smallest_ids(spark):
    docs = spark.range(3000).select((F.lit(2999) - F.col("id")).alias("doc_id"), F.lit("same words here").alias("text")).repartition(5)
    docs = docs.unionAll(spark.createDataFrame([(i, "else") for i in range(9000, 9100)], "doc_id long, text string"))
    items = spark.createDataFrame([(1, "words")], "item_id long, text string")
    got = sorted((r["rank"], r.doc_id) for r in lexical.ranked_search(docs, items, shard=512).collect())
    assert got == [(i + 1, i) for i in range(50)] or not got  # a term that most documents hold may weigh nothing


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 70), st.integers(1, 12), st.integers(0, 2**32 - 1), st.integers(1, 8))
def test_tree_finds_the_best(n_docs, n_terms, seed, k):
    rng = np.random.default_rng(seed)
    table = rng.integers(0, 6, (n_terms, n_docs)) * (rng.random((n_terms, n_docs)) < 0.4)
    term, doc = np.nonzero(table)
    if not len(term):
        return
    go = rng.permutation(len(term))
    tree = lexical.Tree(doc[go], n_docs, term[go], table[term, doc][go])
    wanted, weight = np.arange(0, n_terms + 2, 2), rng.integers(0, 9, len(range(0, n_terms + 2, 2)))
    scores = sum((w * table[t] for t, w in zip(wanted, weight) if t < n_terms), np.zeros(n_docs, int))
    want = sorted([(-s, i) for i, s in enumerate(scores.tolist()) if s > 0])[:k]
    docs, found, _ = tree.best(wanted, weight, k, first=2)
    assert sorted(zip((-found).tolist(), docs.tolist()))[:k] == want
