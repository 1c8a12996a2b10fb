"""MinHash near-dedup by improved consistent weighted sampling.

A document is the weighted set of its five-word shingles; a weight is one plus
the logarithm of the shingle's count, times the IDF of its bucket, as in hashed
TF-IDF. The IDF is
from 1 to 2, so that shingles which a large group of near copies shares don't
weigh next to nothing beside the few that differ. Consistent weighted samples
are banded; documents that share a band's samples are candidates. They count as
near copies if their weighted Jaccard similarity, computed from their whole
texts, reaches the threshold; only those are left out whose total weights rule
that out. Four bits of every sample tell which candidates to compare first.

Exact copies are one class from the start. Within a band's bucket all members
are first held against the smallest one; only members that still lie in
different classes are then held against each other. That takes place in tiles of
two blocks of members, each in one task, which return links that join classes,
never pairs. No candidate pair of different classes is left out.

The IDF counts all documents. It has a fixed number of buckets, so it is bounded
whatever the corpus holds; since the share of documents that meet in a bucket
doesn't depend on their number, it weighs alike at every size.

Rows: null or empty texts are a class each; other wordless texts have exact
copies only. Fewer than five words are one
shingle. Rows of one doc_id are one document, repeated or not; rows with a null
doc_id are left out. Extra columns don't matter. An empty table gives no rows."""

from __future__ import annotations

import functools
import hashlib
import math
import re
import sys
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.shared import arrow_map, connected_components, materialize, settled

WORD = re.compile(r"\w+")
#: IDF buckets, and how many of them travel in one row.
BUCKET_BITS, RANGE = 18, 1024
#: More tasks than this have their IDF counts added up in two steps.
TASKS = 256
#: Steps of the sampled distributions.
STEPS = 4096
#: Members of a bucket that make a block of its tiles.
BLOCK = 128
#: Shingles whose samples are drawn at once.
DRAWN = 256
#: The digest of null and empty texts.
EMPTY = hashlib.blake2b(b"", digest_size=16).digest()
#: Code points of a text that are hashed at once; a longer word is hashed by itself.
PIECE = 1 << 16
#: What a code point counts for at each place of a word: powers of an odd number.
STEP = 0xA0761D6478BD642F


@dataclass(frozen=True)
class Params:
    """At similarity 0.8, 24 bands of 5 samples miss a pair once in 14,000
    times, and once in 2 million at 0.85."""

    words: int = 5
    threshold: float = 0.8
    bands: int = 24
    rows: int = 5
    seed: int = 11


def _mix(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


@functools.cache
def _tables():
    """Which code points belong to words, and the powers of ``STEP`` and of its
    inverse modulo 2^64."""
    import numpy as np

    wordy = np.zeros(sys.maxunicode + 1, bool)
    for m in WORD.finditer("".join(map(chr, range(len(wordy))))):
        wordy[m.start() : m.end()] = True
    powers = []
    for x in (STEP, pow(STEP, -1, 1 << 64)):
        row = np.full(PIECE, x, np.uint64)
        row[0] = 1
        powers.append(np.cumprod(row, dtype=np.uint64))
    return wordy, *powers


def word_hashes(text: str):
    """A hash of each match of ``WORD``, in order: the sum of its mixed code
    points by the powers of their places, from prefix sums of a whole piece."""
    import numpy as np
    import xxhash

    wordy, powers, inverse = _tables()
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(text):
        points = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = wordy[points]
        if inside[-1] and at + PIECE < len(text) and wordy[ord(text[at + PIECE])]:  # a word goes on: cut before it
            gaps = np.flatnonzero(~inside)
            if not len(gaps):
                end = WORD.match(text, at).end()
                out.append(np.array([xxhash.xxh3_64_intdigest(text[at:end].encode("utf-8", "surrogatepass"))], np.uint64))
                at = end
                continue
            points, inside = points[: gaps[-1] + 1], inside[: gaps[-1] + 1]
        at += len(points)
        edge = np.empty(len(points) + 1, bool)
        edge[0], edge[-1] = inside[0], inside[-1]
        np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
        edges = np.flatnonzero(edge)
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(_mix(points.astype(np.uint64) * np.uint64(STEP)) * powers[: len(points)], out=total[1:])
        out.append(_mix((total[edges[1::2]] - total[edges[::2]]) * inverse[edges[::2]]))
    return out[1] if len(out) == 2 else np.concatenate(out)


def _distinct(ordered):
    """Where each value of a sorted array begins."""
    import numpy as np

    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return np.flatnonzero(new)


def shingles(text: str | None, words: int):
    """Sorted hashes of the text's shingles, and their counts."""
    import numpy as np

    h = word_hashes((text or "").lower())
    n = max(min(1, len(h)), len(h) - words + 1)
    out = h[:n].copy()
    for i in range(1, min(words, len(h))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    out = _mix(_mix(out))
    out.sort()
    first = _distinct(out)
    return out[first], np.diff(first, append=len(out))


def _buckets(h):
    import numpy as np

    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def inverse_frequencies(docs: DataFrame, text: str, words: int):
    """1 + ln((1 + n) / (1 + df)) / ln(buckets) for each bucket, over all
    documents. It depends on the share of documents, whatever their number.

    Each task sends its counts by ranges of buckets; where tasks are many, groups
    of them are added up first, so that no range gathers a row from every task."""
    import numpy as np

    def sent(total, n):
        import pyarrow as pa

        parts = [(i, total[i * RANGE : (i + 1) * RANGE]) for i in range(len(total) // RANGE)] if n else []
        rows = [(i, zlib.compress(p.astype("<i8").tobytes(), 1)) for i, p in parts if p.any()] + [(-1, zlib.compress(np.array([n], "<i8").tobytes()))] * bool(n)
        return pa.RecordBatch.from_pydict({"part": [i for i, _ in rows], "counts": [c for _, c in rows]}, pa.schema([("part", pa.int32()), ("counts", pa.binary())]))

    def count(batches):
        total, n = np.zeros(1 << BUCKET_BITS, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                h, _ = shingles(t.as_py(), words)
                if len(h):
                    found = _buckets(h)  # as sorted as the hashes, whose first bits they are
                    total[found[_distinct(found)]] += 1
                    n += 1
        yield sent(total, n)

    read = lambda c: np.frombuffer(zlib.decompress(c), "<i8")

    def some(batches):
        total, n = np.zeros(1 << BUCKET_BITS, np.int64), 0
        for batch in batches:
            for i, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i < 0:
                    n += int(read(c)[0])
                else:
                    total[i * RANGE : (i + 1) * RANGE] += read(c)
        yield sent(total, n)

    def add(pdf):
        import pandas as pd

        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "counts": [zlib.compress(sum(map(read, pdf["counts"])).astype("<i8").tobytes(), 1)]})

    kind = "part int, counts binary"
    counted = docs.select(text).mapInArrow(count, kind)
    if (tasks := docs.rdd.getNumPartitions()) > TASKS:
        counted = counted.withColumn("task", F.spark_partition_id()).repartition(math.isqrt(tasks), "task").select("part", "counts").mapInArrow(some, kind)
    found = {r.part: read(r.counts) for r in counted.groupBy("part").applyInPandas(add, kind).collect()}
    df = np.zeros(1 << BUCKET_BITS)
    for i, c in found.items():
        if i >= 0:
            df[i * RANGE : (i + 1) * RANGE] = c
    n = float(found[-1][0]) if -1 in found else 0.0
    return 1 + np.log((1 + n) / (1 + df)) / np.log(len(df))


def weights(h, counts, idf):
    import numpy as np

    return (1 + np.log(counts)) * idf[_buckets(h)]


def weighted_jaccard(a, b) -> float:
    """Of two (hashes, weights)."""
    import numpy as np

    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    low = np.minimum(wa[i], wb[j]).sum()
    return float(low / (wa.sum() + wb.sum() - low))


class Sampler:
    """Improved consistent weighted sampling: for each sample and element, r and
    c are Gamma(2, 1) and beta is uniform, all functions of the element; the
    sample is the element of least c / (y e^r) with its y's exponent."""

    def __init__(self, params: Params):
        import numpy as np

        u = (np.arange(STEPS) + 0.5) / STEPS
        x = np.where(u < 0.5, np.sqrt(2 * u), 1 - np.log1p(-u))
        for _ in range(60):  # Newton's method for the quantiles of Gamma(2, 1)
            x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - u) / (x * np.exp(-x)), x / 8)
        self.params, self.r, self.log_c = params, x.astype(np.float32), np.log(x).astype(np.float32)
        k = params.bands * params.rows
        seeds = _mix(_mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(params.seed)))
        self.seeds = (seeds >> np.uint64(32)).astype(np.uint32)[:, None]

    def draw(self, h, w):
        """A hash for each sample. The draws of an element come from 32 bits of
        its hash: r's and c's steps from 12 bits each of one mix, beta from
        another."""
        import numpy as np

        one, two, low = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35), np.uint32(STEPS - 1)
        k = len(self.seeds)
        every = np.arange(k)
        best, element, step = np.full(k, np.inf, np.float32), np.zeros(k, np.uint64), np.zeros(k, np.float32)
        high = (h >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(h), DRAWN):
            log_w = np.log(w[at : at + DRAWN]).astype(np.float32)
            z = (high[at : at + DRAWN] ^ self.seeds) * one
            z ^= z >> np.uint32(15)
            z *= two
            r = self.r.take((z >> np.uint32(20)).view(np.int32), mode="wrap")
            log_a = self.log_c.take(((z >> np.uint32(8)) & low).view(np.int32), mode="wrap")
            z *= one
            beta = (z >> np.uint32(8)).view(np.int32).astype(np.float32)
            beta *= np.float32(2.0**-24)
            t = np.floor(log_w / r + beta)
            log_a -= r * (t - beta + 1)
            i = log_a.argmin(axis=1)
            least = log_a[every, i]
            new = least < best
            best[new], element[new], step[new] = least[new], h[at + i[new]], t[every, i][new]
        return _mix(element * np.uint64(0x9E3779B97F4A7C15) + step.astype(np.int64).astype(np.uint64))

    def keys(self, h, w) -> tuple[list[int], list[int]]:
        """A key for each band, of which the band's number is part, and four
        bits of each sample, 16 to a word."""
        import numpy as np

        drawn = self.draw(h, w)
        bits = np.zeros(-(-len(drawn) // 16) * 16, np.uint64)
        bits[: len(drawn)] = (drawn >> np.uint64(20)) & np.uint64(15)
        sketch = np.bitwise_or.reduce(bits.reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=1)
        drawn = drawn.reshape(self.params.bands, self.params.rows)
        key = np.arange(1, self.params.bands + 1, dtype=np.uint64)
        for i in range(self.params.rows):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + drawn[:, i])
        return key.view(np.int64).tolist(), sketch.view(np.int64).tolist()


def samples_apart(x: Column, y: Column, words: int) -> Column:
    """How many samples of two sketches differ, in four bits of each."""
    out = F.lit(0)
    for i in range(words):
        z = F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        out = out + F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))
    return out


def signatures(docs: DataFrame, idf, params: Params, doc_id: str, text: str) -> DataFrame:
    """``doc_id, digest, total`` (weight), ``bands`` and ``sketch``, both empty if
    wordless."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def make():
        sampler = Sampler(params)

        def one(t):
            h, c = shingles(t, params.words)
            if not len(h):
                return 0.0, [], []
            w = weights(h, c, shared.value)
            return float(w.sum()), *sampler.keys(h, w)

        def step(cols):
            got = [one(t) for t in cols["text"]]
            return {"doc_id": cols["doc_id"], "digest": [hashlib.blake2b((t or "").encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in cols["text"]], "total": [g[0] for g in got], "bands": [g[1] for g in got], "sketch": [g[2] for g in got]}

        return step

    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return arrow_map(rows, make, "doc_id long, digest binary, total double, bands array<long>, sketch array<long>")


def verified(pairs: DataFrame, texts: DataFrame, idf, params: Params) -> DataFrame:
    """The ``pairs(a, b)`` whose texts reach the threshold, as edges."""
    shared = texts.sparkSession.sparkContext.broadcast(idf)
    a, b = texts.toDF("a", "text_a"), texts.toDF("b", "text_b")
    rows = pairs.join(a, "a").join(b, "b").select("a", "text_a", "b", "text_b")

    def make():
        known = {}

        def vector(i, t):
            if (found := known.get(i)) is None or found[0] != t:
                if len(known) > 64:
                    known.clear()
                h, c = shingles(t, params.words)
                found = known[i] = (t, (h, weights(h, c, shared.value)))
            return found[1]

        def step(cols):
            ok = [weighted_jaccard(vector(i, s), vector(j, t)) >= params.threshold for i, s, j, t in zip(cols["a"], cols["text_a"], cols["b"], cols["text_b"])]
            return {n: [x for x, y in zip(cols[n], ok) if y] for n in ("a", "b")}

        return step

    return materialize(arrow_map(rows, make, "a long, b long"), "edges")


def tiles(rows: DataFrame, compare) -> DataFrame:
    """Deals the rows of each key over blocks and runs ``compare`` on each pair
    of blocks of a key; it returns pairs of longs."""
    n = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n"))
    n = materialize(n, "counts")
    dealt = rows.join(n, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("n")).cast("int"))
    packed = dealt.groupBy("key", "block").agg(F.collect_list(F.struct(*(c for c in rows.columns if c != "key"))).alias("x"))
    packed = materialize(packed, "blocks")
    pairs = packed.select("key", "block", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("other"))
    work = pairs.join(packed, ["key", "block"]).join(packed.toDF("key", "other", "y"), ["key", "other"])
    work = work.repartition("key", "block", "other").select("key", "block", "other", "x", "y")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                key, block, other, x, y = (c[0] for c in batch.slice(i, 1).to_pydict().values())
                out = compare(key, x, None if block == other else y)
                yield pa.RecordBatch.from_pydict({n: [p[k] for p in out] for k, n in enumerate(("a", "b"))}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return work.mapInArrow(run, "a long, b long")


def _compare(params: Params, idf, texts: bool):
    """Compares the members of a tile that lie in different parts, where the
    tile's band is the first that both share. Without ``texts`` it returns (key,
    member) of those that are to be compared; with them, the links that join parts,
    of which the likeliest are looked for first."""
    def run(key: int, x: list[dict], y: list[dict] | None) -> list[tuple[int, int]]:
        import numpy as np

        def columns(rows):
            return [np.array([r[k] for r in rows]) for k in ("rep", "part", "total", "bands")] + [np.array([r["sketch"] for r in rows]).view(np.uint64)]

        rep, part, total, bands, sketch = columns(x)
        rep2, part2, total2, bands2, sketch2 = columns(y or x)
        ok = part[:, None] != part2
        ok &= np.minimum(total[:, None], total2) >= (params.threshold - 1e-9) * np.maximum(total[:, None], total2)
        if y is None:
            ok &= np.arange(len(x))[:, None] < np.arange(len(x))
        i, j = np.nonzero(ok)
        if not len(i):
            return []
        z = sketch[i] ^ sketch2[j]
        z |= z >> np.uint64(1)
        z |= z >> np.uint64(2)
        order = np.argsort(np.bitwise_count(z & np.uint64(0x1111111111111111)).sum(axis=1), kind="stable")
        i, j = i[order], j[order]
        same = bands[i] == bands2[j]
        first = same.argmax(axis=1)
        mine = bands[i, first] == key
        i, j = i[mine], j[mine]
        if not texts:
            return [(key, r) for r in np.unique(np.concatenate([rep[i], rep2[j]])).tolist()]
        known, root, out = {}, {}, []

        def vector(row):
            if (found := known.get(row["rep"])) is None:
                h, c = shingles(row["text"], params.words)
                found = known[row["rep"]] = h, weights(h, c, idf)
            return found

        def find(p):
            while (q := root.get(p, p)) != p:
                p = q
            return p

        for a, b in zip(i.tolist(), j.tolist()):
            pa, pb = find(int(part[a])), find(int(part2[b]))
            if pa != pb and weighted_jaccard(vector(x[a]), vector((y or x)[b])) >= params.threshold:
                root[max(pa, pb)] = min(pa, pb)
                out.append((int(rep[a]), int(rep2[b])))
        return out

    return run


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", params: Params = Params()) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id``, ``class_id`` (the smallest
    doc_id that links of exact or near copies reach) and ``kept``, whether the
    document is the one of its class that stays."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    idf = inverse_frequencies(source, "text", params.words)
    rows = materialize(signatures(source, idf, params, "doc_id", "text"), "signatures")
    parts = settled(docs.sparkSession, lambda: classes(source, rows, idf, params), "classes").withColumnRenamed("id", "doc_id")
    out = rows.select("doc_id").join(parts, "doc_id", "left").withColumn("class_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def classes(source: DataFrame, rows: DataFrame, idf, params: Params) -> DataFrame:
    """``(id, component)`` of the documents that links of exact or near copies
    join, from ``source(doc_id, text)`` and its signatures."""
    filled = rows.where(F.col("digest") != F.lit(EMPTY))
    texts_once = materialize(
        filled.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first(F.struct("total", "sketch", "bands")).alias("s")).select("digest", "rep", "copies", "s.*"), "classes")
    members = texts_once.select("rep", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("last"))
    buckets = materialize(buckets.where("lead != last").select("key", "lead"), "buckets")
    members = materialize(members.join(buckets, "key"), "members")

    totals = texts_once.select("rep", "total")
    star = members.where("rep != lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    side = lambda n: totals.select(F.col("rep").alias(n), F.col("total").alias(f"{n}_total"))
    t, u = F.col("a_total"), F.col("b_total")  # the similarity is no more than the lesser over the greater
    star = star.join(side("a"), "a").join(side("b"), "b").where(F.least(t, u) >= (params.threshold - 1e-9) * F.greatest(t, u))
    star = materialize(star.select("a", "b").distinct(), "star")
    ids = materialize(members.select(F.col("rep").alias("doc_id")).distinct(), "ids")
    texts = materialize(source.join(ids.hint("shuffle_hash"), "doc_id").dropDuplicates(["doc_id", "text"]), "texts")
    edges = verified(star, texts, idf, params)

    parts = settled(source.sparkSession, lambda: connected_components(edges), "parts")
    own = parts.select(F.col("id").alias("rep"), F.col("component").alias("part"))
    led = parts.select(F.col("id").alias("lead"), F.col("component").alias("lead_part"))
    placed = members.join(own, "rep", "left").join(led, "lead", "left")
    placed = placed.select("key", "rep", "lead", F.coalesce("part", "rep").alias("part"), F.coalesce("lead_part", "lead").alias("lead_part"))
    apart = materialize(placed.where("part != lead_part"), "apart")
    there = placed.join(apart.select("key").distinct(), "key", "left_semi").where("rep != lead")
    there = materialize(there.select("key", "rep", "part").join(texts_once.select("rep", "total", "sketch", "bands"), "rep"), "there")
    # first without texts, to see which members have anyone to be compared with
    busy = materialize(tiles(there, _compare(params, idf, False)).distinct(), "busy").toDF("key", "rep")
    whole = there.join(busy, ["key", "rep"]).join(texts.withColumnRenamed("doc_id", "rep"), "rep")
    edges = edges.unionAll(materialize(tiles(materialize(whole, "whole"), _compare(params, idf, True)).toDF("a", "b"), "links"))

    many = texts_once.where("copies > 1").select("digest", "rep")
    # rows of one doc_id are one document, so its texts' classes are linked too
    shared = filled.join(many, "digest").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a != b")
    return connected_components(edges.unionAll(shared))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", params: Params = Params()) -> DataFrame:
    """One document of each class: the row whose doc_id is the class's; of
    repeated rows of it, the first by text. Rows with a null doc_id stay."""
    from pyspark.sql import Window

    from lodestar.llm.shared import free_name

    gone, one = free_name(docs, "_gone"), free_name(docs, "_one")
    drop = settled(docs.sparkSession, lambda: near_duplicates(docs, doc_id, text, params).where("not kept").select(F.col("doc_id").alias(gone)).distinct(), "gone")
    named = docs.where(F.col(doc_id).isNotNull())
    kept = named.join(drop.hint("shuffle_hash"), named[doc_id] == drop[gone], "left_anti")
    kept = kept.withColumn(one, F.row_number().over(Window.partitionBy(doc_id).orderBy(text))).where(F.col(one) == 1).drop(one)
    return kept.unionAll(docs.where(F.col(doc_id).isNull()))
