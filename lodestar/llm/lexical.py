"""Ranked lexical search over dual-sorted wavelet trees.

Postings of a shard are one sequence of documents: term after term, and within a
term by falling impact. A wavelet matrix over the documents' numbers orders the
same sequence by doc_id: a node is a range of documents, each term's postings of
that range are an interval of the node's level, still by falling impact, and two
lookups lead to the halves of the range. So the first posting of an interval
bounds the term's impact in the whole subtree, and the sum of these bounds is an
upper bound of every document's score there; at a leaf it is the score. A search
opens the nodes with the highest bounds first, many at once, and ends when no
bound reaches the k-th best score: the top k are exact.

Three passes: documents become rows of term numbers and frequencies, with only
the terms that queries ask for; counts over all documents give term weights and
lengths; each task builds the trees of its documents, ``SHARD`` at a time, and
answers all queries on them. What a task has found raises the bar for its later
shards. Of a task's hits the best k of each query are left to rank.

The terms of the queries go to every task: they are bounded by ``TERMS``, and a
larger set of queries is answered in several passes over the rows.

Rows: a null text has no terms, and a document without terms is not counted.
Every row is a document of its own, with its doc_id in the results; equal scores
and doc_ids (null last) are ranked in any order, as they are alike. Query rows of
one item_id are one query with the terms of all; an item without terms, or whose
terms no document has, gets no rows. Texts of any length are one row. Empty tables
give an empty result. Extra columns aren't read."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.shared import arrow_map, materialize

#: Documents of a shard, and their postings unless one has more: a tree takes
#: about 100 bytes a posting.
SHARD, POSTINGS = 2048, 2_000_000
#: Different terms of the queries of one pass.
TERMS = 200_000
#: The best hits of so many parts are ranked before all are.
PARTS = 64
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Fixed values of the score: impacts are in millionths, term weights in thousandths.
IMPACT, TF, LENGTH, FLAT = 1_000_000_000, 1000, 20, 50
SCALE = 1000


def terms(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, with A-Z in lower case."""
    return TERM.findall(text.translate(LOWER)) if text and not text.isascii() else TERM.findall(text.lower()) if text else []


# --- passes over the rows ---

def query_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> list[tuple[object, list[str]]]:
    """Each item's distinct terms, in order, through the driver: queries are a
    stated set. Items come in the order of their ids."""
    found: dict[object, set[str]] = {}
    for r in items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).toLocalIterator():
        found.setdefault(r.i, set()).update(terms(r.t))
    return [(i, sorted(found[i])) for i in sorted(found, key=lambda i: (i is None, i if i is not None else 0))]


def passes(queries: list[tuple[object, list[str]]], most: int = TERMS) -> list[list[tuple[object, list[str]]]]:
    """Queries in groups with at most ``most`` different terms, or one query."""
    out, seen = [], set()
    for q in queries:
        if out and len(seen | set(q[1])) <= most:
            out[-1].append(q)
            seen |= set(q[1])
        else:
            out.append([q])
            seen = set(q[1])
    return out


def postings(docs: DataFrame, numbers: dict[str, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n, terms, tf)``: a document's number of terms, with repeats, and
    those in ``numbers`` with their frequencies. Written, as two steps read it."""
    known = docs.sparkSession.sparkContext.broadcast(numbers)

    def make():
        at = known.value

        def step(cols):
            n, ids, tf = [], [], []
            for t in cols["text"]:
                words = terms(t)
                mine = sorted((at[w], c) for w, c in Counter(words).items() if w in at)
                n.append(len(words))
                ids.append([i for i, _ in mine])
                tf.append([c for _, c in mine])
            return {"doc_id": cols["doc_id"], "n": n, "terms": ids, "tf": tf}

        return step

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return materialize(arrow_map(rows, make, f"doc_id {kind}, n long, terms array<int>, tf array<int>", 256), "postings")


def statistics(rows: DataFrame, n_terms: int) -> tuple[int, int, list[int]]:
    """Documents with terms, all their terms, and for each known term how many
    documents hold it."""
    n, length = rows.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = [0] * n_terms
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toLocalIterator():
        df[r.t] = r.df
    return n, length, df


def term_weights(n: int, df: list[int]) -> list[int]:
    return [math.floor(SCALE * math.log((2 * n + 2) / (2 * d + 1))) for d in df]


# --- the tree ---

class Tree:
    """A dual-sorted wavelet tree, as a matrix of levels: ``rank[d, p]`` counts
    the set bits of level d before position p, ``impact[d, p]`` is the impact of
    the posting that lies at p of level d, and ``zeros[d]`` is where set bits go."""

    def __init__(self, docs, n_docs: int, term, impact):
        """Postings in any order: document numbers below ``n_docs``, term numbers,
        impacts."""
        import numpy as np

        self.depth = max(1, (n_docs - 1).bit_length())
        order = np.lexsort((docs, -impact, term))
        self.terms, starts = np.unique(term[order], return_index=True)
        self.bounds = np.append(starts, len(order)).astype(np.int64)
        seq, imp, n = docs[order], impact[order], len(order)
        self.rank = np.zeros((self.depth, n + 1), np.int32)
        self.impact = np.zeros((self.depth + 1, n + 1), np.int32)
        self.zeros = np.zeros(self.depth, np.int64)
        for d in range(self.depth):
            bit = (seq >> (self.depth - 1 - d)) & 1
            np.cumsum(bit, out=self.rank[d, 1:])
            self.impact[d, :n] = imp
            self.zeros[d] = n - self.rank[d, n]
            go = np.concatenate([np.flatnonzero(bit == 0), np.flatnonzero(bit)])
            seq, imp = seq[go], imp[go]
        self.impact[self.depth, :n] = imp

    def intervals(self, wanted):
        """Which of the ``wanted`` term numbers the shard has, and their postings
        at the root."""
        import numpy as np

        at = np.searchsorted(self.terms, wanted)
        at[at == len(self.terms)] = 0
        has = np.flatnonzero(self.terms[at] == wanted) if len(self.terms) else np.zeros(0, np.int64)
        return has, self.bounds[at[has]], self.bounds[at[has] + 1]

    def best(self, wanted, weight, k: int, bar: int = 1, first: int = 64):
        """Numbers and scores of all documents that may be among the best k with
        scores of at least ``bar``: more than k only where scores tie."""
        import numpy as np

        has, left, right = self.intervals(wanted)
        weight = weight[has]
        nobody = np.zeros(0, np.int64)
        # of each open node: level, first document, bound, interval of each term
        level, low, bound = np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, (weight * self.impact[0, left]).sum())
        left, right = left[None, :], right[None, :]
        docs, scores, batch = nobody, nobody, first
        while len(bound):
            go = np.argpartition(-bound, batch - 1)[:batch] if len(bound) > batch else np.arange(len(bound))
            rest = np.ones(len(bound), bool)
            rest[go] = False
            d, l, r = level[go], left[go], right[go]
            to = d[:, None]
            ones_l, ones_r = self.rank[to, l].astype(np.int64), self.rank[to, r].astype(np.int64)
            z = self.zeros[d][:, None]
            l = np.concatenate([l - ones_l, z + ones_l])
            r = np.concatenate([r - ones_r, z + ones_r])
            below = np.concatenate([d, d]) + 1
            start = np.concatenate([low[go], low[go] + (1 << (self.depth - 1 - d))])
            top = np.where(r > l, self.impact[below[:, None], l], 0) @ weight
            good = top >= bar
            leaf = good & (below == self.depth)
            if leaf.any():
                docs, scores = np.append(docs, start[leaf]), np.append(scores, top[leaf])
                if len(scores) >= k:
                    bar = max(bar, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                    keep = scores >= bar
                    docs, scores = docs[keep], scores[keep]
            inner = good & ~leaf & (top >= bar)
            rest &= bound >= bar
            level, low, bound = np.append(level[rest], below[inner]), np.append(low[rest], start[inner]), np.append(bound[rest], top[inner])
            left, right = np.concatenate([left[rest], l[inner]]), np.concatenate([right[rest], r[inner]])
            batch *= 2
        return docs, scores, bar


def _impacts(tf, n, n_docs: int, length: int):
    """Impacts of postings with frequencies ``tf`` in documents of ``n`` terms."""
    m = 100 - FLAT + (FLAT * n * n_docs) // max(1, length)
    return (IMPACT * tf) // (TF * tf + LENGTH * m)


def hits(rows: DataFrame, queries: list[tuple[object, list[int]]], n_docs: int, length: int, weights: list[int], k: int, kind: str, shard: int = SHARD) -> DataFrame:
    """``(item, doc_id, score)`` of the best k of each query in each task.
    ``queries`` have their terms' numbers; ``item`` is a query's place."""
    shared = rows.sparkSession.sparkContext.broadcast((weights, [q for _, q in queries]))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        weight, wanted = np.asarray(shared.value[0], np.int64), [np.asarray(q, np.int64) for q in shared.value[1]]
        found = [([], np.zeros(0, np.int64), 1) for _ in wanted]  # doc_ids, scores, bar
        first = lambda ids: sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
        kinds = None

        def search(part):
            sizes = part.column("terms").value_lengths().to_numpy().astype(np.int64)
            if not sizes.sum():
                return
            ids = part.column("doc_id").to_pylist()
            order = first(ids)  # numbers follow doc_ids, so that leaves do
            number = np.empty(len(ids), np.int64)
            number[order] = np.arange(len(ids))
            term, tf = (part.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tf"))
            impact = _impacts(tf, np.repeat(part.column("n").to_numpy(), sizes), n_docs, length)
            tree = Tree(np.repeat(number, sizes), len(ids), term, impact)
            for q, want in enumerate(wanted):
                held, scores, bar = found[q]
                docs, more, _ = tree.best(want, weight[want], k, bar)
                if not len(docs):
                    continue
                held, scores = held + [ids[order[i]] for i in docs.tolist()], np.append(scores, more)
                if len(held) > k:
                    by_id = first(held)
                    go = [by_id[i] for i in np.argsort(-scores[by_id], kind="stable")[:k]]
                    held, scores = [held[i] for i in go], scores[go]
                found[q] = (held, scores, max(1, int(scores.min())) if len(held) == k else 1)

        for batch in batches:
            kinds = batch.schema.field("doc_id").type
            many = np.cumsum(batch.column("terms").value_lengths().to_numpy().astype(np.int64))
            start = 0
            while start < batch.num_rows:
                most = np.searchsorted(many, (many[start - 1] if start else 0) + POSTINGS, side="right")
                stop = int(min(batch.num_rows, start + shard, max(start + 1, most)))
                search(batch.slice(start, stop - start))
                start = stop
        if kinds is None:
            return
        schema = pa.schema([("item", pa.int32()), ("doc_id", kinds), ("score", pa.int64())])
        for q, (ids, scores, _) in enumerate(found):
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(ids), pa.int32()), pa.array(ids, kinds), pa.array(scores, pa.int64())], schema=schema)

    return rows.select("doc_id", "n", "terms", "tf").mapInArrow(run, f"item int, doc_id {kind}, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", shard: int = SHARD, most_terms: int = TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's k documents with the highest
    scores above 0, all if they are fewer."""
    spark = docs.sparkSession
    d_kind, i_kind = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {i_kind}, rank int, doc_id {d_kind}, score long")
    for group in passes(query_terms(items, item_id, item_text), most_terms):
        numbers = {w: i for i, w in enumerate(sorted({w for _, ws in group for w in ws}))}
        rows = postings(docs, numbers, doc_id, text)
        n, length, df = statistics(rows, len(numbers))
        weights = term_weights(n, df)
        asked = [(i, [numbers[w] for w in ws if df[numbers[w]]]) for i, ws in group]
        found = hits(rows, asked, n, length, weights, k, d_kind, shard).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
        best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        some = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*best))).where(F.col("rank") <= k).drop("part")
        ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(asked)], f"item int, item_id {i_kind}")
        out = out.unionByName(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out
