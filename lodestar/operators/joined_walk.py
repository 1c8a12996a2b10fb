"""Graph walks that Spark runs: rounds of joins over tables of links and vectors.

All queries walk together. A query's state is its beam, the nearest candidates so
far with a mark on those whose links have been followed. Each round follows the
links of the nearest unmarked candidates of every query: the frontier meets the
table of links by node, what it leads to meets the table of vectors by id, and
distances are column expressions. A beam keeps its nearest ``ef``; a candidate
that was dropped can't come back, as beams only get nearer, so no table of visited
nodes is needed. The walk ends when no beam has an unmarked candidate.

No task holds a graph, or more of a query than its beam and the links of one round.
Tables of links and vectors may be of any size; written as tables bucketed by id
they aren't moved, and the frontier, a few rows for each query, is what travels.
State is written after every round, so lost executors cost one round's tasks.

Links: a row is linked with its nearest rows and with those that it is nearest to,
at most ``degree`` of each, so hubs don't grow. Queries enter at their nearest rows
of a table of entry points, a hashed part of all rows.

Rows with a null id or vector are left out; a query without vector has no hits;
repeated links and entries count once; empty tables give no hits."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.metrics import metric
from lodestar.operators.blocks import tiles
from lodestar.operators.codecs import best_of_tile
from lodestar.operators.knn import HITS, knn, top
from lodestar.sources.shared import materialize

#: Links of a row at most, candidates whose links a round follows, rounds at most.
DEGREE, POPS, ROUNDS = 32, 4, 500


def links_of(neighbours: DataFrame, degree: int = DEGREE) -> DataFrame:
    """``(node, neighbour)`` from a result of searches of rows among themselves
    ``(qid, id, dist)``: the links there are, and of those back the nearest."""
    there = neighbours.select(F.col("qid").alias("node"), F.col("id").alias("neighbour"), "dist").where("node <> neighbour")
    both = there.unionByName(there.select(F.col("neighbour").alias("node"), F.col("node").alias("neighbour"), "dist"))
    one = both.groupBy("node", "neighbour").agg(F.min("dist").alias("dist"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("dist", "neighbour"))
    return one.withColumn("rank", rank).where(F.col("rank") <= degree).select("node", "neighbour")


def random_links(base: DataFrame, degree: int = DEGREE, seed: int = 7) -> DataFrame:
    """Links that know nothing of distances: row n is linked with rows whose
    numbers are hashes of n."""
    from lodestar.operators.ordered import numbered

    rows = materialize(numbered(base.select("id"), ["id"], "n"), "numbered")
    n = rows.count()
    drawn = rows.select(F.col("id").alias("node"), F.explode(F.sequence(F.lit(1), F.lit(degree))).alias("j")).select("node", (F.pmod(F.xxhash64("node", "j", F.lit(seed)), F.lit(max(1, n))) + 1).alias("n"))
    return drawn.join(rows, "n").select("node", F.col("id").alias("neighbour")).where("node <> neighbour").distinct()


def entry_points(base: DataFrame, one_in: int | None = None) -> DataFrame:
    """The rows of ``(id, embedding)`` whose hash says so, one in so many; by
    default about the square root of all."""
    rows = base.toDF("id", "embedding").where("id is not null and embedding is not null")
    if one_in is None:
        one_in = max(1, math.isqrt(rows.count()))
    return rows.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(one_in)) == 0)


@dataclass(frozen=True)
class Epsilon:
    """A walk ends when its nearest candidate is over ``epsilon`` away and its beam
    has ``least`` rows; beams hold ``most``, and hits are those within epsilon."""

    epsilon: float
    least: int
    most: int


@dataclass(frozen=True)
class Documents:
    """Beams hold the rows of their ``collect`` nearest documents, by each one's
    nearest row; hits are the rows of the nearest ``n``. ``of`` is (id, doc)."""

    of: DataFrame
    n: int
    collect: int


def _kept(rows: DataFrame, ef: int, stop: Epsilon | Documents | None, pops: int) -> DataFrame:
    """Beams from candidates ``(qid, id, dist, popped[, doc])``, and whose links are
    to follow next."""
    near = Window.partitionBy("qid").orderBy("dist", "id")
    if isinstance(stop, Documents):
        # the place of a row's document among those of the beam: of equal ones the smaller
        first = F.min(F.struct("dist", "doc")).over(Window.partitionBy("qid", "doc"))
        rows = rows.withColumn("place", F.dense_rank().over(Window.partitionBy("qid").orderBy(first)))
        rows = rows.where(F.col("place") <= stop.collect).drop("place")
    else:
        most = stop.most if isinstance(stop, Epsilon) else ef
        rows = rows.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= most).drop("rank")
    n = F.count(F.lit(1)).over(Window.partitionBy("qid"))
    open_ = F.row_number().over(Window.partitionBy("qid", "popped").orderBy("dist", "id"))
    follow = ~F.col("popped") & (open_ <= pops)
    if isinstance(stop, Epsilon):
        follow = follow & ((F.col("dist") <= stop.epsilon) | (n < stop.least))
    return rows.withColumn("next", follow)


def walk(queries: DataFrame, base: DataFrame, links: DataFrame, entries: DataFrame, k: int = 10, ef: int = 64, name: str = "l2", stop: Epsilon | Documents | None = None, pops: int = POPS, starts: int = 4, hide_self: bool = False, rounds: int = ROUNDS) -> tuple[DataFrame, list[dict]]:
    """Hits ``(qid, rank, id, dist)`` of ``(qid, qv)``, and before each round how many
    queries were still walking and how many rows of beams were unmarked. ``base`` is
    ``(id, embedding)``, ``links`` ``(node, neighbour)``; ``entries``, rows of the
    base or codes of them, are searched exactly for each query's ``starts``."""
    m = metric(name)
    sign = F.lit(-1.0 if m.larger_is_better else 1.0)
    q = queries.toDF("qid", "qv").where("qid is not null and qv is not null")
    vectors = base.toDF("id", "v").where("id is not null and v is not null")
    documents = stop.of.toDF("id", "doc") if isinstance(stop, Documents) else None

    def measured(pairs: DataFrame) -> DataFrame:
        """``(qid, id)`` with their distances, smaller ones nearer, and documents."""
        rows = pairs.join(vectors, "id").join(q, "qid").select("qid", "id", (sign * m.column(F.col("qv"), F.col("v"))).alias("dist"), F.lit(False).alias("popped"))
        return rows.join(documents, "id", "left") if documents is not None else rows

    first = knn(q, entries.toDF("id", "embedding"), starts, name, exclude_self=hide_self).select("qid", "id").distinct()
    state = materialize(_kept(measured(first), ef, stop, pops), "state")
    log: list[dict] = []
    for _ in range(rounds):
        walking, rows = state.agg(F.countDistinct(F.when(F.col("next"), F.col("qid"))), F.count_if(~F.col("popped"))).first()
        log.append({"round": len(log), "walking": walking, "unmarked": rows})
        if not walking:
            break
        front = state.where("next").select("qid", "id")
        met = front.join(links.select(F.col("node").alias("id"), "neighbour"), "id").select("qid", F.col("neighbour").alias("id"))
        if hide_self:
            met = met.where("qid <> id")
        new = met.distinct().join(state.select("qid", "id"), ["qid", "id"], "left_anti")
        old = state.withColumn("popped", F.col("popped") | F.col("next")).drop("next")
        state = materialize(_kept(old.unionByName(measured(new)), ef, stop, pops), "state")
    else:
        raise RuntimeError(f"walks didn't end in {rounds} rounds")
    if isinstance(stop, Epsilon):
        state = state.where(F.col("dist") <= stop.epsilon)
    elif isinstance(stop, Documents):
        best = F.min(F.struct("dist", "doc")).over(Window.partitionBy("qid", "doc"))
        state = state.withColumn("place", F.dense_rank().over(Window.partitionBy("qid").orderBy(best))).where(F.col("place") <= stop.n)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("dist", "id"))
    out = state.withColumn("rank", rank)
    if stop is None:
        out = out.where(F.col("rank") <= k)
    return out.select("qid", "rank", "id", (sign * F.col("dist")).alias("dist")), log


# --- what walks have missed ---

def within(queries: DataFrame, base: DataFrame, bounds: DataFrame, name: str = "l2", hide_self: bool = False, most: int | None = None) -> DataFrame:
    """``(qid, id, dist)`` of all rows that are no farther from a query than its bound
    ``(qid, bound)``; a query without one has no bound. Of a block of rows only the
    nearest ``most``."""
    m = metric(name)
    sign = -1.0 if m.larger_is_better else 1.0
    q = queries.toDF("qid", "qv").where("qid is not null and qv is not null").join(bounds.select("qid", "bound"), "qid", "left")
    # the bound travels as one more component
    q = q.select("qid", F.concat(F.col("qv").cast("array<double>"), F.array(F.coalesce(F.col("bound"), F.lit(sign * math.inf)))))
    b = base.toDF("id", "v").where("id is not null and v is not null").select("id", F.concat(F.col("v").cast("array<double>"), F.array(F.lit(0.0))))

    def kernel(qids, x, ids, v):
        import numpy as np

        d, bound = m.tile(x[:, :-1], v[:, :-1], None), sign * x[:, -1]
        far = sign * d > (bound + 1e-9 * (1 + np.abs(bound)))[:, None]  # sums in another order
        if hide_self:
            far |= ids[None, :] == qids[:, None]
        out = []
        for i in np.flatnonzero(~far.all(axis=1)):
            c = np.flatnonzero(~far[i])
            out.append(best_of_tile(qids[i : i + 1], ids[c], d[i : i + 1, c], most or len(c), m.larger_is_better))
        none = {"qid": qids[:0], "id": ids[:0], "dist": d[0, :0]}
        return {k: np.concatenate([o[k] for o in out or [none]]) for k in none}

    return tiles(q, b, kernel, HITS)


def completed(found: DataFrame, queries: DataFrame, base: DataFrame, k: int = 10, name: str = "l2", hide_self: bool = False) -> DataFrame:
    """The k nearest of all rows, from hits ``(qid, rank, id, dist)`` of walks: what is
    no farther than a query's k-th hit, be it a hit or missed."""
    bounds = materialize(found.where(F.col("rank") == k).select("qid", F.col("dist").alias("bound")), "bounds")
    return top(within(queries, base, bounds, name, hide_self, k), k, metric(name).larger_is_better)


def completed_documents(found: DataFrame, queries: DataFrame, base: DataFrame, of: DataFrame, n: int, name: str = "l2", hide_self: bool = False) -> DataFrame:
    """``(qid, id, dist)``: all rows of the ``n`` nearest documents of ``(id, doc)``,
    from rows ``(qid, id, dist)`` of walks that met n documents or more: documents
    that have a row no farther than the n-th, and all of their rows."""
    m, docs = metric(name), of.toDF("id", "doc")
    sign = F.lit(-1.0 if m.larger_is_better else 1.0)
    place = F.row_number().over(Window.partitionBy("qid").orderBy("near", "doc"))

    def nearest(rows: DataFrame) -> DataFrame:
        by = rows.join(docs, "id").groupBy("qid", "doc").agg(F.min(sign * F.col("dist")).alias("near"))
        return by.withColumn("place", place).where(F.col("place") <= n)

    bounds = materialize(nearest(found.select("qid", "id", "dist")).where(F.col("place") == n).select("qid", (sign * F.col("near")).alias("bound")), "bounds")
    best = materialize(nearest(within(queries, base, bounds, name, hide_self)).select("qid", "doc"), "best")
    pairs = best.join(docs, "doc").select("qid", "id")
    if hide_self:
        pairs = pairs.where("qid <> id")
    q, v = queries.toDF("qid", "qv"), base.toDF("id", "v").where("v is not null")
    return pairs.join(v, "id").join(q, "qid").select("qid", "id", m.column(F.col("qv"), F.col("v")).alias("dist"))
