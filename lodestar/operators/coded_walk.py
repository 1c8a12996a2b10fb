"""Walks over rotated-bit codes, as rounds of joins, and their calibration.

A walk measures rows by estimates from codes, each with a bound on its error. Of
a code with levels y, ``w = factor * (y - middle)`` stands for the rotated, centred
vector v, and the estimate of a squared distance is ``|x|^2 + |v|^2 - 2 x.w``. Its
error is ``2 |x.(v - w)|``, at most ``2 |x| |v - w|``, for certain; the rotation turns
``v - w`` at random, so ``eps / sqrt(dimensions - 1)`` of that is a bound that few
estimates exceed.

Two sets are kept for a query. Its beam, the ``ef`` nearest by estimate, is what is
followed and what counts as full: a ratio is the estimate of a candidate whose links
are followed over that of the furthest of a full beam. Its pool holds whatever may be
among the ``k`` nearest, by lower bounds against the k-th upper bound, inside the
beam or not. Only the pool is measured by vectors at the end, so with certain bounds
hits are the exact nearest of all rows that the walk met.

The same query can walk at many widths and under many policies. All its walks are one
row of a table of states and share estimates of rows that it still holds with links:
in each round states ask for the candidates that they don't know, joins with codes,
links and queries bring these, and states and estimates of a query meet again. Ratios
belong to the beam as it was when the round began; with one candidate a round that is
the order of a sequential walk.

Rows with a null id or vector are left out, and so are queries without vector or
width; repeated queries, links and entries count once; empty tables give no hits."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from lodestar.functions.metrics import metric
from lodestar.operators import calibrate
from lodestar.operators.codecs import RaBitQ, mapped
from lodestar.operators.joined_walk import POPS, ROUNDS
from lodestar.operators.knn import knn
from lodestar.sources.shared import materialize, succeeding


@dataclass(frozen=True)
class Coded:
    """``(id, levels, factor, length, slack)``, the middle of the levels, and what
    brings queries into the space of the codes."""

    rows: DataFrame
    middle: float
    moved: Callable[[DataFrame], DataFrame]


def share(width: int, eps: float | None) -> float:
    """Which part of the certain bound the probable one is."""
    return 1.0 if eps is None else min(1.0, eps / max(1, width - 1) ** 0.5)


def slack(codes, eps: float | None):
    """Of codes as ``RaBitQ.encode`` makes them, the bound on ``|v - w|``."""
    import numpy as np

    length, cosine = codes[:, -3], codes[:, -1]
    sound = np.abs(cosine) > 1e-12
    away = np.where(sound, length * np.sqrt(np.maximum(0.0, 1 / np.where(sound, cosine, 1.0) ** 2 - 1)), length)
    return away * share(codes.shape[1] - 3, eps) * (1 + 1e-9) + 1e-12


def coded(base: DataFrame, codec: RaBitQ, eps: float | None = 1.9) -> Coded:
    """Codes of ``(id, embedding)``; without ``eps`` their bounds are certain."""
    rows = base.toDF("id", "embedding").where("id is not null and embedding is not null")

    def encode(v):
        import numpy as np

        c = codec.encode(v)
        length, size, cosine = c[:, -3], c[:, -2], c[:, -1]
        sound = np.abs(cosine) > 1e-12
        factor = np.where(sound, length / np.maximum(size, 1e-30) / np.where(sound, cosine, 1.0), 0.0)
        return np.column_stack([c[:, :-3], factor, length, slack(c, eps)])

    at = lambda back: F.element_at("embedding", -back)
    levels = F.slice("embedding", 1, F.size("embedding") - 3).cast("array<smallint>")
    codes = mapped(rows, encode).select("id", levels.alias("levels"), at(3).alias("factor"), at(2).alias("length"), at(1).alias("slack"))
    return Coded(materialize(codes, "codes"), ((1 << codec.bits) - 1) / 2, lambda q: mapped(q, lambda v: codec.rotation(v - codec.center)))


def uncoded(base: DataFrame) -> Coded:
    """Vectors as codes of themselves, without error."""
    v = F.col("embedding").cast("array<double>")
    rows = base.toDF("id", "embedding").where("id is not null and embedding is not null")
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return Coded(rows.select("id", v.alias("levels"), F.lit(1.0).alias("factor"), length.alias("length"), F.lit(0.0).alias("slack")), 0.0, lambda q: q.select("id", v.alias("embedding")))


def estimates(pairs: DataFrame, moved: DataFrame, codes: Coded, *more: str) -> DataFrame:
    """``pairs``, with columns qid and id, with ``est``, the estimated squared
    distance, ``slack``, how far it may be off, and ``more`` columns of the codes.
    ``moved`` is (qid, x, norm, total): a moved query, its length and the sum of its
    components."""
    dot = F.aggregate(F.zip_with("x", "levels", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x) - F.col("total") * codes.middle
    est = F.col("norm") * F.col("norm") + F.col("length") * F.col("length") - 2 * F.col("factor") * dot
    rows = pairs.join(codes.rows, "id").join(moved, "qid")
    return rows.select(*pairs.columns, est.alias("est"), (2 * F.col("norm") * F.col("slack")).alias("slack"), *more)


def moved_queries(queries: DataFrame, codes: Coded) -> DataFrame:
    """``(qid, x, norm, total)`` of ``(qid, qv)``, one row for each qid."""
    x = codes.moved(queries.toDF("id", "embedding").dropDuplicates(["id"])).toDF("qid", "x")
    total = lambda f: F.aggregate("x", F.lit(0.0), lambda a, v: a + f(v))
    return x.select("qid", "x", F.sqrt(total(lambda v: v * v)).alias("norm"), total(lambda v: v).alias("total"))


_KEY = ("qid", "ef")

#: Marks of a candidate in a walk: estimated, its links followed, to be estimated, in
#: the pool.
MET, POPPED, WANTED, POOL = 1, 2, 4, 8
#: What is counted of a walk: its width now, full pops, the smoothed ratio, the sum
#: and number of those in the window, whether the policy was asked, estimates, pool.
NUMBERS = 8
#: All walks of a query, each by its policy's place and its width. Of their candidates
#: by ascending id: estimate, slack (-1: not known yet) and a mark for each walk; and
#: the links of those whose links may be followed next.
STATE = "qid long, live boolean, ask array<long>, ways array<int>, efs array<int>, numbers array<double>, ids array<long>, est array<double>, slack array<double>, marks array<tinyint>, linked array<long>, to array<array<long>>"


def _begun(walks: DataFrame, first: DataFrame) -> DataFrame:
    """The state before the first round, of ``(qid, way, ef)`` and the rows ``(qid,
    id)`` where walks start."""
    by = walks.groupBy("qid").agg(F.array_sort(F.collect_set(F.struct("way", "ef"))).alias("w"))
    by = by.join(first.groupBy("qid").agg(F.array_sort(F.collect_set("id")).alias("ids")), "qid", "left")
    by = by.withColumn("ids", F.coalesce("ids", F.array().cast("array<long>")))
    n, numbers = F.size("ids"), F.flatten(F.transform("w", lambda w: F.array(w["ef"].cast("double"), *[F.lit(0.0)] * (NUMBERS - 1))))
    none = (F.array_repeat(F.lit(0.0), n).alias("est"), F.array_repeat(F.lit(-1.0), n).alias("slack"), F.array_repeat(F.lit(WANTED).cast("tinyint"), n * F.size("w")).alias("marks"), F.array().cast("array<long>").alias("linked"), F.array().cast("array<array<long>>").alias("to"))
    return by.select("qid", F.lit(True).alias("live"), F.col("ids").alias("ask"), F.col("w.way").alias("ways"), F.col("w.ef").alias("efs"), numbers.alias("numbers"), "ids", *none)


def _routes(policy: DataFrame | None) -> dict:
    """For each width of a policy, its tau and its routes ``(gamma, route_ef)``."""
    out: dict = {}
    for r in sorted(policy.select("ef", "route_idx", "gamma", "route_ef", "tau").collect()) if policy is not None else ():
        tau, routes = out.get(r.ef, (r.tau, []))
        out[r.ef] = (max(tau, r.tau), [*routes, (r.gamma, r.route_ef)])
    return out


def _round(policies: list[dict], k: int, pops: int, window: tuple[int, int], decay: float, hide_self: bool) -> Callable:
    """A round of each query's walks, from their state and the estimates that it asked
    for; rounds that ask for nothing are followed by the next at once."""
    start, end = window
    kinds = to_arrow_schema(_parse_datatype_string(STATE))

    def observed(x, ratios, ef, policy):
        for r in ratios:
            x[1] += 1
            x[2] = r if x[1] == 1 else x[2] * decay + r * (1 - decay)
            if start <= x[1] <= end:
                x[3], x[4] = x[3] + x[2], x[4] + 1
        if ef in policy and x[1] >= end and not x[5]:
            (tau, routes), x[5] = policy[ef], 1
            if x[4] and (mean := x[3] / x[4]) <= tau:
                x[0] = next((min(ef, max(width, k)) for gamma, width in routes if mean / max(tau, 1e-6) <= gamma + 1e-12), x[0])

    def step(qid, ways, efs, x, ids, est, slack, marks, to):
        import numpy as np

        known = slack >= 0  # others have no codes
        ids, est, slack, marks = ids[known], est[known], slack[known], marks[known]
        live, ask = True, ids[:0]
        while live and not len(ask):
            wanted = (marks & WANTED) > 0
            x[:, 6] += (wanted & ((marks & MET) == 0)).sum(0)
            marks = np.where(wanted, marks | MET, marks) & np.int8(MET | POPPED)
            order, low, high = np.lexsort((ids, est)), est - slack, est + slack
            keep, held, found, live = np.zeros(len(ids), bool), [ids[:0]], [], False
            for w, ef in enumerate(efs):
                own = order[(marks[order, w] & MET) > 0]
                beam = own[: int(x[w, 0])]
                open_, full = beam[(marks[beam, w] & POPPED) == 0], len(beam) >= x[w, 0]
                pool = own[low[own] <= (np.partition(high[own], k - 1)[k - 1] if len(own) >= k else np.inf)]
                keep[beam] = keep[pool] = True
                follow = open_[:pops]
                held.append(ids[open_[pops:]])
                if full:
                    observed(x[w], (np.maximum(est[follow], 0) / max(est[beam[-1]], 1e-6)).tolist(), ef, policies[ways[w]])
                x[w, 7] = len(pool)
                marks[pool, w] |= POOL
                marks[follow, w] |= POPPED
                live = live or len(follow) > 0
                found.append(np.concatenate([ids[:0], *(to[i] for i in ids[follow].tolist())]))
            # what no walk holds is forgotten, and what links lead to comes in
            every = np.unique(np.concatenate([ids[keep], *found]))
            every = every[every != qid] if hide_self else every
            at, n = np.searchsorted(every, ids[keep]), len(every)
            was, (est, slack, marks) = (est[keep], slack[keep], marks[keep]), (np.zeros(n), np.full(n, -1.0), np.zeros((n, len(efs)), np.int8))
            est[at], slack[at], marks[at] = was
            ids = every
            for w, f in enumerate(found):
                f = np.searchsorted(ids, f[f != qid] if hide_self else f)
                f = f[(marks[f, w] & MET) == 0]
                marks[f, w] |= WANTED
            wanted = ((marks & WANTED) > 0).any(1)
            to = {i: to[i] for i in np.concatenate([*held, ids[wanted & (slack >= 0)]]).tolist() if i in to}
            ask = ids[wanted & ~np.isin(ids, list(to))]
        return qid, live, ask, ways, efs, x.ravel(), ids, est, slack, marks.ravel(), list(to), list(to.values())

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def rows(column):
            """The lists of a column, without a copy."""
            at, values = column.offsets.to_numpy().tolist(), column.values
            values = rows(values) if pa.types.is_list(values.type) else values.to_numpy(zero_copy_only=False)
            return [values[i:j] for i, j in zip(at, at[1:])]

        def column(values, kind):
            if not pa.types.is_list(kind):
                return pa.array(values, kind)
            flat = [v for part in values for v in part] if pa.types.is_list(kind.value_type) else np.concatenate([np.asarray(v) for v in values])
            return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), column(flat, kind.value_type) if len(flat) else pa.array([], kind.value_type), kind)

        for batch in batches:
            of, out = {c: rows(v) if pa.types.is_list(v.type) else v.to_pylist() for c, v in zip(batch.schema.names, batch.columns)}, []
            for i in range(batch.num_rows):
                qid, _, _, ways, efs, x, ids, est, slack, marks, linked, to, new, new_est, new_slack, new_to = (v[i] for v in of.values())
                at = np.searchsorted(ids, new)
                est, slack = est.copy(), slack.copy()
                est[at], slack[at] = new_est, new_slack
                known = dict(zip(linked.tolist(), to)) | dict(zip(new.tolist(), new_to))
                out.append(step(qid, ways.tolist(), efs.tolist(), x.reshape(-1, NUMBERS).copy(), ids, est, slack, marks.reshape(-1, len(efs)), known))
            if out:
                yield pa.RecordBatch.from_arrays([column(v, f.type) for v, f in zip(zip(*out), kinds)], schema=kinds)

    return run


def walks(queries: DataFrame, base: DataFrame, codes: Coded, links: DataFrame, entries: DataFrame, k: int = 10, policies: Sequence[DataFrame | None] = (None,), window: tuple[int, int] = (4, 16), decay: float = 0.8, pops: int = POPS, starts: int = 4, hide_self: bool = False, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """``walk`` under each of several policies at once, with the policy's place from 0
    as a column ``way`` of both results."""
    q = queries.toDF("qid", "qv", "ef").where("qid is not null and qv is not null and ef is not null")
    vectors = base.toDF("id", "v").where("id is not null and v is not null")
    one = materialize(q.select("qid", "qv").dropDuplicates(["qid"]), "queries")
    moved = materialize(moved_queries(one, codes), "moved")
    to = links.where("node is not null and neighbour is not null").groupBy(F.col("node").alias("id")).agg(F.collect_set("neighbour").alias("to"))
    none = F.array().cast("array<long>")
    nodes = replace(codes, rows=materialize(codes.rows.join(to, "id", "left").withColumn("to", F.coalesce("to", none)), "nodes"))
    first = knn(one, entries.toDF("id", "embedding"), starts, "l2", exclude_self=hide_self).select("qid", "id")
    ways = q.select("qid", F.greatest(F.col("ef").cast("int"), F.lit(1)).alias("ef"), F.explode(F.array(*map(F.lit, range(len(policies))))).alias("way"))
    state, run = materialize(_begun(ways, first), "state"), _round([_routes(p) for p in policies], k, pops, window, decay, hide_self)
    for _ in range(rounds):
        live = state.where("live")
        if live.isEmpty():
            break
        fresh = estimates(live.select("qid", F.explode("ask").alias("id")), moved, nodes, "to")
        fresh = fresh.where("est is not null and slack is not null").groupBy("qid").agg(F.collect_list(F.struct("id", "est", "slack", "to")).alias("f"))
        new = [F.coalesce(F.col(f"f.{c}"), F.array().cast(kind)).alias(f"new_{c}") for c, kind in (("id", "array<long>"), ("est", "array<double>"), ("slack", "array<double>"), ("to", "array<array<long>>"))]
        stepped = live.join(fresh, "qid", "left").select(*state.columns, *new).mapInArrow(run, STATE)
        state = succeeding(stepped.unionByName(state.where("not live")), "state")
    else:
        raise RuntimeError(f"walks didn't end in {rounds} rounds")
    n = F.size("efs")
    places = F.sequence(F.lit(0), n - 1)
    in_pool = F.transform("ids", lambda id, i: F.struct(id.alias("id"), F.filter(places, lambda w: F.get("marks", i * n + w).cast("int").bitwiseAND(F.lit(POOL)) > 0).alias("of")))
    pool = state.select("qid", F.explode(in_pool).alias("p")).select("qid", "p.id", "p.of").where(F.size("of") > 0)
    asked = one.join(state.select("qid", "ways", "efs"), "qid")
    exact = pool.join(vectors, "id").join(asked, "qid").select("qid", "id", metric("l2").column(F.col("qv"), F.col("v")).alias("dist"), F.transform("of", lambda w: F.struct(F.get("ways", w).alias("way"), F.get("efs", w).alias("ef"))).alias("of"))
    rank = F.row_number().over(Window.partitionBy("qid", "way", "ef").orderBy("dist", "id"))
    hits = exact.select("qid", "id", "dist", F.explode("of").alias("of")).select("qid", "of.way", "of.ef", "id", "dist")
    hits = hits.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "way", "ef", "rank", "id", "dist")
    each = F.transform(places, lambda w: F.struct(F.get("ways", w).alias("way"), F.get("efs", w).alias("ef"), F.slice("numbers", w * NUMBERS + 1, NUMBERS).alias("x")))
    did, x = state.select("qid", F.explode(each).alias("w")).select("qid", "w.*"), F.col("x")
    mean = F.when(x[4] > 0, x[3] / x[4])
    return hits, did.select("qid", "way", "ef", x[6].cast("long").alias("ndis"), x[7].cast("long").alias("refined"), x[1].cast("int").alias("full_pops"), mean.alias("cfr_mean"), x[0].cast("int").alias("effective_ef"))


def walk(queries: DataFrame, base: DataFrame, codes: Coded, links: DataFrame, entries: DataFrame, k: int = 10, policy: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Hits ``(qid, ef, rank, id, dist)`` by squared distance of ``(qid, qv, ef)``, and
    what the walks did: ``(qid, ef, ndis, refined, full_pops, cfr_mean,
    effective_ef)``, ``ndis`` estimates and ``refined`` distances of vectors. ``base``
    is ``(id, embedding)``, ``links`` ``(node, neighbour)``, ``entries`` rows of the
    base. ``policy``, as ``calibrate.thresholds`` returns it, narrows walks whose
    ratios are low. ``options`` are those of ``walks``."""
    hits, did = walks(queries, base, codes, links, entries, k, [policy], **options)
    return hits.drop("way"), did.drop("way")


def recalls(hits: DataFrame, asked: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """``(qid, ef, recall)`` of each of ``asked`` (qid, ef)."""
    true = truth.where(F.col("rank") <= k).select("qid", "id")
    found = hits.join(true, ["qid", "id"]).groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"))
    return asked.select(*_KEY).distinct().join(found, list(_KEY), "left").select("qid", "ef", (F.coalesce("n", F.lit(0)) / k).alias("recall"))


def calibrated(base: DataFrame, codes: Coded, links: DataFrame, entries: DataFrame, near: DataFrame, efs: Iterable[int], k: int = 10, n_probes: int = 100, buckets: int = 4, gap: int = 2, least_recall: float = 0.9, lid_k: int = 20, **options) -> dict[str, DataFrame]:
    """The policy of walks over these codes, without labelled queries: probes are
    rows of the base, chosen by their local dimension from ``near``, each row's
    nearest others ``(qid, rank, id, dist)``, which are their truth too. All widths of
    all probes are one walk. ``options`` are those of ``walk``."""
    spark, efs = base.sparkSession, sorted(set(efs))
    lids = materialize(calibrate.lid(near, lid_k), "lid")
    probes = materialize(calibrate.quantile_probes(calibrate.trimmed(lids), n_probes), "probes")
    route = materialize(calibrate.routes(spark.createDataFrame([(int(e),) for e in efs], "ef int"), buckets, gap), "routes")
    wanted = sorted({r[0] for r in route.select("pair_ef").distinct().collect()})
    widths = sorted({*efs, *(max(k, w) for w in wanted)})
    q = materialize(probes.select("id").join(base.toDF("id", "qv"), "id").select(F.col("id").alias("qid"), "qv", F.explode(F.array(*map(F.lit, widths))).alias("ef")), "walks")
    hits, did = walk(q, base, codes, links, entries, k, hide_self=True, **options)
    did = materialize(did, "did")
    r = materialize(recalls(hits, q, near, k), "recalls")
    as_wanted = spark.createDataFrame([(w, max(k, w)) for w in wanted], "pair_ef int, ef int")
    at_pairs = r.join(F.broadcast(as_wanted), "ef").select("qid", F.col("pair_ef").alias("ef"), "recall")
    own = F.col("ef").isin(efs)
    policy = materialize(calibrate.thresholds(route, at_pairs, did.where(own).select("qid", "ef", "cfr_mean"), least_recall), "policy")
    curve = r.where(own).groupBy("ef").agg(F.avg("recall").alias("recall"))
    return {"policy": policy, "recommended": calibrate.recommended(curve), "recalls": r, "did": did, "probes": probes}
