"""Calibration of adaptive search: local intrinsic dimension, probe selection,
routes and thresholds, a recommended width, difficulty groups and analyses."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.evaluate import everything
from lodestar.operators.ordered import numbered
from lodestar.sources.shared import materialize

_PROBES = "selection_rank int, id long, lid double, bucket_lower double, bucket_upper double, target_lid double, used_fallback boolean"


def lid(neighbours: DataFrame, k: int) -> DataFrame:
    """(id, lid) from each row's neighbours ``(qid, rank, id, dist)`` but itself:
    -k / sum(ln(d / d_max)) over the first k distances above 1e-9, 0 where that
    is undefined."""
    sound = neighbours.where((F.col("dist") > 1e-9) & (F.col("dist") < float("inf")))
    nth = F.row_number().over(Window.partitionBy("qid").orderBy("dist", "id"))
    near = sound.withColumn("nth", nth).where(F.col("nth") <= k)
    a = near.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("far"), F.sum(F.log("dist")).alias("logs"))
    total = F.col("logs") - F.col("n") * F.log("far")
    value = F.when((F.col("n") >= 2) & (F.abs(total) > 1e-12), -F.col("n") / F.when(F.abs(total) > 1e-12, total)).otherwise(0.0)
    return neighbours.select("qid").distinct().join(a.select("qid", value.alias("lid")), "qid", "left").select(F.col("qid").alias("id"), F.coalesce("lid", F.lit(0.0)).alias("lid"))


def sampled(rows: DataFrame, n: int, id: str = "id", exact: bool = False) -> DataFrame:
    """n rows by the order of their ids' hashes: the same at every run."""
    out = rows.orderBy(F.xxhash64(F.col(id), F.lit(42)), id).limit(n)
    if exact and out.count() < n:
        raise ValueError(f"there are fewer than {n} rows")
    return out


def trimmed(lids: DataFrame, low: float = 1, high: float = 99) -> DataFrame:
    """Rows within the percentiles, both included, with these as lid_min and
    lid_max."""
    p = lids.agg(F.percentile("lid", F.array(F.lit(low / 100), F.lit(high / 100))).alias("p")).select(F.col("p")[0].alias("lid_min"), F.col("p")[1].alias("lid_max"))
    return lids.join(F.broadcast(p), F.col("lid").between(F.col("lid_min"), F.col("lid_max")))


def at_places(rows: DataFrame, places: list[int]) -> dict[int, tuple[float, int]]:
    """The (lid, id) that have these places, from 0, in the order of (lid, id).
    Rows are range-partitioned, so no task holds them all."""
    dealt = materialize(rows.select("lid", "id").repartitionByRange("lid", "id").withColumn("part", F.spark_partition_id()), "parts")  # bounds are sampled: once
    found, before = {}, 0
    wanted = []
    for part, n in sorted((r.part, r["count"]) for r in dealt.groupBy("part").count().collect()):
        wanted += [(part, p - before + 1, p) for p in sorted(set(places)) if before <= p < before + n]
        before += n
    if wanted:
        nth = F.row_number().over(Window.partitionBy("part").orderBy("lid", "id"))
        w = rows.sparkSession.createDataFrame(wanted, "part int, nth int, place long")
        found = {r.place: (r.lid, r.id) for r in dealt.withColumn("nth", nth).join(F.broadcast(w), ["part", "nth"]).collect()}
    return found


def quantile_probes(pool: DataFrame, n: int) -> DataFrame:
    """The middle row of each of n chunks of the pool by (lid, id); larger
    chunks come first."""
    pool = materialize(pool.select("lid", "id"), "pool")
    total, chunks = pool.count(), []
    for i in range(min(n, total)):
        start, size = i * (total // n) + min(i, total % n), total // n + (i < total % n)
        chunks.append((start, start + size // 2, start + size - 1, start + (size - 1) // 2))
    at = at_places(pool, [p for c in chunks for p in c])
    out = [(i, at[middle][1], at[middle][0], at[low][0], at[high][0], (at[middle][0] + at[left][0]) / 2, False) for i, (low, middle, high, left) in enumerate(chunks)]
    return pool.sparkSession.createDataFrame(out, _PROBES)


def uniform_probes(pool: DataFrame, n: int) -> DataFrame:
    """The row nearest to the middle of each of n equal ranges of lid, without
    replacement; an empty range takes the nearest row of all that are left. Each
    choice depends on the ones before, but at most n rows are taken, so of each
    range the driver needs the n lowest, the n highest and the n nearest to its
    middle."""
    bounded = {"lid_min", "lid_max"} <= set(pool.columns)
    pool = materialize(pool.select("lid", "id", *(("lid_min", "lid_max") if bounded else ())), "pool")
    spark = pool.sparkSession
    bounds = pool.agg(F.count(F.lit(1)), F.min("lid_min" if bounded else "lid"), F.max("lid_max" if bounded else "lid")).first()
    total, low, high = bounds
    if not total:
        raise ValueError("the pool is empty")
    n, out = min(n, total), []
    edge = [low + (high - low) * i / n for i in range(n)] + [high]
    middle = [(a + b) / 2 for a, b in zip(edge, edge[1:])]
    within = F.lit(0)
    for e in edge[1:-1]:
        within = within + (F.col("lid") >= e).cast("int")
    ranged = pool.withColumn("range", F.when(F.col("lid") < low, -1).when(F.col("lid") > high, n).otherwise(within))
    to_middle = F.abs(F.col("lid") - F.coalesce(F.get(F.array(*map(F.lit, middle)), F.greatest(F.col("range"), F.lit(0))), F.lit(high)))
    few = None
    for order in ((F.col("lid").asc(),), (F.col("lid").desc(),), (to_middle.asc(), F.col("lid").asc())):
        nth = F.row_number().over(Window.partitionBy("range").orderBy(*order, F.col("id").asc()))
        part = ranged.withColumn("nth", nth).where(F.col("nth") <= n).select("lid", "id")
        few = part if few is None else few.unionAll(part)
    rows = sorted((r.lid, r.id) for r in few.distinct().collect())
    for i in range(n):
        a, b = edge[i], edge[i + 1]
        inside = [r for r in rows if a <= r[0] and (r[0] <= b if i == n - 1 else r[0] < b)]
        pick = min(inside or rows, key=lambda r: abs(r[0] - middle[i]))
        rows.remove(pick)
        out.append((i, pick[1], pick[0], a, b, middle[i], not inside))
    return spark.createDataFrame(out, _PROBES)


def routes(efs: DataFrame, buckets: int = 4, gap: int = 2) -> DataFrame:
    """For each ef: ``route_idx, route_ef, pair_ef``. Routes are floor(ef * j /
    buckets), at least 1 and below ef, without repeats; a pair target is a
    route over ``gap``."""
    if buckets < 2 or gap < 1:
        raise ValueError("there are two buckets or more, and a gap of 1 or more")
    steps = F.transform(F.sequence(F.lit(1), F.lit(buckets - 1)), lambda j: F.least(F.greatest(F.lit(1), F.floor(F.col("ef") * j / buckets)), F.col("ef") - 1).cast("int"))
    r = efs.select("ef", F.posexplode(F.array_distinct(steps)).alias("route_idx", "route_ef"))
    return r.withColumn("pair_ef", F.greatest(F.lit(1), F.floor(F.col("route_ef") / gap)).cast("int"))


def thresholds(route: DataFrame, recalls: DataFrame, cfr: DataFrame, least_recall: float, scales: tuple[float, float, float] = (1, 1, 1)) -> DataFrame:
    """The policy ``ef, route_idx, route_ef, theta, tau, gamma``.

    ``recalls`` is (qid, ef, recall) of the probes at the pair targets, ``cfr`` is
    (qid, ef, cfr_mean) of the usable probes at each ef. The threshold of a route
    is the CFR quantile at the share of probes that reach ``least_recall`` at its
    pair target, scaled (first, middle, last route), never below 1e-6 nor below
    the route before."""
    ok = recalls.withColumnRenamed("ef", "pair_ef").withColumn("ok", (F.col("recall") + 1e-12 >= least_recall).cast("double"))
    usable = cfr.where(F.col("cfr_mean").isNotNull() & ~F.isnan("cfr_mean"))
    rate = route.join(usable.select("ef", "qid"), "ef").join(ok, ["pair_ef", "qid"]).groupBy("ef", "route_idx", "route_ef", "pair_ef").agg(F.avg("ok").alias("rate"))
    values = usable.groupBy("ef").agg(F.sort_array(F.collect_list("cfr_mean")).alias("v"))  # probes are few
    at = F.col("rate") * (F.size("v") - 1)
    low = F.get("v", F.floor(at).cast("int"))
    high = F.get("v", F.ceil(at).cast("int"))
    by_ef = Window.partitionBy("ef")
    so_far = by_ef.orderBy("route_idx").rowsBetween(Window.unboundedPreceding, 0)
    scale = F.when(F.col("routes") <= 1, scales[2]).when(F.col("route_idx") == 0, scales[0]).when(F.col("route_idx") == F.col("routes") - 1, scales[2]).otherwise(scales[1])
    out = rate.join(values, "ef").withColumn("q", low + (high - low) * (at - F.floor(at))).withColumn("routes", F.count(F.lit(1)).over(by_ef))
    out = out.withColumn("theta", F.max(F.greatest(F.col("q") * scale, F.lit(1e-6))).over(so_far)).withColumn("tau", F.max("theta").over(by_ef))
    gamma = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("theta") / F.greatest("tau", F.lit(1e-6))))
    return out.select("ef", "route_idx", "route_ef", "pair_ef", "rate", "theta", "tau", gamma.alias("gamma"))


def routed(queries: DataFrame, policy: DataFrame, k: int) -> DataFrame:
    """The ef that the policy gives a query of ``(qid, ef, cfr_mean)``: the first
    route whose gamma reaches cfr_mean / tau."""
    rows = queries.join(policy, "ef", "left")
    share = F.col("cfr_mean") / F.greatest("tau", F.lit(1e-6))
    fits = (F.col("cfr_mean") <= F.col("tau")) & (share <= F.col("gamma") + 1e-12)
    return rows.groupBy("qid", "ef").agg(F.coalesce(F.min(F.when(fits, F.greatest(F.lit(k), F.col("route_ef")))), F.col("ef")).alias("routed_ef"))


def recommended(curve: DataFrame, eps: float = 0.001) -> DataFrame:
    """``curve`` (ef, recall) with its running maximum, what is left to gain, and
    the recommended ef: the first with no more than ``eps`` left."""
    w = Window.orderBy("ef").rowsBetween(Window.unboundedPreceding, 0)
    c = curve.withColumn("cumulative", F.max("recall").over(w)).withColumn("most", F.max("recall").over(everything()))
    c = c.withColumn("left", F.col("most") - F.col("cumulative")).withColumn("gain", F.col("cumulative") - F.lag("cumulative").over(Window.orderBy("ef")))
    pick = F.coalesce(F.min(F.when(F.col("left") <= eps, F.col("ef"))).over(everything()), F.max("ef").over(everything()))
    return c.select("ef", "recall", "cumulative", "left", "gain", pick.alias("recommended_ef"))


def difficulty(queries: DataFrame, share: float = 0.3) -> DataFrame:
    """``queries`` (qid, recall, first_step) with rank, percentile and group: the
    first share of them is easy, the last hard."""
    q = numbered(queries, [F.col("recall").desc(), F.col("first_step").asc(), F.col("qid").asc()])
    q = q.join(F.broadcast(queries.agg(F.count(F.lit(1)).alias("n"))), F.lit(True)).withColumn("cut", F.floor(F.col("n") * share))
    group = F.when(F.col("rank") <= F.col("cut"), "easy").when(F.col("rank") > F.col("n") - F.col("cut"), "hard").otherwise("medium")
    return q.select("qid", "recall", "first_step", F.col("rank").cast("int").alias("rank"), F.coalesce(F.try_divide(F.col("rank") - 1, F.col("n") - 1), F.lit(0.0)).alias("percentile"), group.alias("group"))


def drill_down(groups: DataFrame, runs: DataFrame) -> DataFrame:
    """Recall, distances and width by group, ef and method, for ``runs`` (qid,
    ef, method, recall, ndis, effective_ef), with what adaptive runs save."""
    g = runs.join(groups.select("qid", "group"), "qid").groupBy("group", "ef", "method").agg(F.count(F.lit(1)).alias("n"), F.avg("recall").alias("recall"), F.avg("ndis").alias("ndis"), F.avg("effective_ef").alias("effective_ef"))
    base = g.where("method = 'vanilla'").select("group", "ef", F.col("recall").alias("vanilla_recall"), F.col("ndis").alias("vanilla_ndis"))
    return g.join(base, ["group", "ef"], "left").select(*g.columns, (F.col("recall") - F.col("vanilla_recall")).alias("recall_delta"), (1 - F.col("ndis") / F.col("vanilla_ndis")).alias("ndis_saved"))


def false_easy(groups: DataFrame, runs: DataFrame) -> DataFrame:
    """Hard queries that ran below their full width, with what recall they lost:
    by width, how many, and the drop's mean and quartiles."""
    hard = groups.where(F.col("group") == "hard").select("qid")
    wide = runs.where("method = 'vanilla'").select("qid", "ef", F.col("recall").alias("full_recall"))
    low = runs.where("method = 'adaptive'").where(F.col("effective_ef") < F.col("ef")).join(hard, "qid").join(wide, ["qid", "ef"])
    drop = F.col("full_recall") - F.col("recall")
    return low.groupBy("ef", "effective_ef").agg(F.count(F.lit(1)).alias("n"), F.count_if(drop > 0).alias("n_lost"), F.avg(drop).alias("mean_drop"), F.percentile(drop, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("drop_quartiles"))


def loss_by_query(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs of the same queries side by side: recall lost, distances saved."""
    x, y = a.select("qid", "recall", "ndis"), b.select("qid", F.col("recall").alias("recall_b"), F.col("ndis").alias("ndis_b"))
    return x.join(y, "qid").select("qid", "recall", "recall_b", (F.col("recall") - F.col("recall_b")).alias("lost"), (1 - F.col("ndis_b") / F.col("ndis")).alias("saved"))


def hit_bursts(hits: DataFrame, gap: int) -> DataFrame:
    """Runs of steps at which new true neighbours are found, no more than
    ``gap`` apart: ``hits`` is (qid, step, found)."""
    w = Window.partitionBy("qid").orderBy("step")
    grew = hits.withColumn("new", F.col("found") - F.coalesce(F.lag("found").over(w), F.lit(0))).where("new > 0")
    marked = grew.withColumn("begins", F.coalesce((F.col("step") - F.lag("step").over(w) > gap).cast("int"), F.lit(1)))
    runs = marked.withColumn("burst", F.sum("begins").over(w))
    return runs.groupBy("qid", "burst").agg(F.min("step").alias("first"), F.max("step").alias("last"), F.sum("new").alias("found"))


def first_steps(steps: DataFrame, targets: list[int]) -> DataFrame:
    """The first step at which a trace holds each number of true neighbours."""
    return steps.groupBy("qid").agg(*(F.min(F.when(F.col("hits") >= t, F.col("step"))).alias(f"first_{t}") for t in targets))


def cfr_of_trace(cfr: Column, decay: float = 0.8, start: int = 4, end: int = 16) -> Column:
    """The mean of the smoothed ratios in the window, over an ordered array of
    the ratios at full pops."""
    empty = F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("s"), F.lit(0.0).alias("total"), F.lit(0).alias("seen"))

    def step(a, x):
        s = F.when(a["s"].isNull(), x).otherwise(a["s"] * decay + x * (1 - decay))
        n = a["n"] + 1
        inside = (n >= start) & (n <= end)
        return F.struct(n.alias("n"), s.alias("s"), (a["total"] + F.when(inside, s).otherwise(0.0)).alias("total"), (a["seen"] + inside.cast("int")).alias("seen"))

    return F.aggregate(cfr, empty, step, lambda a: F.when(a["seen"] > 0, a["total"] / a["seen"]))


def save_policy(policy: DataFrame, settings: dict, path: str) -> None:
    """Write a policy with the settings that it was built under."""
    policy.withColumn("settings", F.lit(json.dumps(settings, sort_keys=True))).write.mode("overwrite").parquet(path)


def load_policy(spark, settings: dict, path: str, efs: list[int] | None = None) -> DataFrame:
    """A saved policy; other settings than the saved ones are an error. Fewer efs
    than were saved are fine."""
    saved = spark.read.parquet(path)
    row = saved.select("settings").first()
    if row is None or json.loads(row[0]) != json.loads(json.dumps(settings)):
        raise ValueError("the saved policy was built under other settings")
    out = saved.drop("settings")
    if efs is not None:
        have = {r[0] for r in out.select("ef").distinct().collect()}
        if missing := set(efs) - have:
            raise ValueError(f"the saved policy lacks ef {sorted(missing)}")
        out = out.where(F.col("ef").isin(list(efs)))
    return out


def load_or_build(spark, settings: dict, path: str, build: Callable[[], DataFrame], efs: list[int] | None = None) -> tuple[DataFrame, str]:
    """The policy at a path, and "hit"; where there is none, or one of other
    settings or with fewer efs, it is built and saved there, and the status is
    "miss" or "rebuilt"."""
    from pyspark.errors import AnalysisException

    try:
        return load_policy(spark, settings, path, efs), "hit"
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        status = "miss"
    except ValueError:
        status = "rebuilt"
    save_policy(materialize(build(), "policy"), settings, path)
    return load_policy(spark, settings, path, efs), status


def route_mix(runs: DataFrame, groups: DataFrame) -> DataFrame:
    """How adaptive runs were routed: by ef, group and width, how many queries and
    which share of the group."""
    n = runs.where("method = 'adaptive'").join(groups.select("qid", "group"), "qid").groupBy("ef", "group", "effective_ef").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("ef", "group")))


def overlap(first: DataFrame, second: DataFrame) -> DataFrame:
    """Queries that two analyses name: how many each, both, and their Jaccard
    similarity."""
    a, b = first.select("qid", F.lit(1).alias("a")).distinct(), second.select("qid", F.lit(1).alias("b")).distinct()
    n = a.join(b, "qid", "full").agg(F.count("a").alias("first"), F.count("b").alias("second"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count(F.lit(1)).alias("any"))
    return n.select("first", "second", "both", F.try_divide("both", "any").alias("jaccard"))


def hits_in_windows(hits: DataFrame, width: int) -> DataFrame:
    """True neighbours found in each window of ``width`` steps, by query: ``hits``
    is (qid, step, found)."""
    w = Window.partitionBy("qid").orderBy("step")
    new = hits.withColumn("new", F.col("found") - F.coalesce(F.lag("found").over(w), F.lit(0)))
    return new.groupBy("qid", F.floor((F.col("step") - 1) / width).cast("int").alias("window")).agg(F.sum("new").alias("found"), F.max("step").alias("last"))


def recovery_budget(hits: DataFrame, stops: DataFrame, target: int) -> DataFrame:
    """How many more steps a query that stopped early would have needed to hold
    ``target`` true neighbours: ``stops`` is (qid, stopped); null if its trace
    never holds so many, 0 if it did when it stopped."""
    first = hits.where(F.col("found") >= target).groupBy("qid").agg(F.min("step").alias("first"))
    more = F.when(F.col("first").isNotNull(), F.greatest(F.lit(0), F.col("first") - F.col("stopped")))
    return stops.join(first, "qid", "left").select("qid", "stopped", more.alias("more"))


def replayed(full: DataFrame, stops: DataFrame, k: int) -> DataFrame:
    """Recall at the step where a walk stopped, beside that of the whole walk, from
    the trace (qid, step, found) of the whole one."""
    at = full.join(stops, "qid").where(F.col("step") <= F.col("stopped")).groupBy("qid").agg(F.max("found").alias("held"))
    whole = full.groupBy("qid").agg(F.max("found").alias("most"))
    return whole.join(at, "qid", "left").select("qid", (F.coalesce("held", F.lit(0)) / k).alias("recall"), (F.col("most") / k).alias("full_recall"), ((F.col("most") - F.coalesce("held", F.lit(0))) / k).alias("lost"))


def cost_by_step(times: DataFrame) -> DataFrame:
    """Offline cost: the median seconds of each step over its repeats, and its
    share of all steps of its run. ``times`` is (run, step, repeat, seconds)."""
    steps = times.groupBy("run", "step").agg(F.count(F.lit(1)).alias("repeats"), F.percentile("seconds", F.lit(0.5)).alias("seconds"))
    return steps.withColumn("share", F.col("seconds") / F.sum("seconds").over(Window.partitionBy("run")))


def ablation(runs: DataFrame, variant: str = "variant") -> DataFrame:
    """For each variant and ef of ``runs`` (variant, ef, method, recall,
    seconds): how much faster adaptive search is and what share of recall it
    loses."""
    of = lambda method: runs.where(F.col("method") == method).select(variant, "ef", F.col("recall").alias(f"{method}_recall"), F.col("seconds").alias(f"{method}_seconds"))
    both = of("vanilla").join(of("adaptive"), [variant, "ef"])
    return both.select(variant, "ef", (F.col("vanilla_seconds") / F.col("adaptive_seconds")).alias("speedup"), ((F.col("vanilla_recall") - F.col("adaptive_recall")) / F.col("vanilla_recall")).alias("loss"))


def truth_drift(pseudo: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """How many true neighbours a pseudo ground truth holds for each query."""
    from lodestar.operators.evaluate import recall

    return recall(pseudo, exact, k)


def ndis_savings(weak: DataFrame, strong: DataFrame) -> DataFrame:
    """Distances that a better graph saves, by ef: both are (ef, ndis)."""
    a, b = weak.groupBy("ef").agg(F.avg("ndis").alias("weak")), strong.groupBy("ef").agg(F.avg("ndis").alias("strong"))
    return a.join(b, "ef").select("ef", "weak", "strong", (1 - F.col("strong") / F.col("weak")).alias("saved"))
