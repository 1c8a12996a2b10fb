"""Evaluation of results against ground truth, of latencies, and of curves.

Result and ground truth are ``(qid, rank, id, dist)``; a curve is a frame of
operating points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.ordered import running


def everything():
    """The window of all rows; windows need a session, so it isn't a constant."""
    return Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def recall(result: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(qid, hits, recall) at k, for each query of the truth."""
    found = result.where(F.col("rank") <= k).select("qid", "id", F.lit(1).alias("hit")).distinct()
    t = truth.where(F.col("rank") <= k).select("qid", "id").distinct()
    hits = F.coalesce(F.sum("hit"), F.lit(0))
    return t.join(found, ["qid", "id"], "left").groupBy("qid").agg(hits.cast("long").alias("hits"), (hits / k).alias("recall"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Hits that two results share over all that the first has: one row."""
    n = a.agg(F.count(F.lit(1)).alias("n"))
    both = a.select("qid", "id").intersect(b.select("qid", "id")).agg(F.count(F.lit(1)).alias("shared"))
    return n.join(both, F.lit(True)).select("shared", "n", F.try_divide("shared", "n").alias("share"))


def one_recall(result: DataFrame, truth: DataFrame, at: int) -> DataFrame:
    """The share of queries whose true nearest row is among the first ``at``."""
    nearest = truth.where("rank = 1").select("qid", "id")
    found = result.where(F.col("rank") <= at).select("qid", "id", F.lit(1.0).alias("hit")).distinct()
    return nearest.join(found, ["qid", "id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))


def range_scores(result: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """Precision and recall of a range result for each query. A query without
    results has precision 1, and recall 1 only if nothing was to be found."""
    r = result.groupBy("qid").agg(F.count(F.lit(1)).alias("n_result"))
    t = truth.groupBy("qid").agg(F.count(F.lit(1)).alias("n_truth"))
    b = result.join(truth.select("qid", "id"), ["qid", "id"]).groupBy("qid").agg(F.count(F.lit(1)).alias("n_both"))
    out = queries.select("qid").join(r, "qid", "left").join(t, "qid", "left").join(b, "qid", "left").na.fill(0, ["n_result", "n_truth", "n_both"])
    precision = F.when(F.col("n_result") == 0, 1.0).otherwise(F.try_divide("n_both", "n_result"))
    rec = F.when(F.col("n_truth") == 0, (F.col("n_result") == 0).cast("double")).otherwise(F.try_divide("n_both", "n_truth"))
    return out.select("qid", "n_result", "n_truth", "n_both", precision.alias("precision"), rec.alias("recall"))


def range_overall(result: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision and recall over all queries together."""
    j = result.select("qid", "id", F.lit(1).alias("r")).join(truth.select("qid", "id", F.lit(1).alias("t")), ["qid", "id"], "full")
    n = j.agg(F.count("r").alias("n_result"), F.count("t").alias("n_truth"), F.count_if(F.col("r").isNotNull() & F.col("t").isNotNull()).alias("n_both"))
    one = lambda of: F.when(F.col(of) == 0, 1.0).otherwise(F.try_divide("n_both", of))
    return n.select("*", one("n_result").alias("precision"), F.when(F.col("n_truth") == 0, (F.col("n_result") == 0).cast("double")).otherwise(F.try_divide("n_both", "n_truth")).alias("recall"))


def range_curve(result: DataFrame, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """Overall precision and recall of the results below each threshold,
    against the truth below the same threshold."""
    t = truth.select("qid", "id", F.col("dist").alias("true_dist"))
    j = result.select("qid", "id", "dist").join(t, ["qid", "id"], "full")
    at = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    inside = lambda c: F.coalesce(F.col(c) < F.col("threshold"), F.lit(False))
    n = j.select("dist", "true_dist", at).groupBy("threshold").agg(
        F.count_if(inside("dist")).alias("n_result"), F.count_if(inside("true_dist")).alias("n_truth"), F.count_if(inside("dist") & inside("true_dist")).alias("n_both"))
    precision = F.when(F.col("n_result") == 0, 1.0).otherwise(F.try_divide("n_both", "n_result"))
    rec = F.when(F.col("n_truth") == 0, (F.col("n_result") == 0).cast("double")).otherwise(F.try_divide("n_both", "n_truth"))
    return n.select("threshold", "n_result", "n_truth", "n_both", precision.alias("precision"), rec.alias("recall"))


def range_weight(distance: Column, radius: float | None = None, steps: list[tuple[float, float]] | None = None) -> Column:
    """What a range hit counts for: 1 within the radius, or the score of its
    distance along (distance, score) steps, interpolated, 0 beyond the last."""
    if steps is None:
        return (distance < radius).cast("double")
    out = F.lit(0.0)
    for (d0, s0), (d1, s1) in reversed(list(zip(steps, steps[1:]))):
        out = F.when(distance <= d1, s0 + (F.greatest(distance, F.lit(d0)) - d0) * ((s1 - s0) / (d1 - d0))).otherwise(out)
    return out


def fitted_sigmoid(points: list[tuple[float, float]], rounds: int = 50) -> Callable[[Column], Column]:
    """A falling sigmoid through (distance, score) pairs, scores from 0 to 1, fitted
    by least squares; it is 0 beyond the largest distance."""
    import numpy as np

    x, y = np.array(points, float).T
    z = np.log(np.clip(y, 1e-3, 1 - 1e-3) / (1 - np.clip(y, 1e-3, 1 - 1e-3)))
    slope, shift = np.polyfit(x, z, 1) if len(set(x)) > 1 else (0.0, z.mean())
    for _ in range(rounds):  # Gauss and Newton from the line through the logits
        p = 1 / (1 + np.exp(-(slope * x + shift)))
        j = np.column_stack([p * (1 - p) * x, p * (1 - p)])
        step = np.linalg.lstsq(j, y - p, rcond=None)[0]
        if ((y - 1 / (1 + np.exp(-((slope + step[0]) * x + shift + step[1])))) ** 2).sum() >= ((y - p) ** 2).sum():
            break
        slope, shift = slope + step[0], shift + step[1]
    return lambda d: F.when(d <= float(x.max()), 1 / (1 + F.exp(-(d * float(slope) + float(shift))))).otherwise(0.0)


def latencies(times: DataFrame, by: list[str], ms: str = "ms") -> DataFrame:
    q = F.percentile(ms, F.array(F.lit(0.5), F.lit(0.95)))
    out = times.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(ms).alias("mean_ms"), q.alias("q"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"), F.sum(ms).alias("total_ms"))
    return out.select(*by, "n", "mean_ms", F.col("q")[0].alias("p50_ms"), F.col("q")[1].alias("p95_ms"), "min_ms", "max_ms", (F.col("n") * 1000 / F.col("total_ms")).alias("qps"))


def pareto(points: DataFrame, better: str, cost: str, by: list[str] | None = None) -> DataFrame:
    """Points that no other one dominates: none is at least as good for less."""
    order = [F.col(better).desc(), F.col(cost).asc()]
    if by:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        marked = points.withColumn("_least", F.min(cost).over(w))
    else:
        marked = running(points, order, {"_least": ("min", F.col(cost))})
    return marked.where(F.col("_least").isNull() | (F.col(cost) < F.col("_least"))).drop("_least")


def recall_qps_frontier(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The best QPS for each recall (to 10 digits), then only points whose QPS
    rises on the way down from the highest recall."""
    by = by or []
    best = points.withColumn("recall", F.round("recall", 10)).groupBy(*by, "recall").agg(F.max("qps").alias("qps"))
    if by:
        above = Window.partitionBy(*by).orderBy(F.col("recall").desc()).rowsBetween(Window.unboundedPreceding, -1)
        marked = best.withColumn("_most", F.max("qps").over(above))
    else:
        marked = running(best, [F.col("recall").desc()], {"_most": ("max", F.col("qps"))})
    return marked.where(F.col("_most").isNull() | (F.col("qps") > F.col("_most"))).drop("_most")


def at_recall(curve: DataFrame, target: float, value: str, by: list[str], log: bool = False, clamp: bool = False) -> DataFrame:
    """``value`` where a recall curve crosses the target, linear (or linear in
    its logarithm) between neighbours; null outside the curve, or its end if
    ``clamp``."""
    v = F.log(value) if log else F.col(value).cast("double")
    # of equal recalls the least value counts
    pts = curve.groupBy(*by, "recall").agg(F.min(v).alias("v"))
    w = Window.partitionBy(*by).orderBy("recall")
    pairs = pts.select(*by, "recall", "v", F.lead("recall").over(w).alias("r1"), F.lead("v").over(w).alias("v1"))
    inside = (F.col("recall") <= target) & ((F.col("r1") > target) | (F.col("recall") == target))
    share = F.when(F.col("r1").isNotNull(), (target - F.col("recall")) / (F.col("r1") - F.col("recall"))).otherwise(0.0)
    hit = F.max(F.when(inside, F.col("v") + F.when(share > 0, share * (F.col("v1") - F.col("v"))).otherwise(0.0)))
    ends = F.when(F.min("recall") > target, F.min_by("v", "recall")).when(F.max("recall") < target, F.max_by("v", "recall"))
    out = F.coalesce(hit, ends) if clamp else hit
    return pairs.groupBy(*by).agg((F.exp(out) if log else out).alias(value))


def ecdf(values: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Adds ``ecdf``, the share of rows (of the group) up to each value. Rows are
    counted by value first, so a window holds distinct values only."""
    n = values.groupBy(*(by or []), value).agg(F.count(F.lit(1)).alias("_n"))
    if by:
        w = Window.partitionBy(*by)
        sums = n.withColumn("_up", F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(w))
    else:
        sums = running(n, [F.col(value).asc()], {"_up": ("sum", F.col("_n"))}, including=True).join(F.broadcast(n.agg(F.sum("_n").alias("_all"))), F.lit(True))
    keys = [*(by or []), value]
    sums = sums.select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keys)), (F.col("_up") / F.col("_all")).alias("ecdf"))
    on = [values[k].eqNullSafe(sums[f"_{i}"]) for i, k in enumerate(keys)]
    return values.join(sums, on).drop(*(f"_{i}" for i in range(len(keys))))


def _ranked(values: DataFrame, value: str, alias: str) -> DataFrame:
    """Mean ranks: counts by value, then sums along the distinct values."""
    n = values.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    sums = running(n, [value], {"_before": ("sum", F.col("_n"))})
    return sums.select(value, (F.col("_before") + (F.col("_n") + 1) / 2).alias(alias))


def rank_correlation(values: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman's, with mean ranks for ties."""
    v = values.select(F.col(x).alias("x"), F.col(y).alias("y")).dropna()
    return v.join(_ranked(v, "x", "rx"), "x").join(_ranked(v, "y", "ry"), "y").agg(F.corr("rx", "ry").alias("rho"))


def auc(values: DataFrame, score: str, positive: str) -> DataFrame:
    """The area under the ROC curve, by rank sums."""
    v = values.select(F.col(score).alias("s"), F.col(positive).cast("boolean").alias("p")).dropna()
    r = v.join(_ranked(v, "s", "r"), "s")
    n1, n0 = F.count_if("p"), F.count_if(~F.col("p"))
    return r.agg(F.try_divide(F.sum(F.when(F.col("p"), F.col("r"))) - n1 * (n1 + 1) / 2, n1 * n0).alias("auc"))


def ks(values: DataFrame, value: str, group: str) -> DataFrame:
    """The largest distance between the ECDFs of the rows where ``group`` is
    true and of those where it is false."""
    v = values.select(F.col(value).alias("v"), F.col(group).cast("boolean").alias("g")).dropna()
    n = v.groupBy("v").agg(F.count_if("g").alias("n1"), F.count_if(~F.col("g")).alias("n0"))
    sums = running(n, ["v"], {"s1": ("sum", F.col("n1")), "s0": ("sum", F.col("n0"))}, including=True)
    both = F.broadcast(n.agg(F.sum("n1").alias("a1"), F.sum("n0").alias("a0")))
    return sums.join(both, F.lit(True)).agg(F.max(F.abs(F.try_divide("s1", "a1") - F.try_divide("s0", "a0"))).alias("ks"))
