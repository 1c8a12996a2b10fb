"""Clustering: k-means and its relatives over ``(id, embedding)``.

An iteration is one pass: each block of rows is assigned to the centroids, a
parameter of bounded size, and returns only its sums, so what is shuffled
doesn't grow with the rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.metrics import metric
from lodestar.operators.blocks import pack, unpack

#: Rows that initial centroids are chosen from, for each centroid, at most.
POINTS_PER_CENTROID = 256


@dataclass(frozen=True)
class KMeans:
    k: int
    iterations: int = 25
    redo: int = 1
    spherical: bool = False
    integral: bool = False
    init: str = "first"  # or "hash", "plusplus", "afkmc2"
    seed: int = 1234
    frozen: bool = False


def _nearest(v, centroids, name: str):
    import numpy as np

    m = metric(name)
    d = m.tile(v, centroids)
    return np.argmin(-d if m.larger_is_better else d, axis=1), d


def initial(base: DataFrame, p: KMeans, attempt: int = 0):
    """Centroids from a bounded sample of the rows, by hash, or the rows of least
    id."""
    import numpy as np

    rows = base.toDF("id", "v").where("v is not null")
    if p.init == "first":
        return np.array([r.v for r in rows.orderBy("id").limit(p.k).collect()], float)
    n = p.k if p.init == "hash" else p.k * POINTS_PER_CENTROID
    pool = np.array([r.v for r in rows.orderBy(F.xxhash64("id", F.lit(p.seed + attempt)), "id").limit(n).collect()], float)
    if p.init == "hash":
        return pool
    random = np.random.default_rng(p.seed + attempt)
    chosen = [int(random.integers(len(pool)))]
    gap = ((pool - pool[chosen[0]]) ** 2).sum(1)
    proposal = gap / (2 * max(gap.sum(), 1e-30)) + 1 / (2 * len(pool))
    while len(chosen) < min(p.k, len(pool)):
        if p.init == "plusplus":
            nxt = int(random.choice(len(pool), p=gap / gap.sum())) if gap.sum() > 0 else int(random.integers(len(pool)))
        elif p.init == "afkmc2":  # a Markov chain on the proposal instead of exact sampling
            chain = random.choice(len(pool), size=50, p=proposal)
            nxt = int(chain[0])
            for c in chain[1:].tolist():
                if gap[nxt] * proposal[c] == 0 or random.random() < gap[c] * proposal[nxt] / (gap[nxt] * proposal[c]):
                    nxt = c
        else:
            raise ValueError(f"unknown init {p.init!r}")
        chosen.append(nxt)
        gap = np.minimum(gap, ((pool - pool[nxt]) ** 2).sum(1))
    return pool[chosen]


def sums(base: DataFrame, centroids, name: str = "l2", weights: DataFrame | None = None) -> DataFrame:
    """One pass: ``list_no, n, total`` (per dimension) and ``cost``."""
    rows = base.toDF("id", "v")
    shared = rows.sparkSession.sparkContext.broadcast(centroids)
    weighted = weights is not None
    packed = pack(rows) if not weighted else None

    def part(batches):
        import numpy as np
        import pyarrow as pa

        c = shared.value
        n, total, cost = np.zeros(len(c)), np.zeros_like(c), np.zeros(len(c))
        for batch in batches:
            for r in batch.to_pylist():
                if weighted:
                    v, w = np.array([r["v"]], float), np.array([r["weight"]])
                else:
                    v = unpack(r["ids"], r["width"], r["vectors"])[1]
                    w = np.ones(len(v))
                a, d = _nearest(v, c, name)
                np.add.at(n, a, w)
                np.add.at(total, a, v * w[:, None])
                np.add.at(cost, a, w * d[np.arange(len(v)), a])
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"list_no": used.astype(np.int32), "n": n[used], "total": list(total[used]), "cost": cost[used]}, pa.schema([("list_no", pa.int32()), ("n", pa.float64()), ("total", pa.list_(pa.float64())), ("cost", pa.float64())]))

    source = rows.join(weights.toDF("id", "weight"), "id").select("v", "weight") if weighted else packed
    parts = source.mapInArrow(part, "list_no int, n double, total array<double>, cost double")
    by_dim = [F.sum(F.get("total", F.lit(i))).alias(f"d{i}") for i in range(centroids.shape[1])]
    return parts.groupBy("list_no").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), *by_dim).select("list_no", "n", "cost", F.array(*(f"d{i}" for i in range(centroids.shape[1]))).alias("total"))


def split_empty(centroids, n) -> None:
    """Give each empty cluster half of a large one, both moved by 1/1024."""
    import numpy as np

    for i in np.flatnonzero(n == 0):
        j = int(np.argmax(n))
        sign = np.where(np.arange(centroids.shape[1]) % 2 == 0, 1 + 1 / 1024, 1 - 1 / 1024)
        centroids[i], centroids[j] = centroids[j] * sign, centroids[j] * (2 - sign)
        n[i] = n[j] / 2
        n[j] -= n[i]


def kmeans(base: DataFrame, p: KMeans, name: str = "l2", weights: DataFrame | None = None):
    """Centroids (a matrix) and the cost at each iteration of the best attempt."""
    import numpy as np

    best = None
    for attempt in range(p.redo):
        c, costs = initial(base, p, attempt), []
        for _ in range(0 if p.frozen else p.iterations):
            rows = sums(base, c, name, weights).collect()  # one for each centroid
            n = np.zeros(len(c))
            new = c.copy()
            for r in rows:
                n[r.list_no] = r.n
                new[r.list_no] = np.array(r.total) / r.n
            costs.append(sum(r.cost for r in rows))
            split_empty(new, n)
            if p.spherical:
                new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-30)
            if p.integral:
                new = np.rint(new)
            done = np.array_equal(new, c)
            c = new
            if done:
                break
        if best is None or (costs and costs[-1] < best[1][-1]):
            best = c, costs
    return best


def progressive_kmeans(base: DataFrame, p: KMeans, steps: int = 4):
    """k-means over more and more leading dimensions, each time from where the
    last one ended."""
    import numpy as np

    rows = base.toDF("id", "v")
    width = len(rows.first().v)
    c = None
    for s in range(1, steps + 1):
        d = max(1, width * s // steps)
        part = rows.select("id", F.slice("v", 1, d).alias("v"))
        start = initial(part, p)
        if c is not None:
            start[:, : c.shape[1]] = c[: len(start)]
        c = start
        for _ in range(p.iterations):
            found = sums(part, c).collect()
            n, new = np.zeros(len(c)), c.copy()
            for r in found:
                n[r.list_no], new[r.list_no] = r.n, np.array(r.total) / r.n
            split_empty(new, n)
            if np.array_equal(new, c):
                break
            c = new
    return c


def centroid_frame(spark, centroids) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "list_no int, centroid array<double>")


def lloyd_step(base: DataFrame, centroids: DataFrame) -> DataFrame:
    """New centroids ``(list_no, n, centroid)`` from a frame of old ones."""
    import numpy as np

    rows = sorted((r.list_no, r.centroid) for r in centroids.collect())
    out = sums(base, np.array([c for _, c in rows], float))
    return out.select("list_no", F.col("n").cast("long").alias("n"), F.transform("total", lambda x: x / F.col("n")).alias("centroid"))


def kmeans_1d(values, k: int):
    """The exact least-cost split of numbers into k ranges, by dynamic
    programming with divide and conquer over the monotone split points; returns
    the centres. The numbers are one machine's."""
    import numpy as np

    x = np.sort(np.asarray(values, float))
    n = len(x)
    s, s2 = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
    cost = lambda i, j: s2[j] - s2[i] - (s[j] - s[i]) ** 2 / max(1, j - i)  # noqa: E731  of x[i:j]
    k = min(k, n)
    best, cuts = np.array([cost(0, j) if j else 0 for j in range(n + 1)]), []
    for level in range(1, k):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        todo = [(level + 1, n, level, n - 1)]
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            mid = (low + high) // 2
            options = [(best[i] + cost(i, mid), i) for i in range(first, min(last, mid - 1) + 1)]
            new[mid], cut[mid] = min(options)
            todo += [(low, mid - 1, first, cut[mid]), (mid + 1, high, cut[mid], last)]
        best = new
        cuts.append(cut)
    ends = [n]
    for cut in reversed(cuts):
        ends.append(int(cut[ends[-1]]))
    ends = [0, *reversed(ends)] if ends[-1] else list(reversed(ends))
    return np.array([x[a:b].mean() for a, b in zip(ends, ends[1:])])


def two_level(base: DataFrame, k1: int, k2: int, iterations: int = 10) -> DataFrame:
    """``(first, second, centroid)``: k1 clusters, each split into k2. A cluster
    is dealt over sub-clusters by iterations of the same pass, not in one task."""
    import numpy as np

    top_centroids, _ = kmeans(base, KMeans(k1, iterations))
    rows = base.toDF("id", "v")
    from lodestar.operators.ivf import assign_lists

    lists = assign_lists(rows, centroid_frame(rows.sparkSession, top_centroids))
    out = []
    for i in range(len(top_centroids)):
        part = lists.where(F.col("list_no") == i).select("id", F.col("embedding").alias("v"))
        if part.isEmpty():
            continue
        c, _ = kmeans(part, KMeans(k2, iterations))
        out += [(i, j, [float(x) for x in v]) for j, v in enumerate(np.asarray(c))]
    return rows.sparkSession.createDataFrame(out, "first int, second int, centroid array<double>")


def balanced_assignment(base: DataFrame, centroids, rounds: int = 20, most: int = 4, power: float = 0.03) -> DataFrame:
    """``(id, list_no)`` with sizes evened out: each row chooses among its nearest
    centroids by squared distance plus a squared penalty, and penalties follow
    the sizes."""
    import numpy as np

    from lodestar.operators.knn import knn
    from lodestar.sources.shared import materialize

    rows = base.toDF("id", "v")
    spark = rows.sparkSession
    frame = centroid_frame(spark, centroids).select(F.col("list_no").cast("long").alias("id"), F.col("centroid").alias("embedding"))
    near = materialize(knn(rows.toDF("qid", "qv"), frame, min(most, len(centroids))), "near")
    n = rows.count()
    penalty, target = np.ones(len(centroids)), n / len(centroids)
    pick = lambda p: near.groupBy("qid").agg(F.min_by("id", F.struct(F.col("dist") + F.pow(F.get(F.array(*map(F.lit, map(float, p))), F.col("id").cast("int")), F.lit(2)), "id")).alias("list_no"))
    for _ in range(rounds):
        size = np.zeros(len(centroids))
        for r in pick(penalty).groupBy("list_no").count().collect():
            size[r.list_no] = r["count"]
        penalty *= (np.maximum(size, 1) / target) ** power
    return pick(penalty).select(F.col("qid").alias("id"), F.col("list_no").cast("int").alias("list_no"))


def imbalance(lists: DataFrame, list_no: str = "list_no") -> DataFrame:
    """k * sum(n^2) / (sum n)^2 over the lists in use."""
    n = lists.groupBy(list_no).agg(F.count(F.lit(1)).alias("n"))
    return n.agg((F.count(F.lit(1)) * F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("imbalance"))
