"""Exact searches that look at most vectors only in part.

Vectors are rotated so that their first dimensions hold most of their length, and
cut into levels. After each level a pair's squared distance is known up to what
the lengths of the rests allow: rows whose least possible distance lies beyond
the k-th of the largest possible ones are out. What is left after the last level
is ranked by the metric itself, so the result is that of a full search."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lodestar.functions.metrics import metric
from lodestar.operators import ivf
from lodestar.operators.blocks import tiles
from lodestar.operators.codecs import Linear, best_of_tile
from lodestar.operators.knn import HITS, top

#: Relative error that the bounds allow for.
SLACK = 1e-9


def candidates(q, b, k: int, levels: int, rotation: Linear | None = None):
    """A mask of the pairs that may be among the k nearest, and how many
    components of the base were looked at."""
    import numpy as np

    x, y = (rotation(q), rotation(b)) if rotation else (q, b)
    edges = [x.shape[1] * i // levels for i in range(levels + 1)]
    rest = lambda m: np.sqrt(np.maximum(np.concatenate([np.cumsum((m * m)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(m), 1))], axis=1), 0))
    rx, ry = rest(x), rest(y)
    length = (rx[:, 0] ** 2)[:, None] + ry[:, 0] ** 2
    alive, dot, looked = np.ones((len(x), len(y)), bool), np.zeros((len(x), len(y))), 0
    for low, high in zip(edges, edges[1:]):
        rows = np.flatnonzero(alive.any(axis=0))
        looked += int(alive.sum()) * (high - low)
        dot[:, rows] += x[:, low:high] @ y[rows, low:high].T
        spread = 2 * rx[:, high][:, None] * ry[rows, high]
        middle = length[:, rows] - 2 * dot[:, rows]
        margin = SLACK * (length[:, rows] + 1)
        most = np.where(alive[:, rows], middle + spread + margin, np.inf)
        if len(rows) > k:
            limit = np.partition(most, k - 1, axis=1)[:, k - 1 : k]
            alive[:, rows] &= middle - spread - margin <= limit
    return alive, looked


def _kernel(k: int, levels: int, rotation: Linear | None):
    def run(qids, q, ids, b):
        import numpy as np

        alive, _ = candidates(q, b, k, levels, rotation)
        rows = np.flatnonzero(alive.any(axis=0))
        d = np.where(alive[:, rows], metric("l2").tile(q, b[rows]), np.inf)
        out = best_of_tile(qids, ids[rows], d, k, False)
        sound = out["dist"] < np.inf
        return {c: x[sound] for c, x in out.items()}

    return run


def search(queries: DataFrame, base: DataFrame, k: int, levels: int = 8, rotation: Linear | None = None) -> DataFrame:
    """The k nearest rows by L2."""
    return top(tiles(queries, base, _kernel(k, levels, rotation), HITS), k)


def list_search(queries: DataFrame, chosen: DataFrame, lists: DataFrame, k: int, levels: int = 8, rotation: Linear | None = None) -> DataFrame:
    """The k nearest rows by L2 among the lists chosen for each query."""
    kernel = _kernel(k, levels, rotation)
    return top(ivf.list_tiles(queries, chosen, ivf.list_blocks(lists), lambda qids, q, ids, b, list_no: kernel(qids, q, ids, b), HITS), k)


def looked_at(queries: DataFrame, base: DataFrame, k: int, levels: int = 8, rotation: Linear | None = None) -> DataFrame:
    """How many components of how many were looked at: ``looked, all``."""
    from pyspark.sql import functions as F

    def kernel(qids, q, ids, b):
        return {"looked": [candidates(q, b, k, levels, rotation)[1]], "every": [len(q) * b.size]}

    return tiles(queries, base, kernel, "looked long, every long").agg(F.sum("looked").alias("looked"), F.sum("every").alias("every"))
