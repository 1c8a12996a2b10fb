"""Distances and similarities between vectors.

Each metric has a column form, a composition of built-in functions over two
array columns for row-wise use, and a tile form, NumPy over two matrices for
searches. Both accumulate in double. A metric that can have no value gives NaN,
which sorts last. L2 and Lp stay without their roots; ``ip`` and ``jaccard`` are
similarities, of which more is better."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
#: Elements of the largest intermediate of a tile without a matrix product.
TILE = 1 << 22


def fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _sum(x: Column, y: Column, f: Callable[[Column, Column], Column]) -> Column:
    return fold(F.zip_with(x, y, lambda a, b: f(a.cast("double"), b.cast("double"))))


def ratio(a: Column, b: Column) -> Column:
    """IEEE division, where SQL would fail or give null."""
    return F.when(b != 0, a / F.when(b != 0, b)).when(a == 0, F.lit(NAN)).otherwise(F.signum(a) * float("inf"))


def _js(a: Column, b: Column) -> Column:
    m = (a + b) / 2
    return -a * F.log(ratio(m, a)) - b * F.log(ratio(m, b))


def _nan_l2(x: Column, y: Column) -> Column:
    both = F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
    total = F.aggregate(both, F.lit(0.0), lambda a, p: a + (p["x"].cast("double") - p["y"].cast("double")) * (p["x"].cast("double") - p["y"].cast("double")))
    return F.when(F.size(both) == 0, F.lit(NAN)).otherwise(F.size(x) / F.greatest(F.size(both), F.lit(1)) * total)


def _gower(x: Column, y: Column) -> Column:
    def term(a, b):
        apart = F.abs(a - b)
        return (F.when(F.isnan(a) | F.isnan(b), F.lit(None).cast("double"))
                .when((a >= 0) & (b >= 0), F.when(apart <= 1, apart).otherwise(F.lit(NAN)))
                .when((a < 0) & (b < 0), (a != b).cast("double")).otherwise(F.lit(NAN)))

    terms = F.filter(F.zip_with(x, y, lambda a, b: term(a.cast("double"), b.cast("double"))), lambda t: t.isNotNull())
    return F.when(F.size(terms) == 0, F.lit(NAN)).otherwise(fold(terms) / F.greatest(F.size(terms), F.lit(1)))


def norm(x: Column) -> Column:
    return F.sqrt(_sum(x, x, lambda a, b: a * b))


def _cosine(x: Column, y: Column) -> Column:
    lengths = norm(x) * norm(y)
    return 1 - F.when(lengths > 0, _sum(x, y, lambda a, b: a * b) / F.when(lengths > 0, lengths)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Metric:
    name: str
    column: Callable[..., Column]
    tile: Callable
    larger_is_better: bool = False


def _by_element(f: Callable) -> Callable:
    """A tile by broadcasting over chunks of queries; f reduces the last axis."""

    def tile(x, y, p=None):
        import numpy as np

        out = np.empty((len(x), len(y)))
        step = max(1, TILE // max(1, y.size))
        with np.errstate(all="ignore"):
            for i in range(0, len(x), step):
                out[i : i + step] = f(x[i : i + step, None, :], y[None, :, :], p)
        return out

    return tile


def _tile_l2(x, y, p=None):
    import numpy as np

    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T), 0)


def _tile_cosine(x, y, p=None):
    import numpy as np

    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1)
    return 1 - unit(x) @ unit(y).T


def _tile_js(x, y, p):
    import numpy as np

    m = (x + y) / 2
    return 0.5 * (-x * np.log(m / x) - y * np.log(m / y)).sum(-1)


def _tile_nan_l2(x, y, p):
    import numpy as np

    d = x - y
    n = (~np.isnan(d)).sum(-1)
    return np.where(n > 0, d.shape[-1] / np.maximum(n, 1) * np.nansum(d * d, -1), NAN)


def _tile_gower(x, y, p):
    import numpy as np

    d, missing = np.abs(x - y), np.isnan(x) | np.isnan(y)
    term = np.where((x >= 0) & (y >= 0), np.where(d <= 1, d, NAN), np.where((x < 0) & (y < 0), (x != y) * 1.0, NAN))
    n = (~missing).sum(-1)
    return np.where(n > 0, np.where(missing, 0, term).sum(-1) / np.maximum(n, 1), NAN)


def _np(name):
    import numpy as np

    return getattr(np, name)


METRICS = {m.name: m for m in (
    Metric("l2", lambda x, y, p=None: _sum(x, y, lambda a, b: (a - b) * (a - b)), _tile_l2),
    Metric("ip", lambda x, y, p=None: _sum(x, y, lambda a, b: a * b), lambda x, y, p=None: x @ y.T, True),
    Metric("ip_distance", lambda x, y, p=None: 1 - _sum(x, y, lambda a, b: a * b), lambda x, y, p=None: 1 - x @ y.T),
    Metric("cosine", lambda x, y, p=None: _cosine(x, y), _tile_cosine),
    Metric("l1", lambda x, y, p=None: _sum(x, y, lambda a, b: F.abs(a - b)), _by_element(lambda x, y, p: abs(x - y).sum(-1))),
    Metric("linf", lambda x, y, p=None: F.array_max(F.zip_with(x, y, lambda a, b: F.abs(a.cast("double") - b.cast("double")))), _by_element(lambda x, y, p: abs(x - y).max(-1))),
    Metric("lp", lambda x, y, p=None: _sum(x, y, lambda a, b: F.pow(F.abs(a - b), F.lit(float(p)))), _by_element(lambda x, y, p: (abs(x - y) ** p).sum(-1))),
    Metric("canberra", lambda x, y, p=None: _sum(x, y, lambda a, b: ratio(F.abs(a - b), F.abs(a) + F.abs(b))), _by_element(lambda x, y, p: (abs(x - y) / (abs(x) + abs(y))).sum(-1))),
    Metric("braycurtis", lambda x, y, p=None: ratio(_sum(x, y, lambda a, b: F.abs(a - b)), _sum(x, y, lambda a, b: F.abs(a + b))), _by_element(lambda x, y, p: abs(x - y).sum(-1) / abs(x + y).sum(-1))),
    Metric("jensenshannon", lambda x, y, p=None: _sum(x, y, _js) / 2, _by_element(_tile_js)),
    Metric("jaccard", lambda x, y, p=None: ratio(_sum(x, y, F.least), _sum(x, y, F.greatest)), _by_element(lambda x, y, p: _np("minimum")(x, y).sum(-1) / _np("maximum")(x, y).sum(-1)), True),
    Metric("nan_euclidean", lambda x, y, p=None: _nan_l2(x, y), _by_element(_tile_nan_l2)),
    Metric("gower", lambda x, y, p=None: _gower(x, y), _by_element(_tile_gower)),
)}


def metric(name: str | Metric) -> Metric:
    """A metric by name; a Metric of the caller's own passes through."""
    if isinstance(name, Metric):
        return name
    if name not in METRICS:
        raise ValueError(f"no metric {name!r}; there are {', '.join(METRICS)}")
    return METRICS[name]


def distance(name: str, x: Column, y: Column, p: float | None = None) -> Column:
    return metric(name).column(x, y, p)


def hamming(x: Column, y: Column) -> Column:
    """Differing bits of two arrays of integer words."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, v: s + v)


def generalized_hamming(x: Column, y: Column) -> Column:
    """Differing elements (bytes) of two arrays."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a != b).cast("int")), F.lit(0), lambda s, v: s + v)


def l2_from_ip(x_norm2: Column, y_norm2: Column, ip: Column) -> Column:
    return x_norm2 + y_norm2 - 2 * ip


def external_distance(raw: Column, similarity: bool) -> Column:
    """What a graph keeps, negated similarities or distances, as a distance."""
    return 1 + raw if similarity else raw


#: Tokens of dataset names that fix the space; the first row that matches holds. Fixed values.
SPACE_TOKENS = (
    ("ip", ("msmarco", "msmacro", "-ip", "_ip", "dot", "text2image")),
    ("cosine", ("angular", "cosine", "coco", "nytimes", "deep", "glove", "openai")),
    ("l2", ("euclidean", "l2", "sift", "gist", "mnist", "learn")),
)


def space_of(dataset: str) -> str:
    """The space that a dataset's name tells, l2 by default. Names of
    text-to-image sets count as inner product unless they are of coco."""
    name = dataset.lower()
    if any(t in name for t in SPACE_TOKENS[0][1]) or ("t2i" in name and "coco" not in name):
        return "ip"
    return next((space for space, tokens in SPACE_TOKENS[1:] if any(t in name for t in tokens)), "l2")


