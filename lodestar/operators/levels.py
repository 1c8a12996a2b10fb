"""Codes whose levels or thresholds no component is trained for: levels that are
best for the components of random unit vectors, codes of no bits at all, and signs
of waves along projections, with thresholds by list."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from lodestar.functions.metrics import metric
from lodestar.operators.codecs import Linear, RowCodec, pack_rows, unpack_rows


@functools.lru_cache(maxsize=32)
def best_levels(d: int, bits: int, points: int = 200_001, rounds: int = 300):
    """The ``2 ** bits`` levels and the boundaries between them that lose least,
    in the mean square, of a component of a random unit vector of d dimensions: its
    density is proportional to (1 - x^2) ^ ((d - 3) / 2). Levels and boundaries are
    improved by turns on a grid, from levels dealt by the cube root of the density."""
    import numpy as np

    x = np.linspace(-1, 1, points)[1:-1]
    log = (d - 3) / 2 * np.log1p(-x * x)
    mass = np.exp(log - log.max())
    spread = np.cumsum(np.cbrt(mass))
    n = 1 << bits
    levels = x[np.searchsorted(spread, (np.arange(n) + 0.5) / n * spread[-1])]
    total, moment = (np.concatenate([[0], np.cumsum(m)]) for m in (mass, mass * x))
    for _ in range(rounds):
        cut = np.concatenate([[0], np.searchsorted(x, (levels[1:] + levels[:-1]) / 2), [len(x)]])
        weight = np.diff(total[cut])
        new = np.where(weight > 0, np.diff(moment[cut]) / np.where(weight > 0, weight, 1), levels)
        if np.abs(new - levels).max() < 1e-12:
            break
        levels = new
    levels = (levels - levels[::-1]) / 2  # as the density is, the same on both sides
    return levels, (levels[1:] + levels[:-1]) / 2


@dataclass
class FixedLevels(RowCodec):
    """Components of a vector's direction, as one of ``best_levels``, and its
    length. Without a rotation the vectors should have been rotated before, as
    levels are those of directions that no dimension is special for."""

    d: int
    bits: int = 4
    rotation: Linear | None = None

    def _parts(self, v):
        import numpy as np

        x = self.rotation(v) if self.rotation else v
        length = np.sqrt((x * x).sum(1))
        return x / np.where(length > 0, length, 1)[:, None], length

    def encode(self, v):
        import numpy as np

        unit, length = self._parts(v)
        return np.column_stack([np.searchsorted(best_levels(self.d, self.bits)[1], unit), length.astype(np.float32)]).astype(float)

    def decode(self, codes):
        import numpy as np

        x = best_levels(self.d, self.bits)[0][codes[:, :-1].astype(np.int64)] * codes[:, -1:]
        return self.rotation.back(x) if self.rotation else x

    def from_doubles(self, codes):
        return codes

    def row_bytes(self, codes) -> list[bytes]:
        import numpy as np

        rows, lengths = pack_rows(codes[:, :-1].astype(np.int64), self.bits), np.ascontiguousarray(codes[:, -1:], "<f4")
        return [a.tobytes() + b.tobytes() for a, b in zip(rows, lengths)]

    def from_bytes(self, raw: bytes, n: int, width: int):
        import numpy as np

        rows = np.frombuffer(raw, np.uint8).reshape(n, -1)
        whole = unpack_rows(np.ascontiguousarray(rows[:, :-4]).tobytes(), n, width - 1, self.bits)
        return np.column_stack([whole, np.ascontiguousarray(rows[:, -4:]).view("<f4").astype(float)])

    @property
    def width(self) -> int:
        return self.d + 1


@dataclass
class ZeroBits(RowCodec):
    """No bits: a row is its list's centroid, and ranks by that alone."""

    d: int
    bits: int | None = 8
    width: int = 0

    def encode(self, v):
        import numpy as np

        return np.zeros((len(v), 0), np.int64)

    def decode(self, codes):
        import numpy as np

        return np.zeros((len(codes), self.d))

    def distances(self, q, codes, name: str = "l2"):
        import numpy as np

        one = metric(name).tile(q, np.zeros((1, q.shape[1])))
        return np.repeat(one, len(codes), axis=1)

    def row_bytes(self, codes) -> list[bytes]:
        return [b""] * len(codes)

    def from_bytes(self, raw: bytes, n: int, width: int):
        import numpy as np

        return np.zeros((n, 0), np.int64)


@dataclass
class SpectralHash(RowCodec):
    """A bit for each projection: whether the projection, less a threshold, lies in
    an even or an odd half of its period. Codes are compared with the query's, by
    the thresholds of the list that is scanned, in how many bits they differ."""

    project: object
    period: float
    #: Thresholds by list and projection; None: 0 everywhere.
    thresholds: object = None
    bits: int | None = 1
    by_list: bool = True

    @staticmethod
    def train_on(v, where, centroids, project, period: float, kind: str = "g") -> SpectralHash:
        """``kind``: thresholds are 0 (g), the list's centroid (c), a quarter of a
        period below it (h), or the medians of the list's rows (m)."""
        import numpy as np

        t = None
        if kind in ("c", "h"):
            t = project(centroids) - (period / 4 if kind == "h" else 0)
        elif kind == "m":
            x = project(v)
            t = np.stack([np.median(x[where == i], axis=0) if (where == i).any() else np.zeros(x.shape[1]) for i in range(len(centroids))])
        return SpectralHash(project, period, t)

    def encode_in(self, v, where):
        """Bits of rows by the thresholds of their lists."""
        import numpy as np

        x = self.project(v)
        if self.thresholds is not None:
            x = x - np.asarray(self.thresholds)[where]
        return np.floor(x * (2 / self.period)).astype(np.int64) & 1

    def distances_in(self, q, codes, list_no: int):
        import numpy as np

        x, y = self.encode_in(q, np.full(len(q), list_no)).astype(float), codes.astype(float)
        return x.sum(1)[:, None] + y.sum(1) - 2 * (x @ y.T)

    def larger_is_better(self, name: str) -> bool:
        return False
