"""Additive codes of slices, and codes of two stages.

A product additive quantizer cuts vectors into slices and keeps each slice as a
sum of book rows. Inner products of a query with a code are sums over tables, one
for each book; the squared length of what a code stands for is kept with it, so
squared distances need no decoding. A two-stage code has a second product code of
what the first one loses: a scan ranks by the first, and only what it shortlists
in a tile is ranked again by both."""

from __future__ import annotations

from dataclasses import dataclass, field

from lodestar.functions.metrics import metric
from lodestar.operators.codecs import ProductQuantizer, ResidualQuantizer, RowCodec, pack_rows, unpack_rows


@dataclass
class ProductAdditive(RowCodec):
    """Slices of the dimensions, each with an additive quantizer. A code has the
    book rows of all slices and, last, the squared length of their sum."""

    parts: list

    def __post_init__(self):
        self.bits = max(p.bits for p in self.parts)

    @staticmethod
    def train_on(v, slices: int, m: int, bits: int = 8, local_search: bool = False) -> ProductAdditive:
        """``slices`` of equal width with ``m`` books each; with ``local_search``
        the books of a slice are solved for at once and codes are improved one
        place at a time."""
        import numpy as np

        if v.shape[1] % slices:
            raise ValueError("slices have equal widths")
        train = ResidualQuantizer.train_local_search if local_search else ResidualQuantizer.train_on
        return ProductAdditive([train(x, m, bits) for x in np.split(v, slices, axis=1)])

    @property
    def width(self) -> int:
        return sum(len(p.books) for p in self.parts) + 1

    def _split(self, v):
        import numpy as np

        return np.split(v, len(self.parts), axis=1)

    def _places(self):
        """Each part with its columns of a code."""
        at = 0
        for p in self.parts:
            yield p, slice(at, at + len(p.books))
            at += len(p.books)

    def encode(self, v):
        import numpy as np

        codes = np.concatenate([p.encode(x) for p, x in zip(self.parts, self._split(v))], axis=1)
        kept = self.decode(np.column_stack([codes, np.zeros(len(codes))]))
        return np.column_stack([codes, (kept * kept).sum(1).astype(np.float32)]).astype(float)

    def decode(self, codes):
        import numpy as np

        return np.concatenate([p.decode(codes[:, c].astype(np.int64)) for p, c in self._places()], axis=1)

    def products(self, q, codes):
        """Inner products of queries with codes, by one table for each book."""
        import numpy as np

        out = np.zeros((len(q), len(codes)), np.float32)
        for (p, c), x in zip(self._places(), self._split(q)):
            for book, column in zip(p.books, codes[:, c].astype(np.int64).T):
                out += (x @ book.T).astype(np.float32)[:, column]
        return out

    def distances(self, q, codes, name: str = "l2"):
        if name not in ("l2", "ip"):
            return metric(name).tile(q, self.decode(codes))
        ip = self.products(q, codes).astype(float)
        return ip if name == "ip" else (q * q).sum(1)[:, None] + codes[:, -1] - 2 * ip

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


@dataclass
class TwoStage(RowCodec):
    """A product code and a second one of what it loses. ``keep`` rows of a tile
    are ranked by both for each query; the others' distances aren't numbers."""

    first: ProductQuantizer
    second: ProductQuantizer
    keep: int = 40
    bits: int | None = field(init=False)

    def __post_init__(self):
        self.bits = max(self.first.bits, self.second.bits)

    @staticmethod
    def train_on(v, m: int, m_refine: int, bits: int = 8) -> TwoStage:
        first = ProductQuantizer.train_on(v, m, bits)
        return TwoStage(first, ProductQuantizer.train_on(v - first.decode(first.encode(v)), m_refine, bits))

    @property
    def width(self) -> int:
        return len(self.first.books) + len(self.second.books)

    def _both(self, codes):
        m = len(self.first.books)
        return codes[:, :m], codes[:, m:]

    def encode(self, v):
        import numpy as np

        codes = self.first.encode(v)
        return np.concatenate([codes, self.second.encode(v - self.first.decode(codes))], axis=1)

    def decode(self, codes):
        a, b = self._both(codes)
        return self.first.decode(a) + self.second.decode(b)

    def distances(self, q, codes, name: str = "l2"):
        import numpy as np

        a, _ = self._both(codes)
        d = self.first.distances(q, a, name)
        larger, n = metric(name).larger_is_better, min(self.keep, len(codes))
        best = np.argpartition(-d if larger else d, n - 1, axis=1)[:, :n] if n < len(codes) else np.broadcast_to(np.arange(n), d.shape)
        out = np.full(d.shape, np.nan)
        if name in ("l2", "ip"):
            some = np.unique(best)
            v = self.decode(codes[some])[np.searchsorted(some, best)]
            exact = np.einsum("qd,qnd->qn", q, v) if name == "ip" else ((q[:, None, :] - v) ** 2).sum(2)
        else:
            exact = np.stack([metric(name).tile(q[i : i + 1], self.decode(codes[b]))[0] for i, b in enumerate(best)])
        np.put_along_axis(out, np.ascontiguousarray(best), exact, 1)
        return out
