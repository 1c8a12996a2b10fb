"""Vector transforms and codecs. Training uses a bounded sample, or statistics
of all rows where these are sums; applying is a column expression where
built-ins can say it, else an Arrow map over blocks of rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.metrics import metric
from lodestar.operators.knn import pair_distances, top

#: Rows on which a codec is trained at most, and bytes of their components.
TRAIN_ROWS, TRAIN_BYTES = 65536, 256 << 20


def sample(base: DataFrame, n: int = TRAIN_ROWS, seed: int = 42):
    """A matrix of the n rows of least hash, fewer where they are wide: at most
    ``TRAIN_BYTES`` of 32-bit components go to the driver."""
    import numpy as np

    rows = base.toDF("id", "v").where("v is not null")
    first = rows.select(F.size("v")).first()
    n = max(1, min(n, TRAIN_BYTES // (4 * max(1, first[0])))) if first else n
    found = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n).select(F.col("v").cast("array<float>" if rows.schema["v"].dataType.elementType.simpleString() == "float" else "array<double>").alias("v")).toArrow()
    if not found.num_rows:
        return np.zeros((0, 0))
    return found.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(found.num_rows, -1)


def mapped(base: DataFrame, f: Callable, kind: str = "array<double>") -> DataFrame:
    """``(id, embedding)`` through a function of a matrix that returns a list of
    rows."""
    rows = base.toDF("id", "embedding").where("embedding is not null")
    schema = rows.select("id", F.lit(None).cast(kind).alias("embedding")).schema

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            if batch.num_rows:
                v = np.stack([x.values.to_numpy(zero_copy_only=False) for x in batch.column(1)]).astype(float)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(f(v)), arrow.field("embedding").type)], schema=arrow)

    return rows.mapInArrow(run, schema)


@dataclass
class Linear:
    """x -> A x + b; ``back`` applies the transpose, or the pseudo-inverse where
    A isn't orthonormal."""

    a: object
    b: object = None
    orthonormal: bool = True

    def __call__(self, v):
        out = v @ self.a.T
        return out if self.b is None else out + self.b

    def back(self, v):
        import numpy as np

        v = v if self.b is None else v - self.b
        return v @ self.a if self.orthonormal else v @ np.linalg.pinv(self.a).T


def random_rotation(d_in: int, d_out: int, seed: int = 1234) -> Linear:
    import numpy as np

    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(max(d_in, d_out), max(d_in, d_out))))
    return Linear((q * np.sign(np.diag(r)))[:d_out, :d_in])


def hadamard_rotation(d: int, seed: int = 1234) -> Callable:
    """Three rounds of random signs and a fast Walsh-Hadamard transform, over
    the next power of two."""
    import numpy as np

    n = 1 << max(0, d - 1).bit_length()
    signs = np.where(np.random.default_rng(seed).random((3, n)) < 0.5, -1.0, 1.0)

    def f(v):
        x = np.zeros((len(v), n))
        x[:, :d] = v
        for s in signs:
            x = x * s
            h = 1
            while h < n:
                y = x.reshape(len(x), -1, 2, h)
                x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
                h *= 2
            x /= np.sqrt(n)
        return x

    return f


def pca(base: DataFrame, d_out: int, whiten: float = 0.0, rotate: bool = False, seed: int = 1234) -> Linear:
    """Principal components of all rows: sums and products are added up in one
    pass. ``whiten`` is the power of the eigenvalues that scales them (-0.5)."""
    import numpy as np

    def part(batches):
        import pyarrow as pa

        n, s, p = 0, 0.0, 0.0
        for batch in batches:
            if batch.num_rows:
                v = np.stack([x.values.to_numpy(zero_copy_only=False) for x in batch.column(0)]).astype(float)
                n, s, p = n + len(v), s + v.sum(0), p + v.T @ v
        if n:
            yield pa.RecordBatch.from_pydict({"one": [1], "n": [n], "s": [s.tolist()], "p": [p.ravel().tolist()]}, pa.schema([("one", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.float64())), ("p", pa.list_(pa.float64()))]))

    rows = base.toDF("id", "v").where("v is not null").select("v")
    parts = rows.mapInArrow(part, "one int, n long, s array<double>, p array<double>")
    flat = parts.select("n", F.posexplode(F.concat("s", "p")).alias("i", "x")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()  # d + d * d sums
    total, n = np.array([r.x for r in sorted(flat)]), flat[0].n
    d = int((np.sqrt(4 * len(total) + 1) - 1) / 2)
    mean = total[:d] / n
    values, vectors = np.linalg.eigh(total[d:].reshape(d, d) / n - np.outer(mean, mean))
    order = np.argsort(-values)[:d_out]
    a = vectors[:, order].T
    a *= np.sign(a[np.arange(len(a)), np.argmax(np.abs(a), axis=1)])[:, None]
    if whiten:
        a = a * np.maximum(values[order], 1e-12)[:, None] ** whiten
    if rotate:
        a = random_rotation(len(a), len(a), seed).a @ a
    return Linear(a, -a @ mean, not whiten)


def itq(base: DataFrame, d_out: int, iterations: int = 50, seed: int = 1234) -> Linear:
    """A rotation of the principal components whose signs lose least."""
    import numpy as np

    first = pca(base, d_out)
    v = first(sample(base))
    r = random_rotation(d_out, d_out, seed).a
    for _ in range(iterations):
        u, _, w = np.linalg.svd(np.where(v @ r.T > 0, 1.0, -1.0).T @ v)
        r = u @ w
    return Linear(r @ first.a, r @ first.b)


def opq(base: DataFrame, m: int, bits: int = 8, iterations: int = 10, seed: int = 1234) -> Linear:
    """A rotation under which a product quantizer loses less, by turns of
    training the quantizer and solving for the rotation."""
    import numpy as np

    v = sample(base)
    r = random_rotation(v.shape[1], v.shape[1], seed).a
    for _ in range(iterations):
        x = v @ r.T
        q = ProductQuantizer.train_on(x, m, bits, 4, seed)
        u, _, w = np.linalg.svd(q.decode(q.encode(x)).T @ v)
        r = u @ w
    return Linear(r)


# --- codecs of rows ---

class RowCodec:
    """A codec of the rows of a matrix: ``encode`` gives a matrix of codes,
    ``decode`` what they keep, ``row_bytes`` and ``from_bytes`` store a code in as
    few bytes as it needs, and ``distances`` compares queries with codes."""

    #: Bits of an element of a code; None: elements are doubles.
    bits: int | None = None

    def encode(self, v):
        return v

    def decode(self, codes):
        return codes

    def distances(self, q, codes, name: str = "l2"):
        return metric(name).tile(q, self.decode(codes))

    def larger_is_better(self, name: str) -> bool:
        return metric(name).larger_is_better

    def from_doubles(self, codes):
        """Codes that travelled as doubles."""
        return codes if self.bits is None else codes.astype(int)

    def row_bytes(self, codes) -> list[bytes]:
        import numpy as np

        if self.bits is None:
            return [x.tobytes() for x in np.ascontiguousarray(codes, "<f8")]
        return [x.tobytes() for x in pack_rows(codes, self.bits)]

    def from_bytes(self, raw: bytes, n: int, width: int):
        """The codes of n rows, ``width`` elements each."""
        import numpy as np

        return np.frombuffer(raw, "<f8").reshape(n, -1) if self.bits is None else unpack_rows(raw, n, width, self.bits)


def pack_rows(codes, bits: int):
    """Rows of whole numbers below 2^bits as rows of bytes."""
    import numpy as np

    c = np.asarray(codes)
    if bits in (8, 16, 32):
        return c.astype(f"<u{bits // 8}").view(np.uint8).reshape(len(c), -1)
    planes = (c.astype(np.uint32)[:, :, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).reshape(len(c), -1), axis=1, bitorder="little")


def unpack_rows(raw: bytes, n: int, width: int, bits: int):
    import numpy as np

    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}").reshape(n, width).astype(np.int64)
    if bits == 4 and not width % 2:
        rows = np.frombuffer(raw, np.uint8).reshape(n, -1)
        return np.stack([rows & 15, rows >> 4], axis=2).reshape(n, width).astype(np.int64)
    rows = np.frombuffer(raw, np.uint8).reshape(n, -1)
    planes = np.unpackbits(rows, axis=1, count=width * bits, bitorder="little").reshape(n, width, bits)
    return (planes.astype(np.int64) << np.arange(bits)).sum(axis=2)


@dataclass
class Half(RowCodec):
    """Components as fp16 or bf16 keep them."""

    kind: str
    bits: int | None = 16

    def encode(self, v):
        import numpy as np

        if self.kind == "fp16":
            return v.astype("<f2").view("<u2").astype(np.int64)
        raw = v.astype(np.float32).view(np.uint32).astype(np.int64)
        return (raw + 0x7FFF + ((raw >> 16) & 1)) >> 16

    def decode(self, codes):
        import numpy as np

        if self.kind == "fp16":
            return codes.astype("<u2").view("<f2").astype(float)
        return (codes.astype(np.uint32) << np.uint32(16)).view(np.float32).astype(float)


# --- scalar quantizers ---

@dataclass(frozen=True)
class ScalarQuantizer:
    """Levels of each dimension (or of all, if uniform) between the least and
    most of all rows, widened by ``widen`` of the range on both sides."""

    low: list
    step: list
    bits: int

    def encode(self, v: Column) -> Column:
        at = F.zip_with(F.zip_with(v, F.array(*map(F.lit, self.low)), lambda x, a: x.cast("double") - a), F.array(*map(F.lit, self.step)), lambda x, s: F.when(s > 0, F.floor(x / F.when(s > 0, s))).otherwise(0))
        return F.transform(at, lambda x: F.least(F.greatest(x, F.lit(0)), F.lit((1 << self.bits) - 1)).cast("int"))

    def rows(self) -> ScalarRows:
        return ScalarRows(self)

    def decode(self, codes: Column) -> Column:
        mid = F.zip_with(codes, F.array(*map(F.lit, self.step)), lambda c, s: (c + 0.5) * s)
        return F.zip_with(mid, F.array(*map(F.lit, self.low)), lambda x, a: x + a)


class ScalarRows(RowCodec):
    """The same quantizer over matrices."""

    def __init__(self, of: ScalarQuantizer):
        self.of, self.bits = of, of.bits

    def encode(self, v):
        import numpy as np

        step = np.array(self.of.step)
        return np.clip(np.where(step > 0, np.floor((v - np.array(self.of.low)) / np.where(step > 0, step, 1)), 0), 0, (1 << self.bits) - 1).astype(np.int64)

    def decode(self, codes):
        import numpy as np

        return (codes + 0.5) * np.array(self.of.step) + np.array(self.of.low)

    @staticmethod
    def train_on(v, bits: int, widen: float = 0.0) -> ScalarRows:
        a, b = v.min(axis=0), v.max(axis=0)
        a, b = a - (b - a) * widen, b + (b - a) * widen
        return ScalarRows(ScalarQuantizer(a.tolist(), ((b - a) / (1 << bits)).tolist(), bits))


def scalar_quantizer(base: DataFrame, bits: int = 8, uniform: bool = False, widen: float = 0.0) -> ScalarQuantizer:
    dims = base.toDF("id", "v").select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.min(F.col("x").cast("double")).alias("a"), F.max(F.col("x").cast("double")).alias("b"))
    rows = sorted((r.dim, r.a, r.b) for r in dims.collect())
    if uniform:
        a, b = min(r[1] for r in rows), max(r[2] for r in rows)
        rows = [(i, a, b) for i, _, _ in rows]
    wide = [(a - (b - a) * widen, b + (b - a) * widen) for _, a, b in rows]
    return ScalarQuantizer([a for a, _ in wide], [(b - a) / (1 << bits) for a, b in wide], bits)


def rounded(base: DataFrame, kind: str) -> DataFrame:
    """Components as fp16 or bf16 would keep them."""
    half = Half(kind)
    return mapped(base, lambda v: half.decode(half.encode(v)))


def row_min_max(v: Column, bits: int = 8) -> Column:
    """Levels between the row's own least and most, kept with them."""
    low, high = F.array_min(v).cast("double"), F.array_max(v).cast("double")
    step = (high - low) / ((1 << bits) - 1)
    codes = F.transform(v, lambda x: F.when(step > 0, F.rint((x - low) / F.when(step > 0, step))).otherwise(0.0).cast("int"))
    return F.struct(low.alias("low"), step.alias("step"), codes.alias("codes"))


def row_min_max_decode(code: Column) -> Column:
    return F.transform(code["codes"], lambda c: code["low"] + c * code["step"])


# --- product and residual quantizers ---

def nearest_codes(v, book):
    """The number of the row of ``book`` nearest to each row of ``v``, without the
    part of the distances that all share."""
    import numpy as np

    half = (book * book).sum(1) / 2
    return np.concatenate([np.zeros(0, np.int64), *(np.argmax(v[i : i + 8192] @ book.T - half, axis=1) for i in range(0, len(v), 8192))])


def lloyd(v, k: int, iterations: int, seed: int):
    """k centroids of a matrix."""
    import numpy as np

    random = np.random.default_rng(seed)
    k = min(k, len(v))
    c, x = v[random.choice(len(v), k, replace=False)].astype(float), v.astype(np.float32)
    for _ in range(iterations):
        a = nearest_codes(x, c.astype(np.float32))
        n = np.bincount(a, minlength=k)
        total = np.stack([np.bincount(a, weights=column, minlength=k) for column in v.T], axis=1)
        new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        if np.array_equal(new, c):
            break
        c = new
    return c


@dataclass
class ProductQuantizer(RowCodec):
    """``m`` slices of the dimensions with a codebook each."""

    books: list

    def __post_init__(self):
        self.bits = _bits_of(self.books)

    def distances(self, q, codes, name: str = "l2"):
        """By the tables of each query: what a scan adds up."""
        if name not in ("l2", "ip"):
            return metric(name).tile(q, self.decode(codes))
        import numpy as np

        tables, columns = self.table(q, name), np.ascontiguousarray(codes.T.astype(np.intp))
        out = np.empty((len(q), len(codes)))
        for at in range(0, len(q), 16):  # a few queries at a time, so that their sums stay in cache
            part = out[at : at + 16]
            np.take(tables[0][at : at + 16], columns[0], axis=1, out=part, mode="clip")
            for t, c in zip(tables[1:], columns[1:]):
                part += np.take(t[at : at + 16], c, axis=1, mode="clip")
        return out

    @staticmethod
    def train_on(v, m: int, bits: int = 8, iterations: int = 25, seed: int = 1234) -> ProductQuantizer:
        import numpy as np

        if v.shape[1] % m:
            raise ValueError("slices have equal widths")
        return ProductQuantizer([lloyd(x, 1 << bits, iterations, seed + i) for i, x in enumerate(np.split(v, m, axis=1))])

    @staticmethod
    def train(base: DataFrame, m: int, bits: int = 8, iterations: int = 25) -> ProductQuantizer:
        return ProductQuantizer.train_on(sample(base), m, bits, iterations)

    def slices(self, v):
        import numpy as np

        return np.split(v, len(self.books), axis=1)

    def encode(self, v):
        import numpy as np

        return np.stack([nearest_codes(x, b) for x, b in zip(self.slices(v), self.books)], axis=1)

    def decode(self, codes):
        import numpy as np

        return np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1)

    def table(self, q, name: str = "l2"):
        """Distances of each query slice to its codebook: what a scan adds up."""
        return [metric(name).tile(x, b) for x, b in zip(self.slices(q), self.books)]

    def between_codes(self):
        """Distances among each book's centroids, for symmetric comparison."""
        return [metric("l2").tile(b, b) for b in self.books]


def _bits_of(books) -> int:
    """Bits of a code of the largest book."""
    return max(1, max(len(b) - 1 for b in books).bit_length())


def encoded(base: DataFrame, codec) -> DataFrame:
    """``(id, code)`` by any codec with ``encode`` of a matrix."""
    return mapped(base, lambda v: codec.encode(v).astype(int), "array<int>").toDF("id", "code")


def decoded(codes: DataFrame, codec) -> DataFrame:
    return mapped(codes, lambda c: codec.decode(c.astype(int))).toDF("id", "embedding")


def code_search(queries: DataFrame, codes: DataFrame, codec: RowCodec, k: int, name: str = "l2", symmetric: bool = False) -> DataFrame:
    """Nearest codes ``(id, code)`` by the codec's own distances; with
    ``symmetric`` the queries are quantized too."""
    from lodestar.operators.knn import HITS
    from lodestar.operators.blocks import tiles

    larger = codec.larger_is_better(name)

    def kernel(qids, q, ids, c):
        c = codec.from_doubles(c)
        d = codec.distances(codec.decode(codec.encode(q)) if symmetric else q, c, name)
        return best_of_tile(qids, ids, d, k, larger)

    return top(tiles_of_two_widths(queries, codes, kernel, HITS, tiles), k, larger)


def best_of_tile(qids, ids, d, k: int, larger: bool) -> dict:
    """The best k of each row of a tile of distances, ties by id."""
    import numpy as np

    key = -d if larger else d
    if (lost := np.isnan(key)).any():
        key = np.where(lost, np.inf, key)
    n = min(k, len(ids))
    if n < len(ids):  # first all that tie with the n-th or beat it
        limit = np.partition(key, n - 1, axis=1)[:, n - 1 : n]
        r, c = np.nonzero(key <= limit)
        order = np.lexsort((ids[c], key[r, c], r))
        r, c = r[order], c[order]
        nth = np.arange(len(r)) - np.searchsorted(r, r)
        r, c = r[nth < n], c[nth < n]
    else:
        c = np.lexsort((np.broadcast_to(ids, d.shape), key)).ravel()
        r = np.repeat(np.arange(len(d)), n)
    return {"qid": qids[r], "id": ids[c], "dist": d[r, c]}


def tiles_of_two_widths(queries: DataFrame, base: DataFrame, kernel, schema: str, tiles) -> DataFrame:
    """Tiles of vectors with codes of another width: both are padded to the
    wider one, and the kernel gets them as they were."""
    q, b = queries.toDF("id", "v"), base.toDF("id", "v")
    one, two = q.select(F.size("v")).first(), b.select(F.size("v")).first()
    dq, db = one[0] if one else 0, two[0] if two else 0
    wide = max(dq, db)
    pad = lambda d: F.concat(F.col("v").cast("array<double>"), F.array_repeat(F.lit(0.0), wide - d))
    return tiles(q.select("id", pad(dq)), b.select("id", pad(db)), lambda i, x, j, y: kernel(i, x[:, :dq], j, y[:, :db]), schema)


@dataclass
class ResidualQuantizer(RowCodec):
    """Codebooks one after the other, each for what the ones before leave; the
    encoder follows the best ``beam`` partial codes, then, if there are
    ``searches``, changes codes one at a time."""

    books: list
    beam: int = 5
    searches: int = 0

    def __post_init__(self):
        self.bits = _bits_of(self.books)

    @staticmethod
    def train(base: DataFrame, m: int, bits: int = 8, iterations: int = 10, beam: int = 5) -> ResidualQuantizer:
        return ResidualQuantizer.train_on(sample(base), m, bits, iterations, beam)

    @staticmethod
    def train_on(v, m: int, bits: int = 8, iterations: int = 10, beam: int = 5) -> ResidualQuantizer:
        import numpy as np

        left, books = v, []
        for i in range(m):
            books.append(lloyd(left, 1 << bits, iterations, 1234 + i))
            left = left - books[-1][nearest_codes(left, books[-1])]
        return ResidualQuantizer(books, beam)

    @staticmethod
    def train_local_search(v, m: int, bits: int = 8, rounds: int = 6, searches: int = 4) -> ResidualQuantizer:
        """Books that local search trains: by turns codes are improved one
        position at a time, and all books are solved for at once."""
        import numpy as np

        q = ResidualQuantizer.train_on(v, m, bits)
        q.searches = searches
        codes = q.encode(v)
        for _ in range(rounds):
            sizes = [len(b) for b in q.books]
            at = np.concatenate([[0], np.cumsum(sizes)[:-1]]) + codes
            gram, right = np.zeros((sum(sizes), sum(sizes))), np.zeros((sum(sizes), v.shape[1]))
            for i in range(m):
                np.add.at(right, at[:, i], v)
                for j in range(m):
                    np.add.at(gram, (at[:, i], at[:, j]), 1)
            flat = np.linalg.solve(gram + 1e-3 * np.eye(len(gram)), right)
            q.books = np.split(flat, np.cumsum(sizes)[:-1])
            codes = q.refine(v, codes, searches)
        return q

    def encode(self, v):
        import numpy as np

        out = np.zeros((len(v), len(self.books)), int)
        for at in range(0, len(v), 1024):  # the beams of many rows at a time
            left = v[at : at + 1024, None, :]
            n = len(left)
            rows, codes = np.arange(n)[:, None], np.zeros((n, 1, 0), int)
            for b in self.books:
                flat = left.reshape(-1, v.shape[1])
                d = metric("l2").tile(flat, b).reshape(n, -1)
                pick = np.argsort(d, axis=1, kind="stable")[:, : self.beam]
                i, j = np.divmod(pick, len(b))
                codes, left = np.concatenate([codes[rows, i], j[:, :, None]], axis=2), left[rows, i] - b[j]
            out[at : at + n] = codes[:, 0]
        return self.refine(v, out, self.searches) if self.searches else out

    def decode(self, codes):
        return sum(b[codes[:, i]] for i, b in enumerate(self.books))

    def refine(self, v, codes, rounds: int = 4):
        """Local search: change one position at a time to its best value while
        the others stand."""
        codes = codes.copy()
        for _ in range(rounds):
            for i, b in enumerate(self.books):
                rest = v - self.decode(codes) + b[codes[:, i]]
                codes[:, i] = nearest_codes(rest, b)
        return codes


# --- binary codes ---

def lsh(v: Column, thresholds: list[float] | None = None) -> Column:
    """Sign bits in 32-bit words, or bits of v above each dimension's threshold."""
    from lodestar.functions.vectors import sign_words

    return sign_words(F.zip_with(v, F.array(*map(F.lit, thresholds)), lambda x, t: x - t) if thresholds else v)


def medians(base: DataFrame) -> list[float]:
    """Each dimension's median over all rows."""
    rows = base.toDF("id", "v").select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.percentile("x", F.lit(0.5)).alias("m")).collect()
    return [float(r.m) for r in sorted(rows)]


@dataclass
class Signs(RowCodec):
    """Bits of components above thresholds, optionally after a rotation; compared
    by how many differ from the query's."""

    thresholds: object = None
    rotation: Linear | None = None
    bits: int | None = 1

    def encode(self, v):
        x = self.rotation(v) if self.rotation else v
        return (x > (0 if self.thresholds is None else self.thresholds)).astype(int)

    def distances(self, q, codes, name: str = "l2"):
        x, y = self.encode(q).astype(float), codes.astype(float)
        return x.sum(1)[:, None] + y.sum(1) - 2 * (x @ y.T)

    def larger_is_better(self, name: str) -> bool:
        return False


@dataclass
class RaBitQ(RowCodec):
    """Rotated sign bits, 1 to 9 a component, with the factors that make inner
    products of codes unbiased estimates. ``center`` is subtracted first."""

    rotation: Linear
    center: object
    bits: int = 1

    @staticmethod
    def train(base: DataFrame, bits: int = 1, seed: int = 1234) -> RaBitQ:
        return RaBitQ.train_on(sample(base), bits, seed)

    @staticmethod
    def train_on(v, bits: int = 1, seed: int = 1234) -> RaBitQ:
        return RaBitQ(random_rotation(v.shape[1], v.shape[1], seed), v.mean(0), bits)

    def from_doubles(self, codes):
        return codes

    def row_bytes(self, codes) -> list[bytes]:
        """The bits, and the three factors as 32-bit floats."""
        import numpy as np

        whole, factors = pack_rows(codes[:, :-3].astype(int), self.bits), np.ascontiguousarray(codes[:, -3:], "<f4")
        return [a.tobytes() + b.tobytes() for a, b in zip(whole, factors)]

    def from_bytes(self, raw: bytes, n: int, width: int):
        import numpy as np

        rows = np.frombuffer(raw, np.uint8).reshape(n, -1)
        whole = unpack_rows(np.ascontiguousarray(rows[:, :-12]).tobytes(), n, width - 3, self.bits)
        return np.column_stack([whole, np.ascontiguousarray(rows[:, -12:]).view("<f4").astype(float)])

    def distances(self, q, codes, name: str = "l2"):
        """Estimates, of squared L2 or of inner products."""
        if name == "ip":
            x = self.rotation(q - self.center)
            d = self.estimate(q, codes)
            centred = ((x * x).sum(1)[:, None] + codes[:, -3] ** 2 - d) / 2
            return centred + (q @ self.center)[:, None] + (self.decode(codes) - self.center) @ self.center
        if name != "l2":
            raise ValueError(f"no estimates of {name}")
        return self.estimate(q, codes)

    def decode(self, codes):
        """The vectors that the estimates take codes for."""
        import numpy as np

        y, length, size, cosine = codes[:, :-3] - ((1 << self.bits) - 1) / 2, codes[:, -3], codes[:, -2], codes[:, -1]
        scale = length / np.maximum(size, 1e-30) / np.where(np.abs(cosine) > 1e-12, cosine, 1)
        return self.rotation.back(y * scale[:, None]) + self.center

    def encode(self, v):
        """Codes and, in the last three columns, the length of each centred
        vector, the length of its code, and their cosine."""
        import numpy as np

        x = self.rotation(v - self.center)
        length = np.linalg.norm(x, axis=1)
        unit = x / np.maximum(length, 1e-30)[:, None]
        top_level = (1 << self.bits) - 1
        if self.bits == 1:
            codes = (unit > 0).astype(int)
        else:  # the scale that keeps most of the direction
            grid = np.linspace(0.35, 1.1, 16)
            most = np.maximum(np.abs(unit).max(axis=1), 1e-30)[:, None]
            codes, best = None, None
            for g in grid:
                c = np.clip(np.floor((unit / (most * g) + 1) / 2 * (top_level + 1)), 0, top_level)
                y = c - top_level / 2
                cosine = (y * unit).sum(1) / np.maximum(np.linalg.norm(y, axis=1), 1e-30)
                if best is None:
                    codes, best = c, cosine
                else:
                    better = cosine > best
                    codes[better], best[better] = c[better], cosine[better]
            codes = codes.astype(int)
        y = codes - top_level / 2
        size = np.linalg.norm(y, axis=1)
        return np.column_stack([codes, length, size, (y * unit).sum(1) / np.maximum(size, 1e-30)])

    def estimate(self, q, codes):
        """Squared distances of queries to codes, estimated."""
        import numpy as np

        x = self.rotation(q - self.center)
        y, length, size, cosine = codes[:, :-3] - ((1 << self.bits) - 1) / 2, codes[:, -3], codes[:, -2], codes[:, -1]
        ip = x @ (y / np.maximum(size, 1e-30)[:, None]).T / np.where(np.abs(cosine) > 1e-12, cosine, 1) * length
        return (x * x).sum(1)[:, None] + length**2 - 2 * ip


def rabitq_search(queries: DataFrame, base: DataFrame, codec: RaBitQ, k: int) -> DataFrame:
    """Nearest rows by estimates from codes."""
    return code_search(queries, mapped(base, lambda v: codec.encode(v)), codec, k)


def refined(candidates: DataFrame, queries: DataFrame, base: DataFrame, k: int, name: str = "l2") -> DataFrame:
    """The best k of a longer result by exact distances."""
    pairs = candidates.select(F.col("qid").alias("ix"), F.col("id").alias("iy"))
    d = pair_distances(pairs, queries, base, name)
    return top(d.select(F.col("ix").alias("qid"), F.col("iy").alias("id"), "dist"), k, metric(name).larger_is_better)


@dataclass
class Lattice(RowCodec):
    """Points of the unit sphere nearest to integer vectors of squared length
    ``r2``: a codec of directions."""

    r2: int
    known: dict = field(default_factory=dict)

    def encode(self, v):
        """For each row, the integer vector of squared length r2 with the largest
        inner product: the best sorted pattern, with the row's order and signs."""
        import numpy as np

        patterns = self.patterns(v.shape[1])
        size = np.abs(v)
        order = np.argsort(-size, axis=1, kind="stable")
        best = np.argmax(np.take_along_axis(size, order, 1) @ patterns.T, axis=1)
        out = np.zeros(v.shape, int)
        np.put_along_axis(out, order, patterns[best], 1)
        return np.where(v < 0, -out, out)

    def decode(self, codes):
        return codes / self.r2**0.5

    def patterns(self, d: int):
        """Falling lists of d numbers whose squares add up to r2."""
        import numpy as np

        if d not in self.known:
            found: list[list[int]] = []

            def fill(head, left):
                if left == 0:
                    found.append(head + [0] * (d - len(head)))
                elif len(head) < d:
                    for x in range(min(head[-1] if head else left, int(left**0.5)), 0, -1):
                        fill([*head, x], left - x * x)

            fill([], self.r2)
            self.known[d] = np.array(found)
        return self.known[d]


# --- polysemous codes ---

@dataclass
class Polysemous(ProductQuantizer):
    """A product quantizer whose codes can also be compared as bits: each book is
    ordered so that codes of near centroids differ in few bits. Codes over ``ht``
    differing bits from the query's are passed over."""

    ht: int | None = None

    @staticmethod
    def of(pq: ProductQuantizer, ht: int | None = None, rounds: int = 20_000, seed: int = 1234) -> Polysemous:
        return Polysemous([b[annealed_order(b, rounds, seed + i)] for i, b in enumerate(pq.books)], ht)

    def distances(self, q, codes, name: str = "l2"):
        import numpy as np

        d = super().distances(q, codes, name)
        if self.ht is None:
            return d
        own, apart = self.encode(q), np.zeros(d.shape, np.int64)
        for i in range(codes.shape[1]):
            apart += np.bitwise_count(own[:, i][:, None] ^ codes[:, i])
        return np.where(apart <= self.ht, d, np.nan)


def annealed_order(book, rounds: int = 20_000, seed: int = 1234):
    """An order of a book's centroids, by simulated annealing over swaps: the
    numbers of bits in which two places differ follow the distances between the
    centroids there, near ones counting more."""
    import numpy as np

    n = len(book)
    order, random = np.arange(n), np.random.default_rng(seed)
    if n < 3:
        return order
    far = np.sqrt(np.maximum(metric("l2").tile(book, book), 0))
    bits = np.bitwise_count(np.arange(n)[:, None] ^ np.arange(n)).astype(float)
    aim = far / max(far.mean(), 1e-30) * bits.mean()
    weight = np.exp(-np.log(4) * far / max(far.max(), 1e-30) * 4)
    cost = lambda rows: sum(float((weight[order[r], order] * (bits[r] - aim[order[r], order]) ** 2).sum()) for r in rows)
    heat = 0.7 * cost(range(n)) / n
    for a, b, u in zip(random.integers(0, n, rounds).tolist(), random.integers(0, n, rounds).tolist(), random.random(rounds).tolist()):
        heat *= 0.9997
        if a == b:
            continue
        before = cost((a, b))
        order[a], order[b] = order[b], order[a]
        worse = cost((a, b)) - before
        if worse > 0 and u >= np.exp(-worse / max(heat, 1e-12)):
            order[a], order[b] = order[b], order[a]
    return order
