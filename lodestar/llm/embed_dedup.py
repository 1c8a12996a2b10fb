"""Embedding near-dedup by int8 tile products with error bounds.

Vectors of one label are dealt over blocks, quantised once to int8 codes; each
pair of blocks is one tile, computed by one task from the codes alone. Each
vector knows its code's scale and the length of its own rounding error, which
bounds what a product of codes can be off by. Pairs that the bound puts below
the threshold are none, pairs that it puts above are links; only those between
are computed again from the full vectors, in double precision, and full vectors
only travel to tiles that have such pairs.

A tile doesn't return its pairs: it returns how many links each vector has in it
and a spanning forest of the links, at most one edge for each vector. Components
of all forests are those of all links.

Rows: vectors that are null, empty, zero or hold null or non-finite components
link with nothing, as do those with a null label or vec_id; vectors of different
lengths don't link. Vectors are scaled by their largest component first, so that
no norm over- or underflows. Rows with one vec_id are vectors of their own, which
link like any others; in the result they stand as one row for each input row,
with the sums of their vec_id. An empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.shared import connected_components, materialize, settled

#: Vectors in a block aim at this number; of a tile, so many by so many are computed at once.
BLOCK, PART = 2048, 512
#: Products of codes are exact in float32 up to this many components.
EXACT_WIDTH = (1 << 24) // (127 * 127)
#: What products and sums in double precision can be off by.
ROUNDING = 1e-9


def unit_rows(vectors):
    """Rows of length 1, whatever the size of their components."""
    import numpy as np

    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def quantised(vectors):
    """Of unit vectors: int8 codes, the scale of each code, and the length of its
    rounding error."""
    import numpy as np

    scale = np.abs(vectors).max(axis=1) / 127
    codes = np.rint(vectors / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(vectors - scale[:, None] * codes, axis=1)


def by_bound(x, y, threshold: float):
    """Which pairs of ``x`` and ``y``, each as from ``quantised``, have a cosine
    of at least ``threshold`` for certain, and which may have. With unit vectors
    u = su*qu + eu, the product differs from su*sv*(qu.qv) by no more than
    |eu| (1 + |ev|) + |ev|."""
    import numpy as np

    (qx, sx, ex), (qy, sy, ey) = x, y
    kind = np.float32 if qx.shape[1] <= EXACT_WIDTH else np.float64
    near = (qx.astype(kind) @ qy.astype(kind).T) * sx[:, None] * sy
    bound = ex[:, None] * (1 + ey) + ey + ROUNDING
    sure = near - bound >= threshold
    return sure, (near + bound >= threshold) & ~sure


def exact_pairs(ux, uy, i, j, threshold: float):
    """Those of the row numbers (i, j) whose unit vectors reach the threshold, in
    double precision."""
    import numpy as np

    ok = np.concatenate([np.einsum("ij,ij->i", ux[i[k : k + 65536]], uy[j[k : k + 65536]]) for k in range(0, len(i), 65536)] or [np.zeros(0)]) >= threshold
    return i[ok], j[ok]


def forest(n: int, i, j):
    """Each row's root, for the components of the pairs (i, j) among n rows: the
    component's first row. In rounds over all pairs at once: the larger of two
    roots is hung under the smallest that a pair leads to, then all rows point at
    the tops of their trees."""
    import numpy as np

    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        open_ = a != b
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def _found(ids_x, ids_y, i, j):
    """Link counts and forest edges of the pairs (i, j) of a tile's rows; without
    ``ids_y``, of a block with itself."""
    import numpy as np

    ids, j = (ids_x, j) if ids_y is None else (np.concatenate([ids_x, ids_y]), j + len(ids_x))
    links = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
    order = np.argsort(ids, kind="stable")  # so that roots are the smallest ids
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    root = forest(len(ids), rank[i], rank[j])
    hung = np.flatnonzero(root != np.arange(len(root)))
    ordered = ids[order]
    return [(a, n, None) for a, n in zip(ids[links > 0].tolist(), links[links > 0].tolist())] + [(a, 0, b) for a, b in zip(ordered[hung].tolist(), ordered[root[hung]].tolist())]


def _pairs_of(x, y, threshold: float):
    """Row numbers of the certain and of the possible pairs of a tile; without
    ``y``, of a block with itself, each pair once."""
    import numpy as np

    out, other = ([], []), y or x
    part = lambda v, at: tuple(c[at : at + PART] for c in v)
    for a in range(0, len(x[1]), PART):
        for b in range(a if y is None else 0, len(other[1]), PART):
            for kind, hit in zip(out, by_bound(part(x, a), part(other, b), threshold)):
                i, j = np.nonzero(np.triu(hit, 1) if y is None and a == b else hit)
                kind.append((i + a, j + b))
    return [tuple(np.concatenate([p[k] for p in kind]) if kind else np.zeros(0, np.int64) for k in (0, 1)) for kind in out]


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors``:
    others of its label with a cosine of at least ``threshold``, the smallest
    vec_id that links reach, and whether that is its own."""
    v = F.col(embedding)
    sound = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(label).isNotNull() & F.col(vec_id).isNotNull() & F.coalesce(sound, F.lit(False)))
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.to_json(F.struct(F.col(label).alias("label"), F.size(v).alias("width"))).alias("group"), v.cast("array<double>").alias("v"))
    # numbered once in a written table, so that rows which are alike in all columns are dealt over blocks too
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    blocks = materialize(rows.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n_blocks")), "groups")
    dealt = rows.join(blocks, "group").withColumn("block", F.pmod(F.xxhash64("row"), F.col("n_blocks")).cast("int"))

    def pack(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(["vec_id", "row"])
        u = unit_rows(np.stack(pdf["v"].to_numpy()))
        q, s, e = quantised(u)
        return pd.DataFrame([{"group": pdf["group"].iloc[0], "block": pdf["block"].iloc[0], "ids": pdf["vec_id"].to_numpy(np.int64).tobytes(),
                              "codes": q.tobytes(), "scales": s.tobytes(), "errors": e.tobytes(), "units": u.tobytes()}])

    packed = materialize(dealt.groupBy("group", "block").applyInPandas(pack, "group string, block int, ids binary, codes binary, scales binary, errors binary, units binary"), "blocks")
    # block b meets b itself and those before it
    tiles = packed.select("group", "block", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("other"))
    side = lambda n, names: packed.select("group", F.col("block").alias(n), *(F.col(c).alias(f"{c}_{n}") for c in names))
    coded = ("ids", "codes", "scales", "errors")
    work = tiles.join(side("block", coded), ["group", "block"]).join(side("other", coded), ["group", "other"])
    work = work.repartition("group", "block", "other").select("group", "block", "other", *(f"{c}_{n}" for n in ("block", "other") for c in coded))
    kind = "group string, block int, other int, pairs binary, vec_id long, links long, forest long"

    def record(group, block, other, pairs, found):
        """A row for the tile's undecided pairs, if any, and one for each finding."""
        import pyarrow as pa

        n, k = len(found), int(pairs is not None)
        return pa.RecordBatch.from_arrays([
            pa.array([group] * k + [None] * n, pa.string()), pa.array([block] * k + [None] * n, pa.int32()), pa.array([other] * k + [None] * n, pa.int32()), pa.array([pairs] * k + [None] * n, pa.binary()),
            *(pa.array([None] * k + [f[c] for f in found], pa.int64()) for c in range(3))], names=["group", "block", "other", "pairs", "vec_id", "links", "forest"])

    def by_codes(batches):
        import numpy as np

        for batch in batches:
            for r in range(batch.num_rows):
                group, block, other, *raw = (batch.column(c)[r].as_py() for c in range(11))
                two = []
                for ids, codes, scales, errors in (raw[:4], raw[4:]):
                    ids = np.frombuffer(ids, np.int64)
                    two.append((ids, (np.frombuffer(codes, np.int8).reshape(len(ids), -1), np.frombuffer(scales), np.frombuffer(errors))))
                (ids_x, x), (ids_y, y) = two if block != other else (two[0], (None, None))
                sure, open_ = _pairs_of(x, y, threshold)
                pairs = np.stack(open_).astype("<u2").tobytes() if len(open_[0]) else None
                yield record(group, block, other, pairs, _found(ids_x, ids_y, *sure))

    tiled = materialize(work.mapInArrow(by_codes, kind), "tiled")
    full = ("ids", "units")
    work = tiled.where("pairs is not null").select("group", "block", "other", "pairs")
    work = work.join(side("block", full), ["group", "block"]).join(side("other", full), ["group", "other"]).repartition("group", "block", "other")
    work = work.select("group", "block", "other", "pairs", *(f"{c}_{n}" for n in ("block", "other") for c in full))

    def in_full(batches):
        import numpy as np

        for batch in batches:
            for r in range(batch.num_rows):
                group, block, other, pairs, ids_x, ux, ids_y, uy = (batch.column(c)[r].as_py() for c in range(8))
                i, j = np.frombuffer(pairs, "<u2").reshape(2, -1).astype(np.int64)
                ids_x, ids_y = np.frombuffer(ids_x, np.int64), np.frombuffer(ids_y, np.int64)
                hit = exact_pairs(np.frombuffer(ux).reshape(len(ids_x), -1), np.frombuffer(uy).reshape(len(ids_y), -1), i, j, threshold)
                yield record(group, block, other, None, _found(ids_x, None if block == other else ids_y, *hit))

    found = tiled.where("pairs is null").select("vec_id", "links", "forest").unionAll(materialize(work.mapInArrow(in_full, kind), "exact").select("vec_id", "links", "forest"))
    edges = found.where("forest is not null").select(F.col("vec_id").alias("a"), F.col("forest").alias("b"))
    parts = settled(vectors.sparkSession, lambda: connected_components(edges), "parts")
    links = found.where("links > 0").groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    out = vectors.select(F.col(vec_id).cast("long").alias("vec_id"))
    out = out.join(links, "vec_id", "left").join(parts.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
