"""Searches of an index that reach a stated recall at any size of the base.

What codes of a few bits leave of the order of distances gets less as rows get more,
so a fixed number of candidates loses hits. Here each code is stored with its row's
vector: of each block, the part of rows that is nearest by codes is ranked by vectors
where the block is, and only the best k leave it. How many lists are probed and how
large the part is are fitted on rows of the base (at most ``FIT_ROWS``, those of least
hash), whose exact neighbours are searched. Every row is indexed; in the limit all
lists are probed and all rows ranked, which is exact. An index that refines by codes
ranks by what those keep, and asks for as much more as they lose.

Graphs have no blocks: there the nearest rows of walks, as many as the fitting rows
need, meet their vectors."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.metrics import metric
from lodestar.operators import additive, codecs, ivf
from lodestar.operators.blocks import tiles
from lodestar.operators.knn import HITS, knn, top
from lodestar.plans.factory import Centroids, Index
from lodestar.sources.shared import materialize

#: Rows of the base on which a search is fitted at most, and how much more recall is
#: asked for there than is stated.
FIT_ROWS, MARGIN = 256, 0.02


class _Decoded(codecs.RowCodec):
    """Another codec's codes, compared by what they keep."""

    def __init__(self, of: codecs.RowCodec):
        self.of, self.decode, self.from_bytes = of, of.decode, of.from_bytes


class _WithVectors(codecs.RowCodec):
    """Codes of a codec, each followed by the row's vector of d doubles."""

    def __init__(self, of: codecs.RowCodec, d: int):
        self.of, self.d = of, d

    def from_bytes(self, raw: bytes, n: int, width: int):
        import numpy as np

        rows = np.frombuffer(raw, np.uint8).reshape(n, -1)
        return self.of.from_bytes(rows[:, : -8 * self.d].tobytes(), n, width), np.ascontiguousarray(rows[:, -8 * self.d :]).view("<f8")


@dataclass
class Ranked:
    """An index whose ``rows`` (or ``blocks``, if it has lists) have codes with
    vectors of ``d`` components; a search probes ``nprobe`` lists and ranks ``part``
    of the rows of each block, ``least`` at least."""

    index: Index
    rows: DataFrame
    blocks: DataFrame | None
    d: int
    nprobe: int = 1
    part: float = 1.0
    least: int = 1

    def _tiles(self, queries: DataFrame, nprobe: int, kernel: Callable, schema: str) -> DataFrame:
        """``kernel(query ids, keys by codes, queries, ids, vectors)`` over all tiles
        of a search; smaller keys are nearer."""
        index, d = self.index, self.d
        distances, larger, width, steps = index._distances(), index.larger_is_better(), index.width, index.transforms
        codec = _WithVectors(index.codec, d)

        def both(v):
            import numpy as np

            m = v
            for t in steps:
                m = t(m)
            return np.hstack([m, v])

        def run(qids, x, ids, stored, list_no):
            import numpy as np

            codes, v = stored
            key = distances(x[:, :-d], codes, list_no)
            key = -key if larger else key
            return kernel(qids, np.where(np.isnan(key), np.inf, key), x[:, -d:], ids, v)

        q = codecs.mapped(queries.toDF("id", "embedding"), both).toDF("qid", "qv")
        if self.blocks is not None:
            return ivf.list_tiles(q, index.chosen(queries, nprobe), self.blocks, run, schema, codec, width)
        return tiles(q, self.rows.select("id", "code"), lambda qids, x, ids, raw: run(qids, x, ids, codec.from_bytes(raw, len(ids), width), 0), schema)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """The k nearest rows of ``(qid, qv)`` among those ranked by vectors."""
        m, part, least = metric(self.index.name), self.part, max(k, self.least)

        def kernel(qids, keys, q, ids, v):
            import numpy as np

            n, out = min(len(ids), max(least, math.ceil(part * len(ids)))), []
            for i, qid in enumerate(qids):
                c = np.flatnonzero(keys[i] <= np.partition(keys[i], n - 1)[n - 1]) if n < len(ids) else np.arange(n)
                out.append(codecs.best_of_tile(qids[i : i + 1], ids[c], m.tile(q[i : i + 1], v[c]), k, m.larger_is_better))
            return {x: np.concatenate([o[x] for o in out]) for x in ("qid", "id", "dist")}

        return top(self._tiles(queries.toDF("qid", "qv"), self.nprobe, kernel, HITS), k, m.larger_is_better)


def ranked(index: Index, base: DataFrame) -> Ranked:
    """The index with the vectors of its rows ``(id, embedding)``, or what its refining
    codes keep of them, before any fit: all rows of one list are ranked."""
    if index.codes is None or index.copies is not None or index.coarse is not None and not isinstance(index.coarse, Centroids) or index.independent:
        raise ValueError(f"{index.spec} isn't ranked by vectors")
    if isinstance(index.codec, additive.TwoStage):  # its own distances are of few rows
        index = replace(index, codec=_Decoded(index.codec))
    given = (index.refining() if index.refine_codes is not None else base.toDF("id", "embedding")).select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    d = given.select(F.size("embedding")).first()[0]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                v = np.ascontiguousarray(ivf.matrix_of(batch.column(3)), "<f8")
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c + x.tobytes() for c, x in zip(batch.column(2).to_pylist(), v)], pa.binary())], names=["id", "list_no", "code"])

    rows = materialize(index.codes.join(given, "id").select("id", "list_no", "code", "embedding").mapInArrow(run, "id long, list_no int, code binary"), "ranked")
    return Ranked(index, rows, materialize(ivf.list_blocks(rows, "code"), "blocks") if index.coarse else None, d)


@dataclass
class Walked:
    """An index of graphs over what codes keep; the ``wide`` nearest of its walks, with
    beams of ``ef`` or more, are ranked by the vectors of ``base``."""

    index: Index
    base: DataFrame
    ef: int = 64
    wide: int = 1

    def candidates(self, queries: DataFrame, wide: int) -> DataFrame:
        """The ``wide`` nearest rows by what the codes keep."""
        return self.index.search(queries, wide, ef=max(self.ef, wide))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """The k nearest rows of ``(qid, qv)`` among those ranked by vectors."""
        q = queries.toDF("qid", "qv")
        return codecs.refined(self.candidates(q, max(k, self.wide)), q, self.base, k, self.index.name)


def fitting_rows(base: DataFrame, k: int, name: str) -> tuple[DataFrame, DataFrame]:
    """The rows on which a search is fitted, as queries, and their k exact neighbours
    ``(qid, id)``: their own rows, the easiest hits, don't count."""
    q = materialize(base.toDF("qid", "qv").where("qid is not null and qv is not null").orderBy(F.xxhash64("qid", F.lit(11)), "qid").limit(FIT_ROWS), "fit")
    return q, materialize(knn(q, base, k, name, exclude_self=True).select("qid", "id"), "truth")


def fitted_walk(index: Index, base: DataFrame, k: int, reach: float, ef: int = 64) -> Walked:
    """The index with the fewest candidates of walks by which the fitting rows reach
    that recall, in the limit all rows that links lead to."""
    given = base.toDF("id", "embedding")
    out, (q, truth) = Walked(index, given, ef), fitting_rows(given, k, index.name)
    wanted, rows, wide = math.ceil(min(1.0, reach + MARGIN) * truth.count()), given.count(), max(ef, k)
    while wanted:
        met = out.candidates(q, wide).join(truth, ["qid", "id"]).select("rank").orderBy("rank").collect()  # k for each fitting row at most
        if len(met) >= wanted:
            return replace(out, wide=met[wanted - 1]["rank"])
        if wide >= rows:
            break
        wide = min(rows, 4 * wide)
    return replace(out, wide=wide)


def fitted(index: Index, base: DataFrame, k: int, reach: float, nprobe: int = 1, k_factor: int = 1) -> Ranked:
    """The index with vectors, and with the fewest probes, ``nprobe`` at least, and the
    smallest part of rows, ``k * k_factor`` of a block at least, by which the fitting
    rows reach that recall. Of what may be lost, half is left to lists."""
    out, lists = replace(ranked(index, base), least=k * k_factor), len(index.coarse.matrix) if index.coarse else 1
    q, truth = fitting_rows(base, k, index.name)
    true: dict[int, list[int]] = {}
    for r in truth.collect():  # k for each fitting row
        true.setdefault(r.qid, []).append(r.id)

    def kernel(qids, keys, q, ids, v):
        import numpy as np

        rows = []
        for i, qid in enumerate(qids.tolist()):
            c = np.flatnonzero(np.isin(ids, true.get(qid, [])))
            rows += [(qid, int(ids[j]), float((keys[i] <= keys[i, j]).mean())) for j in c]
        return dict(zip(("qid", "id", "part"), map(np.array, zip(*rows)))) if rows else {"qid": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "part": np.zeros(0)}

    found = out._tiles(q, lists, kernel, "qid long, id long, part double")
    if index.coarse:
        chosen = materialize(index.chosen(q, lists), "chosen")
        found = found.join(out.rows.select("id", "list_no"), "id").join(chosen.select("qid", "list_no", "probe"), ["qid", "list_no"])
    rows = [(r.probe, r.part) for r in found.select("qid", "id", F.col("probe") if index.coarse else F.lit(1).alias("probe"), "part").collect()]
    n = sum(map(len, true.values()))
    if not n:
        return replace(out, nprobe=lists)
    most = 1.0
    if index.refine_codes is not None:  # what is left if all rows are ranked by its codes
        most = knn(q, index.refining(), k, index.name, exclude_self=True).join(truth, ["qid", "id"]).count() / n
    least = min(1.0, (reach + MARGIN) / max(most, reach))
    probes = [p for p in range(min(nprobe, lists), lists + 1) if sum(x <= p for x, _ in rows) >= (1 + least) / 2 * n]
    out.nprobe = probes[0] if probes else lists
    parts = sorted(x for p, x in rows if p <= out.nprobe)
    at = math.ceil(least * n) - 1
    out.part = parts[at] if at < len(parts) else 1.0
    return out
