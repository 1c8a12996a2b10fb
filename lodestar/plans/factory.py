"""Index factory: a string names the steps of an index, such as
``PCA32,IVF16,PQ8x4,Refine(Flat)``, and builds them over a base."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import additive, cluster, codecs, graph, ivf, levels, merge
from lodestar.operators.blocks import tiles
from lodestar.operators.knn import HITS, top
from lodestar.sources.shared import materialize

_TRANSFORM = re.compile(r"(PCAWR|PCAW|PCAR|PCA|OPQ|RR|HR|ITQ|L2norm|Pad)(\d+)?(?:_(\d+))?$")
_COARSE = re.compile(r"(IVF|IMI2x)(\d+)(k)?(?:_HNSW(\d+)?)?$")
_CODEC = re.compile(r"(?:(Flat|FlatDedup)|(SQ)(4|6|8|fp16|bf16)|PQ(\d+)(?:x(\d+))?|RQ(\d+)x(\d+)|LSH(r?t?)|LSQ(\d+)x(\d+)|RaBitQ(\d)?|HNSW(\d+)?|NSG(\d+)?)$")

#: Codes of slices as sums, fixed levels, no bits, two stages, signs of waves.
_MORE = re.compile(r"(?:(PRQ|PLSQ)(\d+)x(\d+)x(\d+)|SQtqmse([1-8])|(SQ0)|PQ(\d+)\+(\d+)(?:x(\d+))?|(?:(ITQ|PCAR|PCA|RR)(\d+),)?SH([\d.]+)([gchm]?))$")


@dataclass(frozen=True)
class Step:
    kind: str
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Spec:
    """A parsed string: what is done to vectors, how they are partitioned, how
    they are stored, and whether hits are ranked again."""

    transforms: tuple[Step, ...] = ()
    coarse: Step | None = None
    codec: Step = Step("Flat")
    id_map: bool = False
    refine: Step | None = None

    def __str__(self) -> str:
        parts = (["IDMap"] if self.id_map else []) + [_name(t) for t in self.transforms] + ([_name(self.coarse)] if self.coarse else []) + [_name(self.codec)]
        return ",".join(parts + ([f"Refine({_name(self.refine)})"] if self.refine else []))


def _name(s: Step) -> str:
    o = s.options
    if s.kind in ("IVF", "IMI2x"):
        return f"{s.kind}{o['n']}" + ("_HNSW" + (str(o["m"]) if o.get("m") else "") if "m" in o else "")
    if s.kind == "SQ":
        return f"SQ{o['type']}"
    if s.kind in ("PQ", "RQ", "LSQ"):
        return f"{s.kind}{o['m']}x{o['bits']}"
    if s.kind == "LSH":
        return "LSH" + o.get("flags", "")
    if s.kind in ("PRQ", "PLSQ"):
        return f"{s.kind}{o['slices']}x{o['m']}x{o['bits']}"
    if s.kind == "PQ+":
        return f"PQ{o['m']}+{o['refine']}x{o['bits']}"
    if s.kind == "SH":
        return (f"{o['by']}{o['d']}," if o["by"] else "") + f"SH{o['period']:g}{o['flag']}"
    if s.kind == "SQ0":
        return s.kind
    n = o.get("d", o.get("m", o.get("bits", "")))
    return f"{s.kind}{n if n is not None else ''}" + (f"_{o['out']}" if o.get("out") else "") + (f",{o['storage']}" if "storage" in o else "")


def _split(text: str) -> list[str]:
    parts, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            raise ValueError(f"unmatched bracket in {text!r}")
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    if depth:
        raise ValueError(f"unmatched bracket in {text!r}")
    return [p.strip() for p in parts]


def _codec(part: str) -> Step | None:
    if m := _MORE.match(part):
        if m[1]:
            return Step(m[1], {"slices": int(m[2]), "m": int(m[3]), "bits": int(m[4])})
        if m[5]:
            return Step("SQtqmse", {"bits": int(m[5])})
        if m[6]:
            return Step("SQ0")
        if m[7]:
            return Step("PQ+", {"m": int(m[7]), "refine": int(m[8]), "bits": int(m[9] or 8)})
        return Step("SH", {"by": m[10], "d": int(m[11]) if m[11] else None, "period": float(m[12]), "flag": m[13] or "g"})
    m = _CODEC.match(part)
    if not m:
        return None
    if m[1]:
        return Step(m[1])
    if m[2]:
        return Step("SQ", {"type": m[3]})
    if m[4]:
        return Step("PQ", {"m": int(m[4]), "bits": int(m[5] or 8)})
    if m[6]:
        return Step("RQ", {"m": int(m[6]), "bits": int(m[7])})
    if part.startswith("LSH"):
        return Step("LSH", {"flags": m[8] or ""})
    if m[9]:
        return Step("LSQ", {"m": int(m[9]), "bits": int(m[10])})
    if part.startswith("RaBitQ"):
        return Step("RaBitQ", {"bits": int(m[11] or 1)})
    kind = "HNSW" if part.startswith("HNSW") else "NSG"
    return Step(kind, {"m": int((m[12] if kind == "HNSW" else m[13]) or 32)})


def _with_projections(parts: list[str]) -> list[str]:
    """Parts in which a projection stays with the hash that is made of it."""
    out: list[str] = []
    for p in parts:
        if p.startswith("SH") and out and re.fullmatch(r"(ITQ|PCAR|PCA|RR)\d+", out[-1]):
            out[-1] += "," + p
        else:
            out.append(p)
    return out


def parse(text: str) -> Spec:
    """The steps of a factory string; what isn't understood is an error."""
    transforms, coarse, codec, id_map, refine = [], None, None, False, None
    for part in _with_projections(_split(text)):
        if part in ("IDMap", "IDMap2"):
            id_map = True
        elif m := re.fullmatch(r"Refine\((.+)\)|RFlat", part):
            refine = _codec(m[1]) if m[1] else Step("Flat")
            if refine is None:
                raise ValueError(f"{part!r} refines by an unknown codec")
        elif codec is None and not coarse and (m := _TRANSFORM.match(part)):
            transforms.append(Step(m[1], {"d": int(m[2]) if m[2] else None, "out": int(m[3]) if m[3] else None}))
        elif codec is None and coarse is None and (m := _COARSE.match(part)):
            coarse = Step(m[1], {"n": int(m[2]) * (1024 if m[3] else 1)} | ({"m": int(m[4]) if m[4] else None} if "_HNSW" in part else {}))
        elif codec is None and (step := _codec(part)):
            codec = step
        elif codec is not None and codec.kind in ("HNSW", "NSG") and (step := _codec(part)):
            codec = Step(codec.kind, codec.options | {"storage": _name(step)}) if step.kind != "Flat" else codec
        else:
            raise ValueError(f"{part!r} isn't understood in {text!r}")
    if codec is None:
        if coarse or transforms:
            raise ValueError(f"{text!r} names no codec")
        raise ValueError("the string is empty")
    spec = Spec(tuple(transforms), coarse, codec, id_map, refine)
    if why := _refused(spec):
        raise ValueError(f"{text!r}: {why}")
    return spec


def _refused(spec: Spec) -> str | None:
    """Why no index of these steps is built."""
    k = spec.codec.kind
    if spec.coarse and k in ("HNSW", "NSG"):
        return "graphs have no lists; a graph over centroids is IVFn_HNSWm"
    if k in ("FlatDedup", "SQ0", "PQ+", "SH") and not spec.coarse:
        return f"{k} is for lists"
    if spec.coarse and spec.coarse.kind == "IMI2x" and k == "SH":
        return "a multi-index has no thresholds by list"
    if spec.refine and spec.refine.kind in ("LSH", "HNSW", "NSG", "FlatDedup", "SQ0", "SH"):
        return f"{spec.refine.kind} can't rank again"
    if spec.codec.options.get("storage", "").startswith(("LSH", "HNSW", "NSG", "FlatDedup", "SQ0", "SH")):
        return f"graphs don't store {spec.codec.options['storage']}"
    if spec.coarse and spec.coarse.kind == "IMI2x" and ("m" in spec.coarse.options or spec.coarse.options["n"] > 12):
        return "a multi-index has 1 to 12 bits for each half and no graph"
    return None


def code_size(spec: Spec, d: int) -> int:
    """Bytes that a vector's code takes."""
    for t in spec.transforms:
        d = t.options.get("out") or (t.options["d"] if t.kind not in ("OPQ",) and t.options["d"] else d)
    o, k = spec.codec.options, spec.codec.kind
    if k in ("Flat", "FlatDedup"):
        size = 4 * d
    elif k == "SQ":
        size = 2 * d if o["type"] in ("fp16", "bf16") else math.ceil(d * int(o["type"]) / 8)
    elif k in ("PQ", "RQ", "LSQ"):
        size = math.ceil(o["m"] * o["bits"] / 8)
    elif k == "LSH":
        size = math.ceil(d / 8)
    elif k in ("PRQ", "PLSQ"):
        size = math.ceil(o["slices"] * o["m"] * o["bits"] / 8) + 4
    elif k == "PQ+":
        size = math.ceil((o["m"] + o["refine"]) * o["bits"] / 8)
    elif k == "SQtqmse":
        size = math.ceil(d * o["bits"] / 8) + 4
    elif k == "SH":
        size = math.ceil((o["d"] or d) / 8)
    elif k == "SQ0":
        size = 0
    elif k == "RaBitQ":
        size = math.ceil(d * o["bits"] / 8) + 8
    else:
        size = 4 * d + 2 * o["m"] * 4
    if spec.coarse:
        n = spec.coarse.options["n"]
        size += math.ceil((2 * n if spec.coarse.kind == "IMI2x" else math.log2(max(2, n))) / 8)
    return size


# --- coarse quantizers ---

@dataclass
class Centroids:
    """Lists by the nearest of n centroids; with a graph over them, probes walk it."""

    matrix: object
    name: str
    graph: list | None = None

    def assign(self, v):
        return ivf.nearest_rows(v, self.matrix, self.name)[0]

    def centroid(self, list_no):
        return self.matrix[list_no]

    def probes(self, queries: DataFrame, nprobe: int) -> DataFrame:
        spark = queries.sparkSession
        if self.graph is None:
            return ivf.probes(queries, cluster.centroid_frame(spark, self.matrix), nprobe, self.name)
        index = spark.createDataFrame(self.graph, graph.INDEX)
        found = graph.hits(graph.search(queries, index, graph.Walk(k=nprobe, ef=max(64, 2 * nprobe))), nprobe, self.name)
        return found.select("qid", F.col("id").cast("int").alias("list_no"), F.col("rank").alias("probe"), F.col("dist").alias("coarse"))


@dataclass
class Cells:
    """Lists by the nearest centroid of each half of the dimensions: a cell is a
    pair of them, the first half's lowest in its number."""

    books: list
    name: str

    def assign(self, v):
        d = self.books[0].shape[1]
        first, second = (ivf.nearest_rows(x, b, "l2")[0] for x, b in zip((v[:, :d], v[:, d:]), self.books))
        return first + second * len(self.books[0])

    def centroid(self, list_no):
        import numpy as np

        n = len(self.books[0])
        return np.concatenate([self.books[0][list_no % n], self.books[1][list_no // n]], axis=-1)

    def probes(self, queries: DataFrame, nprobe: int) -> DataFrame:
        spark = queries.sparkSession
        books = [spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(b)], "id long, embedding array<double>") for b in self.books]
        found = ivf.multi_index(queries, books, nprobe)
        return found.select("qid", F.col("id").cast("int").alias("list_no"), F.col("rank").alias("probe"), F.col("dist").alias("coarse"))


# --- indexes ---

@dataclass
class Index:
    """A built index. ``codes`` has ``(id, list_no, code)``, a code as few bytes as
    its codec needs; ``blocks`` are the same packed by list, if there are lists. A
    code is of the vector, or, if ``residual``, of its difference from its list's
    centroid. If ``independent``, lists are those of the vectors as they were given,
    and only what the codes keep is moved."""

    spec: Spec
    name: str
    transforms: list
    codec: codecs.RowCodec | None = None
    width: int = 0
    coarse: Centroids | Cells | None = None
    residual: bool = False
    independent: bool = False
    codes: DataFrame | None = None
    blocks: DataFrame | None = None
    graphs: DataFrame | None = None
    copies: DataFrame | None = None
    refine_codec: codecs.RowCodec | None = None
    refine_codes: DataFrame | None = None
    base: DataFrame | None = None

    def moved(self, vectors: DataFrame) -> DataFrame:
        for t in self.transforms:
            vectors = codecs.mapped(vectors.toDF("id", "embedding"), t)
        return vectors.toDF("id", "embedding")

    def coded(self, vectors: DataFrame) -> DataFrame:
        """``(id, list_no, code)`` of vectors that the transforms have moved, or, if
        lists are independent of them, have yet to move."""
        residual, transforms = self.residual, self.transforms if self.independent else []
        shared = vectors.sparkSession.sparkContext.broadcast((self.codec, self.coarse))

        def run(batches):
            import numpy as np
            import pyarrow as pa

            codec, coarse = shared.value
            for batch in batches:
                if batch.num_rows:
                    v = ivf.matrix_of(batch.column(1))
                    where = coarse.assign(v) if coarse else np.zeros(len(v), np.int64)
                    for t in transforms:
                        v = t(v)
                    moved = v - coarse.centroid(where) if residual else v
                    codes = codec.row_bytes(codec.encode_in(moved, where) if getattr(codec, "by_list", False) else codec.encode(moved))
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(where.astype(np.int32)), pa.array(codes, pa.binary())], names=["id", "list_no", "code"])

        return vectors.toDF("id", "embedding").where("id is not null and embedding is not null").select(F.col("id").cast("long").alias("id"), "embedding").mapInArrow(run, "id long, list_no int, code binary")

    def kept(self) -> DataFrame:
        """``(id, embedding)`` as the codes keep them, in the moved space."""
        codec, coarse, residual, width = self.codec, self.coarse, self.residual, self.width
        shared = self.codes.sparkSession.sparkContext.broadcast((codec, coarse))

        def run(batches):
            import pyarrow as pa

            codec, coarse = shared.value
            for batch in batches:
                if batch.num_rows:
                    v = codec.decode(codec.from_bytes(b"".join(batch.column(2).to_pylist()), batch.num_rows, width))
                    v = v + coarse.centroid(batch.column(1).to_numpy()) if residual else v
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(v), pa.list_(pa.float64()))], names=["id", "embedding"])

        return self.codes.select("id", "list_no", "code").mapInArrow(run, "id long, embedding array<double>")

    def _distances(self):
        """Distances of queries to the codes of a list."""
        codec, coarse, residual, name = self.codec, self.coarse, self.residual, self.name

        def run(q, codes, list_no):
            if getattr(codec, "by_list", False):
                return codec.distances_in(q, codes, list_no)
            if not residual:
                return codec.distances(q, codes, name)
            c = coarse.centroid(list_no)
            return codec.distances(q, codes, "ip") + (q @ c)[:, None] if name == "ip" else codec.distances(q - c, codes, name)

        return run

    def larger_is_better(self) -> bool:
        return self.codec.larger_is_better(self.name)

    def chosen(self, queries: DataFrame, nprobe: int, max_codes: int | None = None) -> DataFrame:
        """The lists that a search of ``queries`` scans."""
        found = self.coarse.probes((queries if self.independent else self.moved(queries)).toDF("qid", "qv"), nprobe)
        return found if max_codes is None else ivf.limited_probes(found, self.blocks, max_codes)

    def _hits(self, q: DataFrame, kernel, chosen: DataFrame | None) -> DataFrame:
        """``kernel(query ids, ids, distances)`` over all tiles of the search."""
        distances, codec, width = self._distances(), self.codec, self.width
        if chosen is not None:
            return ivf.list_tiles(q, chosen, self.blocks, lambda qids, x, ids, c, n: kernel(qids, ids, distances(x, c, n)), HITS, codec, width)
        return tiles(q, self.codes.select("id", "code"), lambda qids, x, ids, raw: kernel(qids, ids, distances(x, codec.from_bytes(raw, len(ids), width), 0)), HITS)

    def search(self, queries: DataFrame, k: int, nprobe: int = 1, ef: int = 64, k_factor: float = 4, max_codes: int | None = None) -> DataFrame:
        """The k nearest rows of ``(qid, qv)``."""
        q = self.moved(queries).toDF("qid", "qv")
        wide = int(k * k_factor) if self.spec.refine else k
        if isinstance(self.codec, additive.TwoStage):
            self = replace(self, codec=replace(self.codec, keep=int(max(1, k_factor) * wide)))
        if self.graphs is not None:
            out = graph.hits(graph.search(q, self.graphs, graph.Walk(k=wide, ef=max(ef, wide))), wide, self.name)
        else:
            larger = self.larger_is_better()
            out = top(self._hits(q, lambda qids, ids, d: codecs.best_of_tile(qids, ids, d, wide, larger), self.chosen(queries, nprobe, max_codes) if self.coarse else None), wide, larger)
        if self.copies is not None:
            out = merge.expand_duplicates(out, self.copies, wide)
        if self.spec.refine:
            out = codecs.refined(out, queries.toDF("qid", "qv"), self.refining(), k, self.name)
        return out

    def range_search(self, queries: DataFrame, radius: float, nprobe: int = 1) -> DataFrame:
        """``(qid, id, dist)`` strictly within the radius, by the codes' distances."""
        if self.graphs is not None:
            found = graph.search(self.moved(queries).toDF("qid", "qv"), self.graphs, graph.Walk(k=10, ef=64, radius=radius))
            return found.select("qid", F.explode(F.arrays_zip("ids", "dists")).alias("h")).select("qid", F.col("h.ids").alias("id"), F.col("h.dists").alias("dist"))
        larger = self.larger_is_better()

        def kernel(qids, ids, d):
            import numpy as np

            i, j = np.nonzero(d > radius if larger else d < radius)
            return {"qid": qids[i], "id": ids[j], "dist": d[i, j]}

        out = self._hits(self.moved(queries).toDF("qid", "qv"), kernel, self.chosen(queries, nprobe) if self.coarse else None)
        if self.copies is not None:
            g = self.copies.toDF("representative", "copy")
            out = out.join(g, out["id"] == g["representative"]).select("qid", F.col("copy").alias("id"), "dist")
        return out

    def refining(self) -> DataFrame:
        """``(id, embedding)`` by which hits are ranked again."""
        if self.refine_codes is None:
            return self.base
        return Index(self.spec, self.name, [], self.refine_codec, _elements(self.refine_codec, self.refine_codes), codes=self.refine_codes).kept()

    def searched_codes(self, result: DataFrame) -> DataFrame:
        """A result with the list and the code of each hit."""
        return result.join(self.codes, "id")

    def add(self, vectors: DataFrame) -> Index:
        """The index with more rows; what was trained stays."""
        if self.graphs is not None or self.copies is not None:
            raise ValueError(f"{self.spec} takes no more rows")
        rows = vectors.toDF("id", "embedding")
        new = materialize(self.coded(rows if self.independent else self.moved(rows)), "codes")
        out = replace(self, codes=self.codes.unionByName(new))
        if self.blocks is not None:
            out.blocks = self.blocks.unionByName(materialize(ivf.list_blocks(new, "code"), "blocks"))
        if self.refine_codes is not None:
            out.refine_codes = self.refine_codes.unionByName(materialize(replace(self, codec=self.refine_codec, coarse=None, residual=False, independent=False).coded(rows), "refine"))
        if self.base is not None:
            out.base = self.base.unionByName(rows)
        return out

    def remove(self, ids: DataFrame) -> Index:
        """The index without the rows whose ``id`` is in ``ids``."""
        if self.graphs is not None or self.copies is not None:
            raise ValueError(f"rows of {self.spec} can't be removed")
        gone = ids.select("id").distinct()
        left = lambda rows: None if rows is None else materialize(rows.join(gone, "id", "left_anti").select(rows.columns), "left")
        out = replace(self, codes=left(self.codes), refine_codes=left(self.refine_codes), base=left(self.base))
        out.blocks = materialize(ivf.list_blocks(out.codes, "code"), "blocks") if self.blocks is not None else None
        return out

    def update(self, vectors: DataFrame) -> Index:
        """The index with new vectors for ids that it has, or may have."""
        rows = vectors.toDF("id", "embedding")
        return self.remove(rows).add(rows)

    def merge_from(self, other: Index, shift: int = 0) -> Index:
        """The rows of an index that was trained alike, their ids shifted."""
        if str(other.spec) != str(self.spec) or _meta(other) != _meta(self):
            raise ValueError("only indexes of one training merge")
        both = lambda x, y: None if x is None else x.unionByName(y.withColumn("id", F.col("id") + shift))
        out = replace(self, codes=both(self.codes, other.codes), refine_codes=both(self.refine_codes, other.refine_codes), base=both(self.base, other.base))
        if self.blocks is not None:
            out.blocks = self.blocks.unionByName(other.blocks.withColumn("ids", F.transform("ids", lambda i: i + shift)))
        return out

    def empty(self) -> Index:
        """What was trained, without rows."""
        none = lambda x: None if x is None else x.limit(0)
        return replace(self, codes=none(self.codes), blocks=none(self.blocks), refine_codes=none(self.refine_codes), base=none(self.base))

    def save(self, path: str) -> None:
        """Write the index to a folder: what was trained, and its tables."""
        spark = next(x for x in (self.codes, self.graphs) if x is not None).sparkSession
        spark.createDataFrame([(bytearray(_meta(self)),)], "trained binary").write.parquet(f"{path}/trained")
        for name in TABLES:
            if (rows := getattr(self, name)) is not None:
                rows.write.parquet(f"{path}/{name}")


#: The tables of an index.
TABLES = ("codes", "blocks", "graphs", "copies", "refine_codes", "base")


def _meta(index: Index) -> bytes:
    from pyspark import cloudpickle

    return cloudpickle.dumps((index.spec, index.name, index.transforms, index.codec, index.width, index.coarse, index.residual, index.independent, index.refine_codec, tuple(n for n in TABLES if getattr(index, n) is not None)))


def load(spark: SparkSession, path: str) -> Index:
    """An index that ``save`` wrote. What was trained is unpickled, so load only
    folders that you trust."""
    from pyspark import cloudpickle

    spec, name, transforms, codec, width, coarse, residual, independent, refine, tables = cloudpickle.loads(bytes(spark.read.parquet(f"{path}/trained").first().trained))
    return Index(spec, name, transforms, codec, width, coarse, residual, independent, refine_codec=refine, **{n: spark.read.parquet(f"{path}/{n}") for n in tables})


def _elements(codec: codecs.RowCodec, codes: DataFrame) -> int:
    """How many elements a code has: those of its bytes, or as many as the codec
    itself knows."""
    if isinstance(codec, codecs.ProductQuantizer | codecs.ResidualQuantizer):
        return len(codec.books)
    if hasattr(codec, "width"):
        return codec.width
    if isinstance(codec, codecs.ScalarRows):
        return len(codec.of.low)
    if isinstance(codec, codecs.RaBitQ):
        return len(codec.center) + 3
    first = codes.first()
    return 0 if first is None else len(first.code) * 8 // (codec.bits or 64)


def _codec_of(step: Step, v) -> codecs.RowCodec:
    """The codec of a step, trained on a matrix."""
    import numpy as np

    o = step.options
    if step.kind in ("Flat", "FlatDedup"):
        return codecs.RowCodec()
    if step.kind == "SQ":
        return codecs.Half(o["type"]) if o["type"] in ("fp16", "bf16") else codecs.ScalarRows.train_on(v, int(o["type"]))
    if step.kind == "PQ":
        return codecs.ProductQuantizer.train_on(v, o["m"], o["bits"])
    if step.kind == "RQ":
        return codecs.ResidualQuantizer.train_on(v, o["m"], o["bits"])
    if step.kind == "LSQ":
        return codecs.ResidualQuantizer.train_local_search(v, o["m"], o["bits"])
    if step.kind == "RaBitQ":
        return codecs.RaBitQ.train_on(v, o["bits"])
    if step.kind == "LSH":
        rotation = codecs.random_rotation(v.shape[1], v.shape[1]) if "r" in o["flags"] else None
        return codecs.Signs(np.median(rotation(v) if rotation else v, axis=0) if "t" in o["flags"] else None, rotation)
    if step.kind in ("PRQ", "PLSQ"):
        return additive.ProductAdditive.train_on(v, o["slices"], o["m"], o["bits"], step.kind == "PLSQ")
    if step.kind == "PQ+":
        return additive.TwoStage.train_on(v, o["m"], o["refine"], o["bits"])
    if step.kind == "SQtqmse":
        return levels.FixedLevels(v.shape[1], o["bits"])
    if step.kind == "SQ0":
        return levels.ZeroBits(v.shape[1])
    raise ValueError(f"{step.kind} is no codec")


def _spectral(step: Step, v, coarse: Centroids, rows: DataFrame) -> levels.SpectralHash:
    """Signs of waves along the projections that a step names."""
    o, width = step.options, v.shape[1]
    d = o["d"] or width
    project = {"ITQ": lambda: codecs.itq(rows, d), "PCA": lambda: codecs.pca(rows, d), "PCAR": lambda: codecs.pca(rows, d, 0.0, True)}.get(o["by"], lambda: codecs.random_rotation(width, d))()
    return levels.SpectralHash.train_on(v, coarse.assign(v), coarse.matrix, project, o["period"], o["flag"])


def _transform(step: Step, rows: DataFrame):
    width = len(rows.first().embedding)
    d = step.options["d"] or width
    if step.kind.startswith("PCA"):
        return codecs.pca(rows, d, -0.5 if "W" in step.kind else 0.0, step.kind.endswith("R"))
    if step.kind == "OPQ":  # OPQm_d: principal components first, if d is less
        first = codecs.pca(rows, step.options["out"]) if (step.options["out"] or width) < width else None
        r = codecs.opq(codecs.mapped(rows, first) if first else rows, d)
        return codecs.Linear(r.a @ first.a, r.a @ first.b) if first else r
    return {"ITQ": lambda: codecs.itq(rows, d), "RR": lambda: codecs.random_rotation(width, d), "HR": lambda: codecs.hadamard_rotation(width), "Pad": lambda: _padded(d), "L2norm": lambda: _unit}[step.kind]()


def build(base: DataFrame, text: str, name: str = "l2", independent: bool = False) -> Index:
    """Train and fill the index that ``text`` names over ``(id, embedding)``.
    Strings that name what isn't built are a ValueError. With ``independent``,
    lists are made of the vectors before the transforms."""
    spec = parse(text)
    kind = spec.codec.kind
    if independent and (not spec.coarse or kind == "FlatDedup"):
        raise ValueError(f"{text!r} has no lists that could be independent")
    if kind == "RaBitQ" and name not in ("l2", "ip"):
        raise ValueError(f"no estimates of {name}")
    given = base.toDF("id", "embedding")
    spark, rows = base.sparkSession, given
    index = Index(spec, name, [])
    for t in spec.transforms:
        index.transforms.append(_transform(t, rows))
        rows = codecs.mapped(rows, index.transforms[-1])
    if spec.refine and spec.refine.kind == "Flat":
        index.base = given
    elif spec.refine:
        index.refine_codec = _codec_of(spec.refine, codecs.sample(given))
        index.refine_codes = materialize(replace(index, codec=index.refine_codec).coded(given), "refine")
    if kind in ("HNSW", "NSG"):
        storage = spec.codec.options.get("storage")
        if storage:  # the graph is over what the codec keeps
            rows = build(rows, storage, name).kept()
        m = spec.codec.options["m"]
        index.graphs = materialize(graph.build(rows, name, max(2, m // 2), max(64, 2 * m), nsg=kind == "NSG"), "graphs")
        return index
    if kind == "FlatDedup":
        index.copies = materialize(merge.duplicate_groups(rows), "copies")
        rows = rows.join(index.copies.select(F.col("representative").alias("id")).distinct(), "id").select("id", "embedding")
    v = codecs.sample(rows)
    if spec.coarse:
        index.coarse, index.independent = _coarse_of(spec.coarse, given if independent else rows, name, spark), independent
        index.residual = not independent and name in ("l2", "ip") and kind in ("PQ", "RQ", "LSQ", "SQ", "RaBitQ", "LSH", "PRQ", "PLSQ", "PQ+", "SQtqmse", "SQ0") and spec.codec.options.get("type") not in ("fp16", "bf16")
        v = v - index.coarse.centroid(index.coarse.assign(v)) if index.residual else v
    index.codec = _spectral(spec.codec, v, index.coarse, rows) if kind == "SH" else _codec_of(spec.codec, v)
    index.codes = materialize(index.coded(given if independent else rows), "codes")
    index.width = _elements(index.codec, index.codes)
    if spec.coarse:
        index.blocks = materialize(ivf.list_blocks(index.codes, "code"), "blocks")
    return index


def _centroids(rows: DataFrame, n: int):
    """n centroids, trained on the codecs' sample while that has enough rows for
    each, else on all rows."""
    if n * cluster.POINTS_PER_CENTROID <= codecs.TRAIN_ROWS:
        return codecs.lloyd(codecs.sample(rows), n, 10, 1234)
    return cluster.kmeans(rows, cluster.KMeans(n, 10, init="hash"))[0]


def _coarse_of(step: Step, rows: DataFrame, name: str, spark: SparkSession) -> Centroids | Cells:
    n = step.options["n"]
    if step.kind == "IMI2x":
        d = len(rows.first().embedding) // 2
        half = lambda a, b: _centroids(rows.select("id", F.expr(f"slice(embedding, {a + 1}, {b})").alias("embedding")), 1 << n)
        return Cells([half(0, d), half(d, 1 << 20)], name)
    c = _centroids(rows, n)
    out = Centroids(c, name)
    if "m" in step.options:
        m = step.options["m"] or 32
        frame = cluster.centroid_frame(spark, c).select(F.col("list_no").cast("long").alias("id"), F.col("centroid").alias("embedding"))
        out.graph = graph.build(frame, name, max(2, m // 2), max(64, 2 * m), shards=1).collect()
    return out


def _unit(v):
    import numpy as np

    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n > 0, n, 1)


def _padded(d: int):
    def f(v):
        import numpy as np

        return np.pad(v, ((0, 0), (0, d - v.shape[1])))

    return f
