"""Datasets as frames: base, queries, training rows and ground truth."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.metrics import space_of
from lodestar.operators.knn import knn
from lodestar.sources.vecs import read_vectors


@dataclass(frozen=True)
class Dataset:
    """``base`` and ``train`` are (id, embedding), ``queries`` is (qid, qv), the
    truth is a result, computed where there is none."""

    name: str
    base: DataFrame
    queries: DataFrame
    train: DataFrame | None = None
    truth: DataFrame | None = None

    @property
    def space(self) -> str:
        return space_of(self.name)

    def ground_truth(self, k: int = 10) -> DataFrame:
        return self.truth if self.truth is not None else knn(self.queries, self.base, k, {"ip": "ip_distance"}.get(self.space, self.space))

    def parts(self, n: int, i: int) -> DataFrame:
        """The i-th of n parts of the base, by ids' remainders."""
        return self.base.where(F.pmod("id", F.lit(n)) == i)


#: Files of a dataset in its folder, by what they hold.
LAYOUTS = {
    "vecs": {"base": "{name}_base.fvecs", "queries": "{name}_query.fvecs", "train": "{name}_learn.fvecs", "truth": "{name}_groundtruth.ivecs"},
    "bin": {"base": "base.{name}.fbin", "queries": "query.{name}.fbin", "truth": "truth.{name}.ibin"},
    "parquet": {"base": "{name}_base.parquet", "queries": "{name}_query.parquet", "train": "{name}_learn.parquet", "truth": "{name}_truth.parquet"},
}


def load(spark: SparkSession, folder: str, name: str, layout: str = "vecs", has: tuple[str, ...] = ("base", "queries")) -> Dataset:
    """A dataset by name; ``has`` are the files that exist beside it."""
    read = {}
    for part in has:
        path = f"{folder.rstrip('/')}/{LAYOUTS[layout][part].format(name=name)}"
        read[part] = spark.read.parquet(path) if layout == "parquet" else read_vectors(spark, path)
    truth = read.get("truth")
    if truth is not None and layout != "parquet":
        truth = truth.select(F.col("id").alias("qid"), F.posexplode("embedding").alias("pos", "x")).select("qid", (F.col("pos") + 1).alias("rank"), F.col("x").cast("long").alias("id"), F.lit(None).cast("double").alias("dist"))
    return Dataset(name, read["base"], read["queries"].toDF("qid", "qv"), read.get("train"), truth)


def save(d: Dataset, folder: str) -> None:
    """Write a dataset's tables where ``load`` finds them by the Parquet layout."""
    for part in ("base", "queries", "train", "truth"):
        if (rows := getattr(d, part)) is not None:
            rows.write.parquet(f"{folder.rstrip('/')}/{LAYOUTS['parquet'][part].format(name=d.name)}")


def load_hdf5(spark: SparkSession, path: str, name: str) -> Dataset:
    """A dataset in an HDF5 file with ``train`` (the base), ``test`` (the queries)
    and, if it is there, ``neighbors`` (ids by query). Executors read ranges of
    rows, so the file has to be in a folder that all of them have; h5py has to be
    installed."""
    try:
        import h5py
    except ImportError as e:
        raise ImportError("HDF5 files need h5py; the Parquet layout needs nothing more") from e
    with h5py.File(path, "r") as f:
        shapes = {k: f[k].shape for k in ("train", "test", "neighbors") if k in f}

    def table(key: str, kind: str):
        def read(batches):
            import h5py
            import numpy as np
            import pyarrow as pa

            with h5py.File(path, "r") as f:
                for batch in batches:
                    for start in batch.column(0).to_pylist():
                        m = f[key][start : start + 4096]
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + len(m))), pa.array(list(m), pa.list_(pa.float32() if kind == "float" else pa.int64()))], names=["id", "embedding"])

        return spark.range(0, shapes[key][0], 4096).mapInArrow(read, f"id long, embedding array<{kind}>")

    truth = None
    if "neighbors" in shapes:
        truth = table("neighbors", "bigint").select(F.col("id").alias("qid"), F.posexplode("embedding").alias("pos", "x"))
        truth = truth.select("qid", (F.col("pos") + 1).alias("rank"), F.col("x").alias("id"), F.lit(None).cast("double").alias("dist"))
    return Dataset(name, table("train", "float"), table("test", "float").toDF("qid", "qv"), truth=truth)


def synthetic(spark: SparkSession, d: int, n_base: int, n_queries: int, n_train: int = 0, seed: int = 1338, latent: int = 10) -> Dataset:
    """Points on a sine-warped low-dimensional surface. Each row depends only on
    the seed and its number, so executors make them without a driver's matrix."""
    def rows(first: int, n: int) -> DataFrame:
        def make(batches):
            import numpy as np
            import pyarrow as pa

            fixed = np.random.default_rng(seed)
            to, wide = fixed.random((latent, d)), 4 * fixed.random(d) + 0.1
            for batch in batches:
                ids = batch.column(0).to_pylist()
                x = np.stack([np.random.default_rng((seed, i)).normal(size=latent) for i in ids]) if ids else np.zeros((0, latent))
                v = np.sin((x @ to) * wide).astype(np.float32)
                yield pa.RecordBatch.from_pydict({"id": [i - first for i in ids], "embedding": list(v)}, pa.schema([("id", pa.int64()), ("embedding", pa.list_(pa.float32()))]))

        return spark.range(first, first + n).mapInArrow(make, "id long, embedding array<float>")

    base = rows(0, n_base)
    return Dataset(f"synthetic{d}", base, rows(n_base, n_queries).toDF("qid", "qv"), rows(n_base + n_queries, n_train) if n_train else None)


def embeddings(spark: SparkSession, sf_dir: str) -> Dataset:
    """The embeddings table: queries are the rows whose id is divisible by 100."""
    base = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    return Dataset("embeddings-cosine", base, base.where(F.col("id") % 100 == 0).toDF("qid", "qv"))


def query_subset(vectors: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    return vectors.join(ids.select(id).distinct(), id, "left_semi")


def index_path(root: str, dataset: str, index: str, **settings) -> str:
    """Where an index of a dataset lies: the same settings, the same path."""
    safe = lambda x: re.sub(r"[^A-Za-z0-9._-]+", "_", str(x))
    name = "-".join([safe(index), *(f"{k}{safe(v)}" for k, v in sorted(settings.items()))])
    return f"{root.rstrip('/')}/{safe(dataset)}/{name}"


def write_summary(rows: DataFrame, path: str, order: list[str], digits: int = 4) -> None:
    """A summary table, of a few rows, as ``summary.csv`` and ``summary.md``."""
    ordered = rows.orderBy(*order)
    ordered.coalesce(1).write.mode("overwrite").csv(f"{path}/summary.csv", header=True)
    shown = lambda x: "" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x).replace("|", "\\|")
    lines = [f"| {' | '.join(rows.columns)} |", "|" + "---|" * len(rows.columns)] + [f"| {' | '.join(map(shown, r))} |" for r in ordered.collect()]
    spark = rows.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/summary.md")
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(("\n".join(lines) + "\n").encode())
    finally:
        out.close()


def replace_rows(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A CSV table with the rows of ``rows`` in place of those with their keys,
    sorted; writes a new table at the path and returns it."""
    from lodestar.sources.shared import materialize

    old = spark.read.schema(rows.schema).csv(path, header=True).join(rows.select(*keys).distinct(), keys, "left_anti")
    new = materialize(old.unionByName(rows), "rows")  # apart from the files that are about to go
    new.orderBy(*order).coalesce(1).write.mode("overwrite").csv(path, header=True)
    return spark.read.schema(rows.schema).csv(path, header=True)
