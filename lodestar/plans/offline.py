"""An index over a base that comes in shards, as steps that write what the next
one reads: statistics, duplicates, training, shards, merge, search, refinement,
evaluation. A step whose table is there isn't run again, so a run that broke off
goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import vectors
from lodestar.operators import codecs, evaluate, knn, merge
from lodestar.plans import factory

STEPS = ("stats", "copies", "unique", "trained", "shards", "index", "hits", "refined", "scores")


def there(spark: SparkSession, path: str) -> bool:
    """Whether a step has ended: its last file says so."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def step(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, made first if there is none that is whole."""
    if not there(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _index(spark: SparkSession, path: str, make: Callable[[], factory.Index]) -> factory.Index:
    try:
        if there(spark, f"{path}/done"):
            return factory.load(spark, path)
    except AnalysisException:
        pass
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)  # of a run that broke off
    make().save(path)
    spark.range(1).write.parquet(f"{path}/done")
    return factory.load(spark, path)


def run(base: DataFrame, queries: DataFrame, text: str, path: str, shards: int = 4, k: int = 10, nprobe: int = 16, k_factor: float = 4, name: str = "l2") -> dict[str, DataFrame]:
    """The tables by step. ``base`` is (id, embedding); equal vectors are indexed
    once and come back as hits of all their ids; the index is trained once, each
    shard is filled into a copy of it, and the copies are merged."""
    spark, rows = base.sparkSession, base.toDF("id", "embedding")
    if factory.parse(text).refine:
        raise ValueError("the refinement is a step of its own")
    out = {"stats": step(spark, f"{path}/stats", lambda: vectors.matrix_stats(rows))}
    out["copies"] = step(spark, f"{path}/copies", lambda: merge.duplicate_groups(rows))
    firsts = out["copies"].select(F.col("representative").alias("id")).distinct()
    out["unique"] = unique = step(spark, f"{path}/unique", lambda: rows.join(firsts, "id", "left_semi"))
    trained = _index(spark, f"{path}/trained", lambda: factory.build(codecs_sample(unique), text, name).empty())
    parts = [_index(spark, f"{path}/shards/{i}", lambda i=i: trained.add(unique.where(F.pmod(F.xxhash64("id"), F.lit(shards)) == i))) for i in range(shards)]

    def merged():
        index = parts[0]
        for p in parts[1:]:
            index = index.merge_from(p)
        return index

    index = _index(spark, f"{path}/index", merged)
    wide = int(k * k_factor)
    out["hits"] = step(spark, f"{path}/hits", lambda: merge.expand_duplicates(index.search(queries, wide, nprobe=nprobe), out["copies"], wide))
    out["refined"] = step(spark, f"{path}/refined", lambda: codecs.refined(out["hits"], queries, rows, k, name))
    truth = step(spark, f"{path}/truth", lambda: knn.knn(queries, rows, k, name))
    out["scores"] = step(spark, f"{path}/scores", lambda: evaluate.recall(out["refined"], truth, k))
    return out


def codecs_sample(rows: DataFrame, n: int = codecs.TRAIN_ROWS) -> DataFrame:
    """The rows that an index is trained on: the n of least hash."""
    return rows.orderBy(F.xxhash64("id", F.lit(42)), "id").limit(n)
