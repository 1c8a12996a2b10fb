"""Where queries register, and what several of them read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Register a function as a query, with its SQL if it has one."""
    def register(f):
        n = name or f.__name__
        QUERIES[n] = f
        if sql is not None:
            ORACLE_SQL[n] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base_of(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", *more)


def queries_of(base: DataFrame) -> DataFrame:
    return base.where(F.col("id") % 100 == 0).select(F.col("id").alias("qid"), F.col("embedding").alias("qv"))


# --- SQL that several oracles share ---

#: The element-wise sum of an expression over z[1] (query) and z[2] (base).
def sql_sum(expression: str, x: str = "q.v", y: str = "b.v") -> str:
    return f"list_sum([{expression} for z in list_zip({x}, {y})])"


L2 = sql_sum("(z[1] - z[2]) * (z[1] - z[2])")

VECTORS = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), q AS (SELECT id AS qid, v, label FROM v WHERE id % 100 = 0)"


def sql_hits(distance: str = L2, where: str = "b.id <> q.qid", vectors: str = VECTORS) -> str:
    """CTEs down to ``h``: all distances of the query set to the base."""
    return f"WITH {vectors}, h AS (SELECT q.qid, b.id, b.label, {distance} AS dist FROM q JOIN v b ON {where})"


def sql_top(k: int = 10, descending: bool = False, source: str = "h") -> str:
    """A CTE ``r``: the best k of each query."""
    return f"r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY isnan(dist), dist {'DESC' if descending else 'ASC'}, id)::INT AS rank FROM {source}) WHERE rank <= {k})"


RESULT = "SELECT qid, rank, id, round(dist, 5) AS dist FROM r"


def result(df: DataFrame) -> DataFrame:
    """A result as queries return it: distances to five digits."""
    return df.select("qid", "rank", "id", F.round("dist", 5).alias("dist"))
