"""Every query against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestar.plans.catalog import ORACLE_SQL, QUERIES
from lodestar.sources.shared import clear
from tests.conftest import SMALL

@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rows(df):
    return sorted(map(str, df[sorted(df.columns)].astype(object).to_dict("split")["data"]))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, db, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), db.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    clear(spark)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", ["diverse_knn", "multi_vector_documents"])
def test_null_labels_are_a_group(spark, tmp_path, name):
    # every third vector has no label, and two labels differ beyond what doubles carry
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 3 == 0, None).when(F.col("vec_id") % 3 == 1, 2**53 + F.col("vec_id") % 2).otherwise(F.col("label"))
    e.withColumn("label", label.cast("long")).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    columns = ["qid", "rank", "id", "dist"]
    want = [tuple(None if v != v else v for v in r) for r in con.sql(ORACLE_SQL[name]).fetchall()]
    got = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select(columns).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert name == "diverse_knn" or any(r[2] is None for r in want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
