"""What an index is made of, as tables: its projections, centroids, books, lists and
codes. Vectors put together again from these tables are those that the index keeps.

Projections, centroids and books are of the size that training bounds; lists and
codes are as many as rows, and stay where they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators import cluster
from lodestar.operators.codecs import Linear, ProductQuantizer
from lodestar.plans.factory import Centroids, Index


def projections(index: Index) -> DataFrame:
    """``(step, row, weights, added)`` of the linear transforms, in their order."""
    rows = [
        (step, i, [float(x) for x in weights], 0.0 if t.b is None else float(t.b[i]))
        for step, t in enumerate(index.transforms) if isinstance(t, Linear)
        for i, weights in enumerate(t.a)
    ]
    return index.codes.sparkSession.createDataFrame(rows, "step int, row int, weights array<double>, added double")


def centroids(index: Index) -> DataFrame:
    """``(list_no, centroid)``; none without lists."""
    spark = index.codes.sparkSession
    if not isinstance(index.coarse, Centroids):
        return spark.createDataFrame([], "list_no int, centroid array<double>")
    return cluster.centroid_frame(spark, index.coarse.matrix).toDF("list_no", "centroid")


def books(index: Index) -> DataFrame:
    """``(slice, code, entry)`` of product codes; none of other codecs."""
    found = index.codec.books if isinstance(index.codec, ProductQuantizer) else []
    rows = [(s, c, [float(x) for x in entry]) for s, book in enumerate(found) for c, entry in enumerate(book)]
    return index.codes.sparkSession.createDataFrame(rows, "slice int, code int, entry array<double>")


def lists(index: Index) -> DataFrame:
    """``(list_no, n, bytes)`` of all lists, those without rows too."""
    full = index.codes.groupBy("list_no").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("code")).alias("bytes"))
    known = centroids(index).select("list_no")
    return full.join(known, "list_no", "full").select("list_no", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def codes(index: Index) -> DataFrame:
    """``(id, list_no, codes)``, a number for each element of a row's code."""
    codec, width = index.codec, index.width
    shared = index.codes.sparkSession.sparkContext.broadcast(codec)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                numbers = shared.value.from_bytes(b"".join(batch.column(2).to_pylist()), batch.num_rows, width)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(numbers.astype(float)), pa.list_(pa.float64()))], names=["id", "list_no", "codes"])

    return index.codes.select("id", "list_no", "code").mapInArrow(run, "id long, list_no int, codes array<double>")


def together(index: Index) -> DataFrame:
    """``(id, embedding)`` from the tables of product codes by joins, in the space of
    the projections: each slice's entry, one after the other, and the centroid."""
    if not isinstance(index.codec, ProductQuantizer):
        raise ValueError("only product codes are put together from tables")
    one = codes(index).select("id", "list_no", F.posexplode("codes").alias("slice", "code")).withColumn("code", F.col("code").cast("int"))
    parts = one.join(F.broadcast(books(index)), ["slice", "code"])  # slices x codes, as training bounds them
    rows = parts.groupBy("id", "list_no").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("slice", "entry"))), lambda p: p["entry"])).alias("v"))
    if not index.residual:
        return rows.select("id", F.col("v").alias("embedding"))
    return rows.join(centroids(index), "list_no").select("id", F.zip_with("v", "centroid", lambda a, b: a + b).alias("embedding"))
