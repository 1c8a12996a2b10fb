"""Streams of vectors into a base table, a window of its newest slices, and
searches of arriving queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql import functions as F

from lodestar.operators import ivf, knn


def append(stream: DataFrame, path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Append each batch to the table at ``path`` as a slice numbered by the
    batch. A batch that runs again overwrites its own slice, so that each row is
    there once."""
    def write(batch: DataFrame, number: int) -> None:
        rows = prepare(batch) if prepare else batch
        rows.write.mode("overwrite").parquet(f"{path}/slice_id={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest(base: DataFrame, id: str = "id") -> DataFrame:
    """The newest row of each id of a table that grows by slices."""
    newest = base.groupBy(id).agg(F.max("slice_id").alias("slice_id"))
    return base.join(newest, [id, "slice_id"], "left_semi")


def newest(base: DataFrame, slices: int) -> DataFrame:
    return ivf.window(base, slices)


def searched(stream: DataFrame, base: DataFrame, k: int, path: str, checkpoint: str, name: str = "l2", trigger: dict | None = None) -> StreamingQuery:
    """Search each batch of queries ``(qid, qv)`` in a base and append the
    results as slices."""
    def write(batch: DataFrame, number: int) -> None:
        knn.knn(batch, base, k, name).write.mode("overwrite").parquet(f"{path}/slice_id={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
