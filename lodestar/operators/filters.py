"""Selectors of rows by id, and the removal, hiding and replacement of rows.

A selector is a boolean column of an id column; selectors combine with ``&``,
``|``, ``~`` and ``!=`` (exclusive or). It goes into a ``where`` on the base
before a search, which pushes it down to the scan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_range(id: Column, low: int, high: int) -> Column:
    return (id >= low) & (id < high)


def in_list(id: Column, ids: Iterable[int]) -> Column:
    return id.isin(list(ids))


def in_bitmap(id: Column, bitmap: bytes) -> Column:
    """Bit i % 8 of byte i / 8; ids beyond the bitmap are out."""
    hexed = F.lit(bytes(bitmap).hex())
    byte = F.conv(F.substring(hexed, (F.floor(id / 8) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    inside = (id >= 0) & (id < 8 * len(bitmap))
    return inside & (F.coalesce(F.call_function("shiftright", byte, (id % 8).cast("int")), F.lit(0)) % 2 == 1)


def in_table(base: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    """The rows whose id is in another table: a selector of any size."""
    return base.join(ids.select(id).distinct(), id, "left_semi")


def translated(base: DataFrame, id_map: DataFrame, selected: DataFrame) -> DataFrame:
    """Rows by external ids: ``id_map`` is (id, external)."""
    return in_table(base, id_map.join(selected.toDF("external"), "external", "left_semi").select("id"))


def check_selector(selector: object) -> Column:
    if not isinstance(selector, Column):
        raise NotImplementedError(f"a selector is a boolean column, not {type(selector).__name__}")
    return selector


def removed(base: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    return base.join(ids.select(id).distinct(), id, "left_anti")


def renumbered(base: DataFrame, id: str = "id") -> DataFrame:
    """Ids 0, 1, 2, ... in the order of the old ones: what sequential ids become
    after rows went. Counts of key ranges give each range its first number."""
    from lodestar.sources.shared import materialize

    parts = materialize(base.repartitionByRange(id).withColumn("_part", F.spark_partition_id()), "parts")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = parts.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    number = F.row_number().over(Window.partitionBy("_part").orderBy(id)) - 1 + F.col("_first")
    return parts.join(first, "_part").withColumn(id, number.cast("long")).drop("_part", "_first")


def marked_deleted(base: DataFrame, ids: DataFrame, deleted: bool = True, id: str = "id") -> DataFrame:
    """Set the ``deleted`` flag of some ids. An id that is missing or has that
    flag already is an error, raised when the result is computed."""
    marks = ids.select(F.col(id).alias("_id")).distinct()
    flag = F.coalesce("deleted", F.lit(False))
    out = base.join(marks, base[id] == marks["_id"], "full") if "deleted" in base.columns else base.withColumn("deleted", F.lit(False)).join(marks, F.col(id) == F.col("_id"), "full")
    bad = F.col("_id").isNotNull() & (F.col(id).isNull() | (flag == deleted))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("can't mark id "), F.col("_id").cast("string"))).cast("boolean")).when(F.col("_id").isNotNull(), F.lit(deleted)).otherwise(flag)
    return out.withColumn("deleted", checked).drop("_id")


def upserted(base: DataFrame, rows: DataFrame, id: str = "id") -> DataFrame:
    """``rows`` in place of those of the base with their ids, or beside them."""
    return removed(base, rows.select(id), id).unionByName(rows)
