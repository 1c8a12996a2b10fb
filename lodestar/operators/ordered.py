"""What windows over all rows in order would say, without one task that holds
them: rows are range-partitioned, each partition adds up its own, and sums over
the partitions, of which there are few, tell what lies before each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.sources.shared import materialize

AGGREGATES = {"sum": F.sum, "min": F.min, "max": F.max}


def running(rows: DataFrame, order: Sequence[Column | str], what: dict[str, tuple[str, Column]], including: bool = False) -> DataFrame:
    """``rows`` with running aggregates in an order: ``what`` has the new columns'
    names, each with "sum", "min" or "max" and what is aggregated over the rows
    before (and at, if ``including``) each row. A sum over none is 0, others are
    null. The order should tell all rows apart, else that of equal ones is open."""
    columns = {n: F.col(n) for n in rows.columns}
    marked = rows.withColumns({f"_in_{n}": c for n, (_, c) in what.items()})
    ordered = [F.col(o) if isinstance(o, str) else o for o in order]
    parts = marked.repartitionByRange(*ordered).withColumn("_part", F.spark_partition_id())
    parts = materialize(parts, "parts")  # bounds are sampled: once
    totals = parts.groupBy("_part").agg(*(AGGREGATES[kind](f"_in_{n}").alias(f"_all_{n}") for n, (kind, _) in what.items()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_part", *(AGGREGATES[kind](f"_all_{n}").over(earlier).alias(f"_before_{n}") for n, (kind, _) in what.items()))
    within = Window.partitionBy("_part").orderBy(*ordered).rowsBetween(Window.unboundedPreceding, 0 if including else -1)
    own = parts.withColumns({f"_own_{n}": AGGREGATES[kind](f"_in_{n}").over(within) for n, (kind, _) in what.items()})

    def both(n: str, kind: str) -> Column:
        a, b = F.col(f"_before_{n}"), F.col(f"_own_{n}")
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)) if kind == "sum" else F.least(a, b) if kind == "min" else F.greatest(a, b)

    return own.join(F.broadcast(before), "_part").select(*columns.values(), *(both(n, kind).alias(n) for n, (kind, _) in what.items()))


def numbered(rows: DataFrame, order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """``rows`` with their numbers in an order, from 1."""
    return running(rows, order, {name: ("sum", F.lit(1).cast("long"))}, including=True)
