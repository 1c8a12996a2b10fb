"""What several operators of this subpackage need: Arrow-batched maps, written
tables, and connected components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from lodestar.sources.shared import materialize, settled

__all__ = ["arrow_map", "connected_components", "digest128", "free_name", "materialize", "settled"]


def arrow_map(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str | StructType, rows: int = 512) -> DataFrame:
    """Map ``df`` in Python over Arrow batches.

    ``make`` is called once in each task and returns a function from a dict of
    column lists (at most ``rows`` rows) to a dict of column lists."""
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches):
        import pyarrow as pa

        f = None
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                f = f or make()
                out = f({n: c.to_pylist() for n, c in zip(part.schema.names, part.columns)})
                yield pa.RecordBatch.from_pydict({n: out[n] for n in arrow.names}, schema=arrow)

    return df.mapInArrow(run, kind)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def digest128(value: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a column under different seeds: 128 bits."""
    return F.xxhash64(value), F.xxhash64(F.lit("second"), value)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Components of an undirected graph by alternating large and small stars.

    ``edges`` has long columns ``a`` and ``b``; self-loops, repeated and
    reversed edges are allowed, rows with nulls are left out. Returns
    ``(id, component)`` for every id in an edge between two different ids; the
    component is its smallest id. Each half round is an aggregate with map-side
    combine and an equi-join of two written tables, whose hot keys adaptive
    execution splits; nothing goes to the driver but two checksums."""
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    e = materialize(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    def stars(e: DataFrame) -> DataFrame:
        both = e.unionAll(e.select(v.alias("u"), u.alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), u).alias("m")), "least")
        large = both.join(least, "u").where(v > u).select(v.alias("u"), m.alias("v")).where(u != v)
        large = materialize(large.distinct(), "large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where(v != m).select(v.alias("u"), m.alias("v"))
        return materialize(small.unionAll(least.select("u", m.alias("v"))).distinct(), "small")

    seen = mark(e)
    for _ in range(rounds):
        if not seen[0]:
            break
        e = stars(e)
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    roots = e.groupBy("v").agg(F.lit(1).alias("one")).select(v.alias("id"), v.alias("component"))
    return e.select(u.alias("id"), v.alias("component")).unionAll(roots)
