"""Searches run in blocks: query vectors and base vectors are packed into
matrices, and each pair of a query block and a base block is one row that a
NumPy kernel reduces on its own. Query blocks are broadcast while they are
small; beyond that groups of them meet chunks of base blocks in an equi-join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Rows of a packed block.
QUERY_ROWS, BASE_ROWS = 1024, 4096
#: Query blocks up to so many bytes are broadcast.
BROADCAST_BYTES = 64 << 20
#: Query blocks of a group, where queries are too large for a broadcast.
GROUP_BLOCKS = 64

PACKED = "ids binary, width int, vectors binary"


def unpack(ids: bytes, width: int, vectors: bytes):
    import numpy as np

    return np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, max(1, width))


def _pack(ids, vectors) -> dict:
    import numpy as np

    m = np.stack(vectors).astype(np.float64)
    return {"ids": np.asarray(ids, np.int64).tobytes(), "width": m.shape[1], "vectors": m.tobytes()}


def pack(vectors: DataFrame, rows: int = BASE_ROWS) -> DataFrame:
    """Packs ``(id, v)`` into blocks, within each partition and without a
    shuffle. Null vectors are left out; vectors of a block have one width. Codes,
    as bytes, are packed the same way, their width in bytes."""
    schema = to_arrow_schema(_parse_datatype_string(PACKED))
    coded = vectors.dtypes[1][1] == "binary"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held: dict[int, tuple[list, list]] = {}
        emit = lambda part: pa.RecordBatch.from_pylist([_joined(*part) if coded else _pack(*part)], schema=schema)
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                if i is None or not v.is_valid:
                    continue
                v = v.as_py() if coded else np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
                ids, part = held.setdefault(len(v), ([], []))
                ids.append(i)
                part.append(v)
                if len(ids) == rows:
                    yield emit(held.pop(len(v)))
        for part in held.values():
            yield emit(part)

    return vectors.toDF("id", "v").mapInArrow(run, PACKED)


def _joined(ids, codes) -> dict:
    import numpy as np

    return {"ids": np.asarray(ids, np.int64).tobytes(), "width": len(codes[0]), "vectors": b"".join(codes)}


def query_blocks(queries: DataFrame, rows: int = QUERY_ROWS) -> tuple[DataFrame, int, bool]:
    """``(id, v)`` in blocks with a number, how many there are, and whether they
    are small enough for a broadcast."""
    q = queries.toDF("id", "v").where(F.col("v").isNotNull() & F.col("id").isNotNull())
    n, size = q.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("v") * 8 + 8), F.lit(0))).first()
    blocks = max(1, -(-n // rows))

    def make(pdf):
        import pandas as pd

        out = []
        for _, part in pdf.groupby(pdf["v"].str.len()):
            out.append(_pack(part["id"].to_numpy(), part["v"].to_list()) | {"q": pdf["q"].iloc[0]})
        return pd.DataFrame(out)[["q", "ids", "width", "vectors"]]

    dealt = q.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("q"), "id", F.col("v").cast("array<double>").alias("v"))
    return dealt.groupBy("q").applyInPandas(make, f"q int, {PACKED}").toDF("q", "ids_q", "width", "vectors_q"), blocks, size <= BROADCAST_BYTES


def tiles(queries: DataFrame, base: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """``kernel(query ids, query matrix, base ids, base matrix)`` returns a dict
    of columns of ``schema`` for each pair of blocks of one width. ``queries``
    and ``base`` have two columns, an id and a vector. Where the base has codes,
    as bytes, the kernel gets those of a block joined in place of a matrix.

    Queries beyond ``BROADCAST_BYTES`` are dealt over groups of that size, and the
    base over chunks: each pair of a group and a chunk is a key of its own, so the
    base moves once for each group, not for each block, and no key has all of it."""
    q, n, small = query_blocks(queries)
    coded = base.dtypes[1][1] == "binary"
    b = pack(base)
    b = b.withColumnRenamed("width", "bytes") if coded else b.withColumn("bytes", F.col("width"))
    on = [] if coded else ["width"]
    if small:
        b = b.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        work = b.join(F.broadcast(q), ["q", *on])
    else:
        groups, chunks = max(1, n // GROUP_BLOCKS), max(1, base.rdd.getNumPartitions())
        b = b.withColumn("chunk", F.pmod(F.xxhash64("ids"), F.lit(chunks))).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        q = q.withColumn("group", F.pmod("q", F.lit(groups))).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
        work = b.join(q, ["group", "chunk", *on])
    work = work.select("ids_q", "width", "vectors_q", "ids", "bytes", "vectors")
    kind = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for r in range(batch.num_rows):
                ids_q, width, vectors_q, ids, wide, vectors = (batch.column(c)[r].as_py() for c in range(6))
                rows = (np.frombuffer(ids, np.int64), vectors) if coded else unpack(ids, wide, vectors)
                out = kernel(*unpack(ids_q, width, vectors_q), *rows)
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return work.mapInArrow(run, kind)
