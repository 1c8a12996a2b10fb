"""Vector files: fvecs, ivecs and bvecs (each row begins with its dimension) and
fbin and ibin (a header of rows and dimension), and sparse matrices.

Files are cut at row bounds, so many tasks read one file, each its own range of
bytes, through the file systems that pyarrow knows by a path's scheme; files in a
store that it doesn't know come whole through Spark's binary source. Writers make
numbered chunks in executors, in the order of ids; a folder of chunks is read as
one table. Nothing but the names, sizes and headers of files goes to the driver.

Whole numbers stay whole: ids of ivecs and ibin files come as 64-bit integers."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a component, its NumPy type, and the type of its column.
KINDS = {"fvecs": (4, "<f4", "float"), "ivecs": (4, "<i4", "bigint"), "bvecs": (1, "u1", "float"), "fbin": (4, "<f4", "float"), "ibin": (4, "<u4", "bigint")}
HEADED = ("fbin", "ibin")
#: Bytes of a file that a task reads, and of a chunk that one writes.
SPLIT_BYTES, CHUNK_BYTES = 64 << 20, 64 << 20


def _kind(path: str, kind: str | None) -> str:
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1]
    if kind not in KINDS:
        raise ValueError(f"unknown kind of vector file {kind!r}")
    return kind


def _file_system(path: str):
    """pyarrow's file system for a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") and not path.startswith("file:") else re.sub(r"^file:/*", "file:///", path))


def _known(path: str) -> bool:
    import pyarrow as pa

    try:
        _file_system(path)
        return True
    except (pa.ArrowInvalid, OSError):
        return False


@dataclass(frozen=True)
class _File:
    """A file's rows: their width, how many, where the first begins, and the
    number of the first among all files."""

    path: str
    width: int
    rows: int
    start: int
    first: int


def _head(path: str, length: int, raw: bytes, kind: str) -> tuple[int, int, int]:
    """Width, rows and start of the first row of a file that begins with ``raw``."""
    size = KINDS[kind][0]
    if not length:
        return 0, 0, 0
    first, *more = (int.from_bytes(raw[i : i + 4], "little", signed=True) for i in range(0, len(raw) - 3, 4))
    if kind in HEADED:
        if length < 8 + first * more[0] * size:
            raise ValueError(f"{path} is shorter than its header says")
        return more[0], first, 8
    if first < 0 or length % (4 + first * size):
        raise ValueError(f"{path} doesn't hold whole rows of {first}")
    return first, length // (4 + first * size), 0


def _rows_of(raw: bytes, n: int, width: int, kind: str, path: str):
    """The matrix of n rows as they lie in a file."""
    import numpy as np

    size, dtype, _ = KINDS[kind]
    if kind in HEADED:
        return np.frombuffer(raw, dtype, n * width).reshape(n, width)
    m = np.frombuffer(raw, np.uint8).reshape(n, 4 + width * size)
    if (m[:, :4].copy().view("<i4") != width).any():
        raise ValueError(f"{path} has rows of different widths")
    return m[:, 4:].copy().view(dtype)


def _files(spark: SparkSession, path: str, kind: str) -> list[_File]:
    """The files of a path in the order of their names, with their headers, which
    executors read."""
    found = spark.read.format("binaryFile").load(path).select("path", "length").where(~F.element_at(F.split("path", "/"), -1).rlike("^[_.]"))

    def heads(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for name, length in zip(*(c.to_pylist() for c in batch.columns)):
                system, at = _file_system(name)
                with system.open_input_file(at) as f:
                    out.append(dict(zip(("path", "width", "rows", "start"), (name, *_head(name, length, f.read(8), kind)))))
            yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("width", pa.int32()), ("rows", pa.int64()), ("start", pa.int64())]))

    out, first = [], 0
    for r in sorted(found.mapInArrow(heads, "path string, width int, rows long, start long").collect()):
        out.append(_File(r.path, r.width, r["rows"], r.start, first))
        first += r["rows"]
    return out


def read_vectors(spark: SparkSession, path: str, kind: str | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``(id, embedding)`` with ids by position; several files, or those of a
    folder, are one after the other by their names."""
    kind = _kind(path, kind)
    size, _, component = KINDS[kind]
    schema = f"id long, embedding array<{component}>"
    if not _known(path.split(",")[0]):
        return _read_whole(spark, path, kind)
    files = _files(spark, path, kind)
    splits = []  # file, first row, rows
    for i, f in enumerate(files):
        step = max(1, split_bytes // max(1, f.width * size + 4))
        splits += [(i, r, min(step, f.rows - r)) for r in range(0, f.rows, step)]
    if not splits:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast((files, splits))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        files, splits = shared.value
        arrow = pa.schema([("id", pa.int64()), ("embedding", pa.list_(pa.int64() if component == "bigint" else pa.float32()))])
        for batch in batches:
            for s in batch.column(0).to_pylist():
                i, r, n = splits[s]
                f = files[i]
                wide = f.width * size + (kind not in HEADED) * 4
                system, at = _file_system(f.path)
                with system.open_input_file(at) as raw:
                    raw.seek(f.start + r * wide)
                    while n:
                        m = _rows_of(raw.read(min(n, 4096) * wide), min(n, 4096), f.width, kind, f.path)
                        ids = np.arange(f.first + r, f.first + r + len(m))
                        flat = pa.array(np.ascontiguousarray(m).ravel().astype(np.int64 if component == "bigint" else np.float32))
                        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, max(1, f.width))[: len(m) + 1] if f.width else np.zeros(len(m) + 1), pa.int32()), flat)], schema=arrow)
                        n, r = n - len(m), r + len(m)

    return spark.range(0, len(splits), 1, len(splits)).mapInArrow(run, schema)


def _numbered(found: DataFrame, column: str) -> DataFrame:
    """Rows ``(path, place, ...)`` with ids that go on from file to file."""
    sizes = sorted((r.path, r.n) for r in found.groupBy("path").agg(F.count(F.lit(1)).alias("n")).collect())
    shift, at = [], 0
    for path, n in sizes:
        shift.append((path, at))
        at += n
    if len(shift) < 2:
        return found.withColumn("id", F.col("place")).drop("path", "place")
    table = found.sparkSession.createDataFrame(shift, "path string, shift long")
    return found.join(F.broadcast(table), "path").withColumn("id", F.col("place") + F.col("shift")).drop("path", "place", "shift")


def _read_whole(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Files of a store that only Spark reads, each by one task."""
    component = KINDS[kind][2]

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = raw.as_py()
                width, n, start = _head(name, len(raw), raw[:8], kind)
                m = _rows_of(raw[start:], n, width, kind, name) if n else []
                for i in range(0, n, 4096):
                    part = m[i : i + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(range(i, i + len(part)), pa.int64()), pa.array(list(part.astype("f4" if component == "float" else "i8")), pa.list_(pa.float32() if component == "float" else pa.int64()))], names=["path", "place", "embedding"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return _numbered(files.mapInArrow(rows, f"path string, place long, embedding array<{component}>"), "embedding").select("id", "embedding")


def check_chunks(names: list[str]) -> list[str]:
    """Chunk files in the order of their numbers; a gap is an error."""
    numbered = sorted((int(re.findall(r"\d+", n)[-1]), n) for n in names)
    if [k for k, _ in numbered] != list(range(numbered[0][0], numbered[0][0] + len(numbered))):
        raise ValueError(f"chunks are missing among {[n for _, n in numbered]}")
    return [n for _, n in numbered]


def _put(path: str, raw: list[bytes]) -> None:
    """A file, whole or not at all: a task that runs twice leaves the same."""
    import uuid

    system, at = _file_system(path)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    hidden = f"{at.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}"
    with system.open_output_stream(hidden) as f:
        for part in raw:
            f.write(part)
    system.move(hidden, at)


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows in ranges of ids, sorted, with the number of their range. Bounds of
    ranges are sampled once, as their number is taken behind the exchange."""
    return rows.repartitionByRange("id").sortWithinPartitions("id").withColumn("part", F.spark_partition_id())


def write_vectors(vectors: DataFrame, path: str, kind: str = "fvecs", chunk_bytes: int = CHUNK_BYTES) -> list[str]:
    """Write ``(id, vector)`` to the folder ``path`` as files of rows in the order
    of ids, which the tasks that hold them write. Returns the files' names in
    order. Null vectors are left out; kinds with a header have one in each file."""
    size, dtype, _ = KINDS[_kind(path, kind)]
    rows = _in_order(vectors.toDF("id", "v").where("v is not null"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, n, part, number, width = [], 0, 0, 0, 0

        def flush():
            name = f"{path.rstrip('/')}/part-{part:06d}-{number:04d}.{kind}"
            _put(name, [np.array([n, width], "<i4").tobytes(), *held] if kind in HEADED else held)
            return pa.RecordBatch.from_pydict({"path": [name], "rows": [n]}, pa.schema([("path", pa.string()), ("rows", pa.int64())]))

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(2)[0].as_py()
            for x in batch.column(1):
                v = x.values.to_numpy(zero_copy_only=False).astype(dtype)
                if n and len(v) != width:
                    raise ValueError(f"rows of {width} and of {len(v)} components")
                if n and n * (len(v) * size + 4) >= chunk_bytes:
                    yield flush()
                    held, n, number = [], 0, number + 1
                width = len(v)
                held.append(v.tobytes() if kind in HEADED else np.array([width], "<i4").tobytes() + v.tobytes())
                n += 1
        if n:
            yield flush()

    return sorted(r.path for r in rows.select("id", "v", "part").mapInArrow(run, "path string, rows long").collect())


def write_sparse(rows: DataFrame, path: str) -> list[str]:
    """``(id, indices, values)`` in the order of ids as CSR matrices in .npz files
    of the folder ``path``, each written by the task that holds its rows."""
    def run(batches):
        import io

        import numpy as np
        import pyarrow as pa

        counts, indices, values, part = [np.zeros(1, np.int64)], [], [], None
        for batch in batches:
            if batch.num_rows:
                part = batch.column(3)[0].as_py()
                counts.append(batch.column(1).value_lengths().to_numpy().astype(np.int64))
                indices.append(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int32))
                values.append(batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(float))
        if part is not None:
            raw = io.BytesIO()
            np.savez(raw, indptr=np.cumsum(np.concatenate(counts)), indices=np.concatenate(indices), data=np.concatenate(values))
            name = f"{path.rstrip('/')}/part-{part:06d}.npz"
            _put(name, [raw.getvalue()])
            yield pa.RecordBatch.from_pydict({"path": [name]})

    found = _in_order(rows.select("id", "indices", "values")).mapInArrow(run, "path string").collect()
    return sorted(r.path for r in found)


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    """``(id, indices, values)`` of CSR matrices in .npz files; ids go on from
    file to file in the order of their names."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(batches):
        import io

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                z = np.load(io.BytesIO(raw.as_py()))
                ends = pa.array(z["indptr"].astype(np.int32))
                n = len(ends) - 1
                lists = [pa.ListArray.from_arrays(ends, pa.array(z[c].astype(k))) for c, k in (("indices", np.int32), ("data", float))]
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(n)), *lists], names=["path", "place", "indices", "values"])

    found = files.mapInArrow(rows, "path string, place long, indices array<int>, values array<double>")
    return _numbered(found, "indices").select("id", "indices", "values")
