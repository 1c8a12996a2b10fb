"""Tables that jobs write between their steps."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Where that is unset, a
    temporary folder does in local mode; on a cluster it is an error, as
    executors don't see each other's disks."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class _Written(threading.local):
    """Folders of the tables that this thread has written and not removed."""

    def __init__(self):
        self.paths: list[str] = []


_written = _Written()


def new_folder(spark: SparkSession) -> str:
    """A folder for what a query writes, which ``clear`` removes."""
    _written.paths.append(f"{shared_dir(spark)}/lodestar-{uuid.uuid4().hex}")
    return _written.paths[-1]


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: later
    jobs start from files that survive lost executors, not from shuffle files,
    and random or sampled steps before it run once. The table stays until
    ``settled`` or ``clear`` removes it."""
    spark = df.sparkSession
    folder = new_folder(spark)
    df.write.parquet(f"{folder}/{name}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str = "table") -> DataFrame:
    """``materialize`` of what ``make`` returns; the tables that it wrote on the
    way, which the result no longer needs, are removed."""
    before = len(_written.paths)
    out = materialize(make(), name)
    gone, _written.paths[before:] = _written.paths[before:-1], _written.paths[-1:]
    _remove(spark, gone)
    return out


def succeeding(df: DataFrame, name: str = "table") -> DataFrame:
    """``materialize`` of a round's table, made from that of the round before, which is
    the last that this thread has written and is removed."""
    before = _written.paths[-1]
    out = materialize(df, name)
    _written.paths.remove(before)
    _remove(df.sparkSession, [before])
    return out


def together(*makes: Callable[[], object]) -> list:
    """What each of ``makes`` returns, run at once, for small jobs that would leave cores
    idle. The tables that they write are this thread's."""
    def run(make):
        return make(), _written.paths

    with ThreadPoolExecutor(len(makes)) as pool:
        done = list(pool.map(lambda f: f(), [inheritable_thread_target(partial(run, make)) for make in makes]))
    for _, paths in done:
        _written.paths += [p for p in paths if p not in _written.paths]
    return [out for out, _ in done]


def clear(spark: SparkSession) -> None:
    """Remove all tables that this thread's queries have written. Results that
    haven't been read or written yet need them."""
    gone, _written.paths[:] = _written.paths[:], []
    _remove(spark, gone)


def _remove(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def within(spark: SparkSession, seconds: float, make: Callable[[], object]):
    """What ``make`` returns, if it does so in time; else its jobs are cancelled and
    it is a TimeoutError."""
    group, late = f"lodestar-{uuid.uuid4().hex}", threading.Event()
    context = spark.sparkContext

    def cancel():
        late.set()
        context.cancelJobGroup(group)

    context.setJobGroup(group, f"at most {seconds} s", True)
    timer = threading.Timer(seconds, cancel)
    timer.start()
    try:
        return make()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"it took more than {seconds} s") from e
        raise
    finally:
        timer.cancel()
        context._jsc.clearJobGroup()
