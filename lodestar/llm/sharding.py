"""Sharding by extendible hashing.

A document's hash is 60 bits of its doc_id's MD5. A bucket is a prefix of these
bits. Only buckets over the byte limit split on the next bit; the directory maps
each prefix of the deepest level to its bucket. All levels of a directory are
summed at once from one histogram; cells that are still too large at its deepest
bit get a directory of their own below it.

Rows: a null text has 0 bytes; a null doc_id is a key of its own. Rows of one
doc_id always share a shard, so a shard with only one doc_id isn't split
further; if it is over the limit it is marked ``oversized``. A text of any length
lies whole in one shard; an empty table has no shards."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodestar.llm.shared import free_name, materialize
from lodestar.sources.shared import new_folder

BITS = 60
#: Bytes of text that a shard may hold.
LIMIT = 16 << 20
#: Shards up to so many are sent to all tasks; more meet the rows in a shuffle.
FEW = 20_000
#: Bits of a directory beyond those that even buckets would need; bits of the next one below.
SLACK, DEEPER = 4, 8


def hash_bits(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def directory(rows: DataFrame, base: int, bits: int, limit: int) -> DataFrame:
    """The directory of ``rows(hash, bytes)`` from ``base`` bits to ``bits``
    bits: ``cell, depth, prefix, shard_bytes, shard_docs, fits``, where the
    bucket of a cell is the shallowest prefix that fits, or the cell itself."""
    prefix = lambda h, d: F.shiftrightunsigned(h, BITS - d) if isinstance(d, int) else F.expr(f"shiftrightunsigned({h}, {BITS} - {d})")
    cells = materialize(
        rows.groupBy(prefix(F.col("hash"), bits).alias("cell"))
        .agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"), F.min("hash").alias("least"), F.max("hash").alias("most")), "cells")
    above = cells.withColumn("depth", F.explode(F.sequence(F.lit(base), F.lit(bits)))).withColumn("prefix", F.expr(f"shiftrightunsigned(cell, {bits} - depth)"))
    nodes = above.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"), (F.min("least") == F.max("most")).alias("single"))
    nodes = nodes.withColumn("fits", (F.col("shard_bytes") <= limit) | F.col("single"))
    nodes = materialize(nodes.where(F.col("fits") | (F.col("depth") == bits)), "nodes")
    pick = F.min_by(F.struct("depth", "prefix", "shard_bytes", "shard_docs", "fits"), F.col("depth"))
    return above.select("cell", "depth", "prefix").join(nodes, ["depth", "prefix"]).groupBy("cell").agg(pick.alias("b")).select("cell", "b.*")


def assign(docs: DataFrame, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, bytes, depth, prefix, shard (its
    name), shard_bytes, shard_docs, oversized."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    rows = materialize(docs.select(F.col(doc_id).alias("doc_id"), hash_bits(F.col(doc_id)).alias("hash"), size.alias("bytes")), "rows")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    base, bits = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SLACK)
    done, left = [], rows
    while True:
        here = directory(left, base, bits, limit)
        found = materialize(left.withColumn("cell", F.shiftrightunsigned("hash", BITS - bits)).join(here, "cell"), "found")
        done.append(found.where("fits"))
        left = found.where("not fits").select("doc_id", "hash", "bytes")
        if left.isEmpty():
            break
        base, bits = bits, min(BITS, bits + DEEPER)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    name = F.concat_ws("-", F.col("depth").cast("string"), F.lpad(F.hex("prefix"), 15, "0"))
    return out.select("doc_id", "bytes", F.col("depth").cast("int").alias("depth"), "prefix", name.alias("shard"), "shard_bytes", "shard_docs", (F.col("shard_bytes") > limit).alias("oversized"))


def placed(docs: DataFrame, shards: DataFrame, doc_id: str = "doc_id") -> tuple[DataFrame, str]:
    """``docs`` with the name of each row's shard, and that column's name. Up to
    ``FEW`` shards go to the rows, and texts don't move for it; more of them meet
    the rows by the hash of their doc_ids, of which ``shards`` has a row each."""
    known = materialize(shards.select("depth", "prefix", "shard").distinct(), "known")
    s, h = free_name(docs, "shard"), free_name(docs, "_hash")
    out, names = docs.withColumn(h, hash_bits(F.col(doc_id))), []
    if known.count() > FEW:
        key, by_hash = free_name(docs, "_key"), shards.select(hash_bits(F.col("doc_id")).alias("key"), "shard").distinct()
        out = out.join(by_hash.toDF(key, s), F.col(h) == F.col(key), "left")
        return out.select(*(docs[c] for c in docs.columns), s), s
    for d in sorted(r.depth for r in known.select("depth").distinct().collect()):
        p, n = free_name(docs, f"_prefix{d}"), free_name(docs, f"_shard{d}")
        here = known.where(F.col("depth") == d).select(F.col("prefix").alias(p), F.col("shard").alias(n))
        out = out.join(F.broadcast(here), F.shiftrightunsigned(h, BITS - d) == F.col(p), "left")
        names.append(n)
    return out.select(*(docs[c] for c in docs.columns), F.coalesce(F.lit(None).cast("string"), *map(F.col, names)).alias(s)), s


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` with one folder for each shard, and return the assignment
    of its doc_ids."""
    shards = materialize(assign(docs, limit, doc_id, text), "shards")
    rows, s = placed(docs, shards, doc_id)
    rows.repartition(s).write.partitionBy(s).parquet(path)
    return shards


def shard(docs: DataFrame, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` as shards in the shared folder and return a row for each
    row that lies there, with the columns of ``assign``: sizes are those of the
    written texts, shards those of their folders."""
    spark = docs.sparkSession
    path, s = f"{new_folder(spark)}/shards", free_name(docs, "shard")
    write_shards(docs, path, limit, doc_id, text)
    there = spark.read.schema(StructType([*docs.schema.fields, StructField(s, StringType())])).parquet(path)
    rows = materialize(there.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), F.col(s).alias("shard")), "there")
    sums = rows.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_docs"))
    depth, prefix = (F.split("shard", "-")[i] for i in (0, 1))
    return rows.join(sums, "shard").select("doc_id", "bytes", depth.cast("int").alias("depth"), F.conv(prefix, 16, 10).cast("long").alias("prefix"), "shard", "shard_bytes", "shard_docs", (F.col("shard_bytes") > limit).alias("oversized"))
