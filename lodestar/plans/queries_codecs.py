"""Queries of codecs whose books, levels or projections are given, so that SQL
computes the same codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import additive, codecs, levels
from lodestar.plans.registry import base_of, query, sql_sum, table

#: Bits of the codes whose levels are fixed.
BITS = (1, 2, 3, 4, 8)


def _list(values) -> str:
    return f"[{', '.join(repr(float(x)) for x in values)}]::DOUBLE[]"


_LEVELS = " UNION ALL ".join(f"SELECT {b} AS bits, {_list(levels.best_levels(64, b)[0])} AS levels, {_list(levels.best_levels(64, b)[1])} AS cuts" for b in BITS)


@query(f"""
    WITH l AS ({_LEVELS}),
    v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum([x * x for x in embedding::DOUBLE[]])) AS n FROM embeddings),
    c AS (SELECT bits, vec_id, e, n::FLOAT AS n, levels, list_transform(e, lambda x: len(list_filter(cuts, lambda c: c < x / n))) AS codes FROM v, l)
    SELECT bits, sum(list_sum(codes))::BIGINT AS code_sum, round(avg(list_sum([(z[1] - levels[z[2] + 1] * n) * (z[1] - levels[z[2] + 1] * n) for z in list_zip(e, codes)])), 6) AS error
    FROM c GROUP BY bits""")
def fixed_levels(spark, sf_dir):
    """Codes by the levels of random directions and what they lose: less with
    every bit, though nothing was trained."""
    base, out = base_of(spark, sf_dir), None
    for b in BITS:
        codec = levels.FixedLevels(64, b)
        codes = codecs.mapped(base, codec.encode).toDF("id", "code")
        kept = codecs.mapped(codes, codec.decode).toDF("id", "kept")
        lost = F.aggregate(F.zip_with("kept", "embedding", lambda a, x: (a - x) * (a - x)), F.lit(0.0), lambda a, x: a + x)
        total = F.aggregate(F.slice("code", 1, 64), F.lit(0.0), lambda a, x: a + x)
        row = codes.join(kept, "id").join(base, "id").agg(F.sum(total).cast("long").alias("code_sum"), F.round(F.avg(lost), 6).alias("error")).select(F.lit(b).alias("bits"), "code_sum", "error")
        out = row if out is None else out.unionAll(row)
    return out


#: Given books: row j of book b of slice s has cos((j + 1) (i + 1) (s + 1) + b) / (5 + 5 b) at place i.
SLICES, BOOKS, ROWS, WIDE = 2, 2, 16, 32
_BOOK = f"list_transform(range({ROWS}), lambda j: list_transform(range({WIDE}), lambda i: cos((j + 1) * (i + 1) * ({{s}} + 1) + {{b}}) / (5 + 5 * {{b}})))"


def _given_books():
    import numpy as np

    j, i = np.arange(ROWS)[:, None] + 1, np.arange(WIDE)[None, :] + 1
    return [[np.cos(j * i * (s + 1) + b) / (5 + 5 * b) for b in range(BOOKS)] for s in range(SLICES)]


_NEAREST = "list_position(list_transform({book}, lambda r: round({l2}, 12)), list_min(list_transform({book}, lambda r: round({l2}, 12))))"


@query(f"""
    WITH b AS (SELECT {', '.join(f'{_BOOK.format(s=s, b=b)} AS b{s}{b}' for s in range(SLICES) for b in range(BOOKS))}),
    v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, e[1:{WIDE}] AS x0, e[{WIDE + 1}:] AS x1 FROM embeddings),
    f AS (SELECT *, {', '.join(f'{_NEAREST.format(book=f"b{s}0", l2=sql_sum("(z[1] - z[2]) * (z[1] - z[2])", f"x{s}", "r"))} AS c{s}0' for s in range(SLICES))} FROM v, b),
    g AS (SELECT *, {', '.join(f'[z[1] - z[2] for z in list_zip(x{s}, b{s}0[c{s}0])] AS y{s}' for s in range(SLICES))} FROM f),
    h AS (SELECT *, {', '.join(f'{_NEAREST.format(book=f"b{s}1", l2=sql_sum("(z[1] - z[2]) * (z[1] - z[2])", f"y{s}", "r"))} AS c{s}1' for s in range(SLICES))} FROM g),
    k AS (SELECT id, e, c00, c01, c10, c11, [z[1] + z[2] for z in list_zip(b00[c00], b01[c01])] || [z[1] + z[2] for z in list_zip(b10[c10], b11[c11])] AS kept FROM h)
    SELECT id, concat_ws(' ', c00 - 1, c01 - 1, c10 - 1, c11 - 1) AS code, round(list_sum([x * x for x in kept]), 4) AS length,
           round(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(e, kept)]), 4) AS error FROM k""")
def product_additive_codes(spark, sf_dir):
    """Sums of given book rows for each half of a vector, with the squared length
    of what they stand for."""
    base = base_of(spark, sf_dir)
    codec = additive.ProductAdditive([codecs.ResidualQuantizer(books, beam=1) for books in _given_books()])
    codes = codecs.mapped(base, codec.encode).toDF("id", "code")
    lost = F.aggregate(F.zip_with("kept", "embedding", lambda a, x: (a - x) * (a - x)), F.lit(0.0), lambda a, x: a + x)
    rows = codes.join(codecs.mapped(codes, codec.decode).toDF("id", "kept"), "id").join(base, "id")
    return rows.select("id", F.array_join(F.transform(F.slice("code", 1, 4), lambda x: x.cast("long").cast("string")), " ").alias("code"), F.round(F.element_at("code", -1), 4).alias("length"), F.round(lost, 4).alias("error"))


@query("SELECT 'PRQ2x4x6' AS codec, 6 AS bytes, true AS less_than_pq, true AS sound FROM (VALUES (1)) UNION ALL SELECT 'PLSQ2x4x6', 6, true, true")
def product_additive_errors(spark, sf_dir):
    """What books trained for sums of two slices lose, beside slices alone at as
    many bytes: the mean over all rows. Distances from tables and stored lengths
    are those to the decoded vectors."""
    base, out = base_of(spark, sf_dir), None
    v = codecs.sample(base)
    plain = codecs.ProductQuantizer.train_on(v, 8, 6)
    for name, search in (("PRQ2x4x6", False), ("PLSQ2x4x6", True)):
        codec = additive.ProductAdditive.train_on(v, 2, 4, 6, search)

        def lost(rows, codec=codec):
            import numpy as np

            kept, codes = codec.decode(codec.encode(rows)), codec.encode(rows)
            apart = np.abs(codec.distances(rows[:4], codes) - ((rows[:4, None, :] - kept) ** 2).sum(2)).max()
            pq = plain.decode(plain.encode(rows))
            return np.column_stack([((kept - rows) ** 2).sum(1), ((pq - rows) ** 2).sum(1), np.full(len(rows), apart)])

        e = codecs.mapped(base, lost).toDF("id", "e")
        row = e.agg((F.avg(F.col("e")[0]) < F.avg(F.col("e")[1])).alias("less_than_pq"), (F.max(F.col("e")[2]) < 1e-4).alias("sound"))
        row = row.select(F.lit(name).alias("codec"), F.lit(6).alias("bytes"), "less_than_pq", "sound")
        out = row if out is None else out.unionAll(row)
    return out


PERIOD = 0.25


@query(f"""
    WITH t AS (SELECT label, list(t ORDER BY dim) AS t FROM (SELECT label, dim, avg(x) AS t FROM (SELECT label, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, dim) GROUP BY label),
    c AS (SELECT vec_id AS id, label, [floor((z[1] - z[2]) * {2 / PERIOD}::DOUBLE)::BIGINT & 1 for z in list_zip(embedding::DOUBLE[], t)] AS bits FROM embeddings JOIN t USING (label)),
    h AS (SELECT q.id AS qid, b.id, list_sum([abs(z[1] - z[2]) for z in list_zip(q.bits, b.bits)])::DOUBLE AS dist FROM c q JOIN c b USING (label) WHERE q.id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id)::INT AS rank FROM h)
    SELECT qid, rank, id, dist FROM r WHERE rank <= 10""")
def spectral_hash_hits(spark, sf_dir):
    """Nearest rows of a query's own list in bits that differ, where a list is a
    label, its threshold the mean of its rows, and projections are the dimensions."""
    import numpy as np

    from lodestar.operators import ivf
    from lodestar.operators.knn import HITS, top

    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("list_no"))
    means = rows.select("list_no", F.posexplode("embedding").alias("dim", "x")).groupBy("list_no", "dim").agg(F.avg(F.col("x").cast("double")).alias("t"))
    found = sorted(means.collect())  # a row for each label and dimension
    labels = sorted({r.list_no for r in found})
    thresholds = np.zeros((max(labels) + 1, 64))
    for r in found:
        thresholds[r.list_no, r.dim] = r.t
    codec = levels.SpectralHash(codecs.Linear(np.eye(64)), PERIOD, thresholds)

    def coded(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                codes = codec.row_bytes(codec.encode_in(ivf.matrix_of(batch.column(1)), batch.column(2).to_numpy()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(codes, pa.binary())], names=["id", "list_no", "code"])

    codes = rows.mapInArrow(coded, "id long, list_no int, code binary")
    q = rows.where("id % 100 = 0")
    kernel = lambda qids, x, ids, c, n: codecs.best_of_tile(qids, ids, codec.distances_in(x, c, n), 10, False)
    tiles = ivf.list_tiles(q.select(F.col("id").alias("qid"), F.col("embedding").alias("qv")), q.select(F.col("id").alias("qid"), "list_no"), ivf.list_blocks(codes, "code"), kernel, HITS, codec, 64)
    return top(tiles, 10).select("qid", "rank", "id", "dist")
