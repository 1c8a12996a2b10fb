"""One query for each operator of this subpackage, with its production
parameters on the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import bpe, chat, embed_dedup, fingerprints, lexical, line_dedup, media, minhash, mixing, quality, resampling, sharding, token_counts


def _ranks() -> tuple[str, str]:
    """The rank file and its splitting pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each section (line) of each document."""
    docs = token_counts.token_counts(_read(spark, sf_dir, "documents", "doc_id", "text"), *_ranks())
    s = F.explode("sections").alias("s")
    return docs.select("doc_id", "n_tokens", s).select("doc_id", F.col("n_tokens").alias("doc_tokens"), "s.section", "s.start", "s.end", "s.n_tokens", "s.n_crossing")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    return quality.classify(docs).select("doc_id", "score", "kept")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf_dir, "documents", "doc_id", "source", "text"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards; a row for each document that lies in one."""
    return sharding.shard(_read(spark, sf_dir, "documents", "doc_id", "text"))


def sharding_to_64k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4 with a limit of 64 KiB, at which small tables split into many shards
    too; a document over the limit is a shard of its own."""
    return sharding.shard(_read(spark, sf_dir, "documents", "doc_id", "text"), 64 << 10)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_read(spark, sf_dir, "documents", "doc_id", "text"), *_ranks())


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.line_dedup(_read(spark, sf_dir, "documents", "doc_id", "text"))
    runs = F.array_join(F.transform("keep_bitmap", lambda r: F.concat_ws("+", r["start"].cast("string"), r["len"].cast("string"))), " ")
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"), runs.alias("keep_bitmap"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = media.read_media(media.add_media(_read(spark, sf_dir, "documents", "doc_id", "text")))
    marks = F.to_json("marks")
    return files.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("marks").cast("string"), F.md5(marks)).alias("feature"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    rows = _read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], rows.schema))
    back = chat.read_back(chat.format_conversations(rows))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "benchmark", "text"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(_read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "benchmark", "item_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_quality_classifier, op3_mixing, op4_sharding, op5_byte_bpe, op6_line_dedup, op7_embedding_dedup, op8_media, op9_chat_format, op10_minhash, op11_fingerprints, op12_importance_resampling, op13_lexical_search, sharding_to_64k, pipeline)}

_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL = {
    "op3_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                          md5(coalesce(doc_id::VARCHAR, 'null') || ':7') AS key FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1 AS nth FROM d GROUP BY source),
        w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(nth % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
        f AS (SELECT *, (SELECT sum(source_size) FROM w) * 1.5::DOUBLE AS total,
                     coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
                     sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
        l AS (SELECT (total - caps) / rest AS level FROM f WHERE (total - caps) / rest * weight <= cap ORDER BY cap / weight, nth LIMIT 1),
        t AS (SELECT w.source, source_size, coalesce(least(cap, (SELECT level FROM l) * weight), cap) AS target FROM w),
        r AS (SELECT d.*, source_size, target, floor(target)::BIGINT AS budget,
                     coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM r)
        SELECT doc_id, source, size, source_size, target,
               (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken FROM e""",
    "op4_sharding": """
        WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes,
                          ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS hash FROM documents),
        p AS (SELECT d.*, depth, (hash >> (60 - depth))::BIGINT AS prefix FROM d, (SELECT unnest(range(0, 61))::INT AS depth)),
        n AS (SELECT depth, prefix, sum(bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_docs,
                     sum(bytes) <= 16777216 OR min(hash) = max(hash) AS fits FROM p GROUP BY depth, prefix),
        b AS (SELECT p.doc_id, p.bytes, n.depth, n.prefix, n.shard_bytes, n.shard_docs,
                     row_number() OVER (PARTITION BY p.doc_id, p.bytes ORDER BY n.depth) AS k, count(*) OVER (PARTITION BY p.doc_id, p.bytes, n.depth) AS same
              FROM p JOIN n USING (depth, prefix) WHERE fits)
        SELECT doc_id, bytes, depth, prefix, depth || '-' || lpad(printf('%X', prefix), 15, '0') AS shard, shard_bytes, shard_docs,
               shard_bytes > 16777216 AS oversized FROM b WHERE k <= same""",
    "op6_line_dedup": f"""
        WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS pos, unnest(x) AS line
                   FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
        k AS (SELECT *, translate(trim(line, {_WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
        j AS (SELECT k.*, o.owner IS NOT NULL AND o.owner <> doc_id AS dropped FROM k LEFT JOIN o ON k.key = o.key),
        r AS (SELECT doc_id, min(pos) - 1 AS start, count(*) AS len
              FROM (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM j WHERE NOT dropped) GROUP BY doc_id, run),
        b AS (SELECT doc_id, string_agg(start || '+' || len, ' ' ORDER BY start) AS runs FROM r GROUP BY doc_id)
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256, coalesce(any_value(runs), '') AS keep_bitmap
        FROM j LEFT JOIN b USING (doc_id) GROUP BY doc_id""",
    "op7_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
                             WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
              WHERE list_sum([z[1] * z[2] for z in list_zip(a.e, b.e)]) / sqrt(list_sum([x * x for x in a.e]) * list_sum([x * x for x in b.e])) >= 0.93),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
        r AS (SELECT a AS id, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
        c AS (SELECT id, min(root) AS root FROM r GROUP BY id)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(root, vec_id)::BIGINT AS component_id, coalesce(root, vec_id) = vec_id AS kept
        FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.id = vec_id""",
}
ORACLE_SQL["sharding_to_64k"] = ORACLE_SQL["op4_sharding"].replace("16777216", "65536")

#: The tree of a text ``t`` of the relation ``x``, which has a row number ``i``, as
#: ``{name}(i, root, p, s, pieces)``: digests of paragraphs and sections, items of pieces.
_TREE = r"""
    {name}_p AS (SELECT i, k, d, z, sum(k_ends) OVER (PARTITION BY i ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sec
                 FROM (SELECT i, k, z, md5(list_aggregate(list_transform(z, lambda y: md5(y)), 'string_agg', '')) AS d0, coalesce(d0, md5('')) AS d,
                              (len(z) = 0 OR substr(d, 1, 1) IN ('0', '1'))::INT AS k_ends
                       FROM (SELECT i, unnest(generate_series(1, len(l))) AS k, regexp_extract_all(unnest(l), '[^.!?]{{0,64}}[.!?]|[^.!?]{{1,64}}') AS z
                             FROM (SELECT i, string_split(t, chr(10)) AS l FROM {x})))),
    {name}_s AS (SELECT i, coalesce(sec, 0) AS sec, md5(string_agg(d, '' ORDER BY k)) AS d, count(*) AS n FROM {name}_p GROUP BY ALL),
    {name}_r AS (SELECT i, md5(string_agg(d, '' ORDER BY sec)) AS root, string_agg(substr(d, 1, 8) || ':' || n, ' ' ORDER BY sec) AS s FROM {name}_s GROUP BY i),
    {name}_l AS (SELECT i, list(d ORDER BY k) AS ps, string_agg(substr(d, 1, 8) || ':' || len(z) || ':' || coalesce(list_sum(list_transform(z, lambda y: length(y))), 0)::INT, ' ' ORDER BY k) AS p,
                        flatten(list(list_transform(z, lambda y: substr(md5(y), 1, 8) || ':' || length(y)) ORDER BY k)) AS pieces,
                        list(list_transform(z, lambda y: substr(md5(y), 1, 8) || ':' || length(y)) ORDER BY k) AS each, list(coalesce(list_sum(list_transform(z, lambda y: length(y))), 0) ORDER BY k) AS chars
                 FROM {name}_p GROUP BY i),
    {name} AS (SELECT i, root, root || '|' || s || '|' || p || '|' || coalesce(list_aggregate(pieces, 'string_agg', ' '), '') AS fingerprint, ps, each, chars, list_distinct(pieces) AS pieces
               FROM {name}_r JOIN {name}_l USING (i))"""


def _like(a: str, b: str) -> str:
    chars = lambda x: f"coalesce(list_sum(list_transform({x}, lambda y: split_part(y, ':', 2)::BIGINT)), 0)"
    most = f"greatest({chars(f'{a}.pieces')}, {chars(f'{b}.pieces')})"
    return f"CASE WHEN {a}.root = {b}.root THEN 1.0 WHEN {most} = 0 THEN 0.0 ELSE {chars(f'list_intersect({a}.pieces, {b}.pieces)')}::DOUBLE / {most} END::DOUBLE"


ORACLE_SQL["op11_fingerprints"] = f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, row_number() OVER (ORDER BY doc_id) AS i FROM documents),
    m AS (SELECT max(i) AS last FROM d),
    e AS (SELECT d.i, substr(d.t, 1, d.n - d.n // 4) || substr(x.t, 1, d.n // 4) AS t FROM d, m JOIN d x ON x.i = CASE WHEN d.i = last THEN 1 ELSE d.i + 1 END),
    {_TREE.format(name="a", x="d")},
    {_TREE.format(name="b", x="e")}
    , j AS (SELECT doc_id, n::BIGINT AS n_chars, sha256(e.t) AS edited_sha256, a.fingerprint, b.fingerprint AS edited_fingerprint,
                {_like("a", "b")} AS near_edited, {_like("a", "c")} AS near_next, a.root <> b.root AS differs, a.chars, a.each AS x, b.each AS y,
                list_position(list_transform(list_zip(a.ps, b.ps), lambda z: z[1] IS NOT DISTINCT FROM z[2]), false) AS w
           FROM d JOIN e USING (i) JOIN a USING (i) JOIN b USING (i) JOIN m ON true JOIN a c ON c.i = CASE WHEN d.i = last THEN 1 ELSE d.i + 1 END),
    k AS (SELECT *, list_position(list_transform(list_zip(x[w], y[w]), lambda z: z[1] IS NOT DISTINCT FROM z[2]), false) AS v FROM j)
    SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
           CASE WHEN differs THEN (coalesce(list_sum(chars[1:w - 1]), 0) + w - 1 + coalesce(list_sum(list_transform(x[w][1:v - 1], lambda q: split_part(q, ':', 2)::BIGINT)), 0))::BIGINT END AS edit_at
    FROM k"""

_A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), {_A_TO_Z}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL["op12_importance_resampling"] = f"""
    WITH bytes AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS tab),
    d AS (SELECT doc_id, row_number() OVER () AS i, {_WORDS} AS ws FROM documents),
    q AS (SELECT {_WORDS} AS ws FROM benchmark),
    v AS (SELECT DISTINCT w FROM (SELECT unnest(ws) AS w FROM d UNION ALL SELECT unnest(ws) FROM q)),
    h AS (SELECT w, xor(list_reduce(list_transform(range(strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT),
                                    lambda c, b: xor(c // 256, tab[(xor(c, b) % 256) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM v, bytes),
    f AS (SELECT i, bucket FROM (SELECT i, unnest(ws) AS w FROM d) JOIN h USING (w)),
    t AS (SELECT bucket, count(*) AS t FROM (SELECT unnest(ws) AS w FROM q) JOIN h USING (w) GROUP BY bucket),
    s AS (SELECT bucket, count(*) AS s FROM f GROUP BY bucket),
    g AS (SELECT range AS bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000))::DOUBLE
                                                  / ((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000))::DOUBLE))::BIGINT AS gain
          FROM range(10000) LEFT JOIN t ON t.bucket = range LEFT JOIN s ON s.bucket = range),
    w AS (SELECT i, sum(gain)::BIGINT AS gain, count(*) AS n FROM f JOIN g USING (bucket) GROUP BY i),
    r AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce((gain - ((gain % n) + n) % n) // n, 0)::BIGINT AS weight,
                 ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (i)),
    x AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM r),
    y AS (SELECT *, row_number() OVER (ORDER BY n_features >= 20 DESC, score DESC, doc_id NULLS LAST) AS nth FROM x)
    SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND nth <= 10 * (SELECT count(*) FROM x WHERE n_features >= 20) // 100 THEN nth END::BIGINT AS rank FROM y"""

ORACLE_SQL["op13_lexical_search"] = f"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS i, {_WORDS} AS ws FROM documents),
    n AS (SELECT count(*)::BIGINT AS nn, sum(len(ws))::BIGINT AS ll FROM d WHERE len(ws) > 0),
    q AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, unnest({_WORDS}) AS w FROM benchmark)),
    p AS (SELECT doc_id, i, n, w, count(*)::BIGINT AS tf FROM (SELECT doc_id, i, len(ws)::BIGINT AS n, unnest(ws) AS w FROM d) SEMI JOIN q USING (w) GROUP BY ALL),
    f AS (SELECT w, floor(1000 * ln((2 * nn + 2) / (2 * df + 1)))::BIGINT AS weight FROM (SELECT w, count(*) AS df FROM p GROUP BY w), n),
    s AS (SELECT item_id, doc_id, i, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::BIGINT AS score FROM p JOIN f USING (w) JOIN q USING (w), n GROUP BY ALL),
    r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM s WHERE score > 0)
    SELECT * FROM r WHERE rank <= 50"""
