"""Token counts by offset-mapped attribution.

A document's fields are joined by a separator and encoded once. Each token spans
some of the document's bytes; each section (a line of a field, or the field) spans
others. An interval join by binary search allocates tokens to sections. The rule
for a token that crosses a boundary: it belongs to the section where its first
byte lies. A section ends behind the separator that follows it, so the sections
cover the document and their counts add up to the document's.

The encoder's own splitter fails on about a million white-space characters in a
row, so a text with a run of ``LONG_WHITE`` of them is split and encoded by the
codec of ``bpe``, which gives the same ids: texts of any length are counted.

Rows: null fields are empty. An empty table gives no rows. An empty field has one empty section, with the
separator behind it, if any. Every row stands for itself, so repeated rows and
ties need no care. Extra columns but the fields stay; a column that has the name
of one that is added is replaced."""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.shared import arrow_map

#: White space in a row from which on a text is encoded by the other codec.
LONG_WHITE = re.compile(r"\s{20000}")
SECTION = "struct<field:string,section:int,start:int,end:int,n_tokens:bigint,n_crossing:bigint>"


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    """A function from a text to its ids, without special tokens, and each
    token's length."""
    import numpy as np
    import tiktoken

    from lodestar.llm.bpe import codec, read_ranks

    ranks = read_ranks(path)
    lengths = np.zeros(len(ranks), dtype=np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    whole = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        return codec(path, pattern).encode(text) if LONG_WHITE.search(text) else whole.encode_ordinary(text)

    return encode, lengths


def attribute(values: Sequence[str], names: Sequence[str], encode, lengths, separator: str = "\n", by_line: bool = True) -> tuple[int, list[dict]]:
    """Tokens of the joined ``values``, and a dict for each section. ``start``
    and ``end`` are code points of the joined text; ``n_crossing`` counts the
    section's own tokens that reach into the next."""
    import numpy as np

    whole = separator.join(values)
    raw = np.frombuffer(whole.encode(), dtype=np.uint8)
    ids = encode(whole)
    sizes = lengths[np.asarray(ids, dtype=np.int64)] if ids else lengths[:0]
    ends = np.cumsum(sizes)
    field_ends = np.cumsum([len((v + separator).encode()) for v in values])
    field_ends[-1] = len(raw)
    if by_line:
        breaks = np.flatnonzero(raw == 10) + 1
        bounds = np.unique(np.concatenate([field_ends[:-1], breaks[breaks < len(raw)]]))
    else:
        bounds = field_ends[:-1]
    starts = np.concatenate([[0], bounds])
    stops = np.concatenate([bounds, [len(raw)]])
    owner = np.searchsorted(starts, ends - sizes, side="right") - 1
    count = np.bincount(owner, minlength=len(starts))
    crossing = np.bincount(owner[ends > stops[owner]], minlength=len(starts))
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    field = np.searchsorted(field_ends[:-1], starts, side="right")
    number = np.arange(len(starts)) - np.searchsorted(field, field)
    rows = zip(field.tolist(), number.tolist(), points[starts].tolist(), points[stops].tolist(), count.tolist(), crossing.tolist())
    return len(ids), [{"field": names[f], "section": n, "start": s, "end": e, "n_tokens": c, "n_crossing": x} for f, n, s, e, c, x in rows]


def token_counts(docs: DataFrame, path: str, pattern: str, fields: Sequence[str] = ("text",), by_line: bool = True) -> DataFrame:
    """Replace the fields by ``n_tokens`` of the whole document and
    ``sections``: field, number within it, start, end, n_tokens, n_crossing."""
    fields, new = list(fields), ("n_tokens", "sections")
    rest = [c for c in docs.columns if c not in fields and c.lower() not in new]
    rows = docs.select(*rest, *fields)
    schema = rows.select(*rest, F.lit(0).cast("long").alias("n_tokens"), F.array().cast(f"array<{SECTION}>").alias("sections")).schema

    def make():
        encode, lengths = encoder(path, pattern)

        def step(cols):
            got = [attribute([v or "" for v in values], fields, encode, lengths, by_line=by_line) for values in zip(*(cols[f] for f in fields))]
            return {c: cols[c] for c in rest} | {"n_tokens": [n for n, _ in got], "sections": [s for _, s in got]}

        return step

    return arrow_map(rows, make, schema, 128)
