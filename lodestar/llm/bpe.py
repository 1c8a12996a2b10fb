"""Byte-level BPE by a sentencepiece model made from a rank file.

The rank file (base64 token, rank) becomes a serialised sentencepiece BPE model:
each byte maps to one letter, each token to the word of its bytes' letters with
the score minus its rank, under identity normalisation. Pre-tokens are encoded
by that model; ids map back to bytes through the inverse table."""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.shared import arrow_map

#: Byte b stands as this code point plus b: letters that no normaliser touches.
FIRST_LETTER = 0x4E00
#: Pre-tokens whose ids a worker remembers before it starts anew.
REMEMBERED = 400_000
#: \s as the rank file's own splitter reads it (White_Space), for a regex class.
WHITE = r"\t-\r \x85\xa0  -     　"


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: bytes, a varint or a 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


def all_letters(tokens: list[bytes]) -> list[str]:
    """Each token's letters, by one vectorised addition over all bytes."""
    import numpy as np

    units = np.frombuffer(b"".join(tokens), dtype=np.uint8).astype("<u2") + np.uint16(FIRST_LETTER)
    joined, out, at = units.tobytes().decode("utf-16-le"), [], 0
    for t in tokens:
        out.append(joined[at : at + len(t)])
        at += len(t)
    return out


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto for ``ranks``. Piece 0 is the unknown piece
    that the format asks for; rank r is piece r + 1."""
    order = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in order] != list(range(len(order))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"no token for the bytes {missing}")
    pieces = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))]
    pieces += [_field(1, _field(1, t.encode()) + _field(2, float(-r)) + _field(3, 1)) for r, t in enumerate(all_letters(order))]
    minus_one = (1 << 64) - 1
    trainer = _field(3, 2) + _field(4, len(order) + 1) + _field(40, 0) + b"".join(_field(n, minus_one) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes texts to ids of the rank file and decodes ids to bytes."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self.table = sorted(self.ranks, key=self.ranks.__getitem__)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text. The model gets the pre-tokens that no earlier text
        had in one call, as a call costs more than a pre-token does."""
        split = [self.split(t) for t in texts]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, set().union(*split)
        self._learn(list(new))
        find = self.known.__getitem__
        return [list(chain.from_iterable(map(find, words))) for words in split]

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        self.known.update((w, (self.ranks[b],)) for w, b in zip(words, raw) if b in self.ranks)
        rest = [i for i, b in enumerate(raw) if b not in self.ranks]
        for at in range(0, len(rest), 20_000):
            part = rest[at : at + 20_000]
            got = self.model.encode(all_letters([raw[i] for i in part]), num_threads=1)
            self.known.update((words[i], tuple(p - 1 for p in ids)) for i, ids in zip(part, got))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Add ``into``, the ids of each whole text (null: empty). Other columns
    stay; a column of that name is an error. Every row stands for itself, so
    repeated rows and empty tables need no care."""
    if into in docs.columns:
        raise ValueError(f"there is a column {into}")
    return _map(docs, path, pattern, text, into, "array<int>", lambda c: lambda texts: c.encode_all([t or "" for t in texts]))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add ``into``, the bytes that ``ids`` stand for (null: empty)."""
    if into in docs.columns:
        raise ValueError(f"there is a column {into}")
    return _map(docs, path, pattern, ids, into, "binary", lambda c: lambda lists: [c.decode(x or []) for x in lists])


def _map(docs, path, pattern, source, into, kind, step):
    schema = docs.select("*", F.lit(None).cast(kind).alias(into)).schema

    def make():
        f = step(codec(path, pattern))
        return lambda cols: cols | {into: f(cols[source])}

    return arrow_map(docs, make, schema, 64)


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: bool = False) -> DataFrame:
    """Encode each text, decode its ids, and return what identifies both:
    ``n_tokens``, ``ids_sha256`` (of decimal ids joined by one space) and
    ``decoded_sha256``, in one pass; with ``ids``, the ids too. Other columns
    but ``text`` stay; one that has the name of a new one is replaced.

    Rows: a null text is empty, with no ids and the digests of nothing. Every row
    stands for itself, so repeated rows and ties get equal values; an empty table
    gives no rows."""
    new = ("n_tokens", "ids_sha256", "decoded_sha256", "ids")[: 3 + ids]
    rest = [c for c in docs.columns if c != text and c.lower() not in new]
    kinds = ("long", "string", "string", "array<int>")
    schema = docs.select(*rest, *(F.lit(None).cast(k).alias(n) for n, k in zip(new, kinds))).schema
    docs = docs.select(*rest, text)

    def make():
        c = codec(path, pattern)
        names = [str(i) for i in range(len(c.table))]

        def one(ids):
            return len(ids), hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest(), ids

        def step(cols):
            got = [one(ids) for ids in c.encode_all([t or "" for t in cols[text]])]
            return {k: cols[k] for k in rest} | {n: [g[i] for g in got] for i, n in enumerate(new)}

        return step

    return arrow_map(docs, make, schema, 64)
