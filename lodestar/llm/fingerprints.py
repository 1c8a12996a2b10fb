"""Document fingerprints in DataFrame operations only: Merkle trees over
paragraphs and sections.

A paragraph is a line. It is cut into pieces, which end at a sentence mark or
after ``PIECE`` code points and start anew in each paragraph, so an edit moves no
cut beyond its paragraph. A section ends behind an empty paragraph and behind
every paragraph whose digest says so, one in eight; so sections, too, depend on
what they hold and not on where they lie. The digest of a piece is its MD5, that
of a paragraph, a section and the root the MD5 of the digests below it.

A fingerprint is a string of four levels, root, sections, paragraphs and pieces,
parted by ``|``. Items of a level are parted by spaces: the first eight digits of
the digest, a colon, and how many items of the next level belong to it; a
paragraph has its code points behind a second colon, and of a piece the number is
its code points. Equal roots mean equal texts (128 bits; no defence against texts
made to collide). Branches that differ tell where: ``with_first_edit`` descends only
into the first differing section, and ``changed_pieces`` lists all new pieces.

Rows: a null text is empty; an empty text has one section of one paragraph
without pieces. A text of any length stays in its row, as arrays that grow with
it. Rows of one doc_id are one document for the order of ``edited``, whose next
document is the row of the next larger doc_id with the smallest hash of its text;
a null doc_id is one that comes first. An empty table gives an empty result.
Extra columns stay; columns added replace those of the same name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.shared import free_name, materialize
from lodestar.operators.ordered import running

#: Code points of a piece before its sentence mark, at most.
PIECE = 64
PIECES = rf"[^.!?]{{0,{PIECE}}}[.!?]|[^.!?]{{1,{PIECE}}}"
#: First digits of a paragraph's digest behind which a section ends.
ENDS = ("0", "1")


def _whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _up_to(digest: Column) -> Column:
    return F.substring(digest, 1, 8)


def with_tree(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the fingerprint of the column ``text``, which holds no nulls."""
    paragraphs, ends, sections = (free_name(rows, f"_{out}_{n}") for n in ("paragraphs", "ends", "sections"))
    pieces = F.transform(F.split(text, "\n", -1), lambda p: F.transform(F.regexp_extract_all(p, F.lit(PIECES), F.lit(0)), lambda x: F.struct(F.md5(x).alias("d"), F.char_length(x).alias("n"))))
    rows = rows.withColumn(paragraphs, pieces)
    rows = rows.withColumn(paragraphs, F.transform(paragraphs, lambda a: F.struct(F.md5(F.array_join(a["d"], "")).alias("d"), a.alias("pieces"))))
    last = F.size(paragraphs) - 1
    ending = lambda p: (F.size(p["pieces"]) == 0) | F.substring(p["d"], 1, 1).isin(*ENDS)
    rows = rows.withColumn(ends, F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | ending(F.get(paragraphs, i))))

    def section(end: Column, k: Column) -> Column:
        start = F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1) + 1)
        return F.struct(F.md5(F.array_join(F.slice(F.col(f"{paragraphs}.d"), start + 1, end + 1 - start), "")).alias("d"), (end + 1 - start).alias("n"))

    rows = rows.withColumn(sections, F.transform(ends, section))
    items = lambda *parts: F.concat_ws(":", *(p.cast("string") for p in parts))
    chars = lambda a: F.aggregate(a["n"], F.lit(0), lambda x, y: x + y)
    levels = [
        F.transform(sections, lambda s: items(_up_to(s["d"]), s["n"])),
        F.transform(paragraphs, lambda p: items(_up_to(p["d"]), F.size(p["pieces"]), chars(p["pieces"]))),
        F.flatten(F.transform(paragraphs, lambda p: F.transform(p["pieces"], lambda x: items(_up_to(x["d"]), x["n"])))),
    ]
    root = F.md5(F.array_join(F.col(f"{sections}.d"), ""))
    return rows.withColumn(out, F.concat_ws("|", root, *(F.array_join(x, " ") for x in levels))).drop(paragraphs, ends, sections)


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprints of their texts."""
    whole = free_name(docs, "_whole")
    return with_tree(docs.drop(out).withColumn(whole, _whole(F.col(text))), whole, out).drop(whole)


# --- what fingerprints tell ---

def root(fingerprint: Column) -> Column:
    return F.substring_index(fingerprint, "|", 1)


def _level(fingerprint: Column, number: int) -> Column:
    """The items of a level, 1 to 3; none if it is empty."""
    return F.filter(F.split(F.split(fingerprint, r"\|")[number], " "), lambda x: x != "")


def _numbers(items: Column, at: int) -> Column:
    return F.transform(items, lambda x: F.split(x, ":")[at].cast("int"))


def _sum(numbers: Column, first: Column, n: Column) -> Column:
    """The sum of ``n`` numbers from the one at ``first``, from 0."""
    return F.aggregate(F.slice(numbers, first + 1, F.greatest(n, F.lit(0))), F.lit(0), lambda a, b: a + b)


def _differs(a: Column, b: Column) -> Column:
    """The first place, from 0, where two lists differ; -1 if none."""
    return F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True).cast("int") - 1


def likeness(a: Column, b: Column) -> Column:
    """Of 0 to 1: 1 if the roots are equal, else the code points of the distinct
    pieces that both texts have, as a part of those of the one with more."""
    x, y = F.array_distinct(_level(a, 3)), F.array_distinct(_level(b, 3))
    chars = lambda pieces: F.aggregate(pieces, F.lit(0).cast("long"), lambda n, p: n + F.substring_index(p, ":", -1).cast("int"))
    most = F.greatest(chars(x), chars(y))
    return F.when(root(a) == root(b), F.lit(1.0)).when(most == 0, F.lit(0.0)).otherwise(chars(F.array_intersect(x, y)) / most)


def with_first_edit(rows: DataFrame, a: str, b: str, out: str = "edit_at") -> DataFrame:
    """Adds where, in code points from 0, the first piece of ``a`` that differs
    from ``b`` begins: null if the texts are equal. Only the first differing
    section and paragraph are read."""
    s, p0, pa, pb, p, l0, j = (free_name(rows, f"_{out}_{n}") for n in ("s", "p0", "pa", "pb", "p", "l0", "j"))
    c = F.col
    rows = rows.withColumn(s, _differs(_level(c(a), 1), _level(c(b), 1)))
    rows = rows.withColumns({p0: _sum(_numbers(_level(c(a), 1), 1), F.lit(0), c(s)), pa: _level(c(a), 2), pb: _level(c(b), 2)})
    below = lambda x, n: F.slice(x, n + 1, F.size(x))
    rows = rows.withColumn(p, c(p0) + _differs(below(c(pa), c(p0)), below(c(pb), c(p0))))
    rows = rows.withColumn(l0, _sum(_numbers(c(pa), 1), F.lit(0), c(p)))
    rows = rows.withColumn(j, _differs(below(_level(c(a), 3), c(l0)), below(_level(c(b), 3), c(l0))))
    at = _sum(_numbers(c(pa), 2), F.lit(0), c(p)) + c(p) + _sum(_numbers(_level(c(a), 3), 1), c(l0), c(j))
    return rows.withColumn(out, F.when(root(c(a)) != root(c(b)), at.cast("long"))).drop(s, p0, pa, pb, p, l0, j)


def changed_pieces(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """``(key, start, len)`` of the pieces of ``b`` that ``a`` has nowhere, in code
    points of b's text. ``key`` tells the rows apart. Rows with equal roots are
    not opened, nor are paragraphs that ``a`` has."""
    open_ = rows.where(root(F.col(a)) != root(F.col(b))).select(F.col(key).alias("key"), _level(F.col(a), 2).alias("old"), _level(F.col(a), 3).alias("had"), _level(F.col(b), 2).alias("new"), _level(F.col(b), 3).alias("pieces"))
    each = open_.select("key", "old", "had", "pieces", F.posexplode("new").alias("p", "item"))
    n, chars = (F.split("item", ":")[i].cast("int") for i in (1, 2))
    before = Window.partitionBy("key").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumns({"n": n, "first": F.coalesce(F.sum(n).over(before), F.lit(0)), "start": F.coalesce(F.sum(chars + 1).over(before), F.lit(0))})
    each = each.where(~F.array_contains("old", F.col("item"))).select("key", "had", "p", "start", F.posexplode(F.slice("pieces", (F.col("first") + 1).cast("int"), F.col("n"))).alias("j", "piece"))
    size = F.split("piece", ":")[1].cast("int")
    within = Window.partitionBy("key", "p").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumns({"len": size, "start": F.col("start") + F.coalesce(F.sum(size).over(within), F.lit(0))})
    return each.where(~F.array_contains("had", F.col("piece"))).select(F.col("key").alias(key), F.col("start").cast("long").alias("start"), "len")


# --- edited texts ---

def _key(doc_id: Column) -> Column:
    """A doc_id as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit(""))


def _links(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(key, before, wanted)``: for each doc_id the key of the one before it (the
    last one's for the first), and how many code points that one takes from it."""
    quarter = F.floor(F.char_length(_whole(F.col(text))) / 4).cast("int")
    ids = materialize(docs.groupBy(F.col(doc_id).alias("id")).agg(F.max(quarter).alias("wanted")), "ids")
    last = ids.agg(F.max(F.struct("id", "wanted"))).first()[0]
    ordered = running(ids, ["id"], {"before": ("max", F.struct("id", "wanted"))})
    kind = ids.schema["id"].dataType
    around = F.struct(F.lit(last["id"] if last else None).cast(kind).alias("id"), F.lit(last["wanted"] if last else 0).cast("int").alias("wanted"))
    before = F.coalesce("before", around)
    return ordered.select(_key(F.col("id")).alias("key"), _key(before["id"]).alias("before"), before["wanted"].alias("wanted"))


def edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``n_chars``, ``edited_sha256``, the two
    fingerprints, and the likeness of the text's to the edited text's
    (``near_edited``) and to the next document's (``near_next``); ``edit_at`` is
    where the fingerprints say that the edit begins.

    The edited text has the last quarter of the code points, rounded down,
    replaced by the first as many of the next document in the order of doc_ids.
    Texts move once, by doc_id, and what the document before takes from one, at
    most a quarter, moves to that one together with the fingerprint."""
    links = _links(docs, doc_id, text)
    own = _key(F.col(doc_id))
    here = docs.select(doc_id, text).join(links, own == F.col("key"))
    here = here.select("before", F.substring(_whole(F.col(text)), F.lit(1), F.col("wanted")).alias("head"), _whole(F.col(text)).alias("whole"))
    here = with_tree(here.withColumn("version", F.xxhash64("whole")), "whole", "next")
    heads = here.groupBy("before").agg(F.min_by(F.struct("head", "next"), F.col("version")).alias("n"))
    rest = [c for c in docs.columns if c != text and c.lower() not in ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edit_at")]
    whole, key, n, new, following = (free_name(docs, f"_{x}") for x in ("whole", "key", "n", "new", "following"))
    heads = heads.select(F.col("before").alias(key), F.col("n").alias(n))
    both = docs.select(*rest, text).join(heads, own == F.col(key), "left")
    size = F.char_length(whole)
    quarter = F.floor(size / 4).cast("int")
    both = both.select(*rest, _whole(F.col(text)).alias(whole), F.col(f"{n}.head").alias(new), F.col(f"{n}.next").alias(following))
    both = both.withColumn(new, F.concat(F.substring(whole, F.lit(1), size - quarter), F.substring(_whole(F.col(new)), F.lit(1), quarter)))
    out = with_tree(with_tree(both, whole, "fingerprint"), new, "edited_fingerprint")
    out = out.withColumns({"n_chars": size.cast("long"), "edited_sha256": F.sha2(new, 256)}).drop(whole, new)
    out = out.withColumns({"near_edited": likeness(F.col("fingerprint"), F.col("edited_fingerprint")), "near_next": likeness(F.col("fingerprint"), F.col(following))})
    return with_first_edit(out, "fingerprint", "edited_fingerprint").drop(following)
