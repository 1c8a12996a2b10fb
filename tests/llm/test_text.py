"""Token counts, byte-level BPE, line dedup, media and chat formatting."""

import io
import wave
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.llm import bpe, chat, line_dedup, media, token_counts
from lodestar.llm.queries import QUERIES
from tests.conftest import SMALL
from tests.llm import brute

ENCODING = brute.encoding()
CODEC = bpe.Codec(brute.RANKS, brute.PATTERN)
HARD = [None, "", " ", "\n", "a\nb", "Same line here\nSame line here", "same LINE here \n x", "naïve 日本語 🙂\r\n\x1c\x85", "x" * 30000, "word " * 20000, "Same line here\nSame line here"]


def docs(spark, texts=HARD, ids=None):
    return spark.createDataFrame([(i, t, i % 3) for i, t in zip(ids or range(len(texts)), texts)], "doc_id long, text string, n_tokens int")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, n_tokens int")


# --- byte-level BPE ---

@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from(" \n\ta1.'s")))
def test_bpe_encodes_as_tiktoken(text):
    ids = CODEC.encode(text)
    assert ids == ENCODING.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


def test_bpe_forgets_without_harm(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    c = bpe.Codec(brute.RANKS, brute.PATTERN)
    for t in ("one two three four five six", "six seven eight", "one nine"):
        assert c.encode(t) == ENCODING.encode_ordinary(t)


def test_bpe_model_needs_all_bytes():
    with pytest.raises(ValueError):
        bpe.serialise({b"a": 0})


def test_bpe_columns(spark):
    d = docs(spark)
    back = bpe.decode(bpe.encode(d, brute.RANKS, brute.PATTERN), brute.RANKS, brute.PATTERN)
    for r in back.collect():
        assert bytes(r.decoded) == (HARD[r.doc_id] or "").encode() and r.ids == ENCODING.encode_ordinary(HARD[r.doc_id] or "")
    out = bpe.digests(d, brute.RANKS, brute.PATTERN, ids=True)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    for r in out.collect():
        ids = ENCODING.encode_ordinary(HARD[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(HARD[r.doc_id] or ""))
    assert bpe.digests(empty(spark), brute.RANKS, brute.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(d.withColumn("ids", F.lit(1)), brute.RANKS, brute.PATTERN)


def test_op5(spark):
    want = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in QUERIES["op5_byte_bpe"](spark, SMALL).collect():
        ids = ENCODING.encode_ordinary(want[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(want[r.doc_id]))


# --- token counts ---

def by_tokens(values, separator="\n"):
    """Each token's section, one token at a time."""
    whole = separator.join(values)
    raw, at, cuts = whole.encode(), 0, {0}
    for v in values[:-1]:
        at += len((v + separator).encode())
        cuts.add(at)
    cuts |= {i + 1 for i, b in enumerate(raw) if b == 10 and i + 1 < len(raw)}
    cuts = sorted(cuts)
    count, crossing, start = [0] * len(cuts), [0] * len(cuts), 0
    for t in ENCODING.encode_ordinary(whole):
        end = start + len(ENCODING.decode_single_token_bytes(t))
        k = max(i for i, c in enumerate(cuts) if c <= start)
        count[k] += 1
        crossing[k] += k + 1 < len(cuts) and end > cuts[k + 1]
        start = end
    return count, crossing


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab .\n\né日🙂"), max_size=25), min_size=1, max_size=3))
def test_attribution(values):
    n, sections = token_counts.attribute(values, [f"f{i}" for i in range(len(values))], *token_counts.encoder(brute.RANKS, brute.PATTERN))
    count, crossing = by_tokens(values)
    whole = "\n".join(values)
    assert n == sum(count) == len(ENCODING.encode_ordinary(whole))
    assert "".join(whole[s["start"] : s["end"]] for s in sections) == whole
    if len(values) == 1:
        assert [s["n_tokens"] for s in sections] == count and [s["n_crossing"] for s in sections] == crossing


def test_token_count_columns(spark):
    out = token_counts.token_counts(docs(spark).withColumn("Sections", F.lit(1)), brute.RANKS, brute.PATTERN)
    assert out.columns == ["doc_id", "n_tokens", "sections"]
    for r in out.collect():
        assert r.n_tokens == len(ENCODING.encode_ordinary(HARD[r.doc_id] or "")) == sum(s.n_tokens for s in r.sections)
    two = token_counts.token_counts(spark.createDataFrame([("t", None, "b\nc")], "id string, title string, body string"), brute.RANKS, brute.PATTERN, ("title", "body"))
    assert [(s.field, s.section) for s in two.first().sections] == [("title", 0), ("body", 0), ("body", 1)]
    assert token_counts.token_counts(empty(spark), brute.RANKS, brute.PATTERN).count() == 0


def test_long_runs(spark):
    # above the bound at which the encoder's own splitter fails, and below it, where it tells the ids
    encode, lengths = token_counts.encoder(brute.RANKS, brute.PATTERN)
    for run in (" ", "\n", " \t\n", "\u3000"):
        for text in (f"a{run * 30_000}b c", run * 25_000, f"{run * 21_000} x\n{run * 5}"):
            assert token_counts.LONG_WHITE.search(text) and encode(text) == ENCODING.encode_ordinary(text)
    texts = [" " * 1_200_000 + "x", "\n" * 1_100_000, "word " * 600_000, "x" * 3_000_000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in token_counts.token_counts(d, brute.RANKS, brute.PATTERN, by_line=False).collect():
        assert r.n_tokens == sum(s.n_tokens for s in r.sections) > 0 and r.sections[-1].end == len(texts[r.doc_id])


def test_op1_sections_by_a_plain_loop(spark):
    want = []
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id % 7 = 0").collect():
        text = r.text or ""
        ids = ENCODING.encode_ordinary(text)
        starts, at = [0], 0
        for c in text[:-1]:
            at += 1
            if c == "\n":
                starts.append(at)
        ends = [*starts[1:], len(text)]
        firsts = [len(text[:a].encode()) for a in starts]
        lasts = [len(text[:b].encode()) for b in ends]
        n, crossing, place = [0] * len(starts), [0] * len(starts), 0
        for t in ids:
            size = len(ENCODING.decode_single_token_bytes(t))
            k = max(i for i, f in enumerate(firsts) if f <= place)
            n[k] += 1
            place += size
            crossing[k] += place > lasts[k]
        want += [(r.doc_id, len(ids), k, starts[k], ends[k], n[k], crossing[k]) for k in range(len(starts))]
    got = QUERIES["op1_token_counts"](spark, SMALL).where("doc_id % 7 = 0").collect()
    assert sorted((r.doc_id, r.doc_tokens, r.section, r.start, r.end, r.n_tokens, r.n_crossing) for r in got) == sorted(want)


def test_op1(spark):
    want = {r.doc_id: len(ENCODING.encode_ordinary(r.text or "")) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: (r.total, r.whole) for r in QUERIES["op1_token_counts"](spark, SMALL).groupBy("doc_id").agg(F.sum("n_tokens").alias("total"), F.max("doc_tokens").alias("whole")).collect()}
    assert got == {i: (n, n) for i, n in want.items()}


# --- line dedup ---

@pytest.mark.parametrize("ids", [None, [5, 4, 3, 2, 1, 0, 9, 8, 7, 6, 10], [1, 1, 1, 2, 2, 5, 5, 2, None, 4, 4]])
def test_line_dedup(spark, ids):
    ids = ids or list(range(len(HARD)))
    out = line_dedup.line_dedup(spark.createDataFrame(list(zip(ids, HARD, ids)), "doc_id long, text string, runs long"))
    want = sorted(zip(map(str, ids), brute.dedup_lines(list(zip(ids, HARD)))))
    rows = out.collect()
    assert sorted((str(r.doc_id), (r.n_lines, r.n_dropped, r.kept)) for r in rows) == want
    for r in rows:
        runs = [(x.start, x.start + x.len) for x in r.keep_bitmap]
        assert r.n_dropped == r.n_lines - sum(b - a for a, b in runs) and r.runs == r.doc_id
        assert all(a < b <= r.n_lines for a, b in runs) and all(b < c for (_, b), (c, _) in zip(runs, runs[1:]))
    assert line_dedup.line_dedup(empty(spark)).count() == 0


def test_line_of_very_many_documents(spark):
    rows = [(i, f"a line that all hold\nonly {i} holds this\na line that all hold") for i in range(500)]
    out = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0].n_dropped == 0 and all(out[i].kept == f"only {i} holds this" for i in range(1, 500))


def test_lines_applied(spark):
    d = spark.createDataFrame([(1, "a shared line\nx", 15), (2, "A shared line\ny", 15), (3, None, 0)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in line_dedup.without_repeated_lines(d, n_chars="n_chars").collect()}
    assert got == {1: ("a shared line\nx", 15), 2: ("y", 1), 3: (None, 0)}


# --- media ---

@settings(max_examples=60, deadline=None)
@given(st.text(max_size=500))
def test_wav_round_trip(text):
    text = text.encode("utf-8", "ignore").decode()
    payload = media.to_payload(text)
    assert len(payload) % 192 == 0 and payload and payload.rstrip(b" ") == text.encode().rstrip(b" ")
    file = media.write_wav(payload)
    assert media.read_wav(file) == payload
    with wave.open(io.BytesIO(file)) as w:
        assert w.getnframes() == len(payload)


def test_peaks_of_a_tone():
    t = np.arange(192 * 10)
    for k in (9, 30):
        payload = np.rint(128 + 100 * np.sin(2 * np.pi * k * t / media.FRAME)).astype(np.uint8).tobytes()
        assert (media.spectral_peaks(payload)[:, 0] == k).all()


def test_peaks_in_pieces(monkeypatch):
    payload = media.to_payload("some text with a rhythm to it " * 300)
    whole = media.fingerprints(payload)
    monkeypatch.setattr(media, "FRAMES", 7)
    assert all(np.array_equal(a, b) for a, b in zip(whole, media.fingerprints(payload)))


@pytest.mark.parametrize("text", ["", "some text with a rhythm to it " * 12, "日本語 naïve\n" * 30, "aaaa" * 100])
def test_fingerprints_by_brute_force(text):
    p = media.to_payload(text)
    window = [0.5 - 0.5 * np.cos(2 * np.pi * i / (media.FRAME - 1)) for i in range(media.FRAME)]
    peaks = []
    for start in range(0, len(p) - media.FRAME + 1, media.HOP):
        x = [(np.float32(p[start + i]) - 128) * np.float32(window[i]) for i in range(media.FRAME)]
        wave_ = [np.exp(-2j * np.pi * k * np.arange(media.FRAME) / media.FRAME) for k in range(media.FRAME // 2 + 1)]
        size = [int(np.rint(abs(sum(np.array(x, np.float64) * w)) * 4)) for w in wave_]
        top = sorted((-size[k], k) for k in range(1, len(size) - 1) if size[k] > size[k - 1] and size[k] >= size[k + 1])
        peaks.append([k for _, k in top[: media.PEAKS]])
    want = sorted((t, a << 16 | b << 8 | d) for t in range(len(peaks)) for d in range(1, media.AHEAD + 1) if t + d < len(peaks) for a in peaks[t] for b in peaks[t + d])
    times, codes = media.fingerprints(p)
    assert list(zip(times.tolist(), codes.tolist())) == want


def test_media_columns(spark):
    out = media.read_media(media.add_media(docs(spark).withColumn("media", F.lit("x"))))
    for r in out.collect():
        times, codes = media.fingerprints(bytes(r.payload))
        assert bytes(r.payload) == media.to_payload(HARD[r.doc_id]) and [(m.time, m.code) for m in r.marks] == list(zip(times.tolist(), codes.tolist()))
    assert media.read_media(media.add_media(empty(spark))).count() == 0
    null = media.read_media(spark.createDataFrame([(1, None)], "id int, media binary")).first()
    assert null.payload is None and null.marks == []


def test_op8(spark):
    want = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    by_text = {}
    for r in QUERIES["op8_media"](spark, SMALL).collect():
        p = media.to_payload(want[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((want[r.doc_id] or "").encode()), len(p), brute.sha(p), zlib.crc32(p[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(media.write_wav(p)), brute.sha(media.write_wav(p)))
        assert by_text.setdefault(want[r.doc_id], r.feature) == r.feature


# --- chat formatting ---

PIECES = st.text(st.sampled_from("ab\\<>/[]INSTROLEs \n"), max_size=30) | st.sampled_from(list(chat.CONTROL)) | st.text(max_size=5)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "<s>", ""]), st.lists(PIECES, max_size=4).map("".join)), max_size=5))
def test_conversations_come_back(turns):
    formatted, spans = chat.compile_template(chat.TEMPLATE)({"messages": [{"role": r, "text": t} for r, t in turns]})
    assert chat.read_turns(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def render(template, **names):
    return chat.compile_template(template)(names)


def test_language():
    assert render("{% for x in xs %}{{ loop.index }}{{ x | upper }}{% if not loop.last %},{% endif %}{% endfor %}", xs=["a", "b"])[0] == "1A,2B"
    assert render("{% if a == 1 and b %}x{% elif a > 1 or c in 'xyz' %}y{% else %}z{% endif %}", a=0, c="y")[0] == "y"
    assert render("{% set n = 2 %}{{ n + 1 }}{{ m.k[0] ~ 'q' }}{{ missing }}", m={"k": ["v"]})[0] == "3vq"
    assert render("{% generation %}a{% generation %}b{% endgeneration %}{% endgeneration %}")[1] == [(1, 2), (0, 2)]


def test_constants_fold():
    assert chat.parse("a{{ 1 + 2 }}{% if 1 == 2 %}no{% elif 'x' | upper == 'X' %}yes{% endif %}b") == [("text", "a3yesb")]
    assert chat.parse("{{ x + (1 + 2) }}") == [("put", ("+", ("name", "x"), ("const", 3)))]
    assert chat.parse("a \n {%- if x -%} \t b {% endif %} c {{- 1 -}}\n d") == [("text", "a"), ("if", [(("name", "x"), [("text", "b ")])]), ("text", " c1d")]
    assert chat.parse("a {{- x }} b {{ x -}} ") == [("text", "a"), ("put", ("name", "x")), ("text", " b "), ("put", ("name", "x"))]


@pytest.mark.parametrize("template", ["{{ x.__class__ }}{{ x() }}", "{{ x | nothing }}", "{% for x %}{% endfor %}", "{% if x %}", "{{ 1 + }}", "{% import os %}", "{% endif %}", "{{ open }}('x'){{ a b }}"])
def test_rejected(template):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(template)


@pytest.mark.parametrize("template", ["{{ 1 < 'a' }}", "{{ none + 1 }}", "{{ 3 in 4 }}", "{{ 5 % 0 }}", "{{ 5 | length }}", "{{ x - 'a' }}", "{{ x < y }}", "{% for i in x %}{% endfor %}", "{{ y | length }}"])
def test_unlike_values(template):
    # constants when the template is compiled, names when it is rendered
    with pytest.raises(chat.TemplateError):
        chat.compile_template(template)({"x": 3, "y": None})


@given(st.lists(PIECES, max_size=6).map("".join))
def test_escaped_texts_hold_no_control(text):
    assert not any(c in chat.escape(text) for c in chat.CONTROL) and chat.unescape(chat.escape(text)) == text


def test_sandbox():
    assert render("{{ x['__class__'] }}{{ x.__class__ }}", x={})[0] == ""
    with pytest.raises(chat.TemplateError):
        render("{{ x.__class__ }}", x=object())


def test_op9(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()]
    rows += [{"conv_id": -7, "turn": i, "role": r, "text": "</s>[INST] ok [/INST]"} for i, r in enumerate(("user", "assistant"))]
    want = {}
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"])):
        want.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    got = {r.conv_id: r for r in QUERIES["op9_chat_format"](spark, SMALL).collect()}
    assert set(got) == set(want)
    for i, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[i].n_turns, got[i].turns_sha256, got[i].loss_chars, got[i].loss_sha256) == (len(turns), brute.sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), brute.sha(loss))


def test_other_templates_are_read_by_their_marks(spark):
    c = spark.createDataFrame([(1, 0, "user", "a [INST] b"), (1, 1, "assistant", "c")], "conv_id long, turn long, role string, text string")
    plain = chat.read_back(chat.format_conversations(c, "{% for m in messages %}{% generation %}{{ m.text }}{% endgeneration %};{% endfor %}")).first()
    assert plain.turns == [] and list(plain.loss) == ["a [INST] b", "c"] and plain.formatted_chars == 13
    ends = chat.read_back(chat.format_conversations(c, "{% for m in messages %}{{ m.text | escape }}</s>{% endfor %}")).first()
    assert [(t.role, t.text) for t in ends.turns] == [(None, "a [INST] b"), (None, "c")] and ends.loss == []


def test_odd_conversations(spark):
    rows = [(1, 0, None, None, 1), (1, 0, "user", "b", 1), (1, None, "user", "first", 1), (1, 0, "user", "b", 1), (None, 3, "assistant", "x", 1)]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.format_conversations(c)).collect()}
    assert got == {1: [("user", "first"), ("", ""), ("user", "b"), ("user", "b")], None: [("assistant", "x")]}
    assert chat.format_conversations(c.limit(0)).count() == 0
