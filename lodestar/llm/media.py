"""Media columns: payloads stored as WAV files, and audio features read from them.

A payload is the text's UTF-8 bytes, filled up with spaces to a positive multiple
of a block; it is stored as unsigned 8-bit mono samples by the wave module. The
reader takes the samples back out of the file, short-time Fourier transforms
find spectral peaks, and pairs of peaks become time-coded fingerprints.

Rows: a null text is empty and becomes one block of spaces; a null media file
has a null payload and no fingerprints. A text of any length is one file in its
row, up to the format's 4 GB; an empty table gives an empty result. Every row
stands for itself. Extra columns stay; a column that has the name of one that is
added is replaced."""

from __future__ import annotations

import io
import wave

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.shared import arrow_map

BLOCK = 192
RATE = 8000
#: Samples in a window and between windows; both divide into blocks.
FRAME, HOP = 192, 96
#: Peaks kept in a frame, and frames ahead in which a peak finds its partners.
PEAKS, AHEAD = 2, 3
#: Frames transformed at once, which bounds memory for very long payloads.
FRAMES = 4096

MARK = "struct<time:int,code:int>"


def to_payload(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // BLOCK)) * BLOCK, b" ")


def write_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("8-bit mono samples are needed")
        return w.readframes(w.getnframes())


def spectral_peaks(payload: bytes):
    """For each frame, the bins of its ``PEAKS`` strongest local maxima, strongest
    first, -1 where there are fewer. Magnitudes are compared as whole numbers."""
    import numpy as np

    samples = np.frombuffer(payload, dtype=np.uint8)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    found = []
    for at in range(0, len(frames), FRAMES):
        part = frames[at : at + FRAMES].astype(np.float32) - np.float32(128)
        size = np.rint(np.abs(np.fft.rfft(part * window, axis=1)) * 4).astype(np.int64)
        inner = size[:, 1:-1]
        # the bin breaks ties, so that equal magnitudes always give the same order
        rank = np.where((inner > size[:, :-2]) & (inner >= size[:, 2:]), inner * 128 + np.arange(127, 127 - inner.shape[1], -1), 0)
        best = np.argpartition(rank, -PEAKS, axis=1)[:, -PEAKS:]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(rank, best, 1), axis=1), 1)
        found.append(np.where(np.take_along_axis(rank, best, 1) > 0, best + 1, -1))
    return np.concatenate(found)


def fingerprints(payload: bytes):
    """Times (frames) and codes of the payload's peak pairs, by time. A code
    packs both bins and the frames between them."""
    import numpy as np

    peaks = spectral_peaks(payload)
    times, codes = [], []
    for ahead in range(1, AHEAD + 1):
        a, b = peaks[:-ahead], peaks[ahead:]
        for i in range(PEAKS):
            for j in range(PEAKS):
                at = np.flatnonzero((a[:, i] >= 0) & (b[:, j] >= 0))
                times.append(at)
                codes.append(a[at, i] << 16 | b[at, j] << 8 | ahead)
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((codes, times))
    return times[order], codes[order]


def add_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace ``text`` by ``n_bytes`` of it and ``media``, the WAV file."""
    rest = [c for c in docs.columns if c != text and c.lower() not in ("n_bytes", "media")]
    rows = docs.select(*rest, text)
    schema = rows.select(*rest, F.lit(0).cast("long").alias("n_bytes"), F.lit(b"").alias("media")).schema

    def make():
        return lambda cols: {c: cols[c] for c in rest} | {"n_bytes": [len((t or "").encode("utf-8", "surrogatepass")) for t in cols[text]], "media": [write_wav(to_payload(t)) for t in cols[text]]}

    return arrow_map(rows, make, schema, 256)


def read_media(files: DataFrame) -> DataFrame:
    """Add ``payload``, the samples in ``media``, and ``marks``, the time-coded
    fingerprints."""
    new = ("payload", "marks")
    rows = files.select(*(c for c in files.columns if c.lower() not in new))
    schema = rows.select("*", F.lit(None).cast("binary").alias("payload"), F.array().cast(f"array<{MARK}>").alias("marks")).schema

    def make():
        import pyarrow as pa

        def step(cols):
            payloads = [None if m is None else read_wav(m) for m in cols["media"]]
            marks = [fingerprints(p) if p else ((), ()) for p in payloads]
            times = pa.array([x for t, _ in marks for x in t], pa.int32())
            codes = pa.array([x for _, c in marks for x in c], pa.int32())
            ends = [0]
            for t, _ in marks:
                ends.append(ends[-1] + len(t))
            flat = pa.StructArray.from_arrays([times, codes], ["time", "code"])
            return cols | {"payload": payloads, "marks": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)}

        return step

    return arrow_map(rows, make, schema, 64)
