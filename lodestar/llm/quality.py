"""Quality classifier: a weak-label model that trains a hashed linear scorer.

Overlapping heuristic labellers vote on each document: good, bad or no vote.
Expectation-maximisation over the counts of all documents' vote patterns finds
how often each labeller gives each vote on good and on bad documents, without
any true labels. The posterior labels of a bounded sample train a logistic
scorer over hashed features, and the scorer decides on every document.

The share of distinct words falls with a text's length, so it is taken in
windows of 200 words over the whole text: their mean makes the vote, and a text
with a window that would be bad by itself gets no good vote.

The sample is the distinct texts of least hash, ``SAMPLE`` of them at most, and
of these the first that have no more than ``FEATURES`` features together.

Rows: null, empty and wordless texts have score 0 and are rejected. Every row
stands for itself; ties and repeated rows get equal scores. Extra columns stay; a
column that has the name of one that is added is replaced. A table without any
text that has words rejects everything."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.shared import arrow_map, free_name, materialize

GOOD, BAD, NONE = 1, 2, 0
#: Hashed features of the scorer.
WIDTH = 1 << 16
#: Distinct documents, by hash, on which the scorer is fitted at most, and how
#: many features all of them may have (8 bytes each, on the driver).
SAMPLE, FEATURES = 4000, 16_000_000
#: Bytes of a text whose trigrams are counted at once.
CHUNK = 1 << 20
#: Words of a window in which distinct words are counted.
WINDOW = 200

_WORDY = re.compile(r"\w")
_MARKS = re.compile(r"[^\w\s]{2,}")


def distinct_shares(words: list[str]) -> list[float]:
    """The share of distinct words in each of the consecutive windows; the last
    one ends with the text, and a shorter text is one window."""
    starts = [*range(0, len(words) - WINDOW, WINDOW), max(0, len(words) - WINDOW)]
    return [len(set(words[i : i + WINDOW])) / min(len(words), WINDOW) for i in starts]


def measures(text: str) -> dict[str, float] | None:
    """Shares that the labellers vote by; None for a text without words."""
    words = text.split()
    if not words or not _WORDY.search(text):
        return None
    n = len(words)
    distinct = distinct_shares(words)
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    alnum = sum(map(str.isalnum, text))
    upper = sum(map(str.isupper, text))
    lower = sum(map(str.islower, text))
    return {
        "words": float(n),
        "marked": len(_MARKS.findall(text)) / n,
        "upper": upper / max(1, upper + lower),
        "distinct": sum(distinct) / len(distinct),
        "least_distinct": min(distinct),
        "repeat": sum(a == b for a, b in zip(words, words[1:])) / max(1, n - 1),
        "bare": sum(len(w) == 1 and not w.isalnum() for w in words) / n,
        "line_repeat": 1 - len(set(lines)) / max(1, len(lines)),
        "alnum": alnum / max(1, len(text) - text.count(" ") - text.count("\n")),
        "stops": sum(text.count(x) for x in ".?!;") / n,
    }


def _vote(value: float, good: float, bad: float) -> int:
    """Good up to ``good``, bad from ``bad`` (or the other way round), else no vote."""
    if good < bad:
        return GOOD if value <= good else BAD if value >= bad else NONE
    return GOOD if value >= good else BAD if value <= bad else NONE


#: Labellers: name, measure, good up to (or from), bad from (or up to).
LABELLERS = (
    ("clusters of marks", "marked", 0.05, 0.25),
    ("share of letters and digits", "alnum", 0.93, 0.84),
    ("capitals", "upper", 0.15, 0.5),
    ("repeated neighbours", "repeat", 0.03, 0.3),
    ("distinct words", "distinct", 0.45, 0.2),
    ("bare marks", "bare", 0.02, 0.2),
    ("repeated lines", "line_repeat", 0.2, 0.6),
)
#: Measures of a text's worst part: if it is bad, the text gets no good vote.
WORST = {"distinct": "least_distinct"}


def votes(text: str | None) -> list[int]:
    m = measures(text or "")
    if m is None:
        return [NONE] * len(LABELLERS)
    out = [_vote(m[k], good, bad) for _, k, good, bad in LABELLERS]
    worst = [_vote(m[WORST.get(k, k)], good, bad) for _, k, good, bad in LABELLERS]
    return [NONE if v == GOOD and w == BAD else v for v, w in zip(out, worst)]


@dataclass
class WeakLabels:
    """``prior`` of good, and ``given[c, l, v]``: how likely labeller l votes v
    on documents of class c (0 bad, 1 good)."""

    prior: float
    given: object

    def posterior(self, patterns):
        """Of good, for each row of votes."""
        import numpy as np

        p = np.asarray(patterns).reshape(-1, self.given.shape[1])
        logs = [np.log(self.given[c][np.arange(p.shape[1]), p]).sum(axis=1) + np.log(x) for c, x in ((0, 1 - self.prior), (1, self.prior))]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))

    def accuracies(self) -> dict[str, float]:
        """How often each labeller is right where it votes."""
        g, p = self.given, self.prior
        right = p * g[1, :, GOOD] + (1 - p) * g[0, :, BAD]
        wrong = p * g[1, :, BAD] + (1 - p) * g[0, :, GOOD]
        return {name: float(x) for (name, *_), x in zip(LABELLERS, right / (right + wrong))}


def fit_weak_labels(patterns, counts, rounds: int = 200, smooth: float = 0.5) -> WeakLabels:
    """Expectation-maximisation over vote patterns and how many documents have
    each. It begins with what most votes say; a single bad vote counts as bad,
    as each labeller sees only its own kind of bad text."""
    import numpy as np

    p, n = np.asarray(patterns, dtype=np.int64).reshape(-1, len(LABELLERS)), np.asarray(counts, dtype=np.float64)
    good = np.where((p == BAD).any(axis=1), 0.1, np.where((p == GOOD).any(axis=1), 0.9, 0.5))
    model = WeakLabels(0.5, None)
    for _ in range(rounds):
        given = np.full((2, p.shape[1], 3), smooth)
        for c, w in ((0, n * (1 - good)), (1, n * good)):
            for v in (NONE, GOOD, BAD):
                given[c, :, v] += (w[:, None] * (p == v)).sum(axis=0)
        model = WeakLabels(float((smooth + (n * good).sum()) / (2 * smooth + n.sum())), given / given.sum(axis=2, keepdims=True))
        new = model.posterior(p)
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return model


def features(text: str):
    """Hashed features of a text with words: byte trigrams by the square root of
    their share, and its measures in steps."""
    import numpy as np

    m = measures(text)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    total = np.zeros(WIDTH, np.float64)
    for at in range(0, max(1, len(raw) - 2), CHUNK):
        part = raw[at : at + CHUNK + 2].astype(np.uint32)
        if len(part) >= 3:
            h = (part[:-2] << 16 | part[1:-1] << 8 | part[2:]) * np.uint32(2654435761)
            total += np.bincount((h >> np.uint32(17)).astype(np.int64), minlength=WIDTH)
    index = np.flatnonzero(total)
    value = np.sqrt(total[index] / max(1.0, total.sum()))
    steps = [WIDTH // 2 + i * 64 + min(20, int(x * 20)) for i, x in enumerate(v for k, v in m.items() if k != "words")]
    return np.concatenate([index, steps]).astype(np.int32), np.concatenate([value, np.full(len(steps), 0.5)]).astype(np.float32)


def fit_scorer(rows: list, labels, rounds: int = 30, rate: float = 0.5, seed: int = 3):
    """Weights of a logistic scorer (the last is the bias), by AdaGrad over the
    features of the sample with soft labels."""
    import numpy as np

    w, seen = np.zeros(WIDTH + 1), np.full(WIDTH + 1, 1e-6)
    random = np.random.default_rng(seed)
    for _ in range(rounds):
        for k in random.permutation(len(rows)):
            index, value = rows[k]
            g = 1 / (1 + np.exp(-np.clip(w[index] @ value + w[-1], -50, 50))) - labels[k]
            step = g * value
            seen[index] += step * step
            w[index] -= rate * step / np.sqrt(seen[index])
            seen[-1] += g * g
            w[-1] -= rate * g / np.sqrt(seen[-1])
    return w


@dataclass
class Classifier:
    weak: WeakLabels
    scorer: object

    def score(self, text: str | None) -> float:
        import math

        if not _WORDY.search(text or ""):
            return 0.0
        index, value = features(text)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, float(self.scorer[index] @ value + self.scorer[-1])))))


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE, features_most: int = FEATURES) -> Classifier | None:
    """Votes of all documents fit the weak labels; the ``sample`` distinct texts
    of least hash fit the scorer, as far as they have ``features_most`` features
    (the first always counts). None if there are no texts with words."""
    import numpy as np

    rows = docs.select(F.col(text).alias("text"))

    def make():
        return lambda cols: {"hash": cols["hash"], "votes": [v if _WORDY.search(t or "") else None for t, v in zip(cols["text"], map(votes, cols["text"]))]}

    hashed = rows.withColumn("hash", F.xxhash64("text"))
    voted = materialize(arrow_map(hashed, make, "hash long, votes array<int>").where("votes is not null"), "votes")
    found = voted.groupBy("votes").count().collect()  # at most 3 to the number of labellers
    if not found:
        return None
    weak = fit_weak_labels([r.votes for r in found], [r["count"] for r in found])
    chosen = voted.select("hash", "votes").dropDuplicates(["hash"]).orderBy("hash").limit(sample).collect()
    last = max(r.hash for r in chosen)

    def make_features():
        def step(cols):
            got = [features(t) for t in cols["text"]]
            return {"hash": cols["hash"], "index": [g[0] for g in got], "value": [g[1] for g in got]}

        return step

    picked = hashed.where((F.col("hash") <= last) & F.col("text").rlike(r"[\p{L}\p{N}_]")).dropDuplicates(["hash"])
    picked = materialize(arrow_map(picked, make_features, "hash long, index array<int>, value array<float>", 64), "features")
    sizes, total = {r["hash"]: r.n for r in picked.select("hash", F.size("index").alias("n")).collect()}, 0
    fits = []
    for r in chosen:
        if (total := total + sizes.get(r["hash"], 0)) > features_most and fits:
            break
        fits += [r] * (r["hash"] in sizes)
    got = picked.where(F.col("hash") <= fits[-1]["hash"]).toPandas().to_dict("records") if fits else []
    got = {r["hash"]: (np.asarray(r["index"]), np.asarray(r["value"])) for r in got}
    labels = weak.posterior([r.votes for r in fits]) if fits else []
    return Classifier(weak, fit_scorer([got[r["hash"]] for r in fits], labels).astype(np.float64))


def score(docs: DataFrame, model: Classifier | None, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Add ``score``, how likely the document is good, and ``kept``."""
    rest = docs.select(*(c for c in docs.columns if c.lower() not in ("score", "kept")))
    if model is None:
        return rest.withColumn("score", F.lit(0.0)).withColumn("kept", F.lit(False))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = rest.select("*", F.lit(0.0).alias("score"), F.lit(True).alias("kept")).schema

    def make():
        m = shared.value

        def step(cols):
            scores = [m.score(t) for t in cols[text]]
            return cols | {"score": scores, "kept": [s >= threshold for s in scores]}

        return step

    return arrow_map(rest, make, schema, 128)


def classify(docs: DataFrame, text: str = "text") -> DataFrame:
    """Fit on ``docs`` and add ``score`` and ``kept`` to each row."""
    return score(docs, fit(docs, text), text)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that the classifier doesn't reject, with their own columns."""
    s, k = free_name(docs, "_score"), free_name(docs, "_kept")
    columns = [c for c in docs.columns]
    safe = docs.toDF(*(s if c.lower() == "score" else k if c.lower() == "kept" else c for c in columns))
    return classify(safe, text).where("kept").select(*(F.col(n).alias(c) for n, c in zip(safe.columns, columns)))
