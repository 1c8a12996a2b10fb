"""Plain versions of the operators, for small inputs."""

import base64
import hashlib
import re

import numpy as np
import public_tokenizers
import tiktoken

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def encoding():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def line_key(line):
    line = line.strip(" \t\n\x0b\x0c\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)


def dedup_lines(docs):
    """For (doc_id, text): (n_lines, n_dropped, kept) in the same order."""
    holders = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            if i is not None and len(line_key(x)) >= 10:
                holders.setdefault(line_key(x), set()).add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if i is None or len(holders.get(line_key(x), ())) < 2 or min(holders[line_key(x)]) == i or len(line_key(x)) < 10]
        out.append((len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


def components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Reshares what sources can't take until none is above its cap. ``sizes``
    is a dict by source."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(full.values())
        over = [s for s in free if left * w[s] / sum(w[x] for x in free) > most * sizes[s]]
        if not over:
            return full | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        full |= {s: most * sizes[s] for s in over}


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def near_classes(docs, threshold=0.8):
    """Classes of (doc_id, text) by all pairs."""
    from lodestar.llm import minhash

    rows, df = [], np.zeros(1 << minhash.BUCKET_BITS)
    for i, t in docs:
        h, c = minhash.shingles(t, 5)
        rows.append((i, h, c))
        if len(h):
            df[np.unique(minhash._buckets(h))] += 1
    n = sum(len(h) > 0 for _, h, _ in rows)
    idf = 1 + np.log((1 + n) / (1 + df)) / np.log(len(df))
    vectors = [(i, (h, minhash.weights(h, c, idf))) for i, h, c in rows]
    links = [(i, j) for k, (i, x) in enumerate(vectors) for j, y in vectors[:k] if minhash.weighted_jaccard(x, y) >= threshold]
    return components([i for i, _ in docs], links)


def quality_scores(texts, hashes, sample=4000):
    """A score for each text: labellers by hand, expectation-maximisation over
    single documents, and a scorer over plain dicts."""
    wordy = [bool(re.search(r"\w", t or "")) for t in texts]

    def measure(t):
        words = t.split()
        n, lines = len(words), [x.strip() for x in t.split("\n") if x.strip()]
        at = [*range(0, n - 200, 200), max(0, n - 200)]
        shares = [len(set(words[i : i + 200])) / len(words[i : i + 200]) for i in at]
        upper, lower = sum(c.isupper() for c in t), sum(c.islower() for c in t)
        return [
            len(re.findall(r"[^\w\s]{2,}", t)) / n, upper / max(1, upper + lower), sum(shares) / len(shares), min(shares), sum(words[i] == words[i + 1] for i in range(n - 1)) / max(1, n - 1),
            sum(len(w) == 1 and not w.isalnum() for w in words) / n, 1 - len(set(lines)) / max(1, len(lines)), sum(c.isalnum() for c in t) / max(1, len(t) - t.count(" ") - t.count("\n")), sum(c in ".?!;" for c in t) / n]

    def votes(t):
        marked, upper, distinct, least, repeat, bare, line_repeat, alnum, _ = measure(t)
        low = lambda x, good, bad: "g" if x <= good else "b" if x >= bad else "-"
        out = [low(marked, 0.05, 0.25), low(-alnum, -0.93, -0.84), low(upper, 0.15, 0.5), low(repeat, 0.03, 0.3), low(-distinct, -0.45, -0.2), low(bare, 0.02, 0.2), low(line_repeat, 0.2, 0.6)]
        if out[4] == "g" and least <= 0.2:
            out[4] = "-"
        return "".join(out)

    said = [votes(t) if w else None for t, w in zip(texts, wordy)]
    docs = [v for v in said if v]
    good = [0.1 if "b" in v else 0.9 if "g" in v else 0.5 for v in docs]

    def likely(v, prior, given):
        a, b = prior, 1 - prior
        for i, x in enumerate(v):
            a, b = a * given[1][i][x], b * given[0][i][x]
        return a / (a + b)

    for _ in range(200):
        given = []
        for w in ([1 - g for g in good], good):
            rows = [{x: 0.5 + sum(y for v, y in zip(docs, w) if v[i] == x) for x in "gb-"} for i in range(7)]
            given.append([{x: y / sum(r.values()) for x, y in r.items()} for r in rows])
        prior = (0.5 + sum(good)) / (1 + len(docs))
        known = {v: likely(v, prior, given) for v in set(docs)}
        new = [known[v] for v in docs]
        done = max(abs(a - b) for a, b in zip(new, good)) < 1e-9
        if done:
            break
        good = new

    def features(t):
        raw, total = t.encode("utf-8", "surrogatepass"), {}
        for i in range(len(raw) - 2):
            h = ((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 & 0xFFFFFFFF) >> 17
            total[h] = total.get(h, 0) + 1
        out = [(h, np.float32((n / max(1, len(raw) - 2)) ** 0.5)) for h, n in sorted(total.items())]
        return out + [(32768 + i * 64 + min(20, int(x * 20)), np.float32(0.5)) for i, x in enumerate(measure(t))]

    chosen = sorted({h: (t, v) for h, t, v in zip(hashes, texts, said) if v}.items())[:sample]
    rows = [(features(t), likely(v, prior, given)) for _, (t, v) in chosen]
    w, seen, random = {}, {}, np.random.default_rng(3)
    dot = lambda f: sum(w.get(k, 0) * float(x) for k, x in f) + w.get("bias", 0)
    for _ in range(30):
        for k in random.permutation(len(rows)):
            f, label = rows[k]
            g = 1 / (1 + np.exp(-dot(f))) - label
            for key, x in [*f, ("bias", 1)]:
                seen[key] = seen.get(key, 1e-6) + (g * float(x)) ** 2
                w[key] = w.get(key, 0) - 0.5 * g * float(x) / seen[key] ** 0.5
    return [1 / (1 + np.exp(-dot(features(t)))) if ok else 0.0 for t, ok in zip(texts, wordy)]
