"""Brute-force versions of the operators, word by word and pair by pair."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from weft.llm import _text, quality, secrets, simhash


def spans(docs, length):
    """docs: (doc_id, text) rows -> {(doc_id, text): [(start, end)]} of later windows, merged."""
    rows = sorted({(i, t) for i, t in docs if i is not None and t is not None})
    first, out = {}, {}
    places = sorted((i, t, a) for i, t in rows for a in range(len(t.split()) - length + 1))
    for i, t, a in places:
        w = tuple(t.split()[a : a + length])
        if w in first:
            s = out.setdefault((i, t), [])
            if s and a <= s[-1][1]:
                s[-1] = (s[-1][0], a + length)
            else:
                s.append((a, a + length))
        else:
            first[w] = (i, t, a)
    return out


def cut(text, found):
    at = [m.start() for m in re.finditer(r"\S+", text)] + [len(text)]
    out, done = "", 0
    for a, b in found:
        out, done = out + text[done : at[a]], at[b]
    return out + text[done:]


def fingerprint(texts):
    w = _text.words(*_text.buffer(pa.array(texts, pa.string())))
    h, at = simhash._distinct(*_text.shingles(w.hash, w.first, 2))
    out = [None] * len(texts)
    for k in range(len(texts)):
        feats = h[at[k] : at[k + 1]]
        if len(feats):
            bits = np.concatenate([np.unpackbits(_text.mix(feats, s + 1).view(np.uint8).reshape(-1, 8), axis=1) for s in range(simhash.WORDS)], axis=1)
            out[k] = 2 * bits.sum(0) > len(feats)
    return out


def groups(docs, radius=simhash.RADIUS):
    """{doc_id: kept} by comparing all pairs."""
    rows = [(i, t) for i, t in docs if i is not None and t is not None]
    rows = [(i, f) for (i, _), f in zip(rows, fingerprint([t for _, t in rows]), strict=True) if f is not None]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, f) in enumerate(rows):
        for j, g in rows[x + 1 :]:
            if (f != g).sum() <= radius and find(i) != find(j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in root if find(i) != i}


def measures(text):
    t = text or ""
    w, ls = [x for x in re.split("[ \t\n\r]+", t) if x], [x for x in t.split("\n") if x]
    count = lambda chars: sum(c in chars for c in t)
    return {
        "n_chars": len(t), "n_words": len(w), "n_distinct": len(set(w)), "n_adjacent": sum(a == b for a, b in zip(w, w[1:], strict=False)), "n_lines": len(ls), "n_distinct_lines": len(set(ls)),
        "n_symbols": count(quality.SYMBOLS), "n_upper": count(quality.UPPER), "n_lower": count(quality.UPPER.lower()), "n_digits": count(quality.DIGITS), "n_bars": count("|"),
    }


def fail_bits(text):
    m = measures(text)
    holds = lambda rule: eval(re.sub(r"(\w+) BETWEEN (\d+) AND (\d+)", r"\2 <= \1 <= \3", rule).replace("AND", "and").replace(" = ", " == "), {}, m)  # noqa: E731, S307
    return sum(1 << i for i, (_, rule) in enumerate(quality.RULES) if holds(rule))


def masked(text):
    out, at = "", 0
    for m in secrets.CONTEXT.finditer(text):
        g = "a" if m["a"] else "b" if m["b"] else "c"
        if segmentation_cost(m[g]) >= secrets.STRONG:
            out, at = out + text[at : m.start(g)] + secrets.MASK, m.end(g)
    return out + text[at:]


def segmentation_cost(value):
    """The cheapest segmentation, by shortest path over all cuts; brute-force spans may have any length."""
    each = secrets.char_cost(value)
    edges = {(i, j): (j - i) * each for i in range(len(value)) for j in range(i + 1, len(value) + 1)}
    for i, j, _, cost in secrets.parts(value):
        edges[i, j] = min(edges[i, j], cost)
    best = [0.0] + [math.inf] * len(value)
    for j in range(1, len(value) + 1):
        best[j] = min(best[i] + edges[i, j] + (secrets.PART if i else 0.0) for i in range(j))
    return best[-1]


def packed(docs, window, shards_of, k1=1.2, b=0.75, every=1):
    """Windows of (doc_id, text) rows as lists of (doc_id, start, length); shards_of: doc_id -> shard; every: divides the seeds' doc_ids."""
    rows = [(i, t, terms(t)) for i, t in docs if i is not None and t is not None]
    rows = [r for r in rows if r[2]]
    n, mean = len(rows), sum(len(r[2]) for r in rows) / max(1, len(rows))
    df = Counter(x for r in rows for x in set(r[2]))
    idf = {x: math.log1p((n - d + 0.5) / (d + 0.5)) for x, d in df.items()}
    out = []
    for shard in sorted({shards_of(r[0]) for r in rows}):
        own = sorted((r for r in rows if shards_of(r[0]) == shard), key=lambda r: (r[0], len(r[2])))
        free = {}
        for k, (i, _, w) in enumerate(own):
            for s in range(0, len(w) - window + 1, window):
                out.append([(i, s, window)])
            if len(w) % window:
                free[k] = len(w) % window
        left = dict(free)

        def filled(seed, left=left, free=free, own=own):
            took = [seed] if free.pop(seed, 0) else []
            room = window - sum(left[k] for k in took)
            q = set(own[seed][2])
            score = {}
            for k in free:
                tf = Counter(own[k][2])
                s = sum(idf[x] * tf[x] * (k1 + 1) / (tf[x] + k1 * (1 - b + b * len(own[k][2]) / mean)) for x in q if x in tf)
                if s > 0:
                    score[k] = round(s, 9)
            for k in sorted(score, key=lambda k: (-score[k], k)):
                if left[k] <= room:
                    took.append(k)
                    room -= left[k]
                    del free[k]
            return [[(own[k][0], len(own[k][2]) - left[k], left[k]) for k in took]] if took else []

        seeds = [k for k, r in enumerate(own) if r[0] % every == 0] if every > 1 else []
        for at, seed in enumerate(seeds):
            for _ in range(-(-sum(free.values()) // (window * (len(seeds) - at)))):
                out += filled(seed)
        for seed in range(len(own)):
            if seed in free:
                out += filled(seed)
    return out


def terms(text):
    return re.findall(r"[^\W_]+|[^\x00-\x7f]+", text.lower())


def dice(text, template):
    a, b = ({*zip(w, w[1:], strict=False)} for w in (terms(text), terms(template)))
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def guesses(value):
    """The least log10 of the guesses over all segmentations: every span is tried as every kind."""
    low, n, each = value.lower(), len(value), secrets.char_cost(value)
    plain = low.translate(secrets._LEET)
    best = [0.0] + [math.inf] * n
    for j in range(1, n + 1):
        for i in range(j):
            costs, part = [(j - i) * each], value[i:j]
            for form, extra in ((low[i:j], 0.0), (plain[i:j], 0.7)):
                if form in secrets.COMMON:
                    costs.append(math.log10(secrets.COMMON.index(form) + 1) + extra * (form != low[i:j]) + 0.4 * (part != low[i:j]))
            if j - i == 4 and secrets._YEAR.match(part):
                costs.append(math.log10(200))
            if (m := secrets._DATE.match(value, i)) and i + len(m[1]) == j:
                costs.append(math.log10(365 * 120 * 4))
            if j - i >= 3 and all(p in secrets._NEXT for p in zip(low[i:j], low[i + 1 : j], strict=False)):
                costs.append(math.log10(47 * 4 * (j - i)))
            for k in range(1, (j - i) // 2 + 1):
                times, rest = divmod(j - i, k)
                if not rest and times >= (3 if k == 1 else 2) and part == part[:k] * times:
                    costs.append(k * each + math.log10(times))
            best[j] = min(best[j], best[i] + min(costs) + (secrets.PART if i else 0.0))
    return best[n]
