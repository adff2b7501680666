"""License scans: Dice coefficient over word bigrams against licence templates.

Each text is compared as a whole, by paragraph, by line, by sentence, and for licences that none of
these carries by runs of adjoining sentences and lines (so by runs of paragraphs, too).  Words are folded (case and
punctuation gone); a unit's set of distinct word bigrams A and a template's B score
``2 |A and B| / (|A| + |B|)``.  Since no score exceeds ``2 min / (|A| + |B|)``, a template is a
candidate only for units whose size lies within ``[|B| t / (2 - t), |B| (2 - t) / t]`` for threshold t;
units without a bigram of any template are never measured.  A match shares at least ``|B| t / (2 - t)``
bigrams with the template, so runs are formed only in texts that have so many, and begin and end at
pieces that share one: others only lower the score.

Licences are told apart by the words in which their templates differ: of the templates that a unit
matches only the best counts, and a run counts unless another licence scores as much or more over
words that it shares, be it by a unit or by a run.

Defined cases: null and empty texts match nothing; a null doc_id is scanned and reported as null;
repeated rows are each reported; of the units of a document that match a licence the best score is
given (ties: the larger unit, then the earlier); one document may match several licences, and licences
that a unit matches alike are all reported.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import _shared, _text
from weft.llm.license_bigrams import BIGRAMS
from weft.llm.license_texts import TEXTS

THRESHOLD = 0.8
LEVELS = ("document", "paragraph", "line", "sentence")
RUN = "run"

#: One-line notices. The name before '#' is the licence; a licence may have several.
NOTICES = {
    "Apache-2.0#1": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0#2": "This project is released under the Apache License 2.0.",
    "MIT#1": "Released under the MIT License.",
    "MIT#2": "This project is licensed under the terms of the MIT License.",
    "BSD-3-Clause#1": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "GPL-3.0#1": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0#1": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0#1": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0#1": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0#1": "Licensed under the Mozilla Public License, version 2.0.",
    "CC-BY-4.0#1": "Licensed under CC BY 4.0.",
    "CC-BY-4.0#2": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0#1": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0#2": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0#1": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0#2": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0#1": "This work has been dedicated to the public domain under CC0 1.0 Universal.",
    "Unlicense#1": "This is free and unencumbered software released into the public domain.",
    "proprietary#1": "All rights reserved.",
    "proprietary#2": "Unauthorized copying of this file, via any medium, is strictly prohibited.",
}


def bigrams(h: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words; one fewer than words."""
    with np.errstate(over="ignore"):
        return _text.mix(h[:-1] * np.uint64(0x9FB21C651E98DF25) + h[1:])


@lru_cache(maxsize=1)
def templates() -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Names; sizes; and all (bigram, template) pairs sorted by bigram."""
    names, sets = [], []
    for name, text in NOTICES.items():
        names.append(name.split("#")[0])
        sets.append(np.unique(bigrams(_text.words(*_text.buffer(pa.array([text]))).hash)))
    for name, joined in (BIGRAMS | TEXTS).items():
        names.append(name.split("#")[0])
        sets.append(np.unique(bigrams(_text.words(*_text.buffer(pa.array(joined.split("|")))).hash)[::2]))
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    pairs = np.concatenate(sets)
    order = np.argsort(pairs, kind="stable")
    return names, np.array([len(s) for s in sets]), pairs[order], owner[order]


def _breaks(data: np.ndarray, offs: np.ndarray, level: str) -> np.ndarray:
    """Sorted byte positions at which a new unit begins, rows' own first bytes included."""
    rows = offs[:-1]
    feed = np.flatnonzero(data == 10)
    if level == "document":
        return rows
    if level == "line":
        return np.union1d(rows, feed)
    if level == "paragraph":  # a line without anything but blanks ends a paragraph
        solid = np.flatnonzero(~_text.SPACE[data])
        nxt = np.searchsorted(solid, feed)
        blank = np.empty(len(feed), bool)
        blank[:-1] = nxt[1:] == nxt[:-1]
        blank[-1:] = False
        return np.union1d(rows, feed[blank])
    stop = np.flatnonzero((data == 46) | (data == 33) | (data == 63))
    follow = data[np.minimum(stop + 1, len(data) - 1)]
    return np.union1d(np.union1d(rows, feed), stop[_text.SPACE[follow]])


def matches(texts: pa.Array, threshold: float = THRESHOLD) -> list[tuple[int, str, float, str]]:
    """row, licence, score and level of every match; one for each row and licence."""
    names, sizes, pairs, owner = templates()
    data, offs = _text.buffer(texts)
    w = _text.words(data, offs)
    if len(w.hash) < 2:
        return []
    gram = bigrams(w.hash)
    place = np.minimum(np.searchsorted(pairs, gram), len(pairs) - 1)
    known = pairs[place] == gram
    best: dict[tuple[int, str], tuple[float, int, int]] = {}
    claims: dict[int, list[tuple[float, int, int, str]]] = {}  # by row: score, first and last word + 1, licence
    for rank, level in enumerate(LEVELS):
        breaks = _breaks(data, offs, level)
        unit = np.searchsorted(breaks, w.start, "right")
        inside = unit[1:] == unit[:-1]
        hit = np.zeros(int(unit[-1]) + 1, bool)
        hit[unit[:-1][inside & known]] = True
        at = np.flatnonzero(inside & hit[unit[:-1]])
        if not len(at):
            continue
        # Of units that share a bigram with a template: their distinct bigrams.
        order = np.lexsort((gram[at], unit[at]))
        at = at[order]
        new = np.append(True, (gram[at][1:] != gram[at][:-1]) | (unit[at][1:] != unit[at][:-1]))
        u, g, first_word = unit[at][new], gram[at][new], at[new]
        begin = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
        size = np.diff(np.append(begin, len(u)))
        index = np.repeat(np.arange(len(begin)), size)
        row = np.searchsorted(offs, w.start[first_word[begin]], "right") - 1
        left, right = np.searchsorted(pairs, g, "left"), np.searchsorted(pairs, g, "right")
        count = right - left
        which = owner[np.arange(count.sum()) + np.repeat(left - np.cumsum(count) + count, count)]
        both = np.repeat(index, count)
        bound = 2 * np.minimum(size[both], sizes[which]) >= threshold * (size[both] + sizes[which])
        key, shared = np.unique(both[bound] * len(sizes) + which[bound], return_counts=True)
        i, t = key // len(sizes), key % len(sizes)
        score = 2 * shared / (size[i] + sizes[t])
        top = np.zeros(len(size))
        np.maximum.at(top, i, score)
        for j in np.flatnonzero((score >= threshold) & (score == top[i])):
            k = (int(row[i[j]]), names[t[j]])
            a, b = np.searchsorted(unit, [u[begin[i[j]]], u[begin[i[j]]] + 1])
            claims.setdefault(k[0], []).append((float(score[j]), int(a), int(b), k[1]))
            mine = (-round(float(score[j]), 6), rank, int(i[j]))
            if k not in best or mine < best[k]:
                best[k] = mine
    runs = _runs(data, offs, w, gram, known, best, claims, threshold)
    return sorted([(r, name, -s, LEVELS[rank]) for (r, name), (s, rank, _) in best.items()] + [(r, name, s, RUN) for (r, name), s in runs.items()])


def _runs(data: np.ndarray, offs: np.ndarray, w, gram: np.ndarray, known: np.ndarray, best: dict, claims: dict, threshold: float) -> dict[tuple[int, str], float]:
    """The best score over runs of adjoining pieces, for each row and licence that no single unit matches."""
    names, sizes, pairs, owner = templates()
    of = np.searchsorted(offs, w.start, "right") - 1
    at = np.flatnonzero(known & (of[1:] == of[:-1]))
    if not len(at):
        return {}
    seen = np.unique(np.stack([of[at].astype(np.uint64), gram[at]]), axis=1)
    left, right = np.searchsorted(pairs, seen[1], "left"), np.searchsorted(pairs, seen[1], "right")
    count = right - left
    which = owner[np.arange(count.sum()) + np.repeat(left - np.cumsum(count) + count, count)]
    key, shared = np.unique(np.repeat(seen[0].astype(np.int64), count) * len(sizes) + which, return_counts=True)
    row, t = key // len(sizes), key % len(sizes)
    enough = shared >= sizes[t] * threshold / (2 - threshold) - 1e-9
    wanted: dict[int, list[int]] = {}
    for r, i in zip(row[enough].tolist(), t[enough].tolist(), strict=True):
        if (r, names[i]) not in best:
            wanted.setdefault(r, []).append(i)
    if not wanted:
        return {}
    piece = np.searchsorted(_breaks(data, offs, "sentence"), w.start, "right")
    found: dict[tuple[int, str], float] = {}
    for r, ts in wanted.items():
        a, b = (int(x) for x in np.searchsorted(of, [r, r + 1]))
        taken = claims.get(r, [])
        words, pieces = gram[a : b - 1].tolist(), piece[a:b]
        runs = []
        for i in ts:
            template = set(pairs[owner == i].tolist())
            runs += [(score, a + x, a + y, i) for score, x, y in _free_runs(words, pieces, template, threshold, names[i], [(s, p - a, q - a, n) for s, p, q, n in taken])]
        for score, x, y, i in sorted(runs, key=lambda k: (-k[0], k[1], k[3])):
            if not any(s >= score and p < y and x < q and n != names[i] for s, p, q, n in taken):
                taken = [*taken, (score, x, y, names[i])]
                found[r, names[i]] = max(found.get((r, names[i]), 0.0), round(score, 6))
    return found


def _free_runs(gram: list[int], piece: np.ndarray, template: set[int], threshold: float, name: str, taken: list[tuple[float, int, int, str]], low: int = 0) -> list[tuple[float, int, int]]:
    """The best run, its first word and its last + 1; where another licence scores as much over words of it, the best before and the best behind those."""
    if len(piece) < 2:
        return []
    score, a, b = _best_run(gram, piece, template, threshold)
    if score < threshold:
        return []
    rival = next(((p - low, q - low) for s, p, q, n in taken if n != name and s >= score and p - low < b and a < q - low), None)
    if rival is None:
        return [(score, a + low, b + low)]
    p, q = max(rival[0], 0), min(rival[1], len(piece))
    return _free_runs(gram[: max(p - 1, 0)], piece[:p], template, threshold, name, taken, low) + _free_runs(gram[q:], piece[q:], template, threshold, name, taken, low + q)


def _best_run(gram: list[int], piece: np.ndarray, template: set[int], threshold: float) -> tuple[float, int, int]:
    """Score, first word and last + 1. gram: of each word but the last with the next; piece: of each word."""
    _, first = np.unique(piece, return_index=True)
    ends = np.append(first[1:], len(piece))
    hit = np.array([*(g in template for g in gram), False])
    touched = np.logical_or.reduceat(hit | np.append(False, hit[:-1]), first)
    most, best = len(template) * (2 - threshold) / threshold, (0.0, 0, 0)
    places = np.flatnonzero(touched)
    for k, a in enumerate(places):
        own: set[int] = set()
        shared, at = 0, int(first[a])
        for b in places[k:]:
            for g in gram[at : int(ends[b]) - 1]:
                if g not in own:
                    own.add(g)
                    shared += g in template
            at = max(at, int(ends[b]) - 1)
            if len(own) > most + 1e-9:
                break
            score = 2 * shared / (len(own) + len(template))
            if score > best[0]:
                best = score, int(first[a]), int(ends[b])
    return best


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice, level: the licences that each document carries."""
    _shared.ship(docs.sparkSession)

    def run(batches):
        for batch in _text.slices(batches, "text", 4 << 20):
            found = matches(batch.column(1), threshold)
            if found:
                row, name, score, level = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(name), pa.array(score), pa.array(level)], ["doc_id", "license", "dice", "level"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, license string, dice double, level string")


def _template_rows() -> str:
    rows = []
    for name, text in NOTICES.items():
        w = "".join(c if c.isalnum() else " " for c in text.lower()).split()
        rows += sorted({(name, f"{a} {b}") for a, b in zip(w, w[1:], strict=False)})
    for name, joined in (BIGRAMS | TEXTS).items():
        rows += sorted({(f"{name}#", g) for g in joined.split("|")})
    return ", ".join(f"('{n}', '{g}')" for n, g in rows)


def _split(rank: int, pattern: str) -> str:
    return f"SELECT row, {rank} AS rank, generate_subscripts(parts, 1) AS part, unnest(parts) AS unit FROM (SELECT row, regexp_split_to_array(text, '{pattern}') AS parts FROM d)"


SCAN_SQL = f"""
WITH t AS (SELECT * FROM (VALUES {_template_rows()}) AS v(template, gram)), ts AS (SELECT template, count(*) AS size FROM t GROUP BY template),
d AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents WHERE text IS NOT NULL),
u AS (SELECT row, 0 AS rank, 1 AS part, text AS unit FROM d UNION ALL {_split(1, "\\n[ \\t\\r\\v\\f]*\\n")} UNION ALL {_split(2, "\\n")} UNION ALL {_split(3, "[.!?][ \\t\\r\\v\\f\\n]|\\n")}),
w AS (SELECT row, rank, part, regexp_extract_all(lower(unit), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM u),
g AS (SELECT DISTINCT row, rank, part, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS gram FROM w WHERE len(ws) > 1),
n AS (SELECT row, rank, part, count(*) AS size FROM g GROUP BY ALL),
m AS (SELECT row, rank, part, template, count(*) AS shared FROM g JOIN t ON t.gram = g.gram GROUP BY ALL),
s AS (SELECT m.row, m.rank, m.part, split_part(m.template, '#', 1) AS license, 2 * shared / (n.size + ts.size) AS dice FROM m JOIN n ON n.row = m.row AND n.rank = m.rank AND n.part = m.part JOIN ts ON ts.template = m.template),
k AS (SELECT *, rank() OVER (PARTITION BY row, rank, part ORDER BY dice DESC) AS place FROM s WHERE dice >= {THRESHOLD}),
b AS (SELECT row, license, round(max(dice), 6) AS dice, arg_min(rank, (-round(dice, 6), rank)) AS rank FROM k WHERE place = 1 GROUP BY row, license)
SELECT doc_id, license, dice, CASE rank {" ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(LEVELS))} END AS level FROM b JOIN d ON d.row = b.row
"""
