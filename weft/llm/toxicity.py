"""Toxicity: a factorization machine over hashed terms.

A document's features are the distinct hashed terms of its text: folded words, and the first bytes of
longer words (``HEADS``), so that a stem counts in all its forms.  The score is the logistic of
``bias + sum w_i + sum_{i<j} <v_i, v_j>`` over its features: the second sum learns what a pair of terms
adds beyond the two alone, such as an insult and the mention of a group, or two rare stems.

Training takes at most ``MAX_LABELLED`` labelled documents (those with the smallest hash of doc_id, so
the sample does not depend on how the data lies, and of one doc_id at most ``MAX_TEXTS`` different texts,
those with the smallest hash); every seventh of them is held out to set the
decision threshold.  Terms that fewer than ``MIN_DOCS`` sampled documents hold are left out, and of
the others ``MAX_TERMS`` are kept: those most associated with the label, and ``PAIR_TERMS`` that are so in
pairs (``pair_strength``), be they neutral alone.  The model is a fixed-size table; every document is
scored on its whole text.

Defined cases: a null text scores as an empty one; a null doc_id is scored and comes back null; rows
with several labels count as toxic if any says so; null labels are ignored; repeated rows are scored
alike and train once, and of rows that share a doc_id with a label each different text trains.  With no label of one class at all, every score is that class's rate and nothing is flagged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm import _shared, _text

HEADS = (4, 6)
MAX_LABELLED = 12_000
MAX_TEXTS = 8
MIN_DOCS = 3
MAX_TERMS = 8192
PAIR_TERMS = 1024
SKETCHES = 48
FACTORS = 8
STEPS = 150
RATE = 0.05
SPARSE = 2e-4  # L1 on w
SHRINK = 1e-3  # L2 on V


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of each text, as one array and the row offsets into it. Hashes are 44 bits, so a row fits beside them."""
    w = _text.words(*_text.buffer(texts), heads=HEADS)
    row = w.row.astype(np.uint64)
    h = np.concatenate([w.hash, *w.heads])
    rows = np.tile(row, 1 + len(HEADS))
    keep = h != 0
    key = np.unique((rows[keep] << np.uint64(44)) | (h[keep] >> np.uint64(20)))
    first = np.searchsorted(key, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(44))
    return (key & np.uint64((1 << 44) - 1)).astype(np.int64), first


@dataclass
class Machine:
    """terms: sorted hashes; w, v: their weights and factors; threshold: scores from here on are toxic."""

    terms: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray
    threshold: float = 2.0

    def raw(self, index: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log-odds of each row; ``index``: places in ``terms`` of its features."""
        if len(first) < 2:
            return np.zeros(0)
        some = np.diff(first) > 0
        add = lambda x: np.add.reduceat(np.append(x, 0.0), first[:-1]) * some
        out = self.bias + add(self.w[index]) - 0.5 * add((self.v**2).sum(1)[index])
        for f in range(self.v.shape[1]):  # one factor at a time keeps work arrays small
            out += 0.5 * add(self.v[:, f][index]) ** 2
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        return logistic(self.raw(*self.look_up(*terms_of(texts))))

    def look_up(self, terms: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros_like(first)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        known = self.terms[at] == terms
        return at[known], np.concatenate(([0], np.cumsum(known)))[first]


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def pair_strength(index: np.ndarray, rows: np.ndarray, n_terms: int, y: np.ndarray) -> np.ndarray:
    """How far each term's pairs with all other terms go with the label, against what chance gives.

    With labels r less their mean, and M_ij the sum of r over the rows that hold i and j, the sum of
    M_ij ** 2 over j is estimated from ``SKETCHES`` random signs of the terms, without forming a pair.
    """
    r = y - y.mean()
    rng = np.random.default_rng(11)
    own = np.bincount(index, r[rows], n_terms)
    total = np.zeros(n_terms)
    for _ in range(SKETCHES):
        sign = rng.integers(0, 2, n_terms) * 2.0 - 1
        total += (np.bincount(index, (r * np.bincount(rows, sign[index], len(y)))[rows], n_terms) - sign * own) ** 2
    length = np.bincount(rows, minlength=len(y))
    chance = np.bincount(index, (r * r * np.maximum(length - 1, 0))[rows], n_terms)
    return (total / SKETCHES - chance) / np.maximum(chance, 1e-9) * np.sqrt(np.bincount(index, minlength=n_terms))


def train(terms: np.ndarray, first: np.ndarray, y: np.ndarray, held: np.ndarray) -> Machine:
    """Fits the machine by full-batch Adam on the rows that aren't ``held``; the threshold has the best F1 on those that are."""
    y = y.astype(np.float64)
    fit = ~held
    rate = float(y[fit].mean()) if fit.any() else 0.0
    empty = Machine(np.zeros(0, np.int64), float(np.log((rate + 1e-9) / (1 - rate + 1e-9))), np.zeros(0), np.zeros((0, FACTORS)))
    if not 0 < rate < 1:
        return empty
    row = np.repeat(np.arange(len(y)), np.diff(first))
    inside = fit[row]
    vocabulary, code = np.unique(terms[inside], return_inverse=True)
    df = np.bincount(code)
    hits = np.bincount(code, y[row[inside]])
    n, positive = fit.sum(), y[fit].sum()
    expected = df * positive / n
    chi = (hits - expected) ** 2 / (expected * (1 - positive / n) * np.maximum(1 - df / n, 1e-9))
    chi[df < MIN_DOCS] = -1
    strength = pair_strength(code, row[inside], len(vocabulary), np.where(fit, y, positive / n))
    strength[df < MIN_DOCS] = -np.inf
    best = np.union1d(np.lexsort((vocabulary, -chi))[: MAX_TERMS - PAIR_TERMS], np.lexsort((vocabulary, -strength))[:PAIR_TERMS])
    best = best[chi[best] >= 0]
    m = Machine(vocabulary[best], empty.bias, np.zeros(len(best)), np.random.default_rng(7).normal(0, 0.02, (len(best), FACTORS)))
    if not len(best):
        return empty
    index, at = m.look_up(terms, first)
    rows = np.repeat(np.arange(len(y)), np.diff(at))
    use = fit[rows]
    i_fit, r_fit = index[use], rows[use]
    order = np.argsort(i_fit, kind="stable")
    by_term, row_by_term = i_fit[order], r_fit[order]
    starts = np.searchsorted(by_term, np.arange(len(best)))
    held_out_weight = np.where(y > 0, 0.5 / max(rate, 1e-9), 0.5 / (1 - rate)) * fit / n
    first_m, second_m = [np.zeros_like(m.w), np.zeros_like(m.v), 0.0], [np.zeros_like(m.w), np.zeros_like(m.v), 0.0]
    total = lambda x: np.add.reduceat(x, np.minimum(starts, len(x) - 1), axis=0)  # noqa: E731  every kept term has a row
    for step in range(1, STEPS + 1):
        sums = np.stack([np.bincount(rows, m.v[:, f][index], len(y)) for f in range(FACTORS)], 1)
        squares = np.bincount(rows, (m.v**2).sum(1)[index], len(y))
        raw = m.bias + np.bincount(rows, m.w[index], len(y)) + 0.5 * ((sums**2).sum(1) - squares)
        g = (logistic(raw) - y) * held_out_weight
        gr = g[row_by_term]
        own = total(gr)
        crossed = np.stack([total(gr * sums[:, f][row_by_term]) for f in range(FACTORS)], 1)
        grads = [own, crossed - own[:, None] * m.v + SHRINK * m.v, g.sum()]
        for k, grad in enumerate(grads):
            first_m[k] = 0.9 * first_m[k] + 0.1 * grad
            second_m[k] = 0.999 * second_m[k] + 0.001 * grad**2
            move = RATE * first_m[k] / (1 - 0.9**step) / (np.sqrt(second_m[k] / (1 - 0.999**step)) + 1e-6)
            if k == 0:
                scale = RATE / (np.sqrt(second_m[k] / (1 - 0.999**step)) + 1e-6)
                new = m.w - move
                m.w = np.sign(new) * np.maximum(np.abs(new) - scale * SPARSE, 0)
            elif k == 1:
                m.v = m.v - move
            else:
                m.bias -= float(move)
    p = logistic(m.raw(index, at))
    m.threshold = best_threshold(p[held], y[held]) if held.any() and 0 < y[held].mean() < 1 else 0.5
    return m


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap below the lowest score that the best F1 accepts."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    hit = np.cumsum(y)
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = -1
    k = int(np.argmax(f1))
    below = p[k + 1] if k + 1 < len(p) else 0.0
    return float(np.clip((p[k] + below) / 2, 1e-6, 1 - 1e-6))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> Machine:
    """Trains on the labelled documents; what comes to the driver is bounded by ``max_labelled`` term lists."""
    known = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").cast("int").alias("__toxic")).where("__id IS NOT NULL AND __toxic IS NOT NULL").groupBy("__id").agg(F.max("__toxic").alias("__toxic"))
    sample = known.withColumn("__order", F.xxhash64("__id")).orderBy("__order", "__id").limit(max_labelled).drop("__order")
    joined = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "__id")
    joined = joined.withColumn("__text", F.xxhash64("text")).dropDuplicates(["__id", "__text"])  # the driver sees no row twice
    few = Window.partitionBy("__id").orderBy("__text")
    joined = joined.withColumn("__n", F.row_number().over(few)).where(F.col("__n") <= MAX_TEXTS)

    def run(batches):
        for batch in _text.slices(batches, "text", 4 << 20):
            terms, first = terms_of(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(terms))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), lists], ["doc_id", "toxic", "th", "terms"])

    t = joined.select("__id", "text", "__toxic", F.coalesce("__text", F.lit(0).cast("long"))).mapInArrow(run, "doc_id long, toxic int, th long, terms array<long>").toArrow().combine_chunks()
    ids, y = t.column(0).to_numpy(), t.column(1).to_numpy()
    order = np.lexsort((t.column(2).to_numpy(), ids))
    lists = t.column(3).combine_chunks().take(pa.array(order)) if len(order) else pa.array([], pa.list_(pa.int64()))
    first = np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths(), np.int64)))).astype(np.int64) if len(order) else np.zeros(1, np.int64)
    held = (_text.mix(ids[order].view(np.uint64)) % np.uint64(7) == 0) if len(order) else np.zeros(0, bool)
    return train(np.asarray(lists.flatten(), np.int64), first, y[order].astype(np.float64), held)


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, toxicity (0 to 1) and is_toxic of every row."""
    _shared.ship(docs.sparkSession)

    def run(batches):
        for batch in _text.slices(batches, "text", 4 << 20):
            p = machine.score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(p >= machine.threshold)], ["doc_id", "toxicity", "is_toxic"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, toxicity double, is_toxic boolean")


def flag(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    _shared.ship(docs.sparkSession)
    return score(docs, fit(docs, labels, id_col, text_col), id_col, text_col)
