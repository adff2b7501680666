"""SimHash near-dedup with pivot distance tables.

A document's fingerprint is the 256-bit SimHash of its distinct word pairs (words lower-cased, punctuation
dropped; a one-word document has that word as its only feature).  A line that fills half of a document by
repetition weighs no more than one that is there once.  Two documents are near-duplicates
if their fingerprints differ in at most ``radius`` bits; groups are the connected components, and the
smallest doc_id of each group stays.

The search: fingerprints are blocked by keys that near-duplicates share (``bands`` keys of two
min-wise hashes each over the same word pairs).  Inside a block, references are chosen farthest
first, the Hamming distances of all members to all references form the pivot table, and by the
triangle inequality a pair whose coordinates differ by more than ``radius`` anywhere is discarded;
survivors are verified on the full fingerprints.  References that are members of the block matter:
arbitrary ones lie 128 +- 8 bits from everything, and at this radius their tables discard nothing.
Blocks have no size cap: time in a block is members x balls.

Defined cases: a null doc_id, a null text or a text without words is never a duplicate and stays.
doc_id is the identity: rows that repeat one are the same document, and stay or go together.  Ties
are broken by the smaller doc_id.  Other columns are carried along untouched, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import _shared, _text

RADIUS = 60
BANDS = 16
ROWS = 2
PIVOTS = 64
WORDS = 4  # 64-bit words of a fingerprint

_FP = [f"f{i}" for i in range(WORDS)]


def simhash(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """256-bit SimHash of each row's feature hashes, as (rows, 4) uint64. Every row needs a feature.

    Bits are summed in eight lanes of a 64-bit word at a time, in runs of at most 255 features.
    """
    size = np.diff(offs)
    runs = -(-size // 255)
    first = np.concatenate(([0], np.cumsum(runs)))
    starts = np.repeat(offs[:-1], runs) + 255 * (np.arange(first[-1]) - np.repeat(first[:-1], runs))
    sums = np.empty((len(starts), 64 * WORDS), np.uint8)
    bounds = np.append(starts, len(h))
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + 32768, "right")) - 1)
        part = h[bounds[at] : bounds[stop]]
        bits = np.unpackbits(np.stack([_text.mix(part, s + 1) for s in range(WORDS)], 1).view(np.uint8), axis=1)
        sums[at:stop] = np.add.reduceat(bits.view(np.uint64), bounds[at:stop] - bounds[at], axis=0).view(np.uint8)
        at = stop
    out = np.empty((len(size), WORDS), np.uint64)
    for at in range(0, len(size), 4096):
        stop = min(len(size), at + 4096)
        total = np.add.reduceat(sums[first[at] : first[stop]].astype(np.int32), first[at:stop] - first[at], axis=0)
        out[at:stop] = np.packbits(2 * total > size[at:stop, None], axis=1).view(np.uint64)
    return out


def band_keys(h: np.ndarray, offs: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """``bands`` block keys of each row, each of ``rows`` min-wise hashes: (rows, bands) uint64."""
    out = np.empty((len(offs) - 1, bands), np.uint64)
    odd = _text.mix(np.arange(bands * rows, dtype=np.uint64), 99) | np.uint64(1)
    with np.errstate(over="ignore"):
        for b in range(bands):
            key = np.full(len(offs) - 1, b, np.uint64)
            for r in range(rows):
                key = _text.mix(key + np.minimum.reduceat(h * odd[b * rows + r], offs[:-1]))
            out[:, b] = key
    return out


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int32)


def block_edges(fp: np.ndarray, radius: int = RADIUS, pivots: int = PIVOTS) -> tuple[np.ndarray, np.ndarray]:
    """Links between the members of a block, whose components are those of all pairs within ``radius``.

    References are taken farthest first until every member lies within the radius of one; members are
    linked to the references that near, and belong to the ball of the first.  What may still be missing
    are pairs across balls.  For a ball, one look at its reference's column discards every outsider
    farther from it than the ball's outermost member plus the radius; the columns of the first
    ``pivots`` references discard most other pairs, and the rest are verified.
    """
    n = len(fp)
    ball = np.full(n, -1)
    nearest = np.full(n, 1 << 30)
    table, left, right = [], [], []
    near_balls: list[tuple[np.ndarray, np.ndarray]] = []
    at, balls = 0, 0
    everyone = np.arange(n)
    while True:
        d = hamming(fp, fp[at]).astype(np.int16)
        within = np.flatnonzero((d <= radius) & (everyone != at))
        left.append(np.full(len(within), at))
        right.append(within)
        fresh = np.flatnonzero((d <= radius) & (ball < 0))
        ball[fresh] = balls
        balls += 1
        if len(fresh) > 1:
            outside = np.flatnonzero((d > radius) & (d <= d[fresh].max() + radius))
            if len(outside):
                near_balls.append((fresh, outside))
        if len(table) < pivots:
            table.append(d)
        nearest = np.minimum(nearest, d)
        at = int(np.argmax(nearest))
        if nearest[at] <= radius:
            break
    coords = np.stack(table, 1)
    for inside, outside in near_balls:
        step = max(1, (1 << 20) // len(outside))
        for lo in range(0, len(inside), step):
            i, j = (x.ravel() for x in np.meshgrid(inside[lo : lo + step], outside, indexing="ij"))
            keep = ball[i] != ball[j]
            i, j = i[keep], j[keep]
            for p in range(coords.shape[1]):
                if not len(i):
                    break
                keep = np.abs(coords[i, p] - coords[j, p]) <= radius
                if not keep.all():
                    i, j = i[keep], j[keep]
            keep = hamming(fp[i], fp[j]) <= radius
            left.append(i[keep])
            right.append(j[keep])
    return np.concatenate(left), np.concatenate(right)


def _distinct(h: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct features, and the row offsets into them; 44 bits of a hash tell features apart."""
    row = np.repeat(np.arange(len(offs) - 1, dtype=np.uint64), np.diff(offs)) << np.uint64(44)
    key = np.unique(row | (h >> np.uint64(20)))
    first = np.searchsorted(key, np.arange(len(offs), dtype=np.uint64) << np.uint64(44))
    return _text.mix(key & np.uint64((1 << 44) - 1)), first


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, f0..f3 and the block keys of every document that has a doc_id and a word."""

    def run(batches):
        for batch in _text.slices(batches, "text", 4 << 20):
            data, offs = _text.buffer(batch.column(1))
            w = _text.words(data, offs)
            h, at = _distinct(*_text.shingles(w.hash, w.first, 2))
            has = np.flatnonzero(np.diff(at) > 0)
            if not len(has):
                continue
            at = np.append(at[has], len(h))
            fp, keys = simhash(h, at), band_keys(h, at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(has)), *(pa.array(fp[:, i].view(np.int64)) for i in range(WORDS)), pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel().view(np.int64)), BANDS).cast(pa.list_(pa.int64()))], ["doc_id", *_FP, "keys"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    return picked.mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in _FP)}, keys array<long>")


def edges(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b), a < b, between near-duplicates; see ``block_edges``."""
    prints = _shared.table(prints, "prints")
    same = prints.groupBy(*_FP).agg(F.min("doc_id").alias("a"), F.count("*").alias("n"), F.min_by("keys", "doc_id").alias("keys"))
    same = _shared.table(same, "distinct-prints")
    exact = prints.select("doc_id", *_FP).join(same.where("n > 1").select("a", *_FP), _FP).where("doc_id <> a").select("a", F.col("doc_id").alias("b"))

    def run(batches):
        t = _text.gather(batches)
        if t is None:
            return
        key, ids = t.column("key").to_numpy(), t.column("a").to_numpy()
        fp = np.stack([t.column(c).to_numpy().view(np.uint64) for c in _FP], 1)
        order = np.lexsort((ids, key))
        key, ids, fp = key[order], ids[order], fp[order]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(begin, len(key)))
        pair = begin[size == 2]
        pair = pair[hamming(fp[pair], fp[pair + 1]) <= radius]
        found = [(ids[pair], ids[pair + 1])]
        for b, n in zip(begin[size > 2], size[size > 2], strict=True):
            i, j = block_edges(fp[b : b + n], radius)
            found.append((ids[b + i], ids[b + j]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        u = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        u = u[u[:, 0] < u[:, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(u[:, 0]), pa.array(u[:, 1])], ["a", "b"])

    blocks = same.select("a", *_FP, F.explode("keys").alias("key")).repartition("key").mapInArrow(run, "a long, b long")
    return exact.unionByName(blocks).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of ``links`` (a, b), roots included.

    Alternating large-star and small-star steps, each a minimum by node and a join; each round's links are
    a table in the shared folder.
    """
    now = _shared.table(links, "links")
    seen = None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _shared.table(both.join(low, "a").where("b > a AND m <> b").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct(), "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select("m", F.col("v").alias("b")).union(least.select("m", "u"))
        now = _shared.table(small.select(F.col("m").alias("a"), "b").where("a <> b").distinct(), "links")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    pairs = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return pairs.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, kept_doc_id: each document that goes, and the one of its group that stays."""
    _shared.ship(docs.sparkSession)
    return components(edges(fingerprints(docs, id_col, text_col), radius)).where("node <> root").select(F.col("node").alias("doc_id"), F.col("root").alias("kept_doc_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay, columns unchanged."""
    own = _shared.unused(docs, "gone")
    gone = near_duplicates(docs, id_col, text_col, radius).select(F.col("doc_id").alias(own))
    return docs.join(gone, docs[id_col].cast("long") == gone[own], "left_anti")
