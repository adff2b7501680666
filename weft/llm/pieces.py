"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice; lossless decoding.

A text is a space followed by its own characters, with spaces written as the model's U+2581.  Every
piece of the model, and for characters without a piece of their own its byte pieces, is an edge of
the lattice over the text's bytes.  The model's merge ranks are taken for a Zipf law: piece of rank r
has weight 1 / (r + 2) ** alpha.  No piece crosses from a character into a following space or over a
line feed, so the lattice falls into units (spaces and the word after them; single line feeds), and
equal units of a batch share one forward pass.  Going backward, every piece is drawn in proportion to
the weight of all segmentations that end with it, by a number hashed from (seed, row key, place of
the unit in the row, step): the same row gives the same pieces on any cluster, however it is split.

Decoding joins the pieces' bytes and drops the first space.  U+2581 in the text itself is encoded as
bytes, so it isn't taken for a space: decode(encode(x)) = x for every string.

Defined cases: a null text has null ids and an empty one the ids of the space alone; a null doc_id is a
row key of its own; repeated rows are segmented alike; texts of any length are encoded whole.  Units of
over ``LONG`` bytes (base64, scripts without spaces) have the same lattice and draws, but are filtered one
by one, a block of edges at a time, and only the forward scores of all places are kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import _shared, _text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 0.8
SEED = 20
_NODES = 1 << 19  # lattice nodes worked on together
_MAYBE = 16  # bits of the filter before the search for a piece
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_LOW = -1e30
LONG = 512
_BLOCK = 1 << 16  # places of a long unit whose edges are held at once
_RESCALE = 32


@dataclass
class Model:
    """Pieces as bytes with spaces for U+2581: by length their sorted hashes, ids and a filter; log weights; and all of them by id for decoding."""

    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    weight: np.ndarray
    byte_id: np.ndarray
    offs: np.ndarray
    data: np.ndarray


def _span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte span; spans of one megabyte window at a time, so the power tables stay small."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        base = start[at]
        stop = max(at + 1, int(np.searchsorted(start, base + (1 << 20))))
        part = data[base : int(end[at:stop].max())]
        power, inverse = _text._power_tables(len(part) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=total[1:])
            out[at:stop] = _text.mix((total[end[at:stop] - base] - total[start[at:stop] - base]) * inverse[start[at:stop] - base])
        at = stop
    return out


def _plain_hashes(data: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    power, _ = _text._power_tables(length)
    with np.errstate(over="ignore"):
        return ((data[start[:, None] + np.arange(length)].astype(np.uint64) + np.uint64(1)) * power[:length]).sum(1, dtype=np.uint64)


@lru_cache(maxsize=4)
def load(path: str = MODEL, alpha: float = ALPHA) -> Model:
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    weight, byte_id, texts, spans = np.zeros(n), np.full(256, -1, np.int32), [b""] * n, {}
    for i in range(n):
        if p.is_byte(i):
            b = int(p.id_to_piece(i)[3:-1], 16)
            byte_id[b], texts[i], weight[i] = i, bytes([b]), -alpha * np.log(n + 2.0)
        elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
            text = p.id_to_piece(i).replace("▁", " ")
            texts[i] = text.encode()
            weight[i] = -alpha * np.log(min(max(-p.get_score(i), 0.0), n) + 2.0)
            if " " not in text.lstrip(" ") and "\n" not in text:
                spans.setdefault(len(texts[i]), []).append(i)
    if (byte_id < 0).any():
        raise ValueError(f"{path} has no byte pieces: texts could not be decoded without loss")
    data = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    by_length = {}
    for k, ids in sorted(spans.items()):
        ids = np.array(ids, np.int32)
        h = _plain_hashes(data, offs[ids], k)
        order = np.argsort(h)
        maybe = np.zeros(1 << _MAYBE, bool)
        with np.errstate(over="ignore"):
            maybe[(h * _SPREAD) >> np.uint64(64 - _MAYBE)] = True
        by_length[k] = h[order], ids[order], maybe
    return Model(by_length, weight, byte_id, offs, data)


@dataclass
class _Lattice:
    """Edges into every node (unit, depth), by length: piece ids, and the chance that the last piece has at most that length.

    Depth d holds only the units of d bytes and more, the longest first, so a unit has one rank at all
    depths.  An edge's place is ``at[d] + row of the length * wide[d] + rank``.
    """

    lengths: np.ndarray
    ids: np.ndarray
    chance: np.ndarray
    at: np.ndarray
    wide: np.ndarray


def _lattice(m: Model, data: np.ndarray, first: np.ndarray) -> _Lattice:
    """The lattice of units laid end to end in order of falling length, forward-filtered."""
    size = np.diff(first)
    deepest = int(size[0]) if len(size) else 0
    wide = np.searchsorted(-size, -np.arange(deepest + 1), "right")
    lengths = np.array(sorted({1, *m.by_length}), np.int64)
    # How many bytes of its character a byte ends, and how long that character is: for characters without a piece.
    lead = (data & 0xC0) != 0x80
    begin = np.flatnonzero(lead)
    of = np.cumsum(lead) - 1
    char = np.diff(np.append(begin, len(data)))
    inside = np.arange(len(data)) - begin[of] + 1
    whole = inside == char[of]
    power, inverse = (x[: deepest + 1] for x in _text._power_tables(deepest + 1))
    totals = [np.zeros(len(size), np.uint64)]
    scores = [np.zeros(len(size))]
    ids_at, owned = [], np.zeros(len(begin), bool)
    with np.errstate(over="ignore"):
        for d in range(1, deepest + 1):
            n = wide[d]
            byte = first[:n] + d - 1
            totals.append(totals[-1][:n] + (data[byte].astype(np.uint64) + np.uint64(1)) * power[d - 1])
            if d > lengths[-1] + 1:
                totals[d - int(lengths[-1]) - 1] = None
            ids = np.full((int(np.searchsorted(lengths, d, "right")), n), -1, np.int32)
            for row in range(len(ids)):
                k = int(lengths[row])
                if k not in m.by_length:
                    continue
                hashes, known, maybe = m.by_length[k]
                h = (totals[d] - totals[d - k][:n]) * inverse[d - k]
                hit = np.flatnonzero(maybe[(h * _SPREAD) >> np.uint64(64 - _MAYBE)])
                if len(hit):
                    place = np.minimum(np.searchsorted(hashes, h[hit]), len(hashes) - 1)
                    ok = hashes[place] == h[hit]
                    hit, place = hit[ok], place[ok]
                    ids[row, hit] = known[place]
                    if k <= 4:  # a whole character, if it begins where its first byte is
                        end = byte[hit]
                        own = end[whole[end] & (char[of[end]] == k)]
                        owned[of[own]] = True
            ids_at.append(ids)
        for d in range(1, deepest + 1):
            n = wide[d]
            byte = first[:n] + d - 1
            ids = ids_at[d - 1]
            raw = np.flatnonzero(~owned[of[byte]])
            ids[0, raw] = m.byte_id[data[byte[raw]]]
            w = np.where(ids >= 0, m.weight[ids], _LOW)
            for row in range(len(ids)):
                w[row] += scores[d - int(lengths[row])][:n]
            top = w.max(0)
            w -= top
            np.exp(w, out=w)
            np.cumsum(w, axis=0, out=w)
            scores.append(np.where(top > _LOW / 2, top + np.log(w[-1]), _LOW))
            w /= w[-1]
            if d > lengths[-1]:
                scores[d - int(lengths[-1])] = None
            totals[d - 1] = w  # its hash is not needed any more
    chance = totals[:deepest]
    places = np.cumsum([0, 0, *(x.size for x in ids_at)])[:-1] if ids_at else np.zeros(1, np.int64)
    flat = lambda parts, kind: np.concatenate([x.ravel() for x in parts]) if parts else np.zeros(0, kind)
    return _Lattice(lengths, flat(ids_at, np.int32), flat(chance, float), places, wide)


def _owned(m: Model, data: np.ndarray) -> np.ndarray:
    """For every byte, whether its character has a piece of its own."""
    begin = np.flatnonzero((data & 0xC0) != 0x80)
    size = np.diff(np.append(begin, len(data)))
    out = np.zeros(len(begin), bool)
    for k in range(1, 5):
        if k in m.by_length:
            hashes = m.by_length[k][0]
            which = np.flatnonzero(size == k)
            for at in range(0, len(which), 1 << 18):
                part = which[at : at + (1 << 18)]
                h = _plain_hashes(data, begin[part], k)
                out[part] = hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)] == h
    return np.repeat(out, size)


def _edges(m: Model, data: np.ndarray, owned: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of a unit that end at depths from ``low`` + 1 to ``high``, by depth and length: depth, length, piece."""
    longest = max(m.by_length)
    front = max(0, low - longest)
    part = data[front:high]
    power, inverse = _text._power_tables(len(part) + 1)
    total = np.zeros(len(part) + 1, np.uint64)
    found = []
    with np.errstate(over="ignore"):
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=total[1:])
        for k, (hashes, known, maybe) in m.by_length.items():
            depth = np.arange(max(low + 1, k), high + 1)
            if not len(depth):
                continue
            h = (total[depth - front] - total[depth - front - k]) * inverse[depth - front - k]
            hit = np.flatnonzero(maybe[(h * _SPREAD) >> np.uint64(64 - _MAYBE)])
            place = np.minimum(np.searchsorted(hashes, h[hit]), len(hashes) - 1)
            ok = hashes[place] == h[hit]
            found.append((depth[hit[ok]], np.full(ok.sum(), k), known[place[ok]]))
    raw = np.flatnonzero(~owned[low:high]) + low
    depth, length, ids = (np.concatenate(x) for x in zip(*found, (raw + 1, np.ones(len(raw), int), m.byte_id[data[raw]]), strict=True))
    order = np.lexsort((length, depth))
    return depth[order], length[order], ids[order]


def _sample_long(m: Model, data: np.ndarray, keys: np.ndarray) -> list[np.ndarray]:
    """Pieces of one long unit, drawn anew for each of its occurrences, whose draws ``keys`` seed."""
    n, owned, longest = len(data), _owned(m, data), max(m.by_length)
    log = np.full(n + 1, -np.inf)
    log[0] = 0.0
    for low in range(0, n, _BLOCK):
        high = min(n, low + _BLOCK)
        depth, length, ids = _edges(m, data, owned, low, high)
        weight = np.exp(m.weight[ids]).tolist()
        cuts = np.searchsorted(depth, np.arange(low, high + _RESCALE, _RESCALE), "right").tolist()
        depths, lengths = depth.tolist(), length.tolist()
        for k, at in enumerate(range(low, high, _RESCALE)):
            stop = min(high, at + _RESCALE)
            front = max(0, at - longest)
            top = log[front : at + 1].max()
            a = [*np.exp(log[front : at + 1] - top).tolist(), *[0.0] * (stop - at)]
            for i in range(cuts[k], cuts[k + 1]):
                d = depths[i] - front
                a[d] += a[d - lengths[i]] * weight[i]
            with np.errstate(divide="ignore"):
                log[at + 1 : stop + 1] = np.log(a[at + 1 - front :]) + top
    out = []
    for key in keys:
        chosen, d, low, step = [], n, n, 0
        while d:
            if d <= low:  # the block of edges before
                low = max(0, d - _BLOCK)
                depth, length, ids = _edges(m, data, owned, low, d)
                first = np.searchsorted(depth, np.arange(low, d + 2)).tolist()
                score, lengths, pieces = (m.weight[ids] + log[depth - length] - log[depth]).tolist(), length.tolist(), ids.tolist()
            if step % 4096 == 0:
                with np.errstate(over="ignore"):
                    draws = ((_text.mix(key + np.arange(step, step + 4096, dtype=np.uint64), 5) >> np.uint64(11)).astype(np.float64) * 2.0**-53).tolist()
            u, i, last = draws[step % 4096], first[d - low], first[d - low + 1] - 1
            u -= exp(score[i])
            while u >= 0 and i < last:  # to the next longer edge
                i += 1
                u -= exp(score[i])
            chosen.append(pieces[i])
            d -= lengths[i]
            step += 1
        out.append(np.array(chosen[::-1], np.int32))
    return out


def sample(m: Model, texts: pa.Array, keys: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts, and the row offsets into them."""
    data, offs = _text.buffer(texts)
    rows = len(offs) - 1
    data = np.insert(data, offs[:-1], 32)
    offs = offs + np.arange(rows + 1)
    n = len(data)
    if not n:
        return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
    space, feed = data == 32, data == 10
    begin = np.ones(n, bool)
    begin[1:] = (space[1:] & ~space[:-1]) | feed[1:] | feed[:-1]
    begin[offs[:-1]] = True
    start = np.flatnonzero(begin)
    end = np.append(start[1:], n)
    first = np.searchsorted(start, offs)  # each row's first unit
    _, pick, unit = np.unique(_span_hashes(data, start, end), return_index=True, return_inverse=True)
    row = np.repeat(np.arange(rows), np.diff(first))
    place = np.arange(len(start)) - first[row]
    key = _text.mix(_text.mix(keys.view(np.uint64), seed)[row] + _text.mix(place.astype(np.uint64), 3))
    size = end[pick] - start[pick]
    rank = np.argsort(-size, kind="stable")  # units by falling length
    pick, size = pick[rank], size[rank]
    unit = np.argsort(rank)[unit]
    by_unit = np.argsort(unit, kind="stable")
    occurs = np.concatenate(([0], np.cumsum(np.bincount(unit, minlength=len(pick)))))
    reach = np.cumsum(size)
    who, step_of, piece = [], [], []
    a = int(np.searchsorted(-size, -LONG))  # units above LONG come first
    for k in range(a):
        occ = by_unit[occurs[k] : occurs[k + 1]]
        for o, found in zip(occ, _sample_long(m, data[start[pick[k]] : end[pick[k]]], key[occ]), strict=True):
            who.append(np.full(len(found), o))
            step_of.append(np.arange(len(found), dtype=np.int32)[::-1])
            piece.append(found)
    while a < len(pick):
        b = max(a + 1, int(np.searchsorted(reach, (reach[a - 1] if a else 0) + _NODES, "right")))
        lens = size[a:b]
        base = np.concatenate(([0], np.cumsum(lens)))
        chunk = data[np.arange(base[-1]) + np.repeat(start[pick[a:b]] - base[:-1], lens)]
        lattice = _lattice(m, chunk, base)
        occ = by_unit[occurs[a] : occurs[b]]
        depth, who_unit = size[unit[occ]], unit[occ] - a
        step = 0
        while len(occ):
            with np.errstate(over="ignore"):
                u = (_text.mix(key[occ] + np.uint64(step), 5) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge, wide = lattice.at[depth] + who_unit, lattice.wide[depth]
            choice = np.zeros(len(occ), np.int64)
            going = np.flatnonzero(lattice.chance[edge] <= u)
            while len(going):  # to the next longer edge
                choice[going] += 1
                edge[going] += wide[going]
                going = going[lattice.chance[edge[going]] <= u[going]]
            who.append(occ)
            step_of.append(np.full(len(occ), step, np.int32))
            piece.append(lattice.ids[edge])
            depth = depth - lattice.lengths[choice]
            more = depth > 0
            occ, depth, who_unit = occ[more], depth[more], who_unit[more]
            step += 1
        a = b
    who, step_of, piece = np.concatenate(who), np.concatenate(step_of), np.concatenate(piece)
    pieces = np.bincount(who, minlength=len(start))
    last = np.cumsum(pieces)
    out = np.empty(len(piece), np.int32)
    out[last[who] - 1 - step_of] = piece
    return out, np.concatenate(([0], last))[first]


def join(m: Model, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the decoded rows, the space in front of each still there, and the row offsets."""
    size = np.diff(m.offs)[ids]
    at = np.cumsum(size) - size
    data = m.data[np.arange(size.sum()) + np.repeat(m.offs[ids] - at, size)]
    return data, np.append(at, size.sum())[first]


def _decoded(m: Model, ids: np.ndarray, first: np.ndarray, valid: np.ndarray) -> pa.Array:
    data, offs = join(m, ids, first)
    return pa.array([data[a + 1 : b].tobytes() if ok else None for a, b, ok in zip(offs[:-1], offs[1:], valid, strict=True)], pa.binary()).cast(pa.string())


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """doc_id, ids, n_pieces, and lossless: whether the pieces' bytes are the text again."""
    _shared.ship(docs.sparkSession)

    def run(batches):
        m = load(model, alpha)
        for batch in _text.slices(batches, "text", 4 << 20):
            texts = batch.column(1)
            valid = texts.is_valid().to_numpy(zero_copy_only=False)
            ids, first = sample(m, texts, batch.column(2).to_numpy(), seed)
            back, offs = join(m, ids, first)
            data, was = _text.buffer(texts)
            same = np.diff(offs) == np.diff(was) + 1
            if same.all():
                wrong = np.flatnonzero(back[np.delete(np.arange(len(back)), offs[:-1])] != data)
                same[np.searchsorted(was, wrong, "right") - 1] = False
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))
            lists = lists if valid.all() else lists.take(pa.array(np.where(valid, np.arange(len(valid)), 0), mask=~valid))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(np.diff(first), mask=~valid), pa.array(same, mask=~valid)], ["doc_id", "ids", "n_pieces", "lossless"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col).cast("long")).alias("key"))
    return picked.mapInArrow(run, "doc_id long, ids array<int>, n_pieces long, lossless boolean")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """doc_id and text of every row of ids."""
    _shared.ship(encoded.sparkSession)

    def run(batches):
        m = load(model)
        for batch in batches:
            lists = batch.column(1)
            first = np.concatenate(([0], np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))))
            yield pa.RecordBatch.from_arrays([batch.column(0), _decoded(m, lists.flatten().to_numpy(), first, lists.is_valid().to_numpy(zero_copy_only=False))], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
