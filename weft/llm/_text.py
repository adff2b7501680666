"""Vectorised word handling over Arrow string batches.

A batch of texts is one byte buffer plus row offsets; words are found, folded and hashed with numpy
over the whole buffer, a megabyte at a time, so no Python object is made per word.  Nulls count as
empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = 1 << 20
_U8 = np.arange(256)

#: Bytes that separate words in ``split`` mode: ASCII white space.
SPACE = np.isin(_U8, list(b" \t\n\r\x0b\x0c"))
#: Bytes inside words in ``fold`` mode: ASCII letters and digits, and every byte of a non-ASCII character.
ALNUM = ((_U8 >= 48) & (_U8 <= 57)) | ((_U8 >= 65) & (_U8 <= 90)) | ((_U8 >= 97) & (_U8 <= 122)) | (_U8 >= 128)
_LOWER = np.where((_U8 >= 65) & (_U8 <= 90), _U8 + 32, _U8).astype(np.uint8)

_powers: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of each."""
    global _powers
    if len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers = tuple(np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, b, np.uint64))), dtype=np.uint64) for b in (_BASE, inverse))
    return _powers


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: equal inputs stay equal, everything else is scattered."""
    with np.errstate(over="ignore"):
        h = h + np.uint64((seed * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and the row offsets into them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def fold_bytes(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the Latin-1 letters of two-byte UTF-8."""
    out = _LOWER[data]
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    at = at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]
    out[at] += 32
    return out


class Words:
    """Words of a batch: ``start``/``end`` byte positions, ``hash``, and ``first``: the offset of each row's first word."""

    def __init__(self, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, offs: np.ndarray):
        self.start, self.end, self.hash = start, end, hashes
        self.first = np.searchsorted(start, offs)
        self.heads: list[np.ndarray] = []

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(data: np.ndarray, offs: np.ndarray, fold: bool = True, heads: tuple[int, ...] = (), inside: np.ndarray | None = None) -> Words:
    """All words of the batch. ``fold``: runs of letters and digits, lower-cased; else runs between white space, as they are.

    ``inside``: for each byte, whether it belongs to a word, where that is neither of the two.

    ``heads``: for each, also a hash of every word's first so many bytes, in ``heads`` (0: the word is no longer than that).
    """
    inside = inside if inside is not None else ALNUM if fold else ~SPACE
    starts, ends, hashes = [], [], []
    first_bytes: list[list[np.ndarray]] = [[] for _ in heads]
    cuts = offs[1:-1]
    at, n = 0, len(data)
    while at < n:
        stop = min(n, at + _STEP)
        while stop < n:  # a chunk ends before a byte between words, or where a row begins
            gap = np.flatnonzero(~inside[data[stop : stop + 4096]])
            if len(gap):
                stop += int(gap[0])
                break
            stop = min(n, stop + 4096)
        part = data[at:stop]
        part_in = inside[part]
        own = cuts[np.searchsorted(cuts, at, "right") : np.searchsorted(cuts, stop)] - at
        before = np.empty(len(part) + 1, bool)
        before[0] = False
        before[1:] = part_in
        after = part_in.copy()
        before[own] = False
        begin = np.flatnonzero(part_in & ~before[:-1])
        follows = np.empty(len(part), bool)
        follows[:-1] = after[1:]
        follows[-1] = False
        follows[own - 1] = False
        finish = np.flatnonzero(part_in & ~follows) + 1
        power, inverse = _power_tables(len(part))
        with np.errstate(over="ignore"):
            total = np.zeros(len(part) + 1, np.uint64)
            folded = fold_bytes(part) if fold else part
            np.cumsum((folded.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=total[1:])
            h = (total[finish] - total[begin]) * inverse[begin]
            for k, n_head in enumerate(heads):
                long = finish - begin > n_head
                part_h = mix((total[np.minimum(begin + n_head, len(part))] - total[begin]) * inverse[begin], 17 + n_head)
                first_bytes[k].append(np.where(long, part_h, np.uint64(0)))
        starts.append(begin + at)
        ends.append(finish + at)
        hashes.append(mix(h))
        at = stop
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    out = Words(join(starts, np.int64), join(ends, np.int64), join(hashes, np.uint64), offs)
    out.heads = [join(x, np.uint64) for x in first_bytes]
    return out


def shingles(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` words inside each row, and the row offsets into them; a shorter row that has words is one run."""
    size = np.diff(first)
    count = np.where(size > 0, np.maximum(size - n + 1, 1), 0)
    offs = np.concatenate(([0], np.cumsum(count)))
    at = np.arange(offs[-1]) + np.repeat(first[:-1] - offs[:-1], count)
    last = np.repeat(first[1:], count)
    with np.errstate(over="ignore"):
        out = np.zeros(len(at), np.uint64)
        for k in range(n):
            out = out * np.uint64(0x9FB21C651E98DF25) + np.where(at + k < last, h[np.minimum(at + k, max(len(h) - 1, 0))], np.uint64(7)) if len(at) else out
    return mix(out), offs


def slices(batches: Iterator[pa.RecordBatch], text: str | int, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text, so that work arrays stay small whatever the row length."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = buffer(batch.column(text if isinstance(text, int) else batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            yield batch.slice(at, stop - at)
            at = stop


def gather(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """A whole partition as one table; None when it has no rows."""
    kept = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(kept).combine_chunks() if kept else None
