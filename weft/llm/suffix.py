"""Suffix-array dedup: passages of ``length`` words or more that occur before are found, and cut.

A window is ``length`` consecutive words (exact, between white space).  Of the places where one window
occurs, the first by (doc_id, text, position) stays; the words under all its later places are
duplicates.  Adjoining and overlapping duplicate windows make one span.

How: (1) consecutive windows whose least 12-word hash lies at the same place form a run, and that hash
is the run's key, so equal windows always meet under one key.  (2) Only keys that occur again are kept, and
only their runs' words are shipped, by key.  (3) Each partition sorts the suffixes of its distinct
runs, forms the Burrows-Wheeler transform, and widens matches breadth first by backward extension:
level q+1's intervals follow from level q's through the LF mapping, so common prefixes appear in order
of length; intervals of one suffix are dropped, and the expansion stops at ``length``.  (4) What is
left are the groups of equal windows; spans are merged by document.

Defined cases: a null doc_id or text neither matches nor is cut.  Texts shorter than ``length`` words
have no window.  Rows that repeat a doc_id and its text are the same document, not copies; rows that
share a doc_id only are told apart by their text.  Repeats inside a document count.  A document all
of whose words are duplicates stays with what white space is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import _shared, _text

LENGTH = 50
GRAM = 12
BATCH = 1 << 20  # words whose suffixes are sorted together


def window_runs(h: np.ndarray, first: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one key: key, row, first word within the row, number of words."""
    gram = min(gram, length)
    n = len(h)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none

    def ahead(x: np.ndarray, k: int) -> np.ndarray:
        return np.concatenate((x[k:], np.zeros(min(k, len(x)), x.dtype)))

    with np.errstate(over="ignore"):
        g, have, parts = h, 1, []
        for bit in range(gram.bit_length()):  # hashes of 1, 2, 4, ... words, put together to gram words
            if gram >> bit & 1:
                parts.append((g, have))
            if gram >> (bit + 1):
                g = _text.mix(g * np.uint64(0x9FB21C651E98DF25) + ahead(g, have))
                have *= 2
        low, shift = parts[0]
        for g, have in parts[1:]:
            low = _text.mix(low * np.uint64(0xD6E8FEB86659FD93) + ahead(g, shift))
            shift += have
    own = low
    width, have = length - gram + 1, 1
    while have * 2 <= width:
        low = np.minimum(low, ahead(low, have))
        have *= 2
    low = np.minimum(low, ahead(low, width - have))
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    valid = np.arange(n) + length <= np.repeat(first[1:], np.diff(first))
    fresh = valid.copy()
    fresh[1:] &= (low[1:] != low[:-1]) | (own[:-1] == low[:-1]) | (row[1:] != row[:-1]) | ~valid[:-1]
    at = np.flatnonzero(fresh)
    run = np.cumsum(fresh) - 1
    windows = np.bincount(run[valid], minlength=len(at))
    return low[at].view(np.int64), row[at], at - first[row[at]], windows + length - 1


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of ``s`` in order, by prefix doubling; the last symbol must be found only once."""
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    n, h = len(s), 1
    while True:
        second = np.zeros(n, np.int64)
        second[: max(n - h, 0)] = rank[h:] + 1
        key = rank * (n + 1) + second
        sa = np.argsort(key, kind="stable")
        fresh = np.ones(n, bool)
        fresh[1:] = key[sa][1:] != key[sa][:-1]
        rank = np.empty(n, np.int64)
        rank[sa] = np.cumsum(fresh) - 1
        if fresh.all():
            return sa
        h *= 2


def repeated_prefixes(s: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``s`` whose next ``length`` symbols occur elsewhere too, and a group number that such positions share."""
    sa = suffix_array(s)
    bwt = s[sa - 1]
    follows = np.argsort(bwt, kind="stable")  # suffix p, less its first symbol, is suffix follows[p]: LF backwards
    symbol = bwt[follows]
    live = np.arange(len(s))
    start = np.zeros(len(s), np.int64)  # every suffix's interval, named by its first place
    depth = 0
    while len(live) and depth < length:
        came = symbol[live] if depth == 0 else start[follows[live]]
        now = start[live]
        fresh = np.ones(len(live), bool)
        fresh[1:] = (now[1:] != now[:-1]) | (came[1:] != came[:-1])
        own = np.cumsum(fresh) - 1
        start[live] = live[fresh][own]
        live = live[np.bincount(own)[own] > 1]  # an interval of one suffix can't grow
        depth += 1
    return sa[live], start[live]


def duplicate_spans(texts: pa.Array, doc: np.ndarray, begin: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans of later windows among runs that share keys: occurrence, first word, end word, and the ``doc`` that holds the first.

    ``doc``: rank of the document by order of precedence. ``begin``: the run's first word in it.
    """
    code = texts.dictionary_encode()
    run = code.indices.to_numpy().astype(np.int64)
    seen = np.unique(np.stack([run, doc, begin], 1), axis=0, return_index=True)
    run, doc, begin, occurrence = *seen[0].T, seen[1]
    head = np.flatnonzero(np.append(True, run[1:] != run[:-1]))  # each distinct run's first place
    data, offs = _text.buffer(code.dictionary)
    w = _text.words(data, offs, fold=False)
    size = np.diff(w.first)
    # Words as numbers from 1 to k; after each run a symbol of its own.
    ids = np.unique(w.hash, return_inverse=True)[1].astype(np.int64)
    s = np.empty(len(ids) + len(size), np.int64)
    base = w.first[:-1] + np.arange(len(size))
    s[np.arange(len(ids)) + w.row] = ids + len(size)
    s[base + size] = np.arange(len(size))
    at, group = repeated_prefixes(s, length)
    of = np.searchsorted(base, at, "right") - 1
    offset = at - base[of]
    place = (doc[head][of] << 32) + begin[head][of] + offset
    order = np.lexsort((place, group))
    lead = np.append(True, group[order][1:] != group[order][:-1])[: len(at)]
    least = np.empty(len(at), np.int64)
    if len(at):
        least[order] = place[order][np.flatnonzero(lead)][np.cumsum(lead) - 1]
    # Later places of one run: all of it. The source: where its first window is found first.
    source = doc[head].copy()
    front = offset == 0
    source[of[front]] = least[front] >> 32
    later = np.ones(len(run), bool)
    later[head] = False
    out = [(occurrence[later], begin[later], begin[later] + size[run[later]], source[run[later]])]
    # First places of runs: windows that another run has before.
    bad = least != place
    of, offset, least = of[bad], offset[bad], least[bad]
    order = np.lexsort((offset, of))
    of, offset, least = of[order], offset[order], least[order]
    if len(of):
        cut = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (offset[1:] != offset[:-1] + 1) | ((least[1:] >> 32) != (least[:-1] >> 32))))
        stop = np.append(cut[1:], len(of)) - 1
        b = begin[head][of[cut]]
        out.append((occurrence[head][of[cut]], b + offset[cut], b + offset[stop] + length, least[cut] >> 32))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_RUN = "key long, doc_id long, th long, start int, n int"


def _keyed(docs: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for batch in _text.slices(batches, "text", 4 << 20):
            w = _text.words(*_text.buffer(batch.column(2)), fold=False)
            key, row, start, n = window_runs(w.hash, w.first, length)
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(row), batch.column(1).take(row), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], ["key", "doc_id", "th", "start", "n"])

    return docs.mapInArrow(run, _RUN)


def _again(keyed: DataFrame) -> DataFrame:
    """Runs whose key occurs more than once."""

    def run(batches):
        t = _text.gather(batches)
        if t is not None:
            key = t.column("key").to_numpy()
            ranked = np.sort(key)
            twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
            if len(twice):
                at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
                yield from t.filter(pa.array(twice[at] == key)).to_batches()

    return keyed.repartition("key").mapInArrow(run, _RUN)


def _picked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")


def duplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, th (hash of the text), start_word, end_word, first_doc_ids: every duplicate span, merged by document."""
    _shared.ship(docs.sparkSession)
    picked = _picked(docs, id_col, text_col)
    runs = _again(_keyed(picked, length)).groupBy("doc_id", "th").agg(F.collect_list(F.struct("key", "start", "n")).alias("runs"))

    def cut(batches):
        for batch in _text.slices(batches, "text", 4 << 20):
            data, offs = _text.buffer(batch.column(2))
            w = _text.words(data, offs, fold=False)
            lists = batch.column(3)
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            key, start, n = (flat.field(i).to_numpy() for i in range(3))
            a, b = w.start[w.first[row] + start], w.end[w.first[row] + start + n - 1]
            texts = pa.array([data[x:y].tobytes() for x, y in zip(a, b, strict=True)], pa.binary()).cast(pa.string())
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(row), batch.column(1).take(row), pa.array(start), texts], ["key", "doc_id", "th", "start", "run"])

    cuts = picked.join(runs.hint("shuffle_hash"), ["doc_id", "th"]).mapInArrow(cut, "key long, doc_id long, th long, start int, run string")

    def match(batches):
        t = _text.gather(batches)
        if t is None:
            return
        key = t.column("key").to_numpy()
        order = np.argsort(key, kind="stable")
        key = key[order]
        t = t.take(pa.array(order))
        # Whole keys, about BATCH words at a time.
        ends = np.flatnonzero(np.append(key[1:] != key[:-1], True)) + 1
        total = np.cumsum(pc.binary_length(t.column("run")).to_numpy())
        at = 0
        while at < len(key):
            limit = (total[at - 1] if at else 0) + 6 * BATCH
            i = int(np.searchsorted(ends, at, "right"))
            stop = int(ends[max(i, int(np.searchsorted(total[ends - 1], limit, "right")) - 1)])
            part = t.slice(at, stop - at)
            at = stop
            ids, th, begin = (part.column(c).to_numpy() for c in ("doc_id", "th", "start"))
            known, doc = np.unique(np.stack([ids, th], 1), axis=0, return_inverse=True)
            who, a, b, source = duplicate_spans(part.column("run").combine_chunks(), doc.ravel().astype(np.int64), begin.astype(np.int64), length)
            if len(who):
                yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(th[who]), pa.array(a), pa.array(b), pa.array(known[source, 0])], ["doc_id", "th", "a", "b", "source"])

    spans = cuts.repartition("key").mapInArrow(match, "doc_id long, th long, a long, b long, source long")

    def merge(batches):
        t = _text.gather(batches)
        if t is None:
            return
        ids, th, a, b, source = (c.to_numpy() for c in t.columns)
        order = np.lexsort((a, th, ids))
        ids, th, a, b, source = (x[order] for x in (ids, th, a, b, source))
        _, doc = np.unique(np.stack([ids, th], 1), axis=0, return_inverse=True)
        reach = np.maximum.accumulate(b + (doc.ravel().astype(np.int64) << 32)) - (doc.ravel().astype(np.int64) << 32)
        fresh = np.ones(len(a), bool)
        fresh[1:] = (ids[1:] != ids[:-1]) | (th[1:] != th[:-1]) | (a[1:] > reach[:-1])
        at = np.flatnonzero(fresh)
        span = np.cumsum(fresh) - 1
        both = np.unique(np.stack([span, source], 1), axis=0)
        offsets = np.append(np.searchsorted(both[:, 0], np.arange(len(at))), len(both)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(both[:, 1]))
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(th[at]), pa.array(a[at]), pa.array(np.maximum.reduceat(b, at)), lists], ["doc_id", "th", "start_word", "end_word", "first_doc_ids"])

    return spans.repartition("doc_id", "th").mapInArrow(merge, "doc_id long, th long, start_word long, end_word long, first_doc_ids array<long>")


def cut_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with duplicate spans cut out of the texts; n_chars, where there is one, follows. All rows stay."""
    spans = duplicated(docs, id_col, text_col, length)
    i, h, s = (_shared.unused(docs, n) for n in ("id", "th", "spans"))
    lists = spans.groupBy(F.col("doc_id").alias(i), F.col("th").alias(h)).agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias(s))
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in _text.slices(batches, text_col):
            texts, lists = batch.column(at), batch.column(batch.num_columns - 1)
            hit = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
            if len(hit):
                data, offs = _text.buffer(texts.take(pa.array(hit)))
                w = _text.words(data, offs, fold=False)
                new = texts.to_pylist()
                for k, row in enumerate(hit.tolist()):
                    starts = np.append(w.start[w.first[k] : w.first[k + 1]], offs[k + 1])
                    keep, done = [], offs[k]
                    for span in lists[row].as_py():
                        keep.append(data[done : starts[span["start_word"]]].tobytes())
                        done = starts[span["end_word"]]
                    keep.append(data[done : offs[k + 1]].tobytes())
                    new[row] = b"".join(keep).decode()
                texts = pa.array(new, texts.type)
            yield pa.RecordBatch.from_arrays([texts if c == at else batch.column(c) for c in range(batch.num_columns - 1)], batch.schema.names[:-1])

    id_, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    held = docs.join(lists.hint("shuffle_hash"), (id_ == F.col(i)) & (F.xxhash64(text) == F.col(h)), "left").select(*(docs[c] for c in docs.columns), s)
    out = held.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


SPANS_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\v\\f]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
p AS (SELECT doc_id, w, unnest(range(0, len(w) - {LENGTH - 1})) AS a FROM d WHERE len(w) >= {LENGTH}),
k AS (SELECT doc_id, a, md5(array_to_string(list_slice(w, a + 1, a + {LENGTH}), ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS source FROM k GROUP BY h HAVING count(*) > 1),
g AS (SELECT k.doc_id, k.a, f.source, row_number() OVER (PARTITION BY k.h ORDER BY k.doc_id, k.a) AS r FROM k JOIN f ON k.h = f.h),
b AS (SELECT doc_id, a, source, max(a) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM g WHERE r > 1),
i AS (SELECT *, sum(CASE WHEN last IS NULL OR a > last + {LENGTH} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a) AS island FROM b)
SELECT doc_id, min(a) AS start_word, max(a) + {LENGTH} AS end_word, list_sort(list_distinct(list(source))) AS first_doc_ids FROM i GROUP BY doc_id, island
"""
