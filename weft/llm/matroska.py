"""Media columns: Matroska containers parsed into packet tables.

``packets`` walks the EBML element tree of each container: variable-length ids and sizes (unknown sizes
too), Segment Info, Tracks, Clusters with SimpleBlocks and BlockGroups, all four kinds of lacing, and
Cues.  Each frame of each block becomes one row with its track, codec, timestamp and byte range in the
container, so payloads can be cut out later without another parse.  A frame of a lace comes one default
duration of its track after the frame before it, where the track has one.  Times are whole milliseconds,
rounded down, in integer arithmetic.  Tracks, time scale and cues are those of a block's own segment.

``mux`` writes containers from texts, for tables that hold no media: each line is a block on track 1
(subtitles) or, laced into up to four frames of ``FRAME_MS``, on track 2; a cluster holds ``CLUSTER``
lines, and every second cluster has a cue.

Defined cases: a null container has no packets; one that is damaged or cut short gives the packets
before the damage and one row whose ``error`` says what is wrong, with all other columns but doc_id null
(numbers of more than 8 bytes, a time scale of 0 and times beyond 64 bits are damage);
a null doc_id comes back null; repeated rows are each parsed; a null text is muxed as a null container
and an empty one as a container without clusters.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import _shared

CLUSTER = 8
LINE_MS = 1000
FRAME_MS = 250
SCALE = 1_000_000  # nanoseconds in a tick

EBML, SEGMENT, INFO, TRACKS, CLUSTERS, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
_MASTERS = {SEGMENT, INFO, TRACKS, CLUSTERS, CUES, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469}
_LACING = ("none", "xiph", "fixed", "ebml")


def _vint(n: int, length: int | None = None) -> bytes:
    if length is None:
        length = next(k for k in range(1, 9) if n < (1 << 7 * k) - 1)
    return (n | 1 << 7 * length).to_bytes(length, "big")


def _element(ident: int, payload: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + _vint(len(payload)) + payload


def _uint(ident: int, n: int) -> bytes:
    return _element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _laced(frames: list[bytes], kind: int) -> bytes:
    """Lace header and frames, the bytes of a block behind its flags."""
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if kind == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == 3:
        head += _vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            d = b - a
            length = next(k for k in range(1, 9) if abs(d) < 1 << 7 * k - 1)
            head += _vint(d + (1 << 7 * length - 1) - 1, length)
    return head + b"".join(frames)


_HEADER = _element(EBML, _uint(0x4286, 1) + _uint(0x42F7, 1) + _element(0x4282, b"matroska") + _uint(0x4287, 4))
_FRONT = _element(INFO, _uint(0x2AD7B1, SCALE)) + _element(
    TRACKS,
    _element(0xAE, _uint(0xD7, 1) + _uint(0x83, 0x11) + _element(0x86, b"S_TEXT/UTF8"))
    + _element(0xAE, _uint(0xD7, 2) + _uint(0x83, 0x02) + _uint(0x23E383, FRAME_MS * 1_000_000) + _element(0x86, b"A_PCM/INT/LIT")),
)


def mux(text: str) -> bytes:
    """A container whose frames, in order, are the bytes of the text's lines that aren't empty."""
    lines = [x for x in text.encode().split(b"\n") if x]
    body, cues, at = [], [], len(_FRONT)
    for c in range(0, len(lines), CLUSTER):
        blocks = [_uint(0xE7, c * LINE_MS)]
        for i, line in enumerate(lines[c : c + CLUSTER]):
            kind = (c + i) % 4
            time = (i * LINE_MS).to_bytes(2, "big")
            if kind == 0 or len(line) < 8:
                blocks.append(_element(0xA3, b"\x81" + time + b"\x80" + line))
                continue
            step = len(line) // 4
            frames = [line[:step], line[step : 2 * step], line[2 * step : 3 * step], line[3 * step :]]
            if kind == 2 and len(line) % 4:
                kind = 1
            block = b"\x82" + time
            if kind == 3:  # in a group, with a duration
                blocks.append(_element(0xA0, _element(0xA1, block + bytes([kind << 1]) + _laced(frames, kind)) + _uint(0x9B, LINE_MS)))
            else:
                blocks.append(_element(0xA3, block + bytes([0x80 | kind << 1]) + _laced(frames, kind)))
        cluster = _element(CLUSTERS, b"".join(blocks))
        if c // CLUSTER % 2 == 0:
            cues.append(_element(0xBB, _uint(0xB3, c * LINE_MS) + _element(0xB7, _uint(0xF7, 1) + _uint(0xF1, at))))
        body.append(cluster)
        at += len(cluster)
    return _HEADER + _element(SEGMENT, _FRONT + b"".join(body) + (_element(CUES, b"".join(cues)) if cues else b""))


class Damaged(ValueError):
    pass


def _read_id(data: bytes, at: int, end: int) -> tuple[int, int]:
    if at >= end or not data[at]:
        raise Damaged(f"no element id at byte {at}")
    length = 9 - data[at].bit_length()
    if length > 4 or at + length > end:
        raise Damaged(f"no element id at byte {at}")
    return int.from_bytes(data[at : at + length], "big"), at + length


def _read_size(data: bytes, at: int, end: int) -> tuple[int | None, int]:
    """The size and where it ends; None if it is unknown."""
    if at >= end or not data[at]:
        raise Damaged(f"no size at byte {at}")
    length = 9 - data[at].bit_length()
    if at + length > end:
        raise Damaged(f"no size at byte {at}")
    n = int.from_bytes(data[at : at + length], "big") & (1 << 7 * length) - 1
    return (None if n == (1 << 7 * length) - 1 else n), at + length


def _children(data: bytes, at: int, end: int):
    """(id, first byte, end, whether the parent ends before it) of each element."""
    while at < end:
        ident, body = _read_id(data, at, end)
        size, body = _read_size(data, body, end)
        if size is None:
            if ident not in (SEGMENT, CLUSTERS):
                raise Damaged(f"element {ident:#x} at byte {at} has no size")
            try:
                stop = _unknown_end(data, body, end, ident)
            except Damaged:  # raised again by whoever reads what is inside, behind the elements before the damage
                yield ident, body, end, False
                return
        else:
            stop = body + size
            if stop > end:
                yield ident, body, end, True
                return
        yield ident, body, stop, False
        at = stop


def _unknown_end(data: bytes, at: int, end: int, ident: int) -> int:
    if ident == SEGMENT:
        return end
    while at < end:
        child, body = _read_id(data, at, end)
        if child in _MASTERS or child == EBML:
            return at
        size, body = _read_size(data, body, end)
        at = min(end, body + (size if size is not None else end))
    return end


def _number(data: bytes, a: int, b: int) -> int:
    if b - a > 8:
        raise Damaged(f"number of {b - a} bytes at byte {a}")
    return int.from_bytes(data[a:b], "big")


def _ms(ticks: int, scale: int, extra: int = 0) -> int:
    """Whole milliseconds of so many ticks of ``scale`` nanoseconds and ``extra`` nanoseconds."""
    return (ticks * scale + extra) // 1_000_000


def _frames(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames."""
    if not lacing:
        return [(at, end - at)]
    if at >= end:
        raise Damaged(f"no lace at byte {at}")
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == 2:
        if (end - at) % n:
            raise Damaged(f"lace of unequal frames at byte {at}")
        sizes = [(end - at) // n] * n
    else:
        for i in range(n - 1):
            if lacing == 1:
                size = 0
                while True:
                    if at >= end:
                        raise Damaged(f"lace cut short at byte {at}")
                    size += data[at]
                    at += 1
                    if data[at - 1] != 255:
                        break
            else:
                start = at
                value, at = _read_size(data, at, end)
                length = at - start
                value = (1 << 7 * length) - 1 if value is None else value
                size = value if i == 0 else sizes[-1] + value - ((1 << 7 * length - 1) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
        if min(sizes) < 0:
            raise Damaged(f"lace longer than its block at byte {at}")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


class _Segment:
    """What holds for the blocks of one segment: time scale, tracks (codec, nanoseconds a frame), cued clusters, and the rows so far."""

    def __init__(self, first_cluster: int):
        self.scale, self.tracks, self.cued, self.clusters, self.rows, self.first_cluster = SCALE, {}, set(), [], [], first_cluster

    def block(self, data: bytes, a: int, b: int, base: int, simple: bool, duration: int | None, refers: bool) -> None:
        track, at = _read_size(data, a, b)
        if track is None or at + 3 > b:
            raise Damaged(f"block cut short at byte {a}")
        time = base + int.from_bytes(data[at : at + 2], "big", signed=True)
        flags = data[at + 2]
        lacing = flags >> 1 & 3
        key = bool(flags & 0x80) if simple else not refers
        for i, (start, size) in enumerate(_frames(data, at + 3, b, lacing)):
            self.rows.append((track, len(self.clusters) - 1, time, duration, key, _LACING[lacing], i, start, size))

    def cluster(self, data: bytes, a: int, b: int) -> None:
        base = 0
        for ident, x, y, short in _children(data, a, b):
            if short:
                raise Damaged(f"element {ident:#x} cut short at byte {y}")
            if ident == 0xE7:
                base = _number(data, x, y)
            elif ident == 0xA3:
                self.block(data, x, y, base, True, None, False)
            elif ident == 0xA0:
                inner, duration, refers = [], None, False
                for child, p, q, broken in _children(data, x, y):
                    if broken:
                        raise Damaged(f"element {child:#x} cut short at byte {q}")
                    if child == 0xA1:
                        inner.append((p, q))
                    elif child == 0x9B:
                        duration = _number(data, p, q)
                    elif child == 0xFB:
                        refers = True
                for p, q in inner:
                    self.block(data, p, q, base, False, duration, refers)

    def element(self, data: bytes, child: int, low: int, x: int, y: int) -> None:
        if child == INFO:
            for k, p, q, _ in _children(data, x, y):
                if k == 0x2AD7B1:
                    scale = _number(data, p, q)
                    if not scale:
                        raise Damaged(f"time scale of 0 at byte {p}")
                    self.scale = scale
        elif child == TRACKS:
            for k, p, q, _ in _children(data, x, y):
                if k == 0xAE:
                    own = {c: (s, t) for c, s, t, _ in _children(data, p, q)}
                    if 0xD7 in own:
                        codec = data[slice(*own[0x86])].decode("ascii", "replace") if 0x86 in own else ""
                        self.tracks[_number(data, *own[0xD7])] = codec, _number(data, *own[0x23E383]) if 0x23E383 in own else 0
        elif child == CLUSTERS:
            self.clusters.append(_head(data, low, x) - low)
            self.cluster(data, x, y)
        elif child == CUES:
            for k, p, q, _ in _children(data, x, y):
                if k == 0xBB:
                    for c, s, t, _ in _children(data, p, q):
                        if c == 0xB7:
                            self.cued |= {_number(data, e, f) for d, e, f, _ in _children(data, s, t) if d == 0xF1}

    def packets(self) -> list[tuple]:
        out = []
        for t, c, time, d, key, lace, i, at, n in self.rows:
            codec, each = self.tracks.get(t, (None, 0))
            stamp, lasts = _ms(time, self.scale, i * each), None if d is None else _ms(d, self.scale)
            if not -(1 << 63) <= stamp < 1 << 63 or (lasts or 0) >= 1 << 63:
                raise _Beyond(out, f"time beyond 64 bits at byte {at}")
            out.append((t, codec, self.first_cluster + c, stamp, lasts, key, lace, i, at, n, self.clusters[c] in self.cued))
        return out


class _Beyond(Damaged):
    """Damage seen only when rows are made: carries those before it."""

    def __init__(self, before: list[tuple], message: str):
        super().__init__(message)
        self.before = before


def packets(data: bytes) -> tuple[list[tuple], str | None]:
    """(track, codec, cluster, timestamp_ms, duration_ms, keyframe, lacing, frame, offset, size, cue), and what is wrong, if anything."""
    segments: list[_Segment] = []
    error = None
    try:
        top = _children(data, 0, len(data))
        first = next(top, None)
        if first is None or first[0] != EBML or first[3]:
            raise Damaged("no EBML header")
        for ident, a, b, short in top:
            if ident != SEGMENT:
                continue
            segments.append(own := _Segment(sum(len(s.clusters) for s in segments)))
            for child, x, y, broken in _children(data, a, b):
                own.element(data, child, a, x, y)
                if broken:
                    raise Damaged(f"element {child:#x} cut short at byte {y}")
            if short:
                raise Damaged(f"segment cut short at byte {b}")
        if not segments:
            raise Damaged("no segment")
    except Damaged as e:
        error = str(e)
    out: list[tuple] = []
    try:
        for s in segments:
            out += s.packets()
    except _Beyond as e:
        out, error = out + e.before, str(e)
    return out, error


def _head(data: bytes, low: int, body: int) -> int:
    """Where the cluster whose body begins at ``body`` has its id."""
    for length in range(1, 9):
        at = body - length - 4
        if at >= low and data[at : at + 4] == b"\x1f\x43\xb6\x75" and 9 - data[at + 4].bit_length() == length:
            return at
    raise Damaged(f"no cluster at byte {body}")


_PACKETS = pa.schema([("doc_id", pa.int64()), ("track", pa.int64()), ("codec", pa.string()), ("cluster", pa.int64()), ("timestamp_ms", pa.int64()), ("duration_ms", pa.int64()), ("keyframe", pa.bool_()), ("lacing", pa.string()), ("frame", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("cue", pa.bool_()), ("error", pa.string())])
_PACKETS_DDL = "doc_id long, track long, codec string, cluster long, timestamp_ms long, duration_ms long, keyframe boolean, lacing string, frame long, offset long, size long, cue boolean, error string"


def containers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``media``: each text as a container."""
    _shared.ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if t is None else mux(t) for t in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, media binary")


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row a frame; see ``packets``."""
    _shared.ship(media.sparkSession)

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for ident, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not data.is_valid:
                    continue
                found, error = packets(data.as_py())
                rows += [(ident, *f, None) for f in found]
                if error:
                    rows.append((ident, *[None] * 11, error))
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PACKETS, strict=True)], schema=_PACKETS)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PACKETS, strict=True)], schema=_PACKETS)

    return media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).cast("binary").alias("media")).mapInArrow(run, _PACKETS_DDL)


def _steps(n: str, limits: list[int]) -> str:
    """SQL: how many of the bytes, the limits of which are given, ``n`` takes."""
    return "CASE " + " ".join(f"WHEN {n} < {limit} THEN {k}" for k, limit in enumerate(limits, 1)) + f" ELSE {len(limits) + 1} END"


def _sql_vint(n: str) -> str:
    return _steps(n, [(1 << 7 * k) - 1 for k in range(1, 6)])


def _sql_bytes(n: str) -> str:
    return _steps(n, [1 << 8 * k for k in range(1, 6)])


#: The packets of the containers that ``mux`` writes, from the lengths of the lines alone.
PACKETS_SQL = f"""
WITH l AS (SELECT row_number() OVER () AS doc, doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS ls FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc, doc_id, i, strlen(ls[i + 1]) AS n FROM (SELECT doc, doc_id, ls, unnest(range(0, len(ls))) AS i FROM l)),
k AS (SELECT *, n // 4 AS step, CASE WHEN n < 8 THEN 0 WHEN i % 4 = 2 AND n % 4 > 0 THEN 1 ELSE i % 4 END AS kind FROM x),
h AS (SELECT *, CASE kind WHEN 0 THEN 0 WHEN 1 THEN 1 + 3 * (step // 255 + 1) WHEN 2 THEN 1 ELSE 3 + {_sql_vint("step")} END AS head FROM k),
p AS (SELECT *, 4 + head + n AS payload, 1 + {_sql_vint("(4 + head + n)")} AS front FROM h),
b AS (SELECT *, front + payload + 4 AS grouped, i // {CLUSTER} AS cluster FROM p),
e AS (SELECT *, CASE WHEN kind = 3 THEN 1 + {_sql_vint("grouped")} + grouped ELSE front + payload END AS block, CASE WHEN kind = 3 THEN 1 + {_sql_vint("grouped")} ELSE 0 END + front + 4 + head AS inside FROM b),
o AS (SELECT *, inside + coalesce(sum(block) OVER (PARTITION BY doc, cluster ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS after FROM e),
c AS (SELECT doc, cluster, sum(block) AS blocks, {_sql_bytes(f"(cluster * {CLUSTER * LINE_MS})")} AS stamp FROM e GROUP BY doc, cluster),
c2 AS (SELECT *, 2 + stamp + blocks AS body FROM c),
c3 AS (SELECT *, 4 + {_sql_vint("body")} AS opening FROM c2),
c4 AS (SELECT *, {len(_FRONT)} + coalesce(sum(opening + body) OVER (PARTITION BY doc ORDER BY cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM c3),
c5 AS (SELECT *, CASE WHEN cluster % 2 = 0 THEN 2 + 2 + stamp + 2 + 3 + 2 + {_sql_bytes("place")} ELSE 0 END AS cue_size FROM c4),
s AS (SELECT doc, sum(opening + body) AS clusters, sum(cue_size) AS cues FROM c5 GROUP BY doc),
s2 AS (SELECT doc, {len(_FRONT)} + clusters + 4 + {_sql_vint("cues")} + cues AS segment FROM s),
f AS (SELECT o.*, {len(_HEADER)} + 4 + {_sql_vint("segment")} + place + opening + 2 + stamp + after AS base, unnest(range(0, CASE WHEN kind = 0 THEN 1 ELSE 4 END)) AS frame FROM o JOIN c5 ON c5.doc = o.doc AND c5.cluster = o.cluster JOIN s2 ON s2.doc = o.doc)
SELECT doc_id, CAST(CASE WHEN kind = 0 THEN 1 ELSE 2 END AS BIGINT) AS track, CASE WHEN kind = 0 THEN 'S_TEXT/UTF8' ELSE 'A_PCM/INT/LIT' END AS codec,
  CAST(cluster AS BIGINT) AS cluster, CAST(i * {LINE_MS} + frame * {FRAME_MS} AS BIGINT) AS timestamp_ms, CAST(CASE WHEN kind = 3 THEN {LINE_MS} END AS BIGINT) AS duration_ms, true AS keyframe,
  CASE kind WHEN 0 THEN 'none' WHEN 1 THEN 'xiph' WHEN 2 THEN 'fixed' ELSE 'ebml' END AS lacing, CAST(frame AS BIGINT) AS frame, CAST(base + frame * step AS BIGINT) AS "offset",
  CAST(CASE WHEN kind = 0 THEN n WHEN frame < 3 THEN step ELSE n - 3 * step END AS BIGINT) AS size, cluster % 2 = 0 AS cue, CAST(NULL AS VARCHAR) AS error FROM f
"""
