"""Secret scans: values in credential contexts, judged by the least cost of guessing them.

A context is a credential word (password, token, api key, ...), an assignment sign and a value, quoted
or bare.  The cost of a value is that of its cheapest segmentation into dictionary words (also
capitalised or with digits for letters), dates, repeats, keyboard walks and brute-force spans, found
by dynamic programming over the whole value: the log10 of each part's guesses, plus ``PART`` for each
part after the first.  Values, walks and repeated blocks may be of any length.  A value that takes ``10 ** STRONG`` guesses or more is a secret; cheaper ones
("changeme", "12345678") are reported as placeholders.

Defined cases: a null text has no findings; a null doc_id is scanned and reported as null; repeated
rows are each reported; the whole text is scanned whatever its length; of contexts that overlap, the
one that begins first counts.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import _shared, _text

STRONG = 10.0
PART = math.log10(4)
MIN_VALUE = 6
MASK = "<SECRET>"

_NAME = r"passwords?|passwd|passphrase|pwd|secrets?|tokens?|api[_-]?keys?|access[_-]?keys?|secret[_-]?keys?|private[_-]?keys?|auth[_-]?keys?|credentials?"
_SHAPE = rf"(?P<name>{_NAME})[\"']?[ \t]*(?:=>|:=|=|:)[ \t]*(?:\"(?P<a>[^\"\n]{{{MIN_VALUE},}})\"|'(?P<b>[^'\n]{{{MIN_VALUE},}})'|(?P<c>[^\s\"',;]{{{MIN_VALUE},}}))"
CONTEXT = re.compile(_SHAPE, re.IGNORECASE)
#: The same without names of groups, for RE2: finds the texts worth a closer look. Its white space is ASCII, so it finds no fewer.
_CONTEXT_RE2 = re.sub(r"\?P<\w+>", "?:", _SHAPE)

#: Most common first: the place in the list is the number of guesses.
COMMON = (
    "password 123456 qwerty admin welcome letmein secret changeme test user root master login example token default guest hello monkey dragon "
    "abc123 iloveyou sunshine princess football shadow superman michael access pass key your here none null true false placeholder dummy sample demo "
    "summer winter spring autumn january february march april may june july august september october november december server database mysql postgres "
    "oracle redis backup temp public private company internal system manager service account email mail site web cloud data api dev prod stage staging "
    "the and for you love baby angel king star blue red green black white dog cat house home money happy lucky magic power super ninja soccer hockey "
    "baseball batman trustno starwars computer internet freedom whatever charlie thomas jordan hunter daniel robert andrew jessica ashley nicole matrix"
).split()
_RANK = {w: i + 1 for i, w in enumerate(COMMON)}
_LONGEST = max(map(len, COMMON))
_LEET = str.maketrans("013457@$!", "oleastasi")
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
_NEXT = {(a, b) for row in _ROWS for a, b in zip(row, row[1:], strict=False)}
_NEXT |= {(b, a) for a, b in _NEXT}
_NEXT |= {(a, b) for upper, lower in zip(_ROWS[:3], _ROWS[1:4], strict=True) for i, a in enumerate(upper) for b in lower[max(0, i - 1) : i + 1]}
_DATE = re.compile(r"(?=((?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)\d\d))")
_YEAR = re.compile(r"(?=((?:19|20)\d\d))")


def char_cost(value: str) -> float:
    """log10 of the guesses for one brute-forced character: the size of the alphabet that the value draws on."""
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) and not value.isdigit():
        return math.log10(16)
    size = 10 * bool(re.search(r"\d", value)) + 26 * bool(re.search("[a-z]", value)) + 26 * bool(re.search("[A-Z]", value))
    size += 33 * bool(re.search(r"[ -/:-@\[-`{-~]", value)) + 100 * bool(re.search(r"[^ -~]", value))
    return math.log10(max(size, 2))


def _reach(h: np.ndarray, power: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """How many characters from a on (``back``: before a) equal those from b on, at most ``most``: binary search over prefix hashes."""
    low, high = np.zeros_like(a), most.copy()
    while (open_ := low < high).any():
        mid = (low + high + 1) // 2
        x, y = (a - mid, b - mid) if back else (a, b)
        with np.errstate(over="ignore"):
            same = h[x + mid] - h[x] * power[mid] == h[y + mid] - h[y] * power[mid]
        low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
    return low


def runs(value: str) -> list[tuple[int, int, int]]:
    """(begin, end, size) of every maximal stretch that repeats a block of ``size`` characters, twice at least; blocks of any size.

    Such a stretch holds two places a block apart that are multiples of its size, so those are all that is
    compared: n / size pairs for a size, n log n in all.
    """
    n = len(value)
    if n < 2:
        return []
    codes = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
    h, power = np.zeros(n + 1, np.uint64), np.ones(n + 1, np.uint64)
    mixed, base = _text.mix(codes.astype(np.uint64)), np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        power[1:] = np.cumprod(np.full(n, base))
        inverse = np.cumprod(np.full(n, np.uint64(pow(int(base), -1, 1 << 64))))
        h[1:] = np.cumsum(mixed * inverse) * power[1:]  # h[j] is the sum of mixed[i] * base ** (j - 1 - i)
    found: dict[tuple[int, int], int] = {}
    size = 1
    while size <= n // 2:
        upto, pairs = size, 0
        while upto <= n // 2 and pairs < 1 << 19:
            pairs += n // upto
            upto += 1
        sizes = np.arange(size, upto)
        counts = (n - 1) // sizes
        step = np.repeat(sizes, counts)
        a = step * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
        b = a + step
        near = (codes[a] == codes[b]) | (a > 0) & (codes[a - 1] == codes[b - 1])
        a, b, step = a[near], b[near], step[near]
        ahead = _reach(h, power, a, b, n - b, False)
        behind = _reach(h, power, a, b, a, True)
        long = ahead + behind >= step
        for begin, end, k in zip((a - behind)[long].tolist(), (b + ahead)[long].tolist(), step[long].tolist(), strict=True):
            if found.get((begin, end), k) >= k and value[begin : end - k] == value[begin + k : end]:
                found[begin, end] = k
        size = upto
    return sorted((a, b, k) for (a, b), k in found.items())


def _walks(low: str) -> list[tuple[int, int]]:
    """Maximal stretches of three characters or more of which each is next to the one before on a keyboard or in the alphabet."""
    out, i = [], 0
    while i < len(low) - 2:
        j = i + 1
        while j < len(low) and (low[j - 1], low[j]) in _NEXT:
            j += 1
        if j - i >= 3:
            out.append((i, j))
        i = max(j - 1, i + 1)
    return out


def parts(value: str) -> list[tuple[int, int, str, float]]:
    """Spans of the value that are cheaper than brute force: start, end, kind, log10 of the guesses.

    All words and dates.  Walks and repeats may be cut: they begin where they can or where another part
    ends, and end where they can or where another begins; any other cut only leaves more to brute force.
    """
    found, low, n = [], value.lower(), len(value)
    plain = low.translate(_LEET)
    for i in range(n):
        for j in range(i + 3, min(n, i + _LONGEST) + 1):
            for form, extra in ((low, 0.0), (plain, 0.7)):
                if rank := _RANK.get(form[i:j]):
                    case = 0.0 if value[i:j] == low[i:j] else 0.4
                    found.append((i, j, "word", math.log10(rank) + extra * (form[i:j] != low[i:j]) + case))
                    break
    for pattern, kind, cost in ((_DATE, "date", math.log10(365 * 120 * 4)), (_YEAR, "date", math.log10(200))):
        found += [(m.start(), m.start() + len(m[1]), kind, cost) for m in pattern.finditer(value)]
    walks, again, each = _walks(low), runs(value), char_cost(value)
    # Where parts that aren't cut begin and end; a repeat's own ends: whole blocks from its begin, and to its end.
    begins = sorted({0} | {f[0] for f in found} | {w[0] for w in walks} | {x for a, b, k in again for x in (a, a + (b - a) % k)})
    ends = sorted({n} | {f[1] for f in found} | {w[1] for w in walks} | {x for a, b, k in again for x in (b, b - (b - a) % k)})
    inside = lambda xs, a, b: xs[bisect_left(xs, a) : bisect_right(xs, b)]
    for a, b in walks:
        for i in {a, *inside(ends, a, b - 3)}:
            found += [(i, j, "walk", math.log10(47 * 4 * (j - i))) for j in {b, *inside(begins, i + 3, b)}]
    for a, b, k in again:
        least = 3 if k == 1 else 2
        for i in {*range(a, a + (b - a) % k + 1), *inside(ends, a, b - least * k)}:
            for times in {(b - i) // k, *((j - i) // k for j in inside(begins, i + least * k, b) if (j - i) % k == 0)}:
                if times >= least:
                    found.append((i, i + times * k, "repeat", k * each + math.log10(times)))
    return found


def guess_cost(value: str) -> tuple[float, list[tuple[str, int]]]:
    """log10 of the guesses for the cheapest segmentation, and its parts as (kind, length).

    Two states an end: the last part is a brute-force span, which may grow, or is another.
    """
    n, each = len(value), char_cost(value)
    by_end: dict[int, list[tuple[int, str, float]]] = {}
    for i, j, kind, cost in parts(value):
        by_end.setdefault(j, []).append((i, kind, cost))
    inf = float("inf")
    other, brute = [0.0] + [inf] * n, [inf] * (n + 1)
    came_other: list[tuple[int, str] | None] = [None] * (n + 1)
    came_brute = [0] * (n + 1)
    for j in range(1, n + 1):
        opened = other[j - 1] + each + (PART if j > 1 else 0.0)
        grown = brute[j - 1] + each
        brute[j], came_brute[j] = (grown, came_brute[j - 1]) if grown <= opened else (opened, j - 1)
        for i, kind, cost in by_end.get(j, ()):
            total = min(other[i], brute[i]) + cost + (PART if i else 0.0)
            if total < other[j]:
                other[j], came_other[j] = total, (i, kind)
    out, j = [], n
    in_brute = brute[n] <= other[n]
    while j:
        i, kind = (came_brute[j], "brute") if in_brute else came_other[j]
        out.append((kind, j - i))
        in_brute = kind != "brute" and brute[i] <= other[i]
        j = i
    return min(other[n], brute[n]), out[::-1]


def findings(text: str) -> list[tuple[int, int, str, float, str, str]]:
    """start, length, name, cost, parts and fingerprint of every context's value in a text."""
    out = []
    for m in CONTEXT.finditer(text):
        group = "a" if m["a"] else "b" if m["b"] else "c"
        cost, split = guess_cost(m[group])
        out.append((m.start(group), m.end(group) - m.start(group), m["name"].lower(), round(cost, 6), "+".join(f"{k}:{n}" for k, n in split), hashlib.sha256(m[group].encode()).hexdigest()[:16]))
    return out


def _suspects(texts: pa.Array) -> np.ndarray:
    return np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, _CONTEXT_RE2, ignore_case=True), False).to_numpy(zero_copy_only=False))


_FOUND = "doc_id long, start long, n_chars long, name string, guesses_log10 double, parts string, fingerprint string, is_secret boolean"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a context: where its value lies, what guessing it costs, and whether it is a secret. The value itself isn't shown."""
    _shared.ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = [(batch.column(0)[int(i)].as_py(), *f, f[3] >= STRONG) for i in _suspects(batch.column(1)) for f in findings(batch.column(1)[int(i)].as_py())]
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "start", "n_chars", "name", "guesses_log10", "parts", "fingerprint", "is_secret"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _FOUND)


def masked(text: str) -> str:
    out, at = [], 0
    for start, n, _, cost, _, _ in findings(text):
        if cost >= STRONG:
            out += [text[at:start], MASK]
            at = start + n
    return "".join(out) + text[at:]


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every secret's value replaced by ``<SECRET>``; n_chars, where there is one, follows. All rows stay."""
    _shared.ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = batch.column(at)
            hit = _suspects(texts)
            if len(hit):
                new = pa.array([masked(texts[int(i)].as_py()) for i in hit], texts.type)
                where = np.zeros(len(texts), bool)
                where[hit] = True
                texts = pc.replace_with_mask(texts, pa.array(where), new)
            yield pa.RecordBatch.from_arrays([texts if i == at else batch.column(i) for i in range(batch.num_columns)], batch.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
