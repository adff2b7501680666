"""URL filters: a blocklist as a sorted, memory-mapped digest array.

Entries are strings: ``d:`` and a domain (it and all below it), or ``u:`` and a canonical URL (host and
path without scheme, user, port, query, fragment and closing slashes).  Their 64-bit xxhash digests are
range-partitioned and sorted by Spark; each partition is one file in the shared folder, with digests,
offsets and the full strings, which the workers map into memory.  A page's candidates (its URL, its
host, the host's parent domains) and their digests are computed in the JVM; a worker finds them by
vectorised binary search, and compares the stored string of every entry with that digest, so a
collision can neither block a page nor hide an entry.

Defined cases: a null URL or one without a host has no candidates and is not blocked; null and empty
entries are dropped, repeated ones count once; an empty list blocks nothing; repeated pages are each
judged; of several matches the most specific is given: URL, then host, then parents upward.
"""

from __future__ import annotations

import os
import uuid
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm import _shared, _text

#: Domains that the registered query blocks; any table of entries will do.
DOMAINS = [f"{name}.example.{top}" for name in ("casino-win", "spam-farm", "ads-track", "adult-x", "cheap-pills", "free-bets") for top in ("com", "net", "org")]
DIGEST_SEED = 42  # that of Spark's xxhash64

_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    """Lower case, without closing dots; an IPv6 address keeps its brackets; a URL without a scheme (//host/path) has one, too."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), "\\.+$", "")


def canonical(url: Column) -> Column:
    """Host and path; '' where there is no host."""
    return F.when(host(url) != "", F.concat(host(url), F.regexp_replace(F.regexp_extract(url, _PATH, 1), "/+$", ""))).otherwise("")


def candidates(url: Column) -> Column:
    """Entries that would block the URL, the most specific first."""
    parts = F.split(host(url), "\\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    return F.when(F.coalesce(host(url), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.concat(F.array(F.concat(F.lit("u:"), canonical(url))), parents))


def _local(path: str) -> str:
    """The mounted path of a shared-folder URI."""
    at = urlparse(path)
    if at.scheme not in ("", "file"):
        raise ValueError(f"a memory-mapped list needs a shared folder that is mounted on every executor, not {path}")
    return unquote(at.path)


def build(entries: DataFrame, entry_col: str = "entry") -> list[tuple[int, int, str]]:
    """Writes the digest array; returns its files in order: least digest, greatest digest, path.

    Names are unique to a task attempt and only the files of tasks that ended well are returned, so
    lost executors and repeated tasks leave no wrong file behind in the list.
    """
    spark = entries.sparkSession
    _shared.ship(spark)
    at = _local(f"{_shared.folder(spark)}/urls-{uuid.uuid4().hex}")
    clean = entries.select(F.col(entry_col).cast("string").alias("entry")).where("entry IS NOT NULL AND entry <> ''").distinct().withColumn("digest", F.xxhash64("entry"))
    ordered = clean.repartitionByRange("digest").sortWithinPartitions("digest", "entry").select("digest", "entry")

    def write(batches):
        t = _text.gather(batches)
        if t is None:
            return
        os.makedirs(at, exist_ok=True)
        path = f"{at}/{uuid.uuid4().hex}"
        digest = t.column("digest").to_numpy()
        data, offs = _text.buffer(t.column("entry"))
        digest.astype("<i8").tofile(f"{path}.digest")
        offs.astype("<i8").tofile(f"{path}.offset")
        data.tofile(f"{path}.string")
        yield pa.RecordBatch.from_arrays([pa.array([int(digest[0])]), pa.array([int(digest[-1])]), pa.array([path])], ["low", "high", "path"])

    return sorted((r.low, r.high, r.path) for r in ordered.mapInArrow(write, "low long, high long, path string").collect())


@lru_cache(maxsize=4096)
def _mapped(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.memmap(f"{path}.{part}", kind, "r") for part, kind in (("digest", "<i8"), ("offset", "<i8"), ("string", "u1")))


def lookup(files: list[tuple[int, int, str]], digest: np.ndarray, strings: pa.Array) -> np.ndarray:
    """Which of the strings are in the list."""
    found = np.zeros(len(digest), bool)
    order = np.argsort(digest, kind="stable")
    ranked = digest[order]
    for low, high, path in files:
        a, b = np.searchsorted(ranked, low, "left"), np.searchsorted(ranked, high, "right")
        if a == b:
            continue
        keys, offs, data = _mapped(path)
        left, right = np.searchsorted(keys, ranked[a:b], "left"), np.searchsorted(keys, ranked[a:b], "right")
        for i in np.flatnonzero(right > left):
            own = strings[int(order[a + i])].as_py().encode()
            found[order[a + i]] |= any(data[offs[j] : offs[j + 1]].tobytes() == own for j in range(left[i], right[i]))
    return found


def block(pages: DataFrame, files: list[tuple[int, int, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, url, is_blocked and the entry that blocks it, for every page."""
    _shared.ship(pages.sparkSession)

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            strings, digest = lists.flatten(), batch.column(3).flatten().to_numpy()
            hit = np.flatnonzero(lookup(files, digest, strings))
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())[hit]
            row, at = np.unique(row, return_index=True)  # the first is the most specific
            entry = np.full(batch.num_rows, -1)
            entry[row] = hit[at]
            entry = strings.take(pa.array(entry, mask=entry < 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), entry.is_valid(), entry], ["page_id", "url", "is_blocked", "entry"])

    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")).withColumn("strings", candidates(F.col("url")))
    return own.withColumn("digests", F.transform("strings", lambda s: F.xxhash64(s))).mapInArrow(run, "page_id long, url string, is_blocked boolean, entry string")


def crawled_twice(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Entries for the canonical URLs that more than one row of pages has."""
    own = pages.select(canonical(F.col(url_col).cast("string")).alias("c")).where("c IS NOT NULL AND c <> ''")
    return own.groupBy("c").count().where("count > 1").select(F.concat(F.lit("u:"), F.col("c")).alias("entry"))


def filter_pages(pages: DataFrame, domains: list[str] | None = None) -> DataFrame:
    """Pages against the blocked domains and the URLs crawled more than once."""
    spark = pages.sparkSession
    listed = spark.createDataFrame([(f"d:{d.lower()}",) for d in (DOMAINS if domains is None else domains)], "entry string")
    return block(pages, build(listed.unionByName(crawled_twice(pages))))


_SQL_HOST = f"regexp_replace(lower(regexp_extract(url, '{_HOST}', 1)), '\\.+$', '')"
FILTER_SQL = f"""
WITH p AS (SELECT page_id, url, {_SQL_HOST} AS h, {_SQL_HOST} || regexp_replace(regexp_extract(url, '{_PATH}', 1), '/+$', '') AS c FROM pages),
e AS (SELECT 'u:' || c AS entry FROM p WHERE h <> '' GROUP BY c HAVING count(*) > 1 UNION SELECT * FROM (VALUES {", ".join(f"('d:{d}')" for d in DOMAINS)}) AS v(entry)),
l AS (SELECT page_id, url, string_split(h, '.') AS s, c FROM p WHERE h <> ''),
k AS (SELECT page_id, 0 AS rank, 'u:' || c AS entry FROM l UNION ALL
  SELECT page_id, i AS rank, 'd:' || array_to_string(list_slice(s, i, len(s)), '.') AS entry FROM (SELECT page_id, s, unnest(range(1, greatest(len(s), 2))) AS i FROM l)),
b AS (SELECT page_id, arg_min(k.entry, rank) AS entry FROM k JOIN e ON k.entry = e.entry GROUP BY page_id)
SELECT p.page_id, p.url, b.entry IS NOT NULL AS is_blocked, b.entry FROM p LEFT JOIN b ON p.page_id = b.page_id
"""
