"""JSONL snapshots, agent-to-agent sync files and backfill exports.

Records are written by the cluster as text; a snapshot is a folder of part files, so it may be larger than
any one machine.  Its checksum is over the header and a sum of all lines' digests, which a cluster
recomputes in parallel; ``bytes_verified`` checks one-file snapshots, whose checksum is over their text.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import merge
from weft.operators.components import shared_folder, small_tasks
from weft.operators.graph import EDGE, ENTITY, MEMORY, Graph

_STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
_KINDS = {"entity": ENTITY, "relationship": EDGE, "memory_id": MEMORY}


def _names(ddl: str) -> list[tuple[str, str]]:
    return [tuple(x.strip().split(" ")) for x in ddl.split(",")]


def _record(df: DataFrame, kind: str, ddl: str, tag: str = "record_type", nested: bool = False) -> DataFrame:
    stamp = lambda n, t: F.date_format(n, _STAMP).alias(n) if t == "timestamp" else F.to_json(n).alias(n) if t.startswith("array") else F.col(n)
    own = [stamp(n, t) for n, t in _names(ddl)]
    body = F.struct(F.lit(kind).alias(tag), F.struct(*own).alias("data")) if nested else F.struct(F.lit(kind).alias(tag), *own)
    return df.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))


def read_stamp(text: Column) -> Column:
    """A time from either spelling: with seconds, or (older writers) minutes and microseconds only."""
    bare = F.regexp_replace(text, "Z$", "")
    full = F.try_to_timestamp(bare)
    old = F.try_to_timestamp(F.regexp_replace(bare, r"^(\d{4}-\d\d-\d\dT\d\d:\d\d):(\d{6})$", "$1:00.$2"))
    return F.when(bare.rlike(r"T\d\d:\d\d:\d{6}$"), old).otherwise(full)


def _parsed(lines: DataFrame, kind: str, ddl: str) -> DataFrame:
    raw = ", ".join(f"{n} {'string' if t == 'timestamp' or t.startswith('array') else t}" for n, t in _names(ddl))
    likely = F.col("value").contains(f'"{kind}"') | F.col("value").contains("\\u")  # spares the other lines the parser
    rows = lines.where(likely & (F.get_json_object("value", "$.record_type") == kind)).select("seq", F.from_json("value", raw).alias("r"))
    pick = lambda n, t: (read_stamp(F.col(f"r.{n}")) if t == "timestamp" else F.coalesce(F.from_json(F.col(f"r.{n}"), t), F.array().cast(t)) if t.startswith("array") else F.col(f"r.{n}")).alias(n)
    return rows.select(*(pick(n, t) for n, t in _names(ddl)), "seq")


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """value, seq of every line; seq orders them by file, block, and place in the block, whatever order the files are read in."""
    at = F.concat_ws("\x01", F.col("_metadata.file_path"), F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0"), F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))
    return spark.read.text(paths).select("value", at.alias("seq"))


def digest(header: dict, lines: DataFrame) -> str:
    """SHA-256 over the header and the sum, modulo 2**128, of the MD5 sums of all lines."""
    half = lambda at: F.sum(F.conv(F.substring(F.md5("value"), at, 15), 16, 10).cast("decimal(38,0)"))
    low = lines.agg(F.count("*").alias("n"), half(1).alias("a"), half(16).alias("b")).first()
    return hashlib.sha256(f"{json.dumps(header, sort_keys=True)}|{low.n}|{low.a or 0}|{low.b or 0}".encode()).hexdigest()


#: Folders of more lines are compressed; their part files say so by their names.
PLAIN = 1_000_000


def _codec(lines: int) -> str:
    return "gzip" if lines > PLAIN else "none"


def export_snapshot(g: Graph, path: str, exported_at: datetime, schema_version: int) -> dict:
    """Writes a snapshot folder; returns its manifest row."""
    spark = g.entities.sparkSession
    parts = [
        _record(g.entities.orderBy("created_at", "name"), "entity", ENTITY),
        _record(g.relationships.orderBy("created_at", "source_name", "target_name", "rel_type"), "relationship", EDGE),
        _record(g.memory_ids.orderBy("entity_id", "memory_id"), "memory_id", MEMORY),
    ]
    with small_tasks(spark):
        for i, (p, n) in enumerate(zip(parts, [g.entities.count(), g.relationships.count(), g.memory_ids.count()], strict=True)):
            p.write.mode("overwrite").text(f"{path}/part={i + 1}", compression=_codec(n))
    counts = [spark.read.text(f"{path}/part={i + 1}").count() for i in range(3)]
    header = {"type": "graph_snapshot", "schema_version": schema_version, "exported_at": exported_at.isoformat(), "entity_count": counts[0], "relationship_count": counts[1], "memory_id_count": counts[2]}
    body = spark.read.option("basePath", path).text([f"{path}/part={i}" for i in (1, 2, 3)])
    header["checksum"] = digest(header, body)
    spark.createDataFrame([(json.dumps(header),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/part=0")
    at = hashlib.md5(f"{path}{exported_at}".encode()).hexdigest()[:16]
    return {"snapshot_id": at, "created_at": exported_at, "schema_version": schema_version, "entity_count": counts[0], "relationship_count": counts[1], "db_checksum": header["checksum"], "backup_path": path, "integrity_status": "ok"}


def export_file(g: Graph, path: str, exported_at: datetime, schema_version: int, most: int | None = None) -> dict:
    """Writes a snapshot as one file, which other tools read too; returns its header.

    The cluster sorts and writes the lines, and the driver's JVM copies them behind the header, so that its
    memory holds a buffer only.  ``most``: more records than that are refused.
    """
    spark = g.entities.sparkSession
    parts = [
        _record(g.entities.orderBy("created_at", "name"), "entity", ENTITY),
        _record(g.relationships.orderBy("created_at", "source_name", "target_name", "rel_type"), "relationship", EDGE),
        _record(g.memory_ids.orderBy("entity_id", "memory_id"), "memory_id", MEMORY),
    ]
    root = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    folders = [f"{root}/{i}" for i in range(3)]
    fs, at = _file_system(spark, root)
    try:
        with small_tasks(spark):
            for p, folder in zip(parts, folders, strict=True):
                p.write.text(folder)
        counts = [spark.read.text(folder).count() for folder in folders]
        if most is not None and sum(counts) > most:
            raise ValueError(f"{sum(counts)} records: too many for one file")
        header = {"type": "graph_snapshot", "schema_version": schema_version, "exported_at": exported_at.isoformat(), "entity_count": counts[0], "relationship_count": counts[1], "memory_id_count": counts[2]}
        header["checksum"] = _digested(spark, (json.dumps(header) + "\n").encode(), lambda out: [_copy(spark, folder, out) for folder in folders])
        to, file = _file_system(spark, path)
        out = to.create(file, True)
        try:
            out.write(bytearray((json.dumps(header) + "\n").encode()))
            for folder in folders:
                _copy(spark, folder, out)
        finally:
            out.close()
    finally:
        fs.delete(at, True)
    return header


def _file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path as an object of the JVM."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()), at


def _copy(spark: SparkSession, folder: str, out) -> None:
    """The bytes of a folder's part files, in order, to a stream of the JVM."""
    fs, at = _file_system(spark, folder)
    files = {f.getPath().getName(): f.getPath() for f in fs.listStatus(at)}
    for name in sorted(n for n in files if n.startswith("part-")):
        source = fs.open(files[name])
        try:
            spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16)
        finally:
            source.close()


def _digested(spark: SparkSession, head: bytes, copy: Callable) -> str:
    """SHA-256 of ``head`` and of what ``copy`` writes to the stream that it is given."""
    jvm = spark.sparkContext._jvm
    sha = jvm.java.security.MessageDigest.getInstance("SHA-256")
    sha.update(bytearray(head))
    copy(jvm.java.security.DigestOutputStream(jvm.java.io.OutputStream.nullOutputStream(), sha))
    return bytes(sha.digest()).hex()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file of that text, on any file system."""
    fs, at = _file_system(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def verified(spark: SparkSession, path: str) -> bool:
    """Whether the snapshot's checksum is right; one without a checksum is taken as it is."""
    head = spark.read.text(f"{path}/part=0").first()
    header = json.loads(head.value)
    claimed = header.pop("checksum", None)
    if claimed is None:
        return True
    return claimed == digest(header, spark.read.option("basePath", path).text([f"{path}/part={i}" for i in (1, 2, 3)]))


def bytes_verified(content: str) -> bool:
    """The same for a one-file snapshot, whose checksum is over its text with the header lacking that key."""
    first, _, rest = content.partition("\n")
    header = json.loads(first)
    claimed = header.pop("checksum", None)
    return claimed is None or hashlib.sha256((json.dumps(header) + "\n" + rest).encode()).hexdigest() == claimed


def file_verified(spark: SparkSession, path: str) -> bool:
    """``bytes_verified`` of a file, which is streamed."""
    jvm = spark.sparkContext._jvm
    fs, at = _file_system(spark, path)
    source = fs.open(at)
    try:
        first = jvm.org.apache.hadoop.io.Text()
        header_bytes = jvm.org.apache.hadoop.util.LineReader(source, 1 << 16, bytearray(b"\n")).readLine(first)
        header = json.loads(first.toString())
        claimed = header.pop("checksum", None)
        if claimed is None:
            return True
        source.seek(header_bytes)
        return claimed == _digested(spark, (json.dumps(header) + "\n").encode(), lambda out: jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16))
    finally:
        source.close()


def import_snapshot(g: Graph, path: str, mode: str = "merge") -> Graph:
    """The graph after an import: later rows evict earlier ones by name or id; mode 'replace' starts from nothing.

    ``path``: a snapshot folder, or a one-file snapshot (``*.jsonl``) as a single machine writes it.
    """
    spark = g.entities.sparkSession
    if path.endswith(".jsonl"):
        whole, parts = file_verified(spark, path), path
    else:
        whole, parts = verified(spark, path), [f"{path}/part={i}" for i in (1, 2, 3)]
    if not whole:
        raise ValueError(f"checksum mismatch in {path}")
    lines = _lines(spark, parts)
    if mode == "replace":
        g = Graph(*(df.limit(0) for df in (g.entities, g.relationships, g.memory_ids)))
    e, r, m = (_parsed(lines, k, ddl) for k, ddl in _KINDS.items())
    return Graph(merge.import_last_wins(g.entities, e), merge.import_edges_last_wins(g.relationships, r), merge.link_memory(g.memory_ids, m.drop("seq")))


def export_sync(g: Graph, folder: str, agent: str, exported_at: datetime) -> str:
    """Entities and edges for other agents, as ``<agent>_graph.jsonl``."""
    spark = g.entities.sparkSession
    if not re.fullmatch(r"[\w.-]+", agent):
        raise ValueError(f"not an agent name: {agent}")
    path = f"{folder}/{agent}_graph.jsonl"
    e, r = _record(g.entities, "entity", ENTITY), _record(g.relationships, "relationship", EDGE)
    header = {"type": "graph_sync_export", "agent": agent, "exported_at": exported_at.isoformat(), "entity_count": g.entities.count(), "relationship_count": g.relationships.count()}
    head = spark.createDataFrame([(json.dumps(header),)], "value string")
    with small_tasks(spark):
        head.coalesce(1).unionByName(e).unionByName(r).write.mode("overwrite").text(path, compression=_codec(header["entity_count"] + header["relationship_count"]))
    return path


def merge_shared(g: Graph, path: str, seen_at: datetime) -> tuple[Graph, DataFrame]:
    """The graph after another agent's file: what is there already stays. Also: lines by record type."""
    lines = _lines(g.entities.sparkSession, path)
    at = F.lit(seen_at)
    e = _parsed(lines, "entity", ENTITY).where("name IS NOT NULL")
    e = e.withColumns({"type": F.coalesce("type", F.lit("concept")), "domain": F.coalesce("domain", F.lit("general")), "confidence": F.coalesce("confidence", F.lit(0.5)), "mention_count": F.coalesce("mention_count", F.lit(1)), "first_seen": F.coalesce("first_seen", at), "last_seen": F.coalesce("last_seen", at), "created_at": F.coalesce("created_at", at)})
    r = _parsed(lines, "relationship", EDGE).where("source_name IS NOT NULL AND target_name IS NOT NULL AND rel_type IS NOT NULL")
    counts = lines.groupBy(F.get_json_object("value", "$.record_type").alias("record_type")).agg(F.count("*").alias("n")).where("record_type IS NOT NULL")
    return g.with_(entities=merge.sync_first_wins(g.entities, e), relationships=merge.sync_edges_first_wins(g.relationships, r)), counts


def sync_status(spark: SparkSession, folder: str) -> DataFrame:
    """file, bytes, modified of every sync file; one of several parts counts as a whole."""
    parts = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")
    name = F.regexp_extract("path", r"([^/]+\.jsonl)(?:/[^/]*)?$", 1)
    return parts.withColumn("file", name).where("file <> ''").groupBy("file").agg(F.sum("length").alias("bytes"), F.max("modificationTime").alias("modified"))


def export_backfill(g: Graph, path: str) -> None:
    """The backfill's own format: type and data, no header."""
    e, r = _record(g.entities, "entity", ENTITY, "type", True), _record(g.relationships, "relationship", EDGE, "type", True)
    e.unionByName(r).write.mode("overwrite").text(path)
