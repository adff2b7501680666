"""Documents and chat sessions from folders."""

from __future__ import annotations

import re
from datetime import datetime
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def _base(root: str) -> str:
    """The folder's path as a pattern, without scheme."""
    return re.escape(urlparse(root).path.rstrip("/"))


def _decoded(path: Column) -> Column:
    return F.url_decode(F.regexp_replace(path, r"\+", "%2B"))


def _found(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """path, modified, bytes; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select(_decoded(F.col("path")).alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def markdown_files(spark: SparkSession, root: str, limit: int = 0) -> DataFrame:
    """Every ``*.md`` below the folder, by path; the first ``limit`` of them if it is above 0."""
    out = _found(spark, root, "*.md").orderBy("path")
    return out.limit(limit) if limit > 0 else out


def chat_sessions(spark: SparkSession, root: str, cutoff: datetime | None = None, older: bool = False, limit: int = 0) -> DataFrame:
    """session, modified of each sub-folder with texts: the recent ones, latest first, or those before the cutoff, earliest first."""
    inside = F.regexp_extract("path", rf"{_base(root)}/([^/]+)/", 1)
    each = _found(spark, root, "*.txt").withColumn("session", inside).where("session <> '' AND session NOT LIKE '.%' AND session <> '_archive'")
    s = each.groupBy("session").agg(F.max("modified").alias("modified"))
    if cutoff is not None:
        s = s.where(F.col("modified") < F.lit(cutoff) if older else F.col("modified") >= F.lit(cutoff))
    s = s.orderBy(F.asc("modified") if older else F.desc("modified"), "session")
    return s.limit(limit) if limit > 0 else s


def session_texts(spark: SparkSession, root: str, most: int = 0) -> DataFrame:
    """session, text: messages/*.txt and then *.txt of each session, by number, the last ``most`` of each folder, joined by blank lines."""
    base = _base(root)
    number = r"coalesce(try_cast(regexp_extract(path, '([^/]+)\\.txt$', 1) AS BIGINT), 0)"
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root, wholetext=True).select(_decoded(F.col("_metadata.file_path")).alias("path"), F.regexp_replace("value", r"^(?U)\s+|\s+$", "").alias("text"))
    part = raw.withColumns({"session": F.regexp_extract("path", rf"{base}/([^/]+)/", 1), "below": F.regexp_extract("path", rf"{base}/[^/]+/(.*/)?[^/]+$", 1), "n": F.expr(number)}).where("session <> '' AND below IN ('', 'messages/') AND text <> ''")
    back = F.row_number().over(Window.partitionBy("session", "below").orderBy(F.desc("n"), F.desc("path")))
    kept = part.withColumn("back", back).where(F.col("back") <= most) if most > 0 else part
    order = F.sort_array(F.collect_list(F.struct((F.col("below") == "").alias("root"), "n", "path", "text")))
    return kept.groupBy("session").agg(order.alias("l")).select("session", F.array_join(F.expr("l.text"), "\n\n").alias("text"))


def file_texts(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """path, text of whole files; bytes that aren't UTF-8 are replaced."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True).select(_decoded(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("text"))
