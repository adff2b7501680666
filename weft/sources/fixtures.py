"""Graph-shaped views over the star-schema tables of a directory."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import names
from weft.operators import search
from weft.operators.components import FILE_ROWS, shared_folder, small_tasks
from weft.operators.graph import Graph

#: The views as SQL that any engine runs; ``{t}`` stands for a table's name.
ENTITIES_SQL = """
SELECT r_name AS name, 'location' AS type, 'general' AS domain, CAST(0.9 AS DOUBLE) AS confidence, CAST(5 AS BIGINT) AS mention_count, 'region' AS description, CAST(NULL AS {string}) AS session_id FROM {region}
UNION ALL SELECT n_name, 'location', 'general', CAST(0.8 AS DOUBLE), CAST(1 + n_nationkey % 7 AS BIGINT), 'nation', concat('r', CAST(n_regionkey AS {string})) FROM {nation}
UNION ALL SELECT p_name, 'technology', 'platform', CAST(10 + CAST(sum(p_size) AS BIGINT) % 90 AS DOUBLE) / CAST(100 AS DOUBLE), count(*), concat(min(p_type), ' ', min(p_brand)), min(p_brand) FROM {part} GROUP BY p_name
UNION ALL SELECT s_name, 'organization', 'work', CAST(10 + s_suppkey % 90 AS DOUBLE) / CAST(100 AS DOUBLE), CAST(1 + s_suppkey % 3 AS BIGINT), 'supplier', concat('n', CAST(s_nationkey AS {string})) FROM {supplier}
UNION ALL SELECT c_name, 'person', 'personal', CAST(10 + c_custkey % 90 AS DOUBLE) / CAST(100 AS DOUBLE), CAST(1 + c_custkey % 3 AS BIGINT), c_mktsegment, concat('n', CAST(c_nationkey AS {string})) FROM {customer}
"""

EDGES_SQL = """
SELECT n_name AS source_name, r_name AS target_name, 'part_of' AS rel_type, CAST(0.9 AS DOUBLE) AS confidence FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT s_name, n_name, 'part_of', CAST(0.7 AS DOUBLE) FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
UNION ALL SELECT c_name, n_name, 'part_of', CAST(0.6 AS DOUBLE) FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
UNION ALL SELECT s_name, p_name, 'uses', least(CAST(1 AS DOUBLE), CAST(count(*) AS DOUBLE) / CAST(20 AS DOUBLE)) FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {part} ON l_partkey = p_partkey GROUP BY s_name, p_name
UNION ALL SELECT c_name, p_name, 'owns', least(CAST(1 AS DOUBLE), CAST(count(*) AS DOUBLE) / CAST(10 AS DOUBLE)) FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {part} ON l_partkey = p_partkey GROUP BY c_name, p_name
"""

ACTIVITY_SQL = """
SELECT concat('user ', CAST(user_id AS {string}), ' ', event_type) AS name, 'concept' AS type, 'general' AS domain, CAST(10 + (count(*) * 7) % 90 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence, count(*) AS mention_count, min(ts) AS first_seen, max(ts) AS last_seen FROM {events} GROUP BY user_id, event_type
"""

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
FOUNDED = "2024-01-01 00:00:00"


def _spelled(sql: str, names_: dict[str, str]) -> str:
    for table, spelling in names_.items():
        sql = sql.replace(f"{{{table}}}", spelling)
    return sql


def duck(sql: str) -> str:
    """A view's SQL over tables of the plain names."""
    return _spelled(sql, {t: t for t in _TABLES} | {"string": "VARCHAR"})


def _view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(_spelled(sql, {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in _TABLES} | {"string": "STRING"}))


_built: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The view as a table in the shared folder, written once by application and directory: a graph is stored, not joined together by each reader."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _built:
        path = f"{shared_folder(spark)}/view-{uuid.uuid4().hex}"
        with small_tasks(spark):
            make().write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)
        _built[key] = path
    return spark.read.parquet(_built[key])


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity view with every column of the entity schema; ``created_at`` and the like are a fixed time."""
    at = F.lit(FOUNDED).cast("timestamp")

    def make() -> DataFrame:
        return _view(spark, sf_dir, ENTITIES_SQL).select(
            names.entity_id(F.col("name")).alias("entity_id"), "name", "type", "domain", "confidence", "mention_count", at.alias("first_seen"), at.alias("last_seen"), "description",
            F.array().cast("array<string>").alias("aliases"), "session_id", at.alias("created_at"), names.canonical(F.col("name")).alias("canonical_name"),
        )

    return _once(spark, sf_dir, "entities", make)


def index(spark: SparkSession, sf_dir: str) -> search.Index:
    """The search index of the entity view, made once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        with small_tasks(spark):
            _indexes[key] = search.index(entities(spark, sf_dir))
    return _indexes[key]


_indexes: dict[tuple[str, str], search.Index] = {}


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "relationships", lambda: _view(spark, sf_dir, EDGES_SQL).select("source_name", "target_name", "rel_type", "confidence", F.lit("fixture").alias("source_doc"), F.lit(FOUNDED).cast("timestamp").alias("created_at")))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, ACTIVITY_SQL)


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, name: capitalised words of four letters or more in the conversations."""
    words = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.explode(F.split("text", "[^A-Za-z]+")).alias("name"))
    return words.where(F.col("name").rlike("^[A-Z][a-z]{3,}$"))


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Entities, edges, and one memory id for each entity."""
    e = entities(spark, sf_dir)
    return Graph(e, relationships(spark, sf_dir), e.select("entity_id", F.concat(F.lit("m"), F.substring("entity_id", 1, 8)).alias("memory_id")))
