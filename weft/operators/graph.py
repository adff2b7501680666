"""The graph as DataFrames: schemas, scans, look-ups, neighbourhoods, top-k and statistics."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.operators import components
from weft.operators.components import shared_table

ENTITY = "entity_id string, name string, type string, domain string, confidence double, mention_count long, first_seen timestamp, last_seen timestamp, description string, aliases array<string>, session_id string, created_at timestamp, canonical_name string"
EDGE = "source_name string, target_name string, rel_type string, confidence double, source_doc string, created_at timestamp"
MEMORY = "entity_id string, memory_id string"
SESSION = "session_id string, last_extracted_msg_index long, last_extraction_at timestamp, total_extractions long"
MANIFEST = "snapshot_id string, created_at timestamp, schema_version long, entity_count long, relationship_count long, db_checksum string, backup_path string, integrity_status string"
CHECKPOINT = "source string, file_path string, status string, entities_extracted long, entities_rejected long, relationships_extracted long, error_message string, processed_at timestamp"
MIGRATIONS = "version long, applied_at timestamp, checksum string, description string, rollback_sql string"
POSTINGS = "term string, entity_id string, tf long, length int"
CORPUS = "n long, mean double"
EMBEDDING = "entity_id string, embedding array<float>, model_name string, computed_at timestamp"

TABLES = {
    "entities": ENTITY,
    "relationships": EDGE,
    "memory_ids": MEMORY,
    "session_state": SESSION,
    "manifest": MANIFEST,
    "checkpoint": CHECKPOINT,
    "schema_meta": MIGRATIONS,
    "embeddings": EMBEDDING,
    "postings": POSTINGS,
    "corpus": CORPUS,
}


@dataclass(frozen=True)
class Graph:
    """One state of the graph. Operators take one and return another; nothing is changed in place."""

    entities: DataFrame
    relationships: DataFrame
    memory_ids: DataFrame

    def with_(self, **tables: DataFrame) -> Graph:
        return replace(self, **tables)


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def top_by(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group, with their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def all_entities(entities: DataFrame, limit: int = 10_000) -> DataFrame:
    return entities.orderBy("created_at", "name").limit(limit)


def all_relationships(edges: DataFrame, limit: int = 500) -> DataFrame:
    return edges.orderBy(F.desc("created_at"), "source_name", "target_name", "rel_type").limit(limit)


def entity_by_name(entities: DataFrame, name: str) -> DataFrame:
    return entities.where(F.col("name") == name)


def entity_by_id(entities: DataFrame, entity_id: str) -> DataFrame:
    return entities.where(F.col("entity_id") == entity_id)


def memory_ids_of(memory_ids: DataFrame, entity_id: str) -> DataFrame:
    return memory_ids.where(F.col("entity_id") == entity_id).select("memory_id")


def session_state_of(states: DataFrame, session_id: str) -> DataFrame:
    return states.where(F.col("session_id") == session_id)


def top_entities(entities: DataFrame, limit: int = 10, floor: float = 0.3) -> DataFrame:
    """By confidence times mentions, among those of at least ``floor`` confidence."""
    score = F.round(F.col("confidence") * F.col("mention_count"), 9)
    return entities.where(F.col("confidence") >= floor).withColumn("score", score).orderBy(F.desc("score"), "name").limit(limit)


def relationships_of(edges: DataFrame, name: str, limit: int = 20) -> DataFrame:
    """Edges that touch the name, the most certain first."""
    return edges.where((F.col("source_name") == name) | (F.col("target_name") == name)).orderBy(F.desc("confidence"), "source_name", "target_name", "rel_type").limit(limit)


#: So many names are told to every task.
FEW = 10_000


def neighbourhood(names: DataFrame, edges: DataFrame, per_entity: int, name_col: str = "name") -> DataFrame:
    """For every name its first ``per_entity`` edges, with ``other``, the endpoint that isn't the name.

    Edges are read once and listed under both ends (a self-loop once), for one equi-join instead of a join on either end.
    Where they are many, names of many edges are cut into slices, whose first edges decide, so that no task holds all of a name.
    """
    n = shared_table(names.select(F.col(name_col).alias("name")).distinct())
    ends = F.array(F.struct(F.col("source_name").alias("name"), F.col("target_name").alias("other")), F.struct(F.col("target_name").alias("name"), F.col("source_name").alias("other")))
    listed = edges.select("*", F.explode(F.array_distinct(ends)).alias("end")).select("end.name", *edges.columns, "end.other")
    order = [F.desc("confidence"), F.col("source_name"), F.col("target_name"), F.col("rel_type")]
    rows = 2 * edges.count()
    if rows <= components.TASK_ROWS:
        return top_by(n.join(listed, "name"), ["name"], order, per_entity, "edge_rank")
    few = n.limit(FEW + 1).count() <= FEW
    if few:
        listed = F.broadcast(n).join(listed, "name")
    slice_ = components.TASK_ROWS // 10
    large = shared_table(listed.groupBy("name").agg(F.count("*").alias("__rows")).where(F.col("__rows") > slice_))  # at most rows / slice_ names
    sliced = listed.join(F.broadcast(large), "name", "left").withColumn("__slice", F.coalesce(F.pmod(F.xxhash64("source_name", "target_name", "rel_type"), F.floor(F.col("__rows") / slice_) + 1), F.lit(0))).drop("__rows")
    first = shared_table(top_by(components.spread(sliced, rows, "name", "__slice"), ["name", "__slice"], order, per_entity, "edge_rank").drop("edge_rank", "__slice"))
    best = top_by(components.spread(first, first.count(), "name"), ["name"], order, per_entity, "edge_rank")
    return best if few else best.join(n, "name", "left_semi")


def by_count(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def stats(graph: Graph, schema_meta: DataFrame) -> DataFrame:
    """One row: counts, the two distributions as sorted arrays of (value, n), and the schema version."""
    e = graph.entities.groupBy("type", "domain").agg(F.count("*").alias("n"))

    def spread(column: str) -> DataFrame:
        g = e.groupBy(F.col(column).alias("value")).agg(F.sum("n").alias("n"))
        listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "value", "n")))
        return g.agg(F.transform(listed, lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))).alias(f"by_{column}"))

    version = schema_meta.agg(F.coalesce(F.max("version"), F.lit(0)).cast("long").alias("schema_version"))
    counts = e.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("entity_count"))
    edges = graph.relationships.agg(F.count("*").alias("relationship_count"))
    return counts.crossJoin(edges).crossJoin(spread("type")).crossJoin(spread("domain")).crossJoin(version)  # of one row each
