"""Health of a graph: orphans, invalid entities, integrity, and the cleanup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions import names
from weft.operators.dream import connected
from weft.operators.graph import Graph


def orphans(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges of which an end is no entity; ``no_source`` and ``no_target`` say which."""
    known = entities.select("name").distinct()
    s = known.select(F.col("name").alias("source_name"), F.lit(True).alias("__s"))
    t = known.select(F.col("name").alias("target_name"), F.lit(True).alias("__t"))
    marked = edges.join(s, "source_name", "left").join(t, "target_name", "left")
    out = marked.withColumns({"no_source": F.col("__s").isNull(), "no_target": F.col("__t").isNull()}).where("no_source OR no_target")
    return out.select(*edges.columns, "no_source", "no_target")


def invalid(entities: DataFrame, least: int = names.MIN_NAME) -> DataFrame:
    return entities.where(F.length("name") < least)


def integrity(g: Graph) -> DataFrame:
    """One row: keys that repeat and required values that are missing."""
    twice = lambda df, keys: df.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("n"))
    missing = g.entities.agg(F.count_if(F.expr("entity_id IS NULL OR name IS NULL OR type IS NULL OR domain IS NULL")).alias("missing"))
    parts = [
        twice(g.entities, ["entity_id"]).withColumnRenamed("n", "repeated_ids"),
        twice(g.entities, ["name"]).withColumnRenamed("n", "repeated_names"),
        twice(g.relationships, ["source_name", "target_name", "rel_type"]).withColumnRenamed("n", "repeated_edges"),
        missing,
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # of one row each
    return out


def check(g: Graph) -> DataFrame:
    """One row: status (healthy, degraded, corrupt) and the counts behind it."""
    counts = g.entities.agg(F.count("*").alias("entities"), F.count_if(F.length("name") < names.MIN_NAME).alias("invalid_entities"))
    edges = g.relationships.agg(F.count("*").alias("relationships"))
    lost = orphans(g.relationships, g.entities).agg(F.count("*").alias("orphans"))
    whole = counts.crossJoin(edges).crossJoin(lost).crossJoin(integrity(g))  # of one row each
    bad = F.expr("repeated_ids + repeated_names + repeated_edges + missing > 0")
    return whole.withColumn("status", F.when(bad, "corrupt").when(F.expr("orphans + invalid_entities > 0"), "degraded").otherwise("healthy"))


def cleaned(g: Graph) -> Graph:
    """Without invalid entities, orphan edges and memory ids of no entity; missing canonical names are filled in."""
    e = g.entities.where(F.length("name") >= names.MIN_NAME)
    e = e.withColumn("canonical_name", F.coalesce("canonical_name", names.canonical(F.col("name")))).select(g.entities.columns)
    return Graph(e, connected(g.relationships, e), g.memory_ids.join(e.select("entity_id"), "entity_id", "left_semi"))


def check_and_clean(g: Graph) -> tuple[Graph, list[str]]:
    """A degraded graph is cleaned and checked again; returns it and the statuses seen."""
    seen = [check(g).first().status]
    if seen[0] == "degraded":
        g = cleaned(g)
        seen.append(check(g).first().status)
    return g, seen
