"""Maintenance passes over a graph: decay, dedup, prune, infer, strengthen; each takes a state and returns the next."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import names
from weft.operators.components import shared_table
from weft.operators.graph import Graph, top_by

DECAY, AGE, FLOOR, SCHEDULER_FLOOR = 0.95, timedelta(days=7), 0.15, 0.1
ALIASES = 20
INFERRED = 0.3
STEP, MOST, TOGETHER = 0.05, 0.2, 3


def _stale(as_of: datetime, age: timedelta, floor: float) -> Column:
    return (F.col("last_seen") < F.lit(as_of - age)) & (F.col("confidence") > floor)


def decay(entities: DataFrame, as_of: datetime, factor: float = DECAY, age: timedelta = AGE, floor: float = FLOOR, least: float | None = None) -> DataFrame:
    """Entities not seen for ``age``, of more than ``floor`` confidence, lose some, down to ``least`` (``floor``)."""
    lower = F.greatest(F.lit(floor if least is None else least), F.col("confidence") * factor)
    return entities.withColumn("confidence", F.when(_stale(as_of, age, floor), lower).otherwise(F.col("confidence")))


def scheduled_decay(entities: DataFrame, as_of: datetime, factor: float = DECAY, age: timedelta = AGE) -> DataFrame:
    """The interval-driven form, whose floor is lower."""
    return decay(entities, as_of, factor, age, SCHEDULER_FLOOR)


def decay_due(last_run: datetime | None, now: datetime, interval: timedelta = timedelta(hours=6)) -> bool:
    return last_run is None or now - last_run >= interval


def decay_ids(entities: DataFrame, ids: DataFrame, factor: float) -> DataFrame:
    """The entities in ``ids`` (entity_id) decay; a factor outside (0, 1] changes nothing."""
    if not 0 < factor <= 1:
        return entities
    hit = ids.select("entity_id").distinct().withColumn("__hit", F.lit(True))
    low = F.greatest(F.lit(SCHEDULER_FLOOR), F.col("confidence") * factor)
    return entities.join(hit, "entity_id", "left").withColumn("confidence", F.when(F.col("__hit"), low).otherwise(F.col("confidence"))).select(entities.columns)


def duplicates(entities: DataFrame) -> DataFrame:
    """name, primary: of each canonical form the longest name (ties: the smaller id) is the primary; the others are its duplicates."""
    form = F.when(F.coalesce("canonical_name", F.lit("")) == "", names.canonical(F.col("name"))).otherwise(F.col("canonical_name"))
    e = entities.select("entity_id", "name", form.alias("form")).where("form <> ''")
    best = e.groupBy("form").agg(F.min_by("name", F.struct(-F.length("name"), F.col("entity_id"))).alias("primary"), F.count("*").alias("n")).where("n > 1")
    return e.join(best, "form").where("name <> primary").select("name", "primary")


def repoint(edges: DataFrame, moved: DataFrame) -> DataFrame:
    """Edges with both endpoints mapped through ``moved`` (name, primary); of edges that become one, the most certain stays."""
    a = moved.select(F.col("name").alias("__a"), F.col("primary").alias("__pa"))
    b = moved.select(F.col("name").alias("__b"), F.col("primary").alias("__pb"))
    to = edges.join(a, edges["source_name"] == a["__a"], "left").join(b, F.col("target_name") == b["__b"], "left")
    new = to.select(F.coalesce("__pa", "source_name").alias("source_name"), F.coalesce("__pb", "target_name").alias("target_name"), "rel_type", "confidence", "source_doc", "created_at", (F.col("__pa").isNotNull() | F.col("__pb").isNotNull()).alias("__moved"))
    first = F.min_by(F.struct("source_doc", "created_at"), F.struct("__moved", "created_at", "source_doc")).alias("f")
    return new.groupBy("source_name", "target_name", "rel_type").agg(F.max("confidence").alias("confidence"), first).select("source_name", "target_name", "rel_type", "confidence", "f.source_doc", "f.created_at")


def absorb(g: Graph, moved: DataFrame, cap: int | None = ALIASES, most_certain: bool = True) -> Graph:
    """Duplicates (name, primary) end in their primaries: mentions add up, names become aliases, memory ids of duplicates go."""
    moved = shared_table(moved)
    e = g.entities
    gone = e.join(moved, "name").select("primary", F.col("name").alias("__n"), F.col("mention_count").alias("__m"), F.col("confidence").alias("__c"), F.col("entity_id").alias("__i"))
    sums = gone.groupBy("primary").agg(F.sum("__m").alias("__m"), F.max("__c").alias("__c"), F.collect_set("__n").alias("__names"))
    kept = e.join(moved.select("name"), "name", "left_anti")
    joined = kept.join(sums, kept["name"] == sums["primary"], "left")
    aliases = F.array_sort(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), "__names"))
    new = {
        "mention_count": F.col("mention_count") + F.coalesce("__m", F.lit(0)),
        "confidence": F.greatest("confidence", "__c") if most_certain else F.col("confidence"),
        "aliases": F.when(F.col("__names").isNull(), F.col("aliases")).otherwise(F.slice(aliases, 1, cap) if cap else aliases),
    }
    out = joined.select(*(new[c].alias(c) if c in new else F.col(c) for c in e.columns))
    return Graph(out, shared_table(repoint(g.relationships, moved)), g.memory_ids.join(gone.select(F.col("__i").alias("entity_id")), "entity_id", "left_anti"))


def dedup(g: Graph, edge_mode: str = "pairwise") -> Graph:
    """Merges entities of one canonical form.

    ``edge_mode``: 'pairwise' re-points every edge; 'reference' first drops the duplicate's edges whose
    other end *and*, looked at separately, whose type the primary has in that direction too, and self
    loops of duplicates, as a store that cleans up before it re-points does.
    """
    moved = duplicates(g.entities)
    if edge_mode == "reference":
        moved = shared_table(moved)
        g = g.with_(relationships=_cross_dropped(g.relationships, moved))
    return absorb(g, moved)


def _cross_dropped(edges: DataFrame, moved: DataFrame) -> DataFrame:
    m = moved.select(F.col("name").alias("__dup"), F.col("primary").alias("__primary"))
    primary = m.select("__primary").distinct()
    for near, far in (("source_name", "target_name"), ("target_name", "source_name")):
        columns = edges.columns
        own = edges.join(primary, edges[near] == primary["__primary"])
        ends = own.select(F.col("__primary").alias("__key"), F.col(far).alias("__far")).distinct().withColumn("__end", F.lit(True))
        kinds = own.groupBy("__primary").agg(F.collect_set("rel_type").alias("__kinds"))
        tagged = edges.join(m.join(kinds, "__primary"), edges[near] == F.col("__dup"), "left").withColumn("__like", F.coalesce(F.array_contains("__kinds", F.col("rel_type")), F.lit(False)))
        # Edges that stay whatever the primary's ends are have keys of their own: nulls would meet in one task.
        keyed = tagged.withColumns({"__key": F.when(F.col("__like"), F.col("__primary")).otherwise(F.concat(F.lit("\x01"), near)), "__far": F.col(far)})
        edges = shared_table(keyed.join(ends, ["__key", "__far"], "left").where("NOT __like OR __end IS NULL").select(columns))
    return edges.join(m, (edges["source_name"] == m["__dup"]) & (edges["target_name"] == m["__dup"]), "left_anti")


def connected(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges both of whose ends are entities."""
    known = entities.select(F.col("name").alias("__name"))
    return edges.join(known, edges["source_name"] == known["__name"], "left_semi").join(known, F.col("target_name") == F.col("__name"), "left_semi")


def prune(g: Graph, floor: float = FLOOR) -> Graph:
    """Without entities of little confidence that were mentioned once, orphan edges and memory ids."""
    kept = g.entities.where(~((F.col("confidence") < floor) & (F.col("mention_count") <= 1)))
    return Graph(kept, connected(g.relationships, kept), g.memory_ids.join(kept.select("entity_id"), "entity_id", "left_semi"))


def inferred(edges: DataFrame, types: tuple[str, ...] = names.TRANSITIVE) -> DataFrame:
    """source_name, target_name, rel_type, n_paths: edges that two edges of one transitive type imply and that aren't there."""
    t = edges.where(F.col("rel_type").isin(*types)).select("source_name", "target_name", "rel_type")
    r1 = t.select(F.col("source_name").alias("source"), F.col("target_name").alias("mid"), "rel_type")
    r2 = t.select(F.col("source_name").alias("mid"), F.col("target_name").alias("target"), "rel_type")
    two = r1.join(r2, ["rel_type", "mid"]).where("source <> target")
    new = two.groupBy(F.col("source").alias("source_name"), F.col("target").alias("target_name"), "rel_type").agg(F.count("*").alias("n_paths"))
    return new.join(t, ["source_name", "target_name", "rel_type"], "left_anti")


def infer(g: Graph, as_of: datetime) -> Graph:
    """One round of transitive closure."""
    new = inferred(g.relationships).select("source_name", "target_name", "rel_type", F.lit(INFERRED).alias("confidence"), F.lit("inferred").alias("source_doc"), F.lit(as_of).alias("created_at"))
    return g.with_(relationships=g.relationships.unionByName(new))


def closure(g: Graph, as_of: datetime, rounds: int = 32) -> Graph:
    """``infer`` until no edge is new; each round is a table in the shared folder."""
    for _ in range(rounds):
        nxt = shared_table(infer(g, as_of).relationships)
        if nxt.count() == g.relationships.count():
            break
        g = g.with_(relationships=nxt)
    return g


def boosts_by_session(entities: DataFrame, threshold: int = TOGETHER) -> DataFrame:
    """entity_id, boost from entities that share a session_id.

    An entity has one session, so a pair is together once: below a threshold of 2 everyone gains one
    step for each other member, which counts give without forming pairs; above it nobody gains.
    """
    e = entities.where("session_id IS NOT NULL").select("entity_id", "session_id")
    sizes = e.groupBy("session_id").agg(F.count("*").alias("n"))
    step = min(STEP, MOST) if threshold <= 1 else 0.0
    return e.join(sizes, "session_id").where(F.lit(threshold <= 1)).select("entity_id", ((F.col("n") - 1) * step).alias("boost"))


def together(mentions: DataFrame, threshold: int = TOGETHER) -> DataFrame:
    """a, b, n_sessions: pairs mentioned in at least ``threshold`` sessions; mentions (entity, session).

    Entities of fewer sessions can't be in such a pair; they go before pairs are formed.
    """
    m = mentions.select("entity", "session").where("entity IS NOT NULL AND session IS NOT NULL").distinct()
    often = m.groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") >= threshold).select("entity")
    m = m.join(often, "entity")
    a, b = m.select(F.col("entity").alias("a"), "session"), m.select(F.col("entity").alias("b"), "session")
    return a.join(b, "session").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_sessions")).where(F.col("n_sessions") >= threshold)


def boosts_by_mentions(mentions: DataFrame, threshold: int = TOGETHER) -> DataFrame:
    """entity_id, boost: over all its pairs, one step a shared session, at most ``MOST`` a pair."""
    pairs = together(mentions, threshold).withColumn("boost", F.least(F.lit(MOST), STEP * F.col("n_sessions")))
    return pairs.select(F.explode(F.array("a", "b")).alias("entity_id"), "boost").groupBy("entity_id").agg(F.sum("boost").alias("boost"))


def strengthen(entities: DataFrame, boosts: DataFrame) -> DataFrame:
    up = F.least(F.lit(1.0), F.col("confidence") + F.coalesce("boost", F.lit(0.0)))
    return entities.join(boosts, "entity_id", "left").withColumn("confidence", up).select(entities.columns)


def link(g: Graph) -> Graph:
    """Linking to an external memory is a hook without a body."""
    return g


def checkpoint(g: Graph) -> Graph:
    """All tables written to the shared folder and read back: lineage ends there."""
    return Graph(shared_table(g.entities), shared_table(g.relationships), shared_table(g.memory_ids))


def cycle(g: Graph, as_of: datetime, enabled: dict[str, bool] | None = None, mentions: DataFrame | None = None, threshold: int = TOGETHER) -> tuple[Graph, list[tuple[str, str]]]:
    """All passes in order. A pass that fails is recorded, and the next runs on the state before it."""
    on = {"link": False} | (enabled or {})
    passes: list[tuple[str, Callable[[Graph], Graph]]] = [
        ("decay", lambda s: s.with_(entities=decay(s.entities, as_of))),
        ("dedup", dedup),
        ("prune", prune),
        ("infer", lambda s: infer(s, as_of)),
        ("strengthen", lambda s: s.with_(entities=strengthen(s.entities, boosts_by_session(s.entities, threshold) if mentions is None else boosts_by_mentions(mentions, threshold)))),
        ("link", link),
        ("checkpoint", lambda s: s),
    ]
    report = []
    for name, step in passes:
        if not on.get(name, True):
            report.append((name, "skipped"))
            continue
        try:
            g = checkpoint(step(g))
            report.append((name, "done"))
        except Exception as e:  # noqa: BLE001  what a pass raises is its report
            report.append((name, f"error: {str(e)[:200]}"))
    return g, report
