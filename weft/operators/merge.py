"""Writes as merges: a batch of records and a table give the next table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions import names
from weft.operators.graph import Graph, top_by


def matching_form(form: Column, name: Column, mode: str) -> Column:
    """What names are matched by: their canonical form; a name without one is like itself only, but in ``loose`` mode like all such names."""
    return form if mode == "loose" else F.when(form == "", F.concat(F.lit("\x01"), name)).otherwise(form)


def before(incoming: DataFrame) -> Column:
    """A sequence value before all those of ``incoming``, which are numbers from 0 on or texts."""
    return F.lit("") if incoming.schema["seq"].dataType == T.StringType() else F.lit(-1).cast("long")


def upsert_entities(store: DataFrame, batch: DataFrame, mode: str = "strict") -> DataFrame:
    """Entities after a batch (name, type, domain, confidence, description, aliases, session_id, seen_at, seq) in order of seq.

    The row-by-row rule in closed form: a record goes to the entity of its exact name; failing that to
    one of its canonical form (of several the first name); failing that the first record of the form
    founds an entity.  A target gains one mention a record, the greatest confidence, the latest time, and
    the last description that isn't empty among records of exactly its name.  Other columns keep the
    founder's values.  A name whose form is '' matches its exact name only, unless ``mode`` is 'loose'.
    """
    held = store.withColumn("__canon", F.coalesce("canonical_name", names.canonical(F.col("name"), mode)))
    rows = batch.withColumn("__canon", names.canonical(F.col("name"), mode)).withColumn("__form", matching_form(F.col("__canon"), F.col("name"), mode))
    first = held.groupBy(matching_form(F.col("__canon"), F.col("name"), mode).alias("__form")).agg(F.min("name").alias("__by_canon"))
    known = held.select(F.col("name").alias("__known"))
    founder = rows.groupBy("__form").agg(F.min_by("name", F.struct("seq", "name")).alias("__first"))
    new = rows.join(known, rows["name"] == known["__known"], "left").join(first, "__form", "left").join(founder, "__form", "left")
    new = new.withColumn("__target", F.coalesce("__known", "__by_canon", "__first"))
    exact = (F.col("name") == F.col("__target")) & (F.coalesce("description", F.lit("")) != "")
    gained = new.groupBy("__target").agg(
        F.count("*").alias("__n"),
        F.max("confidence").alias("__confidence"),
        F.max("seen_at").alias("__last"),
        F.max_by(F.when(exact, F.col("description")), F.when(exact, F.col("seq"))).alias("__description"),
        F.min_by(F.struct("name", "type", "domain", "description", "aliases", "session_id", "seen_at", "__canon"), F.struct("seq", "name")).alias("__founder"),
    )
    joined = held.join(gained, held["name"] == gained["__target"], "full")
    had = F.col("name").isNotNull()
    founder = F.col("__founder")
    pick = lambda c, other: F.when(had, F.col(c)).otherwise(other).alias(c)
    return joined.select(
        pick("entity_id", names.entity_id(founder["name"])),
        pick("name", founder["name"]),
        pick("type", founder["type"]),
        pick("domain", founder["domain"]),
        F.greatest("confidence", "__confidence").alias("confidence"),
        (F.coalesce("mention_count", F.lit(0)) + F.coalesce("__n", F.lit(0))).cast("long").alias("mention_count"),
        pick("first_seen", founder["seen_at"]),
        F.greatest("last_seen", "__last").alias("last_seen"),
        F.coalesce("__description", F.when(had, F.col("description")).otherwise(founder["description"])).alias("description"),
        pick("aliases", founder["aliases"]),
        pick("session_id", founder["session_id"]),
        pick("created_at", founder["seen_at"]),
        F.when(had, F.col("__canon")).otherwise(founder["__canon"]).alias("canonical_name"),
    )


def upsert_relationships(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Edges after a batch (the edge columns and seq): greatest confidence; the first source_doc and created_at stay."""
    both = store.withColumn("seq", F.lit(-1).cast("long")).unionByName(batch)
    first = F.min_by(F.struct("source_doc", "created_at"), F.struct("seq", "created_at", "source_doc"))
    return both.groupBy("source_name", "target_name", "rel_type").agg(F.max("confidence").alias("confidence"), first.alias("f")).select("source_name", "target_name", "rel_type", "confidence", "f.source_doc", "f.created_at")


def register(store: DataFrame, batch: DataFrame, mode: str = "strict") -> DataFrame:
    """Normalises the batch's names, drops what may not enter the graph, and upserts the rest."""
    ok = names.normalize(batch, "name").where(names.acceptable(F.col("name"), F.col("confidence")))
    return upsert_entities(store, ok, mode)


def delete_entities(graph: Graph, gone: DataFrame) -> Graph:
    """Without the entities named in ``gone`` (name), their edges and their memory ids."""
    gone = gone.select(F.col("name").alias("__gone")).distinct()
    e, r = graph.entities, graph.relationships
    ids = e.join(gone, e["name"] == gone["__gone"], "left_semi").select(F.col("entity_id").alias("__id"))
    kept = r.join(gone, r["source_name"] == gone["__gone"], "left_anti").join(gone, F.col("target_name") == gone["__gone"], "left_anti")
    m = graph.memory_ids
    return Graph(e.join(gone, e["name"] == gone["__gone"], "left_anti"), kept, m.join(ids, m["entity_id"] == ids["__id"], "left_anti"))


def link_memory(links: DataFrame, new: DataFrame) -> DataFrame:
    return links.unionByName(new).dropDuplicates(["entity_id", "memory_id"])


def update_sessions(states: DataFrame, seen: DataFrame) -> DataFrame:
    """States after extractions (session_id, msg_index, at, seq): the last index and time; one more extraction each."""
    news = seen.groupBy("session_id").agg(F.max_by(F.struct("msg_index", "at"), "seq").alias("l"), F.count("*").alias("n"))
    joined = states.join(news, "session_id", "full")
    return joined.select(
        "session_id",
        F.coalesce("l.msg_index", "last_extracted_msg_index").alias("last_extracted_msg_index"),
        F.coalesce("l.at", "last_extraction_at").alias("last_extraction_at"),
        (F.coalesce("total_extractions", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("total_extractions"),
    )


def import_last_wins(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """Entities after an import (entity columns and seq): a later row evicts every earlier one of its name or its id.

    That holds even for a row that is itself evicted later, so two windows decide: a row stays if it is
    the last of its name and the last of its id.
    """
    both = store.withColumn("seq", before(incoming)).unionByName(incoming)
    last = both.withColumn("__n", F.max("seq").over(Window.partitionBy("name"))).withColumn("__i", F.max("seq").over(Window.partitionBy("entity_id")))
    kept = last.where("seq = __n AND seq = __i").drop("seq", "__n", "__i")
    return kept.withColumn("canonical_name", names.canonical(F.col("name")))


def import_edges_last_wins(store: DataFrame, incoming: DataFrame) -> DataFrame:
    both = store.withColumn("seq", before(incoming)).unionByName(incoming)
    return top_by(both, ["source_name", "target_name", "rel_type"], [F.desc("seq")], 1).drop("seq", "rank")


def sync_first_wins(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """Entities after a sync (entity columns and seq): a row enters unless its name or id is there already.

    Only rows that enter block later ones, which is sequential by nature.  Rows of a name and id that
    pair one to one, the usual case, are decided by a window; the rest, connected through shared names
    and ids, are walked in order, each connected group on its own.
    """
    h = store
    fresh = incoming.join(h.select(F.col("name").alias("__n")), incoming["name"] == F.col("__n"), "left_anti").join(h.select(F.col("entity_id").alias("__i")), incoming["entity_id"] == F.col("__i"), "left_anti")
    w_name, w_id = Window.partitionBy("name"), Window.partitionBy("entity_id")
    marked = fresh.withColumn("__a", F.min("entity_id").over(w_name)).withColumn("__b", F.max("entity_id").over(w_name)).withColumn("__c", F.min("name").over(w_id)).withColumn("__d", F.max("name").over(w_id))
    plain = F.expr("__a = __b AND __c = __d")
    extra = ("__a", "__b", "__c", "__d")
    simple = top_by(marked.where(plain).drop(*extra), ["name"], [F.col("seq")], 1).drop("rank", "seq")
    tangled = marked.where(~plain).drop(*extra)
    return h.unionByName(simple).unionByName(_walk(tangled).drop("seq"))


def _walk(rows: DataFrame) -> DataFrame:
    """First come, first served by name and id, in order of seq, within each connected group.

    A task streams through many groups, each in order, and holds the names and ids of one.
    """
    import pyarrow as pa

    from weft.operators.components import grouped, shared_table, spread

    def first_come(batches):
        group, names_, ids = None, set(), set()
        for batch in batches:
            keep = []
            for k, n, e in zip(batch.column("__group").to_pylist(), batch.column("name").to_pylist(), batch.column("entity_id").to_pylist(), strict=True):
                if k != group:
                    group, names_, ids = k, set(), set()
                keep.append(n not in names_ and e not in ids)
                if keep[-1]:
                    names_.add(n)
                    ids.add(e)
            yield batch.filter(pa.array(keep, pa.bool_()))

    g = shared_table(grouped(shared_table(rows), "name", "entity_id", "__group"))
    return spread(g, g.count(), "__group").sortWithinPartitions("__group", "seq").mapInArrow(first_come, g.schema).drop("__group")


def sync_edges_first_wins(store: DataFrame, incoming: DataFrame) -> DataFrame:
    both = store.withColumn("seq", before(incoming)).unionByName(incoming)
    return top_by(both, ["source_name", "target_name", "rel_type"], [F.col("seq")], 1).drop("seq", "rank")


def checkpoint_rows(done: DataFrame, new: DataFrame) -> DataFrame:
    """Checkpoint after new rows, by (source, file_path), the latest processed_at; errors are cut at 500 characters."""
    both = done.unionByName(new.withColumn("error_message", F.substring("error_message", 1, 500)))
    return top_by(both, ["source", "file_path"], [F.desc("processed_at"), F.desc("status")], 1).drop("rank")


def unprocessed(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files whose checkpoint isn't 'processed'; failed ones are tried again."""
    return files.join(done.where("status = 'processed'").select("source", "file_path"), ["source", "file_path"], "left_anti")


def phase_stats(done: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return done.groupBy("source").agg(
        F.count_if(F.col("status") == "processed").alias("n_processed"),
        F.count_if(F.col("status") == "failed").alias("n_failed"),
        total("entities_extracted").alias("entities"),
        total("entities_rejected").alias("rejected"),
        total("relationships_extracted").alias("relationships"),
    )


TARGETS = {"knowledge_base": 0.20, "recent_conversations": 0.30, "older_conversations": 0.50}


def rejection_rates(stats: DataFrame, targets: dict[str, float] | None = None, default: float = 0.40) -> DataFrame:
    """Share of rejected entities by source, and whether it is above the source's target."""
    t = F.create_map(*(F.lit(x) for pair in (TARGETS if targets is None else targets or {"": default}).items() for x in pair))
    seen = F.col("entities") + F.col("rejected")
    rate = F.when(seen > 0, F.round(F.col("rejected") / seen, 6)).otherwise(F.lit(0.0))
    target = F.coalesce(F.try_element_at(t, F.col("source")), F.lit(default))
    return stats.select("source", "entities", "rejected", rate.alias("rejection_rate"), target.alias("target"), (rate > target).alias("alert"))
