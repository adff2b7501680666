"""Ingestion: texts through an extractor into the graph; windows over chat sessions; resumable backfill of files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import names, texts
from weft.functions.extract import Extractor, entity_records, relationship_records, responses
from weft.operators import merge
from weft.operators.components import shared_table
from weft.operators.graph import Graph

MIN_MESSAGES, WINDOW, MIN_CHARS, MIN_NEW = 3, 15, 50, 3
MIN_FILE_CHARS = 50


def session_windows(messages: DataFrame, states: DataFrame, most: int = WINDOW, least: int = MIN_MESSAGES, new: int = MIN_NEW, chars: int = MIN_CHARS) -> DataFrame:
    """session_id, msg_index, text: what is next extracted of each session; messages (session_id, idx, role, text), idx from 0.

    A session that was extracted up to an index needs ``new`` messages more, and gives the last
    ``most`` of those; one never seen needs ``least`` and gives its last ``most``.
    """
    known = states.select("session_id", F.col("last_extracted_msg_index").alias("__last"))
    each = messages.join(known, "session_id", "left").withColumn("n", F.max("idx").over(Window.partitionBy("session_id")) + 1)
    seen = F.coalesce("__last", F.lit(0))
    fresh = each.where((F.col("n") >= least) & (F.col("idx") >= seen) & ((seen == 0) | (F.col("n") - seen >= new)) & (F.col("idx") >= F.col("n") - most))
    lines = F.sort_array(F.collect_list(F.struct("idx", F.concat_ws(": ", "role", "text").alias("line"))))
    out = fresh.groupBy("session_id").agg(F.max("n").alias("msg_index"), lines.alias("l")).select("session_id", "msg_index", F.array_join(F.expr("l.line"), "\n").alias("text"))
    return out.where(F.length("text") >= chars)


def extract_and_store(g: Graph, prompts: DataFrame, extractor: Extractor, seen_at: datetime, resolve_endpoints: bool = False, mode: str = "strict", chars: int | None = texts.PROMPT_CHARS) -> tuple[Graph, DataFrame]:
    """The graph after the texts of prompts (source, session_id, seq, text); and stored, rejected and edges by source.

    ``resolve_endpoints``: ends of edges take the spelling of the entity that their canonical form belongs to.
    """
    keys = ["source", "session_id", "seq"]
    answers = shared_table(responses(prompts.select(*keys, "text"), extractor, chars=chars).select(*keys, texts.parsed(F.col("raw")).alias("answer")))
    e = shared_table(entity_records(answers, keys))
    r = shared_table(relationship_records(answers, keys))
    ok = e.where("status = 'ok'").withColumn("seen_at", F.lit(seen_at))
    entities = shared_table(merge.upsert_entities(g.entities, ok.drop("status", "source"), mode))
    if resolve_endpoints:
        r = resolved(r, entities, mode)
    new = r.select("source_name", "target_name", "rel_type", "confidence", F.col("source").alias("source_doc"), F.lit(seen_at).alias("created_at"), "seq")
    edges = merge.upsert_relationships(g.relationships, new)
    failed = answers.groupBy("source").agg(F.count_if(F.col("answer").isNull()).alias("parse_failed"))
    counts = e.groupBy("source").agg(F.count_if(F.col("status") == "ok").alias("stored"), F.count_if(F.col("status") != "ok").alias("rejected"))
    related = r.groupBy("source").agg(F.count("*").alias("edges"))
    report = failed.join(counts, "source", "left").join(related, "source", "left").na.fill(0)
    return g.with_(entities=entities, relationships=shared_table(edges)), report


def resolved(edges: DataFrame, entities: DataFrame, mode: str = "strict") -> DataFrame:
    """Ends of edges that are no entity's name become that of the first entity of their canonical form, where there is one."""
    form = lambda c: merge.matching_form(names.canonical(F.col(c), mode), F.col(c), mode)
    known = entities.select(F.col("name").alias("__name")).distinct()
    by_form = entities.groupBy(form("name").alias("__form")).agg(F.min("name").alias("__to"))
    for end in ("source_name", "target_name"):
        to = edges.withColumn("__form", form(end)).join(by_form, "__form", "left").join(known, F.col(end) == known["__name"], "left")
        edges = to.withColumn(end, F.coalesce("__name", "__to", end)).select(edges.columns)
    return edges


def ingest_sessions(g: Graph, states: DataFrame, messages: DataFrame, extractor: Extractor, seen_at: datetime, chars: int | None = texts.PROMPT_CHARS) -> tuple[Graph, DataFrame, DataFrame]:
    """Graph and session states after the next window of every session, and the report by session."""
    windows = shared_table(session_windows(messages, states))
    order = windows.select("session_id", "msg_index", names.sequence("session_id", "msg_index").alias("seq"), "text").withColumn("source", F.col("session_id"))
    g, report = extract_and_store(g, order, extractor, seen_at, chars=chars)
    moved = merge.update_sessions(states, windows.select("session_id", "msg_index", F.lit(seen_at).alias("at"), F.col("msg_index").alias("seq")))
    return g, moved, report


def backfill(g: Graph, done: DataFrame, files: DataFrame, extractor: Extractor, seen_at: datetime, most_chunks: int = texts.MAX_CHUNKS, chars: int | None = texts.PROMPT_CHARS) -> tuple[Graph, DataFrame]:
    """The graph and the checkpoint after the files (source, file_path, text) that aren't processed yet.

    Texts under 50 characters count as processed; files of too many chunks fail, as do those whose
    answers hold neither an accepted nor a rejected entity.
    """
    todo = merge.unprocessed(files, done).withColumn("chunks", texts.chunks("text"))
    short = F.length(F.trim("text")) < MIN_FILE_CHARS
    state = F.when(F.col("text").isNull() | short, "short").when(F.size("chunks") > most_chunks, "large").otherwise("take")
    todo = shared_table(todo.withColumn("state", state).select("source", "file_path", "state", "chunks"))
    key = F.concat_ws("\x1f", "source", "file_path")
    prompts = todo.where("state = 'take'").select(key.alias("source"), F.lit(None).cast("string").alias("session_id"), F.posexplode("chunks").alias("at", "text")).withColumn("seq", names.sequence("source", "at")).drop("at")
    g, report = extract_and_store(g, prompts, extractor, seen_at, chars=chars)
    counted = todo.join(report.withColumnRenamed("source", "__key"), F.col("__key") == key, "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    silent = (F.col("state") == "take") & (n("stored") == 0) & (n("rejected") == 0)
    error = F.when(F.col("state") == "large", "too many chunks").when(silent, "nothing extracted, nothing rejected")
    rows = counted.select("source", "file_path", F.when(error.isNull(), "processed").otherwise("failed").alias("status"), n("stored").alias("entities_extracted"), n("rejected").alias("entities_rejected"), n("edges").alias("relationships_extracted"), error.alias("error_message"), F.lit(seen_at).alias("processed_at"))
    return g, shared_table(merge.checkpoint_rows(done, rows))
