"""Recall: topic insights, context for a message, and the context that is injected into prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import texts
from weft.operators import graph, search
from weft.operators.components import shared_table
from weft.operators.graph import FEW, Graph, top_by


def insights(g: Graph, queries: DataFrame, limit: int = 10, entities: int = 5, edges: int = 10, domain: str | None = None, using: search.Index | None = None) -> DataFrame:
    """query_id, rank, name, type, domain, edge_rank, rel_type, other, confidence: the first entities found and their edges.

    An entity without edges has one row, with nulls.
    """
    top = shared_table(search.search(g.entities, queries, limit, domain, using=using).where(F.col("rank") <= entities).select("query_id", "rank", "name", "type", "domain"))
    near = graph.neighbourhood(top, g.relationships, edges).select("name", "edge_rank", "rel_type", "other", "confidence")
    return top.join(near, "name", "left").select("query_id", "rank", "name", "type", "domain", "edge_rank", "rel_type", "other", "confidence")


def _worded(messages: DataFrame, keywords: int) -> DataFrame:
    """message_id, words: the lists of keywords of a message's texts, in order; messages of the same words find the same."""
    return shared_table(messages.groupBy("message_id").agg(F.array_sort(F.collect_set(texts.keywords("text", keywords))).alias("words")))


def _found(entities: DataFrame, worded: DataFrame, most: int, using: search.Index | None) -> DataFrame:
    """words, entity_rank, entity_id for distinct ``words``."""
    each = worded.select("words", F.explode("words").alias("list")).select("words", F.posexplode("list").alias("word_at", "query"))
    asked = each.select("query").distinct().withColumn("query_id", F.col("query"))
    found = search.search(entities, asked, most, using=using).select("query_id", "rank", "entity_id")
    first = each.join(found, each["query"] == found["query_id"]).groupBy("words", "entity_id").agg(F.min(F.struct("word_at", "rank")).alias("place"))
    return shared_table(top_by(first, ["words"], [F.col("place"), F.col("entity_id")], most, "entity_rank").drop("place"))


def _answered(worded: DataFrame, answers: DataFrame) -> DataFrame:
    """What was found for the words, for each message that has them."""
    few = answers.limit(FEW + 1).count() <= FEW
    return worded.join(F.broadcast(answers) if few else answers, "words").drop("words")


def keyword_entities(entities: DataFrame, messages: DataFrame, most: int = 3, keywords: int = 5, using: search.Index | None = None) -> DataFrame:
    """message_id, place, entity_id: the entities that the message's keywords find, in the order of keywords, then of rank.

    Each keyword is a search of its own; an entity counts where it is found first.
    """
    worded = _worded(messages, keywords)
    return _answered(worded, _found(entities, shared_table(worded.select("words").distinct()), most, using))


def recall(g: Graph, messages: DataFrame, most: int = 3, keywords: int = 5, per_entity: int = 5, cap: int = 10, using: search.Index | None = None) -> DataFrame:
    """message_id, entities (structs in order), relationships (at most ``cap`` distinct edge texts in order).

    A message that finds nothing gets the top entities.
    """
    worded = _worded(messages, keywords)
    asked = shared_table(worded.select("words").distinct())
    by_word = _found(g.entities, asked, most, using)
    top = graph.top_entities(g.entities, most).withColumn("entity_rank", F.row_number().over(Window.orderBy(F.desc("score"), "name"))).select("entity_id", "entity_rank")
    rest = asked.join(by_word.select("words").distinct(), "words", "left_anti").crossJoin(top)  # top: ``most`` rows
    picked = by_word.select("words", "entity_rank", "entity_id").unionByName(rest.select("words", "entity_rank", "entity_id"))
    full = shared_table(picked.join(g.entities.select("entity_id", "name", "type", "domain", "description", "confidence"), "entity_id"))
    near = graph.neighbourhood(full.select("name"), g.relationships, per_entity).select("name", "edge_rank", texts.edge_text(F.col("source_name"), F.col("rel_type"), F.col("target_name")).alias("edge"))
    once = full.select("words", "entity_rank", "name").join(near, "name").groupBy("words", "edge").agg(F.min(F.struct("entity_rank", "edge_rank")).alias("place"))
    edges = top_by(once, ["words"], [F.col("place")], cap, "n").groupBy("words").agg(F.sort_array(F.collect_list(F.struct("n", "edge"))).alias("edges"))
    listed = full.groupBy("words").agg(F.sort_array(F.collect_list(F.struct("entity_rank", "name", "type", "domain", "description", "confidence"))).alias("entities"))
    answers = shared_table(listed.join(edges, "words", "left").select("words", "entities", F.coalesce(F.expr("edges.edge"), F.array().cast("array<string>")).alias("relationships")))
    return _answered(worded, answers)


def rendered(recalled: DataFrame, most_edges: int = 5) -> DataFrame:
    """message_id, block: the recalled entities and edges as text."""
    line = F.transform("entities", lambda e: texts.recalled_text(e["name"], e["type"], e["domain"], e["description"]))
    edges = F.transform(F.slice("relationships", 1, most_edges), lambda r: F.concat(F.lit("    - "), r))
    return recalled.select("message_id", F.array_join(F.concat(line, edges), "\n").alias("block"))


def recall_hook(g: Graph, messages: DataFrame, phase: str = "full", iterations: int = 2, least: int = 10, using: search.Index | None = None) -> DataFrame:
    """Blocks for messages (message_id, text, iteration) of an early iteration and some length; none in the shadow phase."""
    open_ = messages.where((F.col("iteration") <= iterations) & (F.length(F.trim("text")) >= least) & F.lit(phase != "shadow"))
    return rendered(recall(g, open_, using=using))


def injected(entities: DataFrame, messages: DataFrame, phase: str = "full", most: int = 3, lines: int = 10, using: search.Index | None = None) -> DataFrame:
    """message_id, block: lines for the entities that a question names; messages with code, and other than questions, get none."""
    asked = messages.where(~texts.has_code(F.col("text")) & texts.is_question(F.col("text")) & F.lit(phase == "full"))
    found = keyword_entities(entities, asked, most, using=using).join(entities, "entity_id")
    line = texts.context_text(F.col("name"), F.col("type"), F.col("domain"), F.col("description"))
    listed = found.where(F.col("entity_rank") < lines).groupBy("message_id").agg(F.sort_array(F.collect_list(F.struct("entity_rank", line.alias("line")))).alias("l"))
    return listed.select("message_id", F.array_join(F.expr("l.line"), "\n").alias("block"))
