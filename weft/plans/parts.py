"""Queries of single operators that the composed ones don't show: scans, look-ups, writes, cleanup, sources, sinks, rendering, streaming."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import names, texts
from weft.operators import dream, fuzzy, graph, health, ingest, merge, recall, search
from weft.operators.components import shared_folder, shared_table
from weft.plans.queries import _BM25, _DUPES, _NAMES, _NEAR, _PART_Q, _REASON, _TRIPLED, _WITH, AS_OF, ORACLES, _messages, _names, _read, _variant_graph, form_sql, query
from weft.sources import files, fixtures, jsonl
from weft.sources.store import Store
from weft.streaming import ingest as streaming

_ID = "substr(md5({}), 1, 16)"


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Scans and look-ups


@query(_WITH + "SELECT name, type, domain, confidence, mention_count, description FROM e ORDER BY name LIMIT 10000")
def entity_scan(spark, d):
    return graph.all_entities(fixtures.entities(spark, d)).select("name", "type", "domain", "confidence", "mention_count", "description")


@query(_WITH + "SELECT source_name, target_name, rel_type, round(confidence, 6) AS confidence FROM r ORDER BY source_name, target_name, rel_type LIMIT 500")
def edge_scan(spark, d):
    return graph.all_relationships(fixtures.relationships(spark, d)).select("source_name", "target_name", "rel_type", F.round("confidence", 6).alias("confidence"))


@query(_WITH + "SELECT name, type, mention_count, description FROM e WHERE name = 'small ring'")
def entity_by_name(spark, d):
    return graph.entity_by_name(fixtures.entities(spark, d), "small ring").select("name", "type", "mention_count", "description")


@query(_WITH + f"SELECT name, type, mention_count, description FROM e WHERE {_ID.format('name')} = {_ID.format(repr('ASIA'))}")
def entity_by_id(spark, d):
    at = spark.range(1).select(names.entity_id(F.lit("ASIA"))).first()[0]
    return graph.entity_by_id(fixtures.entities(spark, d), at).select("name", "type", "mention_count", "description")


@query(f"SELECT 'm' || substr(md5('ASIA'), 1, 8) AS memory_id FROM region WHERE r_name = 'ASIA'")
def memory_ids_of_entity(spark, d):
    g = fixtures.graph(spark, d)
    at = spark.range(1).select(names.entity_id(F.lit("ASIA"))).first()[0]
    return graph.memory_ids_of(g.memory_ids, at)


def _states(spark, d):
    """States after one extraction of every session, at its number of messages."""
    c = _read(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("msg_index"))
    seen = c.select(F.col("conv_id").cast("string").alias("session_id"), "msg_index", F.lit(AS_OF).alias("at"), F.col("msg_index").alias("seq"))
    return merge.update_sessions(graph.empty(spark, "session_state"), seen), seen


@query("SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) AS last_extracted_msg_index, CAST(1 AS BIGINT) AS total_extractions FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations) GROUP BY conv_id")
def session_state(spark, d):
    states, _ = _states(spark, d)
    least = _read(spark, d, "conversations").agg(F.min("conv_id").cast("string")).first()[0]
    return graph.session_state_of(states, least).select("session_id", "last_extracted_msg_index", "total_extractions")


@query("SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) + 5 AS last_extracted_msg_index, CAST(CASE WHEN conv_id % 2 = 0 THEN 3 ELSE 2 END AS BIGINT) AS total_extractions FROM conversations GROUP BY conv_id")
def session_updates(spark, d):
    """Two or three extractions of every session, counted up."""
    states, seen = _states(spark, d)
    more = seen.withColumns({"msg_index": F.col("msg_index") + 5, "seq": F.col("seq") + 5})
    also = seen.where("CAST(session_id AS BIGINT) % 2 = 0").withColumns({"msg_index": F.col("msg_index") + 3, "seq": F.col("seq") + 3})
    return merge.update_sessions(states, more.unionByName(also)).select("session_id", "last_extracted_msg_index", "total_extractions")


# Scalars


@query(f"WITH {_NAMES}, q AS (SELECT DISTINCT trim(regexp_replace(name, '[ \\t\\n\\r\\v\\f]+', ' ', 'g')) AS name FROM n), c AS (SELECT name, CAST(length(name) % 10 AS DOUBLE) / 10 AS confidence FROM q) SELECT md5(name) AS id, confidence >= 0.3 AND {_REASON} = 'ok' AND NOT regexp_matches(name, '[\\w.\\-]+@[\\w.\\-]+\\.\\w+|sk-|ghp_|hf_|nvapi-|(^|[^A-Za-z0-9])[A-Z0-9]{{8}}[A-Za-z0-9]{{24,}}') AS ok FROM c")
def acceptable_names(spark, d):
    n = names.normalize(_names(spark, d), "name").distinct()
    return n.select(F.md5("name").alias("id"), names.acceptable(F.col("name"), (F.length("name") % 10).cast("double") / 10).alias("ok"))


_ANSWER = """{"entities": [{"name": "%s", "type": "tool", "confidence": "0.5"}], "relationships": []}"""
_ANSWERS = ("```json\n%s\n```", "json %s", "%s", "```\n%s\n```", "no answer", "[1]")


@query("SELECT p_partkey, CASE WHEN p_partkey % 6 < 4 THEN p_name END AS name FROM part")
def response_repair(spark, d):
    """Model answers in fences, behind a word, bare and broken."""
    p = _read(spark, d, "part")
    body = F.concat(F.lit(_ANSWER.split("%s")[0]), "p_name", F.lit(_ANSWER.split("%s")[1]))
    raw = F.coalesce(*(F.when(F.col("p_partkey") % 6 == i, F.concat(F.lit(a.split("%s")[0]), body, F.lit(a.split("%s")[1])) if "%s" in a else F.lit(a)) for i, a in enumerate(_ANSWERS)))
    return p.select("p_partkey", F.try_element_at(texts.parsed(raw)["entities"], F.lit(1))["name"].alias("name"))


@query("SELECT doc_id, md5(substr(text, 1, 8000)) AS hash FROM documents")
def prompt_cut(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.md5(texts.prompt_text(F.col("text"))).alias("hash"))


@query(_WITH + "SELECT name, '**' || name || '** (' || type || '/' || domain || ', conf=' || printf('%.2f', confidence) || ')' || CASE WHEN coalesce(description, '') <> '' THEN chr(10) || '  ' || description ELSE '' END AS found, "
    "'- **' || name || '** (' || type || ', ' || domain || ')' || CASE WHEN coalesce(description, '') <> '' THEN ' — ' || substr(description, 1, 80) ELSE '' END AS context FROM e")
def entity_cards(spark, d):
    e = fixtures.entities(spark, d)
    c = [F.col(x) for x in ("name", "type", "domain")]
    return e.select("name", texts.found_text(*c, F.col("confidence"), F.col("description")).alias("found"), texts.context_text(*c, F.col("description")).alias("context"))


@query(_WITH + "SELECT '- ' || source_name || ' →[' || rel_type || ']→ ' || target_name || ' (conf=' || printf('%.2f', confidence) || ')' AS line FROM r")
def edge_lines(spark, d):
    return fixtures.relationships(spark, d).select(texts.relation_text(F.col("source_name"), F.col("rel_type"), F.col("target_name"), F.col("confidence")).alias("line"))


# Search, recall, injection


@query(
    _WITH + f", {_PART_Q}, {_BM25}, x AS (SELECT query_id, rk.name, score, mention_count, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mention_count DESC, rk.name) AS rank FROM sc rk JOIN e ON e.name = rk.name WHERE domain = 'platform' AND type = 'technology') SELECT query_id, CAST(rank AS INTEGER) AS rank, name, score FROM x WHERE rank <= 10"
)
def search_filtered(spark, d):
    asked = _read(spark, d, "part").select(F.concat("p_name", "p_type").alias("query_id"), F.concat("p_name", F.lit(" "), F.substring("p_type", 1, 3)).alias("query")).distinct()
    return search.ranked(fixtures.entities(spark, d), asked, domain="platform", etype="technology", using=fixtures.index(spark, d)).select("query_id", "rank", "name", "score")


@query(
    _WITH + ", q AS (SELECT DISTINCT replace(p_name, ' ', '_') AS query_id, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part), "
    "d AS (SELECT name, mention_count, list_filter(regexp_split_to_array(lower(name), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS n, list_filter(regexp_split_to_array(lower(coalesce(description, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM e), "
    "corpus AS (SELECT count(*) AS n_docs, avg(len(n) + len(t)) AS mean FROM d), "
    "f AS (SELECT query_id, name, mention_count, len(n) + len(t) AS dl, len(list_filter(range(1, len(n)), lambda i: n[i] = a AND starts_with(n[i + 1], b))) + len(list_filter(range(1, len(t)), lambda i: t[i] = a AND starts_with(t[i + 1], b))) AS f FROM d JOIN q ON true), "
    "h AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS nq FROM f WHERE f > 0), "
    "s AS (SELECT query_id, name, mention_count, round(CASE WHEN ln((n_docs - nq + 0.5) / (nq + 0.5)) > 0 THEN ln((n_docs - nq + 0.5) / (nq + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / mean)), 6) AS score FROM h, corpus), "
    "x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mention_count DESC, name) AS rank FROM s) SELECT query_id, CAST(rank AS INTEGER) AS rank, name, score FROM x WHERE rank <= 10"
)
def search_phrase(spark, d):
    """Part names with an underscore: phrases whose two words must adjoin."""
    asked = _read(spark, d, "part").select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("query_id")).distinct().withColumn("query", F.col("query_id"))
    return search.ranked(fixtures.entities(spark, d), asked, using=fixtures.index(spark, d)).select("query_id", "rank", "name", "score")


@query(
    f"WITH rec AS ({ORACLES['recall_context']}), e0 AS (SELECT name, type, domain, description FROM ({fixtures.duck(fixtures.ENTITIES_SQL)})), "
    "n AS (SELECT message_id, relationships, unnest(string_split(entities, '|')) AS name, generate_subscripts(string_split(entities, '|'), 1) AS i FROM rec), "
    "l AS (SELECT message_id, relationships, string_agg('- **' || n.name || '** (' || type || '/' || domain || ')' || CASE WHEN coalesce(description, '') <> '' THEN ': ' || description ELSE '' END, chr(10) ORDER BY i) AS head FROM n JOIN e0 ON e0.name = n.name GROUP BY message_id, relationships) "
    "SELECT message_id, head || CASE WHEN relationships = '' THEN '' ELSE chr(10) || array_to_string(list_transform(list_slice(string_split(relationships, '|'), 1, 5), lambda r: '    - ' || r), chr(10)) END AS block FROM l WHERE message_id % 4 < 3"
)
def recall_hook(spark, d):
    """Messages of early iterations get blocks; those of the third don't, nor do short ones."""
    late = _messages(spark, d).withColumn("iteration", (F.col("message_id") % 4).cast("int"))
    short = late.select((F.col("message_id") + 10_000_000).alias("message_id"), F.lit("hi there").alias("text"), F.lit(0).alias("iteration"))
    return recall.recall_hook(fixtures.graph(spark, d), late.unionByName(short), using=fixtures.index(spark, d))


@query(
    f"WITH inj AS ({ORACLES['recall_context']}), e0 AS (SELECT name, type, domain, description FROM ({fixtures.duck(fixtures.ENTITIES_SQL)})), n AS (SELECT message_id, unnest(string_split(entities, '|')) AS name, generate_subscripts(string_split(entities, '|'), 1) AS i FROM inj) "
    "SELECT message_id, string_agg('- **' || n.name || '** (' || type || ', ' || domain || ')' || CASE WHEN coalesce(description, '') <> '' THEN ' — ' || substr(description, 1, 80) ELSE '' END, chr(10) ORDER BY i) AS block FROM n JOIN e0 ON e0.name = n.name GROUP BY message_id"
)
def injection_blocks(spark, d):
    """The lines that questions get; the same questions with code in them get none."""
    asked = _messages(spark, d)
    code = asked.select((F.col("message_id") + 10_000_000).alias("message_id"), F.concat(F.lit("import this: "), "text").alias("text"))
    return recall.injected(fixtures.entities(spark, d), asked.unionByName(code), using=fixtures.index(spark, d))


# Writes


@query(_WITH + ", gone AS (SELECT name FROM e WHERE mention_count = 2) SELECT 'entity' AS kind, name AS a, '' AS b, '' AS c FROM e WHERE name NOT IN (SELECT name FROM gone) UNION ALL SELECT 'edge', source_name, target_name, rel_type FROM r WHERE source_name NOT IN (SELECT name FROM gone) AND target_name NOT IN (SELECT name FROM gone) "
    "UNION ALL SELECT 'memory', substr(md5(name), 1, 16), 'm' || substr(md5(name), 1, 8), '' FROM e WHERE name NOT IN (SELECT name FROM gone)")
def delete_cascade(spark, d):
    g = fixtures.graph(spark, d)
    left = merge.delete_entities(g, g.entities.where("mention_count = 2").select("name"))
    none = F.lit("").alias("c")
    e = left.entities.select(F.lit("entity").alias("kind"), F.col("name").alias("a"), F.lit("").alias("b"), none)
    r = left.relationships.select(F.lit("edge").alias("kind"), F.col("source_name").alias("a"), F.col("target_name").alias("b"), F.col("rel_type").alias("c"))
    m = left.memory_ids.select(F.lit("memory").alias("kind"), F.col("entity_id").alias("a"), F.col("memory_id").alias("b"), none)
    return e.unionByName(r).unionByName(m)


@query(_WITH + "SELECT substr(md5(name), 1, 16) AS entity_id, 'm' || substr(md5(name), 1, 8) AS memory_id FROM e UNION SELECT substr(md5(name), 1, 16), 'x' || mention_count FROM e")
def memory_links(spark, d):
    g = fixtures.graph(spark, d)
    new = g.entities.select("entity_id", F.concat(F.lit("x"), F.col("mention_count").cast("string")).alias("memory_id"))
    return merge.link_memory(g.memory_ids, new.unionByName(new).unionByName(g.memory_ids))


_ODD_NAMES = ("東京", "Москва", "Inc", "The", "Theory", "Ory", "東京 A", "大阪 A", "Acme Inc.", "Acme", "acme ltd", "small ring", "The Small Ring")
_ODD_SQL = "b AS (SELECT name, i, 0.3 + (i % 7) / 10.0 AS confidence, 'turn ' || i AS description FROM (VALUES " + ", ".join(f"('{n}', {i})" for i, n in enumerate(_ODD_NAMES * 2)) + ") AS v(name, i) UNION ALL SELECT CASE WHEN p_partkey % 2 = 0 THEN p_name || ' Inc.' ELSE 'The ' || p_brand END, p_partkey + 100, 0.5, 'part' FROM part)"


def _odd_batch(spark, d):
    rows = spark.createDataFrame([(n, 0.3 + (i % 7) / 10.0, f"turn {i}", i) for i, n in enumerate(_ODD_NAMES * 2)], "name string, confidence double, description string, seq long")
    p = _read(spark, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" Inc."))).otherwise(F.concat(F.lit("The "), "p_brand")).alias("name"), F.lit(0.5).alias("confidence"), F.lit("part").alias("description"), (F.col("p_partkey") + 100).alias("seq"))
    return rows.unionByName(p).select("name", F.lit("concept").alias("type"), F.lit("general").alias("domain"), "confidence", "description", F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("session_id"), F.lit(AS_OF).alias("seen_at"), "seq")


def _form(c):
    return f"CASE WHEN {form_sql(c, 'strict')} = '' THEN '#' || {c} ELSE {form_sql(c, 'strict')} END"


_UPSERT = (
    "s AS (SELECT name, confidence, mention_count, description, " + _form("name") + " AS form FROM e), f AS (SELECT form, min(name) AS by_form FROM s GROUP BY form), k AS (SELECT *, " + _form("name") + " AS form FROM b0), "
    "h AS (SELECT k.*, coalesce(s.name, by_form, first_value(k.name) OVER (PARTITION BY k.form ORDER BY i, k.name)) AS target FROM k LEFT JOIN s ON s.name = k.name LEFT JOIN f ON f.form = k.form), "
    "g AS (SELECT target, count(*) AS n, max(confidence) AS c, arg_max(description, i) FILTER (WHERE name = target AND description <> '') AS dn, arg_min(description, i) AS d0 FROM h GROUP BY target) "
    "SELECT coalesce(s.name, target) AS name, coalesce(mention_count, 0) + coalesce(n, 0) AS mention_count, round(greatest(coalesce(confidence, 0), coalesce(c, 0)), 6) AS confidence, coalesce(dn, s.description, d0) AS description FROM s FULL JOIN g ON s.name = target"
)


@query(_WITH + f", {_ODD_SQL}, b0 AS (SELECT * FROM b), {_UPSERT}")
def upsert_strict(spark, d):
    """Names of other scripts, of suffixes alone, and variants of names that are there: only true variants meet."""
    return merge.upsert_entities(fixtures.entities(spark, d), _odd_batch(spark, d)).select("name", "mention_count", F.round("confidence", 6).alias("confidence"), "description")


@query(_WITH + f", {_ODD_SQL}, b0 AS (SELECT * FROM b WHERE confidence >= 0.3 AND {_REASON} = 'ok'), {_UPSERT}")
def register_entities(spark, d):
    """The same batch through validation."""
    return merge.register(fixtures.entities(spark, d), _odd_batch(spark, d)).select("name", "mention_count", F.round("confidence", 6).alias("confidence"), "description")


@query(_WITH + ", i AS (SELECT name, substr(md5(name), 1, 16) AS id, 1 AS seq FROM e WHERE mention_count <> 3 UNION ALL SELECT name || ' 2', substr(md5(name), 1, 16), 2 FROM e WHERE mention_count = 2 UNION ALL SELECT name || ' 2', substr(md5(name || ' x'), 1, 16), 3 FROM e WHERE mention_count = 2 AND type = 'person'), "
    "u AS (SELECT name, substr(md5(name), 1, 16) AS id, -1 AS seq FROM e UNION ALL SELECT * FROM i), w AS (SELECT *, max(seq) OVER (PARTITION BY name) AS n, max(seq) OVER (PARTITION BY id) AS k FROM u) SELECT name, id AS entity_id, CAST(seq AS BIGINT) AS seq FROM w WHERE seq = n AND seq = k")
def import_clashes(spark, d):
    """Rows that repeat in the batch, one id under two names and one name under two ids: the last wins."""
    e = fixtures.entities(spark, d)
    two = e.where("mention_count = 2").withColumn("name", F.concat("name", F.lit(" 2")))
    three = e.where("mention_count = 2 AND type = 'person'").withColumns({"entity_id": names.entity_id(F.concat("name", F.lit(" x"))), "name": F.concat("name", F.lit(" 2"))})
    i = e.where("mention_count <> 3").withColumn("seq", F.lit(1).cast("long")).unionByName(two.withColumn("seq", F.lit(2).cast("long"))).unionByName(three.withColumn("seq", F.lit(3).cast("long")))
    marked = i.withColumn("description", F.col("seq").cast("string"))
    return merge.import_last_wins(e.withColumn("description", F.lit("-1")), marked).select("name", "entity_id", F.col("description").cast("long").alias("seq"))


@query(
    _WITH + ", t AS (SELECT name, type FROM e WHERE mention_count = 1) SELECT name, substr(md5(name), 1, 16) AS entity_id FROM e WHERE mention_count <> 1 "
    "UNION ALL SELECT name || ' a', substr(md5(name || ' 1'), 1, 16) FROM t UNION ALL SELECT name || ' c', substr(md5(name || ' 2'), 1, 16) FROM t"
)
def sync_tangled(spark, d):
    """Names and ids in chains, in order a-1, b-1, c-2, b-2: a-1 and c-2 enter, and each keeps a row of b out."""
    e = fixtures.entities(spark, d)
    t = e.where("mention_count = 1")
    link = lambda name, i, seq: t.withColumns({"entity_id": names.entity_id(F.concat("name", F.lit(f" {i}"))), "name": F.concat("name", F.lit(f" {name}")), "seq": F.lit(seq).cast("long")})
    chain = link("a", 1, 1).unionByName(link("b", 1, 2)).unionByName(link("b", 2, 4)).unionByName(link("c", 2, 3))
    return merge.sync_first_wins(e.where("mention_count <> 1"), chain).select("name", "entity_id")


@query(_WITH + "SELECT name, round(CASE WHEN mention_count = 2 THEN greatest(0.1, confidence * 0.5) ELSE confidence END, 6) AS confidence FROM e")
def decay_by_ids(spark, d):
    e = fixtures.entities(spark, d)
    ids = e.where("mention_count = 2").select("entity_id")
    same = dream.decay_ids(e, ids, 1.5)  # no factor: nothing changes
    return dream.decay_ids(same, ids.unionByName(ids), 0.5).select("name", F.round("confidence", 6).alias("confidence"))


@query("SELECT source, CAST(doc_id AS VARCHAR) AS file_path, CASE WHEN doc_id % 2 = 0 THEN 'processed' ELSE 'failed' END AS status, CASE WHEN doc_id % 2 = 1 THEN substr(text, 1, 500) END AS error_message FROM documents")
def checkpoint_writes(spark, d):
    """Every file fails first; every other is processed later. Errors are cut at 500 characters."""
    docs = _read(spark, d, "documents")
    zero = F.lit(0).cast("long")
    row = lambda status, error, at: docs.select("source", F.col("doc_id").cast("string").alias("file_path"), F.lit(status).alias("status"), zero.alias("entities_extracted"), zero.alias("entities_rejected"), zero.alias("relationships_extracted"), error.cast("string").alias("error_message"), F.lit(at).alias("processed_at"))
    once = merge.checkpoint_rows(graph.empty(spark, "checkpoint"), row("failed", F.col("text"), AS_OF))
    later = row("processed", F.lit(None), AS_OF + timedelta(hours=1)).where("CAST(file_path AS BIGINT) % 2 = 0")
    return merge.checkpoint_rows(shared_table(once), later).select("source", "file_path", "status", "error_message")


# Health and maintenance


_SHORTENED = "k AS (SELECT CASE WHEN mention_count = 1 THEN substr(name, 1, 1) ELSE name END AS name, mention_count, substr(md5(name), 1, 16) AS id FROM e)"


def _shortened(spark, d):
    """The graph with one-letter names in place of entities mentioned once: they are invalid, and their edges are orphans."""
    g = fixtures.graph(spark, d)
    return g.with_(entities=g.entities.withColumns({"name": F.when(F.col("mention_count") == 1, F.substring("name", 1, 1)).otherwise(F.col("name")), "canonical_name": F.lit(None).cast("string")}))


@query(_WITH + f", {_SHORTENED} SELECT name, id AS entity_id FROM k WHERE length(name) < 2")
def invalid_entities(spark, d):
    return health.invalid(_shortened(spark, d).entities).select("name", "entity_id")


@query(_WITH + f", {_SHORTENED}, v AS (SELECT * FROM k WHERE length(name) >= 2) SELECT 'entity' AS kind, name AS a, {form_sql('name', 'strict')} AS b, '' AS c FROM v UNION ALL SELECT 'edge', source_name, target_name, rel_type FROM r WHERE source_name IN (SELECT name FROM v) AND target_name IN (SELECT name FROM v) UNION ALL SELECT 'memory', id, 'm' || substr(id, 1, 8), '' FROM v")
def cleanup(spark, d):
    left = health.cleaned(_shortened(spark, d))
    e = left.entities.select(F.lit("entity").alias("kind"), F.col("name").alias("a"), F.col("canonical_name").alias("b"), F.lit("").alias("c"))
    r = left.relationships.select(F.lit("edge").alias("kind"), F.col("source_name").alias("a"), F.col("target_name").alias("b"), F.col("rel_type").alias("c"))
    m = left.memory_ids.select(F.lit("memory").alias("kind"), F.col("entity_id").alias("a"), F.col("memory_id").alias("b"), F.lit("").alias("c"))
    return e.unionByName(r).unionByName(m)


@query("SELECT 1 AS step, 'degraded' AS status UNION ALL SELECT 2, 'healthy'")
def health_action(spark, d):
    """A degraded graph is cleaned and checked again."""
    g = fixtures.graph(spark, d)
    _, seen = health.check_and_clean(g.with_(entities=g.entities.where("mention_count <> 1")))
    return spark.createDataFrame(list(enumerate(seen, 1)), "step int, status string")


@query(
    _WITH + f", {_DUPES}, {_TRIPLED}, m AS (SELECT DISTINCT name AS dup, prime FROM w WHERE name <> prime), pr AS (SELECT DISTINCT prime FROM m), "
    "o1 AS (SELECT DISTINCT source_name AS p, target_name AS far FROM u WHERE source_name IN (SELECT prime FROM pr)), t1 AS (SELECT DISTINCT source_name AS p, rel_type AS kind FROM u WHERE source_name IN (SELECT prime FROM pr)), "
    "u1 AS (SELECT u.* FROM u LEFT JOIN m ON m.dup = u.source_name LEFT JOIN o1 ON o1.p = m.prime AND o1.far = u.target_name LEFT JOIN t1 ON t1.p = m.prime AND t1.kind = u.rel_type WHERE o1.p IS NULL OR t1.p IS NULL), "
    "o2 AS (SELECT DISTINCT target_name AS p, source_name AS far FROM u1 WHERE target_name IN (SELECT prime FROM pr)), t2 AS (SELECT DISTINCT target_name AS p, rel_type AS kind FROM u1 WHERE target_name IN (SELECT prime FROM pr)), "
    "u2 AS (SELECT u1.* FROM u1 LEFT JOIN m ON m.dup = u1.target_name LEFT JOIN o2 ON o2.p = m.prime AND o2.far = u1.source_name LEFT JOIN t2 ON t2.p = m.prime AND t2.kind = u1.rel_type WHERE o2.p IS NULL OR t2.p IS NULL), "
    "u3 AS (SELECT u2.* FROM u2 LEFT JOIN m ON m.dup = u2.source_name WHERE m.dup IS NULL OR u2.source_name <> u2.target_name) "
    "SELECT coalesce(a.prime, source_name) AS source_name, coalesce(b.prime, target_name) AS target_name, rel_type, round(max(confidence), 6) AS confidence FROM u3 LEFT JOIN m a ON a.dup = u3.source_name LEFT JOIN m b ON b.dup = u3.target_name GROUP BY ALL"
)
def dedup_edges_reference(spark, d):
    """Edges of duplicates whose other end and whose type the primary has, looked at apart, go first."""
    return dream.dedup(_variant_graph(spark, d), "reference").relationships.select("source_name", "target_name", "rel_type", F.round("confidence", 6).alias("confidence"))


_MENTIONED = "m AS (SELECT DISTINCT conv_id, name FROM (SELECT conv_id, unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS name FROM conversations) WHERE regexp_matches(name, '^[A-Z][a-z]{3,}$')), p AS (SELECT x.name AS a, y.name AS b, least(0.2, 0.05 * count(*)) AS boost FROM m x JOIN m y ON x.conv_id = y.conv_id AND x.name < y.name GROUP BY ALL HAVING count(*) >= 3)"


@query(f"WITH {_MENTIONED} SELECT entity_id, round(CAST(sum(boost) AS DOUBLE), 6) AS boost FROM (SELECT a AS entity_id, boost FROM p UNION ALL SELECT b, boost FROM p) GROUP BY entity_id")
def mention_boosts(spark, d):
    return dream.boosts_by_mentions(fixtures.mentions(spark, d).select(F.col("name").alias("entity"), F.col("conv_id").alias("session"))).select("entity_id", F.round("boost", 6).alias("boost"))


@query(_WITH + "SELECT name FROM e")
def checkpoint_pass(spark, d):
    """Linking changes nothing; a checkpoint keeps every row."""
    return dream.checkpoint(dream.link(fixtures.graph(spark, d))).entities.select("name")


@query(_WITH + "SELECT md5(name) AS id, gram, count(*) AS n FROM (SELECT name, unnest(CASE WHEN length(low) < 2 THEN [low] ELSE list_transform(range(1, length(low)), lambda i: substr(low, i, 2)) END) AS gram FROM (SELECT name, lower(trim(name)) AS low FROM e)) GROUP BY ALL")
def bigram_counts(spark, d):
    return fuzzy.gram_counts(fixtures.entities(spark, d)).select(F.md5("name").alias("id"), "gram", "n")


def _pairs_of_variants(spark, d):
    return fixtures.entities(spark, d).select(F.col("name").alias("primary"), F.concat("name", F.lit(" 2")).alias("name"))


@query(_WITH + "SELECT name, mention_count * 2 + 1 AS mention_count, confidence, [name || ' 2'] AS aliases FROM e")
def backfill_merge(spark, d):
    """Every entity absorbs a variant: mentions add up, the name becomes an alias, confidence stays."""
    g = fixtures.graph(spark, d)
    more = g.entities.withColumns({"entity_id": names.entity_id(F.concat("name", F.lit(" 2"))), "name": F.concat("name", F.lit(" 2")), "mention_count": F.col("mention_count") + 1, "confidence": F.lit(1.0)})
    out = dream.absorb(g.with_(entities=g.entities.unionByName(more)), _pairs_of_variants(spark, d).select("name", "primary"), None, False)
    return out.entities.select("name", "mention_count", "confidence", "aliases")


# Store, snapshots, syncs


@query(_WITH + "SELECT 'entities' AS kind, count(*) AS n FROM e UNION ALL SELECT 'relationships', count(*) FROM r UNION ALL SELECT 'memory_ids', count(*) FROM e UNION ALL SELECT 'version', 3 UNION ALL SELECT 'schema', 2")
def store_commits(spark, d):
    """A graph committed, schema steps applied, one table written again: the others stay where they were."""
    store = Store(spark, _new_folder(spark, "store"))
    g = fixtures.graph(spark, d)
    store.commit_graph(g)
    schema = store.migrate(AS_OF)
    store.commit(entities=store.table("entities").withColumn("confidence", F.lit(0.5)))
    store.vacuum()
    n = lambda t: store.table(t).agg(F.lit(t).alias("kind"), F.count("*").alias("n"))
    fixed = spark.createDataFrame([("version", store.version()), ("schema", schema)], "kind string, n long")
    return n("entities").unionByName(n("relationships")).unionByName(n("memory_ids")).unionByName(fixed)


@query("SELECT CAST(1 AS BIGINT) AS version, 'base tables' AS description, 'drop all tables' AS rollback_sql UNION ALL SELECT 2, 'canonical names, session state, embeddings', 'drop canonical_name, session_state, embeddings'")
def schema_steps(spark, d):
    store = Store(spark, _new_folder(spark, "store"))
    store.migrate(AS_OF)
    store.migrate(AS_OF + timedelta(days=1))  # nothing left to do
    return store.table("schema_meta").select("version", "description", "rollback_sql")


@query(_WITH + "SELECT CAST(24 AS BIGINT) AS hours_later, CAST(2 AS BIGINT) AS n_backups, (SELECT count(*) FROM e) AS entity_count")
def last_backup(spark, d):
    store, g = Store(spark, _new_folder(spark, "store")), fixtures.graph(spark, d)
    for at in (AS_OF + timedelta(days=1), AS_OF):
        store.record_backup(jsonl.export_snapshot(g, _new_folder(spark, "snapshot"), at, 2))
    made = spark.createDataFrame([(int((store.last_backup() - AS_OF).total_seconds() // 3600),)], "hours_later long")
    return made.crossJoin(store.table("manifest").agg(F.count("*").alias("n_backups"), F.max("entity_count").alias("entity_count")))  # of one row each


@query(_WITH + "SELECT name, round(confidence, 6) AS confidence, mention_count FROM e")
def snapshot_file(spark, d):
    """A snapshot in one file, checked and read into an empty graph."""
    at = _new_folder(spark, "snapshot") + ".jsonl"
    jsonl.export_file(fixtures.graph(spark, d), at, AS_OF, 2)
    back = jsonl.import_snapshot(graph.Graph(*(graph.empty(spark, t) for t in ("entities", "relationships", "memory_ids"))), at)
    return back.entities.select("name", F.round("confidence", 6).alias("confidence"), "mention_count")


@query(_WITH + "SELECT 'entity' AS record_type, name AS a, '' AS b, CAST(NULL AS BIGINT) AS n FROM e UNION ALL SELECT 'relationship', source_name, target_name, NULL FROM r UNION ALL SELECT 'header', 'alpha', '', (SELECT count(*) FROM r)")
def sync_export(spark, d):
    folder = _new_folder(spark, "sync")
    at = jsonl.export_sync(fixtures.graph(spark, d), folder, "alpha", AS_OF)
    get = lambda k: F.get_json_object("value", f"$.{k}")
    return spark.read.text(at).select(F.coalesce(get("record_type"), F.lit("header")).alias("record_type"), F.coalesce(get("name"), get("source_name"), get("agent")).alias("a"), F.coalesce(get("target_name"), F.lit("")).alias("b"), get("relationship_count").cast("long").alias("n"))


@query(_WITH + ", o AS (SELECT *, substr(md5(name), 1, 1) < '8' AS held FROM e) SELECT 'entity' AS kind, name AS a, round(CASE WHEN held THEN confidence ELSE 0.25 END, 6) AS confidence FROM o UNION ALL SELECT 'edge', source_name || '|' || target_name || '|' || rel_type, round(confidence, 6) FROM r")
def sync_import(spark, d):
    """Another agent's file: what is there already stays, the rest enters."""
    g = fixtures.graph(spark, d)
    mine = g.with_(entities=g.entities.where(F.substring(F.md5("name"), 1, 1) < "8"), relationships=g.relationships.where("rel_type = 'part_of'"))
    theirs = g.with_(entities=g.entities.withColumn("confidence", F.lit(0.25)))
    at = jsonl.export_sync(theirs, _new_folder(spark, "sync"), "beta", AS_OF)
    out, _ = jsonl.merge_shared(mine, at, AS_OF)
    e = out.entities.select(F.lit("entity").alias("kind"), F.col("name").alias("a"), F.round("confidence", 6).alias("confidence"))
    return e.unionByName(out.relationships.select(F.lit("edge").alias("kind"), F.concat_ws("|", "source_name", "target_name", "rel_type").alias("a"), F.round("confidence", 6).alias("confidence")))


@query("SELECT 'alpha_graph.jsonl' AS file, true AS some UNION ALL SELECT 'beta_graph.jsonl', true")
def sync_status(spark, d):
    folder, g = _new_folder(spark, "sync"), fixtures.graph(spark, d)
    for agent in ("alpha", "beta"):
        jsonl.export_sync(g, folder, agent, AS_OF)
    return jsonl.sync_status(spark, folder).select("file", (F.col("bytes") > 0).alias("some"))


@query(_WITH + "SELECT 'entity' AS type, name AS a, type AS b FROM e UNION ALL SELECT 'relationship', source_name, target_name FROM r")
def backfill_export(spark, d):
    at = _new_folder(spark, "backfill")
    jsonl.export_backfill(fixtures.graph(spark, d), at)
    get = lambda k: F.get_json_object("value", f"$.{k}")
    return spark.read.text(at).select(get("type").alias("type"), F.coalesce(get("data.name"), get("data.source_name")).alias("a"), F.coalesce(get("data.type"), get("data.target_name")).alias("b"))


# Folders of files


def _folder_of_nations(spark, d):
    """A markdown file for every nation, and its name as a numbered message in the session of its region; one folder is an archive."""
    root = _new_folder(spark, "files")
    rows = _read(spark, d, "nation").join(_read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name", "r_regionkey").collect()  # 25 rows
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(sc._jsc.hadoopConfiguration())
    for r in rows:
        jsonl.write_text(spark, f"{root}/kb/{r.r_name}/{r.n_name}.md", f"# {r.n_name}\n\nin {r.r_name}\n")
        for session in (r.r_name, "_archive"):
            at = f"{root}/chats/{session}/{'messages/' if r.n_nationkey % 2 else ''}{r.n_nationkey}.txt"
            jsonl.write_text(spark, at, f"  {r.n_name}\n")
            fs.setTimes(path(at), int((AS_OF - datetime(1970, 1, 1)).total_seconds() * 1000) + r.r_regionkey * 1000, -1)
    return root


@query("SELECT n_name || '.md' AS file, CAST(strlen(n_name) + strlen(r_name) + 8 AS BIGINT) AS bytes FROM nation JOIN region ON n_regionkey = r_regionkey")
def markdown_files(spark, d):
    return files.markdown_files(spark, f"{_folder_of_nations(spark, d)}/kb").select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "bytes")


@query("SELECT n_name || '.md' AS file, '# ' || n_name || chr(10) || chr(10) || 'in ' || r_name || chr(10) AS text FROM nation JOIN region ON n_regionkey = r_regionkey")
def file_texts(spark, d):
    return files.file_texts(spark, f"{_folder_of_nations(spark, d)}/kb").select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "text")


@query("SELECT r_name AS session, CAST(row_number() OVER (ORDER BY r_regionkey DESC) AS INTEGER) AS place FROM region WHERE r_regionkey >= 1 AND r_regionkey IN (SELECT n_regionkey FROM nation)")
def chat_sessions(spark, d):
    """Sessions since a cutoff, the latest first."""
    got = files.chat_sessions(spark, f"{_folder_of_nations(spark, d)}/chats", AS_OF + timedelta(seconds=1)).collect()  # a session a region
    return spark.createDataFrame([(r.session, i) for i, r in enumerate(got, 1)], "session string, place int")


@query("SELECT r_name AS session, string_agg(n_name, chr(10) || chr(10) ORDER BY n_nationkey % 2 DESC, n_nationkey) AS text FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def session_texts(spark, d):
    return files.session_texts(spark, f"{_folder_of_nations(spark, d)}/chats").select("session", "text")


# Streams


@query(
    "WITH m AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), w AS (SELECT conv_id, n, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS t FROM m WHERE n >= 3 AND turn >= n - 15 GROUP BY ALL) "
    "SELECT CAST(conv_id AS VARCHAR) AS session_id, n AS msg_index, md5(t) AS hash FROM w WHERE length(t) >= 50"
)
def stream_windows(spark, d):
    """All conversations as a stream of files, to its end: the windows that reach the store, each once."""
    root = _new_folder(spark, "stream")
    c = _read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("idx"), "role", "text")
    c.write.json(f"{root}/in")

    def store(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    writer = streaming.ingest(streaming.read_messages(spark, f"{root}/in", 1_000_000), store, f"{root}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(streaming.PROMPT).parquet(f"{root}/out").select("session_id", "msg_index", F.md5("text").alias("hash"))


@query("SELECT col0 AS step, col1 AS outcome FROM (VALUES (1, 'done'), (2, 'failed'), (3, 'failed'), (4, 'failed'), (5, 'open'), (6, 'done'))")
def stream_breaker(spark, d):
    """Three failures in a row open the breaker until its time is over."""
    now = [0.0]
    guard = streaming.Breaker(3, 300.0, lambda: now[0])

    def fails():
        raise RuntimeError("no store")

    seen = [guard.call(lambda: None), *(guard.call(fails) for _ in range(3)), guard.call(lambda: None)]
    now[0] = 301.0
    return spark.createDataFrame(list(enumerate([*seen, guard.call(lambda: None)], 1)), "step int, outcome string")


@query("SELECT i AS batch, i > 0 AND i % 50 = 0 AS dreams, i % 6 = 0 AS decays FROM (SELECT unnest(range(0, 101)) AS i)")
def triggers(spark, d):
    """Maintenance after every fiftieth batch; decay every six hours of batches an hour apart."""
    due, rows, last = streaming.every(50), [], None
    for i in range(101):
        now = AS_OF + timedelta(hours=i)
        decays = dream.decay_due(last, now)
        last = now if decays else last
        rows.append((i, due(i), decays))
    return spark.createDataFrame(rows, "batch long, dreams boolean, decays boolean")
