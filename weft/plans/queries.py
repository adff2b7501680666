"""The registered queries over the graph views, and the SQL that each is held against."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import names, texts
from weft.functions.extract import RuleExtractor
from weft.operators import dream, fuzzy, graph, health, ingest, merge, recall, search
from weft.operators.components import shared_folder
from weft.sources import fixtures, jsonl

AS_OF = datetime(2024, 1, 31)
_E, _R, _A = (fixtures.duck(s) for s in (fixtures.ENTITIES_SQL, fixtures.EDGES_SQL, fixtures.ACTIVITY_SQL))

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_WITH = f"WITH e AS ({_E}), r AS ({_R}) "


@query(_WITH + "SELECT type, count(*) AS n FROM e GROUP BY type")
def stats_by_type(spark, d):
    return graph.by_count(fixtures.entities(spark, d), "type")


@query(_WITH + "SELECT domain, count(*) AS n FROM e GROUP BY domain")
def stats_by_domain(spark, d):
    return graph.by_count(fixtures.entities(spark, d), "domain")


@query(_WITH + "SELECT (SELECT count(*) FROM e) AS entity_count, (SELECT count(*) FROM r) AS relationship_count, CAST(0 AS BIGINT) AS schema_version")
def stats_counts(spark, d):
    g = fixtures.graph(spark, d)
    return graph.stats(g, graph.empty(spark, "schema_meta")).select("entity_count", "relationship_count", "schema_version")


@query(_WITH + "SELECT name, type, domain, confidence, mention_count, round(confidence * mention_count, 9) AS score FROM e WHERE confidence >= 0.3 ORDER BY score DESC, name LIMIT 10")
def top_entities(spark, d):
    return graph.top_entities(fixtures.entities(spark, d)).select("name", "type", "domain", "confidence", "mention_count", "score")


@query(_WITH + "SELECT source_name, target_name, rel_type, round(confidence, 6) AS confidence FROM r WHERE source_name = 'small ring' OR target_name = 'small ring' ORDER BY r.confidence DESC, source_name, target_name, rel_type LIMIT 20")
def entity_relationships(spark, d):
    return graph.relationships_of(fixtures.relationships(spark, d), "small ring").select("source_name", "target_name", "rel_type", F.round("confidence", 6).alias("confidence"))


_NEAR = """b AS (SELECT source_name AS name, target_name AS other, source_name, target_name, rel_type, confidence FROM r
  UNION ALL SELECT target_name, source_name, source_name, target_name, rel_type, confidence FROM r WHERE source_name <> target_name),
n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY confidence DESC, source_name, target_name, rel_type) AS edge_rank FROM b)"""


@query(_WITH + f", {_NEAR} SELECT name, CAST(edge_rank AS INTEGER) AS edge_rank, rel_type, other, round(confidence, 6) AS confidence FROM n WHERE edge_rank <= 5 AND name IN (SELECT name FROM e)")
def neighbourhoods(spark, d):
    g = fixtures.graph(spark, d)
    return graph.neighbourhood(g.entities, g.relationships, 5).select("name", "edge_rank", "rel_type", "other", F.round("confidence", 6).alias("confidence"))


_NAMES = "n AS (SELECT c_name AS name FROM customer UNION ALL SELECT p_name FROM part UNION ALL SELECT upper(substr(p_name, 1, 1)) || substr(p_name, 2) FROM part UNION ALL SELECT p_brand || ' Inc.' FROM part UNION ALL SELECT 'The ' || p_type || '  Limited' FROM part UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation UNION ALL SELECT DISTINCT text FROM conversations UNION ALL SELECT text FROM documents)"
_SQUEEZED = "trim(regexp_replace(name, '[ \\t\\n\\r\\v\\f]+', ' ', 'g'))"


def _names(spark, d):
    part, docs = _read(spark, d, "part"), _read(spark, d, "documents")
    p = part.select(F.explode(F.array(F.col("p_name"), F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substr(p_name, 2)")), F.concat("p_brand", F.lit(" Inc.")), F.concat(F.lit("The "), "p_type", F.lit("  Limited")))).alias("name"))
    rest = [_read(spark, d, t).select(F.col(c).alias("name")) for t, c in (("customer", "c_name"), ("region", "r_name"), ("nation", "n_name"))]
    rest += [_read(spark, d, "conversations").select(F.col("text").alias("name")).distinct(), docs.select(F.col("text").alias("name"))]
    for x in rest:
        p = p.unionByName(x)
    return p


_REASON = (
    "CASE WHEN name = '' THEN 'empty' WHEN length(name) < 2 THEN 'too_short' WHEN length(name) > 100 THEN 'too_long' WHEN upper(name) IN ("
    + ", ".join(f"'{t}'" for t in names.TECHNICAL)
    + ") THEN 'ok' WHEN NOT regexp_matches(name, '[A-Za-z]') THEN 'no_letter' "
    + " ".join(f"WHEN starts_with(lower(name), '{p}') THEN 'forbidden_prefix:{p}'" for p in (*"/#.{<", "http", "api/"))
    + r" WHEN regexp_matches(name, '(?i)\.py$|\.json$|\.env$|\.yaml$|\.md$|^/api/|^/health|^/v1/|^#|\d{4,}') THEN 'forbidden_pattern'"
    + r" WHEN NOT regexp_matches(name, '\p{Lu}') AND NOT regexp_matches(name, '\S\s+\S') THEN 'not_proper_noun' ELSE 'ok' END"
)


@query(f"WITH {_NAMES}, q AS (SELECT DISTINCT {_SQUEEZED} AS name FROM n) SELECT name, {_REASON} AS reason FROM q")
def name_validation(spark, d):
    return names.normalize(_names(spark, d), "name").distinct().select("name", names.reason(F.col("name")).alias("reason"))


@query(
    f"WITH {_NAMES}, l AS (SELECT name FROM n UNION ALL SELECT text FROM documents UNION ALL SELECT upper(md5(name)) FROM n UNION ALL SELECT 'sk-' || name FROM n), q AS (SELECT DISTINCT name FROM l) SELECT md5(name) AS id, "
    r"array_to_string(list_filter([CASE WHEN regexp_matches(name, '[\w.\-]+@[\w.\-]+\.\w+') THEN 'email' END, CASE WHEN regexp_matches(name, 'sk-|ghp_|hf_|nvapi-') THEN 'api_key' END, CASE WHEN regexp_matches(name, '(^|[^A-Za-z0-9])[A-Z0-9]{8}[A-Za-z0-9]{24,}') THEN 'token' END], lambda x: x IS NOT NULL), ',') AS labels FROM q"
)
def pii_detect(spark, d):
    n = _names(spark, d)
    rows = n.unionByName(_read(spark, d, "documents").select(F.col("text").alias("name"))).unionByName(n.select(F.upper(F.md5("name")).alias("name"))).unionByName(n.select(F.concat(F.lit("sk-"), "name").alias("name")))
    return rows.distinct().select(F.md5("name").alias("id"), F.array_join(names.pii(F.col("name")), ",").alias("labels"))


_TYPED = "t AS (SELECT name, type FROM (VALUES ('Docker', 'person'), ('Python', 'tool'), ('redis', 'concept'), ('Foo', 'gadget'), ('GitHub', 'organization'), ('Flask', 'nonsense')) AS v(name, type) UNION ALL SELECT p_name, p_type FROM part)"
_KNOWN = ", ".join(f"('{k}', '{v}')" for k, v in names.TYPE_OF.items())


@query(f"WITH {_TYPED}, k AS (SELECT * FROM (VALUES {_KNOWN}) AS v(low, known)), c AS (SELECT name, type, CASE WHEN type IN ({', '.join(repr(x) for x in names.ENTITY_TYPES)}) THEN type ELSE 'concept' END AS coerced FROM t) SELECT name, type, coalesce(known, coerced) AS final, coalesce(known, coerced) <> coerced AS corrected, count(*) AS n FROM c LEFT JOIN k ON lower(name) = low GROUP BY ALL")
def type_correction(spark, d):
    rows = spark.createDataFrame([("Docker", "person"), ("Python", "tool"), ("redis", "concept"), ("Foo", "gadget"), ("GitHub", "organization"), ("Flask", "nonsense")], "name string, type string")
    rows = rows.unionByName(_read(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("type")))
    coerced = names.coerced(F.col("type"), names.ENTITY_TYPES, "concept")
    final = names.corrected_type(F.col("name"), coerced)
    return rows.select("name", "type", final.alias("final"), (final != coerced).alias("corrected")).groupBy("name", "type", "final", "corrected").agg(F.count("*").alias("n"))


#: A lower-cased text as word runs and what is between them, so that whole words can be taken out in an engine without look-behind.
_RUNS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+')"
_DROPPED = "list_filter({}, lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in names.COMPANY) + "))"
_CUT = "list_transform({}, lambda x: regexp_replace(x, '^(the|inc|ltd|limited|corp)', ''))"


def form_sql(name: str, mode: str) -> str:
    kept = (_CUT if mode == "loose" else _DROPPED).format(_RUNS.format(name))
    others = "[^\\p{L}\\p{M}\\p{N} ]" if mode == "strict" else "[^a-z0-9 ]"
    return f"trim(regexp_replace(regexp_replace(array_to_string({kept}, ''), '{others}', '', 'g'), ' +', ' ', 'g'))"


def _canonical_sql(mode: str) -> str:
    return f"WITH {_NAMES}, u AS (SELECT DISTINCT name FROM n) SELECT md5(name) AS id, md5({form_sql('name', mode)}) AS form FROM u"


def _forms(spark, d, mode):
    return _names(spark, d).distinct().select(F.md5("name").alias("id"), F.md5(names.canonical(F.col("name"), mode)).alias("form"))


@query(_canonical_sql("strict"))
def canonical_strict(spark, d):
    return _forms(spark, d, "strict")


@query(_canonical_sql("ascii"))
def canonical_ascii(spark, d):
    return _forms(spark, d, "ascii")


@query(_canonical_sql("loose"))
def canonical_loose(spark, d):
    return _forms(spark, d, "loose")


_STOP = ", ".join(f"'{w}'" for w in texts.STOPWORDS)


@query(
    "WITH w AS (SELECT conv_id, turn, list_transform(regexp_split_to_array(text, '\\s+'), lambda x: regexp_replace(x, '[^a-zA-Z0-9_-]', '', 'g')) AS ws FROM conversations), "
    "x AS (SELECT conv_id, turn, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w), "
    f"k AS (SELECT conv_id, turn, lower(word) AS low, arg_min(word, i) AS word, min(i) AS i FROM x WHERE length(word) >= 2 AND lower(word) NOT IN ({_STOP}) GROUP BY ALL), "
    "t AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS r FROM k) "
    "SELECT c.conv_id, c.turn, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE r <= 5), '') AS keywords FROM conversations c LEFT JOIN t ON c.conv_id = t.conv_id AND c.turn = t.turn GROUP BY ALL"
)
def keywords(spark, d):
    return _read(spark, d, "conversations").select("conv_id", "turn", F.array_join(texts.keywords("text"), " ").alias("keywords"))


@query("SELECT conv_id, turn, array_to_string(list_transform(list_slice(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), 1, 5), lambda w: w || '*'), ' OR ') AS match FROM conversations")
def match_query(spark, d):
    return _read(spark, d, "conversations").select("conv_id", "turn", texts.match_text("text").alias("match"))


_ASKED = ("What is the {} thing?", "compare {}", "Tell me about {} please", "no {} here at all", "import {} from there, explain")


@query(
    "WITH m AS (SELECT text FROM conversations UNION ALL SELECT replace(q, '{}', p_name) FROM part, (VALUES " + ", ".join(f"('{q}')" for q in _ASKED) + ") AS v(q)), u AS (SELECT DISTINCT text FROM m) SELECT md5(text) AS id, "
    r"length(text) >= 15 AND (regexp_matches(text, '(?i)\b(what|who)\b.*\b(are|is|were|was)\b') OR regexp_matches(text, '(?i)\bhow\b.*\b(to|did|does|do)\b') OR regexp_matches(text, '(?i)\b(compare|explain|tell me about|(difference|relationship) between)\b')) AS is_question, "
    "list_bool_or(list_transform(['import ', 'from ', 'class ', 'def ', '```'], lambda k: contains(text, k))) AS has_code FROM u"
)
def question_filter(spark, d):
    part = _read(spark, d, "part").select(F.explode(F.array(*(F.replace(F.lit(q), F.lit("{}"), F.col("p_name")) for q in _ASKED))).alias("text"))
    rows = _read(spark, d, "conversations").select("text").unionByName(part).distinct()
    return rows.select(F.md5("text").alias("id"), texts.is_question(F.col("text")).alias("is_question"), texts.has_code(F.col("text")).alias("has_code"))


@query(
    "WITH w AS (SELECT doc_id, regexp_replace(text, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g') AS t FROM documents), s AS (SELECT doc_id, t, regexp_split_to_array(t, '[ \\t\\n\\r]+') AS ws FROM w WHERE t <> ''), "
    "c AS (SELECT doc_id, t, ws, unnest(range(0, CASE WHEN len(ws) <= 1500 THEN 1 ELSE 1 + CAST(ceil((len(ws) - 1500) / 1350.0) AS BIGINT) END)) AS i FROM s) "
    "SELECT doc_id, CAST(i AS INTEGER) AS chunk, md5(CASE WHEN len(ws) <= 1500 THEN t ELSE array_to_string(list_slice(ws, i * 1350 + 1, i * 1350 + 1500), ' ') END) AS hash FROM c"
)
def chunk_documents(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.posexplode(texts.chunks("text")).alias("chunk", "text")).select("doc_id", "chunk", F.md5("text").alias("hash"))


@query(
    "SELECT event_id, coalesce(array_to_string(TRY_CAST(a AS VARCHAR[]), ','), '') AS aliases FROM (SELECT event_id, CASE WHEN event_id % 3 < 2 THEN [event_type, props] ELSE [] END AS a FROM events)"
)
def alias_json(spark, d):
    coded = F.when(F.col("event_id") % 3 == 0, F.to_json(F.array("event_type", "props"))).when(F.col("event_id") % 3 == 1, F.to_json(F.array("event_type", "props"))).otherwise(F.concat(F.lit("["), "props"))
    return _read(spark, d, "events").select("event_id", F.array_join(names.aliases_of(coded), ",").alias("aliases"))


@query(
    "SELECT event_id, CASE WHEN c IS NULL THEN 0.5 WHEN TRY_CAST(c AS DOUBLE) IS NULL THEN NULL ELSE greatest(0.1, least(1.0, TRY_CAST(c AS DOUBLE))) END AS confidence FROM "
    "(SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(value AS VARCHAR) WHEN 1 THEN CAST(CAST(event_id % 100 AS DOUBLE) / 90 - 0.05 AS VARCHAR) WHEN 2 THEN event_type END AS c FROM events)"
)
def confidence_clamp(spark, d):
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.col("value").cast("string")).when(k == 1, ((F.col("event_id") % 100).cast("double") / 90 - F.lit(0.05)).cast("string")).when(k == 2, F.col("event_type"))
    return _read(spark, d, "events").select("event_id", names.clamped(raw).alias("confidence"))


_LIKED = ("small", "B_LT", "Customer%7", "%", "MACHINE", "supplier")
_LIKED_SQL = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(_LIKED)) + ") AS v(query_id, query))"


@query(
    _WITH + f", {_LIKED_SQL}, h AS (SELECT query_id, e.*, row_number() OVER (PARTITION BY query_id ORDER BY mention_count DESC, confidence DESC, name) AS rank FROM e, q WHERE name ILIKE '%' || query || '%' OR description ILIKE '%' || query || '%') "
    "SELECT query_id, CAST(rank AS INTEGER) AS rank, name, type, mention_count, confidence FROM h WHERE rank <= 10"
)
def search_like(spark, d):
    asked = spark.createDataFrame(list(enumerate(_LIKED)), "query_id int, query string")
    return search.like(fixtures.entities(spark, d), asked).select("query_id", "rank", "name", "type", "mention_count", "confidence")


_TOKENS = "list_filter(regexp_split_to_array(strip_accents(lower(coalesce({}, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_BM25 = f"""
d AS (SELECT e.*, list_concat({_TOKENS.format("name")}, {_TOKENS.format("description")}) AS ts FROM e),
corpus AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM d),
qw AS (SELECT query_id, unnest(list_slice(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+'), 1, 5)) AS p, generate_subscripts(list_slice(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+'), 1, 5), 1) AS i FROM q),
f AS (SELECT query_id, i, name, len(list_filter(ts, lambda t: starts_with(t, p))) AS f, len(ts) AS dl FROM (SELECT name, ts FROM d) JOIN qw ON true),
hit AS (SELECT *, count(*) OVER (PARTITION BY query_id, i) AS nq FROM f WHERE f > 0),
sc AS (SELECT query_id, name, round(sum(CASE WHEN ln((n - nq + 0.5) / (nq + 0.5)) > 0 THEN ln((n - nq + 0.5) / (nq + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM hit, corpus GROUP BY query_id, name)"""


def _part_queries(spark, d):
    return _read(spark, d, "part").select(F.col("p_name").alias("query_id"), F.concat("p_name", F.lit(" "), F.substring("p_type", 1, 3)).alias("query")).distinct()


_PART_Q = "q AS (SELECT DISTINCT p_name || p_type AS query_id, p_name || ' ' || substr(p_type, 1, 3) AS query FROM part)"


@query(
    _WITH + f", {_PART_Q}, {_BM25}, x AS (SELECT query_id, rk.name, score, mention_count, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mention_count DESC, rk.name) AS rank FROM sc rk JOIN e ON e.name = rk.name) SELECT query_id, CAST(rank AS INTEGER) AS rank, name, score FROM x WHERE rank <= 10"
)
def search_bm25(spark, d):
    asked = _read(spark, d, "part").select(F.concat("p_name", "p_type").alias("query_id"), F.concat("p_name", F.lit(" "), F.substring("p_type", 1, 3)).alias("query")).distinct()
    return search.search(fixtures.entities(spark, d), asked, using=fixtures.index(spark, d)).select("query_id", "rank", "name", "score")


_TOPIC = "q AS (SELECT DISTINCT p_name AS query_id, p_name AS query FROM part)"


@query(
    _WITH + f", {_TOPIC}, {_BM25}, x AS (SELECT query_id, e.name, e.type, e.domain, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mention_count DESC, sc.name) AS rank FROM sc JOIN e ON e.name = sc.name), {_NEAR} "
    "SELECT x.query_id, CAST(x.rank AS INTEGER) AS rank, x.name, x.type, x.domain, CAST(n.edge_rank AS INTEGER) AS edge_rank, n.rel_type, n.other, round(n.confidence, 6) AS confidence FROM x LEFT JOIN n ON n.name = x.name AND n.edge_rank <= 10 WHERE x.rank <= 5"
)
def insights(spark, d):
    asked = _read(spark, d, "part").select(F.col("p_name").alias("query_id"), F.col("p_name").alias("query")).distinct()
    return recall.insights(fixtures.graph(spark, d), asked, using=fixtures.index(spark, d)).withColumn("confidence", F.round("confidence", 6))


_MESSAGES = "m AS (SELECT p_partkey AS message_id, 'What is the ' || p_name || ' made by ' || p_brand || '?' AS text FROM part)"


def _messages(spark, d):
    return _read(spark, d, "part").select(F.col("p_partkey").alias("message_id"), F.concat(F.lit("What is the "), "p_name", F.lit(" made by "), "p_brand", F.lit("?")).alias("text"))


_KEYED = f"""
kw AS (SELECT message_id, unnest(regexp_split_to_array(text, '\\s+')) AS raw, generate_subscripts(regexp_split_to_array(text, '\\s+'), 1) AS i FROM m),
k2 AS (SELECT message_id, regexp_replace(raw, '[^a-zA-Z0-9_-]', '', 'g') AS w, i FROM kw),
k3 AS (SELECT message_id, arg_min(w, i) AS query, min(i) AS i FROM k2 WHERE length(w) >= 2 AND lower(w) NOT IN ({_STOP}) GROUP BY message_id, lower(w)),
k4 AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY i) AS word_at FROM k3), q AS (SELECT DISTINCT query AS query_id, query FROM k4 WHERE word_at <= 5)"""


@query(
    _WITH + f", {_MESSAGES}, {_KEYED}, {_BM25}, x AS (SELECT query_id, e.name, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mention_count DESC, sc.name) AS rank FROM sc JOIN e ON e.name = sc.name), "
    "l AS (SELECT query_id, e.name, row_number() OVER (PARTITION BY query_id ORDER BY mention_count DESC, confidence DESC, e.name) AS rank FROM q JOIN e ON e.name ILIKE '%' || query || '%' OR e.description ILIKE '%' || query || '%' WHERE query_id NOT IN (SELECT query_id FROM x)), "
    "a AS (SELECT * FROM x UNION ALL SELECT * FROM l), p AS (SELECT message_id, a.name, min((word_at, rank)) AS place FROM k4 JOIN a ON a.query_id = k4.query WHERE rank <= 3 AND word_at <= 5 GROUP BY ALL), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY place, substr(md5(name), 1, 16)) AS entity_rank FROM p), t AS (SELECT name, row_number() OVER (ORDER BY round(confidence * mention_count, 9) DESC, name) AS entity_rank FROM e WHERE confidence >= 0.3), "
    f"fin AS (SELECT message_id, name, entity_rank FROM o WHERE entity_rank <= 3 UNION ALL SELECT message_id, t.name, t.entity_rank FROM m, t WHERE t.entity_rank <= 3 AND message_id NOT IN (SELECT message_id FROM o)), {_NEAR}, "
    "c AS (SELECT message_id, concat_ws('→', source_name, rel_type, target_name) AS edge, min((entity_rank, edge_rank)) AS place FROM fin JOIN n ON n.name = fin.name WHERE edge_rank <= 5 GROUP BY ALL), "
    "g AS (SELECT message_id, edge, row_number() OVER (PARTITION BY message_id ORDER BY place) AS i FROM c) "
    "SELECT fin.message_id, string_agg(name, '|' ORDER BY entity_rank) AS entities, coalesce((SELECT string_agg(edge, '|' ORDER BY i) FROM g WHERE g.message_id = fin.message_id AND i <= 10), '') AS relationships FROM fin GROUP BY fin.message_id"
)
def recall_context(spark, d):
    got = recall.recall(fixtures.graph(spark, d), _messages(spark, d), using=fixtures.index(spark, d))
    return got.select("message_id", F.array_join("entities.name", "|").alias("entities"), F.array_join("relationships", "|").alias("relationships"))


@query(
    "WITH m AS (SELECT p_partkey AS message_id, 'What is the ' || p_name || '?' AS text FROM part UNION ALL SELECT p_partkey + 1000000, 'import the ' || p_name || ' and explain' FROM part), q AS (SELECT message_id FROM m WHERE NOT contains(text, 'import ')) SELECT count(*) AS n_messages, min(message_id) AS least FROM q"
)
def injection_gate(spark, d):
    p = _read(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("message_id"), F.concat(F.lit("What is the "), "p_name", F.lit("?")).alias("text")).unionByName(p.select((F.col("p_partkey") + 1000000).alias("message_id"), F.concat(F.lit("import the "), "p_name", F.lit(" and explain")).alias("text")))
    got = recall.injected(fixtures.entities(spark, d), rows, using=fixtures.index(spark, d))
    return got.agg(F.count("*").alias("n_messages"), F.min("message_id").alias("least"))


_BATCH = "b AS (SELECT name, row_number() OVER (ORDER BY conv_id, turn, name) AS seq, 0.3 + (conv_id % 7) / 10.0 AS confidence, CASE WHEN turn % 2 = 0 THEN 'turn ' || turn ELSE '' END AS description, conv_id FROM (SELECT DISTINCT conv_id, turn, name FROM (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS name FROM conversations) WHERE regexp_matches(name, '^[A-Z][a-z]{3,}$')))"


def _mention_batch(spark, d):
    m = fixtures.mentions(spark, d).distinct()
    seq = F.col("conv_id") * 100_000 + F.col("turn")  # records of one turn are told apart by name
    return m.select(
        "name", F.lit("concept").alias("type"), F.lit("general").alias("domain"), (F.lit(0.3) + (F.col("conv_id") % 7) / F.lit(10.0)).cast("double").alias("confidence"),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("turn "), F.col("turn").cast("string"))).otherwise("").alias("description"), F.array().cast("array<string>").alias("aliases"), F.col("conv_id").cast("string").alias("session_id"),
        F.lit(AS_OF).alias("seen_at"), seq.cast("long").alias("seq"),
    )


_LOOSE = form_sql("{}", "loose").replace("{}", "\0").replace("{", "{{").replace("}", "}}").replace("\0", "{}")


@query(
    _WITH + f", {_BATCH}, s AS (SELECT name, confidence, mention_count, description, {_LOOSE.format('name')} AS form FROM e), k AS (SELECT b.*, {_LOOSE.format('b.name')} AS form FROM b), "
    "f AS (SELECT form, min(name) AS by_form FROM s GROUP BY form), h AS (SELECT k.*, coalesce(s.name, by_form, first_value(k.name) OVER (PARTITION BY k.form ORDER BY seq)) AS target FROM k LEFT JOIN s ON s.name = k.name LEFT JOIN f ON f.form = k.form), "
    "g AS (SELECT target, count(*) AS n, max(confidence) AS c, arg_max(description, seq) FILTER (WHERE name = target AND description <> '') AS dn, arg_min(description, seq) AS d0 FROM h GROUP BY target) "
    "SELECT coalesce(s.name, target) AS name, coalesce(mention_count, 0) + coalesce(n, 0) AS mention_count, round(greatest(coalesce(confidence, 0), coalesce(c, 0)), 6) AS confidence, coalesce(dn, s.description, d0) AS description FROM s FULL JOIN g ON s.name = target"
)
def upsert_entities(spark, d):
    store = fixtures.entities(spark, d).withColumn("canonical_name", names.canonical(F.col("name"), "loose"))
    return merge.upsert_entities(store, _mention_batch(spark, d), "loose").select("name", "mention_count", F.round("confidence", 6).alias("confidence"), "description")


@query(
    _WITH + ", n AS (SELECT target_name AS source_name, source_name AS target_name, rel_type, confidence / 2 AS confidence FROM r UNION ALL SELECT source_name, target_name, rel_type, confidence * 1.5 FROM r WHERE rel_type = 'part_of'), "
    "u AS (SELECT *, 'fixture' AS doc FROM r UNION ALL SELECT *, 'new' FROM n) SELECT source_name, target_name, rel_type, round(max(confidence), 6) AS confidence, min(doc) AS source_doc FROM u GROUP BY ALL"
)
def upsert_relationships(spark, d):
    r = fixtures.relationships(spark, d)
    back = r.select(F.col("target_name").alias("source_name"), F.col("source_name").alias("target_name"), "rel_type", (F.col("confidence") / 2).alias("confidence"))
    more = r.where("rel_type = 'part_of'").select("source_name", "target_name", "rel_type", (F.col("confidence") * 1.5).alias("confidence"))
    new = back.unionByName(more).select("*", F.lit("new").alias("source_doc"), F.lit(AS_OF).alias("created_at"), F.lit(1).cast("long").alias("seq"))
    return merge.upsert_relationships(r, new).select("source_name", "target_name", "rel_type", F.round("confidence", 6).alias("confidence"), "source_doc")


_HALVES = "o AS (SELECT *, substr(md5(name), 1, 1) < '8' AS held FROM e), s AS (SELECT * FROM o WHERE held), i AS (SELECT name, round(confidence / 2, 6) AS confidence FROM o WHERE NOT held OR substr(md5(name), 2, 1) < '3')"


def _halves(spark, d):
    e = fixtures.entities(spark, d)
    held = F.substring(F.md5("name"), 1, 1) < "8"
    new = e.where(~held | (F.substring(F.md5("name"), 2, 1) < "3")).withColumn("confidence", F.round(F.col("confidence") / 2, 6))
    return e.where(held), new.withColumn("seq", F.xxhash64("name").bitwiseAND(F.lit(2**62 - 1)))


@query(_WITH + f", {_HALVES} SELECT coalesce(i.name, s.name) AS name, round(coalesce(i.confidence, s.confidence), 6) AS confidence FROM s FULL JOIN i ON s.name = i.name")
def import_last_wins(spark, d):
    return merge.import_last_wins(*_halves(spark, d)).select("name", F.round("confidence", 6).alias("confidence"))


@query(_WITH + f", {_HALVES} SELECT coalesce(i.name, s.name) AS name, round(coalesce(s.confidence, i.confidence), 6) AS confidence FROM s FULL JOIN i ON s.name = i.name")
def sync_first_wins(spark, d):
    return merge.sync_first_wins(*_halves(spark, d)).select("name", F.round("confidence", 6).alias("confidence"))


@query(f"WITH a AS ({_A}) SELECT name, round(CASE WHEN last_seen < TIMESTAMP '2024-01-24 00:00:00' AND confidence > 0.15 THEN greatest(0.15, confidence * 0.95) ELSE confidence END, 6) AS confidence FROM a")
def decay(spark, d):
    return dream.decay(fixtures.activity(spark, d), AS_OF).select("name", F.round("confidence", 6).alias("confidence"))


@query(f"WITH a AS ({_A}) SELECT name, round(CASE WHEN last_seen < TIMESTAMP '2024-01-24 00:00:00' AND confidence > 0.1 THEN greatest(0.1, confidence * 0.95) ELSE confidence END, 6) AS confidence FROM a")
def decay_scheduler_floor(spark, d):
    return dream.scheduled_decay(fixtures.activity(spark, d), AS_OF).select("name", F.round("confidence", 6).alias("confidence"))


_VARIANTS = (
    "v AS (SELECT name, confidence, mention_count FROM e UNION ALL SELECT 'The ' || name, confidence / 2, mention_count FROM e "
    "UNION ALL SELECT name || ' Inc.', confidence / 3, mention_count + 1 FROM e UNION ALL SELECT upper(name), confidence, 1 FROM e WHERE upper(name) <> name)"
)
_STRICT = form_sql("{}", "strict").replace("{}", "\0").replace("{", "{{").replace("}", "}}").replace("\0", "{}")


def _variants(spark, d):
    e = fixtures.entities(spark, d)
    forms = [(F.col("name"), F.col("confidence"), F.col("mention_count")), (F.concat(F.lit("The "), "name"), F.col("confidence") / 2, F.col("mention_count")), (F.concat("name", F.lit(" Inc.")), F.col("confidence") / 3, F.col("mention_count") + 1), (F.upper("name"), F.col("confidence"), F.lit(1).cast("long"))]
    out = None
    for i, (n, c, m) in enumerate(forms):
        one = e.where(F.upper("name") != F.col("name")) if i == 3 else e  # a name in upper case is there already
        one = one.withColumns({"name": n, "confidence": c, "mention_count": m})
        out = one if out is None else out.unionByName(one)
    return out.withColumns({"entity_id": names.entity_id(F.col("name")), "canonical_name": F.lit(None).cast("string")})


def _variant_graph(spark, d):
    e = _variants(spark, d)
    r = fixtures.relationships(spark, d)
    r = r.unionByName(r.withColumns({"target_name": F.concat("target_name", F.lit(" Inc.")), "confidence": F.col("confidence") / 2})).unionByName(r.withColumns({"target_name": F.upper("target_name"), "rel_type": F.lit("owns")}))
    return graph.Graph(e, r, e.select("entity_id", F.lit("m").alias("memory_id")))


_DUPES = f"{_VARIANTS}, p AS (SELECT *, {_STRICT.format('name')} AS form FROM v), w AS (SELECT *, first_value(name) OVER (PARTITION BY form ORDER BY length(name) DESC, substr(md5(name), 1, 16)) AS prime FROM p)"


@query(_WITH + f", {_DUPES} SELECT prime AS name, CAST(sum(mention_count) AS BIGINT) AS mention_count, round(max(confidence), 6) AS confidence, coalesce(string_agg(name, '|' ORDER BY name) FILTER (WHERE name <> prime), '') AS aliases FROM w GROUP BY prime")
def dedup_canonical(spark, d):
    return dream.dedup(_variant_graph(spark, d)).entities.select("name", "mention_count", F.round("confidence", 6).alias("confidence"), F.array_join("aliases", "|").alias("aliases"))


_TRIPLED = "u AS (SELECT source_name, target_name, rel_type, confidence FROM r UNION ALL SELECT source_name, target_name || ' Inc.', rel_type, confidence / 2 FROM r UNION ALL SELECT source_name, upper(target_name), 'owns', confidence FROM r)"


@query(
    _WITH + f", {_DUPES}, {_TRIPLED} SELECT coalesce(s.prime, source_name) AS source_name, coalesce(t.prime, target_name) AS target_name, rel_type, round(max(u.confidence), 6) AS confidence "
    "FROM u LEFT JOIN (SELECT DISTINCT name, prime FROM w) s ON s.name = u.source_name LEFT JOIN (SELECT DISTINCT name, prime FROM w) t ON t.name = u.target_name GROUP BY ALL"
)
def dedup_edges(spark, d):
    """All edges, both ends re-pointed."""
    return dream.dedup(_variant_graph(spark, d)).relationships.select("source_name", "target_name", "rel_type", F.round("confidence", 6).alias("confidence"))


@query(_WITH + ", k AS (SELECT name FROM e WHERE NOT (confidence < 0.15 AND mention_count <= 1)) SELECT source_name, target_name, rel_type, round(confidence, 6) AS confidence FROM r WHERE source_name IN (SELECT name FROM k) AND target_name IN (SELECT name FROM k)")
def prune_cascade(spark, d):
    return dream.prune(fixtures.graph(spark, d)).relationships.select("source_name", "target_name", "rel_type", F.round("confidence", 6).alias("confidence"))


@query(_WITH + ", k AS (SELECT name FROM e WHERE mention_count <> 1) SELECT source_name, target_name, rel_type, source_name NOT IN (SELECT name FROM k) AS no_source, target_name NOT IN (SELECT name FROM k) AS no_target FROM r WHERE source_name NOT IN (SELECT name FROM k) OR target_name NOT IN (SELECT name FROM k)")
def orphans(spark, d):
    g = fixtures.graph(spark, d)
    return health.orphans(g.relationships, g.entities.where("mention_count <> 1")).select("source_name", "target_name", "rel_type", "no_source", "no_target")


@query(_WITH + ", k AS (SELECT name FROM e WHERE mention_count <> 1), x AS (SELECT count(*) AS n FROM r WHERE source_name NOT IN (SELECT name FROM k) OR target_name NOT IN (SELECT name FROM k)) SELECT CASE WHEN n > 0 THEN 'degraded' ELSE 'healthy' END AS status, (SELECT count(*) FROM k) AS entities, (SELECT count(*) FROM r) AS relationships, n AS orphans FROM x")
def health_check(spark, d):
    g = fixtures.graph(spark, d)
    return health.check(g.with_(entities=g.entities.where("mention_count <> 1"))).select("status", "entities", "relationships", "orphans")


@query(_WITH + ", t AS (SELECT * FROM r WHERE rel_type IN ('depends_on', 'part_of', 'runs_on')) SELECT a.source_name, b.target_name, a.rel_type, count(*) AS n_paths FROM t a JOIN t b ON a.target_name = b.source_name AND a.rel_type = b.rel_type WHERE a.source_name <> b.target_name AND NOT EXISTS (SELECT 1 FROM t c WHERE c.source_name = a.source_name AND c.target_name = b.target_name AND c.rel_type = a.rel_type) GROUP BY ALL")
def infer_transitive(spark, d):
    return dream.inferred(fixtures.relationships(spark, d))


@query(
    _WITH.replace("WITH ", "WITH RECURSIVE ", 1) + ", b AS (SELECT source_name, target_name FROM r WHERE rel_type = 'part_of' UNION SELECT r_name, 'WORLD' FROM region), "
    "c AS (SELECT * FROM b UNION SELECT c.source_name, b.target_name FROM c JOIN b ON c.target_name = b.source_name) SELECT * FROM c"
)
def infer_closure(spark, d):
    """Every part_of edge, the customers' too."""
    r = fixtures.relationships(spark, d).where("rel_type = 'part_of'")
    world = _read(spark, d, "region").select(F.col("r_name").alias("source_name"), F.lit("WORLD").alias("target_name"), F.lit("part_of").alias("rel_type"), F.lit(0.9).alias("confidence"), F.lit("fixture").alias("source_doc"), F.lit(AS_OF).alias("created_at"))
    return dream.closure(graph.Graph(fixtures.entities(spark, d), r.unionByName(world), graph.empty(spark, "memory_ids")), AS_OF).relationships.select("source_name", "target_name")


@query(_WITH + ", s AS (SELECT session_id, count(*) AS n FROM e WHERE session_id IS NOT NULL GROUP BY ALL) SELECT name, round(least(1.0, confidence + coalesce((n - 1) * 0.05, 0)), 6) AS confidence FROM e LEFT JOIN s ON s.session_id = e.session_id")
def strengthen_sessions(spark, d):
    e = fixtures.entities(spark, d)
    return dream.strengthen(e, dream.boosts_by_session(e, 1)).select("name", F.round("confidence", 6).alias("confidence"))


@query("WITH m AS (SELECT DISTINCT conv_id, name FROM (SELECT conv_id, unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS name FROM conversations) WHERE regexp_matches(name, '^[A-Z][a-z]{3,}$')) SELECT x.name AS a, y.name AS b, count(*) AS n_sessions FROM m x JOIN m y ON x.conv_id = y.conv_id AND x.name < y.name GROUP BY ALL HAVING count(*) >= 3")
def strengthen_mentions(spark, d):
    return dream.together(fixtures.mentions(spark, d).select(F.col("name").alias("entity"), F.col("conv_id").alias("session")))


@query(
    "WITH s AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE conv_id % 3 END AS last FROM (SELECT DISTINCT conv_id FROM conversations)), m AS (SELECT c.*, last, count(*) OVER (PARTITION BY c.conv_id) AS n FROM conversations c JOIN s ON s.conv_id = c.conv_id), "
    "w AS (SELECT conv_id, n, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS t FROM m WHERE n >= 3 AND turn >= coalesce(last, 0) AND (last IS NULL OR n - last >= 3) AND turn >= n - 15 GROUP BY ALL) SELECT CAST(conv_id AS VARCHAR) AS session_id, n AS msg_index, md5(t) AS hash FROM w WHERE length(t) >= 50"
)
def session_window(spark, d):
    c = _read(spark, d, "conversations")
    states = c.select(F.col("conv_id").cast("string").alias("session_id"), (F.col("conv_id") % 3).alias("last_extracted_msg_index")).distinct().where("last_extracted_msg_index > 0")
    got = ingest.session_windows(c.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("idx"), "role", "text"), states)
    return got.select("session_id", "msg_index", F.md5("text").alias("hash"))


def _checkpoint(spark, d):
    failed = F.col("n_chars") < 200
    return _read(spark, d, "documents").select("source", F.col("doc_id").cast("string").alias("file_path"), F.when(failed, "failed").otherwise("processed").alias("status"), (F.col("n_chars") % 11).alias("entities_extracted"), (F.col("n_chars") % 5).alias("entities_rejected"), (F.col("n_chars") % 7).alias("relationships_extracted"), F.lit(None).cast("string").alias("error_message"), F.lit(AS_OF).alias("processed_at"))


@query("SELECT source, CAST(doc_id AS VARCHAR) AS file_path FROM documents WHERE NOT (doc_id % 3 < 2 AND n_chars >= 200)")
def checkpoint_resume(spark, d):
    files = _read(spark, d, "documents").select("source", F.col("doc_id").cast("string").alias("file_path"))
    return merge.unprocessed(files, _checkpoint(spark, d).where("CAST(file_path AS BIGINT) % 3 < 2"))  # the others were never tried


@query("SELECT source, count(*) FILTER (WHERE n_chars >= 200) AS n_processed, count(*) FILTER (WHERE n_chars < 200) AS n_failed, CAST(sum(n_chars % 11) AS BIGINT) AS entities, CAST(sum(n_chars % 5) AS BIGINT) AS rejected, CAST(sum(n_chars % 7) AS BIGINT) AS relationships FROM documents GROUP BY source")
def phase_stats(spark, d):
    return merge.phase_stats(_checkpoint(spark, d))


@query("SELECT source, CAST(sum(n_chars % 11) AS BIGINT) AS entities, CAST(sum(n_chars % 5) AS BIGINT) AS rejected, round(sum(n_chars % 5) / sum(n_chars % 11 + n_chars % 5), 6) AS rejection_rate, CAST(0.4 AS DOUBLE) AS target, sum(n_chars % 5) / sum(n_chars % 11 + n_chars % 5) > 0.4 AS alert FROM documents GROUP BY source")
def rejection_alert(spark, d):
    return merge.rejection_rates(merge.phase_stats(_checkpoint(spark, d)))


@query("WITH q AS (SELECT vec_id AS query_id, embedding AS vector FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(vector AS DOUBLE[])), 6) AS cosine FROM embeddings, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM s) SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, cosine FROM r WHERE rank <= 5")
def embedding_cosine(spark, d):
    """Every row whose id is divisible by 50 against all rows."""
    v = _read(spark, d, "embeddings")
    return search.similar(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))).select("query_id", "rank", "vec_id", "cosine")


@query()
def fuzzy_dedup(spark, d):
    """All entities, and variants of the part names. No SQL: the sequence matcher. Held against a naive loop in the tests."""
    e = fixtures.entities(spark, d)
    more = _variants(spark, d).where("type = 'technology'").join(e.select("name"), "name", "left_anti")
    return fuzzy.leaders(e.unionByName(more.select(e.columns)))


@query("SELECT 'entities' AS \"table\", CAST(0 AS BIGINT) AS n_different UNION ALL SELECT 'relationships', 0 UNION ALL SELECT 'memory_ids', 0")
def export_roundtrip(spark, d):
    """Writes a snapshot, reads it into an empty graph, and counts what differs (nothing)."""
    import uuid

    g = fixtures.graph(spark, d)
    at = f"{shared_folder(spark)}/snapshot-{uuid.uuid4().hex}"
    jsonl.export_snapshot(g, at, AS_OF, 2)
    back = jsonl.import_snapshot(graph.Graph(*(graph.empty(spark, t) for t in ("entities", "relationships", "memory_ids"))), at)
    both = [("entities", g.entities, back.entities), ("relationships", g.relationships, back.relationships), ("memory_ids", g.memory_ids, back.memory_ids)]
    out = None
    for name, a, b in both:
        left, right = a.select(F.xxhash64(*a.columns).alias("h")), b.select(F.xxhash64(*a.columns).alias("h"))
        one = left.exceptAll(right).unionByName(right.exceptAll(left)).agg(F.lit(name).alias("table"), F.count("*").alias("n_different"))
        out = one if out is None else out.unionByName(one)
    return out


def _extracted_sql(prompts: str) -> str:
    """Names and pairs that the rule extractor finds in ``prompts`` (source, seq, text): f (source, seq, name, n) and p (source, seq, a, b)."""
    return (
        f"x AS ({prompts}), s AS (SELECT source, seq, unnest(regexp_split_to_array(text, '[.!?\\n]')) AS sentence, generate_subscripts(regexp_split_to_array(text, '[.!?\\n]'), 1) AS line FROM x), "
        "o AS (SELECT source, seq, line, regexp_extract_all(sentence, '\\b[A-Z][A-Za-z]{3,}\\b') AS ws FROM s), i AS (SELECT source, seq, line, unnest(ws) AS name, generate_subscripts(ws, 1) AS i FROM o), "
        "u AS (SELECT source, seq, line, name, min(i) AS i FROM i GROUP BY ALL), f AS (SELECT source, seq, name, count(*) AS n FROM u GROUP BY ALL), "
        "l AS (SELECT source, seq, name AS a, lead(name) OVER (PARTITION BY source, seq, line ORDER BY i) AS b FROM u), p AS (SELECT DISTINCT source, seq, a, b FROM l WHERE b IS NOT NULL)"
    )


_WINDOWS = (
    "SELECT CAST(conv_id AS VARCHAR) AS source, CAST('0x' || substr(md5(CAST(conv_id AS VARCHAR) || chr(31) || CAST(n AS VARCHAR)), 1, 15) AS BIGINT) AS seq, t AS text FROM "
    "(SELECT conv_id, n, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS t FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE n >= 3 AND turn >= n - 15 GROUP BY ALL) WHERE length(t) >= 50"
)


@query(
    f"WITH {_extracted_sql(_WINDOWS)}, k AS (SELECT *, CASE WHEN {form_sql('name', 'strict')} = '' THEN '#' || name ELSE {form_sql('name', 'strict')} END AS form FROM f), t AS (SELECT *, first_value(name) OVER (PARTITION BY form ORDER BY seq, name) AS target FROM k) "
    "SELECT target AS name, 'concept' AS type, 'general' AS domain, count(*) AS mention_count, round(CAST(max(least(1.0, 0.4 + 0.1 * n)) AS DOUBLE), 6) AS confidence FROM t GROUP BY target"
)
def ingest_conversations(spark, d):
    """Windows of all sessions, whole, through the rule extractor into an empty graph; its entities."""
    c = _read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("idx"), "role", "text")
    empty = graph.Graph(*(graph.empty(spark, t) for t in ("entities", "relationships", "memory_ids")))
    g, _, _ = ingest.ingest_sessions(empty, graph.empty(spark, "session_state"), c, RuleExtractor(), AS_OF, chars=None)
    return g.entities.select("name", "type", "domain", "mention_count", F.round("confidence", 6).alias("confidence"))


_CHUNKED = (
    "SELECT source || chr(31) || CAST(doc_id AS VARCHAR) AS source, i AS seq, CASE WHEN len(ws) <= 1500 THEN t ELSE array_to_string(list_slice(ws, i * 1350 + 1, i * 1350 + 1500), ' ') END AS text FROM "
    "(SELECT source, doc_id, t, ws, unnest(range(0, n)) AS i FROM (SELECT source, doc_id, t, ws, CASE WHEN len(ws) <= 1500 THEN 1 ELSE 1 + CAST(ceil((len(ws) - 1500) / 1350.0) AS BIGINT) END AS n FROM "
    "(SELECT source, doc_id, text, t, regexp_split_to_array(t, '[ \\t\\n\\r]+') AS ws FROM (SELECT source, doc_id, text, regexp_replace(text, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g') AS t FROM documents)) WHERE length(trim(text)) >= 50) WHERE n <= 50)"
)


@query(
    f"WITH {_extracted_sql(_CHUNKED)}, e AS (SELECT source, count(*) AS n FROM f GROUP BY source), r AS (SELECT source, count(*) AS n FROM p GROUP BY source), "
    "d AS (SELECT source, source || chr(31) || CAST(doc_id AS VARCHAR) AS key, length(trim(text)) < 50 AS short FROM documents), "
    "c AS (SELECT d.source, CASE WHEN short OR coalesce(e.n, 0) > 0 THEN 'processed' ELSE 'failed' END AS status, coalesce(e.n, 0) AS en, coalesce(r.n, 0) AS rn FROM d LEFT JOIN e ON e.source = d.key LEFT JOIN r ON r.source = d.key) "
    "SELECT source, status, count(*) AS n, CAST(sum(en) AS BIGINT) AS entities, CAST(sum(rn) AS BIGINT) AS relationships FROM c GROUP BY source, status"
)
def backfill_documents(spark, d):
    """All documents through chunking and the rule extractor, which sees whole chunks; the checkpoint by status."""
    files = _read(spark, d, "documents").select("source", F.col("doc_id").cast("string").alias("file_path"), "text")
    empty = graph.Graph(*(graph.empty(spark, t) for t in ("entities", "relationships", "memory_ids")))
    _, done = ingest.backfill(empty, graph.empty(spark, "checkpoint"), files, RuleExtractor(), AS_OF, chars=None)
    return done.groupBy("source", "status").agg(F.count("*").alias("n"), F.sum("entities_extracted").alias("entities"), F.sum("relationships_extracted").alias("relationships"))


@query(
    _WITH + ", k AS (SELECT name FROM e WHERE NOT (confidence < 0.15 AND mention_count <= 1)), c AS (SELECT * FROM r WHERE source_name IN (SELECT name FROM k) AND target_name IN (SELECT name FROM k)), t AS (SELECT * FROM c WHERE rel_type IN ('depends_on', 'part_of', 'runs_on')), "
    "n AS (SELECT DISTINCT a.source_name, b.target_name, a.rel_type FROM t a JOIN t b ON a.target_name = b.source_name AND a.rel_type = b.rel_type WHERE a.source_name <> b.target_name AND NOT EXISTS (SELECT 1 FROM t x WHERE x.source_name = a.source_name AND x.target_name = b.target_name AND x.rel_type = a.rel_type)) "
    "SELECT (SELECT count(*) FROM k) AS entity_count, (SELECT count(*) FROM c) + (SELECT count(*) FROM n) AS relationship_count"
)
def dream_cycle(spark, d):
    """One cycle over the entity view, which holds no duplicates; counts after it."""
    g, report = dream.cycle(fixtures.graph(spark, d), AS_OF, threshold=1)
    failed = [r for r in report if r[1].startswith("error")]
    if failed:
        raise RuntimeError(str(failed))
    return graph.stats(g, graph.empty(spark, "schema_meta")).select("entity_count", "relationship_count")
