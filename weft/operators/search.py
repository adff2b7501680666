"""Ranked full-text search over entity names and descriptions: prefix queries, BM25, substring fallback.

Queries come as a table (query_id, query), so one plan answers any number of them.  All joins are
equi-joins: prefixes meet terms through the prefixes of the distinct vocabulary, of the lengths that are
asked for, and substrings meet texts through their rarest three characters.  The exception is a
substring query without three plain characters in a row: it is compared with every entity.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.operators.components import shared_table
from weft.operators.graph import top_by

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
QUERY_WORDS = 5

_MARKED = [chr(c) for c in range(0xC0, 0x180) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and chr(c) == chr(c).lower()]
_PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in _MARKED)


def fold(text: Column) -> Column:
    """Lower case, Latin letters without their marks."""
    return F.translate(F.lower(text), "".join(_MARKED), _PLAIN)


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(fold(text), F.lit("")), r"[^\p{L}\p{N}]+"), "")


def postings(entities: DataFrame) -> DataFrame:
    """term, entity_id, tf, length: one row a distinct term of an entity; length: all its tokens."""
    e = entities.select("entity_id", F.concat(tokens(F.col("name")), tokens(F.col("description"))).alias("tokens"))
    each = e.select("entity_id", F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
    return each.groupBy("term", "entity_id").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


@dataclass(frozen=True)
class Index:
    """What searches read in place of the texts: postings, and entities in number (n) and mean length. Kept beside the entities by ``Store.commit_graph``."""

    postings: DataFrame
    n: int
    mean: float


def index(entities: DataFrame) -> Index:
    """The index of a table of entities, in the shared folder."""
    lengths = entities.select((F.size(tokens(F.col("name"))) + F.size(tokens(F.col("description")))).alias("length"))
    n, mean = lengths.agg(F.count("*"), F.avg("length")).first()
    return Index(shared_table(postings(entities)), n, mean or 0.0)


def _phrases(queries: DataFrame, words: int) -> DataFrame:
    """query_id, phrase (its tokens), head (all but the last) and prefix (the last) of each of the first query words."""
    found = F.slice(F.regexp_extract_all(F.lower("query"), F.lit(r"(?U)\w+"), F.lit(0)), 1, words)
    each = queries.select("query_id", F.posexplode(found).alias("word_at", "word"))
    split = each.select("query_id", "word_at", tokens(F.col("word")).alias("phrase")).where("size(phrase) > 0")
    return split.select("query_id", "word_at", F.expr("slice(phrase, 1, size(phrase) - 1)").alias("head"), F.element_at("phrase", -1).alias("prefix"))


def _adjoining(entities: DataFrame, hits: DataFrame) -> DataFrame:
    """Of phrases whose last token an entity holds: how often all tokens adjoin there, in the name or the description."""
    columns = entities.select("entity_id", F.array(tokens(F.col("name")), tokens(F.col("description"))).alias("columns"))
    places = "aggregate(columns, 0L, (acc, c) -> acc + size(filter(sequence(1, greatest(size(c) - size(head), 1)), i -> slice(c, i, size(head)) = head AND startswith(coalesce(try_element_at(c, i + size(head)), ''), prefix))))"
    return hits.join(columns, "entity_id").withColumn("f", F.expr(places)).where("f > 0").select("query_id", "word_at", "entity_id", "f", "length")


def scores(entities: DataFrame, queries: DataFrame, words: int = QUERY_WORDS, using: Index | None = None) -> DataFrame:
    """query_id, entity_id, score of every entity that matches a word of the query.

    A word that holds separators is a phrase whose last token is a prefix; its tokens must adjoin.
    ``using``: the entities' index, where there is one already.
    """
    using = using or index(entities)
    p = shared_table(_phrases(queries, words))
    wanted = p.select("prefix").distinct()
    sizes = [r[0] for r in p.select(F.length("prefix")).distinct().collect()]  # as many as there are lengths of words
    heads = F.filter(F.array(*(F.lit(n) for n in sorted(sizes))), lambda n: n <= F.length("term")) if sizes else F.array().cast("array<int>")
    vocabulary = using.postings.select("term").distinct().select("term", F.explode(heads).alias("n")).select("term", F.expr("substring(term, 1, n)").alias("prefix"))
    matched = vocabulary.join(wanted, "prefix")
    hits = shared_table(using.postings.join(matched, "term").groupBy("prefix", "entity_id").agg(F.sum("tf").alias("f"), F.first("length").alias("length")))
    spread = hits.groupBy("prefix").agg(F.count("*").alias("n_q"))
    found = p.where("size(head) = 0").join(spread, "prefix").join(hits, "prefix").select("query_id", "word_at", "entity_id", "f", "length", "n_q")
    phrases = p.where("size(head) > 0")
    if not phrases.isEmpty():
        near = shared_table(_adjoining(entities, phrases.join(hits, "prefix")))
        found = found.unionByName(near.join(near.groupBy("query_id", "word_at").agg(F.count("*").alias("n_q")), ["query_id", "word_at"]))
    idf = F.log((F.lit(using.n) - F.col("n_q") + 0.5) / (F.col("n_q") + 0.5))
    idf = F.when(idf > 0, idf).otherwise(F.lit(LEAST_IDF))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.lit(using.mean)))
    return found.groupBy("query_id", "entity_id").agg(F.round(F.sum(part), 6).alias("score"))


def _filtered(entities: DataFrame, domain: str | None, etype: str | None) -> DataFrame:
    if domain is not None:
        entities = entities.where(F.col("domain") == domain)
    return entities if etype is None else entities.where(F.col("type") == etype)


def ranked(entities: DataFrame, queries: DataFrame, limit: int = 10, domain: str | None = None, etype: str | None = None, using: Index | None = None) -> DataFrame:
    """query_id, rank, score and the entity's columns: best score first, then mentions, then name."""
    hits = scores(entities, queries, using=using).join(_filtered(entities, domain, etype), "entity_id")
    return top_by(hits, ["query_id"], [F.desc("score"), F.desc("mention_count"), F.col("name")], limit)


GRAM = 3


def _grams(text: str) -> str:
    """SQL: the distinct runs of ``GRAM`` characters of a text, in lower case; none of a shorter one."""
    low = f"lower({text})"
    return f"CASE WHEN length({low}) < {GRAM} THEN CAST(array() AS array<string>) ELSE array_distinct(transform(sequence(1, length({low}) - {GRAM - 1}), i -> substring({low}, i, {GRAM}))) END"


def _run_grams(run: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(run) - (GRAM - 1)), lambda i: F.lower(F.substring(run, i, F.lit(GRAM))))


def like(entities: DataFrame, queries: DataFrame, limit: int = 10, domain: str | None = None, etype: str | None = None) -> DataFrame:
    """Entities whose name or description holds the whole query; % and _ in it are wildcards. Score is null.

    A query with three plain ASCII characters in a row meets only entities that hold its rarest such run,
    by an equi-join, and is compared with those; the others, which may match anything, with every entity.
    """
    e = _filtered(entities, domain, etype)
    q = queries.select("query_id", "query", F.expr(r"concat('%', replace(query, '\\', '\\\\'), '%')").alias("__pattern"))
    runs = F.filter(F.split("query", r"[%_\\\\]|[^\x00-\x7F]"), lambda r: F.length(r) >= GRAM)
    q = shared_table(q.withColumn("__grams", F.array_distinct(F.flatten(F.transform(runs, _run_grams)))))
    hold = F.expr("name ILIKE __pattern OR description ILIKE __pattern")
    some = q.where("size(__grams) > 0")
    none = F.array().cast("array<string>")
    held = e.select("entity_id", F.explode(F.array_union(F.coalesce(F.expr(_grams("name")), none), F.coalesce(F.expr(_grams("description")), none))).alias("__gram"))
    asked = some.select("query_id", F.explode("__grams").alias("__gram"))
    wanted = shared_table(held.join(asked.select("__gram").distinct(), "__gram", "left_semi"))
    spread = wanted.groupBy("__gram").agg(F.count("*").alias("__n"))
    rarest = asked.join(spread, "__gram", "left").groupBy("query_id").agg(F.min_by("__gram", F.struct(F.coalesce("__n", F.lit(0)), F.col("__gram"))).alias("__gram"))
    near = wanted.join(rarest, "__gram").select("query_id", "entity_id").join(some.select("query_id", "__pattern"), "query_id").join(e, "entity_id").where(hold)
    free = e.join(q.where("size(__grams) = 0").select("query_id", "__pattern"), hold)
    out = near.select("query_id", *e.columns).unionByName(free.select("query_id", *e.columns))
    return top_by(out.withColumn("score", F.lit(None).cast("double")), ["query_id"], [F.desc("mention_count"), F.desc("confidence"), F.col("name")], limit)


def search(entities: DataFrame, queries: DataFrame, limit: int = 10, domain: str | None = None, etype: str | None = None, using: Index | None = None) -> DataFrame:
    """``ranked``; the queries that have no ranked result take ``like`` instead."""
    first = shared_table(ranked(entities, queries, limit, domain, etype, using))
    rest = shared_table(queries.join(first.select("query_id").distinct(), "query_id", "left_anti"))
    if rest.isEmpty():
        return first
    return first.unionByName(like(entities, rest, limit, domain, etype).select(first.columns))


#: Rows, and cosines, that a task holds at once.
ROWS, CELLS = 2048, 2**20


def similar(embeddings: DataFrame, wanted: DataFrame, limit: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 2048) -> DataFrame:
    """query_id, rank, id, cosine: the embeddings nearest to each of ``wanted`` (query_id, vector), exactly.

    The queries are held against all rows in blocks: block by block they are written to the shared folder
    and read by the tasks, which keep the best ``limit`` of what each has seen, so that only those are
    shuffled.  Vectors that are null, empty, of another length than the query's, or 0 match nothing.
    """
    spark = embeddings.sparkSession
    n = wanted.count()
    blocks = max(1, -(-n // block))
    q = shared_table(wanted.select("query_id", F.col("vector").cast("array<double>").alias("vector")).where("query_id IS NOT NULL AND size(vector) > 0").withColumn("__block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))))
    kind = q.schema["query_id"].dataType
    id_type = embeddings.schema[id_col].dataType
    rows = embeddings.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND size(v) > 0")
    out_type = T.StructType([T.StructField("query_id", kind), T.StructField(id_col, id_type), T.StructField("cosine", T.DoubleType())])
    parts = []
    for k in range(blocks):
        asked = q.where(F.col("__block") == k).select("query_id", "vector").toPandas()  # ``block`` rows, about
        if not len(asked):
            continue
        sent = spark.sparkContext.broadcast((asked["query_id"].tolist(), [np.asarray(v, float) for v in asked["vector"]]))
        parts.append(rows.mapInPandas(_nearest(sent, limit, id_col), out_type))
    if not parts:
        return spark.createDataFrame([], T.StructType([out_type[0], T.StructField("rank", T.IntegerType()), *out_type[1:]]))
    pairs = parts[0]
    for x in parts[1:]:
        pairs = pairs.unionByName(x)
    return top_by(pairs, ["query_id"], [F.desc("cosine"), F.col(id_col)], limit)


def _nearest(sent, limit: int, id_col: str):
    """For mapInPandas: the best rows of a task for each query, with ties at the last place."""

    def run(batches):
        ids, vectors = sent.value
        by_size: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            by_size.setdefault(len(v), []).append(i)
        unit = {n: np.stack([vectors[i] for i in which]) for n, which in by_size.items()}
        norm = {n: np.linalg.norm(m, axis=1) for n, m in unit.items()}
        best: dict[tuple[int, int], pd.DataFrame] = {}
        for pdf in (whole.iloc[k : k + ROWS] for whole in batches for k in range(0, len(whole), ROWS)):
            sizes = pdf["v"].map(len)
            for n, which in by_size.items():
                own = pdf[sizes == n]
                if not len(own):
                    continue
                m = np.stack(own["v"].to_numpy())
                length = np.linalg.norm(m, axis=1)
                step = CELLS // ROWS
                for start in range(0, len(which), step):
                    some = slice(start, start + step)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        cosine = unit[n][some] @ m.T
                        cosine /= norm[n][some, None]
                        cosine /= length
                    np.round(cosine, 6, out=cosine)
                    cosine[~np.isfinite(cosine)] = -np.inf
                    k = min(limit, cosine.shape[1])
                    cut = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, cosine.shape[1] - k]
                    row, col = np.nonzero((cosine >= cut[:, None]) & np.isfinite(cosine))
                    new = pd.DataFrame({"q": np.asarray(which[some])[row], "id": own["id"].to_numpy()[col], "cosine": cosine[row, col]})
                    both = pd.concat([best[n, start], new]) if (n, start) in best else new
                    best[n, start] = both.sort_values(["q", "cosine", "id"], ascending=[True, False, True]).groupby("q").head(limit)
        for found in best.values():
            yield pd.DataFrame({"query_id": [ids[i] for i in found["q"]], id_col: found["id"].to_numpy(), "cosine": found["cosine"].to_numpy()})

    return run
