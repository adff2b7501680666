"""Text scalars: keywords, search terms, question and code detection, model-response repair, chunks, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STOPWORDS = tuple(
    sorted(
        set(
            """a about above after all also am an and any are at be been before being below between but by can could did do does down during
            each explain few for from get give go going had has have here how if in into is it its just like made make may me might more most
            must need no nor not now off on only or other out over own same should show so some such tell than that the their them then there
            these they this those through to too under up use using very want was were what when where which who whom whose why with would""".split()
        )
    )
)

_QUESTION = "|".join(
    [rf"\b{word}\b.*\b({verbs})\b" for word, verbs in (("what", "is|are|was|were"), ("who", "is|are|was|were"), ("how", "do|does|did|to"))]
    + [rf"\b{phrase}\b" for phrase in ("explain", "compare", "tell me about", "relationship between", "difference between")]
)
_CODE = "```|def |class |import |from "

CHUNK_TOKENS, OVERLAP_TOKENS, WORDS_PER_TOKEN, MAX_CHUNKS = 2000, 200, 0.75, 50
PROMPT_CHARS = 8000

RESPONSE = (
    "struct<entities:array<struct<name:string,type:string,domain:string,description:string,confidence:string,aliases:array<string>>>,"
    "relationships:array<struct<source:string,target:string,type:string,confidence:string>>,_bad:string>"
)


def _sql(column: str, text: str) -> Column:
    return F.expr(text.replace("{c}", column))


def keywords(column: str, most: int = 5) -> Column:
    """The first ``most`` words that aren't stopwords, stripped to [A-Za-z0-9_-], first spelling of each."""
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    return _sql(
        column,
        "aggregate(filter(transform(split({c}, '(?U)\\\\s+'), w -> regexp_replace(w, '[^a-zA-Z0-9_-]', '')), "
        f"w -> length(w) >= 2 AND NOT array_contains(array({stop}), lower(w))), CAST(array() AS array<string>), "
        f"(acc, w) -> CASE WHEN size(acc) >= {most} OR exists(acc, a -> lower(a) = lower(w)) THEN acc ELSE array_append(acc, w) END)",
    )


def prefix_terms(column: str, most: int = 5) -> Column:
    """The first ``most`` word runs of a query, lower-cased."""
    return _sql(column, f"slice(regexp_extract_all(lower({{c}}), '(?U)\\\\w+', 0), 1, {most})")


def match_text(column: str) -> Column:
    """The prefix query of a text: ``docker* OR redis*``."""
    return F.array_join(F.transform(prefix_terms(column), lambda w: F.concat(w, F.lit("*"))), " OR ")


def is_question(text: Column, least: int = 15) -> Column:
    return F.coalesce((F.length(text) >= least) & text.rlike(f"(?i){_QUESTION}"), F.lit(False))


def has_code(text: Column) -> Column:
    return F.coalesce(text.rlike(_CODE), F.lit(False))


def unfenced(raw: Column) -> Column:
    """A model's answer without code fences and a leading 'json'."""
    plain = raw.startswith("{") & raw.endswith("}")  # as most are: the expressions below leave it as it is, at a cost for each character
    bare = F.regexp_replace(raw, r"^(?U)\s+|\s+$", "")
    fence = F.when(bare.startswith("```"), F.when(bare.contains("\n"), F.regexp_replace(bare, r"^[^\n]*\n", "")).otherwise(F.expr("NULL"))).otherwise(bare)
    fence = F.coalesce(fence, F.regexp_replace(bare, "^```", ""))
    bare = F.trim(F.regexp_replace(F.regexp_replace(fence, "```$", ""), r"^(?U)\s+|\s+$", ""))
    return F.when(plain, raw).otherwise(F.regexp_replace(bare, r"^json(?U)\s*", ""))


def parsed(raw: Column) -> Column:
    """The answer as a struct; null where it isn't a JSON object of that shape."""
    bare = unfenced(raw)
    value = F.from_json(bare, RESPONSE, {"columnNameOfCorruptRecord": "_bad"})
    return F.when(bare.startswith("{") & value["_bad"].isNull(), value)


def prompt_text(text: Column, chars: int = PROMPT_CHARS) -> Column:
    return F.substring(text, 1, chars)


def chunks(column: str, tokens: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> Column:
    """The text as it is, trimmed, or runs of words that overlap; blank texts have none."""
    size, lap = int(tokens * WORDS_PER_TOKEN), int(overlap * WORDS_PER_TOKEN)
    step = max(1, size - lap)
    trimmed = "regexp_replace({c}, '^[ \\\\t\\\\n\\\\r]+|[ \\\\t\\\\n\\\\r]+$', '')"
    # The one-element arrays bind the trimmed text and its words, so that either is computed once.
    return _sql(
        column,
        f"flatten(transform(array({trimmed}), t -> flatten(transform(array(split(t, '[ \\\\t\\\\n\\\\r]+')), w -> "
        f"CASE WHEN t IS NULL OR t = '' THEN CAST(array() AS array<string>) WHEN size(w) <= {size} THEN array(t) "
        f"ELSE transform(sequence(0, CAST(ceil((size(w) - {size}) / {step}) AS INT)), i -> array_join(slice(w, i * {step} + 1, {size}), ' ')) END))))",
    )


def edge_text(source: Column, rel: Column, target: Column) -> Column:
    return F.concat_ws("→", source, rel, target)


def found_text(name: Column, kind: Column, domain: Column, confidence: Column, description: Column) -> Column:
    """An entity as the search action shows it."""
    head = F.format_string("**%s** (%s/%s, conf=%.2f)", name, kind, domain, confidence)
    return F.when(F.coalesce(description, F.lit("")) != "", F.concat(head, F.lit("\n  "), description)).otherwise(head)


def relation_text(source: Column, rel: Column, target: Column, confidence: Column) -> Column:
    return F.format_string("- %s →[%s]→ %s (conf=%.2f)", source, rel, target, confidence)


def recalled_text(name: Column, kind: Column, domain: Column, description: Column) -> Column:
    head = F.format_string("- **%s** (%s/%s)", name, kind, domain)
    return F.when(F.coalesce(description, F.lit("")) != "", F.concat(head, F.lit(": "), description)).otherwise(head)


def context_text(name: Column, kind: Column, domain: Column, description: Column, chars: int = 80) -> Column:
    head = F.format_string("- **%s** (%s, %s)", name, kind, domain)
    return F.when(F.coalesce(description, F.lit("")) != "", F.concat(head, F.lit(" — "), F.substring(description, 1, chars))).otherwise(head)
