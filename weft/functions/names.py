"""Entity names: normal form, canonical forms, validation, PII, types; and small scalars of the extraction record.

Everything is a Column built from JVM expressions.  The one exception is Unicode compatibility
normalisation, which Spark lacks: rows that need it take an Arrow UDF, see ``normalize``.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITY_TYPES = ("concept", "framework", "language", "location", "organization", "person", "project", "skill", "technology", "tool")
DOMAINS = ("general", "personal", "platform", "research", "work")
REL_TYPES = ("alternative_to", "built_with", "competes_with", "depends_on", "owns", "part_of", "predecessor_of", "related_to", "runs_on", "uses")
TRANSITIVE = ("depends_on", "part_of", "runs_on")

#: Names accepted whatever the later rules say; compared with the upper-cased name.
TECHNICAL = tuple(sorted(set("API AWQ AWS BF16 CD CI CPU CSS CUDA DNS FAISS FP16 FP8 GCP GGUF GPT GPTQ GPU HDD HTML JSON LLM MIG NCCL NLP PCIE PR RAG RAM REST SQL SSD SSH SSL TDD TLS TOML VLLM YAML".split())))
TYPE_OF = {
    **dict.fromkeys(("docker", "k8s", "kubernetes", "linux", "neo4j", "nginx", "postgres", "redis", "sqlite"), "technology"),
    **dict.fromkeys(("faiss", "git", "github", "litellm", "ollama"), "tool"),
    **dict.fromkeys(("asyncio", "fastapi", "flask"), "framework"),
    "python": "language",
}

MIN_NAME, MAX_NAME, MIN_CONFIDENCE = 2, 100, 0.3
_PREFIXES = (*"/#.{<", "http", "api/")
_BAD = r"(?iU)\.(py|json|env|yaml|md)$|^/(api/|health|v1/)|^#|\d{4,}"

COMPANY = ("the", "inc", "ltd", "limited", "corporation", "corp")
_WORD = r"[\p{L}\p{N}_]"
_COMPANY = {
    "strict": rf"(?<!{_WORD})({'|'.join(COMPANY)})(?!{_WORD})\.?",
    "ascii": rf"(?<!{_WORD})({'|'.join(COMPANY)})(?!{_WORD})\.?",
    "loose": rf"(?<!{_WORD})(the|inc|ltd|limited|corp)\.?",
}
_KEPT = {"strict": r"[^\p{L}\p{M}\p{N} ]", "ascii": "[^a-z0-9 ]", "loose": "[^a-z0-9 ]"}


@F.pandas_udf(T.StringType())
def _nfkc(names: pd.Series) -> pd.Series:
    return names.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def squeeze(name: Column) -> Column:
    """Trimmed, runs of white space as one space; null is ''."""
    return F.coalesce(F.trim(F.regexp_replace(name, r"(?U)[\s\x1c-\x1f]+", " ")), F.lit(""))


def normalize(df: DataFrame, column: str, to: str | None = None) -> DataFrame:
    """``df`` with the normal form of ``column`` in ``to``: NFKC, then ``squeeze``.

    ASCII names stay in the JVM; only the rows that hold other characters pass through Python.
    """
    to = to or column
    ascii_only = F.coalesce(~F.col(column).rlike(r"[^\x00-\x7F]"), F.lit(True))
    plain = df.where(ascii_only).withColumn(to, squeeze(F.col(column)))
    other = df.where(~ascii_only).withColumn(to, squeeze(_nfkc(F.col(column))))
    return plain.unionByName(other)


def canonical(name: Column, mode: str = "strict") -> Column:
    """Lower case without company suffixes, articles and punctuation.

    ``strict`` takes whole words only and keeps letters and digits of any script; ``ascii`` keeps
    a to z and 0 to 9 alone, as existing stores do; ``loose`` does so, too, and strips suffixes from the
    front of longer words ("theory" becomes "ory"), as their upsert path does.
    """
    bare = F.regexp_replace(F.trim(F.lower(name)), _COMPANY[mode], "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, _KEPT[mode], ""), " +", " "))


def reason(name: Column) -> Column:
    """'ok', or the first rule that the (normalised) name breaks."""
    low = F.lower(name)
    out = F.when(F.coalesce(name, F.lit("")) == "", "empty").when(F.length(name) < MIN_NAME, "too_short").when(F.length(name) > MAX_NAME, "too_long")
    out = out.when(F.upper(name).isin(*TECHNICAL), "ok").when(~name.rlike("[A-Za-z]"), "no_letter")
    for p in _PREFIXES:
        out = out.when(low.startswith(p), f"forbidden_prefix:{p}")
    return out.when(name.rlike(_BAD), "forbidden_pattern").when(~name.rlike(r"\p{Lu}") & ~name.rlike(r"(?U)\S\s+\S"), "not_proper_noun").otherwise("ok")


def pii(text: Column) -> Column:
    """Labels found, in the order email, api_key, token."""
    found = [
        F.when(text.rlike(r"(?U)[\w\-.]+@[\w\-.]+\.\w+"), "email"),
        F.when(text.rlike("sk-|ghp_|hf_|nvapi-"), "api_key"),
        F.when(text.rlike("(?<![A-Za-z0-9])[A-Z0-9]{8}[A-Za-z0-9]{24,}"), "token"),
    ]
    return F.array_compact(F.array(*found))


def acceptable(name: Column, confidence: Column) -> Column:
    """Whether a (normalised) name may enter the graph."""
    return (confidence >= MIN_CONFIDENCE) & (reason(name) == "ok") & (F.size(pii(name)) == 0)


def corrected_type(name: Column, proposed: Column, known: dict[str, str] = TYPE_OF) -> Column:
    """The type that the map knows for the lower-cased name, else the one proposed."""
    known = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(name)), proposed)


def coerced(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(default)


def clamped(confidence: Column, default: float = 0.5) -> Column:
    """Within 0.1 and 1.0; a missing one is ``default``. A value that is no number is null: its record is rejected."""
    number = confidence.try_cast("double")
    return F.when(confidence.isNull(), F.lit(default)).when(number.isNull() | F.isnan(number), F.lit(None).cast("double")).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(1.0), number)))


def entity_id(name: Column) -> Column:
    """16 hex digits that depend on the name alone."""
    return F.substring(F.md5(name), 1, 16)


def sequence(*columns: str) -> Column:
    """A number below 2**60 that depends on the values alone: an order of records that no run changes."""
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *columns)), 1, 15), 16, 10).cast("long")


def aliases_of(text: Column) -> Column:
    """An alias list from JSON text; bad JSON is an empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
