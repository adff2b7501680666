"""Extraction of entities and relationships: pluggable extractors, and the rules that their answers pass."""

from __future__ import annotations

import json
import logging
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions import names, texts


class Extractor(Protocol):
    """Turns prompts into raw answers; called in the workers, on whole batches."""

    def __call__(self, prompts: list[str]) -> list[str]: ...


class RuleExtractor:
    """A deterministic extractor without a model: capitalised words are entities, neighbours in a sentence are related.

    All of them, unless limits are given.
    """

    def __init__(self, most_entities: int | None = None, most_relationships: int | None = None):
        self.most_entities, self.most_relationships = most_entities, most_relationships

    def __call__(self, prompts: list[str]) -> list[str]:
        return [self._one(p) for p in prompts]

    def _one(self, prompt: str) -> str:
        found: dict[str, int] = {}
        edges: dict[tuple[str, str], int] = {}
        for sentence in re.split(r"[.!?\n]", prompt):
            own = list(dict.fromkeys(re.findall(r"\b[A-Z][A-Za-z]{3,}\b", sentence, re.ASCII)))
            for n in own:
                found[n] = found.get(n, 0) + 1
            for a, b in zip(own, own[1:], strict=False):
                edges[a, b] = edges.get((a, b), 0) + 1
        best = sorted(found, key=lambda n: (-found[n], n))[: self.most_entities]
        taken = set(best)
        kept = [(a, b) for a, b in sorted(edges, key=lambda e: (-edges[e], e)) if a in taken and b in taken][: self.most_relationships]
        entity = lambda n: {"name": n, "type": "concept", "domain": "general", "description": "", "confidence": min(1.0, 0.4 + 0.1 * found[n]), "aliases": []}
        return json.dumps({"entities": [entity(n) for n in best], "relationships": [{"source": a, "target": b, "type": "related_to", "confidence": 0.5} for a, b in kept]})


class JsonExtractor:
    """Passes answers that were made elsewhere through."""

    def __call__(self, prompts: list[str]) -> list[str]:
        return prompts


class Retried:
    """An extractor asked again, ``times`` in all and after waits that double, when it raises; what still fails has the answer ''.

    '' doesn't parse: it is counted as failed, and its source is tried again by a later run.  A batch
    that raises is asked prompt by prompt, so that one bad prompt costs no other its answer.
    ``between``: least seconds from one call to the next.
    """

    def __init__(self, inner: Extractor, times: int = 3, wait: float = 1.0, between: float = 0.0, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.inner, self.times, self.wait, self.between, self.sleep, self.clock = inner, times, wait, between, sleep, clock
        self.last: float | None = None

    def __call__(self, prompts: list[str]) -> list[str]:
        try:
            return self._asked(prompts)
        except Exception as e:  # noqa: BLE001  whatever a model's client raises
            logging.getLogger(__name__).warning("extractor failed on %d prompts: %s", len(prompts), e)
            return [""] if len(prompts) == 1 else [x for p in prompts for x in self([p])]

    def _asked(self, prompts: list[str]) -> list[str]:
        for k in range(self.times):
            if self.last is not None and (early := self.between - (self.clock() - self.last)) > 0:
                self.sleep(early)
            self.last = self.clock()
            try:
                return self.inner(prompts)
            except Exception:  # noqa: BLE001
                if k == self.times - 1:
                    raise
                self.sleep(self.wait * 2**k)
        return []


def responses(prompts: DataFrame, extractor: Extractor, text_col: str = "text", chars: int | None = texts.PROMPT_CHARS) -> DataFrame:
    """``prompts`` and ``raw``: the extractor's answer to the first ``chars`` characters of each text (None: to all of it)."""
    cut = prompts if chars is None else prompts.withColumn(text_col, texts.prompt_text(F.col(text_col), chars))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(raw=extractor([t or "" for t in pdf[text_col]]))

    return cut.mapInPandas(run, T.StructType([*cut.schema.fields, T.StructField("raw", T.StringType())]))


def _answers(answers: DataFrame, keys: list[str]) -> DataFrame:
    """The keys and ``answer``, which is parsed from ``raw`` unless it is there."""
    return answers.select(*keys, "answer" if "answer" in answers.columns else texts.parsed(F.col("raw")).alias("answer"))


def entity_records(answers: DataFrame, keys: list[str]) -> DataFrame:
    """The keys, and name, type, domain, description, confidence, aliases, status of every proposed entity.

    ``status`` is 'ok' or why it may not enter: the name's broken rule, 'pii', 'low_confidence' or 'bad_confidence'.
    """
    each = _answers(answers, keys).select(*keys, F.explode("answer.entities").alias("r"))
    rows = names.normalize(each.where("r IS NOT NULL").select(*keys, "r.*"), "name")
    rows = rows.withColumns({
        "type": names.corrected_type(F.col("name"), names.coerced(F.col("type"), names.ENTITY_TYPES, "concept")),
        "domain": names.coerced(F.col("domain"), names.DOMAINS, "general"),
        "description": F.coalesce("description", F.lit("")),
        "aliases": F.coalesce("aliases", F.array().cast("array<string>")),
        "confidence": names.clamped(F.col("confidence")),
    })
    why = names.reason(F.col("name"))
    status = F.when(why != "ok", why).when(F.size(names.pii(F.col("name"))) > 0, "pii").when(F.col("confidence").isNull(), "bad_confidence").when(F.col("confidence") < names.MIN_CONFIDENCE, "low_confidence").otherwise("ok")
    return rows.withColumn("status", status)


def relationship_records(answers: DataFrame, keys: list[str]) -> DataFrame:
    """The keys, and source_name, target_name, rel_type, confidence of every relationship with clean, non-empty ends."""
    each = _answers(answers, keys).select(*keys, F.explode("answer.relationships").alias("r")).where("r IS NOT NULL")
    rows = each.select(*keys, F.col("r.source").alias("source_name"), F.col("r.target").alias("target_name"), names.coerced(F.col("r.type"), names.REL_TYPES, "related_to").alias("rel_type"), names.clamped(F.col("r.confidence")).alias("confidence"))
    rows = names.normalize(names.normalize(rows, "source_name"), "target_name")
    clean = (F.size(names.pii(F.col("source_name"))) == 0) & (F.size(names.pii(F.col("target_name"))) == 0)
    return rows.where(clean & (F.col("source_name") != "") & (F.col("target_name") != "") & F.col("confidence").isNotNull())
