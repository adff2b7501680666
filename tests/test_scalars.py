"""Golden vectors of the scalar functions, written from the rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weft.functions import names, texts


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column).first()[0]


def test_normalize(spark):
    rows = [(1, "  A\t b  "), (2, "Ｄｏｃｋｅｒ"), (3, ""), (4, None), (5, "é x")]
    got = {r.id: r.n for r in names.normalize(spark.createDataFrame(rows, "id int, n string"), "n").collect()}
    assert got == {1: "A b", 2: "Docker", 3: "", 4: "", 5: "é x"}


@pytest.mark.parametrize(
    ("name", "why"),
    [("Docker", "ok"), ("docker", "not_proper_noun"), ("api", "ok"), ("X", "too_short"), ("A" * 101, "too_long"), ("123", "no_letter"), ("/Tmp", "forbidden_prefix:/"), ("Http Thing", "forbidden_prefix:http"), ("Main.py", "forbidden_pattern"), ("Model 2024", "forbidden_pattern"), ("small ring", "ok"), ("Customer#000000000", "forbidden_pattern"), ("", "empty")],
)
def test_reason(spark, name, why):
    assert one(spark, name, names.reason(F.col("x"))) == why


@pytest.mark.parametrize(("text", "labels"), [("a@b.co", ["email"]), ("Task-Runner", ["api_key"]), ("A" * 32, ["token"]), ("a" * 32, []), ("Docker", []), ("x@y.zz sk-1", ["email", "api_key"])])
def test_pii(spark, text, labels):
    assert one(spark, text, names.pii(F.col("x"))) == labels


@pytest.mark.parametrize(
    ("name", "strict", "loose"),
    [("Acme Inc.", "acme", "acme"), ("The Beatles", "beatles", "beatles"), ("Theory", "theory", "ory"), ("Foo Corporation", "foo", "foo oration"), ("C++", "c", "c"), ("Node.js", "nodejs", "nodejs")],
)
def test_canonical(spark, name, strict, loose):
    assert one(spark, name, names.canonical(F.col("x"))) == strict
    assert one(spark, name, names.canonical(F.col("x"), "loose")) == loose


def test_types(spark):
    for name, kind, want in (("Docker", "person", "technology"), ("Python", "language", "language"), ("Foo", "tool", "tool")):
        assert one(spark, name, names.corrected_type(F.col("x"), F.lit(kind))) == want
    assert one(spark, "gadget", names.coerced(F.col("x"), names.ENTITY_TYPES, "concept")) == "concept"


@pytest.mark.parametrize(("given", "want"), [("5", 1.0), ("0.01", 0.1), (None, 0.5), ("much", None), ("0.7", 0.7), ("NaN", None)])
def test_clamp(spark, given, want):
    assert one(spark, given, names.clamped(F.col("x"))) == want


def test_keywords_and_terms(spark):
    text = "What is the relationship between Docker and docker Kubernetes?"
    assert one(spark, text, texts.keywords("x")) == ["relationship", "Docker", "Kubernetes"]
    assert one(spark, "Docker foo_bar", texts.match_text("x")) == "docker* OR foo_bar*"
    assert one(spark, "", texts.keywords("x")) == []


@pytest.mark.parametrize(("text", "question", "code"), [("What is Docker exactly?", True, False), ("What is it?", False, False), ("Please explain import rules", True, True), (None, False, False)])
def test_questions(spark, text, question, code):
    assert one(spark, text, texts.is_question(F.col("x"))) is question
    assert one(spark, text, texts.has_code(F.col("x"))) is code


@pytest.mark.parametrize(("words", "n"), [(0, 0), (1, 1), (1500, 1), (1501, 2), (2850, 2), (2851, 3)])
def test_chunks(spark, words, n):
    got = one(spark, " ".join(f"w{i}" for i in range(words)), texts.chunks("x"))
    assert len(got) == n
    if n > 1:
        assert got[0].split()[-150:] == got[1].split()[:150]
        assert got[-1].split()[-1] == f"w{words - 1}"


def test_parsed(spark):
    good = '{"entities":[{"name":"Docker"}],"relationships":[]}'
    for raw in (good, f"```json\n{good}\n```", f"json {good}", f"```\n{good}```"):
        assert one(spark, raw, texts.parsed(F.col("x")))["entities"][0]["name"] == "Docker"
    for raw in ("no json", "[1, 2]", "", None, "```"):
        assert one(spark, raw, texts.parsed(F.col("x"))) is None


def test_rendering(spark):
    q = lambda c: one(spark, "d", c)
    n, t, m, c = F.lit("A"), F.lit("tool"), F.lit("work"), F.lit(0.5)
    assert q(texts.found_text(n, t, m, c, F.col("x"))) == "**A** (tool/work, conf=0.50)\n  d"
    assert q(texts.found_text(n, t, m, c, F.lit(""))) == "**A** (tool/work, conf=0.50)"
    assert q(texts.relation_text(n, t, m, c)) == "- A →[tool]→ work (conf=0.50)"
    assert q(texts.recalled_text(n, t, m, F.col("x"))) == "- **A** (tool/work): d"
    assert q(texts.context_text(n, t, m, F.repeat("x", 100))) == "- **A** (tool, work) — " + "d" * 80
    assert q(names.aliases_of(F.lit('["a", "b"]'))) == ["a", "b"]
    assert q(names.aliases_of(F.lit("{bad"))) == []
