"""The name queries over whole texts and names with any characters, against plain Python."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pytest

from weft.plans import registry

LONG = "Word " * 60 + "mail someone@example.com of The Café Ltd."
TURN = "hello there, this is Zoë of The Inc. at zoe@example.org"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("names")
    for table, schema, *rows in (
        ("part", "p_name string, p_brand string, p_type string", ("small ring", "Brand#1", "TIN")),
        ("customer", "c_name string", ("Émile Limited",)),
        ("region", "r_name string", ("ASIA",)),
        ("nation", "n_name string", ("CHINA",), ("NATION THÉ INC",)),
        ("conversations", "text string", (TURN,)),
        ("documents", "text string", (LONG,)),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{table}.parquet")
    return str(at)


def form(name, mode):
    pattern = r"\b(the|inc|ltd|limited|corp)\.?" if mode == "loose" else r"\b(the|inc|ltd|limited|corporation|corp)\b\.?"
    bare = re.sub(pattern, "", name.lower().strip())
    kept = [c for c in bare if c == " " or (unicodedata.category(c)[0] in "LMN" if mode == "strict" else c in "abcdefghijklmnopqrstuvwxyz0123456789")]
    return re.sub(" +", " ", "".join(kept)).strip()


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_whole_names(spark, tables):
    run = registry.queries()
    every = {"small ring", "Small ring", "Brand#1 Inc.", "The TIN  Limited", "Émile Limited", "ASIA", "CHINA", "NATION THÉ INC", TURN, LONG}
    for mode in ("strict", "ascii", "loose"):
        assert {(r.id, r.form) for r in run[f"canonical_{mode}"](spark, tables).collect()} == {(md5(x), md5(form(x, mode))) for x in every}
    reasons = {r.name: r.reason for r in run["name_validation"](spark, tables).collect()}
    assert reasons[LONG] == "too_long" and reasons[TURN] == "ok" and "Émile Limited" in reasons
    labels = {r.id: r.labels for r in run["pii_detect"](spark, tables).collect()}
    assert labels[md5(TURN)] == labels[md5(LONG)] == "email"
    assert labels[md5("sk-" + LONG)] == "email,api_key"
