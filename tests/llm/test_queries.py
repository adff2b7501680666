"""The registered queries run over small tables, and agree with their SQL."""

from __future__ import annotations

import random
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from weft.llm import queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(8)
    at = tmp_path_factory.mktemp("sf")
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6)))
    passage = " ".join(word() for _ in range(80))
    rows = [(i, "\n".join(" ".join(word() for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 6))) + (f" {passage}" if i % 9 == 0 else "")) for i in range(80)]
    rows += [(200, "| a | b | c"), (201, ""), (202, "LOUD! WORDS! IN! A! ROW! AND! MORE! OF! THEM!")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 4 // 3) for i in range(0, 80, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    hosts = ["www.spam-farm.example.net", "ok.example.org", "casino-win.example.com"]
    spark.createDataFrame([(i, f"https://{rng.choice(hosts)}/p{i % 7}/{'?q=1' * (i % 2)}", "<p>") for i in range(40)], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return str(at)


@pytest.mark.parametrize("name", [*queries.QUERIES])
def test_query(spark, tables, name):
    df = queries.QUERIES[name](spark, tables)
    got = [r.asDict() for r in df.collect()]
    if name not in queries.ORACLES:
        return
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet/*.parquet')")
    r = con.execute(queries.ORACLES[name])
    cols = [c[0] for c in r.description]
    assert sorted(cols) == sorted(df.columns)
    key = lambda row: sorted((k, str(v)) for k, v in row.items())
    assert sorted(map(key, got)) == sorted(key(dict(zip(cols, x, strict=True))) for x in r.fetchall())


def test_entry_lists_them():
    names = list(entry.queries())
    assert {"pipeline", *queries.QUERIES} <= set(names)
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_nothing_else_imports_the_subpackage():
    root = Path(entry.__file__).parent / "weft"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "weft.llm" not in p.read_text(), p
