"""Registered queries against their SQL over the smallest test tables, where those are there."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from weft.plans import registry

TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="no test tables here")


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", [*registry.oracle_sql()])
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM read_parquet('{t}{'/*' if t.is_dir() else ''}')")
    df = registry.queries()[name](spark, str(TABLES))
    r = con.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in r.description]
    assert sorted(cols) == sorted(df.columns)
    rows = lambda x: sorted(str(tuple(plain(v) for v in row)) for row in x)
    assert rows(df.select(*cols).collect()) == rows(r.fetchall())


def test_snapshot_keeps_everything(spark):
    assert {r.n_different for r in registry.queries()["export_roundtrip"](spark, str(TABLES)).collect()} == {0}
