"""Every registered query of the engine against DuckDB, on whole tables."""

import glob
import math
from pathlib import Path

import duckdb
import pytest

from weft import oracles, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    return c


def rounded(v):
    return ("nan" if math.isnan(v) else round(v, 9)) if isinstance(v, float) else v


def test_every_query_has_sql():
    assert set(queries.queries()) == set(oracles.oracle_sql())


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([rounded(x) for x in r]) for r in df.select(*cols).collect())
    found = duck.execute(oracles.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted(repr([rounded(r[names.index(c)]) for c in cols]) for r in found.fetchall())
    assert got == want


def test_flagship_has_all_sections(spark):
    rows = queries.hybrid_context(spark, SF).collect()
    assert {r["section"] for r in rows} == {0, 1, 2}
