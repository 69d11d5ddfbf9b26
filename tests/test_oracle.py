"""Every query of the star schema against DuckDB on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest
from quernflow.operators import queries as star

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = star.queries(), star.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(rows):
    def cell(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else round(x, 6) + 0.0
        return x

    return sorted((tuple(cell(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.select(*[f"`{c}`" for c in sorted(df.columns)]) if len(set(df.columns)) == len(df.columns) else df
    want = duck.sql(ORACLES[name])
    cols = sorted(want.columns)
    assert sorted(df.columns) == cols
    assert norm(got.collect()) == norm(want.project(", ".join(f'"{c}"' for c in cols)).fetchall())
