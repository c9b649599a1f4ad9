"""Every registered query that has an oracle, against DuckDB at sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

from common import SF_SMALL, TRIALS

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
ORACLE = entry.oracle_sql()
# the tests search fewer trials
ORACLE["g7_search_checks"] = ORACLE["g7_search_checks"].replace("CAST(50 AS BIGINT) AS n_trials", f"CAST({TRIALS} AS BIGINT) AS n_trials")
QUERIES = entry.queries()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i].lower())
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    res = con.execute(ORACLE[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(c.lower() for c in sdf.columns) == sorted(c.lower() for c in ocols)
    assert len(srows) == len(orows)
    assert _rows(sdf.columns, srows) == _rows(ocols, orows)


def test_every_query_has_a_callable():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 10 and df.columns == ["pos", "age", "rate", "n"]
