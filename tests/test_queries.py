"""Registered queries against their DuckDB oracles on the smallest scale, and
the driver contract."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tests.conftest import SMOKE

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return int(v) if v.is_integer() and abs(v) < 2 ** 53 else round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(repr(_norm(x)) for x in r) for r in pdf[cols].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    return c


def test_contract():
    q, o = entry.queries(), entry.oracle_sql()
    own = {n for n in q if n not in entry._llm()[0]}
    assert len(own) >= 90 and set(o) <= set(q)
    assert own <= set(o)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert set(df.columns) == {"variant", "method", "tc", "vc", "cc", "ri", "ex", "n_fk", "n"}
    assert df.count() == 39


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n not in entry._llm()[0]))
def test_query_matches_oracle(spark, con, name):
    got = entry.queries()[name](spark, SMOKE).toPandas()
    exp = con.execute(entry.oracle_sql()[name]).df()
    assert _rows(got) == _rows(exp)
