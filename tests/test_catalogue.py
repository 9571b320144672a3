"""Every query of the core against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from millrace.plans import catalogue, derived, facts

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, (list, dict, tuple)) or getattr(x, "ndim", 0):
        return repr(list(x))
    if pd.isna(x):
        return None
    return str(x) if isinstance(x, (str, pd.Timestamp)) else float(f"{float(x):.9g}")


def rows(df):
    return sorted(repr([plain(x) for x in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("part", range(6))
def test_queries_equal_their_sql(spark, duck, part):
    assert derived.query is facts.query is catalogue.query
    for name in sorted(catalogue.ORACLE_SQL)[part::6]:
        got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.execute(catalogue.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns), name
        assert rows(got) == rows(want), name
