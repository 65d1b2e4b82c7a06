"""Every query with SQL equals DuckDB on the smallest tables; the others run."""

import duckdb
import numpy as np
import pytest
import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [q for q in entry.queries() if not q.startswith("op") and q != "pipeline"]


def plain(v):
    if v is None or (isinstance(v, float) and v != v) or str(v) in ("<NA>", "nan", "NaT"):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.number)):
        return float(f"{float(v):.6g}")
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    if name in entry.oracle_sql():
        assert rows(got) == rows(duck.sql(entry.oracle_sql()[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
