"""Every query of the catalog against DuckDB on the same tables."""

import duckdb
import pandas as pd
import pytest

from siftwork import catalog

catalog.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float):
        return int(v) if v.is_integer() else round(v, 6)
    return str(v.tz_localize(None) if v.tzinfo else v) if isinstance(v, pd.Timestamp) else v


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, duck, name):
    got = catalog.QUERIES[name](spark, data).toPandas()
    if name not in catalog.SQL:
        assert len(got.columns) > 0
        return
    want = duck.execute(catalog.SQL[name]).df()
    assert len(want), "a query that finds nothing proves nothing"
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
