"""Every query against its SQL in DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from scriptorium.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float) or hasattr(v, "as_integer_ratio") and not isinstance(v, int):
        return "nan" if math.isnan(v) else repr(round(float(v), 8) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    frame = catalogue.QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    if name not in catalogue.SQL:
        assert rows
        return
    answer = duck.execute(catalogue.SQL[name])
    at = {c[0]: i for i, c in enumerate(answer.description)}
    assert sorted(at) == columns
    assert rows == sorted(tuple(plain(r[at[c]]) for c in columns) for r in answer.fetchall())


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
