"""Every query of the base library against its DuckDB SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from parlance import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    if isinstance(value, str):
        return value
    return f"{float(value):.6f}" if math.isfinite(float(value)) else str(value)


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(plain(v) for v in row) for row in frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    assert rows_of(queries.QUERIES[name](spark, DATA).toPandas()) == rows_of(duck.sql(queries.ORACLE_SQL[name]).df())


def test_drawn_words(spark):
    rows = queries.QUERIES["se03_biasing_words"](spark, DATA).collect()
    own = {r.item_id: r.rare.split() for r in queries.QUERIES["ag21_rare_words"](spark, DATA).collect()}
    pool = {w for ws in own.values() for w in ws}
    assert len(rows) == len(own) and len({r.drawn for r in rows}) > 1
    for r in rows:
        drawn = r.drawn.split()
        assert len(drawn) == 2 and set(drawn) <= pool and r.biasing.split() == sorted({*own[r.item_id], *drawn})


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, name):
    frame = queries.QUERIES[name](spark, DATA)
    assert frame.count() > 0 and len(set(frame.columns)) == len(frame.columns)


def test_stream_equals_batch(spark):
    batch, stream = (rows_of(queries.QUERIES[n](spark, DATA).toPandas()) for n in ("wn03_pack_windows", "sm04_online_windows"))
    assert batch == stream


def test_entry_has_all(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(queries.QUERIES) <= names and set(__spark_entry__.oracle_sql()) <= names
    assert __spark_entry__.entry(spark).count() > 0
