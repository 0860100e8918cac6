"""Every query with a SQL twin gives the same rows as DuckDB on the smallest tables."""

import decimal
import itertools
import math
import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from paperloom import plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) & set(plans.ORACLES)))
def test_same_rows(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    twin = duck.sql(plans.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(twin.columns)
    at = [twin.columns.index(c) for c in columns]
    ours = sorted("|".join(plain(r[c]) for c in columns) for r in df.collect())
    theirs = sorted("|".join(plain(r[k]) for k in at) for r in twin.fetchall())
    assert ours == theirs


def twins(spark, name, folder, **tables):
    """Rows of a query and of its SQL over tables of one's own (columns by name)."""
    con = duckdb.connect()
    for table, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    df = plans.QUERIES[name](spark, str(folder))
    twin = con.sql(plans.ORACLES[name])
    at = [twin.columns.index(c) for c in df.columns]
    return sorted("|".join(map(plain, r)) for r in df.collect()), sorted("|".join(plain(r[k]) for k in at) for r in twin.fetchall())


def test_search_index_of_odd_texts(spark, tmp_path):
    """Whatever a text begins with is the same number in the SQL; lines end at line feeds only."""
    texts = ["".join(t) for n in range(5) for t in itertools.product("059.+-eE_xBaF \t\n", repeat=n)]
    texts += ["one\u2028two\nthree", "one\u0085two", "one\rtwo\nthree", "one\r\n two\r\n", " \r\n\x0b\none\n", "20.5 words", "1e4 words", None]
    n = len(texts)
    ours, theirs = twins(spark, "search_index", tmp_path, documents={"doc_id": range(n), "text": texts, "lang": (["de", "en", None, "fr"] * n)[:n], "source": (["a", "b", None, "c", None] * n)[:n]})
    assert ours == theirs


def test_every_query_is_registered():
    assert set(plans.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
