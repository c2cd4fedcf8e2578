"""Every query with SQL against DuckDB, and what the others give."""

import glob
import os

import pandas as pd
import pytest

import __spark_entry__
from ravelin.plans.oracle import ORACLE_SQL
from ravelin.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame.reindex(sorted(frame.columns), axis=1)
    # whole numbers with nulls: pandas has floats for Spark's, and a type of its own for DuckDB's
    frame = frame.astype({c: "float64" for c, t in frame.dtypes.items() if str(t).startswith(("Int", "UInt")) and frame[c].isna().any()}).astype(object)
    plain = lambda v: "" if v is None or v != v else repr(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_is_its_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(want)
    assert rows(got) == rows(want)


def test_contract(spark):
    assert set(ORACLE_SQL) <= set(QUERIES) and set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 14
