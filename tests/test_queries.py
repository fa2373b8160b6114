"""Every registered query of the library against its SQL in DuckDB, on the smallest tables; floats to nine digits."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from attrilens.plans.queries import ORACLE_SQL, QUERIES


def canonical(df):
    def one(v):
        if v is None or v is pd.NaT or (isinstance(v, (float, np.floating)) and np.isnan(v)):
            return "NULL"
        if isinstance(v, (float, np.floating)):
            return f"{float(v):.9g}"
        return str([one(x) for x in v]) if isinstance(v, (list, tuple, np.ndarray)) else str(v)

    out = df[sorted(df.columns)].map(one) if len(df) else df[sorted(df.columns)].astype(str)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equal(spark, sf, duck, name):
    got, want = canonical(QUERIES[name](spark, sf).toPandas()), canonical(duck.execute(ORACLE_SQL[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
