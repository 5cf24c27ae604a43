"""Every registered query with a DuckDB twin, at the smallest scale."""

import glob
import os

import duckdb
import pytest

from seedmill import queries

SF = "/root/testdata/sf0.001"
#: Slow twins run at larger scales by the driver only.
NAMES = sorted(set(queries.ORACLES) - {"near_dup_clusters", "minhash_signatures"})


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, db, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = db.sql(queries.ORACLES[name]).df()
    rows = lambda df: sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
