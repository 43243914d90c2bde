import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from voxloom.session import local_session

    session = local_session(4, "6g")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test tables here")
    return path


def against_sql(spark, sf_dir, query, sql):
    """Both results as sorted rows over sorted columns."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(repr([r[c] for c in names]) for r in df.collect())
    want = con.sql(sql)
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    return got, sorted(repr([r[k] for k in at]) for r in want.fetchall())
