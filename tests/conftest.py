import glob
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")  # for the Python workers

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g", "spark.sql.session.timeZone": "UTC"}
    out = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    out.sparkContext.setLogLevel("ERROR")
    yield out
    out.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def _text(v):
    return repr(v) if isinstance(v, float) else str(v)


def same(df, con, sql):
    """Rows of df and of the SQL, as sorted tuples of text, columns by name."""
    names = sorted(df.columns)
    got = sorted(tuple(_text(r[c]) for c in names) for r in df.collect())
    answer = con.execute(sql)
    columns = [d[0] for d in answer.description]
    assert sorted(columns) == names
    want = sorted(tuple(_text(r[columns.index(c)]) for c in names) for r in answer.fetchall())
    assert got == want


@pytest.fixture(scope="session")
def check():
    return same
