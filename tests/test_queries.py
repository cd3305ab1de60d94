"""Every query of the engine runs, and gives the rows of its SQL."""

import glob
import os

import pytest

import __spark_entry__
from glyphmill import catalog

SF = os.environ.get("GLYPHMILL_SF_DIR", "/root/testdata/sf0.001")


def plain(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    if name in catalog.ORACLE_SQL:
        order = ", ".join(f'"{c}"' for c in df.columns)
        assert plain(rows) == plain(con.execute(f"SELECT {order} FROM ({catalog.ORACLE_SQL[name]})").fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
