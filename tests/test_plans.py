"""Every core query against its SQL on the smallest tables, if they are there."""

import glob
import os

import duckdb
import pytest

import __spark_entry__

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = [n for n in __spark_entry__.oracle_sql() if not (n[0] == "p" and n[1].isdigit())]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, duck, name, tmp_path):
    __spark_entry__.queries()[name](spark, FOLDER).write.parquet(str(tmp_path / "out"))
    duck.execute(f"CREATE OR REPLACE TABLE a AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    duck.execute(f"CREATE OR REPLACE TABLE b AS {__spark_entry__.oracle_sql()[name]}")
    columns = sorted(r[0] for r in duck.execute("DESCRIBE a").fetchall())
    assert columns == sorted(r[0] for r in duck.execute("DESCRIBE b").fetchall())
    listed = ", ".join(f'"{c}"' for c in columns)
    for x, y in (("a", "b"), ("b", "a")):
        assert duck.execute(f"SELECT count(*) FROM (SELECT {listed} FROM {x} EXCEPT ALL SELECT {listed} FROM {y})").fetchall() == [(0,)]
