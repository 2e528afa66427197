"""Mapped words of a pool, on tables that have some, by hand and against the SQL."""

import glob
import os

import duckdb

from weftline.plans import pool
from tests.test_whole import write


def test_mapped_words(spark, tmp_path):
    candidates = [(1, f"P{i}", i, None) for i in range(20)] + [(2, "P1", 1, None), (2, "P2", 2, None)]
    meta = {f"P{i}": {"vocab": " ".join(["insulated"] * (i < 6) + ["fleece"] * (i == 0) + ["warm"] * (i in (3, 4)) + ["coat"])} for i in range(20)}
    folder = write(spark, tmp_path, [(1, "a warm one"), (2, "something warm")], candidates, meta)
    support = {(r.request_id, r.said, r.term): r.support for r in pool.grounding_support(spark, folder).collect()}
    assert support == {(1, "warm", "insulated"): 0.3, (2, "warm", "insulated"): 1.0}  # fleece stands in one product of a large pool
    ground = {(r.request_id, r.said, r.term) for r in pool.ground_terms(spark, folder).collect()}
    assert ground == {(1, "warm", "insulated"), (1, "warm", "warm"), (2, "warm", "insulated")}
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}/*.parquet'")
    for name, got in (("grounding_support", {(*k, v) for k, v in support.items()}), ("ground_terms", ground)):
        columns = "request_id, said, term" + (", support" if name == "grounding_support" else "")
        assert set(con.execute(f"SELECT {columns} FROM ({pool.SQL[name]})").fetchall()) == got
