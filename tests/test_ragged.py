"""Queries against their SQL on a table that lacks rows: the last token has some layers only, others are missing, and so are whole layers of an object."""

import duckdb
import pytest
from test_queries import SF, rows

from kelpie.plans.registry import ORACLES, QUERIES

GAPS = f"""SELECT * FROM '{SF}/embeddings.parquet' WHERE vec_id < 498 AND vec_id % 7 <> 3 AND vec_id // 4 NOT IN (5, 40)
UNION ALL SELECT vec_id + 4096, embedding, label FROM '{SF}/embeddings.parquet' WHERE vec_id % 2 = 1 AND vec_id < 70
UNION ALL SELECT vec_id + 8192, embedding, label FROM '{SF}/embeddings.parquet' WHERE vec_id = 2"""


@pytest.mark.parametrize("name", ["packet_header", "packet_round_trip", "layout_token_frames", "layout_inverse"])
def test_missing_rows(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"COPY ({GAPS}) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    got, want = QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
