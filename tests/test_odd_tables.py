"""Registered queries over tables with odd rows, against their SQL."""

import duckdb

from cuecorpus.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_response_status_of_blank_texts_and_odd_ids(spark, tmp_path):
    docs = f"'{SF}/documents.parquet'"
    con = duckdb.connect()
    con.execute(f"""CREATE TABLE documents AS SELECT * REPLACE (CASE doc_id % 13 WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN chr(10) || ' ' ELSE text END AS text) FROM {docs}
    UNION ALL SELECT * REPLACE (-doc_id - 1 AS doc_id) FROM {docs} UNION ALL SELECT * REPLACE (NULL AS doc_id) FROM {docs} WHERE doc_id < 3""")
    con.execute(f"COPY documents TO '{tmp_path}/documents.parquet'")
    want = con.sql(f"SELECT doc_id, status FROM ({ORACLES['response_status']})").fetchall()
    got = QUERIES["response_status"](spark, str(tmp_path)).select("doc_id", "status").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
