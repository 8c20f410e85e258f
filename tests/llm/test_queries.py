"""Registered queries and the pipeline on the smallest tables, against brute force or what must hold."""

import zlib

import duckdb
import pytest

import corpus_pipeline
from cuecorpus.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT * FROM '{SF}/documents.parquet'").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = db.sql(ORACLES[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert sorted(map(str, (tuple(r[c] for c in order) for r in got.collect()))) == sorted(map(str, want.select(*[duckdb.ColumnExpression(c) for c in order]).fetchall()))


def test_near_dedup_query(spark, documents):
    from tests.llm.test_operators import brute_near

    got = QUERIES["op6_minhash_dedup"](spark, SF).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_near([(r[0], r[1]) for r in documents])


def test_suffix_query(spark, documents):
    import hashlib

    from tests.llm.test_operators import brute_repeats

    rows = sorted((r[0], r[1].encode()) for r in documents)
    want = brute_repeats([b for _, b in rows])
    got = {r["doc_id"]: r for r in QUERIES["op3_suffix_dedup"](spark, SF).collect()}
    for (i, _), (n, gone, spans, kept) in zip(rows, want, strict=True):
        assert tuple(got[i][1:]) == (n, gone, spans, hashlib.sha256(kept).hexdigest())


def test_toxicity_query(spark, documents):
    got = QUERIES["op2_toxicity"](spark, SF).collect()
    assert len(got) == len(documents)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF)
        if name != "packing":
            assert docs.columns == columns
            ids = {r[0] for r in before.select("doc_id").collect()}
            assert {r[0] for r in docs.select("doc_id").collect()} <= ids
        docs = docs.cache()
        assert docs.count() > 0
        if name == "exact_dedup":
            assert docs.count() == before.select("text").distinct().count()
        if name == "near_dedup":
            from cuecorpus.llm.minhash import near_duplicates

            assert docs.count() == near_duplicates(before).where("kept").count()
            assert near_duplicates(docs).where("NOT kept").count() == 0
