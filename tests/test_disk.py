"""What frame queries leave on disk, and that groups of videos in turn give what all videos at once give."""

import os

import duckdb
import pytest

from cuecorpus.operators import visual
from cuecorpus.plans import frame_queries
from cuecorpus.plans.queries import ORACLES, QUERIES
from tests.test_queries import SF, plain


def kept(spark) -> int:
    """Bytes under the folder of checkpoints."""
    top = (spark.sparkContext.getCheckpointDir() or "").removeprefix("file:")
    return sum(os.path.getsize(f"{d}/{x}") for d, _, names in os.walk(top) for x in names)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def same_as_sql(db, name, got) -> None:
    want = db.sql(ORACLES[name])
    order = sorted(got.columns)
    at = [want.columns.index(c) for c in order]
    expected = [tuple(plain(r[i]) for i in at) for r in want.fetchall()]
    assert sorted(map(repr, (tuple(plain(r[c]) for c in order) for r in got.collect()))) == sorted(map(repr, expected))


def test_answers_in_waves(spark, db, monkeypatch):
    QUERIES["frame_batches"](spark, SF)
    text = db.sql("SELECT sum(length(text)) FROM events JOIN documents ON doc_id = event_id % (SELECT count(*) FROM documents)").fetchall()[0][0]
    monkeypatch.setattr(frame_queries, "ANSWER_BYTES", text // 3, raising=False)
    before = kept(spark)
    got = QUERIES["attach_visual_results"](spark, SF)
    assert len(got.inputFiles()) > 2
    assert kept(spark) - before < text / 4  # no answer is kept whole
    same_as_sql(db, "attach_visual_results", got)


def test_new_lines_in_waves(spark, db, monkeypatch):
    QUERIES["frame_batches"](spark, SF)
    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(top))
    monkeypatch.setattr(visual, "WAVE_BYTES", 100_000, raising=False)
    got = QUERIES["new_screen_lines"](spark, SF)
    assert len(set(os.listdir(top)) - before) == 1  # the results; frames and what the waves kept are gone
    assert len(got.inputFiles()) > 2
    same_as_sql(db, "new_screen_lines", got)


@pytest.mark.parametrize("name", ["compact_visual", "timeline_budgeted"])
def test_compaction_in_waves(spark, monkeypatch, name):
    QUERIES["frame_batches"](spark, SF)
    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    want = sorted(map(repr, QUERIES[name](spark, SF).collect()))
    before = set(os.listdir(top))
    monkeypatch.setattr(visual, "WAVE_BYTES", 200_000, raising=False)
    got = QUERIES[name](spark, SF)
    assert len(set(os.listdir(top)) - before) == 1
    assert sorted(map(repr, got.collect())) == want
