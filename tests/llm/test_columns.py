"""Columns of any names and types, and bounds that hold whatever the rows are."""

import glob
import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cuecorpus.llm import chat, exact_dedup, minhash, mixing, packing, sharding, topk, toxicity
from cuecorpus.llm.workspace import shared_dir
from tests.llm.test_operators import make, plain_best_fit, words  # noqa: F401

#: Names that the operators use inside, those they add, and odd ones.
NAMES = (
    "_text", "_digest", "_salt", "_rest", "_has_text", "_sha", "_alt", "text_", "digest", "salt", "rank", "row", "tie", "known", "rest", "c0", "src", "tokens", "mark", "_src", "_all", "_begin", "_block", "_budget", "block", "blocks", "epoch", "begin", "budget",
    "position", "all", "sum", "_epoch_", "_shard", "_length", "_source", "_cluster", "_end", "length", "cluster", "dealt", "_score", "_o", "_label", "_file", "_row", "_first", "key", "hub", "a", "b", "id", "n", "shingles", "with.dot", "with`tick", "Ünïcode", "select",
)


@pytest.fixture(scope="module")
def crowded(spark):
    """Documents with a column of each name, and a map; the values tell the rows."""
    texts = [(0, words(30)), (1, words(30)), (2, None), (3, ""), (4, words(40)), (None, words(20)), (None, words(20))]
    rows = make(spark, texts + [(5, texts[0][1]), (6, texts[4][1] + " more")])
    tag = F.coalesce(F.col("doc_id"), F.lit(-1))
    return rows.select("*", *[(tag * 1000 + k).alias(n) for k, n in enumerate(NAMES)], F.create_map(F.lit("k"), tag).alias("a map"))


def check(rows, columns):
    for r in rows:
        d = r.asDict()
        tag = -1 if d["doc_id"] is None else d["doc_id"]
        assert d["a map"] == {"k": tag}
        for k, n in enumerate(NAMES):
            assert d[n] == tag * 1000 + k, n
    assert len(set(columns)) == len(columns)


def test_exact_dedup_passes_columns(crowded):
    out = exact_dedup.drop_duplicates(crowded)
    assert out.columns == crowded.columns
    rows = out.collect()
    check(rows, out.columns)
    assert sorted((r["text"] or "" for r in rows)) == sorted({r["text"] or "" for r in crowded.select("text").collect()})
    assert {r["doc_id"] for r in rows} == {1, 3, 4, None, 5, 6}
    marks = exact_dedup.mark_duplicates(crowded)
    assert marks.count() == crowded.count()


def test_mixing_passes_columns(crowded):
    out = mixing.mix_sources(crowded, packing.word_count(F.col("text")))
    assert set(out.columns) == {*crowded.columns, *mixing.MADE}
    check(out.collect(), out.columns)


def test_packing_passes_columns(crowded):
    out = packing.pack(crowded, packing.word_count(F.col("text")), F.col("source"), F.xxhash64("text"))
    assert out.columns == [*crowded.columns, "bin_id", "bin_offset", "piece", "piece_start", "piece_length"]
    rows = out.collect()
    check(rows, out.columns)
    assert len(rows) == crowded.count()


def test_made_columns_are_replaced(spark):
    docs = make(spark, [(1, "a b c")]).withColumns({c: F.lit("old") for c in (*mixing.MADE, *packing.MADE.names)})
    assert mixing.mix_sources(docs, F.lit(3)).first()["_epoch"] == 0
    assert packing.pack(docs, F.lit(3), F.col("source"), F.col("doc_id")).first()["piece_length"] == 3


def test_near_copies_and_labels_pass_columns(crowded):
    assert minhash.near_duplicates(crowded).count() == crowded.count()
    s = toxicity.Settings()
    scored = toxicity.score_documents(crowded.drop("_score"), (np.zeros(s.buckets, np.float32), -1.0), s)
    assert scored.count() == crowded.count()


def test_pipeline_stages_pass_columns(spark, crowded, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, crowded, sf)
        if name != "packing":
            assert out.columns == crowded.columns, name
            check(out.collect(), out.columns)
        assert out.count() > 0


def test_pipeline_stages_against_brute_force(spark):
    """Each stage on what the one before it kept, by plain Python."""
    from tests.llm.test_operators import brute_near

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 2500")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    # Toxicity: the rows whose own score is below the threshold, scored one by one.
    s = toxicity.Settings()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs.select("doc_id", "text"), labels.where(~corpus_pipeline.held_out()), s)
    scorer = toxicity.Scorer(*model, s)
    clean = stages["toxicity"](spark, docs, sf)
    assert ids(clean) == sorted(r["doc_id"] for r in docs.collect() if scorer.score(r["text"] or "") < s.threshold)
    # Exact copies: the largest id of each text.
    last = {}
    for r in docs.collect():
        last[r["text"] or ""] = max(r["doc_id"], last.get(r["text"] or "", -1))
    unique = stages["exact_dedup"](spark, docs, sf)
    assert ids(unique) == sorted(last.values())
    # Near copies: the smallest id of each component of all pairs.
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute_near(rows)
    assert ids(stages["near_dedup"](spark, docs, sf)) == sorted(i for i, (_, c) in want.items() if i == c)
    # The mix: at two reads at most of a source, each source takes its weight of all words.
    size = {r["doc_id"]: len((r["text"] or "").split()) for r in docs.collect()}
    sources = {r["doc_id"]: r["source"] for r in docs.collect()}
    total = {k: sum(size[i] for i in size if sources[i] == k) for k in set(sources.values())}
    everything = sum(total.values())

    def weights(x):
        raw = {k: (v / everything) ** x for k, v in total.items()}
        return {k: v / sum(raw.values()) for k, v in raw.items()}

    steps = [k / 2000 for k in range(2001)]
    x = next(x for x in steps if all(everything * w <= 2 * total[k] * (1 + 1e-9) for k, w in weights(x).items()))
    mixed = stages["mixing"](spark, docs, sf).collect()
    for k, w in weights(x).items():
        got = sum(size[r["doc_id"]] for r in mixed if r["source"] == k)
        assert abs(got - w * everything) <= max(size.values()) + 0.002 * everything
        times = [sum(r["doc_id"] == i for r in mixed) for i in size if sources[i] == k]
        assert max(times) - min(times) <= 1
    # Packing: nothing lost, bins in bounds, no document twice in a bin.
    packed = stages["packing"](spark, docs, sf).collect()
    assert {i: sum(r["piece_length"] for r in packed if r["doc_id"] == i) for i in size} == size
    for _, own in itertools.groupby(sorted(packed, key=lambda r: (r["bin_id"], r["bin_offset"])), key=lambda r: r["bin_id"]):
        own = list(own)
        assert len({r["doc_id"] for r in own}) == len(own) and sum(r["piece_length"] for r in own) <= packing.CAPACITY
        assert all(a["bin_offset"] + a["piece_length"] <= b["bin_offset"] for a, b in itertools.pairwise(own))


def test_splitters_ask_for_few_counts(spark, monkeypatch):
    """One text with dense and with wide ids: a round never sends more than 256 counts a limit."""
    seen = []
    probe = sharding._probe

    def watched(rows, level, prefixes):
        out = probe(rows, level, prefixes)
        seen.append(sum(map(len, out.values())) / max(1, len(prefixes)))
        return out

    monkeypatch.setattr(sharding, "_probe", watched)
    docs = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.xxhash64("id")).alias("doc_id"), F.lit("one text").alias("text"))
    got = sharding.shard_documents(docs)
    sizes = [r["n"] for r in got.groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert max(seen) <= 256 and len(sizes) == 8 and max(sizes) - min(sizes) <= 0.01 * sum(sizes) / 8
    assert all(r["lo"] == 0 and r["hi"] == r["n"] - 1 for r in got.groupBy("shard").agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.countDistinct("slot").alias("n")).collect())


def test_a_long_block_is_read_in_time(spark):
    """Turns of one role by the thousand: as the length doubles, so does the time, not the time squared."""
    import time

    took = []
    for n in (2000, 8000):
        turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.concat(F.lit("é</s> 😀 "), F.col("id").cast("string")).alias("text"))
        start = time.time()
        r = chat.digests(chat.format_conversations(turns)).first()
        took.append(time.time() - start)
        assert r["n_turns"] == n and r["n_blocks"] == 1
        assert r["loss_chars"] == sum(len(f"é</s> 😀 {i}") for i in range(n))
    assert took[1] < 12


def test_topk_chunks_repeated_ids_and_unlike_lengths(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=rng.integers(1, 9)).tolist()) for i in range(60)] + [(7, [9.0, 9.0]), (None, [1.0]), (61, None), (62, [float("nan")]), (63, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(map(np.isfinite, v))]
    asked = {}
    for i, v in q:
        if i % 3 == 1:
            asked[i] = min(v, asked.get(i, v))
    want = {}
    for i, v in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in q if j != i)[:5]
        want[i] = [(j, -s) for s, j in scores]
    for kw in ({}, {"chunk": 4}, {"chunk_bytes": 200}):
        got = {}
        for r in topk.exact_topk(df, F.col("vec_id") % 3 == 1, k=5, **kw).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert {i: sorted(x, key=lambda y: (-y[1], y[0])) for i, x in got.items()} == want


def test_exponent_of_any_number_of_sources(spark):
    tokens = {f"s{i}": (i + 1) ** 3 for i in range(40)}
    sums = spark.createDataFrame(list(tokens.items()), "src string, t long")
    total = sum(tokens.values())
    for repeats, entropy in ((2.0, None), (1.2, None), (1e9, 2.5), (0.5, None), (1e9, None)):
        x, _ = mixing.temperature_weights(tokens, repeats=repeats, entropy=entropy)
        assert mixing.spread_exponent(sums, total, total, repeats, entropy) == pytest.approx(x, abs=1e-9)


def test_a_source_without_tokens_is_many_blocks(spark):
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit("void").alias("source"), F.lit(0).alias("n"))
    got = mixing.mix_sources(docs, F.col("n"))
    assert got.count() == got.select("doc_id").distinct().count() == 100_000
    tables = sorted(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/mixing-plan-*"), key=os.path.getmtime)
    assert spark.read.parquet(tables[-1]).first()["blocks"] == 2


def test_mixing_null_tokens_and_small_blocks(spark):
    docs = spark.createDataFrame([(i, f"s{i % 7}", None if i % 11 == 0 else -5 if i % 13 == 0 else (i % 7 + 1) ** 3) for i in range(400)] + [(None, None, 5)] * 30, "doc_id long, source string, n long")
    few = mixing.mix_sources(docs, F.col("n"), block_tokens=500)
    small = mixing.mix_sources(docs, F.col("n"), block_tokens=500, block_rows=20)
    spent = lambda df: {r["source"]: r["n"] for r in df.groupBy("source").agg(F.max("_position").alias("n")).collect()}
    # Smaller blocks read other documents last, and spend the same budgets.
    assert all(abs(n - spent(small)[s]) < 7**3 for s, n in spent(few).items())
    assert few.where("_tokens < 0 OR _tokens IS NULL OR _at < 0 OR _at >= 1").count() == 0
    one = mixing.mix_sources(docs.where("doc_id IS NULL"), F.col("n"))
    assert one.count() == 30 and sorted(r["_position"] for r in one.collect()) == [5 * k for k in range(30)]
    none = mixing.mix_sources(docs.withColumn("n", F.lit(None).cast("long")), F.col("n"))
    assert none.count() == 430


def test_packing_spreads_rows_that_repeat(spark):
    docs = spark.range(600).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit(10).alias("n"))
    got = packing.pack(docs, F.col("n"), F.col("source"), F.lit(None).cast("long"), capacity=100, per_source=4, shard_rows=50)
    shards = [r["n"] for r in got.groupBy(F.shiftright("bin_id", 32).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(shards) == 600 and len(shards) == 12 and max(shards) < 100
    assert got.groupBy("bin_id").count().agg(F.max("count")).first()[0] <= 4


def test_bins_do_not_depend_on_the_layout(spark):
    docs = spark.range(900).select((F.col("id") % 700).alias("doc_id"), F.lit("s").alias("source"), (F.col("id") % 700 % 37).alias("n"))
    for df in (docs.where("doc_id IS NOT NULL"), docs.withColumn("doc_id", F.lit(None).cast("long"))):
        pack = lambda d: packing.pack(d, F.col("n"), F.col("source"), F.col("doc_id"), capacity=100, shard_rows=100)
        rows = [sorted(map(str, pack(d).collect())) for d in (df, df.repartition(7), df.orderBy(F.desc("n")))]
        assert rows[0] == rows[1] == rows[2]


@pytest.mark.parametrize("same", [None, 7])
def test_sharding_cuts_rows_without_an_id_of_their_own(spark, same):
    docs = spark.range(20_000).select(F.lit(same).cast("long").alias("doc_id"), F.lit("copy").alias("text"))
    got = sharding.shard_documents(docs, 8).groupBy("shard").agg(F.sum("size").alias("size"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.countDistinct("slot").alias("n")).collect()
    assert len(got) == 8 and sum(r["size"] for r in got) == 100_000
    assert max(r["size"] for r in got) - min(r["size"] for r in got) <= 2 * sharding.TOLERANCE * 100_000 / 8 + 10
    assert all(r["low"] == 0 and r["high"] == r["n"] - 1 for r in got)
