"""Cases that a cut of the job would lose, against brute force."""

import glob
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cuecorpus.llm import suffix_dedup, toxicity, word_quality
from cuecorpus.llm.workspace import shared_dir
from tests.llm.test_operators import awkward, brute_repeats, empty, make, words  # noqa: F401


def brute_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0Dࠀ-\U0010FFFF]+|[ࠀ-\U0010FFFF]", lowered)


def brute_word_model(texts):
    grams = {1: {}, 2: {}, 3: {}}
    for t in texts:
        w = ("", "", *brute_words(t))
        for k in range(2, len(w)):
            grams[3][w[k - 2 : k + 1]] = grams[3].get(w[k - 2 : k + 1], 0) + 1
    for k in (2, 1):
        for g in grams[k + 1]:
            grams[k][g[1:]] = grams[k].get(g[1:], 0) + 1
    d = {k: word_quality.discounts([sum(c == n for c in grams[k].values()) for n in (1, 2, 3, 4)]) for k in grams}

    def p(g, k):
        if k == 0:
            return 1 / (len(grams[1]) + 1)
        own = [c for x, c in grams[k].items() if x[:-1] == g[3 - k : 2]]
        if not own:
            return p(g, k - 1)
        c = grams[k].get(g[3 - k :], 0)
        return (max(c - d[k][min(c, 3) - 1], 0) if c else 0) / sum(own) + sum(d[k][min(x, 3) - 1] for x in own) / sum(own) * p(g, k - 1)

    return p


def test_word_model_against_brute_force(spark):
    texts = [words(30, 12), words(25, 12), "The unseen Ünder W1 w2", "", None, words(10, 12) + "!!", "今天w1天气—好 ok😀x", words(40, 12), " \n"]
    docs = make(spark, list(enumerate(texts)))
    learnt = (0, 1, 5, 6)
    trusted = spark.createDataFrame([(i,) for i in learnt], "doc_id long")
    got = {r["doc_id"]: r for r in word_quality.score_quality(docs, trusted, block_bytes=100, held_out=0).collect()}
    p = brute_word_model([texts[i] for i in learnt])
    for i, t in enumerate(texts):
        w = ("", "", *brute_words(t))
        logs = [np.log(p(w[k - 2 : k + 1], 3)) for k in range(2, len(w))]
        assert got[i]["perplexity"] == pytest.approx(float(np.exp(-np.mean(logs))) if logs else 1.0)
    assert all(got[i]["kept"] for i in learnt if got[i]["perplexity"] <= got[i]["threshold"])


def test_rows_sent_grow_with_blocks(spark):
    docs = make(spark, [(i, words(60, 500)) for i in range(320)])
    trusted = spark.range(0, 320, 2).withColumnRenamed("id", "doc_id")
    n_bytes = docs.agg({"n_chars": "sum"}).first()[0]
    found, sent = [], []
    for blocks in (8, 32):
        seen = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/kneser-ney-blocks-*"))
        got = word_quality.score_quality(docs, trusted, block_bytes=-(-n_bytes // blocks)).collect()
        found.append({r["doc_id"]: round(r["perplexity"], 6) for r in got})
        (path,) = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/kneser-ney-blocks-*")) - seen
        sent.append(spark.read.parquet(path).where("n IS NULL").count())
    # Blocks change neither the model nor, but for n-grams that several of them share, what is sent.
    assert found[0] == found[1]
    assert sent[1] <= 4 * sent[0]


def test_word_model_with_hot_words(spark):
    """Words that fill more than a shard are dealt by the word before them, and nothing changes."""
    texts = [words(200, 6) for _ in range(12)] + ["w1", "", "w1 w1 w1 w1 w2", words(10, 12)]
    docs = make(spark, list(enumerate(texts)))
    learnt = (0, 1, 2, 3, 4, 12)
    trusted = spark.createDataFrame([(i,) for i in learnt], "doc_id long")
    seen = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/kneser-ney-pairs-*"))
    got = {r["doc_id"]: r["perplexity"] for r in word_quality.score_quality(docs, trusted, block_bytes=1000, held_out=0, shard_bytes=500).collect()}
    assert set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/kneser-ney-pairs-*")) - seen
    p = brute_word_model([texts[i] for i in learnt])
    for i, t in enumerate(texts):
        w = ("", "", *brute_words(t))
        logs = [np.log(p(w[k - 2 : k + 1], 3)) for k in range(2, len(w))]
        assert got[i] == pytest.approx(float(np.exp(-np.mean(logs))) if logs else 1.0)


def test_word_model_writes_less_than_its_text(spark):
    """Nearly every triple of these words is distinct, and yet all tables of the model together are smaller than the text."""
    folder = shared_dir(spark).removeprefix("file:")
    files = lambda: {f: os.path.getsize(f) for f in glob.glob(f"{folder}/kneser-ney-*/*.parquet")}
    docs = make(spark, [(i, words(2000, 3000)) for i in range(150)]).persist()
    trusted = spark.range(0, 150, 3).withColumnRenamed("id", "doc_id")
    before = files()
    assert word_quality.score_quality(docs, trusted, block_bytes=500_000, shard_bytes=500_000).count() == 150
    written = sum(n for f, n in files().items() if f not in before)
    assert written <= docs.agg({"n_chars": "sum"}).first()[0]


def test_replies_hold_only_what_a_block_lacks(spark):
    """Texts that share no triple: blocks know all counts of their own, so replies are much smaller than their text."""
    folder = shared_dir(spark).removeprefix("file:")
    seen = set(glob.glob(f"{folder}/kneser-ney-replies-*"))
    docs = make(spark, [(i, words(2000, 3000)) for i in range(150)]).persist()
    trusted = spark.range(0, 150, 2).withColumnRenamed("id", "doc_id")
    assert word_quality.score_quality(docs, trusted, block_bytes=500_000, shard_bytes=500_000, held_out=0).count() == 150
    (path,) = set(glob.glob(f"{folder}/kneser-ney-replies-*")) - seen
    replies = spark.read.parquet(path)
    size = lambda kind: replies.where(f"kind = {kind} AND block IS NOT NULL").selectExpr("coalesce(sum(length(blob)), 0)").first()[0]
    n_bytes = docs.agg({"n_chars": "sum"}).first()[0]
    assert size(word_quality.REPLY) <= 0.05 * n_bytes and size(word_quality.PAIR) == 0


def test_packed_integers_are_read_back():
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 2**64, 1000, np.uint64)
    small = rng.integers(0, 300, 999)
    got = word_quality.unpack(word_quality.pack(hashes, small, np.zeros(0), np.zeros(7), [2**62]))
    assert [x.tolist() for x in got] == [hashes.tolist(), small.tolist(), [], [0] * 7, [2**62]]
    assert [len(x) for x in word_quality.unpack(word_quality.pack(np.zeros(0), np.zeros(0)))] == [0, 0]


def test_word_model_awkward(spark, awkward):  # noqa: F811
    none = spark.createDataFrame([], "doc_id long")
    got = word_quality.score_quality(awkward, none).collect()
    assert len(got) == awkward.count() and all(r["kept"] for r in got)
    assert word_quality.score_quality(empty(spark), none).count() == 0


def test_shuffled_words_are_less_likely(spark):
    rng = np.random.default_rng(11)
    follow = {f"word{i}": [f"word{x}" for x in rng.integers(0, 200, 3)] for i in range(200)}
    texts = []
    for _ in range(60):
        w = ["word1"]
        while len(w) < 200:
            w.append(follow[w[-1]][rng.integers(0, 3)])
        texts.append(w)
    mixed = [list(rng.permutation(t)) for t in texts[50:]]
    docs = make(spark, [(i, " ".join(t)) for i, t in enumerate(texts + mixed)])
    trusted = spark.range(50).withColumnRenamed("id", "doc_id")
    got = {r["doc_id"]: r["perplexity"] for r in word_quality.score_quality(docs, trusted).collect()}
    assert min(got[i] for i in range(60, 70)) > 5 * max(got[i] for i in range(50, 60))


def test_a_hot_string_leaves_a_task_once():
    text = words(60).encode()
    keys = np.unique(suffix_dedup.pieces([text])[3]).tolist()
    batch = pa.RecordBatch.from_arrays([pa.array([9, 4, 7, 4, 8]), pa.array([1] * 5, pa.int64()), pa.array([text] * 4 + [b"x" + text]), pa.array([keys] * 5), pa.array([keys] * 5)], names=list("abcde"))
    rows = [r for b in suffix_dedup._fetch(iter([batch])) for r in b.to_pylist()]
    places = [np.frombuffer(r["places"], suffix_dedup.PLACE) for r in rows if r["piece"] is not None]
    assert len(places) == len(text) - 99 + 1 * (len(places) > len(text) - 99) and all(len(p) == 1 for p in places)
    spans = {tuple(x) for r in rows if r["piece"] is None for x in np.frombuffer(r["places"], suffix_dedup.SPAN).tolist()}
    assert {i for i, *_ in spans} == {7, 8, 9} and (9, 1, 0, len(text)) in {(i, v, min(a for j, _, a, _ in spans if j == i), max(b for j, _, _, b in spans if j == i)) for i, v, _, _ in spans}


def test_equal_texts_are_merged_before_the_search(spark):
    from pyspark.sql import functions as F

    same, other = words(50), words(50)
    texts = [other, same, same, same + "x", other, "short", "short", same]
    docs = make(spark, [*enumerate(texts), (1, same)])
    named = docs.select(F.col("doc_id").alias("_id"), F.xxhash64(F.col("text").cast("binary")).alias("_version"), F.col("text").cast("binary").alias("text"))
    assert sorted(r["_id"] for r in suffix_dedup.later_copies(named).collect()) == [2, 4, 7]
    for hot in (suffix_dedup.HOT, 2):
        got = suffix_dedup.remove_repeats(docs.where("doc_id <> 1").union(docs.where("doc_id = 1").limit(1)), hot=hot).orderBy("doc_id").collect()
        assert [tuple(r[1:4]) + (bytes(r["kept"]),) for r in got] == brute_repeats([t.encode() for t in texts])


def test_toxicity_reads_long_runs_whole():
    s = toxicity.Settings()
    features = lambda w: set(toxicity.word_features([w], s.buckets)[0].tolist())
    run = "".join(chr(0x4E00 + i) for i in range(200)) + "_grumblefink"
    have = set().union(*map(features, toxicity.words_of(run)))
    inner = lambda g: features(f"{g}") - features("")
    for n in (3, 4, 5):
        assert all(inner(run[i : i + n]) & have for i in range(len(run) - n + 1))
    odds = np.zeros(s.buckets, np.float32)
    odds[list(features("grumblefink"))] = 20
    scorer = toxicity.Scorer(odds, -4.0, s, cache=3)
    assert scorer.score(run) > 0.9 and scorer.scores(["a b c d e", run, "", "x"])[1] > 0.9
    assert toxicity.words_of("A b a " + "x" * 40) == ["a", "b", "x" * 40]


def test_word_features_do_not_depend_on_their_neighbours():
    at, owner = toxicity.word_features(["ab", "", "longer", "é😀"], 2**20)
    for k, w in enumerate(["ab", "", "longer", "é😀"]):
        assert sorted(at[owner == k].tolist()) == sorted(toxicity.word_features([w], 2**20)[0].tolist())
        assert (owner == k).sum() == 1 + sum(max(0, len(w) + 2 - n + 1) for n in (3, 4, 5))


def test_toxicity_on_documents_it_never_saw(spark):
    """The share of labelled toxic documents that are caught, and of clean ones that are not left alone, held out."""
    from cuecorpus.llm.queries import QUERIES

    rows = QUERIES["op2_toxicity"](spark, "/root/testdata/sf0.1").where("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    toxic = [r["predicted"] for r in rows if r["toxic"] == 1]
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert len(toxic) > 100 and np.mean(toxic) >= 0.9 and np.mean(clean) <= 0.015


def test_unseen_good_documents_are_kept(spark):
    """Of good documents that were not named as trusted, about as many are kept as the quantile says."""
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.1"
    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 AND toxic = 0").select("doc_id")
    unseen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    scored = word_quality.score_quality(spark.read.parquet(f"{sf}/documents.parquet"), good.where(~unseen))
    kept = scored.join(good.where(unseen), "doc_id").agg(F.avg(F.col("kept").cast("double"))).first()[0]
    assert abs(kept - word_quality.QUANTILE) <= 0.05


def test_rows_without_ids_are_told_apart(spark):
    from pyspark.sql import functions as F

    texts = [words(40) + f" {i}" for i in range(400)]
    docs = spark.createDataFrame([(None, t) for t in texts] + [(5, texts[0])], "doc_id long, text string")
    got = suffix_dedup.remove_repeats(docs).collect()
    # Rows without an id come first, in the order of their texts' hashes.
    ordered = [r["text"] for r in docs.where("doc_id IS NULL").orderBy(F.xxhash64(F.col("text").cast("binary"))).collect()] + [texts[0]]
    assert sorted((*tuple(r[1:4]), bytes(r["kept"])) for r in got) == sorted(brute_repeats([t.encode() for t in ordered]))
