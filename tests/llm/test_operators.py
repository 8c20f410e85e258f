"""Small tests of the training-text operators against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuecorpus.llm import chat, exact_dedup, minhash, mixing, packing, quality, sharding, suffix_dedup, suffixes, topk, toxicity
from cuecorpus.llm.components import connected
from cuecorpus.llm.spread import join_spread

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = np.random.default_rng(3)


def words(n, vocab=60):
    return " ".join(f"w{x}" for x in RNG.integers(0, vocab, n))


def make(spark, texts):
    rows = [(i, t, "en" if (i or 0) % 2 else "de", f"s{(i or 0) % 3}", len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and blank texts, repeated rows, copies, a long text, clashing column names."""
    base = words(80)
    near = base.replace("w1 ", "w999 ", 1)
    texts = [(0, base), (1, None), (2, ""), (3, "  \n"), (4, base), (5, near), (5, near), (6, "one two"), (7, "One\ttwo"), (8, words(20_000)), (None, base), (9, "é" * 150), (10, "x" + "é" * 150), (11, "a" * 400)]
    return make(spark, texts).withColumn("key", F.lit(1)).withColumn("rep", F.lit("x")).withColumn("_text", F.lit(0))


def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1 chat


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


TURNS = [
    (1, 0, "system", "be <s> brief"), (1, 1, "user", "a"), (1, 2, "user", "[INST]b[\\INST]"), (1, 3, "assistant", "<|im_end|>x"), (1, 4, "assistant", ""), (1, 5, "tool", None),
    (2, 1, "assistant", "only"), (2, 0, None, "é\\n"), (3, 0, "user", "<\\\\/s> </s>"), (3, 0, "user", "<\\\\/s> </s>"), (None, None, "user", "nobody"), (4, 0, "as<|im_sep|>s", "t"),
]


def test_chat_round_trip(spark):
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(conversations(spark, TURNS))).collect()}
    for conv in {r[0] for r in TURNS}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in TURNS if c == conv))
        turns = "".join(f"{r}\n{x}\n" for _, _, r, x in own)
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        g = got[conv]
        assert (g["n_turns"], g["turns_sha256"]) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (g["loss_chars"], g["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert g["n_blocks"] == len(list(itertools.groupby(own, key=lambda x: x[2])))


def test_chat_marks_are_the_templates_own(spark):
    rows = chat.format_conversations(conversations(spark, TURNS)).collect()
    for r in rows:
        assert not re.search(r"</?s>|\[/?INST\]", r["formatted"])
        assert r["formatted"].count(chat.END) == r["n_blocks"]
        assert sum(m["length"] for m in r["mask"]) == len(r["formatted"])


def test_chat_empty(spark):
    assert chat.digests(chat.format_conversations(conversations(spark, []))).count() == 0


# 2 toxicity


def test_toxicity_finds_unseen_spelling_and_long_texts(spark):
    bad = ["grumblefink", "snortwaddle"]
    texts, labels = [], []
    for i in range(240):
        t = words(60, 400).split()
        toxic = i % 4 == 0
        if toxic:
            t[int(RNG.integers(0, 60))] = bad[i // 4 % 2]
        texts.append((i, " ".join(t)))
        labels.append((i, 1, int(toxic)))
    long = words(3000, 400) + " grumblefinkz " + words(3000, 400)
    texts += [(900, long), (901, words(6000, 400)), (902, ""), (903, None)]
    docs = make(spark, texts)
    s = toxicity.Settings(sample=200)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), s)
    got = {r["doc_id"]: r["_score"] for r in toxicity.score_documents(docs, model, s).collect()}
    right = sum((got[i] >= s.threshold) == bool(t) for i, _, t in labels)
    assert right >= 230
    assert got[900] >= s.threshold > got[901]
    assert 0 <= got[902] < s.threshold and got[902] == got[903]


def test_toxicity_without_labels(spark):
    docs = make(spark, [(1, "a b")])
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.score_documents(docs, model).first()["_score"] < 0.3
    assert toxicity.score_documents(empty(spark), model).count() == 0
    odds, bias = toxicity.fit(["", " ?"], np.array([0, 1]), np.ones(2), toxicity.Settings())
    assert not odds.any() and bias < 0


# 3 suffix arrays


def brute_repeats(rows):
    """(n_bytes, n_removed, n_spans, kept) of rows that are in order."""
    seen, out = set(), []
    for b in rows:
        mark = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if (s := b[p : p + 100]) in seen:
                mark[p : p + 100] = True
            seen.add(s)
        kept = bytes(np.frombuffer(b, np.uint8)[~mark])
        out.append((len(b), int(mark.sum()), int((np.diff(np.concatenate(([0], mark.astype(int)))) == 1).sum()), kept))
    return out


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(60):
        pieces = [bytes(rng.integers(97, 97 + rng.integers(1, 4), rng.integers(1, 40)).astype(np.uint8)) for _ in range(rng.integers(1, 12))]
        t, starts = suffixes.layout(pieces)
        sizes = np.array([len(p) for p in pieces])
        sa = suffixes.suffix_array(t)
        ends = np.repeat(starts + sizes, sizes + 1)
        tail = lambda i: bytes(t[i : ends[i]].astype(np.uint8))
        assert sorted(sa) == list(range(len(t)))
        assert [tail(i) for i in sa] == sorted(tail(i) for i in sa)
        shared = suffixes.common_prefixes(t, sa, starts, sizes, 100)
        for a, b in itertools.pairwise(sa):
            x, y = tail(a), tail(b)
            n = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
            assert shared[b] == n


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_repeats_against_brute_force(spark, hot):
    common = words(40)
    texts = [common + words(30), words(50) + common, words(9) + common[3:] + " " + common, "ab" * 200, "é" * 120, common + words(5), "x" + "ab" * 90, words(300), "", "short"]
    docs = make(spark, list(enumerate(texts)))
    got = suffix_dedup.remove_repeats(docs, hot=hot).orderBy("doc_id").collect()
    assert [tuple(r[1:4]) + (bytes(r["kept"]),) for r in got] == brute_repeats([t.encode() for t in texts])


def test_repeats_awkward(spark, awkward):
    got = suffix_dedup.remove_repeats(awkward).collect()
    assert len(got) == awkward.count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_bytes"] == 0 and by[0]["n_removed"] == by[0]["n_bytes"] and by[None]["n_removed"] == 0  # the null id comes first
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


# 4 sharding


def test_sharding(spark):
    texts = [(i, words(int(n))) for i, n in enumerate(RNG.integers(1, 60, 1500))] + [(2000 + i, "copy " * 40) for i in range(700)]
    docs = make(spark, texts)
    got = sharding.shard_documents(docs, 8, cell_rows=50).collect()
    assert len(got) == len(texts)
    sizes, slots = [0] * 8, [[] for _ in range(8)]
    text = dict(texts)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert r["size"] == len(text[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
    assert max(sizes) - min(sizes) <= 2 * max(len(t) for _, t in texts) + 0.01 * sum(sizes) / 8
    assert all(sorted(s) == list(range(len(s))) for s in slots)


def test_sharding_awkward(spark, awkward):
    got = sharding.shard_documents(awkward).collect()
    assert len(got) == awkward.count() and {r["size"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert sharding.shard_documents(empty(spark)).count() == 0


# 5 exact dedup


def test_exact_dedup(spark, awkward):
    rows = [(r["doc_id"], r["text"] or "") for r in awkward.collect()]
    got = exact_dedup.mark_duplicates(awkward, salts=3).collect()
    assert len(got) == len(rows)
    for r in got:
        own = [(i, t) for i, t in rows if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"]]
        best = max((i for i, _ in own if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (best, len(own), r["doc_id"] == best)
    kept = exact_dedup.drop_duplicates(awkward, salts=3)
    assert kept.columns == awkward.columns
    assert sorted(r["text"] or "" for r in kept.collect()) == sorted({t for _, t in rows})
    assert exact_dedup.mark_duplicates(empty(spark)).count() == exact_dedup.drop_duplicates(empty(spark)).count() == 0


# 6 near duplicates


def brute_near(rows):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    for _ in range(len(sets)):
        for a, b in itertools.combinations(sets, 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    return {i: (len(sets[i]), root[i]) for i in sets}


def test_near_duplicates_against_brute_force(spark):
    texts = []
    for g in range(6):
        base = words(60, 500).split()
        for _ in range(12):  # some are linked only through others
            t = list(base)
            for k in RNG.integers(0, 60, int(RNG.integers(0, 6))):
                t[k] = f"z{RNG.integers(0, 10**6)}"
            texts.append(" ".join(t))
    texts += [words(60, 500) for _ in range(20)] + ["", None, "A b", "a B", " \n", "a b c"]
    rows = list(enumerate(texts))
    got = minhash.near_duplicates(make(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_near(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_bucket_comparison_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 2000)
    base = words(40, 500).split()
    rows = [(i, " ".join(f"y{i}" if k == i % 40 or k == 7 * i % 40 else w for k, w in enumerate(base))) for i in range(40)]
    got = minhash.near_duplicates(make(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_near(rows)


def test_superminhash_estimates():
    a = np.arange(1, 401, dtype=np.uint64) * np.uint64(7919)
    b = np.concatenate((a[:300], np.arange(5000, 5100, dtype=np.uint64)))
    signs = minhash.superminhash(np.concatenate((a, b)), np.array([len(a), len(b)]), 128)
    assert abs((signs[0] == signs[1]).mean() - 0.6) < 0.15
    alone = minhash.superminhash(a, np.array([len(a)]), 128)
    assert (alone[0] == signs[0]).all()


def test_no_pair_near_the_limit_is_lost(spark):
    """Pairs at 0.75 and a little above: all links are found, by signatures and by prefixes alike."""
    rng = random.Random(77)
    texts, links = [], 0
    for k in range(150):
        n = rng.randint(60, 300)
        base = [f"p{k}w{i}" for i in range(n + 4)]
        # Words at the end change: d shingles of n differ on both sides, (n - d) / (n + d) is just 0.75 or more.
        d = n // 7
        other = base[: n + 4 - d] + [f"q{k}w{i}" for i in range(d)]
        links += 100 * (n - d) >= 75 * (n + d)
        texts += [" ".join(base), " ".join(other)]
    docs = make(spark, list(enumerate(texts)))
    assert links == 150
    for exact in (False, True):
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, exact=exact).collect()}
        assert all(got[2 * k + 1] == 2 * k for k in range(150)), exact


def test_prefixes_against_brute_force(spark):
    rng = random.Random(3)
    base = [words(rng.randint(3, 60), 40).split() for _ in range(25)]
    rows = []
    for k in range(140):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"n{k}"
        rows.append((k, " ".join(w)))
    want = brute_near(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(make(spark, rows), exact=True).collect()}
    assert got == want


def test_join_spread(spark):
    left = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50).alias("k"))
    right = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = join_spread(left, right, "k", "id", crowd=40)
    assert sorted(map(tuple, got.select("id", "k", "v").collect())) == sorted((i, k, 2 * k) for i, k in map(tuple, left.collect()))


def test_near_duplicates_awkward(spark, awkward):
    got = minhash.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    by = {r["doc_id"]: r for r in got}
    assert by[4]["component_id"] == by[5]["component_id"] == 0 and by[7]["component_id"] == 6
    assert by[None]["kept"] and by[None]["component_id"] is None and by[1]["n_shingles"] == by[3]["n_shingles"] == 0
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(100, 50), (50, 70), (7, 7)]
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 100: 50, 70: 50}


# 7 quality


def brute_kneser_ney(texts, order):
    grams = {k: {} for k in range(1, order + 1)}
    for t in texts:
        b = b"\0" * (order - 1) + t
        for p in range(len(t)):
            g = b[p : p + order]
            grams[order][g] = grams[order].get(g, 0) + 1
    for k in range(order - 1, 0, -1):
        for g in grams[k + 1]:
            grams[k][g[1:]] = grams[k].get(g[1:], 0) + 1
    d = {k: quality.discounts([sum(c == n for c in grams[k].values()) for n in (1, 2, 3, 4)]) for k in grams}

    def p(g, k):
        if k == 0:
            return 1 / 256
        own = [c for x, c in grams[k].items() if x[:-1] == g[-k:-1]]
        if not own:
            return p(g, k - 1)
        c = grams[k].get(g[-k:], 0)
        rest = sum(d[k][min(x, 3) - 1] for x in own) / sum(own)
        return (max(c - d[k][min(c, 3) - 1], 0) if c else 0) / sum(own) + rest * p(g, k - 1)

    return p


def test_kneser_ney_against_brute_force(spark):
    texts = [words(30, 12), words(25, 12), "the unseen Ünder", "", None, words(10, 12) + "!!"]
    docs = make(spark, list(enumerate(texts)))
    trusted = spark.createDataFrame([(0,), (1,), (5,)], "doc_id long")
    got = {r["doc_id"]: r for r in quality.score_quality(docs, trusted, block_bytes=300).collect()}
    p = brute_kneser_ney([texts[i].encode() for i in (0, 1, 5)], quality.ORDER)
    for i, t in enumerate(texts):
        b = b"\0" * (quality.ORDER - 1) + (t or "").encode()
        logs = [np.log(p(b[k : k + quality.ORDER], quality.ORDER)) for k in range(len(b) - quality.ORDER + 1)]
        assert got[i]["perplexity"] == pytest.approx(float(np.exp(-np.mean(logs))) if logs else 1.0)
    assert all(got[i]["kept"] for i in (0, 1, 5) if got[i]["perplexity"] <= got[i]["threshold"])


def test_quality_awkward(spark, awkward):
    none = spark.createDataFrame([], "doc_id long")
    got = quality.score_quality(awkward, none).collect()
    assert len(got) == awkward.count() and all(r["kept"] for r in got)
    assert quality.score_quality(empty(spark), none).count() == 0


# 8 mixing


def test_temperature_weights():
    tokens = {"a": 900, "b": 90, "c": 10}
    x, w = mixing.temperature_weights(tokens, repeats=2.0)
    assert sum(w.values()) == pytest.approx(1) and all(1000 * w[k] <= 2 * tokens[k] * (1 + 1e-9) for k in w) and 0 < x < 1
    assert mixing.temperature_weights(tokens, repeats=1e9)[0] == 0
    assert mixing.temperature_weights(tokens, repeats=0.5)[0] == 1
    _, w = mixing.temperature_weights(tokens, repeats=1e9, entropy=0.7)
    assert -sum(v * np.log(v) for v in w.values()) == pytest.approx(0.7, abs=1e-6)
    assert mixing.temperature_weights({"a": 0})[1] == {"a": 0.0} and mixing.temperature_weights({})[1] == {}


def test_mixing_budgets(spark):
    texts = [(i, words(int(n))) for i, n in enumerate(RNG.integers(1, 50, 400))]
    docs = make(spark, texts).withColumn("source", F.when(F.col("doc_id") % 10 < 7, "big").when(F.col("doc_id") % 10 == 7, None).otherwise("small"))
    n = packing.word_count(F.col("text"))
    got = mixing.mix_sources(docs, n, block_tokens=300).collect()
    tokens = {}
    for r in docs.select("source", n.alias("n")).collect():
        tokens[r["source"]] = tokens.get(r["source"], 0) + r["n"]
    _, weights = mixing.temperature_weights(tokens, repeats=mixing.REPEATS)
    for s, total in tokens.items():
        own = sorted((r["_position"], r["_tokens"], r["doc_id"]) for r in got if r["source"] == s)
        budget = round(sum(tokens.values()) * weights[s])
        assert [p for p, _, _ in own] == list(itertools.accumulate([0] + [t for _, t, _ in own[:-1]]))  # no gap, no overlap
        assert own[-1][0] < budget <= own[-1][0] + own[-1][1]
        reads = {}
        for r in got:
            if r["source"] == s:
                reads.setdefault(r["doc_id"], []).append(r["_epoch"])
        assert all(len(set(e)) == len(e) for e in reads.values()) and max(map(len, reads.values())) - min(1, budget // total) <= np.ceil(budget / total)


def test_mixing_awkward(spark, awkward):
    got = mixing.mix_sources(awkward, packing.word_count(F.col("text")))
    assert set(awkward.columns) < set(got.columns) and got.count() > 0
    assert mixing.mix_sources(empty(spark), packing.word_count(F.col("text"))).count() == 0


# 9 top-k


def test_topk_against_brute_force(spark):
    v = RNG.normal(size=(300, 8)).astype(np.float32)
    v[10:40] = v[9]  # ties
    v[50] = 0
    rows = [(i, [float(x) for x in v[i]]) for i in range(300)] + [(400, None), (401, [float("nan")] * 8), (402, [1.0] * 7 + [None]), (None, [1.0] * 8), (403, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("q", F.lit(1))
    got = {}
    for r in topk.exact_topk(df, F.col("vec_id") % 50 == 0, k=5, chunk=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    q = np.floor(1024 * v.astype(float)).astype(int)
    for i in range(0, 300, 50):
        best = sorted(((-(q[i] @ q[j]), j) for j in range(300) if j != i))[:5]
        assert sorted(got[i]) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert set(got) == set(range(0, 300, 50))
    few = topk.exact_topk(df.where("vec_id < 3"), F.col("vec_id") == 0, k=10).collect()
    assert len(few) == 2
    assert topk.exact_topk(df.where("false"), F.col("vec_id") == 0).count() == 0


# 10 packing


def plain_best_fit(lengths, sources, clusters, capacity, per_source):
    bins, out = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [(left, b) for b, (left, s, c) in enumerate(bins) if left > 0 and left >= lengths[i] and (sources[i] < 0 or s.count(sources[i]) < per_source) and (clusters[i] < 0 or clusters[i] not in c)]
        b = min(fits)[1] if fits else len(bins)
        if b == len(bins):
            bins.append((capacity, [], []))
        left, s, c = bins[b]
        out[i] = (b, capacity - left)
        bins[b] = (left - lengths[i], [*s, sources[i]], [*c, clusters[i]])
    return out


def test_best_fit_against_plain_search():
    for _ in range(20):
        n = 120
        lengths, sources, clusters = RNG.integers(0, 60, n), RNG.integers(-1, 4, n), RNG.integers(-1, 30, n)
        bins, offsets = packing.best_fit(lengths, sources, clusters, 100, 2)
        want = plain_best_fit(lengths.tolist(), sources.tolist(), clusters.tolist(), 100, 2)
        assert [(int(b), int(o)) for b, o in zip(bins, offsets)] == [want[i] for i in range(n)]


def test_packing_awkward(spark, awkward):
    docs = awkward.withColumn("words", packing.word_count(F.col("text")))
    got = packing.pack(docs, F.col("words"), F.col("source"), F.xxhash64("text"), capacity=100, per_source=2, shard_rows=5).collect()
    whole = {}
    for r in got:
        whole.setdefault((r["doc_id"], r["text"]), []).append((r["piece"], r["piece_start"], r["piece_length"]))
        assert 0 <= r["bin_offset"] and r["bin_offset"] + r["piece_length"] <= 100
    assert sum(r["piece_length"] for r in got) == sum(r["words"] for r in docs.collect())
    by_bin = {}
    for r in got:
        by_bin.setdefault(r["bin_id"], []).append(r)
    for rows in by_bin.values():
        spans = sorted((r["bin_offset"], r["bin_offset"] + r["piece_length"]) for r in rows if r["piece_length"])
        assert all(a[1] <= b[0] for a, b in itertools.pairwise(spans))
        assert max([r["source"] for r in rows].count(s) for s in {r["source"] for r in rows}) <= 2
        texts = [r["text"] for r in rows if r["text"] is not None]
        assert len(texts) == len(set(texts))
    assert packing.pack(empty(spark), F.col("n_chars"), F.col("source"), F.col("doc_id")).count() == 0
