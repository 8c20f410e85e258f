"""Incremental runs, journaled calls, selection over ranges and scans over long keys, against what they replace."""

import json
import random
import subprocess
import sys

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cuecorpus.operators import keyframes, visual
from cuecorpus.operators.ordered import scan
from cuecorpus.plans import digests, jobs, runner
from cuecorpus.plans.journal import Calls, Journal, Reader
from cuecorpus.sources.store import Conflict, Store

FRAMES = "video_id long, path string, timestamp double, source string, hash_value long"


# Selection over ranges.


def row_model(rows, merge, similar, gap, threshold):
    """The selection over all frames of a video in order, in one loop."""
    out, waiting, last = [], None, None

    def keep(f):
        nonlocal last
        if not similar or last is None or f[2] == "scene" or f[1] - last[1] >= gap or ((f[3] ^ last[3]) & (2**64 - 1)).bit_count() > threshold:
            out.append(f[0])
            last = f

    for f in sorted(rows, key=lambda f: (f[1], f[2] != "scene", f[0])):
        if merge and waiting and f[1] - waiting[1] <= 1:
            waiting = f if f[2] == "scene" else waiting
            continue
        if waiting:
            keep(waiting)
        waiting = f
    if waiting:
        keep(waiting)
    return out


def some_frames(seed, n, wide, scenes=0.1):
    rng = random.Random(seed)
    hashes = [rng.getrandbits(62) for _ in range(4)]
    return [(f"p{i:05d}", round(rng.random() * wide, 1), "scene" if rng.random() < scenes else "periodic", rng.choice(hashes) ^ rng.getrandbits(2)) for i in range(n)]


@pytest.mark.parametrize("seed, wide, scenes", [(1, 3000, 0.1), (2, 300, 0.02), (3, 60, 0.0), (4, 100_000, 0.0), (5, 500, 0.5)])
def test_frames_over_ranges(spark, seed, wide, scenes):
    """One video in many ranges, with few or no places that forget, gives what one loop over it gives."""
    videos = {1: some_frames(seed, 600, wide, scenes), 2: some_frames(seed + 50, 3, wide, scenes), 3: some_frames(seed + 60, 200, wide / 3, scenes)}
    df = spark.createDataFrame([(v, *f) for v, rows in videos.items() for f in rows], FRAMES).repartition(6)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for merge, similar in ((True, False), (False, True), (True, True)):
            got = keyframes._selected(df, merge, similar, 12.0, 10)
            found = {}
            for r in got.collect():
                found.setdefault(r["video_id"], []).append(r["path"])
            assert {v: sorted(p) for v, p in found.items()} == {v: sorted(row_model(rows, merge, similar, 12.0, 10)) for v, rows in videos.items()}
        # The ranges of the long video did most of the work: little is left for the seams where scenes are common.
        assert df.repartitionByRange("video_id", "timestamp").where("video_id = 1").select(F.spark_partition_id()).distinct().count() > 5
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


# Scans.


@pytest.mark.parametrize("keys", [1, 40])
def test_scan_equals_windows(spark, keys):
    n = 100_000 if keys == 1 else 4000
    df = spark.range(n).select(
        (F.col("id") % keys if keys > 1 else F.lit(1)).cast("long").alias("k"), (F.hash("id") % 1000).alias("at"), "id",
        F.when(F.col("id") % 50 == 3, F.col("id")).alias("seldom"), (F.col("id") % 7).alias("x"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("y"),
    ).repartition(5)
    got = scan(df, ["k"], ["at", "id"], row="row", size="size", sums={"s": F.col("x")}, totals={"t": F.col("x")}, last={"l": F.col("seldom")}, next={"f": F.col("seldom")}, previous={"p": F.col("y")})
    own = W.partitionBy("k").orderBy("at", "id")
    back = W.partitionBy("k").orderBy(F.desc("at"), F.desc("id"))
    want = df.select(
        *df.columns, F.row_number().over(own).cast("long").alias("row"), F.count(F.lit(1)).over(W.partitionBy("k")).alias("size"), F.sum("x").over(own.rowsBetween(W.unboundedPreceding, 0)).alias("s"),
        F.sum("x").over(W.partitionBy("k")).alias("t"), F.last("seldom", True).over(own.rowsBetween(W.unboundedPreceding, 0)).alias("l"), F.last("seldom", True).over(back.rowsBetween(W.unboundedPreceding, 0)).alias("f"), F.lag("y").over(own).alias("p"),
    )
    assert got.columns == want.columns and got.count() == n
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


# Answers of vision models.


def test_one_rule_for_usable_answers(spark):
    rng = random.Random(11)
    say = ["seen", " ", "", 5, 2.5, True, None, {"a": 1}, [], ["a", " "], [None], [" "], [3]]
    place = [1, 2, 3, "1", " 2 ", "2.0", "x", 1.7, True, None, [1], -1]

    def item():
        x = {"index": rng.choice(place), "description": rng.choice(say[:2] * 4 + say)}
        return rng.choice([x, x, x, {k: v for k, v in x.items() if rng.random() < 0.8}, 7, None, "text"])

    contents = []
    for _ in range(400):
        body = json.dumps({"frames": [*({"index": k, "description": "d"} for k in range(1, rng.randint(1, 4))), *(item() for _ in range(rng.randint(0, 3)))]})
        contents.append(rng.choice([body, body, f"```json\n{body}\n```", f"so: {body} .", f"[{body}]", body[:-1], body.replace('"frames"', '"frame"'), body.replace('"d"', "NaN", 1), "{}", ""]))
    batches = [(i, f"p{k}", float(k), "scene", 0, k) for i in range(len(contents)) for k in (1, 2)]
    got = visual.attach_visual_results(
        spark.createDataFrame([(i, 0, c) for i, c in enumerate(contents)], "video_id long, batch int, content string"), spark.createDataFrame(batches, "video_id long, path string, timestamp double, source string, batch int, index int")
    )
    errors = {r["video_id"]: r["error"] for r in got.collect()}
    assert len({jobs.fault_of(c, 2) for c in contents}) == 4
    assert errors == {i: jobs.fault_of(c, 2) for i, c in enumerate(contents)}


# The journal.


def test_journal_keeps_what_is_answered(spark, tmp_path):
    journal = Journal(f"file://{tmp_path}/j", "m", "run")
    entries = [(f"{k:02x}key{k:04d}", f"s{k}", [k], k == 7) for k in range(0, 200, 3)] + [("07key0007", "s7", "fault", True)]
    Reader(journal).append(entries[:30])
    Reader(journal).append(entries[30:])
    same, other = Reader(journal), Reader(journal._replace(run="another"))
    for k, s, a, bad in sorted(entries):
        assert same.get(k, s) == a and other.get(k, s) == (None if bad else a) and same.get(k, "else") is None
    seen = tmp_path / "calls"

    def make():
        def model(prompt, tokens, system, temperature):
            with open(seen, "a") as f:
                f.write(prompt + "\n")
            if prompt == "busy" and open(seen).read().split().count("busy") < 3:
                raise RuntimeError("429 rate limit")
            if prompt == "bad":
                raise RuntimeError("no")
            return f"<{prompt}>", "stop"

        return model

    df = spark.createDataFrame([(i, p) for i, p in enumerate(["a", "b", "a", "busy", "bad", *map(str, range(60))])], "i int, prompt string")
    calls, journal = Calls(in_flight=4, batch=8, pause=0.01), Journal(f"{tmp_path}/k", "m")
    first = {r["i"]: (r["answer"], r["status"]) for r in jobs.call_model(df, make, 100, calls, journal).collect()}
    assert first[0] == first[2] == ("<a>", "ok") and first[3] == ("<busy>", "ok") and first[4] == ("no", "error")
    asked = seen.read_text().split()
    assert asked.count("a") == 1 and asked.count("busy") == 3
    assert {r["i"]: (r["answer"], r["status"]) for r in jobs.call_model(df, make, 100, calls, journal).collect()} == first
    again = seen.read_text().split()[len(asked) :]
    assert again == ["bad"]  # a fault of another run is asked for again
    plain = {r["i"]: (r["answer"], r["status"]) for r in jobs.call_model(df, make, 100, calls).collect()}
    assert plain == first


KILLED = """
import os, sys
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from cuecorpus.plans import jobs
from cuecorpus.plans.journal import Calls, Journal
here = sys.argv[1]
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", here + "/cp").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
def note(x):
    with open(here + "/calls", "a") as f:
        f.write(x + "\\n")
def once(n):
    # The worker dies at the n-th call of all, once.
    if len(open(here + "/calls").read().split()) == n and not os.path.exists(here + f"/dead{n}"):
        open(here + f"/dead{n}", "w").close()
        os._exit(1)
def make():
    def model(prompt, tokens, system, temperature):
        note(prompt)
        once(37)
        return prompt.upper(), "stop"
    return model
df = spark.range(100).select(F.concat(F.lit("p"), "id").alias("prompt"))
got = jobs.call_model(df, make, 10, Calls(in_flight=1, batch=8), Journal(here + "/j", "m")).collect()
assert sorted(r["answer"] for r in got) == sorted(f"P{i}" for i in range(100))
asked = open(here + "/calls").read().split()
assert os.path.exists(here + "/dead37") and len(set(asked)) == 100 and len(asked) <= 108, len(asked)
open(here + "/calls", "w").close()
def see():
    def model(parts, tokens, system, temperature):
        images = [x for kind, x in parts if kind == "image"]
        note("+".join(images))
        once(11)
        return '{"frames": [%s]}' % ", ".join('{"index": %d, "description": "d"}' % k for k in range(1, len(images) + 1))
    return model
frames = spark.range(60).select((F.col("id") % 2).alias("video_id"), F.concat(F.lit("i"), "id").alias("path"), F.col("id").cast("double").alias("timestamp"), F.lit("periodic").alias("source"))
none = spark.createDataFrame([], "video_id long, seq long, ts string, seconds double, text string")
results, report = jobs.analyze_frames(frames, none, spark.createDataFrame([], "video_id long, terms array<string>"), see, 3, journal=Journal(here + "/v", "m"))
assert results.count() == 60 and {r["status"] for r in report.collect()} == {"completed"}
asked = open(here + "/calls").read().split()
assert os.path.exists(here + "/dead11") and len(set(asked)) == 20 and len(asked) == 21, asked
print("fine")
os._exit(0)
"""


def test_a_killed_worker_asks_one_batch_again(tmp_path):
    got = subprocess.run([sys.executable, "-c", KILLED, str(tmp_path)], capture_output=True, text=True, timeout=300)
    assert got.stdout.strip().endswith("fine"), got.stderr[-3000:]


# Stores and runs.


def test_store_versions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.version() == 0 and store.read("t") is None
    one = spark.createDataFrame([(1, "a")], "video_id long, x string")
    base = store.manifest()
    store.publish(base, {"t": [store.write("t", one, 1)]})
    assert store.version() == 1 and [tuple(r) for r in store.read("t").collect()] == [(1, "a", 1)]
    with pytest.raises(Conflict):  # a second writer of the same version
        store.publish(base, {"t": [store.write("t", one, 1)]})
    store.publish(store.manifest(), {"t": [store.write("t", one, 2)]})
    assert store.read("t").count() == 2 and store.read("t", 1).count() == 1
    store.compact("t", store.read("t").where("_commit = 2"))
    assert store.read("t").count() == 1 and store.read("t", 2).count() == 2
    assert not [p.name for p in (tmp_path / "s" / "manifests").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def world(spark):
    videos = spark.createDataFrame(
        [(1, "eins", "u1", None, 60.0, ["en"], []), (2, "zwei", "u2", None, 60.0, [], []), (3, "drei", "u3", None, 60.0, ["en"], [])],
        "video_id long, title string, webpage_url string, uploader string, duration double, subtitle_langs array<string>, automatic_caption_langs array<string>",
    )
    srt = "1\n00:00:01,000 --> 00:00:02,000\nhello {}\n\n2\n00:00:20,000 --> 00:00:21,000\nagain"
    files = spark.createDataFrame([(v, "a.en.srt", ".srt", srt.format(v)) for v in (1, 3)], "video_id long, file_name string, ext string, content string")
    asr = spark.createDataFrame([(2, 0, 0.4, "spoken")], "video_id long, seq long, start double, text string")
    rng = random.Random(5)
    candidates = spark.createDataFrame([(v, f"v{v}-{k}.jpg", 7.0 * k, "scene" if k % 3 == 0 else "periodic", rng.getrandbits(62)) for v in (1, 2) for k in range(8)], FRAMES)
    modes = spark.createDataFrame([(1, True, True), (2, True, True), (3, False, True)], "video_id long, with_vision boolean, with_summary boolean")
    return digests.Sources(videos, files, asr, candidates), modes


def reader(log, fails=False):
    def make():
        def model(prompt, tokens, system, temperature):
            with open(log, "a") as f:
                f.write("summary\n")
            if fails:
                raise RuntimeError("no service")
            return f"<{len(prompt)}>{'VISION' if '画面' in prompt else ''}", "stop"

        return model

    return make


def watcher(log, blind=()):
    def make():
        def model(parts, tokens, system, temperature):
            images = [x for kind, x in parts if kind == "image"]
            with open(log, "a") as f:
                f.write("+".join(images) + "\n")
            if any(x in blind for x in images):
                raise RuntimeError("cannot see")
            return json.dumps({"frames": [{"index": k, "description": f"Bild {x}", "visible_text": f"Zeile {x}", "importance": "high"} for k, x in enumerate(images, 1)]})

        return model

    return make


def test_digest_from_candidates_to_summaries(spark, tmp_path):
    """A failed vision run keeps its finished frames and leaves no summary; the next asks for the rest only; a third for nothing."""
    sources, modes = world(spark)
    store, log = Store(spark, f"file://{tmp_path}/s"), tmp_path / "log"
    settings = digests.Settings("{title}|{transcript}", "画面 {title}|{transcript}", batch=2, max_chars=4000)

    def go(run, **models):
        log.write_text("")
        report = digests.digest_corpus(store, sources, models.pop("settings", settings), models.pop("modes", modes), models.get("make", reader(log)), models.get("see", watcher(log)), run, F.current_timestamp(), calls=Calls(pause=0.0))
        return {(r["stage"], r["status"]): r["videos"] for r in report.collect()}, log.read_text().split()

    made, asked = go("a", see=watcher(log, ("v1-4.jpg",)))
    assert made == {("transcript", "done"): 3, ("keyframes", "done"): 2, ("vision", "done"): 1, ("vision", "failed"): 1, ("summary", "done"): 2}
    docs = {r["video_id"]: (json.loads(r["json"]), r["markdown"]) for r in digests.visual_documents(store, "m").collect()}
    assert docs[1][0]["status"] == "failed" and docs[1][0]["error"] == "cannot see" and [f["image"] for f in docs[1][0]["frames"]] == [f"v1-{k}.jpg" for k in range(4)]
    assert "- 状态：failed" in docs[1][1] and "- 错误：cannot see" in docs[1][1] and "v1-3.jpg" in docs[1][1]
    assert docs[2][0]["status"] == "completed" and "error" not in docs[2][0] and len(docs[2][0]["metrics"]["batch_seconds"]) == 4
    found = runner.Artifacts(store)
    assert {r["video_id"]: r["source"] for r in found("summary").collect()} == {2: "whisper+vision", 3: "manual_subtitle"}

    made, asked = go("b")
    assert made == {("vision", "done"): 1, ("summary", "done"): 1}
    assert asked == ["v1-4.jpg+v1-5.jpg", "v1-6.jpg+v1-7.jpg", "summary"]
    assert {r["video_id"]: r["n"] for r in found("vision").where("image IS NOT NULL").groupBy("video_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {1: 8, 2: 8}
    assert {r["video_id"] for r in found("summary").where("summary LIKE '%VISION'").collect()} == {1, 2}
    version = store.version()

    assert go("c") == ({}, []) and store.version() == version

    # No vision for a video, and a model that is gone: its visual artifacts go, and no summary is left of what changed.
    text = modes.withColumn("with_vision", F.col("video_id") == 2)
    made, asked = go("d", modes=text, make=reader(log, True))
    assert made == {("summary", "failed"): 1} and asked == ["summary"]
    assert {r["video_id"] for r in found("vision").select("video_id").distinct().collect()} == {2}
    assert {r["video_id"] for r in found("summary").collect()} == {2, 3} and {r["video_id"] for r in found("summary", failed=True).collect()} == {1}


def test_a_run_that_breaks_loses_one_wave(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    wanted = spark.range(40).select(F.col("id").alias("video_id"), F.lit("transcript").alias("stage"), F.concat(F.lit("s"), "id").alias("signature"))
    modes = spark.range(40).select(F.col("id").alias("video_id"), F.lit(False).alias("with_vision"), F.lit(False).alias("with_summary"))
    waves = []

    def make(breaks):
        def transcript(asked, found):
            waves.append(sorted(r["video_id"] for r in asked.collect()))
            rows = asked.select("video_id", F.lit("x").alias("text"))
            return rows.withColumn("text", F.raise_error(F.lit("lost"))) if breaks and len(waves) == 3 else rows.where("video_id <> 5")

        return [runner.Stage("transcript", transcript)]

    with pytest.raises(PySparkException):
        runner.run_stages(store, wanted, modes, make(True), "one", F.lit("2024-01-01"), waves=4)
    assert store.version() == 2 and runner.Artifacts(store)("transcript").count() in range(len(waves[0]) + len(waves[1]) - 1, len(waves[0]) + len(waves[1]) + 1)
    done = {v for w in waves[:2] for v in w}
    report = {r["status"]: r["videos"] for r in runner.run_stages(store, wanted, modes, make(False), "two", F.lit("2024-01-02"), waves=4).collect()}
    again = {v for w in waves[3:] for v in w}
    assert sum(report.values()) == len(again) and again & done <= {5} and again | done == set(range(40))
    assert runner.missing(store, wanted, modes).select("video_id").collect()[0][0] == 5 and runner.Artifacts(store)("transcript").count() == 39
    runner.compact(store, "transcript")
    runner.compact(store, runner.CACHE)
    assert len(store.manifest()["tables"]["transcript"]) == 1 and runner.Artifacts(store)("transcript").count() == 39
    assert runner.missing(store, wanted, modes).count() == 1


# Buckets.


def test_tables_in_buckets(spark, tmp_path):
    from cuecorpus.operators import timeline
    from cuecorpus.sources.buckets import Buckets, buckets_for

    assert [buckets_for(x, 10) for x in (0, 10, 11, 20, 21, 1000)] == [1, 1, 2, 2, 4, 128]
    corpus = Buckets(spark, f"file://{tmp_path}/b", "talks", 4)
    cues = spark.createDataFrame([(v, k, f"00:00:{k:02d}", float(k), f"cue {k}") for v in range(9) for k in range(6)], "video_id long, seq long, ts string, seconds double, text string")
    seen = spark.createDataFrame(
        [(v, float(k) + 0.5, "00:00:00", f"f{k}.jpg", "scene", f"d{v} {k} " * 9, f"text {k} " * 9, "high", "") for v in range(9) for k in range(20)],
        "video_id long, timestamp_seconds double, timestamp string, image string, frame_source string, description string, visible_text string, importance string, uncertainty string",
    )
    corpus.write("cues", cues)
    corpus.write("seen", seen.where("video_id <> 4"))
    corpus.upsert("seen", seen.where("video_id IN (4, 5)"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (None, 500):
            got = timeline.build_timeline(corpus.read("cues"), corpus.read("seen"), most)
            want = timeline.build_timeline(cues, seen, most)
            assert corpus.exchanges(got) == 0 < corpus.exchanges(want)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert corpus.read("seen").count() == 180
    with pytest.raises(ValueError):
        Buckets(spark, "x", "a b", 1)
