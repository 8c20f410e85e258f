"""Registered queries: broken runs that are taken up again, journaled model calls, faulty answers, scans over long keys."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cuecorpus.checkpoints import ensure_checkpoints
from cuecorpus.operators import keyframes, resume, timeline
from cuecorpus.operators.ordered import scan
from cuecorpus.plans import fixtures as v
from cuecorpus.plans import jobs, runner
from cuecorpus.plans.frame_queries import _EVENTS
from cuecorpus.plans.job_queries import _PLAN
from cuecorpus.plans.journal import Calls, Journal
from cuecorpus.plans.registry import query
from cuecorpus.sources.buckets import Buckets
from cuecorpus.sources.store import Store


def _fresh(spark, name: str) -> str:
    return f"{ensure_checkpoints(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _stages(texts, breaks: bool) -> list:
    """Small stages over documents; where ``breaks``, the second wave of vision doesn't survive."""
    waves = iter(range(1000))

    def vision(asked, found):
        rows = found("keyframes").join(asked.select("video_id"), "video_id", "left_semi").join(found("transcript").withColumnRenamed("text", "said"), "video_id")
        rows = rows.select("video_id", F.concat("text", F.lit(":"), F.substring("said", 1, 20)).alias("text"))
        return rows.withColumn("text", F.raise_error(F.lit("the run breaks here"))) if breaks and next(waves) == 1 else rows

    def summary(asked, found):
        rows = asked.select("video_id").join(found("transcript"), "video_id")
        seen = found("vision").groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
        return rows.join(seen, "video_id", "left").select("video_id", F.concat_ws(":", F.length("text"), F.coalesce("n", F.lit(0))).alias("text"))

    return [
        runner.Stage("transcript", lambda asked, found: asked.join(texts, "video_id").select("video_id", "text")),
        runner.Stage("keyframes", lambda asked, found: asked.select("video_id", F.explode(F.array(F.lit("f1"), F.lit("f2"))).alias("text"))),
        runner.Stage("vision", vision),
        runner.Stage("summary", summary),
    ]


@query(f"""WITH {_PLAN}, missed AS (SELECT video_id, with_vision, unnest(['transcript', 'keyframes', 'vision', 'summary']) AS stage, unnest([transcript, keyframes, vision, summary]) AS hit FROM plan)
SELECT stage, count(*) AS videos, CAST(1 AS BIGINT) AS times, CAST(CASE stage WHEN 'vision' THEN 2 ELSE 1 END AS BIGINT) AS runs, CAST(sum(CASE WHEN stage IN ('keyframes', 'vision') THEN 2 ELSE 1 END) AS BIGINT) AS artifact_rows,
  CAST(sum(CASE stage WHEN 'transcript' THEN length(text) WHEN 'keyframes' THEN 4 WHEN 'vision' THEN 2 * (3 + least(20, length(text))) ELSE length(CAST(length(text) AS VARCHAR)) + 2 END) AS BIGINT) AS artifact_chars
FROM missed JOIN documents ON doc_id = video_id WHERE NOT hit GROUP BY stage""")
def resumed_run(spark, d):
    """A run over all videos that breaks in the middle of a stage, and another that takes it up: what each stage made, how often
    it made a video at most, in how many runs, and what the artifacts hold."""
    store, requests, modes = Store(spark, _fresh(spark, "corpus")), v.v_requests(spark, d), v.v_modes(spark, d)
    texts = v.table(spark, d, "documents").select(F.col("doc_id").alias("video_id"), "text")
    known = v.v_stage_cache(spark, d).where(F.col("schema_version") == resume.SCHEMA_VERSION).join(requests.where("artifact").select("video_id", "stage"), ["video_id", "stage"], "left_semi")
    old = {s: known.where(F.col("stage") == s).join(texts, "video_id").select("video_id", F.col("text") if s == "transcript" else F.lit("old").alias("text")) for s in resume.STAGES}
    runner.adopt(store, known, old, F.lit("2024-01-01"))
    try:
        runner.run_stages(store, requests, modes, _stages(texts, True), "first", F.lit("2024-01-02"), waves=2)
    except PySparkException as e:
        if "the run breaks here" not in str(e):
            raise
    runner.run_stages(store, requests, modes, _stages(texts, False), "second", F.lit("2024-01-03"), waves=2)
    made = runner.made_by(store).where("run <> 'adopted' AND status = 'done'")
    each = made.groupBy("stage", "video_id").agg(F.count(F.lit(1)).alias("times"))
    report = each.groupBy("stage").agg(F.count(F.lit(1)).alias("videos"), F.max("times").alias("times"))
    runs = made.groupBy("stage").agg(F.countDistinct("run").alias("runs"))
    found = runner.Artifacts(store)
    held = None
    for s in resume.STAGES:
        own = found(s).join(each.where(F.col("stage") == s), "video_id", "left_semi").agg(F.lit(s).alias("stage"), F.count(F.lit(1)).alias("artifact_rows"), F.sum(F.length("text")).alias("artifact_chars"))
        held = own if held is None else held.unionByName(own)
    return report.join(runs, "stage").join(held, "stage")


class _Lost(BaseException):
    """What ends a worker, and no model's fault."""


def _reader(breaks: bool):
    def make():
        asked = []

        def answer(prompt: str, tokens, system: str, temperature: float):
            asked.append(prompt)
            if breaks and len(asked) > 40:
                raise _Lost
            return f"{len(prompt)}:{prompt[:20]}", "stop"

        return answer

    return make


@query("SELECT doc_id AS video_id, length(text) || ':' || substring(text, 1, 20) AS answer, 'ok' AS status, CAST(1 AS BIGINT) AS asked FROM documents")
def journaled_answers(spark, d):
    """Answers for all documents by a model whose workers are lost in a first run: the second asks only what wasn't answered."""
    rows = v.table(spark, d, "documents").select(F.col("doc_id").alias("video_id"), F.col("text").alias("prompt"))
    journal, calls = Journal(_fresh(spark, "journal"), "m"), Calls(in_flight=4, batch=16, pause=0.0)
    try:
        jobs.call_model(rows, _reader(True), 1000, calls, journal).write.format("noop").mode("overwrite").save()
    except PySparkException as e:
        if "_Lost" not in str(e):
            raise
    # Another column's worth of text tells requests apart that are answered alike.
    got = jobs.call_model(rows, _reader(False), 1000, calls, journal).select("video_id", "answer", "status", F.sha2("prompt", 256).alias("digest")).checkpoint()
    noted = spark.read.schema("signature string, answer array<string>").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").json(journal.folder)
    times = noted.groupBy("signature").agg(F.count(F.lit(1)).alias("asked"))
    signed = rows.select("video_id", jobs.request_signature(journal, F.col("prompt"), 1000).alias("signature"))
    return got.join(signed, "video_id").join(times, "signature").select("video_id", "answer", "status", "asked")


def _odd_eye():
    """Sees one frame at a time; some answers hold a number, an object, an empty later item, or no item."""

    def answer(parts, tokens, system: str, temperature: float):
        image = next(x for kind, x in parts if kind == "image")
        n = int(image[1:9])
        item = {"index": 1, "description": f"seen {image}", "visible_text": ["a", "b"], "importance": "HIGH"}
        if n % 101 == 0:
            item["description"] = 5
        if n % 103 == 0:
            item["description"] = {"text": "x"}
        items = [item, {"index": "1", "description": " "}] if n % 107 == 0 else [{"index": 1, "description": ""}, item] if n % 5 == 0 else [item]
        return json.dumps({"frames": [] if n % 109 == 0 else items})

    return answer


_ODD = """k AS (SELECT *, event_id % 101 = 0 OR event_id % 103 = 0 OR event_id % 107 = 0 OR event_id % 109 = 0 AS odd, row_number() OVER (PARTITION BY video_id ORDER BY timestamp, path) AS k FROM v_frames),
first AS (SELECT video_id, count(*) AS n, min(CASE WHEN odd THEN k END) AS bad FROM k GROUP BY 1)"""


def _oddly(spark, d):
    f = v.frames(spark, d).drop("hash_value")
    return jobs.analyze_frames(f, v.v_cues(spark, d), f.select("video_id", F.array(F.lit("term")).alias("terms")).distinct(), _odd_eye, 1)


@query(f"WITH {_ODD} SELECT video_id, path AS image, 'seen ' || path AS description FROM k JOIN first USING (video_id) WHERE bad IS NULL OR k < bad")
def vision_odd_results(spark, d):
    """Frames that a model describes up to its first unusable answer in each video: descriptions of other types, a later item
    that is empty, an item that is missing."""
    return _oddly(spark, d)[0].select("video_id", "image", "description")


@query(f"""WITH {_ODD} SELECT first.video_id, CASE WHEN bad IS NULL THEN 'completed' ELSE 'failed' END AS status, CASE WHEN event_id % 109 = 0 THEN 'missing_item' WHEN bad IS NOT NULL THEN 'missing_description' END AS error,
n AS requested_frames, coalesce(bad - 1, n) AS finished_frames, CAST(CASE WHEN bad IS NULL THEN n ELSE bad + 1 END AS INTEGER) AS calls, coalesce(bad - 1, n) AS batches FROM first LEFT JOIN k ON k.video_id = first.video_id AND k.k = bad""")
def vision_odd_report(spark, d):
    return _oddly(spark, d)[1].select("video_id", "status", "error", "requested_frames", "finished_frames", "calls", F.size("batch_seconds").cast("bigint").alias("batches"))


@query(f"""WITH {_ODD} SELECT first.video_id, CASE WHEN bad IS NULL THEN 'completed' ELSE 'failed' END AS status, CASE WHEN event_id % 109 = 0 THEN 'missing_item' WHEN bad IS NOT NULL THEN 'missing_description' END AS error,
CAST(coalesce(bad - 1, n) AS INTEGER) AS frame_count, bad IS NOT NULL AS told FROM first LEFT JOIN k ON k.video_id = first.video_id AND k.k = bad""")
def vision_documents(spark, d):
    """Documents of all videos, of those too whose frames weren't all described: status, error and the frames that were."""
    results, report = _oddly(spark, d)
    docs = timeline.render_visual_json(results, "m", reports=report.select("video_id", "status", "error", F.struct("calls", "batch_seconds").alias("metrics")))
    pages = timeline.render_visual_markdown(results, "m", reports=report.select("video_id", "status", "error"))
    told = F.col("markdown").contains("- 错误：") & F.col("markdown").contains("- 状态：failed")
    rows = docs.select("video_id", F.from_json("json", "status string, error string, frame_count int, frames array<struct<image:string>>").alias("j")).join(pages.select("video_id", told.alias("told")), "video_id")
    return rows.where(F.size("j.frames") == F.col("j.frame_count")).select("video_id", "j.status", "j.error", "j.frame_count", "told")


@query("""WITH e AS (SELECT CAST(1 AS BIGINT) AS video_id, conv_id, turn, role, length(text) AS n FROM conversations)
SELECT conv_id, turn, row_number() OVER w AS row_no, count(*) OVER (PARTITION BY video_id) AS key_rows, CAST(sum(n) OVER w AS BIGINT) AS chars, CAST(sum(CASE role WHEN 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY video_id) AS BIGINT) AS systems,
  last_value(CASE WHEN role = 'system' THEN conv_id END IGNORE NULLS) OVER w AS told, first_value(CASE WHEN n % 50 = 0 THEN conv_id END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY conv_id, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead, lag(role) OVER w AS came_before
FROM e WINDOW w AS (PARTITION BY video_id ORDER BY conv_id, turn)""")
def long_key_scan(spark, d):
    """All turns of all conversations as one video: numbers, sums and last known values over a key that is the whole table."""
    e = v.table(spark, d, "conversations").select(F.lit(1).cast("long").alias("video_id"), "conv_id", "turn", "role", F.length("text").alias("n"))
    got = scan(
        e, ["video_id"], ["conv_id", "turn"], row="row_no", size="key_rows", sums={"chars": F.col("n")}, totals={"systems": F.col("role") == "system"},
        last={"told": F.when(F.col("role") == "system", F.col("conv_id"))}, next={"ahead": F.when(F.col("n") % 50 == 0, F.col("conv_id"))}, previous={"came_before": F.col("role")},
    )
    return got.select("conv_id", "turn", "row_no", "key_rows", "chars", "systems", "told", "ahead", "came_before")


@query(_EVENTS)
def timeline_in_buckets(spark, d):
    """The timeline from tables that lie in buckets of the video, a table replaced in part before: no row changes its task."""
    corpus = Buckets(spark, _fresh(spark, "buckets"), f"c{uuid.uuid4().hex}", 8)
    cues, shown = v.v_cues(spark, d), v.v_visual(spark, d)
    corpus.write("cues", cues.withColumn("text", F.when(F.col("video_id") % 3 == 0, F.lit("old")).otherwise(F.col("text"))))
    corpus.upsert("cues", cues.where("video_id % 3 = 0"))
    corpus.write("shown", shown)
    events = timeline.build_timeline(corpus.read("cues"), corpus.read("shown"))
    if corpus.exchanges(events):
        raise AssertionError("rows are dealt by video again")
    return events


_SCAN_SELECT = """WITH RECURSIVE e AS (SELECT *, row_number() OVER (ORDER BY timestamp, CASE source WHEN 'scene' THEN 0 ELSE 1 END, path) AS k FROM v_frames),
walk AS (SELECT k, timestamp AS anchor, 1 AS g, true AS take FROM e WHERE k = 1
  UNION ALL SELECT e.k, CASE WHEN abs(e.timestamp - w.anchor) > 1 OR e.source = 'scene' THEN e.timestamp ELSE w.anchor END, CASE WHEN abs(e.timestamp - w.anchor) > 1 THEN w.g + 1 ELSE w.g END, abs(e.timestamp - w.anchor) > 1 OR e.source = 'scene' FROM walk w JOIN e ON e.k = w.k + 1)
SELECT e.path, e.timestamp, e.source FROM e JOIN (SELECT g, max(k) AS k FROM walk WHERE take GROUP BY g) USING (k)"""


@query(_SCAN_SELECT)
def long_video_frames(spark, d):
    """All frames as those of one video, merged where they are at most a second apart."""
    return keyframes.merge_near_frames(v.frames(spark, d).withColumn("video_id", F.lit(1).cast("long"))).select("path", "timestamp", "source")
