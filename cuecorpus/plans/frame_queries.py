"""Registered queries: frames, speech around them, what screens show, the timeline."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cuecorpus.checkpoints import in_waves
from cuecorpus.functions import text as t
from cuecorpus.operators import keyframes, timeline, visual
from cuecorpus.plans import fixtures as v
from cuecorpus.plans.registry import query

join = lambda c: F.array_join(c, "|")
#: Bytes of text that the answers of a wave hold, about.
ANSWER_BYTES = 1_000_000_000


@query("""SELECT video_id, CASE WHEN ok THEN round(greatest(5.0, duration / (4 * b)), 3) ELSE 5.0 END::DOUBLE AS scan_interval, CASE WHEN ok THEN round(least(45.0, greatest(15.0, duration / greatest(b - 1, 1))), 3) ELSE 45.0 END::DOUBLE AS max_gap,
  CAST(CASE WHEN ok THEN b ELSE 16 END AS INTEGER) AS max_frames FROM (SELECT video_id, duration, coalesce(duration > 0, false) AS ok, least(60, greatest(8, floor(duration / 30) + 1)) AS b FROM v_videos)""")
def sampling_plan(spark, d):
    return keyframes.sampling_plan(v.v_videos(spark, d).select("video_id", "duration"), 5, 45, 60).select("video_id", "scan_interval", "max_gap", "max_frames")


def _log_files(spark, d):
    return v.v_frames(spark, d).select("video_id", "event_id", F.when(F.col("source") == "scene", "scene").otherwise("periodic").alias("kind"), "path", "timestamp")


@query("""WITH f AS (SELECT video_id, source AS kind, path, event_id, timestamp, row_number() OVER (PARTITION BY video_id, source ORDER BY path) - 1 AS pos, count(*) OVER (PARTITION BY video_id, source) AS n FROM v_frames)
SELECT video_id, path, kind AS source, CASE WHEN kind = 'periodic' AND video_id % 5 = 0 THEN pos * 5.0 ELSE timestamp END::DOUBLE AS timestamp FROM f
WHERE NOT (kind = 'scene' AND video_id % 5 = 0 AND pos = n - 1)""")
def frames_from_log(spark, d):
    f = _log_files(spark, d)
    lines = f.groupBy("video_id", "kind").agg(F.array_sort(F.collect_list(F.struct("path", F.col("timestamp").cast("string").alias("t")))).alias("_l"))
    # Some logs lack their last line.
    kept = F.when(F.col("video_id") % 5 == 0, F.slice("_l", 1, F.greatest(F.size("_l") - 1, F.lit(0)))).otherwise(F.col("_l"))
    log = F.array_join(F.transform(kept, lambda x, i: F.concat(F.lit("[info] n: "), i.cast("string"), F.lit(" pts: 1 pts_time:"), x["t"], F.lit(" fmt"))), "\n")
    return keyframes.frames_from_showinfo(f.select("video_id", "kind", "path"), lines.select("video_id", "kind", log.alias("log")), 5)


@query("SELECT vec_id, hash_value FROM v_hash")
def frame_hash(spark, d):
    return v.v_hash(spark, d)


@query("SELECT a.vec_id, CAST(bit_count(xor(a.hash_value, b.hash_value)) AS INTEGER) AS distance FROM v_hash a JOIN v_hash b ON b.vec_id = a.vec_id + 1")
def hamming(spark, d):
    h = v.v_hash(spark, d)
    return h.join(h.select((F.col("vec_id") - 1).alias("vec_id"), F.col("hash_value").alias("b")), "vec_id").select("vec_id", t.hamming(F.col("hash_value"), F.col("b")).alias("distance"))


_MERGE = """WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY timestamp, CASE source WHEN 'scene' THEN 0 ELSE 1 END, path) AS k FROM v_frames),
walk AS (SELECT video_id, k, timestamp AS anchor, 1 AS g, true AS take FROM o WHERE k = 1
  UNION ALL SELECT o.video_id, o.k, CASE WHEN abs(o.timestamp - w.anchor) > 1 OR o.source = 'scene' THEN o.timestamp ELSE w.anchor END, CASE WHEN abs(o.timestamp - w.anchor) > 1 THEN w.g + 1 ELSE w.g END, abs(o.timestamp - w.anchor) > 1 OR o.source = 'scene'
  FROM walk w JOIN o ON o.video_id = w.video_id AND o.k = w.k + 1),
merged AS (SELECT o.video_id, o.path, o.timestamp, o.source, o.hash_value FROM o JOIN (SELECT video_id, g, max(k) AS k FROM walk WHERE take GROUP BY 1, 2) l ON l.video_id = o.video_id AND l.k = o.k)"""
_FILTER = """, m AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY timestamp, CASE source WHEN 'scene' THEN 0 ELSE 1 END, path) AS k FROM {source}),
pick AS (SELECT video_id, k, timestamp AS anchor, hash_value AS h, true AS keep FROM m WHERE k = 1
  UNION ALL SELECT m.video_id, m.k, CASE WHEN {keep} THEN m.timestamp ELSE p.anchor END, CASE WHEN {keep} THEN m.hash_value ELSE p.h END, {keep} FROM pick p JOIN m ON m.video_id = p.video_id AND m.k = p.k + 1)
""".replace("{keep}", "(m.source = 'scene' OR bit_count(xor(p.h, m.hash_value)) > 10 OR m.timestamp - p.anchor >= {gap})")


@query(_MERGE + " SELECT video_id, path, timestamp, source FROM merged")
def merge_near_frames(spark, d):
    return keyframes.merge_near_frames(v.frames(spark, d)).select("video_id", "path", "timestamp", "source")


@query("WITH RECURSIVE z AS (SELECT 1)" + _FILTER.replace("{source}", "v_frames").replace("{gap}", "12") + " SELECT m.video_id, m.path, m.timestamp, m.source FROM m JOIN pick p ON p.video_id = m.video_id AND p.k = m.k WHERE p.keep")
def drop_similar_frames(spark, d):
    return keyframes.drop_similar_frames(v.frames(spark, d), 12).select("video_id", "path", "timestamp", "source")


def _cap(source: str, most: str, name: str = "capped") -> str:
    even = "list_contains(list_transform(range(0, CAST({c} AS BIGINT)), lambda i: CAST(round_even(i * (sz - 1) / greatest({c} - 1, 1), 0) AS BIGINT)), pos)"
    sample = lambda c: f"({c} > 0 AND CASE WHEN sz <= {c} THEN true WHEN {c} = 1 THEN pos = sz // 2 ELSE {even.format(c=c)} END)"
    return f"""c1 AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY timestamp, CASE source WHEN 'scene' THEN 0 ELSE 1 END, path) AS q, count(*) OVER (PARTITION BY video_id) AS n FROM {source}),
c2 AS (SELECT *, q = 1 OR q = n OR source = 'scene' AS anchor FROM c1),
c3 AS (SELECT *, sum(anchor::INT) OVER (PARTITION BY video_id) AS na, row_number() OVER (PARTITION BY video_id, anchor ORDER BY q) - 1 AS pos, count(*) OVER (PARTITION BY video_id, anchor) AS sz FROM c2),
{name} AS (SELECT * FROM c3 WHERE CASE WHEN n <= {most} THEN true WHEN na >= {most} THEN anchor AND {sample(most)} ELSE anchor OR {sample(f"({most} - na)")} END)"""


@query("WITH " + _cap("v_frames", "20") + " SELECT video_id, path, timestamp, source FROM capped")
def cap_frames(spark, d):
    return keyframes.cap_frames(v.frames(spark, d), 20).select("video_id", "path", "timestamp", "source")


@query("""WITH o AS (SELECT video_id, path, row_number() OVER (PARTITION BY video_id ORDER BY path) - 1 AS pos, count(*) OVER (PARTITION BY video_id) AS n FROM v_frames)
SELECT video_id, path FROM o WHERE n <= 9 OR list_contains(list_transform(range(0, 9), lambda i: CAST(round_even(i * (n - 1) / 8, 0) AS BIGINT)), pos)""")
def even_sample(spark, d):
    return keyframes.even_sample(v.frames(spark, d), 9, ["video_id"], ["path"]).select("video_id", "path")


@query("""SELECT video_id, path, printf('%04d', row_number() OVER (PARTITION BY video_id ORDER BY timestamp, CASE source WHEN 'scene' THEN 0 ELSE 1 END, path)) || printf('-%02d-%02d-%02d.jpg', s // 3600, s % 3600 // 60, s % 60) AS name
FROM (SELECT *, CAST(floor(timestamp) AS BIGINT) AS s FROM v_frames)""")
def name_keyframes(spark, d):
    return keyframes.name_keyframes(v.frames(spark, d)).select("video_id", "path", "name")


@query(_MERGE + _FILTER.replace("{source}", "(SELECT f.*, g.max_gap, g.most FROM merged f JOIN plan g USING (video_id))").replace("{gap}", "m.max_gap").replace(", m AS", """, plan AS (SELECT video_id, CASE WHEN ok THEN round(least(45.0, greatest(15.0, duration / greatest(b - 1, 1))), 3) ELSE 45.0 END::DOUBLE AS max_gap, CASE WHEN ok THEN b ELSE 16 END AS most
FROM (SELECT video_id, duration, coalesce(duration > 0, false) AS ok, least(60, greatest(8, floor(duration / 30) + 1)) AS b FROM v_videos)), m AS""", 1) + ", kept AS (SELECT m.* EXCLUDE (k) FROM m JOIN pick p ON p.video_id = m.video_id AND p.k = m.k WHERE p.keep), " + _cap("kept", "most") + """
SELECT video_id, path, timestamp, source, printf('%04d', row_number() OVER (PARTITION BY video_id ORDER BY q)) || printf('-%02d-%02d-%02d.jpg', CAST(floor(timestamp) AS BIGINT) // 3600, CAST(floor(timestamp) AS BIGINT) % 3600 // 60, CAST(floor(timestamp) AS BIGINT) % 60) AS name FROM capped""")
def select_keyframes(spark, d):
    return keyframes.select_keyframes(v.frames(spark, d), v.v_videos(spark, d)).select("video_id", "path", "timestamp", "source", "name")


@query("SELECT video_id, string_agg(source || '=' || n, '|' ORDER BY source) AS sources FROM (SELECT video_id, source, count(*) AS n FROM v_frames GROUP BY 1, 2) GROUP BY video_id")
def frame_sources(spark, d):
    got = keyframes.frame_source_counts(v.frames(spark, d))
    return got.select("video_id", F.array_join(F.transform(F.map_entries("sources"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "|").alias("sources"))


_NEAR = "SELECT f.video_id, f.path, rtrim(substring(string_agg(c.text, ' ' ORDER BY c.seq), 1, 500)) AS context FROM v_frames f JOIN v_cues c ON c.video_id = f.video_id AND abs(c.seconds - f.timestamp) <= 15 GROUP BY 1, 2"


@query(_NEAR)
def nearby_context(spark, d):
    return visual.nearby_context(v.frames(spark, d), v.v_cues(spark, d))


@query("""SELECT video_id, path, rtrim(substring(text, 1, 500)) AS context FROM (SELECT f.video_id, f.path, c.text, row_number() OVER (PARTITION BY f.video_id, f.path ORDER BY abs(c.seconds - f.timestamp), c.seq) AS r
FROM v_frames f JOIN v_cues c ON c.video_id = f.video_id AND c.seconds IS NOT NULL) WHERE r = 1""")
def nearest_cue(spark, d):
    return visual.nearest_cue(v.frames(spark, d), v.v_cues(spark, d))


def _existing(spark, d):
    got = v.v_visual(spark, d).where("event_id % 3 <> 0")
    extra = got.where("event_id % 31 = 0").withColumn("image", F.concat(F.lit("gone-"), "image"))
    i = F.col("event_id")
    return got.unionByName(extra).withColumns({"model": F.when(i % 7 == 0, "other").otherwise("m"), "analysis_signature": F.when(i % 11 == 0, "old").otherwise("s")})


@query("SELECT video_id, path FROM v_frames WHERE event_id % 3 = 0 OR event_id % 7 = 0 OR event_id % 11 = 0")
def pending_frames(spark, d):
    f = v.frames(spark, d)
    return visual.pending_frames(f, visual.reused_results(f, _existing(spark, d), "m", "s")).select("video_id", "path")


@query("SELECT video_id, image, importance FROM v_visual WHERE event_id % 3 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0")
def reused_results(spark, d):
    return visual.reused_results(v.frames(spark, d), _existing(spark, d), "m", "s").select("video_id", "image", "importance")


@query("SELECT video_id, bool_and(event_id % 97 <> 0) AS covered FROM v_frames GROUP BY video_id")
def visual_coverage(spark, d):
    return visual.coverage(v.frames(spark, d), v.v_visual(spark, d).where("event_id % 97 <> 0"))


@query("WITH f AS MATERIALIZED (SELECT video_id, path, event_id FROM v_frames) SELECT f.video_id, f.path FROM f LEFT JOIN (SELECT DISTINCT video_id FROM f WHERE event_id % 97 = 0) g USING (video_id) WHERE f.video_id % 9 <> 0 AND g.video_id IS NULL")
def cached_keyframes(spark, d):
    f = v.v_frames(spark, d)
    cache = f.select("video_id", F.concat(F.lit("s"), F.col("video_id").cast("string")).alias("signature"), "path")
    wanted = f.select("video_id", F.concat(F.when(F.col("video_id") % 9 == 0, "x").otherwise("s"), F.col("video_id").cast("string")).alias("signature")).distinct()
    return visual.valid_cached_keyframes(cache, f.where("event_id % 97 <> 0"), wanted).select("video_id", "path")


@query("SELECT video_id, path, CAST(k // 4 AS INTEGER) AS batch, CAST(k % 4 + 1 AS INTEGER) AS index FROM (SELECT video_id, path, row_number() OVER (PARTITION BY video_id ORDER BY timestamp, path) - 1 AS k FROM v_frames)")
def frame_batches(spark, d):
    return visual.assign_batches(v.frames(spark, d), 4).select("video_id", "path", "batch", "index")


_BATCHES = "b AS (SELECT video_id, k // 4 AS batch, min(k) AS f, count(*) AS n FROM (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY timestamp, path) - 1 AS k FROM v_frames) GROUP BY 1, 2)"


def _batches(spark, d):
    b = visual.assign_batches(v.frames(spark, d), 4)
    return b.groupBy("video_id", "batch").agg((F.min(F.col("batch") * 4)).alias("first"), F.count(F.lit(1)).cast("int").alias("n"))


@query(f"""WITH {_BATCHES} SELECT video_id, CAST(batch AS INTEGER) AS batch, CAST(h AS INTEGER) AS half, CAST(CASE h WHEN 0 THEN f ELSE f + n // 2 END AS INTEGER) AS first, CAST(CASE h WHEN 0 THEN n // 2 ELSE n - n // 2 END AS INTEGER) AS n
FROM b, (VALUES (0), (1)) x(h) WHERE n > 1 AND batch % 3 = 0""")
def split_batches(spark, d):
    return visual.split_failed_batches(_batches(spark, d).where("batch % 3 = 0"))


@query(f"""WITH {_BATCHES} SELECT video_id, CAST(sum(n) AS BIGINT) AS requested_frames, count(*) AS batches, CAST(sum((batch % 3 = 0)::INT) AS BIGINT) AS fallback_splits, CAST(min(n) AS INTEGER) AS effective_batch_size, round(sum(n * 0.25), 3)::DOUBLE AS seconds FROM b GROUP BY video_id""")
def vision_metrics(spark, d):
    return visual.vision_metrics(_batches(spark, d).withColumns({"seconds": F.col("n") * 0.25, "split": F.col("batch") % 3 == 0}))


@query("""WITH b AS (SELECT v.*, k // 4 AS batch, k % 4 + 1 AS index FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY timestamp_seconds, image) - 1 AS k FROM v_shown) v),
j AS (SELECT *, CASE WHEN batch % 10 = 6 AND count(*) OVER (PARTITION BY video_id, batch) = 1 THEN 'no_frames' WHEN batch % 10 = 6 THEN 'missing_item' END AS error FROM b)
SELECT video_id, CAST(batch AS INTEGER) AS batch, CASE WHEN error IS NULL THEN CAST(index AS INTEGER) END AS index, error, CASE WHEN error IS NULL THEN image END AS image, CASE WHEN error IS NULL THEN timestamp END AS timestamp,
  CASE WHEN error IS NULL THEN rtrim(substring(trim(description, ' ' || chr(10)), 1, 160), ' ' || chr(10)) END AS description,
  CASE WHEN error IS NULL THEN rtrim(substring(CASE WHEN batch % 5 = 4 THEN array_to_string(list_filter(list_transform(string_split(visible_text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), '；') ELSE trim(visible_text, ' ' || chr(10)) END, 1, 320), ' ' || chr(10)) END AS visible_text,
  CASE WHEN error IS NULL THEN importance END AS importance, CASE WHEN error IS NULL THEN uncertainty END AS uncertainty
FROM j WHERE error IS NULL OR index = 1""")
def attach_visual_results(spark, d):
    """Answers hold whole texts, many times what the tables hold, so they are made and read in waves of videos."""
    b = v.v_batches(spark, d)
    said = v.table(spark, d, "documents").agg(F.avg(F.octet_length("text"))).first()[0] or 0
    waves = max(1, math.ceil(b.count() * said / ANSWER_BYTES))

    def read(mine, _):
        return visual.attach_visual_results(v.v_answers(spark, d, mine(b)), mine(b)).select("video_id", "batch", "index", "error", "image", "timestamp", "description", "visible_text", "importance", "uncertainty")

    return in_waves(spark, waves, read)


_LINES = r"""lines AS (SELECT video_id, image, timestamp_seconds, pos, line, replace(lower(trim(regexp_replace(line, '\s+', ' ', 'g'))), 'ß', 'ss') AS norm FROM (SELECT video_id, image, timestamp_seconds, unnest(x) AS line, generate_subscripts(x, 1) AS pos
  FROM (SELECT *, list_filter(list_transform(regexp_split_to_array(visible_text, '[\r\n；;]+'), lambda y: trim(y)), lambda y: y <> '') AS x FROM v_visual))),
boiler AS (SELECT video_id, norm, count(DISTINCT image) AS n FROM lines GROUP BY 1, 2 HAVING count(DISTINCT image) >= greatest(3, ((SELECT count(*) FROM v_visual z WHERE z.video_id = lines.video_id) + 3) // 4) AND length(norm) <= 40)"""
_LINES = _LINES.replace("(SELECT count(*) FROM v_visual z WHERE z.video_id = lines.video_id)", "any_value(total)").replace("FROM lines GROUP BY", "FROM lines JOIN (SELECT video_id, count(*) AS total FROM v_visual GROUP BY 1) USING (video_id) GROUP BY")
_USEFUL = r""", spoken AS (SELECT video_id, replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss') AS said FROM v_transcripts),
fresh AS (SELECT l.* FROM lines l LEFT JOIN boiler b ON b.video_id = l.video_id AND b.norm = l.norm LEFT JOIN spoken s ON s.video_id = l.video_id WHERE b.norm IS NULL AND NOT (length(l.norm) >= 4 AND coalesce(contains(s.said, l.norm), false)))"""


@query(f"WITH {_LINES} SELECT video_id, norm, n FROM boiler")
def boilerplate_lines(spark, d):
    return visual.boilerplate_lines(v.v_visual(spark, d))


@query(f"WITH {_LINES.replace('boiler AS (', 'boiler AS (SELECT * FROM (').replace('length(norm) <= 40)', 'length(norm) <= 40) WHERE false)')}{_USEFUL} SELECT video_id, image, CAST(pos - 1 AS BIGINT) AS pos, line FROM fresh")
def overlap_removed(spark, d):
    lines = visual.visual_lines(v.v_visual(spark, d))
    return visual.remove_subtitle_overlap(lines, v.v_transcripts(spark, d)).select("video_id", "image", F.col("pos").cast("bigint").alias("pos"), "line")


@query(f"""WITH {_LINES}{_USEFUL}, f AS (SELECT video_id, image, lag(image) OVER (PARTITION BY video_id ORDER BY timestamp_seconds, image) AS before FROM v_visual)
SELECT f.video_id, f.image, coalesce(string_agg(l.line, '|' ORDER BY l.pos), '') AS lines FROM f LEFT JOIN (SELECT l.*, f.before FROM fresh l JOIN f USING (video_id, image) WHERE NOT EXISTS (SELECT 1 FROM fresh p WHERE p.video_id = l.video_id AND p.image = f.before AND p.norm = l.norm)) l
ON l.video_id = f.video_id AND l.image = f.image GROUP BY 1, 2""")
def new_screen_lines(spark, d):
    # Nothing is asked of descriptions, which would be kept with the frames.
    shown = v.v_visual(spark, d).select("video_id", "timestamp_seconds", "image", "visible_text")
    return visual.new_screen_lines(shown, v.v_transcripts(spark, d)).select("video_id", "image", join("delta_lines").alias("lines"))


@query()
def compact_visual(spark, d):
    return visual.compact_visual(v.v_visual(spark, d).drop("event_id"), v.v_transcripts(spark, d))


_PROOF = r"(?i)(?:^|[；：\s])(?:\$\s*)?(?:npx|npm|pnpm|yarn|pipx?|uv|docker|git|cargo|go|brew)\s+\S+|https?://\S+|github\.com/\S+"


#: Visual events within the budgets of ``b`` (``video_id``, ``budget``), chosen one after the other.
_HELD = rf"""e AS (SELECT video_id, seconds, image, text, row_number() OVER (PARTITION BY video_id ORDER BY seconds, image) - 1 AS k, regexp_matches(text, '{_PROOF}') AS proof
  FROM (SELECT video_id, timestamp_seconds AS seconds, image, '[' || timestamp || '] 画面：' || description || CASE WHEN visible_text <> '' THEN '；屏幕文字：' || visible_text ELSE '' END || CASE WHEN uncertainty <> '' THEN '；不确定性：' || uncertainty ELSE '' END AS text FROM v_visual)),
s AS (SELECT video_id, any_value(budget) AS budget, count(*) AS n, CAST(sum(length(text) + 1) AS BIGINT) AS total, coalesce(list(k ORDER BY k) FILTER (proof), []) AS proofs FROM e JOIN b USING (video_id) GROUP BY 1),
w AS (SELECT *, greatest(1, least(n, n * budget // total)) AS want FROM s),
h AS (SELECT *, least(len(proofs), greatest(1, want // 5)) AS held FROM w),
pick AS (SELECT video_id, n, want, CASE WHEN total <= budget THEN range(0, n) WHEN want = 1 THEN [n // 2]
  ELSE list_distinct(list_concat(proofs[len(proofs) - held + 1:], list_transform(range(0, want - held), lambda i: CAST(round_even(i * (n - 1) / greatest(want - held - 1, 1), 0) AS BIGINT)))) END AS chosen FROM h
  UNION ALL SELECT video_id, n, want, list_append(chosen, list_position(away, list_max(away)) - 1) FROM (SELECT *, list_transform(range(0, n), lambda i: CASE WHEN list_contains(chosen, i) THEN -1 ELSE list_min(list_transform(chosen, lambda c: abs(i - c))) END) AS away FROM pick WHERE len(chosen) < want)),
full_pick AS (SELECT video_id, arg_max(chosen, len(chosen)) AS chosen FROM pick GROUP BY 1),
kept AS (SELECT e.*, budget, total <= budget AS fits, greatest(1, budget // len(chosen) - 1) AS each FROM e JOIN full_pick USING (video_id) JOIN s USING (video_id) WHERE list_contains(chosen, k)),
short AS (SELECT * REPLACE (CASE WHEN fits OR length(text) <= each THEN text ELSE rtrim(substring(text, 1, greatest(1, each - CASE WHEN each > 2 THEN 2 ELSE 0 END)), ' ' || chr(10)) || CASE WHEN each > 2 THEN '……' ELSE '' END END AS text) FROM kept),
held AS (SELECT * FROM (SELECT *, sum(length(text) + 1) OVER (PARTITION BY video_id ORDER BY k) AS used FROM short) WHERE used <= budget)"""


@query(f"WITH RECURSIVE b AS (SELECT DISTINCT video_id, CAST(1200 AS BIGINT) AS budget FROM v_visual), {_HELD} SELECT video_id, seconds, 1 AS priority, image, text FROM held")
def limit_visual_events(spark, d):
    events = timeline.visual_events(v.v_visual(spark, d)).drop("_tie")
    return timeline.limit_visual_events(events, events.select("video_id", F.lit(1200).alias("budget")).distinct())


_EVENTS = """SELECT video_id, seconds, 0 AS priority, seq, '[' || ts || '] ' || text AS text FROM v_cues WHERE seconds IS NOT NULL UNION ALL
SELECT video_id, timestamp_seconds, 1, row_number() OVER (PARTITION BY video_id ORDER BY timestamp_seconds, image) - 1, '[' || timestamp || '] 画面：' || description || '；屏幕文字：' || visible_text || CASE WHEN uncertainty <> '' THEN '；不确定性：' || uncertainty ELSE '' END FROM v_visual"""


@query(_EVENTS, name="timeline")
def timeline_events(spark, d):
    return timeline.build_timeline(v.v_cues(spark, d), v.v_visual(spark, d))


@query(f"""WITH e AS ({_EVENTS}), u AS (SELECT video_id, string_agg(text, chr(10) ORDER BY seq) AS untimed FROM v_cues WHERE seconds IS NULL GROUP BY 1)
SELECT video_id, rtrim('{timeline.HEADER}' || CASE WHEN untimed IS NOT NULL THEN chr(10) || chr(10) || '{timeline.UNTIMED}' || chr(10) || chr(10) || untimed ELSE '' END || chr(10) || chr(10) || '{timeline.AXIS}' || chr(10) || chr(10) || body, ' ' || chr(10)) || chr(10) AS text
FROM (SELECT video_id, string_agg(text, chr(10) ORDER BY seconds, priority, seq) AS body FROM e GROUP BY 1) LEFT JOIN u USING (video_id)""")
def timeline_text(spark, d):
    cues = v.v_cues(spark, d)
    return timeline.render_timeline_text(timeline.build_timeline(cues, v.v_visual(spark, d)), cues)


@query(f"""WITH RECURSIVE c AS (SELECT video_id, sum(CASE WHEN seconds IS NOT NULL THEN length('[' || ts || '] ' || text) + 1 ELSE 0 END) AS speech, string_agg(CASE WHEN seconds IS NULL THEN text END, chr(10) ORDER BY seq) AS untimed FROM v_cues GROUP BY 1),
b AS (SELECT v.video_id, CAST(least(3200, greatest(greatest(800, 1250), greatest(0, 5000 - (length('{timeline.HEADER}') + length('{timeline.AXIS}') + 4 + coalesce(length(untimed) + length('{timeline.UNTIMED}') + 4, 0) + coalesce(speech, 0))))) AS BIGINT) AS budget FROM (SELECT DISTINCT video_id FROM v_visual) v LEFT JOIN c USING (video_id)),
{_HELD}
SELECT video_id, seconds, 0 AS priority, CAST(seq AS BIGINT) AS seq, '[' || ts || '] ' || text AS text FROM v_cues WHERE seconds IS NOT NULL
UNION ALL SELECT video_id, seconds, 1, row_number() OVER (PARTITION BY video_id ORDER BY seconds, image) - 1, text FROM held""")
def timeline_held(spark, d):
    """The timeline with all frames as they were seen, held to the budget that speech leaves."""
    return timeline.build_timeline(v.v_cues(spark, d), v.v_visual(spark, d), 5000)


@query()
def timeline_budgeted(spark, d):
    return timeline.build_timeline(v.v_cues(spark, d), visual.compact_visual(v.v_visual(spark, d), v.v_transcripts(spark, d)), 5000)


@query(f"""WITH e AS ({_EVENTS}), h AS (SELECT video_id, length('{timeline.HEADER}') + length('{timeline.AXIS}') + 4 + coalesce(max(length(untimed)) + length('{timeline.UNTIMED}') + 4, 0) AS head
  FROM (SELECT DISTINCT video_id FROM e) LEFT JOIN (SELECT video_id, string_agg(text, chr(10) ORDER BY seq) AS untimed FROM v_cues WHERE seconds IS NULL GROUP BY 1) USING (video_id) GROUP BY 1),
s AS (SELECT video_id, sum(priority) AS vis, sum(length(rtrim(text, ' ')) - 0 + 1) AS whole, sum(CASE priority WHEN 0 THEN length(text) + 1 ELSE 0 END) AS speech FROM e GROUP BY 1)
SELECT video_id, CAST(vis AS BIGINT) AS context_frames, CAST(vis AS BIGINT) AS compacted_frames, CAST(least(3200, greatest(greatest(800, ceil(5000 * 0.25)), greatest(0, 5000 - (head + speech)))) AS BIGINT) AS visual_char_budget FROM s JOIN h USING (video_id)""")
def timeline_metrics(spark, d):
    cues, vis = v.v_cues(spark, d), v.v_visual(spark, d)
    return timeline.timeline_metrics(timeline.build_timeline(cues, vis), vis, cues, 5000).drop("multimodal_chars")


@query("""SELECT video_id, rtrim('# 视频画面解析' || chr(10) || chr(10) || '- 状态：completed' || chr(10) || '- 模型：m' || chr(10) || '- 已解析帧数：' || count(*) || string_agg(chr(10) || chr(10) || '## [' || timestamp || ']' || chr(10) || chr(10) || '- 关键帧：`' || image || '`' || chr(10) || '- 画面：' || description
  || chr(10) || '- 屏幕文字：' || coalesce(nullif(visible_text, ''), '无') || chr(10) || '- 重要程度：' || importance || chr(10) || '- 不确定性：' || coalesce(nullif(uncertainty, ''), '无'), '' ORDER BY timestamp_seconds, image), ' ' || chr(10)) || chr(10) AS markdown FROM v_visual GROUP BY video_id""")
def visual_markdown(spark, d):
    return timeline.render_visual_markdown(v.v_visual(spark, d), "m")


@query("SELECT video_id, count(*) AS frame_count, string_agg(image, '|' ORDER BY timestamp_seconds, timestamp, image) AS images FROM v_visual GROUP BY video_id")
def visual_json(spark, d):
    doc = timeline.render_visual_json(v.v_visual(spark, d), "m").select("video_id", F.from_json("json", "frame_count bigint, frames array<struct<image:string>>").alias("j"))
    return doc.select("video_id", F.col("j.frame_count").alias("frame_count"), join("j.frames.image").alias("images"))
