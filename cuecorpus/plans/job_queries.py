"""Registered queries: chunks, terms, prompts, summaries, resume and reports."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from cuecorpus.functions import text as t
from cuecorpus.operators import chunking, resume, subtitles
from cuecorpus.plans import fixtures as v
from cuecorpus.plans import jobs
from cuecorpus.plans.registry import query

join = lambda c: F.array_join(c, "|")


def _texts(spark, d):
    return v.table(spark, d, "documents").select(F.col("doc_id").alias("video_id"), "text")


_SPLIT = """WITH RECURSIVE parts AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p, c) AS k, substring(line, CAST(c * 1000 + 1 AS BIGINT), 1000) AS part
  FROM (SELECT doc_id, p, line, unnest(range(0, greatest(1, (length(line) + 999) // 1000))) AS c FROM (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS p FROM
    (SELECT doc_id, CASE WHEN x[len(x)] = '' THEN x[1:len(x) - 1] ELSE x END AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE length(text) > 1000))))),
walk AS (SELECT doc_id, k, 1 AS chunk, length(part) + 1 AS size FROM parts WHERE k = 1
  UNION ALL SELECT p.doc_id, p.k, CASE WHEN w.size + length(p.part) + 1 > 1000 THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN w.size + length(p.part) + 1 > 1000 THEN length(p.part) + 1 ELSE w.size + length(p.part) + 1 END
  FROM walk w JOIN parts p ON p.doc_id = w.doc_id AND p.k = w.k + 1),
packed AS (SELECT doc_id AS video_id, chunk AS chunk_index, string_agg(part, chr(10) ORDER BY k) AS text FROM walk JOIN parts USING (doc_id, k) GROUP BY 1, 2 UNION ALL SELECT doc_id, 1, text FROM documents WHERE length(text) <= 1000)"""


@query(_SPLIT + " SELECT video_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(count(*) OVER (PARTITION BY video_id) AS INTEGER) AS chunk_count, text FROM packed")
def split_text(spark, d):
    return chunking.split_text(_texts(spark, d), 1000).select("video_id", "chunk_index", "chunk_count", "text")


def _even(table: str, most: int) -> str:
    cand = f"instr(substring(text, CAST(ideal + 1 AS BIGINT), CAST(greatest(0, least(length(text), start + {most}) + 1 - ideal) AS BIGINT)), chr(10))"
    back = "instr(reverse(substring(text, CAST(start + 2 AS BIGINT), CAST(greatest(ideal - start, 0) AS BIGINT))), chr(10))"
    return f"""cuts AS (SELECT id, text, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS stop, CAST(0 AS BIGINT) AS i, CAST(ceil(length(text) / {most}.0) AS BIGINT) AS n FROM {table} WHERE length(text) > {most}
  UNION ALL SELECT id, text, stop, CASE WHEN b IS NULL AND a IS NULL THEN ideal WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN abs(b - ideal) <= abs(a - ideal) THEN b ELSE a END, i, n
  FROM (SELECT *, CASE WHEN fwd > 0 THEN ideal + fwd END AS a, CASE WHEN bwd > 0 THEN start + 1 + greatest(ideal - start, 0) - bwd + 1 END AS b
    FROM (SELECT *, {cand} AS fwd, {back} AS bwd FROM (SELECT id, text, stop AS start, stop, i + 1 AS i, n, stop + CAST(ceil((length(text) - stop) / CAST(n - i AS DOUBLE)) AS BIGINT) AS ideal FROM cuts WHERE i < n - 1)))),
balanced AS (SELECT id, i AS chunk_index, n AS chunk_count, rtrim(substring(text, CAST(start + 1 AS BIGINT), CAST(stop - start AS BIGINT)), chr(10)) AS text FROM cuts WHERE i > 0
  UNION ALL SELECT id, i + 1, n, ltrim(substring(text, CAST(stop + 1 AS BIGINT)), chr(10)) FROM cuts WHERE i = n - 1 UNION ALL SELECT id, 1, 1, text FROM {table} WHERE length(text) <= {most})"""


@query("WITH RECURSIVE src AS (SELECT doc_id AS id, text FROM documents), " + _even("src", 1000) + " SELECT id AS video_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(chunk_count AS INTEGER) AS chunk_count, text FROM balanced")
def split_balanced(spark, d):
    return chunking.split_text_balanced(_texts(spark, d), 1000).select("video_id", "chunk_index", "chunk_count", "text")


@query("WITH RECURSIVE src AS (SELECT video_id AS id, string_agg('[' || ts || '] ' || text, chr(10) ORDER BY seq) || chr(10) AS text FROM v_said GROUP BY 1), " + _even("src", 800) + """
SELECT id AS video_id, count(*) AS chunks, string_agg(CAST(length(text) AS VARCHAR), '|' ORDER BY chunk_index) AS chunk_lengths, CAST(max(length(text)) AS INTEGER) AS max_chars FROM balanced GROUP BY 1""")
def chunk_stats(spark, d):
    """Subtitle files to cues, adjacent repeats dropped, to transcripts, to chunks, to their statistics."""
    cues = subtitles.parse_srt(v.v_srt(spark, d))
    got = chunking.chunk_stats(chunking.split_text_balanced(subtitles.cues_to_text(cues), 800))
    return got.withColumn("chunk_lengths", F.array_join(F.transform("chunk_lengths", lambda x: x.cast("string")), "|"))


_EDGE = t.TERM_EDGE.replace("'", "''").replace("\n", "' || chr(10) || '")


def _matches(column: str) -> str:
    """SQL for the terms in a column. The engine's word bounds know ASCII only: letters beyond it become underscores, two of
    them where a term may hold one."""
    plain = rf"regexp_replace(coalesce({column}, ''), '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}\x00-\x7F]', chr(1), 'g')"
    found = [rf"regexp_extract_all(regexp_replace({plain}, '[^\x00-\x7F]', '{'__' if k == 0 else '_'}', 'g'), '{p.removeprefix('(?U)')}', 0)" for k, p in enumerate(chunking.TERM_PATTERNS)]
    return f"list_concat({found[0]}, list_concat({found[1]}, {found[2]}))"


_TERMS = (
    rf"""WITH c AS (SELECT video_id, list_concat(list_concat({_matches('title')}, list_concat({_matches('uploader')}, {_matches('description')})), list_filter(list_concat(tags[1:12], categories[1:8]), lambda x: length(x) <= 30)) AS terms FROM v_videos),
n AS (SELECT video_id, list_filter(list_transform(terms, lambda x: trim(trim(regexp_replace(regexp_replace(x, 'https?://\S+', ' ', 'g'), '\s+', ' ', 'g'), '{_EDGE}'))), lambda x: length(x) BETWEEN 2 AND 60) AS terms FROM c),
s AS (SELECT video_id, list_transform(terms, lambda x: {{'terms': [x], 'keys': [replace(lower(x), 'ß', 'ss')], 'size': length(x) + 2}}) AS steps FROM n),
r AS (SELECT video_id, list_reduce(steps, lambda a, x: CASE WHEN len(list_filter(a.keys, lambda k: contains(k, x.keys[1]))) > 0 OR a.size + x.size - 2 > 800 THEN a
  ELSE {{'terms': list_concat(a.terms, x.terms), 'keys': list_concat(a.keys, x.keys), 'size': a.size + x.size}} END, {{'terms': []::VARCHAR[], 'keys': []::VARCHAR[], 'size': 0::BIGINT}}) AS kept FROM s)
SELECT video_id, array_to_string(kept.terms, '|') AS terms, CASE WHEN len(kept.terms) > 0 THEN '{t.ASR_LEAD}' || array_to_string(kept.terms, '、') END AS asr_prompt FROM r"""
)


@query(_TERMS)
def context_terms(spark, d):
    """Over all videos and whole descriptions."""
    return chunking.context_terms(v.v_videos(spark, d)).withColumn("terms", join("terms"))


#: Its former name, for whole texts, stays.
query(_TERMS, name="context_terms_all")(context_terms)

_PROMPT = "{title} {chunk_index}/{chunk_count} {source}\n```\n{transcript}\n```\n"


@query(_SPLIT.replace("documents", "fenced").replace("WITH RECURSIVE parts", "WITH RECURSIVE fenced AS (SELECT doc_id, replace(text, '. ', '.```') AS text FROM documents), parts") + """
SELECT p.video_id, rtrim(string_agg(title || ' ' || chunk_index || '/' || n || ' file' || chr(10) || '```' || chr(10) || replace(text, '```', '''''''') || chr(10) || '```' || chr(10), chr(10) || chr(10) ORDER BY chunk_index), ' ' || chr(10)) || chr(10) AS prompts
FROM (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM packed) p JOIN (SELECT doc_id AS video_id, split_part(text, chr(10), 1) AS title FROM documents) v ON v.video_id = p.video_id GROUP BY 1""")
def export_prompts(spark, d):
    texts = _texts(spark, d).withColumn("text", F.replace("text", F.lit(". "), F.lit(".```"))).withColumn("source", F.lit("file"))
    return chunking.export_prompts(texts, v.v_videos(spark, d), 1000, _PROMPT)


@query(f"""SELECT doc_id AS video_id, '{chunking.MERGE_HEAD}' || string_agg('## 第 ' || k || '/' || n || ' 段摘要' || chr(10) || chr(10) || line, chr(10) || chr(10) ORDER BY k) AS text
FROM (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS k, len(x) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)) GROUP BY doc_id""")
def merge_material(spark, d):
    lines = v.table(spark, d, "documents").select(F.col("doc_id").alias("video_id"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "answer"))
    return chunking.merge_material(lines)


def _stub():
    def answer(prompt: str, tokens, system: str, temperature: float):
        if "too-long" in prompt:
            return prompt[:40], "length" if tokens is not None and tokens < 2000 else "stop"
        if len(prompt) % 7 == 0:
            return "", "stop"
        return f"{len(prompt)}:{prompt[:20]}", "stop"

    return answer


@query("""SELECT doc_id AS video_id, CASE WHEN doc_id % 5 = 0 THEN substring('too-long ' || text, 1, 40) WHEN length(text) % 7 = 0 THEN '' ELSE length(text) || ':' || substring(text, 1, 20) END AS answer,
  CASE WHEN doc_id % 5 <> 0 AND length(text) % 7 = 0 THEN 'empty' ELSE 'ok' END AS status, CAST(CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS INTEGER) AS attempts FROM documents""")
def call_model(spark, d):
    rows = _texts(spark, d).select("video_id", F.when(F.col("video_id") % 5 == 0, F.concat(F.lit("too-long "), "text")).otherwise(F.col("text")).alias("prompt"))
    return jobs.call_model(rows, _stub, 1000).select("video_id", "answer", "status", "attempts")


def _filled(template: str, **columns: str) -> str:
    """SQL for a template with columns put in."""
    parts = re.split(r"\{(\w+)\}", template)
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return " || ".join(quote(x) if k % 2 == 0 else columns[x] for k, x in enumerate(parts) if x)


_SUMMARY = "{title}\n{source}\n{transcript}"
_NOTE = f"CASE WHEN vision THEN '{t.NOTES['whisper']}{t.NOTE_VISION}' ELSE '{t.NOTES['file']}' END"
_PART = dict(title="title", chunk_index="chunk_index", chunk_count="chunk_count", source="source", transcript_quality_note=_NOTE, transcript="part")


@query(
    "WITH RECURSIVE src AS (SELECT doc_id AS id, text FROM documents), " + _even("src", 4000) + f""",
facts AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, doc_id % 2 = 0 AS vision, CASE doc_id % 2 WHEN 0 THEN 'whisper+vision' ELSE 'file' END AS source FROM documents),
pieces AS (SELECT b.id, b.chunk_index, b.chunk_count, b.text AS part, title, vision, source FROM balanced b JOIN facts USING (id)),
asked AS (SELECT *, CASE WHEN chunk_count = 1 THEN {_filled(_SUMMARY, title="title", source="source", transcript="part")} WHEN vision THEN {_filled(jobs.VISION_PART_TEMPLATE, **_PART)} ELSE {_filled(jobs.PART_TEMPLATE, **_PART)} END AS prompt FROM pieces),
told AS (SELECT *, length(prompt) % 7 = 0 AS bad, CASE WHEN length(prompt) % 7 = 0 THEN '' ELSE length(prompt) || ':' || substring(prompt, 1, 20) END AS answer FROM asked),
whole AS (SELECT id, any_value(title) AS title, any_value(source) AS source, count(*) AS chunks, bool_or(bad) AS bad, any_value(answer) AS answer, string_agg(CAST(length(part) AS VARCHAR), '|' ORDER BY chunk_index) AS lengths,
  '{chunking.MERGE_HEAD}' || string_agg('## 第 ' || chunk_index || '/' || chunk_count || ' 段摘要' || chr(10) || chr(10) || answer, chr(10) || chr(10) ORDER BY chunk_index) AS merged FROM told GROUP BY id),
final AS (SELECT *, CASE WHEN chunks = 1 OR bad THEN NULL ELSE {_filled(_SUMMARY, title="title", source="source || '_partials'", transcript="merged")} END AS prompt FROM whole),
ended AS (SELECT *, bad OR coalesce(length(prompt) % 7 = 0, false) AS empty FROM final)
SELECT id AS video_id, source, CASE WHEN empty THEN NULL WHEN chunks = 1 THEN answer ELSE length(prompt) || ':' || substring(prompt, 1, 20) END AS summary, CASE WHEN empty THEN 'empty' ELSE 'ok' END AS status, CASE WHEN empty THEN '' END AS error,
  4000 AS chunk_chars, chunks, lengths AS chunk_lengths, false AS fallback_used FROM ended"""
)
def summaries(spark, d):
    texts = _texts(spark, d).withColumn("source", F.when(F.col("video_id") % 2 == 0, "whisper+vision").otherwise("file"))
    got = jobs.summarize_corpus(texts, v.v_videos(spark, d), _stub, 4000, _SUMMARY)
    return got.withColumn("chunk_lengths", F.array_join(F.transform("chunk_lengths", lambda x: x.cast("string")), "|"))


@query("""WITH near AS (SELECT f.video_id, f.path, rtrim(substring(string_agg(c.text, ' ' ORDER BY c.seq), 1, 500)) AS context FROM v_frames f JOIN v_cues c ON c.video_id = f.video_id AND abs(c.seconds - f.timestamp) <= 15 GROUP BY 1, 2),
far AS (SELECT video_id, path, rtrim(substring(text, 1, 500)) AS context FROM (SELECT f.video_id, f.path, c.text, row_number() OVER (PARTITION BY f.video_id, f.path ORDER BY abs(c.seconds - f.timestamp), c.seq) AS r FROM v_frames f JOIN v_cues c ON c.video_id = f.video_id AND c.seconds IS NOT NULL) WHERE r = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY timestamp, path) - 1 AS k, CAST(floor(timestamp) AS BIGINT) AS s FROM v_frames)
SELECT k.video_id, CAST(k // 4 AS INTEGER) AS batch, CAST(count(*) AS INTEGER) AS n, string_agg(k.path, '|' ORDER BY k) AS paths, string_agg('第 ' || (k % 4 + 1) || ' 张图片，对应视频时间 ' || printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) || '。相邻字幕：' || coalesce(nullif(coalesce(near.context, far.context), ''), '无'), '|' ORDER BY k) AS texts,
  'term' || k.video_id AS terms, CAST(greatest(500, least(900, count(*) * 180)) AS INTEGER) AS max_tokens FROM k LEFT JOIN near ON near.video_id = k.video_id AND near.path = k.path LEFT JOIN far ON far.video_id = k.video_id AND far.path = k.path GROUP BY 1, 2, 6""")
def vision_requests(spark, d):
    f = v.frames(spark, d)
    terms = f.select("video_id", F.array(F.concat(F.lit("term"), F.col("video_id").cast("string"))).alias("terms")).distinct()
    return jobs.build_vision_requests(f, v.v_cues(spark, d), terms).withColumn("paths", join("paths")).withColumn("texts", join("texts"))


def _eye():
    """Sees no more than two frames at once, and nothing on every 50th image."""

    def answer(parts, tokens, system: str, temperature: float):
        images = [x for kind, x in parts if kind == "image"]
        if len(images) > 2 or any(int(x[1:9]) % 50 == 0 for x in images):
            raise RuntimeError("context length exceeded")
        return json.dumps({"frames": [{"index": k, "description": f"seen {x}", "visible_text": ["a", "b"], "importance": "HIGH"} for k, x in enumerate(images, 1)]})

    return answer


def _analyzed(spark, d):
    f = v.frames(spark, d)
    terms = f.select("video_id", F.array(F.lit("term")).alias("terms")).distinct()
    return jobs.analyze_frames(f.drop("hash_value"), v.v_cues(spark, d), terms, _eye, 4)


# Batches of two follow a first one of four; one that holds an image on which nothing is seen ends its video.
_SEEN = """k AS (SELECT *, CAST(substring(path, 2, 8) AS BIGINT) % 50 = 0 AS blind, row_number() OVER (PARTITION BY video_id ORDER BY timestamp, path) - 1 AS k FROM v_frames),
g AS (SELECT *, CASE WHEN k < 4 THEN 0 ELSE 1 + (k - 4) // 2 END AS outer_batch FROM k), bad AS (SELECT video_id, min(outer_batch) AS b FROM g WHERE blind GROUP BY 1)"""


@query(f"WITH {_SEEN} SELECT g.video_id, path AS image, 'seen ' || path AS description, 'a；b' AS visible_text, 'high' AS importance FROM g LEFT JOIN bad USING (video_id) WHERE bad.b IS NULL OR outer_batch < bad.b")
def vision_results(spark, d):
    return _analyzed(spark, d)[0].select("video_id", "image", "description", "visible_text", "importance")


@query(f"WITH {_SEEN} SELECT video_id, CASE WHEN b IS NULL THEN 'completed' ELSE 'failed' END AS status, n AS requested_frames FROM (SELECT video_id, count(*) AS n FROM v_frames GROUP BY 1) LEFT JOIN bad USING (video_id)")
def vision_report(spark, d):
    return _analyzed(spark, d)[1].select("video_id", "status", "requested_frames")


_PLAN = """plan AS (SELECT m.video_id, m.with_vision, m.with_summary, tr AS transcript, CASE WHEN with_vision THEN kf END AS keyframes, CASE WHEN with_vision THEN vi AND kf END AS vision, CASE WHEN with_summary THEN su AND tr AND (NOT with_vision OR (vi AND kf)) END AS summary
FROM (SELECT r.video_id, bool_or(CASE r.stage WHEN 'transcript' THEN h END) AS tr, bool_or(CASE r.stage WHEN 'keyframes' THEN h END) AS kf, bool_or(CASE r.stage WHEN 'vision' THEN h END) AS vi, bool_or(CASE r.stage WHEN 'summary' THEN h END) AS su
  FROM (SELECT q.*, q.artifact AND c.signature IS NOT NULL AS h FROM v_requests q LEFT JOIN v_stage_cache c ON c.video_id = q.video_id AND c.stage = q.stage AND c.signature = q.signature AND c.schema_version = 1) r GROUP BY 1) JOIN v_modes m USING (video_id))"""


@query(f"WITH {_PLAN} SELECT video_id, transcript, keyframes, vision, summary FROM plan")
def stage_plan(spark, d):
    return resume.plan_stages(v.v_requests(spark, d), v.v_stage_cache(spark, d), v.v_modes(spark, d)).select("video_id", *resume.STAGES)


@query(f"""WITH {_PLAN} SELECT DISTINCT video_id, unnest(list_concat(list_concat(list_concat(['chatgpt_prompt.md'], CASE WHEN NOT transcript THEN ['transcript.txt', 'summary.md'] ELSE [] END), CASE WHEN coalesce(NOT vision, false) THEN ['visual_context.json', 'visual_context.md', 'summary.md'] ELSE [] END),
  list_concat(list_concat(CASE WHEN coalesce(NOT summary, false) OR NOT with_summary THEN ['summary.md'] ELSE [] END, ['multimodal_context.txt']), CASE WHEN NOT with_vision THEN ['visual_context.json', 'visual_context.md'] ELSE [] END))) AS artifact FROM plan""")
def stale_artifacts(spark, d):
    return resume.stale_artifacts(resume.plan_stages(v.v_requests(spark, d), v.v_stage_cache(spark, d), v.v_modes(spark, d)))


@query("""SELECT coalesce(n.video_id, o.video_id) AS video_id, coalesce(n.stage, o.stage) AS stage, coalesce(n.signature, o.signature) AS signature, CASE WHEN n.video_id IS NULL THEN 1 ELSE 2 END::BIGINT AS completed_at
FROM v_stage_cache o FULL JOIN (SELECT * FROM v_requests WHERE video_id % 2 = 0) n ON n.video_id = o.video_id AND n.stage = o.stage""")
def merged_cache(spark, d):
    old = v.v_stage_cache(spark, d).select("video_id", "stage", "signature", F.lit(1).cast("bigint").alias("completed_at"))
    new = v.v_requests(spark, d).where("video_id % 2 = 0").select("video_id", "stage", "signature", F.lit(2).cast("bigint").alias("completed_at"))
    return resume.merge_stage_cache(old, new)


@query("""SELECT video_id, string_agg(stage || '=' || CAST(CAST(round(seconds * 100) AS BIGINT) AS VARCHAR), '|' ORDER BY stage) AS stages, CAST(round(sum(seconds) * 100) AS BIGINT) AS total_cents, any_value(status) AS status, CAST(any_value(hits) AS BIGINT) AS cache_hits
FROM (SELECT video_id, stage, arg_max(seconds, run_id) AS seconds FROM v_runs GROUP BY 1, 2) JOIN (SELECT video_id, arg_max(status, run_id) AS status, sum(cache_hit::INT) AS hits FROM v_runs GROUP BY 1) USING (video_id) GROUP BY 1""")
def stage_seconds(spark, d):
    got = resume.stage_seconds(v.v_runs(spark, d))
    pairs = F.transform(F.map_entries("stages"), lambda e: F.concat(e["key"], F.lit("="), F.rint(e["value"] * 100).cast("bigint").cast("string")))
    return got.select("video_id", F.array_join(pairs, "|").alias("stages"), F.rint(F.col("total_seconds") * 100).cast("bigint").alias("total_cents"), "status", "cache_hits")


@query("SELECT stage, status, count(*) AS runs, round(sum(seconds), 2) AS sum_seconds, round(avg(seconds), 4) AS avg_seconds, max(seconds) AS max_seconds, CAST(grouping(stage, status) AS BIGINT) AS level FROM v_runs GROUP BY ROLLUP (stage, status)")
def stage_rollup(spark, d):
    return resume.stage_rollup(v.v_runs(spark, d)).withColumn("sum_seconds", F.round("sum_seconds", 2)).withColumn("avg_seconds", F.round("avg_seconds", 4))


@query("""SELECT video_id, title, coalesce(uploader, 'none') AS uploader, 'whisper' AS transcript_source, 0 AS warnings, CASE WHEN video_id % 2 = 0 THEN 'multimodal' ELSE 'quick' END AS analysis_mode, false AS has_description FROM v_videos""")
def meta_records(spark, d):
    vid = v.v_videos(spark, d).withColumns({"transcript_source": F.lit("whisper"), "warnings": F.lit(None).cast("array<string>"), "with_vision": F.col("video_id") % 2 == 0})
    back = resume.meta_records(vid).select("video_id", F.from_json("json", "title string, uploader string, transcript_source string, warnings array<string>, analysis_mode string").alias("j"), F.col("json").contains('"description"').alias("has_description"))
    return back.select("video_id", "j.title", F.coalesce("j.uploader", F.lit("none")).alias("uploader"), "j.transcript_source", F.size("j.warnings").alias("warnings"), "j.analysis_mode", "has_description")



