"""Views that turn the driver's tables into videos, subtitles, frames, answers and runs, for the registered queries.

Each view is a function of (spark, sf_dir); ``SQL`` holds the same view for DuckDB, built from the tables and not from what
the library's operators make of them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuecorpus.functions import text as t

SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _n(df: DataFrame, c: str) -> int:
    return df.select(F.countDistinct(c)).first()[0]


def v_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.split("text", "\n")
    first, second = F.get(line, F.lit(0)), F.coalesce(F.get(line, F.lit(1)), F.lit(""))
    i = F.col("doc_id")
    empty = F.array().cast("array<string>")
    return table(spark, sf_dir, "documents").select(
        i.alias("video_id"),
        i.cast("string").alias("id"),
        first.alias("title"),
        F.concat(F.lit("https://video.example/"), i.cast("string")).alias("webpage_url"),
        F.when(i % 5 != 0, F.col("source")).alias("uploader"),
        F.when(i % 7 != 0, F.col("n_chars") / 4.0).alias("duration"),
        F.col("text").alias("description"),
        F.array("lang", "source", second).alias("tags"),
        F.array("lang").alias("categories"),
        F.when(i % 4 == 0, empty).when(i % 4 == 1, F.array("lang")).when(i % 4 == 2, F.array(F.lit("en"), F.lit("zh"))).otherwise(F.array(F.lit("en"))).alias("subtitle_langs"),
        F.when(i % 3 == 0, F.array(F.lit("ai-zh"))).otherwise(empty).alias("automatic_caption_langs"),
    )


SQL["v_videos"] = """
SELECT doc_id AS video_id, CAST(doc_id AS VARCHAR) AS id, split_part(text, chr(10), 1) AS title,
  'https://video.example/' || doc_id AS webpage_url, CASE WHEN doc_id % 5 <> 0 THEN source END AS uploader,
  CASE WHEN doc_id % 7 <> 0 THEN n_chars / 4.0::DOUBLE END AS duration, text AS description,
  [lang, source, split_part(text, chr(10), 2)] AS tags, [lang] AS categories,
  CASE doc_id % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN [lang] WHEN 2 THEN ['en', 'zh'] ELSE ['en'] END AS subtitle_langs,
  CASE WHEN doc_id % 3 = 0 THEN ['ai-zh'] ELSE []::VARCHAR[] END AS automatic_caption_langs
FROM documents"""


def v_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    n = _n(conv, "conv_id")
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id")).distinct().withColumn("conv_id", F.col("video_id") % n)
    seconds = F.when(F.col("turn") % 8 != 7, F.col("turn") * 60.0)
    return users.join(conv, "conv_id").select("video_id", F.col("turn").alias("seq"), t.format_timestamp(seconds).alias("ts"), seconds.alias("seconds"), t.collapse(F.col("text")).alias("text"))


SQL["v_cues"] = r"""
SELECT u.video_id, c.turn AS seq, CASE WHEN c.turn % 8 <> 7 THEN printf('%02d:%02d:%02d', c.turn // 60, c.turn % 60, 0) END AS ts,
  CASE WHEN c.turn % 8 <> 7 THEN c.turn * 60.0::DOUBLE END AS seconds, trim(regexp_replace(c.text, '\s+', ' ', 'g')) AS text
FROM (SELECT DISTINCT user_id AS video_id FROM events) u
JOIN conversations c ON c.conv_id = u.video_id % (SELECT count(DISTINCT conv_id) FROM conversations)"""


def v_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.sequence(F.lit(0), F.lit(71))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(k, lambda i: F.floor((F.element_at("embedding", i % 64 + 1).cast("double") + 1) * 127).cast("int")).alias("luma"))


SQL["v_luma"] = """
SELECT vec_id, list_transform(range(0, 72), lambda k: CAST(floor((CAST(embedding[k % 64 + 1] AS DOUBLE) + 1) * 127) AS INTEGER)) AS luma FROM embeddings"""

SQL["v_hash"] = """
SELECT vec_id, CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) AS hash_value
FROM (SELECT vec_id, list_sum(list_transform(range(0, 64), lambda k: CASE WHEN luma[(k // 8) * 9 + k % 8 + 1] > luma[(k // 8) * 9 + k % 8 + 2]
      THEN CAST(1 AS HUGEINT) << CAST(63 - k AS INTEGER) ELSE CAST(0 AS HUGEINT) END)) AS h FROM v_luma)"""


def v_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v_luma(spark, sf_dir).select("vec_id", t.difference_hash(F.col("luma")).alias("hash_value"))


def v_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)
    rows = e.select(
        F.col("user_id").alias("video_id"),
        F.concat(F.lit("e"), F.lpad(F.col("event_id").cast("string"), 8, "0"), F.lit(".jpg")).alias("path"),
        (F.floor(micros / 6000000) / 1000.0).alias("timestamp"),
        F.when(F.col("event_type") == "error", "scene").otherwise("periodic").alias("source"),
        "event_id",
        "event_type",
        (F.floor(F.col("event_id") / 3) % _n(table(spark, sf_dir, "embeddings"), "vec_id")).alias("vec_id"),
    )
    return rows.join(v_hash(spark, sf_dir), "vec_id").drop("vec_id")


SQL["v_frames"] = """
SELECT e.user_id AS video_id, 'e' || lpad(CAST(e.event_id AS VARCHAR), 8, '0') || '.jpg' AS path,
  floor((epoch_us(e.ts) - 1704067200000000) / 6000000) / 1000.0::DOUBLE AS timestamp,
  CASE WHEN e.event_type = 'error' THEN 'scene' ELSE 'periodic' END AS source, e.event_id, e.event_type, h.hash_value
FROM events e JOIN v_hash h ON h.vec_id = e.event_id // 3 % (SELECT count(DISTINCT vec_id) FROM embeddings)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v_frames(spark, sf_dir).select("video_id", "path", "timestamp", "source", "hash_value")


def v_shown(spark: SparkSession, sf_dir: str, most: int | None = None, frames: DataFrame | None = None) -> DataFrame:
    """What a model says of each frame, in whole texts; ``most`` cuts descriptions before they meet their frames.

    ``frames`` are those of ``v_frames`` to tell of; what columns they have beside stay.
    """
    docs = table(spark, sf_dir, "documents")
    n = _n(docs, "doc_id")
    line = F.coalesce(F.get(F.split("text", "\n"), F.lit(1)), F.lit(""))
    said = F.col("text") if most is None else t.rstrip(t.cut(t.strip(F.col("text")), most))
    d = docs.select(F.col("doc_id"), said.alias("description"), line.alias("_second"))
    lab = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    cue = v_cues(spark, sf_dir).select("video_id", F.col("seq").alias("_seq"), F.col("text").alias("_said"))
    f = v_frames(spark, sf_dir) if frames is None else frames
    beside = [c for c in f.columns if c not in ("video_id", "path", "timestamp", "source", "event_id", "event_type", "hash_value")]
    f = f.withColumns({"doc_id": F.col("event_id") % n, "_seq": F.col("event_id") % 8})
    if most is None:
        # Whole texts come last, so that they aren't dealt again.
        rows = f.join(cue, ["video_id", "_seq"], "left").join(d, "doc_id").join(lab, "doc_id", "left")
    else:
        rows = f.join(d, "doc_id").join(lab, "doc_id", "left").join(cue, ["video_id", "_seq"], "left")
    e = F.col("event_id")
    shown = F.concat_ws(
        "\n",
        F.concat(F.lit("Kanal "), F.col("video_id").cast("string")),
        F.concat(F.lit("Status: "), F.col("event_type")),
        F.col("_said"),
        F.nullif("_second", F.lit("")),
        F.when(e % 40 == 0, F.concat(F.lit("$ pip install pkg"), e.cast("string"))),
    )
    return rows.select(
        "video_id",
        F.col("timestamp").alias("timestamp_seconds"),
        t.format_timestamp(F.col("timestamp")).alias("timestamp"),
        F.col("path").alias("image"),
        F.col("source").alias("frame_source"),
        "description",
        shown.alias("visible_text"),
        F.when(F.col("toxic") == 1, "low").when(F.col("quality") == 1, "high").otherwise("medium").alias("importance"),
        F.when(e % 9 == 0, "unsure").otherwise("").alias("uncertainty"),
        "event_id",
        *beside,
    )


SQL["v_shown"] = """
SELECT f.video_id, f.timestamp AS timestamp_seconds,
  printf('%02d:%02d:%02d', CAST(floor(f.timestamp) AS BIGINT) // 3600, CAST(floor(f.timestamp) AS BIGINT) % 3600 // 60, CAST(floor(f.timestamp) AS BIGINT) % 60) AS timestamp,
  f.path AS image, f.source AS frame_source, d.text AS description,
  concat_ws(chr(10), 'Kanal ' || f.video_id, 'Status: ' || f.event_type, c.text,
    nullif(split_part(d.text, chr(10), 2), ''), CASE WHEN f.event_id % 40 = 0 THEN '$ pip install pkg' || f.event_id END) AS visible_text,
  CASE WHEN l.toxic = 1 THEN 'low' WHEN l.quality = 1 THEN 'high' ELSE 'medium' END AS importance,
  CASE WHEN f.event_id % 9 = 0 THEN 'unsure' ELSE '' END AS uncertainty, f.event_id
FROM v_frames f JOIN documents d ON d.doc_id = f.event_id % (SELECT count(DISTINCT doc_id) FROM documents)
LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id
LEFT JOIN v_cues c ON c.video_id = f.video_id AND c.seq = f.event_id % 8"""


def v_visual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with what was said of them, cut as the answers of models are when they are attached."""
    rows = v_shown(spark, sf_dir, 160)
    return rows.withColumn("visible_text", t.rstrip(t.cut(t.strip(F.col("visible_text")), 320)))


SQL["v_visual"] = """
SELECT * REPLACE (rtrim(substring(trim(description, ' ' || chr(10) || chr(9)), 1, 160), ' ' || chr(10) || chr(9)) AS description, rtrim(substring(trim(visible_text, ' ' || chr(10) || chr(9)), 1, 320), ' ' || chr(10) || chr(9)) AS visible_text) FROM v_shown"""


def v_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transcript text of each video of v_cues."""
    from cuecorpus.operators.subtitles import cues_to_text

    return cues_to_text(v_cues(spark, sf_dir))


SQL["v_transcripts"] = """
SELECT video_id, string_agg(CASE WHEN ts IS NULL THEN text ELSE '[' || ts || '] ' || text END, chr(10) ORDER BY seq) || chr(10) AS text FROM v_cues GROUP BY video_id"""


def v_srt(spark: SparkSession, sf_dir: str, vtt: bool = False) -> DataFrame:
    """One subtitle file per conversation; every fifth turn is in italics, every seventh stands there twice."""
    k, dot = F.col("turn"), "." if vtt else ","
    at = t.format_timestamp(k * 20.0)
    said = F.when(k % 5 == 0, F.concat(F.lit("<i>"), "text", F.lit("</i>"))).otherwise(F.col("text"))
    block = F.concat((k + 1).cast("string"), F.lit("\n"), at, F.lit(f"{dot}000 --> "), at, F.lit(f"{dot}500" + (" line:90% position:50%" if vtt else "") + "\n"), said, F.lit("\n\n"))
    block = F.when(k % 7 == 0, F.concat(block, block)).otherwise(block)
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("video_id")).agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))).alias("_b"))
    head = "WEBVTT\nKind: captions\n\n" if vtt else ""
    return rows.select("video_id", F.concat(F.lit(head), F.array_join(F.col("_b.b"), "")).alias("content"))


#: What the files above hold, straight from the conversations.
SQL["v_said"] = r"""
SELECT conv_id AS video_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq,
  printf('%02d:%02d:%02d', turn * 20 // 3600, turn * 20 % 3600 // 60, turn * 20 % 60) AS ts, turn * 20.0::DOUBLE AS seconds,
  trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, turn FROM conversations"""


def v_json3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caption events as JSON; a fourth of the starts are fractions."""
    k = F.col("turn")
    start = F.when(k % 4 == 3, F.concat((k * 20000).cast("string"), F.lit(".5"))).otherwise((k * 20000).cast("string"))
    event = F.concat(F.lit('{"tStartMs":'), start, F.lit(',"segs":'), F.to_json(F.array(F.struct(F.col("text").alias("utf8")))), F.lit("}"))
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("video_id")).agg(F.array_sort(F.collect_list(F.struct("turn", event.alias("e")))).alias("_e"))
    return rows.select("video_id", F.concat(F.lit('{"events":['), F.array_join(F.col("_e.e"), ","), F.lit("]}")).alias("content"))


def v_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("video_id"), F.col("turn").alias("seq"), (F.col("turn") * 20 + 0.4).alias("start"), F.when(F.col("turn") % 6 == 5, "  ").otherwise(F.col("text")).alias("text")
    )


def v_asr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The speech of a third of the videos; the others have none."""
    return v_speech(spark, sf_dir).where("video_id % 3 = 0")


SQL["v_asr_cues"] = """
SELECT conv_id AS video_id, turn AS seq, printf('%02d:%02d:%02d', turn * 20 // 3600, turn * 20 % 3600 // 60, turn * 20 % 60) AS ts,
  turn * 20.0::DOUBLE AS seconds, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text
FROM conversations WHERE conv_id % 3 = 0 AND turn % 6 <> 5""".replace("\\\\", "\\")


def v_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs = F.array(*[F.struct(F.lit(i).alias("p"), F.lit(x).alias("l")) for i, x in enumerate(("zh", "ai-zh", "en", "de", ""))])
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), F.explode(langs).alias("_l")).where((F.col("video_id") + F.col("_l.p")) % 3 != 0)
    tail = F.when(F.col("_l.l") == "", ".srt").otherwise(F.concat(F.lit("."), F.col("_l.l"), F.lit(".srt")))
    return rows.select("video_id", F.concat(F.lit("conv-"), F.col("video_id").cast("string"), tail).alias("file_name"))


SQL["v_candidates"] = """
SELECT doc_id AS video_id, 'conv-' || doc_id || CASE WHEN l = '' THEN '.srt' ELSE '.' || l || '.srt' END AS file_name, l, p
FROM documents, (VALUES (0, 'zh'), (1, 'ai-zh'), (2, 'en'), (3, 'de'), (4, '')) x(p, l) WHERE (doc_id + p) % 3 <> 0"""


def v_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    stage = F.when(kind == "view", "load_meta").when(kind == "click", "download_subtitle").when(kind == "purchase", "transcribe").when(kind == "signup", "analyze").otherwise("summarize")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("video_id"), F.col("event_id").alias("run_id"), stage.alias("stage"), F.col("value").alias("seconds"),
        F.when((kind == "error") & (F.col("value") < 5), "failed").otherwise("ok").alias("status"), (F.col("event_id") % 3 == 0).alias("cache_hit"),
    )


SQL["v_runs"] = """
SELECT user_id AS video_id, event_id AS run_id, CASE event_type WHEN 'view' THEN 'load_meta' WHEN 'click' THEN 'download_subtitle' WHEN 'purchase' THEN 'transcribe'
  WHEN 'signup' THEN 'analyze' ELSE 'summarize' END AS stage, value AS seconds,
  CASE WHEN event_type = 'error' AND value < 5 THEN 'failed' ELSE 'ok' END AS status, event_id % 3 = 0 AS cache_hit FROM events"""


def v_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = F.explode(F.array(*[F.lit(s) for s in ("transcript", "keyframes", "vision", "summary")]))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), "n_chars", stages.alias("stage"))
    return rows.select("video_id", "stage", t.stable_signature(doc_id=F.col("video_id"), stage=F.col("stage"), n_chars=F.col("n_chars")).alias("signature"), (F.col("video_id") % 10 != 0).alias("artifact"))


SQL["v_requests"] = """
SELECT doc_id AS video_id, stage, sha256('{"doc_id":' || doc_id || ',"n_chars":' || n_chars || ',"stage":"' || stage || '"}') AS signature, doc_id % 10 <> 0 AS artifact
FROM documents, (VALUES ('transcript'), ('keyframes'), ('vision'), ('summary')) s(stage)"""


def v_stage_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = v_requests(spark, sf_dir).where("video_id % 3 < 2")
    return r.select("video_id", "stage", F.when(F.col("video_id") % 3 == 1, F.concat(F.lit("old"), F.col("signature"))).otherwise(F.col("signature")).alias("signature"), F.when(F.col("video_id") % 17 == 0, 0).otherwise(1).alias("schema_version"))


SQL["v_stage_cache"] = """
SELECT video_id, stage, CASE WHEN video_id % 3 = 1 THEN 'old' || signature ELSE signature END AS signature,
  CASE WHEN video_id % 17 = 0 THEN 0 ELSE 1 END AS schema_version FROM v_requests WHERE video_id % 3 < 2"""


def v_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), (F.col("doc_id") % 4 < 2).alias("with_vision"), (F.col("doc_id") % 4 != 3).alias("with_summary"))


SQL["v_modes"] = "SELECT doc_id AS video_id, doc_id % 4 < 2 AS with_vision, doc_id % 4 <> 3 AS with_summary FROM documents"


def v_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames in batches of four."""
    from cuecorpus.operators.visual import assign_batches

    return assign_batches(v_frames(spark, sf_dir).drop("hash_value"), 4)


def v_answers(spark: SparkSession, sf_dir: str, batches: DataFrame | None = None) -> DataFrame:
    """Model answers for batches of four frames: plain, fenced, in prose, with an index as text, with an item missing.

    ``batches`` are those of ``v_batches`` to answer. Frames are numbered before the texts said of them are met.
    """
    b = v_shown(spark, sf_dir, frames=v_batches(spark, sf_dir) if batches is None else batches)
    shape = F.col("batch") % 5
    index = F.when((shape == 3) & (F.col("index") == 2), F.to_json(F.struct(F.col("index").cast("string").alias("i")))).otherwise(F.to_json(F.struct(F.col("index").alias("i"))))
    text = F.when(shape == 4, F.to_json(F.struct(F.split("visible_text", "\n").alias("v")))).otherwise(F.to_json(F.struct(F.col("visible_text").alias("v"))))
    inner = lambda c: F.regexp_extract(c, r'(?s)^\{"\w":(.*)\}$', 1)
    rest = F.to_json(F.struct("description", F.upper("importance").alias("importance"), "uncertainty"))
    item = F.concat(F.lit('{"index":'), inner(index), F.lit(',"visible_text":'), inner(text), F.lit(","), F.substr(rest, F.lit(2)))
    rows = b.withColumn("item", item).where(~((F.col("batch") % 10 == 6) & (F.col("index") == 1)))
    body = F.concat(F.lit('{"frames":['), F.array_join(F.array_sort(F.collect_list(F.struct("index", "item")))["item"], ","), F.lit("]}"))
    whole = rows.groupBy("video_id", "batch").agg(body.alias("body"))
    return whole.select("video_id", "batch", F.when(F.col("batch") % 5 == 1, F.concat(F.lit("```json\n"), "body", F.lit("\n```"))).when(F.col("batch") % 5 == 2, F.concat(F.lit("Here it is: "), "body", F.lit(" done"))).otherwise(F.col("body")).alias("content"))


def with_views(body: str) -> str:
    """``body`` after the views that it names, and those that they name."""
    order: list[str] = []

    def need(text: str) -> None:
        for name, sql in SQL.items():
            if re.search(rf"\b{name}\b", text) and name not in order:
                need(sql)
                order.append(name)

    need(body)
    views = ",\n".join(f"{n} AS ({SQL[n]})" for n in order)
    text = body.strip()
    if not views:
        return text
    if text.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views},\n{text[len('WITH RECURSIVE'):]}"
    return f"WITH {views},\n{text[4:]}" if text.upper().startswith("WITH ") else f"WITH {views}\n{text}"
