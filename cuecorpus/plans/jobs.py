"""Jobs that a user calls: model calls, summaries of a corpus, vision requests, digests, refresh."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuecorpus.checkpoints import ensure_checkpoints
from cuecorpus.functions import text as t
from cuecorpus.operators import chunking, resume, subtitles, timeline, visual
from cuecorpus.plans.journal import Calls, Journal, Reader, answered, patient

#: A model: (prompt, max_tokens or None, system=, temperature=) to (content, finish reason).
Model = Callable[..., tuple]
#: A vision model: (parts, max_tokens, system=, temperature=) to its content; a part is ("text", text) or ("image", path).
VisionModel = Callable[..., str]
# Fixed texts and values of model calls.
SYSTEM, TEMPERATURE = "你是严谨的视频内容总结助手，只基于给定文本总结，并使用中文输出。", 0.2
VISION_SYSTEM, VISION_TEMPERATURE = "你是严谨的视频关键帧分析器，只报告图片中明确可见的信息。", 0
VISION_TASK = (
    "请逐张分析后只返回 JSON 对象，不要使用 Markdown。格式为："
    '{"frames":[{"index":1,"description":"画面事实",'
    '"visible_text":"可辨认的屏幕文字，没有则为空字符串",'
    '"importance":"high|medium|low","uncertainty":"不确定信息，没有则为空字符串"}]}。'
    "必须为每张图片返回一项。相邻字幕只能用于校正 OCR 和判断信息增量，不能当作图片事实。"
    "description 限 80 个中文字符，只写字幕没有表达的布局、操作、图表或画面变化。"
    "visible_text 限 200 个中文字符，只保留新增或变化的关键文字、命令、参数和数字；"
    "忽略重复页眉、页脚、水印、栏目名及前一张已经出现的文字。"
    "importance 按新增价值判断：high=字幕之外的重要信息，medium=补强字幕，"
    "low=主要重复字幕或装饰。无法确认的英文、命令或小字必须写入 uncertainty。"
)
VISION_TERMS = "视频已知术语（仅用于 OCR 拼写校正）："
LEAST_CHUNK = 1200
PART_TOKENS, FINAL_TOKENS = 1000, 1300
PART_TEMPLATE = "# {title}\n\n这是第 {chunk_index}/{chunk_count} 段材料（{source}）。{transcript_quality_note}\n\n请按时间顺序列出要点。\n\n{transcript}"
VISION_PART_TEMPLATE = "# {title}\n\n这是第 {chunk_index}/{chunk_count} 段语音与画面材料（{source}）。{transcript_quality_note}\n\n请按时间顺序列出要点，并用画面证据补充语音。\n\n{transcript}"


def request_signature(journal: Journal, prompt: Column, max_tokens: int | None) -> Column:
    """The signature under which a journal keeps the answer to a prompt."""
    return t.stable_signature(model=F.lit(journal.model), prompt=prompt, system=F.lit(SYSTEM), temperature=F.lit(TEMPERATURE), tokens=F.lit(max_tokens))


def call_model(requests: DataFrame, make: Callable[[], Model], max_tokens: int | None = None, calls: Calls = Calls(), journal: Journal | None = None) -> DataFrame:
    """``requests`` (with ``prompt``) with ``answer``, ``status`` and ``attempts``.

    ``make`` makes the model once for each task; with several calls in flight it is called from several threads. A truncated
    answer is asked for once more with a larger budget, a call that comes too soon is tried again after a pause; any other
    fault ends a row's call at once. A fault, an exception too, is a row's status and never the job's end.

    With a ``journal``, answers are written down batch by batch under the signature of their request, and what is written down
    isn't asked again: neither by a task that is tried again nor by a later run. Requests are then dealt by signature, so equal
    ones are asked once.
    """
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in requests.schema)}, answer string, attempts int, _reason string, _failed boolean"
    journal = journal and journal.begun()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()

        def ask(prompt: str) -> tuple[list, bool]:
            tokens = max_tokens
            for tries in (1, 2):
                try:
                    answer, reason = patient(lambda: model(prompt, tokens, system=SYSTEM, temperature=TEMPERATURE), calls)  # noqa: B023
                except Exception as e:  # a model's fault of any kind belongs to its row
                    return [str(e), tries, None, True], True
                if str(reason or "").strip().lower() not in t.CUT_SHORT:
                    break
                tokens = 2 * tokens if tokens is not None else t.RETRY_TOKENS
            return [answer, tries, reason, False], False

        frames: list[pd.DataFrame] = []

        def rows() -> Iterator[tuple]:
            for pdf in batches:
                frames.append(pdf)
                keys = pdf["_signature"] if journal else range(len(pdf))
                yield from ((str(k), str(k), prompt) if journal else (f"{id(pdf)}", str(k), prompt) for k, prompt in zip(keys, pdf["prompt"], strict=True))

        out: list = []
        for x in answered(rows(), ask, calls, journal):
            out.append(x)
            while frames and len(out) >= len(frames[0]):
                pdf = frames.pop(0)
                own, out = out[: len(pdf)], out[len(pdf) :]
                added = {c: pd.Series([x[k] for x in own], index=pdf.index, dtype=d) for k, (c, d) in enumerate((("answer", object), ("attempts", "int32"), ("_reason", object), ("_failed", bool)))}
                yield pdf.drop(columns="_signature", errors="ignore").assign(**added)

    asked = requests
    if journal:
        asked = requests.withColumn("_signature", request_signature(journal, F.col("prompt"), max_tokens)).repartitionByRange("_signature").sortWithinPartitions("_signature")
    status = F.when(F.col("_failed"), "error").otherwise(t.response_status(F.col("answer"), F.col("_reason")))
    return asked.mapInPandas(run, schema).select(*requests.columns, "answer", status.alias("status"), "attempts")


def summarize_corpus(transcripts: DataFrame, videos: DataFrame, make: Callable[[], Model], max_chars: int, template: str, local: bool = True, calls: Calls = Calls(), journal: Journal | None = None) -> DataFrame:
    """A summary per transcript (``video_id``, ``source``, ``text``): parts first, then the whole.

    Videos whose context is too long for the model are cut into chunks of half the size and tried again, down to 1,200
    characters. Chunks are spread over tasks by themselves, so a long video is no long task.
    """
    ensure_checkpoints(transcripts.sparkSession)
    t.render(template)  # an unknown variable is an error before anything runs
    facts = videos.select("video_id", "title", "webpage_url", "uploader", "duration")
    part_tokens, final_tokens = (PART_TOKENS, FINAL_TOKENS) if local else (None, None)
    todo, chars, done, fallback = transcripts, max_chars, None, False
    while True:
        chunks = chunking.split_text_balanced(todo, chars).join(facts, "video_id")
        vision = F.col("source").contains("+vision")
        single = chunking.prompts(chunks.where("chunk_count = 1"), template, F.col("source"))
        many = chunks.where("chunk_count > 1")
        parts = chunking.prompts(many.where(~vision), PART_TEMPLATE, F.col("source")).unionByName(chunking.prompts(many.where(vision), VISION_PART_TEMPLATE, F.col("source")))
        keep = ["video_id", "source", "chunk_index", "chunk_count", "n_chars", "prompt"]
        answers = call_model(parts.select(*keep).repartition("video_id", "chunk_index"), make, part_tokens, calls, journal).checkpoint()
        bad = answers.where("status <> 'ok'").groupBy("video_id", "source").agg(F.min_by("answer", "chunk_index").alias("answer"), F.min_by("status", "chunk_index").alias("status"))
        good = answers.join(bad.select("video_id"), "video_id", "left_anti")
        merged = chunking.merge_material(good).join(good.select("video_id", "source").distinct(), "video_id").join(facts, "video_id")
        whole = merged.withColumns({"chunk_index": F.lit(1), "chunk_count": F.lit(1), "n_chars": F.length("text")})
        final = chunking.prompts(whole, template, F.concat("source", F.lit("_partials"))).select(*keep)
        ends = call_model(single.select(*keep).unionByName(final).repartition("video_id"), make, final_tokens, calls, journal).select("video_id", "source", "answer", "status").unionByName(bad.select("video_id", "source", "answer", "status")).checkpoint()
        stats = chunking.chunk_stats(chunks).select("video_id", "chunks", "chunk_lengths")
        rows = ends.join(stats, "video_id").select("video_id", "source", F.when(F.col("status") == "ok", F.col("answer")).alias("summary"), "status", F.when(F.col("status") != "ok", F.col("answer")).alias("error"), F.lit(chars).alias("chunk_chars"), "chunks", "chunk_lengths", F.lit(fallback).alias("fallback_used"))
        long = F.coalesce((F.col("status") == "error") & t.is_context_length(F.col("error")), F.lit(False))
        again = rows.where(long).select("video_id") if local and chars > LEAST_CHUNK else None
        if again is None or again.isEmpty():
            return rows if done is None else done.unionByName(rows)
        kept = rows.where(~long)
        done = kept if done is None else done.unionByName(kept)
        todo, chars, fallback = todo.join(again, "video_id", "left_semi"), max(LEAST_CHUNK, chars // 2), True


def build_vision_requests(frames: DataFrame, cues: DataFrame, terms: DataFrame, size: int = 4) -> DataFrame:
    """A request per batch of frames: their texts in order, the video's terms and the budget of tokens."""
    batched = visual.assign_batches(frames, size)
    rows = batched.join(visual.frame_context(frames, cues), ["video_id", "path"], "left")
    text = F.concat(F.lit("第 "), F.col("index").cast("string"), F.lit(" 张图片，对应视频时间 "), t.format_timestamp(F.col("timestamp")), F.lit("。相邻字幕："), F.coalesce(F.nullif("context", F.lit("")), F.lit("无")))
    grouped = rows.groupBy("video_id", "batch").agg(F.array_sort(F.collect_list(F.struct("index", "path", text.alias("text")))).alias("_f"))
    n = F.size("_f")
    return grouped.join(terms.select("video_id", F.array_join("terms", "、").alias("terms")), "video_id", "left").select(
        "video_id", "batch", n.alias("n"), F.col("_f.path").alias("paths"), F.col("_f.text").alias("texts"), F.coalesce("terms", F.lit("")).alias("terms"), F.greatest(F.lit(500), F.least(F.lit(900), n * 180)).alias("max_tokens")
    )


def _once(pairs: list[tuple]) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("a key stands twice in an object")
    return dict(pairs)


def _constant(name: str):
    raise ValueError(f"{name} isn't JSON")


def _index(value) -> int | None:
    """The place that an item names: a whole number, or a text or fraction that gives one."""
    if isinstance(value, str):
        return int(value) if re.fullmatch(r"\s*[+-]?\d{1,9}\s*", value, re.ASCII) else None
    return int(value) if isinstance(value, (bool, int, float)) and abs(value) < 2**31 else None


def _described(value) -> bool:
    """Whether a description is a text, or a list with an item, that isn't blank."""
    if isinstance(value, str):
        return bool(value.strip())
    return isinstance(value, list) and any(x is not None and str(x).strip() for x in value)


def fault_of(content: str, frames: int) -> str | None:
    """What :func:`cuecorpus.operators.visual.attach_visual_results` will find wrong with an answer, by the same rules; none if
    every frame has a description. Of several items for a frame the last one counts."""
    bare = content.strip()
    if bare.startswith("```"):
        bare = re.sub(r"\s*```\Z", "", re.sub(r"\A```(?:json)?\s*", "", bare, flags=re.I))
    found = None
    for text in (bare, bare[bare.find("{") : bare.rfind("}") + 1] if "{" in bare else ""):
        try:
            found = json.loads(text, object_pairs_hook=_once, parse_constant=_constant)
            break
        except (ValueError, RecursionError):
            continue
    items = found.get("frames") if isinstance(found, dict) else None
    if not isinstance(items, list):
        return "no_frames"
    last = {_index(x.get("index")): x for x in items if isinstance(x, dict)}
    for k in range(1, frames + 1):
        if k not in last:
            return "missing_item"
        if not _described(last[k].get("description")):
            return "missing_description"
    return None


ASKED = "video_id {video}, path string, timestamp double, source string, batch int, index int, content string, calls int, splits int, size int, seconds double, error string"


def _ask_frames(make: Callable[[], VisionModel], size: int, calls: Calls, journal: Journal | None):
    """A stream over frames by video and time. A batch that fails twice is halved, and later batches of its video are half as
    long; a frame that fails alone fails its video, which is asked for no more.

    With a journal each call's outcome is written down under its video and its number in it, faults too, so a task that is
    tried again goes the same way up to where it broke and asks from there on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, video, reader = make(), None, Reader(journal) if journal else None
        waiting: list = []
        state = {"batch": 0, "calls": 0, "splits": 0, "size": size, "error": None}

        def tell(rows: list, parts: list) -> dict:
            """A call's answer or fault, from the journal or the model."""
            state["calls"] += 1
            key, signature = f"{rows[0].key}-{state['calls']:010d}", hashlib.sha256(json.dumps([journal.model, parts], ensure_ascii=False).encode()).hexdigest() if reader else ""
            known = reader and reader.get(key, signature)
            if known:
                return known
            start = time.monotonic()
            try:
                content = patient(lambda: model(parts, max(500, min(900, 180 * len(rows))), system=VISION_SYSTEM, temperature=VISION_TEMPERATURE), calls)
                out = {"content": content or "", "fault": fault_of(content or "", len(rows))}
            except Exception as e:  # a model's fault of any kind belongs to its batch
                out = {"content": None, "fault": str(e)}
            out["seconds"] = round(time.monotonic() - start, 3)
            if reader:
                reader.append([(key, signature, out, out["fault"] is not None)])
            return out

        def ask(rows: list) -> list[tuple[list, str, float]]:
            parts = [("text", VISION_TASK)] + ([("text", VISION_TERMS + rows[0].terms)] if rows[0].terms else [])
            for k, r in enumerate(rows, 1):
                parts += [("text", f"第 {k} {r.said}"), ("image", r.path)]
            seconds = 0.0
            for k in range(2):
                told = tell(rows, parts)
                seconds += told["seconds"]
                if told["fault"] is None:
                    return [(rows, told["content"], seconds)]
                if not k:
                    time.sleep(calls.pause)
            if len(rows) == 1:
                raise RuntimeError(told["fault"])
            state["splits"] += 1
            half = len(rows) // 2
            return ask(rows[:half]) + ask(rows[half:])

        def finish() -> list[tuple]:
            out, before = [], state["splits"]
            if waiting and state["error"] is None:
                try:
                    for rows, content, seconds in ask(waiting):
                        out += [(r.video_id, r.path, r.timestamp, r.source, state["batch"], k, content if k == 1 else None, None, None, None, seconds if k == 1 else None, None) for k, r in enumerate(rows, 1)]
                        state["batch"] += 1
                except RuntimeError as e:
                    out, state["error"] = [], str(e)
                if state["splits"] > before:
                    state["size"] = max(1, state["size"] // 2)
            waiting.clear()
            return out

        def report() -> list[tuple]:
            rows = [*finish(), (video, None, None, None, None, None, None, state["calls"], state["splits"], state["size"], None, state["error"])]
            state.update(batch=0, calls=0, splits=0, size=size, error=None)
            return rows

        columns = [x.split()[0] for x in ASKED.split(", ")]
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if video is not None and row.video_id != video:
                    out += report()
                video = row.video_id
                waiting.append(row)
                if len(waiting) >= state["size"]:
                    out += finish()
            yield pd.DataFrame(out, columns=columns).astype({c: "Int32" for c in ("batch", "index", "calls", "splits", "size")})
        if video is not None:
            yield pd.DataFrame(report(), columns=columns).astype({c: "Int32" for c in ("batch", "index", "calls", "splits", "size")})

    return run


def analyze_frames(
    frames: DataFrame, cues: DataFrame, terms: DataFrame, make: Callable[[], VisionModel], size: int = 4, existing: DataFrame | None = None,
    calls: Calls = Calls(pause=0.0), journal: Journal | None = None,
) -> tuple[DataFrame, DataFrame]:
    """What a vision model sees on frames (``video_id``, ``path``, ``timestamp``, ``source``), and a report by video.

    ``existing`` are results to keep (see :func:`cuecorpus.operators.visual.reused_results`); their images aren't asked for
    again. Videos are spread over tasks; within one, batches follow each other, as each learns its length from the last. No
    task holds more than a batch. The answers are written to the checkpoint folder, so no model is asked twice for them; with
    a ``journal``, neither is it by a task that is tried again, but for the call that broke.

    Results are those of ``attach_visual_results``. The report has ``status`` (``completed`` or ``failed``), ``error``,
    ``requested_frames``, ``finished_frames``, ``calls``, ``fallback_splits``, ``effective_batch_size``, ``seconds`` and
    ``batch_seconds`` (``frames`` and ``seconds`` of each batch that was answered). A failed video keeps what it had. A video is
    completed only where each of its frames has a result.
    """
    ensure_checkpoints(frames.sparkSession)
    pending = frames if existing is None else visual.pending_frames(frames, existing)
    said = F.concat(F.lit("张图片，对应视频时间 "), t.format_timestamp(F.col("timestamp")), F.lit("。相邻字幕："), F.coalesce(F.nullif("context", F.lit("")), F.lit("无")))
    rows = pending.join(visual.frame_context(pending, cues), ["video_id", "path"], "left").join(terms.select("video_id", F.array_join("terms", "、").alias("terms")), "video_id", "left")
    rows = rows.select("video_id", "path", "timestamp", "source", said.alias("said"), F.coalesce("terms", F.lit("")).alias("terms"), F.sha2(F.col("video_id").cast("string"), 256).alias("key"))
    ordered = rows.repartition("key").sortWithinPartitions("key", "video_id", "timestamp", "path")
    journal = journal and journal.begun()
    asked = ordered.mapInPandas(_ask_frames(make, size, calls, journal), ASKED.format(video=frames.schema["video_id"].dataType.simpleString())).checkpoint()
    answers = asked.where("path IS NOT NULL")
    attached = visual.attach_visual_results(answers.where("content IS NOT NULL").select("video_id", "batch", "content"), answers.select("video_id", "path", "timestamp", "source", "batch", "index"))
    results = attached.where("error IS NULL").drop("batch", "index", "error")
    ended = attached.groupBy("video_id").agg(F.count("image").alias("finished_frames"), F.min("error").alias("_fault"))
    # A batch's seconds stand on its first frame.
    timed = answers.groupBy("video_id", "batch").agg(F.count(F.lit(1)).alias("frames"), F.max("seconds").alias("seconds"))
    spent = timed.groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("batch", "frames", "seconds"))), lambda x: F.struct(x["frames"].alias("frames"), x["seconds"].alias("seconds"))).alias("batch_seconds"), F.round(F.sum("seconds"), 3).alias("seconds"))
    if existing is not None:
        results = existing.select(*results.columns).unionByName(results)
    counted = pending.groupBy("video_id").agg(F.count(F.lit(1)).alias("requested_frames"))
    known = asked.where("path IS NULL").select("video_id", "error", "calls", F.col("splits").alias("fallback_splits"), F.col("size").alias("effective_batch_size"))
    whole = known.join(counted, "video_id").join(ended, "video_id", "left").join(spent, "video_id", "left")
    finished = F.coalesce("finished_frames", F.lit(0))
    error = F.coalesce("error", "_fault", F.when(finished < F.col("requested_frames"), "frames without a result"))
    report = whole.select(
        "video_id", F.when(error.isNull(), "completed").otherwise("failed").alias("status"), error.alias("error"), "requested_frames", finished.alias("finished_frames"),
        "calls", "fallback_splits", "effective_batch_size", F.coalesce("seconds", F.lit(0.0)).alias("seconds"), F.coalesce("batch_seconds", F.array().cast("array<struct<frames:bigint,seconds:double>>")).alias("batch_seconds"),
    )
    return results, report


def text_digest(videos: DataFrame, subtitle_files: DataFrame, asr: DataFrame, make: Callable[[], Model], max_chars: int, template: str, langs: str = "zh,ai-zh,en") -> DataFrame:
    """Summaries from subtitle files (``video_id``, ``file_name``, ``ext``, ``content``) or recognised speech."""
    transcripts = corpus_transcripts(videos, subtitle_files, asr, langs)
    return summarize_corpus(transcripts.where("error IS NULL").select("video_id", "source", "text"), videos, make, max_chars, template)


def corpus_transcripts(videos: DataFrame, subtitle_files: DataFrame, asr: DataFrame, langs: str) -> DataFrame:
    """The transcript of each video: best subtitle file, cleaned, or recognised speech."""
    chosen = subtitles.select_subtitle(subtitle_files, langs, videos)
    source = subtitles.subtitle_source(chosen, videos).select("video_id", "source", "warning")
    cues = subtitles.parse_files(subtitle_files.join(chosen, ["video_id", "file_name"], "left_semi"))
    texts = source.join(subtitles.cues_to_text(cues), "video_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    spoken = subtitles.cues_to_text(subtitles.asr_to_cues(asr))
    known = videos if "is_local" in videos.columns else videos.withColumn("is_local", F.lit(False))
    return subtitles.resolve_transcripts(known, texts, spoken)


def transcript_cues(transcripts: DataFrame) -> DataFrame:
    """Cues in long form from transcript texts."""
    rows = transcripts.select("video_id", F.posexplode(t.split_lines(F.col("text"))).alias("seq", "_l")).where(t.strip(F.col("_l")) != "")
    return rows.select("video_id", F.col("seq").cast("bigint").alias("seq"), *[c.alias(k) for k, c in t.cue_line(F.col("_l")).items()])


def multimodal_texts(transcripts: DataFrame, visual_frames: DataFrame, max_chars: int) -> DataFrame:
    """``video_id``, ``source`` and ``text`` of speech and pictures: compacted, held to a budget, merged by time."""
    cues = transcript_cues(transcripts)
    compacted = visual.compact_visual(visual_frames, transcripts.select("video_id", "text"))
    texts = timeline.render_timeline_text(timeline.build_timeline(cues, compacted, max_chars), cues)
    return texts.join(transcripts.select("video_id", F.concat("source", F.lit("+vision")).alias("source")), "video_id").select("video_id", "source", "text")


def multimodal_digest(transcripts: DataFrame, visual_frames: DataFrame, videos: DataFrame, make: Callable[[], Model], max_chars: int, template: str) -> DataFrame:
    """Summaries of speech and pictures that were seen before; :mod:`cuecorpus.plans.digests` starts from frame candidates."""
    return summarize_corpus(multimodal_texts(transcripts, visual_frames, max_chars), videos, make, max_chars, template)


def refresh(requests: DataFrame, cache: DataFrame, modes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What must be made anew, what is stale, and the cache after it was made; :mod:`cuecorpus.plans.runner` makes it.

    ``requests`` and ``cache`` as for :func:`cuecorpus.operators.resume.plan_stages`.
    """
    plan = resume.plan_stages(requests, cache, modes)
    misses = resume.stage_rows(plan).where("NOT hit").select("video_id", "stage")
    made = requests.join(misses, ["video_id", "stage"], "left_semi").select("video_id", "stage", "signature", F.lit(resume.SCHEMA_VERSION).alias("schema_version"), now.alias("completed_at"))
    return misses, resume.stale_artifacts(plan), resume.merge_stage_cache(cache, made)


