"""Digests of a corpus as stages of an incremental run: transcripts, key frames, what a vision model sees, summaries."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuecorpus.functions import text as t
from cuecorpus.operators import chunking, keyframes, resume, timeline
from cuecorpus.plans import jobs, runner
from cuecorpus.plans.journal import Calls, Journal
from cuecorpus.sources.store import Store


class Sources(NamedTuple):
    """Videos with their metadata, subtitle files, recognised speech, and frame candidates."""

    videos: DataFrame
    subtitle_files: DataFrame
    asr: DataFrame
    candidates: DataFrame


class Settings(NamedTuple):
    """What a digest is made with; whatever changes an artifact is part of its stage's signature."""

    template: str
    vision_template: str
    langs: str = "zh,ai-zh,en"
    min_scan: float = 5
    max_gap: float = 45
    max_frames: int = 60
    batch: int = 4
    max_chars: int = 12_000
    model: str = ""
    vision_model: str = ""
    #: Raised whenever the prompt of the vision model changes.
    vision_schema: int = 3


def requests(sources: Sources, settings: Settings, modes: DataFrame) -> DataFrame:
    """``video_id``, ``stage`` and ``signature`` of each stage of each video; signatures build on those of earlier stages."""
    v = sources.videos
    for name, kind in (("local_size", "long"), ("local_mtime_ns", "long")):
        v = v if name in v.columns else v.withColumn(name, F.lit(None).cast(kind))
    v = v if "id" in v.columns else v.withColumn("id", F.col("video_id").cast("string"))
    plan = keyframes.sampling_plan(v.select("video_id", "duration"), settings.min_scan, settings.max_gap, settings.max_frames)
    rows = resume.source_signature(v).select("video_id", F.col("signature").alias("source")).join(plan, "video_id").join(terms_of(v), "video_id").join(modes, "video_id")
    s = {k: F.lit(x) for k, x in settings._asdict().items()}
    rows = rows.withColumn("transcript", t.stable_signature(source=F.col("source"), langs=s["langs"]))
    rows = rows.withColumn("keyframes", t.stable_signature(source=F.col("source"), scan=F.col("scan_interval"), gap=F.col("max_gap"), frames=F.col("max_frames")))
    rows = rows.withColumn("vision", t.stable_signature(keyframes=F.col("keyframes"), transcript=F.col("transcript"), model=s["vision_model"], batch=s["batch"], terms=F.col("terms"), schema=s["vision_schema"]))
    shown = F.when(F.col("with_vision"), F.col("vision"))
    template = F.when(F.col("with_vision"), s["vision_template"]).otherwise(s["template"])
    rows = rows.withColumn("summary", t.stable_signature(transcript=F.col("transcript"), vision=shown, template=template, max_chars=s["max_chars"], model=s["model"]))
    stages = F.array(*[F.struct(F.lit(x).alias("stage"), F.col(x).alias("signature")) for x in resume.STAGES])
    return rows.select("video_id", F.explode(stages).alias("_s")).select("video_id", "_s.*")


def terms_of(videos: DataFrame) -> DataFrame:
    """Context terms of each video; fields that the metadata lacks count as empty."""
    lists = ("tags", "categories")
    for name in ("title", "uploader", "description", *lists):
        videos = videos if name in videos.columns else videos.withColumn(name, F.lit(None).cast("array<string>" if name in lists else "string"))
    return chunking.context_terms(videos).select("video_id", "terms")


def stages(sources: Sources, settings: Settings, make: Callable[[], jobs.Model], see: Callable[[], jobs.VisionModel], calls: Calls = Calls(), journal: Journal | None = None) -> list[runner.Stage]:
    """The four stages of :func:`cuecorpus.plans.runner.run_stages`."""
    seen = journal and journal._replace(folder=f"{journal.folder}/vision", model=settings.vision_model)
    told = journal and journal._replace(folder=f"{journal.folder}/summary", model=settings.model)

    def mine(df: DataFrame, asked: DataFrame) -> DataFrame:
        return df.join(asked.select("video_id"), "video_id", "left_semi")

    def transcript(asked: DataFrame, found: runner.Artifacts) -> DataFrame:
        return jobs.corpus_transcripts(*(mine(x, asked) for x in (sources.videos, sources.subtitle_files, sources.asr)), settings.langs)

    def frames(asked: DataFrame, found: runner.Artifacts) -> DataFrame:
        return keyframes.select_keyframes(mine(sources.candidates, asked), mine(sources.videos, asked), settings.min_scan, settings.max_gap, settings.max_frames)

    def vision(asked: DataFrame, found: runner.Artifacts) -> DataFrame:
        wanted = mine(found("keyframes"), asked).select("video_id", "path", "timestamp", "source")
        cues = jobs.transcript_cues(mine(found("transcript"), asked))
        before = found("vision", failed=True)
        # What a failed run had finished counts under the same signature.
        kept = None if before is None else before.where("image IS NOT NULL").join(asked, ["video_id", "signature"], "left_semi")
        kept = kept if kept is None else kept.join(wanted.select("video_id", F.col("path").alias("image")), ["video_id", "image"], "left_semi")
        results, report = jobs.analyze_frames(wanted, cues, terms_of(mine(sources.videos, asked)), see, settings.batch, kept, calls, seen)
        metrics = F.struct(*[c for c in report.columns if c not in ("video_id", "error")]).alias("report")
        rows = results.unionByName(report.select("video_id", "error", metrics), allowMissingColumns=True)
        return rows.join(asked, "video_id")

    def summary(asked: DataFrame, found: runner.Artifacts) -> DataFrame:
        spoken, shown = mine(found("transcript"), asked).select("video_id", "source", "text"), found("vision")
        if shown is None:
            return _summaries(jobs.summarize_corpus(spoken, sources.videos, make, settings.max_chars, settings.template, calls=calls, journal=told))
        shown = mine(shown, asked).where("image IS NOT NULL")
        pictured = shown.select("video_id").distinct()
        texts = jobs.multimodal_texts(spoken.join(pictured, "video_id", "left_semi"), shown, settings.max_chars)
        plain = spoken.join(pictured, "video_id", "left_anti")
        both = [jobs.summarize_corpus(rows, sources.videos, make, settings.max_chars, template, calls=calls, journal=told) for rows, template in ((plain, settings.template), (texts, settings.vision_template))]
        return _summaries(both[0].unionByName(both[1]))

    return [runner.Stage("transcript", transcript), runner.Stage("keyframes", frames), runner.Stage("vision", vision), runner.Stage("summary", summary)]


def _summaries(rows: DataFrame) -> DataFrame:
    return rows.withColumn("error", F.when(F.col("status") != "ok", F.coalesce(F.nullif("error", F.lit("")), "status")))


def digest_corpus(
    store: Store, sources: Sources, settings: Settings, modes: DataFrame, make: Callable[[], jobs.Model], see: Callable[[], jobs.VisionModel], run: str, now: Column,
    waves: int = 1, calls: Calls = Calls(), journal: Journal | None = None,
) -> DataFrame:
    """Bring a corpus up to date, from files and candidates to summaries: ``stage``, ``status``, ``videos`` that this run made.

    ``modes``: ``video_id``, ``with_vision``, ``with_summary``. Only what a store misses is made; the artifacts are those of
    ``runner.Artifacts(store)``.
    """
    return runner.run_stages(store, requests(sources, settings, modes), modes, stages(sources, settings, make, see, calls, journal), run, now, waves)


def visual_documents(store: Store, model: str) -> DataFrame:
    """``json`` and ``markdown`` of what was seen of each video, of failed ones too: status, error and finished frames."""
    found = runner.Artifacts(store)
    done, failed = found("vision"), found("vision", failed=True)
    rows = done.unionByName(failed)
    # A video of which an earlier run had finished all frames has no report of its own.
    told = rows.groupBy("video_id").agg(F.first("report", True).alias("metrics"), F.first("error", True).alias("error"))
    reports = told.select("video_id", F.coalesce("metrics.status", F.lit("completed")).alias("status"), "error", "metrics")
    frames = rows.where("image IS NOT NULL")
    return timeline.render_visual_json(frames, model, reports=reports).join(timeline.render_visual_markdown(frames, model, reports=reports), "video_id")
