"""What must be made anew, from the signatures of stages; the stage cache; reports of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cuecorpus.functions import text as t

SCHEMA_VERSION = 1
STAGES = ("transcript", "keyframes", "vision", "summary")
#: Artifacts that are stale when a condition on a video holds.
RULES = (
    ("always", "chatgpt_prompt.md"),
    ("transcript_miss", "transcript.txt"),
    ("transcript_miss", "summary.md"),
    ("vision_miss", "visual_context.json"),
    ("vision_miss", "visual_context.md"),
    ("vision_miss", "summary.md"),
    ("summary_miss", "summary.md"),
    ("text_only", "visual_context.json"),
    ("text_only", "visual_context.md"),
    ("text_only", "multimodal_context.txt"),
    ("multimodal", "multimodal_context.txt"),
    ("no_summary", "summary.md"),
)


def stage_hits(requests: DataFrame, cache: DataFrame, resume: bool = True) -> DataFrame:
    """``hit`` of each requested stage (``video_id``, ``stage``, ``signature``, ``artifact``): the cache holds its signature,
    under the present schema, and the artifact is there."""
    known = cache.where(F.col("schema_version") == SCHEMA_VERSION).select("video_id", "stage", "signature").distinct().withColumn("_hit", F.lit(True))
    joined = requests.join(known, ["video_id", "stage", "signature"], "left")
    return joined.select("video_id", "stage", "signature", (F.lit(resume) & F.coalesce("_hit", F.lit(False)) & F.col("artifact")).alias("hit"))


def plan_stages(requests: DataFrame, cache: DataFrame, modes: DataFrame, resume: bool = True) -> DataFrame:
    """Per video and stage: ``hit`` after the cascade. ``modes``: ``video_id``, ``with_vision``, ``with_summary``.

    A transcript that is made anew makes the summary stale; so do visual results. Without vision, key frames and vision are
    not asked for; without a summary, neither is that.
    """
    hits = stage_hits(requests, cache, resume).groupBy("video_id").agg(*[F.bool_or(F.when(F.col("stage") == s, F.col("hit"))).alias(s) for s in STAGES])
    rows = hits.join(modes, "video_id")
    yes = lambda s: F.coalesce(F.col(s), F.lit(False))
    vision = F.when(F.col("with_vision"), yes("vision") & yes("keyframes"))
    plan = rows.select(
        "video_id", "with_vision", "with_summary", yes("transcript").alias("transcript"), F.when(F.col("with_vision"), yes("keyframes")).alias("keyframes"),
        vision.alias("vision"), F.when(F.col("with_summary"), yes("summary") & yes("transcript") & F.coalesce(vision, F.lit(True))).alias("summary"),
    )
    return plan


def stage_rows(plan: DataFrame) -> DataFrame:
    """A plan in long form; stages that aren't asked for are left out."""
    entries = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("hit")) for s in STAGES])
    return plan.select("video_id", F.explode(F.filter(entries, lambda x: x["hit"].isNotNull())).alias("_s")).select("video_id", "_s.stage", "_s.hit")


def stale_artifacts(plan: DataFrame) -> DataFrame:
    """Artifacts of each video that must go, by the rules above (a table of a dozen rows)."""
    no = lambda s: F.coalesce(~F.col(s), F.lit(False))
    facts = F.array_compact(
        F.array(
            F.lit("always"),
            F.when(no("transcript"), "transcript_miss"),
            F.when(no("vision"), "vision_miss"),
            F.when(no("summary"), "summary_miss"),
            F.when(~F.col("with_vision"), "text_only"),
            F.when(F.col("with_vision"), "multimodal"),
            F.when(~F.col("with_summary"), "no_summary"),
        )
    )
    rules = plan.sparkSession.createDataFrame(list(RULES), "condition string, artifact string")
    return plan.select("video_id", F.explode(facts).alias("condition")).join(F.broadcast(rules), "condition").select("video_id", "artifact").distinct()


def stale_after_failure(runs: DataFrame) -> DataFrame:
    """Timeline texts of failed runs (``failed``, ``with_vision``, ``vision_completed``) whose vision wasn't completed."""
    return runs.where("failed AND with_vision AND NOT vision_completed").select("video_id", F.lit("multimodal_context.txt").alias("artifact"))


def merge_stage_cache(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per video and stage, the newest; of equal times the row of ``new``."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = W.partitionBy("video_id", "stage").orderBy(F.desc("completed_at"), F.desc("_new"), F.desc("signature"))
    return both.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_new")


def source_signature(videos: DataFrame) -> DataFrame:
    """``signature`` of a video's source; of local files (``local_size`` set) size and time of change are part of it."""
    d = F.col("duration")
    base = {"id": F.col("id"), "url": F.col("webpage_url"), "duration": d}
    local = {**base, "local_size": F.col("local_size"), "local_mtime_ns": F.col("local_mtime_ns")}
    return videos.withColumn("signature", F.when(F.col("local_size").isNull(), t.stable_signature(**base)).otherwise(t.stable_signature(**local)))


def stage_seconds(runs: DataFrame) -> DataFrame:
    """Per video: seconds of each stage as a map (the last run of a stage counts), their total and the status."""
    last = runs.groupBy("video_id", "stage").agg(F.max_by("seconds", "run_id").alias("seconds"))
    maps = last.groupBy("video_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "seconds")))).alias("stages"), F.round(F.sum("seconds"), 3).alias("total_seconds"))
    status = runs.groupBy("video_id").agg(F.max_by("status", "run_id").alias("status"), F.sum(F.col("cache_hit").cast("bigint")).alias("cache_hits"))
    return maps.join(status, "video_id")


def stage_rollup(runs: DataFrame) -> DataFrame:
    """Count, sum, mean and most of seconds by stage and status, with the sums over statuses and over all."""
    return runs.rollup("stage", "status").agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.sum("seconds"), 3).alias("sum_seconds"), F.round(F.avg("seconds"), 6).alias("avg_seconds"), F.max("seconds").alias("max_seconds"), F.grouping_id().cast("bigint").alias("level")
    )


def meta_records(videos: DataFrame) -> DataFrame:
    """A video's metadata as JSON: without description, tags and categories; with source, warnings, options and mode."""
    dropped = {"description", "tags", "categories", "with_vision", "context_terms", "processing", "options"}
    fields = [F.col(c) for c in videos.columns if c not in dropped and c not in ("video_id", "warnings")]
    warnings = F.coalesce(F.col("warnings"), F.array().cast("array<string>")).alias("warnings")
    extra = [F.col(c) for c in ("context_terms", "processing", "options") if c in videos.columns]
    mode = F.when(F.col("with_vision"), "multimodal").otherwise("quick").alias("analysis_mode")
    return videos.select("video_id", F.to_json(F.struct(*fields, warnings, *extra, mode), {"ignoreNullFields": "false"}).alias("json"))
