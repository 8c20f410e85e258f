"""Stages of a corpus, made where they are missed: an incremental run that can break off anywhere and be taken up again.

A run goes through its stages in order. For each it asks :func:`cuecorpus.operators.resume.plan_stages` which videos miss it,
makes those in waves, and publishes each wave's artifacts, its rows of the stage cache and what it makes stale as one version
of the :class:`cuecorpus.sources.store.Store`. A run that breaks loses the wave that was being made; the next one plans from
what is published.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuecorpus.operators import resume
from cuecorpus.sources.store import COMMIT, Store

CACHE = "stage_cache"
#: What a stage that is made anew makes stale, besides what its signatures say.
STALE = {"transcript": ("summary",), "keyframes": ("vision", "summary"), "vision": ("summary",)}
#: Stages whose artifacts a stage is made from; those that a video doesn't ask for don't count.
NEEDS = {"vision": ("transcript", "keyframes"), "summary": ("transcript", "vision")}
#: Folders of a table from which on it is compacted.
MOST_PARTS = 32


class Stage(NamedTuple):
    """``make`` takes the videos that miss the stage (``video_id``, ``signature``) and the store's artifacts by stage, and gives
    rows with ``video_id``; rows with a non-null ``error`` say that their video failed, and are kept beside what it finished."""

    name: str
    make: Callable[[DataFrame, Artifacts], DataFrame]


class Artifacts:
    """The present artifacts of a store."""

    def __init__(self, store: Store):
        self.store = store

    def __call__(self, stage: str, failed: bool = False) -> DataFrame | None:
        """Rows of the newest version of a stage, of the videos for which it is done (or ``failed``)."""
        rows, cache = self.store.read(stage), cache_of(self.store)
        if rows is None:
            return None
        wanted = cache.where((F.col("stage") == stage) & (F.col("status") == ("failed" if failed else "done"))).select("video_id", COMMIT)
        return rows.join(wanted, ["video_id", COMMIT], "left_semi").drop(COMMIT)


def cache_of(store: Store) -> DataFrame:
    """The newest row of each video and stage: ``signature`` (null if it isn't done), ``status``, ``error``, ``run``, ``completed_at``."""
    rows = store.read(CACHE)
    if rows is None:
        return store.spark.createDataFrame([], f"video_id long, stage string, signature string, status string, error string, run string, schema_version int, completed_at timestamp, {COMMIT} long")
    rest = [c for c in rows.columns if c not in ("video_id", "stage")]
    # A commit has one row of a video and stage at most.
    return rows.groupBy("video_id", "stage").agg(F.max_by(F.struct(*rest), COMMIT).alias("_row")).select("video_id", "stage", "_row.*")


def _cache_rows(videos: DataFrame, stage: str | Column, status: str, run: str, now: Column) -> DataFrame:
    signature = F.col("signature") if "signature" in videos.columns else F.lit(None).cast("string")
    error = F.col("error") if "error" in videos.columns else F.lit(None).cast("string")
    stage = F.lit(stage) if isinstance(stage, str) else stage
    status = F.when(error.isNotNull(), "failed").otherwise(status)
    return videos.select(
        "video_id", stage.alias("stage"), F.when(status == "done", signature).alias("signature"), status.alias("status"), error.alias("error"),
        F.lit(run).alias("run"), F.lit(resume.SCHEMA_VERSION).alias("schema_version"), now.cast("timestamp").alias("completed_at"),
    )


def adopt(store: Store, cache: DataFrame, artifacts: dict[str, DataFrame], now: Column, run: str = "adopted") -> int:
    """Publish stages that were made elsewhere: ``cache`` (``video_id``, ``stage``, ``signature``) and their artifacts by stage."""
    base = store.manifest()
    added = {name: [store.write(name, rows, base["version"] + 1)] for name, rows in artifacts.items()}
    added[CACHE] = [store.write(CACHE, _cache_rows(cache, F.col("stage"), "done", run, now), base["version"] + 1)]
    return store.publish(base, added)


def missing(store: Store, requests: DataFrame, modes: DataFrame) -> DataFrame:
    """``video_id``, ``stage``, ``signature`` of what is asked for and not there. ``requests``: ``video_id``, ``stage``, ``signature``.

    A stage whose own sources aren't there either is listed too.
    """
    plan = _plan(store, requests, modes)
    return requests.join(resume.stage_rows(plan).where("NOT hit").select("video_id", "stage"), ["video_id", "stage"], "left_semi").select("video_id", "stage", "signature")


def _plan(store: Store, requests: DataFrame, modes: DataFrame) -> DataFrame:
    # A cache row and its artifact are published together, so the one stands for the other.
    present = requests.select("video_id", "stage", "signature").withColumn("artifact", F.lit(True))
    return resume.plan_stages(present, cache_of(store), modes)


def _ready(store: Store, requests: DataFrame, modes: DataFrame, stage: str) -> DataFrame:
    """Videos that miss ``stage`` and have all it is made from."""
    plan = _plan(store, requests, modes)
    ready = F.lit(True)
    for need in NEEDS.get(stage, ()):
        ready &= F.coalesce(F.col(need), F.lit(True))
    asked = plan.where(ready & ~F.coalesce(F.col(stage), F.lit(True))).select("video_id")
    return requests.where(F.col("stage") == stage).join(asked, "video_id", "left_semi").select("video_id", "signature")


def _retire(store: Store, requests: DataFrame, modes: DataFrame, run: str, now: Column) -> None:
    """Publish that vision is gone of videos read without it, and summaries of those that want none."""
    unwanted = modes.select("video_id", F.explode(F.array_compact(F.array(F.when(~F.col("with_vision"), "vision"), F.when(~F.col("with_summary"), "summary")))).alias("stage"))
    gone = cache_of(store).where("status <> 'stale'").join(unwanted, ["video_id", "stage"], "left_semi").select("video_id", "stage")
    if not gone.isEmpty():
        base = store.manifest()
        store.publish(base, {CACHE: [store.write(CACHE, _cache_rows(gone, F.col("stage"), "stale", run, now), base["version"] + 1)]})


def _make(store: Store, stage: Stage, asked: DataFrame, run: str, now: Column) -> None:
    """One wave: artifacts, cache rows and what becomes stale, under one manifest."""
    base = store.manifest()
    version = base["version"] + 1
    made = stage.make(asked, Artifacts(store))
    folder = store.write(stage.name, made, version)
    rows = store.spark.read.parquet(f"{store.root}/{folder}")
    error = F.max("error") if "error" in rows.columns else F.lit(None).cast("string")
    seen = rows.groupBy("video_id").agg(error.alias("error"), F.lit(True).alias("_seen"))
    ended = asked.join(seen, "video_id", "left").withColumn("error", F.when(F.col("_seen").isNull(), "no result").otherwise(F.col("error")))
    cache = _cache_rows(ended, stage.name, "done", run, now)
    later = STALE.get(stage.name, ())
    if later:
        touched = asked.select("video_id", F.explode(F.array(*[F.lit(s) for s in later])).alias("stage"))
        known = cache_of(store).where("status <> 'stale'").select("video_id", "stage")
        cache = cache.unionByName(_cache_rows(touched.join(known, ["video_id", "stage"], "left_semi"), F.col("stage"), "stale", run, now))
    store.publish(base, {stage.name: [folder], CACHE: [store.write(CACHE, cache, version)]})


def run_stages(store: Store, requests: DataFrame, modes: DataFrame, stages: list[Stage], run: str, now: Column, waves: int = 1) -> DataFrame:
    """Make what is missing, and tell what this run made: ``stage``, ``status``, ``videos``.

    ``requests`` and ``modes`` as for :func:`cuecorpus.operators.resume.plan_stages`, with the store's own artifacts in place of
    ``artifact``. A stage is asked for only where all it is made from is there; a video that failed in one is left out of the
    later ones and asked for again by the next run. What a stage is asked for is written down before it is made, so that it
    doesn't change with what its waves publish; a wave without videos publishes nothing.
    """
    _retire(store, requests, modes, run, now)
    for stage in stages:
        dealt = _ready(store, requests, modes, stage.name).withColumn("_wave", F.pmod(F.xxhash64("video_id"), F.lit(waves)).cast("int"))
        folder = store.write(f"asked-{stage.name}", dealt, store.version() + 1)
        asked = store.spark.read.schema(dealt.schema).parquet(f"{store.root}/{folder}")
        for wave in sorted(r[0] for r in asked.select("_wave").distinct().collect()):
            _make(store, stage, asked.where(F.col("_wave") == wave).drop("_wave"), run, now)
    made = made_by(store)  # reads the folders named now, which stay
    for table, parts in store.manifest()["tables"].items():
        if len(parts) >= MOST_PARTS:
            compact(store, table)
    return made.where(F.col("run") == run).groupBy("stage", "status").agg(F.count(F.lit(1)).alias("videos"))


def compact(store: Store, table: str) -> None:
    """Rewrite a table as one folder, without rows that newer ones have replaced."""
    if table == CACHE:
        store.compact(table, cache_of(store).select(*store.read(CACHE).columns))
    else:
        live = cache_of(store).where((F.col("stage") == table) & F.col("status").isin("done", "failed")).select("video_id", COMMIT)
        rows = store.read(table)
        store.compact(table, rows.join(live, ["video_id", COMMIT], "left_semi").select(*rows.columns))


def made_by(store: Store) -> DataFrame:
    """Every row that a run has put into the stage cache, but for those that only say that a stage is stale."""
    rows = store.read(CACHE)
    return (cache_of(store) if rows is None else rows).where("status <> 'stale'")
