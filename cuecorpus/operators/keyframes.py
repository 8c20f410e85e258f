"""Sampling plans and the selection of key frames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pyspark.sql.types import StructType

from cuecorpus.checkpoints import ensure_checkpoints
from cuecorpus.functions import text as t
from cuecorpus.operators import folds
from cuecorpus.operators.ordered import scan


def sampling_plan(videos: DataFrame, min_scan: float, max_gap: float, max_frames: int) -> DataFrame:
    """``scan_interval``, ``max_gap`` and ``max_frames`` of each video, from its duration."""
    d = F.col("duration").cast("double")
    known = F.coalesce(d > 0, F.lit(False))
    budget = F.least(F.lit(max_frames), F.greatest(F.lit(8), F.floor(d / 30) + 1))
    scan = F.greatest(F.lit(float(min_scan)), d / (budget * 4))
    gap = F.least(F.lit(float(max_gap)), F.greatest(F.lit(15.0), d / F.greatest(budget - 1, F.lit(1))))
    return videos.withColumns(
        {
            "scan_interval": F.when(known, F.round(scan, 3)).otherwise(float(min_scan)),
            "max_gap": F.when(known, F.round(gap, 3)).otherwise(float(max_gap)),
            "max_frames": F.when(known, budget).otherwise(min(max_frames, 16)).cast("int"),
        }
    )


def frames_from_showinfo(files: DataFrame, logs: DataFrame, scan_interval: float) -> DataFrame:
    """Frame candidates from a listing (``video_id``, ``kind``, ``path``) and the frame logs (``video_id``, ``kind``, ``log``).

    Times of periodic frames count only when there is one for each file, else frames are ``scan_interval`` apart; scene
    frames are paired with times as far as both go.
    """
    own = W.partitionBy("video_id", "kind")
    numbered = files.withColumns({"pos": F.row_number().over(own.orderBy("path")) - 1, "n_files": F.count(F.lit(1)).over(own)})
    found = F.regexp_extract_all("log", F.lit(r"\bn:\s*\d+.*?\bpts_time:\s*([0-9.]+)"), 1)
    stamped = logs.select("video_id", "kind", found.alias("_times"))
    times = stamped.select("video_id", "kind", F.size("_times").alias("n_times"), F.posexplode_outer("_times").alias("pos", "_time"))
    counts = stamped.select("video_id", "kind", F.size("_times").alias("n_times"))
    rows = numbered.join(counts, ["video_id", "kind"], "left").join(times.select("video_id", "kind", "pos", "_time"), ["video_id", "kind", "pos"], "left")
    periodic = F.col("kind") == "periodic"
    stamp = F.when(periodic & ~F.col("n_files").eqNullSafe(F.col("n_times")), F.col("pos") * F.lit(float(scan_interval))).otherwise(F.col("_time").cast("double"))
    return rows.withColumn("timestamp", stamp).where("timestamp IS NOT NULL").select("video_id", "path", "timestamp", F.col("kind").alias("source"))


def _selected(frames: DataFrame, merge: bool, similar: bool, gap: float | str | None = None, threshold: int = 0) -> DataFrame:
    """Frames that stay of each video (see :func:`cuecorpus.operators.folds.select_in_ranges`).

    Frames are dealt by ranges of video and time, so a video is as many tasks as it has ranges. Only what a range can't decide
    by itself, rows before the first scene or long gap and the one that waits at its end, meets again at the seams. The ranges'
    marks are checkpointed, as both parts are read from them.
    """
    ensure_checkpoints(frames.sparkSession)
    order = ["video_id", "timestamp", "_late", "path"]
    rows = frames.withColumn("_late", F.col("source") != "scene").repartitionByRange(*order).sortWithinPartitions(*order).drop("_late")
    width, schema = len(frames.columns), StructType([*frames.schema.fields, *StructType.fromDDL(folds.MARKS).fields])
    marked = rows.mapInArrow(folds.select_in_ranges(width, merge, similar, gap, threshold), schema).checkpoint()
    seams = marked.where(F.col("_mark") != folds.KEPT).repartition("video_id").sortWithinPartitions("video_id", "_range", "_place")
    closed = seams.mapInArrow(folds.select_at_seams(width, merge, similar, gap, threshold), schema)
    return marked.where(F.col("_mark") == folds.KEPT).unionByName(closed).select(*frames.columns)


def merge_near_frames(frames: DataFrame) -> DataFrame:
    """Frames at most a second after the last kept one go; a scene frame takes the place of the last kept one."""
    return _selected(frames, True, False)


def drop_similar_frames(frames: DataFrame, max_gap: float, threshold: int = 10) -> DataFrame:
    """Frames like the last kept one and less than ``max_gap`` after it go, scenes excepted."""
    return _selected(frames, False, True, max_gap, threshold)


def spread_evenly(position: Column, n: Column, count: Column) -> Column:
    """Whether one of ``count`` places, spread evenly over ``n`` rows from the first to the last and rounded half to even,
    is ``position`` (from 0)."""
    near = F.floor(position * (count - 1) / F.greatest(n - 1, F.lit(1)))
    hit = lambda i: (i >= 0) & (i < count) & (F.rint(i * (n - 1).cast("double") / F.greatest(count - 1, F.lit(1))) == position)
    return hit(near) | hit(near + 1) | hit(near - 1)


def _chosen(position: Column, n: Column, count: Column) -> Column:
    """Whether the row at ``position`` (from 0) of ``n`` is one of ``count`` spread evenly; one alone is the middle."""
    return F.when(count <= 0, False).when(n <= count, True).when(count == 1, position == F.floor(n / 2)).otherwise(spread_evenly(position, n, count))


def even_sample(df: DataFrame, count: int | Column, partition: list[str], order: list) -> DataFrame:
    """At most ``count`` rows of each partition, spread evenly over its order."""
    own = W.partitionBy(*partition)
    rows = df.withColumns({"_pos": F.row_number().over(own.orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(own)})
    return rows.where(_chosen(F.col("_pos"), F.col("_n"), count if isinstance(count, Column) else F.lit(count))).drop("_pos", "_n")


def cap_frames(frames: DataFrame, max_frames: int | str) -> DataFrame:
    """At most ``max_frames`` (a number or a column) frames of a video: first, last and scene frames before all others."""
    most = F.col(max_frames) if isinstance(max_frames, str) else F.lit(max_frames)
    order = ["timestamp", "_late", "path"]
    scene = F.col("source") == "scene"
    rows = frames.withColumns({"_most": most, "_late": ~scene})
    ends = rows.groupBy("video_id").agg(F.min_by("_late", F.struct(*order)).cast("int").alias("_plain_first"), F.max_by("_late", F.struct(*order)).cast("int").alias("_plain_last"))
    rows = scan(rows, ["video_id"], order, row="_k", size="_n", sums={"_scenes": scene}, totals={"_all": scene}).join(ends, "video_id")
    first, end = F.col("_k") == 1, F.col("_k") == F.col("_n")
    # Anchors up to the row: its scenes, a first frame that is none, and a last one that is none.
    plain_end = F.when(F.col("_n") > 1, F.col("_plain_last")).otherwise(0)
    so_far = F.col("_scenes") + F.col("_plain_first") + F.when(end, plain_end).otherwise(0)
    rows = rows.withColumns({"_anchor": scene | first | end, "_anchors": F.col("_all") + F.col("_plain_first") + plain_end, "_so_far": so_far})
    pos = F.when(F.col("_anchor"), F.col("_so_far") - 1).otherwise(F.col("_k") - F.col("_so_far") - 1)
    size = F.when(F.col("_anchor"), F.col("_anchors")).otherwise(F.col("_n") - F.col("_anchors"))
    rows = rows.withColumns({"_pos": pos, "_size": size})
    full = F.col("_anchors") >= F.col("_most")
    keep = (
        F.when(F.col("_n") <= F.col("_most"), True)
        .when(full, F.col("_anchor") & _chosen(F.col("_pos"), F.col("_size"), F.col("_most")))
        .otherwise(F.col("_anchor") | _chosen(F.col("_pos"), F.col("_size"), F.col("_most") - F.col("_anchors")))
    )
    return rows.where(keep).select(*frames.columns)


def name_keyframes(frames: DataFrame) -> DataFrame:
    """``name`` of each frame: its number in time order and its time."""
    numbered = scan(frames.withColumn("_late", F.col("source") != "scene"), ["video_id"], ["timestamp", "_late", "path"], row="_k")
    return numbered.withColumn("name", F.concat(F.format_string("%04d-", F.col("_k")), F.replace(t.format_timestamp(F.col("timestamp")), F.lit(":"), F.lit("-")), F.lit(".jpg"))).select(*frames.columns, "name")


def select_keyframes(frames: DataFrame, videos: DataFrame, min_scan: float = 5, max_gap: float = 45, max_frames: int = 60, threshold: int = 10) -> DataFrame:
    """Plan, merge, drop similar, cap and name; all by video, over one partitioning."""
    plan = sampling_plan(videos.select("video_id", "duration"), min_scan, max_gap, max_frames).select("video_id", "max_gap", "max_frames")
    joined = frames.join(plan, "video_id")
    kept = _selected(joined, True, True, "max_gap", threshold)
    return name_keyframes(cap_frames(kept, "max_frames").drop("max_gap", "max_frames"))


def frame_source_counts(frames: DataFrame) -> DataFrame:
    """Frames of each video by source, as a map."""
    counted = frames.groupBy("video_id", "source").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("video_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("sources"))


def image_luma(images: DataFrame, column: str = "image") -> DataFrame:
    """``luma`` (72 integers) of Spark ``image`` structs."""
    import numpy as np

    @F.pandas_udf("array<int>")
    def shrink(pdf: pd.DataFrame) -> pd.Series:
        return pd.Series([folds.shrink_gray(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)) for r in pdf.itertuples()])

    return images.withColumn("luma", shrink(F.col(column)))
