"""Joins of frames with speech, model answers for frames, and the compaction of what screens show."""

from __future__ import annotations

import math
from collections.abc import Callable

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, StringType

from cuecorpus.checkpoints import Scratch, in_waves
from cuecorpus.functions import text as t
from cuecorpus.operators import folds
from cuecorpus.operators.ordered import scan

MARK = "……"
#: Lines that meet a transcript at once.
LINES = 10_000
#: Bytes of screen text, and 100 for each frame, that a wave of videos holds, about.
WAVE_BYTES = 512_000_000


def nearby_context(frames: DataFrame, cues: DataFrame, window: float = 15, max_chars: int = 500) -> DataFrame:
    """``context`` of each frame: the cues at most ``window`` seconds away, in transcript order, cut to ``max_chars``.

    A range join over time buckets of the window's width: a cue meets the frames of three buckets of its video.
    """
    bucket = F.floor(F.col("timestamp") / window)
    near = frames.select("video_id", "path", "timestamp", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b"))
    timed = cues.where("seconds IS NOT NULL").select("video_id", "seq", "seconds", "text", F.floor(F.col("seconds") / window).alias("_b"))
    joined = near.join(timed, ["video_id", "_b"]).where(F.abs(F.col("seconds") - F.col("timestamp")) <= window)
    words = joined.groupBy("video_id", "path", "timestamp").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("_c"))
    return words.select("video_id", "path", t.rstrip(t.cut(F.array_join(F.col("_c.text"), " "), max_chars)).alias("context"))


def nearest_cue(frames: DataFrame, cues: DataFrame, max_chars: int = 500) -> DataFrame:
    """``context`` of each frame: the timed cue closest to it, ties to the first in transcript order.

    Frames and cues are laid in one order per video; the cue before and the one after a frame are looked up in it, in as many
    tasks as the video has ranges of time.
    """
    c = cues.where("seconds IS NOT NULL").groupBy("video_id", "seconds").agg(F.min(F.struct("seq", "text")).alias("_cue"))
    both = c.select("video_id", F.col("seconds").alias("at"), F.lit(None).cast("string").alias("path"), F.struct("_cue.seq", F.col("seconds"), "_cue.text").alias("_cue")).unionByName(
        frames.select("video_id", F.col("timestamp").alias("at"), "path"), allowMissingColumns=True
    )
    # A cue at a frame's time comes before it, and is found looking back.
    rows = scan(both.withColumn("_frame", F.col("path").isNotNull()), ["video_id"], ["at", "_frame", "path"], last={"_back": F.col("_cue")}, next={"_ahead": F.col("_cue")}).where("path IS NOT NULL")
    far = lambda c: F.abs(F.col(f"{c}.seconds") - F.col("at"))
    ahead = F.col("_back").isNull() | (F.col("_ahead").isNotNull() & ((far("_ahead") < far("_back")) | ((far("_ahead") == far("_back")) & (F.col("_ahead.seq") < F.col("_back.seq")))))
    return rows.select("video_id", "path", t.rstrip(t.cut(F.when(ahead, F.col("_ahead.text")).otherwise(F.col("_back.text")), max_chars)).alias("context")).where("context IS NOT NULL")


def frame_context(frames: DataFrame, cues: DataFrame, window: float = 15, max_chars: int = 500) -> DataFrame:
    """Nearby speech, or the nearest cue for frames that have none in their window."""
    near = nearby_context(frames, cues, window, max_chars)
    rest = frames.join(near, ["video_id", "path"], "left_anti")
    return near.unionByName(nearest_cue(rest, cues, max_chars))


def reused_results(frames: DataFrame, existing: DataFrame, model: str, signature: str) -> DataFrame:
    """Existing results of the same model and signature for images that are still wanted."""
    return existing.where((F.col("model") == model) & (F.col("analysis_signature") == signature)).join(frames.select("video_id", F.col("path").alias("image")), ["video_id", "image"], "left_semi")


def pending_frames(frames: DataFrame, reused: DataFrame) -> DataFrame:
    return frames.join(reused.select("video_id", F.col("image").alias("path")), ["video_id", "path"], "left_anti")


def coverage(frames: DataFrame, results: DataFrame) -> DataFrame:
    """``covered``: whether a video has frames and a result for each."""
    done = results.select("video_id", F.col("image").alias("path")).distinct().withColumn("_done", F.lit(True))
    return frames.join(done, ["video_id", "path"], "left").groupBy("video_id").agg(F.bool_and(F.coalesce("_done", F.lit(False))).alias("covered"))


def valid_cached_keyframes(cache: DataFrame, files: DataFrame, signatures: DataFrame) -> DataFrame:
    """Cached frames (``video_id``, ``signature``, ``path``) of the videos whose signature matches and whose files all exist."""
    wanted = cache.join(signatures, ["video_id", "signature"], "left_semi")
    there = wanted.join(files.select("video_id", "path").distinct().withColumn("_there", F.lit(True)), ["video_id", "path"], "left")
    good = there.groupBy("video_id").agg(F.bool_and(F.coalesce("_there", F.lit(False))).alias("_ok")).where("_ok")
    return wanted.join(good, "video_id", "left_semi")


def assign_batches(frames: DataFrame, size: int) -> DataFrame:
    """``batch`` from 0 and ``index`` from 1 of each frame, in time order."""
    k = F.col("_k") - 1
    numbered = scan(frames, ["video_id"], ["timestamp", "path"], row="_k")
    return numbered.withColumns({"batch": F.floor(k / size).cast("int"), "index": (k % size + 1).cast("int")}).drop("_k")


def split_failed_batches(batches: DataFrame) -> DataFrame:
    """Failed batches (``first``, ``n``) as two halves; a failed batch of one frame has none and fails its video."""
    half = F.floor(F.col("n") / 2).cast("int")
    halves = F.when(F.col("n") > 1, F.array(F.struct(F.lit(0).alias("half"), F.col("first").alias("first"), half.alias("n")), F.struct(F.lit(1).alias("half"), (F.col("first") + half).alias("first"), (F.col("n") - half).alias("n"))))
    return batches.select("video_id", "batch", F.explode(halves).alias("_h")).select("video_id", "batch", "_h.half", F.col("_h.first").alias("first"), F.col("_h.n").alias("n"))


def attach_visual_results(responses: DataFrame, batches: DataFrame) -> DataFrame:
    """Model answers joined to frames by (``batch``, ``index``): one row per frame of a usable batch, one per failed batch.

    ``responses``: ``video_id``, ``batch``, ``content``. A batch fails as a whole, with ``error``, when its answer isn't an
    object with a list of frames, or misses a frame or a frame's description.
    """
    parsed = responses.withColumn("_bare", t.unfenced(F.col("content"))).withColumn("_v", t.json_in(F.col("_bare")))
    field = lambda x, k: F.coalesce(t.text_field(x, f"$.{k}"), F.lit(""))
    # Answers are whole texts: what is kept of an item is cut where the answer is read, before anything is dealt.
    item = lambda x: F.struct(
        F.try_variant_get(x, "$.index", "int").alias("index"), t.rstrip(t.cut(field(x, "description"), 160)).alias("d"), t.rstrip(t.cut(field(x, "visible_text"), 320)).alias("t"),
        F.lower(field(x, "importance")).alias("level"), field(x, "uncertainty").alias("uncertainty"),
    )
    read = parsed.select("video_id", "batch", F.transform(F.try_variant_get("_v", "$.frames", "array<variant>"), item).alias("_items"))
    rows = batches.join(read, ["video_id", "batch"], "left").withColumn("_i", F.try_element_at(F.filter("_items", lambda x: x["index"] == F.col("index")), F.lit(-1)))
    level = F.col("_i.level")
    rows = rows.select(
        "video_id", "batch", "index", "path", "timestamp", "source", F.col("_items").isNotNull().alias("_list"),
        F.col("_i").isNull().alias("_gone"), F.col("_i.d").alias("_d"), F.col("_i.t").alias("_t"),
        F.when(level.isin("high", "medium", "low"), level).otherwise("medium").alias("importance"), F.coalesce("_i.uncertainty", F.lit("")).alias("uncertainty"),
    )
    fault = F.when(~F.col("_list"), "no_frames").when(F.col("_gone"), "missing_item").when(F.col("_d") == "", "missing_description")
    rows = rows.withColumn("_fault", fault)
    own = W.partitionBy("video_id", "batch")
    rows = rows.withColumn("error", F.min_by("_fault", F.when(F.col("_fault").isNotNull(), F.col("index"))).over(own))
    good = F.col("error").isNull()
    return rows.where(good | (F.col("index") == 1)).select(
        "video_id", "batch", F.when(good, F.col("index")).alias("index"), "error",
        F.when(good, F.round("timestamp", 3)).alias("timestamp_seconds"),
        F.when(good, t.format_timestamp(F.col("timestamp"))).alias("timestamp"),
        F.when(good, F.col("path")).alias("image"), F.when(good, F.col("source")).alias("frame_source"),
        F.when(good, F.col("_d")).alias("description"), F.when(good, F.col("_t")).alias("visible_text"),
        F.when(good, F.col("importance")).alias("importance"), F.when(good, F.col("uncertainty")).alias("uncertainty"),
    )


def visual_lines(frames: DataFrame) -> DataFrame:
    """Lines on screen in long form: ``video_id``, ``image``, ``timestamp_seconds``, ``pos``, ``line``, ``norm``."""
    rows = frames.select("video_id", "image", "timestamp_seconds", F.posexplode(t.screen_lines(F.col("visible_text"))).alias("pos", "line"))
    return rows.withColumn("norm", t.normalize_line(F.col("line")))


def _is_boilerplate(shown: Column, frames: Column) -> Column:
    return (shown >= F.greatest(F.lit(3), F.floor((frames + 3) / 4))) & (F.length("norm") <= 40)


def boilerplate_lines(frames: DataFrame) -> DataFrame:
    """Lines of at most 40 characters that a quarter of a video's frames, and three at least, show."""
    counted = visual_lines(frames).select("video_id", "image", "norm").distinct().groupBy("video_id", "norm").agg(F.count(F.lit(1)).alias("n"))
    sizes = frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("frames"))
    return counted.join(sizes, "video_id").where(_is_boilerplate(F.col("n"), F.col("frames"))).select("video_id", "norm", "n")


@F.pandas_udf(ArrayType(StringType()))
def _found(lines: pd.Series, spoken: pd.Series) -> pd.Series:
    """Of each list of lines, those that the text beside it holds: one automaton over the lines, one pass over the text."""

    def find(patterns, text: str) -> list[str]:
        machine = ahocorasick.Automaton()
        for x in patterns:
            machine.add_word(x, x)
        machine.make_automaton()
        return list({x for _, x in machine.iter(text)})

    return pd.Series([find(x, y) if len(x) and y else [] for x, y in zip(lines, spoken, strict=True)], dtype=object)


def spoken_lines(lines: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Distinct lines (``video_id``, ``norm``) of four characters and more that the video's transcript holds.

    A video's lines meet its transcript as lists of about ``LINES``, which are searched for at once, so the transcript is read
    once for each list and not for each line, and a video of any number of lines is more than one row.
    """
    long = lines.where(F.length("norm") >= 4).select("video_id", "norm").distinct()
    lists = long.groupBy("video_id").agg(F.ceil(F.count(F.lit(1)) / LINES).alias("lists"))
    dealt = long.join(lists, "video_id").groupBy("video_id", F.pmod(F.xxhash64("norm"), F.col("lists")).alias("list")).agg(F.collect_list("norm").alias("norms"))
    spoken = transcripts.select("video_id", t.normalize_line(F.col("text")).alias("spoken"))
    found = dealt.join(spoken, "video_id").select("video_id", _found("norms", "spoken").alias("norms"))
    return found.select("video_id", F.explode("norms").alias("norm"))


def remove_subtitle_overlap(lines: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Screen lines but for those of four characters and more that the transcript holds."""
    return lines.join(spoken_lines(lines, transcripts), ["video_id", "norm"], "left_anti").select(*lines.columns)


def _normed() -> Column:
    """The normalized lines of a frame, at their places."""
    return F.coalesce(F.transform(t.screen_lines(F.col("visible_text")), t.normalize_line), F.array().cast("array<string>"))


def _useful(lined: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Lines (``_id``, ``video_id``, ``pos``, ``norm``) of frames (``_id``, ``video_id``, ``_norms``) that are neither boilerplate
    nor spoken.

    Frames that show a line are counted in the tasks that read them before the counts meet, and a video's boilerplate, of which
    there is little by its nature, is taken out of frames before their lines become rows: the lines that most frames show
    are never rows of one key.
    """
    sizes = lined.groupBy("video_id").agg(F.count(F.lit(1)).alias("_frames"))
    counted = lined.select("video_id", F.explode(F.array_distinct("_norms")).alias("norm")).groupBy("video_id", "norm").agg(F.count(F.lit(1)).alias("_shown"))
    # What can't be boilerplate in a video of any length doesn't meet the sizes.
    judged = counted.where(_is_boilerplate(F.col("_shown"), F.lit(0))).join(sizes, "video_id").where(_is_boilerplate(F.col("_shown"), F.col("_frames")))
    boiler = judged.groupBy("video_id").agg(F.collect_list("norm").alias("_boilers"))
    known = lined.select("_id", "video_id", F.transform("_norms", lambda x, k: F.struct(k.alias("pos"), x.alias("norm"))).alias("_l")).join(boiler, "video_id", "left")
    shown = known.select("_id", "video_id", F.explode(F.filter("_l", lambda x: ~F.array_contains(F.coalesce("_boilers", F.array().cast("array<string>")), x["norm"]))).alias("_x")).select("_id", "video_id", "_x.*")
    return remove_subtitle_overlap(shown, transcripts)


def _numbered(frames: DataFrame, scratch: Scratch) -> DataFrame:
    """Frames with a number ``_id``, kept, as they are read more than once."""
    return scratch.keep(frames.withColumn("_id", F.monotonically_increasing_id()))


def useful_lines(frames: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Lines that are neither boilerplate nor spoken: ``video_id``, ``image``, ``timestamp_seconds``, ``pos``, ``line``, ``norm``."""
    numbered = _numbered(frames, Scratch(frames.sparkSession))
    useful = _useful(numbered.select("_id", "video_id", _normed().alias("_norms")), transcripts).drop("video_id")
    return useful.join(numbered, "_id").select("video_id", "image", "timestamp_seconds", "pos", F.get(t.screen_lines(F.col("visible_text")), F.col("pos")).alias("line"), "norm")


def _new_places(numbered: DataFrame, transcripts: DataFrame, scratch: Scratch) -> DataFrame:
    """``_id`` and ``_new`` of frames with new lines: the places of their useful lines that the frame before didn't show.

    The frame before is looked up by an ordered scan over numbers of frames; lines meet those of the frame before by frame and
    line, so a video of any length is dealt to all tasks. Lines travel normalized only; places find them in their frames.
    """
    lined = scratch.keep(numbered.select("_id", "video_id", "timestamp_seconds", "image", _normed().alias("_norms")))
    before = scan(lined.select("_id", "video_id", "timestamp_seconds", "image"), ["video_id"], ["timestamp_seconds", "image", "_id"], previous={"_before": F.col("_id")}, keep=scratch.keep).select("_id", "_before")
    useful = scratch.keep(_useful(lined, transcripts).join(before, "_id").select("_id", "_before", "pos", "norm"))
    fresh = useful.join(useful.select(F.col("_id").alias("_before"), "norm").distinct(), ["_before", "norm"], "left_anti")
    return fresh.groupBy("_id").agg(F.array_sort(F.collect_list("pos")).alias("_new"))


def _new_lines() -> Column:
    """The lines at the places ``_new`` of a frame."""
    none = F.array().cast("array<string>")
    return F.coalesce(t.let(t.screen_lines(F.col("visible_text")), lambda x: F.transform("_new", lambda k: F.get(x, k))), none)


def _by_videos(frames: DataFrame, transcripts: DataFrame, work: Callable[[DataFrame, DataFrame, Scratch], DataFrame]) -> DataFrame:
    """``work`` on numbered frames and transcripts, in waves of videos where there are many frames, so that what it deals and
    keeps is never on disk for all of them. Frames are made once."""
    scratch = Scratch(frames.sparkSession)
    numbered = _numbered(frames, scratch)
    size = numbered.agg(F.sum(F.coalesce(F.octet_length("visible_text"), F.lit(0)) + 100)).first()[0] or 0
    waves = max(1, math.ceil(size / WAVE_BYTES))
    spoken = transcripts.select("video_id", "text")
    if waves > 1:
        spoken = scratch.keep(spoken)
    got = in_waves(frames.sparkSession, waves, lambda mine, own: work(mine(numbered), mine(spoken), own))
    if waves > 1:
        scratch.drop()
    return got


def new_screen_lines(frames: DataFrame, transcripts: DataFrame) -> DataFrame:
    """``delta_lines`` of each frame: its useful lines that the frame before it didn't show."""

    def work(numbered: DataFrame, spoken: DataFrame, scratch: Scratch) -> DataFrame:
        return numbered.join(_new_places(numbered, spoken, scratch), "_id", "left").select(*frames.columns, _new_lines().alias("delta_lines"))

    return _by_videos(frames, transcripts, work)


def compact_visual(frames: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Visual frames without repeated lines, and without those that add nothing.

    A frame with new lines stays. One without goes if it is of low importance, or if its description is like that of the
    last frame that stayed. Frames with lines part a video into segments; only what has no lines passes through Python, and
    segments are dealt by themselves, so a long video is many tasks.
    """
    def work(numbered: DataFrame, spoken: DataFrame, scratch: Scratch) -> DataFrame:
        fresh = scratch.keep(_new_places(numbered, spoken, scratch))
        described = numbered.withColumn("description", t.collapse("description"))
        marked = described.join(fresh.select("_id", F.lit(True).alias("_has")), "_id", "left").withColumn("_has", F.coalesce("_has", F.lit(False)))
        # Frames without lines and of low importance neither stay nor matter to others.
        narrow = marked.where(F.col("_has") | ~F.col("importance").eqNullSafe("low")).select("_id", "video_id", "timestamp_seconds", "image", "_has", t.casefold(F.col("description")).alias("_key"))
        parted = scan(narrow, ["video_id"], ["timestamp_seconds", "image", "_id"], sums={"segment": F.col("_has")}, last={"head": F.when(F.col("_has"), F.col("_key"))}, keep=scratch.keep)
        plain = parted.where("NOT _has").select("video_id", "segment", "timestamp_seconds", "image", "_id", F.col("_key").alias("key"), "head")
        stream = plain.repartition("video_id", "segment").sortWithinPartitions("video_id", "segment", "timestamp_seconds", "image", "_id")
        stay = stream.mapInArrow(folds.unlike_last, plain.schema).select("_id", F.array().cast("array<int>").alias("_new"))
        kept = described.join(fresh.unionByName(stay), "_id")
        short = lambda c, most: F.when(F.length(c) > most, F.concat(t.rstrip(t.cut(c, most)), F.lit(MARK))).otherwise(c)
        shown = kept.withColumn("visible_text", short(F.array_join(_new_lines(), "\n"), F.lit(240)))
        said = shown.withColumn("description", short(F.col("description"), F.when(F.col("visible_text") != "", 80).otherwise(120)))
        # What a task writes stands in the order of time.
        return said.sortWithinPartitions("video_id", "timestamp_seconds", "image").select(*frames.columns)

    return _by_videos(frames, transcripts, work)


def vision_metrics(batches: DataFrame) -> DataFrame:
    """Per video: requested frames, batches, splits and seconds (``n``, ``seconds``, ``split``), and the smallest batch size."""
    return batches.groupBy("video_id").agg(
        F.sum("n").alias("requested_frames"),
        F.count(F.lit(1)).alias("batches"),
        F.sum(F.col("split").cast("int")).alias("fallback_splits"),
        F.min("n").alias("effective_batch_size"),
        F.round(F.sum("seconds"), 3).alias("seconds"),
    )
