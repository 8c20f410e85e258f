"""Files and listings as tables, and tables as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cuecorpus.checkpoints import ensure_checkpoints
from cuecorpus.functions import text as t
from cuecorpus.operators.subtitles import EXTENSIONS

METADATA = "title string, id string, webpage_url string, uploader string, channel string, duration double, subtitles map<string,string>, automatic_captions map<string,string>"
_NONE = "array<string>"


def _strings(doc: Column, path: str) -> Column:
    """Items of a list that are texts, trimmed, without empty ones."""
    items = F.coalesce(F.try_variant_get(doc, path, "array<variant>"), F.array().cast("array<variant>"))
    texts = F.transform(F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: t.strip(F.try_variant_get(x, "$", "string")))
    return F.filter(texts, lambda x: x != "")


def parse_video_metadata(df: DataFrame, column: str = "json", url: str | None = None) -> DataFrame:
    """Videos from one JSON document each; ``url`` names the column with the address a document was asked for.

    Keys may be missing, null or empty; lists may be of mixed types. A document that isn't JSON gives no row.
    """
    passed = [F.col(c) for c in df.columns if c not in (column, url)]
    rows = df.select(*passed, *([F.col(url).alias("_url")] if url else [F.lit(None).cast("string").alias("_url")]), F.from_json(column, METADATA).alias("m"), F.try_parse_json(column).alias("v")).where("v IS NOT NULL")
    or_ = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) for x in c])
    langs = lambda c: F.coalesce(F.array_sort(F.map_keys(c)), F.array().cast(_NONE))
    title = F.coalesce(or_(F.col("m.title"), F.col("m.id")), F.lit("video"))
    description = F.when(F.schema_of_variant(F.try_variant_get("v", "$.description", "variant")) == "STRING", F.try_variant_get("v", "$.description", "string"))
    return rows.select(
        *passed,
        title.alias("title"),
        F.coalesce(or_(F.col("m.id")), t.safe_name(title)).alias("id"),
        or_(F.col("m.webpage_url"), F.col("_url")).alias("webpage_url"),
        or_(F.col("m.uploader"), F.col("m.channel")).alias("uploader"),
        F.col("m.duration").alias("duration"),
        description.alias("description"),
        _strings(F.col("v"), "$.tags").alias("tags"),
        _strings(F.col("v"), "$.categories").alias("categories"),
        langs("m.subtitles").alias("subtitle_langs"),
        langs("m.automatic_captions").alias("automatic_caption_langs"),
    )


def read_video_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Videos from a folder of JSON files."""
    return parse_video_metadata(spark.read.text(path, wholetext=True), "value")


def _suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))


def keep_subtitle_files(files: DataFrame) -> DataFrame:
    """Files (``file_name``, ``content`` as bytes) of the known extensions, with ``ext`` and decoded ``content``."""
    ext = _suffix(F.col("file_name"))
    timed = ext.isin(".srt", ".vtt")
    return files.withColumn("ext", ext).where(F.col("ext").isin(*EXTENSIONS)).withColumn("content", F.when(timed, t.decode_text(F.col("content"), bom=True)).otherwise(t.decode_text(F.col("content"))))


def read_subtitle_files(spark: SparkSession, path: str) -> DataFrame:
    """Subtitle files below ``path``; the video's id is the name of the folder a file lies in."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    return keep_subtitle_files(raw.select(F.element_at(parts, -2).alias("video_id"), F.element_at(parts, -1).alias("file_name"), "content"))


def transcripts_of(files: DataFrame) -> DataFrame:
    """Transcripts and titles from files (``path``, ``text``): the title is the stem, or the folder of a ``transcript``."""
    parts = F.split("path", "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    title = F.when((stem == "transcript") & (F.size(parts) > 1), F.element_at(parts, -2)).otherwise(stem)
    return files.select(t.safe_name(title).alias("id"), title.alias("title"), F.lit("file").alias("source"), "text")


def read_transcript_files(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return transcripts_of(raw)


def videos_from_media_listing(files: DataFrame, durations: DataFrame) -> DataFrame:
    """Videos of local media (``path``), with the durations that were probed (``path``, ``duration``), if positive."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    title = F.coalesce(F.nullif(stem, F.lit("")), F.lit("local-video"))
    return files.join(durations, "path", "left").select(title.alias("title"), t.safe_name(stem).alias("id"), F.col("path").alias("webpage_url"), F.when(F.col("duration") > 0, F.col("duration")).alias("duration"))


def write_corpus(df: DataFrame, path: str, buckets: int = 64, key: str = "video_id") -> None:
    """Write a table by hash bucket of the video; only buckets with rows in ``df`` are replaced.

    A bucket is replaced whole: give all rows of the buckets that are touched, as :func:`upsert_corpus` does. A large bucket
    is written by several tasks, a small one by one; how many is left to the sizes that are met at run time. Readers that
    must never see a table between two states take :class:`cuecorpus.sources.store.Store` or ``Buckets``.
    """
    bucketed = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).hint("rebalance", "bucket")
    bucketed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def upsert_corpus(df: DataFrame, path: str, buckets: int = 64, key: str = "video_id") -> None:
    """Replace the videos of ``df`` in a table that :func:`write_corpus` wrote; other videos stay.

    The touched buckets are checkpointed before they are replaced, as they are read and written at once.
    """
    spark = df.sparkSession
    ensure_checkpoints(spark)
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    old = spark.read.parquet(path)
    touched = df.select(bucket.alias("bucket")).distinct()
    rest = old.join(touched, "bucket", "left_semi").join(df.select(key).distinct(), key, "left_anti").drop("bucket")
    write_corpus(df.unionByName(rest).checkpoint(), path, buckets, key)


def latest(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The newest row of each key."""
    order = W.partitionBy(*keys).orderBy(F.desc(by))
    return df.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
