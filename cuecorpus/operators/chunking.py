"""Chunks of long texts, context terms, and rendered prompts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuecorpus.functions import text as t

# Fixed texts of the merged material.
MERGE_HEAD = (
    "# 合并要求\n\n以下是全部分段摘要。最终结果必须逐段覆盖，每一段都至少保留其开头、中间和结尾的重要时间节点；"
    "可以合并相邻节点，但不得只详细总结第一段或省略最后一段的后半部分。若材料本身没有注明截断，不得声称“原文截断”。\n\n# 全部分段摘要\n\n"
)
TERM_PATTERNS = (
    r"(?U)\b[A-Za-z][A-Za-z0-9]*(?:[.+_-][A-Za-z0-9]+)+\b",
    r"(?U)\b[A-Za-z]*[A-Z][A-Za-z0-9]*(?:\s+[A-Za-z]*[A-Z][A-Za-z0-9]*){0,2}\b",
    r"(?U)\b[A-Za-z]+(?:\s+[A-Z][A-Za-z0-9]+){1,2}\b",
)


def _split(df: DataFrame, max_chars: int | Column, cut, text: str) -> DataFrame:
    if isinstance(max_chars, int):
        if max_chars <= 0:
            raise ValueError("max_chars must be positive")
        max_chars = F.lit(max_chars)
    rest = [c for c in df.columns if c != text]
    # Texts that are short enough never leave the JVM.
    long = F.length(text) > max_chars

    @F.pandas_udf("array<string>")
    def cuts(texts: pd.Series, most: pd.Series) -> pd.Series:
        return pd.Series([cut(x, int(n)) if isinstance(x, str) else None for x, n in zip(texts, most, strict=True)], dtype=object)

    asked = cuts(F.when(long, F.col(text)), F.when(long, max_chars.cast("int")))
    rows = df.select(*rest, F.coalesce(asked, F.when(F.col(text).isNotNull(), F.array(F.col(text)))).alias("_parts"))
    out = rows.select(*rest, F.size("_parts").alias("chunk_count"), F.posexplode("_parts").alias("_k", "text"))
    return out.select(*rest, (F.col("_k") + 1).alias("chunk_index"), "chunk_count", "text", F.length("text").alias("n_chars"))


def _packed(text: str, most: int) -> list[str]:
    """Chunks of whole lines, lines of over ``most`` characters cut; where a chunk ends is looked up among the sums of lengths."""
    parts = [x[at : at + most] for x in text.splitlines() for at in range(0, max(len(x), 1), most)]
    # Each part costs its length and a break.
    used = np.concatenate(([0], np.cumsum([len(x) + 1 for x in parts])))
    out, at = [], 0
    while at < len(parts):
        end = max(at + 1, int(np.searchsorted(used, used[at] + most, side="right")) - 1)
        out.append("\n".join(parts[at:end]))
        at = end
    return out


def _balanced(text: str, most: int) -> list[str]:
    """Chunks of like length; the break nearest to an even cut is looked up among the places of all breaks."""
    breaks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10)
    n, pieces = len(text), -(-len(text) // most)
    out, start = [], 0
    for left in range(pieces, 1, -1):
        even = start - (start - n) // left
        at = int(np.searchsorted(breaks, even, side="right"))
        # A cut stands behind its break. Breaks count after the first character, and as far as a chunk may reach.
        before = [b for b in breaks[max(at - 1, 0) : at] if b > start]
        behind = [b for b in breaks[int(np.searchsorted(breaks, even)) :][:1] if b <= start + most]
        near = min(((abs(b + 1 - even), k, int(b) + 1) for k, found in enumerate((before, behind)) for b in found), default=(0, 0, even))
        end = near[2]
        out.append(text[start:end].rstrip("\n"))
        start = end
    return [*out, text[start:].lstrip("\n")]


def split_text(df: DataFrame, max_chars: int | Column, text: str = "text") -> DataFrame:
    """Chunks of whole lines, filled one after the other; the work is linear in a text's length."""
    return _split(df, max_chars, _packed, text)


def split_text_balanced(df: DataFrame, max_chars: int | Column, text: str = "text") -> DataFrame:
    """Chunks of like length, cut at line ends where one is near; the work is linear in a text's length."""
    return _split(df, max_chars, _balanced, text)


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Per video: number of chunks, their lengths in order and the longest."""
    rows = chunks.groupBy("video_id").agg(F.count(F.lit(1)).alias("chunks"), F.array_sort(F.collect_list(F.struct("chunk_index", "n_chars"))).alias("_c"), F.max("n_chars").alias("max_chars"))
    return rows.select("video_id", "chunks", F.col("_c.n_chars").alias("chunk_lengths"), "max_chars")


def context_terms(videos: DataFrame, max_total: int = 800) -> DataFrame:
    """Terms of each video's title, uploader, description, tags and categories, first come first kept, within ``max_total``.

    Kept terms are few, so the fold over candidates carries a small state; it stays inside the row.
    """
    found = lambda c: F.flatten(F.array(*[F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(p), 0) for p in TERM_PATTERNS]))
    short = lambda c, n: F.filter(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, n), lambda x: F.length(x) <= 30)
    candidates = F.concat(found(F.col("title")), found(F.col("uploader")), found(F.col("description")), short(F.col("tags"), 12), short(F.col("categories"), 8))
    rows = videos.select("video_id", F.filter(F.transform(candidates, t.normalize_term), lambda x: (F.length(x) >= 2) & (F.length(x) <= 60)).alias("_c"))
    start = F.struct(F.array().cast("array<string>").alias("terms"), F.array().cast("array<string>").alias("keys"), F.lit(0).alias("size"))

    def step(acc: Column, x: Column) -> Column:
        key = t.casefold(x)
        # A key that is part of a kept one, or equal to it, adds nothing.
        known = F.exists(acc["keys"], lambda k: k.contains(key))
        return F.when(known | (acc["size"] + F.length(x) > max_total), acc).otherwise(
            F.struct(F.concat(acc["terms"], F.array(x)).alias("terms"), F.concat(acc["keys"], F.array(key)).alias("keys"), (acc["size"] + F.length(x) + 2).alias("size"))
        )

    kept = rows.select("video_id", F.aggregate("_c", start, step)["terms"].alias("terms"))
    return kept.withColumn("asr_prompt", t.asr_prompt(F.col("terms")))


def prompts(chunks: DataFrame, template: str, source: Column) -> DataFrame:
    """``prompt`` of each chunk; ``chunks`` carries the video's title, webpage_url, uploader and duration."""
    return chunks.withColumn(
        "prompt",
        t.render(template, title=F.col("title"), source=source, transcript=F.col("text"), chunk_index=F.col("chunk_index"), chunk_count=F.col("chunk_count"), webpage_url=F.col("webpage_url"), uploader=F.col("uploader"), duration=F.col("duration"), transcript_quality_note=t.quality_note(source)),
    )


def merge_material(partials: DataFrame) -> DataFrame:
    """The answers for a video's chunks (``chunk_index``, ``answer``) as material of the final prompt."""
    rows = partials.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "answer"))).alias("_p"))
    part = lambda x, k: F.concat(F.lit("## 第 "), (k + 1).cast("string"), F.lit("/"), F.size("_p").cast("string"), F.lit(" 段摘要\n\n"), x["answer"])
    return rows.select("video_id", F.concat(F.lit(MERGE_HEAD), F.array_join(F.transform("_p", part), "\n\n")).alias("text"))


def export_prompts(transcripts: DataFrame, videos: DataFrame, max_chars: int, template: str) -> DataFrame:
    """One text of prompts per transcript (``video_id``, ``source``, ``text``), fences of three backticks defused."""
    chunks = split_text(transcripts, max_chars).withColumn("text", F.replace("text", F.lit("```"), F.lit("'''")))
    joined = chunks.join(videos.select("video_id", "title", "webpage_url", "uploader", "duration"), "video_id")
    rows = prompts(joined, template, F.col("source")).groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "prompt"))).alias("_p"))
    return rows.select("video_id", F.concat(t.rstrip(F.array_join(F.col("_p.prompt"), "\n\n")), F.lit("\n")).alias("prompts"))
