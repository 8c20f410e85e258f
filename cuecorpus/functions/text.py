"""Column functions for names, times, subtitle text, screen text, prompts and model answers.

White space is what Unicode calls so, and U+001C to U+001F; lengths are in code points.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, constants and texts that results depend on.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
BREAKS = "(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ])"
TERM_EDGE = " \t\r\n,，。.!！?？:：;；()（）[]【】<>《》\"'"
EVIDENCE = (
    r"(?iU)(?:^|[；：\s])(?:\$\s*)?(?:npx|npm|pnpm|yarn|pipx?|uv|docker|git|cargo|go|brew)\s+\S+"
    r"|https?://\S+|github\.com/\S+"
)
VISUAL_LEAST, VISUAL_MOST, VISUAL_RATIO = 800, 3200, 0.25
RETRY_TOKENS = 2600
CUT_SHORT = ("length", "max_tokens")
NOTES = {
    "whisper": "本文本由 Whisper 音频转写生成，可能存在专有名词、英文术语、产品名、人名、数字、标点和断句错误。请结合上下文只修正明显误识别；无法确定时保守表述，不要编造原文没有的信息。",
    "auto_subtitle": "本文本来自平台自动字幕，可能存在自动识别错误。请结合上下文只修正明显误识别；无法确定时保守表述，不要编造原文没有的信息。",
    "manual_subtitle": "本文本来自人工字幕，通常较可靠，但仍可能存在错字、漏字或排版问题；请只基于原文总结。",
    "file": "本文本来自已有转写稿，来源质量未知；如遇疑似识别错误，请结合上下文保守理解，不要编造。",
}
NOTE_OTHER = "转写文本可能存在识别、清洗或断句错误；请结合上下文保守总结，不要编造原文没有的信息。"
NOTE_VISION = " 画面描述由本地视觉模型生成，也可能存在漏读或误判；不确定内容不得当作事实。"
LANGUAGE_WARNING = "标题包含较多英文术语；如果视频主要是英文，建议使用 --language en 或 --language auto 提升 Whisper 识别质量。"
DOWNLOAD_HINTS = {
    "bilibili_precondition_failed": [
        "B 站返回 412，通常是风控或未携带有效登录态。",
        "请优先尝试 --cookies /app/cookies/cookies.txt，或 --cookies-from-browser edge/chrome/firefox。",
        "如果在 Docker 中读取浏览器 cookies，请先把浏览器 profile 挂载进容器，或导出 cookies.txt。",
    ],
    "rate_limited": ["上游服务限流，请稍后重试。"],
    "insufficient_quota": ["OpenAI API 额度不足，请检查 API billing 和项目 quota。"],
}
MODEL_HINTS = {
    "insufficient_quota": ["OpenAI API 额度不足，ChatGPT Plus 不等于 API 额度。", "程序会尽量生成 chatgpt_prompt.md，你可以复制到 ChatGPT 手动总结。"],
    "rate_limited": ["请求被限流，请稍后重试或换用 --export-prompt。"],
    "llm_error": ["可以使用 --export-prompt 导出提示词后手动总结。"],
}
ASR_LEAD = "视频元数据中出现的关键词包括："
VARIABLES = ("title", "source", "transcript", "chunk_index", "chunk_count", "webpage_url", "uploader", "duration", "transcript_quality_note")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return strip(F.regexp_replace(c, rf"{SPACE}+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def split_lines(c: Column) -> Column:
    """Lines of a text, without an empty one after a final break."""
    parts = F.split(c, BREAKS, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


#: Lower case letters that full case folding changes further, such as sharp s, final sigma and ligatures.
FOLDED = {x: x.casefold() for x in map(chr, range(0x110000)) if x.casefold() != x == x.lower()}


def casefold(c: Column) -> Column:
    """Full case folding: lower case, and the letters that fold further one by one in texts that hold any.

    Sharp s is common and folded at once; two ranges tell most texts that hold no other such letter.
    """
    low = F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))
    rest = {k: v for k, v in FOLDED.items() if k != "ß"}
    table = F.create_map(*[F.lit(x) for pair in rest.items() for x in pair])
    folded = F.array_join(F.transform(F.split(low, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    likely = low.rlike("[" + "".join(k for k in rest if k < "\u0100") + "\u0100-\U0010ffff]")
    return F.when(~likely, low).when(low.rlike("[" + "".join(rest) + "]"), folded).otherwise(low)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def cut(c: Column, n: int | Column) -> Column:
    return F.substr(c, F.lit(1), n if isinstance(n, Column) else F.lit(n))


def decode_text(content: Column, bom: bool = False) -> Column:
    """Bytes as text, leaving out what isn't UTF-8; with ``bom`` a leading byte order mark goes too."""
    text = F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))
    return F.regexp_replace(text, "^﻿", "") if bom else text


def safe_name(c: Column) -> Column:
    """A name without the characters that file systems refuse; at most 80 code points."""
    clean = strip(F.regexp_replace(c, r'[\\/:*?"<>|]+', "_"))
    return F.coalesce(blank_to_null(cut(F.regexp_replace(clean, rf"(?U){SPACE}+", " "), 80)), F.lit("video"))


def output_key(video_id: Column, title: Column, is_local: Column) -> Column:
    return F.when(is_local, safe_name(title)).otherwise(safe_name(F.concat(video_id, F.lit("-"), title)))


def format_timestamp(seconds: Column) -> Column:
    """``HH:MM:SS`` of the whole seconds, negative ones as zero."""
    s = F.greatest(seconds.cast("bigint"), F.lit(0))
    return F.when(seconds.isNotNull(), F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60))


def parse_subtitle_timestamp(c: Column) -> Column:
    """The time at the start of a text, as ``HH:MM:SS``; null when there is none. No range check."""
    pattern = r"^(?:(\d+):)?(\d{1,2}):(\d{2})(?:[,.]\d{1,3})?"
    value = strip(c)
    part = lambda k: F.coalesce(F.try_to_number(blank_to_null(F.regexp_extract(value, pattern, k)), F.lit("9999999999")).cast("bigint"), F.lit(0))
    return F.when(value.rlike(pattern), F.format_string("%02d:%02d:%02d", part(1), part(2), part(3)))


def timestamp_to_seconds(c: Column) -> Column:
    parts = F.split(c, ":")
    number = lambda k: F.get(parts, F.lit(k)).try_cast("double")
    return F.when(F.size(parts) == 3, number(0) * 3600 + number(1) * 60 + number(2))


def clean_cue_text(c: Column) -> Column:
    """Without tags and override codes, white space collapsed."""
    return collapse(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), r"\{\\.*?\}", ""))


def cue_line(line: Column) -> dict[str, Column]:
    """``ts``, ``seconds`` and ``text`` of one transcript line; ``ts`` is null for an untimed one."""
    value = strip(line)
    pattern = r"(?U)^\[(\d+:\d{2}:\d{2})\]\s*(.+)$"
    timed = value.rlike(pattern)
    ts = F.when(timed, F.regexp_extract(value, pattern, 1))
    return {"ts": ts, "seconds": timestamp_to_seconds(ts), "text": F.when(timed, F.regexp_extract(value, pattern, 2)).otherwise(value)}


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def difference_hash(luma: Column) -> Column:
    """64 bits from 8 rows of 9 pixels: a bit is set where a pixel is brighter than the next; the first is the highest."""
    bit = lambda k: F.when(F.get(luma, F.floor(k / 8).cast("int") * 9 + k % 8) > F.get(luma, F.floor(k / 8).cast("int") * 9 + k % 8 + 1), F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda acc, k: F.call_function("shiftleft", acc, F.lit(1)).bitwiseOR(bit(k)))


def normalize_term(c: Column) -> Column:
    edge = "".join(re.escape(x) for x in TERM_EDGE)
    flat = F.regexp_replace(F.regexp_replace(c, r"(?U)https?://\S+", " "), rf"(?U){SPACE}+", " ")
    return strip(F.regexp_replace(flat, rf"^[{edge}]+|[{edge}]+\z", ""))


def normalize_line(c: Column) -> Column:
    return casefold(collapse(c))


def screen_lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "[\r\n；;]+", -1), strip), lambda x: x != "")


def has_command_evidence(c: Column) -> Column:
    """A package or version control command with an argument, or an address."""
    return c.rlike(EVIDENCE)


def quality_note(source: Column) -> Column:
    base = F.substring_index(F.regexp_replace(source, r"_partials\z", ""), "+", 1)
    note = F.lit(NOTE_OTHER)
    for name, text in NOTES.items():
        note = F.when(base == name, text).otherwise(note)
    return F.concat(note, F.when(source.contains("+vision"), NOTE_VISION).otherwise(""))


def warns_language(title: Column, requested: str) -> Column:
    return F.lit(requested == "zh") & (F.regexp_count(title, F.lit("[A-Za-z][A-Za-z0-9.+_-]*")) >= 3)


def download_error(log: Column, url: Column) -> Column:
    site = F.coalesce(url.contains("bilibili.com") | url.contains("b23.tv"), F.lit(False))
    return (
        F.when(log.contains("HTTP Error 412") & site, "bilibili_precondition_failed")
        .when(log.contains("429") | F.lower(log).contains("rate limit"), "rate_limited")
        .when(log.contains("insufficient_quota"), "insufficient_quota")
        .otherwise("upstream_error")
    )


def model_error(message: Column) -> Column:
    return (
        F.when(message.contains("insufficient_quota") | message.contains("exceeded your current quota"), "insufficient_quota")
        .when(F.lower(message).contains("rate limit") | message.contains("429"), "rate_limited")
        .otherwise("llm_error")
    )


def _hints(code: Column, hints: dict[str, list[str]]) -> Column:
    out = F.array().cast("array<string>")
    for name, lines in hints.items():
        out = F.when(code == name, F.array(*[F.lit(x) for x in lines])).otherwise(out)
    return out


def download_hints(code: Column) -> Column:
    """What to try after a download failed with ``code``."""
    return _hints(code, DOWNLOAD_HINTS)


def model_hints(code: Column) -> Column:
    """What to try after a model's call failed with ``code``."""
    return _hints(code, MODEL_HINTS)


def is_context_length(message: Column) -> Column:
    low = F.lower(message)
    return low.contains("context length") | low.contains("context window") | low.contains("too long") | low.contains("exceeds the context")


def response_status(content: Column, finish_reason: Column) -> Column:
    reason = F.coalesce(F.lower(strip(finish_reason)), F.lit(""))
    return (
        F.when(reason.isin(*CUT_SHORT), "truncated")
        .when(reason == "", "missing_reason")
        .when(reason != "stop", "abnormal")
        .when(strip(F.coalesce(content, F.lit(""))) == "", "empty")
        .otherwise("ok")
    )


def visual_char_budget(max_chars: Column, base_chars: Column) -> Column:
    own = F.greatest(F.lit(VISUAL_LEAST), F.ceil(max_chars * F.lit(VISUAL_RATIO)))
    return F.least(F.lit(VISUAL_MOST), F.greatest(own, F.greatest(F.lit(0), max_chars - base_chars))).cast("bigint")


def summary_chunk_chars(max_chars: Column, configured: Column, is_local: Column, context: Column) -> Column:
    return (
        F.when(F.coalesce(configured, F.lit(0)) != 0, F.least(max_chars, configured))
        .when(is_local & (F.coalesce(context, F.lit(0)) != 0), F.least(max_chars, F.greatest(F.lit(1200), context - 1800)))
        .otherwise(max_chars)
        .cast("bigint")
    )


def retry_tokens(max_tokens: Column) -> Column:
    return F.coalesce(max_tokens * 2, F.lit(RETRY_TOKENS)).cast("bigint")


def asr_prompt(terms: Column) -> Column:
    return F.when(F.size(terms) > 0, F.concat(F.lit(ASR_LEAD), F.array_join(terms, "、")))


def unfenced(text: Column) -> Column:
    """A model's answer without the fence of a code block."""
    value = strip(text)
    return F.when(value.startswith("```"), F.regexp_replace(F.regexp_replace(value, rf"(?iU)^```(?:json)?{SPACE}*", ""), rf"(?U){SPACE}*```\z", "")).otherwise(value)


def json_in(bare: Column) -> Column:
    """The JSON object that a text is or holds, as a variant; null if there is none."""
    first, last = F.instr(bare, "{"), F.length(bare) - F.instr(F.reverse(bare), "}") + 1
    inner = F.when((first > 0) & bare.contains("}") & (last > first), F.substr(bare, first, last - first + 1))
    found = F.coalesce(F.try_parse_json(bare), F.try_parse_json(inner))
    return F.when(F.schema_of_variant(found).startswith("OBJECT"), found)


def model_json(text: Column) -> Column:
    """The JSON object in a model's answer: fenced, bare or with prose around it."""
    return json_in(unfenced(text))


def text_field(value: Column, path: str) -> Column:
    """A text, or the non-blank items of a list joined by ``；``, or nothing."""
    part = F.try_variant_get(value, path, "variant")
    kind = F.coalesce(F.schema_of_variant(part), F.lit("VOID"))
    items = F.filter(F.transform(F.try_variant_get(value, path, "array<string>"), strip), lambda x: x != "")
    return F.when(kind == "STRING", strip(F.try_variant_get(value, path, "string"))).when(kind.startswith("ARRAY"), F.coalesce(F.array_join(items, "；"), F.lit(""))).otherwise("")


def stable_signature(**values: Column) -> Column:
    """SHA-256 of the compact JSON object with sorted keys; nulls stay."""
    return F.sha2(F.to_json(F.struct(*[values[k].alias(k) for k in sorted(values)]), {"ignoreNullFields": "false"}), 256)


def render(template: str, **values: Column) -> Column:
    """A template with the nine variables of a prompt put in once; an unknown one is an error at once.

    Doubled braces stand for single ones. Values are never read as templates.
    """
    parts: list[Column] = []
    for literal, name, spec, conversion in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            if name not in VARIABLES or spec or conversion:
                raise ValueError(f"prompt template holds an unknown variable: {name}")
            parts.append(F.coalesce(values.get(name, F.lit("")).cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")
