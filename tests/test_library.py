"""Golden cases of the library's operators, row models of its folds, and what must hold whatever the input."""

import difflib
import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cuecorpus.functions import text as t
from cuecorpus.operators import chunking, keyframes, resume, subtitles, timeline, visual
from cuecorpus.plans import jobs
from cuecorpus.sources import files

FRAMES = "video_id long, path string, timestamp double, source string, hash_value long"
VISUAL = "video_id long, timestamp_seconds double, timestamp string, image string, frame_source string, description string, visible_text string, importance string, uncertainty string"


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def cells(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(f(F.col("v"))).collect()]


def frames(spark, rows):
    return spark.createDataFrame([(1, f"p{i:03d}", float(a), s, h) for i, (a, s, h) in enumerate(rows)], FRAMES)


def shown(spark, rows):
    return spark.createDataFrame([(1, float(s), f"00:00:{int(s):02d}", f"f{i:03d}.jpg", "periodic", d, v, imp, "") for i, (s, d, v, imp) in enumerate(rows)], VISUAL)


def said(spark, text):
    return spark.createDataFrame([(1, "x", text)], "video_id long, source string, text string")


def test_text_functions(spark):
    assert cells(spark, ['a/b:*c"', "  x　y ", "", "n" * 90], t.safe_name) == ["a_b_c_", "x y", "video", "n" * 80]
    assert cells(spark, ["00:01:02,500", "75:10", "1:2:3", "x", None], t.parse_subtitle_timestamp) == ["00:01:02", "00:75:10", None, None, None]
    assert cells(spark, [3661.9, -5.0, 360000.0], t.format_timestamp, "double") == ["01:01:01", "00:00:00", "100:00:00"]
    assert cells(spark, [r"{\an8}<i>a </i>  b"], t.clean_cue_text) == ["a b"]
    assert cells(spark, ["a\r\nb\x0bc\n", ""], lambda c: F.array_join(t.split_lines(c), "|")) == ["a|b|c", ""]
    assert cells(spark, ["whisper+vision_partials", "nope"], t.quality_note) == [t.NOTES["whisper"] + t.NOTE_VISION, t.NOTE_OTHER]
    assert cells(spark, ["$ npx skills add x", "git", "see https://a.b/c", "；pip install y"], t.has_command_evidence) == [True, False, True, True]
    assert one(spark, t.summary_chunk_chars(F.lit(12000), F.lit(None).cast("int"), F.lit(True), F.lit(8192))) == 6392
    assert one(spark, t.stable_signature(b=F.lit(None).cast("string"), a=F.lit("é"))) == one(spark, F.sha2(F.lit('{"a":"é","b":null}'), 256))
    assert one(spark, t.decode_text(F.lit(b"\xef\xbb\xbfa\xffb"), bom=True)) == "ab"


def test_responses_and_json(spark):
    rows = [("部分", "length"), ("完整", "stop"), (" ", "stop"), ("x", None), ("x", "content_filter"), ("x", " STOP ")]
    got = spark.createDataFrame(rows, "c string, r string").select(t.response_status(F.col("c"), F.col("r"))).collect()
    assert [r[0] for r in got] == ["truncated", "ok", "empty", "missing_reason", "abnormal", "ok"]
    read = lambda c: t.text_field(t.model_json(c), "$.v")
    assert cells(spark, ['```json\n{"v": ["开始", " ", "设置"]}\n```', 'ok {"v": " a "} end', '{"v": "[x]"}'], read) == ["开始；设置", "a", "[x]"]


def test_render(spark):
    with pytest.raises(ValueError):
        t.render("{nope}", title=F.lit("x"))
    assert one(spark, t.render("{{{title}}} {uploader}{transcript}", title=F.lit("{x}"), transcript=F.lit("{title}"), uploader=F.lit(None).cast("string"))) == "{{x}} {title}"


def test_subtitle_choice(spark):
    videos = spark.createDataFrame([(1, ["zh"], ["ai-zh"])], "video_id long, subtitle_langs array<string>, automatic_caption_langs array<string>")
    names = spark.createDataFrame([(1, "s-123.zh.srt"), (1, "s-123.ai-zh.srt")], "video_id long, file_name string")
    chosen = subtitles.select_subtitle(names, "zh,ai-zh", videos)
    assert chosen.first()["file_name"] == "s-123.zh.srt"
    r = {x["file_name"]: x for x in subtitles.subtitle_source(names, videos).collect()}
    assert r["s-123.zh.srt"]["source"] == "manual_subtitle" and r["s-123.zh.srt"]["warning"] is None
    assert r["s-123.ai-zh.srt"]["source"] == "auto_subtitle" and r["s-123.ai-zh.srt"]["automatic_caption_langs"] == ["ai-zh"]
    assert subtitles.select_subtitle(names, "[,all", videos).count() == 1


def test_parsers(spark):
    srt = "1\r\n00:00:01,000 --> 00:00:02,000\r\n<b>Hi</b>\r\nthere\r\n\r\n2\r\n00:00:01,000 --> 00:00:02,000\r\nHi there\r\n\r\n3\nno time\n\n00:00:05.0 --> x\nend"
    f = spark.createDataFrame([(1, srt), (2, ""), (3, None)], "video_id long, content string")
    assert [(r["video_id"], r["ts"], r["text"]) for r in subtitles.parse_srt(f).collect()] == [(1, "00:00:01", "Hi there"), (1, "00:00:05", "end")]
    vtt = spark.createDataFrame([(1, "WEBVTT\n\n00:01.000 --> 00:02.000 line:9%\nA")], "video_id long, content string")
    assert [(r["ts"], r["text"]) for r in subtitles.parse_vtt(vtt).collect()] == [("00:00:01", "A")]
    j = {"events": [{"tStartMs": 1000, "segs": [{"utf8": "a"}, {"utf8": " b"}]}, {"tStartMs": 1.5, "segs": [{"utf8": "c"}]}, {"tStartMs": 9}]}
    got = subtitles.parse_json3(spark.createDataFrame([(1, json.dumps(j))], "video_id long, content string")).collect()
    assert [(r["ts"], r["text"]) for r in got] == [("00:00:01", "a b"), (None, "c")]


@pytest.mark.parametrize("duration,want", [(60.0, (5.0, 15.0, 8)), (510.0, (7.083, 30.0, 18)), (3600.0, (15.0, 45.0, 60)), (None, (5.0, 45.0, 16)), (0.0, (5.0, 45.0, 16))])
def test_sampling_plan(spark, duration, want):
    r = keyframes.sampling_plan(spark.createDataFrame([(1, duration)], "video_id long, duration double"), 5, 45, 60).first()
    assert (r["scan_interval"], r["max_frames"]) == (want[0], want[2])
    assert r["max_gap"] == pytest.approx(want[1], abs=0.01)


def test_frame_selection(spark):
    f = frames(spark, [(0, "periodic", 0), (5, "periodic", 0), (10, "periodic", -1), (12, "scene", -1), (35, "periodic", -1)])
    kept = keyframes.drop_similar_frames(keyframes.merge_near_frames(f), 20)
    assert sorted(r["timestamp"] for r in keyframes.cap_frames(kept, 60).collect()) == [0, 10, 12, 35]
    many = keyframes.cap_frames(frames(spark, [(5 * i, "periodic", i) for i in range(20)]), 6).collect()
    times = sorted(r["timestamp"] for r in many)
    assert len(times) == 6 and times[0] == 0 and times[-1] == 95
    anchor = frames(spark, [(0, "periodic", 0), (0.9, "scene", 0), (1.8, "periodic", 0), (2.0, "periodic", 0)])
    assert [r["timestamp"] for r in keyframes.merge_near_frames(anchor).orderBy("timestamp").collect()] == [0.9, 2.0]


def test_even_sample_rounds_half_to_even(spark):
    df = spark.range(11).withColumn("g", F.lit(1))
    for count in range(0, 13):
        want = [] if count <= 0 else list(range(11)) if count >= 11 else [5] if count == 1 else sorted({round(i * 10 / (count - 1)) for i in range(count)})
        assert sorted(r["id"] for r in keyframes.even_sample(df, count, ["g"], ["id"]).collect()) == want


def test_speech_around_frames(spark):
    cues = spark.createDataFrame([(1, 0, "00:00:05", 5.0, "前"), (1, 1, "00:00:20", 20.0, "当前内容"), (1, 2, "00:01:00", 60.0, "后"), (1, 3, None, None, "untimed")], "video_id long, seq long, ts string, seconds double, text string")
    f = frames(spark, [(18, "periodic", 0), (40, "periodic", 0), (300, "periodic", 0)])
    near = visual.nearby_context(f, cues, window=5)
    assert [r["context"] for r in near.collect()] == ["当前内容"]
    got = {r["path"]: r["context"] for r in visual.frame_context(f, cues, window=5).collect()}
    assert got == {"p000": "当前内容", "p001": "当前内容", "p002": "后"}
    plan = near._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_cached_keyframes_need_all_files(spark):
    cache = spark.createDataFrame([(1, "s", "a"), (1, "s", "b"), (2, "s", "c")], "video_id long, signature string, path string")
    there = spark.createDataFrame([(1, "a"), (2, "c")], "video_id long, path string")
    want = spark.createDataFrame([(1, "s"), (2, "s")], "video_id long, signature string")
    assert [r["video_id"] for r in visual.valid_cached_keyframes(cache, there, want).collect()] == [2]


def test_compaction(spark):
    got = visual.compact_visual(shown(spark, [(5, "菜单", "开始", "medium"), (10, "菜单", "开始", "medium")]), said(spark, "")).collect()
    assert [(r["timestamp_seconds"], r["visible_text"]) for r in got] == [(5, "开始")]
    got = visual.compact_visual(shown(spark, [(5, "幻灯片", "标题\n第一行", "medium"), (10, "幻灯片", "标题\n第一行\n第二行", "medium")]), said(spark, "")).collect()
    assert [r["visible_text"] for r in got] == ["标题\n第一行", "第二行"]
    rows = [(i, f"画面{i}" * 9, f"固定页眉；开始执行；参数 {'ABCDE'[i]}{i}x", "medium") for i in range(4)]
    lines = [r["visible_text"] for r in visual.compact_visual(shown(spark, rows), said(spark, "[00:00:01] 现在开始执行任务")).collect()]
    assert lines == [f"参数 {'ABCDE'[i]}{i}x" for i in range(4)]


COMMAND = "$ npx skills add owner/repo --skill example"


def kept_events(texts, budget):
    """Places and texts of the events within a budget, one choice after the other."""
    total, n = sum(len(x) + 1 for x in texts), len(texts)
    if budget <= 0:
        return []
    if total <= budget:
        return list(enumerate(texts))
    want = max(1, min(n, n * budget // total))
    proof = [i for i, x in enumerate(texts) if "npx skills" in x]
    if want == 1:
        chosen = {n // 2}
    else:
        held = min(len(proof), max(1, want // 5))
        chosen = set(proof[len(proof) - held :])
        chosen |= {round(i * (n - 1) / max(want - held - 1, 1)) for i in range(want - held)}
        while len(chosen) < want:
            away = {i: min(abs(i - c) for c in chosen) for i in range(n) if i not in chosen}
            chosen.add(min(i for i in away if away[i] == max(away.values())))
    each = max(1, budget // len(chosen) - 1)
    tail = "……" if each > 2 else ""
    out = [(i, texts[i] if len(texts[i]) <= each else texts[i][: max(1, each - len(tail))].rstrip() + tail) for i in sorted(chosen)]
    return [x for k, x in enumerate(out) if sum(len(y) + 1 for _, y in out[: k + 1]) <= budget]


def test_event_budget(spark):
    rng = random.Random(5)
    cases = [(["x" * rng.randint(0, 60) + rng.choice(["", "", f" {COMMAND}"]) for _ in range(rng.randint(1, 70))], rng.randint(0, 1500)) for _ in range(150)]
    cases += [([f"{i} " + rng.choice(["y", COMMAND]) * 9 for i in range(40)], b) for b in range(30, 1200, 60)]
    cases.append((["画面" * 60 for _ in range(9)] + [COMMAND], 650))
    rows = [(k, float(i), f"{i:03d}", x) for k, (texts, _) in enumerate(cases) for i, x in enumerate(texts)]
    events = spark.createDataFrame(rows, "video_id long, seconds double, image string, text string")
    budgets = spark.createDataFrame([(k, b) for k, (_, b) in enumerate(cases)], "video_id long, budget long")
    got = {}
    for r in timeline.limit_visual_events(events, budgets).collect():
        got.setdefault(r["video_id"], []).append((int(r["seconds"]), r["text"]))
    for k, (texts, budget) in enumerate(cases):
        assert sorted(got.get(k, [])) == kept_events(texts, budget), (k, texts, budget)
    assert any(COMMAND in x for _, x in got[len(cases) - 1])


def test_timeline_keeps_all_cues(spark):
    cues = spark.createDataFrame([(1, i, f"00:00:{i:02d}", float(i), f"话语{i}") for i in range(30)], "video_id long, seq long, ts string, seconds double, text string")
    vis = shown(spark, [(i, f"描述{i}" * 20, f"文字{i}" * 20, "high") for i in range(20)])
    line = timeline.build_timeline(cues, vis, 500).collect()
    assert sum(r["priority"] == 0 for r in line) == 30 and 0 < sum(r["priority"] == 1 for r in line) < 20
    assert sum(len(r["text"]) + 1 for r in line if r["priority"]) <= 800
    text = timeline.render_timeline_text(timeline.build_timeline(cues, vis), cues).first()["text"]
    assert text.index("[00:00:05] 话语5") < text.index("[00:00:05] 画面") < text.index("[00:00:06] 话语6")


def packed(text, most):
    if len(text) <= most:
        return [text]
    parts = [line[k : k + most] for line in text.splitlines() for k in range(0, max(1, len(line)), most)]
    out = [[]]
    for x in parts:
        if out[-1] and sum(len(y) + 1 for y in out[-1]) + len(x) + 1 > most:
            out.append([])
        out[-1].append(x)
    return ["\n".join(x) for x in out]


def balanced(text, most):
    if len(text) <= most:
        return [text]
    out, rest = [], text
    for left in range(-(-len(text) // most), 1, -1):
        even = -(-len(rest) // left)
        breaks = [b for b, c in enumerate(rest) if c == "\n" and 1 <= b <= max(even, most)]
        near = [max((b for b in breaks if b <= even), default=None), min((b for b in breaks if b >= even), default=None)]
        ends = [b + 1 for b in near if b is not None]
        end = min(ends, key=lambda x: abs(x - even), default=even)
        out.append(rest[:end].rstrip("\n"))
        rest = rest[end:]
    return [*out, rest.lstrip("\n")]


def test_chunks(spark):
    rng = random.Random(2)
    long = ["\n".join(["x" * 180] * 50), "\n".join(["y" * 80] * 90)]
    cases = [(x, 5000) for x in long] + [("".join(rng.choice("ab\n字😀") for _ in range(rng.randint(0, 200))), rng.randint(1, 50)) for _ in range(300)]
    cases += [("a\r\nb\x0bc\u2028d\n" * 9, 7), ("\n" * 40, 3), ("", 1), (None, 5)]
    df = spark.createDataFrame([(k, x, n) for k, (x, n) in enumerate(cases)], "video_id long, text string, most int")
    for split, model in ((chunking.split_text, packed), (chunking.split_text_balanced, balanced)):
        got = {}
        for r in split(df, F.col("most")).orderBy("video_id", "chunk_index").collect():
            got.setdefault(r["video_id"], []).append(r["text"])
            assert r["n_chars"] == len(r["text"])
        for k, (x, n) in enumerate(cases):
            assert got.get(k) == (None if x is None else model(x, n)), (split, x, n)
    for k, apart in ((0, 500), (1, 300)):
        sizes = [len(x) for x in balanced(*cases[k])]
        assert len(sizes) == 2 and max(sizes) - min(sizes) < apart
    with pytest.raises(ValueError):
        chunking.split_text(said(spark, "x"), 0)


def test_full_case_folding(spark):
    values = ["ΟΔΟΣ ﬁ", "Straße ẞ", "ſK", "ꭰᏸ", "ᾳ İI ŉ", "plain ASCII", "", "Ǆ ﬗ"]
    assert cells(spark, values, t.casefold) == [x.casefold() for x in values]


def model_compact(rows):
    """Rows (description, new lines, importance) in order, one after the other."""
    out, last = [], ""
    for i, (key, lines, importance) in enumerate(rows):
        alike = bool(last and key) and difflib.SequenceMatcher(None, last, key).ratio() >= 0.88
        if lines or not (key == last or alike or importance == "low"):
            out.append(i)
            last = key
    return out


def test_compaction_against_a_row_model(spark):
    rng = random.Random(8)
    said_ = ["the quick brown fox jumps", "the quick brown fox jumped", "another scene", "", "another scene!"]
    rows = [(v, i, rng.choice(said_), f"only {v} {i}" if rng.random() < 0.2 else "", rng.choice(["low", "medium", "high"])) for v in range(30) for i in range(40)]
    frames_ = spark.createDataFrame([(v, float(i), "00:00:00", f"{i:04d}", "periodic", d, x, m, "") for v, i, d, x, m in rows], "video_id long, timestamp_seconds double, timestamp string, image string, frame_source string, description string, visible_text string, importance string, uncertainty string")
    none = spark.createDataFrame([], "video_id long, text string")
    got = {}
    for r in visual.compact_visual(frames_, none).collect():
        got.setdefault(r["video_id"], []).append(int(r["timestamp_seconds"]))
    for v in range(30):
        own = [(d, x, m) for w, _, d, x, m in rows if w == v]
        assert sorted(got.get(v, [])) == model_compact(own)


def test_texts_of_frames_are_cut(spark):
    got = visual.compact_visual(shown(spark, [(5, "d" * 200, "字" * 500, "high"), (9, "e" * 200, "", "high")]), said(spark, "")).orderBy("timestamp_seconds").collect()
    assert [(r["description"], r["visible_text"]) for r in got] == [("d" * 80 + "……", "字" * 240 + "……"), ("e" * 120 + "……", "")]


def test_hints(spark):
    logs = ["HTTP Error 412: x", "429", "insufficient_quota", "else"]
    code = lambda c: t.download_error(c, F.lit("https://b23.tv/x"))
    assert [len(x) for x in cells(spark, logs, lambda c: t.download_hints(code(c)))] == [3, 1, 1, 0]
    assert [len(x) for x in cells(spark, ["exceeded your current quota", "Rate limit", "?"], lambda c: t.model_hints(t.model_error(c)))] == [2, 1, 1]


def test_context_terms(spark):
    v = spark.createDataFrame([(1, "使用 LLaMA-3.1 and GPT Store", "Ann", "GPT store; see https://x.y GPT Store again", ["tag one", "x" * 31], ["cat"])], "video_id long, title string, uploader string, description string, tags array<string>, categories array<string>")
    terms = chunking.context_terms(v).first()["terms"]
    assert terms[0] == "LLaMA-3.1" and "tag one" in terms and "cat" in terms and len({x.lower() for x in terms}) == len(terms)


def test_plan_and_cache(spark):
    req = spark.createDataFrame([(v, s, f"{v}{s}", v != 4) for v in range(1, 6) for s in resume.STAGES], "video_id long, stage string, signature string, artifact boolean")
    cache = req.where("NOT (video_id = 2 AND stage = 'transcript') AND NOT (video_id = 3 AND stage = 'vision')").select("video_id", "stage", "signature", F.when(F.col("video_id") == 5, 0).otherwise(1).alias("schema_version"))
    modes = req.select("video_id").distinct().select("video_id", F.lit(True).alias("with_vision"), F.lit(True).alias("with_summary"))
    plan = {r["video_id"]: tuple(r[s] for s in resume.STAGES) for r in resume.plan_stages(req, cache, modes).collect()}
    assert plan == {1: (True,) * 4, 2: (False, True, True, False), 3: (True, True, False, False), 4: (False,) * 4, 5: (False,) * 4}
    assert not any(r["hit"] for r in resume.stage_hits(req, cache, resume=False).collect())
    misses, stale, merged = jobs.refresh(req, cache.withColumn("completed_at", F.lit(datetime(2024, 1, 1))), modes, F.lit(datetime(2025, 1, 1)))
    assert misses.where("video_id = 1").count() == 0 and merged.count() == req.count()
    assert {r["artifact"] for r in stale.where("video_id = 3").collect()} >= {"visual_context.json", "summary.md"}


class Model:
    """Answers with the length of what it is asked; truncates once, and knows only short contexts."""

    def __call__(self, prompt, tokens, system, temperature):
        assert system == jobs.SYSTEM and temperature == 0.2
        if len(prompt) > 4000:
            raise RuntimeError("context window is too long")
        if "cut" in prompt and tokens and tokens < 2000:
            return "half", "length"
        return f"<{len(prompt)}>", "stop"


def test_model_calls(spark):
    df = spark.createDataFrame([(1, "a"), (2, "cut"), (3, "x" * 5000)], "video_id long, prompt string")
    got = {r["video_id"]: (r["status"], r["attempts"]) for r in jobs.call_model(df, Model, 1000).collect()}
    assert got == {1: ("ok", 1), 2: ("ok", 2), 3: ("error", 1)}
    videos = spark.createDataFrame([(i, f"t{i}", "u", None, None) for i in (1, 2)], "video_id long, title string, webpage_url string, uploader string, duration double")
    texts = spark.createDataFrame([(1, "file", "short"), (2, "whisper+vision", "long line\n" * 900)], "video_id long, source string, text string")
    out = {r["video_id"]: r for r in jobs.summarize_corpus(texts, videos, Model, 6000, "{title}:{transcript}").collect()}
    assert out[1]["status"] == out[2]["status"] == "ok" and not out[1]["fallback_used"]
    assert out[2]["fallback_used"] and out[2]["chunk_chars"] == 3000 and sum(out[2]["chunk_lengths"]) <= 9000


class Eye:
    """A vision model that sees at most two frames at once, nothing on images named blind, and notes its calls."""

    def __call__(self, parts, tokens, system, temperature):
        images = [x for kind, x in parts if kind == "image"]
        with open(f"{images[0].rsplit('/', 1)[0]}/calls", "a") as f:
            f.write(f"{len(images)} {tokens}\n")
        if len(images) > 2 or any("blind" in x for x in images):
            raise RuntimeError("context length exceeded")
        return "```json\n" + json.dumps({"frames": [{"index": k, "description": f"结果 {k}", "visible_text": "", "importance": "medium", "uncertainty": ""} for k in range(1, len(images) + 1)]}) + "\n```"


def test_vision_halves_what_fails_and_remembers(spark, tmp_path):
    names = {1: [f"{i}.jpg" for i in range(6)], 2: ["0.jpg", "1.jpg", "2.jpg", "blind.jpg", "4.jpg"], 3: ["0.jpg"]}
    for v in names:
        (tmp_path / str(v)).mkdir()
    rows = [(v, f"{tmp_path}/{v}/{x}", 5.0 * i, "periodic") for v, xs in names.items() for i, x in enumerate(xs)]
    f = spark.createDataFrame(rows, "video_id long, path string, timestamp double, source string")
    none = spark.createDataFrame([], "video_id long, seq long, ts string, seconds double, text string")
    results, report = jobs.analyze_frames(f, none, spark.createDataFrame([(1, ["x"])], "video_id long, terms array<string>"), Eye, 4)
    assert {v: results.where(f"video_id = {v}").count() for v in names} == {1: 6, 2: 0, 3: 1}
    got = {r["video_id"]: (r["status"], r["fallback_splits"], r["effective_batch_size"]) for r in report.collect()}
    assert got == {1: ("completed", 1, 2), 2: ("failed", 2, 2), 3: ("completed", 0, 4)}
    assert [x.split()[0] for x in (tmp_path / "1" / "calls").read_text().splitlines()] == ["4", "4", "2", "2", "2"]
    again, _ = jobs.analyze_frames(f.where("video_id = 1"), none, spark.createDataFrame([], "video_id long, terms array<string>"), Eye, 2, existing=results.where("video_id = 1"))
    assert again.count() == 6 and len((tmp_path / "1" / "calls").read_text().splitlines()) == 5


def test_digests_end_to_end(spark):
    videos = spark.createDataFrame([(1, "t", "u", None, 60.0, ["en"], []), (2, "t2", "u", None, None, [], [])], "video_id long, title string, webpage_url string, uploader string, duration double, subtitle_langs array<string>, automatic_caption_langs array<string>")
    f = spark.createDataFrame([(1, "a.en.srt", ".srt", "1\n00:00:01,000 --> 00:00:02,000\nhello")], "video_id long, file_name string, ext string, content string")
    asr = spark.createDataFrame([(2, 0, 0.4, "spoken")], "video_id long, seq long, start double, text string")
    got = {r["video_id"]: (r["source"], r["status"]) for r in jobs.text_digest(videos, f, asr, Model, 1000, "{transcript}").collect()}
    assert got == {1: ("manual_subtitle", "ok"), 2: ("whisper", "ok")}
    vis = shown(spark, [(1, "d", "v", "high")])
    multi = jobs.multimodal_digest(said(spark, "[00:00:01] hello\n"), vis, videos, Model, 1000, "{source}|{transcript}").first()
    assert multi["source"] == "x+vision" and multi["status"] == "ok"


def test_files_round_trip(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "video_id long, text string")
    files.write_corpus(df, path, buckets=4)
    files.upsert_corpus(spark.createDataFrame([(3, "new"), (99, "more")], "video_id long, text string"), path, buckets=4)
    got = {r["video_id"]: r["text"] for r in spark.read.parquet(path).collect()}
    assert len(got) == 51 and got[3] == "new" and got[99] == "more" and got[4] == "t4"
    (tmp_path / "v1").mkdir()
    (tmp_path / "v1" / "a.en.SRT").write_bytes(b"\xef\xbb\xbf1\n00:00:01,0 --> x\nhi\xff")
    r = files.read_subtitle_files(spark, str(tmp_path / "v1")).first()
    assert (r["video_id"], r["ext"], r["content"]) == ("v1", ".srt", "1\n00:00:01,0 --> x\nhi")
    (tmp_path / "v1" / "transcript.txt").write_text("words")
    t1 = files.read_transcript_files(spark, str(tmp_path / "v1" / "transcript.txt")).first()
    assert (t1["title"], t1["source"], t1["text"]) == ("v1", "file", "words")


def test_partitioning_does_not_matter(spark):
    rng = random.Random(9)
    f = frames(spark, [(rng.randint(0, 300) / 3, rng.choice(["scene", "periodic", "periodic"]), rng.getrandbits(60)) for _ in range(150)])
    videos = spark.createDataFrame([(1, 200.0)], "video_id long, duration double")
    a, b = (sorted(map(tuple, keyframes.select_keyframes(f.repartition(n), videos).collect())) for n in (1, 7))
    assert a == b
