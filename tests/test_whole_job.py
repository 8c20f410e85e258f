"""Queries that read all rows, and whole texts."""

import re

import duckdb

from cuecorpus.operators.chunking import TERM_PATTERNS
from cuecorpus.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute_terms(title, uploader, description, tags, categories):
    got = []
    for x in (title, uploader, description):
        for p in TERM_PATTERNS:
            got += [m.group(0) for m in re.finditer(p.removeprefix("(?U)"), x or "")]
    got += [x for x in (tags[:12] + categories[:8]) if len(x) <= 30]
    kept, keys, size = [], [], 0
    for x in got:
        x = re.sub(r"\s+", " ", re.sub(r"https?://\S+", " ", x)).strip(" ,，。.!！?？:：;；()（）[]【】<>《》\"'\n")
        key = x.casefold()
        if 2 <= len(x) <= 60 and not any(key in k for k in keys) and size + len(x) <= 800:
            kept.append(x)
            keys.append(key)
            size += len(x) + 2
    return "|".join(kept)


def test_context_terms_of_all_videos(spark):
    from cuecorpus.plans import fixtures as v

    got = {r["video_id"]: r["terms"] for r in QUERIES["context_terms"](spark, SF).collect()}
    rows = v.v_videos(spark, SF).collect()
    assert len(got) == len(rows)
    wide = [r for r in rows if not (r["title"] + (r["uploader"] or "") + r["description"]).isascii()]
    assert wide
    for r in rows:
        assert got[r["video_id"]] == brute_terms(r["title"], r["uploader"], r["description"], r["tags"], r["categories"])


def test_asr_cues_of_all_conversations(spark):
    want = duckdb.sql(f"SELECT count(DISTINCT conv_id) FROM '{SF}/conversations.parquet' WHERE turn % 6 <> 5").fetchall()[0][0]
    assert QUERIES["asr_cues"](spark, SF).select("video_id").distinct().count() == want


def test_prompts_hold_whole_texts(spark):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    got = {r["video_id"]: r["prompt"] for r in QUERIES["render_prompt"](spark, SF).collect()}
    assert max(map(len, texts.values())) > 400 and all(texts[i] in got[i] for i in texts)
