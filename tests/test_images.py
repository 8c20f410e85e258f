"""The image filter against the same filter in plain integers, pixel by pixel; chunkers on very long texts."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuecorpus.functions import text as t
from cuecorpus.operators import chunking, folds, keyframes


def cubic(x):
    x = abs(x)
    if x < 1:
        return 1.5 * x**3 - 2.5 * x**2 + 1
    return -0.5 * (x**3 - 5 * x**2 + 8 * x - 4) if x < 2 else 0.0


def shrunk(values, wanted):
    """One row of pixels as ``wanted`` ones: weights of 22 bits, sums rounded and clipped."""
    scale = len(values) / wanted
    wide = max(1.0, scale)
    out = []
    for i in range(wanted):
        centre = (i + 0.5) * scale
        first, end = max(0, int(centre - 2 * wide + 0.5)), min(len(values), int(centre + 2 * wide + 0.5))
        weights = [cubic((k + 0.5 - centre) / wide) for k in range(first, end)]
        whole = [int(w / sum(weights) * 2**22 + (0.5 if w >= 0 else -0.5)) for w in weights]
        out.append(max(0, min(255, (sum(w * v for w, v in zip(whole, values[first:end], strict=True)) + 2**21) >> 22)))
    return out


def model_hash(image):
    gray = [[(19595 * int(r) + 38470 * int(g) + 7471 * int(b) + 2**15) >> 16 for b, g, r in row] for row in image]
    h, w = len(gray), len(gray[0])
    y, x = max(1, int(h * 0.06)), max(1, int(w * 0.06))
    rows = [shrunk(row[x : w - x], 9) for row in gray[y : h - y]]
    columns = [shrunk([row[c] for row in rows], 8) for c in range(9)]
    bits = "".join(str(int(columns[c][r] > columns[c + 1][r])) for r in range(8) for c in range(8))
    return int(bits, 2) - (2**64 if bits[0] == "1" else 0)


def test_hashes_of_images(spark):
    rng = np.random.default_rng(4)
    images = []
    for k in range(20):
        h, w = (int(x) for x in rng.integers(4, 120, 2))
        smooth = np.add.outer(np.arange(h) * rng.integers(0, 9), np.arange(w) * rng.integers(0, 9))[..., None] + rng.integers(0, 60, (h, w, 3))
        images.append((k, (smooth % 256).astype(np.uint8)))
    images += [(20, np.full((1, 1, 3), 200, np.uint8)), (21, np.full((2, 300, 3), 7, np.uint8))]
    rows = [(k, ("", int(x.shape[0]), int(x.shape[1]), 3, 16, bytearray(x.tobytes()))) for k, x in images]
    df = spark.createDataFrame(rows, "k int, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    got = {r["k"]: r["h"] for r in keyframes.image_luma(df).select("k", t.difference_hash(F.col("luma")).alias("h")).collect()}
    assert {k: got[k] for k in range(20)} == {k: model_hash(x) for k, x in images[:20]}
    assert len(set(got.values())) > 15 and got[20] == got[21] == 0
    gray = rng.integers(0, 256, (50, 70, 1)).astype(np.uint8)
    assert folds.shrink_gray(gray) == folds.shrink_gray(gray[..., 0])


@pytest.mark.parametrize("split", [chunking.split_text, chunking.split_text_balanced])
def test_chunks_of_a_very_long_text(spark, split):
    rng = random.Random(3)
    text = "\n".join("wort " * rng.randint(1, 40) for _ in range(30_000))
    df = spark.createDataFrame([(1, text)], "video_id long, text string")
    start = time.time()
    parts = [r["text"] for r in split(df, 1000).orderBy("chunk_index").collect()]
    assert time.time() - start < 15 and len(text) > 2_900_000
    assert "".join(parts).replace("\n", "") == text.replace("\n", "") and len(parts) > 2900
