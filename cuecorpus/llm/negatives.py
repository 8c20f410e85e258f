"""Hard negatives by a secondary-sort shuffle.

Pair scores become keys (anchor, descending score, id). They are dealt by anchor and sorted inside their partitions, and an
iterator reads them in that order: a row of the anchor's label opens a window of scores below its own, a row of another label
is emitted for the window that it was sent for until that one is full. The iterator's state is the windows of one anchor, at
most as many as it has positives; no anchor's rows are gathered.

What is shuffled is cut to what can be in an answer, without loss: a first pass over the rows finds each anchor's positives, so
a task knows every window and sends its best rows of each window only, besides its best rows of the anchor's own label.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cuecorpus.llm.topk import _matrix, quantised
from cuecorpus.llm.workspace import shared_dir, staged

#: Anchors broadcast at once, and bytes of their components.
CHUNK, CHUNK_BYTES = 10_000, 64_000_000
#: Anchors and rows that meet in one array of scores.
ANCHOR_BLOCK, ROW_BLOCK = 128, 4096
LOWEST, NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Scores below this are exact as doubles, and still have room for a place in a block.
EXACT = 2**50
#: ``below`` is the negated score; ``window`` is 0 for a row of the anchor's label, else the place of the positive whose window
#: the row is sent for, so that a window is open before its rows come.
KEY = "anchor_id long, below long, window long, vec_id long"


class _Anchors:
    """What tasks know of a chunk of anchors."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        self.ids, self.labels, self.rows = ids, labels, rows
        self.floats, self.most = rows.astype(np.float64), int(np.abs(rows).max(initial=0))
        self.low = self.high = np.zeros((len(ids), 0), np.int64)


def _scores(anchors: _Anchors, at: slice, block: np.ndarray) -> tuple[np.ndarray, bool]:
    """Integer inner products, and whether they are small enough to be packed with a place in the block."""
    small = block.shape[1] * anchors.most * int(np.abs(block).max(initial=0)) < EXACT
    if small:
        return (anchors.floats[at] @ block.T.astype(np.float64)).astype(np.int64), True
    return anchors.rows[at] @ block.T, False


def _select(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int, small: bool) -> tuple[np.ndarray, np.ndarray]:
    """The k best allowed columns of each row, ties to the smaller id, in any order; ``ids`` ascend."""
    n, width = scores.shape
    if width <= k:
        at = np.broadcast_to(np.arange(width), (n, width))
    elif small:
        key = np.where(allowed, scores * ROW_BLOCK + (ROW_BLOCK - 1 - np.arange(width)), LOWEST)
        at = np.argpartition(key, width - k, axis=1)[:, width - k :]
    else:
        at = np.lexsort((np.broadcast_to(ids, scores.shape), ~scores, ~allowed), axis=1)[:, :k]
    ok = np.take_along_axis(allowed, at, 1)
    return np.where(ok, np.take_along_axis(scores, at, 1), LOWEST), np.where(ok, ids[at], NO_ID)


class _Best:
    """The k best rows of each of n lists so far."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, np.full((n, k), LOWEST), np.full((n, k), NO_ID)

    def merge(self, at: slice, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.hstack((self.scores[at], scores)), np.hstack((self.ids[at], ids))
        order = np.lexsort((i, ~s), axis=1)[:, : self.k]
        self.scores[at], self.ids[at] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r, c = np.nonzero(self.scores > LOWEST)
        return r, self.scores[r, c], self.ids[r, c]


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and vectors of at most ROW_BLOCK rows, by ascending id."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROW_BLOCK):
            part = batch.slice(at, ROW_BLOCK)
            ids = np.asarray(part.column(0), dtype=np.int64)
            order = np.argsort(ids, kind="stable")
            yield ids[order], np.asarray(part.column(1), dtype=np.int64)[order], _matrix(part.column(2), width)[order]


def _positives(usable: DataFrame, sent, k: int) -> DataFrame:
    """Each task's k best rows of each anchor's label."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = sent.value
        best = _Best(len(anchors.ids), k)
        for ids, labels, block in _blocks(batches, anchors.rows.shape[1]):
            for a in range(0, len(anchors.ids), ANCHOR_BLOCK):
                own = slice(a, a + ANCHOR_BLOCK)
                scores, small = _scores(anchors, own, block)
                allowed = (anchors.labels[own, None] == labels) & (anchors.ids[own, None] != ids)
                best.merge(own, *_select(scores, allowed, ids, k, small))
        r, s, i = best.found()
        yield pa.RecordBatch.from_arrays([pa.array(anchors.ids[r]), pa.array(s), pa.array(i)], names=["anchor_id", "score", "vec_id"])

    return usable.select("vec_id", "label", "q").mapInArrow(search, "anchor_id long, score long, vec_id long")


def _keys(usable: DataFrame, sent, positives: int, negatives: int) -> DataFrame:
    """The keys that each task sends: its best rows of the anchor's label, and its best rows of each window."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = sent.value
        same = _Best(len(anchors.ids), positives)
        windows = [_Best(len(anchors.ids), negatives) for _ in range(anchors.low.shape[1])]
        for ids, labels, block in _blocks(batches, anchors.rows.shape[1]):
            for a in range(0, len(anchors.ids), ANCHOR_BLOCK):
                own = slice(a, a + ANCHOR_BLOCK)
                scores, small = _scores(anchors, own, block)
                alike = anchors.labels[own, None] == labels
                same.merge(own, *_select(scores, alike & (anchors.ids[own, None] != ids), ids, positives, small))
                for w, best in enumerate(windows):
                    inside = ~alike & (scores >= anchors.low[own, w, None]) & (scores <= anchors.high[own, w, None])
                    if inside.any():
                        best.merge(own, *_select(scores, inside, ids, negatives, small))
        r, s, i = same.found()
        found = [(0, *same.found()), *((w + 1, *best.found()) for w, best in enumerate(windows))]
        rows = np.vstack([np.column_stack((anchors.ids[r], -s, np.full_like(s, w), i)) for w, r, s, i in found])
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, c]) for c in range(4)], names=["anchor_id", "below", "window", "vec_id"])

    return usable.select("vec_id", "label", "q").mapInArrow(search, KEY)


def _bounds(scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest score that each positive's window admits; LOWEST scores stand for no positive."""
    lo, hi = np.ones(scores.shape, np.int64), np.zeros(scores.shape, np.int64)
    for at in np.argwhere(scores > LOWEST):
        p = int(scores[tuple(at)])
        lo[tuple(at)], hi[tuple(at)] = -((-low * p) // 100), (high * p) // 100
    return lo, hi


def _stream(positives: int, negatives: int, low: int, high: int):
    """The iterator over sorted keys: open windows of the present anchor are all it holds."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        anchor, windows = None, []
        for batch in batches:
            out: list[tuple] = []
            for a, below, window, i in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if a != anchor:
                    anchor, windows = a, []
                score = -below
                if not window:
                    if len(windows) < positives:
                        windows.append([i, score, 0])
                    continue
                w = windows[window - 1]
                if w[2] < negatives and low * w[1] <= 100 * score <= high * w[1]:
                    w[2] += 1
                    out.append((a, w[0], w[2], i, w[1], score))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kinds[c]) for c in range(6)], names=names)

    return read


def mine_hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 256.0,
    chunk: int = CHUNK,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Negatives of each anchor and positive: ``anchor_id``, ``positive_id``, ``rank`` from 1, ``negative_id``, ``positive_score``,
    ``negative_score``.

    A score is the inner product of the components, each ``floor(scale * x)``. An anchor's positives are its ``positives`` best
    other rows of its label; a positive's negatives are the ``negatives`` best rows of other labels whose score lies between
    ``low`` and ``high`` percent of the positive's. Higher scores come first, ties by smaller id. A positive of a negative score
    admits nothing, one of score 0 admits scores of 0.

    Rows with a null id, label or vector, or a component that is null or not finite, take no part. Of several rows with an
    anchor's id the least by (label, vector) is the anchor, and none of them is its positive; elsewhere repeated rows count once
    each. Vectors of unlike lengths are compared on the components both have. Fewer rows than asked for give fewer, an
    empty table gives none. Extra columns are ignored.

    The work is anchors times rows. Each chunk of at most ``chunk`` anchors and ``chunk_bytes`` bytes is broadcast and costs two
    scans; what it sends is written to the shared folder before the next one is read.
    """
    spark = vectors.sparkSession
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), quantised(F.col(vector_col), scale).alias("q"), is_anchor.alias("is_anchor"))
    usable = named.where("vec_id IS NOT NULL AND label IS NOT NULL AND q IS NOT NULL")
    asked = staged(usable.where("is_anchor").groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("own")).select("vec_id", "own.*"), "negatives-anchors")
    n, width = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    most = max(1, min(chunk, chunk_bytes // (16 * max(width, 1))))
    chunks = max(1, -(-n // most))
    parts = staged(asked.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int")), "negatives-chunks", by="chunk")
    path = f"{shared_dir(spark)}/negatives-keys-{uuid.uuid4().hex}"
    spark.createDataFrame([], KEY).write.parquet(path)
    first = W.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    for c in range(chunks if n else 0):
        rows = parts.where(F.col("chunk") == c).select("vec_id", "label", "q").toArrow().combine_chunks()
        for at in range(0, rows.num_rows, most):
            part = rows.slice(at, most).combine_chunks().to_batches()[0]
            own = _Anchors(np.asarray(part.column(0), dtype=np.int64), np.asarray(part.column(1), dtype=np.int64), _matrix(part.column(2), int(np.max(np.asarray(part.column(2).value_lengths()), initial=0))))
            sent = spark.sparkContext.broadcast(own)
            best = _positives(usable, sent, positives).withColumn("n", F.row_number().over(first)).where(F.col("n") <= positives)
            # At most ``positives`` rows an anchor of the chunk.
            known = best.select("anchor_id", "score", "n").toArrow()
            sent.destroy()
            scores = np.full((len(own.ids), positives), LOWEST)
            place = {a: k for k, a in enumerate(own.ids.tolist())}
            for a, s, k in zip(*(known.column(x).to_pylist() for x in ("anchor_id", "score", "n")), strict=True):
                scores[place[a], k - 1] = s
            own.low, own.high = _bounds(scores, low, high)
            sent = spark.sparkContext.broadcast(own)
            _keys(usable, sent, positives, negatives).write.mode("append").parquet(path)
            sent.destroy()
    keys = spark.read.schema(KEY).parquet(path).repartition("anchor_id").sortWithinPartitions("anchor_id", "below", "window", "vec_id")
    return keys.mapInArrow(_stream(positives, negatives, low, high), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
