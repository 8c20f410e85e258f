"""Exact top-k search by inner product, exhaustive and term at a time.

The query set is cut into chunks of a stated number of rows and bytes; a chunk is the only thing that is broadcast, and it
is gone from the driver before the next one comes. For a chunk, each task walks over its candidates in blocks: a block is turned into postings per component, each posting list is
scattered, weighted by the queries' components, into a dense array of scores, and a partial selection keeps the best k
of each query. The tasks' selections are merged by rank.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cuecorpus.llm.workspace import shared_dir, staged

#: Queries broadcast at once, and bytes of their components.
CHUNK, CHUNK_BYTES = 20_000, 64_000_000
#: Queries and candidates that meet in one array of scores.
QUERY_BLOCK, ROW_BLOCK = 64, 4096
LOWEST = np.iinfo(np.int64).min


def quantised(vector: Column, scale: float = 1024.0) -> Column:
    """``floor(scale * x)`` of each component as a double, or null where a component is null or not finite."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    return F.when(vector.isNotNull() & usable, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a dense array; shorter rows are filled with zeros, longer ones cut to ``width``."""
    lengths = np.asarray(lists.value_lengths(), dtype=np.int64)
    flat = np.asarray(lists.flatten(), dtype=np.int64)
    out = np.zeros((len(lists), width), np.int64)
    rows = np.repeat(np.arange(len(lists)), lengths)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    ok = at < width
    out[rows[ok], at[ok]] = flat[ok]
    return out


def _fitting(queries: np.ndarray, block: np.ndarray) -> type:
    """The narrowest integers that hold all sums of products of these components."""
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(block).max(initial=0)) * queries.shape[1]
    return np.int32 if most < 2**31 else np.int64


def _scores(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Term at a time: for each component, its posting list scattered into the scores of the queries that have it."""
    kind = _fitting(queries, block)
    terms, postings = np.ascontiguousarray(queries.T, kind), np.ascontiguousarray(block.T, kind)
    acc, product = np.zeros((len(queries), len(block)), kind), np.empty((len(queries), len(block)), kind)
    for weights, values in zip(terms, postings, strict=True):
        who, posting = np.flatnonzero(weights), np.flatnonzero(values)
        if len(who) == len(queries) and len(posting) == len(block):
            acc += np.multiply.outer(weights, values, out=product)
        elif len(who) and len(posting):
            acc[np.ix_(who, posting)] += weights[who, None] * values[posting]
    return acc.astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest of each row, ties to the smaller id; ``ids`` has the shape of ``scores``."""
    order = np.lexsort((ids, ~scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _select(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest of each row, ties to the smaller id; ``ids``, one for each column, ascend.

    Score and place are packed in one number, so that one partial selection settles ties too. Where the scores are too
    large to be packed, all columns are sorted.
    """
    n = scores.shape[1]
    if n <= k or int(np.abs(scores, where=scores != LOWEST, out=np.zeros_like(scores)).max(initial=0)) >= 2**61 // n:
        return _best(scores, np.broadcast_to(ids, scores.shape), k)
    packed = np.where(scores == LOWEST, LOWEST, scores * n + np.arange(n - 1, -1, -1))
    at = np.argpartition(packed, n - k, axis=1)[:, n - k :]
    return _best(np.take_along_axis(scores, at, 1), ids[at], k)


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0, chunk: int = CHUNK, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Each query's k best candidates: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``.

    Candidates are all rows whose id is not the query's own. Vectors that are null, hold a null or a component that is
    not finite, or have no id take no part. Of several query rows with one id, the one with the smallest vector asks.
    Repeated candidate rows count once each. Vectors of unlike lengths are compared on the components both have. Fewer
    than k candidates give fewer rows, no query gives none.

    The work is queries times rows, as the exhaustive search asks. Each chunk of at most ``chunk`` queries and
    ``chunk_bytes`` bytes is one more scan of the vectors; its best rows are written to the shared folder and its broadcast
    is destroyed before the next chunk is read.
    """
    spark = vectors.sparkSession
    usable = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("q"), is_query.alias("is_query")).where("q IS NOT NULL AND vec_id IS NOT NULL")
    asked = staged(usable.where("is_query").groupBy("vec_id").agg(F.min("q").alias("q")), "topk-queries")
    n, width = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    # A chunk's rows are those of one hash class; one that comes out larger is cut again below.
    most = max(1, min(chunk, chunk_bytes // (8 * max(width, 1))))
    chunks = max(1, -(-n // most))
    parts = staged(asked.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int")), "topk-chunks", by="chunk")
    schema = "query_id long, vec_id long, score long"
    path = f"{shared_dir(spark)}/topk-best-{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(path)
    for c in range(chunks if n else 0):
        rows = parts.where(F.col("chunk") == c).select("vec_id", "q").toArrow()
        for at in range(0, rows.num_rows, most):
            own = rows.slice(at, most)
            lists = own["q"].combine_chunks()
            lists = lists if isinstance(lists, pa.Array) else lists.chunk(0)
            longest = int(np.max(np.asarray(lists.value_lengths()), initial=0))
            sent = spark.sparkContext.broadcast((np.asarray(own["vec_id"], dtype=np.int64), _matrix(lists, longest)))
            _search(usable, sent, k, schema).write.mode("append").parquet(path)
            sent.destroy()
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return spark.read.schema(schema).parquet(path).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(usable: DataFrame, sent, k: int, schema: str) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries = sent.value
        s, i = np.full((len(names), k), LOWEST), np.full((len(names), k), np.iinfo(np.int64).max)
        for batch in batches:
            for at in range(0, batch.num_rows, ROW_BLOCK):
                ids = np.asarray(batch.column(0).slice(at, ROW_BLOCK), dtype=np.int64)
                up = np.argsort(ids, kind="stable")
                ids, block = ids[up], _matrix(batch.column(1).slice(at, ROW_BLOCK), queries.shape[1])[up]
                for q in range(0, len(names), QUERY_BLOCK):
                    own, rows = slice(q, q + QUERY_BLOCK), names[q : q + QUERY_BLOCK]
                    scores = _scores(queries[own], block)
                    scores[rows[:, None] == ids[None, :]] = LOWEST
                    a, b = _select(scores, ids, k)
                    s[own], i[own] = (x[:, :k] for x in _best(np.hstack((s[own], a)), np.hstack((i[own], b)), k))
        r, c = np.nonzero(s > LOWEST)
        yield pa.RecordBatch.from_arrays([pa.array(names[r]), pa.array(i[r, c]), pa.array(s[r, c])], names=["query_id", "vec_id", "score"])

    return usable.select("vec_id", "q").mapInArrow(search, schema)
