"""Best-fit packing of documents into bins of a fixed number of words, with conflicts.

Documents are dealt into packing shards at random, so copies and hot sources are spread evenly. In a shard,
pieces are taken from the longest to the shortest. Open bins are ordered by what is left in them, and each carries a
bitmap of the sources and one of the duplicate clusters it holds. The search starts at the first bin that is large enough
and goes on to its successors until it meets one without a conflict: the tightest compatible bin. If there is none, a bin
is opened.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuecorpus.llm.workspace import as_row, number_equals, row_hash, staged

#: Words that a bin holds.
CAPACITY = 4096
#: Documents that one task packs, about; what is left open at a shard's end is a small part of its bins.
SHARD_ROWS = 4000
#: Words of such a shard, at most, about.
SHARD_WORDS = 8_000_000
SEED = 11
#: Pieces of one source that a bin may hold.
PER_SOURCE = 4


def best_fit(lengths: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int, per_source: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; all lengths are at most ``capacity``.

    A bin holds at most ``per_source`` pieces of a source, each a bit of the source's field, and no two of a cluster; a
    negative number stands for none and conflicts with nothing.
    Pieces of no length share bins freely. Equal lengths keep their order.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_: list[tuple[int, int]] = []  # (left, bin), in order
    held: list[tuple[int, int]] = []  # bitmaps of sources and clusters
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        field = int(sources[i]) * per_source
        source = 1 << (field + per_source - 1) if sources[i] >= 0 else 0  # the last bit of a full field
        cluster = 1 << int(clusters[i]) if clusters[i] >= 0 else 0
        at = bisect_left(open_, (need, -1))
        while at < len(open_):
            s, c = held[open_[at][1]]
            if not (s & source or c & cluster):
                break
            at += 1
        if at < len(open_):
            left, b = open_.pop(at)
        else:
            left, b = capacity, len(held)
            held.append((0, 0))
        bins[i], offsets[i] = b, capacity - left
        s, c = held[b]
        if source:
            taken = (s >> field) & ((1 << per_source) - 1)
            s |= (taken + 1) << field
        held[b] = (s, c | cluster)
        if left - need > 0:
            insort(open_, (left - need, b))
    return bins, offsets


def _numbers(values: np.ndarray, shared_only: bool) -> np.ndarray:
    """Small numbers for bitmaps; with ``shared_only`` a value that occurs once needs none."""
    names, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    if not shared_only:
        return inverse
    numbers = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)
    return numbers[inverse]


MADE = T.StructType([T.StructField("bin_id", T.LongType()), T.StructField("bin_offset", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("piece_start", T.LongType()), T.StructField("piece_length", T.LongType())])


def pack(docs: DataFrame, length: Column, source: Column, cluster: Column, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_rows: int = SHARD_ROWS, shard: Column | None = None) -> DataFrame:
    """``docs`` with ``bin_id``, ``bin_offset``, ``piece``, ``piece_start`` and ``piece_length``, a row per piece.

    A document longer than ``capacity`` is cut into full pieces, each a bin of its own, and a rest that is packed; nothing
    is dropped. A bin's pieces don't overlap, at most ``per_source`` are of one source, and no two of one cluster (null values
    conflict with nothing). Documents whose length is null or negative have none, and are packed too.

    Rows are dealt into shards by a hash of all their columns and of their number among equal rows, so null and repeated ids
    and rows that repeat all columns are spread evenly, and the bins don't depend on the files or the order that rows come in;
    ``shard``, a number from 0, overrides that. The bins of a smaller shard have the smaller numbers. The rows
    are written to the shared folder before they are packed, so pass no more columns than are wanted. Columns of any names
    and types pass through, but for the five above, which are replaced. An empty table gives an empty table.
    """
    keyed = docs.select(
        as_row(docs, tuple(MADE.names)).alias("row"),
        F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0)).alias("length"),
        F.when(source.isNotNull(), F.xxhash64(source)).alias("source"),
        F.when(cluster.isNotNull(), F.xxhash64(cluster)).alias("cluster"),
        row_hash(docs).alias("mark"),
        F.spark_partition_id().alias("part") if shard is None else shard.cast("long").alias("dealt"),
    )
    rows = staged(keyed, "packing-rows")
    if shard is None:
        n, words = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        shards = max(1, -(-n // shard_rows), -(-words // SHARD_WORDS))
        rows = number_equals(rows, ["mark"], "part").withColumn("dealt", F.pmod(F.xxhash64("mark", "nth", F.lit(SEED)), F.lit(shards)).cast("long"))
    schema = T.StructType([rows.schema["row"], *MADE])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            numbers = np.asarray(batch.column("dealt"), np.int64)
            cuts = np.concatenate(([0], np.flatnonzero(numbers[1:] != numbers[:-1]) + 1, [len(numbers)]))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    if held and numbers[a] != last:
                        yield from _pack_shard(held, last, capacity, per_source)
                        held = []
                    held.append(batch.slice(a, b - a))
                    last = numbers[a]
        if held:
            yield from _pack_shard(held, last, capacity, per_source)

    sorted_ = rows.repartition("dealt").sortWithinPartitions("dealt", "mark")
    return sorted_.select("row", "dealt", "length", "source", "cluster").mapInArrow(packed, schema).select("row.*", *MADE.names)


def _pack_shard(batches: list[pa.RecordBatch], shard: int, capacity: int, per_source: int) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(batches)
    count = table.num_rows
    lengths = np.asarray(table["length"], np.int64)
    groups = []
    for name, shared in (("source", False), ("cluster", True)):
        column = table[name].combine_chunks()
        known = np.asarray(column.is_valid())
        numbers = np.full(count, -1, np.int64)
        numbers[known] = _numbers(np.asarray(column.drop_null(), np.int64), shared)
        groups.append(numbers)
    full = np.where(lengths > capacity, (lengths - 1) // capacity, 0)
    rest = lengths - full * capacity
    bins, offsets = best_fit(rest, *groups, capacity, per_source)
    opened = int(bins.max()) + 1 if count else 0
    row = np.repeat(np.arange(count), full + 1)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(full + 1) - full - 1, full + 1)
    is_rest = piece == full[row]
    own = opened + np.cumsum(~is_rest) - 1
    cols = {
        "bin_id": np.where(is_rest, bins[row], own) + (int(shard) << 32),
        "bin_offset": np.where(is_rest, offsets[row], 0),
        "piece": piece.astype(np.int32),
        "piece_start": piece * capacity,
        "piece_length": np.where(is_rest, rest[row], capacity),
    }
    out = table.select(["row"]).take(pa.array(row))
    for name, values in cols.items():
        out = out.append_column(name, pa.array(values))
    yield from out.to_batches(max_chunksize=2000)


def word_count(text: Column) -> Column:
    """Words of a text: runs of characters other than white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))
