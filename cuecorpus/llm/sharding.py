"""Sharding by histogram sort, from DataFrame operations only.

Rows are ordered by (hash of the text, id, number among rows that share both), so equal texts lie together. The shard limits are found without moving a
row: each round counts the exact bytes below candidate limits, in one aggregation with a result of a few thousand
rows, and narrows the interval around each limit until it is within the tolerance. Then rows move once.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cuecorpus.llm.workspace import number_equals, staged

#: Bits by which a round narrows each open limit: 2**BITS candidates between its ends.
BITS = 8
#: Part of a shard's bytes by which a limit may miss its place.
TOLERANCE = 0.001
#: Rows that one task numbers, about.
CELL_ROWS = 500_000
LOWEST = -(2**63)

#: Parts of a row's key, 64 bits each: hash of the text, id, hash of the number among rows that share both.
KEY = ("_h", "_i", "_r")
WORD = 64
Limit = tuple[int, int, int]


def _kept_bits(level: int) -> list[int]:
    """How many leading bits of each part of the key the first ``level * BITS`` bits of the whole hold."""
    return [min(max(level * BITS - WORD * k, 0), WORD) for k in range(len(KEY))]


def _prefix(level: int) -> list[Column]:
    """The first ``level * BITS`` bits of a row's key."""
    return [F.shiftright(c, WORD - bits) if bits else F.lit(0).cast("long") for c, bits in zip(KEY, _kept_bits(level), strict=True)]


def _limit(level: int, prefix: Limit) -> Limit:
    """The lowest key that has this prefix."""
    return tuple(p << (WORD - bits) if bits else LOWEST for p, bits in zip(prefix, _kept_bits(level), strict=True))


def _probe(rows: DataFrame, level: int, prefixes: set[Limit]) -> dict[Limit, list[tuple[Limit, int]]]:
    """For each prefix of the level before, those of this level below it with their bytes, in order: ``2**BITS`` at most,
    whatever the rows are."""
    outer, inner = _prefix(level - 1), _prefix(level)
    mine = F.lit(False)
    for p in sorted(prefixes):
        mine = mine | reduce(and_, (c == v for c, v in zip(outer, p, strict=True)))
    named = [c.alias(f"o{k}") for k, c in enumerate(outer)] + [c.alias(f"i{k}") for k, c in enumerate(inner)]
    got = rows.where(mine).groupBy(*named).agg(F.sum("_size").alias("bytes"))
    out: dict[Limit, list] = {p: [] for p in prefixes}
    for r in got.orderBy("i0", "i1", "i2").collect():
        out[r["o0"], r["o1"], r["o2"]].append(((r["i0"], r["i1"], r["i2"]), r["bytes"]))
    return out


def find_splitters(rows: DataFrame, parts: int, total: int, slack: float) -> list[Limit]:
    """Keys that cut ``rows`` (``KEY``, ``_size``) into ``parts`` parts of near equal bytes.

    Limits between two hashes come first, so equal texts stay together where the tolerance allows; a larger group is cut
    between two ids, and rows that share an id or have none between two numbers. At most 192 / BITS rounds, each of which
    sends the driver ``2**BITS`` counts a limit at most.
    """
    # For each open limit: the prefix whose rows hold its place, and the bytes below that prefix.
    open_, found, level = {k: ((0,) * len(KEY), 0) for k in range(1, parts)}, {}, 0
    while open_:
        level += 1
        counts = _probe(rows, level, {p for p, _ in open_.values()})
        for k, (prefix, below) in list(open_.items()):
            goal = total * k / parts
            best, at, inner = None, below, None
            for key, size in counts[prefix]:
                if best is None or abs(at - goal) < best[0]:
                    best = (abs(at - goal), _limit(level, key))
                if at <= goal:
                    inner = (key, at)
                at += size
            if best is None:
                found[k] = (LOWEST,) * len(KEY)
            elif best[0] <= slack or level * BITS == WORD * len(KEY):
                found[k] = best[1]
            else:
                open_[k] = inner
                continue
            del open_[k]
    return [found[k] for k in range(1, parts)]


def _shard(limits: list[Limit]) -> Column:
    """Number of limits at or below a row's key."""
    out = F.lit(0)
    for h, i, r in limits:
        later = (F.col("_h") > h) | (F.col("_h") == h) & ((F.col("_i") > i) | (F.col("_i") == i) & (F.col("_r") >= r))
        out = out + F.when(later, 1).otherwise(0)
    return out


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per document: ``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    The law is ``bytes``: sizes (UTF-8 bytes of the text plus 1; a null text has none) of the shards are near equal.
    Slots of a shard are gapless from 0. Rows that tie on text and id are interchangeable, and are cut by their number
    where they are too many for a shard. A null id sorts before all others. ``grown_shard`` is null under this law. Further columns are ignored; an empty table gives an empty table.

    Slots are given out by cells, each a part of one shard by hash of the key, so that no task numbers a whole shard: the
    cells' row counts are summed up to their first slots, and rows are numbered inside their cell.
    """
    text = F.col(text_col)
    keyed = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("_size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("_h"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("_i"),
        F.spark_partition_id().alias("_part"),
    )
    numbered = number_equals(staged(keyed, "sharding-texts"), ["_h", "_i"], "_part")
    rows = staged(numbered.withColumn("_r", F.xxhash64("nth")).drop("nth"), "sharding-keys")
    total, n = rows.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.count(F.lit(1))).first()
    limits = find_splitters(rows, shards, total, tolerance * total / shards)
    cells = max(4, -(-n // (shards * cell_rows)))
    placed = rows.select("doc_id", F.col("_size").alias("size"), "text_crc32", _shard(limits).alias("shard"), F.pmod(F.xxhash64("_i", "_h", "_r"), F.lit(cells)).cast("int").alias("_cell"))
    counts = placed.groupBy("shard", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    # One row for each cell: rows / cell_rows of them.
    firsts = counts.select("shard", "_cell", (F.sum("_n").over(W.partitionBy("shard").orderBy("_cell")) - F.col("_n")).alias("_first"))
    order = W.partitionBy("shard", "_cell").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("_at", F.row_number().over(order) - 1)
        .join(F.broadcast(firsts), ["shard", "_cell"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_first") + F.col("_at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
