"""Joins whose one side holds hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that one task takes, at least; above that, keys count as hot.
CROWD = 1000
#: Keys that may be hot: at most so many rows are broadcast.
HOT_KEYS = 100_000


def join_spread(left: DataFrame, right: DataFrame, on: str, by: str, counts: DataFrame | None = None, crowd: int = CROWD) -> DataFrame:
    """The inner join of ``left`` with ``right``, which has one row for each key ``on``, however many rows of ``left`` share one.

    The rows of a hot key are dealt by a hash of ``by`` to tasks of about ``crowd`` rows, and the row of ``right`` goes to each
    of these. Keys are hot from ``crowd`` rows on, or from a ``HOT_KEYS``-th part of all rows if that is more, so there are
    never more than ``HOT_KEYS`` of them and their numbers can be broadcast. ``counts`` (``on``, ``n``) spares counting;
    it may leave out keys. Pass a table as ``left``, as it is read twice.
    """
    if counts is None:
        counts = left.groupBy(on).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.where(F.col("n") > crowd)
    most = max(crowd, (counts.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    hot = F.broadcast(counts.where(F.col("n") > most).select(on, F.ceil(F.col("n") / F.lit(most)).alias("_parts")))
    dealt = left.join(hot, on, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")), F.lit(0))).drop("_parts")
    copied = right.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copied, [on, "_part"]).drop("_part")
