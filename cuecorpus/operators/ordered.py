"""Ordered scans whose keys may be longer than a task: numbers, running sums and last known values without one window a key.

Rows are dealt by ranges of key and order, so a long key is several parts. Each part is scanned by itself; what it hands on to
the parts after it is one row. A range boundary cuts one key at most, so the rows of keys of several parts are fewer than twice
the ranges: these are what is broadcast back to the parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cuecorpus.checkpoints import ensure_checkpoints, tidied

_ROWS = "_rows"


def scan(
    df: DataFrame,
    key: list[str],
    order: list[str],
    row: str | None = None,
    size: str | None = None,
    sums: dict[str, Column] | None = None,
    totals: dict[str, Column] | None = None,
    last: dict[str, Column] | None = None,
    next: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``df`` with columns over the rows of a ``key`` in ascending ``order`` (nulls first), which must be a total one.

    ``row`` names a row's number from 1 and ``size`` the number of rows of its key. ``sums`` are running sums up to the row,
    ``totals`` those over the key; ``last`` are the last values up to the row that aren't null, ``next`` the first ones from
    the row on, ``previous`` the values of the row before, null or not. Keys aren't null; sums are of longs, nulls count as 0.

    The rows are checkpointed once, or written by ``keep`` and read back, as parts must stay as they are while what they hand
    on is worked out.
    """
    ensure_checkpoints(df.sparkSession)
    sums, totals, last, next, previous = sums or {}, totals or {}, last or {}, next or {}, previous or {}
    number = lambda c: F.coalesce(c.cast("long"), F.lit(0).cast("long"))
    given = df.withColumns(
        {f"_s_{k}": number(c) for k, c in sums.items()} | {f"_t_{k}": number(c) for k, c in totals.items()} | {f"_l_{k}": c for k, c in last.items()} | {f"_n_{k}": c for k, c in next.items()} | {f"_p_{k}": c for k, c in previous.items()}
    )
    ranged = given.repartitionByRange(*key, *order).withColumn("_part", F.spark_partition_id())
    with tidied(df.sparkSession):
        parts = keep(ranged) if keep else ranged.checkpoint()

    place = F.struct(*order)
    known = lambda c: F.when(F.col(c).isNotNull(), place)
    handed = [F.count(F.lit(1)).alias(_ROWS)]
    handed += [F.sum(f"_s_{k}").alias(f"_s_{k}") for k in sums] + [F.sum(f"_t_{k}").alias(f"_t_{k}") for k in totals]
    handed += [F.max_by(f"_l_{k}", known(f"_l_{k}")).alias(f"_l_{k}") for k in last] + [F.min_by(f"_n_{k}", known(f"_n_{k}")).alias(f"_n_{k}") for k in next]
    handed += [F.max_by(F.struct(F.col(f"_p_{k}").alias("v")), place).alias(f"_p_{k}") for k in previous]
    summary = parts.groupBy("_part", *key).agg(*handed)
    own = W.partitionBy(*key)
    before, after = (own.orderBy(o).rowsBetween(W.unboundedPreceding, -1) for o in ("_part", F.desc("_part")))
    shared = summary.withColumn("_parts", F.count(F.lit(1)).over(own)).select(
        "_part", *key, "_parts", F.sum(_ROWS).over(before).alias("_a_row"), F.sum(_ROWS).over(own).alias("_a_size"),
        *[F.sum(f"_s_{k}").over(before).alias(f"_a_s_{k}") for k in sums], *[F.sum(f"_t_{k}").over(own).alias(f"_a_t_{k}") for k in totals],
        *[F.last(f"_l_{k}", True).over(before).alias(f"_a_l_{k}") for k in last], *[F.last(f"_n_{k}", True).over(after).alias(f"_a_n_{k}") for k in next],
        *[F.last(f"_p_{k}").over(before).alias(f"_a_p_{k}") for k in previous],
    ).where("_parts > 1").drop("_parts")

    local = W.partitionBy("_part", *key)
    ahead, back, whole = local.orderBy(*order), local.orderBy(*[F.desc(c) for c in order]), local.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    so_far = ahead.rowsBetween(W.unboundedPreceding, 0)
    scanned = parts.withColumn("_row", F.row_number().over(ahead).cast("long"))
    scanned = scanned.withColumns({f"_s_{k}": F.sum(f"_s_{k}").over(so_far) for k in sums} | {f"_l_{k}": F.last(f"_l_{k}", True).over(so_far) for k in last} | {f"_p_{k}": F.lag(F.struct(F.col(f"_p_{k}").alias("v"))).over(ahead) for k in previous})
    if next:
        scanned = scanned.withColumns({f"_n_{k}": F.last(f"_n_{k}", True).over(back.rowsBetween(W.unboundedPreceding, 0)) for k in next})
    if size or totals:
        scanned = scanned.withColumns({f"_t_{k}": F.sum(f"_t_{k}").over(whole) for k in totals} | {"_size": F.count(F.lit(1)).over(whole)})
    met = scanned.join(F.broadcast(shared), ["_part", *key], "left")
    none = F.lit(0).cast("long")
    out = {}
    if row:
        out[row] = F.coalesce("_a_row", none) + F.col("_row")
    if size:
        out[size] = F.coalesce("_a_size", "_size")
    out |= {k: F.coalesce(f"_a_s_{k}", none) + F.col(f"_s_{k}") for k in sums} | {k: F.coalesce(f"_a_t_{k}", f"_t_{k}") for k in totals}
    out |= {k: F.coalesce(f"_l_{k}", f"_a_l_{k}") for k in last} | {k: F.coalesce(f"_n_{k}", f"_a_n_{k}") for k in next}
    out |= {k: F.coalesce(f"_p_{k}", f"_a_p_{k}")["v"] for k in previous}
    return met.select(*[F.col(f"`{c}`") for c in df.columns], *[c.alias(k) for k, c in out.items()])
