"""Where intermediate tables go: the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Spark's setting that removes shuffled files when a query has ended.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, a fresh temporary folder that is then set on the session,
    if driver and executors are one machine. On a cluster an unset folder is an error, as executors share no local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str, by: str | None = None, tidy: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder, in parts by the column ``by`` if one is named, and read it back.

    This cuts the lineage: a lost executor costs a reread of shared files, not a recomputation. With ``tidy`` Spark removes
    what the job shuffled as soon as the table is written; the session's setting is put back.
    """
    return staged_parts([df], name, by, tidy)


def staged_parts(parts: Sequence[DataFrame], name: str, by: str | None = None, tidy: bool = True) -> DataFrame:
    """The union of ``parts`` as one table as in ``staged``; they are written one after the other."""
    spark = parts[0].sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(TIDY, None)
    if tidy:
        spark.conf.set(TIDY, "true")
    try:
        for df in parts:
            writer = df.write.mode("append")
            (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        if tidy and before is None:
            spark.conf.unset(TIDY)
        elif tidy:
            spark.conf.set(TIDY, before)
    return spark.read.schema(parts[0].schema).parquet(path)


def column(name: str) -> Column:
    """The column of exactly this name, dots and backticks taken as they are."""
    return F.col(f"`{name.replace('`', '``')}`")


def as_row(df: DataFrame, skip: tuple[str, ...] = ()) -> Column:
    """The columns of ``df`` but ``skip`` in one struct, so that columns made beside it can't clash with the caller's."""
    return F.struct(*[column(c) for c in df.columns if c not in skip])


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns; those of types that Spark can't hash go in as JSON."""
    odd = [f.name for f in df.schema if any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    plain = [column(c) for c in df.columns if c not in odd]
    return F.xxhash64(F.lit(0), *plain, *([F.to_json(F.struct(*[column(c).alias(f"c{k}") for k, c in enumerate(odd)]))] if odd else []))


def number_equals(rows: DataFrame, keys: list[str], part: str) -> DataFrame:
    """``rows`` with ``nth``: a running number from 0 among rows with equal ``keys``, in place of the column ``part``.

    ``part`` says by which task a row was written. Rows are numbered inside their part, and parts are summed up in order, so a
    key that very many rows share is spread over as many tasks as there are parts. Pass a table, as it is read twice.
    """
    counts = rows.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("_n"))
    firsts = counts.select(*keys, part, (F.sum("_n").over(W.partitionBy(*keys).orderBy(part)) - F.col("_n")).alias("_first"))
    inside = rows.withColumn("_at", F.row_number().over(W.partitionBy(*keys, part).orderBy(F.lit(0))) - 1)
    return inside.join(firsts, [*keys, part]).withColumn("nth", (F.col("_first") + F.col("_at")).cast("long")).drop(part, "_first", "_at")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
