"""The session's folder for checkpoints, tables that are kept there for a while, and work on videos in waves."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting that removes shuffled files when a query has ended.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoints(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where none is set, a temporary one
    if driver and executors are one machine, and an error otherwise."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Within it, what a job shuffled is removed as soon as the job has ended; the session's setting is put back."""
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)


class Scratch:
    """Tables in a folder of their own below the session's checkpoints, compressed, and without what their making shuffled."""

    def __init__(self, spark: SparkSession):
        ensure_checkpoints(spark)
        self.spark, self.root = spark, f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` written, and read back."""
        # Types that files can't hold.
        if any(k in df.schema.simpleString() for k in (":void", "<void", "interval")):
            with tidied(self.spark):
                return df.checkpoint()
        path = f"{self.root}/{uuid.uuid4().hex}"
        with tidied(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def in_waves(spark: SparkSession, waves: int, work: Callable[[Callable[[DataFrame], DataFrame], Scratch], DataFrame]) -> DataFrame:
    """The results of ``work`` on all videos, made in ``waves`` groups of videos one after the other.

    ``work`` is given a function that takes a group's rows from a table with ``video_id``, and a place for tables that go when
    the group is done; so what is on disk together is the results and one group's share. A single group is left lazy.
    """
    if waves == 1:
        return work(lambda df: df, Scratch(spark))
    done, parts = Scratch(spark), []
    with tidied(spark):
        for k in range(waves):
            own = Scratch(spark)
            # Ids of other types may be equal: they are hashed as texts.
            parts.append(done.keep(work(lambda df, k=k: df.where(F.pmod(F.xxhash64(F.col("video_id").cast("string")), F.lit(waves)) == k), own)))
            own.drop()
    return reduce(DataFrame.unionByName, parts)
