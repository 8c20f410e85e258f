"""Co-partitioned tables: artifacts of one corpus in buckets of the video's hash, so that joins by video move no rows.

A table is a view over its newest version. A version is a table of its own, bucketed and sorted by the key, and is written
whole before the view is pointed at it; a reader sees one version or the next. Tables of one corpus have one number of buckets.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a bucket's file, about.
BUCKET_BYTES = 256 << 20


def buckets_for(size: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """A power of two, so that tables of unlike numbers still meet without a shuffle of both."""
    return 1 << max(0, (max(1, size) - 1) // bucket_bytes).bit_length()


class Buckets:
    """Bucketed tables of a corpus, kept below ``root``, a folder that driver and executors share; ``name`` tells corpora apart
    in the session's catalog."""

    def __init__(self, spark: SparkSession, root: str, name: str, buckets: int, key: str = "video_id"):
        if not re.fullmatch(r"[A-Za-z]\w*", name):
            raise ValueError(f"{name} is no name of a table")
        self.spark, self.root, self.name, self.buckets, self.key = spark, root.rstrip("/"), name, buckets, key

    def _view(self, table: str) -> str:
        return f"{self.name}_{table}"

    def write(self, table: str, rows: DataFrame) -> None:
        """Make ``rows`` the table's newest version.

        Rows are dealt by bucket before they are written, so a bucket is one file and a task holds no more than one open.
        """
        version = f"{self._view(table)}_{uuid.uuid4().hex}"
        dealt = rows.repartition(self.buckets, self.key)
        dealt.write.bucketBy(self.buckets, self.key).sortBy(self.key).option("path", f"{self.root}/{version}").format("parquet").saveAsTable(version)
        self.spark.sql(f"CREATE OR REPLACE VIEW {self._view(table)} AS SELECT * FROM {version}")

    def read(self, table: str) -> DataFrame:
        return self.spark.table(self._view(table))

    def upsert(self, table: str, rows: DataFrame) -> None:
        """Make a version in which the videos of ``rows`` are replaced. The old rows meet the new keys bucket by bucket, where
        they lie; the old version stays as it is."""
        old = self.read(table)
        rest = old.join(rows.select(self.key).distinct(), self.key, "left_anti").select(*old.columns)
        self.write(table, rest.unionByName(rows.select(*old.columns)))

    def exchanges(self, df: DataFrame) -> int:
        """How many times the rows of a plan are dealt anew by the key."""
        plan = df._jdf.queryExecution().executedPlan().toString()
        return len(re.findall(rf"hashpartitioning\({self.key}#\d+L?,", plan))

