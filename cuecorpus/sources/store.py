"""A corpus of artifacts as versions: folders that are never changed, and a manifest that is published in one rename.

``root/data/<table>/<version>-<id>`` holds the rows that a commit added, ``root/manifests/<version>.json`` lists the folders that
make up a version. A commit writes its folders first and then its manifest under another name, and renames that; a reader
sees the version before or the version after, and a commit that broke off leaves folders that no manifest names. Two writers
of one version can't both succeed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The version that wrote a row.
COMMIT = "_commit"


class Conflict(RuntimeError):
    """Another writer published this version first."""


class Store:
    """Tables keyed by ``video_id`` under ``root``, a folder that the driver and all executors share.

    Publishing rests on a rename that doesn't replace a file, as distributed and local file systems have it; object stores
    that copy need a committer of their own in front.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def version(self) -> int:
        """The newest published version; 0 before the first."""
        fs, path = self._path("manifests")
        if not fs.exists(path):
            return 0
        names = [x.getPath().getName() for x in fs.listStatus(path)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """The tables of a version, each a list of folders."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "tables": {}}
        fs, path = self._path(f"manifests/{version:010d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """All rows that the commits of a table added, with ``_commit``; none if there is no such table."""
        parts = self.manifest(version)["tables"].get(table)
        return self.spark.read.parquet(*[f"{self.root}/{p}" for p in parts]) if parts else None

    def write(self, table: str, rows: DataFrame, version: int) -> str:
        """Write rows of a version that isn't published yet; the folder, relative to the root."""
        folder = f"data/{table}/{version:010d}-{uuid.uuid4().hex}"
        (rows if COMMIT in rows.columns else rows.withColumn(COMMIT, F.lit(version).cast("long"))).write.parquet(f"{self.root}/{folder}")
        return folder

    def publish(self, base: dict, added: dict[str, list[str]], replaced: bool = False) -> int:
        """Publish the version after ``base``: its folders and the ``added`` ones, or these instead of a table's old ones."""
        tables = {k: list(v) for k, v in base["tables"].items()}
        for name, folders in added.items():
            tables[name] = folders if replaced else [*tables.get(name, []), *folders]
        version = base["version"] + 1
        fs, draft = self._path(f"manifests/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps({"version": version, "tables": tables}).encode()))
        finally:
            out.close()
        _, path = self._path(f"manifests/{version:010d}.json")
        if fs.exists(path) or not fs.rename(draft, path):
            fs.delete(draft, False)
            raise Conflict(f"version {version} of {self.root} is published already")
        return version

    def compact(self, table: str, keep: DataFrame) -> int:
        """Publish ``keep``, rows of ``read(table)`` that are still wanted, as the table's only folder."""
        base = self.manifest()
        return self.publish(base, {table: [self.write(table, keep, base["version"] + 1)]}, replaced=True)
