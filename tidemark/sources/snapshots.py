"""Versions of a set of points: a Parquet folder for each, with a manifest row that holds its hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def content_hash(points: DataFrame) -> str:
    """A hash that doesn't depend on the order of rows: rows are hashed where they are, and their hashes added up and counted."""
    row: Column = F.sha2(F.to_json(F.struct(*sorted(points.columns))), 256)
    halves = [F.sum(F.conv(F.substring(row, a, 12), 16, 10).cast("decimal(38,0)")).cast("string") for a in (1, 13, 25, 37)]
    return points.agg(F.sha2(F.concat_ws("|", *halves, F.count("*").cast("string")), 256).alias("h")).head()["h"]


class Snapshots:
    """Versions below ``folder``; the newest ``keep`` are listed."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = 10):
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep

    def _manifest(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.folder}/manifest")
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return None

    def create(self, points: DataFrame, name: str) -> int:
        """Writes ``points`` as the next version of ``name``; returns its number."""
        held = self._manifest()
        last = held.filter(F.col("name") == name).agg(F.max("version")).head()[0] if held is not None else None
        version = (last or 0) + 1
        points.write.parquet(f"{self.folder}/{name}/version={version}")
        stored = self.spark.read.parquet(f"{self.folder}/{name}/version={version}")
        row = [(name, version, content_hash(stored), stored.count())]
        self.spark.createDataFrame(row, "name string, version int, sha256 string, rows bigint").write.mode("append").parquet(f"{self.folder}/manifest")
        return version

    def list(self, name: str) -> DataFrame:
        held = self._manifest()
        if held is None:
            raise ValueError("there is no snapshot")
        return held.filter(F.col("name") == name).orderBy(F.col("version").desc()).limit(self.keep)

    def restore(self, name: str, version: int) -> DataFrame:
        """The points of a version, after its hash is checked."""
        known = self.list(name).filter(F.col("version") == version).head()
        if known is None:
            raise ValueError(f"no version {version} of {name}")
        points = self.spark.read.parquet(f"{self.folder}/{name}/version={version}")
        if content_hash(points) != known["sha256"]:
            raise ValueError(f"version {version} of {name} was changed")
        return points
