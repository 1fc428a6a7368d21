"""A table as versioned Parquet folders; a version counts once its ``_SUCCESS`` mark is there."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from sitegrain.session import empty_table

_FOLDER = re.compile(r"v\d{12}(-[\w-]+)?")


@dataclass(frozen=True)
class SnapshotTable:
    """One writer at a time, any number of readers. A merge reads one version and writes the next.

    ``sort_by`` orders rows within files, so that filters on it skip row groups: the link for lookups,
    ``fetched_at`` for raw pages. ``bloom`` names further lookup columns to keep bloom filters for.
    """

    spark: SparkSession
    root: str
    schema: StructType
    sort_by: str | None = None
    bloom: Sequence[str] = ()

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        to_path = jvm.org.apache.hadoop.fs.Path
        return to_path, to_path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[tuple[int, str]]:
        """Committed versions, oldest first, as ``(number, folder name)``."""
        to_path, files = self._files()
        if not files.exists(to_path(self.root)):
            return []
        names = [status.getPath().getName() for status in files.listStatus(to_path(self.root))]
        return sorted(
            (int(name[1:13]), name)
            for name in names
            if _FOLDER.fullmatch(name) and files.exists(to_path(f"{self.root}/{name}/_SUCCESS"))
        )

    def read(self) -> DataFrame:
        """The last committed version; an empty table before the first commit."""
        versions = self.versions()
        if not versions:
            return empty_table(self.spark, self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{versions[-1][1]}")

    def has(self, tag: str) -> bool:
        """Whether a version with this tag has been committed."""
        return any(name[14:] == tag for _, name in self.versions())

    def commit(self, rows: DataFrame, tag: str = "") -> None:
        """Write the next version. A tag that is committed already makes this a no-op, so replays are safe."""
        if tag and self.has(tag):
            return
        versions = self.versions()
        number = versions[-1][0] + 1 if versions else 0
        rows = rows.select(*self.schema.names)
        if self.sort_by:
            rows = rows.sortWithinPartitions(self.sort_by)
        writer = rows.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true")
        for column in self.bloom:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(f"{self.root}/v{number:012d}" + (f"-{tag}" if tag else ""))

    def expire(self, keep: int = 2) -> None:
        """Remove committed versions older than the last ``keep``."""
        to_path, files = self._files()
        for _, name in self.versions()[: -max(1, keep)]:
            files.delete(to_path(f"{self.root}/{name}"), True)
