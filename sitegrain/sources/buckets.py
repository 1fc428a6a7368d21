"""Keyed tables in hash buckets: a write touches the buckets of its keys and leaves the files of all others in place."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from sitegrain.session import empty_table
from sitegrain.sources.snapshots import SnapshotTable

_PLACE = [StructField("version", LongType()), StructField("bucket", IntegerType())]
_COMMIT = StructType([StructField("bucket", IntegerType()), StructField("version", LongType())])


@dataclass(frozen=True)
class BucketTable:
    """A table whose rows lie in ``buckets`` folders by a hash of ``key``. One writer at a time, any number of readers.

    ==========================================  ==================================================================
    ``data/version=v/bucket=b/``                rows that version ``v`` wrote
    ``keys/version=v/bucket=b/``                their keys alone, once each, so that key checks read no other column
    ``lookup/<column>/version=v/part=p/``       which files of the version hold a value of the column
    ``commits/``                                a snapshot for each write: the versions that make up each bucket
    ==========================================  ==================================================================

    A write counts once its commit is there, and the commit is written last; files of a write that failed are never read and
    are overwritten by the next one. ``lookups`` are the columns that ``lookup`` may search.
    """

    spark: SparkSession
    root: str
    schema: StructType
    key: str
    buckets: int = 64
    lookups: Sequence[str] = ()
    commits: SnapshotTable = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "commits", SnapshotTable(self.spark, f"{self.root}/commits", _COMMIT))

    # What is there

    def versions(self) -> list[tuple[int, str]]:
        return self.commits.versions()

    def has(self, tag: str) -> bool:
        return self.commits.has(tag)

    def live(self) -> list[tuple[int, int]]:
        """``(bucket, version)`` of the last commit: a row for each bucket and each append to it since it was rewritten."""
        return sorted((r.bucket, r.version) for r in self.commits.read().collect())

    def bucket_of(self, key: Column | str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame, key: Column | str) -> list[int]:
        """Buckets of these keys; at most ``buckets`` numbers."""
        return sorted(r[0] for r in rows.select(self.bucket_of(key)).distinct().collect())

    def _paths(self, kind: str, buckets: Iterable[int] | None) -> list[str]:
        wanted = None if buckets is None else set(buckets)
        return [f"{self.root}/{kind}/version={v}/bucket={b}" for b, v in self.live() if wanted is None or b in wanted]

    def _read(self, kind: str, schema: StructType, paths: Sequence[str]) -> DataFrame:
        if not paths:
            return empty_table(self.spark, StructType([*schema.fields, *_PLACE]))
        reader = self.spark.read.schema(StructType([*schema.fields, *_PLACE])).option("basePath", f"{self.root}/{kind}")
        return reader.parquet(*paths)

    def read(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """Rows of the given buckets, or of all; other buckets' files are not opened."""
        return self._read("data", self.schema, self._paths("data", buckets)).select(*self.schema.names)

    def keys(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """``(key, bucket)`` from the keys-only files."""
        return self._read("keys", StructType([self.schema[self.key]]), self._paths("keys", buckets)).select(self.key, "bucket")

    def files_with(self, column: str, value: str) -> list[str]:
        """Files of the table that hold a value, by the list kept on write."""
        if column not in self.lookups:
            raise ValueError(f"lookup key is one of {', '.join(self.lookups)}")
        live = set(self.live())
        part = self.spark.range(1).select(self.bucket_of(F.lit(value))).first()[0]
        versions = sorted({v for _, v in live})
        root = f"{self.root}/lookup/{column}"
        paths = [path for v in versions if self._exists(path := f"{root}/version={v}/part={part}")]
        if not paths:
            return []
        listed = self.spark.read.option("basePath", root).parquet(*paths).filter(F.col("value") == F.lit(value))
        # One row for each file that holds the value; the planner of any scan keeps as much.
        found = {(r.bucket, r.version, r.file) for r in listed.select("bucket", "version", "file").distinct().collect()}
        return sorted(f"{self.root}/data/version={v}/bucket={b}/{name}" for b, v, name in found if (b, v) in live)

    def lookup(self, column: str, value: str) -> DataFrame:
        """Rows with this value; only files that hold it are opened."""
        rows = self._read("data", self.schema, self.files_with(column, value)).select(*self.schema.names)
        return rows.filter(F.col(column) == F.lit(value))

    # Writing

    def append(self, rows: DataFrame, tag: str = "") -> None:
        """Add rows as files of their own; no stored row is read."""
        self._write(rows, self.live, tag)

    def replace(self, buckets: Iterable[int] | None, rows: DataFrame, tag: str = "") -> None:
        """Make ``rows`` the whole content of these buckets (all buckets, if None); every row must belong to one of them."""
        gone = None if buckets is None else set(buckets)
        self._write(rows, lambda: [(b, v) for b, v in self.live() if gone is not None and b not in gone], tag)

    def commit(self, rows: DataFrame, tag: str = "") -> None:
        """Make ``rows`` the whole table."""
        self.replace(None, rows, tag)

    def _write(self, rows: DataFrame, kept, tag: str) -> None:
        if tag and self.has(tag):
            return
        versions = self.versions()
        version = versions[-1][0] + 1 if versions else 0
        place = rows.select(*self.schema.names).withColumn("bucket", self.bucket_of(self.key))
        # Rebalanced, so that a bucket of many or of large rows is written by several tasks, and small ones by one.
        laid = place.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", self.key)
        laid.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/version={version}")
        written = self._folders(f"data/version={version}")
        paths = [f"{self.root}/data/version={version}/bucket={b}" for b in written]
        fresh = self._read("data", self.schema, paths)
        keys = fresh.select(self.key, "bucket").distinct()
        keys.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/keys/version={version}")
        self._beside(version, keys)
        for column in self.lookups if paths else ():
            at = F.col("_metadata.file_name").alias("file")
            values = fresh.select(F.col(column).alias("value"), "bucket", at).filter("value is not null").distinct()
            values = values.withColumn("part", self.bucket_of("value")).sortWithinPartitions("part", "value")
            values.write.mode("overwrite").partitionBy("part").parquet(f"{self.root}/lookup/{column}/version={version}")
        places = [(b, v) for b, v in [*kept(), *((b, version) for b in written)]]
        self.commits.commit(self.spark.createDataFrame(places, _COMMIT).coalesce(1), tag)

    def _beside(self, version: int, keys: DataFrame) -> None:
        """What else a kind of table keeps of the ``(key, bucket)`` rows that a version wrote; stored before the commit."""

    # Files

    def _exists(self, path: str) -> bool:
        to_path, files = self.commits._files()
        return files.exists(to_path(path))

    def _folders(self, below: str) -> list[int]:
        """Buckets that have files in a version."""
        to_path, files = self.commits._files()
        names = [status.getPath().getName() for status in files.listStatus(to_path(f"{self.root}/{below}"))]
        return sorted(int(name.removeprefix("bucket=")) for name in names if name.startswith("bucket="))

    def expire(self, keep: int = 2) -> None:
        """Remove commits older than the last ``keep``, and the files that none of the others names."""
        self.commits.expire(keep)
        used = set()
        for _, name in self.versions():
            used |= {(r.version, r.bucket) for r in self.spark.read.schema(_COMMIT).parquet(f"{self.commits.root}/{name}").collect()}
        to_path, files = self.commits._files()
        last = max((number for number, _ in self.versions()), default=-1)
        for kind in ("data", "keys"):
            for version in range(last + 1):
                if not self._exists(f"{self.root}/{kind}/version={version}"):
                    continue
                for bucket in self._folders(f"{kind}/version={version}"):
                    if (version, bucket) not in used:
                        files.delete(to_path(f"{self.root}/{kind}/version={version}/bucket={bucket}"), True)
