"""Scans and lookups of the stored tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.schemas import RAW_PAGES

LOOKUP_KEYS = ("company", "title", "link")


def spread(scan: DataFrame) -> DataFrame:
    """Spread a freshly read table that has fewer splits than the cluster has cores.

    A small file would else be parsed by one task. Large tables come back as they are, unshuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def read_raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw pages stored as Parquet, read with the table's schema."""
    return spark.read.schema(RAW_PAGES).parquet(path)


def scan_raw_pages(raw_pages: DataFrame) -> DataFrame:
    """The three columns the parse step reads."""
    return raw_pages.select("url", "content_type", "raw_content")


def since(start: datetime | Column, at: str = "fetched_at") -> Column:
    return F.col(at) >= (start if isinstance(start, Column) else F.lit(start).cast("timestamp_ntz"))


def scan_since(raw_pages: DataFrame, start: datetime | Column, at: str = "fetched_at") -> DataFrame:
    """Rows fetched at ``start`` or later; the bound reaches the Parquet scan."""
    return raw_pages.filter(since(start, at))


def lookup_extracted(extracted: DataFrame, key: str, value: str) -> DataFrame:
    """S3: equality lookup by company, title or link."""
    if key not in LOOKUP_KEYS:
        raise ValueError(f"lookup key is one of {', '.join(LOOKUP_KEYS)}")
    return extracted.filter(F.col(key) == F.lit(value))
