"""Keyed merges, deletes and appends on stored tables.

They take a ``BucketTable``, of which they read and write the buckets of the keys at hand, or a ``SnapshotTable``, which they rewrite.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.operators import merge
from sitegrain.operators.keys import rows_with_keys
from sitegrain.session import stage
from sitegrain.sources.buckets import BucketTable
from sitegrain.sources.snapshots import SnapshotTable

Table = BucketTable | SnapshotTable


def _link() -> Column:
    """The key that a record is stored under: none is the empty one."""
    return F.coalesce(F.col("link"), F.lit(""))


def upsert_raw_pages(table: Table, rows: DataFrame, order: Sequence[str], now: Column | None = None, tag: str = "") -> DataFrame:
    """K1 on a stored table; returns the rows it cannot hold, with a ``reason``."""
    complete, rejected = merge.split_incomplete(rows, ("url", "raw_content"))
    if not isinstance(table, BucketTable):
        table.commit(merge.upsert_raw_pages(table.read(), complete, order, now), tag)
        return rejected
    touched = table.touched(complete, "url")
    if touched:
        table.replace(touched, merge.upsert_raw_pages(table.read(touched), complete, order, now), tag)
    return rejected


def upsert_extracted(table: Table, rows: DataFrame, order: Sequence[str], now: Column | None = None, tag: str = "") -> None:
    """K3 on a stored table. With a tag, an empty batch is committed too, so that it counts as done."""
    if not isinstance(table, BucketTable):
        table.commit(merge.upsert_extracted(table.read(), rows, order, now), tag)
        return
    touched = table.touched(rows, _link())
    if touched or tag:
        table.replace(touched, merge.upsert_extracted(table.read(touched), rows, order, now), tag)


def append_extracted(table: BucketTable, rows: DataFrame, now: Column | None = None, tag: str = "") -> None:
    """K2 on a stored table: adds files; raises when a link would occur twice. Of what is stored only keys are read."""
    if tag and table.has(tag):
        return
    stored = table.keys(table.touched(rows, _link())).select("link")
    table.append(merge.append_extracted(stored, rows, now), tag)


def append_job_listings(table: BucketTable, listings: DataFrame, now: Column | None = None, tag: str = "") -> DataFrame:
    """K5 on a stored table: adds files, whatever is stored; returns the rows it cannot hold, with a ``reason``."""
    rows, rejected = merge.append_job_listings(listings, now)
    table.append(rows, tag)
    return rejected


def delete_by_urls(table: Table, urls: DataFrame | None, key: str | Sequence[str] = "url", tag: str = "") -> None:
    """K4 on a stored table: buckets that hold none of the listed keys stay as they are."""
    if urls is None:
        return
    keys = [key] if isinstance(key, str) else list(key)
    if not isinstance(table, BucketTable):
        table.commit(merge.delete_by_urls(table.read(), urls, keys), tag)
        return
    listed = stage(urls.select(*keys).distinct(), "listed")
    held = rows_with_keys(table.keys(table.touched(listed, table.key)), listed, [table.key])
    touched = sorted(r[0] for r in held.select("bucket").distinct().collect())
    if touched or tag:
        table.replace(touched, merge.delete_by_urls(table.read(touched), listed, keys), tag)
