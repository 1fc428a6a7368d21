"""Keyed merges, deletes and appends, as DataFrames of the table that results."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.operators.keys import rows_without_keys
from sitegrain.schemas import EXTRACTED_JOBS, JOB_LISTINGS, RAW_PAGES
from sitegrain.session import fits_broadcast, stage, utc_now

JOB_TEXTS = ("title", "company", "location", "salary", "description")


class DuplicateLinkError(ValueError):
    """An append would break the uniqueness of ``link``."""


def latest_per_key(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``.

    An aggregate, not a window: copies of a hot key merge before the shuffle.
    """
    others = [name for name in rows.columns if name != key and name not in order]
    last = rows.groupBy(key).agg(F.max(F.struct(*order, *others)).alias("_last"))
    return last.select(*[F.col(name) if name == key else F.col(f"_last.{name}").alias(name) for name in rows.columns])


def split_incomplete(rows: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(complete, rejected)`` by NULLs in required columns; the rejected go to quarantine."""
    missing = F.array_compact(F.array(*[F.when(F.col(name).isNull(), F.lit(name)) for name in required]))
    # Plain tests for NULL reach the scan, and cost less than the list of what is missing.
    complete = reduce(and_, [F.col(name).isNotNull() for name in required])
    return rows.filter(complete), rows.filter(~complete).withColumn(
        "reason", F.concat(F.lit("missing: "), F.array_join(missing, ", "))
    )


def upsert_raw_pages(
    target: DataFrame | None, rows: DataFrame, order: Sequence[str], now: Column | None = None
) -> DataFrame:
    """K1: ``raw_pages``, new ones if None, after inserting ``rows(url, content_type, raw_content)`` or replacing by URL.

    The last row by ``order`` wins within the batch. Rows without URL or content are left out;
    ``split_incomplete`` gives them.

    Bodies are heavy, so they move only where they must: the batch's URLs, and those that occur
    several times in it, are staged first. While the latter are small enough to broadcast, only their
    rows are shuffled; beyond that, all rows of the batch go through the aggregate, which merges
    copies before its shuffle. ``rows`` is read several times; stage it first if it is costly to
    compute or holds random ids.
    """
    complete, _ = split_incomplete(rows, ("url", "raw_content"))
    return upsert_complete_pages(target, complete, order, now)


def upsert_complete_pages(
    target: DataFrame | None, rows: DataFrame, order: Sequence[str], now: Column | None = None, urls: DataFrame | None = None
) -> DataFrame:
    """``upsert_raw_pages`` of rows that all have URL and content.

    ``urls(url)`` holds a row for each of them, and may hold more: it is what new pages are counted by, so that no content is read for that.
    """
    complete = rows.select("url", "content_type", "raw_content", *order)
    if target is None:
        # No URL is looked for in the table, so hashes will do: that a few more rows go through the aggregate changes nothing.
        key, hashed = "_hash", complete.withColumn("_hash", F.xxhash64("url"))
        counted = (complete if urls is None else urls).select(F.xxhash64("url").alias(key)).groupBy(key).count()
    else:
        key, hashed = "url", complete
        counted = stage(complete.groupBy(key).count(), "batch-urls")
    repeated = stage(counted.filter("count > 1").select(key), "repeated-urls")
    if fits_broadcast(repeated):
        several = latest_per_key(hashed.join(repeated, key, "left_semi").select(*complete.columns), "url", order)
        last = hashed.join(repeated, key, "left_anti").select(*complete.columns).unionByName(several)
    else:
        last = latest_per_key(complete, "url", order)
    fetched = (utc_now() if now is None else now).cast("timestamp_ntz")
    fresh = last.select("url", "content_type", "raw_content", fetched.alias("fetched_at"))
    if target is None:
        return fresh
    kept = rows_without_keys(target.select(*RAW_PAGES.names), counted, ["url"])
    return kept.unionByName(fresh)


def joined_skills(skills: Column) -> Column:
    """C4: comma-joined, a NULL list as ``""`` and a NULL item as an empty one."""
    items = F.transform(skills, lambda skill: F.coalesce(skill, F.lit("")))
    return F.coalesce(F.array_join(items, ","), F.lit(""))


def _job_rows(rows: DataFrame, *others: str) -> DataFrame:
    return rows.select(
        *[F.coalesce(F.col(name), F.lit("")).alias(name) for name in (*JOB_TEXTS, "link")],
        joined_skills(F.col("skills")).alias("skills"),
        *others,
    )


def upsert_extracted(
    target: DataFrame, rows: DataFrame, order: Sequence[str], now: Column | None = None
) -> DataFrame:
    """K3: ``extracted_jobs`` after inserting records or replacing by link.

    The last row by ``order`` wins within the batch; ``created_at`` of an existing link is kept.
    """
    at = (F.current_timestamp() if now is None else now).cast("timestamp")
    last = stage(latest_per_key(_job_rows(rows, *order), "link", order), "extracted")
    known = target.select("link", "created_at").join(last.select("link"), "link", "left_semi")
    fresh = last.join(known, "link", "left").select(
        *JOB_TEXTS, "link", "skills", F.coalesce("created_at", at).alias("created_at"), at.alias("updated_at")
    )
    kept = rows_without_keys(target, last, ["link"])
    return kept.select(*EXTRACTED_JOBS.names).unionByName(fresh)


def link_conflicts(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Links that occur twice in ``rows`` or already in ``target``."""
    counted = rows.select(F.coalesce("link", F.lit("")).alias("link")).groupBy("link").count()
    present = counted.join(target.select("link"), "link", "left_semi")
    return counted.filter("count > 1").select("link").union(present.select("link")).distinct()


def append_extracted(target: DataFrame, rows: DataFrame, now: Column | None = None) -> DataFrame:
    """K2: rows to append to ``extracted_jobs``; raises when a link would occur twice."""
    conflict = link_conflicts(target, rows)
    if not conflict.isEmpty():
        raise DuplicateLinkError("append holds links that occur twice or are stored already")
    at = (F.current_timestamp() if now is None else now).cast("timestamp")
    return _job_rows(rows).select(*JOB_TEXTS, "link", "skills", at.alias("created_at"), at.alias("updated_at"))


def delete_by_urls(target: DataFrame, urls: DataFrame | None, key: str | Sequence[str] = "url") -> DataFrame:
    """K4: the table without rows whose key is listed; give ``(url, fetched_at)`` to spare refetched pages."""
    if urls is None:
        return target
    return rows_without_keys(target, urls, [key] if isinstance(key, str) else key)


def append_job_listings(listings: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """K5: ``(rows, rejected)``: listings in table form with defaults, and those that do not fit it.

    Rejected are rows lacking a required column, or with a salary beyond the column's range.
    """
    listings = listings.withColumns(
        {
            name: F.lit(None).cast(JOB_LISTINGS[name].dataType)
            for name in JOB_LISTINGS.names
            if name not in listings.columns
        }
    )
    complete, rejected = split_incomplete(listings, ("title", "source", "url"))
    salaries = ("salary_min", "salary_max")
    money = JOB_LISTINGS["salary_min"].dataType
    unfit = [F.col(name).isNotNull() & F.col(name).try_cast(money).isNull() for name in salaries]
    out_of_range = unfit[0] | unfit[1]
    defaults = {
        "remote_flag": F.coalesce("remote_flag", F.lit(False)),
        "crawl_timestamp": F.coalesce(F.col("crawl_timestamp"), (utc_now() if now is None else now)),
    }
    rows = complete.filter(~out_of_range).select(
        *[
            (
                F.col(field.name).try_cast(field.dataType)
                if field.name in salaries
                else defaults.get(field.name, F.col(field.name)).cast(field.dataType)
            ).alias(field.name)
            for field in JOB_LISTINGS
        ]
    )
    unfit_rows = complete.filter(out_of_range).withColumn("reason", F.lit("salary out of range"))
    return rows, rejected.unionByName(unfit_rows)
