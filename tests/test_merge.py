from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import rows
from sitegrain.operators import merge
from sitegrain.schemas import EXTRACTED_JOBS, JOB_LISTINGS, RAW_PAGES
from sitegrain.sources import tables
from sitegrain.sources.snapshots import SnapshotTable

T0, T1 = datetime(2024, 1, 1), datetime(2024, 1, 2)


def at(time):
    return F.lit(time).cast("timestamp")


@pytest.fixture
def stored(spark):
    return spark.createDataFrame([("u1", "text/html", "old", T0), ("u2", "text/plain", "two", T0)], RAW_PAGES)


def batch(spark, *items):
    return spark.createDataFrame(list(items), "url string, content_type string, raw_content string, seq int")


def test_upsert_raw_pages(spark, stored):
    new = batch(
        spark, ("u1", "text/html", "first", 1), ("u1", "image/png", "last", 2), ("u3", None, "three", 1),
        (None, "t", "x", 1), ("u4", "t", None, 1),
    )
    once = merge.upsert_raw_pages(stored, new, ["seq"], F.lit(T1))
    want = [("u1", "image/png", "last", T1), ("u2", "text/plain", "two", T0), ("u3", None, "three", T1)]
    assert rows(once) == want
    assert rows(merge.upsert_raw_pages(once, new, ["seq"], F.lit(T1))) == want
    assert rows(merge.upsert_raw_pages(stored, batch(spark), ["seq"])) == rows(stored)
    _, rejected = merge.split_incomplete(new, ("url", "raw_content"))
    assert rows(rejected.select(F.coalesce("url", F.lit("-")), "reason")) == [("-", "missing: url"), ("u4", "missing: raw_content")]


def test_upsert_with_a_hot_key(spark, stored):
    hot = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "u1").otherwise(F.concat(F.lit("n"), "id")).alias("url"),
        F.lit("t").alias("content_type"),
        F.col("id").cast("string").alias("raw_content"),
        F.col("id").alias("seq"),
    )
    got = merge.upsert_raw_pages(stored, hot, ["seq"], F.lit(T1))
    assert got.count() == 2002
    assert rows(got.filter("url = 'u1'"), "raw_content") == [("2997",)]


def job(title, link, skills=None, pos=0, description=""):
    return (title, "C", None, "1–2", description, link, skills, pos)


JOBS = "title string, company string, location string, salary string, description string, link string, skills array<string>, pos int"


def test_upsert_extracted(spark):
    empty = spark.createDataFrame([], EXTRACTED_JOBS)
    first = spark.createDataFrame([job("a", "l1", ["x", "y"]), job("b", "l2"), job("c", None), job("d", "", pos=1)], JOBS)
    stored = merge.upsert_extracted(empty, first, ["pos"], at(T0))
    assert rows(stored, "link", "title", "location", "skills", "created_at") == [
        ("", "d", "", "", T0), ("l1", "a", "", "x,y", T0), ("l2", "b", "", "", T0)
    ]
    second = spark.createDataFrame([job("a2", "l1", [None, "z"]), job("a3", "l1", ["w"], 1), job("n", "l3")], JOBS)
    merged = merge.upsert_extracted(stored, second, ["pos"], at(T1))
    want = [("", "d", "", T0, T0), ("l1", "a3", "w", T0, T1), ("l2", "b", "", T0, T0), ("l3", "n", "", T1, T1)]
    shown = ("link", "title", "skills", "created_at", "updated_at")
    assert rows(merged, *shown) == want
    assert rows(merge.upsert_extracted(merged, second, ["pos"], at(T1)), *shown) == want
    assert rows(merge.upsert_extracted(merged, spark.createDataFrame([], JOBS), ["pos"]), *shown) == want


def test_skills_are_joined_without_losing_items(spark):
    frame = spark.createDataFrame([(0, None), (1, []), (2, ["a", None, "b,c"])], "i int, s array<string>")
    assert rows(frame.select("i", merge.joined_skills(F.col("s")))) == [(0, ""), (1, ""), (2, "a,,b,c")]


def test_append_extracted(spark):
    empty = spark.createDataFrame([], EXTRACTED_JOBS)
    two = spark.createDataFrame([job("a", "l1"), job("b", "l2", ["s"])], JOBS)
    stored = merge.append_extracted(empty, two, at(T0))
    assert rows(stored, "title", "link", "skills") == [("a", "l1", ""), ("b", "l2", "s")]
    for clash in ([job("c", "l1")], [job("c", "l3"), job("d", "l3")], [job("c", None), job("d", "")]):
        with pytest.raises(merge.DuplicateLinkError):
            merge.append_extracted(stored, spark.createDataFrame(clash, JOBS))
    assert merge.append_extracted(stored, spark.createDataFrame([], JOBS)).count() == 0


def test_delete_by_urls(spark, stored, urls_frame):
    assert rows(merge.delete_by_urls(stored, urls_frame("u1", "u1", "unknown", None)), "url") == [("u2",)]
    assert rows(merge.delete_by_urls(stored, urls_frame())) == rows(stored)
    assert rows(merge.delete_by_urls(stored, None)) == rows(stored)
    as_read = spark.createDataFrame([("u1", T0), ("u2", T1)], "url string, fetched_at timestamp_ntz")
    assert rows(merge.delete_by_urls(stored, as_read, ("url", "fetched_at")), "url") == [("u2",)]


def test_append_job_listings(spark):
    listings = spark.createDataFrame(
        [
            ("a", "s", "u1", 750000.5, None, ["x"]),
            ("b", "s", "u2", None, 1e15, None),
            (None, "s", "u3", None, None, None),
        ],
        "title string, source string, url string, salary_min double, salary_max double, tags array<string>",
    )
    good, rejected = merge.append_job_listings(listings, F.lit(T1))
    assert good.schema.names == JOB_LISTINGS.names
    assert [f.dataType for f in good.schema] == [f.dataType for f in JOB_LISTINGS]
    row = good.first()
    assert (row.salary_min, row.salary_max, row.remote_flag, row.posted_date) == (Decimal("750000.5"), None, False, None)
    assert (row.tags, row.crawl_timestamp) == (["x"], T1)
    assert rows(rejected, "url", "reason") == [("u2", "salary out of range"), ("u3", "missing: title")]


def test_scans(spark, stored):
    assert tables.scan_raw_pages(stored).columns == ["url", "content_type", "raw_content"]
    assert tables.scan_since(stored, T0).count() == 2
    assert tables.scan_since(stored, T1).count() == 0
    jobs = spark.createDataFrame([("t", "c", "l"), ("t", "d", "m")], "title string, company string, link string")
    assert rows(tables.lookup_extracted(jobs, "company", "c"), "link") == [("l",)]
    assert tables.lookup_extracted(jobs, "title", "t").count() == 2
    with pytest.raises(ValueError):
        tables.lookup_extracted(jobs, "salary", "1")


def test_snapshots(spark, stored, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "raw"), RAW_PAGES, sort_by="url", bloom=("content_type",))
    assert table.read().count() == 0 and table.versions() == []
    table.commit(stored)
    table.commit(merge.delete_by_urls(table.read(), stored.limit(1).select("url")))
    assert table.read().count() == 1
    table.commit(stored, tag="run-1")
    table.commit(stored.limit(0), tag="run-1")  # a replay
    assert table.read().count() == 2 and table.has("run-1") and len(table.versions()) == 3
    # A version without its mark is not there.
    (tmp_path / "raw" / "v000000000003").mkdir()
    assert table.read().count() == 2
    table.commit(stored.limit(1))
    assert table.read().count() == 1
    table.expire(keep=2)
    assert [number for number, _ in table.versions()] == [2, 3]


def test_a_failed_write_leaves_the_table_as_it_was(spark, stored, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "raw"), RAW_PAGES)
    table.commit(stored)
    broken = stored.withColumn("raw_content", F.raise_error(F.lit("boom")).cast("string"))
    with pytest.raises(Exception, match="boom"):
        table.commit(broken)
    assert rows(table.read()) == rows(stored)


def test_new_raw_pages_are_deduplicated_without_moving_urls(spark, tmp_path):
    batch = [("a", "t", "1", 1), ("b", "t", "2", 1), ("a", "t", "3", 2), (None, "t", "4", 1), ("c", "t", None, 1), ("b", "t", "2", 1)]
    spark.createDataFrame(batch, "url string, content_type string, raw_content string, n int").write.parquet(f"{tmp_path}/batch")
    new = spark.read.parquet(f"{tmp_path}/batch")
    for limit in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            made = merge.upsert_raw_pages(None, new, ["n"], F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
            assert made.columns == RAW_PAGES.names
            assert rows(made, "url", "raw_content") == [("a", "3"), ("b", "2")]
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
