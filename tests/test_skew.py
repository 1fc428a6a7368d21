"""Joins with a key that holds a third of the rows: beyond broadcast size, Spark splits its partition."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sitegrain.operators import crawl, merge
from sitegrain.schemas import RAW_PAGES
from sitegrain.session import stage

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}
HOT = "https://example.com/hot"


@pytest.fixture
def small_partitions(spark):
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    yield
    for name in SETTINGS:
        spark.conf.unset(name)


@pytest.fixture
def links_of(spark):
    """30,000 rows ``(url, dst)``, a third of them with one URL."""
    url = F.when(F.col("id") % 3 == 0, HOT).otherwise(F.concat(F.lit("https://example.com/"), "id"))
    target = F.concat(F.lit("https://example.com/to/"), F.sha2(F.col("id").cast("string"), 256))
    return stage(spark.range(0, 30000, 1, 6).select(url.alias("url"), target.alias("dst")), "links")


def run(frame, payload):
    """Row count and the plan as it was run, with a column that does not compress."""
    counted = frame.agg(F.count("*"), F.max(payload))
    return counted.collect()[0][0], counted._jdf.queryExecution().executedPlan().toString()


def test_fetch_splits_a_hot_url(spark, small_partitions, links_of):
    frontier = stage(links_of.select("url").distinct(), "frontier")
    count, plan = run(crawl.fetch_stored_pages(frontier, links_of), "dst")
    assert count == 30000 and "skew=true" in plan


def test_visited_flags_split_a_hot_url(spark, small_partitions, links_of):
    visited = stage(links_of.select("url").distinct(), "visited")
    count, plan = run(crawl.is_visited(links_of, visited), "dst")
    assert count == 30000 and "skew=true" in plan


def test_a_hop_splits_a_hot_source(spark, small_partitions, links_of):
    edges = links_of.withColumnRenamed("url", "src")
    frontier = stage(links_of.select("url").distinct().withColumn("depth", F.lit(1)), "frontier")
    visited = spark.createDataFrame([("none",)], "url string")
    count, plan = run(crawl.expand_frontier(frontier, edges, ["example.com"], visited), "url")
    assert count == 30000 and "skew=true" in plan


def test_copies_of_a_hot_url_merge_before_the_shuffle(spark, small_partitions, links_of):
    frame = crawl.mark_visited(links_of, spark.createDataFrame([("none",)], "url string"))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert frame.count() == 20001
    assert plan.index("LeftAnti") < plan.index("HashAggregate(keys=[url") and "partial_count" in plan
    last = merge.latest_per_key(links_of, "url", ["dst"])
    assert "partial_max" in last._jdf.queryExecution().executedPlan().toString()
    assert last.count() == 20001


def batch_and_target(spark, links_of):
    rows = links_of.select("url", F.lit("t").alias("content_type"), F.col("dst").alias("raw_content"), "dst")
    return rows, spark.createDataFrame([(HOT, "t", "old", datetime(2024, 1, 1))], RAW_PAGES)


def test_upsert_merges_a_hot_url_before_the_shuffle(spark, small_partitions, links_of):
    rows, target = batch_and_target(spark, links_of)
    count, plan = run(merge.upsert_raw_pages(target, rows, ["dst"]), "raw_content")
    assert count == 20001 and "partial_max(struct" in plan and "LeftSemi" not in plan


def test_upsert_shuffles_only_repeated_urls_of_a_small_batch(spark, links_of):
    rows, target = batch_and_target(spark, links_of)
    count, plan = run(merge.upsert_raw_pages(target, rows, ["dst"]), "raw_content")
    assert count == 20001 and plan.count("hashpartitioning") == plan.count("hashpartitioning(url") and "LeftSemi" in plan
