"""Plans that must hold at scale: one UDF pass, pushdown, no row moved that need not be."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sitegrain.operators import crawl, extract, keys, links, merge
from sitegrain.session import stage
from sitegrain.sources import tables

SF_DIR = "/root/testdata/sf0.001"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def pages(spark):
    return entry.table(spark, SF_DIR, "pages")


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", sorted(entry.library_queries()))
def test_no_pair_joins_and_no_windows(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF_DIR))
    for costly in ("CartesianProduct", "BroadcastNestedLoopJoin", "Window", "SinglePartition"):
        assert costly not in plan


def test_filters_on_results_do_not_run_the_udf_again(pages):
    frames = [
        links.resolve_links(links.extract_links(pages)).filter("dst like '%a%'"),
        extract.extract_cards(pages, container="article").filter("title = ''"),
        extract.clean_html_text(pages).filter("text <> ''"),
        links.canonicalize_urls(pages.select("url", F.lit("").alias("href"))).filter("canonical is not null"),
        extract.select_page_content(pages, extract.SiteConfig(("a",), ("h1",))).filter("body <> ''"),
        extract.parse_model_responses(pages.select(F.col("html").alias("response"))).filter("decoded.status = 'ok'"),
    ]
    for frame, passes in zip(frames, (2, 1, 1, 1, 1, 1)):
        assert plan_of(frame).count("ArrowEvalPython") == passes


def test_filters_and_pruning_reach_the_scan(spark, pages):
    plan = plan_of(extract.clean_html_text(pages).filter("page_id = 7").select("text"))
    assert "EqualTo(page_id,7)" in plan and "ReadSchema: struct<page_id:bigint,html:string>" in plan
    plan = plan_of(links.extract_links(pages).filter("url = 'x'").select("href"))
    assert "EqualTo(url,x)" in plan
    events = entry.event_pages(spark, SF_DIR)
    plan = plan_of(tables.scan_raw_pages(tables.scan_since(events, entry.timestamp(entry.HALFWAY))))
    assert "GreaterThanOrEqual(ts," in plan
    assert re.search(r"ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,props:string>", plan)


def test_crawl_dedupes_before_it_looks_up_visits(spark, urls_frame, no_broadcast):
    edges = spark.createDataFrame([("https://example.com/", "b")], "src string, dst string")
    frontier = urls_frame("https://example.com/").withColumn("depth", F.lit(1))
    plan = plan_of(crawl.expand_frontier(frontier, edges, ["example.com"], urls_frame("v")))
    assert plan.index("LeftAnti") < plan.index("HashAggregate")  # top down: the join reads the aggregate
    edge_side = plan[plan.index("Inner") :]
    assert edge_side.count("RLIKE") <= 6  # the domain test stands on the frontier alone
    assert plan.count("Exchange hashpartitioning") == 4


def test_a_small_batch_leaves_the_target_where_it_is(spark):
    pages = entry.event_pages(spark, SF_DIR)
    target = pages.select("url", "content_type", "raw_content", "fetched_at")
    plan = plan_of(merge.upsert_raw_pages(target, pages, ["event_id"]))
    assert plan.count("BroadcastHashJoin") == 3
    # Only copies of one URL move, to be merged.
    assert plan.count("hashpartitioning") == 1 and plan.index("LeftSemi") > plan.index("hashpartitioning")


def test_dedupe_moves_no_page_bodies(pages):
    plan = plan_of(links.dedupe_by_canonical_url(pages, order=["page_id"]))
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_a_long_list_moves_keys_rather_than_rows(spark, urls_frame):
    """Broadcast at most 2 kB: too little for the list, enough for the few keys hit or left."""
    body = F.sha2(F.col("id").cast("string"), 256)
    target = stage(spark.range(3000).select(F.col("id").cast("string").alias("url"), body.alias("body")), "target")
    nobody = target.limit(1).withColumn("url", F.lit(None).cast("string"))
    target = stage(target.union(nobody), "target")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2000")
    try:
        for first, last, want in ((2990, 9000, 2991), (10, 9000, 11), (1000, 9000, 1001)):
            listed = stage(spark.range(first, last).select(F.col("id").cast("string").alias("url")), "listed")
            for frame, size in (
                (keys.rows_without_keys(target, listed, ["url"]), want),
                (keys.rows_with_keys(target, listed, ["url"]), 3001 - want),
            ):
                moves = "SortMergeJoin" in plan_of(frame)
                assert (frame.count(), moves) == (size, first == 1000)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_short_table_is_matched_without_a_shuffle_of_a_long_list(spark):
    listed = stage(spark.range(5000).select(F.col("id").cast("string").alias("url")), "listed")
    table = spark.createDataFrame([("7", "a"), ("x", "b"), (None, "c")], "url string, body string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2000")
    try:
        assert [row.body for row in keys.rows_with_keys(table, listed, ["url"]).collect()] == ["a"]
        assert sorted(row.body for row in keys.rows_without_keys(table, listed, ["url"]).collect()) == ["b", "c"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_spread_leaves_large_tables_alone(spark, pages):
    assert tables.spread(pages).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 100, 1, 16)
    assert tables.spread(many) is many
