"""Links of plain pages, found and resolved in one pass, against the full rules."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from sitegrain.functions import html, targets, urls
from sitegrain.operators import merge
from sitegrain.plans import jobs
from sitegrain.session import stage

BASES = ["https://h.example/a/b", "http://h.example", "http://h.example/x//y/", "http://h/a.b/c", "http://u@h/x", "HTTP://h/x", "http://h/?q", "", "mailto:x"]
PARTS = (
    "<p>,</p>,text,<b>,<a>,</a>,<,<a href=/a/b>,<a href='../x/y?q=1'>,<a href=\"//o.example/z\">,<a href=https://k/l?a=b>,<a href=\"/a'>,<a href=..>"
    ",<a href='/.x'>,<a href=/q#f>,<A href=//h:80/a>,<a href=mailto:x>,<a href='/a b'>,<a href=/a/>,<a href=/a//b>,<a href='/&amp;'>,<a href=\"\">"
    ",<a HREF=/c>,<a class=x href=/d>,<title>,</title>,<styled>,<!--,-->,<br/>,\r"
).split(",")


def full(base, page):
    return list(dict.fromkeys(urls.to_text(p) if p else h for h, p in ((h, joined(base, h)) for h in html.hrefs(page))))


def joined(base, href):
    parent, ref = urls.split_url(base), urls.split_url(href)
    absolute = urls._ABSOLUTE.match(href)
    return None if absolute or parent is None or ref is None else urls.join(parent, ref)


def test_links_in_one_pass_are_those_of_the_full_rules():
    draw = random.Random(3)
    for _ in range(30_000):
        base, page = draw.choice(BASES), "".join(draw.choices(PARTS, k=draw.randrange(1, 7)))
        assert targets.page_targets(base, page) == full(base, page), (base, page)


def test_plain_pages_need_no_full_parse(monkeypatch):
    page = "<p><a href='/r/1'>r</a> <a href=\"../u/2\">u</a><a href=//o.example/3>o</a><a href=https://k.example/4>k</a><a href=/r/1>"
    want = ["https://h.example/r/1", "https://h.example/u/2", "https://o.example/3", "https://k.example/4"]
    monkeypatch.setattr(html, "hrefs", None)
    monkeypatch.setattr(urls, "resolve", None)
    assert targets.page_targets("https://h.example/s/5", page) == want


@pytest.mark.parametrize("href, want", [("/r", "https://h.example/r"), ("../u", "https://h.example/a/u"), ("//o.example/p", "https://o.example/p")])
def test_plain_bases_are_split_without_a_cache(monkeypatch, href, want):
    """A crawl of more pages than a cache holds would else parse each page's URL in full."""
    monkeypatch.setattr(urls, "_origin", None)
    monkeypatch.setattr(urls, "_above", None)
    assert urls.resolve("https://h.example/a/b/c", href) == want


def test_rows_of_nearly_all_urls_are_picked_where_they_lie(spark, monkeypatch):
    """Where the URLs left out are few enough to broadcast, results are not laid out anew."""
    monkeypatch.setattr(jobs, "lay_out", None)
    url = F.concat(F.lit("https://h.example/"), F.sha2(F.col("id").cast("string"), 256))
    data = spark.range(3000).select(F.when(F.col("id") != 7, url).alias("url"), F.lit("<p>x").alias("body"), "id")
    results = stage(data.union(data.filter("id % 3 = 0")), "results")
    seeds = stage(results.filter("id >= 3").select("url").union(spark.createDataFrame([("https://h.example/none",)], "url string")), "seeds")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")
    try:
        done = jobs.crawl_to_raw(seeds, results, ["h.example"], ["id"], 1, now=F.lit("2024-05-01 00:00:00").cast("timestamp_ntz"))
        wanted = results.filter("id >= 3 and url is not null").select("url").distinct()
        assert rows(done.raw_pages, "url") == rows(wanted) and wanted.count() == 2996
        outcomes = {r.outcome: r["count"] for r in done.visited.groupBy("outcome").count().collect()}
        assert outcomes == {"fetched": 2996, "no_page": 1}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_complete_rows_are_told_by_plain_tests(spark):
    data = [("a", "x"), (None, "x"), ("b", None), (None, None)]
    given = stage(spark.createDataFrame(data, "url string, raw_content string"), "given")
    complete, rejected = merge.split_incomplete(given, ("url", "raw_content"))
    assert rows(complete) == [("a", "x")]
    assert sorted(r.reason for r in rejected.collect()) == ["missing: raw_content", "missing: url", "missing: url, raw_content"]
    plan = complete._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(raw_content)" in plan and "array" not in plan
