from collections import deque

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from sitegrain.operators import crawl

HOST = "https://example.com"


def edges_of(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def outcomes(frame):
    return {row.url: (row.hop, row.depth_left, row.outcome) for row in frame.collect()}


def test_mark_visited(spark, urls_frame):
    nothing = urls_frame()
    many = urls_frame(*[f"{HOST}/{i}" for i in range(100)])
    assert crawl.mark_visited(many, nothing).count() == 100
    assert rows(crawl.mark_visited(urls_frame(*[HOST] * 100, None), nothing)) == [(HOST,)]
    assert rows(crawl.mark_visited(urls_frame("x", "x#a", "y"), urls_frame("x"))) == [("x#a",), ("y",)]


def test_is_visited(urls_frame):
    got = crawl.is_visited(urls_frame(HOST, "https://other.com", HOST), urls_frame(HOST))
    assert rows(got) == [(HOST, True), (HOST, True), ("https://other.com", False)]


def test_fetch_returns_every_row_of_a_url(spark, urls_frame):
    pages = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "url string, n int")
    assert rows(crawl.fetch_stored_pages(urls_frame("a", "a", "c"), pages)) == [("a", 1), ("a", 2)]


def test_depth_one_discovers_but_does_not_fetch_links(spark, urls_frame):
    edges = edges_of(spark, (HOST, f"{HOST}/about"), (HOST, f"{HOST}/contact"))
    got = outcomes(crawl.crawl_bounded(urls_frame(HOST), edges, ["example.com"], 1))
    assert got == {
        HOST: (0, 1, "fetched"),
        f"{HOST}/about": (1, 0, "depth_exhausted"),
        f"{HOST}/contact": (1, 0, "depth_exhausted"),
    }


def test_depth_zero_fetches_nothing(spark, urls_frame):
    got = outcomes(crawl.crawl_bounded(urls_frame(HOST), edges_of(spark, (HOST, "x")), ["example.com"], 0))
    assert got == {HOST: (0, 0, "depth_exhausted")}


def test_outcomes_cycles_and_shortest_path(spark, urls_frame):
    a, b, c, off, gone = (f"{HOST}/a", f"{HOST}/b", f"{HOST}/c", "https://off.org/", f"{HOST}/gone")
    edges = edges_of(spark, (a, b), (b, c), (c, a), (a, c), (c, off), (off, f"{HOST}/never"), (b, gone))
    got = outcomes(crawl.crawl_bounded(urls_frame(a), edges, ["example.com"], 3))
    assert got == {
        a: (0, 3, "fetched"),
        b: (1, 2, "fetched"),
        c: (1, 2, "fetched"),
        off: (2, 1, "off_domain"),
        gone: (2, 1, "no_page"),
    }


def test_two_seeds_and_prior_visits(spark, urls_frame):
    a, b, c = f"{HOST}/a", f"{HOST}/b", f"{HOST}/c"
    edges = edges_of(spark, (a, b), (b, c))
    got = outcomes(crawl.crawl_bounded(urls_frame(a, b, b), edges, ["example.com"], 2))
    assert got[b] == (0, 2, "fetched") and got[c] == (1, 1, "no_page")
    assert crawl.crawl_bounded(urls_frame(a), edges, ["example.com"], 2, visited=urls_frame(a)).count() == 0
    got = outcomes(crawl.crawl_bounded(urls_frame(a), edges, ["example.com"], 2, visited=urls_frame(b)))
    assert set(got) == {a}


def test_link_arrays_and_pairs_agree(spark, urls_frame):
    a, b, c = f"{HOST}/a", f"{HOST}/b", f"{HOST}/c"
    arrays = spark.createDataFrame([(a, [b, c, b]), (b, []), (c, None)], "src string, dsts array<string>")
    got = outcomes(crawl.crawl_bounded(urls_frame(a), arrays, ["example.com"], 2))
    assert got == {a: (0, 2, "fetched"), b: (1, 1, "fetched"), c: (1, 1, "fetched")}


def test_hot_target_and_hot_source(spark, urls_frame):
    hub = f"{HOST}/hub"
    out = spark.range(2000).select(F.lit(hub).alias("src"), F.concat(F.lit(f"{HOST}/"), "id").alias("dst"))
    back = out.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    got = crawl.crawl_bounded(urls_frame(hub), out.union(back), ["example.com"], 3)
    assert rows(got.groupBy("hop", "outcome").count()) == [(0, "fetched", 1), (1, "fetched", 2000)]


def breadth_first(pairs, seeds, max_depth):
    hops, queue = {seed: 0 for seed in seeds}, deque(seeds)
    while queue:
        node = queue.popleft()
        if hops[node] < max_depth and node.startswith(HOST):
            for src, dst in pairs:
                if src == node and dst not in hops:
                    hops[dst] = hops[node] + 1
                    queue.append(dst)
    return hops


NODES = [f"{HOST}/{i}" for i in range(6)] + ["https://off.org/0", "https://off.org/1"]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.sampled_from(NODES), st.sampled_from(NODES)), min_size=1, max_size=14),
    st.lists(st.sampled_from(NODES), min_size=1, max_size=2, unique=True),
    st.integers(0, 3),
)
def test_equals_plain_breadth_first_search(spark, pairs, seeds, max_depth):
    got = crawl.crawl_bounded(
        spark.createDataFrame([(seed,) for seed in seeds], "url string"), edges_of(spark, *pairs), ["example.com"], max_depth
    )
    assert {row.url: row.hop for row in got.collect()} == breadth_first(pairs, seeds, max_depth)


def test_a_url_visited_twice_gives_no_second_row(spark, urls_frame):
    got = crawl.is_visited(urls_frame("a", "b"), urls_frame("a", "a"))
    assert rows(got) == [("a", True), ("b", False)]
