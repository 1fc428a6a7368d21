import re

import pytest
from pyspark.sql import functions as F

from conftest import rows
from sitegrain.operators import links


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(
        [
            ("https://a.example/x/", '<a href="/1">one</a><a>no</a><a href="">self</a><a href="2">two</a>'),
            ("https://b.example/", "<p>none</p>"),
            ("https://c.example/", None),
        ],
        "url string, html string",
    )


def test_extract_keeps_order_and_empty_links(pages):
    got = rows(links.extract_links(pages))
    assert got == [("https://a.example/x/", 0, "/1"), ("https://a.example/x/", 1, ""), ("https://a.example/x/", 2, "2")]


def test_resolve(pages):
    got = links.resolve_links(links.extract_links(pages))
    assert rows(got, "pos", "dst") == [
        (0, "https://a.example/1"),
        (1, "https://a.example/x/"),
        (2, "https://a.example/x/2"),
    ]


def test_page_targets_keep_every_page(pages):
    got = {row.src: row.dsts for row in links.page_targets(pages).collect()}
    assert got["https://b.example/"] == [] and got["https://c.example/"] is None
    assert got["https://a.example/x/"] == ["https://a.example/1", "https://a.example/x/", "https://a.example/x/2"]


def test_assign_page_id(spark):
    frame = spark.createDataFrame(
        [("https://h/p", "/job/1?ref=x", 0), ("https://h/p", " ", 1), ("https://h/p", None, 2), ("https://h/p", "/%zz", 3)],
        "url string, href string, pos int",
    )
    fixed = links.assign_page_id(frame, row_key=["pos"], ignore_params=["ref"])
    ids = [row.page_id for row in fixed.orderBy("pos").collect()]
    assert ids[0] == "https://h/job/1"
    assert all(re.fullmatch(r"https://h/p[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", x) for x in ids[1:])
    assert len(set(ids)) == 4
    assert ids == [row.page_id for row in fixed.orderBy("pos").collect()]
    loose = [row.page_id for row in links.assign_page_id(frame).collect()]
    assert len(set(loose)) == 4


def test_dedupe_by_canonical_url_with_a_hot_url(spark):
    copies = spark.range(300).select(
        F.concat(F.lit("https://h/hot?utm_id="), "id").alias("url"), F.col("id"), F.lit("body").alias("html")
    )
    others = spark.range(300, 900).select(F.concat(F.lit("https://h/"), "id").alias("url"), "id", F.lit("b").alias("html"))
    broken = spark.createDataFrame([("https://h h/", 900, "x")], "url string, id long, html string")
    got = links.dedupe_by_canonical_url(copies.union(others).union(broken), order=["id"])
    assert got.count() == 602
    assert rows(got.filter("canonical = 'https://h/hot'"), "id") == [(299,)]
    assert rows(got.filter("id = 900"), "canonical") == [("https://h h/",)]
    assert got.columns == ["url", "id", "html", "canonical"] or set(got.columns) == {"url", "id", "html", "canonical"}


def test_bytes_that_are_not_text_do_not_stop_a_job(spark):
    from sitegrain.operators import extract

    raw = spark.createDataFrame([(bytearray(b'<a href="/\xff">x\xfe</a>'),)], "html binary")
    pages = raw.select(F.lit("https://h/").alias("url"), "html")
    as_text = pages.withColumn("html", F.expr("cast(html as string)"))
    for frame in (pages, as_text):
        assert rows(links.resolve_links(links.extract_links(frame)), "dst") == [("https://h/%EF%BF%BD",)]
        assert rows(extract.clean_html_text(frame), "text") == [("x\ufffd",)]


def test_dedupe_keeps_one_row_whatever_the_order_holds(spark, tmp_path):
    data = [
        ("https://h/a", 1, "x"), ("https://h/a/", 1, "y"), ("https://h/a#f", 1, "z"),  # ties
        ("https://h/b", None, "x"), ("https://h/b", None, "y"),  # NULLs alone
        ("https://h/c", None, "x"), ("https://h/c", 2, "y"), ("https://h/c", 1, "z"),
        ("https://h/same", 3, "s"), ("https://h/same", 3, "s"),  # equal rows
        (None, 1, "n"), ("%zz", 1, "p"),
    ]
    frame = spark.createDataFrame(data, "url string, n int, body string")
    for pages in (frame, spark.read.schema(frame.schema).parquet(save(frame.repartition(3), tmp_path))):
        got = links.dedupe_by_canonical_url(pages, order=["n"])
        assert got.columns == ["url", "n", "body", "canonical"]
        kept = [tuple(r) for r in got.collect()]
        assert sorted(r[3] or "" for r in kept) == ["", "%zz", "https://h/a", "https://h/b", "https://h/c", "https://h/same"]
        assert next(r for r in kept if r[3] == "https://h/c")[1:3] == (2, "y")
    # Twice the same, though rows tie.
    stored = spark.read.parquet(f"{tmp_path}/pages")
    one, two = (sorted(map(str, links.dedupe_by_canonical_url(stored, order=["n"]).collect())) for _ in range(2))
    assert one == two


def save(frame, folder):
    frame.write.mode("overwrite").parquet(f"{folder}/pages")
    return f"{folder}/pages"
