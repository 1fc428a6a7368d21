from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from extractors import answer, answer_without_links, fail
from sitegrain.operators import extract, merge
from sitegrain.plans import jobs
from sitegrain.schemas import EXTRACTED_JOBS, RAW_PAGES
from sitegrain.sources.buckets import BucketTable
from sitegrain.sources.snapshots import SnapshotTable
from sitegrain.streaming.parse_stream import parse_stream

T0, T1, T2 = datetime(2024, 1, 1), datetime(2024, 1, 2), datetime(2024, 1, 3)


@pytest.fixture
def stores(spark, tmp_path):
    raw = SnapshotTable(spark, str(tmp_path / "raw"), RAW_PAGES, sort_by="url")
    extracted = SnapshotTable(spark, str(tmp_path / "extracted"), EXTRACTED_JOBS, sort_by="link", bloom=("company",))
    return raw, extracted, str(tmp_path / "failures")


def raw_pages(spark, *pages):
    return spark.createDataFrame([(url, "text/html", body, at) for url, body, at in pages], RAW_PAGES)


def now(time):
    return F.lit(time).cast("timestamp")


def test_parse_stores_then_deletes(spark, stores):
    raw, extracted, failures = stores
    raw.commit(raw_pages(spark, ("u0", "early", T0), ("u1", "one", T1), ("u2", "two+", T1), ("u3", "bad?", T2)))
    assert jobs.parse_to_extracted(raw, extracted, failures, answer, T1, now=now(T2)) == 3
    assert rows(extracted.read(), "title", "link") == [("TWO+", "u2"), ("one", "u1")]
    assert rows(raw.read(), "url") == [("u0",)]
    assert rows(spark.read.parquet(f"{failures}/*"), "url", "reason") == [("u3", "no_json")]
    assert jobs.parse_to_extracted(raw, extracted, failures, answer, T1) == 0


def test_parse_can_keep_record_links(spark, stores):
    raw, extracted, failures = stores
    raw.commit(raw_pages(spark, ("u1", "one", T1), ("u2", "two", T1)))
    jobs.parse_to_extracted(raw, extracted, failures, answer, T1, link_from="record", now=now(T2))
    assert rows(extracted.read(), "title", "link") == [("two", "/own")]


def test_a_failing_extractor_deletes_nothing(spark, stores):
    raw, extracted, failures = stores
    raw.commit(raw_pages(spark, ("u1", "one", T1)))
    with pytest.raises(Exception, match="model is away"):
        jobs.parse_to_extracted(raw, extracted, failures, fail, T0)
    assert raw.read().count() == 1 and extracted.versions() == []


def test_a_failing_store_deletes_nothing(spark, stores, monkeypatch):
    raw, extracted, failures = stores
    raw.commit(raw_pages(spark, ("u1", "one", T1)))

    def refuse(*_args, **_kwargs):
        raise OSError("disk full")

    monkeypatch.setattr(jobs.merge, "upsert_extracted", refuse)
    with pytest.raises(OSError):
        jobs.parse_to_extracted(raw, extracted, failures, answer, T0)
    assert raw.read().count() == 1


def test_a_page_fetched_again_meanwhile_stays(spark, stores):
    raw, extracted, failures = stores
    raw.commit(raw_pages(spark, ("u1", "one", T1)))
    used = jobs.parse_pages(raw.read(), answer).used
    raw.commit(raw_pages(spark, ("u1", "newer", T2)))
    assert merge.delete_by_urls(raw.read(), used, ("url", "fetched_at")).count() == 1


def test_crawl_to_raw(spark, urls_frame):
    home, about, gone, off = "https://example.com/", "https://example.com/about", "https://example.com/x", "https://off.org/"
    results = spark.createDataFrame(
        [
            (home, f'<a href="/about">a</a><a href="{off}">o</a><a href="/x">x</a>', 1),
            (about, "<p>old</p>", 2),
            (about, '<p>new</p><a href="/deep">d</a>', 3),
            (off, '<a href="https://example.com/deep">d</a>', 4),
            ("https://example.com/deep", "deep", 5),
        ],
        "url string, body string, seq int",
    )
    done = jobs.crawl_to_raw(urls_frame(home), results, ["example.com"], ["seq"], max_depth=2, now=F.lit(T1))
    assert rows(done.raw_pages, "url", "content_type", "fetched_at") == [
        (home, "text/html", T1), (about, "text/html", T1)
    ]
    assert rows(done.raw_pages.filter(F.col("url") == about), "raw_content") == [('<p>new</p><a href="/deep">d</a>',)]
    assert rows(done.visited, "url", "outcome") == [
        (home, "fetched"), (about, "fetched"), ("https://example.com/deep", "depth_exhausted"),
        (gone, "no_page"), (off, "off_domain"),
    ]
    stored = raw_pages(spark, (about, "stale", T0), ("https://example.com/kept", "k", T0))
    merged = jobs.crawl_to_raw(urls_frame(home), results, ["example.com"], ["seq"], 1, stored, F.lit(T1)).raw_pages
    assert rows(merged, "url", "fetched_at") == [(home, T1), (about, T0), ("https://example.com/kept", T0)]


def test_crawl_over_listing_results(spark, urls_frame):
    page = "<a class=j href='/job/1?ref=a'>1</a><a class=j href='/job/2#x'>2</a><div id=d>first</div><div id=d>second</div>"
    pages = spark.createDataFrame([("https://h.example.com/list", page)], "url string, html string")
    site = extract.SiteConfig(("a.j",), ("#d",), ignore_params=("ref",))
    results = extract.select_page_content(pages, site).withColumnRenamed("page_id", "result_url")
    done = jobs.crawl_to_raw(
        urls_frame("https://h.example.com/list"), results, ["example.com"], ["listing_pos", "data_pos"], now=F.lit(T1)
    )
    assert rows(done.raw_pages, "url", "raw_content") == [
        ("https://h.example.com/job/1", "second"),
        ("https://h.example.com/job/2", "second"),
    ]


def test_cards_to_extracted(spark):
    card = "<article data-testid='job-card'><a data-automation='jobTitle' href='{}'>{}</a></article>"
    pages = spark.createDataFrame(
        [
            ("https://h/p1", card.format("/job/1?ref=a#s", "old") + card.format("job/2", "two"), 1),
            ("https://h/p2", card.format("https://h/job/1", "new") + card.format("/%zz", "odd"), 2),
        ],
        "url string, html string, seq int",
    )
    empty = spark.createDataFrame([], EXTRACTED_JOBS)
    got = jobs.cards_to_extracted(pages, empty, ["seq"], now=now(T1))
    assert rows(got, "link", "title") == [("/%zz", "odd"), ("https://h/job/1", "new"), ("https://h/job/2", "two")]


def test_stream_takes_each_file_once(spark, stores, tmp_path):
    _, extracted, failures = stores
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")

    def run(*pages, fn=answer):
        raw_pages(spark, *pages).write.mode("append").parquet(folder)
        parse_stream(spark, folder, extracted, failures, checkpoint, fn, now=now(T2), files_per_batch=1).awaitTermination()

    extracted.commit(spark.createDataFrame([("kept", "c", "", "", "", "l", "", T0, T0)], EXTRACTED_JOBS))
    run(("u1", "one", T1))
    run(("u1", "again", T2), ("u3", "bad?", T2))
    assert rows(extracted.read(), "title", "link") == [("again", "u1"), ("kept", "l")]
    assert rows(spark.read.parquet(f"{failures}/*"), "url", "reason") == [("u3", "no_json")]
    with pytest.raises(Exception, match="model is away"):
        run(("u4", "four", T2), fn=fail)
    run(("u5", "five", T2))
    assert rows(extracted.read(), "title") == [("again",), ("five",), ("four",), ("kept",)]
    tags = [name.split("-", 1)[1] for _, name in extracted.versions() if "-" in name]
    assert len(tags) == len(set(tags)) and all("None" not in tag for tag in tags)


def test_cards_without_a_link_stay_apart(spark):
    card = "<article data-testid='job-card'><h3><a data-automation='jobTitle'>%s</a></h3></article>"
    pages = spark.createDataFrame([(f"https://h/{i}", card % "Baker" + card % "Cook", i) for i in range(3)], "url string, html string, page_id int")
    target = spark.createDataFrame([], EXTRACTED_JOBS)
    assert jobs.cards_to_extracted(pages, target, ["page_id"]).select("link").distinct().count() == 6


def test_records_without_a_link_stay_apart(spark, stores):
    raw, extracted, failures = stores
    raw.commit(raw_pages(spark, *[(f"u{i}", "one+two", T1) for i in range(3)]))
    jobs.parse_to_extracted(raw, extracted, failures, answer_without_links, T0, link_from="record", now=now(T2))
    got = {r.link for r in extracted.read().collect()}
    assert len(got) == 6 and all(link.startswith("u") for link in got)


def test_a_replayed_batch_deletes_once_and_only_as_read(spark, stores, tmp_path):
    _, extracted, failures = stores
    raw = BucketTable(spark, str(tmp_path / "pages"), RAW_PAGES, "url", buckets=4)
    folder, checkpoint = str(tmp_path / "in"), tmp_path / "checkpoint"

    def run():
        parse_stream(
            spark, folder, extracted, failures, str(checkpoint), answer, now=now(T2), raw=raw, consumed_path=str(tmp_path / "used")
        ).awaitTermination()

    pages = [("u1", "one", T1), ("u2", "two", T1), ("u3", "bad?", T1)]
    raw.commit(raw_pages(spark, *pages, ("u9", "kept", T1)))
    raw_pages(spark, *pages).write.parquet(folder)
    run()
    assert rows(raw.read(), "url") == [("u9",)] and rows(extracted.read(), "link") == [("u1",), ("u2",)]
    # u1 is fetched again; then the stream forgets that its batch was done, as after a crash.
    raw.append(raw_pages(spark, ("u1", "newer", T2), ("u2", "two", T1)))
    versions = raw.versions()
    for name in ("0", ".0.crc"):
        (checkpoint / "commits" / name).unlink()
    run()
    assert raw.versions() == versions and rows(raw.read(), "url") == [("u1",), ("u2",), ("u9",)]
    # A crash between storing records and deleting: the list is there, the deletion runs from it, and spares what is newer.
    tag = next(name.split("-", 1)[1] for _, name in versions if "-" in name)
    fresh = BucketTable(spark, str(tmp_path / "pages2"), RAW_PAGES, "url", buckets=4)
    fresh.commit(raw_pages(spark, ("u1", "newer", T2), ("u2", "two", T1), ("u3", "bad?", T1)))
    (checkpoint / "commits" / "0").unlink()
    (checkpoint / "commits" / ".0.crc").unlink()
    raw = fresh
    run()
    assert rows(fresh.read(), "url") == [("u1",)] and fresh.has(tag)
    with pytest.raises(ValueError):
        parse_stream(spark, folder, extracted, failures, str(checkpoint), answer, raw=raw)
