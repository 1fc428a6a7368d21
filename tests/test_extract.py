import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from extractors import count_letters
from sitegrain.functions.responses import decode_records
from sitegrain.operators import extract

CARD = """<article data-testid='job-card'><h3><a data-automation='jobTitle' href="/job/1?a=1&amp;b=2">Baker</a></h3>
<a data-automation='jobCompany'>Bread &amp; Co</a><span data-automation='jobLocation'>North</span>,
<span data-automation='jobLocation'>South</span><span data-automation='jobSalary'>$50 – $60</span></article>"""


def page_frame(spark, *pages):
    return spark.createDataFrame([(f"https://h/{i}", page) for i, page in enumerate(pages)], "url string, html string")


def test_cards(spark):
    second = CARD.replace("Baker", " Cook ").replace("</article>", "<p data-automation='jobDescription'>\n bakes \u00a0</p></article>")
    got = extract.extract_cards(page_frame(spark, CARD + second, "", "<div><p>none</p></div>", None)).orderBy("pos").collect()
    assert [row.asDict() for row in got] == [
        {"url": "https://h/0", "pos": 0, "title": "Baker", "company": "Bread & Co", "location": "NorthSouth",
         "salary": "$50 – $60", "description": "", "link": "/job/1?a=1&b=2", "skills": []},
        {"url": "https://h/0", "pos": 1, "title": " Cook ", "company": "Bread & Co", "location": "NorthSouth",
         "salary": "$50 – $60", "description": "bakes", "link": "/job/1?a=1&b=2", "skills": []},
    ]


def test_bad_selector_fails_before_any_job(spark):
    with pytest.raises(ValueError):
        extract.extract_cards(page_frame(spark, ""), container="a:hover")


@pytest.mark.parametrize(
    "page, want",
    [
        ("<h1>Rye</h1><script async>if (a < b) { bake(); }</script>", "Rye"),
        ("<style media=print>h1 > em { margin: 0 }</style><em>Oats</em>", "Oats"),
        ("<li>salt\r\n<li>flour\n\n\n\n<li>yeast", "salt\n\nflour\n\nyeast"),
        ("", ""),
        ("\r\n\r\n\t", ""),
        ("<p>a\n\u00a0\u2003\t\n b\u00a0</p>", "a\n\nb"),
        ("<title>T</title><p>x<!-- gone --></p>", "Tx"),
        ("<p>one</p><p>two</p>", "onetwo"),
        ("<nav>n<nav>m</nav>n</nav>a<footer>f</footer><iframe>i</iframe><noscript><p>s</p></noscript>b", "ab"),
        ("<script>document.write('<p>no</p>')</script>yes", "yes"),
    ],
)
def test_clean_text(spark, page, want):
    assert rows(extract.clean_html_text(page_frame(spark, page)), "text") == [(want,)]


def test_prompts(spark):
    pages = page_frame(spark, "<p>a</p>\n<script>x</script>b")
    assert rows(extract.build_prompts(pages), "prompt") == [(extract.PROMPT + "<p>a</p>\n<script>x</script>b",)]
    assert rows(extract.build_prompts(pages, use_clean=True), "prompt") == [(extract.PROMPT + "a\n\nb",)]


JOB = '{"job_title": "Baker", "company_name": "B", "required_skills": ["x", "y"], "links": "/1"}'


@pytest.mark.parametrize(
    "response, status, titles",
    [
        (f"Text\n```json\n[{JOB}, {JOB}]\n```\nmore", "ok", ["Baker", "Baker"]),
        (f"```json[{JOB}]```\n```json\n[]\n```", "ok", ["Baker"]),
        ("```json\n \u00a0\n```", "empty", []),
        ("```json\n[]\n```", "no_json", []),
        ("```json\nnull\n```", "no_json", []),
        (f"[{JOB}]", "no_json", []),
        ("```\n[]\n```", "no_json", []),
        ("", "no_json", []),
        (None, "no_json", []),
        (f"```json\n{JOB}\n```", "bad_json", []),
        ('```json\n[{"job_title": 5}]\n```', "bad_json", []),
        ('```json\n[{"required_skills": "x"}]\n```', "bad_json", []),
        (f"```json\n[{JOB}, \n```", "bad_json", []),
        (f"```json\n[{JOB}] junk\n```", "bad_json", []),
        ('```json\n[{"job_title": NaN}]\n```', "bad_json", []),
        ("```json\n" + "[" * 50000 + "\n```", "bad_json", []),
        ('```json\n[{"JOB_TITLE": "Cook", "extra": {"a": [1e999]}}]\n```', "ok", ["Cook"]),
        ("```json\n[{}, null]\n```", "ok", ["", ""]),
        ('```json\n[{"job_title": "\\ud83d"}]\n```', "ok", ["\ufffd"]),
        ('```json\n[{"job_title": "a", "Job_Title": null}]\n```', "ok", ["a"]),
    ],
)
def test_decoding(spark, response, status, titles):
    frame = spark.createDataFrame([(response,)], "response string")
    row = extract.parse_model_responses(frame).select("decoded.*").first()
    assert (row.status, [job.job_title for job in row.jobs]) == (status, titles)


@given(st.lists(st.fixed_dictionaries({"job_title": st.text(), "required_skills": st.lists(st.text())}), min_size=1))
def test_what_json_can_spell_comes_back(jobs):
    status, got = decode_records(json.dumps(jobs))
    assert status == "ok"
    assert [(job["job_title"], job["required_skills"]) for job in got] == [
        (job["job_title"], job["required_skills"]) for job in jobs
    ]


def test_unescape_links(spark):
    links = ["//shop.test/rye&oats", "/bread?size=2&amp;cut=thin", "", None, "&lt;t&gt;&#39;"]
    got = extract.unescape_links(spark.createDataFrame(list(enumerate(links)), "i int, link string"))
    assert [row.link for row in got.orderBy("i").collect()] == [
        "//shop.test/rye&oats", "/bread?size=2&cut=thin", "", None, "<t>'"
    ]


def test_jobs_and_failures(spark):
    answers = [f'```json\n[{JOB}, {{"job_title": "Cook", "links": "/2?a&amp;b"}}]\n```', "no", "```json\n```", "```json\n{}\n```"]
    frame = spark.createDataFrame([(f"https://h/{i}", a) for i, a in enumerate(answers)], "url string, response string")
    good, failed = extract.split_parse_failures(extract.parse_model_responses(frame))
    assert rows(failed, "url", "reason") == [("https://h/1", "no_json"), ("https://h/3", "bad_json")]
    jobs = good.select("url", F.col("decoded.jobs").alias("jobs"))
    assert rows(extract.explode_page_jobs(jobs), "pos", "title", "link") == [
        (0, "Baker", "https://h/0"),
        (1, "Cook", "https://h/0"),
    ]
    assert rows(extract.explode_page_jobs(jobs, link_from="record"), "pos", "link") == [(0, "/1"), (1, "/2?a&b")]


BOARD = """<main><section><h2>Kitchen</h2><a class="post wide" href="open/kitchen-7">Sous chef</a></section>
<section><h2>Garden</h2><a class="post" href="open/garden-2">Pruner</a><a class="post" href="open/garden-9">Mower</a></section>
<p id="pay">by the hour</p><p id="place">indoors</p></main>"""
POST = "a.post"


@pytest.mark.parametrize(
    "page, listings, data, want",
    [
        (BOARD, ("a.wide", "a.narrow"), ("#bonus", "#place"), 1),
        (BOARD, (POST,), (), 0),
        (BOARD, (), ("#pay",), 0),
        (BOARD, (POST,), ("#bonus",), 0),
        (BOARD, (POST,), ("#pay", "#place"), 6),
    ],
)
def test_page_content(spark, page, listings, data, want):
    found = extract.select_page_content(page_frame(spark, page, "", None), extract.SiteConfig(listings, data))
    assert found.count() == want
    if want == 6:
        assert rows(found.filter("listing_pos = 2"), "data_pos", "page_id", "body") == [
            (0, "https://h/open/garden-9", "by the hour"), (1, "https://h/open/garden-9", "indoors")
        ]


def test_page_content_ids(spark):
    page = "<a class=j href='job/1?ref=x'>1</a><a class=j>2</a><p id=d>t</p>"
    site = extract.SiteConfig(("a.j",), ("#d",), ignore_params=("ref",), root_prefixes=("job/",))
    ids = [row.page_id for row in extract.select_page_content(page_frame(spark, page), site).orderBy("listing_pos").collect()]
    assert ids[0] == "https://h/job/1" and ids[1].startswith("https://h/0") and len(ids[1]) == len("https://h/0") + 36


def test_title_links(spark):
    page = "<a id='job-title-1'>One &amp; all</a><a id='other'>no</a><a id='x-job-title'>Two</a>"
    assert rows(extract.select_title_links(page_frame(spark, page)), "url", "pos", "body", "status") == [
        ("https://h/0", 0, "One & all", 200),
        ("https://h/0", 1, "Two", 200),
    ]


def test_extract_with(spark):
    got = extract.extract_with(page_frame(spark, "abc", ""), count_letters, "url string, n long")
    assert rows(got) == [("https://h/0", 3), ("https://h/1", 0)]


def test_listings_and_content_apart_store_each_text_once(spark):
    page = "<a class=j href='/1'>1</a><a class=j href='/2'>2</a><a class=j href='/3'>3</a><div id=d>first</div><div id=d>second</div>"
    data = [("https://h/a", page, 1), ("https://h/b", page, 2), ("https://h/c", "<a class=j href='/4'>", 3), ("https://h/d", None, 4), ("https://h/e", page.replace("first", "x" * 50_000), 5)]
    pages = spark.createDataFrame(data, "url string, html string, page_id int")
    site = extract.SiteConfig(("a.j",), ("#d",))
    apart = extract.split_page_content(pages, site)
    assert apart.listings.columns == ["url", "page_id", "data_id", "listing_pos", "href", "content_id", "status"]
    assert apart.content.columns == ["data_id", "data_pos", "body"] and apart.content.count() == 4 and apart.listings.count() == 9
    whole = extract.select_page_content(pages, site)
    assert rows(apart.listings.join(apart.content, "data_id").select(*whole.columns)) == rows(whole)
    assert sum(len(r.body) for r in apart.content.collect()) < 50_100 < sum(len(r.body) for r in whole.collect()) / 2
