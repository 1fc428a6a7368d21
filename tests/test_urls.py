import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from sitegrain.functions import urls
from sitegrain.operators import links

IGNORED = ["sol", "ref", "origin"]


@pytest.mark.parametrize(
    "base, href, want",
    [
        ("http://mill.test/flour/", "/oven/hot", "http://mill.test/oven/hot"),
        ("http://mill.test/flour/", "https://shop.test/loaf", "https://shop.test/loaf"),
        ("http://mill.test/flour/", "//cdn.test/i/1.png", "http://cdn.test/i/1.png"),
        ("http://mill.test/flour/rye", "wheat", "http://mill.test/flour/wheat"),
        ("https://e.com/a/b?x=1#f", "?y=2", "https://e.com/a/b?y=2"),
        ("https://e.com/a/b?x=1#f", "#g", "https://e.com/a/b?x=1#g"),
        ("https://e.com/a/b?x=1#f", "", "https://e.com/a/b?x=1#f"),
        ("https://e.com/a/b/", "../../../c/./d/..", "https://e.com/c/"),
        ("https://e.com/a", "/für?q=ü#ß", "https://e.com/f%C3%BCr?q=ü#%C3%9F"),
        ("https://e.com/a", "/a%2fb", "https://e.com/a%2fb"),
        ("https://e.com/a", "/a b!", "https://e.com/a%20b%21"),
        ("https://e.com/a", "HTTP://E.com/../x", "HTTP://E.com/../x"),
        ("https://e.com/a", "mailto:x@y.z", "mailto:x@y.z"),
        ("https://e.com/a", "javascript:void(0)", "javascript:void(0)"),
        ("https://e.com/a", "1:b", "1:b"),
        ("https://e.com/a", ":b", ":b"),
        ("https://e.com/a", "/%zz", "/%zz"),
        ("https://e.com/a", "/tab\tbed", "/tab\tbed"),
        ("https://e.com/a", "//bad host/", "//bad host/"),
        ("https://e.com/a", "/x?", "https://e.com/x?"),
        ("not a\nbase", "/x", "/x"),
        ("https://u:p@e.com:8080/a", "b", "https://u:p@e.com:8080/b"),
        ("https://münchen.de/", "x", "https://m%C3%BCnchen.de/x"),
    ],
)
def test_resolve(base, href, want):
    assert urls.resolve(base, href) == want


@given(st.text(alphabet="aZ0/.?&=#%ü;:@!-_ ", max_size=20))
def test_the_short_way_resolves_alike(href):
    base = "HTTPS://u@Host.example:81/a/b?c#d"
    parent, ref = urls.split_url(base), urls.split_url("/" + href)
    want = "/" + href if ref is None else urls.to_text(urls.join(parent, ref))
    assert urls.resolve(base, "/" + href) == want


@pytest.mark.parametrize(
    "base, href, want",
    [
        ("https://MILL/a/b", "/rye?origin=x&cut=thin&sol=1#ref=9", "https://mill/rye?cut=thin"),
        ("https://MILL/a/b", "job/rye?ref=x", "https://mill/job/rye"),
        ("https://mill.test/", "//SHOP.test/loaf?utm_term=q&n=3&utm_id=8", "https://shop.test/loaf?n=3"),
        ("https://mill.test/a/b/c", "../rye?z=1#top", "https://mill.test/a/rye?z=1"),
        ("https://h", "", "https://h/"),
        ("https://h:443/x", "", "https://h/x"),
        ("http://h:80", "", "http://h/"),
        ("https://h:80/", "", "https://h:80/"),
        ("https://h:8443/", "", "https://h:8443/"),
        ("https://h/", "/a//b/../c/", "https://h/a/c"),
        ("https://h/", "?b=2&a=1&a=0", "https://h/?a=1&a=0&b=2"),
        ("https://h/", "?UTM_X=1&Ref=2&y", "https://h/?y="),
        ("https://h/", "?q=a b&r=~*+%41&bad=%zz&semi=1;2", "https://h/?q=a+b&r=~%2A+A"),
        ("https://h/", "/für/", "https://h/f%C3%BCr"),
        ("https://h/", "/%FF/", "https://h/%FF"),
        ("https://h/", "  /x\n", "https://h/x"),
        ("https://h/", "/%zz", None),
        ("https://h h/", "/x", None),
        ("https://h/a", "mailto:A@b", "mailto:A@b"),
        ("HTTPS://U@Ex.COM/A", "", "https://U@ex.com/A"),
    ],
)
def test_canonicalize(base, href, want):
    assert urls.canonicalize(base, href, urls.ignored_names(IGNORED), ["job/", " "]) == want


PIECE = st.text(alphabet="aZ0/.?&=#%+~ü;:@!-_", max_size=30)


@given(PIECE)
def test_canonical_form_is_stable(path):
    once = urls.canonicalize("https://h.example/x/y", path, frozenset({"a"}), [])
    if once is not None and once.startswith("https://h.example/"):
        assert urls.canonicalize("https://h.example/x/y", once, frozenset({"a"}), []) == once


def test_native_query_work_agrees_with_the_row_helper(spark):
    queries = ["", "b=2&a=1&a=0", "utm_x=1&Ref=3&y", "q=a b&r=~*+%41", "bad=%zz&ok=1", "s=1;2&t=3", "ü=ß&=v&&k", "a=b=c"]
    got = spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "i int, q string").select(
        "i", urls.strip_tracking_params(F.col("q"), IGNORED).alias("q")
    )
    dropped = urls.ignored_names(IGNORED)
    assert rows(got) == [(i, urls._encode_query(q, dropped)) for i, q in enumerate(queries)]


HOSTS = [
    ("https://example.com/page", "example.com"),
    ("https://sub.example.com?x", "sub.example.com"),
    ("http://a_b.example.com:8080/x|y", "a_b.example.com"),
    ("//h.example.com#f", "h.example.com"),
    ("https://user:pw@example.com/", "example.com"),
    ("https://[::1]:80/x", "::1"),
    ("https://münchen.de/", "münchen.de"),
    ("/about", ""),
    ("mailto:a@example.com", ""),
    ("https://exa mple.com/", ""),
    ("https://example.com:port/", ""),
    ("https://example.com/%zz", ""),
    ("https://example.com/%41?%zz", "example.com"),
    ("https://exam%70le.com/", ""),
    ("https://example.com/a\tb", ""),
    ("", ""),
]


def test_url_host(spark):
    got = spark.createDataFrame([(url,) for url, _ in HOSTS], "url string").select("url", urls.url_host(F.col("url")))
    assert rows(got) == sorted(HOSTS)


CASES = [
    ("https://example.com/page", ["example.com", "other.com"], True),
    ("https://bad.com/page", ["example.com", "other.com", "bads.com"], False),
    ("https://sub.example.com/page", ["example.com"], True),
    ("/about", ["example.com"], False),
    ("https://notexample.com/", ["example.com"], False),
    ("https://EXAMPLE.com/", ["example.com"], False),
    ("http://a_b.example.com:8080/x", ["example.com"], True),
    ("https://exampleXcom/", ["example.com"], False),
    ("https://example.com.evil.org/", ["example.com"], False),
    ("https://evil.org/?https://example.com/", ["example.com"], False),
    ("https://example.com@evil.org/", ["example.com"], False),
    ("https://example.com/%zz", ["example.com"], False),
    ("https://example.com/", [], False),
]


@pytest.mark.parametrize("url, domains, want", CASES)
def test_allowed_domains(spark, url, domains, want):
    frame = spark.createDataFrame([(url,)], "dst string")
    assert (links.filter_allowed_domains(frame, domains).count() == 1) is want
    table = spark.createDataFrame([(domain,) for domain in domains], "domain string")
    assert (links.filter_allowed_domains(frame, table).count() == 1) is want


def test_queries_are_the_same_by_columns_and_by_bytes(spark):
    """L9 and L8 agree on any bytes."""
    draw = random.Random(8)
    part = lambda: "".join(draw.choice(["a", "b", "%41", "%ff", "%C3%a9", "é", "+", "%20", "%2B", "%00", "~", "*", "%7e", "-", "_", ".", "%", "%zz", "UTM_x", "ref", "REF", "/", "%C3"]) for _ in range(draw.randint(0, 4)))
    queries = ["&".join(part() + draw.choice(["", "=", "=" + part()]) for _ in range(draw.randint(0, 5))) for _ in range(600)]
    queries += ["x=%FF", "x=%ff&x=%FE", "%FFa=1&%C3%A9=2&%FF=3", "a;b=1&c", "=&=1", "&&"]
    frame = spark.createDataFrame([(q,) for q in queries], "q string")
    got = frame.select("q", urls.strip_tracking_params(F.col("q"), IGNORED).alias("s")).collect()
    assert {r.q: r.s for r in got} == {q: urls._encode_query(q, urls.ignored_names(IGNORED)) for q in queries}
    assert {r.q: r.s for r in got}["x=%FF"] == "x=%FF"


def test_common_links_are_not_split_and_joined(monkeypatch):
    """Links to another host and links upward resolve without a full parse; results are those of the full one."""
    links_of = ["//other.example.com/a/b.c?d=e", "../part/17", "../x/?q=1", "/rooted/1", "https://h/1"]
    bases = ["https://shop.example.com/supplier/4", "http://h.example/a/b/../c/", "http://h.example", "http://u@h.example:81/a/b?q#f"]
    full = lambda base, href: urls.to_text(urls.join(urls.split_url(base), urls.split_url(href)))
    assert [[urls.resolve(b, h) for h in links_of] for b in bases] == [[full(b, h) for h in links_of] for b in bases]
    assert urls.resolve("http://h/%zz", "../a") == "../a" and urls.resolve("", "//h/a") == "//h/a"
    parsed = []
    monkeypatch.setattr(urls, "split_url", lambda text: parsed.append(text))
    for href in links_of:
        urls.resolve(bases[0], href)
    assert not parsed


def test_above_of_odd_bases():
    for base in ("mailto:x", "a/b/c", "", "//h/x/y", "http:///a", "http://h/..", "x:/a//b/"):
        assert urls.resolve(base, "../a") == urls.resolve(base, "./../a"), base
