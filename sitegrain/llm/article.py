"""Main text of HTML pages by equivalence-class template deduction.

Tokens are block tags with their class, id and role, and whole text blocks, each with its tag path and its number among equals of the page.
Over the distinct pages of a host, tokens with the same occurrence vector (a hash of the pages that hold them) form a class. A class that
``share`` of the pages hold is kept with those of its tokens that stand in the same order on all its pages and nest into the same gap between
the tokens that all pages hold; these are the template. Its text blocks are no page's own, within article and main too. What is
left are the slots; those inside menus, headers, footers, sidebars, notices, adverts, forms, scripts and comments are dropped, told by their tag or by
a whole word of class, id or role. Copies of a page
count once, and a host with one distinct page has no template. A page with no text of its own in its article keeps the article.
Null or empty html: empty text.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.session import stage

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|template|noscript|textarea|title|svg|iframe|select)\b[^>]*>.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<![^>]*>|<\?[^>]*>", re.S | re.I)
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIP = frozenset("nav header footer aside form head dialog menu button figure".split()) - {"figure"}
_NOISE = re.compile(r"nav|navbar|navigation|menu|menus|breadcrumbs?|header|masthead|footer|sidebar|side|aside|widget|related|recommend(?:ed|ations)?|promo|advert|adverts|advertisement|ads?|sponsor(?:ed)?|banner|cookies?|consent|notice|notices|popup|modal|overlay|alert|newsletter|subscribe|signup|login|share|sharing|social|comments?|respond|replies|disqus|form|search|pagination|pager|toolbar|skip", re.I)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_UNSHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_SPACE = re.compile(r"\s+")


class _Element:
    """An open tag. ``bad``: noise by its tag or hidden. ``named``: noise by class, id or role. ``holds``: an article or main stands in it."""

    __slots__ = ("tag", "parent", "path", "bad", "named", "holds", "inside", "noisy")

    def __init__(self, tag: str, parent: "_Element | None", bad: bool, named: bool) -> None:
        self.tag, self.parent, self.bad, self.named, self.holds = tag, parent, bad, named, False
        self.path = f"{parent.path if parent else ''}/{tag}"

    def judge(self, cleared: bool) -> bool:
        """Set ``inside`` and ``noisy`` from the parent's; whether this is an article or main that counts."""
        inside, noisy = (self.parent.inside, self.parent.noisy) if self.parent else (False, False)
        spared = self.tag == "header" and inside or cleared and self.holds and (self.tag == "form" or not self.bad)
        main = self.tag in ("article", "main") and not noisy and not self.bad
        self.inside, self.noisy = inside or main, noisy or (self.bad or self.named) and not spared
        return main


def _noise(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """Class, id and role; whether the element is noise by its tag or hidden; whether a whole word of those makes it noise."""
    got: dict[str, str] = {}
    for x in _ATTR.finditer(attributes):
        got.setdefault(x[1].lower(), x[2] or x[3] or x[4] or "")
    words = " ".join(got[k] for k in ("class", "id", "role") if k in got)
    if tag in ("html", "body"):
        return words, False, False
    hidden = "hidden" in got or got.get("aria-hidden", "").strip().lower() == "true" or bool(_UNSHOWN.search(got.get("style", "")))
    return words, tag in _SKIP or hidden, tag not in ("article", "main") and any(map(_NOISE.fullmatch, words.split()))


def blocks(page: str | None) -> list[tuple[int, str | None, bool, bool]]:
    """Tokens in page order: hash, text (none for a tag), whether it stands in an article or main element, whether it stands in a part that is no main text.

    A name makes an ancestor of an article or main noise only if the page has another one outside such parts, as comments may be articles.
    """
    out: list[tuple[int, str | None, _Element | None]] = []
    every: list[_Element] = []
    stack: list[_Element] = []
    text: list[str] = []
    met: Counter[str] = Counter()

    def add(value: str, got: str | None) -> None:
        at = stack[-1] if stack else None
        key = f"{at.path if at else ''}\0{value}"
        met[key] += 1
        digest = blake2b(f"{key}\0{met[key]}".encode("utf-8", "surrogatepass"), digest_size=8).digest()
        out.append((int.from_bytes(digest, "little", signed=True), got, at))

    def flush() -> None:
        got = _SPACE.sub(" ", html.unescape("".join(text))).strip()
        text.clear()
        if got:
            add(got, got)

    at = 0
    for m in _TOKEN.finditer(page or ""):
        text.append(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            if m[1] and m[1].lower() == "title":
                flush()
            continue
        words, bad, named = "", False, False
        if not m[2]:
            words, bad, named = _noise(tag, m[4])
        if tag in _INLINE and not bad and not named and (not m[2] or not any(s.tag == tag for s in stack[-3:])):
            continue
        flush()
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("article", "main", "body", "nav", "footer", "aside") and tag in ("p", "li", "b", "i", "span", "a"):
                    break
        elif tag not in _VOID:
            if tag == "p" and stack and stack[-1].tag == "p":
                stack.pop()
            if tag in ("article", "main"):
                for s in reversed(stack):
                    if s.holds:
                        break
                    s.holds = True
            stack.append(_Element(tag, stack[-1] if stack else None, bad, named))
            every.append(stack[-1])
            add(f"<{words}>", None)
    text.append((page or "")[at:])
    flush()
    if not any([x.judge(False) for x in every]):
        for x in every:
            x.judge(True)
    return [(k, t, x.inside, x.noisy) if x else (k, t, False, False) for k, t, x in out]


_RANKS = 1 << 20


def misplaced(places: list[int]) -> list[int]:
    """Of a page's class * _RANKS + rank in page order, those outside the longest run of rising ranks of their class."""
    out, classes = [], {}
    for x in places:
        classes.setdefault(x // _RANKS, []).append(x)
    for run in classes.values():
        if all(x < y for x, y in zip(run, run[1:])):
            continue
        ends: list[int] = []
        last: list[int] = []
        before = [-1] * len(run)
        for i, x in enumerate(run):
            at = bisect_left(ends, x)
            before[i] = last[at - 1] if at else -1
            ends[at : at + 1] = [x]
            last[at : at + 1] = [i]
        kept, i = set(), last[-1]
        while i >= 0:
            kept.add(i)
            i = before[i]
        out += [x for i, x in enumerate(run) if i not in kept]
    return out


def template(parts: DataFrame, share: float) -> DataFrame:
    """(host, template): the template's tokens on each host, out of (host, page, tokens) with a row for each page; equal ``page`` are copies."""
    some = parts.filter(F.size("tokens") > 0)
    seen = some.select("host", "page", F.posexplode("tokens").alias("pos", "token")).distinct()
    tokens = seen.groupBy("host", "token").agg(F.bit_xor(F.xxhash64("page")).alias("vector"), F.count("*").alias("n"), F.avg("pos").alias("at"))
    sizes = some.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    held = tokens.join(sizes, "host").filter((F.col("n") >= 2) & (F.col("n") >= share * F.col("pages"))).withColumn("root", F.col("n") == F.col("pages"))
    # The pages of a class are the same for all its tokens, so means of their places rise where their order agrees.
    member = F.struct("root", "n", "vector", "at", "token")
    listed = held.groupBy("host").agg(F.array_sort(F.collect_list(member)).alias("found"))
    classes = F.array_distinct(F.transform("found", lambda x: F.struct(x["n"], x["vector"])))
    number = F.transform("found", lambda x, i: F.array_position("classes", F.struct(x["n"], x["vector"])) * _RANKS + i)
    first = listed.withColumn("classes", classes).select("host", F.map_from_arrays("found.token", number).alias("place"), F.transform(F.filter("found", lambda x: x["root"]), lambda x: x["token"]).alias("root"))
    first = stage(first, "classes")

    @F.pandas_udf("array<long>")
    def out_of_order(column: pd.Series) -> pd.Series:
        return pd.Series([misplaced(list(x)) for x in column], dtype=object)

    places = F.filter(F.transform("tokens", lambda t: F.element_at("place", t)), lambda x: x.isNotNull())
    wrong = some.join(first, "host").select("host", F.explode(out_of_order(places)).alias("place")).distinct()
    wrong = wrong.groupBy("host").agg(F.collect_list("place").alias("wrong"))
    right = first.join(wrong, "host", "left").withColumn("wrong", F.coalesce("wrong", F.array().cast("array<bigint>")))
    right = right.select("host", F.map_filter("place", lambda _, x: ~F.array_contains("wrong", x)).alias("place"), "root")
    right = stage(right.select("host", F.map_keys("place").alias("held"), F.array_intersect("root", F.map_keys("place")).alias("root")), "ordered")
    # The gap of a token is the number of the root's tokens before it.
    step = lambda a, t: F.struct((a["gap"] + F.array_contains("root", t).cast("int")).alias("gap"), F.when(F.array_contains("held", t), F.array_append(a["out"], F.struct(t.alias("token"), a["gap"].alias("gap")))).otherwise(a["out"]).alias("out"))
    start = F.struct(F.lit(0).alias("gap"), F.array().cast("array<struct<token:bigint,gap:int>>").alias("out"))
    gaps = some.join(right, "host").select("host", F.explode(F.aggregate("tokens", start, step)["out"]).alias("g")).select("host", "g.*")
    nested = gaps.groupBy("host", "token").agg(F.min("gap").alias("low"), F.max("gap").alias("high")).filter("low = high")
    return nested.groupBy("host").agg(F.collect_list("token").alias("template"))


def extract(pages: DataFrame, share: float = 0.5) -> DataFrame:
    """(page_id, url, text), a row for each row of ``pages``."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select("page_id", "url", "html", host.alias("host"))

    @F.pandas_udf("array<struct<token:long,text:string,inside:boolean,noisy:boolean>>")
    def cut(column: pd.Series) -> pd.Series:
        return pd.Series([[{"token": k, "text": t, "inside": i, "noisy": n} for k, t, i, n in blocks(p)] for p in column], dtype=object)

    found = rows.select("page_id", "url", "host", cut("html").alias("found"))
    tokens, texts = F.transform("found", lambda b: b["token"]), F.filter("found", lambda b: b["text"].isNotNull())
    clean = F.filter(texts, lambda b: ~b["noisy"])
    article = F.filter(clean, lambda b: b["inside"])
    # Only blocks that may be chosen are kept.
    kept = F.transform(F.when(F.size(article) > 0, article).otherwise(clean), lambda b: F.struct(b["token"].alias("token"), b["text"].alias("text")))
    parts = found.select("page_id", "url", "host", F.xxhash64(tokens).alias("page"), tokens.alias("tokens"), kept.alias("blocks"), (F.size(article) > 0).alias("inside"))
    parts = stage(parts, "blocks", "zstd")
    known = stage(template(parts.select("host", "page", "tokens"), share), "template")  # of known size, so that a small one is broadcast and the blocks stay in place
    both = parts.join(known, "host", "left")
    own = F.filter("blocks", lambda b: ~F.coalesce(F.array_contains("template", b["token"]), F.lit(False)))
    chosen = F.when((F.size(own) > 0) | ~F.col("inside"), own).otherwise(F.col("blocks"))
    return both.select("page_id", "url", F.array_join(F.transform(chosen, lambda b: b["text"]), " ").alias("text"))
