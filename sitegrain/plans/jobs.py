"""The user-level jobs: crawl stored pages, parse them with an extractor, parse cards."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from datetime import datetime
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sitegrain.operators import crawl, extract, links, merge, stored
from sitegrain.operators.visits import VisitedSet
from sitegrain.schemas import RAW_PAGES
from sitegrain.session import fits_broadcast, stage
from sitegrain.sources.layout import Layout, lay_out
from sitegrain.sources.tables import scan_since

Extractor = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]

PAGE_CONTENT_TYPE = "text/html"
DEFAULT_DEPTH = 3


class CrawlResult(NamedTuple):
    raw_pages: DataFrame
    visited: DataFrame
    rejected: DataFrame


def _rows_of(results: DataFrame, urls: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A function that gives the rows of a list of distinct URLs; ``urls`` holds each URL of ``results`` once, staged.

    While the URLs, those of them that have rows, or those with rows that are not listed are few enough to broadcast, rows are picked
    where they lie. The first list beyond that has the rows laid out by URL, once; from then on only lists move.
    """
    laid: list[Layout] = []

    def rows(wanted: DataFrame) -> DataFrame:
        if not fits_broadcast(wanted) and not laid:
            wanted = stage(urls.join(wanted, "url", "left_semi"), "urls-hit")
            if not fits_broadcast(wanted):
                others = stage(urls.join(wanted, "url", "left_anti"), "urls-left")
                if fits_broadcast(others):
                    return results.filter(F.col("url").isNotNull()).join(others, "url", "left_anti")
                laid.append(lay_out(results, "url", "results"))
        return laid[0].joined(wanted) if laid else results.join(wanted, "url", "left_semi")

    return rows


def crawl_to_raw(
    seeds: DataFrame,
    results: DataFrame,
    allowed_domains: Iterable[str] | DataFrame,
    order: Sequence[str],
    max_depth: int = DEFAULT_DEPTH,
    target: DataFrame | stored.Table | None = None,
    now: Column | None = None,
    targets: Callable[[DataFrame], DataFrame] | None = None,
    known: VisitedSet | None = None,
) -> CrawlResult:
    """Crawl from the seeds over stored fetch results and merge what was fetched into ``raw_pages``.

    ``results`` holds ``url`` (as requested), ``body`` (text or bytes), the ``order`` columns and, if the content is
    stored under another name, ``result_url``; a URL may have several rows. Pages are parsed hop by hop: only those
    that are reached, each once. Stage ``results`` first if it is costly to compute, as each hop reads it. Of results
    stored under one name the last by ``order`` is kept; fetched results without a name or a body come back as ``rejected``.

    ``targets`` finds links: it turns ``(url, body, ...)`` into ``(src, dsts)``; by default those of ``a[href]``. URLs in ``known``
    are never entered, and those discovered are added to it.
    """
    if "result_url" not in results.columns:
        results = results.withColumn("result_url", F.col("url"))
    # Rows are far more than URLs, and each hop would else compare the URLs of all rows.
    urls = stage(results.select("url").filter("url is not null").distinct(), "result-urls")
    rows_of, links_of = _rows_of(results, urls), targets or (lambda pages: links.page_targets(pages, body="body"))

    def children(active: DataFrame) -> DataFrame:
        found = links.explode_udf(links_of(rows_of(active)), F.col("dsts"), "pos", "_to")
        return found.select(F.col("_to").alias("url"))

    walked = crawl.walk(seeds, children, urls, allowed_domains, max_depth, known=known, once=True)
    visited = stage(walked, "visited")
    fetched = rows_of(visited.filter("outcome = 'fetched'").select("url"))
    by = [f"_order_{i}" for i in range(len(order))]
    rows = fetched.select(
        F.col("result_url").alias("url"),
        F.lit(PAGE_CONTENT_TYPE).alias("content_type"),
        F.col("body").alias("raw_content"),
        *[F.col(name).alias(alias) for name, alias in zip(order, by)],
    )
    # Bodies are made readable behind the split, so that the test for NULL does not do it too.
    split = merge.split_incomplete(rows, ("url", "raw_content"))
    complete, incomplete = (part.withColumn("raw_content", links.readable("raw_content")) for part in split)
    if isinstance(target, stored.Table):
        stored.upsert_raw_pages(target, complete, by, now)
        merged = target.read()
    else:
        merged = merge.upsert_complete_pages(target, complete, by, now, rows.select("url"))
    if known is not None:
        known.add(visited)
    return CrawlResult(merged, visited, incomplete.drop(*by))


class ParseResult(NamedTuple):
    records: DataFrame
    failures: DataFrame
    used: DataFrame


RESPONSES = StructType([RAW_PAGES["url"], RAW_PAGES["fetched_at"], StructField("response", StringType())])


class ExtractorAway(RuntimeError):
    """An extractor answered none of a run's pages."""


def parse_pages(
    pages: DataFrame, fn: Extractor, use_clean: bool = False, link_from: str = "page", all_may_fail: bool = False
) -> ParseResult:
    """The parse step of P2: prompts, responses, decoding, and records apart from failures.

    ``fn`` turns batches of ``(url, fetched_at, prompt)`` into ``(url, fetched_at, response)``, one row
    for each. Its answers are decoded and staged before use, so that it is called once per page
    whatever reads them and whichever executors are lost later. A page it raises on, or does not answer, is a failure
    with the error as its reason; the others go on. When no page at all is answered, the extractor rather than a page is
    at fault: that raises, before anything is stored, unless ``all_may_fail``.
    """
    prompts = extract.build_prompts(pages, body="raw_content", use_clean=use_clean)
    asked = prompts.select("url", "fetched_at", "prompt")
    responses = extract.extract_apart(asked, fn, RESPONSES, ("url", "fetched_at"))
    parsed = stage(extract.parse_model_responses(responses), "parsed")
    pages_n, errors_n, error = parsed.agg(F.count("*"), F.count("error"), F.min("error")).first()
    if pages_n and pages_n == errors_n and not all_may_fail:
        raise ExtractorAway(error)
    good, failed = extract.split_parse_failures(parsed, error="error")
    records = extract.explode_page_jobs(
        good.select("url", "fetched_at", F.col("decoded.jobs").alias("jobs")), link_from=link_from
    )
    if link_from == "record":
        # Records without a link of their own stay apart: each gets an id from its page and place.
        own = F.when(F.btrim("link") != "", F.col("link"))
        place = links.page_id(F.col("url"), F.lit(""), F.lit(None).cast("string"), [F.col("pos")])
        records = records.withColumn("link", F.coalesce(own, place))
    return ParseResult(records, failed, parsed.select("url", "fetched_at"))


RECORD_ORDER = ("fetched_at", "url", "pos")


def parse_to_extracted(
    raw: stored.Table,
    extracted: stored.Table,
    failures_path: str,
    fn: Extractor,
    start: datetime | Column,
    use_clean: bool = False,
    link_from: str = "page",
    now: Column | None = None,
    all_may_fail: bool = False,
) -> int:
    """Parse the pages fetched since ``start``, merge the records, then delete the used pages.

    Failures are written first, then the merged records are committed, and only then are pages
    deleted, and only as read: one fetched again meanwhile stays. Run again after a crash, each step
    gives the same. Failures go to a folder named as the version read. Returns the number of pages used.
    """
    read = raw.versions()
    parsed = parse_pages(scan_since(raw.read(), start), fn, use_clean, link_from, all_may_fail)
    used = parsed.used.count()
    if not used:
        return 0
    parsed.failures.write.mode("overwrite").parquet(f"{failures_path}/{read[-1][1]}")
    stored.upsert_extracted(extracted, parsed.records, RECORD_ORDER, now)
    stored.delete_by_urls(raw, parsed.used, ("url", "fetched_at"))
    return used


def cards_to_extracted(
    pages: DataFrame,
    target: DataFrame,
    order: Sequence[str],
    site: extract.SiteConfig = extract.JOB_BOARD,
    container: str = extract.JOB_CARD,
    fields: dict[str, extract.Field] | None = None,
    url: str = "url",
    body: str = "html",
    now: Column | None = None,
) -> DataFrame:
    """Job cards of stored pages, keyed by canonical link, merged into ``extracted_jobs``.

    A link that does not parse is kept as written. A card without a link gets an id from its page and place.
    """
    cards = extract.extract_cards(pages.select(*dict.fromkeys([url, *order, body])), body, container, fields)
    fields = extract.JOB_CARD_FIELDS if fields is None else fields
    canonical = links.canonical_url(url, "link", site.ignore_params, site.root_prefixes)
    blanks = {name: F.lit("") for name in merge.JOB_TEXTS if name not in fields}
    place = links.page_id(F.col(url), F.lit(""), canonical, [F.col("pos")])
    linked = F.when(F.btrim("link") != "", F.coalesce(canonical, F.col("link"))).otherwise(place)
    rows = cards.withColumn("link", linked)
    return merge.upsert_extracted(target, rows.withColumns(blanks) if blanks else rows, [*order, "pos"], now)
