"""Text, records and page content from stored HTML, and records from model responses."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from html import unescape
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from sitegrain.functions import html, urls
from sitegrain.functions.responses import decode_records
from sitegrain.functions.selectors import compile_selector, select
from sitegrain.operators.links import explode_udf, page_id, readable, with_udf
from sitegrain.schemas import DECODED_RESPONSE
from sitegrain.session import stage


@dataclass(frozen=True)
class Field:
    """Where a record field comes from: the text of all matches, or an attribute of the first."""

    selector: str
    attribute: str | None = None
    trim: bool = False


# Selectors of a job card and its fields, and of content to drop.
JOB_CARD = "article[data-testid='job-card']"
JOB_CARD_FIELDS = {
    "title": Field("a[data-automation='jobTitle']"),
    "company": Field("a[data-automation='jobCompany']"),
    "location": Field("[data-automation='jobLocation']"),
    "salary": Field("[data-automation='jobSalary']"),
    "description": Field("[data-automation='jobDescription']", trim=True),
    "link": Field("a[data-automation='jobTitle']", attribute="href"),
}
NO_TEXT_TAGS = frozenset("script style nav footer iframe noscript".split())
TITLE_LINK = "a[id*='job-title']"


@dataclass(frozen=True)
class SiteConfig:
    """How listings, their content and their ids are found on a site's pages."""

    listing_selectors: tuple[str, ...] = ()
    data_selectors: tuple[str, ...] = ()
    ignore_params: tuple[str, ...] = ()
    root_prefixes: tuple[str, ...] = ()


# Selectors and URL rules of one job board's pages.
JOB_BOARD = SiteConfig(
    listing_selectors=("a[data-automation='jobTitle']", "a.job-link", "a[data-testid='job-result']"),
    data_selectors=(
        "#job-details",
        ".JobDetail",
        "[data-automation='jobDetail']",
        "[data-automation='jobDetailsPage']",
        ".job-detail-content",
    ),
    ignore_params=("sol", "ref", "origin"),
    root_prefixes=("job/",),
)


def _field_value(page: html.Page, card: int, field: Field) -> str:
    found = select(page, field.selector, within=card)
    if field.attribute is not None:
        return page.attributes(found[0]).get(field.attribute, "") if found else ""
    text = "".join(page.text_of(node) for node in found)
    return text.strip(urls.SPACE) if field.trim else text


def extract_cards(
    pages: DataFrame,
    body: str = "html",
    container: str = JOB_CARD,
    fields: Mapping[str, Field] | None = None,
) -> DataFrame:
    """One row per container element: the other columns, ``pos``, one text per field, ``skills``.

    A field that matches nothing is ``""``; ``skills`` is always empty, as cards hold none.
    """
    fields = dict(JOB_CARD_FIELDS if fields is None else fields)
    for selector in (container, *(field.selector for field in fields.values())):
        compile_selector(selector)
    cards_type = ArrayType(StructType([StructField(name, StringType()) for name in fields]))
    arrow_type = to_arrow_type(cards_type)

    @F.arrow_udf(cards_type)
    def cards(bodies: pa.Array) -> pa.Array:
        out = []
        for body in bodies.to_pylist():
            page = html.scan(body) if body else None
            out.append(
                [
                    {name: _field_value(page, card, field) for name, field in fields.items()}
                    for card in (select(page, container) if page else ())
                ]
            )
        return pa.array(out, arrow_type)

    others = [name for name in pages.columns if name != body]
    found = explode_udf(pages.select(*others, cards(readable(body)).alias("_cards")), F.col("_cards"), "pos", "_card")
    return found.select(
        *others, "pos", *[F.col(f"_card.{name}").alias(name) for name in fields],
        F.array().cast("array<string>").alias("skills"),
    )


@F.arrow_udf(StringType())
def _visible_text(pages: pa.Array) -> pa.Array:
    return pa.array(
        [None if page is None else html.scan(page).text_without(NO_TEXT_TAGS) for page in pages.to_pylist()],
        pa.string(),
    )


def collapse_lines(text: Column) -> Column:
    """Lines trimmed of Unicode white space, blank ones dropped, joined by an empty line."""
    lines = F.transform(
        F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n"), lambda line: F.btrim(line, F.lit(urls.SPACE))
    )
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n\n")


def clean_html_text(pages: DataFrame, body: str = "html", to: str = "text") -> DataFrame:
    """Replace the page by its text, without scripts, styles, navigation, footers and frames."""
    others = [name for name in pages.columns if name not in (body, to)]
    found = with_udf(pages, "_visible", _visible_text(readable(body)))
    return found.select(*others, collapse_lines(F.col("_visible")).alias(to))


PROMPT = """Read the page below and list every job advertised on it as JSON objects with these fields:
job_title, company_name, location, salary_range, description,
links (the address of the advertisement, as one string),
required_skills (an array of strings).
Answer with one array of such objects inside a ```json fenced block and nothing else.
If the page advertises no job, answer with a plain sentence and no block.

Page:
"""


def build_prompts(pages: DataFrame, body: str = "html", use_clean: bool = False, to: str = "prompt") -> DataFrame:
    """Add the instruction followed by the page, as stored or (``use_clean``) as text."""
    if not use_clean:
        return pages.withColumn(to, F.concat(F.lit(PROMPT), readable(body)))
    found = with_udf(pages, "_visible", _visible_text(readable(body)))
    return found.withColumn(to, F.concat(F.lit(PROMPT), collapse_lines(F.col("_visible")))).drop("_visible")


def extract_with(
    df: DataFrame,
    fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    schema: StructType | str,
) -> DataFrame:
    """Run a user's extractor over batches of rows. Filter and project before: Spark cannot look inside."""
    return df.mapInPandas(fn, schema)


ERROR_CHARS = 2000


def extract_apart(
    df: DataFrame,
    fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    schema: StructType,
    keys: Sequence[str],
    error: str = "error",
) -> DataFrame:
    """U1 with failures told apart: the extractor's rows and, for each row it fails on, the keys and an ``error``.

    ``fn`` is called with a batch at a time, so a costly set-up belongs in its module. When it raises, the rows it had answered by then
    are kept, and of the others each half is tried by itself, down to the single rows that fail; the job goes on. A row without an
    answer is an error too. ``keys`` are columns of ``df`` and of ``schema`` that an answer repeats.
    """
    keys, names = list(keys), schema.names

    def told(rows: pd.DataFrame, why: str | None) -> pd.DataFrame:
        nothing = pd.Series([None] * len(rows), index=rows.index, dtype=object)
        filled = {name: rows[name] if name in rows else nothing for name in names}
        return pd.DataFrame({**filled, error: nothing if why is None else nothing.map(lambda _: why[:ERROR_CHARS])})

    def unanswered(batch: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(answers):
            return batch
        of = lambda rows: pd.MultiIndex.from_frame(rows[keys].astype(object).where(rows[keys].notna(), None))
        return batch[~of(batch).isin(of(answers))]

    def attempt(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        answers, failure = [], None
        try:
            for answer in fn(iter([batch])):
                answers.append(answer[names])
        except Exception as raised:  # whatever a user's function raises concerns its rows alone
            failure = f"{type(raised).__name__}: {raised}"
        for answer in answers:
            yield told(answer, None)
        left = unanswered(batch, pd.concat(answers)) if answers else batch
        if failure is None:
            if len(left):
                yield told(left[keys], "no answer")
        elif len(left) == 1:
            yield told(left[keys], failure)
        elif len(left) < len(batch):
            if len(left):
                yield from attempt(left)
        else:
            yield from attempt(batch.iloc[: len(batch) // 2])
            yield from attempt(batch.iloc[len(batch) // 2 :])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield from attempt(batch)

    return df.mapInPandas(run, StructType([*schema.fields, StructField(error, StringType())]))


# Fixed value: the form in which models are asked to answer.
_FENCED = r"(?s)```json\n?(.*?)\n?```"
_DECODED = to_arrow_type(DECODED_RESPONSE)


@F.arrow_udf(DECODED_RESPONSE)
def _decode(blocks: pa.Array) -> pa.Array:
    rows = []
    for block in blocks.to_pylist():
        status, jobs = ("no_json", []) if block is None else decode_records(block)
        rows.append({"status": status, "jobs": jobs})
    return pa.array(rows, _DECODED)


def parse_model_responses(responses: DataFrame, response: str = "response", to: str = "decoded") -> DataFrame:
    """Decode the first fenced JSON block into ``struct<status, jobs>``.

    ``status`` is ok, empty (blank block), no_json (no block, or no records in it) or bad_json.
    """
    text = F.col(response)
    block = F.when(text.rlike(_FENCED), F.regexp_extract(text, _FENCED, 1))
    return with_udf(responses, to, _decode(readable(block)))


@F.arrow_udf(StringType())
def _unescape(texts: pa.Array) -> pa.Array:
    return pa.array([None if text is None else unescape(text) for text in texts.to_pylist()], pa.string())


def unescape_links(records: DataFrame, link: str = "link") -> DataFrame:
    """E5: decode character references in the link; only links holding ``&`` go through Python."""
    escaped = F.when(F.contains(F.col(link), F.lit("&")), F.col(link))
    found = with_udf(records, "_plain", _unescape(readable(escaped)))
    return found.withColumn(link, F.coalesce("_plain", link)).drop("_plain")


def explode_page_jobs(pages: DataFrame, jobs: str = "jobs", url: str = "url", link_from: str = "page") -> DataFrame:
    """One row per record with ``pos``; ``link`` is the page's URL, or the record's own (``"record"``)."""
    if link_from not in ("page", "record"):
        raise ValueError("link_from is 'page' or 'record'")
    others = [name for name in pages.columns if name != jobs]
    found = explode_udf(pages, F.col(jobs), "pos", "_job").select(
        *others,
        "pos",
        F.col("_job.job_title").alias("title"),
        F.col("_job.company_name").alias("company"),
        F.col("_job.location").alias("location"),
        F.col("_job.salary_range").alias("salary"),
        F.col("_job.description").alias("description"),
        F.col("_job.required_skills").alias("skills"),
        (F.col(url) if link_from == "page" else F.col("_job.links")).alias("link"),
    )
    return found if link_from == "page" else unescape_links(found)


def split_parse_failures(
    parsed: DataFrame, decoded: str = "decoded", error: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(parsed, failed)``. A blank block is no failure: it has no records.

    ``error`` names the column of ``extract_apart`` that tells why there is no answer; it then is the ``reason``.
    Both sides read ``parsed``; stage it first when it is costly to compute.
    """
    status = F.col(f"{decoded}.status")
    if error is not None:
        status = F.coalesce(F.col(error), status)
    good = status.isin("ok", "empty")
    left = [decoded] if error is None else [decoded, error]
    return parsed.filter(good).drop(*left[1:]), parsed.filter(~good).withColumn("reason", status).drop(*left)


def _nodes(*fields: tuple[str, object]) -> ArrayType:
    return ArrayType(StructType([StructField(name, kind) for name, kind in fields]))


_CONTENT = StructType(
    [
        StructField(
            "listings", _nodes(("listing_pos", IntegerType()), ("href", StringType()), ("canonical", StringType()))
        ),
        StructField("data", _nodes(("data_pos", IntegerType()), ("body", StringType()))),
    ]
)


def _content_of(site: SiteConfig, url: str, body: str) -> Column:
    """A page's listings and data as one struct, found in one pass."""
    dropped, prefixes = urls.ignored_names(site.ignore_params), site.root_prefixes
    listing_selectors, data_selectors = site.listing_selectors, site.data_selectors
    for selector in listing_selectors + data_selectors:
        compile_selector(selector)
    arrow_type = to_arrow_type(_CONTENT)

    @F.arrow_udf(_CONTENT)
    def content(page_urls: pa.Array, bodies: pa.Array) -> pa.Array:
        rows = []
        for page_url, body in zip(page_urls.to_pylist(), bodies.to_pylist()):
            page = html.scan(body) if body else None
            listings, data = [], []
            for selector in listing_selectors if page else ():
                listings = select(page, selector)
                if listings:
                    break
            if listings:
                data = [page.text_of(node) for selector in data_selectors for node in select(page, selector)]
            hrefs = [page.attributes(node).get("href") for node in listings] if data else []
            rows.append(
                {
                    "listings": [
                        {
                            "listing_pos": pos,
                            "href": href,
                            "canonical": href and urls.canonicalize(page_url or "", href, dropped, prefixes),
                        }
                        for pos, href in enumerate(hrefs)
                    ],
                    "data": [{"data_pos": pos, "body": text} for pos, text in enumerate(data)],
                }
            )
        return pa.array(rows, arrow_type)

    return content(readable(url), readable(body))


def _listings(found: DataFrame, others: Sequence[str], more: Sequence[str], url: str) -> DataFrame:
    """A row for each listing of ``_content``, with the id under which its content is stored."""
    listed = found.select(*others, *more, F.explode_outer("_content.listings").alias("_listing"))
    return listed.filter("_listing is not null").select(
        *others,
        *more,
        F.col("_listing.listing_pos").alias("listing_pos"),
        F.col("_listing.href").alias("href"),
        page_id(
            F.col(url), F.col("_listing.href"), F.col("_listing.canonical"), [F.col("_listing.listing_pos")]
        ).alias("page_id" if "page_id" not in others else "content_id"),
    )


def select_page_content(pages: DataFrame, site: SiteConfig, url: str = "url", body: str = "html") -> DataFrame:
    """For each listing of a page, the text of every data element, under the listing's id.

    The first listing selector that matches decides which elements are the page's listings. Ids are
    made as by L10. A page's listings and data leave Python as two arrays and are crossed by two
    explodes of that row, as each listing shows all of the page's content: nothing is shuffled.
    Result: the other columns, ``listing_pos, data_pos, href, page_id, body, status``.
    """
    others = [name for name in pages.columns if name != body]
    found = pages.select(*others, _content_of(site, url, body).alias("_content"))
    identified = _listings(found.withColumn("_data", F.col("_content.data")), others, ["_data"], url)
    kept = [name for name in identified.columns if name != "_data"]
    return identified.select(*kept, F.explode_outer("_data").alias("_item")).select(
        *kept,
        F.col("_item.data_pos").alias("data_pos"),
        F.col("_item.body").alias("body"),
        F.lit(200).alias("status"),
    )


class PageContent(NamedTuple):
    listings: DataFrame
    content: DataFrame


def split_page_content(pages: DataFrame, site: SiteConfig, url: str = "url", body: str = "html") -> PageContent:
    """E8 as two related tables, so that a page's text is stored once and not once for each listing.

    ``listings`` has the other columns, ``listing_pos, href, page_id, status`` and ``data_id``; ``content`` has ``data_id, data_pos,
    body``, once for each different content. Joined on ``data_id`` they give the rows of ``select_page_content``. Both come from one staged
    pass over the pages and are together no longer than these.
    """
    others = [name for name in pages.columns if name != body]
    found = pages.select(*others, F.explode_outer(F.array(_content_of(site, url, body))).alias("_content"))
    texts = F.transform("_content.data", lambda item: F.concat(F.length(item["body"]).cast("string"), F.lit(":"), item["body"]))
    found = stage(found.withColumn("data_id", F.sha2(F.array_join(texts, ""), 256)), "page-content")
    listings = _listings(found, others, ["data_id"], url).withColumn("status", F.lit(200))
    some = found.filter(F.size("_content.listings") > 0).select("data_id", F.col("_content.data").alias("_data"))
    content = some.dropDuplicates(["data_id"]).select("data_id", F.explode("_data").alias("_item"))
    return PageContent(listings, content.select("data_id", "_item.data_pos", "_item.body"))


def select_title_links(pages: DataFrame, selector: str = TITLE_LINK, url: str = "url", body: str = "html") -> DataFrame:
    """One row per title link: the page's URL and the link's text."""
    compile_selector(selector)

    @F.arrow_udf(ArrayType(StringType()))
    def texts(bodies: pa.Array) -> pa.Array:
        out = []
        for body in bodies.to_pylist():
            page = html.scan(body) if body else None
            out.append([page.text_of(node) for node in select(page, selector)] if page else [])
        return pa.array(out, pa.list_(pa.string()))

    found = explode_udf(pages.select(F.col(url).alias("url"), texts(readable(body)).alias("_texts")), F.col("_texts"), "pos", "body")
    return found.drop("_texts").withColumn("status", F.lit(200))
