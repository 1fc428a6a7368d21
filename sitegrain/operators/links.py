"""Link extraction, resolution, domain gates and canonical URLs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from sitegrain.functions import html, urls
from sitegrain.functions.targets import page_targets as page_targets_of
from sitegrain.session import stage

_STRINGS = pa.list_(pa.string())


def _texts(column: pa.Array) -> list[str | None]:
    """``to_pylist`` of strings, which makes no Arrow scalar of each."""
    return column.to_numpy(zero_copy_only=False).tolist()


@F.arrow_udf(ArrayType(StringType()))
def _hrefs(pages: pa.Array) -> pa.Array:
    return pa.array([None if page is None else html.hrefs(page) for page in _texts(pages)], _STRINGS)


@F.arrow_udf(StringType())
def _resolve(bases: pa.Array, hrefs: pa.Array) -> pa.Array:
    return pa.array(
        [
            None if href is None else href if base is None else urls.resolve(base, href)
            for base, href in zip(_texts(bases), _texts(hrefs))
        ],
        pa.string(),
    )


@F.arrow_udf(ArrayType(StringType()))
def _targets(bases: pa.Array, pages: pa.Array) -> pa.Array:
    return pa.array(
        [
            None if base is None or page is None else page_targets_of(base, page)
            for base, page in zip(_texts(bases), _texts(pages))
        ],
        _STRINGS,
    )


def readable(text: Column | str) -> Column:
    """Text, or bytes of text, fit for Python: Spark strings may hold bytes that are not UTF-8."""
    column = F.col(text) if isinstance(text, str) else text
    return F.make_valid_utf8(column.cast("string"))


def with_udf(df: DataFrame, to: str, value: Column) -> DataFrame:
    """``withColumn`` for a UDF result, evaluated once.

    Spark moves a filter on a plain column below it, and then runs the UDF for the filter and
    again for the column. Here the value passes through a one-item ``explode_outer``, which stops
    filters on the value but lets those on other columns through to the scan.
    """
    return df.select(*[name for name in df.columns if name != to], F.explode_outer(F.array(value)).alias(to))


def explode_udf(df: DataFrame, array: Column, pos: str, item: str) -> DataFrame:
    """``posexplode`` of a UDF result, evaluated once.

    A plain ``explode`` adds a filter on the array's size, for which Spark would run the
    UDF a second time; the outer form adds none, and the empty rows are dropped here.
    """
    return df.select("*", F.posexplode_outer(array).alias(pos, item)).filter(F.col(pos).isNotNull())


def extract_links(pages: DataFrame, url: str = "url", body: str = "html") -> DataFrame:
    """L1: one row ``(url, pos, href)`` per ``a[href]``, in document order."""
    found = explode_udf(pages.select(F.col(url).alias("url"), _hrefs(readable(body)).alias("_hrefs")), F.col("_hrefs"), "pos", "href")
    return found.drop("_hrefs")


def resolve_links(links: DataFrame, base: str = "url", href: str = "href", to: str = "dst") -> DataFrame:
    """L2: add ``dst``, the href resolved against its page's URL."""
    return with_udf(links, to, _resolve(readable(base), readable(href)))


def filter_allowed_domains(
    links: DataFrame, domains: Iterable[str] | DataFrame, url: str = "dst"
) -> DataFrame:
    """L3: keep rows whose URL lies on an allowed domain or under one.

    Give ``domains`` as strings for a short list, or as a DataFrame with a ``domain`` column for
    one of any length: it is then matched by equi-joins on each distinct host's dotted suffixes.
    """
    if not isinstance(domains, DataFrame):
        return links.filter(urls.on_domain(F.col(url), domains))
    # Each distinct host is tested once. Links and hosts are read from one staged copy.
    with_host = stage(links.withColumn("_host", urls.url_host(F.col(url))), "hosts")
    allowed = _hosts_on(with_host.select("_host").distinct(), domains)
    return with_host.join(allowed, "_host", "left_semi").select(*links.columns)


def _hosts_on(hosts: DataFrame, domains: DataFrame) -> DataFrame:
    """The ``_host`` that lie on a ``domain`` or under one, staged, so that the planner knows how many are left."""
    labels = F.split("_host", r"\.")
    suffix = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."),
    )
    matched = hosts.select("_host", F.explode(suffix).alias("domain")).join(domains.select("domain"), "domain", "left_semi")
    return stage(matched.select("_host").distinct(), "allowed-hosts")


def with_allowed(rows: DataFrame, domains: Iterable[str] | DataFrame, url: str = "url", to: str = "allowed") -> DataFrame:
    """Add a flag: whether the URL lies on an allowed domain; ``domains`` as for L3, a DataFrame for a list of any length."""
    if not isinstance(domains, DataFrame):
        return rows.withColumn(to, F.coalesce(urls.on_domain(F.col(url), domains), F.lit(False)))
    with_host = stage(rows.withColumn("_host", urls.url_host(F.col(url))), "hosts")
    allowed = _hosts_on(with_host.select("_host").distinct(), domains).withColumn(to, F.lit(True))
    return with_host.join(allowed, "_host", "left").select(*rows.columns, F.coalesce(to, F.lit(False)).alias(to))


def page_targets(pages: DataFrame, url: str = "url", body: str = "html") -> DataFrame:
    """L1 and L2 in one pass over each page: ``(src, dsts)`` with the distinct resolved links."""
    return pages.select(F.col(url).alias("src"), _targets(readable(url), readable(body)).alias("dsts"))


def canonical_url(
    base: Column | str, href: Column | str, ignore_params: Sequence[str] = (), root_prefixes: Sequence[str] = ()
) -> Column:
    """L8 as a Column: canonical URL of ``href`` on page ``base``, NULL when either does not parse."""
    dropped, prefixes = urls.ignored_names(ignore_params), tuple(root_prefixes)

    @F.arrow_udf(StringType())
    def canonical(bases: pa.Array, hrefs: pa.Array) -> pa.Array:
        return pa.array(
            [
                None if base is None or href is None else urls.canonicalize(base, href, dropped, prefixes)
                for base, href in zip(_texts(bases), _texts(hrefs))
            ],
            pa.string(),
        )

    return canonical(readable(base), readable(href))


def canonicalize_urls(
    df: DataFrame,
    base: str = "url",
    href: str = "href",
    ignore_params: Sequence[str] = (),
    root_prefixes: Sequence[str] = (),
    to: str = "canonical",
) -> DataFrame:
    """Add the canonical form of ``href``."""
    return with_udf(df, to, canonical_url(base, href, ignore_params, root_prefixes))


def strip_tracking_params(
    df: DataFrame, url: str = "url", ignore_params: Sequence[str] = (), to: str = "query"
) -> DataFrame:
    """Add the URL's query without tracking and ignored parameters, sorted by key."""
    return df.withColumn(to, urls.strip_tracking_params(urls.query_of(F.col(url)), ignore_params))


def page_id(page_url: Column, href: Column, canonical: Column, row_key: Sequence[Column] = ()) -> Column:
    """L10 as a Column: the canonical URL, else the page's URL with a UUID appended.

    With ``row_key`` the UUID is derived from it and the page, so that a task run again after
    a lost executor, or a replayed batch, gives the same id; without, it is random.
    """
    if row_key:
        digest = F.md5(F.concat_ws("\n", page_url, *[key.cast("string") for key in row_key]))
        token = F.regexp_replace(digest, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    else:
        token = F.uuid()
    blank = href.isNull() | (F.btrim(href, F.lit(urls.SPACE)) == "")
    return F.coalesce(F.when(~blank, canonical), F.concat(page_url, token))


def assign_page_id(
    df: DataFrame,
    page_url: str = "url",
    href: str = "href",
    row_key: Sequence[str] = (),
    ignore_params: Sequence[str] = (),
    root_prefixes: Sequence[str] = (),
    to: str = "page_id",
) -> DataFrame:
    """Add the id under which content found behind ``href`` is stored."""
    canonical = canonical_url(page_url, href, ignore_params, root_prefixes)
    key = [F.col(name) for name in row_key]
    found = with_udf(df, "_canonical", canonical)
    return found.withColumn(to, page_id(F.col(page_url), F.col(href), F.col("_canonical"), key)).drop("_canonical")


def dedupe_by_canonical_url(
    pages: DataFrame,
    order: Sequence[str],
    url: str = "url",
    ignore_params: Sequence[str] = (),
    root_prefixes: Sequence[str] = (),
) -> DataFrame:
    """One row per canonical URL, the last by ``order``; adds ``canonical``.

    NULL comes before any value. Rows that tie go by their place in their file, so one row is left whatever ``order`` holds.
    Canonical URLs and row places are staged once; page bodies stay where they are while the
    repeats are found: an aggregate over canonical URLs, which merges copies before its shuffle,
    gives the rows to keep, and all others are dropped by an anti join on row places, which
    Spark broadcasts when they are few. No key of either join is hot.
    Rows whose URL does not parse are kept under the URL itself. Rows that don't come from files are staged first.
    """
    key = F.coalesce(canonical_url(url, F.lit(""), ignore_params, root_prefixes), F.col(url))
    placed = with_places(pages)
    names = list(dict.fromkeys(order))
    ids = stage(placed.select(key.alias("_canonical"), F.struct(*names, *PLACE).alias("_row")), "canonical")
    last = ids.groupBy("_canonical").agg(F.max("_row").alias("_row"))
    kept = last.select(*[F.col(f"_row.{name}").alias(name) for name in PLACE])
    losers = stage(ids.select(*[F.col(f"_row.{name}").alias(name) for name in PLACE]).join(kept, list(PLACE), "left_anti"), "repeats")
    return with_udf(placed.join(losers, list(PLACE), "left_anti").drop(*PLACE), "canonical", key)


PLACE = ("_file", "_file_row")


def with_places(rows: DataFrame) -> DataFrame:
    """Add the file and the row in it that each row comes from: the same whenever and wherever a task runs."""
    place = [F.col("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.row_index").alias(PLACE[1])]
    try:
        return rows.select("*", *place)
    except AnalysisException:  # not the rows of files
        return stage(rows, "placed").select("*", *place)


def rows_at(placed: DataFrame, places: DataFrame, wanted: bool = True) -> DataFrame:
    """Of rows with their places those that are listed, or are not; they stay where they lie.

    The list becomes a bit for each row of a file, so that one of millions of rows is still broadcast. A row may be listed several times.
    """
    block, bit = F.bitmap_bucket_number(PLACE[1]), F.bitmap_bit_position(PLACE[1])
    marks = stage(places.groupBy(PLACE[0], block.alias("_block")).agg(F.bitmap_construct_agg(bit).alias("_marks")), "marks")
    byte = F.conv(F.hex(F.substring("_marks", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    found = placed.withColumn("_block", block).join(marks, [PLACE[0], "_block"], "left")
    return found.filter(marked if wanted else ~marked).select(*placed.columns)
