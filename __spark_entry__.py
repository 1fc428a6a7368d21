
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.operators import crawl, extract, links, merge, stored
from sitegrain.operators.visits import VisitedSet
from sitegrain.plans import jobs
from sitegrain.schemas import EXTRACTED_JOBS, JOB_LISTINGS, RAW_PAGES
from sitegrain.session import configure, empty_table, stage, staging_root
from sitegrain.sources import tables
from sitegrain.sources.buckets import BucketTable
from sitegrain.sources.snapshots import SnapshotTable
from sitegrain.streaming.parse_stream import parse_stream

try:
    import sitegrain.llm.queries as corpus
except ModuleNotFoundError as error:
    if not (error.name or "").startswith("sitegrain.llm"):
        raise
    corpus = None

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

DOMAINS = ["example.com"]
HALFWAY = "2024-01-16 00:00:00"
EARLIER, LATER = "2024-02-01 00:00:00", "2024-02-02 12:30:00"


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark, __file__), sf_dir)

        _QUERIES[name], _SQL[name] = run, sql
        return fn

    return register


def entry(spark: SparkSession) -> DataFrame:
    """The next frontier: allowed links of the stored pages that have not been visited."""
    return next_frontier(configure(spark, __file__), "/root/testdata/sf0.001")


def library_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def queries() -> dict[str, Query]:
    return _QUERIES | {name: _configured(fn) for name, fn in (corpus.QUERIES if corpus else {}).items()}


def oracle_sql() -> dict[str, str]:
    return _SQL | (corpus.SQL if corpus else {})


def _configured(fn: Query) -> Query:
    return lambda spark, sf_dir: fn(configure(spark, __file__), sf_dir)


# Inputs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.spread(table(spark, sf_dir, "pages"))


def timestamp(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def zoned(text: str) -> Column:
    return F.lit(text + " UTC").cast("timestamp")


def as_text(at: str) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias(at)


def event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as fetched pages, one URL per user."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("https://example.com/user/"), "user_id").alias("url"),
        F.col("event_type").alias("content_type"),
        F.col("props").alias("raw_content"),
        F.col("ts").alias("fetched_at"),
        "event_id",
    )


SQL_EVENT_PAGES = """events_as_pages as (
    select 'https://example.com/user/' || user_id as url, event_type as content_type, props as raw_content,
           ts as fetched_at, event_id from events)"""

SQL_LINKS = """links as (
    select page_id, url, cast(pos as integer) as pos, href,
           regexp_extract(url, '^https?://[^/?#]+') || replace(replace(url_encode(href), '%2F', '/'), '%2C', ',') as dst
    from (select page_id, url, unnest(range(len(hrefs))) as pos, unnest(hrefs) as href
          from (select page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) as hrefs from pages)))"""

SQL_CANONICAL_PAGE = r"""regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '')
    || case when regexp_matches(url, '[?&]page=2') then '?page=2' else '' end"""


def sql_text(expression: str) -> str:
    """SQL for the entities that occur in the pages."""
    for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"')):
        expression = f"replace({expression}, '{name}', '{char}')"
    return f"regexp_replace({expression}, '&amp;?', '&', 'g')"


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.resolve_links(links.extract_links(pages_of(spark, sf_dir)))


# Scans and sources


@query("s1_scan_raw_pages", "select url, 'text/html' as content_type, html as raw_content from pages")
def scan_raw_pages(spark, sf_dir):
    raw = table(spark, sf_dir, "pages").select(
        "url", F.lit("text/html").alias("content_type"), F.col("html").alias("raw_content"), "page_id"
    )
    return tables.scan_raw_pages(raw)


@query(
    "s2_scan_since",
    f"with {SQL_EVENT_PAGES} select url, content_type, raw_content from events_as_pages "
    f"where fetched_at >= timestamp '{HALFWAY}'",
)
def scan_since(spark, sf_dir):
    return tables.scan_raw_pages(tables.scan_since(event_pages(spark, sf_dir), timestamp(HALFWAY)))


@query(
    "s3_lookup_extracted",
    "select p_name as title, p_brand as company, 'https://example.com/part/' || p_partkey as link from part "
    "where p_brand = 'Brand#13'",
)
def lookup_extracted(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("company"),
        F.concat(F.lit("https://example.com/part/"), "p_partkey").alias("link"),
    )
    return tables.lookup_extracted(parts, "company", "Brand#13")


@query(
    "s4_fetch_stored_pages",
    "select page_id, url, html from pages where url in (select regexp_replace(url, '[?#].*$', '') from pages)",
)
def fetch_stored_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    frontier = pages.select(F.regexp_replace("url", "[?#].*$", "").alias("url"))
    return crawl.fetch_stored_pages(frontier, pages).select("page_id", "url", "html")


# Links


@query("l1_extract_links", f"with {SQL_LINKS} select url, pos, href from links")
def extract_links(spark, sf_dir):
    return links.extract_links(pages_of(spark, sf_dir))


@query("l2_resolve_links", f"with {SQL_LINKS} select url, pos, href, dst from links")
def resolve_links(spark, sf_dir):
    return page_links(spark, sf_dir)


@query(
    "l3_filter_allowed_domains",
    f"with {SQL_LINKS} select url, pos, dst from links "
    r"where regexp_matches(dst, '^https?://([^/?#]+\.)?example\.com(/|$)')",
)
def filter_allowed_domains(spark, sf_dir):
    return links.filter_allowed_domains(page_links(spark, sf_dir), DOMAINS).select("url", "pos", "dst")


@query(
    "l3_filter_allowed_domain_table",
    rf"""with {SQL_LINKS},
    domains as (select distinct regexp_extract(url, '([^./]+\.[^./]+)(/|$)', 1) as domain from pages where url like 'http:%'
                and url like '%/es/%')
    select url, pos, dst from links
    where exists (select 1 from domains
                  where ends_with('.' || regexp_extract(dst, '^https?://([^/?#]+)', 1), '.' || domain))""",
)
def filter_allowed_domain_table(spark, sf_dir):
    pages = pages_of(spark, sf_dir).filter(F.col("url").startswith("http:") & F.col("url").contains("/es/"))
    domains = pages.select(F.regexp_extract("url", r"([^./]+\.[^./]+)(/|$)", 1).alias("domain"))
    return links.filter_allowed_domains(page_links(spark, sf_dir), domains).select("url", "pos", "dst")


@query(
    "l4_mark_visited",
    f"with {SQL_LINKS} select distinct dst as url from links where dst not in "
    "(select dst from links where url like '%/en/%')",
)
def mark_visited(spark, sf_dir):
    found = page_links(spark, sf_dir).select("url", F.col("dst"))
    visited = found.filter(F.col("url").contains("/en/")).select(F.col("dst").alias("url")).distinct()
    return crawl.mark_visited(found.select(F.col("dst").alias("url")), visited)


@query(
    "l5_is_visited",
    f"with {SQL_LINKS} select url, pos, dst, dst in (select dst from links where url like '%/en/%') as visited from links",
)
def is_visited(spark, sf_dir):
    found = page_links(spark, sf_dir).select("url", "pos", "dst")
    visited = found.filter(F.col("url").contains("/en/")).select("dst").distinct()
    return crawl.is_visited(found, visited, url="dst")


@query("l4_known_urls", _SQL["l4_mark_visited"])
def known_urls(spark, sf_dir):
    """L4 with a visited set kept between crawls."""
    found = stage(page_links(spark, sf_dir).select("url", F.col("dst")), "links")
    known = VisitedSet(spark, f"{staging_root(spark)}/visited-{uuid.uuid4().hex}", buckets=16)
    known.add(found.filter(F.col("url").contains("/en/")), "dst")
    return known.unvisited(found.select(F.col("dst").alias("url")).distinct())


# The link graph of parts, suppliers, orders (no stored page) and return flags (off the domain)


def shop(path: str, key: str) -> Column:
    return F.concat(F.lit(f"https://shop.example.com/{path}/"), key)


def shop_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supplier = shop("part", "l_partkey"), shop("supplier", "l_suppkey")
    order = F.concat(F.lit("https://orders.example.com/order/"), "l_orderkey")
    flag = F.concat(F.lit("https://flags.example.net/"), "l_returnflag")

    def edge(src: Column, dst: Column) -> Column:
        return F.struct(src.alias("src"), dst.alias("dst"))

    four = F.array(edge(part, supplier), edge(supplier, part), edge(supplier, order), edge(part, flag))
    return tables.spread(table(spark, sf_dir, "lineitem")).select(F.inline(four))


def shop_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter("p_brand = 'Brand#13'").select(shop("part", "p_partkey").alias("url"))


SQL_SHOP = """edges as (
    select distinct 'https://shop.example.com/part/' || l_partkey as src,
           'https://shop.example.com/supplier/' || l_suppkey as dst from lineitem
    union select 'https://shop.example.com/supplier/' || l_suppkey, 'https://shop.example.com/part/' || l_partkey from lineitem
    union select 'https://shop.example.com/supplier/' || l_suppkey, 'https://orders.example.com/order/' || l_orderkey from lineitem
    union select 'https://shop.example.com/part/' || l_partkey, 'https://flags.example.net/' || l_returnflag from lineitem),
seeds as (select 'https://shop.example.com/part/' || p_partkey as url from part where p_brand = 'Brand#13')"""

SQL_REACH = """reach(url, hop) as (
    select url, 0 from seeds
    union select dst, hop + 1 from reach join edges on src = url
    where hop < 3 and url like 'https://%.example.com/%')"""


@query(
    "l6_expand_frontier",
    f"""with {SQL_SHOP}
    select distinct dst as url, cast(1 as integer) as depth from edges where src in (select url from seeds)
    and dst not in (select 'https://shop.example.com/supplier/' || s_suppkey from supplier where s_acctbal < 0)""",
)
def expand_frontier(spark, sf_dir):
    frontier = shop_seeds(spark, sf_dir).withColumn("depth", F.lit(2))
    suppliers = table(spark, sf_dir, "supplier").filter("s_acctbal < 0")
    visited = frontier.select("url").union(suppliers.select(shop("supplier", "s_suppkey")))
    return crawl.expand_frontier(frontier, shop_edges(spark, sf_dir), DOMAINS, visited)


@query(
    "l7_crawl_bounded",
    f"""with recursive {SQL_SHOP}, {SQL_REACH}
    select url, cast(min(hop) as integer) as hop, cast(3 - min(hop) as integer) as depth_left,
           case when min(hop) = 3 then 'depth_exhausted' when url not like 'https://%.example.com/%' then 'off_domain'
                when url in (select src from edges) then 'fetched' else 'no_page' end as outcome
    from reach group by url""",
)
def crawl_bounded(spark, sf_dir):
    return crawl.crawl_bounded(shop_seeds(spark, sf_dir), shop_edges(spark, sf_dir), DOMAINS, max_depth=3)


# Canonical URLs


@query(
    "l8_canonicalize_urls",
    f"""with {SQL_LINKS}
    select url, href, dst as canonical from links
    union all select url, url as href, {SQL_CANONICAL_PAGE} as canonical from pages""",
)
def canonicalize_urls(spark, sf_dir):
    pages = pages_of(spark, sf_dir)
    hrefs = links.extract_links(pages).select("url", "href").union(pages.select("url", "url"))
    return links.canonicalize_urls(hrefs, ignore_params=["ref"])


@query(
    "l9_strip_tracking_params",
    r"""select page_id, url, coalesce(array_to_string(list_sort(list_filter(
            string_split(regexp_extract(url, '\?([^#]*)', 1), '&'),
            lambda p: p <> '' and not starts_with(lower(p), 'utm_') and not starts_with(p, 'ref='))), '&'), '') as query
    from pages""",
)
def strip_tracking_params(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return links.strip_tracking_params(pages, ignore_params=["ref"])


@query(
    "l10_assign_page_id",
    f"""with {SQL_LINKS}
    select url, pos, case when href not like '%th%' then dst
        else url || regexp_replace(md5(url || chr(10) || pos), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')
        end as page_id from links""",
)
def assign_page_id(spark, sf_dir):
    found = links.extract_links(pages_of(spark, sf_dir))
    some = found.withColumn("href", F.when(~F.col("href").contains("th"), F.col("href")))
    return links.assign_page_id(some, row_key=["pos"]).select("url", "pos", "page_id")


@query(
    "l11_dedupe_by_canonical_url",
    f"""select page_id, url, html, canonical from (
        select page_id, url, html, canonical, row_number() over (partition by canonical order by page_id desc) as n
        from (select page_id, url, html, {SQL_CANONICAL_PAGE} as canonical from pages)) where n = 1""",
)
def dedupe_by_canonical_url(spark, sf_dir):
    pages = pages_of(spark, sf_dir)
    return links.dedupe_by_canonical_url(pages, order=["page_id"], ignore_params=["ref"]).select(
        "page_id", "url", "html", "canonical"
    )


# Extraction


def sql_trim(expression: str) -> str:
    return rf"regexp_replace({expression}, '^\s+|\s+$', '', 'g')"


SQL_TITLE = sql_text("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")
SQL_TAGLESS_ARTICLE = "regexp_replace(regexp_extract(html, '</h1>(.*?)</article>', 1, 's'), '<[^>]*>', '', 'g')"


@query(
    "e1_extract_cards",
    f"select page_id, url, cast(0 as integer) as pos, {SQL_TITLE} as title, "
    f"{sql_trim(sql_text(SQL_TAGLESS_ARTICLE))} as description from pages",
)
def extract_cards(spark, sf_dir):
    fields = {"title": extract.Field("h1"), "description": extract.Field("p", trim=True)}
    cards = extract.extract_cards(pages_of(spark, sf_dir), container="article", fields=fields)
    return cards.drop("skills")


SQL_UNSEEN = "(?s)<!--.*?-->|<script>.*?</script>|<style>.*?</style>|<nav>.*?</nav>|<footer>.*?</footer>|<[^>]*>"
SQL_CLEAN_TEXT = rf"""array_to_string(list_filter(list_transform(
    string_split({sql_text(f"regexp_replace(html, '{SQL_UNSEEN}', '', 'g')")}, chr(10)),
    lambda line: {sql_trim("line")}), lambda line: line <> ''), chr(10) || chr(10))"""


@query("e2_clean_html_text", f"select page_id, url, {SQL_CLEAN_TEXT} as text from pages")
def clean_html_text(spark, sf_dir):
    return extract.clean_html_text(pages_of(spark, sf_dir))


SQL_PROMPT = "'" + extract.PROMPT.replace("'", "''") + "'"


@query(
    "e3_build_prompts",
    f"""select page_id, false as cleaned, {SQL_PROMPT} || html as prompt from pages
    union all select page_id, true as cleaned, {SQL_PROMPT} || {SQL_CLEAN_TEXT} as prompt from pages""",
)
def build_prompts(spark, sf_dir):
    pages = pages_of(spark, sf_dir).select("page_id", "html")
    stored = extract.build_prompts(pages).select("page_id", F.lit(False).alias("cleaned"), "prompt")
    clean = extract.build_prompts(pages, use_clean=True).select("page_id", F.lit(True).alias("cleaned"), "prompt")
    return stored.union(clean)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers made from conversations, in five forms: fenced, bare, cut short, one object, blank."""
    first = F.struct(
        F.concat("role", F.lit(" "), "turn").alias("job_title"),
        F.concat(F.lit("conv "), "conv_id").alias("company_name"),
        F.col("text").alias("description"),
        F.array("role", F.lit("talk")).alias("required_skills"),
        F.concat(F.lit("/c/"), "conv_id", F.lit("?a=1&amp;b=2")).alias("links"),
    )
    second = F.struct(
        F.concat("role", F.lit(" again")).alias("job_title"),
        F.lit(None).cast("string").alias("company_name"),
        F.lit("").alias("description"),
        F.lit(None).cast("array<string>").alias("required_skills"),
        F.lit("/again").alias("links"),
    )
    both, form = F.to_json(F.array(first, second)), F.pmod("conv_id", F.lit(5))
    answer = (
        F.when(form == 0, F.concat(F.lit("Found:\n```json\n"), both, F.lit("\n```\nThat is all. ```json\n[]\n```")))
        .when(form == 1, both)
        .when(form == 2, F.concat(F.lit("```json\n"), F.regexp_replace(both, "..$", ""), F.lit("\n```")))
        .when(form == 3, F.concat(F.lit("```json\n"), F.to_json(first), F.lit("\n```")))
        .otherwise(F.lit("```json\n \n```"))
    )
    url = F.concat(F.lit("https://talk.example.com/"), "conv_id", F.lit("/"), "turn")
    talk = tables.spread(table(spark, sf_dir, "conversations"))
    return talk.select("conv_id", "turn", url.alias("url"), answer.alias("response"))


SQL_STATUS = "case conv_id % 5 when 0 then 'ok' when 1 then 'no_json' when 4 then 'empty' else 'bad_json' end"
SQL_JOBS = f"""jobs as (
    select conv_id, turn, 'https://talk.example.com/' || conv_id || '/' || turn as url, cast(0 as integer) as pos,
           role || ' ' || turn as title, 'conv ' || conv_id as company, text as description,
           role || ',talk' as skills, '/c/' || conv_id || '?a=1&b=2' as own_link
    from conversations where {SQL_STATUS} = 'ok'
    union all select conv_id, turn, 'https://talk.example.com/' || conv_id || '/' || turn, 1, role || ' again', '', '', '',
           '/again' from conversations where {SQL_STATUS} = 'ok')"""


@query(
    "e4_parse_model_responses",
    f"""select conv_id, turn, {SQL_STATUS} as status,
        cast(case when {SQL_STATUS} = 'ok' then 2 else 0 end as integer) as n_jobs,
        case when {SQL_STATUS} = 'ok' then text end as first_description from conversations""",
)
def parse_model_responses(spark, sf_dir):
    parsed = extract.parse_model_responses(responses(spark, sf_dir))
    return parsed.select(
        "conv_id",
        "turn",
        F.col("decoded.status").alias("status"),
        F.size("decoded.jobs").alias("n_jobs"),
        F.get("decoded.jobs", F.lit(0))["description"].alias("first_description"),
    )


@query(
    "e5_unescape_links",
    f"select page_id, {sql_text(chr(39) + '/find?t=' + chr(39) + ' || regexp_extract(html, ' + chr(39) + '<title>(.*?)</title>' + chr(39) + ', 1)')} as link from pages",
)
def unescape_links(spark, sf_dir):
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    found = pages_of(spark, sf_dir).select("page_id", F.concat(F.lit("/find?t="), title).alias("link"))
    return extract.unescape_links(found)


@query(
    "e6_explode_page_jobs",
    f"""with {SQL_JOBS}
    select conv_id, turn, pos, title, company, description, skills, url as link, 'page' as link_from from jobs
    union all select conv_id, turn, pos, title, company, description, skills, own_link, 'record' from jobs""",
)
def explode_page_jobs(spark, sf_dir):
    parsed = extract.parse_model_responses(responses(spark, sf_dir))
    with_jobs = parsed.select("conv_id", "turn", "url", F.col("decoded.jobs").alias("jobs"))
    sides = [
        extract.explode_page_jobs(with_jobs, link_from=source).select(
            "conv_id",
            "turn",
            "pos",
            "title",
            "company",
            "description",
            merge.joined_skills(F.col("skills")).alias("skills"),
            "link",
            F.lit(source).alias("link_from"),
        )
        for source in ("page", "record")
    ]
    return sides[0].unionByName(sides[1])


@query(
    "e7_split_parse_failures",
    f"""select conv_id, turn, {SQL_STATUS} not in ('ok', 'empty') as failed,
        case when {SQL_STATUS} not in ('ok', 'empty') then {SQL_STATUS} end as reason from conversations""",
)
def split_parse_failures(spark, sf_dir):
    parsed = stage(extract.parse_model_responses(responses(spark, sf_dir)), "responses")
    good, failed = extract.split_parse_failures(parsed)
    return good.select("conv_id", "turn", F.lit(False).alias("failed"), F.lit(None).cast("string").alias("reason")).union(
        failed.select("conv_id", "turn", F.lit(True), "reason")
    )


SQL_AD = sql_text("""regexp_extract(html, '<div class="ad">(.*?)</div>', 1, 's')""")


@query(
    "e8_select_page_content",
    f"""with {SQL_LINKS}, data as (
        select page_id, cast(0 as integer) as data_pos, {SQL_TITLE} as body from pages
        union all select page_id, 1, {SQL_AD} from pages)
    select page_id, pos as listing_pos, data_pos, dst as content_id, body, cast(200 as integer) as status
    from links join data using (page_id)""",
)
def select_page_content(spark, sf_dir):
    site = extract.SiteConfig(listing_selectors=("a.job-link", "nav a"), data_selectors=("article h1", ".ad", "#job"))
    found = extract.select_page_content(pages_of(spark, sf_dir), site)
    return found.select("page_id", "listing_pos", "data_pos", "content_id", "body", "status")


@query("e8_split_page_content", _SQL["e8_select_page_content"])
def split_page_content(spark, sf_dir):
    """E8 as listings and content, joined again."""
    site = extract.SiteConfig(listing_selectors=("a.job-link", "nav a"), data_selectors=("article h1", ".ad", "#job"))
    found = extract.split_page_content(pages_of(spark, sf_dir), site)
    joined = found.listings.join(found.content, "data_id")
    return joined.select("page_id", "listing_pos", "data_pos", "content_id", "body", "status")


@query(
    "e9_select_title_links",
    f"""with texts as (
        select url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) as href,
               unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) as body from pages)
    select url, {sql_text("body")} as body, cast(200 as integer) as status from texts where href like '%th%'""",
)
def select_title_links(spark, sf_dir):
    found = extract.select_title_links(pages_of(spark, sf_dir), "a[href*='th']")
    return found.select("url", "body", "status")


def shout(batches):
    """A deterministic extractor: length and letter count of each text."""
    for batch in batches:
        yield batch[["conv_id", "turn"]].assign(
            n_chars=batch["text"].str.len(), n_letter_e=batch["text"].str.count("e")
        )


@query(
    "u1_extract_with",
    "select conv_id, turn, length(text) as n_chars, length(text) - length(replace(text, 'e', '')) as n_letter_e from conversations",
)
def extract_with(spark, sf_dir):
    talk = tables.spread(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "text")
    return extract.extract_with(talk, shout, "conv_id long, turn long, n_chars long, n_letter_e long")


# Keyed sinks

SQL_LAST_PAGES = f"""{SQL_EVENT_PAGES},
old as (select * from events_as_pages where fetched_at < timestamp '{HALFWAY}'),
new as (select * from events_as_pages where fetched_at >= timestamp '{HALFWAY}'),
stored as (select * from old qualify row_number() over (partition by url order by event_id desc) = 1),
staged as (select * from new qualify row_number() over (partition by url order by event_id desc) = 1)"""


def stored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = event_pages(spark, sf_dir).filter(F.col("fetched_at") < timestamp(HALFWAY))
    return merge.latest_per_key(old, "url", ["event_id"]).select(*RAW_PAGES.names)


@query(
    "k1_upsert_raw_pages",
    f"""with {SQL_LAST_PAGES}
    select url, content_type, raw_content, '{LATER}' as fetched_at from staged
    union all select url, content_type, raw_content, strftime(fetched_at, '%Y-%m-%d %H:%M:%S') from stored
    where url not in (select url from staged)""",
)
def upsert_raw_pages(spark, sf_dir):
    new = tables.scan_since(event_pages(spark, sf_dir), timestamp(HALFWAY))
    merged = merge.upsert_raw_pages(stored_pages(spark, sf_dir), new, ["event_id"], timestamp(LATER))
    return merged.select("url", "content_type", "raw_content", as_text("fetched_at"))


def part_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("company"),
        F.col("p_type").alias("location"),
        F.col("p_size").cast("string").alias("salary"),
        F.lit("").alias("description"),
        F.concat(F.lit("https://example.com/part/"), "p_partkey").alias("link"),
        F.array("p_type", "p_name").alias("skills"),
    )


def supplier_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = [F.lit("").alias(name) for name in ("company", "location", "salary", "description")]
    return table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("title"),
        *blank,
        F.concat(F.lit("https://example.com/supplier/"), "s_suppkey").alias("link"),
        F.lit(None).cast("array<string>").alias("skills"),
    )


@query(
    "k2_append_extracted",
    f"""select p_name as title, p_brand as company, p_type as location, cast(p_size as varchar) as salary,
        '' as description, 'https://example.com/part/' || p_partkey as link, p_type || ',' || p_name as skills,
        '{LATER}' as created_at, '{LATER}' as updated_at from part
    union all select s_name, '', '', '', '', 'https://example.com/supplier/' || s_suppkey, '', '{EARLIER}', '{EARLIER}'
    from supplier""",
)
def append_extracted(spark, sf_dir):
    nothing = empty_table(spark, EXTRACTED_JOBS)
    before = merge.append_extracted(nothing, supplier_jobs(spark, sf_dir), zoned(EARLIER))
    added = merge.append_extracted(before, part_jobs(spark, sf_dir), zoned(LATER))
    every = before.unionByName(added)
    return every.withColumns({"created_at": as_text("created_at"), "updated_at": as_text("updated_at")})


def event_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as job records, a fifth of them without a link."""
    signup = F.col("event_type") == "signup"
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("title"),
        F.concat(F.lit("event "), "event_id").alias("company"),
        F.lit(None).cast("string").alias("location"),
        F.lit("").alias("salary"),
        F.col("props").alias("description"),
        F.when(~signup, F.concat(F.lit("https://example.com/job/"), "user_id")).alias("link"),
        F.when(~signup, F.array(F.col("event_type"), F.lit(None), F.lit("x"))).alias("skills"),
        "event_id",
        F.col("ts").alias("fetched_at"),
    )


@query(
    "k3_upsert_extracted",
    f"""with jobs as (
        select event_type as title, 'event ' || event_id as company, '' as location, '' as salary, props as description,
               case when event_type = 'signup' then '' else 'https://example.com/job/' || user_id end as link,
               case when event_type = 'signup' then '' else event_type || ',,x' end as skills, event_id, ts from events),
    stored as (select * from jobs where ts < timestamp '{HALFWAY}'
               qualify row_number() over (partition by link order by event_id desc) = 1),
    staged as (select * from jobs where ts >= timestamp '{HALFWAY}'
               qualify row_number() over (partition by link order by event_id desc) = 1)
    select title, company, location, salary, description, link, skills,
           case when link in (select link from stored) then '{EARLIER}' else '{LATER}' end as created_at,
           '{LATER}' as updated_at from staged
    union all select title, company, location, salary, description, link, skills, '{EARLIER}', '{EARLIER}' from stored
    where link not in (select link from staged)""",
)
def upsert_extracted(spark, sf_dir):
    rows = event_jobs(spark, sf_dir)
    old, new = (rows.filter(F.col("fetched_at") < timestamp(HALFWAY)), tables.scan_since(rows, timestamp(HALFWAY)))
    nothing = empty_table(spark, EXTRACTED_JOBS)
    before = stage(merge.upsert_extracted(nothing, old, ["event_id"], zoned(EARLIER)), "stored-jobs")
    merged = merge.upsert_extracted(before, new, ["event_id"], zoned(LATER))
    return merged.withColumns({"created_at": as_text("created_at"), "updated_at": as_text("updated_at")})


@query(
    "k4_delete_by_urls",
    f"""with {SQL_LAST_PAGES}
    select url, content_type, raw_content, strftime(fetched_at, '%Y-%m-%d %H:%M:%S') as fetched_at from stored
    where url not in (select url from new where content_type = 'purchase' and fetched_at >= timestamp '2024-01-28')""",
)
def delete_by_urls(spark, sf_dir):
    new = tables.scan_since(event_pages(spark, sf_dir), timestamp("2024-01-28 00:00:00"))
    kept = merge.delete_by_urls(stored_pages(spark, sf_dir), new.filter("content_type = 'purchase'").select("url"))
    return kept.select("url", "content_type", "raw_content", as_text("fetched_at"))


@query(
    "k5_append_job_listings",
    f"""select c_name as title, c_mktsegment as company, false as remote_flag, 'customers' as source,
        'https://example.com/customer/' || c_custkey as url, c_acctbal as salary_min, 'a,' || c_mktsegment as tags,
        '{LATER}' as crawl_timestamp, cast(null as varchar) as reason from customer where abs(c_acctbal) < 9000
    union all select c_name, c_mktsegment, null, 'customers', 'https://example.com/customer/' || c_custkey, c_acctbal,
        'a,' || c_mktsegment, null, 'salary out of range' from customer where abs(c_acctbal) >= 9000""",
)
def append_job_listings(spark, sf_dir):
    return shown_listings(*merge.append_job_listings(customer_listings(spark, sf_dir), timestamp(LATER)))


def customer_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("title"),
        F.col("c_mktsegment").alias("company"),
        F.lit("customers").alias("source"),
        F.concat(F.lit("https://example.com/customer/"), "c_custkey").alias("url"),
        F.col("c_acctbal").alias("salary_min"),
        F.when(F.abs("c_acctbal") >= 9000, F.lit(1e20)).alias("salary_max"),
        F.array(F.lit("a"), "c_mktsegment").alias("tags"),
    )


def shown_listings(rows: DataFrame, rejected: DataFrame) -> DataFrame:
    shown = ["title", "company", "remote_flag", "source", "url", F.col("salary_min").cast("double").alias("salary_min")]
    shown += [F.array_join("tags", ",").alias("tags"), as_text("crawl_timestamp"), "reason"]
    return rows.withColumn("reason", F.lit(None).cast("string")).select(*shown).union(rejected.select(*shown))


# The same on tables stored in buckets


def bucket_table(spark: SparkSession, schema, key: str, lookups: tuple[str, ...] = ()) -> BucketTable:
    return BucketTable(spark, f"{staging_root(spark)}/buckets-{uuid.uuid4().hex}", schema, key, buckets=16, lookups=lookups)


def stored_page_table(spark: SparkSession, sf_dir: str) -> BucketTable:
    """Pages of the first half, with the time they were fetched at."""
    pages = bucket_table(spark, RAW_PAGES, "url")
    pages.commit(stored_pages(spark, sf_dir))
    return pages


@query("k1_upsert_stored_pages", _SQL["k1_upsert_raw_pages"])
def upsert_stored_pages(spark, sf_dir):
    pages = stored_page_table(spark, sf_dir)
    new = tables.scan_since(event_pages(spark, sf_dir), timestamp(HALFWAY))
    stored.upsert_raw_pages(pages, new, ["event_id"], timestamp(LATER))
    return pages.read().select("url", "content_type", "raw_content", as_text("fetched_at"))


@query("k2_append_stored", _SQL["k2_append_extracted"])
def append_stored(spark, sf_dir):
    done = bucket_table(spark, EXTRACTED_JOBS, "link")
    stored.append_extracted(done, supplier_jobs(spark, sf_dir), zoned(EARLIER))
    stored.append_extracted(done, part_jobs(spark, sf_dir), zoned(LATER))
    return done.read().withColumns({"created_at": as_text("created_at"), "updated_at": as_text("updated_at")})


@query("k3_upsert_stored", _SQL["k3_upsert_extracted"])
def upsert_stored(spark, sf_dir):
    rows = event_jobs(spark, sf_dir)
    done = bucket_table(spark, EXTRACTED_JOBS, "link")
    stored.upsert_extracted(done, rows.filter(F.col("fetched_at") < timestamp(HALFWAY)), ["event_id"], zoned(EARLIER))
    stored.upsert_extracted(done, tables.scan_since(rows, timestamp(HALFWAY)), ["event_id"], zoned(LATER))
    return done.read().withColumns({"created_at": as_text("created_at"), "updated_at": as_text("updated_at")})


@query("k4_delete_stored_urls", _SQL["k4_delete_by_urls"])
def delete_stored_urls(spark, sf_dir):
    pages = stored_page_table(spark, sf_dir)
    new = tables.scan_since(event_pages(spark, sf_dir), timestamp("2024-01-28 00:00:00"))
    stored.delete_by_urls(pages, new.filter("content_type = 'purchase'").select("url"))
    return pages.read().select("url", "content_type", "raw_content", as_text("fetched_at"))


@query("k5_append_stored_listings", _SQL["k5_append_job_listings"])
def append_stored_listings(spark, sf_dir):
    done = bucket_table(spark, JOB_LISTINGS, "url")
    rejected = stored.append_job_listings(done, customer_listings(spark, sf_dir), timestamp(LATER))
    return shown_listings(done.read(), rejected)


@query(
    "s3_lookup_stored",
    "select p_name as title, p_brand as company, 'https://example.com/part/' || p_partkey as link from part "
    "where p_brand = 'Brand#13'",
)
def lookup_stored(spark, sf_dir):
    done = bucket_table(spark, EXTRACTED_JOBS, "link", ("company", "title", "link"))
    stored.append_extracted(done, supplier_jobs(spark, sf_dir), zoned(EARLIER))
    stored.append_extracted(done, part_jobs(spark, sf_dir), zoned(LATER))
    return done.lookup("company", "Brand#13").select("title", "company", "link")


# Jobs


def fetch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch results: each line item as two results, one of its part's and one of its supplier's page, and the pages."""
    part, supplier = shop("part", "l_partkey"), shop("supplier", "l_suppkey")
    line = F.concat(F.lit("/offer/"), "l_orderkey", F.lit("-"), "l_linenumber")

    def result(url: Column, body: Column) -> Column:
        return F.struct(url.alias("url"), F.concat(url, line).alias("result_url"), body.alias("body"))

    of_part = F.concat(
        F.lit('<p><a href="/supplier/'), "l_suppkey", F.lit('">s</a><a href=\'https://flags.example.net/'),
        "l_returnflag", F.lit("'>f</a>"),
    )
    of_supplier = F.concat(
        F.lit('<p><a href="../part/'), "l_partkey", F.lit('">p</a><a href=//orders.example.com/order/'),
        "l_orderkey", F.lit(">o</a>"),
    )
    lines = tables.spread(table(spark, sf_dir, "lineitem")).select(
        F.inline(F.array(result(part, of_part), result(supplier, of_supplier)))
    )
    pages = pages_of(spark, sf_dir).select("url", F.col("url").alias("result_url"), F.col("html").alias("body"))
    return lines.unionByName(pages)


@query(
    "p1_crawl_to_raw",
    f"""with recursive {SQL_SHOP}, {SQL_REACH},
    results as (
        select 'https://shop.example.com/part/' || l_partkey as url, '/offer/' || l_orderkey || '-' || l_linenumber as line,
               '<p><a href="/supplier/' || l_suppkey || '">s</a><a href=''https://flags.example.net/' || l_returnflag
               || '''>f</a>' as body from lineitem
        union select 'https://shop.example.com/supplier/' || l_suppkey, '/offer/' || l_orderkey || '-' || l_linenumber,
               '<p><a href="../part/' || l_partkey || '">p</a><a href=//orders.example.com/order/' || l_orderkey
               || '>o</a>' from lineitem)
    select url || line as url, 'text/html' as content_type, max(body) as raw_content, '{LATER}' as fetched_at from results
    where url in (select url from reach where hop < 3) group by 1
    union all select url, 'text/html', html, '{LATER}' from pages
    where regexp_matches(url, '^https?://([^/?#]+\\.)?example\\.com[/?#]')""",
)
def crawl_to_raw(spark, sf_dir):
    seeds = shop_seeds(spark, sf_dir).union(pages_of(spark, sf_dir).select("url"))
    done = jobs.crawl_to_raw(
        seeds, stage(fetch_results(spark, sf_dir), "fetch-results"), DOMAINS, order=["body"], max_depth=3, now=timestamp(LATER)
    )
    return done.raw_pages.select("url", "content_type", "raw_content", as_text("fetched_at"))


@query(
    "p1_rejected",
    """select 'https://shop.example.com/part/' || l_partkey || '/offer/' || l_orderkey || '-' || l_linenumber as url,
        'text/html' as content_type, 'missing: raw_content' as reason
    from lineitem join part on p_partkey = l_partkey where p_brand = 'Brand#13' and l_returnflag = 'R'""",
)
def rejected_results(spark, sf_dir):
    """Fetched results without a body, of the pages that were reached."""
    page = shop("part", "l_partkey")
    results = tables.spread(table(spark, sf_dir, "lineitem")).select(
        page.alias("url"),
        F.concat(page, F.lit("/offer/"), "l_orderkey", F.lit("-"), "l_linenumber").alias("result_url"),
        F.when(F.col("l_returnflag") != "R", F.lit("<p>offer")).alias("body"),
    )
    done = jobs.crawl_to_raw(shop_seeds(spark, sf_dir), results, DOMAINS, order=["result_url"], max_depth=1, now=timestamp(LATER))
    return done.rejected.select("url", "content_type", "reason")


def answer_with_page(batches):
    """An extractor whose answer is the page itself, as the test pages are answers already."""
    for batch in batches:
        answer = batch["prompt"].str.removeprefix(extract.PROMPT)
        yield batch[["url", "fetched_at"]].assign(response=answer)


def answer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses(spark, sf_dir).select(
        "url",
        F.lit("text/html").alias("content_type"),
        F.col("response").alias("raw_content"),
        timestamp(EARLIER).alias("fetched_at"),
    )


def parse_tables(spark: SparkSession, kind: str = "snapshots") -> tuple[stored.Table, stored.Table, str]:
    root = f"{staging_root(spark)}/parse-{uuid.uuid4().hex}"
    if kind == "buckets":
        raw = BucketTable(spark, f"{root}/raw", RAW_PAGES, "url", buckets=16)
        extracted = BucketTable(spark, f"{root}/extracted", EXTRACTED_JOBS, "link", buckets=16)
    else:
        raw = SnapshotTable(spark, f"{root}/raw", RAW_PAGES, sort_by="fetched_at")
        extracted = SnapshotTable(spark, f"{root}/extracted", EXTRACTED_JOBS, sort_by="link", bloom=("company", "title"))
    return raw, extracted, f"{root}/failures"


def shown_jobs(extracted: DataFrame) -> DataFrame:
    return extracted.select("title", "company", "description", "skills", "link", as_text("created_at"), as_text("updated_at"))


SQL_STORED_JOBS = f"""with {SQL_JOBS}
    select title, company, description, skills, url as link, '{LATER}' as created_at, '{LATER}' as updated_at
    from jobs where pos = 1"""


@query("p2_parse_to_extracted", SQL_STORED_JOBS)
def parse_to_extracted(spark, sf_dir):
    raw, extracted, failures = parse_tables(spark)
    raw.commit(answer_pages(spark, sf_dir))
    jobs.parse_to_extracted(raw, extracted, failures, answer_with_page, timestamp(EARLIER), now=zoned(LATER))
    return shown_jobs(extracted.read())


def answer_but_first_turns(batches):
    """An extractor that fails on the first turn of a conversation, whole batches with it."""
    for batch in batches:
        bad = batch["url"][batch["url"].str.endswith("/1")]
        if len(bad):
            raise ValueError(f"cannot read {bad.iloc[0]}")
        yield from answer_with_page([batch])


@query(
    "p2_record_links",
    f"""with {SQL_JOBS}
    select title, company, description, skills, link, '{LATER}' as created_at, '{LATER}' as updated_at from (
        select *, case when pos = 0 then own_link else url || regexp_replace(md5(url || chr(10) || pos),
            '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') end as link from jobs)
    qualify row_number() over (partition by link order by url desc, pos desc) = 1""",
)
def parse_record_links(spark, sf_dir):
    """P2 with the records' own links; the second record of each page has none."""
    raw, extracted, failures = parse_tables(spark, "buckets")
    raw.commit(answer_pages(spark, sf_dir).withColumn("raw_content", F.replace("raw_content", F.lit('"/again"'), F.lit('" "'))))
    jobs.parse_to_extracted(raw, extracted, failures, answer_with_page, timestamp(EARLIER), link_from="record", now=zoned(LATER))
    return shown_jobs(extracted.read())


@query(
    "p2_extractor_errors",
    f"""with {SQL_JOBS}
    select 'https://talk.example.com/' || conv_id || '/' || turn as url, cast(null as varchar) as title,
        case when turn = 1 then 'ValueError: cannot read https://talk.example.com/' || conv_id || '/' || turn else {SQL_STATUS} end as reason
    from conversations where turn = 1 or {SQL_STATUS} not in ('ok', 'empty')
    union all select url, title, null from jobs where pos = 1 and turn <> 1""",
)
def parse_past_errors(spark, sf_dir):
    """P2 with failing pages among good ones: what was stored, and each failed page with its reason."""
    raw, extracted, failures = parse_tables(spark, "buckets")
    raw.commit(answer_pages(spark, sf_dir))
    jobs.parse_to_extracted(raw, extracted, failures, answer_but_first_turns, timestamp(EARLIER), now=zoned(LATER))
    failed = spark.read.parquet(f"{failures}/*")
    done = extracted.read().select(F.col("link").alias("url"), "title", F.lit(None).cast("string").alias("reason"))
    return done.union(failed.select("url", F.lit(None).cast("string"), "reason"))


@query("p2_parse_stream", SQL_STORED_JOBS)
def parse_as_stream(spark, sf_dir):
    raw, extracted, failures = parse_tables(spark)
    answer_pages(spark, sf_dir).write.parquet(raw.root)
    stream = parse_stream(
        spark, raw.root, extracted, failures, f"{failures}-checkpoint", answer_with_page, now=zoned(LATER)
    )
    stream.awaitTermination()
    return shown_jobs(extracted.read())


@query(
    "p2_stream_deletes",
    f"""select 'https://talk.example.com/' || conv_id || '/' || turn as url, '{LATER}' as fetched_at
    from conversations where conv_id % 7 = 0""",
)
def stream_deletes(spark, sf_dir):
    """P2 as a stream that deletes used pages: of its raw table those fetched again meanwhile are left."""
    raw, extracted, failures = parse_tables(spark, "buckets")
    arrived = answer_pages(spark, sf_dir)
    arrived.write.parquet(f"{failures}-arrivals")
    again = F.element_at(F.split("url", "/"), -2).cast("long") % 7 == 0
    raw.commit(arrived.withColumn("fetched_at", F.when(again, timestamp(LATER)).otherwise(F.col("fetched_at"))))
    stream = parse_stream(
        spark, f"{failures}-arrivals", extracted, failures, f"{failures}-checkpoint", answer_with_page, now=zoned(LATER),
        raw=raw, consumed_path=f"{failures}-consumed",
    )
    stream.awaitTermination()
    return raw.read().select("url", as_text("fetched_at"))


@query(
    "p3_cards_to_extracted",
    f"""with cards as (
        select page_id, url, unnest(range(len(hrefs))) as pos, unnest(hrefs) as href, unnest(texts) as title
        from (select page_id, url, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) as hrefs,
                     regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) as texts from pages)),
    linked as (
        select *, regexp_extract(url, '^https?://[^/?#]+') || replace(replace(url_encode(href), '%2F', '/'), '%2C', ',') as link
        from cards)
    select {sql_text("title")} as title, '' as company, '' as description, '' as skills, link,
           '{LATER}' as created_at, '{LATER}' as updated_at from linked
    qualify row_number() over (partition by link order by page_id desc, pos desc) = 1""",
)
def cards_to_extracted(spark, sf_dir):
    merged = jobs.cards_to_extracted(
        pages_of(spark, sf_dir),
        empty_table(spark, EXTRACTED_JOBS),
        order=["page_id"],
        container="nav li",
        fields={"title": extract.Field("a"), "link": extract.Field("a", attribute="href")},
        now=zoned(LATER),
    )
    return shown_jobs(merged)


@query(
    "f0_next_frontier",
    f"""with {SQL_LINKS} select distinct dst as url from links
    where regexp_matches(dst, '^https?://([^/?#]+\\.)?example\\.com(/|$)') and dst not in (select url from pages)""",
)
def next_frontier(spark, sf_dir):
    pages = pages_of(spark, sf_dir)
    found = links.explode_udf(links.page_targets(pages), F.col("dsts"), "pos", "url").select("url")
    allowed = links.filter_allowed_domains(found, DOMAINS, url="url")
    return crawl.mark_visited(allowed, pages.select("url"))
