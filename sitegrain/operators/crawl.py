"""Visited sets and bounded expansion of the link graph."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.functions import urls
from sitegrain.operators.keys import rows_with_keys
from sitegrain.operators.links import with_allowed, with_udf
from sitegrain.operators.visits import VisitedSet
from sitegrain.session import fits_broadcast, stage
from sitegrain.sources.layout import lay_out


def fetch_stored_pages(frontier: DataFrame, pages: DataFrame, key: str = "url") -> DataFrame:
    """Stored rows of the frontier's URLs; a URL may have several rows."""
    return rows_with_keys(pages, frontier, [key])


def mark_visited(discovered: DataFrame, visited: DataFrame, url: str = "url") -> DataFrame:
    """L4: URLs seen for the first time, once each. Exact string match: ``x`` and ``x#a`` differ."""
    # Counting drops NULLs after the aggregate; a filter would be moved below and run UDFs twice.
    fresh = discovered.groupBy(url).agg(F.count(url).alias("_seen")).filter("_seen > 0").select(url)
    return fresh.join(visited.select(url), url, "left_anti")


def is_visited(candidates: DataFrame, visited: DataFrame, url: str = "url", to: str = "visited") -> DataFrame:
    """Add a flag telling whether the URL is in ``visited``; a URL may stand there several times.

    The distinct URLs are staged, as without an aggregate below the join Spark can split a hot URL's candidates.
    """
    known = stage(visited.select(url).distinct(), "known").select(url, F.lit(True).alias(to))
    return candidates.join(known, url, "left").withColumn(to, F.coalesce(F.col(to), F.lit(False)))


def expand_frontier(
    frontier: DataFrame, edges: DataFrame, allowed_domains: Iterable[str], visited: DataFrame
) -> DataFrame:
    """One hop from ``frontier(url, depth)`` to the unvisited ``(url, depth)`` it links to.

    ``edges`` is ``(src, dst)`` or ``(src, dsts)``. The second keeps one row per page through the
    join and fans out after it. Rows without depth left or off the domains expand to nothing, but
    being linked to still counts as visited. A frontier may bring the domain test as ``allowed``.
    """
    if "allowed" not in frontier.columns:
        # Behind a generator, so that Spark does not repeat the test on the source of every edge.
        frontier = with_udf(frontier, "allowed", urls.on_domain(F.col("url"), allowed_domains))
    active = frontier.filter("depth > 0 and allowed").select(F.col("url").alias("src"), "depth")
    reached = edges.join(active, "src")
    target = F.explode("dsts") if "dsts" in edges.columns else F.col("dst")
    children = reached.select(target.alias("url"), (F.col("depth") - 1).alias("depth"))
    fresh = children.filter(F.col("url").isNotNull()).groupBy("url").agg(F.max("depth").alias("depth"))
    return fresh.join(visited.select("url"), "url", "left_anti")


def crawl_bounded(
    seeds: DataFrame,
    edges: DataFrame,
    allowed_domains: Iterable[str] | DataFrame,
    max_depth: int,
    stored: DataFrame | None = None,
    visited: DataFrame | None = None,
    known: VisitedSet | None = None,
) -> DataFrame:
    """Breadth-first reach from ``seeds(url)``: ``(url, hop, depth_left, outcome)``.

    Pages at hops ``0 .. max_depth - 1`` are fetched; hop ``max_depth`` is only discovered. ``edges`` is ``(src, dst)`` or
    ``(src, dsts)``; it is laid out by ``src`` once, and at each hop only the frontier moves. ``stored(url)`` tells which pages exist;
    by default those with edges. URLs in ``visited`` or ``known`` are never entered.
    """
    laid = lay_out(edges, "src", "edges")

    def children(active: DataFrame) -> DataFrame:
        reached = laid.joined(active.withColumnRenamed("url", "src"))
        return reached.select((F.explode("dsts") if "dsts" in edges.columns else F.col("dst")).alias("url"))

    pages = laid.rows.select(F.col("src").alias("url")) if stored is None else stored.select("url")
    return walk(seeds, children, pages, allowed_domains, max_depth, visited, known)


def walk(
    seeds: DataFrame,
    children: Callable[[DataFrame], DataFrame],
    pages: DataFrame,
    allowed_domains: Iterable[str] | DataFrame,
    max_depth: int,
    visited: DataFrame | None = None,
    known: VisitedSet | None = None,
    once: bool = False,
) -> DataFrame:
    """L7 with any source of links: ``children`` gives the ``url`` that the pages of a frontier ``(url)`` link to.

    It is called once a hop, with URLs of that hop alone. Each hop is one job written to the staging folder, so plans stay short and the
    sizes of frontier and visited set are known to the planner. ``pages(url)`` are those that exist; ``once`` tells that
    each is listed once, so that a long frontier is compared with them but one time.
    """
    domains = allowed_domains if isinstance(allowed_domains, DataFrame) else list(allowed_domains)

    def staged(level: DataFrame, hop: int) -> DataFrame:
        if known is not None:
            level = known.unvisited(level)
        return stage(with_allowed(level, domains).withColumn("hop", F.lit(hop)), f"hop-{hop}")

    start = seeds.select("url").filter(F.col("url").isNotNull()).distinct()
    before = [] if visited is None else [visited.select("url")]
    for listed in before:
        start = start.join(listed, "url", "left_anti")
    levels = [staged(start, 0)]
    for hop in range(1, max_depth + 1):
        found = children(levels[-1].filter("allowed").select("url")).filter(F.col("url").isNotNull()).distinct()
        seen = reduce(DataFrame.union, [level.select("url") for level in levels] + before)
        level = staged(found.join(seen, "url", "left_anti"), hop)
        if level.isEmpty():
            break
        levels.append(level)
    reached = reduce(DataFrame.unionByName, levels)
    to_fetch = reached.filter((F.col("hop") < max_depth) & F.col("allowed")).select("url")
    found = pages.select("url")
    if not once or fits_broadcast(to_fetch):
        found = rows_with_keys(found, to_fetch, ["url"]).distinct()
    found = found.withColumn("_found", F.lit(True))
    outcome = (
        F.when(F.col("hop") >= max_depth, "depth_exhausted")
        .when(~F.col("allowed"), "off_domain")
        .when(F.col("_found"), "fetched")
        .otherwise("no_page")
    )
    left = F.lit(max_depth) - F.col("hop")
    return reached.join(found, "url", "left").select("url", "hop", left.alias("depth_left"), outcome.alias("outcome"))
