"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Texts become runs of letters and digits in lower case. A seed reads a span of words through a fixed mask, which
ignores a position; equal seeds of a document and an item put them on a diagonal. Around a hit, the item's words are compared with the
document's on that diagonal and on those up to ``BAND`` words to either side. Of the ways through this band that end on each diagonal the
one with the best score is followed, where each word put in or left out counts as one that differs. A run along it, or along the hit's
own diagonal, is a leak if it has ``least_words`` words or more of the item and of the document, or all words of a shorter item, of which
``percent`` agree. At 80 % of 13 words and more, changed words leave a seed in every placement; of shorter items too, down to one word.

Null or empty texts match nothing, nor do rows or items without an id. Rows that repeat an id count as one document each, of which the
best overlap is told. Only ids and diagonals of hits are joined with texts; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.session import stage

#: Of 8, 9 and 11 words or more with 80 % equal, some five stand so.
MASKS = ((0, 1, 2, 4),)
#: For items of so few words, and of ten, where two may differ. One of five words may differ, none of fewer.
SHORT = {1: ((0,),), 2: ((0, 1),), 3: ((0, 2),), 4: ((0, 1, 3),), 5: ((0, 1, 3), (0, 2, 3)), 6: ((0, 1, 3),), 7: ((0, 1, 3),), 10: ((0, 1, 3),)}
BAND = 2
OUT = -1_000_000


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _seeds(words: Column, masks: list[tuple[int, ...]]) -> Column:
    """Array of (seed, pos) of every mask at every position."""

    def of(mask: tuple[int, ...]) -> Column:
        last = F.size(words) - 1 - mask[-1]
        places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(F.xxhash64(F.lit(str(mask)), *[F.get(words, i + F.lit(p)) for p in mask]).alias("seed"), i.alias("pos")))

    return F.flatten(F.array(*[of(mask) for mask in masks]))


def _may_leak(words: Column, item: Column, shift: Column, percent: int, least: Column) -> Column:
    """Whether a run has enough words that the document holds within the band; each leak does."""

    def near(w: Column, q: Column) -> Column:
        begin = F.greatest(q + shift - BAND, F.lit(0))
        return F.array_contains(F.slice(words, begin + 1, F.greatest(q + shift + BAND + 1 - begin, F.lit(0))), w)

    worth = F.transform(item, lambda w, q: F.when(near(w, q), 100 - percent).otherwise(-percent))
    sums = F.aggregate(worth, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
    return F.exists(F.sequence(least, F.size(item)), lambda j: F.get(sums, j) >= F.array_min(F.slice(sums, 1, j - least + 1)))


def _same(words: Column, item: Column, shift: Column) -> Column:
    """For each item word, whether it equals the document's on each diagonal of the band; null outside the document."""
    at = lambda w, q, d: F.when(q + shift + d >= 0, F.get(words, q + shift + d) == w)
    return F.transform(item, lambda w, q: F.array(*[at(w, q, d) for d in range(-BAND, BAND + 1)]))


_PATH = "struct<score:int,sums:array<int>,equal:array<int>,shift:array<int>>"


def _worth(same: Column, percent: int) -> Column:
    return F.when(same.isNull(), OUT).when(same, 100 - percent).otherwise(-percent)


def _hit(same: Column) -> Column:
    return F.coalesce(same, F.lit(False)).cast("int")


def _longer(path: Column, score: Column, equal, shift) -> Column:
    """A path one item word further; its arrays have a sum before each word and one after the last."""
    return F.struct(
        score.cast("int").alias("score"),
        F.array_append(path["sums"], score.cast("int")).alias("sums"),
        F.array_append(path["equal"], (F.element_at(path["equal"], -1) + equal).cast("int")).alias("equal"),
        F.array_append(path["shift"], shift).alias("shift"),
    )


def _paths(rows: Column, percent: int) -> Column:
    """The best path through the band to each of its diagonals, in one pass over the item."""
    width = 2 * BAND + 1
    zero = F.array(F.lit(0))
    start = F.struct(F.lit(0).alias("score"), zero.alias("sums"), zero.alias("equal"), F.array().cast("array<int>").alias("shift"))

    def step(state: Column, same: Column) -> Column:
        def reached(path: Column, k: Column) -> Column:
            on = _longer(path, path["score"] + _worth(F.get(same, k), percent), _hit(F.get(same, k)), k - BAND)
            # An item word that the document lacks.
            before = F.get(state, k + 1)
            return F.when(k < width - 1, F.greatest(on, _longer(before, before["score"] - percent, F.lit(0), k - BAND))).otherwise(on)

        def put_in(cells: Column) -> Column:
            """Words of the document that the item lacks."""

            def back(k: Column, by: int) -> Column:
                path = F.get(cells, k - by)
                score = (path["score"] - percent * by).cast("int")
                sums = F.array_append(F.slice(path["sums"], 1, F.size(path["sums"]) - 1), score)
                return F.when(k >= by, F.struct(score.alias("score"), sums.alias("sums"), path["equal"].alias("equal"), path["shift"].alias("shift")))

            return F.transform(cells, lambda c, k: F.greatest(c, *[back(k, by) for by in range(1, width)]))

        return F.get(F.transform(F.array(F.transform(state, reached)), put_in), F.lit(0)).cast(f"array<{_PATH}>")

    return F.aggregate(rows, F.array_repeat(start.cast(_PATH), width), step)


def _plain(rows: Column, percent: int) -> Column:
    """The path along the hit's own diagonal."""
    own = F.transform(rows, lambda same: F.get(same, F.lit(BAND)))
    sums = F.aggregate(own, F.array(F.lit(0)), lambda a, x: F.array_append(a, (F.element_at(a, -1) + _worth(x, percent)).cast("int")))
    equal = F.aggregate(own, F.array(F.lit(0)), lambda a, x: F.array_append(a, (F.element_at(a, -1) + _hit(x)).cast("int")))
    return F.struct(F.element_at(sums, -1).alias("score"), sums.alias("sums"), equal.alias("equal"), F.array_repeat(F.lit(0), F.size(rows)).alias("shift")).cast(_PATH)


def _run(path: Column, shift: Column, percent: int, least: Column, least_words: int) -> Column:
    """A path's run with the most equal words, of these the shortest, as (equal, -words, -doc_start), or null.

    A run is a leak if its sum is not negative. For each last word the longest such run begins where the sums first fell to what they
    are after it; words that differ at its front are dropped again.
    """
    n = F.size(path["shift"])
    falls = F.aggregate(path["sums"], F.array().cast("array<int>"), lambda a, x: F.array_append(a, F.least(F.coalesce(F.get(a, F.size(a) - 1), x), x)))

    def ending(fallen: Column, j: Column) -> Column:
        after = F.get(path["sums"], j)
        first = F.array_position(F.transform(fallen, lambda m: m <= after), True).cast("int") - 1
        front = F.array_position(path["equal"], F.get(path["equal"], first) + 1).cast("int") - 2
        begin = F.least(F.when(front >= first, front).otherwise(first), j - least)
        equal, score = F.get(path["equal"], j) - F.get(path["equal"], begin), after - F.get(path["sums"], begin)
        others = ((equal * (100 - percent) - score) / percent).cast("int")
        doc_words = j - begin + F.get(path["shift"], j - 1) - F.get(path["shift"], begin)
        fits = (first <= j - least) & (score >= 0) & ((n < least_words) | (doc_words >= least))
        at = F.greatest(begin + shift + F.get(path["shift"], begin), F.lit(0))
        return F.when(fits, F.struct(equal.cast("int").alias("equal"), (-equal - others).cast("int").alias("less"), (-at).cast("int").alias("from")))

    every = lambda fallen: F.array_max(F.transform(F.sequence(least, n), lambda j: ending(fallen, j)))
    return F.get(F.transform(F.array(falls), every), F.lit(0))


def _best(rows: Column, shift: Column, percent: int, least: Column, least_words: int) -> Column:
    """The best run of a hit: along its own diagonal where all words of the item agree, else along any path."""
    run = lambda path: _run(path, shift, percent, least, least_words)
    plain = F.transform(F.array(_plain(rows, percent)), run)
    whole = lambda found: F.when(F.get(found, F.lit(0))["equal"] == F.size(rows), found).otherwise(F.concat(found, F.transform(_paths(rows, percent), run)))
    return F.array_max(F.get(F.transform(F.array(plain), whole), F.lit(0)))


def leaks(docs: DataFrame, items: DataFrame, percent: int = 80, least_words: int = 13) -> DataFrame:
    """(doc_id, item_id, doc_start, n_words, n_equal): the best overlap of each document and item that leaks."""
    bench = stage(items.select("item_id", tokens(F.col("text")).alias("item")).filter("item_id is not null and size(item) > 0"), "items")
    texts = docs.select("doc_id", "text").filter("doc_id is not null")
    short = [r.n for r in bench.select(F.size("item").alias("n")).filter(F.col("n").isin(*SHORT)).distinct().collect()]
    masks = list(dict.fromkeys([*MASKS, *(m for n in sorted(short) for m in SHORT[n])]))
    # The masks of short items are theirs alone.
    none = F.array().cast("array<struct<seed:bigint,pos:int>>")
    of = F.flatten(F.array(_seeds(F.col("item"), list(MASKS)), *[F.when(F.size("item") == n, _seeds(F.col("item"), list(SHORT[n]))).otherwise(none) for n in sorted(short)]))
    keys = stage(bench.select("item_id", F.explode(of).alias("s")).select("item_id", "s.seed", F.col("s.pos").alias("q")), "item-seeds")
    doc = texts.select("doc_id", tokens(F.col("text")).alias("words"))
    seeds = doc.select("doc_id", F.explode(_seeds(F.col("words"), masks)).alias("s")).select("doc_id", "s.seed", F.col("s.pos").alias("p"))
    hits = stage(seeds.join(keys, "seed").select("doc_id", "item_id", (F.col("p") - F.col("q")).alias("shift")).distinct(), "hits")
    # Texts without a hit stay where they are while the list of hits is small.
    words = texts.join(stage(hits.select("doc_id").distinct(), "hit-documents"), "doc_id", "left_semi").select("doc_id", tokens(F.col("text")).alias("words"))
    both = hits.join(bench, "item_id").join(words, "doc_id")
    least = F.least(F.lit(least_words), F.size("item"))
    args = F.col("words"), F.col("item"), F.col("shift")
    near = both.filter(_may_leak(*args, percent, least)).select("doc_id", "item_id", "shift", least.alias("least"), _same(*args).alias("same"))
    near = stage(near, "near")  # spread evenly again: comparing costs more than finding
    near = near.repartition(max(near.sparkSession.sparkContext.defaultParallelism, near.rdd.getNumPartitions()), "doc_id", "item_id", "shift")
    best = near.select("doc_id", "item_id", _best(F.col("same"), F.col("shift"), percent, F.col("least"), least_words).alias("best"))
    kept = best.filter("best is not null").groupBy("doc_id", "item_id").agg(F.max("best").alias("b"))
    return kept.select("doc_id", "item_id", (-F.col("b.from")).cast("long").alias("doc_start"), (-F.col("b.less")).cast("long").alias("n_words"), F.col("b.equal").cast("long").alias("n_equal"))
