"""Near-duplicate documents by SuperMinHash signatures, banding, verification and grouping.

Words are lower-cased (A-Z); a document's set holds its distinct runs of ``size`` words, or the whole sequence if it has fewer.
Null, empty or blank text: an empty set, linked with nothing. Equal sets form one class first, so that copies are
not paired. Classes that share a band are compared with the band's least member, then with a few other hubs; then, within bands that
still hold several components, members of different components with each other. Bands with many such members
are paired by their rarest shingles instead, under bounds that lose no link, so no group is paired out. Every link is confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.words import fingerprints, mix, windows, words
from sitegrain.operators.links import PLACE, rows_at, with_places
from sitegrain.session import fits_broadcast, stage

SLOTS, ROWS = 128, 4
SLACK = 0.21  # six standard deviations of the share of slots that agree
COUNTERS = 1 << 16  # of shingles, by their first 16 bits: half a megabyte, whatever the input
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct fingerprints of a text's shingles."""
    if not text:
        return np.empty(0, np.uint64)
    values = fingerprints(text.encode("utf-8", "surrogatepass").translate(_LOWER).split())
    return np.unique(windows(values, min(size, len(values)))) if len(values) else np.empty(0, np.uint64)


def signature(elements: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash: each element draws ranks r + j for the slots of a random permutation, step by step, until no slot can get lower."""
    low = np.full(slots, np.inf)
    rows = np.arange(len(elements))
    order = np.tile(np.arange(slots, dtype=np.int16), (len(elements), 1))
    with np.errstate(over="ignore"):
        for j in range(slots):
            if j > low.max():
                break
            drawn = mix(elements + _STEP * np.uint64(j + 1))
            rank = (drawn >> np.uint64(32)).astype(np.float64) / 2**32 + j
            k = j + ((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
            slot = order[rows, k]
            order[rows, k] = order[:, j]
            np.minimum.at(low, slot, rank)
    return low


def _many(elements: np.ndarray) -> np.ndarray:
    """The signature of a set of any size, in bounded memory."""
    parts = [signature(elements[i : i + 20_000]) for i in range(0, len(elements), 20_000)]
    return np.min(parts, axis=0)


def _brief(low: np.ndarray) -> np.ndarray:
    """Four bits of each slot, 16 slots a number: equal slots have equal bits."""
    bits = (mix(low.view(np.uint32).astype(np.uint64)) & np.uint64(15)).astype(np.uint8)
    return (bits[::2] | bits[1::2] << 4).view("<i8")


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """One row a document: id, set size, key of the whole set, key of each band, signature, four bits of each slot, and its other columns but the text."""
    others = [name for name in docs.columns if name not in ("doc_id", "text")]

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(ROWS)], np.uint64)
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"], b["text"]):
                s = shingles(text, size)
                if not len(s):
                    out.append((doc, 0, None, None, None, None))
                    continue
                low = _many(s)
                with np.errstate(over="ignore"):
                    bits = low.view(np.uint64).reshape(-1, ROWS)
                    bands = mix((mix(bits) * powers).sum(1) + np.arange(len(bits), dtype=np.uint64)).view(np.int64)
                    whole = f"{len(s)}:{int(s.sum()):x}:{int(mix(s).sum()):x}"
                low = low.astype(np.float32)
                out.append((doc, len(s), whole, bands, low, _brief(low)))
            made = pd.DataFrame(out, columns=["doc_id", "n_shingles", "whole", "bands", "sig", "brief"])
            yield made.assign(**{name: list(b[name]) for name in others})

    kinds = "".join(f", {name} {kind}" for name, kind in docs.dtypes if name in others)
    return docs.mapInPandas(sketch, f"doc_id long, n_shingles long, whole string, bands array<long>, sig array<float>, brief array<long>{kinds}")


def _may(x: str, y: str, least: float) -> Column:
    """Whether as many slots as ``_likely`` asks for may agree, by the bits of two ``brief`` columns. No pair that it would keep fails."""

    def differ(i: int) -> Column:
        bits = F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))
        bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 1))
        bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 2))
        return F.bit_count(bits.bitwiseAND(F.lit(0x1111111111111111)))

    return SLOTS - sum(differ(i) for i in range(SLOTS // 16)) >= least * SLOTS


def _likely(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """Pairs whose signatures agree in enough slots; the bound leaves six standard deviations below the threshold."""

    both = pairs.join(sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("_x")), "a").join(sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("_y")), "b")
    agree = F.size(F.filter(F.zip_with("_x", "_y", lambda x, y: x == y), lambda same: same))
    return both.filter(agree >= least * SLOTS).select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out, last, first = [], None, None
        for s, t in zip(x, y):
            if last != t:
                last, first = t, shingles(t, size)
            other = shingles(s, size)
            common = len(np.intersect1d(first, other, assume_unique=True))
            out.append(100 * common >= percent * (len(first) + len(other) - common))
        return pd.Series(out, dtype=bool)

    texts = docs.select("doc_id", "text")
    both = pairs.join(texts.withColumnsRenamed({"doc_id": "a", "text": "_s"}), "a").join(texts.withColumnsRenamed({"doc_id": "b", "text": "_t"}), "b")
    return both.filter(linked("_s", "_t")).select("a", "b")


def _links(pairs: DataFrame, sigs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Staged pairs that are links. While the documents they name are few enough to broadcast, signatures and texts of these alone move."""
    ids = stage(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "named")
    if fits_broadcast(ids):
        sigs, texts = (rows.join(ids, "doc_id", "left_semi") for rows in (sigs, texts))
    likely = stage(_likely(pairs, sigs, percent / 100 - SLACK), "likely")
    return stage(_verified(likely, texts, size, percent), "links")


def components(edges: DataFrame) -> DataFrame:
    """(v, root): the least vertex each one reaches. Labels travel along edges and are then shortened, until they stay."""
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
    both = stage(both.distinct(), "edges")
    labels = stage(both.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("w"), F.col("root").alias("_r")), "w").groupBy("v").agg(F.min("_r").alias("_n"))
        step = stage(labels.join(near, "v").select("v", F.least("root", "_n").alias("root"), F.col("root").alias("_old")), "labels")
        jump = step.select(F.col("v").alias("root"), F.col("root").alias("_up"))
        labels = stage(step.join(jump, "root").select("v", F.least("root", "_up").alias("root"), "_old"), "labels")
        if labels.filter("root != _old").isEmpty():
            return labels.select("v", "root")
        labels = labels.select("v", "root")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` after more links: only components that they join are labelled anew."""
    of = lambda v, to: roots.withColumnsRenamed({"v": v, "root": to})
    ends = links.join(of("a", "_p"), "a", "left").join(of("b", "_q"), "b", "left")
    ends = ends.select(F.coalesce("_p", "a").alias("a"), F.coalesce("_q", "b").alias("b"))
    new = stage(components(ends.distinct()), "joined")
    old = roots.join(new.select(F.col("v").alias("root"), F.col("root").alias("_up")), "root", "left")
    fresh = new.join(roots.select("v"), "v", "left_anti")
    return stage(old.select("v", F.coalesce("_up", "root").alias("root")).union(fresh.select("v", "root")), "labels")


def _mixed(members: DataFrame, roots: DataFrame, briefs: DataFrame) -> DataFrame:
    """(band, doc_id, root, _n, brief) of the bands whose members are in several components."""
    rest = members.join(roots.withColumnRenamed("v", "doc_id"), "doc_id", "left").select("band", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    mixed = rest.groupBy("band").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.count("*").alias("_n")).filter("_lo != _hi and _n > 2")
    return stage(rest.join(mixed.select("band", "_n"), "band").join(briefs, "doc_id"), "rest")


def _rare_pairs(members: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b) of different components that may reach ``percent``; no pair that does is left out.

    With shingles in one order, those of the lowest counters first, two sets that are alike enough share one among the first ``n - ceil(percent * n) + 1`` of each.
    At the first they share, what follows bounds their overlap; the parities of hashed shingles bound their difference from below.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc, text in zip(b["doc_id"], b["text"]):
                s = shingles(text, size)
                odd = np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=512) & 1
                yield pd.DataFrame({"doc_id": [doc], "n": [len(s)], "odd": [np.packbits(odd.astype(bool)).view(np.int64)], "shingles": [s.view(np.int64)]})

    sets = stage(docs.join(members, "doc_id", "left_semi").mapInPandas(cut, "doc_id long, n int, odd array<long>, shingles array<long>"), "sets")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            if len(b):
                total += np.bincount((np.concatenate(list(b["shingles"])).view(np.uint64) >> np.uint64(48)).astype(np.int64), minlength=COUNTERS)
        yield pd.DataFrame({"counts": [total.tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for x in b["counts"]:
                total += np.frombuffer(x, np.int64)
        yield pd.DataFrame({"counts": [total.tobytes()]})

    partial = stage(sets.select("shingles").mapInPandas(count, "counts binary"), "counts")
    several = partial.repartition(max(1, round(partial.count() ** 0.5))).mapInPandas(add, "counts binary")
    often = np.frombuffer(several.repartition(1).mapInPandas(add, "counts binary").first()[0], np.int64)

    def head(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc, n, odd, s in zip(b["doc_id"], b["n"], b["odd"], b["shingles"]):
                s = np.asarray(s, np.int64)
                seen = often[(s.view(np.uint64) >> np.uint64(48)).astype(np.int64)]
                at = np.arange(n - -(-n * percent // 100) + 1)
                order = np.lexsort((s, seen))[at]
                # A counter of one: no other document holds the shingle, so only its place counts.
                at, order = at[seen[order] > 1], order[seen[order] > 1]
                if len(at):
                    yield pd.DataFrame({"doc_id": np.full(len(at), doc), "n": np.full(len(at), n, np.int32), "odd": [odd] * len(at), "shingle": s[order], "at": at.astype(np.int32)})

    keyed = stage(sets.mapInPandas(head, "doc_id long, n int, odd array<long>, shingle long, at int").join(members, "doc_id"), "heads")
    x, y = keyed.alias("x"), keyed.alias("y")
    both = F.col("x.n") + F.col("y.n")
    after = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    apart = sum(F.bit_count(F.get("x.odd", F.lit(i)).bitwiseXOR(F.get("y.odd", F.lit(i)))) for i in range(8))
    fits = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.doc_id") > F.col("y.doc_id")) & (F.col("x.root") != F.col("y.root"))
    fits &= (after * (100 + percent) >= both * percent) & (apart * (100 + percent) <= both * (100 - percent))
    return x.join(y, fits).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 80, crowd: int = 64, hubs: int = 3) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``; a null id keeps to itself.

    Of rows with one id, one stands for it in comparisons. Signatures and texts are picked by the rows' places and do not move for it.
    """
    docs = with_places(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *PLACE)
    sigs = stage(signatures(docs, size), "signatures")
    first = sigs.filter("whole is not null and doc_id is not null").groupBy("whole").agg(F.min(F.struct("doc_id", *PLACE)).alias("_row"))
    heads = stage(first.select("whole", F.col("_row.doc_id").alias("head"), F.struct(*[f"_row.{name}" for name in PLACE]).alias("_at")), "heads")
    own = stage(heads.groupBy(F.col("head").alias("doc_id")).agg(F.min("_at").alias("_at")).select("doc_id", "_at.*"), "classes")
    bands = rows_at(sigs, own).select("doc_id", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("_m")).filter("b != _m").select("band", "b")
    members = stage(bands.join(shared, "band"), "bands")
    inside = stage(own.join(members.select("doc_id").distinct(), "doc_id", "left_semi").select(*PLACE), "inside")
    texts = stage(rows_at(docs, inside).select("doc_id", "text"), "texts")
    sketches = stage(rows_at(sigs, inside).select("doc_id", "sig"), "sketches")
    briefs = stage(rows_at(sigs, inside).select("doc_id", "brief"), "briefs")
    star = stage(members.filter("doc_id != b").select(F.col("doc_id").alias("a"), "b").distinct(), "star")
    roots = components(_links(star, sketches, texts, size, percent))
    tried, least = star, percent / 100 - SLACK
    for turn in range(1, hubs + 1):
        # Another member of each larger band that still holds several components is its hub, the same one in many bands.
        rest = _mixed(members, roots, briefs)
        rank = F.xxhash64("doc_id", F.lit(turn))
        hub = rest.filter(F.col("_n") > 8).groupBy("band").agg(F.min(F.struct(rank.alias("_k"), "doc_id", "root", "brief")).alias("h"))
        both = rest.join(hub, "band").filter("root != h.root").filter(_may("brief", "h.brief", least)).select(F.greatest("doc_id", "h.doc_id").alias("a"), F.least("doc_id", "h.doc_id").alias("b"))
        pairs = stage(both.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        tried = stage(tried.union(pairs), "tried")
        more = _links(pairs, sketches, texts, size, percent)
        if not more.isEmpty():
            roots = _joined(roots, more)
    rest = _mixed(members, roots, briefs)
    few = rest.filter(F.col("_n") <= crowd).select("band", "doc_id", "root", "brief")
    x, y = few.alias("x"), few.alias("y")
    fits = (F.col("x.band") == F.col("y.band")) & (F.col("x.doc_id") > F.col("y.doc_id")) & (F.col("x.root") != F.col("y.root"))
    close = x.join(y, fits & _may("x.brief", "y.brief", least)).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))
    many = stage(rest.filter(F.col("_n") > crowd).select("doc_id", "root").distinct(), "crowded")
    if not many.isEmpty():
        close = close.union(_rare_pairs(many, texts, size, percent))
    pairs = stage(close.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    if not pairs.isEmpty():
        more = _links(pairs, sketches, texts, size, percent)
        if not more.isEmpty():
            roots = _joined(roots, more)
    by_class = heads.join(roots.withColumnRenamed("v", "head"), "head", "left").select("whole", F.coalesce("root", "head").alias("root"))
    out = sigs.select("doc_id", "n_shingles", "whole").join(by_class, "whole", "left")
    found = F.when(F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", found.alias("component_id"), F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept"))
