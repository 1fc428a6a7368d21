"""Repeated passages by Relative Lempel-Ziv parsing.

The corpus is its own reference. Each document is marked at content-defined anchors (the least fingerprint of 20 words within
every window, so that equal windows have equal anchors). Windows around an anchor that several documents hold are the
reference blocks; the index, dealt by fingerprint, knows the first place of each. A document is
factored greedily: a factor runs on as long as the next window's first place is the next one of the same earlier document. Each
window is looked up by itself, so those over a factor's boundary count too. Whole copies take one factor.

Null or empty text, or fewer words than a window: no factor. Rows without an id give and take nothing; rows that repeat
an id don't repeat each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.words import fingerprints, windows, words
from sitegrain.operators.links import PLACE, rows_at, with_places
from sitegrain.session import stage

ANCHOR = 20


def _anchors(tokens: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor fingerprint of each window, and the fingerprints of the windows."""
    values = fingerprints(tokens)
    grams = windows(values, min(ANCHOR, window))
    wide = window - min(ANCHOR, window) + 1
    return np.minimum.reduce([grams[i : len(grams) - wide + 1 + i] for i in range(wide)]), windows(values, window)


def factors(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, start, length, ref_id, ref_start) in words: passages of ``window`` words or more that a lesser doc_id holds."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"], b["text"]):
                w = words(text)
                if len(w) >= window:
                    out.append((doc, hashlib.sha256(b" ".join(w)).digest()[:16], len(w), np.unique(_anchors(w, window)[0]).view(np.int64)))
            yield pd.DataFrame(out, columns=["doc_id", "whole", "n", "anchors"])

    marked = stage(docs.mapInPandas(mark, "doc_id long, whole binary, n int, anchors array<long>"), "anchors")
    heads = marked.groupBy("whole").agg(F.min("doc_id").alias("head"))
    copies = marked.join(heads, "whole").filter("doc_id != head").select("doc_id", F.lit(0).alias("start"), F.col("n").alias("length"), F.col("head").alias("ref_id"), F.lit(0).alias("ref_start")).distinct()
    own = heads.select(F.col("head").alias("doc_id"), "whole")
    spots = stage(marked.join(own, ["doc_id", "whole"]).select("doc_id", F.explode("anchors").alias("anchor")), "spots")
    shared = spots.groupBy("anchor").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_z")).filter("_a != _z").select("anchor")
    wanted = spots.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc, text, anchors in zip(b["doc_id"], b["text"], b["anchors"]):
                w = words(text)
                if len(w) < window:
                    continue
                least, prints = _anchors(w, window)
                at = np.flatnonzero(np.isin(least.view(np.int64), np.asarray(anchors, np.int64)))
                yield pd.DataFrame({"doc_id": np.full(len(at), doc), "print": prints[at].view(np.int64), "start": at.astype(np.int32)})

    placed = stage(docs.join(wanted, "doc_id").mapInPandas(lay, "doc_id long, print long, start int"), "windows")
    index = placed.groupBy("print").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.max("doc_id").alias("_z")).filter("first.doc_id != _z")
    looked = placed.join(index, "print").filter("first.doc_id < doc_id")
    each = looked.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", F.col("first.doc_id").alias("ref_id"), F.col("first.start").alias("ref_start")))).alias("found"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, found in zip(b["doc_id"], b["found"]):
                run = None
                for f in found:
                    s, r, p = f["start"], f["ref_id"], f["ref_start"]
                    if run and r == run[3] and s - run[1] == p - run[4] and s == run[1] + run[2] - window + 1:
                        run[2] += 1
                    else:
                        if run:
                            out.append(tuple(run))
                        run = [doc, s, window, r, p]
                if run:
                    out.append(tuple(run))
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ref_id", "ref_start"])

    return each.mapInPandas(parse, "doc_id long, start int, length int, ref_id long, ref_start int").union(copies)


def without_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row; ``kept`` is the words left, joined by a space. Texts without repeats stay where they lie."""
    placed = with_places(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *PLACE)
    docs = placed.select("doc_id", "text")
    spans = stage(factors(docs, window).groupBy("doc_id").agg(F.collect_set(F.struct("start", "length")).alias("spans")), "spans")
    held = stage(placed.select("doc_id", *PLACE).join(spans.select("doc_id"), "doc_id", "left_semi").select(*PLACE), "held")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, text, spans in zip(b["doc_id"], b["text"], b["spans"]):
                w = words(text)
                kept = np.ones(len(w), bool)
                for s in spans if spans is not None else ():
                    kept[s["start"] : s["start"] + s["length"]] = False
                left = b" ".join([x for x, k in zip(w, kept) if k])
                out.append((doc, len(w), int((~kept).sum()), left.decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept"]).astype({"doc_id": "Int64"})

    some = rows_at(placed, held).select("doc_id", "text").join(spans, "doc_id")
    none = rows_at(placed, held, False).select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    return some.union(none).mapInPandas(cut, "doc_id long, n_words long, n_removed long, kept string")
