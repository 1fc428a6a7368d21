"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the n-grams (3 to 6 characters, ASCII letters in lower case) that it holds, dealt over 2^17 numbers by a
hash. Over all labelled rows, Spark counts in how many texts of either label a feature occurs; the logarithm of the ratio of
the two shares is the feature's scale. A logistic regression is fitted on the scaled features, brought to length one, of a bounded sample: the
``per_label`` rows of each label that come first by a hash of their id, texts over ``sample_chars`` characters only where shorter ones
are too few. Its rows reach the driver as feature numbers, at most 2^17 a row. Whole texts are scored, a piece at a time.

Null and empty texts, and those shorter than three characters with their margins, have no features: their score is the share of
label 1 among the labelled rows. With one label only, the score is 0 or 1; with none, 0. Labels without an id or a value are left
out, an id labelled both ways counts as 1. Rows that repeat an id are scored one by one, and each is learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.words import bitmap, is_set
from sitegrain.session import stage

BITS = 17
SIZES = (3, 4, 5, 6)
_STEP = 1 << 20
_LABEL_BITS = 25
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Features:
    """Finds the features of texts, with one table of marks for all of them."""

    def __init__(self):
        self.marks = np.zeros(1 << BITS, bool)

    def of(self, text: str | None) -> np.ndarray:
        """Numbers of the n-grams that a text holds, ascending."""
        if not text:
            return np.empty(0, np.int32)
        for begin in range(0, len(text), _STEP):
            # Pieces overlap, so that no n-gram is cut; a space stands on either side of the text.
            piece = text[max(0, begin - SIZES[-1] + 1) : begin + _STEP]
            piece = f"{'' if begin else ' '}{piece}{' ' if begin + _STEP >= len(text) else ''}"
            code = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            code += np.uint64(32) * ((code >= 65) & (code <= 90))
            gram = code
            with np.errstate(over="ignore"):
                for size in range(2, SIZES[-1] + 1):
                    if len(code) < size:
                        break
                    gram = gram[:-1] * np.uint64(1_000_003) + code[size - 1 :]
                    if size in SIZES:
                        self.marks[((gram ^ np.uint64(size)) * _SPREAD) >> np.uint64(64 - BITS)] = True
        found = np.flatnonzero(self.marks).astype(np.int32)
        self.marks[found] = False
        return found


@dataclass
class Model:
    """``scale`` by feature, the weights of the scaled features, the bias, and the share of label 1."""

    scale: np.ndarray
    weights: np.ndarray
    bias: float
    share: float

    def __post_init__(self):
        self.pull = (self.scale * self.weights).astype(np.float32)
        self.square = (self.scale * self.scale).astype(np.float32)

    def score(self, features: np.ndarray) -> float:
        length = float(np.sqrt(self.square[features].sum(dtype=np.float64))) if len(features) else 0.0
        if not length:
            return self.share
        return float(1 / (1 + np.exp(-np.clip(self.pull[features].sum(dtype=np.float64) / length + self.bias, -500, 500))))


def fit_model(counts: np.ndarray, rows: list[np.ndarray], labels: list[int], share: float, turns: int = 60, penalty: float = 1e-4) -> Model:
    """``counts[label, feature]`` over all labelled texts, and the sample that the regression is fitted on."""
    size = 1 << BITS
    smooth = counts + 1.0
    scale = np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum())
    rows, y = [x for x in rows if len(x)], np.array([v for x, v in zip(rows, labels) if len(x)], float)
    if len(set(y)) < 2:
        return Model(np.zeros(size), np.zeros(size), 0.0, share)  # nothing to tell apart
    at = np.concatenate(rows)
    begin = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    value = scale[at].astype(np.float32)
    length = np.sqrt(np.add.reduceat(value.astype(np.float64) ** 2, begin[:-1]))
    value /= np.repeat(np.maximum(length, 1e-12), np.diff(begin)).astype(np.float32)
    each = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, bias = np.zeros(size), 0.0
    mean, spread, mean_b, spread_b = np.zeros(size), np.zeros(size), 0.0, 0.0
    for turn in range(1, turns + 1):  # Adam
        s = np.add.reduceat(value * w[at], begin[:-1]) + bias
        g = each * (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y)
        down = np.bincount(at, value * np.repeat(g, np.diff(begin)), size) + penalty * w
        mean, spread = 0.9 * mean + 0.1 * down, 0.999 * spread + 0.001 * down * down
        w -= 0.05 * mean / (1 - 0.9**turn) / (np.sqrt(spread / (1 - 0.999**turn)) + 1e-10)
        mean_b, spread_b = 0.9 * mean_b + 0.1 * g.sum(), 0.999 * spread_b + 0.001 * g.sum() ** 2
        bias -= 0.05 * mean_b / (1 - 0.9**turn) / (np.sqrt(spread_b / (1 - 0.999**turn)) + 1e-10)
    return Model(scale, w, bias, share)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts of either label that hold a feature, summed over a task."""
    find, counts = Features(), np.zeros((2, 1 << BITS), np.int64)
    for b in batches:
        for text, label in zip(b["text"], b["label"]):
            counts[label, find.of(text)] += 1
    some = np.flatnonzero(counts.any(0))
    yield pd.DataFrame({"feature": some.astype(np.int32), "zeros": counts[0, some], "ones": counts[1, some]})


def _found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    find = Features()
    for b in batches:
        yield pd.DataFrame({"k": b["k"], "label": b["label"], "features": [find.of(t) for t in b["text"]]})


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 500, sample_chars: int = 20_000) -> Model:
    """``labels(doc_id, toxic)``; learns from the ids that ``docs`` holds."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("label"))
    known = stage(known, "labels")
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << _LABEL_BITS))
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(known.select(slot.alias("slot")), _LABEL_BITS))

    @F.pandas_udf("boolean")
    def may_be_labelled(slots: pd.Series) -> pd.Series:
        return pd.Series(is_set(bits.value, slots.to_numpy(np.int64)))

    # The texts of few rows beside the labelled ones are moved to meet their labels, at every size in the same way.
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("doc_id is not null").filter(may_be_labelled(slot))
    rows = texts.join(known.hint("merge"), "doc_id")
    drawn = F.xxhash64("doc_id", F.lit(5))
    long = (F.coalesce(F.length("text"), F.lit(0)) > sample_chars).alias("long")
    places = stage(texts.select("doc_id", long).join(known, "doc_id").withColumn("k", drawn), "labelled")
    totals = {r["label"]: r["count"] for r in places.groupBy("label").count().collect()}
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    chosen = [places.filter(F.col("label") == label).orderBy("long", "k", "doc_id").limit(per_label).select("doc_id") for label in totals]
    sums = rows.select("text", "label").mapInPandas(_counted, "feature int, zeros long, ones long")
    counts = np.zeros((2, 1 << BITS))
    for r in sums.groupBy("feature").agg(F.sum("zeros"), F.sum("ones")).collect():  # 2^BITS rows at most
        counts[:, r[0]] = r[1], r[2]
    if len(chosen) < 2:
        return fit_model(counts, [], [], share)
    ids = [r[0] for r in chosen[0].union(chosen[1]).distinct().collect()]  # 2 * per_label at most
    mine = texts.filter(F.col("doc_id").isin(ids))
    marked = known.filter(F.col("doc_id").isin(ids))
    sample = mine.join(marked, "doc_id").select(drawn.alias("k"), "label", "text").mapInPandas(_found, "k long, label int, features array<int>")
    got = sorted(((r["k"], r["label"], np.array(r["features"], np.int32)) for r in sample.toLocalIterator()), key=lambda r: (r[0], len(r[2])))
    return fit_model(counts, [r[2] for r in got], [r[1] for r in got], share)


def score(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = Features()
        for texts in batches:
            yield pd.Series([model.score(find.of(t)) for t in texts], dtype="float64")

    return scored(text)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row with ``held_out``, ``score`` and ``predicted``, which replace columns of these names; learns from rows not held out."""
    model = fit(docs.select("doc_id", "text").filter(~held_out(F.col("doc_id"))), labels.select("doc_id", "toxic"))
    others = [name for name in docs.columns if name not in ("held_out", "score", "predicted")]
    scored = docs.select(*others, score(model, F.col("text").cast("string")).alias("score"))
    return scored.select(*others, held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
