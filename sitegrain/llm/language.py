"""Language ID by string kernels.

Two texts are alike by the n-grams (1 to 3 characters) that both hold: k(x, z) = |X and Z| / sqrt(|X| |Z|), a blended
spectrum of presences. A bounded sample of labelled rows is drawn by hash (``per_language`` at most of each
language on average); some of it serves as Nystroem landmarks, and one ridge regression a language is fitted in the
landmarks' space. Whole texts are scored by matrix products, a batch at a time.

Null text, empty text or text without a letter: ``und``, score 0. No labelled row at all: everything is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SYMBOLS = 128


def _spectrum(text: str) -> np.ndarray:
    code = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    code = np.where(code < 97, 0, (code - 96) % (_SYMBOLS - 1) + 1)
    two = code[:-1] * _SYMBOLS + code[1:]
    three = two[:-1] * _SYMBOLS + code[2:]
    return np.unique(np.concatenate([code, two + _SYMBOLS, three + _SYMBOLS + _SYMBOLS**2])).astype(np.int32)


def grams(text: str | None, step: int = 1 << 20) -> np.ndarray:
    """Numbers of the n-grams that a text holds; empty if it has no letter."""
    if not text or not any(map(str.isalpha, text)):
        return np.empty(0, np.int32)
    text = text.lower()
    parts = [_spectrum(text[max(0, i - 2) : i + step]) for i in range(0, len(text), step)]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


class Model:
    """Weights of each landmark's n-grams, by language: the landmarks' coefficients carried over to their features."""

    def __init__(self, names: list[str], features: np.ndarray, weights: np.ndarray):
        self.names, self.features, self.weights = names, features, weights

    def scores(self, batch: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(batch), len(self.names)))
        for i, x in enumerate(batch):
            if len(x):
                at = np.searchsorted(self.features, x)
                at[at == len(self.features)] = 0
                own = at[self.features[at] == x]
                out[i] = self.weights[own].sum(axis=0) / np.sqrt(len(x))
        return out


def fit_model(samples: list[np.ndarray], labels: list[str], landmarks: int = 192, ridge: float = 1e-2) -> Model:
    names = sorted(set(labels))
    if not names:
        return Model([], np.zeros(1, np.int32), np.zeros((1, 0)))
    features = np.unique(np.concatenate(samples))
    dense = np.zeros((len(samples), len(features)), np.float32)
    for row, x in zip(dense, samples):
        row[np.searchsorted(features, x)] = 1 / np.sqrt(len(x))
    marks = dense[:landmarks]  # the rows come in the order of a hash
    between, inside = (dense @ marks.T).astype(np.float64), (marks @ marks.T).astype(np.float64)
    target = np.array([[1.0 if label == name else 0.0 for name in names] for label in labels])
    alpha = np.linalg.solve(between.T @ between + ridge * len(samples) * (inside + 1e-6 * np.eye(len(marks))), between.T @ target)
    return Model(names, features, marks.T @ alpha)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 200) -> Model:
    """Fit on the labelled rows of ``df``; at most about ``per_language`` rows of each language reach the driver, as n-gram numbers."""
    named = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in named.groupBy(lang_col).count().collect()}
    if not counts:
        return fit_model([], [])
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))])[F.col(lang_col)]
    drawn = F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1_000_000)) < share * 1_000_000

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "lang": b["lang"], "grams": [grams(t) for t in b["text"]]})

    sample = named.filter(drawn).select(F.xxhash64(F.col(id_col)).alias("k"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = sorted((r for r in sample.mapInPandas(gather, "k long, lang string, grams array<int>").collect() if r["grams"]), key=lambda r: (r["k"], r["lang"]))
    return fit_model([np.array(r["grams"], np.int32) for r in rows], [r["lang"] for r in rows])


def predict(model: Model, text: Column) -> Column:
    """Struct of ``lang_pred`` and ``score`` (0 to 1)."""

    @F.pandas_udf("lang_pred string, score double")
    def score(texts: pd.Series) -> pd.DataFrame:
        batch = [grams(t) for t in texts]
        got = model.scores(batch)
        known = np.array([len(x) > 0 and bool(model.names) for x in batch])
        best = got.argmax(1) if model.names else np.zeros(len(batch), int)
        top = got.max(1) if model.names else np.zeros(len(batch))
        return pd.DataFrame({"lang_pred": [model.names[b] if k else "und" for b, k in zip(best, known)], "score": np.where(known, np.clip(top, 0, 1), 0.0)})

    return score(text)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Every row with ``held_out``, ``lang_pred`` and ``score``; learns from the rows that are not held out."""
    model = fit(docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id"))))
    return docs.withColumn("_lang", predict(model, F.col("text"))).select(
        *[F.col(c) for c in docs.columns if c not in ("held_out", "lang_pred", "score")],
        held_out(F.col("doc_id")).alias("held_out"), F.col("_lang.lang_pred").alias("lang_pred"), F.col("_lang.score").alias("score"),
    )
