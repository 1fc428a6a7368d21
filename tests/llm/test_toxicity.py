"""The toxicity classifier: features against a plain recount, held-out accuracy, and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegrain.llm import queries, toxicity

DOCS = "doc_id long, text string, lang string, source string, score string, predicted string, held_out int, toxic int"


def test_features_are_those_of_all_n_grams_and_do_not_depend_on_pieces(monkeypatch):
    text = "An IDIOT, ça va? " * 9 + "\U0001f600 end"
    whole = toxicity.Features().of(text)
    monkeypatch.setattr(toxicity, "_STEP", 7)
    assert np.array_equal(whole, toxicity.Features().of(text))
    padded = " " + "".join(c.lower() if c.isascii() else c for c in text) + " "
    grams = {padded[i : i + n] for n in toxicity.SIZES for i in range(len(padded) - n + 1)}
    assert 0.98 * len(grams) < len(whole) <= len(grams)
    assert np.array_equal(whole, toxicity.Features().of(text.upper().replace("Ç", "ç")))
    assert len(toxicity.Features().of(None)) == len(toxicity.Features().of("")) == 0 < len(toxicity.Features().of("a"))


def test_sums_of_features_equal_a_plain_count():
    import pandas as pd

    texts, labels = ["abc abc", "abcd", None, "xyz" * 400], [0, 1, 1, 1]
    (got,) = toxicity._counted(iter([pd.DataFrame({"text": texts, "label": labels})]))
    want = {}
    for text, label in zip(texts, labels):
        for f in toxicity.Features().of(text):
            want.setdefault(int(f), [0, 0])[label] += 1
    assert {r.feature: [r.zeros, r.ones] for r in got.itertuples()} == want


def made(n=400, seed=3):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abdehinorst") for _ in range(draw.randint(2, 7)))
    rows = []
    for i in range(n):
        words, bad = [word() for _ in range(draw.choice([8, 60, 300]))], i % 7 == 0
        for _ in range(1 + len(words) // 30 if bad else 0):
            words.insert(draw.randrange(len(words)), draw.choice(["wretch", "scoundrel"]))
        rows.append((i, " ".join(words), "en", "s", "x", "y", 1, int(bad)))
    return rows


@pytest.fixture
def tables(spark, tmp_path):
    def make(rows, labels):
        spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, toxic int, quality int, text string").write.parquet(f"{tmp_path}/labels.parquet")
        return queries.op12_toxicity(spark, str(tmp_path))

    return make


def test_held_out_texts_are_told_apart_and_odd_rows_have_a_score(tables):
    rows = made()
    odd = [(1000, None), (1001, ""), (1002, "  "), (None, "a wretch of a scoundrel"), (0, rows[0][1]), (1003, "fine words " * 60_000), (1004, "x")]
    docs = rows + [(i, t, None, None, None, None, None, None) for i, t in odd]
    labels = [(r[0], r[7], 1, "z") for r in rows] + [(0, 0, 1, "z"), (None, 1, 1, "z"), (5, None, 1, "z"), (10**6, 1, 1, "z")]
    got = tables(docs, labels).collect()
    assert len(got) == len(docs)
    truth = {r[0]: r[7] for r in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1000].score == by[1001].score and by[1001].predicted == 0 and by[1003].predicted == 0 and by[None].predicted == 1
    assert by[None].held_out is False


@pytest.mark.parametrize("value, want", [(None, 0.0), (0, 0.0), (1, 1.0)])
def test_one_label_or_none(tables, value, want):
    rows = made(12)
    assert {r.score for r in tables(rows, [(r[0], value, 1, "") for r in rows]).collect()} == {want}


def test_no_documents(tables):
    assert tables([], [(1, 1, 1, "")]).collect() == []


def test_scores_do_not_depend_on_the_order_of_rows(spark):
    rows = made(120)
    docs = spark.createDataFrame(rows, DOCS)
    labels = docs.select("doc_id", "toxic")
    one = {r.doc_id: r.score for r in toxicity.rate(docs.repartition(5), labels).collect()}
    two = {r.doc_id: r.score for r in toxicity.rate(docs.orderBy(F.desc("doc_id")), labels).collect()}
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-6 for k in one)
