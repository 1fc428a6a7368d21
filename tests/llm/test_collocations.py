"""Collocations against a plain recount."""

import random
import re
from collections import Counter

import pytest

from sitegrain.llm import collocations, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, f long, phrase string"


def brute(docs, least, top):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    covered = set()
    for (lang, w), a in candidates.items():
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                if j - i < len(w) and 100 * a >= 100 * f[lang, w[i:j]]:
                    covered.add((lang, w[i:j]))
    rows = {}
    for (lang, w), a in candidates.items():
        if (lang, w) not in covered:
            score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            rows.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted(
        (lang, i, phrase.decode(), -a, left, right, n[lang], -score)
        for lang, found in rows.items()
        for i, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1)
    )


def made(seed, n=60):
    draw = random.Random(seed)
    word = lambda: draw.choice(["the", "The", "a", "of", "é", "ÉA", "x\x01y", "zz", "no-w", "b"])
    phrases = [["the", "hot", "line", "of", "all", "lines"], ["aa", "aa", "aa", "aa"], ["a", "b"], ["of", "the", "é"]]
    out = []
    for i in range(n):
        w = []
        for _ in range(draw.choice([2, 30, 150])):
            w += draw.choice(phrases) if draw.random() < 0.2 else [word()]
            w[-1] += draw.choice(["", "", "", "", ".", ", ", "\n", "?!"])
        out.append((draw.choice([" ", "  ", "\t"]).join(w), draw.choice(["en", "en", "de", None, "und", ""])))
    return out


ODD = [(None, "en"), ("", "en"), (" \t ", None), ("...,\n;", "en"), ("the hot " * 4000, "en"), ("w" * 70_000 + " end", "de"), ("only", "fr")]


def run(spark, docs, least, top=2000):
    rows = [(i % 5 or None, text, lang, "s", 1, "w", 2, "p") for i, (text, lang) in enumerate(docs)]
    return collocations.collocations(spark.createDataFrame(rows, DOCS).repartition(3), least, top)


@pytest.mark.parametrize("least", [3, 20])
def test_phrases_equal_a_plain_recount(spark, monkeypatch, least):
    monkeypatch.setattr(collocations, "_STEP", 2000)
    docs = made(least) + ODD + made(least)[:7]
    got = run(spark, docs, least)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for _, t in got.dtypes[1:2] + got.dtypes[3:]} == {"bigint"}
    got, want = sorted(map(tuple, got.collect())), brute(docs, least, 2000)
    assert got == want and len(want) > 20


def test_the_best_are_kept_and_ties_go_by_phrase(spark):
    docs = [(f"p{i:03d} q{i:03d}. r s{i:03d}\n" * 4, "en") for i in range(120)] + made(1)
    assert sorted(map(tuple, run(spark, docs, 4, top=50).collect())) == brute(docs, 4, 50)


def test_one_beginning_that_fills_many_ranges(spark):
    """Nearly all phrases begin with the same word, and others end with it."""
    docs = [(f"hot w{i}. w{i} hot. hot w{i} z{i % 3}" * 3, "en") for i in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(map(tuple, run(spark, docs, 2).collect())) == brute(docs, 2, 2000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scores_beyond_64_bits_are_exact():
    import pandas as pd

    a, total = 10**7, 10**13
    rows = pd.DataFrame({"lang": ["en"] * 2, "words": [["a", "b"]] * 2, "f": [a] * 2, "beginnings": [[total, a + 1], [total, a + 3]], "covered": [False] * 2, "backward": [False, True]})
    (got,) = collocations._merged(9)(iter([rows]))
    assert 1000 * a * total > 2**64 and got["score"].tolist() == [1000 * a * total // ((a + 1) * (a + 3))]


def test_texts_are_cut_only_where_pieces_end():
    raw = b"one two.three four five six.seven" * 9
    parts = list(collocations._cut(raw, 20))
    assert b"".join(parts) == raw and len(parts) > 9 and all(p.endswith(b".") for p in parts[:-1])
    assert list(collocations._cut(b"x" * 50, 20)) == [b"x" * 50]


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op13_collocations(spark, str(tmp_path)).collect() == []
