"""Exact search against a plain sort, by whole numbers of any size."""

import math
import random

import numpy as np
import pytest

from sitegrain.llm import topk

ROWS = "vec_id long, embedding array<double>, query_id string, score string, label int"


def run(spark, rows, parts=3, **how):
    frame = spark.createDataFrame([(i, v, "q", "s", 1) for i, v in rows], ROWS).repartition(parts)
    return sorted(map(tuple, topk.search(frame, **how).collect()))


def brute(rows, k=20, every=20):
    fine = {(i, tuple(math.floor(64 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in sorted({i for i, _ in fine if i % every == 0}):
        found = {(-sum(a * b for a, b in zip(x, y)), j) for i, x in fine if i == q for j, y in fine if j != q and len(x) == len(y)}
        out += [(q, n, j, -s) for n, (s, j) in enumerate(sorted(found)[:k], 1)]
    return out


def vectors(n, dim=7, seed=1, spread=1.0):
    draw = random.Random(seed)
    return [(i, [draw.gauss(0, spread) for _ in range(dim)]) for i in range(n)]


@pytest.fixture
def small_blocks(monkeypatch):
    """Many blocks, so that there are several rounds."""
    monkeypatch.setattr(topk, "ROWS", 8)
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "TOGETHER", 3)


def test_search_equals_a_plain_sort(spark):
    rows = vectors(300)
    assert run(spark, rows) == brute(rows)


def test_many_rounds_lose_nothing(spark, small_blocks):
    rows = vectors(700, dim=5, seed=2, spread=0.1)
    assert run(spark, rows) == brute(rows)


def test_ties_copies_and_repeated_rows(spark, small_blocks):
    same = [0.5, -0.25, 0.0]
    rows = [(i, same) for i in range(1, 150)] + [(7, same)] * 60 + [(200, same), (220, [1.0, 0.0, 0.0]), (221, [-1.0, 0.0, 0.0])]
    rows += [(5, [9.0, 9.0, 9.0])] * 60 + [(40, [1.0, 2.0, 3.0]), (40, [-1.0, 2.0, 3.0])]
    assert run(spark, rows) == brute(rows)


def test_large_finite_components_take_part(spark):
    rows = vectors(60) + [(100, [2.0**19, 1.0, 0.0, 0.0, 0.0, 0.0, -(2.0**19)]), (101, [-(2.0**20), 0.0, 0.0, 0.0, 0.0, 0.0, 1e-9])]
    assert run(spark, rows) == brute(rows)
    rows = vectors(30, dim=2) + [(100, [2.0**23, 0.0]), (120, [-(2.0**23), 2.0**23])]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("big", [2.0**41, 1e300])
def test_scores_that_fit_no_long_are_refused(spark, big):
    with pytest.raises(ValueError, match="long"):
        run(spark, [(0, [big] * 4), (1, [big] * 4)])


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(30, dim=2) + [(40, None), (41, [None, 1.0]), (42, [nan, 1.0]), (43, [inf, 1.0]), (None, [1.0, 1.0]), (60, [1.0]), (61, [2.0]), (80, []), (81, []), (-20, [0.5, 0.5])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0])]) == []


def test_slices_add_and_hold_what_numbers_do():
    draw = np.random.default_rng(3)
    x = draw.integers(-50, 50, (200, 6))
    index = np.stack([topk.slices(x[:, c], 7) for c in range(6)])
    q = draw.integers(-40, 40, (9, 6))
    total, more = topk.scores(index, q, np.abs(x).max(axis=0), [topk.Multiples(s) for s in index])
    for j in range(9):
        got = topk.values(np.ascontiguousarray(total[:, j]), np.arange(200)) + more[j]
        assert (got == x @ q[j]).all()
    table = topk.Multiples(topk.slices(x[:, 0], 7))
    assert all((topk.values(table[m], np.arange(200)) == m * x[:, 0]).all() for m in (0, 1, 2, 3, 37, 40))


def test_blocks_that_cannot_reach_the_score_to_beat_are_passed_over(monkeypatch):
    import pandas as pd

    x = np.full((10, 2), -3)
    index = np.stack([topk.slices(x[:, c], 3) for c in range(2)])
    row = {"part": 0, "dim": 2, "rows": 10, "ids": np.arange(10).tobytes(), "bits": 3, "slices": index.tobytes(), "least": x[0].tobytes(), "most": x[0].tobytes(), "q_ids": np.array([50, 51]).tobytes(), "q": np.array([[1, 1], [-1, -1]]).tobytes(), "beat": np.array([0, 6]).tobytes(), "beat_id": np.array([0, 4]).tobytes()}
    asked, scored = [], topk.scores
    monkeypatch.setattr(topk, "scores", lambda index, q, *a: asked.append(q.tolist()) or scored(index, q, *a))
    (got,) = topk._search_block(20)(iter([pd.DataFrame([row])]))
    assert asked == [[[-1, -1]]] and got["score"].tolist() == [6] * 4 and set(got["query_id"]) == {51}
