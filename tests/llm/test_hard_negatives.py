"""Hard negatives against plain loops, bounds that hold, and odd tables."""

import math

import numpy as np

from keylake.llm import hard_negatives as H
from keylake.llm import vectors as V

SCHEMA = "vec_id long, embedding array<double>, label int, score string"


def brute(rows, positives=5, negatives=5, every=100, scale=256):
    """Rows (id, vector, label) -> result rows, whole numbers throughout; each anchor row by itself."""
    width = max((len(v) for _, v, _ in rows), default=0)
    whole = [(i, [math.floor(scale * x) for x in v] + [0] * (width - len(v)), y) for i, v, y in rows]
    cut = lambda s: max(-(2**63), min(2**63 - 1, s))
    out = []
    for a, q, y in whole:
        if a % every:
            continue
        scored = [(-cut(sum(x * z for x, z in zip(q, v, strict=True))), i, label) for i, v, label in whole if i != a]
        for s, i, _ in sorted(r for r in scored if r[2] == y)[:positives]:
            inside = sorted(r for r in scored if r[2] != y and 80 * -s <= 100 * -r[0] <= 100 * -s)[:negatives]
            out += [(a, i, n + 1, j, -s, -t) for n, (t, j, _) in enumerate(inside)]
    return sorted(out)


def run(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in H.hard_negatives(frame, **options).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_against_plain_loops(spark):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(4, 12))
    rows = []
    for k in range(900):
        y = int(rng.integers(0, 4))
        v = middle[y] + rng.normal(size=12) * 0.7
        rows.append((k, [float(x) for x in np.round(v, 1)], (y + 1) % 4 if k % 7 == 0 else y))
    rows += [(1000 + k, [0.5] * 12, k % 3) for k in range(150)]
    want = brute(rows, every=50)
    assert len(want) > 200
    for options in ({}, {"cells": 3000}):
        assert run(spark, rows, every=50, **options) == want


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0, 0.5], 1), (0, [1.0, 1.0, 0.25], 1), (1, [1.0, 2.0], 1), (2, [], 1), (3, [1.0, 1.75, 0.25, 9.0], 2), (3, [1.0, 1.75, 0.25, 9.0], 2), (4, [-1.0, -2.0, 0.0], 2), (5, [0.0, 2.0, 0.75], 2), (200, [], 2), (300, [1e30, 1.0], 2), (301, [1e30, 0.5], 2), (302, [1e30, 0.25], 3), (303, [-1e30, 0.25], 3), (304, [1e5, 1.0], 3)]
    bad = [(6, None, 1), (7, [1.0, None], 2), (8, [float("nan")], 2), (9, [float("inf")], 2), (10, [1.0, 2.0, 0.5], None), (None, [1.0, 2.0, 0.5], 2)]
    assert run(spark, rows + bad) == brute(rows)
    frame = spark.createDataFrame([(*r, "x") for r in rows + bad], SCHEMA)
    for none in (frame.limit(0), frame.where("vec_id % 100 > 0"), frame.where("label = 3"), frame.where("vec_id = 200")):
        assert H.hard_negatives(none).count() == 0


def test_hot_vectors(spark):
    rows = [(k, [1.0, 0.5, -0.25], 0) for k in range(0, 1200, 3)] + [(k, [0.9, 0.5, -0.25], 1) for k in range(1, 1200, 3)] + [(k, [1.0, 0.5, -0.25], 1) for k in range(2, 1200, 3)]
    assert run(spark, rows) == brute(rows)


def test_scans_read_few_cells_where_dimensions_differ():
    """Most columns of most rows are never read, and what is left holds all that counts."""
    rng = np.random.default_rng(8)
    n, width = 4000, 64
    values = np.floor(rng.normal(size=(n, width)) * 2000 * 0.7 ** np.arange(width))
    labels = rng.integers(0, 4, n)
    index = H.Columns(np.arange(n), labels, V.Ragged(np.arange(n + 1) * width, values.ravel()))
    for a in range(0, n, 400):
        scores = (values @ values[a]).astype(np.int64)
        ids, found = index.best(values[a], a, labels[a], 5)
        same = sorted((-s, i) for i, s in enumerate(scores.tolist()) if i != a and labels[i] == labels[a])[:5]
        assert list(zip((-found).tolist(), ids.tolist(), strict=True)) == same
        windows = [H.window(int(s), 80, 100) for s in found]
        for (low, high), (ids, got) in zip(windows, index.between(values[a], a, labels[a], windows, 5), strict=True):
            other = sorted((-s, i) for i, s in enumerate(scores.tolist()) if labels[i] != labels[a] and low <= s <= high)[:5]
            assert list(zip((-got).tolist(), ids.tolist(), strict=True)) == other
    assert index.read < 10 * n * width * 0.6


def test_one_wide_vector_costs_its_own_cells():
    wide = V.Ragged(np.concatenate([[0], 20_000 + 2 * np.arange(32_769)]), np.ones(20_000 + 2 * 32_768))
    index = H.Columns(np.arange(32_769), np.zeros(32_769, np.int64), wide)
    assert len(index.cell) == 20_000 + 2 * 32_768
    ids, scores = index.best(np.ones(20_000), 5, 0, 2)
    assert ids.tolist() == [0, 1]
    assert scores.tolist() == [20_000, 2]
