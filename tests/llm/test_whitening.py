"""Whitening against a plain eigendecomposition, its secular equations, and odd tables."""

import math

import numpy as np
import pytest

from keylake.llm import queries, whitening
from keylake.llm.whitening import Spectrum, rank_one

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, n string"


def brute(rows, components=8):
    """{(id, component): (n, deviation, |whitened|, explained)} of rows (id, vector), by numpy and whole numbers."""
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in rows], np.int64)
    n, sums = len(x), [int(s) for s in x.sum(axis=0)]
    y = x - x.mean(axis=0)
    values, basis = np.linalg.eigh(y.T @ y / n)
    values, basis = values[::-1], basis[:, ::-1]
    out = {}
    for r, (i, _) in enumerate(rows):
        deviation = sum((n * int(a) - s) ** 2 for a, s in zip(x[r], sums, strict=True))
        for c in range(min(components, len(values))):
            if values[c] > len(values) * 1e-15 * values.sum():
                out.setdefault((i, c + 1), []).append((n, deviation, abs(float(y[r] @ basis[:, c])) / math.sqrt(values[c]), values[c] / values.sum()))
    return out


def check(found, want):
    got = {}
    for r in found:
        got.setdefault((r.vec_id, r.component), []).append((r.n, r.deviation, abs(r.whitened), r.explained))
        assert r.identity_error <= 1e-9
    assert set(got) == set(want)
    for key, rows in want.items():
        for a, b in zip(sorted(got[key]), sorted(rows), strict=True):
            assert a[:2] == b[:2]
            assert a[2] == pytest.approx(b[2], abs=1e-7)
            assert a[3] == pytest.approx(b[3], rel=1e-9)


def test_rank_one_updates():
    rng = np.random.default_rng(2)
    for k in (1, 2, 5, 30):
        for kind in range(8):
            values = np.sort(rng.random(k) * 10)
            z = rng.normal(size=k)
            if kind == 1:
                values[: k // 2 + 1] = 0
            elif kind == 2:
                values = np.round(values)
            elif kind == 3:
                z[rng.random(k) < 0.6] = 0
            elif kind == 4:
                z *= 1e-9
            elif kind == 5:
                values = 1 + 1e-13 * np.sort(rng.random(k))
            elif kind == 6:
                z *= 10.0 ** -rng.integers(0, 16, k)
            elif kind == 7:
                values[:] = 0
            values = np.sort(values)
            for rho in (1e-6, 0.7, 1e6):
                new, w = rank_one(values, z, rho)
                whole = np.diag(values) + rho * np.outer(z, z)
                scale = max(values.max(), rho * float(z @ z))
                assert np.abs(w.T @ w - np.eye(k)).max() < 1e-13 * max(1, k)
                assert np.abs(w * new @ w.T - whole).max() < 1e-13 * scale * max(1, k)
                assert (np.diff(new) >= 0).all()


def test_spectra_add_and_merge():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 12)) * np.arange(1, 13)
    x[100:300] = x[7]
    x[:, 5] = x[:, 4]
    parts = [Spectrum(12) for _ in range(4)]
    for r, row in enumerate(x):
        parts[r % 4].add(row)
    parts[0].add(x[7], 50.0)
    every = np.vstack([x, np.repeat(x[7:8], 50, axis=0)])
    whole = Spectrum(12)
    for p in parts:
        whole.merge(Spectrum.unpack(p.pack()))
    y = every - every.mean(axis=0)
    assert whole.n == len(every)
    assert np.allclose(whole.mean, every.mean(axis=0))
    assert np.allclose(whole.basis * whole.values @ whole.basis.T, y.T @ y, rtol=0, atol=1e-9 * (y**2).sum())
    assert np.abs(whole.basis.T @ whole.basis - np.eye(whole.basis.shape[1])).max() < 1e-12


def test_query_against_numpy(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(queries.queries()["op12_whitening"](spark, SF).collect(), brute(rows))


def test_narrow_spans_are_completed(spark, monkeypatch):
    monkeypatch.setattr(whitening, "RANK", 3)
    monkeypatch.setattr(Spectrum.__init__, "__defaults__", (3,))
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 40)) * (0.7 ** np.arange(40))
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    check(whitening.whiten(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), components=4).collect(), brute(rows, 4))


def test_odd_tables(spark):
    good = [(1, [0.5, -0.25, 3.0]), (2, [0.5, 1.0, -2.0]), (2, [0.5, 1.0, -2.0]), (3, [0.5, 0.125, 7.5]), (4, [0.5, 2.0])]
    bad = [(5, None), (6, [1.0, None, 2.0]), (7, [float("nan")] * 3), (8, [float("inf"), 0.0, 0.0]), (None, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame([(*r, "x") for r in good + bad], SCHEMA)
    check(whitening.whiten(frame).collect(), brute([(i, [*v, 0.0][:3]) for i, v in good]))
    for none in (frame.limit(0), frame.where("vec_id >= 5"), frame.where("vec_id = 1"), frame.where("vec_id = 2")):
        assert whitening.whiten(none).count() == 0
    empty = spark.createDataFrame([(1, [], "x"), (2, [], "x")], SCHEMA)
    assert whitening.whiten(empty).count() == 0


def test_hot_vectors_and_large_values(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [0.5, 0.25, -0.5]) for k in range(900)] + [(1000 + k, [float(c) for c in rng.normal(size=3)]) for k in range(60)]
    check(whitening.whiten(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(5)).collect(), brute(rows))
    far = [(k, [float(c) * 1e7 for c in rng.normal(size=2)]) for k in range(40)]
    got = whitening.whiten(spark.createDataFrame([(*r, "x") for r in far], SCHEMA)).collect()
    exact = {k: min(2**63 - 1, d[0][1]) for k, d in brute(far).items()}
    assert {(r.vec_id, r.component): r.deviation for r in got} == exact
    assert 2**63 - 1 in exact.values()
