"""Whitened vectors against a dense eigendecomposition."""

from __future__ import annotations

import numpy as np
import pytest

from judgealign.llm import q_corpus, whitening

SF = "/root/testdata/sf0.001"


def brute(rows: list[tuple], scale: int = 256):
    """Remaining rows as whole numbers, the fit list, and the eigenvalues and vectors of its covariance."""
    kept = [(i, [int(np.floor(scale * c)) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max(len(x) for _, x in kept)
    kept = [(i, x + [0] * (width - len(x))) for i, x in kept]
    fit = np.array(sorted({tuple(x) for _, x in kept}), float)
    values, vectors = np.linalg.eigh((fit - fit.mean(0)).T @ (fit - fit.mean(0)) / len(fit))
    return kept, fit, values[::-1], vectors[:, ::-1]


def hold_against(got: list, rows: list[tuple], components: int = 4) -> None:
    kept, fit, values, vectors = brute(rows)
    n, sums = len(fit), [int(s) for s in fit.sum(0)]
    white = np.array([x for _, x in kept]) - fit.mean(0)
    for k in range(components):
        mine = sorted((str(r["vec_id"]), r["deviation"], r["whitened"]) for r in got if r["component"] == k + 1)
        want = (white @ vectors[:, k] / np.sqrt(values[k])).tolist()
        deviation = [sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for _, x in kept]
        theirs = sorted((str(i), d, w) for (i, _), d, w in zip(kept, deviation, want, strict=True))
        assert [m[:2] for m in mine] == [t[:2] for t in theirs]
        a, b = np.array([m[2] for m in mine]), np.array([t[2] for t in theirs])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
    for r in got:
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9)


def test_rows_of_the_table_equal_brute_force(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    hold_against(q_corpus.op13_whitening(spark, SF).collect(), [(r["vec_id"], r["embedding"]) for r in table.collect()])


def test_repeated_unfit_and_short_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.standard_normal((60, 6)) * [5, 4, 3, 2, 1, 1])]
    rows += [rows[0]] * 200 + [(500 + k, rows[1][1]) for k in range(100)] + [(None, rows[2][1]), (None, [9.0, 1.0]), (700, [0.0] * 6), (701, [])]
    unfit = [(800, None), (801, [None] + [1.0] * 5), (802, [float("nan")] * 6), (803, [float("-inf")] + [0.0] * 5)]
    frame = spark.createDataFrame([(i, v, 1, "x", [2]) for i, v in rows + unfit], "vec_id long, embedding array<double>, n int, whitened string, x array<int>")
    got = whitening.whiten(frame.repartition(5)).collect()
    assert len(got) == 4 * len(rows)
    hold_against(got, rows)
    assert whitening.whiten(frame.limit(0)).count() == 0
    assert whitening.whiten(frame.filter("vec_id = 800")).count() == 0


def test_repeated_and_missing_eigenvalues(spark):
    """Equal variances need several starts; directions without variance are no components."""
    corners = [[a, b, c, 7.0, 7.0] for a in (-3.0, 3.0) for b in (-3.0, 3.0) for c in (-1.0, 1.0)]
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(corners)], "vec_id long, embedding array<double>")
    got = whitening.whiten(frame).collect()
    explained = {r["component"]: r["explained"] for r in got}
    assert explained == pytest.approx({1: 9 / 19, 2: 9 / 19, 3: 1 / 19})
    assert max(r["identity_error"] for r in got) < 1e-12
    for k in range(8):
        assert sum(r["whitened"] ** 2 for r in got if r["vec_id"] == k) == pytest.approx(3)
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).count() == 0


def test_huge_entries_stay_exact(spark):
    rows = [(0, [1e9, 1.0]), (1, [-1e9, 3.0]), (2, [5.0, -2e9]), (3, [1e300, 0.0])]
    fit = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    got = {(r["vec_id"], r["component"]): r["deviation"] for r in whitening.whiten(fit).collect()}
    assert set(got) == {(k, c) for k in range(3) for c in (1, 2)}
    assert set(got.values()) == {None}  # beyond a long
    assert whitening.whiten(spark.createDataFrame(rows, fit.schema)).count() > 0


def test_bidiagonalisation_finds_singular_triplets():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 40)) * np.linspace(3, 1, 40)
    scans = []

    def scan(q, c):
        w = x @ q
        scans.append(len(q))
        return w @ x, float(w @ w), w @ (x @ c)

    found = whitening.bidiagonalise(scan, 40, 3, [], 0.0, 1e-9, 0)
    values, right = np.linalg.svd(x)[1:]
    for k, (s, v) in enumerate(found):
        assert s == pytest.approx(values[k], rel=1e-12)
        assert abs(v @ right[k]) == pytest.approx(1, abs=1e-10)
    steps = len(scans)
    assert not [s for s, _ in whitening.bidiagonalise(scan, 40, 1, [v for _, v in found], found[-1][0], 1e-9, 1) if s > found[-1][0]]
    assert steps < 40
