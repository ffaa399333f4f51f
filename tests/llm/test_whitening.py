from __future__ import annotations

import numpy as np
import pytest

from lexsnap.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, x string"


def brute(rows, components=16):
    """Per width: n, deviations by row, eigenvalues and components of the plain covariance."""
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows
            if v and all(c is not None and np.isfinite(c) for c in v)]
    out = {}
    for width in {len(v) for _, v in good}:
        xs = [(i, tuple(int(np.floor(64 * c)) + 1_000_000 for c in v)) for i, v in good if len(v) == width]
        fit = sorted({x for _, x in xs})
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        centred = np.array([[n * a - s for a, s in zip(x, sums)] for x in fit], float) / n
        cov = centred.T @ centred / n
        values, vectors = np.linalg.eigh(cov)
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        deviation = [(i, sum((n * a - s) ** 2 for a, s in zip(x, sums))) for i, x in xs]
        points = [(np.array(x, float) - np.array(sums) / n) @ vectors for _, x in xs]
        out[width] = n, deviation, values, points, np.trace(cov)
    return out


def by_row(got):
    rows = {}
    for r in got:
        rows.setdefault((r.vec_id, r.n, r.deviation), []).append(r)
    return rows


@pytest.mark.parametrize("block", [W.BLOCK_ROWS, 8])
def test_whitened_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(W, "BLOCK_ROWS", block)
    monkeypatch.setattr(W, "BLOCKS_PER_TASK", 2)
    monkeypatch.setattr(W, "BLOCK_COLUMNS", 16)  # the vectors' dimensions are split, too
    rng = np.random.default_rng(5)
    scale = np.linspace(3, 0.2, 20)
    data = [(k, (rng.normal(size=20) * scale).tolist(), "a") for k in range(120)]
    data += [(200 + k, data[3][1], "b") for k in range(40)]  # copies count once in the fit
    data += [(500, data[5][1][:19] + [None], "c"), (501, None, "c"), (502, [], "c"), (503, [float("nan")] * 20, "c"),
             (504, [float("inf")] * 20, "c"), (None, data[7][1], "c"), (3, data[8][1], "c")]
    n, deviation, values, points, trace = brute(data)[20]
    got = W.whitened(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == 16 * len(deviation)
    assert {r.n for r in got} == {n}
    assert sorted({(r.vec_id is None, r.vec_id, r.deviation) for r in got}, key=str) == sorted(
        {(i is None, i, d) for i, d in deviation}, key=str)
    assert max(r.identity_error for r in got) < 1e-8
    for r in got:
        assert r.explained == pytest.approx(values[r.component - 1] / trace, rel=1e-9)
    want = {(i, d): p / np.sqrt(values) for (i, d), p in zip(deviation, points)}
    signs = {}
    for r in got:
        expected = want[(r.vec_id, r.deviation)][r.component - 1]
        assert abs(r.whitened) == pytest.approx(abs(expected), abs=1e-6)
        if abs(expected) > 1e-3:
            signs.setdefault(r.component, set()).add(np.sign(r.whitened * expected))
    assert all(len(s) == 1 for s in signs.values())


def test_widths_apart_and_components_without_variance(spark):
    data = [(1, [1.0, 2.0], ""), (2, [3.0, 2.0], ""), (3, [1.0, 2.0, 3.0], ""), (4, [0.5], ""), (5, [2.5], "")]
    got = W.whitened(spark.createDataFrame(data, SCHEMA)).collect()
    rows = {(r.vec_id, r.component): r for r in got}
    assert sorted(rows) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2), (3, 3), (4, 1), (5, 1)]
    assert abs(rows[1, 1].whitened) == pytest.approx(1.0) and rows[1, 1].explained == pytest.approx(1.0)
    assert rows[1, 1].whitened == pytest.approx(-rows[2, 1].whitened)
    assert rows[1, 2].whitened is None and rows[1, 2].explained == 0.0
    assert rows[3, 1].whitened is None and rows[3, 1].deviation == 0 and rows[3, 1].identity_error == 0.0
    assert rows[4, 1].n == 2 and rows[4, 1].deviation == 128 * 128


def test_entries_too_large_for_whole_numbers(spark):
    schema = "vec_id long, embedding array<double>"
    got = W.whitened(spark.createDataFrame([(1, [1e308, 0.0]), (2, [-1e308, 1.0])], schema)).collect()
    assert {r.deviation for r in got} == {None}
    assert all(r.whitened is None or np.isfinite(r.whitened) for r in got)


def test_empty_table(spark):
    assert W.whitened(spark.createDataFrame([], SCHEMA)).count() == 0
