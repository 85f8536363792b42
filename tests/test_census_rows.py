"""Rows without scores or positions, per-spectrum folds, the ridge penalty and peak widths, each with a plain twin."""
import numpy as np
import pytest

from ionweave.operators import census as C
from ionweave.operators import quality as K


def test_rows_without_a_score_come_last(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, None), (1, 3, 0.9), (1, 4, None), (2, 1, None)], "run_id int, idx long, ident_score double")
    got = {(r.run_id, r.idx): r.ident_rank for r in C.sorted_census(df).collect()}
    assert got == {(1, 3): 1, (1, 1): 2, (1, 2): 3, (1, 4): 4, (2, 1): 1}


def test_spectra_without_position_stay_alone(spark):
    df = spark.createDataFrame([(1, 1, 500.0, 2, 10.0), (1, 2, 500.001, 2, 20.0), (1, 3, None, 2, 10.0), (1, 4, 500.0, None, 10.0), (1, 5, 500.0, 2, None)],
                               "run_id int, idx long, precursor_mz double, charge_used int, rt double")
    got = {r.idx: (r.cluster, r.weight) for r in C.repeat_clusters(df).collect()}
    assert got == {1: (1, 0.5), 2: (1, 0.5), 3: (3, 1.0), 4: (4, 1.0), 5: (5, 1.0)}


def test_gini_and_cover(spark):
    rng = np.random.default_rng(0)
    rows = [(r, i, 100.0 + k, float(rng.integers(0, 4))) for r in (1, 2) for i in (1, 2) for k in range(9)]
    got = {(r.run_id, r.idx): (r.n_peaks, r.int_gini) for r in C.gini(spark.createDataFrame(rows + [(3, 1, 100.0, 0.0)], "run_id int, idx long, mz double, intensity double")).collect()}
    for key in {(r, i) for r, i, _, _ in rows}:
        x = np.sort([y for r, i, _, y in rows if (r, i) == key])
        want = 2 * (np.arange(1, 10) * x).sum() / (9 * x.sum()) - 10 / 9
        assert got[key] == ((x > 0).sum(), pytest.approx(want))
    assert got[(3, 1)] == (0, None)
    t = spark.createDataFrame([(1, 1, 1.0, 3.0), (1, 1, 2.0, 5.0), (1, 1, 7.0, 8.0), (1, 1, 7.2, 7.5)], "run_id int, idx long, low_mz double, high_mz double")
    assert C.tag_cover(t).first().tag_cover == pytest.approx(5.0)


def test_ridge_equals_newton(spark):
    rng = np.random.default_rng(1)
    rows = [(int(r), float(a), float(b), bool(rng.random() < 1 / (1 + np.exp(-a))), float(w)) for r, a, b, w in zip(rng.integers(0, 3, 240), rng.normal(size=240), rng.normal(size=240), rng.uniform(0.5, 1, 240))]
    m = C.fit_ident_model(spark.createDataFrame(rows, "run_id int, a double, b double, y boolean, w double"), "y", "w", ["a", "b"], 1.0)
    run, x = np.array([r[0] for r in rows]), np.array([[1.0, r[1], r[2]] for r in rows])
    y, w = np.array([r[3] for r in rows], float), np.array([r[4] for r in rows])
    w = w / np.bincount(run, weights=w)[run]
    beta, ridge = np.zeros(3), np.diag([0.0, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        beta -= np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (p - y)) + ridge @ beta)
    assert [m.intercept, *m.coefficients] == pytest.approx(beta, abs=1e-4)


def test_width_of_a_well_sampled_peak(spark):
    x = np.linspace(499.9, 500.1, 401)
    sigma = 0.01
    y = np.exp(-((x - 500.0) / sigma) ** 2 / 2)
    mz, width = K.half_widths(x, y)
    assert mz == pytest.approx([500.0]) and width == pytest.approx([2.3548 * sigma], rel=1e-3)
    mz, width = K.half_widths(np.array([1.0, 2, 3]), np.array([5.0, 9, 8]))
    assert np.isnan(width).all()
    rows = [(1, i, float(a), float(b)) for i in range(40) for a, b in zip(x, y)]
    peaks = spark.createDataFrame(rows, "run_id int, idx long, mz double, intensity double")
    scans = spark.createDataFrame([(1, i, "FTMS", 1, True) for i in range(40)], "run_id int, idx long, analyzer string, ms_level int, profile boolean")
    assert K.measured_resolution(peaks, scans).first().resolution == pytest.approx(500 / (2.3548 * sigma), rel=1e-3)


def test_widths_of_many_scans_are_those_of_each():
    rng = np.random.default_rng(3)
    sizes = [1, 2, 3, 40, 5, 200, 3]
    y = [np.round(rng.random(n) * 9) for n in sizes]
    x = [np.sort(rng.random(n)) for n in sizes]
    each = [K.half_widths(a, b) for a, b in zip(x, y) if len(a) > 2]
    got = K.half_widths(np.concatenate(x), np.concatenate(y), np.repeat(np.arange(len(sizes)), sizes))
    assert all(np.array_equal(g, np.concatenate([e[k] for e in each]), equal_nan=True) for k, g in enumerate(got))
