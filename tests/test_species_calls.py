"""Species calls against a genus-by-genus search in plain Python: estimated pi0, detection limits, all reasons."""
import math
import random
from collections import Counter

import numpy as np
import pytest

from ionweave.operators import species as X

ALPHA, TAU, N_MIN, UNITS = 0.05, 0.01, 10, 50


def tail(o, lam):
    """P(X >= o), summed from far above."""
    if o <= 0:
        return 1.0
    top = int(max(o, lam) + 80 + 14 * math.sqrt(max(o, lam)))
    return min(1.0, math.fsum(math.exp(-lam + k * math.log(lam) - math.lgamma(k + 1)) for k in range(o, top)))


def smoothed(values):
    """The smoothing spline of three degrees of freedom through values on the grid, at its last point: penalised least squares on the
    values, with the bending energy of the natural cubic spline through them."""
    h, n = 0.05, len(values)
    Q, R = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for j in range(n - 2):
        Q[[j, j + 1, j + 2], j] = [1 / h, -2 / h, 1 / h]
        R[j, j] = 2 * h / 3
        if j + 1 < n - 2:
            R[j, j + 1] = R[j + 1, j] = h / 6
    energy = Q @ np.linalg.inv(R) @ Q.T
    low, high = 1e-12, 1e12
    for _ in range(300):
        mid = math.sqrt(low * high)
        trace = np.trace(np.linalg.inv(np.eye(n) + mid * energy))
        low, high = (mid, high) if trace > 3 else (low, mid)
    return float(np.linalg.solve(np.eye(n) + low * energy, np.array(values))[-1])


def estimate(p):
    if len(p) < 2:
        return 1.0
    found = smoothed([sum(x >= k * 0.05 for x in p) / len(p) / (1 - k * 0.05) for k in range(1, 20)])
    return min(1.0, found) if found > 0 else 1.0


def q_values(p, pi0):
    order = sorted(range(len(p)), key=lambda i: p[i])
    out = [1.0] * len(p)
    for i in order:
        rank = sum(x <= p[i] for x in p)
        out[i] = p[i] * len(p) / rank * pi0
    return [min([1.0] + [out[j] for j in range(len(p)) if p[j] >= p[i]]) for i in range(len(p))]


def by_hand(genera, C, pi0, coarse, units):
    tested = [t for t in genera if genera[t]["observed"] >= 5]

    def over(p):
        share = pi0 or estimate([p[t] for t in tested])
        q = dict.fromkeys(genera, 1.0) | dict(zip(tested, q_values([p[t] for t in tested], share), strict=True))
        return q, share

    def evaluate(present):
        spill = {}
        for t, g in genera.items():
            up = [h for h in present if (-genera[h]["observed"], h) < (-g["observed"], t)]
            spill[t] = sum(C.get((t, h), 0.0) * genera[h]["n_hat"] for h in up)
        p = {t: tail(g["observed"], spill[t] + g["random"]) for t, g in genera.items()}
        q, share = over(p)
        return frozenset(t for t in tested if q[t] <= ALPHA and genera[t]["share"] >= TAU and genera[t]["observed"] >= N_MIN), spill, q, share

    seen = [frozenset()]
    while (new := evaluate(seen[-1])[0]) not in seen:
        seen.append(new)
    present = frozenset.intersection(*seen[seen.index(new):])
    while True:
        fits, spill, q, share = evaluate(present)
        if present <= fits:
            break
        present &= fits
    rand, _ = over({t: tail(g["observed"], g["random"]) for t, g in genera.items()})
    out = {}
    for t, g in genera.items():
        lod = None
        if coarse:
            call = "no_call", "low_resolution"
        elif units < UNITS:
            call = "no_call", "few_spectra"
        elif t in present:
            call = "present", "pass"
        elif t in fits:
            call = "no_call", "unstable"
        elif t in tested and spill[t] > 0 and rand[t] <= ALPHA < q[t]:
            call = "no_call", "near_neighbour"
        else:
            call = "not_detected", "not_significant" if t not in tested or q[t] > ALPHA else "low_share" if g["share"] < TAU else "few_genus_spectra"
            limit = ALPHA * (1 + sum(q[u] <= ALPHA for u in tested if u != t)) / ((len(tested) + (t not in tested)) * share)
            o = 0
            while limit < 1 and tail(o, spill[t] + g["random"]) > limit:
                o += 1
            lod = max(o, N_MIN, 5, math.ceil(TAU * units - 1e-9)) / units
        out[t] = (*call, lod, q[t], rand[t], share)
    return out


def cases():
    rng = random.Random(41)
    for run in range(12):
        units = 40 if run == 3 else rng.randint(300, 4000)
        genera = {t: {"observed": rng.choice([0, 3, 6, 8, 11, 14, 20, 40, 90, 300]), "random": rng.choice([0.1, 0.7, 3.5, 9.0])} for t in range(1, rng.choice([2, 4, 12, 25]))}
        for g in genera.values():
            g["n_hat"], g["share"] = g["observed"] * rng.uniform(0.5, 1), g["observed"] / units * rng.choice([1, 1, 0.2])
        yield run, units, run == 5, genera
    # genera without homology, some present and some by chance alone
    for run, present in ((21, 10), (22, 20), (23, 30)):
        counts = [rng.randint(40, 90) for _ in range(present)] + [max(5, sum(rng.random() < 0.01 for _ in range(1400))) for _ in range(40 - present)]
        yield run, 3000, False, {100 + k: {"observed": o, "random": 14.0, "n_hat": float(o), "share": o / 3000} for k, o in enumerate(counts)}
    # two genera alike: the second is explained by the first
    yield 20, 1000, False, {1: {"observed": 400, "random": 0.5, "n_hat": 400.0, "share": 0.4}, 2: {"observed": 30, "random": 0.5, "n_hat": 30.0, "share": 0.03},
                           30: {"observed": 8, "random": 0.1, "n_hat": 8.0, "share": 0.02}, 31: {"observed": 90, "random": 0.5, "n_hat": 90.0, "share": 0.002}}


@pytest.mark.parametrize("pi0", [1.0, 0.6, 0.0])
def test_calls_equal_plain_python(spark, pi0):
    rng = random.Random(42)
    C = {(g, h): rng.uniform(0, 0.25) for g in range(1, 25) for h in range(1, 25) if g != h and rng.random() < 0.3} | {(2, 1): 0.08}
    runs = list(cases())
    rows = [(run, t, g["observed"], g["share"], g["random"], g["n_hat"], units, coarse) for run, units, coarse, genera in runs for t, g in genera.items()]
    df = spark.createDataFrame(rows, "run_id int, taxid int, observed int, share double, random_expected double, n_hat double, n_units int, low_resolution boolean")
    got = X.call_species(df, spark.createDataFrame([(g, h, c) for (g, h), c in C.items()], "g int, h int, c double"), ALPHA, TAU, N_MIN, UNITS, pi0).collect()
    want = {(run, t): v for run, units, coarse, genera in runs for t, v in by_hand(genera, C, pi0, coarse, units).items()}
    assert len(got) == len(want) == len({(r.run_id, r.taxid) for r in got})
    for r in got:
        call, reason, lod, q, rand, share = want[r.run_id, r.taxid]
        assert (r.call, r.reason) == (call, reason), (r, want[r.run_id, r.taxid])
        assert (r.lod, r.qvalue, r.qvalue_random, r.pi0) == (pytest.approx(lod), pytest.approx(q, rel=1e-6, abs=1e-9), pytest.approx(rand, rel=1e-6, abs=1e-9), pytest.approx(share, rel=1e-6))
    reasons = Counter(v[1] for v in want.values())
    assert set(reasons) >= {"low_resolution", "few_spectra", "pass", "near_neighbour", "not_significant", "few_genus_spectra", "low_share"} and (pi0 or len({v[5] for v in want.values()}) > 2)


def test_weights_are_those_of_a_smoother():
    w = np.array(X.pi0_weights())
    assert w.sum() == pytest.approx(1) and w @ X.PI0_GRID == pytest.approx(0.95)      # constants and lines stay as they are
    rng = np.random.default_rng(1)
    for _ in range(5):
        v = rng.uniform(0, 1, len(w))
        assert w @ v == pytest.approx(smoothed(v.tolist()), rel=1e-6)


def test_detection_limit_is_the_first_count_below(spark):
    rows = [(lam, lim) for lam in (0.0, 0.02, 0.5, 7.3, 220.0, 1e5) for lim in (1.5, 0.9, 0.05, 1e-6)]
    for r in spark.createDataFrame(rows, "lam double, lim double").withColumn("o", X.smallest_count("lam", "lim")).collect():
        if r.lim >= 1:
            assert r.o == 0
        elif r.lam == 0:
            assert r.o == 1
        else:
            assert tail(r.o, r.lam) <= r.lim < tail(r.o - 1, r.lam)
