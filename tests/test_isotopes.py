"""Isotope clusters against a peak-by-peak search in plain Python, on spectra with overlapping clusters of charge 1 to 3."""
import bisect
import math
import random
import struct

import numpy as np
import pytest

from ionweave.functions import constants as K
from ionweave.operators import isotopes as I

LIMIT = {2: 0.05, 3: 0.1, 4: 0.2, 5: 0.4}


def single(x):
    return struct.unpack("f", struct.pack("f", x))[0]


def expected(mass):
    shares = [1.0]
    for k in range(1, 10):
        shares.append(shares[-1] * mass / 1800.0 / k)
    return [s / sum(shares) for s in shares]


def nearest(mz, want, tol):
    k = bisect.bisect_left(mz, want)
    near = [j for j in (k - 1, k) if 0 <= j < len(mz)]
    j = min(near, key=lambda j: (abs(mz[j] - want), j))
    return j if want - tol <= mz[j] <= want + tol else None


def cluster(mz, height, i, z, tol):
    shares, members = expected(z * (mz[i] - K.PROTON)), [i]
    while len(members) < 10:
        j = nearest(mz, mz[i] + len(members) * K.ISOTOPE_STEP / z, tol)
        if j is None:
            break
        seen, model = [height[m] for m in members] + [height[j]], shares[:len(members) + 1]
        off = 0.0
        for s, m in zip(seen, model, strict=True):
            off = single(off + s / sum(seen) * math.log(s / sum(seen) / (m / sum(model))))
        if off > single(LIMIT.get(len(seen), 0.6)):
            break
        members.append(j)
    return members


def by_hand(peaks, tol, ppm):
    if len(peaks) <= 2:
        return peaks
    measured, top = {m for m, _ in peaks}, max(h for _, h in peaks)
    peaks = [(m, h) for m, h in peaks if h >= min(0.05, 0.05 * top / 1e6)]
    mz, height = [m for m, _ in peaks], [h for _, h in peaks]
    held, out = set(), []
    charge = {}
    for i, m in enumerate(mz):
        if i in held:
            continue
        width = tol / 1e6 * m if ppm else tol
        found = [(len(c), z, c) for z in (1, 2, 3) if len(c := cluster(mz, height, i, z, width)) > 1]
        if found:
            _, charge[i], members = max(found)
            held |= set(members)
    for i, m in enumerate(mz):
        z = charge.get(i, 0)
        if i not in held or z:
            out.append((m * z - (z - 1) * K.PROTON if z > 1 else m, height[i]))
    if all(z < 2 for z in charge.values()):
        return out
    joined = []
    for m, h in sorted(out, key=lambda p: p[0]):
        new = m not in measured
        if joined and (new or joined[-1][2]) and m - joined[-1][0] <= (m * tol * 1e-6 if ppm else tol):
            joined[-1] = (m, h, True) if h > joined[-1][1] else (*joined[-1][:2], True)
        else:
            joined.append((m, h, new))
    return [(m, h) for m, h, _ in joined]


def spectrum(rng):
    """Clusters of charge 1 to 3 with shapes near the model and far from it, some on top of each other, and noise."""
    peaks = {}
    for _ in range(rng.randint(1, 12)):
        z, start = rng.randint(1, 3), rng.choice([rng.uniform(150, 1500), *peaks]) if peaks else rng.uniform(150, 1500)
        scale, wild = 10 ** rng.uniform(0, 6), rng.random() < 0.3
        for k, share in enumerate(expected(z * start)[:rng.randint(1, 8)]):
            m = start + k * K.ISOTOPE_STEP / z + rng.gauss(0, 0.001)
            peaks[m] = scale * (rng.random() if wild else share * rng.uniform(0.8, 1.25)) + 1e-3
    for _ in range(rng.randint(0, 30)):
        peaks[rng.uniform(100, 1600)] = 10 ** rng.uniform(-3, 5)
    return sorted(peaks.items())


def test_clusters_equal_a_search_peak_by_peak():
    rng, collapsed = random.Random(21), 0
    for _ in range(400):
        peaks = spectrum(rng)
        tol, ppm = rng.choice([(20.0, True), (150.0, True), (0.01, False), (0.3, False)])
        want = by_hand(peaks, min(tol, 100.0 if ppm else 0.1), ppm)
        mz, height = I.monoisotopic(np.array([m for m, _ in peaks]), np.array([h for _, h in peaks]), tol, ppm)
        assert np.stack([mz, height], axis=1) == pytest.approx(np.array(want), rel=1e-12)
        collapsed += len(want) < len(peaks)
    assert collapsed > 200


def test_shape_decides_not_spacing():
    rows = lambda shares: (np.array([500 + k * K.ISOTOPE_STEP / 2 for k in range(3)] + [900.0]), np.array([*shares, 50.0]))
    good, _ = I.monoisotopic(*rows([100.0, 55.0, 16.0]), 10, True)
    assert good.tolist() == pytest.approx([900.0, 2 * 500 - K.PROTON])
    bad, _ = I.monoisotopic(*rows([10.0, 900.0, 9000.0]), 10, True)
    assert len(bad) == 4


def test_frame_keeps_constants_and_edges(spark):
    rng = random.Random(22)
    spectra = {k: spectrum(rng) for k in range(12)}
    spectra[90], spectra[91] = [(100.0, 5.0)], [(100.0, 5.0), (101.00335, 3.0)]
    rows = [(1, k, m, h, 700.0 + k) for k, p in spectra.items() for m, h in p]
    rng.shuffle(rows)
    df = I.deisotope(spark.createDataFrame(rows, "run_id long, idx long, mz double, intensity double, mass double").repartition(5), 20.0, True)
    got = {}
    for r in df.collect():
        assert r.mass == 700.0 + r.idx
        got.setdefault(r.idx, []).append((r.mz, r.intensity))
    assert df.columns == ["run_id", "idx", "mz", "intensity", "mass"] and set(got) == set(spectra)
    for k, p in spectra.items():
        assert np.array(sorted(got[k])) == pytest.approx(np.array(sorted(by_hand(p, 20.0, True))), rel=1e-12)
    assert not I.deisotope(df.filter("false"), 20.0, True).collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1
