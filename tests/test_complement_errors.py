"""Complement errors against plain Python, and the tolerance of a run from its peaks."""
import random

import pytest
from pyspark.sql import functions as F

from ionweave.functions import constants as K
from ionweave.operators import precursor as H
from ionweave.operators.tagging import TagParams
from ionweave.plans import tag_run


def by_hand(mz, mass, charge, ends, window, rule):
    out = {}
    for z, end in ends:
        found = []
        for r in ["same", "precursor"] if rule == "both" else [rule]:
            if r == "precursor" and z >= charge:
                continue
            want = mass / z + 2 * K.PROTON - end if r == "same" else (mass + charge * K.PROTON - z * end) / (charge - z)
            near = min(mz, key=lambda x: (abs(x - want), -x))
            if near != end and abs(near - want) <= window:
                found.append(near - want)
        if found:
            out[(z, end)] = min(found, key=abs)
    return sorted((end, round(e, 9)) for (_, end), e in out.items())


@pytest.mark.parametrize("rule", ["same", "precursor", "both"])
def test_errors_equal_plain_python(spark, rule):
    rng, peaks, ends, want = random.Random(3), [], [], {}
    for k in range(60):
        charge, mass = rng.randint(2, 4), rng.uniform(700, 1800)
        mz = sorted({round(rng.uniform(150, 900), 2) for _ in range(rng.choice([1, 12, 80]))} | {mass / 2 + K.PROTON})
        mine = [(rng.randint(1, 2), rng.choice(mz)) for _ in range(2)] + [(1, mass / 2 + K.PROTON)]
        peaks += [(1, k, m, mass, charge) for m in mz]
        ends += [(1, k, *e) for e in mine]
        want[k] = by_hand(mz, mass, charge, mine, 0.7, rule)
    p = spark.createDataFrame(peaks, "run_id long, idx long, mz double, mass double, charge_used int")
    e = spark.createDataFrame(ends, "run_id long, idx long, z int, mz double")
    got = {}
    for r in H.complement_errors(e.union(e), p, 0.7, rule).collect():       # repeated ends count once
        got.setdefault(r.idx, []).append((r.mz, round(r.err, 9)))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    assert H.complement_errors(e.limit(0), p, 0.7, rule).count() == 0


def test_window_is_bounded():
    assert [round(H.measurement_window(t, ppm), 6) for t, ppm in [(20, True), (1, True), (0.05, False), (0.5, False)]] == [0.12, 0.1, 0.3, 0.9]


def test_a_run_shows_its_tolerance(spark):
    """Run 1: partners are off by 0.01 on the mean and 0.004 around it. Run 2: no series, so nothing is measured."""
    rng, masses = random.Random(7), dict(K.residue_rows({}))
    spectra, peaks = [], []
    for k in range(160):
        chain = [masses[r] for r in rng.choices(sorted(masses), k=11)]
        mass, b, mz = sum(chain) + K.WATER, 0.0, []
        for m in chain[:-1]:
            b += m
            mz += [b + K.PROTON, mass - b + K.PROTON + rng.gauss(0.01, 0.004)]
        spectra.append((1, k, (mass + 2 * K.PROTON) / 2, 2))
        peaks += [(1, k, m, rng.uniform(50, 200)) for m in mz]
    spectra += [(2, k, 600.0, 2) for k in range(20)]
    peaks += [(2, k, rng.uniform(100, 1100), rng.uniform(1, 9)) for k in range(20) for _ in range(6)]
    s = spark.createDataFrame(spectra, "run_id long, idx long, precursor_mz double, charge int")
    p = spark.createDataFrame(peaks, "run_id long, idx long, mz double, intensity double")
    got = {r.run_id: r for r in tag_run.measured_tolerance(s, p, TagParams(frag_tol=0.02, tol_ppm=False, complement_tol=0.005)).collect()}
    assert set(got) == {1, 2} and got[1].ok and not got[2].ok and got[2].tol == 0.005
    assert abs(abs(got[1]["median"]) - 0.01) < 0.004 and 0.01 < got[1].tol < 0.03 and got[1].window == 0.12
    few = tag_run.measured_tolerance(s.filter("run_id = 1"), p, TagParams(frag_tol=0.02, tol_ppm=False, complement_tol=0.005), probe=10).first()
    assert few.n <= 20 and not few.ok and few.tol == 0.005
