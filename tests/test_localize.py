"""Localisation of a gap under the three models against plain Python, with satellites of neutral losses on the shifted ions."""
import random

import pytest

from ionweave.functions import constants as K
from ionweave.operators import placement as L

TOL = 0.02
NH3 = 17.0265491


def by_hand(peptide, lo, hi, delta, mz, charges, model):
    masses, n = dict(K.residue_rows({})), len(peptide)
    pre = [0.0]
    for r in peptide:
        pre.append(pre[-1] + masses[r])

    def nearest(m, z):
        want = (m + z * K.PROTON) / z
        near = [x for x in mz if abs(x - want) <= TOL]
        return min(near, key=lambda x: (abs(x - want), x), default=None)

    found = {(kind, i, z, s): (m + s * delta, nearest(m + s * delta, z)) for i in range(1, n) for z in range(1, charges + 1) for s in (0, 1)
             for kind, m in (("b", pre[i]), ("y", pre[-1] - pre[i] + K.WATER))}
    found = {k: v for k, v in found.items() if v[1] is not None}
    gone = set()
    if model == "strict":
        for (kind, i, z, s), (m, _) in found.items():
            if s and any(not s2 and z2 == z and any(abs(m2 - loss - m) <= TOL * z for loss in (K.WATER, NH3)) for (_, _, z2, s2), (m2, _) in found.items()):
                gone.add((kind, i, z, s))
    scores = []
    for j in range(lo, hi + 1):
        own = [v[1] for (kind, i, z, s), v in found.items() if (kind, i, z, s) not in gone and s == int(j < i if kind == "b" else j >= i)]
        scores.append(len(own) if model == "count" else len(set(own)))
    top = max(scores)
    return lo + scores.index(top), top, scores.count(top), top - max([s for s in scores if s < top], default=0), len(gone)


@pytest.mark.parametrize("model", ["count", "unique", "strict"])
def test_models_equal_plain_python(spark, model):
    rng, rows, peaks, want = random.Random(81), [], [], {}
    for k in range(60):
        peptide = "".join(rng.choice("GASPVTLNDQKEMHFRYW") for _ in range(rng.randint(2, 14)))
        n = len(peptide)
        lo = rng.randrange(n)
        hi, delta, site = rng.randint(lo, n - 1), rng.choice([15.9949, -K.WATER, -NH3, 79.966, -0.984]), lo
        masses, mz = dict(K.residue_rows({})), []
        for i in range(1, n):
            left, right = sum(masses[r] for r in peptide[:i]), sum(masses[r] for r in peptide[i:])
            for m in (left + (delta if site < i else 0), right + K.WATER + (delta if site >= i else 0)):
                for z in (1, 2):
                    if rng.random() < 0.6:
                        mz.append((m + z * K.PROTON) / z + rng.gauss(0, 0.004))
                        if rng.random() < 0.3:
                            mz.append((m - rng.choice([K.WATER, NH3]) + z * K.PROTON) / z + rng.gauss(0, 0.004))
        mz += [rng.uniform(60, 900) for _ in range(20)]
        mz = mz if k != 9 else []
        rows.append((k, 1, k, peptide, lo, hi, delta))
        peaks += [(1, k, m) for m in set(mz)]
        want[k] = by_hand(peptide, lo, hi, delta, sorted(set(mz)), 2, model)
    df = spark.createDataFrame([*rows, (99, 1, 1, "PEPTLDE", 0, -1, 1.0)], "id int, run_id int, idx int, peptide string, region_lo int, region_hi int, delta_mass double")
    got = L.localize(df, spark.createDataFrame(peaks, "run_id int, idx int, mz double"), TOL, charges=2, model=model).collect()
    assert {r.id: (r.loc_site, r.loc_score, r.loc_ties, r.loc_lead, r.loc_excluded) for r in got} == want
    assert (model == "strict") == any(w[4] for w in want.values())


def test_unknown_model(spark):
    with pytest.raises(ValueError):
        L.localize(None, None, 0.1, model="guess")
