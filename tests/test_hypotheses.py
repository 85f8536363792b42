"""Precursor hypotheses against plain Python, and tags under hypotheses against tags of each charge on its own."""
import random

import pytest
from pyspark.sql import functions as F

from ionweave.functions import constants as K
from ionweave.operators import precursor as H
from ionweave.operators.tagging import TagParams
from ionweave.plans import tag_run

TOL = 0.02
SHIFTS = [-11.5, -7.5, -4.5, 4.5, 7.5, 11.5]


def pairs(mz, total, w):
    """Peaks with a partner at the sum; of two singly charged ones the lower is counted."""
    n = 0
    for i, m in enumerate(mz):
        want = total - w * m
        if w == 1 and want <= m or want <= 0:
            continue
        n += any(abs(x - want) <= TOL and (x > m if w == 1 else j != i) for j, x in enumerate(mz))
    return n


def excess(mz, mass, z=0):
    """In units of one off-target pair."""
    out = 0
    for w, total in [(1, mass + 2 * K.PROTON)] + ([(z - 1, mass + z * K.PROTON)] if z >= 3 else []):
        out += 6 * pairs(mz, total, w) - sum(pairs(mz, total + s, w) for s in SHIFTS)
    return out


def best(mz, precursor, z, isotopes, aware=False):
    mass = precursor * z - z * K.PROTON
    return max((excess(mz, mass - k * K.ISOTOPE_STEP, z if aware else 0), -abs(k), -k, k) for k in isotopes)


def infer(peaks, precursor, cands, isotopes, margin, aware=False):
    far = [(m, h) for m, h in peaks if abs(m - precursor) > 3.5]
    total = sum(h for _, h in far)
    if 1 in cands and total and sum(h for m, h in far if m > precursor) / total < 0.05:
        return 1, "inferred", "one_plus", None
    mz = sorted({m for m, _ in sorted(peaks, key=lambda p: (-p[1], -p[0]))[:150]})
    fits = [z for z in cands if not (mz and mz[-1] > z * precursor - (z - 1) * K.PROTON + 1.5)] or list(cands)
    ranked = sorted((-best(mz, precursor, z, isotopes, aware)[0], z) for z in fits)
    if ranked[0][0] >= 0:
        return (fits[0], "inferred", "range", None) if fits[0] != cands[0] else (2 if 2 in fits else fits[0], "assumed", "none", None)
    close = len(ranked) > 1 and ranked[1][0] - ranked[0][0] < 6 * margin
    return ranked[0][1], "ambiguous" if close else "inferred", "complement", ranked[1][1] if close else None


def by_hand(spectrum, peaks, p, ms1):
    precursor, header, listed = spectrum
    listed = sorted({z for z in listed or [] if 1 <= z <= 8})
    if header > 0:
        out = [(header, "header", True)]
        if p.header_check == "both":
            z = checked(peaks, precursor, header, p, ms1)
            out += [(z, "check_call", False)] if z != header else []
    elif p.mode == "assume2":
        out = [(2, "assumed", True)]
    elif len(listed) == 1:
        out = [(listed[0], "possible", True)]
    else:
        cands = listed or list(range(p.zmin, p.zmax + 1))
        call, src, _, runner = infer(peaks, precursor, cands, p.isotopes, p.infer_margin)
        if p.mode == "enumerate":
            chosen = call if src != "assumed" else 2 if 2 in cands else cands[0]
            out = [(z, "possible" if listed else "enumerated", z == chosen) for z in cands]
        else:
            out = [(call, src, True)] + ([(runner, src, False)] if runner else [])
    mz = sorted({m for m, _ in sorted(peaks, key=lambda q: (-q[1], -q[0]))[:150]})
    rows = []
    for k, (z, src, chosen) in enumerate(sorted(out)):
        iso = best(mz, precursor, z, p.isotopes)[3]
        rows.append((k, len(out), z, src, chosen, iso, round(precursor - iso * K.ISOTOPE_STEP / z, 9)))
    return rows


def checked(peaks, precursor, header, p, ms1):
    """The charge a disagreement rests on, else the header."""
    call, spaced = ms1
    if call:
        return header if header in spaced or call == header else call
    mz = sorted({m for m, _ in sorted(peaks, key=lambda q: (-q[1], -q[0]))[:150]})
    cands = sorted({*range(p.zmin, p.zmax + 1), header})
    z, src, basis, runner = infer(peaks, precursor, cands, [0], 2.0, True)
    own = best(mz, precursor, header, [0], True)[0]
    against = lambda c: best(mz, precursor, c, [0], True)[0] > 0 and best(mz, precursor, c, [0], True)[0] - own >= 6 * p.header_margin
    if header in (z, runner) or src == "assumed":
        return header
    if src == "ambiguous":
        return z if against(runner) else header
    return z if basis == "one_plus" or basis == "complement" and against(z) else header


def peptide(rng, z, n, share):
    """Both ion series of a random peptide at charge 1 and some at 2, and the precursor m/z."""
    masses = dict(K.residue_rows({}))
    chain = [masses[r] for r in rng.choices(sorted(masses), k=n)]
    mass, b, peaks = sum(chain) + K.WATER, 0.0, []
    for m in chain[:-1]:
        b += m
        ions = [b + K.PROTON, mass - b + K.PROTON] + ([(mass - b + 2 * K.PROTON) / 2] if z > 2 else [])
        peaks += [(x + rng.gauss(0, 0.002), rng.uniform(20, 200)) for x in ions if rng.random() < share]
    return (mass + z * K.PROTON) / z, peaks


@pytest.fixture(scope="module")
def run(spark):
    rng, spectra, peaks, ms1 = random.Random(31), {}, {}, {}
    for k in range(110):
        z = rng.randint(1, 4)
        precursor, p = peptide(rng, z, rng.randint(6, 14), rng.choice([0.2, 0.4, 0.8]))
        p += [(round(rng.uniform(100, 1200), 1), rng.uniform(1, 40)) for _ in range(rng.randint(0, 15) if k % 2 else 60)]
        p = [(m, h) for m, h in p if z > 1 or m < precursor + 5]
        kind = k % 5
        header = z if kind == 0 else rng.randint(1, 4) if kind == 1 else 0
        spectra[k] = (precursor + rng.choice([0, 0, K.ISOTOPE_STEP / z]), header, [None, None, [z], [9, 3, 2, 3], None][kind])
        peaks[k] = sorted(set(p)) if k != 44 else []
        ms1[k] = (rng.choice([0, 0, 0, z]), [z] if rng.random() < 0.5 else [])
    s = spark.createDataFrame([(1, k, *v) for k, v in spectra.items()], "run_id long, idx long, precursor_mz double, charge int, possible_charges array<int>")
    p = spark.createDataFrame([(1, k, m, h) for k, v in peaks.items() for m, h in v], "run_id long, idx long, mz double, intensity double")
    m = spark.createDataFrame([(1, k, *v) for k, v in ms1.items()], "run_id long, idx long, ms1_charge int, spaced array<int>")
    return spectra, peaks, ms1, s, p, m


@pytest.mark.parametrize("params", [H.HypothesisParams(), H.HypothesisParams("enumerate", 1, 4), H.HypothesisParams("infer", 1, 4), H.HypothesisParams("infer", 2, 3, infer_margin=4.0, isotopes=(0, 1, -1)),
                                    H.HypothesisParams("infer", 1, 4, isotopes=(1,), header_check="both", header_margin=2.0)])
def test_hypotheses_equal_plain_python(run, params):
    spectra, peaks, ms1, s, p, m = run
    got = {}
    for r in H.precursor_hypotheses(s, p, TOL, params, m if params.header_check == "both" else None).collect():
        got.setdefault(r.idx, []).append((r.hypothesis, r.n_hyp, r.z, r.charge_src, r.selected, r.iso, round(r.precursor_mz, 9)))
    want = {k: by_hand(spectra[k], peaks[k], params, ms1[k]) for k in spectra}
    assert {k: sorted(v) for k, v in got.items()} == want
    if params.mode != "assume2":
        assert any(len(v) > 1 for v in want.values())


def test_impossible_parameters_are_refused():
    for bad in (dict(mode="guess"), dict(zmin=3, zmax=2), dict(zmax=9), dict(isotopes=()), dict(isotopes=(0, 0)), dict(header_check="warn")):
        with pytest.raises(ValueError):
            H.HypothesisParams(**bad)


def test_tags_under_hypotheses_equal_tags_of_each_charge(run):
    """Each charge tagged by itself, without cut or cap; then E-values times the number of hypotheses, the cut, the cap of a
    hypothesis and the cap of the spectrum in plain Python."""
    _, _, _, s, p, _ = run
    params = TagParams(frag_tol=TOL, tol_ppm=False, complement_tol=TOL, max_tags=12, max_evalue=15.0)
    hyp = H.HypothesisParams("enumerate", 1, 3)
    table = H.precursor_hypotheses(s, p, TOL, hyp).collect()
    got = {}
    for r in tag_run.tag_hypotheses(s, p, params, hyp).collect():
        got.setdefault(r.idx, []).append((r.merged_rank, r.hypothesis, r.seq, r.charge, round(r.evalue, 9), round(r.nterm_mass, 6), round(r.low_mz, 6), r.n_hyp, r.precursor_charge, r.charge_src))
    alone = {}
    for z in sorted({h.z for h in table}):
        every = tag_run.tag_spectra(s.withColumn("charge", F.lit(z)), p, TagParams(frag_tol=TOL, tol_ppm=False, complement_tol=TOL, max_tags=0, max_evalue=0.0))
        for r in every.collect():
            alone.setdefault((r.idx, z), []).append(r)
    want = {}
    for h in sorted(table, key=lambda h: h.hypothesis):
        mine = [(r.evalue * h.n_hyp, h.hypothesis, r) for r in alone.get((h.idx, h.z), [])]
        mine = sorted((t for t in mine if t[0] <= 15.0), key=lambda t: (t[0], t[2].seq, t[2].low_mz, t[2].charge))[:12]
        want.setdefault(h.idx, []).extend((e, k, r.seq, r.low_mz, r.charge, r.nterm_mass, h) for e, k, r in mine)
    for k, rows in want.items():
        rows = sorted(rows, key=lambda t: t[:4])[:12]
        assert [(n + 1, t[1], t[2], t[4], round(t[0], 9), round(t[5], 6), round(t[3], 6), t[6].n_hyp, t[6].z, t[6].charge_src) for n, t in enumerate(rows)] == sorted(got.pop(k, [])), k
    assert not got
    several = [rows for rows in want.values() if len({t[1] for t in rows}) > 1]
    assert several, "no spectrum had tags under two hypotheses"
