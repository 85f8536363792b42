"""Tagging against an exhaustive search in plain Python, and independence of the partitioning."""
import itertools

import pytest
from pyspark.sql import functions as F

from ionweave.functions import constants as K, stats
from ionweave.operators import ranking, scoring, tagging as T
from ionweave.plans import tag_run

MASS = dict(K.residue_rows({"C": K.CARBAMIDOMETHYL}))
P = T.TagParams(frag_tol=0.02, tol_ppm=False, max_extension=1, max_gaps=1)


def ladder(seq, start, z=1):
    out, m = [start], start
    for r in reversed(seq):
        m += MASS[r] / z
        out.append(m)
    return out


@pytest.fixture(scope="module")
def data(spark):
    a = ladder("PEKTAG", 147.11)
    gapped = [x for i, x in enumerate(ladder("SAVLDE", 175.119)) if i != 2]
    rows = [(1, 1, m, 100.0 + 7 * i) for i, m in enumerate(a)] + [(1, 2, m, 50.0 + (i * 37 % 11)) for i, m in enumerate(gapped)]
    rows += [(1, 1, 200.37, 3.0), (1, 2, 333.33, 90.0)]
    peaks = spark.createDataFrame(rows, "run_id long, idx long, mz double, intensity double")
    spectra = spark.createDataFrame([(1, 1, 600.0, 2), (1, 2, 700.0, 2)], "run_id long, idx long, precursor_mz double, charge int")
    return spectra, peaks


def brute_walks(peaks, length, gap):
    """Every path by recursion: (peak numbers, spelled low to high) with at most one gap."""
    mz = sorted(peaks)
    pairs = [(a, b, MASS[a] + MASS[b]) for a, b in itertools.combinations_with_replacement(sorted(MASS, key=MASS.get), 2)]
    edges = {}
    for i, m in enumerate(mz):
        for r, x in MASS.items():
            near = min(range(len(mz)), key=lambda j: abs(mz[j] - (m + x)))
            if abs(mz[near] - (m + x)) <= P.frag_tol and near > i:
                edges.setdefault(i, []).append((near, 1, r))
    gaps = {}
    for i, j in itertools.combinations(range(len(mz)), 2):
        fit = [(abs(x - (mz[j] - mz[i])), a + b) for a, b, x in pairs if abs(x - (mz[j] - mz[i])) <= P.frag_tol]
        bridged = any(e2[0] == j for e in edges.get(i, []) for e2 in edges.get(e[0], []))
        if fit and not bridged:
            gaps.setdefault(i, []).append((j, 2, min(fit)[1]))
    out = set()

    def go(path, n, used):
        if n == length:
            out.add(tuple(path))
            return
        for j, w, _ in edges.get(path[-1], []) + ([] if used else gaps.get(path[-1], []) if gap else []):
            if n + w <= length:
                go(path + [j], n + w, used or w == 2)
    for i in range(len(mz)):
        go([i], 0, False)
    return {tuple(x + 1 for x in p) for p in out}


def test_walks_equal_exhaustive_search(spark, data):
    spectra, peaks = data
    prep = T.prepared_peaks(peaks, spectra, P).cache()
    res = T.alphabet(spark, P)
    e = T.residue_edges(prep, res, P).cache()
    g = T.gap_edges(prep, T.residue_pairs(res), e, P)
    got = T.walks(e, g, 3).filter("z = 1").select("idx", F.transform("nodes", lambda n: n.p).alias("p")).collect()
    for idx in (1, 2):
        mz = [r.mz for r in peaks.filter(F.col("idx") == idx).collect()]
        assert {tuple(r.p) for r in got if r.idx == idx} == brute_walks(mz, 3, True)


def test_known_ladder_is_found_first(spark, data):
    spectra, peaks = data
    tags = tag_run.tag_spectra(spectra, peaks, T.TagParams(frag_tol=0.02, tol_ppm=False))
    best = tags.filter("idx = 1 AND rank = 1").first()
    assert best.seq in ("PEK", "EKT", "KTA", "TAG")
    seqs = {r.seq for r in tags.filter("idx = 1").collect()}
    assert {"PEK", "EKT", "KTA", "TAG"} <= seqs
    r = tags.filter("seq = 'TAG'").first()
    # flanks and residues add up to the precursor
    mass = 600.0 * 2 - 2 * K.PROTON
    assert r.nterm_mass + sum(MASS[c] for c in "TAG") + r.cterm_mass + K.WATER == pytest.approx(mass, abs=1e-6)


def test_gap_spellings_come_in_both_orders(spark, data):
    spectra, peaks = data
    tags = tag_run.tag_spectra(spectra, peaks, T.TagParams(frag_tol=0.02, tol_ppm=False, max_gaps=1, max_evalue=0))
    seqs = {r.seq for r in tags.filter("idx = 2 AND gapped").collect()}
    assert {"VLD", "VDL"} & seqs and {s[::1] for s in seqs if set(s) == set("LDV")} >= {"VLD"} or "VDL" in seqs


def test_extension_and_diversity_keep_order(spark, data):
    spectra, peaks = data
    t = tag_run.tag_spectra(spectra, peaks, T.TagParams(frag_tol=0.02, tol_ppm=False, max_extension=2))
    assert t.filter("extended").count() > 0 and t.agg(F.max("n_res")).first()[0] == 6
    d = tag_run.tag_spectra(spectra, peaks, T.TagParams(frag_tol=0.02, tol_ppm=False, diversity=True, max_tags=3)).collect()
    for idx in (1, 2):
        ev = [r.evalue for r in sorted((r for r in d if r.idx == idx), key=lambda r: r.rank)]
        assert ev == sorted(ev) and len(ev) <= 3


def test_result_does_not_depend_on_partitioning(spark, data):
    spectra, peaks = data
    cols = ["idx", "rank", "seq", F.round("evalue", 9).alias("e")]
    one = {tuple(r) for r in tag_run.tag_spectra(spectra, peaks.repartition(1), P).select(*cols).collect()}
    many = {tuple(r) for r in tag_run.tag_spectra(spectra, peaks.repartition(17), P).select(*cols).collect()}
    assert one == many


def test_ranksum_null_counts_subsets(spark):
    null = {(r.k, r.n, r.s): r.cdf for r in scoring.ranksum_null(spark, [2, 3], 7).collect()}
    for k, n in ((2, 5), (3, 7), (3, 3)):
        sums = [sum(c) for c in itertools.combinations(range(1, n + 1), k)]
        for s in range(max(sums) + 1):
            assert null[(k, n, s)] == pytest.approx(sum(x <= s for x in sums) / len(sums))


def test_fidelity_null_is_a_distribution(spark):
    null = scoring.fidelity_null(spark, [4], draws=2000)
    assert null.agg(F.sum(F.size("sses"))).first()[0] == 2000
    t = spark.createDataFrame([(4, 0.0), (4, 1.2), (4, 99.0)], "k int, sse double")
    p = [r.p_mzfidelity for r in scoring.p_mzfidelity(t, null, 2000).orderBy("sse").collect()]
    assert p[0] == pytest.approx(1 / 2000) and 0.3 < p[1] < 0.8 and p[2] == 1.0


def test_deisotope_moves_a_doubly_charged_cluster(spark):
    step = K.ISOTOPE_STEP / 2
    mz = 600.0
    rows = [(1, 1, mz + i * step, y) for i, y in enumerate((100.0, 70.0, 30.0))] + [(1, 1, 300.0, 55.0), (1, 1, 450.5, 20.0)]
    p = spark.createDataFrame(rows, "run_id long, idx long, mz double, intensity double")
    got = sorted(r.mz for r in T.deisotope(p, 0.01, False).collect())
    assert got == pytest.approx([300.0, 450.5, 2 * mz - K.PROTON])


def test_tail_functions(spark):
    df = spark.createDataFrame([(12, 3, 0.2), (50, 30, 0.5), (40, 1, 0.01)], "n int, k int, p double")
    from math import comb, exp, factorial
    for r in df.select("*", stats.binomial_upper("n", "k", "p").alias("b"), stats.poisson_upper("k", F.col("n") * F.col("p")).alias("q")).collect():
        assert r.b == pytest.approx(sum(comb(r.n, i) * r.p ** i * (1 - r.p) ** (r.n - i) for i in range(r.k, r.n + 1)), rel=1e-9)
        lam = r.n * r.p
        assert r.q == pytest.approx(1 - sum(exp(-lam) * lam ** i / factorial(i) for i in range(r.k)), rel=1e-6)


def test_merge_series_prefers_by_on_ties(spark):
    s = "run_id int, idx int, seq string, evalue double"
    by = spark.createDataFrame([(1, 1, "AAA", 0.5), (1, 1, "CCC", 2.0)], s)
    cz = spark.createDataFrame([(1, 1, "BBB", 0.5)], s)
    got = [r.seq for r in ranking.merge_series(by, cz, 2).orderBy("merged_rank").collect()]
    assert got == ["AAA", "BBB"]
