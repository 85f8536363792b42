"""Tails far from the mean and inputs beyond any fixed number of rounds, residues or terms."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionweave.functions import stats
from ionweave.operators import evaluation as E
from ionweave.operators import placement as L
from ionweave.operators import ranking as R
from ionweave.operators import species as X
from ionweave.operators.core import connected_components


def log_sum(terms):
    top = max(terms)
    return math.exp(top) * math.fsum(math.exp(t - top) for t in terms)


def poisson(o, lam):
    n = int(40 * math.sqrt(max(o, lam)) + 400)
    pmf = lambda k: -lam + k * math.log(lam) - math.lgamma(k + 1)
    if o <= 0:
        return 1.0
    return log_sum([pmf(k) for k in range(o, o + n)]) if o > lam else 1 - log_sum([pmf(k) for k in range(max(0, o - n), o)])


def binomial(n, k, p):
    pmf = lambda j: math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log(1 - p)
    if k <= 0:
        return 1.0
    return log_sum([pmf(j) for j in range(k, n + 1)]) if k > n * p else 1 - log_sum([pmf(j) for j in range(k)])


def test_poisson_tail(spark):
    cases = [(0, 1.0), (1, 0.5), (5, 5.0), (3, 20.0), (1000, 1000.0), (900, 1000.0), (1200, 1000.0), (100001, 1e5), (99000, 1e5), (1000001, 1e6), (10, 1e-3)]
    df = spark.createDataFrame(cases, "o long, lam double").withColumn("t", stats.poisson_upper("o", "lam"))
    for r in df.collect():
        assert r.t == pytest.approx(poisson(r.o, r.lam), rel=1e-7, abs=1e-12), r


def test_binomial_tail(spark):
    cases = [(2000, 100, 0.5), (20000, 5, 0.2), (2000, 1000, 0.5), (2000, 1100, 0.5), (2000, 900, 0.5), (10, 3, 0.3), (10, 10, 0.9), (20000, 4000, 0.2), (20000, 4300, 0.2), (5, 0, 0.1)]
    df = spark.createDataFrame(cases, "n long, k long, p double").withColumn("t", stats.binomial_upper("n", "k", "p"))
    for r in df.collect():
        assert r.t == pytest.approx(binomial(r.n, r.k, r.p), rel=1e-7, abs=1e-12), r


def test_mcnemar_of_lopsided_counts(spark):
    rows = [(1, k < 100, k >= 100) for k in range(2000)]
    r = E.paired_stats(spark.createDataFrame(rows, "g int, a boolean, b boolean"), ["g"], "a", "b").first().asDict()
    assert [v for k, v in r.items() if "p" in k and isinstance(v, float) and v < 1e-200], r


def test_resampling_has_the_whole_distribution():
    assert len(E.POISSON_ONE) > 12 and E.POISSON_ONE[0] == math.exp(-1)


@pytest.mark.parametrize("flank", [50, 60, 61, 100])
def test_flanks_of_any_length(spark, flank):
    seq = "G" * flank + "PEPTIDE" + "A" * flank
    occ = spark.createDataFrame([("P", flank, 7, 57.02146372 * flank, 71.03711378 * flank)], "accession string, pos int, len int, want_n double, want_c double")
    w = L.windows_by_mass(occ, spark.createDataFrame([("P", seq)], "accession string, sequence string"), 0.5).collect()
    assert [(r.start, r.end) for r in w] == [(0, 2 * flank + 7)]


def test_deep_taxonomy(spark):
    nodes = spark.createDataFrame([(k, max(k - 1, 0)) for k in range(150)], "taxid long, parent long")
    a = X.ancestors(nodes)
    assert a.count() == 150 * 151 // 2 and a.agg(F.max("dist")).first()[0] == 149
    with pytest.raises(ValueError):
        X.ancestors(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "taxid long, parent long"))


def test_long_chain_of_components(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    c = connected_components(edges, spark.range(301).select(F.col("id").alias("node")))
    assert c.filter("component <> 0").count() == 0


def test_least_squares_to_the_optimum(spark):
    rng = np.random.default_rng(3)
    for _ in range(20):
        p, o = rng.random((8, 8)), rng.normal(1, 2, 8)
        n = X.nnls(p, o)
        g = p.T @ (o - p @ n)
        assert (n >= 0).all() and (g <= 1e-8).all() and np.abs(g[n > 0]).max(initial=0) < 1e-8
    ov = spark.createDataFrame([("a", "a", 10), ("b", "b", 10), ("a", "b", 5)], "a string, b string, shared long")
    sizes = spark.createDataFrame([("a", 10), ("b", 10)], "taxon string, kmers long")
    obs = spark.createDataFrame([(1, "a", 20), (1, "b", 10), (2, "a", 4)], "run_id long, taxon string, observed long")
    got = {(r.run_id, r.taxon): r.n_hat for r in X.deconvolve(ov, sizes, obs).collect()}
    assert got == {(1, "a"): pytest.approx(20), (1, "b"): pytest.approx(0, abs=1e-9), (2, "a"): pytest.approx(4)}


def test_present_sets_on_a_cycle(spark, monkeypatch):
    """A set map that goes round four sets: the members they have in common stay."""
    sets = {frozenset(): {1, 2}, frozenset({1, 2}): {1, 3}, frozenset({1, 3}): {1, 4}, frozenset({1, 4}): {1, 2}, frozenset({1}): {1}}

    def evaluate(g, C, alpha, tau, n_min, pi0):
        now = frozenset(r.taxid for r in g.filter("present").collect())
        return g.drop("qualifies", "spill", "pvalue", "qvalue").withColumn("qualifies", F.col("taxid").isin(list(sets[now]))).withColumn(
            "spill", F.lit(0.0)).withColumn("pvalue", F.lit(0.0)).withColumn("qvalue", F.lit(0.0)).withColumn("pi0", F.lit(pi0))
    monkeypatch.setattr(X, "_evaluate", evaluate)
    genera = spark.createDataFrame([(1, k, 50, 0.1, 0.5, 50.0, 500) for k in range(1, 6)],
                                   "run_id long, taxid long, observed long, share double, random_expected double, n_hat double, n_units long")
    calls = X.call_species(genera, spark.createDataFrame([(1, 2, 0.1)], "g long, h long, c double"))
    assert [r.taxid for r in calls.filter("call = 'present'").collect()] == [1]


def test_decoys_of_stubborn_peptides(spark):
    tags = spark.createDataFrame([("AAB",), ("AAAAAAAAB",), ("AAA",)], "seq string")
    got = {r.seq: r.decoy_seq for r in X.decoy_tags(tags).collect()}
    assert sorted(got) == ["AAAAAAAAB", "AAB"] and all(sorted(a) == sorted(b) and b not in (a, a[::-1]) for a, b in got.items())
    pool = {r.peptide: r.decoy for r in E.decoy_pool(spark.createDataFrame([("AAAAK",), ("PEPTIDEK",)], "peptide string")).collect()}
    assert pool["AAAAK"] is None and sorted(pool["PEPTIDEK"]) == sorted("PEPTIDEK")


def test_pages_of_any_size(spark):
    assert R.page(spark.range(5000), ["id"], 10, 3000).count() == 3000
