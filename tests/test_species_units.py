"""Spill from units (members) equals spill from the matrix of pairs, and a unit costs its members."""
import random

from pyspark.sql import functions as F

from ionweave.operators import species as X


def genera(spark, rng, taxa, runs=2):
    rows = [(r, t, n, n / 500, 0.5, None if t % 3 else 0.9 * n, 500) for r in range(runs) for t in range(taxa) for n in [rng.randint(0, 90)]]
    return spark.createDataFrame(rows, "run_id int, taxid int, observed int, share double, random_expected double, n_hat double, n_units int")


def test_units_equal_pairs(spark):
    rng = random.Random(5)
    units = {u: rng.sample(range(12), rng.randint(1, 5)) for u in range(60)}
    size = {t: sum(t in m for m in units.values()) for t in range(12)}
    pairs = {}
    for m in units.values():
        for g in m:
            for h in m:
                if g != h:
                    pairs[g, h] = pairs.get((g, h), 0) + 1 / size[h] / 4
    g = genera(spark, rng, 12)
    C = spark.createDataFrame([(a, b, c) for (a, b), c in pairs.items()], "g int, h int, c double")
    U = spark.createDataFrame([(u, h, 1 / size[h] / 4) for u, m in units.items() for h in m], "unit int, h int, c double")
    rows = [{(r.run_id, r.taxid): (round(r.spill, 9), round(r.qvalue, 9), r.call, r.reason, r.lod) for r in X.call_species(g, c, 0.05, 0.001, 10).collect()} for c in (C, U)]
    assert rows[0] == rows[1] and any(v[0] > 0 for v in rows[1].values())


def test_a_unit_of_many_members(spark):
    """Its 40,000 members would be 1.6 billion pairs."""
    rng = random.Random(6)
    g = genera(spark, rng, 20, 1)
    U = spark.range(40_000).selectExpr("1 AS unit", "CAST(id AS INT) AS h", "0.001D AS c")
    out = {r.taxid: r for r in X.call_species(g, U, 0.05, 0.001, 10).collect()}
    seen = {r.taxid: r for r in g.collect()}
    for t, r in out.items():
        above = [s for s in seen.values() if out[s.taxid].call == "present" and (s.observed, -s.taxid) > (r.observed, -t)]
        assert abs(r.spill - sum(0.001 * (s.n_hat if s.n_hat is not None else s.observed) for s in above)) < 1e-9


def test_kmers_of_a_stretch_come_once(spark, monkeypatch):
    monkeypatch.setattr(X, "KMER_LETTERS", 16)
    rows = [("a", "PEPTLDEKPEPTLDEK" * 4), ("a", "PEP#TLDEKAC\nDEFGHKK"), ("b", "ACDEFGHKé"), ("b", None), (None, "PEPTLDEK"), ("c", "PEP")]
    want = {(s[i:i + 7], t) for t, s in rows if s for i in range(len(s) - 6) if not set("#\n") & set(s[i:i + 7])}
    p = spark.createDataFrame(rows, "taxon string, sequence string")
    got = X.build_kmer_taxa(p)
    assert {(r.kmer, r.taxon) for r in got.collect()} == want and got.count() == len(want)
    raw = [(r, t) for b in X._distinct_kmers(iter(p.select(F.coalesce("sequence", F.lit("")).alias("sequence"), "taxon").toArrow().to_batches(max_chunksize=6)), 7) for r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert set(raw) == want and len(raw) < 80
