"""Greedy rules against their one-by-one form, on long stretches of ties and long chains."""
import random

from pyspark.sql import functions as F

from ionweave.operators import shifts as M
from ionweave.operators import shortlist as N


def claim(bins, width):
    seed = {}
    starters = []
    for b, _ in sorted(bins, key=lambda x: (-x[1], x[0])):
        if all(abs(b - s) > width for s in starters):
            starters.append(b)
            for c, _ in bins:
                if abs(b - c) <= width:
                    seed.setdefault(c, b)
    return seed


def test_a_thousand_equal_bins(spark):
    bins = [(k, 1) for k in range(1000)]
    df = spark.createDataFrame([("r", *b) for b in bins], "run_id string, bin long, n long")
    assert {r.bin: r.center for r in M.group_bins(df, 3).collect()} == claim(bins, 3)


def test_bins_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_ROWS", 20)
    rng = random.Random(2)
    runs = {f"r{k}": [(b, rng.randint(1, 6)) for b in sorted(rng.sample(range(900), 200))] for k in range(3)}
    df = spark.createDataFrame([(r, *b) for r, bins in runs.items() for b in bins], "run_id string, bin long, n long")
    got = M.group_bins(df, 2).collect()
    for r, bins in runs.items():
        assert {x.bin: x.center for x in got if x.run_id == r} == claim(bins, 2)


def test_rows_that_may_not_start(spark):
    df = spark.createDataFrame([("r", 0.0, 9), ("r", 0.1, 5), ("r", 0.15, 7), ("r", 3.0, 1)], "run_id string, delta double, n long")
    got = {r.delta: r.seed for r in M.greedy_claim(df, ["run_id"], "delta", "n", 0.06, F.col("delta") > 0.05, 1e6).collect()}
    assert got == {0.0: None, 0.1: 0.15, 0.15: 0.15, 3.0: 3.0}


def cover(holds):
    left = {p: set(s) for p, s in holds.items()}
    taken = set()
    while any(left.values()):
        best = min(left, key=lambda p: (-len(left[p]), p))
        taken.add(best)
        gone = left[best]
        left = {p: s - gone for p, s in left.items()}
    return taken


def greedy(spark, holds):
    ev = spark.createDataFrame([("r", s, f"P{p}") for p, ss in holds.items() for s in ss], "run_id string, spectrum long, protein string")
    ranked = spark.createDataFrame([("r", f"P{p}", p, len(ss), False) for p, ss in holds.items()], "run_id string, protein string, rank int, spectra int, decoy boolean")
    return {r["rank"] for r in N.parsimony_greedy(ranked, ev, 1).collect()}


def test_a_chain_of_a_thousand_proteins(spark):
    holds = {p: [p, p + 1] for p in range(1, 1001)}
    assert greedy(spark, holds) == cover(holds)


def test_random_covers(spark):
    rng = random.Random(8)
    holds = {p: rng.sample(range(120), rng.randint(1, 9)) for p in range(1, 90)}
    assert greedy(spark, holds) == cover(holds)


def test_a_group_holds_few_rows(spark, monkeypatch):
    """One component larger than a group may be: it is covered by rounds, and no group gets more than its rows."""
    rng = random.Random(12)
    holds = {p: rng.sample(range(60), rng.randint(2, 8)) for p in range(1, 60)}
    monkeypatch.setattr(N, "GROUP_ROWS", 30)
    whole = N._cover

    def small(pdf):
        assert len(pdf) <= 30
        return whole(pdf)

    monkeypatch.setattr(N, "_cover", small)
    assert greedy(spark, holds) == cover(holds)
