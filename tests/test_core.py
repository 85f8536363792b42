"""Building blocks against plain Python, with the hot-group path forced by tiny tile sizes."""
import random

import pytest
from pyspark.sql import functions as F

from ionweave.operators import core, shifts, shortlist
from ionweave.operators.core import Scan


@pytest.mark.parametrize("tile_rows", [1000, 5])
def test_ordered_scan_tiles_match_plain_order(spark, tile_rows):
    rnd = random.Random(3)
    rows = [(g, float(v), rnd.randint(1, 9)) for g in (1, 2) for v in rnd.sample(range(1000), 120 if g == 1 else 4)]
    df = spark.createDataFrame(rows, "g int, v double, n int")
    got = core.ordered_scan(df, ["g"], "v", [Scan("up", "sum", "n"), Scan("before", "sum", "n", exclusive=True), Scan("low", "min", "n", reverse=True), Scan("reach", "max", "n", exclusive=True)],
                            tile_rows=tile_rows, tiles=7).collect()
    for r in got:
        mine = sorted((v, n) for g, v, n in rows if g == r.g)
        below = [n for v, n in mine if v < r.v]
        assert r.up == sum(below) + r.n and r.before == sum(below)
        assert r.low == min(n for v, n in mine if v >= r.v)
        assert r.reach == (max(below) if below else None)
    assert len(got) == len(rows)


def test_bh_qvalues(spark):
    p = [0.01, 0.04, 0.03, 0.5, 0.01]
    got = core.bh_qvalues(spark.createDataFrame([(1, i, x) for i, x in enumerate(p)], "g int, i int, p double"), ["g"], "p").collect()
    m, order = len(p), sorted(p)
    for r in got:
        assert r.qvalue == pytest.approx(min(x * m / sum(y <= x for y in p) for x in order if x >= r.p))


def test_interval_union_and_lookback(spark):
    iv = spark.createDataFrame([(1, 0.0, 2.0), (1, 1.0, 3.0), (1, 5.0, 6.0), (1, 5.2, 5.5)], "g int, a double, b double")
    assert core.interval_union(iv, ["g"], "a", "b").first().covered == pytest.approx(4.0)
    s = spark.createDataFrame([(1, i, 1 if i in (0, 7, 30) else 2) for i in range(40)], "run_id int, idx int, ms_level int")
    got = {r.idx: r.m for r in core.lookback(s, ["run_id"], "idx", F.col("ms_level") == 1, "m", tile_width=5).collect()}
    assert all(got[i] == (0 if i < 7 else 7 if i < 30 else 30) for i in range(40))


def test_connected_components_of_a_long_chain(spark):
    n = 70
    e = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(n) if i != 40], "a string, b string")
    nodes = spark.createDataFrame([(f"{i:03d}",) for i in range(n + 1)], "node string")
    got = {r.node: r.component for r in core.connected_components(e, nodes).collect()}
    assert all(got[f"{i:03d}"] == ("000" if i <= 40 else "041") for i in range(n + 1))


def test_greedy_claim_equals_sequential_visit(spark):
    rnd = random.Random(5)
    pos = sorted(rnd.sample(range(300), 120))
    rows = [(1, p, rnd.randint(1, 6)) for p in pos]
    got = {r.bin: r.center for r in shifts.group_bins(spark.createDataFrame(rows, "run_id int, bin long, n long"), 4).collect()}
    taken = {}
    for _, p, n in sorted(rows, key=lambda r: (-r[2], r[1])):
        if p not in taken:
            for q in pos:
                if abs(q - p) <= 4 and q not in taken:
                    taken[q] = p
    assert got == taken


def test_parallel_set_cover_equals_greedy(spark):
    rnd = random.Random(8)
    sets = {p: set(rnd.sample(range(60), rnd.randint(1, 9))) for p in range(1, 41)}
    order = sorted(sets, key=lambda p: (-len(sets[p]), p))
    rank = {p: i + 1 for i, p in enumerate(order)}
    ranked = spark.createDataFrame([(0, p, rank[p], len(s), False) for p, s in sets.items()], "run_id int, protein int, rank int, spectra int, decoy boolean")
    ev = spark.createDataFrame([(0, x, p) for p, s in sets.items() for x in s], "run_id int, spectrum int, protein int")
    got = {r.protein for r in shortlist.parsimony_greedy(ranked, ev, 1).collect()}
    open_, want = set().union(*sets.values()), set()
    while open_:
        best = min(sets, key=lambda p: (-len(sets[p] & open_), rank[p]))
        want.add(best)
        open_ -= sets[best]
    assert got == want


@pytest.mark.parametrize("tile_rows", [1000, 5])
def test_tiles_keep_the_rows_of_no_group(spark, tile_rows):
    rows = [(g, v, v % 3 + 1) for g in (None, 1) for v in range(60)]
    df = spark.createDataFrame(rows, "g int, v int, n int")
    got = core.ordered_scan(df, ["g"], "v", [Scan("up", "sum", "n"), Scan("above", "sum", "n", reverse=True, exclusive=True)], tile_rows=tile_rows, tiles=7).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.up == sum(v % 3 + 1 for v in range(r.v + 1)) and r.above == sum(v % 3 + 1 for v in range(r.v + 1, 60))


def test_rows_without_a_value_are_not_in_one_task(spark):
    df = spark.range(3000).selectExpr("id", "1 AS g", "CASE WHEN id % 3 = 0 THEN id END AS v")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for out in (core.mid_rank(df, ["g"], "v", "r"), core.bh_qvalues(df.withColumn("v", F.col("v") / 3000), ["g"], "v", "r")):
            out = out.withColumn("part", F.spark_partition_id())
            none = out.filter("v IS NULL").groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()
            assert sum(x.n for x in none) == 2000 and out.filter("r IS NULL").count() == 2000
            assert len(none) >= 4 and max(x.n for x in none) < 1000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
