"""Steps whose cost must not outgrow the input: plans, rounds and rows."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from ionweave import session
from ionweave.operators import core, evaluation as E, precursor as H, shortlist, tagging as T


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rounds_follow_the_logarithm(spark, monkeypatch):
    n, written = 1500, []
    monkeypatch.setattr(core, "rewritten", lambda df: written.append(1) or session.rewritten(df))
    order = np.random.default_rng(1).permutation(n).tolist()
    path = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)], "a long, b long")
    c = core.connected_components(path, spark.range(n).select(F.col("id").alias("node")))
    assert c.select("component").distinct().collect() == [(0,)] and c.count() == n
    assert len(written) <= 40
    # the estimate is that of files; products over the rounds had hundreds of digits
    assert len(str(c._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 12


def small_file(spark, tmp_path):
    spark.range(200).selectExpr("id % 2 AS run_id", "id AS idx", "500.0D + id AS precursor_mz", "IF(id % 4 = 0, 1, 2) AS ms_level", "2 AS charge", "1.0D AS iso_lower", "1.0D AS iso_upper").write.parquet(f"{tmp_path}/s")
    spark.range(200).selectExpr("id % 2 AS run_id", "id AS idx", "500.0D + id AS mz", "1.0D AS intensity").write.parquet(f"{tmp_path}/p")
    return spark.read.parquet(f"{tmp_path}/s"), spark.read.parquet(f"{tmp_path}/p")


def test_exploded_rows_are_not_broadcast(spark, tmp_path):
    s, p = small_file(spark, tmp_path)
    joined = core.range_join(s, p, ["run_id", "idx"], F.col("precursor_mz") - 9, F.col("precursor_mz") + 9, "mz", 1.0)
    assert "Broadcast" not in plan(joined) and joined.count() == 200
    assert "SortMergeJoin [run_id" in plan(H.ms1_charge(s, p)) and "Generate" in plan(H.ms1_charge(s, p))


def test_tags_are_not_read_by_one_task(spark, tmp_path):
    spark.createDataFrame([(i, "PEPTLDEK") for i in range(50)], "key long, peptide string").write.parquet(f"{tmp_path}/pep")
    p = spark.read.parquet(f"{tmp_path}/pep")
    t = E.tags_from_predictions(p, 4).withColumn("rank", F.lit(1))
    for df in (E.mark_correct(t, p), E.score_candidate_sets(t, p, p.select("key")), E.attribute_tags(t, p.select("key", F.col("peptide").alias("pep1"), F.lit("GGG").alias("pep2")))[1]):
        assert "Broadcast" not in plan(df)
    assert E.mark_correct(t, p).filter("correct").count() == t.count() == 250


@pytest.mark.parametrize("tile_rows", [10**6, 20])
def test_scans_from_the_high_end(spark, tile_rows):
    df = spark.range(300).selectExpr("id % 2 AS g", "id AS x", "id * 7 % 11 AS v")
    scans = [core.Scan("s", "sum", "v", reverse=True), core.Scan("m", "min", "v", reverse=True, exclusive=True)]
    out = core.ordered_scan(df, ["g"], "x", scans, tile_rows=tile_rows, tiles=8)
    # Spark sums a frame that ends at the group's end anew for every row
    assert not [line for line in plan(out).split("\n") if "unboundedfollowing" in line and "_t0" not in line]   # _t0: the totals of the tiles
    rows = {(r.g, r.x): r.v for r in df.collect()}
    for r in out.collect():
        above = [v for (g, x), v in rows.items() if g == r.g and x > r.x]
        assert (r.s, r.m) == (r.v + sum(above), min(above, default=None))


def test_partners_of_pools(spark):
    rows = [(f"p{i:03d}", "abc"[i % 3], i * 37 % 50) for i in range(120)]
    pools = spark.createDataFrame(rows, "pool string, batch string, size long")
    out = E.pool_swap(pools)
    assert "unboundedfollowing" not in plan(out)
    size, batch = {p: s for p, _, s in rows}, {p: b for p, b, _ in rows}
    got = {r.pool: r.partner for r in out.collect()}
    assert len(got) == len(rows)
    for p, q in got.items():
        assert batch[p] != batch[q] and abs(size[p] - size[q]) == min(abs(size[p] - size[o]) for o in size if batch[o] != batch[p])


def test_excess_needs_no_row_per_sum(spark):
    rng = np.random.default_rng(3)
    peaks = [(0, i, float(m), 1.0) for i in range(6) for m in np.round(rng.uniform(100, 900, 60), 2)]
    masses = [(0, i, z, 1000.0 + i) for i in range(6) for z in (1, 2, 3)] + [(0, 9, 2, 900.0), (0, 1, 4, None)]
    top = spark.createDataFrame(peaks, "run_id int, idx int, mz double, intensity double")
    df = H.complement_excess(top, spark.createDataFrame(masses, "run_id int, idx int, z int, M double"), 0.4, charge_aware=True)
    assert "Generate" not in plan(df)

    def expected(mz, total, w):
        n = []
        for shift in (0.0, *H.OFF_TARGET):
            want = {a: total + shift - w * a for a in mz}
            n.append(sum(any(abs(b - x) <= 0.4 and (b > a if w == 1 else b != a) for b in mz) and (x > a if w == 1 else x > 0) for a, x in want.items()))
        return n[0] - sum(n[1:]) / 6

    P = H.K.PROTON
    for r in df.collect():
        mz = sorted({m for _, i, m, _ in peaks if i == r.idx})
        want = 0.0 if r.M is None else expected(mz, r.M + 2 * P, 1) + (expected(mz, r.M + r.z * P, r.z - 1) if r.z >= 3 else 0)
        assert r.excess == pytest.approx(want)


def test_edges_deal_out_peaks_once(spark):
    rng = np.random.default_rng(5)
    peaks = spark.createDataFrame([(0, i, float(m), float(rng.integers(1, 99))) for i in range(4) for m in np.round(rng.uniform(100, 900, 40), 2)], "run_id int, idx int, mz double, intensity double")
    spectra = spark.createDataFrame([(0, i, 600.0 + i, 2 + i % 2) for i in range(4)], "run_id int, idx int, precursor_mz double, charge int")
    params = T.TagParams(frag_tol=0.3, tol_ppm=False, complement_tol=0.3)
    prepared = session.materialize(T.prepared_peaks(peaks, spectra, params))
    edges = T.residue_edges(prepared, T.alphabet(spark, params), params)
    assert plan(edges).split("== Initial Plan ==")[0].count("Exchange hashpartitioning") <= 1 and edges.count() > 0


def test_work_per_tag_is_not_merged_into_one_task(spark):
    rows = [(i, "PEPTLDEKPEPT", "TPEPTPEP") for i in range(40)]
    p = spark.createDataFrame(rows, "key long, pep1 string, pep2 string").coalesce(1)
    t = E.tags_from_predictions(p.select("key", F.col("pep1").alias("peptide")), 4).withColumn("rank", F.lit(1))
    m = E.attribute_tags(t, p)[0]
    assert m.rdd.getNumPartitions() == 8
    # PEPT stands twice in the first peptide and once in the second, at other masses
    got = {(r.pos, r.tag): r.attribution for r in m.filter("key = 7").collect()}
    assert got[(0, "PEPT")] == got[(8, "PEPT")] == got[(1, "EPTL")] == "pep1"


def test_subsets_are_compared_by_mask_first(spark, monkeypatch):
    rng = np.random.default_rng(5)
    sets = {}
    for k in range(120):
        sets[k] = set(rng.choice(200, 25, replace=False).tolist()) | {777}
        if k % 4 == 1:
            sets[k] = set(list(sets[k - 1])[: 3 + k % 9])
        if k % 10 == 7:
            sets[k] = set(sets[k - 2])
    order = sorted(sets, key=lambda k: (-len(sets[k]), k))
    rank = {k: i + 1 for i, k in enumerate(order)}
    ranked = spark.createDataFrame([(0, k, f"P{k}", len(sets[k]), False, rank[k]) for k in sets], "run_id int, protein long, accession string, spectra long, decoy boolean, rank int")
    ev = spark.createDataFrame([(0, s, k) for k in sets for s in sets[k]], "run_id int, spectrum long, protein long")
    pairs = []
    monkeypatch.setattr(shortlist, "rewritten", lambda df: pairs.append(df.count()) or session.rewritten(df) if df.columns == ["run_id", "rank", "n", "sup"] else session.rewritten(df))
    got = {r.protein: r.subset_of for r in shortlist.parsimony_subset(ranked, ev, 1).collect()}
    better = {k: [q for q in sets if rank[q] < rank[k] and sets[k] <= sets[q]] for k in sets}
    for k in sets:
        kept = [rank[q] for q in better[k] if not better[q]]
        assert got[k] == (f"P{order[min(kept) - 1]}" if kept else None)
    strict = sum(sets[k] < sets[q] for k in sets for q in sets)
    assert len(pairs) == 1 and pairs[0] <= 2 * strict
