"""Placements read tiles of a sequence, boundaries by position, and equal gaps once."""
import random
import time

import pytest
from pyspark.sql import functions as F

from ionweave.operators import placement as L

CASES = ["", "A", "AKPRKDK", "M", "MKK"]


def proteins(spark, rows):
    return spark.createDataFrame(rows, "accession string, sequence string")


@pytest.mark.parametrize("step", [2, 16])
def test_residues_between_equals_slices(spark, monkeypatch, step):
    monkeypatch.setattr(L, "TILE", 4)
    monkeypatch.setattr(L, "TILE_STEP", step)
    rng = random.Random(7)
    seqs = {f"p{k}": "".join(rng.choice("ACDK#") for _ in range(n)) for k, n in enumerate([0, 1, 3, 4, 5, 8, 9, 63, 64, 65, 200])}
    rows = [(p, a, b) for p, s in seqs.items() for a in range(0, len(s) + 1, 1 + len(s) // 20) for b in {a, a + 1, a + 4, a + 5, a + 30, len(s), len(s) + 9} if b >= a]
    df = spark.createDataFrame([*rows, ("gone", 0, 1)], "accession string, a int, b int")
    got = L.residues_between(df, proteins(spark, list(seqs.items())), F.col("a"), F.col("b"), "cut").collect()
    assert sorted((r.accession, r.a, r.b, r.cut) for r in got) == sorted((p, a, b, seqs[p][a:b]) for p, a, b in rows)


@pytest.mark.parametrize("enzyme", ["Trypsin", "Asp-N", "Lys-C"])
@pytest.mark.parametrize("specificity", ["full", "semi"])
def test_cleavage_filter_equals_plain_python(spark, enzyme, specificity):
    rng = random.Random(9)
    seqs = {f"p{k}": s for k, s in enumerate([*CASES, *["".join(rng.choice("MKRPDA") for _ in range(12)) for _ in range(6)]])}
    after, residues, not_before = L.ENZYMES[enzyme]

    def cut(s, b):
        if b in (0, len(s)):
            return True
        return s[b - 1] in residues and s[b] not in (not_before or "-") if after else s[b] in residues

    rows = [(p, a, b) for p, s in seqs.items() for a in range(len(s)) for b in range(a + 1, len(s) + 1)]
    want = []
    for p, a, b in rows:
        n, c = cut(seqs[p], a) or (a == 1 and seqs[p][0] == "M"), cut(seqs[p], b)
        if (n and c) if specificity == "full" else (n or c):
            want.append((p, a, b))
    got = L.cleavage_filter(spark.createDataFrame(rows, "accession string, start int, end int"), proteins(spark, list(seqs.items())), enzyme, specificity)
    assert got.columns == ["accession", "start", "end"] and sorted(map(tuple, got.collect())) == sorted(want)


def test_windows_of_a_long_protein_do_not_scan_it(spark):
    """Before, every window scanned and copied its whole protein: these 60,000 of one of 3 million residues would copy 180 GB."""
    n = 3_000_000
    p = spark.range(1).select(F.lit("P").alias("accession"), F.expr(f"repeat('AAAAK', {n // 5})").alias("sequence"))
    w = spark.range(60_000).select(F.lit("AAAA").alias("seq"), F.lit("P").alias("accession"), (F.col("id") * 50).cast("int").alias("pos"), F.lit(4).alias("len"),
                                   F.lit(False).alias("reversed"), (F.col("id") * 50).cast("int").alias("start"), (F.col("id") * 50 + 5).cast("int").alias("end"))
    tags = spark.createDataFrame([("AAAA", 0.0, 128.09496305)], "seq string, nterm_mass double, cterm_mass double")
    t = time.time()
    assert L.reconcile(tags, w, p).filter("nterm_match AND cterm_match AND peptide = 'AAAAK'").count() == 60_000
    assert time.time() - t < 60


def test_equal_gaps_are_localised_once(spark):
    rows = [(k, 1, None if k % 5 == 4 else k % 2, "PEPTLDE", 1, 4, 15.9949) for k in range(40)]
    df = spark.createDataFrame(rows, "id int, run_id int, idx int, peptide string, region_lo int, region_hi int, delta_mass double")
    peaks = spark.createDataFrame([(1, 0, 98.06), (1, 0, 227.1), (1, 1, 243.1)], "run_id int, idx int, mz double")
    got = {r.id: tuple(r)[1:] for r in L.localize(df, peaks, 0.05).collect()}
    assert sorted(got) == list(range(40)) and len({got[k] for k in range(40) if rows[k][2] == 0}) == 1
    assert got[4][1] == 0 and got[0] != got[1]
