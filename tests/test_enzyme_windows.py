"""Windows by an enzyme's boundaries against the joins by site number, and the plan."""
import random

import pytest
from pyspark.sql import functions as F

from ionweave.operators import placement as L


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(3)
    seqs = {f"p{k}": "".join(rnd.choice("AKPRMDG") for _ in range(n)) for k, n in enumerate([0, 1, 5, 9, 40, 130, 131])}
    occ = [("x", p, a, n, False) for p, s in seqs.items() for n in (1, 4, 11) for a in range(0, len(s) - n + 1)]
    return (spark.createDataFrame(list(seqs.items()), "accession string, sequence string"),
            spark.createDataFrame(occ, "seq string, accession string, pos int, len int, reversed boolean"))


@pytest.mark.parametrize("enzyme", ["Trypsin", "Asp-N", "unspecific"])
@pytest.mark.parametrize("missed", [0, 1, 3])
def test_windows_are_those_of_the_sites(spark, monkeypatch, data, enzyme, missed):
    monkeypatch.setattr(L, "TILE", 16)
    proteins, occ = data
    rows = lambda w: sorted(tuple(r) for r in w.select("accession", "pos", "len", "start", "end").collect())
    got = rows(L.enzyme_windows(occ, proteins, enzyme, missed))
    assert got == rows(L.digest_windows(occ, L.cleavage_sites(proteins, enzyme), missed)) and got


def test_windows_are_shuffled_by_protein_only(spark, data, tmp_path):
    """Before, occurrences were dealt out anew by each of the four tables of sites they met."""
    proteins, _ = data
    proteins.write.parquet(f"{tmp_path}/p")
    proteins = spark.read.parquet(f"{tmp_path}/p")
    occ = L.locate(spark.createDataFrame([("AKPR",), ("AAAAA",)], "seq string"), proteins)
    w = L.cleavage_filter(L.enzyme_windows(occ, proteins, "Trypsin", 1), proteins, "Lys-C", "semi")
    n = w.groupBy("accession").agg(F.count(F.lit(1)))
    plan = n._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    exchanges = [line.split("hashpartitioning(")[1] for line in plan if "Exchange hashpartitioning" in line]
    # those of the k-mers belong to the look-up
    assert sum(e.startswith("accession#") for e in exchanges) == 3
    assert all(e.startswith(("accession#", "kmer#", "_groupingexpression#")) for e in exchanges)
