"""The models share one look-up of ions, among the peaks of spectra that are asked for."""
import pytest

from ionweave.operators import placement as L


def data(spark):
    rows = [(k, 1, k % 3, "PEPTLDE", 1, 4, 15.9949) for k in range(6)]
    peaks = [(1, idx, mz) for idx in range(50) for mz in (98.06, 114.05, 227.1, 243.1, 340.16)]
    return (spark.createDataFrame(rows, "id int, run_id int, idx int, peptide string, region_lo int, region_hi int, delta_mass double"),
            spark.createDataFrame(peaks, "run_id int, idx int, mz double"))


def test_models_are_those_of_single_calls(spark):
    asked, peaks = data(spark)
    got = sorted(tuple(r) for r in L.localize_models(asked, peaks, 0.1, charges=2).collect())
    want = [(*r, m) for m in ("count", "unique", "strict") for r in L.localize(asked, peaks, 0.1, charges=2, model=m).collect()]
    assert got == sorted(tuple(r) for r in want) and len(got) == 18
    with pytest.raises(ValueError):
        L.localize(asked, peaks, 0.1, model="other")


def test_ions_are_looked_up_once_among_the_spectra_that_are_asked_for(spark, monkeypatch):
    asked, peaks = data(spark)
    met, join = [], L.range_join
    monkeypatch.setattr(L, "range_join", lambda left, right, *a, **k: met.append(right.select("idx").distinct().count()) or join(left, right, *a, **k))
    assert L.localize_models(asked, peaks, 0.1, charges=2).count() == 18
    assert met == [3]
