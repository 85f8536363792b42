"""Paths made in a spectrum's row against the operators that make them step by step, and the plan."""
import random

import pytest
from pyspark.sql import functions as F

from ionweave.operators import tagging as T
from ionweave.plans import tag_run
from ionweave.session import materialize

PARAMS = T.TagParams(frag_tol=0.3, tol_ppm=False, complement_tol=0.3, max_gaps=1)
LONGER = T.TagParams(frag_tol=0.3, tol_ppm=False, complement_tol=0.3, max_gaps=1, max_extension=1)


@pytest.fixture(scope="module")
def prepared(spark):
    rnd = random.Random(5)
    spectra = spark.createDataFrame([(0, i, 500.0 + i, 2 + i % 2) for i in range(4)], "run_id long, idx long, precursor_mz double, charge int")
    peaks = spark.createDataFrame([(0, i, 100 + rnd.random() * 900, rnd.random()) for i in range(4) for _ in range(30)], "run_id long, idx long, mz double, intensity double")
    return materialize(T.prepared_peaks(peaks, spectra, PARAMS))


def rows_of(paths):
    seen = paths.select("idx", "z", F.transform("nodes", lambda n: n.p).alias("p"), T.spell("path").alias("seq"), "n_res", "gapped", "extended")
    return sorted(tuple(map(str, r)) for r in seen.collect())


def stepwise(spark, prepared, params):
    residues = T.alphabet(spark, params)
    pairs = T.residue_pairs(residues)
    edges = materialize(T.residue_edges(prepared, residues, params))
    walks = T.walks(edges, materialize(T.gap_edges(prepared, pairs, edges, params)), params.tag_length)
    return pairs, edges, materialize(walks)


def test_paths_are_those_of_the_steps(spark, prepared):
    pairs, edges, walks = stepwise(spark, prepared, PARAMS)
    want = T.gap_spellings(T.extend(walks, edges, 0), pairs, PARAMS)
    got = T.spectrum_paths(prepared, T.alphabet(spark, PARAMS), pairs, PARAMS)
    assert rows_of(got) == rows_of(want) and got.count() > 100
    counts = got.groupBy("idx").agg(F.count(F.lit(1)).alias("n"), F.max("n_paths").alias("m")).collect()
    assert all(r.n == r.m for r in counts)


def test_a_gap_has_its_spellings_in_each_of_two_paths_that_extend_to_the_same(spark, prepared):
    pairs, edges, walks = stepwise(spark, prepared, LONGER)
    spelled = T.gap_spellings(T.extend(walks, edges, 0), pairs, LONGER)
    tags = tag_run.tag_prepared(prepared, T.TagParams(**{**LONGER.__dict__, "max_evalue": 0.0, "max_tags": 0}))
    # every path counts with all its spellings, extended or not
    want = {r.idx: r["count"] for r in spelled.groupBy("idx").count().collect()}
    assert {r.idx: r.n for r in tags.groupBy("idx").agg(F.max("n_candidates").alias("n")).collect()} == want


def test_no_tag_is_shuffled(spark, prepared):
    tags = tag_run.tag_prepared(prepared, LONGER)
    plan = tags._jdf.queryExecution().executedPlan().toString().split("\n")
    dealt = [line for line in plan if "Exchange hashpartitioning(run_id" in line]
    assert dealt and all("REPARTITION_BY_NUM" in line for line in dealt)
