"""Tag scores: rank-sum, m/z fidelity, complements, Fisher, E-value, confidences, flanks."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ionweave.functions import constants as K, stats
from ionweave.operators.core import even_hash
from ionweave.operators.tagging import KEY, TagParams, spell

FIDELITY_CELLS = 1024


def ranksum_null(spark, ks: list[int], n_max: int) -> DataFrame:
    """(k, n, s, cdf): P(sum of k distinct ranks of 1..n <= s), every n up to ``n_max``.

    Size depends on the parameters only (k <= 20, n_max <= 1024); counted on executors, one k per row.
    """
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in pdf["k"]:
                k = int(k)
                ways = np.zeros((k + 1, k * n_max + 1))
                ways[0, 0] = 1.0
                for v in range(1, n_max + 1):
                    for j in range(min(k, v), 0, -1):
                        ways[j, v:] += ways[j - 1, :-v]
                    if v >= k:
                        top = k * v - k * (k - 1) // 2
                        c = np.cumsum(ways[k, : top + 1])
                        yield pd.DataFrame({"k": k, "n": v, "s": np.arange(top + 1), "cdf": c / c[-1]})
    seeds = spark.createDataFrame([(k,) for k in sorted(set(ks))], "k int")
    return seeds.mapInPandas(count, "k int, n int, s int, cdf double")


def p_intensity(tags: DataFrame, null: DataFrame) -> DataFrame:
    """Adds ``p_intensity`` from k (tag peaks), n_kept and rank_sum; 1 outside the table."""
    t = null.select("k", F.col("n").alias("n_kept"), F.col("s").alias("rank_sum"), F.col("cdf").alias("_p"))
    return tags.join(F.broadcast(t), ["k", "n_kept", "rank_sum"], "left").withColumn(
        "p_intensity", F.coalesce("_p", F.lit(1.0))).drop("_p")


def fidelity_null(spark, ks: list[int], draws: int = K.FIDELITY_DRAWS, seed: int = 20080717) -> DataFrame:
    """(k, cell, base, sses): seeded draws of the squared deviation of k uniform errors, by value cell."""
    d = spark.range(draws).select(F.explode(F.array(*[F.lit(int(k)) for k in sorted(set(ks))])).alias("k"), F.col("id").alias("draw"))
    err = F.transform(F.sequence(F.lit(1), F.col("k")), lambda i: even_hash("k", "draw", i, seed=seed) * 2 - 1)
    d = d.withColumn("e", err)
    mean = F.aggregate("e", F.lit(0.0), lambda a, x: a + x) / F.col("k")
    d = d.withColumn("mean", mean).withColumn("sse", F.aggregate("e", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))))
    cell = F.floor(F.col("sse") * FIDELITY_CELLS / F.col("k")).cast("int")
    got = d.groupBy("k", cell.alias("cell")).agg(F.collect_list("sse").alias("sses"))
    every = spark.range(FIDELITY_CELLS).select(F.explode(F.array(*[F.lit(int(k)) for k in sorted(set(ks))])).alias("k"), F.col("id").cast("int").alias("cell"))
    full = every.join(got, ["k", "cell"], "left").withColumn("sses", F.coalesce("sses", F.array().cast("array<double>")))
    w = W.partitionBy("k").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    return full.withColumn("base", F.coalesce(F.sum(F.size("sses")).over(w), F.lit(0)))


def p_mzfidelity(tags: DataFrame, null: DataFrame, draws: int = K.FIDELITY_DRAWS) -> DataFrame:
    """Adds ``p_mzfidelity``: share of null draws at or below ``sse`` (floor 1/draws)."""
    cell = F.floor(F.col("sse") * FIDELITY_CELLS / F.col("k")).cast("int")
    j = tags.withColumn("cell", cell).join(F.broadcast(null), ["k", "cell"], "left")
    r = F.when(F.col("base").isNull(), F.lit(draws)).otherwise(
        F.col("base") + F.size(F.filter("sses", lambda x: x <= F.col("sse"))))
    return j.withColumn("p_mzfidelity", F.greatest(F.lit(1.0 / draws), r / F.lit(float(draws)))).drop("cell", "base", "sses")


def path_fit(paths: DataFrame, params: TagParams) -> DataFrame:
    """What the p-values of a path come from: number of peaks, fit and its squared deviation, rank sum, complement count."""
    offsets = F.transform(
        F.aggregate("path", F.array(F.lit(0.0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s.m / F.col("z")))),
        lambda x: x)
    t = paths.withColumn("k", F.size("nodes")).withColumn("_off", offsets)
    t = t.withColumn("_est", F.zip_with("nodes", "_off", lambda n, o: n.mz - o))
    t = t.withColumn("fit", F.aggregate("_est", F.lit(0.0), lambda a, x: a + x) / F.col("k"))
    if params.tol_ppm:
        dev = F.zip_with("_est", "nodes", lambda e, n: (e - F.col("fit")) / (n.mz * (params.frag_tol * 1e-6)))
    else:
        dev = F.transform("_est", lambda e: (e - F.col("fit")) / F.lit(params.frag_tol))
    t = t.withColumn("sse", F.aggregate(dev, F.lit(0.0), lambda a, x: a + x * x))
    t = t.withColumn("rank_sum", F.aggregate("nodes", F.lit(0), lambda a, n: a + n.rk))
    return t.withColumn("n_compl", F.size(F.filter("nodes", lambda n: F.array_contains(n.compl, F.col("z"))))).withColumn("charge", F.col("z"))


def path_facts(paths: DataFrame, params: TagParams) -> DataFrame:
    """Sequence, fit, rank sum, complement count, confidences, flanks and intensity of each path."""
    return path_report(path_fit(paths, params), params)


def path_report(fitted: DataFrame, params: TagParams) -> DataFrame:
    """The columns of a tag, from the rows of ``path_fit``; columns that scoring added stay."""
    z = F.col("z")
    t = fitted
    added = [c for c in ("p_intensity", "p_mzfidelity", "use_compl", "p_complement", "n_candidates", "evalue") if c in t.columns]
    links = F.arrays_zip(F.slice("nodes", 1, F.col("k") - 1).alias("a"), F.slice("nodes", 2, F.col("k") - 1).alias("b"), F.col("path").alias("s"))
    def conf(e):
        tol = params.tol(e.b.mz) * z
        fit = F.greatest(F.lit(0.0), 1 - F.abs((e.b.mz - e.a.mz) * z - e.s.m) / tol)
        return fit * F.greatest(F.lit(0.0), 1 - F.greatest(e.a.rk, e.b.rk) / F.col("n_kept"))
    t = t.withColumn("_conf", F.transform(links, conf))
    t = t.withColumn("min_conf", F.array_min("_conf")).withColumn(
        "mean_conf", F.aggregate("_conf", F.lit(0.0), lambda a, x: a + x) / F.size("_conf"))
    pct = F.zip_with("_conf", "path", lambda c, s: F.array_repeat(
        F.round(100 * c).cast("tinyint"), F.when(s.a2 != "", 2).otherwise(1)))
    t = t.withColumn("res_conf", F.reverse(F.flatten(pct)))
    span = F.element_at("_off", -1)
    pair = K.ION_PAIRS[params.series]
    low = F.col("fit") * z - z * F.lit(K.PROTON)
    high = (F.col("fit") + span) * z - z * F.lit(K.PROTON)
    t = t.withColumn("cterm_mass", F.greatest(F.lit(0.0), low - F.lit(pair["off_c"])))
    t = t.withColumn("nterm_mass", F.greatest(F.lit(0.0), F.col("mass") - high - F.lit(K.WATER - pair["off_c"])))
    return t.select(
        *KEY, spell("path").alias("seq"), F.aggregate("path", F.lit(0), lambda a, s: a + F.when(s.a2 != "", 2).otherwise(1)).alias("n_res"),
        z.alias("charge"), "k", "n_kept", "rank_sum", "sse", "n_compl", "nterm_mass", "cterm_mass", "extended", "gapped",
        "min_conf", "mean_conf", "res_conf", F.element_at("nodes", 1).getField("mz").alias("low_mz"),
        F.element_at("nodes", -1).getField("mz").alias("high_mz"),
        F.aggregate("nodes", F.lit(0.0), lambda a, n: a + n.intensity).alias("peak_tic"),
        F.transform("nodes", lambda n: n.p).alias("peaks"), F.lit(params.series).alias("ion_series"), *added)


def p_complement(tags: DataFrame, population: DataFrame | None = None, midp: bool = False) -> DataFrame:
    """Adds ``p_complement`` and ``use_compl`` from the spectrum's complement population at the tag's charge; without a table of it the
    tags carry it as ``n_partnered``."""
    if population is None:
        t = tags.withColumnRenamed("n_partnered", "_K")
    else:
        pop = population.select(*KEY, F.col("z").alias("charge"), F.col("n_compl").alias("_K"))
        t = tags.join(pop, [*KEY, "charge"], "left").withColumn("_K", F.coalesce("_K", F.lit(0)))
    use = F.col("_K") > 0
    p = stats.complement_pvalue("n_kept", "_K", "k", "n_compl", midp)
    score = (F.col("n_compl") > 0) | F.lit(midp)
    return t.withColumn("use_compl", use).withColumn("p_complement", F.when(use & score, p).otherwise(1.0)).drop("_K")


def evalue(tags: DataFrame, gap_penalty: float = 100.0, hypotheses: int | Column = 1) -> DataFrame:
    """Combined p-value times the spectrum's candidates, hypotheses (a number or a column) and (gapped tags) the gap penalty. Candidates
    are counted unless the tags carry ``n_paths``."""
    n = F.col("n_paths") if "n_paths" in tags.columns else F.count(F.lit(1)).over(W.partitionBy(*KEY))
    p = stats.fisher("p_intensity", "p_mzfidelity", "p_complement", F.col("use_compl"))
    pen = F.when(F.col("gapped"), F.lit(float(max(1.0, gap_penalty)))).otherwise(1.0)
    return tags.withColumn("n_candidates", n).withColumn("evalue", p * n * F.lit(hypotheses).cast("double") * pen).drop("n_paths")
