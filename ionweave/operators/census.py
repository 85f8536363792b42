"""Per-spectrum census, its run summary, identification join and identifiability score."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ionweave.functions import scalar as S
from ionweave.operators.core import Scan, ordered_scan, value_ranks
from ionweave.session import materialize

KEY = ["run_id", "idx"]

# The frozen identifiability model (features in order, intercept, coefficients).
MODEL_FEATURES = ["pre_best_evalue", "pre_best_len", "pre_best_mean_conf", "pre_tag_cover", "n_found", "n_peaks",
                  "n_compl", "n_edges", "n_peaks_kept", "int_gini", "charge_used", "precursor_mz"]
MODEL_INTERCEPT = -1.648331
MODEL_COEF = [0.995422, -0.613517, 0.333596, 1.54932, 0.588419, -0.290168, 0.440959, 1.457329, -0.71173, -0.206347,
              -0.452941, -1.046685]
ZERO_EVALUE = 400.0
LOWEST = -1e300

STATUSES = ["empty", "no_precursor", "no_signal", "bad_precursor", "too_few_peaks", "no_tags", "filtered", "placed", "tagged"]


def gini(peaks: DataFrame) -> DataFrame:
    """(run_id, idx, n_peaks, int_gini) over finite, non-negative intensities; NULL without a positive one.

    One shuffle: the intensities of a spectrum are sorted and folded in its row.
    """
    ok = peaks.filter((F.col("intensity") >= 0) & (F.col("intensity") < float("inf")) & ~F.isnan("mz"))
    g = ok.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.col("intensity").cast("double"))).alias("_a"))
    start = F.struct(F.lit(1.0).alias("i"), F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))
    fold = F.aggregate("_a", start, lambda t, x: F.struct((t.i + 1).alias("i"), (t.s + x).alias("s"), (t.w + t.i * x).alias("w")))
    n = F.size("_a")
    g = g.withColumn("_f", fold)
    return g.select(*KEY, F.size(F.filter("_a", lambda x: x > 0)).cast("long").alias("n_peaks"),
                    F.when(F.col("_f.s") > 0, 2 * F.col("_f.w") / (n * F.col("_f.s")) - (n + 1) / n).alias("int_gini"))


def tag_cover(tags: DataFrame) -> DataFrame:
    """Length of the union of the tags' m/z ranges per spectrum, whose tags fit in its row."""
    g = tags.filter("low_mz IS NOT NULL").groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct(F.col("low_mz").cast("double").alias("lo"), F.col("high_mz").cast("double").alias("hi")))).alias("_a"))
    start = F.struct(F.lit(float("-inf")).alias("end"), F.lit(0.0).alias("sum"))
    step = lambda t, x: F.struct(F.greatest(t.end, x.hi).alias("end"), (t.sum + F.greatest(x.hi - F.greatest(t.end, x.lo), F.lit(0.0))).alias("sum"))
    return g.select(*KEY, F.aggregate("_a", start, step, lambda t: t.sum).alias("tag_cover"))


def best_tag(tags: DataFrame, order: str = "rank") -> DataFrame:
    """Lowest E-value per spectrum, ties to the first position."""
    cols = [c for c in tags.columns if c not in KEY]
    return tags.groupBy(*KEY).agg(F.min_by(F.struct(*cols), F.struct("evalue", order)).alias("b")).select(*KEY, "b.*")


def status(empty: Column, has_precursor: Column, n_peaks: Column, precursor_mz: Column, enough: Column,
           n_found: Column, n_reported: Column, n_placed: Column) -> Column:
    """First matching of the nine ordered statuses."""
    return (F.when(empty, "empty").when(~has_precursor, "no_precursor").when(n_peaks == 0, "no_signal")
            .when(~((precursor_mz > 0) & (precursor_mz < float("inf"))), "bad_precursor")
            .when(~enough, "too_few_peaks").when(n_found == 0, "no_tags").when(n_reported == 0, "filtered")
            .when(n_placed > 0, "placed").otherwise("tagged"))


def census(spectra: DataFrame, signal: DataFrame, diagnostics: DataFrame, tags: DataFrame,
           reported: DataFrame | None = None, placed: DataFrame | None = None) -> DataFrame:
    """One row per MS2 spectrum, untagged ones included.

    ``signal`` is gini(); ``diagnostics`` the kept peaks, edges and complements; ``tags`` all tags found;
    ``reported`` those left after a database filter; ``placed`` (run_id, idx, n_placed).
    """
    reported = tags if reported is None else reported
    found = tags.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_found"))
    rep = reported.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_reported"))
    best = best_tag(reported).select(*KEY, F.col("evalue").alias("best_evalue"), F.col("n_res").alias("best_len"),
                                     F.col("min_conf").alias("best_min_conf"), F.col("mean_conf").alias("best_mean_conf"),
                                     F.col("peak_tic").alias("best_tic"), F.col("ion_series").alias("best_ion_series"))
    pre = best_tag(tags).select(*KEY, F.col("evalue").alias("pre_best_evalue"), F.col("n_res").alias("pre_best_len"),
                                F.col("mean_conf").alias("pre_best_mean_conf"))
    pre_cover = tag_cover(tags).withColumnRenamed("tag_cover", "pre_tag_cover")
    out = spectra
    for part in (signal, diagnostics, found, rep, best, tag_cover(reported) if reported is not tags else
                 pre_cover.withColumnRenamed("pre_tag_cover", "tag_cover"), pre, pre_cover):
        out = out.join(part, KEY, "left")
    if placed is not None:
        out = out.join(placed, KEY, "left")
    else:
        out = out.withColumn("n_placed", F.lit(None).cast("long"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    st = status(F.col("n_peaks").isNull(), F.col("precursor_mz").isNotNull(), z("n_peaks"), F.col("precursor_mz"),
                F.coalesce("enough_peaks", F.lit(False)), z("n_found"), z("n_reported"), z("n_placed"))
    out = out.withColumn("status", st)
    proc = ~F.col("status").isin("empty", "no_precursor")
    return out.select(
        *KEY, "spectrum", "rt", "precursor_mz", F.greatest(F.lit(0), F.coalesce("charge", F.lit(0))).alias("charge_given"),
        F.when(F.col("charge") > 0, F.col("charge")).otherwise(2).alias("charge_used"), z("n_peaks").alias("n_peaks"),
        F.col("n_kept").alias("n_peaks_kept"), "n_edges", "n_compl", "int_gini", "status",
        F.when(proc, z("n_found")).alias("n_found"), F.when(proc, z("n_reported")).alias("n_reported"),
        "best_evalue", "best_len", "best_min_conf", "best_mean_conf", "best_tic", "tag_cover", "best_ion_series",
        "pre_best_evalue", "pre_best_len", "pre_best_mean_conf", "pre_tag_cover")


def quantiles(df: DataFrame, group: list[str], value: str, probs: list[float]) -> DataFrame:
    """Exact type-7 quantiles per group from counted values; hot groups are scanned in tiles.

    Columns: group, n, and q10-style names for the probabilities.
    """
    r = value_ranks(df.filter(F.col(value).isNotNull()), group, value)
    tot = r.groupBy(*group).agg(F.sum("n").alias("_N"))
    r = r.join(tot, group)
    aggs = []
    for p in probs:
        h = (F.col("_N") - 1) * F.lit(p)
        lo, hi = F.floor(h), F.least(F.floor(h) + 1, F.col("_N") - 1)
        at = lambda pos: F.max(F.when((F.col("below") <= pos) & (pos < F.col("below") + F.col("n")), F.col(value)))
        a, b = at(lo), at(hi)
        aggs.append((a + (F.max(h) - F.floor(F.max(h))) * (b - a)).alias(f"q{int(round(p * 100))}"))
    return r.groupBy(*group).agg(F.max("_N").alias("n"), *aggs)


def census_summary(census_df: DataFrame) -> DataFrame:
    """(run_id, key, value): counts and shares per status, and quantiles of E-value, kept peaks and Gini."""
    census_df = materialize(census_df)
    n = census_df.groupBy("run_id", "status").agg(F.count(F.lit(1)).alias("c"))
    tot = n.groupBy("run_id").agg(F.sum("c").alias("t"))
    rows = n.join(tot, "run_id").select("run_id", F.explode(F.array(
        F.struct(F.concat(F.lit("n_"), "status").alias("key"), F.col("c").cast("double").alias("value")),
        F.struct(F.concat(F.lit("share_"), "status").alias("key"), (F.col("c") / F.col("t")).alias("value")))).alias("r")).select("run_id", "r.*")
    proc = census_df.filter(~F.col("status").isin("empty", "no_precursor"))
    seen = census_df.groupBy("run_id").agg(F.count(F.lit(1)).cast("double").alias("value")).select("run_id", F.lit("ms2_seen").alias("key"), "value")
    done = proc.groupBy("run_id").agg(F.count(F.lit(1)).cast("double").alias("value")).select("run_id", F.lit("ms2_processed").alias("key"), "value")
    out = rows.unionByName(seen).unionByName(done)
    long = proc.select("run_id", F.explode(F.array(
        F.struct(F.lit("best_evalue").alias("what"), F.when(F.col("status").isin("tagged", "placed"), F.col("best_evalue")).alias("v")),
        F.struct(F.lit("n_peaks_kept").alias("what"), F.col("n_peaks_kept").cast("double").alias("v")),
        F.struct(F.lit("int_gini").alias("what"), F.col("int_gini").alias("v")))).alias("x")).select("run_id", "x.*")
    q = quantiles(long, ["run_id", "what"], "v", [0.1, 0.5, 0.9])
    q = q.select("run_id", F.explode(F.array(*[
        F.struct(F.concat("what", F.lit("_p" + str(p))).alias("key"), F.col(f"q{p}").alias("value")) for p in (10, 50, 90)])).alias("r"))
    return out.unionByName(q.select("run_id", "r.*"))


def join_ids(census_df: DataFrame, psms: DataFrame, accept: str = "qvalue", fdr: float = 0.01, exact_only: bool = False) -> DataFrame:
    """Adds ``identified``: true, false, or NULL when an ambiguous scan number leaves it unknown.

    An exact id match wins. Otherwise a scan number counts when one unmatched reference and one spectrum
    carry it. ``psms``: run_id, ref, q, pass_threshold, is_decoy.
    """
    ok = {"qvalue": F.col("q") <= fdr, "threshold": F.col("pass_threshold"), "all": F.lit(True)}[accept]
    refs = (psms.filter(F.length(F.trim("ref")) > 0).groupBy("run_id", "ref")
            .agg(F.max(F.coalesce(ok & ~F.coalesce("is_decoy", F.lit(False)), F.lit(False))).alias("acc")))
    c = census_df.withColumn("_scan", S.scan_of("spectrum"))
    ex = c.join(refs.withColumnRenamed("ref", "spectrum").withColumnRenamed("acc", "_exact"), ["run_id", "spectrum"], "left")
    if exact_only:
        return ex.withColumn("identified", F.coalesce("_exact", F.lit(False))).drop("_exact", "_scan")
    free = refs.join(census_df.select("run_id", F.col("spectrum").alias("ref")), ["run_id", "ref"], "left_anti")
    by_scan = (free.withColumn("_scan", S.scan_of("ref")).filter("_scan IS NOT NULL").groupBy("run_id", "_scan")
               .agg(F.count(F.lit(1)).alias("_nref"), F.max("acc").alias("_acc")))
    seen = c.filter("_scan IS NOT NULL").groupBy("run_id", "_scan").agg(F.count(F.lit(1)).alias("_nspec"))
    j = ex.join(by_scan.join(seen, ["run_id", "_scan"]), ["run_id", "_scan"], "left")
    ident = (F.when(F.col("_exact").isNotNull(), F.col("_exact")).when(F.col("_nref").isNull(), F.lit(False))
             .when((F.col("_nref") > 1) | (F.col("_nspec") != 1), F.lit(None).cast("boolean")).otherwise(F.col("_acc")))
    return j.withColumn("identified", ident).drop("_exact", "_scan", "_nref", "_acc", "_nspec")


def join_verdict(census_df: DataFrame, psms: DataFrame) -> DataFrame:
    """Per run: references, unmatched ones, and refuse (> 50 %), warn (> 1 %) or ok."""
    refs = psms.select("run_id", "ref").distinct().withColumn("_scan", S.scan_of("ref"))
    ids = census_df.select("run_id", F.col("spectrum").alias("ref")).distinct().withColumn("_e", F.lit(True))
    scans = census_df.select("run_id", S.scan_of("spectrum").alias("_scan")).filter("_scan IS NOT NULL").distinct().withColumn("_s", F.lit(True))
    j = refs.join(ids, ["run_id", "ref"], "left").join(scans, ["run_id", "_scan"], "left")
    lost = F.coalesce("_e", "_s").isNull()
    r = j.groupBy("run_id").agg(F.count(F.lit(1)).alias("refs"), F.count_if(lost).alias("unmatched"))
    share = F.col("unmatched") / F.col("refs")
    return r.withColumn("verdict", F.when(share > 0.5, "refuse").when(share > 0.01, "warn").otherwise("ok"))


def triage(census_df: DataFrame, max_evalue: float = 0.01) -> DataFrame:
    """1 for unidentified, tagged or placed spectra with a best E-value at or below the threshold."""
    t = (~F.col("identified")) & F.col("status").isin("tagged", "placed") & (F.col("best_evalue") <= max_evalue)
    return census_df.withColumn("triage", F.coalesce(t, F.lit(False)).cast("int"))


def exact_join_check(census_df: DataFrame, psms: DataFrame) -> DataFrame:
    """Per run: references without a spectrum, spectra named twice, hits without a decoy annotation."""
    ids = census_df.select("run_id", F.col("spectrum").alias("ref"))
    foreign = psms.join(ids, ["run_id", "ref"], "left_anti").groupBy("run_id").agg(F.countDistinct("ref").alias("foreign_refs"))
    twice = psms.groupBy("run_id", "ref").count().filter("count > 1").groupBy("run_id").agg(F.count(F.lit(1)).alias("twice_named"))
    bare = psms.groupBy("run_id").agg(F.count_if(F.col("is_decoy").isNull()).alias("no_decoy_flag"))
    out = bare.join(foreign, "run_id", "left").join(twice, "run_id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("run_id", z("foreign_refs"), z("twice_named"), "no_decoy_flag").withColumn(
        "ok", (F.col("foreign_refs") == 0) & (F.col("twice_named") == 0) & (F.col("no_decoy_flag") == 0))


def raw_feature(name: str) -> Column:
    """Model feature before ranking: missing values lowest, the E-value as -log10 (0 gives 400)."""
    c = F.col(name).cast("double")
    if name == "pre_best_evalue":
        c = F.when(c == 0, ZERO_EVALUE).when(c > 0, F.least(F.lit(ZERO_EVALUE), -F.log10(c)))
    return F.coalesce(c, F.lit(LOWEST))


def mid_ranks(df: DataFrame, features: list[str], group: list[str] = ["run_id"], key: list[str] = KEY) -> DataFrame:
    """Key columns and r_<feature>: (rank - 0.5)/n per run, ties sharing the mean rank.

    All features are ranked in one scan over (run, feature, value) counts and joined back once.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("double").alias("v")) for f in features]))
    long = df.select(*key, pairs.alias("x")).select(*key, "x.f", "x.v")
    r = value_ranks(long, [*group, "f"], "v")
    n = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    r = r.join(n, group).select(*group, "f", "v", ((F.col("below") + F.col("n") / 2) / F.col("_n")).alias("r"))
    return long.join(r, [*group, "f", "v"]).groupBy(*key).agg(
        *[F.max(F.when(F.col("f") == f, F.col("r"))).alias(f"r_{f}") for f in features])


def ident_score(census_df: DataFrame) -> DataFrame:
    """Adds ``ident_score``: the frozen logistic model on per-run mid-ranks of twelve features."""
    census_df = materialize(census_df)   # one row per spectrum, read by every step below
    raw = census_df.select(*KEY, *[raw_feature(f).alias(f) for f in MODEL_FEATURES])
    r = mid_ranks(raw, MODEL_FEATURES)
    z = F.lit(MODEL_INTERCEPT)
    for f, b in zip(MODEL_FEATURES, MODEL_COEF):
        z = z + F.lit(b) * F.col(f"r_{f}")
    return census_df.join(r.select(*KEY, (1 / (1 + F.exp(-z))).alias("ident_score")), KEY, "left")


def sorted_census(census_df: DataFrame, score: str = "ident_score") -> DataFrame:
    """Adds ``ident_rank`` per run: by score, highest first, input order on ties; rows without a score come last."""
    scored = census_df.filter(F.col(score).isNotNull())
    r = value_ranks(scored, ["run_id"], score).select("run_id", score, F.col("above").alias("_above"))
    n = scored.groupBy("run_id").agg(F.count(F.lit(1)).alias("_scored"))
    w = W.partitionBy("run_id", score).orderBy("idx")
    j = census_df.join(r, ["run_id", score], "left").join(n, "run_id", "left")
    above = F.coalesce("_above", "_scored", F.lit(0))
    return j.withColumn("ident_rank", above + F.row_number().over(w)).drop("_above", "_scored")


def repeat_clusters(census_df: DataFrame, ppm: float = 10.0, rt_span: float = 60.0) -> DataFrame:
    """Spectra of equal charge within 10 ppm and 60 s of a cluster's first spectrum; weight 1/size.

    The greedy pass runs in islands: per charge, neighbours more than the window apart in m/z never
    share a cluster, nor do spectra of one m/z island with a time gap above the span. Spectra without m/z,
    charge or time are clusters of their own.
    """
    whole = F.col("precursor_mz").isNotNull() & F.col("charge_used").isNotNull() & F.col("rt").isNotNull()
    alone = census_df.filter(~whole).select("run_id", "idx", F.col("idx").cast("bigint").alias("cluster"), F.lit(1.0).alias("weight"))
    df = census_df.filter(whole).withColumn("_k", F.round(F.col("precursor_mz"), 9))
    keys = df.select("run_id", "charge_used", "_k").distinct()
    w = W.partitionBy("run_id", "charge_used").orderBy("_k")
    new = F.when(F.col("_k") > F.lag("_k").over(w) * (1 + ppm * 1e-6), 1).otherwise(0)
    isl = keys.withColumn("_n", new).withColumn("_isl", F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_n")
    df = df.join(isl, ["run_id", "charge_used", "_k"])
    w2 = W.partitionBy("run_id", "charge_used", "_isl").orderBy("rt", "idx")
    df = df.withColumn("_t", F.when(F.col("rt") - F.lag("rt").over(w2) > rt_span, 1).otherwise(0)).withColumn(
        "_ti", F.sum("_t").over(w2.rowsBetween(W.unboundedPreceding, 0)))
    per = df.groupBy("run_id", "charge_used", "_isl", "_ti").agg(
        F.array_sort(F.collect_list(F.struct(F.col("precursor_mz").alias("mz"), "rt", "idx"))).alias("all"))
    lead_t = "array<struct<mz:double,rt:double,idx:bigint>>"
    map_t = "array<struct<idx:bigint,cluster:bigint>>"
    start = F.struct(F.array().cast(lead_t).alias("leads"), F.array().cast(map_t).alias("of"))
    def step(acc, x):
        home = F.filter(acc.leads, lambda l: (x.mz <= l.mz * (1 + ppm * 1e-6)) & (F.abs(x.rt - l.rt) <= rt_span))
        lead = F.coalesce(F.get(home, F.lit(0)).idx, x.idx)
        return F.struct(
            F.when(F.size(home) > 0, acc.leads).otherwise(F.concat(acc.leads, F.array(
                F.struct(x.mz.cast("double").alias("mz"), x.rt.cast("double").alias("rt"), x.idx.cast("bigint").alias("idx"))))).alias("leads"),
            F.concat(acc.of, F.array(F.struct(x.idx.cast("bigint").alias("idx"), lead.cast("bigint").alias("cluster")))).alias("of"))
    of = per.select("run_id", F.explode(F.aggregate("all", start, step, lambda a: a.of)).alias("c")).select("run_id", "c.*")
    size = of.groupBy("run_id", "cluster").agg(F.count(F.lit(1)).alias("size"))
    return of.join(size, ["run_id", "cluster"]).select("run_id", "idx", "cluster", (1 / F.col("size")).alias("weight")).unionByName(alone)


def fit_ident_model(ranked: DataFrame, label: str, weight: str, features: list[str], ridge: float = 1.0):
    """Weighted ridge logistic regression on mid-ranks, every run with equal total weight.

    The penalty is half of ``ridge`` times the squared coefficients beside the weighted sum of the losses; Spark divides
    that sum by the weights, so its parameter is divided alike.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    tot = ranked.groupBy("run_id").agg(F.sum(weight).alias("_w"))
    d = ranked.join(tot, "run_id").withColumn("_wt", F.col(weight) / F.col("_w")).withColumn("_y", F.col(label).cast("double"))
    total = d.agg(F.sum("_wt")).first()[0]
    d = VectorAssembler(inputCols=features, outputCol="_x").transform(d)
    return LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_wt", regParam=ridge / total, elasticNetParam=0.0,
                              standardization=False).fit(d)


def label_census(census_df: DataFrame, psms: DataFrame, q: float = 0.01) -> DataFrame:
    """accepted, target_above_q, decoy or no_psm per census row from rank-1 identifications."""
    p = psms.select("run_id", F.col("ref").alias("spectrum"), F.col("q").alias("_q"), F.col("is_decoy").alias("_d"))
    j = census_df.join(p, ["run_id", "spectrum"], "left")
    return j.withColumn("label", F.when(F.col("_q").isNull(), "no_psm").when(F.col("_d"), "decoy")
                        .when(F.col("_q") <= q, "accepted").otherwise("target_above_q")).drop("_q", "_d")


def run_summary(spectra: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """(run_id, key, n): spectra by activation class, charge source, series and processing state.

    ``spectra`` may carry activation_class, charge_src, ion_series, iso_offset, reason; absent columns
    give no rows.
    """
    sections = [c for c in ("activation_class", "charge_src", "ion_series", "iso_offset", "reason") if c in spectra.columns]
    items = [F.struct(F.lit("input_spectra").alias("key"), F.lit("all").alias("value"))]
    items += [F.struct(F.lit(c).alias("key"), F.coalesce(F.col(c).cast("string"), F.lit("processed" if c == "reason" else "none")).alias("value")) for c in sections]
    long = spectra.select("run_id", F.explode(F.array(*items)).alias("x")).select("run_id", "x.*")
    if verdicts is not None:
        long = long.unionByName(verdicts.select("run_id", F.lit("header_check").alias("key"), F.col("verdict").alias("value")))
    return long.groupBy("run_id", "key", "value").agg(F.count(F.lit(1)).alias("n"))
