"""Filters and per-spectrum predicates ahead of tagging."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ionweave.functions import constants as K, scalar as S
from ionweave.operators.core import even_hash, values

KEY = ["run_id", "idx"]

# Isobaric label masses, windows and reporter ions.
TMT_LABEL = 229.162932
TMTPRO_LABEL = 304.207146
LABEL_WINDOW_N, LABEL_WINDOW_C = 0.020, 0.006
TMT10_REPORTERS = [126.127726, 127.124761, 127.131081, 128.128116, 128.134436,
                   129.131471, 129.137790, 130.134825, 130.141145, 131.138180]
PROBE_SPECTRA, PROBE_MIN_ELIGIBLE = 1024, 100

# Decoy affixes, matched case-insensitively.
DECOY_AFFIXES = ["DECOY_", "rev_", "reverse_", "XXX_", "shuffled_", "random_", "_DECOY", "_rev"]


def taggable(spectra: DataFrame) -> DataFrame:
    """Adds ``reason``: NULL for an MS2 spectrum with peaks and a precursor, else why it is skipped."""
    return spectra.withColumn(
        "reason", F.when(F.col("ms_level") != 2, "other_level").when(F.col("n_peaks") == 0, "no_peaks")
        .when(F.col("precursor_mz").isNull(), "no_precursor"))


def with_defaults(spectra: DataFrame) -> DataFrame:
    """Charge used (2 where none is stated), neutral mass and number of fragment charges."""
    z = F.when(F.col("charge") > 0, F.col("charge")).otherwise(2).cast("int")
    return (spectra.filter((F.col("precursor_mz") > 0) & (F.col("precursor_mz") < float("inf")))
            .withColumn("charge_used", z)
            .withColumn("mass", S.neutral_mass("precursor_mz", "charge_used"))
            .withColumn("n_z", F.least(F.lit(K.MAX_FRAGMENT_CHARGE), F.greatest(F.lit(1), F.col("charge_used") - 1))))


def clean_peaks(peaks: DataFrame, spectra: DataFrame) -> DataFrame:
    """Finite peaks of positive intensity at or below the singly charged precursor plus 1.5 Da."""
    s = with_defaults(spectra).select(*KEY, "mass", "charge_used", "n_z")
    ok = (F.col("intensity") > 0) & (F.col("intensity") < float("inf")) & ~F.isnan("mz") & (F.col("mz") < float("inf"))
    return (peaks.filter(ok).join(s, KEY)
            .filter(F.col("mz") <= F.col("mass") + F.lit(K.PROTON + K.PRECURSOR_SLACK)))


def etd_precursor_filter(peaks: DataFrame, tol: float, ppm: bool) -> DataFrame:
    """Drops peaks on the charge-reduced precursor species; needs ``mass`` and ``charge_used``."""
    def hit(zr: Column) -> Column:
        centre = (F.col("mass") + F.col("charge_used") * F.lit(K.PROTON)) / zr
        pad = S.tolerance(centre, tol, ppm)
        return F.col("mz").between(centre - F.lit(K.HYDROGEN) / zr - pad, centre + F.lit(K.ETD_REDUCED_ABOVE) / zr + pad)
    return peaks.filter(~F.exists(F.sequence(F.lit(1), F.col("charge_used")), hit))


def collapse_equal_mz(peaks: DataFrame) -> DataFrame:
    """Strongest intensity per identical m/z; other columns are per-spectrum constants."""
    rest = [c for c in peaks.columns if c not in (*KEY, "mz", "intensity")]
    return peaks.groupBy(*KEY, "mz").agg(F.max("intensity").alias("intensity"), *[F.first(c).alias(c) for c in rest])


def evalue_cut(tags: DataFrame, max_evalue: float, gap_penalty: float) -> DataFrame:
    """Cut on the E-value before the gap penalty."""
    if max_evalue <= 0:
        return tags
    raw = F.when(F.col("gapped"), F.col("evalue") / gap_penalty).otherwise(F.col("evalue"))
    return tags.filter(raw <= max_evalue)


def _near(col: str, mass: float, window: float) -> Column:
    return F.abs(F.col(col) - mass) <= window


def tmt_pseudo_filter(tags: DataFrame, fixed: dict[str, float] | None = None, reporters: bool = False) -> DataFrame:
    """Removes b/y tags whose bare end G or A is an image of the label, and reporter-flanked 1+ tags."""
    bad = F.lit(False)
    for r in ("G", "A"):
        if abs((fixed or {}).get(r, 0.0)) > 1e-8:
            continue
        m = K.RESIDUES[r]
        bad = bad | ((S.bare_endpoint("seq", True) == r) & _near("nterm_mass", TMT_LABEL - m, LABEL_WINDOW_N))
        bad = bad | ((S.bare_endpoint("seq", False) == r) & _near("cterm_mass", TMT_LABEL - K.WATER - m, LABEL_WINDOW_C))
    if reporters:
        ion = F.col("cterm_mass") + F.lit(K.WATER + K.PROTON)
        hit = F.exists(F.array(*[F.lit(x) for x in TMT10_REPORTERS]), lambda x: F.abs(ion - x) <= LABEL_WINDOW_C)
        bad = bad | ((F.col("charge") == 1) & hit)
    return tags.filter(~((F.col("ion_series") == "by") & bad))


def tmt_probe(tags: DataFrame, high_resolution: bool = True) -> DataFrame:
    """Run-level TMT detection from the flank images of ungapped tags with E <= 1."""
    k = K.RESIDUES["K"]
    def site(label, n):
        if n:
            return _near("nterm_mass", label, LABEL_WINDOW_N) | _near("cterm_mass", label - K.WATER, LABEL_WINDOW_C)
        return _near("cterm_mass", k + label, LABEL_WINDOW_C) | _near("nterm_mass", k + label + K.WATER, LABEL_WINDOW_N)
    marks = {"tmt_n": site(TMT_LABEL, True), "tmt_k": site(TMT_LABEL, False),
             "pro_n": site(TMTPRO_LABEL, True), "pro_k": site(TMTPRO_LABEL, False)}
    good = tags.filter((F.col("ion_series") == "by") & ~F.col("gapped") & (F.col("evalue") <= 1.0))
    per = good.groupBy(*KEY).agg(*[F.max(v.cast("int")).alias(n) for n, v in marks.items()])
    run = per.groupBy("run_id").agg(F.count(F.lit(1)).alias("eligible"), *[F.sum(n).alias(n) for n in marks])
    share = F.ceil(F.col("eligible") / 100)
    limit, veto = F.greatest(F.lit(20), share), F.greatest(F.lit(5), share)
    reason = (F.when(F.lit(not high_resolution), "Da_tolerance")
              .when(F.col("eligible") < PROBE_MIN_ELIGIBLE, "few_eligible_spectra")
              .when((F.col("pro_n") >= veto) & (F.col("pro_k") >= veto), "conflicting_304Da_label_evidence")
              .when((F.col("tmt_n") < limit) | (F.col("tmt_k") < limit), "insufficient_two_site_TMT_evidence")
              .otherwise("TMT6_10_two_site_evidence"))
    return run.withColumn("reason", reason).withColumn("detected", F.col("reason") == "TMT6_10_two_site_evidence")


def subsample(spectra: DataFrame, n: int | None = None, fraction: float | None = None, seed: int = 1) -> DataFrame:
    """Exactly ``n`` spectra per run, or a share rounded to nearest (at least 1); reproducible.

    Each spectrum gets a hashed position; the run's cut is found from per-cell counts of those
    positions, so only the one cell holding the cut is ordered and no run is sorted as a whole.
    """
    h = spectra.withColumn("_h", even_hash(*KEY, seed=seed)).withColumn("_c", F.floor(F.col("_h") * 4096))
    per = h.groupBy("run_id", "_c").agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy("run_id")
    target = F.lit(n) if n is not None else F.greatest(F.lit(1), F.floor(F.sum("_n").over(w) * fraction + 0.5))
    below = F.coalesce(F.sum("_n").over(w.orderBy("_c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = per.select("run_id", "_c", (target - below).alias("_room"))
    rn = F.row_number().over(W.partitionBy("run_id", "_c").orderBy("_h", "idx"))
    return (h.join(per.filter("_room > 0"), ["run_id", "_c"]).withColumn("_r", rn)
            .filter("_r <= _room").drop("_h", "_c", "_room", "_r"))


def _any(flag_words: list[str], text: Column) -> Column:
    return text.rlike("(?i)@(" + "|".join(flag_words) + ")(?![a-z])")


def activation_class(methods: Column, filter_string: Column) -> Column:
    """collisional, electron, hybrid or unknown; methods first, then the filter string's @tokens."""
    def of(coll, elec, hyb):
        return (F.when(hyb | (coll & elec), "hybrid").when(elec, "electron").when(coll, "collisional"))
    has = lambda *names: F.arrays_overlap(F.coalesce(methods, F.array().cast("array<string>")), F.array(*map(F.lit, names)))
    by_method = of(has("CID", "HCD", "TRAP", "PQD", "HCID", "LCID", "SORI"), has("ETD", "ECD"), has("EThcD", "ETciD"))
    f = F.coalesce(filter_string, F.lit(""))
    by_filter = of(_any(["cid", "hcd", "pqd"], f), _any(["etd", "ecd"], f), _any(["ethcd", "etcid"], f))
    return F.coalesce(by_method, by_filter, F.lit("unknown"))


def ion_series(mode: str, activation: Column, hybrid_both: bool = False) -> Column:
    """Series a spectrum is read as; an array, as hybrid spectra may be read twice."""
    if mode == "cz":
        return F.array(F.lit("cz"))
    if mode == "by":
        return F.array(F.lit("by"))
    both = F.array(F.lit("by"), F.lit("cz")) if hybrid_both else F.array(F.lit("by"))
    return F.when(activation == "electron", F.array(F.lit("cz"))).when(activation == "hybrid", both).otherwise(F.array(F.lit("by")))


def tolerance_by_analyzer(analyzer: Column, tol_ppm: float, tol_da: float) -> tuple[Column, Column]:
    """(tolerance, is_ppm): ion-trap scans use the Da tolerance."""
    trap = F.lower(analyzer).rlike("ion ?trap|itms")
    return F.when(trap, F.lit(tol_da)).otherwise(F.lit(tol_ppm)), ~F.coalesce(trap, F.lit(False))


def centroid(peaks: DataFrame, spectra: DataFrame, policy: str = "legacy") -> DataFrame:
    """Three-point local maxima of profile MS2 scans, where the policy picks.

    ``legacy`` (and ``auto``, read as legacy) picks columnar-archive input only, ``off`` nothing.
    ``spectra`` needs profile, ms_level and source.
    """
    if policy not in ("legacy", "auto", "off"):
        raise ValueError(policy)
    pick = F.lit(policy != "off") & F.col("profile") & (F.col("ms_level") == 2) & (F.col("source") == "columnar")
    p = peaks.join(spectra.select(*KEY, pick.alias("_pick")), KEY)
    w = W.partitionBy(*KEY).orderBy("mz")
    left, right = F.lag("intensity", 1, 0.0).over(w), F.lead("intensity", 1, 0.0).over(w)
    top = (F.col("intensity") > left) & (F.col("intensity") >= right) & (F.col("intensity") > 0)
    return p.withColumn("_top", top).filter(~F.col("_pick") | F.col("_top")).drop("_pick", "_top")


def decoy_flag(accession: Column, affixes: list[str] | None = None) -> Column:
    """Case-insensitive decoy rule: an affix with a leading separator only is a suffix, else a prefix."""
    words = [a.lower() for a in (affixes or DECOY_AFFIXES) if a]
    tails = [a for a in words if a[0] == "_" and a[-1] != "_"]
    heads = [a for a in words if a not in tails]
    low = F.lower(accession)
    flag = F.lit(False)
    for a in heads:
        flag = flag | F.startswith(low, F.lit(a))
    for a in tails:
        flag = flag | F.endswith(low, F.lit(a))
    return flag


def view(tags: DataFrame, spectrum: str | None = None, exact: bool = False, min_len: int | None = None,
         max_evalue: float | None = None, hit: str | None = None, per_spectrum: int | None = None) -> DataFrame:
    """Filters of a result table; a filter on a column the table lacks is inactive."""
    out = tags
    if spectrum and "spectrum" in tags.columns:
        out = out.filter(F.col("spectrum") == spectrum) if exact else out.filter(
            F.lower("spectrum").contains(spectrum.lower()))
    if min_len is not None and "length" in tags.columns:
        out = out.filter(F.col("length") >= min_len)
    if max_evalue is not None and "evalue" in tags.columns:
        out = out.filter(F.col("evalue") <= max_evalue)
    if hit in ("hit", "miss") and "fasta_hit" in tags.columns:
        out = out.filter(F.col("fasta_hit") if hit == "hit" else ~F.col("fasta_hit"))
    if per_spectrum:
        order = [c for c in ("evalue", "tag", "length") if c in out.columns]
        rn = F.row_number().over(W.partitionBy("spectrum").orderBy(*order))
        out = out.withColumn("_r", rn).filter(F.col("_r") <= per_spectrum).drop("_r")
    return out
