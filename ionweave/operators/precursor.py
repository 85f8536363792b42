"""Precursor charge and isotope hypotheses, header checks and the complement tolerance estimate."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ionweave.functions import constants as K, scalar as S
from ionweave.operators.core import Scan, keyed_join, lookback, ordered_scan, range_join
from ionweave.session import materialize

KEY = ["run_id", "idx"]

# Limits of the charge inference.
CHARGE_LIMIT = 8
TOP_PEAKS = 150
OFF_TARGET = [-11.5, -7.5, -4.5, 4.5, 7.5, 11.5]
ONE_PLUS_SHARE, ONE_PLUS_WINDOW = 0.05, 3.5
CEILING_MARGIN = 1.5
INFER_MARGIN, HEADER_MARGIN = 2.0, 6.0
MS1_PPM, MS1_FIRST_MIN, MS1_SUPPORT_MIN = 10.0, 0.15, 0.05
# Complement tolerance estimate.
AUTO_Z, MAD_TO_SD, MIN_SIGNAL, MIN_TOL, FLOOR_FROM = 1.96, 1.4826, 40.0, 0.001, 2.0 / 3.0
WINDOW_FACTOR, WINDOW_MIN, WINDOW_MAX = 6.0, 0.1, 0.9


def charge_candidates(spectra: DataFrame, mode: str = "assume2", zmin: int = 2, zmax: int = 4) -> DataFrame:
    """(run_id, idx, z, src): the header charge, else the listed possible charges, else 2 or a range."""
    listed = F.array_sort(F.array_distinct(F.filter(F.coalesce("possible_charges", F.array().cast("array<int>")),
                                                    lambda z: (z >= 1) & (z <= CHARGE_LIMIT))))
    span = F.array(*[F.lit(z) for z in range(max(1, zmin), min(zmax, CHARGE_LIMIT) + 1)])
    s = spectra.withColumn("_l", listed)
    rest = F.struct(F.array(F.lit(2)).alias("z"), F.lit("assumed").alias("src")) if mode == "assume2" else \
        F.when(F.size("_l") > 0, F.struct(F.col("_l").alias("z"), F.lit("possible").alias("src"))).otherwise(
            F.struct(span.alias("z"), F.lit("enumerated").alias("src")))
    pick = F.when(F.col("charge") > 0, F.struct(F.array(F.col("charge").cast("int")).alias("z"), F.lit("header").alias("src"))).otherwise(rest)
    return s.withColumn("_p", pick).select(*KEY, F.explode("_p.z").alias("z"), F.col("_p.src").alias("src"))


def top_peaks(peaks: DataFrame, n: int = TOP_PEAKS) -> DataFrame:
    """The ``n`` strongest peaks of each spectrum (limit pruned before the shuffle)."""
    w = W.partitionBy(*KEY).orderBy(F.desc("intensity"), F.desc("mz"))
    return peaks.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def _pair_excess(tol: float, delta: float) -> Callable:
    """A column function of a spectrum's sorted m/z, a mass and the weight of the heavier pair rule (0: none): the pair excess."""
    shifts = np.array([0.0, *OFF_TARGET])[:, None]

    def seen(mz: np.ndarray, total: float, w: int) -> float:
        want = (total + shifts) - w * mz
        lo, hi = np.searchsorted(mz, want - tol, "left"), np.searchsorted(mz, want + tol, "right")
        own = np.arange(len(mz))
        if w == 1:
            hit = (want > mz) & (hi > np.maximum(lo, own + 1))
        else:
            hit = (want > 0) & (hi - lo - ((lo <= own) & (own < hi)) > 0)
        n = hit.sum(axis=1)
        return float(n[0]) - float(n[1:].sum()) / len(OFF_TARGET)

    def both(mz: np.ndarray, M: float, z: int) -> float:
        x = seen(mz, M + (2 * K.PROTON + delta), 1)
        if z >= 3:
            n = seen(mz, M + z * K.PROTON + delta, z - 1)
            x += n
        return x

    @F.pandas_udf("double")
    def excess(mz: pd.Series, M: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series([0.0 if a is None or m != m else both(a, m, c) for a, m, c in zip(mz, M, z)], dtype="float64")

    return excess


def complement_excess(top: DataFrame, masses: DataFrame, tol: float, delta: float = 0.0, charge_aware: bool = False) -> DataFrame:
    """Adds to every row of ``masses`` (run_id, idx, M, labels) the pair excess at M + 2 protons.

    The excess is the number of lower peaks with a partner at the pair sum, minus the mean number at
    six off-target sums. ``charge_aware`` (rows carry the precursor charge ``z``) adds, from charge 3, the excess of pairs of a
    singly and a (z - 1) times charged ion, which sum to M + z protons with the latter weighted by its charge. A spectrum's
    peaks meet its masses as one array, so rows are masses, not masses times peaks times sums.
    """
    mz = top.groupBy(*KEY).agg(F.array_sort(F.collect_set("mz")).alias("_mz"))
    z = F.col("z").cast("int") if charge_aware else F.lit(0)
    t = keyed_join(masses, mz, KEY, "left")
    return t.withColumn("excess", _pair_excess(tol, delta)("_mz", F.col("M"), z)).select(*masses.columns, "excess")


def best_isotope(top: DataFrame, candidates: DataFrame, isotopes: list[int], tol: float, charge_aware: bool = False) -> DataFrame:
    """Per (run_id, idx, z): the isotope error with the largest excess, ties to small |k|, then small k.

    ``candidates`` carries precursor_mz and z.
    """
    k = F.explode(F.array(*[F.lit(x) for x in isotopes])).alias("k")
    m = candidates.select(*KEY, "z", "precursor_mz", k)
    m = m.withColumn("M", F.col("precursor_mz") * F.col("z") - F.col("z") * F.lit(K.PROTON) - F.col("k") * F.lit(K.ISOTOPE_STEP))
    e = complement_excess(top, m.select(*KEY, "z", "k", "M"), tol, charge_aware=charge_aware)
    return e.groupBy(*KEY, "z").agg(
        F.max_by("k", F.struct(F.round("excess", 9), -F.abs("k"), -F.col("k"))).alias("iso"), F.max("excess").alias("excess"))


def one_plus_share(peaks: DataFrame, spectra: DataFrame) -> DataFrame:
    """Share of the intensity above the precursor, the precursor's own neighbourhood left out."""
    p = keyed_join(peaks, spectra.select(*KEY, "precursor_mz"), KEY).filter(
        (F.col("intensity") > 0) & (F.abs(F.col("mz") - F.col("precursor_mz")) > ONE_PLUS_WINDOW))
    return p.groupBy(*KEY).agg((F.sum(F.when(F.col("mz") > F.col("precursor_mz"), F.col("intensity")).otherwise(0.0))
                                / F.sum("intensity")).alias("above_share"))


def infer_charge(peaks: DataFrame, spectra: DataFrame, candidates: DataFrame, tol: float, isotopes: list[int] = [0],
                 margin: float = INFER_MARGIN, charge_aware: bool = False) -> DataFrame:
    """Charge call per spectrum: charge, src (inferred, ambiguous, assumed), basis, runner_up, excess.

    1+ when almost no intensity lies above the precursor; charges whose fragment ceiling lies below a
    strong peak are ruled out (unless all are); then the largest excess wins, ambiguous inside ``margin``.
    Excesses are compared in their own unit, one off-target pair, so no rounding decides.
    """
    unit = float(len(OFF_TARGET))
    top = top_peaks(peaks)
    high = top.groupBy(*KEY).agg(F.max("mz").alias("top_mz"))
    c = candidates.select(*KEY, "z").distinct()
    c = keyed_join(c, spectra.select(*KEY, "precursor_mz"), KEY)
    c = keyed_join(keyed_join(c, best_isotope(top, c, isotopes, tol, charge_aware), [*KEY, "z"]), high, KEY, "left")
    over = F.coalesce("top_mz", F.lit(0.0)) > F.col("z") * F.col("precursor_mz") - (F.col("z") - 1) * F.lit(K.PROTON) + CEILING_MARGIN
    w = W.partitionBy(*KEY)
    c = c.withColumn("_ok", ~over).withColumn("_any", F.max("_ok").over(w)).withColumn("_left", F.col("_ok") | ~F.col("_any"))
    c = c.withColumn("_zmin", F.min("z").over(w))
    s = c.groupBy(*KEY).agg(
        F.min("_zmin").alias("z_low"), F.min(F.when(F.col("_left"), F.col("z"))).alias("left_low"),
        F.max(F.when(F.col("_left") & (F.col("z") == 2), 1).otherwise(0)).alias("two_left"),
        F.reverse(F.array_sort(F.collect_list(F.when(F.col("_left"), F.struct(F.round(F.col("excess") * unit).cast("long").alias("e"), (-F.col("z")).alias("nz")))))).alias("best"))
    s = keyed_join(s, one_plus_share(peaks, spectra), KEY, "left")
    e1, e2 = F.get("best", F.lit(0)), F.get("best", F.lit(1))
    range_min = F.when(F.col("left_low") != F.col("z_low"), F.col("left_low"))
    none = ~(e1.e > 0)
    one = (F.col("z_low") == 1) & (F.col("above_share") < ONE_PLUS_SHARE)
    close = e2.e.isNotNull() & (e1.e - e2.e < unit * margin)
    call = (F.when(one, F.struct(F.lit(1).alias("charge"), F.lit("inferred").alias("src"), F.lit("one_plus").alias("basis")))
            .when(none & range_min.isNotNull(), F.struct(range_min.alias("charge"), F.lit("inferred").alias("src"), F.lit("range").alias("basis")))
            .when(none, F.struct(F.when(F.col("two_left") == 1, 2).otherwise(F.col("left_low")).alias("charge"), F.lit("assumed").alias("src"), F.lit("none").alias("basis")))
            .otherwise(F.struct((-e1.nz).alias("charge"), F.when(close, "ambiguous").otherwise("inferred").alias("src"), F.lit("complement").alias("basis"))))
    return s.withColumn("c", call).select(
        *KEY, "c.charge", "c.src", "c.basis", F.when(F.col("c.src") == "ambiguous", -e2.nz).alias("runner_up"),
        (e1.e / unit).alias("excess"), F.when(F.col("c.src") == "ambiguous", e2.e / unit).alias("runner_excess"), "above_share")


def preceding_ms1(scans: DataFrame) -> DataFrame:
    """Adds ``ms1_idx``: the last MS1 scan at or before each scan of its run."""
    return lookback(scans, ["run_id"], "idx", F.col("ms_level") == 1, "ms1_idx")


def ms1_charge(scans: DataFrame, peaks: DataFrame, ppm: float = MS1_PPM) -> DataFrame:
    """Isotope-spacing charge of MS2 precursors in the preceding MS1 scan (0 = none).

    The highest charge with a strong +1/z peak and a -1/z or +2/z peak wins; ``spaced`` lists every
    charge with a strong +1/z peak.
    """
    ms2 = preceding_ms1(scans).filter("ms_level = 2 AND ms1_idx IS NOT NULL AND precursor_mz > 0")
    zs = [(0, 0.0)] + [(z * 10 + j, m / z) for z in range(1, CHARGE_LIMIT + 1) for j, m in ((1, 1.0), (2, -1.0), (3, 2.0))]
    pos = F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.lit(m * K.ISOTOPE_STEP).alias("d")) for c, m in zs]))
    probe = ms2.select(*KEY, "ms1_idx", "precursor_mz", pos.alias("s")).select(
        "run_id", "idx", "ms1_idx", "s.code", (F.col("precursor_mz") + F.col("s.d")).alias("want"))
    target = peaks.select("run_id", F.col("idx").alias("ms1_idx"), F.col("mz").alias("mz_1"), F.col("intensity").alias("y"))
    tol = F.col("want") * F.lit(ppm * 1e-6)
    hit = range_join(probe, target, ["run_id", "ms1_idx"], F.col("want") - tol, F.col("want") + tol, "mz_1", 5.0)
    per = hit.groupBy(*KEY, "code").agg(F.max("y").alias("y")).groupBy(*KEY).agg(
        F.map_from_entries(F.collect_list(F.struct("code", "y"))).alias("m"))
    at = lambda c: F.coalesce(F.element_at("m", F.lit(c)), F.lit(0.0))
    call = F.lit(0)
    for z in range(1, CHARGE_LIMIT + 1):
        ok = (at(z * 10 + 1) >= MS1_FIRST_MIN * at(0)) & ((at(z * 10 + 2) >= MS1_SUPPORT_MIN * at(0)) | (at(z * 10 + 3) >= MS1_SUPPORT_MIN * at(0)))
        call = F.when(ok, z).otherwise(call)
    spaced = F.array_compact(F.array(*[F.when((at(0) > 0) & (at(z * 10 + 1) >= MS1_FIRST_MIN * at(0)), F.lit(z)) for z in range(1, CHARGE_LIMIT + 1)]))
    per = per.select(*KEY, F.when(at(0) > 0, call).otherwise(0).alias("ms1_charge"), spaced.alias("spaced"))
    return keyed_join(ms2.select(*KEY, "ms1_idx"), per, KEY, "left").withColumn("ms1_charge", F.coalesce("ms1_charge", F.lit(0)))


def check_header_charge(peaks: DataFrame, spectra: DataFrame, tol: float, zmin: int = 2, zmax: int = 4,
                        margin: float = HEADER_MARGIN, ms1: DataFrame | None = None) -> DataFrame:
    """agree, disagree, ambiguous or no_call for the stated charge; an MS1 spacing call outranks the rest.

    Complement pairs are counted with their charges. ``replacement``: the charge that a disagreement rests on, else the header.
    """
    s = spectra.filter("charge > 0")
    span = F.array(*[F.lit(z) for z in range(zmin, zmax + 1)])
    cands = s.select(*KEY, F.explode(F.array_distinct(F.concat(span, F.array(F.col("charge").cast("int"))))).alias("z"))
    call = infer_charge(peaks, s, cands, tol, charge_aware=True)
    head = best_isotope(top_peaks(peaks), s.select(*KEY, F.col("charge").cast("int").alias("z"), "precursor_mz"), [0], tol, True)
    j = keyed_join(call.withColumnRenamed("charge", "call"), s.select(*KEY, F.col("charge").alias("header")), KEY)
    j = keyed_join(j, head.select(*KEY, F.col("excess").alias("header_excess")), KEY)
    amb = (F.when((F.col("call") == F.col("header")) | (F.col("runner_up") == F.col("header")), "agree")
           .when((F.col("runner_excess") > 0) & (F.col("runner_excess") - F.col("header_excess") >= margin), "disagree").otherwise("ambiguous"))
    against = (F.col("basis") == "one_plus") | ((F.col("basis") == "complement") & (F.col("excess") > 0)
                                                 & (F.col("excess") - F.col("header_excess") >= margin))
    v = (F.when(F.col("src") == "ambiguous", amb).when((F.col("src") == "assumed") | (F.col("basis") == "none"), "no_call")
         .when(F.col("call") == F.col("header"), "agree").when(against, "disagree").otherwise("no_call"))
    if ms1 is not None:
        # a header whose own +1/z peak is there stands against a higher MS1 call
        j = keyed_join(j, ms1.select(*KEY, "ms1_charge", "spaced"), KEY, "left")
        stands = (F.col("ms1_charge") == F.col("header")) | F.array_contains("spaced", F.col("header").cast("int"))
        v = F.when(F.col("ms1_charge") > 0, F.when(stands, "agree").otherwise("disagree")).otherwise(v)
    other = F.when(F.col("ms1_charge") > 0, F.col("ms1_charge")).otherwise(F.col("call")) if ms1 is not None else F.col("call")
    return j.withColumn("verdict", v).withColumn("replacement", F.when(F.col("verdict") == "disagree", other).otherwise(F.col("header")))


@dataclass(frozen=True)
class HypothesisParams:
    """Which (charge, isotope) hypotheses of a precursor are tagged; at the defaults there is one."""
    mode: str = "assume2"                # assume2, enumerate, infer: for precursors without a charge
    zmin: int = 2
    zmax: int = 4
    infer_margin: float = INFER_MARGIN
    isotopes: tuple[int, ...] = (0,)
    header_check: str = "off"            # both: a disagreeing header is tagged at the other charge as well
    header_margin: float = HEADER_MARGIN

    def __post_init__(self):
        if self.mode not in ("assume2", "enumerate", "infer") or self.header_check not in ("off", "both"):
            raise ValueError(f"{self.mode}, {self.header_check}")
        if not 1 <= self.zmin <= self.zmax <= CHARGE_LIMIT or not self.isotopes or len(set(self.isotopes)) < len(self.isotopes):
            raise ValueError("charges must lie in 1 to 8 and isotopes be distinct")


def precursor_hypotheses(spectra: DataFrame, peaks: DataFrame, tol: float, params: HypothesisParams = HypothesisParams(),
                         ms1: DataFrame | None = None) -> DataFrame:
    """A row per hypothesis: run_id, idx, hypothesis (from 0, ascending charge), n_hyp, z, charge_src, selected, iso, precursor_mz.

    A stated charge stands; under the header check a disagreeing one has the check's charge beside it. Else 2 is assumed, or a
    single listed charge taken, or all candidates are enumerated, or the charge is inferred, two charges if ambiguous. ``selected`` is the
    one that per-spectrum reports use. Of several isotope errors each charge takes the one with the largest complement
    excess, and the precursor m/z is moved by it. ``ms1``: output of ``ms1_charge``. Only spectra whose charge is open, or headers
    under the check, have their peaks read.
    """
    listed = F.array_sort(F.array_distinct(F.filter(F.coalesce("possible_charges", F.array().cast("array<int>")), lambda z: (z >= 1) & (z <= CHARGE_LIMIT))))
    s = spectra if "possible_charges" in spectra.columns else spectra.withColumn("possible_charges", F.lit(None).cast("array<int>"))
    s = s.select(*KEY, "precursor_mz", F.coalesce(F.col("charge").cast("int"), F.lit(0)).alias("charge"), listed.alias("listed")).filter("precursor_mz > 0")
    one = lambda z, src, chosen=F.lit(True): F.struct(z.cast("int").alias("z"), F.lit(src).alias("charge_src"), chosen.alias("selected"))
    header, single = F.col("charge") > 0, F.size("listed") == 1
    fixed = F.when(header, F.array(one(F.col("charge"), "header")))
    fixed = fixed.otherwise(F.array(one(F.lit(2), "assumed"))) if params.mode == "assume2" else fixed.when(single, F.array(one(F.get("listed", F.lit(0)), "possible")))
    s = s.withColumn("hyps", fixed)
    if params.mode != "assume2":
        span = F.array(*[F.lit(z) for z in range(params.zmin, params.zmax + 1)])
        free = s.filter("hyps IS NULL").withColumn("cands", F.when(F.size("listed") > 0, F.col("listed")).otherwise(span))
        theirs = keyed_join(peaks, free.select(*KEY), KEY, "left_semi")
        call = infer_charge(theirs, free, free.select(*KEY, F.explode("cands").alias("z")), tol, list(params.isotopes), params.infer_margin)
        free = keyed_join(free, call.select(*KEY, F.col("charge").alias("call"), "src", "runner_up"), KEY)
        if params.mode == "enumerate":
            has = lambda z: F.array_contains("cands", z)
            chosen = F.when((F.col("src") != "assumed") & has(F.col("call")), F.col("call")).when(has(F.lit(2)), 2).otherwise(F.get("cands", F.lit(0)))
            src = F.when(F.size("listed") > 0, F.lit("possible")).otherwise(F.lit("enumerated"))
            open_ = F.transform("cands", lambda z: F.struct(z.cast("int").alias("z"), src.alias("charge_src"), (z == chosen).alias("selected")))
        else:
            two = F.array_sort(F.array(one(F.col("call"), "ambiguous"), one(F.col("runner_up"), "ambiguous", F.lit(False))))
            alone = F.array(F.struct(F.col("call").cast("int").alias("z"), F.col("src").alias("charge_src"), F.lit(True).alias("selected")))
            open_ = F.when(F.col("src") == "ambiguous", two).otherwise(alone)
        s = s.filter("hyps IS NOT NULL").unionByName(free.withColumn("hyps", open_).select(*s.columns))
    if params.header_check == "both":
        stated = s.filter("charge > 0")
        check = check_header_charge(keyed_join(peaks, stated.select(*KEY), KEY, "left_semi"), stated, tol, params.zmin, params.zmax, params.header_margin, ms1)
        other = check.filter((F.col("verdict") == "disagree") & F.col("replacement").between(1, CHARGE_LIMIT) & (F.col("replacement") != F.col("header")))
        both = F.array_sort(F.array(one(F.col("charge"), "header"), one(F.col("replacement"), "check_call", F.lit(False))))
        s = keyed_join(s, other.select(*KEY, "replacement"), KEY, "left").withColumn("hyps", F.when(F.col("replacement").isNotNull(), both).otherwise(F.col("hyps")))
    h = s.select(*KEY, "precursor_mz", F.size("hyps").alias("n_hyp"), F.posexplode("hyps").alias("hypothesis", "h")).select(*KEY, "hypothesis", "n_hyp", "precursor_mz", "h.*")
    if len(params.isotopes) > 1:
        h = materialize(h)   # read twice below
        found = best_isotope(top_peaks(peaks), h, list(params.isotopes), tol)
        h = keyed_join(h, found.select(*KEY, "z", "iso"), [*KEY, "z"])
    else:
        h = h.withColumn("iso", F.lit(params.isotopes[0]))
    moved = F.col("precursor_mz") - F.col("iso") * F.lit(K.ISOTOPE_STEP) / F.col("z")
    return h.select(*KEY, "hypothesis", "n_hyp", "z", "charge_src", "selected", "iso", F.when(F.col("iso") == 0, F.col("precursor_mz")).otherwise(moved).alias("precursor_mz"))


def measurement_window(frag_tol: float, tol_ppm: bool) -> float:
    """Half-width in Da of the window that errors are gathered in: some fragment tolerances at m/z 1000, within bounds."""
    return min(max(WINDOW_FACTOR * (1e-3 * frag_tol if tol_ppm else frag_tol), WINDOW_MIN), WINDOW_MAX)


def complement_errors(ends: DataFrame, prepared: DataFrame, window: float, rule: str = "same", series: str = "by") -> DataFrame:
    """(run_id, idx, mz, err): signed distance in Da of the nearest peak from the partner position of a tag's end peak.

    ``ends``: run_id, idx, z (fragment charge) and mz of the end peaks; ``prepared``: the peaks of the tagging, with mass and
    charge_used. An end whose nearest peak is itself has no partner under that rule; of several rules the closest counts (ties to
    the first, and at equal distance to the higher peak). Ends without a peak inside the window give no row, equal ends one.
    """
    pair = K.ION_PAIRS[series]
    rules = {"same": ["same"], "precursor": ["precursor"], "both": ["same", "precursor"]}[rule]
    whole = prepared.join(ends.select(*KEY).distinct(), KEY, "left_semi")
    facts = whole.groupBy(*KEY).agg(F.first("mass").alias("mass"), F.first("charge_used").alias("charge_used")).filter("mass > 0")
    probe = ends.select(*KEY, "z", "mz").distinct().join(facts, KEY)
    at = [S.complement_mz(F.col("mass") + F.lit(pair["delta"]), F.col("charge_used") - F.lit(pair["charge_loss"]), F.col("z"), F.col("mz"), r) for r in rules]
    probe = probe.select(*KEY, "z", "mz", F.posexplode(F.array(*at)).alias("r", "want")).filter("want IS NOT NULL")
    peaks = whole.select(*KEY, F.col("mz").alias("mz_q")).distinct()
    hit = range_join(probe, peaks, KEY, F.col("want") - window, F.col("want") + window, "mz_q", 2.0)
    near = hit.groupBy(*KEY, "z", "mz", "r", "want").agg(F.min_by("mz_q", F.struct(F.abs(F.col("mz_q") - F.col("want")), -F.col("mz_q"))).alias("mz_q"))
    err = near.filter("mz_q <> mz").withColumn("err", F.col("mz_q") - F.col("want"))
    return err.groupBy(*KEY, "z", "mz").agg(F.min_by("err", F.struct(F.abs("err"), "r")).alias("err")).select(*KEY, "mz", "err")


def complement_tolerance(errors: DataFrame, window: float, configured: float, min_signal: float = MIN_SIGNAL) -> DataFrame:
    """Per run: floor-corrected median and MAD of complement errors, and the tolerance they give.

    ``errors``: run_id, err. Each error value is counted once before it is ordered; the running counts
    are tiled, so a run with most of the errors is no bottleneck. Never below ``configured``.
    """
    kept = errors.filter(F.abs("err") <= window).groupBy("run_id", "err").agg(F.count(F.lit(1)).alias("c"))
    start = FLOOR_FROM * window
    base = kept.groupBy("run_id").agg(F.sum("c").alias("n"), F.sum(F.when(F.abs("err") >= start, F.col("c")).otherwise(0)).alias("n_floor"))
    dens = F.col("n_floor") / F.lit(2.0 * (window - start))
    f1 = window / (window - start) - 1.0
    need = F.greatest(F.lit(min_signal), 3.0 * F.sqrt(2.0 * ((F.col("n") - F.col("n_floor")) + f1 * f1 * F.col("n_floor"))))
    base = base.withColumn("floor", dens).withColumn("signal", F.col("n") - dens * 2.0 * window).withColumn("need", need)
    cum = ordered_scan(kept, ["run_id"], "err", [Scan("upto", "sum", "c")]).join(base.select("run_id", "floor", "signal"), "run_id")
    ok = F.col("upto") - F.col("floor") * (F.col("err") + window) >= 0.5 * F.col("signal")
    med = cum.groupBy("run_id").agg(F.min(F.when(ok, F.col("err"))).alias("median"))
    dev = kept.join(med.filter("median IS NOT NULL"), "run_id").withColumn("dev", F.abs(F.col("err") - F.col("median")))
    devc = dev.groupBy("run_id", "dev").agg(F.sum("c").alias("c"))
    cd = ordered_scan(devc, ["run_id"], "dev", [Scan("upto", "sum", "c")]).join(base.select("run_id", "floor", "signal"), "run_id").join(med, "run_id")
    span = F.least(F.col("median") + F.col("dev"), F.lit(window)) - F.greatest(F.col("median") - F.col("dev"), F.lit(-window))
    mad = cd.filter(F.col("upto") - F.col("floor") * span >= 0.5 * F.col("signal")).groupBy("run_id").agg(F.min("dev").alias("mad"))
    t = F.abs("median") + AUTO_Z * MAD_TO_SD * F.col("mad")
    out = base.join(med, "run_id", "left").join(mad, "run_id", "left")
    out = out.withColumn("ok", F.coalesce((F.col("signal") >= F.col("need")) & (t < start), F.lit(False)))
    return out.select("run_id", "n", "signal", "need", "median", "mad", "ok",
                      F.when(F.col("ok"), F.greatest(t, F.lit(MIN_TOL), F.lit(configured))).otherwise(F.lit(configured)).alias("tol"))
