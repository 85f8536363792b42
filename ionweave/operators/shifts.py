"""Mass-shift survey: histograms, bin groups, catalogue names, isobars and combinations."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ionweave.functions import constants as K
from ionweave.operators.core import range_join

BIN = 0.0005
C13 = 1.00335483

# Adducts, losses and common modifications (Da).
ADDUCTS = [("Na", 21.981943), ("Mg[II]", 21.969392), ("K", 37.955882), ("Ca[II]", 37.946941), ("Fe[III]", 52.911464),
           ("Fe[II]", 53.919289), ("NH3", 17.026549)]
LOSSES = [("H2O", -18.010565), ("NH3", -17.026549), ("CH4SO", -63.998285), ("H3PO4", -97.976896)]
DEAMIDATION = 0.984016
COMMON_MODS = [("Oxidation", 15.994915), ("Deamidated", 0.984016), ("Acetyl", 42.010565), ("Methyl", 14.01565),
               ("Carbamidomethyl", 57.021464), ("Carbamyl", 43.005814), ("Formyl", 27.994915), ("Phospho", 79.966331),
               ("Dehydrated", -18.010565), ("Amidated", -0.984016), ("Cation:Na", 21.981943)]
SILAC_MODS = ["Label:2H(4)", "Label:13C(6)", "Label:13C(6)15N(2)", "Label:13C(6)15N(4)"]


def delta_histogram(samples: DataFrame, width: float = BIN) -> DataFrame:
    """(run_id, bin, interp, n): counts per bin and reading, combined map-side."""
    return samples.groupBy("run_id", F.round(F.col("delta") / width).cast("long").alias("bin"), "interp").agg(F.count(F.lit(1)).alias("n"))


#: Rows that one ordered fold takes, about; a stretch without a gap stays together.
BLOCK_ROWS = 50_000


def greedy_claim(rows: DataFrame, group: list[str], pos: str, weight: str, width: float, seedable: Column | None = None, scale: float = 1.0) -> DataFrame:
    """Adds ``seed``: the heaviest row within ``width`` that starts a group (ties to the lower position).

    Rows are visited from the heaviest down; a row starts a group unless a starter lies within ``width``, and every
    row joins its heaviest starter. ``rows`` holds one row per (group, pos): a table of bins, which the value range
    bounds. It is cut at gaps wider than ``width``, across which nothing is claimed, and each block is one fold.
    ``scale`` turns positions into whole units.
    """
    reach = int(round(width * scale))
    w = W.partitionBy(*group).orderBy("_u")
    cut = rows.select(*group, F.col(pos).alias("_pos"), F.round(F.col(pos) * scale).cast("long").alias("_u"), F.col(weight).cast("double").alias("_w"),
                      F.coalesce(F.lit(True) if seedable is None else seedable, F.lit(False)).alias("_may"))
    cut = cut.withColumn("_row", F.row_number().over(w)).withColumn("_first", F.when(F.coalesce(F.col("_u") - F.lag("_u").over(w) > reach, F.lit(True)), F.col("_row")))
    cut = cut.withColumn("_block", F.expr(f"last(_first, true) OVER (PARTITION BY {', '.join(group)} ORDER BY _u ROWS UNBOUNDED PRECEDING) div {BLOCK_ROWS}"))

    def claim(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_u", kind="stable")
        u, may = pdf["_u"].to_numpy(), pdf["_may"].to_numpy(bool)
        heavy = pdf["_w"].fillna(-np.inf).to_numpy(float)
        lo, hi = np.searchsorted(u, u - reach, side="left"), np.searchsorted(u, u + reach, side="right")
        covered, seed = np.zeros(len(u), bool), np.full(len(u), -1)
        for i in np.lexsort((u, -heavy)):
            if may[i] and not covered[i]:
                covered[lo[i]:hi[i]] = True
                near = seed[lo[i]:hi[i]]
                near[near < 0] = i                       # starters come heaviest first
        out = pdf[[*group, "_pos"]].copy()
        at = pdf["_pos"].to_numpy()
        out["seed"] = pd.Series([at[i] if i >= 0 else None for i in seed], index=out.index, dtype=object)
        return out

    kind = rows.schema[pos].dataType.simpleString()
    schema = ", ".join([*[f"{g} {rows.schema[g].dataType.simpleString()}" for g in group], f"_pos {kind}", f"seed {kind}"])
    seeds = cut.drop("_row", "_first").groupBy(*group, "_block").applyInPandas(claim, schema)
    return rows.join(seeds.withColumnRenamed("_pos", pos), [*group, pos])


def group_bins(bins: DataFrame, width: int = 0) -> DataFrame:
    """(run_id, bin, n) to bin, n, center. Width 0: local maxima take strictly smaller neighbours, the
    lower maximum first; else each heaviest free bin takes the free bins within ``width``."""
    if width > 0:
        return greedy_claim(bins, ["run_id"], "bin", "n", width).withColumnRenamed("seed", "center")
    w = W.partitionBy("run_id").orderBy("bin")
    near = lambda f: F.when(F.abs(f("bin").over(w) - F.col("bin")) == 1, f("n").over(w)).otherwise(0)
    b = bins.withColumn("_l", F.coalesce(near(F.lag), F.lit(0))).withColumn("_h", F.coalesce(near(F.lead), F.lit(0)))
    b = b.withColumn("_top", (F.col("n") >= F.col("_l")) & (F.col("n") >= F.col("_h")))
    left = (F.lag("_top").over(w)) & (F.col("bin") - F.lag("bin").over(w) == 1) & (F.col("n") < F.col("_l"))
    right = (F.lead("_top").over(w)) & (F.lead("bin").over(w) - F.col("bin") == 1) & (F.col("n") < F.col("_h"))
    c = F.when(F.col("_top"), F.col("bin")).when(left, F.col("bin") - 1).when(right, F.col("bin") + 1)
    return b.withColumn("center", c).filter("center IS NOT NULL").select("run_id", "bin", "n", "center")


def top_interpretations(hist: DataFrame, key: list[str], k: int = 3) -> DataFrame:
    """The ``k`` most frequent readings per row as ``name:count`` text, ties by name."""
    g = hist.groupBy(*key, "interp").agg(F.sum("n").alias("n"))
    g = g.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("n"), "interp"))).filter(F.col("_r") <= k)
    return g.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "interp", "n"))),
                               lambda x: F.concat(x.interp, F.lit(":"), x.n.cast("string"))), ";").alias("top_interps"))


def loc_class(region_lo: Column, region_hi: Column, delta: Column, loc_pos: Column, length: Column,
              alternatives: Column, evidence: Column, min_evidence: int = 2) -> Column:
    """none, unlocalized, sequence, fragment or ambiguous."""
    return (F.when((region_hi < region_lo) | (F.abs(delta) <= 1e-6), "none")
            .when(loc_pos.isNull() | (loc_pos < 0) | (loc_pos >= length), "unlocalized").when(alternatives == 0, "sequence")
            .when(evidence >= max(1, min_evidence), "fragment").when(evidence >= 1, "ambiguous").otherwise("unlocalized"))


def site_key(kind: Column, residue: Column, protein_term: Column) -> Column:
    """``M`` for a residue, ``N-term|M`` or ``Protein N-term|M`` for a terminal residue."""
    return F.when(kind == "R", residue).otherwise(F.concat(F.when(protein_term, "Protein ").otherwise(""),
                                                           F.when(kind == "N", "N-term|").otherwise("C-term|"), residue))


def match_catalogue(rows: DataFrame, entries: DataFrame, fixed: DataFrame | None, tol: float, cap: int = 3) -> DataFrame:
    """Catalogue entries within ``tol`` that may sit on the row's sites, also in place of a fixed modification.

    ``rows``: row_id, delta, kind, residue, protein_term, support. ``entries``: acc, name, origin, term
    (anywhere, n_term, c_term, protein_n_term, protein_c_term), mass, label. ``fixed``: residue, fixed,
    fixed_mass. At most ``cap`` matches per row by support, error, accession (a top-k report).
    """
    direct = entries.withColumn("fixed", F.lit("")).withColumn("want", F.col("mass"))
    if fixed is not None:
        swap = entries.filter("origin <> 'X'").join(F.broadcast(fixed.withColumnRenamed("residue", "origin")), "origin")
        swap = swap.withColumn("want", F.col("mass") - F.col("fixed_mass")).select(*direct.columns)
        direct = direct.unionByName(swap)
    m = range_join(rows, direct, [], F.col("delta") - tol, F.col("delta") + tol, "want", 2.0, small_right=True)
    nt, prot = F.col("term").isin("n_term", "protein_n_term"), F.col("term").isin("protein_n_term", "protein_c_term")
    fits = F.when(F.col("term") == "anywhere", F.col("origin") == F.col("residue")).otherwise(
        (F.col("kind") == F.when(nt, "N").otherwise("C")) & (~prot | F.col("protein_term"))
        & ((F.col("origin") == "X") | (F.col("origin") == F.col("residue"))))
    label = F.when(F.col("term") == "anywhere", F.col("residue")).otherwise(F.concat(
        F.when(prot, "Protein ").otherwise(""), F.when(nt, "N-term").otherwise("C-term"),
        F.when(F.col("origin") != "X", F.concat(F.lit(" "), "origin")).otherwise("")))
    m = m.filter(fits).withColumn("site", label).withColumn("error", F.col("delta") - F.col("want"))
    per = m.groupBy("row_id", "acc", "fixed", "site").agg(F.sum("support").alias("s"),
        F.min_by(F.struct("name", "error", "label", "origin", "term"), F.struct(F.abs("error"), "name")).alias("b"))
    g = per.groupBy("row_id", "acc", "fixed").agg(
        F.sum("s").alias("support"), F.min_by("b", F.struct(F.abs(F.col("b.error")), F.col("b.name"))).alias("b"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("n"), "site"))), lambda x: x.site), "/").alias("sites"))
    w = W.partitionBy("row_id").orderBy(F.desc("support"), F.round(F.abs(F.col("b.error")), 9), "acc", "fixed")
    g = g.withColumn("ord", F.row_number().over(w))
    g = g.filter(F.col("ord") <= cap) if cap else g
    return g.select("row_id", "ord", "acc", "b.name", "fixed", "sites", "support", "b.error", "b.label", "b.origin", "b.term")


def isotope_reading(rows: DataFrame, names: DataFrame, tol: float) -> DataFrame:
    """Adds ``isotope_k`` and ``isotope_err``: nearest one or two 13C steps, unless a residue-specific
    name with half the support explains the shift better; only for rows mostly on the precursor flank."""
    e1, e2 = F.col("delta") - C13, F.col("delta") - 2 * C13
    k = F.when((F.abs(e1) <= tol) & ((F.abs(e1) <= F.abs(e2)) | (F.abs(e2) > tol)), 1).when(F.abs(e2) <= tol, 2)
    r = rows.withColumn("isotope_k", k).withColumn("isotope_err", F.when(k == 1, e1).when(k == 2, e2))
    r = r.withColumn("isotope_k", F.when(2 * F.col("precursor_flank") >= F.col("spectra"), F.col("isotope_k")))
    n = names.filter(~F.col("label") & (F.col("origin") != "X")).select("row_id", F.abs("error").alias("_e"), F.col("support").alias("_s"))
    better = r.select("row_id", "isotope_err", "localized").join(n, "row_id").filter(
        (F.col("_e") < F.abs("isotope_err")) & (2 * F.col("_s") >= F.col("localized")) & (F.col("_s") > 0)).select("row_id").distinct()
    r = r.join(better.withColumn("_b", F.lit(True)), "row_id", "left")
    keep = F.col("_b").isNull() & F.col("isotope_k").isNotNull()
    return r.withColumn("isotope_k", F.when(keep, F.col("isotope_k"))).withColumn(
        "isotope_err", F.when(keep, F.col("isotope_err"))).drop("_b")


def observation_class(samples: DataFrame, tol: float, fixed: dict[str, float] | None = None) -> DataFrame:
    """Adds ``obs_class``, the first fitting explanation of a gap.

    ``samples``: delta, region, localized, site_residue, beyond and inside (arrays of masses outside and
    inside the window's ends), precursor_flank, name_term and name_fixed (best catalogue name), interp.
    """
    d = F.col("delta")
    near = lambda m: F.abs(d - m) <= tol
    loss = F.lit(False)
    for r, m in (fixed or {}).items():
        on = F.contains(F.translate("region", "I", "L"), F.lit(r.replace("I", "L")))
        loss = loss | (on & (~F.col("localized") | F.col("site_residue").isNull() | (F.col("site_residue") == r)) & near(-m))
    any_near = lambda ms: F.exists(F.array(*[F.lit(m) for m in ms]), near)
    iso = F.col("precursor_flank") & ((near(C13) & (F.abs(d - C13) < F.abs(d - DEAMIDATION))) | near(2 * C13))
    named = F.col("name_term").isNotNull()
    c = (F.when(F.abs(d) <= 1e-6, "-").when(F.col("localized") & loss, "fixed_loss")
         .when(F.exists("beyond", near), "extension").when(F.exists("inside", lambda m: near(-m)), "truncation")
         .when(any_near([m for _, m in ADDUCTS]), "adduct").when(iso, "isotope")
         .when(any_near([m for _, m in LOSSES]), "loss").when(loss, "fixed_loss")
         .when(named & (F.coalesce("name_fixed", F.lit("")) != ""), "fixed_replacement")
         .when(named & (F.col("name_term") == "anywhere"), "residue").when(named, "terminal")
         .when(F.startswith("interp", F.lit("sub:")), "substitution").otherwise("unknown"))
    return samples.withColumn("obs_class", c)


def _mod_pairs(spark) -> DataFrame:
    """Sums of two common modifications: a fixed table of 66 rows."""
    rows = [(f"{a}+{b}", a, b, x + y) for i, (a, x) in enumerate(COMMON_MODS) for b, y in COMMON_MODS[i:]]
    return spark.createDataFrame(rows, "member string, part_a string, part_b string, pair_mass double")


def isobar_class(rows: DataFrame, names: DataFrame, iso_tol: float) -> DataFrame:
    """(row_id, isobars): names, substitutions on the row's residues and two-modification sums of the
    best name's mass. ``rows``: row_id, delta, residues (array); ``names`` ordered matches."""
    spark = rows.sparkSession
    nm = names.filter(~F.col("label"))
    best = nm.groupBy("row_id").agg(F.min_by("error", "ord").alias("best_err"))
    b = rows.join(best, "row_id").withColumn("_m", F.col("delta") - F.col("best_err"))
    same = nm.join(best, "row_id").filter(F.abs(F.col("error") - F.col("best_err")) <= iso_tol).select("row_id", F.col("name").alias("member"))
    subs = spark.createDataFrame([(x, f"{x}->{y}", K.RESIDUES[y] - K.RESIDUES[x]) for x in K.RESIDUES for y in K.RESIDUES if x != y],
                                 "x string, member string, delta_xy double")
    sub = range_join(b.select("row_id", "_m", F.explode("residues").alias("_x")), subs, [], F.col("_m") - iso_tol, F.col("_m") + iso_tol,
                     "delta_xy", 2.0, small_right=True).filter("_x = x").select("row_id", "member")
    two = range_join(b.select("row_id", "_m"), _mod_pairs(spark), [], F.col("_m") - iso_tol, F.col("_m") + iso_tol, "pair_mass", 2.0,
                     small_right=True).select("row_id", "member")
    m = same.unionByName(sub).unionByName(two).distinct().groupBy("row_id").agg(F.array_sort(F.collect_list("member")).alias("l"))
    return m.filter(F.size("l") > 1).select("row_id", F.array_join("l", "=").alias("isobars"))


def site_combination(rows: DataFrame, names: DataFrame, entries: DataFrame, iso_tol: float) -> DataFrame:
    """(row_id, combination): a sum of two common modifications that both fit the best localized site,
    one of them residue-specific, where the best name does not already explain the residue.

    ``rows``: row_id, delta, residue (best site), kind.
    """
    nm = names.filter(~F.col("label")).groupBy("row_id").agg(F.min_by(F.struct("error", "origin", "name"), "ord").alias("b"))
    r = rows.join(nm, "row_id").filter(F.col("b.origin") != F.col("residue")).filter(~F.col("b.name").isin([n for n, _ in COMMON_MODS]))
    r = r.withColumn("_m", F.col("delta") - F.col("b.error"))
    pair = range_join(r, _mod_pairs(rows.sparkSession), [], F.col("_m") - iso_tol, F.col("_m") + iso_tol, "pair_mass", 2.0, small_right=True)
    ent = entries.filter(~F.col("label")).select(F.col("name").alias("_n"), "origin", "term")
    def fit(df, part):
        e = F.broadcast(ent.withColumnRenamed("_n", part))
        j = df.join(e, part)
        nt = F.col("term").isin("n_term", "protein_n_term")
        ok = ((F.col("term") == "anywhere") & (F.col("origin") == F.col("residue"))) | (
            (F.col("term") != "anywhere") & (F.col("kind") == F.when(nt, "N").otherwise("C")) & F.col("origin").isin("X") | (
                (F.col("term") != "anywhere") & (F.col("kind") == F.when(nt, "N").otherwise("C")) & (F.col("origin") == F.col("residue"))))
        return j.filter(ok).groupBy("row_id", "member").agg(F.max((F.col("origin") == F.col("residue")).cast("int")).alias(f"spec_{part}"))
    a, b = fit(pair, "part_a"), fit(pair, "part_b")
    hit = a.join(b, ["row_id", "member"]).filter("spec_part_a = 1 OR spec_part_b = 1")
    return hit.groupBy("row_id").agg(F.min("member").alias("combination"))


def delta_spectra(samples: DataFrame, groups: DataFrame, width: float = BIN) -> DataFrame:
    """Every sample with the histogram row (center) its bin belongs to."""
    s = samples.withColumn("bin", F.round(F.col("delta") / width).cast("long"))
    return s.join(groups.select("run_id", "bin", "center"), ["run_id", "bin"], "left")


def delta_counts(samples: DataFrame) -> DataFrame:
    """Funnel per run: tagged, placed, exact, then the localisation classes, from per-spectrum flags."""
    classes = ["terminal", "fragment", "sequence", "ambiguous", "unlocalized"]
    return samples.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("tagged"), F.count_if(F.col("placed")).alias("placed"),
        F.count_if(F.col("placed") & (F.abs("delta") <= 1e-6)).alias("exact"), F.count_if(F.col("placed") & (F.abs("delta") > 1e-6)).alias("region"),
        *[F.count_if(F.col("placed") & (F.col("loc_class") == c)).alias(c) for c in classes],
        F.count_if(F.col("placed") & F.col("charge_assumed")).alias("assumed"))


def gap_peaks(hist: DataFrame, tol: float, min_spectra: int = 5, min_share: float = 0.001) -> DataFrame:
    """(run_id, seed, delta, spectra): greedy peaks of a shift histogram (run_id, delta, spectra).

    A peak sums the unclaimed rows within ``tol`` of its top row; its position is the weighted mean.
    Small peaks and those within 2 tol of zero (calibration offsets) are dropped.
    """
    h = hist.groupBy("run_id", "delta").agg(F.sum("spectra").alias("spectra"))
    placed = h.groupBy("run_id").agg(F.sum("spectra").alias("placed"))
    c = greedy_claim(h, ["run_id"], "delta", "spectra", tol, F.abs("delta") > tol, 1e6).filter("seed IS NOT NULL")
    p = c.groupBy("run_id", "seed").agg(F.sum("spectra").alias("spectra"), (F.sum(F.col("delta") * F.col("spectra")) / F.sum("spectra")).alias("delta"))
    thr = F.greatest(F.lit(float(min_spectra)), F.col("placed") * min_share)
    return p.join(placed, "run_id").filter((F.col("spectra") >= thr) & (F.abs("delta") > 2 * tol)).select("run_id", "seed", "delta", "spectra")


def mod_combinations(mods: DataFrame, max_mods: int = 3) -> DataFrame:
    """(members, n_mods, mass, prior): multisets of 1..max_mods of a modification list.

    ``mods``: name, mass, prior. The list is a parameter of tens of rows; its triples stay in the thousands.
    """
    one = mods.select(F.array("name").alias("members"), F.col("name").alias("last"), F.lit(1).alias("n_mods"), "mass", "prior")
    out, cur = one, one
    nxt = F.broadcast(mods.select(F.col("name").alias("_n"), F.col("mass").alias("_m"), F.col("prior").alias("_p")))
    for k in range(2, max_mods + 1):
        cur = cur.join(nxt, F.col("_n") >= F.col("last")).select(
            F.concat("members", F.array("_n")).alias("members"), F.col("_n").alias("last"), F.lit(k).alias("n_mods"),
            (F.col("mass") + F.col("_m")).alias("mass"), (F.col("prior") * F.col("_p")).alias("prior"))
        out = out.unionByName(cur)
    return out.drop("last")


def explain(peaks: DataFrame, combos: DataFrame, tol: float) -> DataFrame:
    """Peaks with ``members``: fewest modifications, then prior, then error; among equally long readings
    one whose members are seen alone wins, and triples need every member seen alone."""
    c = combos.select("members", "n_mods", F.col("mass").alias("combo_mass"), "prior")
    j = range_join(peaks, c, [], F.col("delta") - tol, F.col("delta") + tol, "combo_mass", 2.0, small_right=True)
    w = W.partitionBy("run_id", "seed").orderBy("n_mods", F.desc("prior"), F.round(F.abs(F.col("combo_mass") - F.col("delta")), 9), F.col("members"))
    j = j.withColumn("ord", F.row_number().over(w)).filter("ord <= 8")
    first = j.filter("ord = 1")
    alone = first.filter("n_mods = 1").select("run_id", F.get("members", F.lit(0)).alias("m"), "spectra").groupBy("run_id", "m").agg(F.sum("spectra").alias("alone"))
    lead = first.select("run_id", "seed", F.col("n_mods").alias("lead_n"))
    cand = j.join(lead, ["run_id", "seed"]).filter("n_mods = lead_n")
    sc = cand.select("run_id", "seed", "ord", F.explode("members").alias("m")).join(alone, ["run_id", "m"], "left").groupBy("run_id", "seed", "ord").agg(
        F.min(F.coalesce("alone", F.lit(0))).alias("seen"))
    cand = cand.join(sc, ["run_id", "seed", "ord"])
    best = F.row_number().over(W.partitionBy("run_id", "seed").orderBy(F.when(F.col("n_mods") >= 2, -F.col("seen")).otherwise(0), "ord"))
    cand = cand.withColumn("_r", best).filter("_r = 1")
    ok = (F.col("n_mods") < 3) | (F.col("seen") > 0)
    won = cand.select("run_id", "seed", F.when(ok, F.col("members")).alias("members"))
    return peaks.join(won, ["run_id", "seed"], "left")


def gap_shares(explained: DataFrame, hist: DataFrame, tol: float) -> DataFrame:
    """(run_id, name, share): shifted spectra explained by each modification."""
    shifted = hist.groupBy("run_id").agg(F.sum(F.when(F.abs("delta") > 2 * tol, F.col("spectra")).otherwise(0)).alias("shifted"))
    e = explained.filter("members IS NOT NULL").select("run_id", "spectra", F.explode("members").alias("name"))
    return e.groupBy("run_id", "name").agg(F.sum("spectra").alias("s")).join(shifted, "run_id").select(
        "run_id", "name", (F.col("s") / F.greatest(F.col("shifted"), F.lit(1))).alias("share"), "shifted")


def silac_call(shares: DataFrame, min_share: float = 0.01, min_shifted: int = 100) -> DataFrame:
    """(run_id, silac): heavy-label call from the shares of the four label modifications."""
    g = shares.groupBy("run_id").agg(F.max("shifted").alias("shifted"), *[
        F.max(F.when((F.col("name") == m) & (F.col("share") >= min_share), 1).otherwise(0)).alias(f"s{i}") for i, m in enumerate(SILAC_MODS)])
    med, heavy = F.col("s0") + F.col("s1") > 0, F.col("s2") + F.col("s3") > 0
    enough = (F.col("s0") + F.col("s1") + F.col("s2") + F.col("s3") >= 2) & (F.greatest(F.col("shifted"), F.lit(1)) >= min_shifted)
    return g.select("run_id", F.when(~enough, "none").when(med & heavy, "SILAC triplex (Lys4/Arg6, Lys8/Arg10)")
                    .when(heavy, "SILAC (Lys8/Arg10)").otherwise("SILAC (Lys4/Arg6)").alias("silac"))
