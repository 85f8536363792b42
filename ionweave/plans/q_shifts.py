"""Queries over the mass-shift survey."""
from __future__ import annotations

from pyspark.sql import functions as F

from ionweave.operators import shifts as M
from ionweave.plans import views as V
from ionweave.plans.registry import query

BW = 0.01
Q_HIST = "SELECT run_id, CAST(round(delta / 0.01) AS BIGINT) AS bin, interp, count(*) AS n FROM d GROUP BY 1, 2, 3"
Q_BINS = "SELECT run_id, bin, sum(n) AS n FROM h GROUP BY 1, 2"
BASE = dict(d=V.Q_DELTAS, h=Q_HIST, b=Q_BINS)
Q_TOPS = ("SELECT b.*, coalesce(l.n, 0) AS nl, coalesce(r.n, 0) AS nh FROM b LEFT JOIN b l ON l.run_id = b.run_id AND l.bin = b.bin - 1 LEFT JOIN b r ON r.run_id = b.run_id AND r.bin = b.bin + 1")
Q_GROUPS = ("SELECT x.run_id, x.bin, x.n, CASE WHEN x.n >= x.nl AND x.n >= x.nh THEN x.bin WHEN l.n >= l.nl AND l.n >= l.nh AND x.n < l.n THEN x.bin - 1 WHEN r.n >= r.nl AND r.n >= r.nh AND x.n < r.n THEN x.bin + 1 END AS center "
            "FROM tp x LEFT JOIN tp l ON l.run_id = x.run_id AND l.bin = x.bin - 1 LEFT JOIN tp r ON r.run_id = x.run_id AND r.bin = x.bin + 1")
GROUPS = dict(**BASE, tp=Q_TOPS, g0=Q_GROUPS, g="SELECT * FROM g0 WHERE center IS NOT NULL")


def _hist(spark, sf):
    return M.delta_histogram(V.deltas(spark, sf), BW)


def _bins(spark, sf):
    return _hist(spark, sf).groupBy("run_id", "bin").agg(F.sum("n").alias("n"))


@query("M1_delta_histogram", V.cte(**BASE) + "SELECT run_id, bin, interp, n FROM h")
def m1(spark, sf):
    return _hist(spark, sf)


@query("M2_group_bins", V.cte(**GROUPS) + "SELECT run_id, bin, n, center FROM g")
def m2(spark, sf):
    return M.group_bins(_bins(spark, sf))


@query("M2_group_bins_greedy")
def m2b(spark, sf):
    return M.group_bins(_bins(spark, sf), 3)


@query("M3_top_interpretations", V.cte(**BASE, r="SELECT *, row_number() OVER (PARTITION BY run_id, bin ORDER BY n DESC, interp) AS r FROM h") +
       "SELECT run_id, bin, string_agg(interp || ':' || n, ';' ORDER BY r) AS top_interps FROM r WHERE r <= 2 GROUP BY 1, 2")
def m3(spark, sf):
    return M.top_interpretations(_hist(spark, sf), ["run_id", "bin"], 2)


@query("M4_loc_class", "SELECT CASE WHEN l_linenumber % 3 = 2 OR abs(l_tax) <= 1e-6 THEN 'none' WHEN l_suppkey % 11 >= 8 THEN 'unlocalized' WHEN l_partkey % 4 = 0 THEN 'sequence' WHEN l_quantity >= 30 THEN 'fragment' WHEN l_quantity >= 1 THEN 'ambiguous' ELSE 'unlocalized' END AS loc_class, "
       "CASE WHEN l_returnflag = 'R' THEN l_linestatus ELSE CASE WHEN l_suppkey % 2 = 0 THEN 'Protein ' ELSE '' END || CASE WHEN l_returnflag = 'N' THEN 'N-term|' ELSE 'C-term|' END || l_linestatus END AS site, count(*) AS n FROM lineitem GROUP BY 1, 2")
def m4(spark, sf):
    t = V.table(spark, sf, "lineitem")
    c = M.loc_class(F.lit(1), 2 - F.when(F.col("l_linenumber") % 3 == 2, 2).otherwise(0), F.col("l_tax"), F.col("l_suppkey") % 11, F.lit(8), F.col("l_partkey") % 4, F.col("l_quantity"), 30)
    s = M.site_key(F.when(F.col("l_returnflag") == "A", "C").otherwise(F.col("l_returnflag")), F.col("l_linestatus"), F.col("l_suppkey") % 2 == 0)
    return t.groupBy(c.alias("loc_class"), s.alias("site")).agg(F.count(F.lit(1)).alias("n"))


# A small modification catalogue for the queries (masses scaled to the range of the shifts).
ENTRIES = [("UNIMOD:1", "Acetyl", "X", "n_term", 2.05, False), ("UNIMOD:2", "Amidated", "X", "c_term", 3.0, False),
           ("UNIMOD:35", "Oxidation", "O", "anywhere", 4.03, False), ("UNIMOD:21", "Phospho", "F", "anywhere", 5.02, False),
           ("UNIMOD:28", "GlnToPyro", "F", "n_term", 1.04, False), ("UNIMOD:34", "Methyl", "O", "anywhere", 4.01, False),
           ("UNIMOD:188", "Heavy", "O", "anywhere", 6.02, True), ("UNIMOD:36", "Dimethyl", "X", "protein_n_term", 7.0, False)]
E_SCHEMA = "acc string, name string, origin string, term string, mass double, label boolean"


def _rows(spark, sf):
    """Survey rows with their sites: one row per bin, site and side of the window."""
    d = V.table(spark, sf, "lineitem").selectExpr("l_orderkey % 4 AS run_id", "CAST(round((l_tax * 100 + l_discount) / 0.01) AS BIGINT) AS bin", "l_linestatus AS residue",
                                                  "CASE l_returnflag WHEN 'A' THEN 'N' WHEN 'N' THEN 'C' ELSE 'R' END AS kind", "l_suppkey % 2 = 0 AS protein_term")
    g = d.groupBy("run_id", "bin", "residue", "kind", "protein_term").agg(F.count(F.lit(1)).alias("support"))
    return g.withColumn("row_id", F.struct("run_id", "bin")).withColumn("delta", F.col("bin") * 0.01)


def _names(spark, sf, cap=3):
    fixed = spark.createDataFrame([("O", "Label", 1.5)], "residue string, fixed string, fixed_mass double")
    return M.match_catalogue(_rows(spark, sf), spark.createDataFrame(ENTRIES, E_SCHEMA), fixed, 0.025, cap)


@query("M5_match_catalogue")
def m5(spark, sf):
    return _names(spark, sf).select("row_id.run_id", "row_id.bin", "ord", "acc", "name", "fixed", "sites", "support", F.round("error", 6).alias("error"))


def _survey_rows(spark, sf):
    d = V.deltas(spark, sf).withColumn("bin", F.round(F.col("delta") / BW).cast("long"))
    g = d.groupBy("run_id", "bin").agg(F.count(F.lit(1)).alias("spectra"), F.count_if(F.col("site") == "O").alias("localized"), F.count_if(F.col("interp") != "A").alias("precursor_flank"),
                                       F.array_sort(F.collect_set("site")).alias("residues"))
    return g.withColumn("row_id", F.struct("run_id", "bin")).withColumn("delta", F.col("bin") * BW)


@query("M6_isotope_reading", V.cte(**BASE, s="SELECT run_id, CAST(round(delta / 0.01) AS BIGINT) AS bin, count(*) AS spectra, sum(CASE WHEN interp <> 'A' THEN 1 ELSE 0 END) AS pf FROM d GROUP BY 1, 2",
       e="SELECT *, bin * 0.01 - 1.00335483 AS e1, bin * 0.01 - 2 * 1.00335483 AS e2 FROM s") +
       "SELECT run_id, bin, CASE WHEN 2 * pf >= spectra THEN CASE WHEN abs(e1) <= 0.045 AND (abs(e1) <= abs(e2) OR abs(e2) > 0.045) THEN 1 WHEN abs(e2) <= 0.045 THEN 2 END END AS isotope_k FROM e")
def m6(spark, sf):
    none = _names(spark, sf).filter("name = 'Oxidation'")
    return M.isotope_reading(_survey_rows(spark, sf), none, 0.045).select("run_id", "bin", "isotope_k")


@query("M7_observation_class")
def m7(spark, sf):
    best = _names(spark, sf, 1).select("row_id", F.col("term").alias("name_term"), F.col("fixed").alias("name_fixed"))
    s = V.table(spark, sf, "lineitem").selectExpr("l_orderkey % 4 AS run_id", "CAST(round((l_tax * 100 + l_discount) / 0.01) AS BIGINT) AS bin", "l_tax * 100 + l_discount - l_linenumber * 9 AS delta", "concat('ACM', l_linestatus) AS region",
        "l_quantity > 25 AS localized", "l_linestatus AS site_residue", "array(2.06D, 5.08D) AS beyond", "array(8.03D, 17.5D) AS inside", "l_returnflag <> 'A' AS precursor_flank", "CASE WHEN l_suppkey % 2 = 0 THEN 'sub:A->G' ELSE '?' END AS interp")
    s = s.withColumn("row_id", F.struct("run_id", "bin")).join(best, "row_id", "left")
    return M.observation_class(s, 0.02, {"C": 17.95}).groupBy("run_id", "obs_class").agg(F.count(F.lit(1)).alias("n"))


@query("M8_isobar_class")
def m8(spark, sf):
    return M.isobar_class(_survey_rows(spark, sf), _names(spark, sf), 0.03).select("row_id.run_id", "row_id.bin", "isobars")


@query("M9_site_combination")
def m9(spark, sf):
    rows = _rows(spark, sf)
    top = rows.groupBy("row_id").agg(F.first("delta").alias("delta"), F.max_by(F.struct("residue", "kind"), F.struct("support", "residue", "kind")).alias("t")).select("row_id", "delta", "t.residue", "t.kind")
    ent = spark.createDataFrame(ENTRIES + [(f"C:{i}", n, "O" if i % 2 else "X", "anywhere" if i % 2 else "n_term", m, False) for i, (n, m) in enumerate(M.COMMON_MODS)], E_SCHEMA)
    return M.site_combination(top, _names(spark, sf), ent, 6.0).select("row_id.run_id", "row_id.bin", "combination")


@query("M10_delta_spectra", V.cte(**GROUPS, s="SELECT d.*, CAST(round(delta / 0.01) AS BIGINT) AS bin FROM d") + "SELECT s.run_id, s.bin, g.center, s.site, count(*) AS n FROM s LEFT JOIN g ON s.run_id = g.run_id AND s.bin = g.bin GROUP BY 1, 2, 3, 4")
def m10(spark, sf):
    g = M.group_bins(_bins(spark, sf))
    return M.delta_spectra(V.deltas(spark, sf), g, BW).groupBy("run_id", "bin", "center", "site").agg(F.count(F.lit(1)).alias("n"))


FUN = ["l_orderkey % 4 AS run_id", "l_tax * 100 AS delta", "l_returnflag <> 'A' AS placed", "CASE l_linenumber WHEN 1 THEN 'terminal' WHEN 2 THEN 'fragment' WHEN 3 THEN 'sequence' WHEN 4 THEN 'ambiguous' ELSE 'unlocalized' END AS loc_class", "l_discount > 0.05 AS charge_assumed"]


@query("M11_delta_counts", V.cte(s="SELECT " + ", ".join(FUN) + " FROM lineitem") + "SELECT run_id, count(*) AS tagged, count(*) FILTER (placed) AS placed, count(*) FILTER (placed AND abs(delta) <= 1e-6) AS exact, count(*) FILTER (placed AND abs(delta) > 1e-6) AS region, "
       + ", ".join(f"count(*) FILTER (placed AND loc_class = '{c}') AS {c}" for c in ("terminal", "fragment", "sequence", "ambiguous", "unlocalized")) + ", count(*) FILTER (placed AND charge_assumed) AS assumed FROM s GROUP BY 1")
def m11(spark, sf):
    return M.delta_counts(V.table(spark, sf, "lineitem").selectExpr(*FUN))


def _shift_hist(spark, sf):
    return V.deltas(spark, sf).groupBy("run_id", F.round("delta", 2).alias("delta")).agg(F.count(F.lit(1)).alias("spectra"))


def _peaks(spark, sf):
    return M.gap_peaks(_shift_hist(spark, sf), 0.035, 5, 0.001)


@query("M12_gap_peaks", V.cte(d=V.Q_DELTAS, h="SELECT run_id, CAST(round(delta, 2) * 100 AS BIGINT) AS b, round(delta, 2) AS delta, count(*) AS spectra FROM d GROUP BY 1, 2, 3", hr="SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY spectra DESC, delta) AS r, count(*) OVER (PARTITION BY run_id) AS m FROM h WHERE abs(delta) > 0.035",
       walk="SELECT run_id, 0::BIGINT AS r, max(m) AS m, []::BIGINT[] AS seeds FROM hr GROUP BY 1 UNION ALL SELECT w.run_id, w.r + 1, w.m, CASE WHEN len(list_filter(w.seeds, lambda s: abs(s - x.b) <= 3)) = 0 THEN list_append(w.seeds, x.b) ELSE w.seeds END FROM walk w JOIN hr x ON x.run_id = w.run_id AND x.r = w.r + 1",
       sd="SELECT run_id, unnest(seeds) AS b FROM walk WHERE r = m", cl="SELECT h.*, (SELECT s.b FROM sd s JOIN hr q ON q.run_id = s.run_id AND q.b = s.b WHERE s.run_id = h.run_id AND abs(s.b - h.b) <= 3 ORDER BY q.r LIMIT 1) AS seed FROM h",
       p="SELECT run_id, seed, sum(spectra) AS spectra, sum(delta * spectra) / sum(spectra) AS delta FROM cl WHERE seed IS NOT NULL GROUP BY 1, 2") +
       "SELECT run_id, round(delta, 6) AS delta, spectra FROM p JOIN (SELECT run_id, sum(spectra) AS placed FROM h GROUP BY 1) USING (run_id) WHERE abs(delta) > 0.07 AND spectra >= greatest(5, 0.001 * placed)")
def m12(spark, sf):
    return _peaks(spark, sf).select("run_id", F.round("delta", 6).alias("delta"), "spectra")


# Gap modifications for the queries (name, mass, prior).
GAP_MODS = [("Label:13C(6)", 1.02, 0.2), ("Label:13C(6)15N(2)", 2.05, 0.3), ("Oxidation", 3.01, 0.5), ("Phospho", 4.98, 0.1), ("Methyl", 1.99, 0.15)]


def _explained(spark, sf):
    mods = spark.createDataFrame(GAP_MODS, "name string, mass double, prior double")
    return M.explain(_peaks(spark, sf), M.mod_combinations(mods, 3), 0.05)


@query("M13_explain")
def m13(spark, sf):
    return _explained(spark, sf).select("run_id", F.round("delta", 6).alias("delta"), "spectra", F.array_join("members", "+").alias("members"))


@query("M14_gap_shares")
def m14(spark, sf):
    s = M.gap_shares(_explained(spark, sf), _shift_hist(spark, sf), 0.035)
    call = M.silac_call(s, 0.01, 100)
    return s.join(call, "run_id").select("run_id", "name", F.round("share", 6).alias("share"), "silac")
