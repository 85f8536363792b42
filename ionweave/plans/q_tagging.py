"""Queries over filters, tagging, scoring, ranking and precursor hypotheses."""
from __future__ import annotations

from pyspark.sql import functions as F

from ionweave.functions import constants as K, scalar as S, stats
from ionweave.operators import filters, ranking, scoring, tagging as T
from ionweave.operators.core import join_values
from ionweave.plans import tag_run, views as V
from ionweave.plans.registry import query
from ionweave.session import materialize

KEY = ["run_id", "idx"]
PARAMS = T.TagParams(frag_tol=0.3, tol_ppm=False, complement_tol=0.3)
GAPPED = T.TagParams(frag_tol=0.3, tol_ppm=False, complement_tol=0.3, max_gaps=1, max_extension=1)

# ------------------------------------------------------------------ shared checking SQL
PROTON, WATER = K.PROTON, K.WATER
Q_SPEC = ("SELECT *, CASE WHEN charge > 0 THEN charge ELSE 2 END AS charge_used FROM spectra")
Q_MASS = (f"SELECT *, precursor_mz * charge_used - charge_used * {PROTON!r} AS mass, "
          "least(8, greatest(1, charge_used - 1)) AS n_z FROM spec")
Q_CLEAN = (f"SELECT p.run_id, p.idx, p.mz, p.intensity, m.mass, m.charge_used, m.n_z FROM peaks p JOIN m USING (run_id, idx) "
           f"WHERE p.intensity > 0 AND p.mz <= m.mass + {PROTON + 1.5!r}")
Q_COLL = ("SELECT run_id, idx, mz, max(intensity) AS intensity, min(mass) AS mass, min(charge_used) AS charge_used, "
          "min(n_z) AS n_z FROM clean GROUP BY run_id, idx, mz")
Q_BUDGET = ("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, idx ORDER BY intensity DESC, mz DESC) AS rk "
            "FROM coll) WHERE rk <= 100")
Q_PREP = ("SELECT *, row_number() OVER (PARTITION BY run_id, idx ORDER BY mz) AS p, count(*) OVER (PARTITION BY run_id, idx) "
          "AS n_kept FROM budget")
Q_ZPREP = "SELECT p.*, z FROM prep p, (SELECT unnest(range(1, 9)) AS z) zz WHERE z <= n_z"
ALPHABET = [(r, r, m) for r, m in K.residue_rows({"C": K.CARBAMIDOMETHYL})]
Q_ALPHA = V.literal(ALPHABET, "residue, base, step")
Q_EDGE = ("SELECT * FROM (SELECT a.run_id, a.idx, a.z, a.p AS pa, b.p AS pb, a.mz AS mz_a, b.mz AS mz_b, a.rk AS rk_a, b.rk AS rk_b, "
          "r.residue, r.step, abs(b.mz - (a.mz + r.step / a.z)) AS err, row_number() OVER (PARTITION BY a.run_id, a.idx, a.z, a.p, "
          "r.residue ORDER BY abs(b.mz - (a.mz + r.step / a.z)), b.mz) AS rn FROM zprep a CROSS JOIN alpha r JOIN prep b ON "
          "a.run_id = b.run_id AND a.idx = b.idx AND abs(b.mz - (a.mz + r.step / a.z)) <= 0.3) WHERE rn = 1 AND pb > pa")
PIPE = dict(peaks=V.Q_PEAKS, spectra=V.Q_SPECTRA, spec=Q_SPEC, m=Q_MASS, clean=Q_CLEAN, coll=Q_COLL, budget=Q_BUDGET,
            prep=Q_PREP, zprep=Q_ZPREP, alpha=Q_ALPHA, edge=Q_EDGE)


def pipe(last: str, **more) -> str:
    keys = list(PIPE)
    return V.cte(**{k: PIPE[k] for k in keys[: keys.index(last) + 1]}, **more)


def _clean(spark, sf):
    return filters.clean_peaks(V.peaks(spark, sf), V.spectra(spark, sf))


def _budget(spark, sf):
    return T.number_peaks(T.peak_budget(filters.collapse_equal_mz(_clean(spark, sf)), 0, 100))


def _prepared(spark, sf, params=PARAMS):
    return T.prepared_peaks(V.peaks(spark, sf), V.spectra(spark, sf), params)


def _edges(spark, sf, params=PARAMS):
    return T.residue_edges(materialize(_prepared(spark, sf, params)), T.alphabet(spark, params), params)


# ------------------------------------------------------------------ filters
@query("P1_taggable", V.cte(s=V.Q_SPECTRA, n="SELECT l_partkey AS idx, count(*) AS n_peaks FROM lineitem GROUP BY 1", j=
       "SELECT s.run_id, CASE WHEN s.charge = 4 THEN 1 ELSE 2 END AS ms_level, coalesce(n.n_peaks, 0) AS n_peaks, "
       "CASE WHEN s.charge = 0 THEN NULL ELSE s.precursor_mz END AS precursor_mz FROM s LEFT JOIN n USING (idx)") +
       "SELECT run_id, CASE WHEN ms_level <> 2 THEN 'other_level' WHEN n_peaks = 0 THEN 'no_peaks' WHEN precursor_mz IS NULL "
       "THEN 'no_precursor' ELSE 'taggable' END AS reason, count(*) AS n FROM j GROUP BY 1, 2")
def p1(spark, sf):
    s, p = V.spectra(spark, sf), V.peaks(spark, sf)
    n = p.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_peaks"))
    s = s.join(n, KEY, "left").withColumn("n_peaks", F.coalesce("n_peaks", F.lit(0)))
    s = s.withColumn("ms_level", F.when(F.col("charge") == 4, 1).otherwise(2)).withColumn(
        "precursor_mz", F.when(F.col("charge") != 0, F.col("precursor_mz")))
    return filters.taggable(s).groupBy("run_id", F.coalesce("reason", F.lit("taggable")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("P2_clean_peaks", pipe("clean") + "SELECT run_id, idx, round(mz, 6) AS mz, intensity FROM clean")
def p2(spark, sf):
    return _clean(spark, sf).select(*KEY, F.round("mz", 6).alias("mz"), "intensity")


@query("P3_etd_precursor_filter", pipe("clean") +
       f"SELECT run_id, idx, count(*) AS n, round(sum(mz), 4) AS s FROM clean c WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(range(1, 9)) AS k) "
       f"WHERE k <= c.charge_used AND c.mz BETWEEN (c.mass + c.charge_used * {PROTON!r}) / k - {K.HYDROGEN!r} / k - 0.3 AND "
       f"(c.mass + c.charge_used * {PROTON!r}) / k + 3.0 / k + 0.3) GROUP BY 1, 2")
def p3(spark, sf):
    x = filters.etd_precursor_filter(_clean(spark, sf), 0.3, False)
    return x.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("mz"), 4).alias("s"))


@query("P4_collapse_equal_mz", pipe("coll") + "SELECT run_id, idx, round(mz, 6) AS mz, intensity FROM coll")
def p4(spark, sf):
    return filters.collapse_equal_mz(_clean(spark, sf)).select(*KEY, F.round("mz", 6).alias("mz"), "intensity")


# tags with given scores: the rows of the order table under tag column names
TAGS = ["o_custkey % 4 AS run_id", "o_custkey AS idx", "substring(o_orderpriority, 3, 3) AS seq",
        "CAST(o_orderkey % 3 + 1 AS INT) AS charge", "o_totalprice % 700 AS nterm_mass", "o_orderkey % 500 + 0.25E0 AS cterm_mass",
        "o_orderstatus = 'P' AS gapped", "o_totalprice / 5000 AS evalue", "o_orderkey % 900 + 100.5E0 AS low_mz",
        "o_orderkey % 900 + 420.5E0 AS high_mz", "CAST(o_orderkey % 4 + 3 AS INT) AS n_res", "o_orderkey AS tag_id"]
Q_TAGS = "SELECT " + ", ".join(TAGS) + " FROM orders"


def given_tags(spark, sf):
    return V.table(spark, sf, "orders").selectExpr(*TAGS)


@query("P5_evalue_cut", V.cte(t=Q_TAGS) + "SELECT tag_id, round(evalue, 6) AS evalue FROM t WHERE CASE WHEN gapped THEN evalue / 10.0 ELSE evalue END <= 8.0")
def p5(spark, sf):
    return filters.evalue_cut(given_tags(spark, sf), 8.0, 10.0).select("tag_id", F.round("evalue", 6).alias("evalue"))


TMT = ["l_orderkey % 4 AS run_id", "l_orderkey AS idx", "l_linenumber AS tag_id", "l_partkey % 300 + 0.1414 AS nterm_mass",
       "l_suppkey % 200 + 0.1152 AS cterm_mass", "CASE l_returnflag WHEN 'A' THEN 'GSA' WHEN 'N' THEN 'AVG' ELSE 'G[x]LK' END AS seq",
       "1 AS charge", "'by' AS ion_series", "false AS gapped", "l_discount * 12 AS evalue"]


@query("P6_tmt_pseudo_filter", V.cte(t="SELECT " + ", ".join(TMT) + " FROM lineitem") +
       f"SELECT run_id, count(*) AS n, sum(tag_id) AS s FROM t WHERE NOT ((seq[1] = 'G' AND seq[2] <> '[' AND abs(nterm_mass - {229.162932 - K.RESIDUES['G']!r}) <= 0.02) "
       f"OR (seq[1] = 'A' AND abs(nterm_mass - {229.162932 - K.RESIDUES['A']!r}) <= 0.02) OR (seq LIKE '%G' AND abs(cterm_mass - {229.162932 - WATER - K.RESIDUES['G']!r}) <= 0.006) "
       f"OR (seq LIKE '%A' AND abs(cterm_mass - {229.162932 - WATER - K.RESIDUES['A']!r}) <= 0.006) OR "
       + " OR ".join(f"abs(cterm_mass + {WATER + PROTON!r} - {x!r}) <= 0.006" for x in filters.TMT10_REPORTERS) + ") GROUP BY 1")
def p6(spark, sf):
    t = V.table(spark, sf, "lineitem").selectExpr(*TMT)
    return filters.tmt_pseudo_filter(t, reporters=True).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tag_id").alias("s"))


@query("P6_tmt_probe", V.cte(t="SELECT " + ", ".join(TMT) + " FROM lineitem", s=
       "SELECT run_id, idx, " + ", ".join(
           f"max(CASE WHEN abs(nterm_mass - {a!r}) <= 0.02 OR abs(cterm_mass - {b!r}) <= 0.006 THEN 1 ELSE 0 END) AS {n}" for n, a, b in [
               ("tmt_n", 229.162932, 229.162932 - WATER), ("tmt_k", K.RESIDUES["K"] + 229.162932 + WATER, K.RESIDUES["K"] + 229.162932),
               ("pro_n", 304.207146, 304.207146 - WATER), ("pro_k", K.RESIDUES["K"] + 304.207146 + WATER, K.RESIDUES["K"] + 304.207146)])
       + " FROM t WHERE evalue <= 1.0 GROUP BY 1, 2") +
       "SELECT run_id, count(*) AS eligible, sum(tmt_n) AS tmt_n, sum(tmt_k) AS tmt_k, sum(pro_n) AS pro_n, sum(pro_k) AS pro_k FROM s GROUP BY 1")
def p6b(spark, sf):
    t = V.table(spark, sf, "lineitem").selectExpr(*TMT)
    return filters.tmt_probe(t).select("run_id", "eligible", "tmt_n", "tmt_k", "pro_n", "pro_k")


@query("P7_subsample", V.cte(s=V.Q_SPECTRA) + "SELECT run_id, greatest(1, floor(count(*) * 0.25 + 0.5)) AS n FROM s GROUP BY 1")
def p7(spark, sf):
    x = filters.subsample(V.spectra(spark, sf), fraction=0.25, seed=7)
    return x.groupBy("run_id").agg(F.countDistinct("idx").cast("double").alias("n"))


FILTER_TEXT = "CASE p_size % 5 WHEN 0 THEN 'FTMS @hcd30.00' WHEN 1 THEN 'ITMS @etd50.00' WHEN 2 THEN '@ETD50@hcd25.00' WHEN 3 THEN '@ethcd20' ELSE 'Full ms' END"


@query("P8_activation_class", "SELECT p_partkey % 4 AS run_id, CASE p_size % 5 WHEN 0 THEN 'collisional' WHEN 1 THEN 'electron' "
       "WHEN 2 THEN 'hybrid' WHEN 3 THEN 'hybrid' ELSE CASE WHEN p_brand LIKE '%1' THEN 'collisional' ELSE 'unknown' END END AS activation, "
       "count(*) AS n FROM part GROUP BY 1, 2")
def p8(spark, sf):
    s = V.table(spark, sf, "part").selectExpr("p_partkey % 4 AS run_id", f"{FILTER_TEXT} AS f",
                                              "CASE WHEN p_size % 5 = 4 AND p_brand LIKE '%1' THEN array('HCD') END AS m")
    return s.select("run_id", filters.activation_class(F.col("m"), F.col("f")).alias("activation")).groupBy("run_id", "activation").agg(F.count(F.lit(1)).alias("n"))


@query("P9_tolerance_by_analyzer", "SELECT p_partkey AS idx, CASE WHEN p_size % 2 = 0 THEN 0.3 ELSE 20.0 END AS tol, p_size % 2 <> 0 AS ppm FROM part")
def p9(spark, sf):
    s = V.table(spark, sf, "part").selectExpr("p_partkey AS idx", "CASE WHEN p_size % 2 = 0 THEN 'ITMS + c' ELSE p_type END AS a")
    tol, ppm = filters.tolerance_by_analyzer(F.col("a"), 20.0, 0.3)
    return s.select("idx", tol.alias("tol"), ppm.alias("ppm"))


@query("P10_centroid", V.cte(p=V.Q_PEAKS, s=V.Q_SPECTRA, d="SELECT run_id, idx, mz, max(intensity) AS intensity FROM p GROUP BY 1, 2, 3", w=
       "SELECT d.*, s.charge, coalesce(lag(intensity) OVER w, 0) AS l, coalesce(lead(intensity) OVER w, 0) AS r FROM d JOIN s USING (run_id, idx) WINDOW w AS (PARTITION BY run_id, idx ORDER BY mz)")
       + "SELECT run_id, idx, count(*) AS n, round(sum(mz), 4) AS s FROM w WHERE charge <> 1 OR (intensity > l AND intensity >= r AND intensity > 0) GROUP BY 1, 2")
def p10(spark, sf):
    p = V.peaks(spark, sf).groupBy(*KEY, "mz").agg(F.max("intensity").alias("intensity"))
    s = V.spectra(spark, sf).select(*KEY, (F.col("charge") == 1).alias("profile"), F.lit(2).alias("ms_level"), F.lit("columnar").alias("source"))
    return filters.centroid(p, s).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("mz"), 4).alias("s"))


VIEW = ["o_orderpriority AS spectrum", "o_orderkey AS tag", "CAST(o_orderkey % 8 AS INT) AS length", "o_totalprice AS evalue", "o_orderstatus = 'F' AS fasta_hit"]


@query("P11_view", V.cte(v="SELECT " + ", ".join(VIEW) + " FROM orders", f="SELECT *, row_number() OVER (PARTITION BY spectrum ORDER BY evalue, tag, length) AS rn FROM v "
       "WHERE lower(spectrum) LIKE '%low%' OR lower(spectrum) LIKE '%hi%' ") +
       "SELECT spectrum, tag, length, evalue FROM (SELECT *, row_number() OVER (PARTITION BY spectrum ORDER BY evalue, tag, length) AS k FROM v "
       "WHERE lower(spectrum) LIKE '%i%' AND length >= 3 AND evalue <= 200000 AND fasta_hit) WHERE k <= 5")
def p11(spark, sf):
    v = V.table(spark, sf, "orders").selectExpr(*VIEW)
    return filters.view(v, spectrum="I", min_len=3, max_evalue=200000, hit="hit", per_spectrum=5).select("spectrum", "tag", "length", "evalue")


@query("P12_decoy_flag", "SELECT is_decoy, count(*) AS n FROM (SELECT lower(CASE c_nationkey % 5 WHEN 0 THEN 'rev_' || c_name WHEN 1 THEN c_name || '_DECOY' WHEN 2 THEN 'Revenue' || c_name ELSE c_name END) AS a FROM customer) x, "
       "LATERAL (SELECT a LIKE 'rev\\_%' ESCAPE '\\' OR a LIKE '%\\_decoy' ESCAPE '\\' AS is_decoy) GROUP BY 1")
def p12(spark, sf):
    c = V.table(spark, sf, "customer").selectExpr("CASE c_nationkey % 5 WHEN 0 THEN concat('rev_', c_name) WHEN 1 THEN concat(c_name, '_DECOY') WHEN 2 THEN concat('Revenue', c_name) ELSE c_name END AS a")
    return c.groupBy(filters.decoy_flag(F.col("a")).alias("is_decoy")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ tagging
PAIR_SQL = ("SELECT a.residue AS pair_a, b.residue AS pair_b, a.step + b.step AS pair_mass FROM alpha a JOIN alpha b ON a.step < b.step OR (a.step = b.step AND a.residue <= b.residue)")


@query("T1_alphabet", V.cte(peaks=V.Q_PEAKS, alpha=Q_ALPHA, pr=PAIR_SQL, d="SELECT DISTINCT floor(mz) AS m FROM peaks") +
       "SELECT d.m, pair_a, pair_b, round(pair_mass, 5) AS pair_mass FROM d JOIN pr ON floor(pair_mass) = d.m")
def t1(spark, sf):
    pairs = T.residue_pairs(T.alphabet(spark)).withColumn("m", F.floor("pair_mass"))
    d = V.peaks(spark, sf).select(F.floor("mz").alias("m")).distinct()
    return d.join(F.broadcast(pairs), "m").select(F.col("m").cast("double").alias("m"), "pair_a", "pair_b", F.round("pair_mass", 5).alias("pair_mass"))


@query("T2_peak_budget", pipe("coll") + "SELECT run_id, idx, round(mz, 6) AS mz, rk FROM (SELECT *, row_number() OVER (PARTITION BY run_id, idx ORDER BY intensity DESC, mz DESC) AS rk FROM "
       "(SELECT *, row_number() OVER (PARTITION BY run_id, idx, floor(mz / 100) ORDER BY intensity DESC, mz DESC) AS w FROM coll) WHERE w <= 3) WHERE rk <= 20")
def t2(spark, sf):
    return T.peak_budget(filters.collapse_equal_mz(_clean(spark, sf)), 3, 20).select(*KEY, F.round("mz", 6).alias("mz"), "rk")


@query("T3_deisotope")
def t3(spark, sf):
    x = T.deisotope(filters.collapse_equal_mz(_clean(spark, sf)), 0.1, False)
    return x.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("mz"), 3).alias("s"))


@query("T4_residue_edges", pipe("edge") + "SELECT run_id, idx, CAST(z AS INT) AS z, pa, pb, residue, round(err, 6) AS err FROM edge")
def t4(spark, sf):
    return _edges(spark, sf).select(*KEY, "z", F.col("a.p").alias("pa"), F.col("b.p").alias("pb"), "residue", F.round("err", 6).alias("err"))


Q_GAP = ("SELECT run_id, idx, z, pa, pb, pair_a, pair_b, pair_mass FROM (SELECT a.run_id, a.idx, a.z, a.p AS pa, b.p AS pb, p.pair_a, p.pair_b, p.pair_mass, "
         "row_number() OVER (PARTITION BY a.run_id, a.idx, a.z, a.p, b.p ORDER BY abs(p.pair_mass - (b.mz - a.mz) * a.z), round(p.pair_mass, 5), p.pair_a, p.pair_b) AS rn "
         "FROM zprep a JOIN prep b ON a.run_id = b.run_id AND a.idx = b.idx AND b.mz > a.mz JOIN pr p ON abs(p.pair_mass - (b.mz - a.mz) * a.z) <= 0.3 * a.z) g WHERE rn = 1 AND NOT EXISTS "
         "(SELECT 1 FROM edge e1 JOIN edge e2 ON e1.run_id = e2.run_id AND e1.idx = e2.idx AND e1.z = e2.z AND e1.pb = e2.pa WHERE e1.run_id = g.run_id AND e1.idx = g.idx AND e1.z = g.z AND e1.pa = g.pa AND e2.pb = g.pb)")


@query("T5_gap_edges", pipe("edge", pr=PAIR_SQL, gap=Q_GAP) + "SELECT run_id, idx, CAST(z AS INT) AS z, count(*) AS n, sum(pa * 1000 + pb) AS s FROM gap GROUP BY 1, 2, 3")
def t5(spark, sf):
    prep = materialize(_prepared(spark, sf))
    res = T.alphabet(spark, PARAMS)
    e = materialize(T.residue_edges(prep, res, PARAMS))
    g = T.gap_edges(prep, T.residue_pairs(res), e, PARAMS)
    return g.groupBy(*KEY, "z").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("a.p") * 1000 + F.col("b.p")).alias("s"))


Q_WALK = ("SELECT e1.run_id, e1.idx, e1.z, e1.pa AS p1, e1.pb AS p2, e2.pb AS p3, e3.pb AS p4, e3.residue || e2.residue || e1.residue AS seq, "
          "e1.mz_a AS m1, e1.mz_b AS m2, e2.mz_b AS m3, e3.mz_b AS m4, e1.rk_a AS r1, e1.rk_b AS r2, e2.rk_b AS r3, e3.rk_b AS r4, e1.step AS s1, e2.step AS s2, e3.step AS s3 "
          "FROM edge e1 JOIN edge e2 ON e1.run_id = e2.run_id AND e1.idx = e2.idx AND e1.z = e2.z AND e1.pb = e2.pa "
          "JOIN edge e3 ON e2.run_id = e3.run_id AND e2.idx = e3.idx AND e2.z = e3.z AND e2.pb = e3.pa")


@query("T6_walks", pipe("edge", walk=Q_WALK) + "SELECT run_id, idx, CAST(z AS INT) AS z, p1, p2, p3, p4, seq FROM walk")
def t6(spark, sf):
    w = T.walks(materialize(_edges(spark, sf)), None, 3)
    return w.select(*KEY, "z", *[F.element_at("nodes", i).getField("p").alias(f"p{i}") for i in (1, 2, 3, 4)], T.spell("path").alias("seq"))


@query("T7_extend")
def t7(spark, sf):
    e = materialize(_edges(spark, sf))
    x = T.extend(materialize(T.walks(e, None, 3)), e, 2)
    return x.groupBy("run_id", F.size("path").alias("n_res"), "extended").agg(F.count(F.lit(1)).alias("n"))


@query("T8_gap_spellings")
def t8(spark, sf):
    res = T.alphabet(spark, PARAMS)
    x = T.spectrum_paths(materialize(_prepared(spark, sf)), res, T.residue_pairs(res), PARAMS)
    return x.groupBy("run_id", "gapped").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(T.spell("path")).alias("spellings"))


@query("T9_spell", pipe("edge", walk=Q_WALK) + "SELECT seq, count(*) AS n FROM walk GROUP BY 1")
def t9(spark, sf):
    w = T.walks(materialize(_edges(spark, sf)), None, 3)
    return w.groupBy(T.spell("path").alias("seq")).agg(F.count(F.lit(1)).alias("n"))


Q_COMPL = (f"SELECT run_id, idx, p, z FROM (SELECT a.run_id, a.idx, a.p, a.z, b.p AS q, row_number() OVER (PARTITION BY a.run_id, a.idx, a.p, a.z ORDER BY "
           f"abs(b.mz - (a.mass / a.z + {2 * PROTON!r} - a.mz)), b.mz) AS rn FROM zprep a JOIN prep b ON a.run_id = b.run_id AND a.idx = b.idx AND "
           f"b.mz BETWEEN (a.mass / a.z + {2 * PROTON!r} - a.mz) - 0.3 AND (a.mass / a.z + {2 * PROTON!r} - a.mz) + 0.3) WHERE rn = 1 AND q <> p")


@query("T10_complement_flags", pipe("zprep", compl=Q_COMPL) + "SELECT run_id, idx, p, CAST(z AS INT) AS z FROM compl")
def t10(spark, sf):
    return _prepared(spark, sf).select(*KEY, "p", F.explode("compl").alias("z"))


@query("T11_tag_spectra")
def t11(spark, sf):
    return tag_run.tag_spectra(V.spectra(spark, sf), V.peaks(spark, sf), PARAMS).select(
        *KEY, "rank", "seq", "charge", F.round("evalue", 6).alias("evalue"), F.round("nterm_mass", 4).alias("nterm_mass"),
        F.round("cterm_mass", 4).alias("cterm_mass"), F.round("min_conf", 4).alias("min_conf"))


@query("T11_tag_spectra_gapped")
def t11b(spark, sf):
    t = tag_run.tag_spectra(V.spectra(spark, sf), V.peaks(spark, sf), GAPPED)
    return t.groupBy("run_id", "gapped", "extended", "n_res").agg(F.count(F.lit(1)).alias("n"))


@query("T12_complement_population", pipe("zprep", compl=Q_COMPL) +
       "SELECT zp.run_id, zp.idx, CAST(zp.z AS INT) AS z, min(n_kept) AS n_kept, count(c.p) AS n_compl FROM zprep zp LEFT JOIN compl c ON zp.run_id = c.run_id AND zp.idx = c.idx AND zp.p = c.p AND zp.z = c.z GROUP BY 1, 2, 3")
def t12(spark, sf):
    return T.complement_population(_prepared(spark, sf))


# ------------------------------------------------------------------ scores
@query("E1_intensity_rank", pipe("budget") + "SELECT run_id, idx, round(mz, 6) AS mz, rk FROM budget")
def e1(spark, sf):
    x = T.intensity_rank(_budget(spark, sf).drop("rk"))
    return x.select(*KEY, F.round("mz", 6).alias("mz"), "rk")


def _facts(spark, sf):
    w = T.walks(materialize(_edges(spark, sf)), None, 3)
    return scoring.path_facts(T.extend(w, w, 0), PARAMS)


@query("E2_ranksum_null", pipe("prep", ns="SELECT DISTINCT n_kept AS n FROM prep WHERE n_kept >= 2",
       c="SELECT n, a + b AS s, count(*) AS ways FROM ns, (SELECT unnest(range(1, 101)) AS a), (SELECT unnest(range(1, 101)) AS b) WHERE a < b AND b <= n GROUP BY 1, 2") +
       "SELECT CAST(n AS INT) AS n, CAST(s AS INT) AS s, round(sum(ways) OVER (PARTITION BY n ORDER BY s) / sum(ways) OVER (PARTITION BY n), 9) AS cdf FROM c")
def e2(spark, sf):
    n = _budget(spark, sf).select(F.col("n_kept").cast("int").alias("n")).distinct()
    null = scoring.ranksum_null(spark, [2], 100).filter("s >= 3")
    return null.join(F.broadcast(n), "n").select("n", "s", F.round("cdf", 9).alias("cdf"))


@query("E2_p_intensity")
def e2b(spark, sf):
    t = scoring.p_intensity(_facts(spark, sf), scoring.ranksum_null(spark, [4], 100))
    return t.select(*KEY, "seq", "rank_sum", F.round("p_intensity", 9).alias("p_intensity"))


@query("E3_mz_fidelity")
def e3(spark, sf):
    t = scoring.p_mzfidelity(_facts(spark, sf), scoring.fidelity_null(spark, [4]))
    return t.select(*KEY, "seq", F.round("sse", 6).alias("sse"), "p_mzfidelity")


@query("E3_back_projection", pipe("edge", walk=Q_WALK, f="SELECT *, (m1 + (m2 - s1 / z) + (m3 - s1 / z - s2 / z) + (m4 - s1 / z - s2 / z - s3 / z)) / 4 AS fit FROM walk") +
       "SELECT run_id, idx, seq, CAST(z AS INT) AS charge, p1, round((power(m1 - fit, 2) + power(m2 - s1 / z - fit, 2) + power(m3 - s1 / z - s2 / z - fit, 2) + power(m4 - s1 / z - s2 / z - s3 / z - fit, 2)) / 0.09, 5) AS sse, r1 + r2 + r3 + r4 AS rank_sum FROM f")
def e3b(spark, sf):
    return _facts(spark, sf).select(*KEY, "seq", "charge", F.element_at("peaks", 1).alias("p1"), F.round("sse", 5).alias("sse"), F.col("rank_sum").cast("long").alias("rank_sum"))


HYP = ("SELECT l_orderkey AS id, l_linenumber AS ln, 60 + l_partkey % 40 AS N, 5 + l_suppkey % 30 AS K, 4 AS n, l_linenumber % 5 AS obs FROM lineitem")


def _pmf(x: str) -> str:
    choose = f"CASE {x} WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 6 WHEN 3 THEN 4 ELSE 1 END"
    num = "*".join(f"(CASE WHEN {i} < {x} THEN K - {i} ELSE (N - K) - ({i} - {x}) END)" for i in range(4))
    return f"CAST({choose} AS DOUBLE) * {num} / (CAST(N AS DOUBLE) * (N - 1) * (N - 2) * (N - 3))"


@query("E4_p_complement", V.cte(h=HYP) + "SELECT id, ln, round(CASE WHEN obs = 0 THEN 1.0 ELSE "
       + " + ".join(f"(CASE WHEN obs <= {x} THEN {_pmf(str(x))} ELSE 0 END)" for x in range(1, 5)) + " END, 9) AS p, round(CASE WHEN obs = 0 THEN "
       + " + ".join(_pmf(str(x)) for x in range(1, 5)) + f" + 0.5 * {_pmf('0')} WHEN obs = 1 THEN " + " + ".join(_pmf(str(x)) for x in range(2, 5)) + f" + 0.5 * {_pmf('1')} ELSE "
       + " + ".join(f"(CASE WHEN obs <= {x} THEN {_pmf(str(x))} ELSE 0 END)" for x in range(2, 5)) + " END, 9) AS midp FROM h")
def e4(spark, sf):
    h = V.table(spark, sf, "lineitem").selectExpr("l_orderkey AS id", "l_linenumber AS ln", "60 + l_partkey % 40 AS N", "5 + l_suppkey % 30 AS K", "l_linenumber % 5 AS obs")
    return h.select("id", "ln", F.round(stats.complement_pvalue("N", "K", F.lit(4), "obs"), 9).alias("p"),
                    F.round(stats.complement_pvalue("N", "K", F.lit(4), "obs", True), 9).alias("midp"))


PV = ["l_orderkey AS id", "l_linenumber AS ln", "(l_discount + 0.001) * 3 AS p1", "l_tax * 5 + 0.0001 AS p2", "l_quantity / 50 AS p3"]


@query("E5_fisher", V.cte(v="SELECT " + ", ".join(PV) + " FROM lineitem", t="SELECT id, ln, -(ln(p1) + ln(p2)) AS t2, -(ln(p1) + ln(p2) + ln(p3)) AS t3 FROM v") +
       "SELECT id, ln, round(CASE WHEN t2 <= 0 THEN 1.0 ELSE least(1.0, exp(-t2) * (1 + t2)) END, 9) AS two, round(CASE WHEN t3 <= 0 THEN 1.0 ELSE least(1.0, exp(-t3) * (1 + t3 + t3 * t3 / 2)) END, 9) AS three FROM t")
def e5(spark, sf):
    v = V.table(spark, sf, "lineitem").selectExpr(*PV)
    return v.select("id", "ln", F.round(stats.fisher("p1", "p2"), 9).alias("two"), F.round(stats.fisher("p1", "p2", "p3"), 9).alias("three"))


EV = ["l_partkey % 4 AS run_id", "l_partkey AS idx", "l_orderkey AS tag_id", "l_linenumber AS ln", "(l_discount + 0.001) * 3 AS p_intensity",
      "l_tax * 5 + 0.0001 AS p_mzfidelity", "l_quantity / 50 AS p_complement", "l_returnflag = 'N' AS use_compl", "l_linestatus = 'O' AS gapped"]


@query("E6_evalue", V.cte(v="SELECT " + ", ".join(EV) + " FROM lineitem", t="SELECT *, -(ln(p_intensity) + ln(p_mzfidelity)) AS t2, count(*) OVER (PARTITION BY run_id, idx) AS n FROM v", u="SELECT *, t2 - ln(p_complement) AS t3 FROM t",
       f="SELECT *, CASE WHEN use_compl THEN CASE WHEN t3 <= 0 THEN 1.0 ELSE least(1.0, exp(-t3) * (1 + t3 + t3 * t3 / 2)) END ELSE CASE WHEN t2 <= 0 THEN 1.0 ELSE least(1.0, exp(-t2) * (1 + t2)) END END AS p FROM u") +
       "SELECT tag_id, ln, round(p * n * 2.0 * CASE WHEN gapped THEN 100.0 ELSE 1.0 END, 5) AS evalue FROM f")
def e6(spark, sf):
    v = V.table(spark, sf, "lineitem").selectExpr(*EV)
    return scoring.evalue(v, 100.0, 2).select("tag_id", "ln", F.round("evalue", 5).alias("evalue"))


def _edge_conf(a, b):
    return f"greatest(0, 1 - abs((m{b} - m{a}) * z - s{a}) / (0.3 * z)) * greatest(0, 1 - greatest(r{a}, r{b}) / CAST(n_kept AS DOUBLE))"


@query("E7_edge_confidence", pipe("edge", walk=Q_WALK, nk="SELECT DISTINCT run_id, idx, n_kept FROM prep", c="SELECT walk.*, " + ", ".join(f"{_edge_conf(i, i + 1)} AS c{i}" for i in (1, 2, 3)) + " FROM walk JOIN nk USING (run_id, idx)") +
       "SELECT run_id, idx, seq, CAST(z AS INT) AS charge, p1, round(least(c1, c2, c3), 5) AS min_conf, round((c1 + c2 + c3) / 3, 5) AS mean_conf FROM c")
def e7(spark, sf):
    return _facts(spark, sf).select(*KEY, "seq", "charge", F.element_at("peaks", 1).alias("p1"), F.round("min_conf", 5).alias("min_conf"), F.round("mean_conf", 5).alias("mean_conf"))


@query("E8_flanks", pipe("edge", walk=Q_WALK, f="SELECT walk.*, mass, (m1 + (m2 - s1 / z) + (m3 - s1 / z - s2 / z) + (m4 - s1 / z - s2 / z - s3 / z)) / 4 AS fit FROM walk JOIN m USING (run_id, idx)") +
       f"SELECT run_id, idx, seq, CAST(z AS INT) AS charge, p1, round(greatest(0, fit * z - {PROTON!r} * z - {WATER!r}), 4) AS cterm_mass, round(greatest(0, mass - ((fit + (s1 + s2 + s3) / z) * z - {PROTON!r} * z)), 4) AS nterm_mass FROM f")
def e8(spark, sf):
    return _facts(spark, sf).select(*KEY, "seq", "charge", F.element_at("peaks", 1).alias("p1"), F.round("cterm_mass", 4).alias("cterm_mass"), F.round("nterm_mass", 4).alias("nterm_mass"))


# ------------------------------------------------------------------ ranking
ORD = "evalue, seq, low_mz, charge, nterm_mass, cterm_mass"


@query("R1_rank_tags", V.cte(t=Q_TAGS) + f"SELECT tag_id, row_number() OVER (PARTITION BY run_id, idx ORDER BY {ORD}) AS rank FROM t")
def r1(spark, sf):
    return ranking.rank_tags(given_tags(spark, sf)).select("tag_id", "rank")


Q_DUP = Q_TAGS.replace("o_totalprice % 700 AS nterm_mass", "o_orderkey % 2 AS nterm_mass").replace("o_orderkey % 500 + 0.25E0 AS cterm_mass", "0 AS cterm_mass")


@query("R2_dedupe_tags", V.cte(t=Q_DUP) + "SELECT tag_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id, idx, seq, charge, nterm_mass, cterm_mass ORDER BY evalue, low_mz) AS r FROM t) WHERE r = 1")
def r2(spark, sf):
    t = given_tags(spark, sf).withColumn("nterm_mass", F.col("tag_id") % 2).withColumn("cterm_mass", F.lit(0))
    return ranking.dedupe_tags(t).select("tag_id")


@query("R3_top_tags", V.cte(t=Q_TAGS) + f"SELECT tag_id, rank FROM (SELECT tag_id, row_number() OVER (PARTITION BY run_id, idx ORDER BY {ORD}) AS rank FROM t) WHERE rank <= 3")
def r3(spark, sf):
    return ranking.top_tags(given_tags(spark, sf), 3).select("tag_id", "rank")


@query("R4_diversify")
def r4(spark, sf):
    p = T.TagParams(frag_tol=0.3, tol_ppm=False, complement_tol=0.3, max_gaps=1, diversity=True, max_tags=5)
    t = tag_run.tag_spectra(V.spectra(spark, sf), V.peaks(spark, sf), p)
    return t.select(*KEY, "rank", "seq", "charge", F.round("evalue", 6).alias("evalue"))


@query("R5_merge_lengths", V.cte(t=Q_DUP, b="SELECT *, n_res AS seed_length, first_value(n_res) OVER (PARTITION BY run_id, idx, seq, charge, nterm_mass, cterm_mass, gapped ORDER BY evalue, n_res) AS b FROM t") + "SELECT tag_id FROM b WHERE seed_length = b")
def r5(spark, sf):
    t = given_tags(spark, sf).withColumn("nterm_mass", F.col("tag_id") % 2).withColumn("cterm_mass", F.lit(0)).withColumn("seed_length", F.col("n_res"))
    return ranking.merge_lengths(t).select("tag_id")


@query("R6_merge_series", V.cte(t=Q_TAGS) + "SELECT tag_id, r AS merged_rank FROM (SELECT tag_id, row_number() OVER (PARTITION BY run_id, idx ORDER BY evalue, CASE WHEN tag_id % 2 = 0 THEN 0 ELSE 1 END, seq, low_mz) AS r FROM t) WHERE r <= 4")
def r6(spark, sf):
    t = given_tags(spark, sf)
    return ranking.merge_series(t.filter("tag_id % 2 = 0"), t.filter("tag_id % 2 <> 0"), 4).select("tag_id", "merged_rank")


@query("R7_merge_hypotheses", V.cte(t=Q_TAGS, h="SELECT run_id, idx, count(DISTINCT charge) AS n_hyp FROM t GROUP BY 1, 2") +
       "SELECT tag_id, round(ev, 6) AS evalue, r AS merged_rank FROM (SELECT tag_id, evalue * n_hyp AS ev, row_number() OVER (PARTITION BY run_id, idx ORDER BY evalue * n_hyp, charge, seq, low_mz) AS r FROM t JOIN h USING (run_id, idx)) WHERE r <= 5")
def r7(spark, sf):
    t = given_tags(spark, sf).withColumn("hypothesis", F.col("charge"))
    h = t.groupBy(*KEY).agg(F.countDistinct("charge").alias("n_hyp"))
    return ranking.merge_hypotheses(t, h, 5).select("tag_id", F.round("evalue", 6).alias("evalue"), "merged_rank")


CELL = "CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR(40)) END"


@query("R8_sort_view", f"SELECT o_orderkey, x AS cell, CASE WHEN x IS NULL THEN -1 ELSE rank() OVER (ORDER BY x NULLS LAST) - 1 END AS position FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS x FROM orders)")
def r8(spark, sf):
    v = V.table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("text"))
    v = ranking.sort_view(v, "text").withColumn("cell", F.col("text").try_cast("double"))
    pos = ranking.row_position(v.filter("cell IS NOT NULL"), "cell").select("cell", "position")
    return join_values(v, pos, ["cell"], "cell").select("o_orderkey", "cell", F.coalesce("position", F.lit(-1)).alias("position"))


@query("R9_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 200")
def r9(spark, sf):
    v = V.table(spark, sf, "orders").withColumn("neg", -F.col("o_totalprice"))
    return ranking.page(v, ["neg", "o_orderkey"], 200, 100).select("o_orderkey", "o_totalprice")


@query("R10_per_spectrum_top", V.cte(t=Q_TAGS) + "SELECT tag_id FROM (SELECT tag_id, row_number() OVER (PARTITION BY run_id, idx ORDER BY n_res, evalue, tag_id) AS r FROM t) WHERE r <= 2")
def r10(spark, sf):
    return ranking.per_spectrum_top(given_tags(spark, sf), 2, ["n_res", "evalue", "tag_id"]).select("tag_id")
