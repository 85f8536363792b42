"""Queries over precursor hypotheses and database matching."""
from __future__ import annotations

from pyspark.sql import functions as F

from ionweave.functions import constants as K
from ionweave.operators import dbmatch as D, precursor as H
from ionweave.plans import q_tagging as QT, tag_run, views as V
from ionweave.plans.registry import query

KEY = ["run_id", "idx"]
P2 = repr(2 * K.PROTON)


def _possible(spark, sf):
    return V.spectra(spark, sf).withColumn("possible_charges", F.when(F.col("idx") % 3 == 0, F.array(F.lit(3), F.lit(2), F.lit(3))))


@query("H1_charge_candidates", V.cte(s=V.Q_SPECTRA) + "SELECT run_id, idx, CAST(z AS INT) AS z, CASE WHEN charge > 0 THEN 'header' WHEN idx % 3 = 0 THEN 'possible' ELSE 'enumerated' END AS src FROM s, "
       "LATERAL (SELECT unnest(CASE WHEN charge > 0 THEN [charge] WHEN idx % 3 = 0 THEN [2, 3] ELSE [2, 3, 4] END) AS z)")
def h1(spark, sf):
    return H.charge_candidates(_possible(spark, sf), "enumerate")


Q_TOP = "SELECT DISTINCT run_id, idx, mz FROM (SELECT *, row_number() OVER (PARTITION BY run_id, idx ORDER BY intensity DESC, mz DESC) AS r FROM peaks) WHERE r <= 150"
Q_SUMS = ("SELECT m.run_id, m.idx, m.k, m.M, s.shift, m.M + " + P2 + " + s.shift AS total FROM mm m, (SELECT unnest([0.0, -11.5, -7.5, -4.5, 4.5, 7.5, 11.5]) AS shift) s")
Q_PAIRS = ("SELECT DISTINCT t.run_id, t.idx, t.k, t.shift, a.mz FROM sums t JOIN top a ON t.run_id = a.run_id AND t.idx = a.idx AND t.total - a.mz > a.mz "
           "JOIN top b ON a.run_id = b.run_id AND a.idx = b.idx AND b.mz > a.mz AND b.mz BETWEEN t.total - a.mz - 0.3 AND t.total - a.mz + 0.3")
Q_EXC = ("SELECT mm.run_id, mm.idx, mm.k, round(sum(CASE WHEN p.shift = 0 THEN 1.0 WHEN p.shift IS NULL THEN 0.0 ELSE -1.0 / 6 END), 6) AS excess FROM mm LEFT JOIN pr p ON mm.run_id = p.run_id AND mm.idx = p.idx AND mm.k = p.k GROUP BY 1, 2, 3")


@query("H2_complement_excess", V.cte(peaks=V.Q_PEAKS, spectra=V.Q_SPECTRA, spec=QT.Q_SPEC, m=QT.Q_MASS, top=Q_TOP, mm="SELECT run_id, idx, 0 AS k, mass AS M FROM m", sums=Q_SUMS, pr=Q_PAIRS, e=Q_EXC) +
       "SELECT run_id, idx, excess FROM e")
def h2(spark, sf):
    s = QT.filters.with_defaults(V.spectra(spark, sf)).select(*KEY, F.col("mass").alias("M"))
    return H.complement_excess(H.top_peaks(V.peaks(spark, sf)), s, 0.3).select(*KEY, F.round("excess", 6).alias("excess"))


# the charge call over candidates cand(run_id, idx, z) of spectra open_(run_id, idx, precursor_mz)
Q_INFER = dict(
    mm=f"SELECT c.run_id, c.idx, c.z AS k, o.precursor_mz * c.z - c.z * {K.PROTON!r} AS M FROM cand c JOIN open_ o USING (run_id, idx)", sums=Q_SUMS, pr=Q_PAIRS,
    e="SELECT mm.run_id, mm.idx, mm.k AS z, sum(CASE WHEN p.shift = 0 THEN 6 WHEN p.shift IS NULL THEN 0 ELSE -1 END)::BIGINT AS e6 FROM mm LEFT JOIN pr p ON mm.run_id = p.run_id AND mm.idx = p.idx AND mm.k = p.k GROUP BY 1, 2, 3",
    hi="SELECT run_id, idx, max(mz) AS top_mz FROM top GROUP BY 1, 2",
    ab="SELECT o.run_id, o.idx, sum(CASE WHEN p.mz > o.precursor_mz THEN p.intensity ELSE 0 END) / sum(p.intensity) AS share FROM open_ o JOIN peaks p ON p.run_id = o.run_id AND p.idx = o.idx AND p.intensity > 0 AND abs(p.mz - o.precursor_mz) > 3.5 GROUP BY 1, 2",
    ok=f"SELECT e.*, NOT (coalesce(hi.top_mz, 0) > e.z * o.precursor_mz - (e.z - 1) * {K.PROTON!r} + 1.5) AS fits FROM e JOIN open_ o USING (run_id, idx) LEFT JOIN hi USING (run_id, idx)",
    lf="SELECT *, fits OR NOT bool_or(fits) OVER (PARTITION BY run_id, idx) AS stays, min(z) OVER (PARTITION BY run_id, idx) AS z_low FROM ok",
    rk="SELECT *, row_number() OVER (PARTITION BY run_id, idx ORDER BY stays DESC, e6 DESC, z) AS r FROM lf",
    ev="SELECT run_id, idx, min(z_low) AS z_low, min(CASE WHEN stays THEN z END) AS left_low, bool_or(stays AND z = 2) AS two, max(CASE WHEN r = 1 THEN e6 END) AS e1, max(CASE WHEN r = 1 THEN z END) AS z1, "
       "max(CASE WHEN r = 2 AND stays THEN e6 END) AS e2, max(CASE WHEN r = 2 AND stays THEN z END) AS z2 FROM rk GROUP BY 1, 2",
    call="SELECT ev.*, CASE WHEN z_low = 1 AND share < 0.05 THEN 'one_plus' WHEN e1 <= 0 AND left_low <> z_low THEN 'range' WHEN e1 <= 0 THEN 'none' ELSE 'complement' END AS basis, e2 IS NOT NULL AND e1 - e2 < 12 AS close "
         "FROM ev LEFT JOIN ab USING (run_id, idx)",
    inf="SELECT run_id, idx, basis, CASE basis WHEN 'one_plus' THEN 1 WHEN 'range' THEN left_low WHEN 'none' THEN CASE WHEN two THEN 2 ELSE left_low END ELSE z1 END::INT AS charge, "
        "CASE WHEN basis = 'none' THEN 'assumed' WHEN basis = 'complement' AND close THEN 'ambiguous' ELSE 'inferred' END AS src, CASE WHEN basis = 'complement' AND close THEN z2 END::INT AS runner_up, round(e1 / 6, 6) AS excess FROM call")


@query("H3_infer_charge", V.cte(peaks=V.Q_PEAKS, spectra=V.Q_SPECTRA, top=Q_TOP, open_="SELECT run_id, idx, precursor_mz FROM spectra", cand="SELECT run_id, idx, unnest([1, 2, 3, 4]) AS z FROM open_", **Q_INFER) +
       "SELECT run_id, idx, charge, src, basis, runner_up, excess FROM inf")
def h3(spark, sf):
    s = V.spectra(spark, sf)
    c = H.charge_candidates(s.withColumn("possible_charges", F.lit(None).cast("array<int>")).withColumn("charge", F.lit(0)), "enumerate", 1, 4)
    return H.infer_charge(V.peaks(spark, sf), s, c, 0.3).select(*KEY, "charge", "src", "basis", "runner_up", F.round("excess", 6).alias("excess"))


# spectra without a charge; every third lists possible ones, every ninth of these a single one


def _hyp_spectra(spark, sf):
    listed = F.when(F.col("idx") % 27 == 0, F.array(F.lit(3), F.lit(3))).when(F.col("idx") % 3 == 0, F.array(F.lit(3), F.lit(2), F.lit(9)))
    return V.spectra(spark, sf).withColumn("possible_charges", listed).withColumn("charge", F.when(F.col("idx") % 2 == 0, F.col("charge")).otherwise(0))


def q_hypotheses(mode: str) -> str:
    single = "SELECT run_id, idx, precursor_mz, 0 AS hypothesis, charge::INT AS z, 'header' AS charge_src, true AS selected FROM hs WHERE charge > 0 UNION ALL SELECT run_id, idx, precursor_mz, 0, 3, 'possible', true FROM hs WHERE charge <= 0 AND idx % 27 = 0"
    if mode == "infer":
        rest = ("SELECT o.run_id, o.idx, o.precursor_mz, CASE WHEN src = 'ambiguous' AND charge > runner_up THEN 1 ELSE 0 END, charge, src, true FROM open_ o JOIN inf USING (run_id, idx) UNION ALL "
                "SELECT o.run_id, o.idx, o.precursor_mz, CASE WHEN charge > runner_up THEN 0 ELSE 1 END, runner_up, src, false FROM open_ o JOIN inf USING (run_id, idx) WHERE src = 'ambiguous'")
    else:
        rest = ("SELECT o.run_id, o.idx, o.precursor_mz, row_number() OVER (PARTITION BY o.run_id, o.idx ORDER BY c.z) - 1, c.z, CASE WHEN o.idx % 3 = 0 THEN 'possible' ELSE 'enumerated' END, "
                "c.z = CASE WHEN src <> 'assumed' THEN charge ELSE 2 END FROM open_ o JOIN cand c USING (run_id, idx) JOIN inf USING (run_id, idx)")
    return V.cte(peaks=V.Q_PEAKS, spectra=V.Q_SPECTRA, top=Q_TOP, hs="SELECT run_id, idx, precursor_mz, CASE WHEN idx % 2 = 0 THEN charge ELSE 0 END AS charge FROM spectra",
                 open_="SELECT run_id, idx, precursor_mz FROM hs WHERE charge <= 0 AND idx % 27 <> 0",
                 cand="SELECT run_id, idx, unnest(CASE WHEN idx % 3 = 0 THEN [2, 3] ELSE [1, 2, 3, 4] END) AS z FROM open_", **Q_INFER, h=f"{single} UNION ALL {rest}") + (
        "SELECT run_id, idx, CAST(hypothesis AS INT) AS hypothesis, CAST(count(*) OVER (PARTITION BY run_id, idx) AS INT) AS n_hyp, z, charge_src, selected, 0 AS iso, round(precursor_mz, 6) AS precursor_mz FROM h")


def hypotheses(spark, sf, params):
    return H.precursor_hypotheses(_hyp_spectra(spark, sf), V.peaks(spark, sf), 0.3, params)


@query("H8_hypotheses_inferred", q_hypotheses("infer"))
def h8(spark, sf):
    return hypotheses(spark, sf, H.HypothesisParams("infer", 1, 4)).withColumn("precursor_mz", F.round("precursor_mz", 6))


@query("H8_hypotheses_enumerated", q_hypotheses("enumerate"))
def h8b(spark, sf):
    return hypotheses(spark, sf, H.HypothesisParams("enumerate", 1, 4)).withColumn("precursor_mz", F.round("precursor_mz", 6))


@query("H8_hypotheses_checked")
def h8c(spark, sf):
    """Headers under the check, with isotope errors; its twin is in the tests."""
    s, p = V.spectra(spark, sf), V.peaks(spark, sf)
    return H.precursor_hypotheses(s, p, 0.3, H.HypothesisParams("infer", isotopes=(0, -1, 1), header_check="both", header_margin=1.0), H.ms1_charge(_scan_levels(spark, sf), p, 500.0))


@query("T11_tag_hypotheses")
def t11_hypotheses(spark, sf):
    """Tags of all spectra under their precursor hypotheses; its twin is in the tests."""
    t = tag_run.tag_hypotheses(_hyp_spectra(spark, sf), V.peaks(spark, sf), QT.PARAMS, H.HypothesisParams("infer", 1, 4))
    return t.select(*KEY, "merged_rank", "hypothesis", "n_hyp", "precursor_charge", "charge_src", "selected", "seq", "charge", "evalue", "nterm_mass", "cterm_mass", "low_mz")


@query("H4_best_isotope", V.cte(peaks=V.Q_PEAKS, spectra=V.Q_SPECTRA, spec=QT.Q_SPEC, m=QT.Q_MASS, top=Q_TOP, mm=f"SELECT run_id, idx, k, mass - k * {K.ISOTOPE_STEP!r} AS M FROM m, (SELECT unnest([0, -1, 1, 2]) AS k)", sums=Q_SUMS, pr=Q_PAIRS, e=Q_EXC) +
       "SELECT run_id, idx, k AS iso, excess FROM (SELECT *, row_number() OVER (PARTITION BY run_id, idx ORDER BY excess DESC, abs(k), k) AS r FROM e) WHERE r = 1")
def h4(spark, sf):
    s = QT.filters.with_defaults(V.spectra(spark, sf)).select(*KEY, "precursor_mz", F.col("charge_used").alias("z"))
    return H.best_isotope(H.top_peaks(V.peaks(spark, sf)), s, [0, -1, 1, 2], 0.3).select(*KEY, "iso", F.round("excess", 6).alias("excess"))


def _scan_levels(spark, sf):
    return V.spectra(spark, sf).withColumn("ms_level", F.when(F.col("charge") == 4, 1).otherwise(2))


def _ms1_positions() -> str:
    rows = [(0, 0.0)] + [(z * 10 + j, m / z * K.ISOTOPE_STEP) for z in range(1, 9) for j, m in ((1, 1.0), (2, -1.0), (3, 2.0))]
    return V.literal(rows, "code, d")


def _ms1_call() -> str:
    at = lambda c: f"coalesce(max(CASE WHEN code = {c} THEN y END), 0)"
    arms = " ".join(f"WHEN {at(z * 10 + 1)} >= 0.15 * {at(0)} AND ({at(z * 10 + 2)} >= 0.05 * {at(0)} OR {at(z * 10 + 3)} >= 0.05 * {at(0)}) THEN {z}" for z in range(8, 0, -1))
    return f"CASE WHEN {at(0)} <= 0 THEN 0 {arms} ELSE 0 END"


@query("H5_ms1_charge", V.cte(peaks=V.Q_PEAKS, spectra=V.Q_SPECTRA, prev="SELECT *, max(CASE WHEN charge = 4 THEN idx END) OVER (PARTITION BY run_id ORDER BY idx) AS ms1_idx FROM spectra",
       pos=_ms1_positions(), h="SELECT a.run_id, a.idx, pos.code, max(p.intensity) AS y FROM prev a CROSS JOIN pos JOIN peaks p ON p.run_id = a.run_id AND p.idx = a.ms1_idx AND p.mz BETWEEN (a.precursor_mz + d) * (1 - 0.0005) AND (a.precursor_mz + d) * (1 + 0.0005) WHERE a.charge <> 4 GROUP BY 1, 2, 3",
       c=f"SELECT run_id, idx, {_ms1_call()} AS ms1_charge FROM h GROUP BY 1, 2") +
       "SELECT a.run_id, a.idx, a.ms1_idx, coalesce(c.ms1_charge, 0) AS ms1_charge FROM prev a LEFT JOIN c USING (run_id, idx) WHERE a.charge <> 4 AND a.ms1_idx IS NOT NULL")
def h5(spark, sf):
    return H.ms1_charge(_scan_levels(spark, sf), V.peaks(spark, sf), 500.0).drop("spaced")


@query("H6_check_header_charge")
def h6(spark, sf):
    s, p = V.spectra(spark, sf), V.peaks(spark, sf)
    v = H.check_header_charge(p, s, 0.3, margin=1.0, ms1=H.ms1_charge(_scan_levels(spark, sf), p, 500.0))
    return v.groupBy("run_id", "header", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("H7_complement_tolerance")
def h7(spark, sf):
    e = V.table(spark, sf, "lineitem").select((F.col("l_partkey") % 4).alias("run_id"),
        F.when(F.col("l_returnflag") == "N", (F.col("l_discount") - 0.05) * (F.col("l_tax") + 0.2)).otherwise((F.col("l_quantity") - 25.5) / 30).alias("err"))
    return H.complement_tolerance(e, 0.9, 0.02).select("run_id", "n", F.round("signal", 4).alias("signal"), F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"), "ok", F.round("tol", 6).alias("tol"))


@query("H7_measured_tolerance")
def h7b(spark, sf):
    t = tag_run.measured_tolerance(V.spectra(spark, sf), V.peaks(spark, sf), QT.PARAMS, max_evalue=20.0)
    return t.select("run_id", "n", F.round("signal", 4).alias("signal"), F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"), "ok", F.round("tol", 6).alias("tol"), "window")


ENDS = ["l_partkey % 4 AS run_id", "l_partkey AS idx", "CAST(1 + l_linenumber % 2 AS INT) AS z", "100 + l_extendedprice % 900 AS mz"]


@query("H7_complement_errors", V.cte(p="SELECT DISTINCT l_partkey % 4 AS run_id, l_partkey AS idx, 100 + l_extendedprice % 900 AS mz FROM lineitem",
       f=f"SELECT p_partkey % 4 AS run_id, p_partkey AS idx, greatest(p_size % 5, 2) AS c, (400 + p_retailprice % 600 - {K.PROTON}) * greatest(p_size % 5, 2) AS mass FROM part",
       e=f"SELECT DISTINCT {', '.join(ENDS)} FROM lineitem",
       w=f"SELECT e.*, 0 AS r, mass / z + 2 * {K.PROTON} - mz AS want FROM e JOIN f USING (run_id, idx) UNION ALL SELECT e.*, 1, (mass + c * {K.PROTON} - z * mz) / (c - z) FROM e JOIN f USING (run_id, idx) WHERE z < c",
       n="SELECT w.*, p.mz AS q, row_number() OVER (PARTITION BY w.run_id, w.idx, w.z, w.mz, r ORDER BY abs(p.mz - want), p.mz DESC) AS k FROM w JOIN p ON p.run_id = w.run_id AND p.idx = w.idx AND p.mz BETWEEN want - 0.9 AND want + 0.9",
       b="SELECT *, row_number() OVER (PARTITION BY run_id, idx, z, mz ORDER BY abs(q - want), r) AS best FROM n WHERE k = 1 AND q <> mz") +
       "SELECT run_id, idx, round(mz, 4) AS mz, round(q - want, 6) AS err FROM b WHERE best = 1")
def h7c(spark, sf):
    facts = V.spectra(spark, sf).select("run_id", "idx", F.greatest("charge", F.lit(2)).alias("charge_used"), "precursor_mz")
    prepared = V.peaks(spark, sf).join(facts.withColumn("mass", (F.col("precursor_mz") - F.lit(K.PROTON)) * F.col("charge_used")), ["run_id", "idx"])
    ends = V.table(spark, sf, "lineitem").selectExpr(*ENDS)
    return H.complement_errors(ends, prepared, 0.9, "both").select("run_id", "idx", F.round("mz", 4).alias("mz"), F.round("err", 6).alias("err"))


# ------------------------------------------------------------------ database matching
def q_kmers(k: int, cols: str = "taxon, genus") -> str:
    return (f"SELECT {cols}, pos, substr(sequence, pos, {k}) AS kmer FROM (SELECT *, unnest(range(1, length(sequence) - {k - 2})) AS pos FROM prot WHERE length(sequence) >= {k}) "
            f"WHERE substr(sequence, pos, {k}) NOT LIKE '%#%'")


@query("Q1_db_kmers", V.cte(prot=V.Q_PROTEINS, k5=q_kmers(5), k6=q_kmers(6), d="SELECT DISTINCT 5 AS k, kmer FROM k5 UNION ALL SELECT DISTINCT 6, kmer FROM k6") +
       "SELECT k, substr(kmer, 1, 2) AS head, count(*) AS n FROM d GROUP BY 1, 2")
def q1(spark, sf):
    return D.db_kmers(V.proteins(spark, sf), 5, 6).groupBy("k", F.substring("kmer", 1, 2).alias("head")).agg(F.count(F.lit(1)).alias("n"))


Q_RULES = "SELECT o.residue AS one, a.residue AS a, b.residue AS b FROM al o JOIN al a ON a.step < o.step JOIN al b ON abs(o.step - (a.step + b.step)) <= 0.01"
Q_AL = V.literal([(r, m) for r, m in K.residue_rows()], "residue, step")


@query("Q2_collapse_rules", V.cte(prot=V.Q_PROTEINS, al=Q_AL, rules=Q_RULES, r="SELECT DISTINCT one, a, b FROM rules") +
       "SELECT r.one, r.a, r.b, count(*) AS docs FROM r JOIN prot ON contains(prot.sequence, r.one) AND contains(prot.sequence, r.a || r.b) GROUP BY 1, 2, 3")
def q2(spark, sf):
    rules = D.collapse_rules(spark, 0.01)
    return V.proteins(spark, sf).join(F.broadcast(rules), F.expr("contains(sequence, one) AND contains(sequence, concat(a, b))")).groupBy("one", "a", "b").agg(F.count(F.lit(1)).alias("docs"))


def _tags7(spark, sf):
    t = V.db_tags(spark, sf)
    return t.unionByName(t.withColumn("seq", F.reverse("seq")).withColumn("pos", F.col("pos") + 100000))


Q_TAGS7 = "SELECT run_id, idx, pos, seq, evalue FROM t0 UNION ALL SELECT run_id, idx, pos + 100000, reverse(seq), evalue FROM t0"


@query("Q3_match_db", V.cte(prot=V.Q_PROTEINS, t0=V.q_db_tags(7), t=Q_TAGS7, k7=q_kmers(7), k="SELECT DISTINCT kmer FROM k7") +
       "SELECT idx, pos, seq, CASE WHEN seq IN (SELECT kmer FROM k) THEN 'forward' WHEN reverse(seq) IN (SELECT kmer FROM k) THEN 'reverse' ELSE 'none' END AS hit FROM t")
def q3(spark, sf):
    return D.match_db(_tags7(spark, sf), D.kmers(V.proteins(spark, sf), 7, [])).select("idx", "pos", "seq", "hit")


@query("Q3_match_db_readings", V.cte(prot=V.Q_PROTEINS, t=V.q_db_tags(6), al=Q_AL, rules=Q_RULES, k6=q_kmers(6), k7=q_kmers(7), k="SELECT DISTINCT kmer FROM k6 UNION SELECT DISTINCT kmer FROM k7",
       s="SELECT DISTINCT seq FROM t", rd="SELECT seq, seq AS reading FROM s UNION SELECT s.seq, substr(s.seq, 1, i - 1) || r.a || r.b || substr(s.seq, i + 1) FROM s, (SELECT unnest(range(1, 7)) AS i) ii JOIN rules r ON substr(s.seq, i, 1) = r.one",
       f="SELECT DISTINCT seq FROM rd WHERE reading IN (SELECT kmer FROM k)") +
       "SELECT idx, pos, t.seq, CASE WHEN f.seq IS NULL THEN 'none' ELSE 'forward' END AS hit FROM t LEFT JOIN f ON t.seq = f.seq")
def q3b(spark, sf):
    p = V.proteins(spark, sf)
    k = D.kmers(p, 6, []).select("kmer").unionByName(D.kmers(p, 7, []).select("kmer"))
    return D.match_db(V.db_tags(spark, sf, 6), k, False, D.collapse_rules(spark, 0.01)).select("idx", "pos", "seq", "hit")


@query("Q4_min_filter_length", V.cte(prot=V.Q_PROTEINS) + "SELECT taxon, genus, CAST(greatest(1, least(25, ceil(ln(40.0 * sum(length(sequence))) / ln(14.7)))) AS INT) AS k FROM prot GROUP BY 1, 2")
def q4(spark, sf):
    n = V.proteins(spark, sf).groupBy("taxon", "genus").agg(F.sum(F.length("sequence")).alias("n"))
    return n.select("taxon", "genus", D.min_filter_length(F.col("n")).alias("k"))


@query("Q5_chance_table", V.cte(prot=V.Q_PROTEINS, t0=V.q_db_tags(7), t=Q_TAGS7, k7=q_kmers(7), k="SELECT DISTINCT kmer FROM k7", n="SELECT sum(length(sequence)) AS n FROM prot",
       c="SELECT run_id, count(*) AS tags, sum(CASE WHEN seq IN (SELECT kmer FROM k) OR reverse(seq) IN (SELECT kmer FROM k) THEN 1 ELSE 0 END) AS matched FROM t GROUP BY 1") +
       "SELECT run_id, 7 AS k, tags, matched, round(tags * (1 - exp(-2.0 * n / power(14.7, 7))), 4) AS expected FROM c, n")
def q5(spark, sf):
    p = V.proteins(spark, sf)
    n = p.agg(F.sum(F.length("sequence")).alias("residues"))
    m = D.match_db(_tags7(spark, sf), D.kmers(p, 7, []))
    return D.chance_table(m, n).select("run_id", "k", "tags", "matched", F.round("expected", 4).alias("expected"))


Q_EVENTS = "SELECT l_orderkey % 4 AS run_id, l_extendedprice AS evalue, l_returnflag <> 'A' AS tgt, 0.5 + l_discount AS weight FROM lineitem"


@query("Q6_qvalues", V.cte(e=Q_EVENTS, g="SELECT run_id, evalue, sum(CASE WHEN tgt THEN 1 ELSE 0 END) AS t, sum(CASE WHEN tgt THEN 0 ELSE weight END) AS d FROM e GROUP BY 1, 2",
       c="SELECT *, sum(t) OVER w AS tt, sum(d) OVER w AS dd FROM g WINDOW w AS (PARTITION BY run_id ORDER BY evalue)") +
       "SELECT run_id, evalue, round(least(1.0, min(dd / tt) OVER (PARTITION BY run_id ORDER BY evalue DESC)), 6) AS qvalue FROM c WHERE t > 0")
def q6(spark, sf):
    e = V.table(spark, sf, "lineitem").selectExpr("l_orderkey % 4 AS run_id", "l_extendedprice AS evalue", "l_returnflag <> 'A' AS tgt", "0.5 + l_discount AS weight")
    return D.qvalues(e.filter("tgt"), e.filter("NOT tgt")).select("run_id", "evalue", F.round("qvalue", 6).alias("qvalue"))


@query("Q7_entrapment_q", V.cte(prot=V.Q_PROTEINS, t=V.q_db_tags(7), k7=q_kmers(7), tk="SELECT DISTINCT kmer FROM k7 WHERE genus = 'en'", ek="SELECT DISTINCT kmer FROM k7 WHERE genus <> 'en'",
       w="SELECT (SELECT count(*) FROM tk) / CAST((SELECT count(*) FROM ek WHERE kmer NOT IN (SELECT kmer FROM tk)) AS DOUBLE) AS weight",
       m="SELECT *, seq IN (SELECT kmer FROM tk) AS ist, seq IN (SELECT kmer FROM ek) AS ise FROM t",
       g="SELECT run_id, evalue, sum(CASE WHEN ist THEN 1 ELSE 0 END) AS t, sum(CASE WHEN NOT ist AND ise THEN weight ELSE 0 END) AS d FROM m, w GROUP BY 1, 2",
       c="SELECT *, sum(t) OVER w2 AS tt, sum(d) OVER w2 AS dd FROM g WINDOW w2 AS (PARTITION BY run_id ORDER BY evalue)",
       q="SELECT run_id, evalue, least(1.0, min(dd / tt) OVER (PARTITION BY run_id ORDER BY evalue DESC)) AS qvalue FROM c WHERE t > 0") +
       "SELECT m.idx, m.pos, m.seq, round(q.qvalue, 6) AS qvalue FROM m JOIN q USING (run_id, evalue) WHERE ist")
def q7(spark, sf):
    p = V.proteins(spark, sf)
    target = D.db_kmers(p.filter("genus = 'en'"), 7, 7)
    entrap = D.db_kmers(p.filter("genus <> 'en'"), 7, 7)
    return D.entrapment_q(V.db_tags(spark, sf), target, entrap).select("idx", "pos", "seq", F.round("qvalue", 6).alias("qvalue"))


Q_TDC = ("SELECT run, score, sum(CASE WHEN is_decoy THEN 1 ELSE 0 END) AS d, sum(CASE WHEN is_decoy THEN 0 ELSE 1 END) AS t FROM p GROUP BY 1, 2")
Q_TDC2 = "SELECT *, (sum(d) OVER w + 1.0) / greatest(1, sum(t) OVER w) AS fdr FROM g WINDOW w AS (PARTITION BY run ORDER BY score DESC)"


@query("Q8_target_decoy_q", V.cte(p=V.Q_PSMS, g=Q_TDC, c=Q_TDC2) + "SELECT run, score, round(least(1.0, min(fdr) OVER (PARTITION BY run ORDER BY score)), 6) AS qvalue FROM c")
def q8(spark, sf):
    return D.target_decoy_q(V.psms(spark, sf), ["run"]).select("run", "score", F.round("qvalue", 6).alias("qvalue"))


@query("Q9_subset_q", V.cte(p0=V.Q_PSMS, p="SELECT * FROM p0 WHERE label", g=Q_TDC, c=Q_TDC2) + "SELECT run, score, round(least(1.0, min(fdr) OVER (PARTITION BY run ORDER BY score)), 6) AS qvalue FROM c")
def q9(spark, sf):
    p = V.psms(spark, sf)
    return D.subset_q(p, p.filter("label"), "key", ["run"]).select("run", "score", F.round("qvalue", 6).alias("qvalue"))
