"""Queries over run quality, digestion, labels and alkylation, and scalar functions."""
from __future__ import annotations

from pyspark.sql import functions as F

from ionweave.functions import constants as C, scalar as S
from ionweave.operators import alkylation as A, digest as G, quality as K
from ionweave.plans import q_tagging as QT, views as V
from ionweave.plans.registry import query

KEY = ["run_id", "idx"]


# ------------------------------------------------------------------ digest
DT = ["l_orderkey % 4 AS run_id", "l_orderkey AS idx", "CASE l_returnflag WHEN 'A' THEN 'GASK' WHEN 'N' THEN 'PVTR' ELSE 'LNDQ' END AS seq", "l_tax > 0.07 AS gapped", "l_discount * 15 AS evalue",
      "round(l_extendedprice % 300, 2) AS cterm_mass", "round(l_extendedprice * 7 % 300, 2) AS nterm_mass"]
Q_DT = "SELECT " + ", ".join(DT) + " FROM lineitem"
Q_KEYS = V.literal(G.RESIDUE_KEYS, "key, key_mass, residue")
Q_ENDS = ("SELECT d.run_id, d.seq, k.key, k.residue, x.kind FROM (SELECT run_id, seq, 'c' AS kind, cterm_mass AS m FROM d WHERE NOT gapped AND evalue <= 1 UNION ALL SELECT run_id, seq, 'h', nterm_mass - 18.010565 FROM d WHERE NOT gapped AND evalue <= 1 UNION ALL SELECT run_id, seq, 'n', nterm_mass FROM d WHERE NOT gapped AND evalue <= 1) x "
          "JOIN keys k ON x.m BETWEEN k.key_mass - 0.0083 AND k.key_mass + 0.0083")
Q_ENDS = Q_ENDS.replace("SELECT d.run_id, d.seq, k.key", "SELECT x.run_id, x.seq, k.key")
ENDS = dict(d=Q_DT, keys=Q_KEYS, e=Q_ENDS)
WIN = 0.0083


def dtags(spark, sf):
    return V.table(spark, sf, "lineitem").selectExpr(*DT)


def _lab() -> str:
    parts = []
    for n, m in G.LABELS:
        for kind, c, mm in (("lab_n", "nterm_mass", m), ("lab_c", "cterm_mass", m), ("bg_n", "nterm_mass", m + 0.5), ("bg_c", "cterm_mass", m + 0.5)):
            parts.append(f"SELECT run_id, '{n}' AS key, '{kind}' AS kind, count(*) AS n FROM d WHERE NOT gapped AND evalue <= 1 AND abs({c} - {mm!r}) <= 0.0083 GROUP BY 1")
    return " UNION ALL ".join(parts)


@query("G1_terminus_counts", V.cte(**ENDS) + "SELECT run_id, key, kind, count(*) AS n FROM e GROUP BY 1, 2, 3 UNION ALL " + _lab())
def g1(spark, sf):
    return G.terminus_counts(dtags(spark, sf), WIN)


@query("G2_position_counts", V.cte(**ENDS, s="SELECT *, CASE WHEN kind = 'n' THEN 'N' ELSE 'C' END AS side, CASE WHEN kind = 'c' THEN reverse(seq) ELSE seq END AS w FROM e WHERE residue IS NOT NULL",
       x="SELECT run_id, side, residue AS p1, 1 AS position, residue FROM s UNION ALL SELECT run_id, side, residue, i + 1, substr(w, i, 1) FROM s, (SELECT unnest([1, 2, 3]) AS i)") + "SELECT run_id, side, p1, CAST(position AS INT) AS position, residue, count(*) AS n FROM x GROUP BY 1, 2, 3, 4, 5")
def g2(spark, sf):
    return G.position_counts(dtags(spark, sf), WIN)


@query("G3_composition", V.cte(prot=V.Q_PROTEINS, c="SELECT genus, r AS residue, count(*) AS n FROM (SELECT genus, unnest(string_split(sequence, '')) AS r FROM prot) WHERE r <> '#' AND r <> '' GROUP BY 1, 2") + "SELECT genus, residue, n, round(n / CAST(sum(n) OVER (PARTITION BY genus) AS DOUBLE), 9) AS freq FROM c")
def g3(spark, sf):
    return G.composition(V.proteins(spark, sf), ["genus"]).withColumn("freq", F.round("freq", 9))


RULES = {"Trypsin": ("KR", "*"), "Lys-C": ("K", "*"), "Arg-C": ("R", "*"), "Glu-C": ("E", "*"), "Asp-N": ("*", "D"), "Chymotrypsin": ("FWYL", "*"), "Lys-N": ("*", "K"), "unspecific": ("*", "*")}


def _bg(spark, sf):
    return G.composition(V.proteins(spark, sf), []).select("residue", "freq")


def _p1(spark, sf):
    return G.position_counts(dtags(spark, sf), WIN).filter("position = 1").groupBy("run_id", "side", "residue").agg(F.sum("n").alias("n"))


def _calls(spark, sf):
    bg = _bg(spark, sf)
    return G.classify_protease(_p1(spark, sf), G.protease_models(spark, bg, RULES), bg, 0.15, 20)


Q_GRID = ("SELECT m, s, residue, ln(p / sum(p) OVER (PARTITION BY m, s)) AS lp FROM (SELECT m, s, bg.residue, 0.85 * CASE WHEN ends = '*' THEN bg.freq WHEN contains(ends, bg.residue) THEN 1.0 / length(ends) ELSE 0 END + 0.15 * bg.freq AS p FROM rules CROSS JOIN bg)")


@query("G4_classify_protease", V.cte(**ENDS, prot=V.Q_PROTEINS, c="SELECT r AS residue, count(*) AS n FROM (SELECT unnest(string_split(sequence, '')) AS r FROM prot) WHERE r <> '#' AND r <> '' GROUP BY 1", bg="SELECT residue, n / CAST(sum(n) OVER () AS DOUBLE) AS freq FROM c",
       rules=V.literal([(m, s, x) for m, e in RULES.items() for s, x in zip("CN", e)], "m, s, ends"), grid=Q_GRID, p1="SELECT run_id, CASE WHEN kind = 'n' THEN 'N' ELSE 'C' END AS side, residue, count(*) AS n FROM e WHERE residue IS NOT NULL GROUP BY 1, 2, 3",
       t="SELECT run_id, side, sum(n) AS t FROM p1 GROUP BY 1, 2 HAVING sum(n) >= 20") +
       "SELECT p1.run_id, grid.m AS model, round(sum(p1.n * lp), 4) AS loglik FROM p1 JOIN t USING (run_id, side) JOIN grid ON grid.s = p1.side AND grid.residue = p1.residue WHERE run_id IN (SELECT run_id FROM t WHERE side = 'C') GROUP BY 1, 2")
def g4(spark, sf):
    return _calls(spark, sf).select("run_id", "model", F.round("loglik", 4).alias("loglik"))


@query("G5_flank2_counts")
def g5(spark, sf):
    return G.flank2_counts(dtags(spark, sf), G.flank2_bins(spark, WIN), WIN)


@query("G5_classify_flank2")
def g5b(spark, sf):
    bg, bins = _bg(spark, sf), G.flank2_bins(spark, WIN)
    return G.classify_flank2(G.flank2_counts(dtags(spark, sf), bins, WIN), bins, G.protease_models(spark, bg, RULES), bg).select("run_id", "model", F.round("loglik", 3).alias("loglik"), "rank")


@query("G6_p_correct", "SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(-1.5 + 2.0 * l_discount + 0.1 * ln(greatest(l_quantity, 1)) + 0.3 * CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END))), 9) AS p FROM lineitem")
def g6(spark, sf):
    t = V.table(spark, sf, "lineitem")
    return t.select("l_orderkey", "l_linenumber", F.round(G.p_correct(F.col("l_discount"), F.col("l_quantity"), F.col("l_returnflag") == "N", (-1.5, 2.0, 0.1, 0.3)), 9).alias("p"))


@query("G7_digest_report")
def g7(spark, sf):
    return G.digest_report(dtags(spark, sf), _calls(spark, sf)).select("run_id", "section", "key", "value")


@query("G8_label_call", V.cte(**ENDS, lab=_lab(), t="SELECT run_id, count(*) AS tags FROM d WHERE NOT gapped AND evalue <= 1 GROUP BY 1", r="SELECT run_id, count(*) AS tot, sum(CASE WHEN key[1] IN ('K', 'R') THEN 1 ELSE 0 END) AS kr FROM e WHERE kind IN ('c', 'h') GROUP BY 1") +
       "SELECT t.run_id, tags, coalesce(tot, 0) AS tot, CASE WHEN coalesce(tot, 0) >= 175 THEN 'call' ELSE 'no_call' END AS status FROM t LEFT JOIN r USING (run_id)")
def g8(spark, sf):
    d = dtags(spark, sf)
    return G.label_call(d, G.terminus_counts(d, WIN)).select("run_id", "tags", "tot", "status")


@query("G9_digest_quality")
def g9(spark, sf):
    q = G.digest_quality(G.position_counts(dtags(spark, sf), WIN), "KR", _bg(spark, sf), 20)
    return q.select("run_id", "ends", "specific", "measured", *[F.round(c, 6).alias(c) for c in ("nonspecific_share", "nonspecific_mle", "mc_retention")])


META = ["p_partkey AS run_id", "CASE p_size % 5 WHEN 0 THEN 'timsTOF Pro' WHEN 1 THEN 'Orbitrap Fusion' WHEN 2 THEN 'Q Exactive' WHEN 3 THEN '' ELSE 'TripleTOF' END AS instrument", "p_size / 50.0 AS integer_share", "p_brand LIKE '%5' AS has_mobility", "p_size % 7 = 0 AS orbitrap", "p_size % 11 = 0 AS iontrap",
        "p_size % 3 AS ms2_itms", "p_size % 4 AS ms2_ftms", "p_size % 2 AS ms2_beam", "p_size % 3 AS ms2_resonance"]


@query("G10_instrument_class", V.cte(m="SELECT " + ", ".join(META) + " FROM part") + "SELECT run_id, CASE WHEN instrument = 'timsTOF Pro' OR has_mobility OR (instrument = '' AND integer_share >= 0.5) THEN 'timstof' WHEN NOT (orbitrap OR instrument IN ('Orbitrap Fusion', 'Q Exactive')) OR ms2_itms > ms2_ftms THEN 'other' "
       "WHEN ms2_beam + ms2_resonance > 0 THEN CASE WHEN ms2_beam > ms2_resonance THEN 'orbitrap_hcd' ELSE 'other' END WHEN instrument = 'Q Exactive' OR (orbitrap AND NOT iontrap) THEN 'orbitrap_hcd' ELSE 'other' END AS instrument_class FROM m")
def g10(spark, sf):
    return G.instrument_class(V.table(spark, sf, "part").selectExpr(*META)).select("run_id", "instrument_class")


# ------------------------------------------------------------------ alkylation
CY = ["l_orderkey % 4 AS run_id", "l_orderkey AS idx", "l_linenumber AS ln", "CAST(l_suppkey AS STRING) AS seq", "l_discount AS evalue", "CASE l_returnflag WHEN 'A' THEN 'SACKTAGR' WHEN 'N' THEN 'TAGSMCAR' ELSE 'GCCTAGK' END AS peptide",
      "CAST(l_partkey % 3 AS INT) AS start", "CAST(CASE l_returnflag WHEN 'A' THEN 4 WHEN 'N' THEN 0 ELSE 3 END AS INT) AS tag_pos", "3 AS tag_len", "l_returnflag <> 'A' AS nterm_match", "l_returnflag <> 'N' AS cterm_match",
      "CASE CAST(l_quantity AS INT) % 4 WHEN 0 THEN 0.003 WHEN 1 THEN 14.0157 WHEN 2 THEN -57.0215 ELSE 87.032 END AS delta_mass"]


@query("A1_cys_evaluate", V.cte(p="SELECT l_returnflag AS f, l_partkey % 3 AS st, CAST(l_quantity AS INT) % 4 AS q FROM lineitem") +
       "SELECT f, st, q, CASE WHEN f = 'R' THEN 'multi_cys' WHEN f = 'A' AND st = 0 THEN 'protein_nterm' WHEN f = 'A' AND q = 3 THEN 'truncation' WHEN f = 'N' AND q = 3 THEN 'unexplained' ELSE 'binned' END AS outcome, count(*) AS n FROM p GROUP BY 1, 2, 3, 4")
def a1(spark, sf):
    t = V.table(spark, sf, "lineitem")
    e = A.cys_evaluate(t.selectExpr(*CY, "l_returnflag AS f", "l_partkey % 3 AS st", "CAST(l_quantity AS INT) % 4 AS q"))
    return e.groupBy("f", "st", "q", "outcome").agg(F.count(F.lit(1)).alias("n"))


VT = ["l_orderkey % 4 AS run_id", "l_orderkey AS idx", "CAST(l_suppkey AS {0}) AS seq", "l_discount AS evalue", "CASE WHEN l_linenumber = 4 THEN 'no_cys' WHEN l_tax < 0.01 THEN 'unexplained' ELSE 'binned' END AS outcome",
      "CASE WHEN l_tax >= 0.01 THEN CASE WHEN l_returnflag = 'N' THEN 'none' ELSE 'Carbamidomethyl' END END AS cls", "CASE WHEN l_tax >= 0.01 THEN CASE WHEN l_returnflag = 'N' THEN 'unmodified' ELSE 'Carbamidomethyl' END END AS form"]
Q_VOTE = dict(v="SELECT " + ", ".join(VT).format("VARCHAR") + " FROM lineitem", t="SELECT run_id, idx, seq, evalue, count(DISTINCT coalesce(cls, '?')) AS k, min(coalesce(cls, '?')) AS c FROM v WHERE outcome IN ('binned', 'unexplained') GROUP BY 1, 2, 3, 4",
              w="SELECT *, row_number() OVER (PARTITION BY run_id, idx ORDER BY evalue, seq) AS r FROM t", o="SELECT run_id, idx, CASE WHEN k > 1 THEN 'conflict' WHEN c = '?' THEN 'unexplained' ELSE c END AS vote FROM w WHERE r = 1")


def _votes(spark, sf):
    return A.cys_votes(V.table(spark, sf, "lineitem").selectExpr(*[e.format("STRING") for e in VT]))


@query("A2_cys_votes", V.cte(**Q_VOTE) + "SELECT run_id, idx, vote FROM o")
def a2(spark, sf):
    return _votes(spark, sf).select("run_id", "idx", "vote")


@query("A3_alkylation_call", V.cte(**Q_VOTE, n="SELECT run_id, vote, count(*) AS n FROM o WHERE vote NOT IN ('conflict', 'unexplained') GROUP BY 1, 2", g="SELECT run_id, arg_max(vote, n) AS cls, sum(n) AS binned, max(n) AS top FROM n GROUP BY 1") +
       "SELECT run_id, cls, binned, top, round(top / CAST(binned AS DOUBLE), 9) AS share, CASE WHEN binned < 10 THEN 'few_cys_spectra' WHEN top < 10 OR top / CAST(binned AS DOUBLE) < 0.6 THEN 'ambiguous' ELSE '-' END AS reason FROM g")
def a3(spark, sf):
    return A.alkylation_call(_votes(spark, sf)).select("run_id", "cls", "binned", "top", F.round("share", 9).alias("share"), "reason")


@query("A4_alkylation_tags")
def a4(spark, sf):
    v = A.alkylation_tags(V.spectra(spark, sf), V.peaks(spark, sf), QT.PARAMS, 20.0)
    return v.groupBy("run_id", "vote", "form").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ run quality
@query("K1_analyzer_class", "SELECT p_partkey AS idx, CASE p_size % 4 WHEN 0 THEN 'FTMS' WHEN 1 THEN 'ITMS' WHEN 2 THEN CASE WHEN p_size > 25 THEN 'TOF' ELSE 'FTMS' END ELSE 'other' END AS analyzer FROM part")
def k1(spark, sf):
    p = V.table(spark, sf, "part").selectExpr("p_partkey AS idx", "CASE p_size % 4 WHEN 0 THEN 'FTMS + p NSI' WHEN 1 THEN 'ITMS + c' END AS f", "CASE WHEN p_size % 4 = 2 AND p_size > 25 THEN 'quadrupole TOF' END AS c", "CASE WHEN p_size % 4 = 2 THEN 'Orbitrap' END AS r")
    return p.select("idx", K.analyzer_class(F.col("f"), F.col("c"), F.col("r")).alias("analyzer"))


@query("K2_scan_counts", "SELECT * FROM (SELECT p_partkey % 4 AS run_id, p_size % 2 + 1 AS ms_level, p_brand AS analyzer, p_size % 3 AS source, count(*) AS n FROM part GROUP BY CUBE (p_partkey % 4, p_size % 2 + 1, p_brand, p_size % 3)) WHERE run_id IS NOT NULL")
def k2(spark, sf):
    return K.scan_counts(V.table(spark, sf, "part").selectExpr("p_partkey % 4 AS run_id", "p_size % 2 + 1 AS ms_level", "p_brand AS analyzer", "p_size % 3 AS source"))


@query("K3_charge_histogram", "SELECT p_partkey % 4 AS run_id, p_size % 5 AS charge, count(*) AS n FROM part GROUP BY 1, 2")
def k3(spark, sf):
    return K.charge_histogram(V.spectra(spark, sf))


@query("K4_stated_resolution", "SELECT p_partkey % 4 AS run_id, p_brand AS analyzer, count(*) AS n, round(median(p_retailprice), 6) AS resolution FROM part GROUP BY 1, 2")
def k4(spark, sf):
    p = V.table(spark, sf, "part").selectExpr("p_partkey % 4 AS run_id", "p_brand AS analyzer", "p_retailprice AS stated_resolution")
    return K.stated_resolution(p).withColumn("resolution", F.round("resolution", 6))


@query("K4_measured_resolution")
def k4b(spark, sf):
    s = V.spectra(spark, sf).select(*KEY, F.lit("FTMS").alias("analyzer"), F.lit(2).alias("ms_level"), F.lit(True).alias("profile"))
    p = V.peaks(spark, sf).groupBy(*KEY, "mz").agg(F.max("intensity").alias("intensity"))
    return K.measured_resolution(p, s).withColumn("resolution", F.round("resolution", 4))


Q_CH = V.literal([(c, m, "TMT") for c, m in K.TMT_CHANNELS] + [(c, m, "iTRAQ") for c, m in K.ITRAQ_CHANNELS], "channel, cmz, family")
RP = ["l_partkey % 4 AS run_id", "l_partkey AS idx", "CASE WHEN l_discount > 0.04 THEN 126.1277 + CAST(l_linenumber AS DOUBLE) * 1.00335 ELSE 100 + l_extendedprice % 900 END AS mz", "l_quantity * CASE WHEN l_discount > 0.04 THEN 5 ELSE 1 END AS intensity"]
REP = dict(p="SELECT " + ", ".join(RP) + " FROM lineitem", ch=Q_CH, med="SELECT run_id, idx, median(intensity) AS bg FROM p GROUP BY 1, 2",
           b="SELECT run_id, idx, channel, family, max(intensity) AS y FROM p JOIN ch ON p.mz BETWEEN cmz * (1 - 20e-6) AND cmz * (1 + 20e-6) GROUP BY 1, 2, 3, 4", seen="SELECT run_id, idx, channel, family FROM b JOIN med USING (run_id, idx) WHERE y >= 3 * bg")


def _rp(spark, sf):
    return V.table(spark, sf, "lineitem").selectExpr(*RP)


@query("K5_reporters_seen", V.cte(**REP) + "SELECT run_id, idx, channel, family FROM seen")
def k5(spark, sf):
    return K.reporters_seen(_rp(spark, sf))


@query("K6_call_kits", V.cte(**REP, fam="SELECT 'TMT' AS family, 126.127726 AS m UNION ALL SELECT 'iTRAQ', 113.1078", low="SELECT run_id, idx, min(mz) AS low FROM p GROUP BY 1, 2",
       a="SELECT s.p_partkey % 4 AS run_id, s.p_partkey AS idx, family, low IS NOT NULL AND low <= m - 0.5 AND s.p_size % 6 <> 0 AS ok FROM part s CROSS JOIN fam LEFT JOIN low l ON l.idx = s.p_partkey",
       n="SELECT run_id, family, count(*) FILTER (ok) AS n_ok FROM a GROUP BY 1, 2", o="SELECT s.run_id, s.family, s.channel FROM seen s JOIN a ON a.idx = s.idx AND a.family = s.family AND a.ok JOIN n ON n.run_id = s.run_id AND n.family = s.family GROUP BY 1, 2, 3, n_ok HAVING count(*) >= 0.2 * n_ok",
       kits=V.literal([(k, "TMT" if k.startswith("tmt") else "iTRAQ", "," + ",".join(c) + ",") for k, c in K.KITS.items()], "kit, family, chans")) +
       "SELECT n.run_id, kit, CASE WHEN n_ok < 20 THEN 'not_assessable' WHEN (SELECT count(*) FROM o WHERE o.run_id = n.run_id AND o.family = n.family) >= 3 AND NOT EXISTS (SELECT 1 FROM o WHERE o.run_id = n.run_id AND o.family = n.family AND NOT contains(kits.chans, ',' || o.channel || ',')) THEN 'present' ELSE 'absent' END AS state FROM n JOIN kits USING (family)")
def k6(spark, sf):
    p = _rp(spark, sf)
    s = V.table(spark, sf, "part").selectExpr("p_partkey % 4 AS run_id", "p_partkey AS idx", "CASE WHEN p_size % 6 = 0 THEN 'ITMS' ELSE 'FTMS' END AS analyzer", "CAST(NULL AS DOUBLE) AS scan_low")
    return K.call_kits(K.assess_reporters(s, p.groupBy(*KEY).agg(F.min("mz").alias("low_mz"))), K.reporters_seen(p))


@query("K7_tag_yield", "SELECT o_custkey % 4 AS run_id, round(avg(CASE WHEN o_totalprice <= 50000 THEN 1.0 ELSE 0 END), 9) AS tag_yield FROM orders GROUP BY 1")
def k7(spark, sf):
    return K.tag_yield(V.table(spark, sf, "orders").selectExpr("o_custkey % 4 AS run_id", "o_totalprice AS best_evalue"), 50000).withColumn("tag_yield", F.round("tag_yield", 9))


Q_OUT = ("SELECT s.run_id, s.idx, ((precursor_mz - " + repr(C.PROTON) + ") * z + y * " + repr(C.PROTON) + ") / y + d / y AS m FROM (SELECT *, unnest(CASE WHEN charge > 0 THEN [charge] ELSE [2, 3] END) AS z FROM spectra) s, (SELECT unnest(range(1, 9)) AS y) yy, (SELECT unnest([0.0, -18.0105647, -17.0265491, " + repr(C.ISOTOPE_STEP) + "]) AS d) dd WHERE y <= z")
Q_FIX = V.literal([(m,) for m in [m for _, m in K.TMT_CHANNELS + K.ITRAQ_CHANNELS] + K.IMMONIUM], "m")


@query("K8_fingerprints", V.cte(peaks=V.Q_PEAKS, spectra=V.Q_SPECTRA, ou=Q_OUT, fx=Q_FIX, k="SELECT * FROM peaks p WHERE NOT EXISTS (SELECT 1 FROM fx WHERE abs(fx.m - p.mz) <= 0.3) AND NOT EXISTS (SELECT 1 FROM ou WHERE ou.run_id = p.run_id AND ou.idx = p.idx AND abs(ou.m - p.mz) <= 0.3)",
       r="SELECT *, row_number() OVER (PARTITION BY run_id, idx ORDER BY intensity DESC, mz) AS r FROM k", b="SELECT run_id, idx, CAST(round(mz / 1.0005079) AS INT) AS bin, sum(sqrt(intensity)) AS v FROM r WHERE r <= 50 GROUP BY 1, 2, 3") +
       "SELECT run_id, idx, bin, round(v / sqrt(sum(v * v) OVER (PARTITION BY run_id, idx)), 6) AS w FROM b")
def k8(spark, sf):
    return K.fingerprints(V.peaks(spark, sf), V.spectra(spark, sf), 0.3, False).withColumn("w", F.round("w", 6))


EM = "SELECT label % 4 AS run_id, vec_id AS idx, 500 + (vec_id % 3) * 0.001 AS precursor_mz, label % 3 + 1 AS charge, vec_id * 0.7 AS rt FROM embeddings"


def _vec(spark, sf):
    e = V.table(spark, sf, "embeddings")
    s = e.selectExpr("label % 4 AS run_id", "vec_id AS idx", "500 + (vec_id % 3) * 0.001D AS precursor_mz", "label % 3 + 1 AS charge", "vec_id * 0.7D AS rt", "CAST(NULL AS DOUBLE) AS ion_mobility")
    p = e.select((F.col("label") % 4).alias("run_id"), F.col("vec_id").alias("idx"), F.posexplode("embedding").alias("bin", "w")).withColumn("w", F.col("w").cast("double"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(G.W.partitionBy("run_id", "idx")))
    return s, p.withColumn("w", F.col("w") / norm)


@query("K9_redundant_pairs", V.cte(s=EM, e="SELECT label % 4 AS run_id, vec_id AS idx, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS nrm FROM embeddings",
       p="SELECT a.run_id, CASE WHEN a.precursor_mz < b.precursor_mz OR (a.precursor_mz = b.precursor_mz AND a.idx < b.idx) THEN a.idx ELSE b.idx END AS a, CASE WHEN a.precursor_mz < b.precursor_mz OR (a.precursor_mz = b.precursor_mz AND a.idx < b.idx) THEN b.idx ELSE a.idx END AS b FROM s a JOIN s b ON a.run_id = b.run_id AND a.charge = b.charge AND a.idx < b.idx AND abs(a.rt - b.rt) <= 60 AND abs(a.precursor_mz - b.precursor_mz) <= 0.004",
       c="SELECT p.run_id, p.a, p.b, (SELECT sum(CAST(x.embedding[i] AS DOUBLE) * y.embedding[i]) FROM (SELECT unnest(range(1, len(x.embedding) + 1)) AS i)) / (x.nrm * y.nrm) AS sim FROM p JOIN e x ON x.run_id = p.run_id AND x.idx = p.a JOIN e y ON y.run_id = p.run_id AND y.idx = p.b") +
       "SELECT run_id, a, b, round(sim, 5) AS sim FROM c WHERE sim >= 0.3")
def k9(spark, sf):
    return K.redundant_pairs(*_vec(spark, sf), min_cosine=0.3).withColumn("sim", F.round("sim", 5))


@query("K10_redundancy_clusters")
def k10(spark, sf):
    s, p = _vec(spark, sf)
    return K.redundancy_clusters(K.redundant_pairs(s, p, min_cosine=0.3), s)


@query("K11_qc_report", V.cte(f="SELECT o_custkey % 4 AS run_id, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1") + "SELECT run_id, 'qc' AS section, 'n' AS key, CAST(n AS VARCHAR) AS value FROM f UNION ALL SELECT run_id, 'qc', 'customers', CAST(customers AS VARCHAR) FROM f")
def k11(spark, sf):
    f = V.table(spark, sf, "orders").groupBy((F.col("o_custkey") % 4).alias("run_id")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("customers"))
    return K.qc_report(f)


@query("K12_fasta_summary", V.cte(p="SELECT lang AS database, CASE WHEN doc_id % 5 = 0 THEN 'rev_' || source ELSE source END AS accession, doc_id % 5 = 0 AS d, " + V.FOLD.format("text") + " AS s FROM documents") + "SELECT database, count(*) AS entries, sum(length(s)) AS residues, count(*) FILTER (d) AS decoys, CASE WHEN count(*) FILTER (d) > 0 THEN 'rev_' END AS affix FROM p GROUP BY 1")
def k12(spark, sf):
    d = V.table(spark, sf, "documents")
    return K.fasta_summary(d.select(F.col("lang").alias("database"), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("rev_"), "source")).otherwise(F.col("source")).alias("accession"), S.fold_residues("text").alias("sequence")))


@query("K13_run_overview", "SELECT run_id, c.protease, c.label, o.n_orders FROM (SELECT c_custkey AS run_id, CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment END AS protease, CASE WHEN c_nationkey % 3 = 0 THEN 'TMT' END AS label FROM customer WHERE c_nationkey % 2 = 0 OR c_nationkey % 3 = 0) c FULL JOIN (SELECT o_custkey AS run_id, count(*) AS n_orders FROM orders GROUP BY 1) o USING (run_id)")
def k13(spark, sf):
    c = V.table(spark, sf, "customer")
    a = c.filter("c_nationkey % 2 = 0").selectExpr("c_custkey AS run_id", "'call' AS section", "'protease' AS key", "c_mktsegment AS value")
    b = c.filter("c_nationkey % 3 = 0").selectExpr("c_custkey AS run_id", "'call' AS section", "'label' AS key", "'TMT' AS value")
    n = V.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("run_id")).agg(F.count(F.lit(1)).alias("n_orders"))
    return K.run_overview(a.unionByName(b), [n], ["protease", "label"])
