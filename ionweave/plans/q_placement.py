"""Queries over placements and the protein shortlist."""
from __future__ import annotations

from pyspark.sql import functions as F

from ionweave.functions import constants as K, scalar as S
from ionweave.operators import dbmatch as D, filters, placement as L, shortlist as N
from ionweave.plans import views as V
from ionweave.plans.q_identification import q_kmers
from ionweave.plans.registry import query

Q_OCC = ("SELECT DISTINCT t.seq, k.accession, k.pos - 1 AS pos, 7 AS len, t.rev AS reversed FROM (SELECT DISTINCT seq, seq AS kmer, false AS rev FROM t "
         "UNION SELECT seq, reverse(seq), true FROM t WHERE seq <> reverse(seq)) t JOIN k7 k ON t.kmer = k.kmer")
OCC = dict(prot=V.Q_PROTEINS, t=V.q_db_tags(7), k7=q_kmers(7, "accession"), occ=Q_OCC)


def _occ(spark, sf):
    return L.locate(V.db_tags(spark, sf), V.proteins(spark, sf))


def _windows(spark, sf, missed=1):
    return L.enzyme_windows(_occ(spark, sf), V.proteins(spark, sf), "Trypsin", missed)


def _tags(spark, sf):
    """Tags with flank masses: a spread of exact and shifted flanks of their own text."""
    t = V.db_tags(spark, sf)
    return t.withColumn("id0", F.col("idx") * 100000 + F.col("pos")).withColumn(
        "nterm_mass", F.col("pos") * 7.5 % 900).withColumn("cterm_mass", F.col("pos") * 3.25 % 700).drop("pos")


@query("L1_locate", V.cte(**OCC) + "SELECT accession, reversed, count(*) AS n, sum(pos) AS s FROM occ GROUP BY 1, 2")
def l1(spark, sf):
    return _occ(spark, sf).groupBy("accession", "reversed").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("s"))


Q_SITES = ("SELECT accession, b, row_number() OVER (PARTITION BY accession ORDER BY b) - 1 AS n FROM (SELECT accession, 0 AS b FROM prot UNION SELECT accession, length(sequence) FROM prot UNION "
           "SELECT accession, i FROM (SELECT accession, sequence, unnest(range(1, length(sequence))) AS i FROM prot) WHERE substr(sequence, i, 1) IN ('K', 'R') AND substr(sequence, i + 1, 1) <> 'P')")


@query("L2_digest_windows", V.cte(**OCC, sites=Q_SITES,
       a="SELECT o.*, max(s.n) AS s0 FROM occ o JOIN sites s ON o.accession = s.accession AND s.b <= o.pos GROUP BY ALL",
       b="SELECT a.*, min(s.n) AS e0 FROM a JOIN sites s ON a.accession = s.accession AND s.b >= a.pos + a.len GROUP BY ALL",
       w="SELECT b.accession, b.pos, s.b AS start, e.b AS fin FROM b JOIN sites s ON s.accession = b.accession AND s.n IN (b.s0, b.s0 - 1) JOIN sites e ON e.accession = b.accession AND e.n IN (b.e0, b.e0 + 1) WHERE e.n - s.n - 1 <= 1 AND e.b > s.b") +
       "SELECT accession, count(*) AS n, sum(start) AS s, sum(fin) AS e FROM w GROUP BY 1")
def l2(spark, sf):
    w = _windows(spark, sf)
    return w.groupBy("accession").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("s"), F.sum("end").alias("e"))


@query("L3_windows_by_mass")
def l3(spark, sf):
    o = _occ(spark, sf).withColumn("want_n", F.col("pos") * 11.5 % 700).withColumn("want_c", F.col("pos") * 5.25 % 700)
    w = L.windows_by_mass(o, V.proteins(spark, sf), 3.0)
    return w.groupBy("accession").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("s"), F.sum("end").alias("e"))


@query("L4_cleavage_filter")
def l4(spark, sf):
    w = L.cleavage_filter(_windows(spark, sf), V.proteins(spark, sf), "Lys-C", "semi")
    return w.groupBy("accession").agg(F.count(F.lit(1)).alias("n"), F.sum("end").alias("e"))


def _placements(spark, sf):
    r = L.reconcile(_tags(spark, sf), _windows(spark, sf), V.proteins(spark, sf), 5.0, False)
    return r.withColumn("id", F.xxhash64("id0", "accession", "pos", "start", "end", "reversed"))


@query("L5_reconcile")
def l5(spark, sf):
    return _placements(spark, sf).select("idx", "seq", "accession", "start", "end", "nterm_match", "cterm_match", F.round("delta_mass", 4).alias("delta_mass"), "region_lo", "region_hi")


MODS = [("Oxidation", "M", 15.9949, 0), ("Phospho", "STY", 79.9663, 1), ("Carbamyl", "", 43.0058, 2), ("Methyl", "KR", 14.0157, 3), ("Deamidated", "NQ", 0.984, 4)]
GAPS = ["round(l_extendedprice % 200 - 60, 2) AS delta_mass", "CASE l_returnflag WHEN 'A' THEN 'GMS' WHEN 'N' THEN 'KNV' ELSE 'WF' END AS region"]
SUBS = [(x, y, K.RESIDUES[y] - K.RESIDUES[x], L.SUBSTITUTION_ORDER.index(y)) for x in K.RESIDUES for y in L.SUBSTITUTION_ORDER if x != y]


@query("L6_interpret_delta", V.cte(g0="SELECT DISTINCT " + ", ".join(GAPS) + " FROM lineitem", g="SELECT row_number() OVER (ORDER BY delta_mass, region) AS id, * FROM g0", mods=V.literal(MODS, "name, residues, delta, ord"), subs=V.literal(SUBS, "x, y, delta, yo"),
       c="SELECT id, abs(delta_mass - delta) AS err, 0 AS kind, ord, 'mod:' || name || '@' || CASE WHEN residues = '' THEN substr(region, 1, 1) ELSE (SELECT substr(region, i, 1) FROM (SELECT unnest([1, 2, 3]) AS i) WHERE i <= length(region) AND contains(residues, substr(region, i, 1)) ORDER BY i LIMIT 1) END AS interp FROM g JOIN mods ON abs(delta_mass - delta) <= 0.05 "
         "UNION ALL SELECT id, abs(delta_mass - delta), 1, instr(region, x) * 100 + yo, 'sub:' || x || '->' || y FROM g JOIN subs ON abs(delta_mass - delta) <= 0.05 AND contains(region, x)",
       b="SELECT id, interp, row_number() OVER (PARTITION BY id ORDER BY round(err, 9), kind, ord) AS r FROM c WHERE interp IS NOT NULL") +
       "SELECT g.region, g.delta_mass, CASE WHEN abs(delta_mass) > 1e-6 THEN coalesce(b.interp, '?') ELSE '' END AS delta_interp FROM g LEFT JOIN b ON g.id = b.id AND b.r = 1")
def l6(spark, sf):
    g = V.table(spark, sf, "lineitem").selectExpr(*GAPS).distinct().withColumn("id", F.struct("region", "delta_mass"))
    mods = spark.createDataFrame(MODS, "name string, residues string, delta double, ord int")
    return L.interpret_delta(g, mods, 0.05).select("region", "delta_mass", "delta_interp")


@query("L7_localize")
def l7(spark, sf):
    return L.localize(_placements(spark, sf), V.peaks(spark, sf), 0.5, charges=1).drop("loc_excluded")


@query("L7_localize_models")
def l7b(spark, sf):
    """The three models side by side, two fragment charges; their twin is in the tests."""
    return L.localize_models(_placements(spark, sf), V.peaks(spark, sf), 0.5, charges=2)


@query("L8_classify_placement", "SELECT l_returnflag, l_linestatus, CASE WHEN nm AND cm THEN 'exact' WHEN (NOT nm AND cm AND abs(d - 4) <= 1.5) OR (nm AND NOT cm AND abs(d - 7) <= 0.5) THEN 'label_exact' ELSE 'gapped' END AS class, count(*) AS n "
       "FROM (SELECT *, l_returnflag = 'N' AS nm, l_linenumber % 2 = 0 AS cm, l_tax * 100 AS d FROM lineitem) GROUP BY 1, 2, 3")
def l8(spark, sf):
    t = V.table(spark, sf, "lineitem")
    c = L.classify_placement(F.col("l_returnflag") == "N", F.col("l_linenumber") % 2 == 0, F.col("l_tax") * 100, 4.0, 0.0, 1.5)
    c2 = L.classify_placement(F.col("l_returnflag") == "N", F.col("l_linenumber") % 2 == 0, F.col("l_tax") * 100, 0.0, 7.0, 0.5)
    return t.groupBy("l_returnflag", "l_linestatus", F.when(c2 == "label_exact", c2).otherwise(c).alias("class")).agg(F.count(F.lit(1)).alias("n"))


PL = ["l_orderkey AS idx", "l_orderkey * 10 + l_linenumber AS id", "l_discount AS evalue", "l_tax AS delta_mass", "l_returnflag AS peptide", "CAST(l_suppkey AS VARCHAR(20)) AS seq"]
PL_SPARK = [e.replace("VARCHAR(20)", "STRING") for e in PL]


@query("L9_best_placement", V.cte(p="SELECT " + ", ".join(PL) + " FROM lineitem", s="SELECT a.id, count(DISTINCT b.seq) AS support FROM p a JOIN p b ON a.idx = b.idx AND a.peptide = b.peptide AND b.delta_mass BETWEEN a.delta_mass - 0.02 AND a.delta_mass + 0.02 GROUP BY 1",
       r="SELECT p.*, s.support, row_number() OVER (PARTITION BY idx ORDER BY evalue, abs(delta_mass), p.id) AS r1, row_number() OVER (PARTITION BY idx ORDER BY support DESC, evalue, abs(delta_mass), p.id) AS r2 FROM p JOIN s ON p.id = s.id") +
       "SELECT 'best' AS mode, idx, id FROM r WHERE r1 = 1 UNION ALL SELECT 'consensus', idx, id FROM r WHERE r2 = 1")
def l9(spark, sf):
    p = V.table(spark, sf, "lineitem").selectExpr(*PL_SPARK)
    a = L.best_placement(p, ["idx"]).select(F.lit("best").alias("mode"), "idx", "id")
    return a.unionByName(L.best_placement(p, ["idx"], "consensus", 0.02).select(F.lit("consensus").alias("mode"), "idx", "id"))


# ------------------------------------------------------------------ shortlist
PROT = ["s_suppkey AS protein", "s_name AS accession", "CAST(100 + s_suppkey % 400 AS INT) AS length", "s_nationkey = 3 AS decoy"]
Q_PROT = "SELECT " + ", ".join(PROT) + " FROM supplier"
Q_EV = "SELECT * FROM ev0 WHERE evalue <= 0.05 AND exact"
Q_PER = "SELECT run_id, spectrum, e.protein, max(CASE WHEN exact THEN 1 ELSE 0 END) AS ex, min(evalue) AS best, min(accession) AS accession, min(length) AS length, bool_or(decoy) AS decoy FROM ev e JOIN pr ON e.protein = pr.protein GROUP BY 1, 2, 3"
Q_SH = "SELECT run_id, spectrum, count(*) AS targets FROM per WHERE NOT decoy GROUP BY 1, 2"
Q_TAB = ("SELECT p.run_id, p.protein, min(p.accession) AS accession, bool_or(p.decoy) AS decoy, count(*) AS spectra, sum(ex) AS exact_spectra, sum(1 - ex) AS gapped_spectra, round(sum(CASE WHEN p.decoy THEN 0 ELSE 1.0 / targets END), 9) AS weighted, "
         "min(best) AS best_evalue, min(p.length) AS length, min(w.n) AS peptides FROM per p LEFT JOIN sh USING (run_id, spectrum) JOIN (SELECT run_id, protein, count(DISTINCT win) AS n FROM ev GROUP BY 1, 2) w ON p.run_id = w.run_id AND p.protein = w.protein GROUP BY 1, 2")
Q_RANK = "SELECT *, CASE WHEN NOT decoy THEN row_number() OVER (PARTITION BY run_id ORDER BY decoy, spectra DESC, peptides DESC, weighted DESC, best_evalue, accession, protein) END AS rank FROM tab"
NS = dict(ev0=V.Q_EVIDENCE, ev=Q_EV, pr=Q_PROT, per=Q_PER, sh=Q_SH, tab=Q_TAB, rk=Q_RANK)


def _ev(spark, sf):
    return N.protein_evidence(V.evidence(spark, sf), 0.05)


def _table(spark, sf):
    return N.protein_table(_ev(spark, sf), V.table(spark, sf, "supplier").selectExpr(*PROT))


@query("N1_protein_evidence", V.cte(ev0=V.Q_EVIDENCE, ev=Q_EV) + "SELECT run_id, protein, count(*) AS n, count(DISTINCT spectrum) AS spectra FROM ev GROUP BY 1, 2")
def n1(spark, sf):
    return _ev(spark, sf).groupBy("run_id", "protein").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("spectrum").alias("spectra"))


@query("N2_protein_table", V.cte(**NS) + "SELECT run_id, protein, decoy, spectra, peptides, exact_spectra, gapped_spectra, round(weighted, 6) AS weighted, round(weighted / length, 6) AS nsaf, best_evalue FROM tab")
def n2(spark, sf):
    return _table(spark, sf).select("run_id", "protein", "decoy", "spectra", "peptides", "exact_spectra", "gapped_spectra", F.round("weighted", 6).alias("weighted"), F.round("nsaf", 6).alias("nsaf"), "best_evalue")


@query("N3_rank_proteins", V.cte(**NS) + "SELECT run_id, protein, rank FROM rk")
def n3(spark, sf):
    return N.rank_proteins(_table(spark, sf)).select("run_id", "protein", "rank")


SMALL = ["o_orderkey AS spectrum", "o_custkey AS protein"]


def _small_rank(spark, sf):
    """Evidence with many containments: orders by customer and part of the key."""
    ev = V.table(spark, sf, "lineitem").selectExpr("0 AS run_id", "l_suppkey * 7 + l_linenumber AS spectrum", "l_partkey AS protein")
    n = ev.distinct().groupBy("run_id", "protein").agg(F.count(F.lit(1)).alias("spectra"))
    n = n.withColumn("decoy", F.lit(False)).withColumn("accession", F.concat(F.lit("P"), F.col("protein").cast("string")))
    w = F.row_number().over(N.W.partitionBy("run_id").orderBy(F.desc("spectra"), "protein"))
    return n.withColumn("rank", w), ev


Q_SMALL = dict(e="SELECT DISTINCT l_suppkey * 7 + l_linenumber AS spectrum, l_partkey AS protein FROM lineitem",
               n="SELECT protein, count(*) AS spectra, row_number() OVER (ORDER BY count(*) DESC, protein) AS rank FROM e GROUP BY 1")


@query("N4_parsimony_subset", V.cte(**Q_SMALL, co="SELECT a.protein AS p, b.protein AS q, count(*) AS c FROM e a JOIN e b ON a.spectrum = b.spectrum AND a.protein <> b.protein GROUP BY 1, 2",
       s="SELECT p, q, nq.rank AS rq FROM co JOIN n np ON np.protein = p JOIN n nq ON nq.protein = q WHERE c = np.spectra AND nq.rank < np.rank AND np.spectra >= 1",
       k="SELECT p, min(rq) AS best FROM s WHERE q NOT IN (SELECT p FROM s) GROUP BY 1") + "SELECT n.protein, 'P' || CAST(m.protein AS VARCHAR) AS subset_of FROM n LEFT JOIN k ON n.protein = k.p LEFT JOIN n m ON m.rank = k.best")
def n4(spark, sf):
    r, ev = _small_rank(spark, sf)
    return N.parsimony_subset(r, ev, 1).select("protein", "subset_of")


@query("N5_parsimony_greedy")
def n5(spark, sf):
    r, ev = _small_rank(spark, sf)
    return N.parsimony_greedy(r, ev, 1).select("protein", "rank")


@query("N6_top_cap", V.cte(**NS, c="SELECT *, rank() OVER (PARTITION BY run_id ORDER BY spectra DESC, peptides DESC, weighted DESC, best_evalue) AS r FROM rk WHERE NOT decoy") + "SELECT run_id, protein FROM c WHERE r <= 10")
def n6(spark, sf):
    return N.top_cap(N.rank_proteins(_table(spark, sf)).filter("NOT decoy"), 10).select("run_id", "protein")


ENT = ["doc_id AS ordinal", "concat(source, '_', lang) AS accession", "text AS sequence"]


@query("N7_dedupe_entries", V.cte(d="SELECT " + ", ".join(ENT) + " FROM documents") + "SELECT accession, ordinal, min(ordinal) OVER (PARTITION BY accession, sequence) AS canonical, (SELECT count(DISTINCT sequence) > 1 FROM d x WHERE x.accession = d.accession) AS conflict FROM d")
def n7(spark, sf):
    return N.dedupe_entries(V.table(spark, sf, "documents").selectExpr(*ENT))


@query("N8_select_background", V.cte(b="SELECT doc_id AS ordinal, CASE WHEN lang = 'de' THEN 'rev_' || source ELSE source END AS accession, text AS sequence FROM documents", db="SELECT text AS sequence FROM documents WHERE lang = 'en' UNION ALL SELECT text FROM benchmark") +
       "SELECT min(ordinal) AS ordinal FROM b WHERE NOT starts_with(lower(accession), 'rev_') AND sequence NOT IN (SELECT sequence FROM db) GROUP BY sequence")
def n8(spark, sf):
    d = V.table(spark, sf, "documents")
    b = d.select(F.col("doc_id").alias("ordinal"), F.expr("CASE WHEN lang = 'de' THEN concat('rev_', source) ELSE source END").alias("accession"), F.col("text").alias("sequence"))
    db = d.filter("lang = 'en'").select(F.col("text").alias("sequence")).unionByName(V.table(spark, sf, "benchmark").select(F.col("text").alias("sequence")))
    return N.select_background(b, db, filters.decoy_flag(F.col("accession"))).select("ordinal")


SC = ["CAST(c_nationkey AS BIGINT) AS run_id", "c_mktsegment AS model", "CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'Trypsin' ELSE 'Glu-C' END AS cls", "c_acctbal"]


@query("N9_protease_verdict", V.cte(s="SELECT " + ", ".join(SC) + " FROM customer", g="SELECT run_id, model, min(cls) AS cls, sum(c_acctbal) AS loglik FROM s GROUP BY 1, 2", n="SELECT run_id, count(*) AS n_used FROM s GROUP BY 1",
       t="SELECT run_id, model, cls, loglik, row_number() OVER (PARTITION BY run_id ORDER BY loglik DESC, model DESC) AS r, max(CASE WHEN cls = 'Trypsin' THEN loglik END) OVER (PARTITION BY run_id) AS bc FROM g") +
       "SELECT run_id, model, CASE WHEN n_used < 50 THEN 'inconclusive' WHEN cls = 'Trypsin' THEN 'compatible' WHEN (loglik - bc) / n_used >= 20 THEN 'non_tryptic' ELSE 'inconclusive' END AS verdict FROM t JOIN n USING (run_id) WHERE r = 1")
def n9(spark, sf):
    s = V.table(spark, sf, "customer").selectExpr(*SC)
    g = s.groupBy("run_id", "model").agg(F.first("cls").alias("cls"), F.sum("c_acctbal").alias("loglik"))
    n = s.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_used"), F.count(F.lit(1)).alias("spectra"))
    return N.protease_verdict(g.join(n, "run_id"), 50, 20.0).select("run_id", "model", "verdict")
