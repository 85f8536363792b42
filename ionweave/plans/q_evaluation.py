"""Queries over evaluation against truth: part names stand for peptides, their substrings for tags."""
from __future__ import annotations

from pyspark.sql import functions as F

from ionweave.functions import constants as K, scalar as S
from ionweave.operators import evaluation as E
from ionweave.plans import q_tagging as QT, views as V
from ionweave.plans.registry import query

WATER = repr(K.WATER)
Q_PEP = "SELECT p_partkey AS key, " + "translate(upper(regexp_replace(concat(p_name, p_type), '[^A-Za-z]', '', 'g')), 'IXBZJUO', 'LLLLLLL')" + " AS peptide, p_size AS size FROM part"


def peptides(spark, sf):
    return V.table(spark, sf, "part").selectExpr("p_partkey AS key", "translate(upper(regexp_replace(concat(p_name, p_type), '[^A-Za-z]', '')), 'IXBZJUO', 'LLLLLLL') AS peptide", "p_size AS size")


def tags(spark, sf):
    """Length-4 substrings with their flanks, a third of them off by 5 Da; rank from a hash-free order."""
    t = E.tags_from_predictions(peptides(spark, sf), 4)
    shift = F.when(F.col("pos") % 3 == 1, 5.0).otherwise(0.0)
    flip = F.col("pos") % 5 == 2
    t = t.withColumn("nterm_mass", F.col("nterm_mass") + shift).withColumn("cterm_mass", F.col("cterm_mass") + F.when(F.col("pos") % 2 == 1, 5.0).otherwise(0.0))
    return t.withColumn("tag", F.when(flip, F.reverse("tag")).otherwise(F.col("tag"))).withColumn("rank", (F.col("pos") * 7 % 23 + 1).cast("int")).withColumn("evalue", F.col("pos") / 10.0)


Q_MASS = V.literal([(r, m) for r, m in K.residue_rows()], "residue, mass")
Q_PRE = ("SELECT key, peptide, i, sum(mass) OVER (PARTITION BY key ORDER BY i) AS upto, sum(mass) OVER (PARTITION BY key) AS total FROM (SELECT key, peptide, unnest(range(1, length(peptide) + 1)) AS i FROM pep) x JOIN res ON res.residue = substr(x.peptide, x.i, 1)")
Q_T0 = ("SELECT p.key, p.peptide, pos, substr(p.peptide, pos + 1, 4) AS fw, coalesce(a.upto, 0) AS pn, b.total - b.upto AS pc, b.total FROM (SELECT key, peptide, unnest(range(0, length(peptide) - 3)) AS pos FROM pep) p LEFT JOIN pre a ON a.key = p.key AND a.i = pos JOIN pre b ON b.key = p.key AND b.i = pos + 4")
Q_T = ("SELECT key, peptide, pos, CASE WHEN pos % 5 = 2 THEN reverse(fw) ELSE fw END AS tag, pn + CASE WHEN pos % 3 = 1 THEN 5.0 ELSE 0 END AS nm, pc + CASE WHEN pos % 2 = 1 THEN 5.0 ELSE 0 END AS cm, total, pos * 7 % 23 + 1 AS rank FROM t0")
TAGS = dict(pep=Q_PEP, res=Q_MASS, pre=Q_PRE, t0=Q_T0, t=Q_T)
Q_OK = ("SELECT t.key, t.pos, bool_or((p.fw = t.tag AND (abs(t.nm - p.pn) <= 0.5 OR abs(t.cm - p.pc) <= 0.5)) OR (p.fw = reverse(t.tag) AND (abs(t.cm - (p.pn - " + WATER + ")) <= 0.5 OR abs(t.nm - (p.pc + " + WATER + ")) <= 0.5))) AS correct FROM t JOIN t0 p ON p.key = t.key GROUP BY 1, 2")

# marks with a given outcome: the order table
MK = ["o_custkey AS key", "CAST(o_orderkey % 12 + 1 AS INT) AS rank", "o_orderstatus = 'F' AS correct", "o_totalprice / 1000 AS x", "o_orderpriority AS prio"]
Q_MK = "SELECT " + ", ".join(MK) + " FROM orders"
Q_PS = "SELECT c_custkey AS key FROM customer"


def marked(spark, sf):
    return V.table(spark, sf, "orders").selectExpr(*MK)


def psm_keys(spark, sf):
    return V.table(spark, sf, "customer").selectExpr("c_custkey AS key")


@query("V1_mark_correct", V.cte(**TAGS, ok=Q_OK) + "SELECT key, pos, correct FROM ok")
def v1(spark, sf):
    return E.mark_correct(tags(spark, sf), peptides(spark, sf)).select("key", "pos", "correct")


def _k(k):
    return f"count(DISTINCT CASE WHEN correct AND rank <= {k} THEN key END)"


@query("V2_score_tags", V.cte(m=Q_MK, p=Q_PS) + f"SELECT (SELECT count(*) FROM p) AS psm_spectra, count(DISTINCT key) AS tagged, count(*) AS tags, count(*) FILTER (correct) AS correct, count(*) FILTER (correct AND rank = 1) AS top1_correct, "
       f"round(count(*) FILTER (correct AND rank = 1) / CAST(count(*) FILTER (rank = 1) AS DOUBLE), 9) AS top1_precision, {_k(1)} AS top1_any_correct, {_k(5)} AS top5_any_correct, {_k(10)} AS top10_any_correct FROM m")
def v2(spark, sf):
    return E.score_tags(marked(spark, sf), psm_keys(spark, sf), [1, 5, 10]).select("psm_spectra", "tagged", "tags", "correct", "top1_correct", F.round("top1_precision", 9).alias("top1_precision"), "top1_any_correct", "top5_any_correct", "top10_any_correct")


@query("V3_precision_by", V.cte(m=Q_MK, b="SELECT *, CASE WHEN x > 0 AND x <= 50 THEN '(0, 50]' WHEN x > 50 AND x <= 150 THEN '(50, 150]' WHEN x > 150 AND x <= 1000 THEN '(150, 1000]' END AS bin FROM m") + "SELECT bin AS x, count(*) AS tags, count(*) FILTER (correct) AS correct, round(avg(CASE WHEN correct THEN 1.0 ELSE 0 END), 9) AS precision FROM b WHERE bin IS NOT NULL GROUP BY 1")
def v3(spark, sf):
    return E.precision_by(marked(spark, sf), "x", [0, 50, 150, 1000]).withColumn("precision", F.round("precision", 9))


@query("V4_rank_curve", V.cte(m=Q_MK, p=Q_PS, f="SELECT key, min(CASE WHEN correct THEN rank END) AS f FROM m GROUP BY 1", k="SELECT unnest(range(1, 13)) AS k") +
       "SELECT CAST(k AS INT) AS k, count(*) FILTER (f <= k) AS spectra, round(count(*) FILTER (f <= k) / CAST(count(*) AS DOUBLE), 9) AS rate, round(count(*) FILTER (f <= k) / CAST((SELECT count(*) FROM p) AS DOUBLE), 9) AS recall FROM f, k GROUP BY 1")
def v4(spark, sf):
    return E.rank_curve(marked(spark, sf), psm_keys(spark, sf), 12).withColumn("rate", F.round("rate", 9)).withColumn("recall", F.round("recall", 9))


@query("V5_chance_control", V.cte(p=Q_PEP) + "SELECT count(*) AS n, 0 AS kept FROM p")
def v5(spark, sf):
    p = peptides(spark, sf)
    c = E.chance_control(p, 3).withColumnRenamed("peptide", "new").join(p, "key")
    return c.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("new") == F.col("peptide")).alias("kept"))


Q_CAND = (f"SELECT DISTINCT s.key, d.peptide FROM (SELECT p_partkey AS key, 400 + p_retailprice % 600 AS mz, unnest(CASE WHEN p_size % 5 > 0 THEN [p_size % 5] ELSE [2, 3, 4] END) AS z FROM part) s, (SELECT unnest([0, 1]) AS k) kk, (SELECT DISTINCT peptide, total + {WATER} AS mass FROM pre) d "
          f"WHERE abs(z * (mz - {K.PROTON!r}) - k * {K.ISOTOPE_STEP!r} - d.mass) <= (z * (mz - {K.PROTON!r}) - k * {K.ISOTOPE_STEP!r}) * 20e-6")


@query("V6_candidates_by_mass", V.cte(**TAGS, c=Q_CAND) + "SELECT key, peptide FROM c")
def v6(spark, sf):
    pep = peptides(spark, sf).select("peptide", F.lit("target").alias("cls")).distinct().withColumn("mass", S.peptide_mass("peptide"))
    s = V.table(spark, sf, "part").selectExpr("p_partkey AS key", "400 + p_retailprice % 600 AS precursor_mz", "p_size % 5 AS charge")
    return E.candidates_by_mass(s, pep, 20.0).select("key", "peptide")


def _sets(spark, sf):
    p = peptides(spark, sf)
    truth = V.table(spark, sf, "part").selectExpr("p_partkey AS key", "p_brand AS brand", "p_size % 3 AS grp")
    return E.score_candidate_sets(tags(spark, sf), p.filter("size > 12"), truth)


@query("V7_score_candidate_sets", V.cte(**TAGS, ok=Q_OK, m="SELECT t.key, t.rank, ok.correct AND pep.size > 12 AS c FROM t JOIN ok ON ok.key = t.key AND ok.pos = t.pos JOIN pep ON pep.key = t.key", g="SELECT key, count(*) AS n_tags, max(CASE WHEN rank = 1 AND c THEN 1 ELSE 0 END) AS top1, max(CASE WHEN rank <= 10 AND c THEN 1 ELSE 0 END) AS top10 FROM m GROUP BY 1") +
       "SELECT p_partkey AS key, CASE WHEN p_size <= 12 THEN 'no_pool_candidate' ELSE 'single' END AS size_label, coalesce(n_tags, 0) AS n_tags, coalesce(top1, 0) AS top1, coalesce(top10, 0) AS top10 FROM part LEFT JOIN g ON g.key = p_partkey")
def v7(spark, sf):
    return _sets(spark, sf).select("key", "size_label", "n_tags", "top1", "top10")


SM = ["p_brand AS brand", "p_size % 3 AS grp", "CASE WHEN p_size % 7 = 0 THEN 'no_pool_candidate' ELSE 'single' END AS size_label", "p_size % 2 AS tagged", "p_partkey % 2 AS top1", "p_partkey % 5 AS n_correct", "p_partkey % 5 + 2 AS n_tags"]


@query("V7_summarize", V.cte(s="SELECT " + ", ".join(SM) + " FROM part") + "SELECT brand, grp, count(*) AS spectra, count(*) FILTER (size_label = 'single') AS scored, count(*) FILTER (size_label = 'single' AND tagged = 1) AS n_tagged, round(avg(CASE WHEN size_label = 'single' AND tagged = 1 THEN top1 END), 9) AS rank1_accuracy, "
       "round(sum(n_correct) FILTER (size_label = 'single') / CAST(sum(n_tags) FILTER (size_label = 'single') AS DOUBLE), 9) AS tag_precision FROM s GROUP BY GROUPING SETS ((brand, grp), ())")
def v7b(spark, sf):
    s = E.summarize(V.table(spark, sf, "part").selectExpr(*SM), ["brand", "grp"])
    return s.withColumn("rank1_accuracy", F.round("rank1_accuracy", 9)).withColumn("tag_precision", F.round("tag_precision", 9))


@query("V8_byproducts", V.cte(p=Q_PEP, d="SELECT DISTINCT peptide, length(peptide) AS l FROM p", v="SELECT peptide, substr(peptide, 2) AS variant FROM d UNION SELECT peptide, substr(peptide, 3) FROM d UNION SELECT peptide, substr(peptide, 1, l - 1) FROM d UNION SELECT peptide, substr(peptide, 1, l - 2) FROM d "
       "UNION SELECT peptide, substr(peptide, 1, i - 1) || substr(peptide, i + 1) FROM (SELECT peptide, unnest(range(1, l + 1)) AS i FROM d)") + "SELECT peptide, count(*) AS n FROM v WHERE length(variant) >= 5 AND variant <> peptide GROUP BY 1")
def v8(spark, sf):
    return E.byproducts(peptides(spark, sf).select("peptide").distinct()).groupBy("peptide").agg(F.count(F.lit(1)).alias("n"))


@query("V8_decoy_pool")
def v8b(spark, sf):
    d = E.decoy_pool(peptides(spark, sf))
    return d.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("decoy") == F.col("peptide")).alias("same"))


@query("V8_pool_swap", V.cte(p="SELECT c_name AS pool, c_mktsegment AS batch, CAST(c_custkey * 37 % 10007 AS BIGINT) AS size FROM customer", d="SELECT a.pool, min(abs(a.size - b.size)) AS gap FROM p a JOIN p b ON a.batch <> b.batch GROUP BY 1") + "SELECT pool, gap FROM d")
def v8c(spark, sf):
    p = V.table(spark, sf, "customer").selectExpr("c_name AS pool", "c_mktsegment AS batch", "CAST(c_custkey * 37 % 10007 AS BIGINT) AS size")
    s = E.pool_swap(p)
    return s.join(p.select("pool", "size"), "pool").join(p.select(F.col("pool").alias("partner"), F.col("size").alias("s2")), "partner").select("pool", F.abs(F.col("size") - F.col("s2")).alias("gap"))


@query("V8_carryover_pools", V.cte(p="SELECT c_name AS pool, c_mktsegment AS st, c_nationkey AS batch, c_custkey % 500 AS num FROM customer") + "SELECT a.pool, b.pool AS neighbour FROM p a JOIN p b ON a.st = b.st AND a.batch = b.batch AND b.num IN (a.num - 1, a.num + 1)")
def v8d(spark, sf):
    return E.carryover_pools(V.table(spark, sf, "customer").selectExpr("c_name AS pool", "c_mktsegment AS set", "c_nationkey AS batch", "c_custkey % 500 AS num"))


POOLS = ["CAST(c_custkey AS {0}) AS pool", "'a' || CAST(c_custkey * 7919 % 4001 AS {0}) AS i1", "'b' || CAST(c_custkey * 104729 % 3001 AS {0}) AS i2"]


@query("V9_grouped_split", V.cte(p="SELECT " + ", ".join(POOLS).format("VARCHAR") + " FROM customer", e="SELECT 'p:' || pool AS p, 'i:' || i1 AS i FROM p UNION SELECT 'p:' || pool, 'i:' || i2 FROM p",
       n="SELECT p AS node FROM e UNION SELECT i FROM e", g="SELECT p AS a, i AS b FROM e UNION ALL SELECT i, p FROM e", r="SELECT node AS src, node AS dst FROM n UNION SELECT r.src, g.b FROM r JOIN g ON g.a = r.dst",
       c="SELECT src AS node, min(dst) AS comp FROM r GROUP BY 1") + "SELECT substr(node, 3) AS pool, comp AS \"group\" FROM c WHERE node LIKE 'p:%'")
def v9(spark, sf):
    p = V.table(spark, sf, "customer").selectExpr(*[e.format("STRING") for e in POOLS])
    m = p.select("pool", F.explode(F.array("i1", "i2")).alias("identity"))
    return E.grouped_split(m, {"train": 0.7, "test": 0.3}).select("pool", "group")


CH = ["l_orderkey AS key", "l_linenumber AS rank", "CASE l_partkey % 4 WHEN 0 THEN 'PEPTLDEK' WHEN 1 THEN 'TLDEK' WHEN 2 THEN 'SAMPLER' ELSE 'ELVLSK' END AS peptide", "l_discount AS q", "l_suppkey % 10 = 0 AS is_decoy", "l_extendedprice AS score"]


@query("V10_chimera_truth", V.cte(p="SELECT DISTINCT " + ", ".join(CH) + " FROM lineitem", u="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, rank ORDER BY score DESC, peptide) AS rn FROM p) WHERE rn = 1",
       g="SELECT score, count(*) FILTER (is_decoy) AS d, count(*) FILTER (NOT is_decoy) AS t FROM u WHERE rank = 2 GROUP BY 1", c="SELECT score, CASE WHEN sum(t) OVER w > 0 THEN sum(d) OVER w / CAST(sum(t) OVER w AS DOUBLE) ELSE 1 END AS fdr FROM g WINDOW w AS (ORDER BY score DESC)",
       q="SELECT score, min(fdr) OVER (ORDER BY score) AS q2 FROM c", a="SELECT key, peptide AS pep1 FROM u WHERE rank = 1 AND NOT is_decoy AND q <= 0.06", b="SELECT key, peptide AS pep2 FROM u JOIN q USING (score) WHERE rank = 2 AND NOT is_decoy AND q <= 0.06 AND q2 <= 0.06") +
       "SELECT a.key, CASE WHEN pep2 IS NULL THEN 'single' WHEN contains(pep1, pep2) OR contains(pep2, pep1) THEN 'nested' ELSE 'chimeric' END AS category FROM a LEFT JOIN b USING (key)")
def v10(spark, sf):
    p = V.table(spark, sf, "lineitem").selectExpr(*CH).distinct()
    rn = F.row_number().over(E.W.partitionBy("key", "rank").orderBy(F.desc("score"), "peptide"))
    return E.chimera_truth(p.withColumn("rn", rn).filter("rn = 1"), 0.06).select("key", "category")


@query("V11_precursor_purity", V.cte(peaks=V.Q_PEAKS, spectra=V.Q_SPECTRA, pv="SELECT *, max(CASE WHEN charge = 4 THEN idx END) OVER (PARTITION BY run_id ORDER BY idx) AS ms1_idx FROM spectra", s="SELECT *, CASE WHEN charge > 0 THEN charge ELSE 2 END AS z FROM pv WHERE charge <> 4 AND ms1_idx IS NOT NULL",
       h="SELECT s.run_id, s.idx, p.mz, p.intensity, (SELECT bool_or(abs(p.mz - (s.precursor_mz + k * " + repr(K.ISOTOPE_STEP) + " / s.z)) <= p.mz * 500e-6) FROM (SELECT unnest([-1, 0, 1, 2, 3, 4]) AS k)) AS env FROM s JOIN peaks p ON p.run_id = s.run_id AND p.idx = s.ms1_idx AND p.mz BETWEEN s.precursor_mz - 20 AND s.precursor_mz + 20",
       g="SELECT run_id, idx, sum(intensity) AS t, sum(CASE WHEN env THEN intensity ELSE 0 END) AS o FROM h GROUP BY 1, 2") + "SELECT s.run_id, s.idx, round(o / t, 6) AS purity FROM s LEFT JOIN g USING (run_id, idx)")
def v11(spark, sf):
    s = V.spectra(spark, sf).withColumn("ms_level", F.when(F.col("charge") == 4, 1).otherwise(2)).withColumn("iso_lower", F.lit(20.0)).withColumn("iso_upper", F.lit(20.0))
    return E.precursor_purity(s, V.peaks(spark, sf), 500.0).withColumn("purity", F.round("purity", 6))


@query("V12_assign_axes", V.cte(c="SELECT l_orderkey * 10 + 1000000 AS key, min(l_partkey) AS parent1, max(l_partkey) AS parent2 FROM lineitem GROUP BY 1", b="SELECT p_partkey AS key, CASE WHEN p_size > 40 THEN 'S0' WHEN p_brand LIKE '%1' THEN 'S3-PT' ELSE 'S5' END AS ident FROM part") +
       "SELECT ident AS identification, chimericity, count(*) AS n FROM (SELECT ident, 'none' AS chimericity FROM b UNION ALL SELECT b.ident, 'synthetic' FROM c JOIN b ON b.key = c.parent1) GROUP BY 1, 2")
def v12(spark, sf):
    p = V.table(spark, sf, "part").selectExpr("p_partkey AS key", "p_size", "p_brand")
    c = V.table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") * 10 + 1000000).alias("key")).agg(F.min("l_partkey").alias("parent1"), F.max("l_partkey").alias("parent2"))
    return E.assign_axes(p, p.filter("p_size > 40"), p.filter("p_brand LIKE '%1'"), c).groupBy("identification", "chimericity").agg(F.count(F.lit(1)).alias("n"))


@query("V13_triage_eval", V.cte(c="SELECT p_partkey % 4 AS run_id, p_partkey AS spectrum, p_size % 5 = 0 AS identified, CASE WHEN p_size > 30 THEN 1 ELSE 0 END AS triage FROM part", s="SELECT DISTINCT l_partkey AS spectrum FROM lineitem WHERE l_quantity > 49",
       j="SELECT c.*, s.spectrum IS NOT NULL AS h FROM c LEFT JOIN s USING (spectrum) WHERE NOT identified") +
       "SELECT run_id, count(*) FILTER (triage = 1) AS cand, count(*) FILTER (triage = 1 AND h) AS cand_hits, count(*) FILTER (triage <> 1) AS rest, count(*) FILTER (triage <> 1 AND h) AS rest_hits, round(count(*) FILTER (triage = 1 AND h) / CAST(count(*) FILTER (h) AS DOUBLE), 9) AS recall FROM j GROUP BY 1")
def v13(spark, sf):
    c = V.table(spark, sf, "part").selectExpr("p_partkey % 4 AS run_id", "p_partkey AS spectrum", "p_size % 5 = 0 AS identified", "CASE WHEN p_size > 30 THEN 1 ELSE 0 END AS triage")
    s = V.table(spark, sf, "lineitem").filter("l_quantity > 49").selectExpr("l_partkey % 4 AS run_id", "l_partkey AS spectrum")
    return E.triage_eval(c, s).select("run_id", "cand", "cand_hits", "rest", "rest_hits", F.round("recall", 9).alias("recall"))


@query("V14_auroc", V.cte(p="SELECT o_custkey % 4 AS run_id, round(o_totalprice / 1000) AS s, o_orderstatus = 'F' AS y FROM orders", r="SELECT *, rank() OVER (PARTITION BY run_id ORDER BY s) - 1 + (count(*) OVER (PARTITION BY run_id, s) + 1) / 2.0 AS r FROM p") +
       "SELECT run_id, round((sum(CASE WHEN y THEN r ELSE 0 END) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (CAST(count(*) FILTER (y) AS DOUBLE) * count(*) FILTER (NOT y)), 9) AS auroc FROM r GROUP BY 1")
def v14(spark, sf):
    p = V.table(spark, sf, "orders").selectExpr("o_custkey % 4 AS run_id", "round(o_totalprice / 1000) AS s", "o_orderstatus = 'F' AS y")
    return E.auroc(p, ["run_id"], "s", "y").withColumn("auroc", F.round("auroc", 9))


@query("V15_top_precision", V.cte(p="SELECT o_custkey % 4 AS run_id, o_orderkey AS s, o_orderstatus = 'F' AS y FROM orders", r="SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY s DESC) AS r, count(*) OVER (PARTITION BY run_id) AS n FROM p") +
       "SELECT run_id, CAST(round(min(n) * 0.1) AS BIGINT) AS k, round(count(*) FILTER (y AND r <= round(n * 0.1)) / round(min(n) * 0.1), 9) AS precision, round(count(*) FILTER (y AND r <= round(n * 0.1)) / CAST(count(*) FILTER (y) AS DOUBLE), 9) AS recovery FROM r GROUP BY 1")
def v15(spark, sf):
    p = V.table(spark, sf, "orders").selectExpr("o_custkey % 4 AS run_id", "o_orderkey AS s", "o_orderstatus = 'F' AS y")
    return E.top_precision(p, ["run_id"], "s", "y", 0.1).select("run_id", "k", F.round("precision", 9).alias("precision"), F.round("recovery", 9).alias("recovery"))


@query("V16_cluster_bootstrap")
def v16(spark, sf):
    p = V.table(spark, sf, "orders").selectExpr("o_custkey % 4 AS run_id", "o_custkey", "o_totalprice")
    return E.cluster_bootstrap(p, ["run_id"], "o_custkey", "o_totalprice", 100).select("run_id", "clusters", *[F.round(c, 4).alias(c) for c in ("estimate", "low", "high")])


@query("V17_paired_stats")
def v17(spark, sf):
    p = V.table(spark, sf, "orders").selectExpr("o_orderpriority AS setting", "o_orderstatus = 'F' AS a", "o_orderkey % 13 < 6 AS b")
    return E.paired_stats(p, ["setting"], "a", "b").select("setting", "n", "ka", "kb", "b01", "b10", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), F.round("p", 9).alias("p"), F.round("p_holm", 9).alias("p_holm"))


CF = ["o_orderpriority AS panel", "o_orderstatus = 'F' AS truth", "o_totalprice > 150000 AS call", "o_totalprice AS score"]


@query("V18_confusion", V.cte(c="SELECT " + ", ".join(CF) + " FROM orders", g="SELECT panel, count(*) FILTER (truth AND call) AS tp, count(*) FILTER (truth AND NOT call) AS fn, count(*) FILTER (NOT truth AND call) AS fp, count(*) FILTER (NOT truth AND NOT call) AS tn FROM c GROUP BY 1") +
       "SELECT *, round(tp / CAST(tp + fn AS DOUBLE), 9) AS sensitivity, round(tn / CAST(tn + fp AS DOUBLE), 9) AS specificity FROM g")
def v18(spark, sf):
    c = E.confusion(V.table(spark, sf, "orders").selectExpr(*CF), ["panel"], "call", "truth")
    return c.withColumn("sensitivity", F.round("sensitivity", 9)).withColumn("specificity", F.round("specificity", 9))


@query("V18_cohen_kappa", V.cte(c="SELECT " + ", ".join(CF) + " FROM orders", g="SELECT panel, avg(CASE WHEN truth = call THEN 1.0 ELSE 0 END) AS po, avg(CASE WHEN truth THEN 1.0 ELSE 0 END) AS pa, avg(CASE WHEN call THEN 1.0 ELSE 0 END) AS pb FROM c GROUP BY 1") +
       "SELECT panel, round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 9) AS kappa FROM g")
def v18b(spark, sf):
    return E.cohen_kappa(V.table(spark, sf, "orders").selectExpr(*CF), ["panel"], "truth", "call").withColumn("kappa", F.round("kappa", 9))


@query("V18_threshold_sweep", V.cte(c="SELECT " + ", ".join(CF) + " FROM orders", h="SELECT unnest([50000.0, 100000.0, 200000.0]) AS threshold") +
       "SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (truth AND score >= threshold) AS tp, count(*) FILTER (truth AND score < threshold) AS fn, count(*) FILTER (NOT truth AND score >= threshold) AS fp, count(*) FILTER (NOT truth AND score < threshold) AS tn FROM c, h GROUP BY 1")
def v18c(spark, sf):
    return E.threshold_sweep(V.table(spark, sf, "orders").selectExpr(*CF), "score", "truth", [50000.0, 100000.0, 200000.0]).select("threshold", "tp", "fn", "fp", "tn")


@query("V19_genus_table", V.cte(u="SELECT DISTINCT n_name AS genus FROM nation JOIN customer ON c_nationkey = n_nationkey", t="SELECT n_name AS genus FROM nation WHERE n_regionkey = 1", a="SELECT n_name AS genus, CASE c_mktsegment WHEN 'BUILDING' THEN 'default' WHEN 'MACHINERY' THEN 'deconv' ELSE 'gapped' END AS arm, c_acctbal AS value, c_custkey AS place FROM customer JOIN nation ON n_nationkey = c_nationkey") +
       "SELECT genus, genus IN (SELECT genus FROM t) AS truth, CASE WHEN genus IN (SELECT genus FROM t) THEN 'positive' ELSE 'negative' END AS status, max(value) FILTER (arm = 'default') AS default_value, min(place) FILTER (arm = 'deconv') AS deconv_place FROM a GROUP BY 1")
def v19(spark, sf):
    n, c = V.table(spark, sf, "nation"), V.table(spark, sf, "customer")
    a = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(F.col("n_name").alias("genus"), F.expr("CASE c_mktsegment WHEN 'BUILDING' THEN 'default' WHEN 'MACHINERY' THEN 'deconv' ELSE 'gapped' END").alias("arm"), F.col("c_acctbal").alias("value"), F.col("c_custkey").alias("place"))
    t = n.filter("n_regionkey = 1").select(F.col("n_name").alias("genus"), F.lit(0.2).alias("fraction"))
    return E.genus_table(a.select("genus").distinct(), t, a).select("genus", "truth", "status", "default_value", "deconv_place")


@query("V20_tags_from_predictions", V.cte(pep=Q_PEP, res=Q_MASS, pre=Q_PRE, t0=Q_T0) + "SELECT key, fw AS tag, pos, round(pn, 4) AS nterm_mass, round(pc, 4) AS cterm_mass FROM t0")
def v20(spark, sf):
    return E.tags_from_predictions(peptides(spark, sf), 4).withColumn("nterm_mass", F.round("nterm_mass", 4)).withColumn("cterm_mass", F.round("cterm_mass", 4))


@query("V20_peptide_agreement", V.cte(p=Q_PEP) + "SELECT count(*) AS n, count(*) FILTER (key % 3 <> 0) AS exact, round(avg(CASE WHEN key % 3 <> 0 THEN 1.0 ELSE 0 END), 9) AS share FROM p")
def v20b(spark, sf):
    p = peptides(spark, sf)
    pred = p.withColumn("peptide", F.when(F.col("key") % 3 == 0, F.concat("peptide", F.lit("GG"))).otherwise(F.concat(F.lit("K."), "peptide", F.lit("[+16].R"))))
    return E.peptide_agreement(pred, p).withColumn("share", F.round("share", 9))


SD = ("SELECT c_custkey AS run_id, 'cleavage agent details' AS k, CASE c_nationkey % 4 WHEN 0 THEN 'Trypsin' WHEN 1 THEN 'Lys-C' WHEN 2 THEN 'Glu-C' ELSE 'unspecific cleavage' END AS v FROM customer UNION ALL "
      "SELECT c_custkey, 'cleavage agent details', 'Trypsin' FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'label', CASE c_mktsegment WHEN 'BUILDING' THEN 'TMT126' WHEN 'MACHINERY' THEN 'TMTpro' WHEN 'FURNITURE' THEN 'SILAC heavy' ELSE 'label free sample' END FROM customer")


@query("V21_sdrf_truth", V.cte(r=SD, e="SELECT run_id, list_sort(list(DISTINCT CASE v WHEN 'unspecific cleavage' THEN 'unspecific' ELSE v END)) AS s FROM r WHERE k LIKE 'cleav%' GROUP BY 1", l="SELECT run_id, min(lower(v)) AS t FROM r WHERE k = 'label' GROUP BY 1") +
       "SELECT run_id, CASE WHEN s = ['Trypsin'] OR s = ['Lys-C', 'Trypsin'] THEN 'Trypsin' WHEN len(s) = 1 THEN s[1] ELSE 'mixed' END AS enzyme, CASE WHEN t LIKE '%tmtpro%' THEN 'TMTpro' WHEN t LIKE '%tmt%' THEN 'TMT' WHEN t LIKE '%silac%' THEN 'SILAC' ELSE 'label-free' END AS label FROM e JOIN l USING (run_id)")
def v21(spark, sf):
    c = V.table(spark, sf, "customer")
    a = c.selectExpr("c_custkey AS run_id", "'cleavage agent details' AS key", "CASE c_nationkey % 4 WHEN 0 THEN 'Trypsin' WHEN 1 THEN 'Lys-C' WHEN 2 THEN 'Glu-C' ELSE 'unspecific cleavage' END AS value")
    b = c.filter("c_custkey % 2 = 0").selectExpr("c_custkey AS run_id", "'cleavage agent details' AS key", "'Trypsin' AS value")
    l = c.selectExpr("c_custkey AS run_id", "'label' AS key", "CASE c_mktsegment WHEN 'BUILDING' THEN 'TMT126' WHEN 'MACHINERY' THEN 'TMTpro' WHEN 'FURNITURE' THEN 'SILAC heavy' ELSE 'label free sample' END AS value")
    return E.sdrf_truth(a.unionByName(b).unionByName(l)).select("run_id", "enzyme", "label")


@query("V22_score_species", V.cte(r="SELECT c_nationkey AS run_id, c_mktsegment AS name, count(*) AS observed, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS place FROM customer GROUP BY 1, 2") +
       "SELECT run_id, max(CASE WHEN place = 1 THEN name END) AS top, min(CASE WHEN name = 'BUILDING' THEN place END) AS expected_rank, coalesce(bool_or(name = 'BUILDING' AND place = 1), false) AS top1_correct, count(*) AS taxa FROM r GROUP BY 1")
def v22(spark, sf):
    c = V.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("run_id"), F.col("c_mktsegment").alias("name")).agg(F.count(F.lit(1)).alias("observed"))
    c = c.withColumn("place", F.row_number().over(E.W.partitionBy("run_id").orderBy(F.desc("observed"), "name")))
    x = c.select("run_id").distinct().withColumn("expected", F.lit("building "))
    return E.score_species(c, x).select("run_id", "top", "expected_rank", "top1_correct", "taxa")


@query("V22_score_digest", "SELECT c_custkey AS run_id, 'Trypsin' AS expected, CASE WHEN c_nationkey % 3 = 0 THEN NULL WHEN c_nationkey % 3 = 1 THEN 'Trypsin' ELSE 'Glu-C' END AS call, CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE c_nationkey % 3 = 1 END AS correct FROM customer")
def v22b(spark, sf):
    c = V.table(spark, sf, "customer")
    calls = c.filter("c_nationkey % 3 <> 0").selectExpr("c_custkey AS run_id", "CASE WHEN c_nationkey % 3 = 1 THEN 'Trypsin' ELSE 'Glu-C' END AS call")
    return E.score_digest(calls, c.selectExpr("c_custkey AS run_id", "'Trypsin' AS expected"))


@query("V23_truth_qc", V.cte(p=V.Q_PSMS) + "SELECT lang, count(*) FILTER (NOT is_decoy) AS targets, count(*) FILTER (is_decoy) AS decoys, count(*) FILTER (NOT is_decoy) >= 50 AND count(*) FILTER (NOT is_decoy) >= 5 * greatest(1, count(*) FILTER (is_decoy)) AS ok FROM p GROUP BY 1")
def v23(spark, sf):
    return E.truth_qc(V.psms(spark, sf), ["lang"], 50, 5.0).select("lang", "targets", "decoys", "ok")


@query("V24_attribute_tags", V.cte(**TAGS, ok=Q_OK) + "SELECT t.key, t.pos, CASE WHEN ok.correct THEN 'pep1' ELSE 'neither' END AS attribution FROM t JOIN ok ON ok.key = t.key AND ok.pos = t.pos")
def v24(spark, sf):
    p = peptides(spark, sf).select("key", F.col("peptide").alias("pep1"), F.lit("GGGGGG").alias("pep2"))
    return E.attribute_tags(tags(spark, sf), p)[0].select("key", "pos", "attribution")


@query("V24_attribute_spectra")
def v24b(spark, sf):
    p = peptides(spark, sf).select("key", F.col("peptide").alias("pep1"), F.reverse("peptide").alias("pep2"))
    return E.attribute_tags(tags(spark, sf), p, 10)[1].groupBy("rank1_attribution", "pep1_topk", "both_topk").agg(F.count(F.lit(1)).alias("n"))


@query("V25_two_group_boot")
def v25(spark, sf):
    p = V.table(spark, sf, "orders").selectExpr("o_orderstatus = 'F' AS g", "o_custkey", "o_totalprice AS v")
    return E.two_group_boot(p, "g", "o_custkey", "v", 100).select(*[F.round(c, 4).alias(c) for c in ("difference", "low", "high")])


@query("V25_stratified_diff", V.cte(g="SELECT o_orderpriority AS s, avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS a, avg(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END) AS b, least(count(*) FILTER (o_orderstatus = 'F'), count(*) FILTER (o_orderstatus <> 'F')) AS w FROM orders GROUP BY 1") +
       "SELECT round(sum((a - b) * w) / sum(w), 4) AS difference, count(*) AS strata FROM g WHERE w > 0")
def v25b(spark, sf):
    p = V.table(spark, sf, "orders").selectExpr("o_orderstatus = 'F' AS g", "o_orderpriority AS s", "o_totalprice AS v")
    return E.stratified_diff(p, "s", "g", "v").withColumn("difference", F.round("difference", 4))


@query("V25_cluster_permutation")
def v25c(spark, sf):
    p = V.table(spark, sf, "orders").selectExpr("o_custkey", "o_totalprice - 150000 AS d")
    return E.cluster_permutation(p, "o_custkey", "d", 100).select(F.round("statistic", 2).alias("statistic"), "p")


@query("V26_truth_overlap", V.cte(p=Q_PEP, a="SELECT key, peptide FROM p WHERE size > 15", b="SELECT key, CASE WHEN key % 5 = 0 THEN peptide || 'K' ELSE peptide END AS peptide FROM p WHERE size <= 35") +
       "SELECT count(*) FILTER (a.key IS NOT NULL AND b.key IS NOT NULL) AS both, count(*) FILTER (a.peptide = b.peptide) AS same_peptide, count(*) FILTER (b.key IS NULL) AS only_a, count(*) FILTER (a.key IS NULL) AS only_b FROM a FULL JOIN b ON a.key = b.key")
def v26(spark, sf):
    p = peptides(spark, sf)
    b = p.filter("size <= 35").withColumn("peptide", F.when(F.col("key") % 5 == 0, F.concat("peptide", F.lit("K"))).otherwise(F.col("peptide")))
    return E.truth_overlap(p.filter("size > 15"), b)


@query("V27_union_clusters", V.cte(p="SELECT p_partkey AS key, 'PEP' || translate(CAST(p_partkey * 7919 % 4001 AS VARCHAR), '0123456789', 'GASPVTCLND') AS a, 'PEP' || translate(CAST(p_partkey * 104729 % 3001 + 5000 AS VARCHAR), '0123456789', 'GASPVTCLND') AS b FROM part",
       g="SELECT a, b FROM p UNION SELECT b, a FROM p", n="SELECT a AS node FROM p UNION SELECT b FROM p", r="SELECT node AS src, node AS dst FROM n UNION SELECT r.src, g.b FROM r JOIN g ON g.a = r.dst", c="SELECT src, min(dst) AS cluster FROM r GROUP BY 1") + "SELECT key, cluster FROM p JOIN c ON c.src = p.a")
def v27(spark, sf):
    p = V.table(spark, sf, "part").selectExpr("p_partkey AS key", "concat('PEP', translate(CAST(p_partkey * 7919 % 4001 AS STRING), '0123456789', 'GASPVTCLND')) AS pep1", "concat('PEP', translate(CAST(p_partkey * 104729 % 3001 + 5000 AS STRING), '0123456789', 'GASPVTCLND')) AS pep2")
    return E.union_clusters(p)


@query("V28_call_confusion", V.cte(c="SELECT c_mktsegment AS panel, CASE WHEN c_nationkey % 5 = 0 THEN 'not_evaluable' WHEN c_nationkey % 2 = 0 THEN 'Trypsin' ELSE 'Glu-C' END AS truth, CASE WHEN c_custkey % 7 = 0 THEN 'no_call' WHEN c_custkey % 3 = 0 THEN 'Glu-C' ELSE 'Trypsin' END AS call FROM customer") +
       "SELECT panel, truth, count(*) AS n, count(*) FILTER (truth = call) AS agree, count(*) FILTER (call = 'Trypsin') AS \"Trypsin\", count(*) FILTER (call = 'Glu-C') AS \"Glu-C\", count(*) FILTER (call = 'no_call') AS no_call FROM c GROUP BY CUBE (panel, truth)")
def v28(spark, sf):
    c = V.table(spark, sf, "customer").selectExpr("c_mktsegment AS panel", "CASE WHEN c_nationkey % 5 = 0 THEN NULL WHEN c_nationkey % 2 = 0 THEN 'Trypsin' ELSE 'Glu-C' END AS truth", "CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'Glu-C' ELSE 'Trypsin' END AS call")
    return E.call_confusion(c, ["Trypsin", "Glu-C"])
