"""Queries over species detection: every document source in a language is a taxon, the language its genus."""
from __future__ import annotations

from pyspark.sql import functions as F

from ionweave.functions import stats
from ionweave.operators import species as X
from ionweave.plans import views as V
from ionweave.plans.q_identification import q_kmers
from ionweave.plans.registry import query

Q_P = "SELECT accession, sequence, taxon || ':' || genus AS taxon, genus FROM (" + V.Q_PROTEINS + ")"
KT = dict(prot=Q_P, k7=q_kmers(7, "taxon"), kt="SELECT DISTINCT kmer, taxon FROM k7")
GROUPS = "SELECT DISTINCT source || ':' || lang AS taxon, lang AS genus FROM documents"
Q_NODES = "SELECT taxon AS taxid, genus AS parent, 'species' AS rank FROM gr UNION ALL SELECT DISTINCT genus, 'root', 'genus' FROM gr UNION ALL SELECT 'root', 'root', 'no rank'"
Q_ANC = "SELECT taxid, taxid AS anc, 0 AS dist FROM nodes UNION ALL SELECT a.taxid, n.parent, a.dist + 1 FROM anc a JOIN nodes n ON a.anc = n.taxid WHERE n.taxid <> n.parent"
Q_TAGK = "SELECT DISTINCT seq, i, substr(seq, i, 7) AS kmer FROM t, (SELECT unnest([1, 2, 3]) AS i)"
Q_SUP = ("SELECT seq, taxon FROM (SELECT tk.seq, kt.taxon, count(*) AS c FROM tk JOIN kt ON tk.kmer = kt.kmer JOIN ok ON ok.seq = tk.seq WHERE tk.kmer NOT IN (SELECT kmer FROM kn WHERE n > 30) GROUP BY 1, 2) JOIN ok USING (seq) WHERE c = n_eval")
SUP = dict(**KT, t=V.q_db_tags(9), tk=Q_TAGK, kn="SELECT kmer, count(*) AS n FROM kt GROUP BY 1",
           ok="SELECT seq, count(*) FILTER (WHERE n <= 30) AS n_eval FROM tk LEFT JOIN kn USING (kmer) GROUP BY 1 HAVING min(coalesce(n, 0)) > 0 AND count(*) FILTER (WHERE n <= 30) > 0", sup=Q_SUP)
HITS = dict(**SUP, best="SELECT run_id, idx, min(evalue) AS e FROM t JOIN (SELECT DISTINCT seq FROM sup) USING (seq) GROUP BY 1, 2",
            st="SELECT DISTINCT t.run_id, t.idx, sup.taxon FROM t JOIN best b ON t.run_id = b.run_id AND t.idx = b.idx AND t.evalue = b.e JOIN sup ON sup.seq = t.seq")
ROLL = dict(**HITS, gr=GROUPS, nodes=Q_NODES, anc=Q_ANC, up="SELECT DISTINCT run_id, idx, anc FROM st JOIN anc ON st.taxon = anc.taxid",
            roll="SELECT u.run_id, u.anc AS taxid, count(*) AS subtree, coalesce(min(d.n), 0) AS direct FROM up u LEFT JOIN (SELECT run_id, taxon, count(DISTINCT idx) AS n FROM st GROUP BY 1, 2) d ON d.run_id = u.run_id AND d.taxon = u.anc GROUP BY 1, 2")


def proteins(spark, sf):
    return V.proteins(spark, sf).withColumn("taxon", F.concat_ws(":", "taxon", "genus"))


def kmer_taxa(spark, sf):
    return X.build_kmer_taxa(proteins(spark, sf))


def groups(spark, sf):
    return V.table(spark, sf, "documents").select(F.concat_ws(":", "source", "lang").alias("taxon"), F.col("lang").alias("genus")).distinct()


def nodes(spark, sf):
    g = groups(spark, sf)
    top = g.select(F.col("genus").alias("taxid"), F.lit("root").alias("parent"), F.lit("genus").alias("rank")).distinct()
    root = spark.createDataFrame([("root", "root", "no rank")], "taxid string, parent string, rank string")
    return g.select(F.col("taxon").alias("taxid"), F.col("genus").alias("parent"), F.lit("species").alias("rank")).unionByName(top).unionByName(root)


def support(spark, sf):
    return X.tag_support(V.db_tags(spark, sf, 9), kmer_taxa(spark, sf), 7, 30)


def hits(spark, sf):
    return X.spectrum_taxa(V.db_tags(spark, sf, 9), support(spark, sf)).withColumnRenamed("taxon", "taxid")


def rolled(spark, sf):
    return X.roll_up(hits(spark, sf), X.ancestors(nodes(spark, sf)))


@query("X1_build_kmer_taxa", V.cte(**KT) + "SELECT taxon, substr(kmer, 1, 1) AS head, count(*) AS n FROM kt GROUP BY 1, 2")
def x1(spark, sf):
    return kmer_taxa(spark, sf).groupBy("taxon", F.substring("kmer", 1, 1).alias("head")).agg(F.count(F.lit(1)).alias("n"))


@query("X2_postings", V.cte(**KT) + "SELECT taxon, count(*) AS kmers FROM kt GROUP BY 1")
def x2(spark, sf):
    return X.postings(kmer_taxa(spark, sf))


@query("X3_group_overlap", V.cte(**KT, g="SELECT DISTINCT kmer, split_part(taxon, ':', 2) AS genus FROM kt") + "SELECT x.genus AS a, y.genus AS b, count(*) AS shared FROM g x JOIN g y ON x.kmer = y.kmer AND x.genus <= y.genus GROUP BY 1, 2")
def x3(spark, sf):
    return X.group_overlap(kmer_taxa(spark, sf), groups(spark, sf))


@query("X3_pairwise_overlap")
def x3b(spark, sf):
    return X.pairwise_overlap(kmer_taxa(spark, sf))


@query("X4_tag_support", V.cte(**SUP) + "SELECT seq, taxon FROM sup")
def x4(spark, sf):
    return support(spark, sf)


@query("X5_oriented_support", V.cte(**{**SUP, "t": "SELECT DISTINCT seq FROM (SELECT seq FROM t9 UNION SELECT reverse(seq) FROM t9)"}).replace("t AS (SELECT DISTINCT seq FROM (", "t9 AS (" + V.q_db_tags(9) + "), t AS (SELECT DISTINCT seq FROM (", 1) +
       ", s AS (SELECT DISTINCT seq FROM t9), f AS (SELECT seq, list_sort(list(taxon)) AS l FROM sup GROUP BY 1), j AS (SELECT s.seq, a.l AS f, b.l AS r FROM s LEFT JOIN f a ON a.seq = s.seq LEFT JOIN f b ON b.seq = reverse(s.seq)), "
       "p AS (SELECT seq, CASE WHEN seq = reverse(seq) THEN f WHEN f IS NOT NULL AND r IS NOT NULL THEN list_intersect(f, r) WHEN f IS NOT NULL THEN f ELSE r END AS l, CASE WHEN seq = reverse(seq) THEN 'palindrome' WHEN f IS NOT NULL AND r IS NOT NULL THEN 'intersection' WHEN f IS NOT NULL THEN 'forward' ELSE 'reverse' END AS orientation FROM j) "
       "SELECT orientation, count(DISTINCT seq) AS tags, count(*) AS n FROM (SELECT seq, orientation, unnest(l) AS taxon FROM p) GROUP BY 1")
def x5(spark, sf):
    o = X.oriented_support(V.db_tags(spark, sf, 9), kmer_taxa(spark, sf), 7, 30)
    return o.groupBy("orientation").agg(F.countDistinct("seq").alias("tags"), F.count(F.lit(1)).alias("n"))


@query("X6_spectrum_taxa", V.cte(**HITS) + "SELECT run_id, idx, taxon AS taxid FROM st")
def x6(spark, sf):
    return hits(spark, sf)


@query("X7_decoy_tags")
def x7(spark, sf):
    d = X.decoy_tags(V.db_tags(spark, sf), 2)
    return d.groupBy("run_id", "decoy").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("decoy_seq") == F.col("seq")).alias("same"))


@query("X7_kmer_decoys")
def x7b(spark, sf):
    """Decoy rates per run of tags of seven and nine letters; its twin is in the tests."""
    t = V.db_tags(spark, sf, 7).unionByName(V.db_tags(spark, sf, 9))
    return X.decoy_rates(t, X.kmer_decoys(t, kmer_taxa(spark, sf), 7, 3))


@query("X8_ancestors", V.cte(gr=GROUPS, nodes=Q_NODES, anc=Q_ANC) + "SELECT taxid, anc, dist FROM anc")
def x8(spark, sf):
    return X.ancestors(nodes(spark, sf))


@query("X9_roll_up", V.cte(**ROLL) + "SELECT run_id, taxid, direct, subtree FROM roll")
def x9(spark, sf):
    return rolled(spark, sf)


def _background(spark, sf):
    kt = kmer_taxa(spark, sf)
    n = kt.groupBy("taxon").agg(F.count(F.lit(1)).alias("k"))
    tot = kt.select("kmer").distinct().agg(F.count(F.lit(1)).alias("t"))
    return n.join(F.broadcast(tot)).select(F.col("taxon").alias("taxid"), (F.col("k") / F.col("t")).alias("p"))


def _totals(spark, sf):
    return hits(spark, sf).groupBy("run_id").agg(F.countDistinct("idx").alias("n_total"))


@query("X10_enrichment")
def x10(spark, sf):
    t = V.table(spark, sf, "lineitem").selectExpr("l_orderkey % 4 AS run_id", "l_orderkey AS idx", "l_suppkey AS taxid", "l_returnflag")
    r = t.filter("l_returnflag = 'N'").groupBy("run_id", "taxid").agg(F.countDistinct("idx").alias("subtree"))
    n = t.filter("l_returnflag = 'N'").groupBy("run_id").agg(F.countDistinct("idx").alias("n_total"))
    bg = t.groupBy("taxid").agg(F.countDistinct("idx").alias("k")).join(F.broadcast(t.agg(F.countDistinct("idx").alias("t")))).select("taxid", (F.col("k") / F.col("t") / 2).alias("p"))
    e = X.enrichment(r, bg, n)
    return e.select("run_id", "taxid", "subtree", F.round("expected", 6).alias("expected"), F.round("pvalue", 9).alias("pvalue"), F.round("qvalue", 9).alias("qvalue"))


@query("X11_bh_qvalues", "WITH p AS (SELECT l_suppkey % 4 AS run_id, l_partkey AS taxid, (sum(l_linenumber) * 37 % 1009) / 1009.0 AS p FROM lineitem GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY run_id ORDER BY p) - 1 + count(*) OVER (PARTITION BY run_id, p) AS pos, count(*) OVER (PARTITION BY run_id) AS m FROM p) "
       "SELECT run_id, taxid, round(least(1.0, min(p * m / pos) OVER (PARTITION BY run_id ORDER BY p DESC)), 7) AS qvalue FROM r")
def x11(spark, sf):
    p = V.table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 4).alias("run_id"), F.col("l_partkey").alias("taxid")).agg((F.sum("l_linenumber") * 37 % 1009 / 1009.0).alias("p"))
    return X.bh_qvalues(p, ["run_id"], "p").select("run_id", "taxid", F.round("qvalue", 7).alias("qvalue"))


@query("X12_poisson_tail", V.cte(c="SELECT l_orderkey, count(*) AS o, sum(l_tax) * 20 AS lam FROM lineitem GROUP BY 1", g="SELECT DISTINCT o, round(lam, 2) AS lam FROM c",
       w="SELECT o, lam, 0 AS i, exp(-lam) AS t, exp(-lam) AS s FROM g UNION ALL SELECT o, lam, i + 1, t * lam / (i + 1), s + t * lam / (i + 1) FROM w WHERE i + 1 < o") +
       "SELECT o, lam, round(CASE WHEN lam <= 0 THEN 0.0 ELSE 1 - max(s) END, 7) AS tail FROM w GROUP BY 1, 2")
def x12(spark, sf):
    g = V.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("o"), (F.sum("l_tax") * 20).alias("lam")).select("o", F.round("lam", 2).alias("lam")).distinct()
    return g.select("o", "lam", F.round(stats.poisson_upper("o", "lam"), 7).alias("tail"))


def _observed(spark, sf):
    return hits(spark, sf).groupBy("run_id", F.col("taxid").alias("taxon")).agg(F.countDistinct("idx").alias("observed"))


@query("X13_deconvolve")
def x13(spark, sf):
    kt = X.materialize(kmer_taxa(spark, sf))
    d = X.deconvolve(X.pairwise_overlap(kt), X.postings(kt), _observed(spark, sf))
    return d.select("run_id", "taxon", F.round("n_hat", 4).alias("n_hat"))


def _genera(spark, sf):
    """Genus-like table per run from lineitem: suppliers observed in orders."""
    g = V.table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 4).alias("run_id"), F.col("l_suppkey").alias("taxid")).agg(
        F.countDistinct("l_orderkey").alias("observed"), F.count_if(F.col("l_discount") > 0.095).alias("decoy_spectra"))
    t = g.groupBy("run_id").agg(F.sum("observed").alias("n_trials"))
    g = X.species_null(g, 1, t)
    return g.withColumn("share", F.col("observed") / F.col("n_trials")).withColumn("n_units", F.col("n_trials")).withColumn("n_hat", F.col("observed") * 0.9)


@query("X14_species_null", V.cte(g="SELECT l_orderkey % 4 AS run_id, l_suppkey AS taxid, count(DISTINCT l_orderkey) AS observed, count(*) FILTER (WHERE l_discount > 0.095) AS d FROM lineitem GROUP BY 1, 2") +
       "SELECT run_id, taxid, observed, d + 0.5 AS random_expected FROM g")
def x14(spark, sf):
    return _genera(spark, sf).select("run_id", "taxid", "observed", "random_expected")


def _spill_units(spark, sf):
    """The suppliers of each part: c(g, h) is the share of h's parts that g has too, over 20."""
    t = X.materialize(V.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("unit"), F.col("l_suppkey").alias("h")).distinct())
    n = t.groupBy("h").agg((1 / F.count(F.lit(1)) / 20).alias("c"))
    return t.join(n, "h").select("unit", "h", "c")


def _calls(spark, sf, genera, **more):
    c = X.call_species(genera, _spill_units(spark, sf), 0.05, 0.001, 10, **more)
    return c.withColumn("spill", F.round("spill", 6)).withColumn("qvalue", F.round("qvalue", 9))


@query("X15_call_species")
def x15(spark, sf):
    return _calls(spark, sf, _genera(spark, sf)).select("run_id", "taxid", "observed", "spill", "qvalue", "call", "reason")


@query("X15_call_species_estimated")
def x15b(spark, sf):
    """Estimated share of absent genera, a run of low resolution, detection limits; its twin is in the tests."""
    g = _genera(spark, sf).withColumn("low_resolution", F.col("run_id") == 3)
    c = _calls(spark, sf, g, pi0=0.0)
    return c.select("run_id", "taxid", "observed", "spill", "qvalue", F.round("qvalue_random", 9).alias("qvalue_random"), F.round("pi0", 9).alias("pi0"), F.round("lod", 12).alias("lod"), "call", "reason")


@query("X16_species_report", V.cte(**ROLL) + "SELECT r.run_id, r.taxid, r.subtree, row_number() OVER (PARTITION BY r.run_id ORDER BY r.subtree DESC, r.taxid) AS place FROM roll r JOIN nodes n ON n.taxid = r.taxid WHERE n.rank = 'species'")
def x16(spark, sf):
    return X.species_report(rolled(spark, sf), nodes(spark, sf).select("taxid", "rank"), "species").select("run_id", "taxid", "subtree", "place")


@query("X17_subsample_stability")
def x17(spark, sf):
    return X.subsample_stability(hits(spark, sf).withColumnRenamed("taxid", "taxon"), 10, 0.5, 3).withColumn("mean", F.round("mean", 4))


@query("X18_compare_reports", V.cte(r="SELECT l_orderkey % 4 AS run_id, l_suppkey AS taxid, count(*) AS subtree, count(*) FILTER (WHERE l_linestatus = 'O' AND l_tax > 0.02) AS sb FROM lineitem GROUP BY 1, 2",
       a="SELECT run_id, taxid, subtree, row_number() OVER (PARTITION BY run_id ORDER BY subtree DESC, taxid) AS place FROM r", b="SELECT run_id, taxid, sb AS subtree, row_number() OVER (PARTITION BY run_id ORDER BY sb DESC, taxid) AS place FROM r WHERE sb > 0") +
       "SELECT run_id, count(*) FILTER (WHERE b.taxid IS NULL) AS only_a, 0 AS only_b, count(*) FILTER (WHERE b.taxid IS NOT NULL) AS both, count(*) FILTER (WHERE a.subtree = b.subtree) AS same_count, coalesce(bool_or(a.place = 1 AND b.place = 1), false) AS same_top FROM a LEFT JOIN b USING (run_id, taxid) GROUP BY 1")
def x18(spark, sf):
    t = V.table(spark, sf, "lineitem").selectExpr("l_orderkey % 4 AS run_id", "l_suppkey AS taxid", "l_linestatus", "l_tax")
    w = F.row_number().over(X.W.partitionBy("run_id").orderBy(F.desc("subtree"), "taxid"))
    a = t.groupBy("run_id", "taxid").agg(F.count(F.lit(1)).alias("subtree")).withColumn("place", w)
    b = t.filter("l_linestatus = 'O' AND l_tax > 0.02").groupBy("run_id", "taxid").agg(F.count(F.lit(1)).alias("subtree")).withColumn("place", w)
    return X.compare_reports(a, b)


@query("X19_prune_taxonomy", V.cte(gr=GROUPS, nodes=Q_NODES, anc=Q_ANC) + "SELECT DISTINCT n.taxid, n.parent, n.rank FROM nodes n JOIN anc ON n.taxid = anc.anc WHERE anc.taxid IN (SELECT taxon FROM gr WHERE genus = 'de')")
def x19(spark, sf):
    want = groups(spark, sf).filter("genus = 'de'").select(F.col("taxon").alias("taxid"))
    n = nodes(spark, sf)
    return X.prune_taxonomy(n, n.select("taxid"), want)[0]


@query("X20_index_stats", V.cte(**KT, kn="SELECT kmer, count(*) AS n, count(DISTINCT split_part(taxon, ':', 2)) AS g FROM kt GROUP BY 1", j="SELECT kt.*, n, g, split_part(taxon, ':', 2) AS genus FROM kt JOIN kn USING (kmer)") +
       "SELECT genus, taxon, count(*) AS kmers, count(*) FILTER (WHERE n = 1) AS \"unique\" FROM j GROUP BY 1, 2 UNION ALL SELECT genus, NULL, count(*), count(*) FILTER (WHERE g = 1) FROM (SELECT DISTINCT genus, kmer, g FROM j) GROUP BY 1")
def x20(spark, sf):
    return X.index_stats(kmer_taxa(spark, sf), groups(spark, sf))
