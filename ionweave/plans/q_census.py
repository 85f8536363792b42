"""Queries over the census, the identification join and the identifiability score."""
from __future__ import annotations

from pyspark.sql import functions as F

from ionweave.functions import scalar as S
from ionweave.operators import census as C
from ionweave.plans import q_tagging as QT, tag_run, views as V
from ionweave.plans.registry import query
from ionweave.session import materialize

KEY = ["run_id", "idx"]


@query("C1_gini", V.cte(p=V.Q_PEAKS, r="SELECT *, row_number() OVER (PARTITION BY run_id, idx ORDER BY intensity) AS i, count(*) OVER (PARTITION BY run_id, idx) AS n FROM p") +
       "SELECT run_id, idx, count(*) AS n_peaks, round(2 * sum(i * intensity) / (max(n) * sum(intensity)) - (max(n) + 1.0) / max(n), 6) AS int_gini FROM r GROUP BY 1, 2")
def c1(spark, sf):
    return C.gini(V.peaks(spark, sf)).withColumn("int_gini", F.round("int_gini", 6))


@query("C2_tag_cover", V.cte(t=QT.Q_TAGS, r="SELECT *, max(high_mz) OVER (PARTITION BY run_id, idx ORDER BY low_mz, high_mz ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM t") +
       "SELECT run_id, idx, round(sum(greatest(0, high_mz - greatest(low_mz, coalesce(reach, low_mz)))), 6) AS tag_cover FROM r GROUP BY 1, 2")
def c2(spark, sf):
    return C.tag_cover(QT.given_tags(spark, sf)).withColumn("tag_cover", F.round("tag_cover", 6))


@query("C3_best_tag", V.cte(t=QT.Q_TAGS) + "SELECT run_id, idx, tag_id, n_res FROM (SELECT *, row_number() OVER (PARTITION BY run_id, idx ORDER BY evalue, tag_id) AS r FROM t) WHERE r = 1")
def c3(spark, sf):
    return C.best_tag(QT.given_tags(spark, sf), "tag_id").select(*KEY, "tag_id", "n_res")


ST = ["l_orderkey AS id", "l_linenumber AS ln", "l_suppkey % 7 = 0 AS empty", "l_partkey % 5 <> 0 AS has_prec", "l_linenumber - 1 AS n_peaks", "l_discount - 0.01 AS mz", "l_tax > 0.01 AS enough",
      "l_quantity % 4 AS n_found", "l_quantity % 3 AS n_rep", "l_orderkey % 2 AS n_placed"]


@query("C4_status", V.cte(s="SELECT " + ", ".join(ST) + " FROM lineitem") + "SELECT CASE WHEN empty THEN 'empty' WHEN NOT has_prec THEN 'no_precursor' WHEN n_peaks = 0 THEN 'no_signal' WHEN mz <= 0 THEN 'bad_precursor' WHEN NOT enough THEN 'too_few_peaks' "
       "WHEN n_found = 0 THEN 'no_tags' WHEN n_rep = 0 THEN 'filtered' WHEN n_placed > 0 THEN 'placed' ELSE 'tagged' END AS status, count(*) AS n FROM s GROUP BY 1")
def c4(spark, sf):
    s = V.table(spark, sf, "lineitem").selectExpr(*ST)
    c = C.status(*[F.col(x) for x in ("empty", "has_prec", "n_peaks", "mz", "enough", "n_found", "n_rep", "n_placed")])
    return s.groupBy(c.alias("status")).agg(F.count(F.lit(1)).alias("n"))


# a census with given tags: orders stand for the tags of the part table's spectra
CT = [e.replace("o_custkey % 4 AS run_id", "(o_custkey * 3) % 4 AS run_id").replace("o_custkey AS idx", "o_custkey * 3 AS idx") for e in QT.TAGS] + [
    "o_totalprice / 1e6 AS min_conf", "o_totalprice / 6e5 AS mean_conf", "o_totalprice AS peak_tic", "'by' AS ion_series"]
Q_CT = "SELECT " + ", ".join(CT) + " FROM orders"
Q_CENSUS = ("SELECT s.run_id, s.idx, s.spectrum, s.rt, s.precursor_mz, greatest(0, s.charge) AS charge_given, CASE WHEN s.charge > 0 THEN s.charge ELSE 2 END AS charge_used, coalesce(g.n_peaks, 0) AS n_peaks, nk.n_kept AS n_peaks_kept, g.int_gini, "
            "CASE WHEN g.n_peaks IS NULL THEN 'empty' WHEN coalesce(nk.n_kept, 0) < 4 THEN 'too_few_peaks' WHEN f.n_found IS NULL THEN 'no_tags' WHEN rp.n_reported IS NULL THEN 'filtered' ELSE 'tagged' END AS status, coalesce(f.n_found, 0) AS n_found, coalesce(rp.n_reported, 0) AS n_reported, "
            "bt.evalue AS best_evalue, bt.n_res AS best_len, pb.evalue AS pre_best_evalue, pb.n_res AS pre_best_len, pb.mean_conf AS pre_best_mean_conf, pc.cover AS pre_tag_cover FROM spectra s LEFT JOIN gini g USING (run_id, idx) LEFT JOIN nk USING (run_id, idx) "
            "LEFT JOIN (SELECT run_id, idx, count(*) AS n_found FROM ct GROUP BY 1, 2) f USING (run_id, idx) LEFT JOIN (SELECT run_id, idx, count(*) AS n_reported FROM ct WHERE n_res >= 4 GROUP BY 1, 2) rp USING (run_id, idx) "
            "LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, idx ORDER BY evalue, tag_id) AS r FROM ct WHERE n_res >= 4) WHERE r = 1) bt USING (run_id, idx) "
            "LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, idx ORDER BY evalue, tag_id) AS r FROM ct) WHERE r = 1) pb USING (run_id, idx) LEFT JOIN pc USING (run_id, idx)")
CEN = dict(**{k: QT.PIPE[k] for k in ("peaks", "spectra", "spec", "m", "clean", "coll", "budget", "prep")}, ct=Q_CT,
           gr="SELECT *, row_number() OVER (PARTITION BY run_id, idx ORDER BY intensity) AS i, count(*) OVER (PARTITION BY run_id, idx) AS n FROM peaks",
           gini="SELECT run_id, idx, count(*) AS n_peaks, 2 * sum(i * intensity) / (max(n) * sum(intensity)) - (max(n) + 1.0) / max(n) AS int_gini FROM gr GROUP BY 1, 2",
           nk="SELECT run_id, idx, count(*) AS n_kept FROM prep GROUP BY 1, 2",
           pr0="SELECT *, max(high_mz) OVER (PARTITION BY run_id, idx ORDER BY low_mz, high_mz ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ct",
           pc="SELECT run_id, idx, sum(greatest(0, high_mz - greatest(low_mz, coalesce(reach, low_mz)))) AS cover FROM pr0 GROUP BY 1, 2", census=Q_CENSUS)


def _census(spark, sf):
    s, p = V.spectra(spark, sf), V.peaks(spark, sf)
    prep = QT._budget(spark, sf)
    diag = prep.groupBy(*KEY).agg(F.first("n_kept").alias("n_kept")).withColumn("n_compl", F.lit(0)).withColumn("n_edges", F.lit(0)).withColumn("enough_peaks", F.col("n_kept") >= 4)
    tags = V.table(spark, sf, "orders").selectExpr(*CT).withColumn("rank", F.col("tag_id"))
    return C.census(s, C.gini(p), diag, tags, tags.filter("n_res >= 4"))


@query("C5_census", V.cte(**CEN) + "SELECT run_id, idx, charge_used, n_peaks, n_peaks_kept, round(int_gini, 6) AS int_gini, status, n_found, n_reported, round(best_evalue, 6) AS best_evalue, best_len, round(pre_tag_cover, 4) AS pre_tag_cover FROM census")
def c5(spark, sf):
    return _census(spark, sf).select(*KEY, "charge_used", "n_peaks", "n_peaks_kept", F.round("int_gini", 6).alias("int_gini"), "status", "n_found", "n_reported", F.round("best_evalue", 6).alias("best_evalue"), "best_len", F.round("pre_tag_cover", 4).alias("pre_tag_cover"))


@query("C5_census_of_tagging")
def c5b(spark, sf):
    s, p = V.spectra(spark, sf), V.peaks(spark, sf)
    prep = materialize(QT._prepared(spark, sf))
    edges = materialize(QT.T.residue_edges(prep, QT.T.alphabet(spark, QT.PARAMS), QT.PARAMS))
    tags = materialize(tag_run.tag_prepared(prep, QT.PARAMS))
    c = C.census(s, C.gini(p), tag_run.tag_diagnostics(prep, edges, QT.PARAMS), tags)
    return c.groupBy("run_id", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("n_edges").alias("edges"), F.sum("n_compl").alias("compl"), F.round(F.sum("tag_cover"), 3).alias("cover"))


def _q_sum() -> str:
    quant = " UNION ALL ".join(f"SELECT run_id, '{c}_p{p}' AS key, round(quantile_cont({v}, {p / 100}), 5) AS value FROM census WHERE status <> 'empty' GROUP BY 1"
                               for c, v in (("best_evalue", "CASE WHEN status = 'tagged' THEN best_evalue END"), ("n_peaks_kept", "CAST(n_peaks_kept AS DOUBLE)"), ("int_gini", "int_gini")) for p in (10, 50, 90))
    return ("SELECT run_id, 'n_' || status AS key, CAST(count(*) AS DOUBLE) AS value FROM census GROUP BY 1, 2 UNION ALL SELECT run_id, 'share_' || status, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY run_id) AS DOUBLE), 5) FROM census GROUP BY run_id, status "
            "UNION ALL SELECT run_id, 'ms2_seen', count(*) FROM census GROUP BY 1 UNION ALL SELECT run_id, 'ms2_processed', count(*) FROM census WHERE status <> 'empty' GROUP BY 1 UNION ALL " + quant)


@query("C6_census_summary", V.cte(**CEN) + _q_sum())
def c6(spark, sf):
    return C.census_summary(_census(spark, sf)).withColumn("value", F.round("value", 5))


CS = ["c_custkey AS idx", "c_nationkey % 4 AS run_id", "concat('controllerType=0 controllerNumber=1 scan=', CAST(c_custkey % 1200 AS STRING)) AS spectrum", "c_acctbal AS best_evalue", "CASE WHEN c_mktsegment = 'BUILDING' THEN 'no_tags' ELSE 'tagged' END AS status"]
RF = ["c_nationkey % 4 AS run_id", "CASE WHEN c_custkey % 3 = 0 THEN concat('controllerType=0 controllerNumber=1 scan=', CAST(c_custkey % 1200 AS STRING)) ELSE concat('scan=', CAST(c_custkey % 1150 AS STRING)) END AS ref",
      "abs(c_acctbal) / 10000 AS q", "c_custkey % 2 = 0 AS pass_threshold", "c_mktsegment = 'FURNITURE' AS is_decoy"]
duck = lambda xs: ", ".join(xs).replace("AS STRING)", "AS VARCHAR)")
IDS = dict(c="SELECT " + duck(CS) + ", CAST(regexp_extract(spectrum, 'scan=(\\d+)', 1) AS BIGINT) AS scan FROM customer", p="SELECT " + duck(RF) + " FROM customer",
           r="SELECT run_id, ref, bool_or(q <= 0.4 AND NOT is_decoy) AS acc, CAST(regexp_extract(min(ref), 'scan=(\\d+)', 1) AS BIGINT) AS scan FROM p GROUP BY 1, 2",
           free="SELECT * FROM r WHERE (run_id, ref) NOT IN (SELECT (run_id, spectrum) FROM c)", bs="SELECT run_id, scan, count(*) AS nref, bool_or(acc) AS acc FROM free GROUP BY 1, 2",
           ss="SELECT run_id, scan, count(*) AS nspec FROM c GROUP BY 1, 2",
           j="SELECT c.*, CASE WHEN e.acc IS NOT NULL THEN e.acc WHEN bs.nref IS NULL THEN false WHEN bs.nref > 1 OR ss.nspec <> 1 THEN NULL ELSE bs.acc END AS identified FROM c LEFT JOIN r e ON e.run_id = c.run_id AND e.ref = c.spectrum LEFT JOIN bs ON bs.run_id = c.run_id AND bs.scan = c.scan LEFT JOIN ss ON ss.run_id = c.run_id AND ss.scan = c.scan")


def _ids(spark, sf):
    t = V.table(spark, sf, "customer")
    return t.selectExpr(*CS), t.selectExpr(*RF)


@query("C7_join_ids", V.cte(**IDS) + "SELECT idx, identified FROM j")
def c7(spark, sf):
    c, p = _ids(spark, sf)
    return C.join_ids(c, p, "qvalue", 0.4).select("idx", "identified")


@query("C7_join_verdict", V.cte(**IDS, u="SELECT r.run_id, r.ref, (r.run_id, r.ref) IN (SELECT (run_id, spectrum) FROM c) OR (r.run_id, r.scan) IN (SELECT (run_id, scan) FROM c) AS ok FROM r") +
       "SELECT run_id, count(*) AS refs, count(*) FILTER (NOT ok) AS unmatched, CASE WHEN count(*) FILTER (NOT ok) > 0.5 * count(*) THEN 'refuse' WHEN count(*) FILTER (NOT ok) > 0.01 * count(*) THEN 'warn' ELSE 'ok' END AS verdict FROM u GROUP BY 1")
def c7b(spark, sf):
    return C.join_verdict(*_ids(spark, sf))


@query("C8_triage", V.cte(**IDS) + "SELECT idx, CASE WHEN NOT identified AND status = 'tagged' AND best_evalue <= 4000 THEN 1 ELSE 0 END AS triage FROM j")
def c8(spark, sf):
    c, p = _ids(spark, sf)
    return C.triage(C.join_ids(c, p, "qvalue", 0.4), 4000).select("idx", "triage")


@query("C9_exact_join_check", V.cte(**IDS, t="SELECT run_id, count(*) AS twice_named FROM (SELECT run_id, ref FROM p GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1", f="SELECT run_id, count(*) AS foreign_refs FROM free GROUP BY 1") +
       "SELECT p.run_id, coalesce(max(foreign_refs), 0) AS foreign_refs, coalesce(max(twice_named), 0) AS twice_named, 0 AS no_decoy_flag, coalesce(max(foreign_refs), 0) = 0 AND coalesce(max(twice_named), 0) = 0 AS ok FROM p LEFT JOIN f USING (run_id) LEFT JOIN t USING (run_id) GROUP BY 1")
def c9(spark, sf):
    return C.exact_join_check(*_ids(spark, sf))


def _mid(col: str) -> str:
    return f"(rank() OVER (PARTITION BY run_id ORDER BY {col}) - 1 + count(*) OVER (PARTITION BY run_id, {col}) / 2.0) / count(*) OVER (PARTITION BY run_id)"


FEAT = {f: f"coalesce(CAST({c} AS DOUBLE), -1e300)" for f, c in {
    "pre_best_evalue": "CASE WHEN pre_best_evalue = 0 THEN 400 WHEN pre_best_evalue > 0 THEN least(400, -log10(pre_best_evalue)) END", "pre_best_len": "pre_best_len", "pre_best_mean_conf": "pre_best_mean_conf",
    "pre_tag_cover": "round(pre_tag_cover, 6)", "n_found": "CASE WHEN status <> 'empty' THEN n_found END", "n_peaks": "n_peaks", "n_compl": "CASE WHEN n_peaks_kept IS NOT NULL THEN 0 END", "n_edges": "CASE WHEN n_peaks_kept IS NOT NULL THEN 0 END", "n_peaks_kept": "n_peaks_kept", "int_gini": "round(int_gini, 6)",
    "charge_used": "charge_used", "precursor_mz": "precursor_mz"}.items()}
Q_RAW = "SELECT run_id, idx, " + ", ".join(f"{c} AS {f}" for f, c in FEAT.items()) + " FROM census"
Q_MID = "SELECT run_id, idx, " + ", ".join(f"{_mid(f)} AS r_{f}" for f in FEAT) + " FROM raw"
Q_SCORE = "SELECT run_id, idx, 1 / (1 + exp(-(" + repr(C.MODEL_INTERCEPT) + "".join(f" + {b!r} * r_{f}" for f, b in zip(C.MODEL_FEATURES, C.MODEL_COEF)) + "))) AS ident_score FROM mid"


def _stable(spark, sf):
    return _census(spark, sf).withColumn("pre_tag_cover", F.round("pre_tag_cover", 6)).withColumn("int_gini", F.round("int_gini", 6))


@query("C10_mid_ranks", V.cte(**CEN, raw=Q_RAW, mid=Q_MID) + "SELECT run_id, idx, " + ", ".join(f"round(r_{f}, 7) AS r_{f}" for f in ("pre_best_evalue", "pre_best_len", "n_peaks", "int_gini", "charge_used")) + " FROM mid")
def c10(spark, sf):
    fs = ["pre_best_evalue", "pre_best_len", "n_peaks", "int_gini", "charge_used"]
    raw = _stable(spark, sf).select(*KEY, *[C.raw_feature(f).alias(f) for f in fs])
    return C.mid_ranks(raw, fs).select(*KEY, *[F.round(f"r_{f}", 7).alias(f"r_{f}") for f in fs])


@query("C11_ident_score", V.cte(**CEN, raw=Q_RAW, mid=Q_MID, sc=Q_SCORE) + "SELECT run_id, idx, round(ident_score, 6) AS ident_score FROM sc")
def c11(spark, sf):
    return C.ident_score(_stable(spark, sf)).select(*KEY, F.round("ident_score", 6).alias("ident_score"))


@query("C12_sorted_census", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey % 4 ORDER BY round(o_totalprice / 1000) DESC, o_orderkey) AS ident_rank FROM orders")
def c12(spark, sf):
    t = V.table(spark, sf, "orders").selectExpr("o_custkey % 4 AS run_id", "o_orderkey AS idx", "o_orderkey", "round(o_totalprice / 1000) AS ident_score")
    return C.sorted_census(t).select("o_orderkey", "ident_rank")


Q_RC = ("SELECT p_partkey % 4 AS run_id, p_partkey AS idx, p_size % 5 AS z, 400 + round(p_retailprice / 10) AS mz, p_partkey * 0.5 AS rt FROM part")


@query("C13_repeat_clusters", V.cte(s=Q_RC, k="SELECT *, row_number() OVER (PARTITION BY run_id, z, mz ORDER BY rt, idx) AS r, count(*) OVER (PARTITION BY run_id, z, mz) AS n FROM s",
       walk="SELECT run_id, z, mz, r, n, idx, rt AS lead_rt, idx AS cluster, [rt] AS leads, [idx] AS ids FROM k WHERE r = 1 UNION ALL SELECT k.run_id, k.z, k.mz, k.r, k.n, k.idx, 0, CASE WHEN len(list_filter(w.leads, lambda l: abs(l - k.rt) <= 60)) > 0 THEN w.ids[list_position(w.leads, list_filter(w.leads, lambda l: abs(l - k.rt) <= 60)[1])] ELSE k.idx END, "
            "CASE WHEN len(list_filter(w.leads, lambda l: abs(l - k.rt) <= 60)) > 0 THEN w.leads ELSE list_append(w.leads, k.rt) END, CASE WHEN len(list_filter(w.leads, lambda l: abs(l - k.rt) <= 60)) > 0 THEN w.ids ELSE list_append(w.ids, k.idx) END FROM walk w JOIN k ON w.run_id = k.run_id AND w.z = k.z AND w.mz = k.mz AND k.r = w.r + 1") +
       "SELECT run_id, idx, cluster, round(1.0 / count(*) OVER (PARTITION BY run_id, cluster), 9) AS weight FROM walk")
def c13(spark, sf):
    t = V.table(spark, sf, "part").selectExpr("p_partkey % 4 AS run_id", "p_partkey AS idx", "p_size % 5 AS charge_used", "400 + round(p_retailprice / 10) AS precursor_mz", "p_partkey * 0.5D AS rt")
    return C.repeat_clusters(t).withColumn("weight", F.round("weight", 9))


@query("C14_fit_ident_model")
def c14(spark, sf):
    d = V.psms(spark, sf).select(F.col("lang").alias("run_id"), F.col("key").alias("idx"), F.col("score").alias("a"), (F.length("run") + F.col("key") % 7).cast("double").alias("b"), F.col("label"), F.lit(1.0).alias("w"))
    r = C.mid_ranks(d, ["a", "b"]).join(d.select("run_id", "idx", "label", "w"), KEY)
    m = C.fit_ident_model(r, "label", "w", ["r_a", "r_b"])
    scored = r.withColumn("score", 1 / (1 + F.exp(-(F.lit(float(m.intercept)) + float(m.coefficients[0]) * F.col("r_a") + float(m.coefficients[1]) * F.col("r_b")))))
    return scored.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))


@query("C15_label_census", V.cte(**IDS, p1="SELECT run_id, ref, min(q) AS q, bool_or(is_decoy) AS d FROM p GROUP BY 1, 2") +
       "SELECT idx, CASE WHEN q IS NULL THEN 'no_psm' WHEN d THEN 'decoy' WHEN q <= 0.4 THEN 'accepted' ELSE 'target_above_q' END AS label FROM c LEFT JOIN p1 ON c.run_id = p1.run_id AND c.spectrum = p1.ref")
def c15(spark, sf):
    c, p = _ids(spark, sf)
    one = p.groupBy("run_id", "ref").agg(F.min("q").alias("q"), F.max("is_decoy").alias("is_decoy"))
    return C.label_census(c, one, 0.4).select("idx", "label")


@query("C16_run_summary", V.cte(s="SELECT p_partkey % 4 AS run_id, p_brand AS activation_class, CASE WHEN p_size % 5 > 0 THEN 'header' ELSE 'assumed' END AS charge_src, CASE WHEN p_size % 5 = 4 THEN 'other_level' END AS reason FROM part") +
       "SELECT run_id, 'input_spectra' AS key, 'all' AS value, count(*) AS n FROM s GROUP BY 1 UNION ALL SELECT run_id, 'activation_class', activation_class, count(*) FROM s GROUP BY 1, 3 UNION ALL SELECT run_id, 'charge_src', charge_src, count(*) FROM s GROUP BY 1, 3 "
       "UNION ALL SELECT run_id, 'reason', coalesce(reason, 'processed'), count(*) FROM s GROUP BY 1, 3")
def c16(spark, sf):
    s = V.table(spark, sf, "part").selectExpr("p_partkey % 4 AS run_id", "p_brand AS activation_class", "CASE WHEN p_size % 5 > 0 THEN 'header' ELSE 'assumed' END AS charge_src", "CASE WHEN p_size % 5 = 4 THEN 'other_level' END AS reason")
    return C.run_summary(s)
