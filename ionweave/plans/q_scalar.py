"""Queries over scalar functions, sinks' table forms and streams run to completion."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ionweave.functions import constants as K, scalar as S
from ionweave.plans import q_acquisition as QB, q_evaluation as QE, q_tagging as QT, tag_run, views as V
from ionweave.plans.registry import query
from ionweave.session import ensure_checkpoint_dir
from ionweave.sources import writers as O
from ionweave.streaming import streams as W

KEY = ["run_id", "idx"]


@query("F1_fold_residues", f"SELECT doc_id, md5({V.FOLD.format('text')}) AS folded FROM documents")
def f1(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.md5(S.fold_residues("text")).alias("folded"))


ANN = "concat(substring(upper(c_mktsegment), 1, 3), '[Mod', CAST(c_nationkey AS STRING), ']', substring(upper(c_mktsegment), 4, 3))"
ANN_SQL = ANN.replace("AS STRING", "AS VARCHAR")


@query("F2_base_sequence", f"SELECT c_custkey, regexp_replace({ANN_SQL}, '\\[[^\\]]*\\]', '', 'g') AS base FROM customer")
def f2(spark, sf):
    return V.table(spark, sf, "customer").selectExpr("c_custkey", f"{ANN} AS a").select("c_custkey", S.base_sequence("a").alias("base"))


@query("F3_mod_shifts", "SELECT c_custkey, CASE WHEN c_nationkey = 3 AND upper(c_mktsegment)[3] = 'I' THEN 15.99 WHEN c_nationkey = 4 AND upper(c_mktsegment)[3] = 'R' THEN 79.97 ELSE 0 END AS shift FROM customer")
def f3(spark, sf):
    c = V.table(spark, sf, "customer").selectExpr("c_custkey", f"{ANN} AS a")
    return c.select("c_custkey", F.aggregate(S.mod_shifts("a", {"I[Mod3]": 15.99, "R[Mod4]": 79.97}), F.lit(0.0), lambda x, y: x + y).alias("shift"))


@query("F4_to_proforma", "SELECT c_custkey, '<[Carbamidomethyl]@C>' || CASE WHEN abs(c_acctbal) >= 0.5 THEN '[+' || printf('%.4f', abs(c_acctbal)) || ']-' ELSE '' END || translate(substr(upper(c_mktsegment), 1, 3), 'L', 'J') || '[Mod' || CAST(c_nationkey AS VARCHAR) || ']' || translate(substr(upper(c_mktsegment), 4, 3), 'L', 'J') "
       "|| CASE WHEN c_nationkey % 2 >= 0.5 THEN '-[+' || printf('%.4f', CAST(c_nationkey % 2 AS DOUBLE)) || ']' ELSE '' END AS proforma FROM customer")
def f4(spark, sf):
    c = V.table(spark, sf, "customer").selectExpr("c_custkey", f"{ANN} AS a", "abs(c_acctbal) AS n", "CAST(c_nationkey % 2 AS DOUBLE) AS c")
    return c.select("c_custkey", S.to_proforma("a", "n", "c", {"C": "Carbamidomethyl"}).alias("proforma"))


NID = "CASE o_custkey % 4 WHEN 0 THEN concat('controllerType=0 controllerNumber=1 scan=', CAST(o_orderkey AS STRING)) WHEN 1 THEN concat('frame=', CAST(o_custkey AS STRING), ' scan=', CAST(o_orderkey AS STRING)) WHEN 2 THEN concat('scan=', CAST(o_orderkey AS STRING)) ELSE 'spectrum x' END"


@query("F5_usi_index", "SELECT o_orderkey, CASE o_custkey % 4 WHEN 0 THEN 'scan:' || o_orderkey WHEN 1 THEN 'nativeId:' || o_custkey || ',' || o_orderkey WHEN 2 THEN 'scan:' || o_orderkey ELSE 'index:' || o_orderkey END AS usi FROM orders")
def f5(spark, sf):
    return V.table(spark, sf, "orders").selectExpr("o_orderkey", f"{NID} AS nid").select("o_orderkey", S.usi_index("nid", F.col("o_orderkey")).alias("usi"))


@query("F6_scan_of", "SELECT o_orderkey, CASE WHEN o_custkey % 4 < 3 THEN o_orderkey END AS scan, CAST(o_custkey AS VARCHAR) AS stem FROM orders")
def f6(spark, sf):
    o = V.table(spark, sf, "orders").selectExpr("o_orderkey", f"{NID} AS nid", "concat('/data/x/', CAST(o_custkey AS STRING), '.mzML.gz') AS path")
    return o.select("o_orderkey", S.scan_of("nid").alias("scan"), S.run_stem("path").alias("stem"))


@query("F7_complement_mz", "SELECT p_partkey, round((p_retailprice + 3 * " + repr(K.PROTON) + " - 1 * 200.5) / 2, 6) AS prec, round(p_retailprice / 2 + 2 * " + repr(K.PROTON) + " - 200.5, 6) AS same FROM part")
def f7(spark, sf):
    p = V.table(spark, sf, "part")
    return p.select("p_partkey", F.round(S.complement_mz("p_retailprice", F.lit(3), F.lit(1), F.lit(200.5), "precursor"), 6).alias("prec"), F.round(S.complement_mz("p_retailprice", F.lit(3), F.lit(2), F.lit(200.5), "same"), 6).alias("same"))


@query("F8_tolerance", "SELECT p_partkey, round(p_retailprice * 20e-6, 9) AS ppm, 0.3 AS da FROM part")
def f8(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", F.round(S.tolerance("p_retailprice", 20.0, True), 9).alias("ppm"), S.tolerance("p_retailprice", 0.3, False).alias("da"))


@query("F9_peptide_mass", V.cte(pep=QE.Q_PEP, res=QE.Q_MASS, pre=QE.Q_PRE) + f"SELECT key, round(max(total) + {K.WATER!r}, 4) AS mass FROM pre GROUP BY 1")
def f9(spark, sf):
    return QE.peptides(spark, sf).select("key", F.round(S.peptide_mass("peptide"), 4).alias("mass"))


@query("F10_bare_endpoint", "SELECT c_custkey, upper(c_mktsegment)[1] AS a, substr(upper(c_mktsegment), 6, 1) AS z, '' AS bare FROM customer")
def f10(spark, sf):
    c = V.table(spark, sf, "customer").selectExpr("c_custkey", f"{ANN} AS a")
    return c.select("c_custkey", S.bare_endpoint("a", True).alias("a"), S.bare_endpoint("a", False).alias("z"), S.bare_endpoint(F.concat(F.lit("A[x]C"), F.lit("")), True).alias("bare"))


@query("F11_mz_band", V.cte(p=V.Q_PEAKS) + "SELECT CASE WHEN mz < 400 THEN 0 WHEN mz < 800 THEN 1 WHEN mz < 1200 THEN 2 ELSE 3 END AS band, CAST(floor(mz / 1.0005079 + 0.5) AS INT) AS bin, count(*) AS n FROM p GROUP BY 1, 2")
def f11(spark, sf):
    return V.peaks(spark, sf).groupBy(S.mz_band("mz").alias("band"), S.mass_bin("mz").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("F12_normalize_peptide", V.cte(pep=QE.Q_PEP) + "SELECT key, peptide AS plain FROM pep")
def f12(spark, sf):
    p = QE.peptides(spark, sf)
    return p.select("key", S.normalize_peptide(F.concat(F.lit("K."), F.substring("peptide", 1, 2), F.lit("[+15.99]"), F.expr("substring(peptide, 3)"), F.lit("(ox).R"))).alias("plain"))


# ------------------------------------------------------------------ table forms of the sinks
def _tags(spark, sf):
    return tag_run.tag_spectra(V.spectra(spark, sf), V.peaks(spark, sf), QT.PARAMS).join(V.spectra(spark, sf).select(*KEY, "spectrum"), KEY)


@query("S10_tag_table")
def s10(spark, sf):
    return O.tag_table(_tags(spark, sf), proforma=True, usi_prefix="mzspec:PXD000001", fixed={"C": "Carbamidomethyl"}).select(*KEY, "rank", "tag", "length", "proforma", "usi")


@query("S12_reduced_fasta", "SELECT doc_id AS ordinal, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS kept, CASE WHEN lang = 'en' THEN 2 ELSE 0 END AS entries FROM documents")
def s12(spark, sf):
    p = V.table(spark, sf, "documents").select(F.col("doc_id").alias("ordinal"), F.col("doc_id").cast("string").alias("accession"), F.col("source").alias("description"), S.fold_residues("text").alias("sequence"), "lang")
    r = O.reduced_fasta(p.drop("lang"), p.filter("lang = 'en'"), None, "DECOY_")
    n = r.groupBy("ordinal").agg(F.count(F.lit(1)).alias("entries"))
    return p.join(n, "ordinal", "left").select("ordinal", F.when(F.col("entries") > 0, 1).otherwise(0).alias("kept"), F.coalesce("entries", F.lit(0)).alias("entries"))


@query("S13_denovo_reads")
def s13(spark, sf):
    return O.denovo_reads(_tags(spark, sf), 3, 2).select(*KEY, "peptide", "length", "alc", "local_confidence")


@query("S14_report_rows", V.cte(f="SELECT o_custkey % 4 AS run_id, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY 1") + "SELECT run_id, 'orders' AS section, key, CAST(value AS VARCHAR) AS value, CAST(n AS VARCHAR) AS n FROM (SELECT run_id, n, 'first' AS key, first AS value FROM f UNION ALL SELECT run_id, n, 'last', last FROM f)")
def s14(spark, sf):
    f = V.table(spark, sf, "orders").groupBy((F.col("o_custkey") % 4).alias("run_id")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))
    return O.report_rows(f, "orders", ["first", "last"], "n").select("run_id", "section", "key", "value", "n")


@query("S15_placement_hits", "SELECT l_orderkey % 4 AS run_id, l_orderkey AS idx, l_returnflag AS peptide, min(l_discount) AS evalue, count(DISTINCT l_suppkey) AS n_proteins FROM lineitem GROUP BY 1, 2, 3")
def s15(spark, sf):
    p = V.table(spark, sf, "lineitem").selectExpr("l_orderkey % 4 AS run_id", "l_orderkey AS idx", "l_returnflag AS peptide", "l_suppkey AS accession", "l_linenumber AS start", "l_discount AS evalue")
    return O.placement_hits(p).select("run_id", "idx", "peptide", "evalue", "n_proteins")


# ------------------------------------------------------------------ streams over the events table
def _events_stream(spark, sf):
    schema = V.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _finish(spark, df, mode: str):
    """Runs a stream over what is there into a table in the shared checkpoint folder and reads it back."""
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch, epoch):
        # complete mode rewrites the whole result, append mode adds one folder per batch
        batch.write.mode("overwrite").parquet(base + ("/out/all" if mode == "complete" else f"/out/batch-{epoch}"))
    q = df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", base + "/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).option("recursiveFileLookup", True).parquet(base + "/out")


EV = ["user_id AS run_id", "event_id AS idx", "CAST(ts AS TIMESTAMP) AS ts", "event_type AS status"]


@query("W2_stream_progress", "SELECT user_id AS run_id, count(*) AS done, count(*) FILTER (event_type = 'click') AS tagged FROM events GROUP BY 1")
def w2(spark, sf):
    s = _events_stream(spark, sf).selectExpr("user_id AS run_id", "CASE WHEN event_type = 'click' THEN 'tagged' ELSE event_type END AS status")
    return _finish(spark, W.stream_progress(s), "complete")


@query("W3_stream_census", "SELECT time_bucket(INTERVAL '6 hours', ts) AS start, user_id AS run_id, event_type AS status, count(*) AS n FROM events GROUP BY 1, 2, 3")
def w3(spark, sf):
    s = _events_stream(spark, sf).selectExpr(*EV)
    return _finish(spark, W.stream_census(s, "6 hours"), "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "run_id", "status", "n")


@query("W3_stream_sessions", V.cte(g="SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS n FROM events", s="SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g") + "SELECT min(ts) AS start, user_id AS run_id, count(*) AS n FROM s GROUP BY user_id, k")
def w3b(spark, sf):
    s = _events_stream(spark, sf).selectExpr(*EV)
    return _finish(spark, W.stream_census(s, session="2 hours"), "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "run_id", "n")


@query("W4_stream_dedupe", "SELECT DISTINCT user_id AS run_id, event_id AS idx FROM events")
def w4(spark, sf):
    s = _events_stream(spark, sf).selectExpr(*EV)
    return _finish(spark, W.stream_dedupe(s.unionByName(s), "3650 days").select("run_id", "idx"), "append")


SG = dict(s="SELECT user_id % 8 AS run_id, event_id AS pos, CAST(round(value) AS BIGINT) AS kx FROM events", p="SELECT *, lag(kx) OVER (PARTITION BY run_id ORDER BY pos) AS pk FROM s", e="SELECT run_id, kx, row_number() OVER (PARTITION BY run_id ORDER BY pos) AS event FROM p WHERE pk IS NULL OR pk <> kx",
          g="SELECT *, event - lag(event) OVER (PARTITION BY run_id, kx ORDER BY event) AS gap FROM e")


@query("W5_stream_repeat_gaps", V.cte(**SG) + "SELECT run_id, kx, event, gap FROM g WHERE gap IS NOT NULL")
def w5(spark, sf):
    s = _events_stream(spark, sf).selectExpr("user_id % 8 AS run_id", "event_id AS pos", "CAST(round(value) AS BIGINT) AS kx")
    with W.state_settings(spark):
        return _finish(spark, W.stream_repeat_gaps(s), "append")
