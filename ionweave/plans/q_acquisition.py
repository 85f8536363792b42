"""Queries over acquisition schemes and oxonium ions."""
from __future__ import annotations

from pyspark.sql import functions as F

from ionweave.operators import acquisition as B, glyco as Y
from ionweave.plans import views as V
from ionweave.plans.registry import query

SC = ["user_id % 8 AS run_id", "event_id", "ts", "round(value / 20) * 20 AS x", "0.0E0 + (event_id % 2) * 10 AS lower", "0.0E0 + (event_id % 2) * 12 AS upper",
      "CASE WHEN event_type = 'click' THEN 2 ELSE 0 END AS charge", "event_type = 'error' AS provenance"]
Q_SC = ("SELECT *, x AS target, CAST(round(x * 10) AS BIGINT) AS kx, CAST(round(lower * 100) AS BIGINT) AS klo, CAST(round(upper * 100) AS BIGINT) AS kup, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS pos FROM (SELECT " + ", ".join(SC) + " FROM events)")
Q_EV = ("SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY pos) AS event FROM (SELECT *, lag(kx) OVER w AS pk, lag(klo) OVER w AS pl, lag(kup) OVER w AS pu FROM s WINDOW w AS (PARTITION BY run_id ORDER BY pos)) WHERE pk IS NULL OR pk <> kx OR pl <> klo OR pu <> kup")
Q_GAP = "SELECT run_id, kx, event, event - prev AS gap FROM (SELECT run_id, kx, event, lag(event) OVER (PARTITION BY run_id, kx ORDER BY event) AS prev FROM ev) WHERE prev IS NOT NULL"
BASE = dict(s=Q_SC, ev=Q_EV, gap=Q_GAP)


def _scans(spark, sf):
    e = V.table(spark, sf, "events").selectExpr(*SC).withColumn("target", F.col("x"))
    return B.number_scans(e, ["ts", "event_id"])


def _events(spark, sf):
    s = _scans(spark, sf).withColumn("kx", F.round(F.col("x") * 10).cast("long")).withColumn("klo", F.round(F.col("lower") * 100).cast("long")).withColumn("kup", F.round(F.col("upper") * 100).cast("long"))
    return B.collapse_events(s)


@query("B1_collapse_events", V.cte(**BASE) + "SELECT run_id, pos, event, kx FROM ev")
def b1(spark, sf):
    return _events(spark, sf).select("run_id", "pos", "event", "kx")


@query("B2_repeat_gaps", V.cte(**BASE) + "SELECT run_id, kx, event, gap FROM gap")
def b2(spark, sf):
    return B.repeat_gaps(_events(spark, sf))


@query("B2_periodicity", V.cte(**BASE, g="SELECT run_id, gap, count(*) AS n, min(event) AS f FROM gap GROUP BY 1, 2", r="SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n DESC, f) AS r, sum(n) OVER (PARTITION BY run_id) AS t FROM g") +
       "SELECT run_id, t AS n_gaps, CASE WHEN t >= 10 THEN gap ELSE 0 END AS cycle, round(CASE WHEN t >= 10 THEN n / CAST(t AS DOUBLE) ELSE 0 END, 9) AS per FROM r WHERE r = 1")
def b2b(spark, sf):
    return B.periodicity(B.repeat_gaps(_events(spark, sf))).withColumn("per", F.round("per", 9))


@query("B3_window_coverage", V.cte(**BASE, w="SELECT run_id, round((target - lower) * 100) AS a, round((target + upper) * 100) AS b FROM ev WHERE lower + upper > 0", d="SELECT DISTINCT run_id, a, b FROM w",
       r="SELECT *, max(b) OVER (PARTITION BY run_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM d",
       c="SELECT run_id, sum(greatest(0, b - greatest(a, coalesce(reach, a)))) AS cover, min(a) AS lo, max(b) AS hi FROM r GROUP BY 1") +
       "SELECT c.run_id, (SELECT count(*) FROM w WHERE w.run_id = c.run_id) AS n_windowed, lo / 100 AS lo, hi / 100 AS hi, round(cover / (hi - lo), 9) AS coverage FROM c")
def b3(spark, sf):
    return B.window_coverage(_events(spark, sf)).withColumn("coverage", F.round("coverage", 9))


@query("B4_grid_share", V.cte(**BASE, k="SELECT DISTINCT run_id, kx FROM ev", d="SELECT run_id, (kx - lag(kx) OVER (PARTITION BY run_id ORDER BY kx)) / 10.0 AS d FROM k", m="SELECT run_id, median(d) AS spacing FROM d WHERE d IS NOT NULL GROUP BY 1") +
       "SELECT d.run_id, count(*) AS n_win, min(spacing) AS spacing, round(avg(CASE WHEN d IS NULL THEN NULL WHEN abs(d - spacing) <= 0.2 * spacing THEN 1.0 ELSE 0.0 END), 9) AS grid_share FROM d JOIN m USING (run_id) GROUP BY 1")
def b4(spark, sf):
    return B.grid_share(_events(spark, sf)).withColumn("grid_share", F.round("grid_share", 9))


@query("B5_closed_set", V.cte(**BASE, n="SELECT run_id, max(event) AS n_events, count(DISTINCT kx) AS n_win FROM ev GROUP BY 1", f="SELECT DISTINCT ev.run_id, kx FROM ev JOIN n USING (run_id) WHERE event <= floor(n_events / 2)",
       l="SELECT ev.run_id, avg(CASE WHEN f.kx IS NULL THEN 0.0 ELSE 1.0 END) AS closed_share FROM ev JOIN n USING (run_id) LEFT JOIN f ON f.run_id = ev.run_id AND f.kx = ev.kx WHERE event > floor(n_events / 2) GROUP BY 1") +
       "SELECT run_id, n_events, round(n_events / CAST(n_win AS DOUBLE), 9) AS visits, round(closed_share, 9) AS closed_share FROM n JOIN l USING (run_id)")
def b5(spark, sf):
    return B.closed_set(_events(spark, sf)).select("run_id", "n_events", F.round("visits", 9).alias("visits"), F.round("closed_share", 9).alias("closed_share"))


# one CTE per statistic, as in B2 to B5
STATS = dict(
    base="SELECT run_id, count(*) AS n_ms2, avg(CASE WHEN provenance THEN 1.0 ELSE 0 END) AS prov, avg(CASE WHEN charge <= 0 THEN 1.0 ELSE 0 END) AS unc, sum(CASE WHEN charge = 2 THEN 1 ELSE 0 END) AS top_z FROM s GROUP BY 1",
    g="SELECT run_id, gap, count(*) AS n, min(event) AS f FROM gap GROUP BY 1, 2",
    r="SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n DESC, f) AS r, sum(n) OVER (PARTITION BY run_id) AS t FROM g",
    n="SELECT run_id, max(event) AS n_events, count(DISTINCT kx) AS n_win, sum(CASE WHEN lower + upper > 0 THEN 1 ELSE 0 END) AS nw FROM ev GROUP BY 1",
    iv="SELECT DISTINCT run_id, round((target - lower) * 100) AS a, round((target + upper) * 100) AS b FROM ev WHERE lower + upper > 0",
    ir="SELECT *, max(b) OVER (PARTITION BY run_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv",
    cov="SELECT run_id, sum(greatest(0, b - greatest(a, coalesce(reach, a)))) / (max(b) - min(a)) AS coverage, (max(b) - min(a)) / 100 AS span FROM ir GROUP BY 1",
    f1="SELECT DISTINCT ev.run_id, kx FROM ev JOIN n USING (run_id) WHERE event <= floor(n_events / 2)",
    cs="SELECT ev.run_id, avg(CASE WHEN f1.kx IS NULL THEN 0.0 ELSE 1.0 END) AS closed_share FROM ev JOIN n USING (run_id) LEFT JOIN f1 ON f1.run_id = ev.run_id AND f1.kx = ev.kx WHERE event > floor(n_events / 2) GROUP BY 1",
    c="SELECT base.*, n_events, n_win, nw, gap AS cycle, t, r.n / CAST(t AS DOUBLE) AS per, coverage, span, closed_share, t >= 10 AND n_win >= 5 AS enough FROM base JOIN n USING (run_id) JOIN r USING (run_id) JOIN cov USING (run_id) JOIN cs USING (run_id) WHERE r.r = 1",
    p="SELECT *, enough AND per >= 0.2 AND abs(cycle - n_win) <= 0.1 * n_win AS periodic, enough AND n_events / CAST(n_win AS DOUBLE) >= 10 AND closed_share >= 0.99 AS closed, nw >= 0.5 * n_events AS windows FROM c")


@query("B6_classify_acquisition", V.cte(**BASE, **STATS) +
       "SELECT run_id, n_ms2, n_events, n_win, CASE WHEN prov >= 0.5 THEN 'pseudo-DDA' WHEN (periodic OR closed) AND windows AND coverage >= 0.8 AND span >= 100 THEN CASE WHEN unc >= 0.5 OR top_z >= 0.99 * n_ms2 THEN 'DIA' ELSE 'DIA-like' END "
       "WHEN periodic THEN 'PRM/targeted' WHEN t < 10 THEN 'undetermined' ELSE 'DDA' END AS mode FROM p")
def b6(spark, sf):
    return B.classify_acquisition(_scans(spark, sf)).select("run_id", "n_ms2", "n_events", "n_win", "mode")


@query("Y1_oxonium_scan", V.cte(p=V.Q_PEAKS, ions=V.literal(Y.OXONIUM, "ion_mz, ion"), base="SELECT run_id, idx, max(intensity) AS base FROM p GROUP BY 1, 2",
       h="SELECT p.run_id, p.idx, ion_mz, ion, max(intensity) AS y FROM p JOIN ions ON p.mz BETWEEN ion_mz - 0.3 AND ion_mz + 0.3 GROUP BY 1, 2, 3, 4",
       g="SELECT run_id, idx, count(*) AS n, sum(y) AS s, string_agg(ion, ';' ORDER BY ion_mz) AS ions FROM h GROUP BY 1, 2") +
       "SELECT b.run_id, b.idx, coalesce(n, 0) AS n_oxonium, round(coalesce(s, 0) / base, 6) AS oxonium_frac, coalesce(n, 0) >= 2 AND coalesce(s, 0) / base >= 0.1 AS glyco, coalesce(ions, '-') AS ions FROM base b LEFT JOIN g USING (run_id, idx)")
def y1(spark, sf):
    return Y.oxonium_scan(V.peaks(spark, sf), 0.3, False).withColumn("oxonium_frac", F.round("oxonium_frac", 6))
