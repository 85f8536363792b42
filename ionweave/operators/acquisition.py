"""Acquisition-scheme statistics and classification from the order of MS2 scans."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ionweave.operators.census import quantiles
from ionweave.operators.core import Scan, interval_union, ordered_scan
from ionweave.session import materialize

# Classification thresholds.
MIN_GAPS, MIN_PERIODICITY, CYCLE_TOLERANCE, MIN_WINDOWS = 10, 0.2, 0.1, 5
WINDOWS_MIN_SHARE, MIN_COVERAGE, MIN_SPAN = 0.5, 0.8, 100.0
DIA_MIN_UNCHARGED, CLOSED_MIN_VISITS, CLOSED_MIN_SHARE, PLACEHOLDER_MIN_SHARE = 0.5, 10.0, 0.99, 0.99
NOWIN_MIN_UNCHARGED, NOWIN_MAX_SPACING, NOWIN_GRID_TOLERANCE, NOWIN_GRID_MIN_SHARE = 0.9, 50.0, 0.2, 0.8
MIN_PROVENANCE = 0.5
TILE = 100_000


def number_scans(scans: DataFrame, order: list[str]) -> DataFrame:
    """``pos``: 1-based position of each scan in its run.

    Counted per time tile first; only the scans of one tile are ordered together, so a long run is
    spread over many tasks. ``order[0]`` is a timestamp or number.
    """
    t = F.col(order[0])
    tile = F.unix_timestamp(t) if dict(scans.dtypes)[order[0]].startswith("timestamp") else t
    s = scans.withColumn("_tile", F.floor(tile / 3600))
    n = s.groupBy("run_id", "_tile").agg(F.count(F.lit(1)).alias("_n"))
    n = ordered_scan(n, ["run_id"], "_tile", [Scan("_before", "sum", "_n", exclusive=True)]).drop("_n")
    rn = F.row_number().over(W.partitionBy("run_id", "_tile").orderBy(*order))
    return s.join(n, ["run_id", "_tile"]).withColumn("pos", (F.col("_before") + rn).cast("long")).drop("_tile", "_before")


def _previous(scans: DataFrame, keys: list[str], out: dict[str, str]) -> DataFrame:
    """Values of the row with the next lower ``pos`` of the run, across tile borders."""
    s = scans.withColumn("_tile", F.floor(F.col("pos") / TILE))
    w = W.partitionBy(*keys, "_tile").orderBy("pos")
    vals = F.struct(*out)
    edge = s.groupBy(*keys, "_tile").agg(F.max_by(vals, "pos").alias("_last"))
    edge = edge.withColumn("_last", F.lag("_last").over(W.partitionBy(*keys).orderBy("_tile")))
    s = s.withColumn("_p", F.lag(vals).over(w)).join(edge, [*keys, "_tile"])
    s = s.withColumn("_p", F.coalesce("_p", "_last"))
    return s.select("*", *[F.col(f"_p.{c}").alias(n) for c, n in out.items()]).drop("_tile", "_p", "_last")


def collapse_events(scans: DataFrame) -> DataFrame:
    """First scan of every stretch of equal (kx, klo, kup); ``event`` numbers the events of a run."""
    p = _previous(scans, ["run_id"], {"kx": "_kx", "klo": "_klo", "kup": "_kup", "pos": "_pos"})
    new = F.col("_pos").isNull() | (F.col("_kx") != F.col("kx")) | (F.col("_klo") != F.col("klo")) | (F.col("_kup") != F.col("kup"))
    e = p.filter(new).drop("_kx", "_klo", "_kup", "_pos")
    tiled = e.withColumn("_tile", F.floor(F.col("pos") / TILE))
    n = tiled.groupBy("run_id", "_tile").agg(F.count(F.lit(1)).alias("_n"))
    n = n.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy("run_id").orderBy("_tile").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rn = F.row_number().over(W.partitionBy("run_id", "_tile").orderBy("pos"))
    return tiled.join(n, ["run_id", "_tile"]).withColumn("event", (F.col("_before") + rn).cast("long")).drop("_tile", "_before")


def repeat_gaps(events: DataFrame) -> DataFrame:
    """(run_id, kx, event, gap): events since the same m/z was last selected."""
    e = events.select("run_id", "kx", F.col("event").alias("pos"))
    p = _previous(e, ["run_id", "kx"], {"pos": "_prev"})
    return p.filter("_prev IS NOT NULL").select("run_id", "kx", F.col("pos").alias("event"), (F.col("pos") - F.col("_prev")).alias("gap"))


def periodicity(gaps: DataFrame) -> DataFrame:
    """(run_id, n_gaps, cycle, per): commonest gap (the first seen among equals) and its share."""
    g = gaps.groupBy("run_id", "gap").agg(F.count(F.lit(1)).alias("n"), F.min("event").alias("first"))
    r = g.groupBy("run_id").agg(F.sum("n").alias("n_gaps"), F.max_by("gap", F.struct("n", -F.col("first"))).alias("cycle"), F.max("n").alias("top"))
    ok = F.col("n_gaps") >= MIN_GAPS
    return r.select("run_id", "n_gaps", F.when(ok, F.col("cycle")).otherwise(0).alias("cycle"), F.when(ok, F.col("top") / F.col("n_gaps")).otherwise(0.0).alias("per"))


def window_coverage(events: DataFrame) -> DataFrame:
    """(run_id, n_windowed, lo, hi, coverage): union of the isolation windows over their span."""
    w = events.filter(F.col("lower") + F.col("upper") > 0)
    n = w.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_windowed"))
    iv = w.select("run_id", F.round((F.col("target") - F.col("lower")) * 100).alias("a"), F.round((F.col("target") + F.col("upper")) * 100).alias("b")).distinct()
    cover = interval_union(iv, ["run_id"], "a", "b", "cover")
    span = iv.groupBy("run_id").agg(F.min("a").alias("lo"), F.max("b").alias("hi"))
    return n.join(cover, "run_id").join(span, "run_id").select(
        "run_id", "n_windowed", (F.col("lo") / 100).alias("lo"), (F.col("hi") / 100).alias("hi"),
        F.when(F.col("hi") > F.col("lo"), F.col("cover") / (F.col("hi") - F.col("lo"))).otherwise(0.0).alias("coverage"))


def grid_share(events: DataFrame) -> DataFrame:
    """(run_id, n_win, spacing, grid_share): spacings of distinct m/z within 20 % of their median.

    Distinct rounded m/z are bounded by the m/z range.
    """
    k = events.select("run_id", "kx").distinct()
    d = k.withColumn("d", (F.col("kx") - F.lag("kx").over(W.partitionBy("run_id").orderBy("kx"))) / 10.0)
    n = k.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_win"))
    med = quantiles(d, ["run_id"], "d", [0.5]).select("run_id", F.col("q50").alias("spacing"))
    j = d.filter("d IS NOT NULL").join(med, "run_id").groupBy("run_id").agg(
        F.first("spacing").alias("spacing"), F.avg((F.abs(F.col("d") - F.col("spacing")) <= NOWIN_GRID_TOLERANCE * F.col("spacing")).cast("int")).alias("grid_share"))
    return n.join(j, "run_id", "left").select("run_id", "n_win", F.coalesce("spacing", F.lit(0.0)).alias("spacing"), F.coalesce("grid_share", F.lit(0.0)).alias("grid_share"))


def closed_set(events: DataFrame) -> DataFrame:
    """(run_id, visits, closed_share): events per m/z, and second-half events on a first-half m/z."""
    n = events.groupBy("run_id").agg(F.max("event").alias("n_events"), F.countDistinct("kx").alias("n_win"))
    e = events.select("run_id", "kx", "event").join(n, "run_id")
    half = F.floor(F.col("n_events") / 2)
    first = e.filter(F.col("event") <= half).select("run_id", "kx").distinct().withColumn("_f", F.lit(1))
    late = e.filter(F.col("event") > half).groupBy("run_id", "kx").agg(F.count(F.lit(1)).alias("c"))
    s = late.join(first, ["run_id", "kx"], "left").groupBy("run_id").agg((F.sum(F.when(F.col("_f") == 1, F.col("c")).otherwise(0)) / F.sum("c")).alias("closed_share"))
    return n.join(s, "run_id", "left").select("run_id", "n_events", (F.col("n_events") / F.col("n_win")).alias("visits"), F.coalesce("closed_share", F.lit(0.0)).alias("closed_share"))


def classify_acquisition(scans: DataFrame) -> DataFrame:
    """One row per run: mode and its statistics.

    ``scans``: run_id, pos, x, target, lower, upper, charge, provenance (MS2 only).
    """
    s = scans.withColumn("kx", F.round(F.col("x") * 10).cast("long")).withColumn(
        "klo", F.round(F.col("lower") * 100).cast("long")).withColumn("kup", F.round(F.col("upper") * 100).cast("long"))
    ev = materialize(collapse_events(s))
    base = s.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_ms2"), F.avg(F.col("provenance").cast("int")).alias("frac_provenance"),
                                   F.avg((F.col("charge") <= 0).cast("int")).alias("frac_uncharged"))
    zc = s.filter("charge > 0").groupBy("run_id", "charge").agg(F.count(F.lit(1)).alias("c")).groupBy("run_id").agg(F.max("c").alias("top_z"))
    out = base.join(zc, "run_id", "left")
    for part in (periodicity(repeat_gaps(ev)), window_coverage(ev), grid_share(ev), closed_set(ev)):
        out = out.join(part, "run_id", "left")
    out = out.fillna(0, ["n_gaps", "cycle", "per", "n_windowed", "coverage", "lo", "hi", "top_z"])
    enough = (F.col("n_gaps") >= MIN_GAPS) & (F.col("n_win") >= MIN_WINDOWS)
    periodic = enough & (F.col("per") >= MIN_PERIODICITY) & (F.abs(F.col("cycle") - F.col("n_win")) <= CYCLE_TOLERANCE * F.col("n_win"))
    closed = enough & (F.col("visits") >= CLOSED_MIN_VISITS) & (F.col("closed_share") >= CLOSED_MIN_SHARE)
    windows = F.col("n_windowed") >= WINDOWS_MIN_SHARE * F.col("n_events")
    tiling = windows & (F.col("coverage") >= MIN_COVERAGE) & (F.col("hi") - F.col("lo") >= MIN_SPAN)
    placeholder = F.col("top_z") >= PLACEHOLDER_MIN_SHARE * F.col("n_ms2")
    grid = F.col("grid_share") >= NOWIN_GRID_MIN_SHARE
    unc = F.col("frac_uncharged")
    mode = (F.when(F.col("frac_provenance") >= MIN_PROVENANCE, "pseudo-DDA")
            .when((periodic | closed) & tiling, F.when((unc >= DIA_MIN_UNCHARGED) | placeholder, "DIA").otherwise("DIA-like"))
            .when(periodic & ~windows, F.when((unc >= NOWIN_MIN_UNCHARGED) & (F.col("spacing") <= NOWIN_MAX_SPACING) & grid, "DIA")
                  .when(unc < DIA_MIN_UNCHARGED, "DDA").otherwise("PRM/targeted"))
            .when(periodic, "PRM/targeted").when(F.col("n_gaps") < MIN_GAPS, "undetermined").otherwise("DDA"))
    return out.select("run_id", "n_ms2", "n_events", "n_gaps", "cycle", "per", "n_win", "coverage", "spacing", "grid_share",
                      "visits", "closed_share", periodic.alias("periodic"), closed.alias("closed"), mode.alias("mode"))
