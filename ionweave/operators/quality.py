"""Run quality: scans, charges, resolution, reporters, tag yield, redundancy and overviews."""
from __future__ import annotations

import heapq
import itertools
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ionweave.functions import constants as K, scalar as S
from ionweave.operators.census import quantiles
from ionweave.operators.core import connected_components, even_hash, range_join
from ionweave.operators.filters import decoy_flag
from ionweave.session import materialize

KEY = ["run_id", "idx"]

# Reporter channels and kits, immonium ions, limits.
TMT_CHANNELS = [("126", 126.127726), ("127N", 127.124761), ("127C", 127.131081), ("128N", 128.128116), ("128C", 128.134436), ("129N", 129.131471),
                ("129C", 129.13779), ("130N", 130.134825), ("130C", 130.141145), ("131N", 131.13818), ("131C", 131.1445), ("132N", 132.141535),
                ("132C", 132.147855), ("133N", 133.14489), ("133C", 133.15121), ("134N", 134.148245), ("134C", 134.154565), ("135N", 135.1516)]
ITRAQ_CHANNELS = [("113", 113.1078), ("114", 114.1112), ("115", 115.1082), ("116", 116.1116), ("117", 117.1149), ("118", 118.112), ("119", 119.1153), ("121", 121.122)]
KITS = {"tmt6plex": ["126", "127N", "128C", "129N", "130C", "131N"], "tmt10plex": [c for c, _ in TMT_CHANNELS[:10]], "tmt11plex": [c for c, _ in TMT_CHANNELS[:11]],
        "tmt16plex": [c for c, _ in TMT_CHANNELS[:16]], "tmt18plex": [c for c, _ in TMT_CHANNELS], "itraq4plex": ["114", "115", "116", "117"],
        "itraq8plex": [c for c, _ in ITRAQ_CHANNELS]}
REPORTER_PPM, REPORTER_MIN_SB, REPORTER_MIN_SHARE, REPORTER_MIN_CHANNELS, REPORTER_MIN_ASSESSABLE = 20.0, 3.0, 0.2, 3, 20
IMMONIUM = [70.0657, 72.0808, 86.0964, 101.0709, 102.055, 104.0528, 110.0713, 120.0808, 136.0757, 159.0917, 129.1022]
BIN_WIDTH, FINGERPRINT_PEAKS = 1.0005079, 50
PAIR_PPM, PAIR_RT, PAIR_MOBILITY, MIN_COSINE, MIN_MATCHED = 10.0, 60.0, 0.02, 0.8, 6
NH3, H2O = 17.0265491, 18.0105647


def analyzer_class(filter_string: Column, configuration: Column, run_default: Column) -> Column:
    """FTMS, ITMS, TOF, ASTMS or other: filter string first, then configuration, then the run's default."""
    def of(c: Column) -> Column:
        u = F.upper(c)
        return (F.when(u.rlike("ASTMS|ASYMMETRIC|ASTRAL"), "ASTMS").when(u.rlike("FTMS|ORBITRAP|FOURIER"), "FTMS").when(u.rlike("ITMS|ION ?TRAP"), "ITMS")
                .when(u.rlike("TOFMS|TIME-OF-FLIGHT|\\bTOF"), "TOF"))
    return F.coalesce(of(filter_string), of(configuration), of(run_default), F.lit("other"))


def scan_counts(scans: DataFrame) -> DataFrame:
    """Scans per level, analyser and source with all sub-totals (cube), per run."""
    return scans.cube("run_id", "ms_level", "analyzer", "source").agg(F.count(F.lit(1)).alias("n")).filter("run_id IS NOT NULL")


def charge_histogram(spectra: DataFrame) -> DataFrame:
    return spectra.groupBy("run_id", F.greatest(F.lit(0), F.coalesce("charge", F.lit(0))).alias("charge")).agg(F.count(F.lit(1)).alias("n"))


def stated_resolution(scans: DataFrame) -> DataFrame:
    """Median stated resolution per run and analyser."""
    return quantiles(scans.filter("stated_resolution > 0"), ["run_id", "analyzer"], "stated_resolution", [0.5]).withColumnRenamed("q50", "resolution")


def half_widths(mz: np.ndarray, y: np.ndarray, scan: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(apex m/z, full width at half maximum) of the peaks of a profile in m/z order, or of many one after the other that ``scan`` numbers.

    From each local maximum one walks to the first sample at or below half height on either side and interpolates
    between it and the sample before; a peak that does not come down on both sides of its scan has no width.
    """
    scan = np.zeros(len(y), np.int64) if scan is None else scan
    top = np.flatnonzero((y[1:-1] > y[:-2]) & (y[1:-1] >= y[2:]) & (y[1:-1] > 0) & (scan[1:-1] == scan[:-2]) & (scan[1:-1] == scan[2:])) + 1
    cross = []
    for step in (-1, 1):
        at = top + step
        within = lambda k: (at[k] >= 0) & (at[k] < len(y)) & (scan[np.clip(at[k], 0, len(y) - 1)] == scan[top[k]])   # noqa: E731, B023
        on = np.arange(len(top))                       # those that still walk
        while True:
            on = on[within(on)]
            on = on[y[at[on]] > y[top[on]] / 2]
            if not len(on):
                break
            at[on] += step
        inside = within(slice(None))
        a, b = np.clip(at, 0, len(y) - 1), np.clip(at - step, 0, len(y) - 1)
        share = (y[b] - y[top] / 2) / np.where(y[b] != y[a], y[b] - y[a], 1.0)
        cross.append(np.where(inside, mz[b] + (mz[a] - mz[b]) * share, np.nan))
    width = cross[1] - cross[0]
    return mz[top], width


def measured_resolution(peaks: DataFrame, scans: DataFrame) -> DataFrame:
    """Median m/z over full width at half maximum per run, analyser, level and m/z band, over all profile scans."""
    c = scans.filter(F.coalesce("profile", F.lit(True))).select(*KEY, "analyzer", "ms_level")
    p = peaks.select(*KEY, F.col("mz").cast("double").alias("mz"), F.col("intensity").cast("double").alias("intensity"))
    kinds = [f"{k} {p.schema[k].dataType.simpleString()}" for k in KEY]

    def widths(batches):       # a batch of whole scans at a time: a call per scan costs more than its peaks
        held = None
        for b in itertools.chain(batches, [None]):
            t = held if b is None else pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if t is None or not len(t):
                continue
            keys = [t[k].to_numpy() for k in KEY]
            new = np.concatenate([[True], (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])])
            end = len(t) if b is None else int(np.flatnonzero(new)[-1])      # the last scan may go on
            held, t = t.slice(end), t.slice(0, end).combine_chunks()
            if len(t) < 3:
                continue
            scan = np.cumsum(new[:end])
            start = np.flatnonzero(new[:end])
            y, at = t["intensity"].to_numpy(), np.arange(len(t), dtype=float)
            mz, fwhm = half_widths(t["mz"].to_numpy(), y, scan)
            apex = half_widths(at, y, scan)[0].astype(np.int64)
            at = start[scan[apex] - 1]
            yield pa.RecordBatch.from_arrays([*(t[k].take(at).combine_chunks() for k in KEY), pa.array(mz), pa.array(fwhm)], [*KEY, "mz", "fwhm"])

    ordered = p.join(c.select(*KEY), KEY, "left_semi").repartition(*KEY).sortWithinPartitions(*KEY, F.col("mz").asc_nulls_last(), "intensity")
    m = ordered.mapInArrow(widths, f"{', '.join(kinds)}, mz double, fwhm double")
    m = m.filter("fwhm > 0 AND NOT isnan(fwhm)").join(c, KEY).withColumn("band", S.mz_band("mz")).filter("band IS NOT NULL")
    m = m.withColumn("res", F.col("mz") / F.col("fwhm"))
    return quantiles(m, ["run_id", "analyzer", "ms_level", "band"], "res", [0.5]).withColumnRenamed("q50", "resolution")


def _channels(spark) -> DataFrame:
    rows = [(c, m, "TMT") for c, m in TMT_CHANNELS] + [(c, m, "iTRAQ") for c, m in ITRAQ_CHANNELS]
    return spark.createDataFrame(rows, "channel string, channel_mz double, family string")


def reporters_seen(peaks: DataFrame) -> DataFrame:
    """(run_id, idx, channel, family): channels whose strongest peak is three times the median intensity."""
    pos = peaks.filter("intensity > 0")
    med = pos.groupBy(*KEY).agg(F.median("intensity").alias("bg"))
    ch = _channels(peaks.sparkSession)
    look = ch.withColumn("_lo", F.col("channel_mz") * (1 - REPORTER_PPM * 1e-6)).withColumn("_hi", F.col("channel_mz") * (1 + REPORTER_PPM * 1e-6))
    look = look.withColumn("_k", F.explode(F.sequence(F.floor("_lo").cast("long"), F.floor("_hi").cast("long"))))
    hit = pos.withColumn("_k", F.floor("mz").cast("long")).join(F.broadcast(look), "_k").filter("mz BETWEEN _lo AND _hi")
    best = hit.groupBy(*KEY, "channel", "family").agg(F.max("intensity").alias("y"))
    return best.join(med, KEY).filter(F.col("y") >= REPORTER_MIN_SB * F.col("bg")).select(*KEY, "channel", "family")


def assess_reporters(spectra: DataFrame, lowest: DataFrame) -> DataFrame:
    """(run_id, idx, family, assess): whether a spectrum can show a family's channels.

    ``spectra``: analyzer, scan_low. ``lowest``: run_id, idx, low_mz (smallest peak).
    """
    fam = F.explode(F.array(F.struct(F.lit("TMT").alias("f"), F.lit(TMT_CHANNELS[0][1]).alias("m")), F.struct(F.lit("iTRAQ").alias("f"), F.lit(ITRAQ_CHANNELS[0][1]).alias("m"))))
    s = spectra.join(lowest, KEY, "left").withColumn("x", fam)
    a = (F.when(F.col("low_mz").isNull(), "no_peaks").when(F.coalesce("scan_low", "low_mz") > F.col("x.m") - 0.5, "low_mass_cutoff")
         .when(F.col("analyzer") == "ITMS", "ion_trap").otherwise("ok"))
    return s.select(*KEY, F.col("x.f").alias("family"), a.alias("assess"))


def call_kits(assessed: DataFrame, seen: DataFrame) -> DataFrame:
    """(run_id, kit, state): present when the family shows enough channels and all of them belong to the kit."""
    ok = assessed.filter("assess = 'ok'")
    n = assessed.groupBy("run_id", "family").agg(F.count_if(F.col("assess") == "ok").alias("n_ok"))
    cs = seen.join(ok.select(*KEY, "family"), [*KEY, "family"], "left_semi").groupBy("run_id", "family", "channel").agg(F.count(F.lit(1)).alias("c"))
    obs = cs.join(n, ["run_id", "family"]).filter(F.col("c") >= REPORTER_MIN_SHARE * F.col("n_ok")).groupBy("run_id", "family").agg(F.collect_set("channel").alias("obs"))
    kits = assessed.sparkSession.createDataFrame([(k, "TMT" if k.startswith("tmt") else "iTRAQ", c) for k, c in KITS.items()], "kit string, family string, channels array<string>")
    j = n.join(obs, ["run_id", "family"], "left").join(F.broadcast(kits), "family")
    o = F.coalesce("obs", F.array().cast("array<string>"))
    state = (F.when(F.col("n_ok") < REPORTER_MIN_ASSESSABLE, "not_assessable").when((F.size(o) >= REPORTER_MIN_CHANNELS) & (F.size(F.array_except(o, "channels")) == 0), "present").otherwise("absent"))
    return j.select("run_id", "kit", state.alias("state"))


def tag_yield(census: DataFrame, max_evalue: float = 0.01) -> DataFrame:
    return census.groupBy("run_id").agg(F.avg(F.coalesce(F.col("best_evalue") <= max_evalue, F.lit(False)).cast("int")).alias("tag_yield"))


def fingerprints(peaks: DataFrame, spectra: DataFrame, tol: float, ppm: bool) -> DataFrame:
    """(run_id, idx, bin, w): unit-length square-root intensities of the 50 strongest informative peaks.

    Reporter, immonium and precursor-derived peaks are left out.
    """
    fixed = F.array(*[F.lit(m) for m in [m for _, m in TMT_CHANNELS + ITRAQ_CHANNELS] + IMMONIUM])
    zs = F.when(F.col("charge") > 0, F.array(F.col("charge").cast("int"))).otherwise(F.array(F.lit(2), F.lit(3)))
    forms = F.flatten(F.transform(zs, lambda z: F.flatten(F.transform(F.sequence(F.lit(1), z), lambda y: F.transform(
        F.array(F.lit(0.0), F.lit(-H2O), F.lit(-NH3), F.lit(K.ISOTOPE_STEP)), lambda d: ((F.col("precursor_mz") - K.PROTON) * z + y * K.PROTON) / y + d / y)))))
    s = spectra.select(*KEY, F.when(F.col("precursor_mz") > 0, F.concat(fixed, forms)).otherwise(fixed).alias("_out"))
    w = F.lit(tol) if not ppm else F.col("mz") * (tol * 1e-6)
    p = peaks.filter("intensity > 0 AND mz > 0").join(s, KEY).filter(~F.exists("_out", lambda m: F.abs(m - F.col("mz")) <= w)).drop("_out")
    p = p.withColumn("_r", F.row_number().over(W.partitionBy(*KEY).orderBy(F.desc("intensity"), "mz"))).filter(F.col("_r") <= FINGERPRINT_PEAKS)
    b = p.groupBy(*KEY, F.round(F.col("mz") / BIN_WIDTH).cast("int").alias("bin")).agg(F.sum(F.sqrt("intensity")).alias("v"))
    return b.withColumn("w", F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(W.partitionBy(*KEY)))).drop("v")


def redundant_pairs(spectra: DataFrame, prints: DataFrame, min_cosine: float = MIN_COSINE, min_matched: int = MIN_MATCHED, ppm: float = PAIR_PPM, rt: float = PAIR_RT) -> DataFrame:
    """(run_id, a, b, sim): pairs of equal charge, close m/z, time and mobility with a high cosine.

    Candidates come from a join on (charge, m/z cell, time cell), so only neighbours meet. ``spectra``:
    precursor_mz, charge, rt, ion_mobility (NULL = none).
    """
    a = spectra.select("run_id", "charge", F.col("idx").alias("a"), F.col("precursor_mz").alias("mz_a"), F.col("rt").alias("rt_a"), F.col("ion_mobility").alias("im_a"))
    b = spectra.select("run_id", "charge", F.col("idx").alias("b"), F.col("precursor_mz").alias("mz_b"), F.col("rt").alias("rt_b"), F.col("ion_mobility").alias("im_b"), F.floor(F.col("rt") / rt).alias("_t"))
    a = a.withColumn("_t", F.explode(F.sequence(F.floor((F.col("rt_a") - rt) / rt), F.floor((F.col("rt_a") + rt) / rt))))
    near = range_join(a, b, ["run_id", "charge", "_t"], F.col("mz_a"), F.col("mz_a") * (1 + ppm * 1e-6), "mz_b", 0.05)
    im = F.when(F.col("im_a").isNull() & F.col("im_b").isNull(), True).otherwise(F.coalesce(F.abs(F.col("im_a") - F.col("im_b")) <= PAIR_MOBILITY, F.lit(False)))
    first = (F.col("mz_a") < F.col("mz_b")) | ((F.col("mz_a") == F.col("mz_b")) & (F.col("a") < F.col("b")))
    near = near.filter((F.abs(F.col("rt_a") - F.col("rt_b")) <= rt) & im & first).select("run_id", "a", "b")
    x = near.join(prints.select("run_id", F.col("idx").alias("a"), "bin", F.col("w").alias("wa")), ["run_id", "a"]).join(prints.select("run_id", F.col("idx").alias("b"), "bin", F.col("w").alias("wb")), ["run_id", "b", "bin"])
    s = x.groupBy("run_id", "a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("sim"), F.count(F.lit(1)).alias("matched"))
    return s.filter((F.col("matched") >= min_matched) & (F.col("sim") >= min_cosine)).select("run_id", "a", "b", "sim")


#: Links of a group that one task brings to its end; a larger group goes on by rounds until it falls apart or below this.
TASK_LINKS = 200_000


def linkage(links: list[tuple], spans: dict, rt: float) -> dict:
    """Complete linkage of one group: the cluster (its least member) of every member.

    The most similar pair whose common time span is at most ``rt`` merges first, equal ones in order of their members; a pair of
    clusters needs every link between them and is as similar as the least.
    """
    near: dict = {n: {} for n in spans}
    for a, b, sim in links:
        near[a][b] = near[b][a] = sim
    heap = [(-sim, a, b) for a, b, sim in links]
    heapq.heapify(heap)
    lead = {n: n for n in spans}
    while heap:
        sim, a, b = heapq.heappop(heap)
        if near.get(a, {}).get(b) != -sim or b not in near:
            continue
        low, high = min(spans[a][0], spans[b][0]), max(spans[a][1], spans[b][1])
        if high - low > rt:
            del near[a][b], near[b][a]            # spans only grow
            continue
        spans[a], lead[b] = (low, high), a
        mine, other = near[a], near.pop(b)
        for n in set(mine) | set(other):
            if n not in (a, b):
                near[n].pop(b, None)
                near[n].pop(a, None)
        near[a] = {n: min(s, mine[n]) for n, s in other.items() if n in mine and n != a}
        for n, s in near[a].items():
            near[n][a] = s
            heapq.heappush(heap, (-s, *sorted((a, n))))
    out = {}
    for n in sorted(lead):                        # a cluster leads to its least member
        out[n] = n if lead[n] == n else out[lead[n]]
    return out


def _merged(live: DataFrame, spans: DataFrame, rt: float) -> tuple[DataFrame, DataFrame]:
    """One round: every pair that is the best of both its ends merges. Such a pair stays the best until it merges, whatever merges
    beside it, so rounds end where one merge at a time does. Returns the links left and (label, into)."""
    at = lambda c: spans.select(F.col("label").alias(c), F.col("lo").alias(f"lo_{c}"), F.col("hi").alias(f"hi_{c}"))
    ok = live.join(at("a"), "a").join(at("b"), "b").filter(F.greatest("hi_a", "hi_b") - F.least("lo_a", "lo_b") <= rt)
    ok = materialize(ok.select("a", "b", "sim"))
    best = ok.select(F.explode(F.array("a", "b")).alias("end"), F.struct((-F.col("sim")).alias("far"), "a", "b").alias("k")).groupBy("end").agg(F.min("k").alias("k"))
    chosen = materialize(best.groupBy("k.a", "k.b").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select("a", "b"))
    into = chosen.select(F.col("b").alias("label"), F.col("a").alias("into"))
    for c in ("a", "b"):
        ok = ok.join(into.withColumnRenamed("label", c), c, "left").withColumn(c, F.coalesce("into", c)).drop("into")
    ok = ok.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("sim").alias("sim"), F.count(F.lit(1)).alias("n"))
    for c in ("a", "b"):
        twice = chosen.select(F.col("a").alias(c), F.lit(2).alias(f"parts_{c}"))
        ok = ok.join(twice, c, "left").withColumn(f"parts_{c}", F.coalesce(f"parts_{c}", F.lit(1)))
    return materialize(ok.filter("n = parts_a * parts_b").select("a", "b", "sim")), into


def redundancy_clusters(pairs: DataFrame, spectra: DataFrame, rt: float = PAIR_RT, task_links: int | None = None) -> DataFrame:
    """(run_id, idx, cluster): complete linkage of linked spectra, time span at most ``rt``; a cluster is named by its least spectrum.

    Groups of up to ``task_links`` links end in one task each. Larger ones merge by rounds of mutual best pairs as joins, until the
    links left make smaller groups. Both give the clusters of merging one best pair at a time; no link is left out.
    """
    task_links = TASK_LINKS if task_links is None else task_links
    key = lambda c: F.concat_ws(":", F.col("run_id").cast("string"), F.lpad(F.col(c).cast("string"), 12, "0"))
    nodes = materialize(spectra.select(key("idx").alias("label"), F.col("run_id").cast("long").alias("run_id"), F.col("idx").cast("long").alias("idx"), F.col("rt").cast("double").alias("lo"), F.col("rt").cast("double").alias("hi")))
    live = materialize(pairs.select(F.least(key("a"), key("b")).alias("a"), F.greatest(key("a"), key("b")).alias("b"), "sim"))
    spans, moved, ended = nodes.select("label", "lo", "hi"), [], []
    while live.limit(1).count():
        ends = live.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        comp = materialize(connected_components(live.select("a", "b"), ends))
        grouped = live.join(comp.withColumnRenamed("node", "a"), "a")
        size = grouped.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        small, large = size.filter(F.col("n") <= task_links), size.filter(F.col("n") > task_links)
        rows = grouped.select("component", "a", "b", "sim", F.lit(None).cast("double").alias("hi")).unionByName(
            comp.join(spans, comp["node"] == spans["label"]).select("component", F.col("node").alias("a"), F.lit(None).cast("string").alias("b"), F.col("lo").alias("sim"), "hi"))

        def end(pdf: pd.DataFrame) -> pd.DataFrame:
            own, links = pdf[pdf["b"].isna()], pdf[pdf["b"].notna()]
            found = linkage(list(links[["a", "b", "sim"]].itertuples(index=False, name=None)), {n: (lo, hi) for n, lo, hi in own[["a", "sim", "hi"]].itertuples(index=False, name=None)}, rt)
            return pd.DataFrame({"label": list(found), "into": list(found.values())})

        ended.append(materialize(rows.join(small, "component", "left_semi").groupBy("component").applyInPandas(end, "label string, into string").filter("label <> into")))
        left = materialize(grouped.join(large, "component", "left_semi").select("a", "b", "sim"))
        if not left.limit(1).count():
            break
        live, into = _merged(left, spans, rt)
        moved.append(into)
        spans = materialize(spans.join(into, "label", "left").groupBy(F.coalesce("into", "label").alias("label")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    member = nodes.select("run_id", "idx", F.col("label").alias("name"))
    # a label that has ended moves no more
    steps = moved + [reduce(DataFrame.unionByName, ended)] if ended else []
    for k, into in enumerate(steps):
        member = member.join(into.withColumnRenamed("label", "name"), "name", "left").withColumn("name", F.coalesce("into", "name")).drop("into")
        member = materialize(member) if k % 8 == 7 else member
    return member.select("run_id", "idx", F.substring_index("name", ":", -1).cast("long").alias("cluster"))


def qc_report(figures: DataFrame, section: str = "qc") -> DataFrame:
    """Wide per-run figures as long report rows."""
    keys = [c for c in figures.columns if c != "run_id"]
    u = figures.select("run_id", *[F.col(c).cast("string").alias(c) for c in keys]).unpivot("run_id", keys, "key", "value")
    return u.select("run_id", F.lit(section).alias("section"), "key", F.coalesce("value", F.lit("-")).alias("value"))


def fasta_summary(proteins: DataFrame) -> DataFrame:
    """Entries, residues, decoys and the most frequent decoy affix per database."""
    d = decoy_flag(F.col("accession"))
    affix = F.when(d, F.regexp_extract(F.lower("accession"), r"^([a-z]+_)|(_[a-z]+)$", 0))
    return proteins.groupBy("database").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.length("sequence")).alias("residues"), F.count_if(d).alias("decoys"), F.mode(affix).alias("affix"))


def run_overview(reports: DataFrame, figures: list[DataFrame], calls: list[str]) -> DataFrame:
    """One row per run: report calls pivoted side by side, full-outer joined with per-run figures."""
    r = reports.filter("section = 'call'").groupBy("run_id").pivot("key", calls).agg(F.first("value"))
    for f in figures:
        r = r.join(f, "run_id", "full_outer")
    return r
