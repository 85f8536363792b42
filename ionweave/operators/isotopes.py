"""Isotope clusters of fragment spectra by the averagine model.

A spectrum is one row with its peaks as an array, so the work needs one exchange of the peaks and no join. Inside a task the
candidate clusters of all peaks of a spectrum are grown together, one isotope at a time and charge by charge, as numpy columns; only
the competition for peaks, in order of m/z, is a loop.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from ionweave.functions import constants as K

KEY = ["run_id", "idx"]

# Isotope clusters and their fit.
MAX_PEAKS, MAX_CHARGE, AVERAGINE = 10, 3, 1800.0
FIT_LIMITS = np.array([0, 0, 0.05, 0.1, 0.2, 0.4, 0.6], np.float32)
FLOOR, FLOOR_FROM = 0.05, 1e6
MAX_PPM, MAX_DA = 100.0, 0.1


def averagine(mass: np.ndarray) -> np.ndarray:
    """Expected shares of the first isotopes of neutral masses, a row per mass: Poisson with one heavy atom per 1800 Da."""
    steps = (mass / AVERAGINE)[:, None] / np.arange(1, MAX_PEAKS)
    weights = np.concatenate([np.ones((len(mass), 1)), np.cumprod(steps, axis=1)], axis=1)
    return weights / weights.sum(axis=1, keepdims=True)


def grown(mz: np.ndarray, height: np.ndarray, charge: int, tol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cluster that starts at each peak: its members (row per peak, columns by isotope) and its size.

    The nearest peak to an isotope's place counts, the lower one on ties, if it lies within ``tol`` of it. A cluster ends before
    the first isotope that is missing or with which the Kullback-Leibler divergence of the observed from the expected shares
    exceeds the limit of that size; it needs two peaks.
    """
    n = len(mz)
    members, size = np.zeros((n, MAX_PEAKS), np.int64), np.ones(n, np.int64)
    members[:, 0] = np.arange(n)
    shares = averagine(charge * (mz - K.PROTON))
    fence = np.concatenate([[-np.inf], mz, [np.inf]])
    alive = np.arange(n)
    for i in range(1, MAX_PEAKS):
        want = mz[alive] + i * K.ISOTOPE_STEP / charge
        above = np.searchsorted(mz, want) + 1
        near = np.where(np.abs(fence[above] - want) < np.abs(fence[above - 1] - want), above, above - 1)
        there = (fence[near] >= want - tol[alive]) & (fence[near] <= want + tol[alive])
        alive, near = alive[there], near[there] - 1
        if not len(alive):
            break
        members[alive, i] = near
        seen = height[members[alive, :i + 1]]
        seen = seen / seen.sum(axis=1, keepdims=True)
        model = shares[alive, :i + 1]
        terms = seen * np.log(seen / (model / model.sum(axis=1, keepdims=True)))
        # single precision, as the limits
        off = np.zeros(len(alive), np.float32)
        for column in terms.T:
            off = (off + column).astype(np.float32)
        alive = alive[off <= FIT_LIMITS[min(i + 1, 6)]]
        size[alive] = i + 1
    return members, size


def monoisotopic(mz: np.ndarray, height: np.ndarray, tol: float, ppm: bool) -> tuple[np.ndarray, np.ndarray]:
    """Peaks of a spectrum (ascending m/z) with each cluster collapsed to its first peak at charge 1.

    A peak that no cluster holds yet takes its largest cluster, ties to the higher charge. Peaks without a cluster stay. A moved
    peak joins a neighbour within the tolerance, the stronger of the two staying.
    """
    if len(mz) <= 2:
        return mz, height
    tol = min(tol, MAX_PPM if ppm else MAX_DA)
    before = mz
    strong = height >= min(FLOOR, FLOOR * height.max() / FLOOR_FROM)
    mz, height = mz[strong], height[strong]
    window = tol / 1e6 * mz if ppm else np.full(len(mz), tol)
    best, members, charge = np.ones(len(mz), np.int64), np.zeros((len(mz), MAX_PEAKS), np.int64), np.zeros(len(mz), np.int64)
    for z in range(1, MAX_CHARGE + 1):
        mine, size = grown(mz, height, z, window)
        wins = (size >= 2) & (size >= best)
        best[wins], members[wins], charge[wins] = size[wins], mine[wins], z
    taken, first = np.zeros(len(mz), bool), np.zeros(len(mz), np.int64)
    for i in np.flatnonzero(charge).tolist():
        if not taken[i]:
            taken[members[i, :best[i]]] = True
            first[i] = charge[i]
    stays = ~taken | (first > 0)
    z = np.maximum(first[stays], 1)
    mz, height = np.where(z > 1, mz[stays] * z - (z - 1) * K.PROTON, mz[stays]), height[stays]
    if not (z > 1).any():
        return mz, height
    order = np.argsort(mz, kind="stable")
    mz, height = mz[order], height[order]
    moved = ~np.isin(mz, before)
    out: list[list] = []
    for m, h, new in zip(mz.tolist(), height.tolist(), moved.tolist(), strict=True):
        last = out[-1] if out else None
        if last and (new or last[2]) and m - last[0] <= (m * tol * 1e-6 if ppm else tol):
            last[:] = [m, h, True] if h > last[1] else [last[0], last[1], True]
        else:
            out.append([m, h, new])
    return np.array([p[0] for p in out]), np.array([p[1] for p in out])


def deisotope(peaks: DataFrame, tol: float, ppm: bool) -> DataFrame:
    """Isotope clusters (two to ten peaks, charge 1 to 3) become their monoisotopic peak on the 1+ scale.

    Needs one row per (spectrum, m/z); columns other than m/z and intensity are constants of the spectrum. Peaks below an
    absolute floor, which falls with the base peak, go first.
    """
    kind = peaks.schema["intensity"].dataType
    rest = [c for c in peaks.columns if c not in (*KEY, "mz", "intensity")]

    @arrow_udf("array<struct<mz:double,intensity:double>>")
    def collapsed(spectra: pa.Array) -> pa.Array:
        offsets, flat = spectra.offsets.to_numpy(), spectra.values
        mz, height = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("mz", "intensity"))
        parts = [monoisotopic(mz[a:z], height[a:z], tol, ppm) for a, z in zip(offsets, offsets[1:], strict=False)]
        ends = np.cumsum([0, *[len(m) for m, _ in parts]])
        none = [np.zeros(0)]
        rows = pa.StructArray.from_arrays([pa.array(np.concatenate(none + [p[k] for p in parts])) for k in (0, 1)], names=["mz", "intensity"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    one = F.struct(F.col("mz").cast("double").alias("mz"), F.col("intensity").cast("double").alias("intensity"))
    per = peaks.groupBy(*KEY).agg(F.array_sort(F.collect_list(one)).alias("_p"), *[F.first(c).alias(c) for c in rest])
    out = per.withColumn("_p", collapsed("_p")).select(*KEY, *rest, F.inline("_p"))
    return out.select(*KEY, "mz", F.col("intensity").cast(kind).alias("intensity"), *rest)
