"""Oxonium ion evidence of glycopeptides."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ionweave.functions import scalar as S

KEY = ["run_id", "idx"]

# Oxonium ions.
OXONIUM = [(126.05495, "HexNAc-C2H6O3"), (138.05495, "HexNAc-CH6O3"), (144.06552, "HexNAc-C2H4O2"), (163.0601, "Hex"),
           (168.06552, "HexNAc-2H2O"), (186.07608, "HexNAc-H2O"), (204.08665, "HexNAc"), (243.02638, "HexP"),
           (274.09213, "NeuAc-H2O"), (290.08705, "NeuGc-H2O"), (292.10269, "NeuAc"), (308.09761, "NeuGc"),
           (366.13948, "HexHexNAc"), (405.07926, "HexNAcHexP"), (512.19737, "HexHexNAcdHex"), (657.23488, "HexHexNAcNeuAc")]


def oxonium_scan(peaks: DataFrame, tol: float, ppm: bool, min_fraction: float = 0.10) -> DataFrame:
    """Per spectrum: matched ions, their intensity over the base peak, the glyco flag and the names.

    Raw peaks are matched to sixteen fixed ions and reduced map-side before any shuffle.
    """
    ions = peaks.sparkSession.createDataFrame(OXONIUM, "ion_mz double, ion string")
    t = S.tolerance("ion_mz", tol, ppm)
    wide = ions.withColumn("_lo", F.col("ion_mz") - t).withColumn("_hi", F.col("ion_mz") + t)
    p = peaks.withColumn("_k", F.floor(F.col("mz")).cast("long"))
    look = wide.withColumn("_k", F.explode(F.sequence(F.floor("_lo").cast("long"), F.floor("_hi").cast("long"))))
    hit = p.join(F.broadcast(look), "_k").filter("mz BETWEEN _lo AND _hi")
    best = hit.groupBy(*KEY, "ion_mz", "ion").agg(F.max("intensity").alias("y"))
    g = best.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"), F.array_sort(F.collect_list(F.struct("ion_mz", "ion"))).alias("l"))
    base = peaks.groupBy(*KEY).agg(F.max("intensity").alias("base"))
    frac = F.coalesce(F.col("s") / F.col("base"), F.lit(0.0))
    return base.join(g, KEY, "left").select(
        *KEY, F.coalesce("n", F.lit(0)).alias("n_oxonium"), frac.alias("oxonium_frac"),
        ((F.coalesce("n", F.lit(0)) >= 2) & (frac >= min_fraction)).alias("glyco"),
        F.coalesce(F.array_join(F.transform("l", lambda x: x.ion), ";"), F.lit("-")).alias("ions"))
