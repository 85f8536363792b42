"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ionweave.plans import registry  # noqa: E402
from ionweave.session import build_session  # noqa: E402

HEADLINE = ["T11_tag_spectra", "T4_residue_edges", "T6_walks", "C5_census", "C11_ident_score", "Q3_match_db", "Q6_qvalues", "L1_locate",
            "M2_group_bins", "N2_protein_table", "G1_terminus_counts", "K8_fingerprints", "B6_classify_acquisition", "X4_tag_support", "Y1_oxonium_scan",
            "V14_auroc"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.checkpoint.dir": os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"), "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    registry.load_all()
    spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()   # JVM warm-up
    times = {}
    for name in HEADLINE:
        t = time.perf_counter()
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
        spark.catalog.clearCache()
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf)}))


if __name__ == "__main__":
    main()
