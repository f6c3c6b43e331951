"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from strandloom.plans import catalog

HEADLINE = ("q02_gc_fraction", "q05_codon_usage", "q07_orfs_linear", "q10_zcurve_mono", "q13_translate_orfs", "q17_gc_bins", "q20_overprint_pairs", "q23_gff_rows", "q28_kmer_profile", "q42_meta_predict", "q44_circular_orfs")
#: Each query's figure is the median of so many runs.
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["q07_orfs_linear"](spark, sf_dir).limit(1).count()  # starts the executor's code
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS):
            began = time.time()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
