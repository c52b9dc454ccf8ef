"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "scan_literal", "scan_regex", "scan_ignore_case", "filter_type", "count_matches", "files_with_matches", "max_results", "context_lines", "render_grep", "render_jsonl",
    "trigram_postings", "trigram_doc_frequency", "index_search_literal", "index_search_regex", "index_search_ignore_case", "candidates_literal", "debounce_batches",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench")
    conf = {"spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": cpus, "spark.sql.session.timeZone": "UTC", "spark.sql.files.maxPartitionBytes": "4m"}
    spark = builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from lexgrain.queries import QUERIES

    took: dict[str, float] = {}
    spark.range(1000).selectExpr("sum(id)").collect()
    began = time.time()
    QUERIES["trigram_doc_frequency"](spark, sf_dir)  # the index is built once and used by all that search it
    took["index_build"] = round(time.time() - began, 3)
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    found = re.search(r"sf([0-9.]+)", os.path.basename(sf_dir.rstrip("/")))
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(found[1]) if found else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
