"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from tracefold.plans import QUERIES

HEADLINE = [
    "fold_part_evidence",        # 1.8 M statements -> edges, from the raw tables
    "fold_market_evidence",
    "parse_document_statements",
    "teach_documents",
    "edge_measures",             # first use of the stored part graph: includes its build
    "recognize_top5",            # 150 groups in one job
    "converge_names",
    "why_parts",
    "similar_properties",
    "cluster_concepts",
    "echo_regions",
    "label_grams",               # builds the stored label index, once per graph
    "resolve_terms",
    "answer_by_intersection",
    "classify_turns",
    "html_to_text_article",
    "chunk_documents",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.adaptive.enabled", "true")
             .config("tracefold.spread", cpus)      # the bench tables are single files
             .config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total query time", "value": round(sum(took.values()), 3),
                      "unit": "sec", "queries": took,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
