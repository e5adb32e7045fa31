"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores; BENCH_QUERIES may list
query names, or ``all``. Tables that are one small file are first copied into a few files
each, as large tables are, so that their scans have a task per core; that is not timed.
Each query runs twice and the second run counts; ``exchanges`` has those of its plan.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

from labelkit.plans.queries import QUERIES

HEADLINE = ["tag_counts", "word_positions", "chunk_words", "page_xml_text", "bio_to_spans",
            "gazetteer_tag", "vote", "project_spans", "label_documents", "evaluate_models",
            "match_entities", "align_labels", "number_lines_poner", "union_corpora",
            "conll_roundtrip_cnec5", "read_archives"]


def in_files(spark: SparkSession, sf: str, to: str, files: int) -> str:
    """The same tables below another folder; those of some size in several files."""
    for file in Path(sf).glob("*.parquet"):
        if file.is_file() and file.stat().st_size > 1 << 20:
            spark.read.parquet(str(file)).repartition(files).write.parquet(f"{to}/{file.name}")
        else:
            (Path(to) / file.name).symlink_to(file.resolve())
    return to


def exchanges(df) -> int:
    return len(re.findall(r"Exchange (?:hash|range|Single|Round)", df._jdf.queryExecution().executedPlan().toString()))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("labelkit-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "16g")
             .config("spark.sql.files.maxPartitionBytes", "4m")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    took, plans = {}, {}
    with tempfile.TemporaryDirectory() as to:
        data = in_files(spark, sf, to, 2 * int(cpus))
        QUERIES["tag_counts"](spark, data).write.format("noop").mode("overwrite").save()
        for name in names:
            for _ in range(2):
                began = time.perf_counter()
                df = QUERIES[name](spark, data)
                df.write.format("noop").mode("overwrite").save()
                took[name] = round(time.perf_counter() - began, 3)
            plans[name] = exchanges(df)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(took.values()), 3),
                      "unit": "sec", "queries": took, "exchanges": plans,
                      "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
