"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the cores. The tables come as
one file with one row group each, which one task has to read; landed data come as many
files. So the tables of texts are first written once as BENCH_FILES files, without
changing a row, and the queries run as they would on a cluster. A query is run once to
warm up, then timed: the median of three runs, or one run when the warm-up took longer
than BENCH_SLOW seconds. A run ends when all rows are made; `build` is the part of it
until the result is described, eager steps included.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from postlake.plans.queries import QUERIES

HEADLINE = (
    "search_bm25", "search_phrase", "search_boolean", "search_filtered", "search_count",
    "index_search_boolean", "facet_source", "facet_city_filtered", "top_skills", "top_terms_text",
    "timeline_days", "summary", "state_fold", "state_upsert", "dedup_run", "dedup_dropped", "quota",
    "normalise_text", "salary_extract", "workload_in_texts", "pages_to_text", "page_links",
    "jsonld_postings", "api_rows", "skill_tagging", "ingest_state", "stream_ingest",
    "state_late_run", "index_refresh", "replayed_state", "search_full_rows",
)
TEXTS = ("documents", "pages", "conversations")


def many_files(spark: SparkSession, folder: str, files: int) -> str:
    """A folder with the same tables, those of texts in many files."""
    made = tempfile.mkdtemp(prefix="postlake-tables-")
    for name in os.listdir(folder):
        table = name.removesuffix(".parquet")
        if table in TEXTS:
            spark.read.parquet(f"{folder}/{name}").repartition(files).write.parquet(f"{made}/{name}")
        else:
            os.symlink(os.path.abspath(f"{folder}/{name}"), f"{made}/{name}")
    return made


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    slow = float(os.environ.get("BENCH_SLOW", "12"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("postlake-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="postlake-bench-"))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    tables = many_files(spark, folder, int(os.environ.get("BENCH_FILES", "16")))

    def run(name: str) -> tuple[float, float]:
        began = time.perf_counter()
        result = QUERIES[name](spark, tables)
        built = time.perf_counter() - began
        result.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began, built

    times: dict[str, float] = {}
    builds: dict[str, float] = {}
    for name in HEADLINE:
        warm_up, _ = run(name)
        runs = sorted(run(name) for _ in range(1 if warm_up > slow else 3))
        times[name], builds[name] = (round(x, 3) for x in runs[len(runs) // 2])
    spark.stop()
    print(json.dumps({
        "metric": "total warm time of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "build": builds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
