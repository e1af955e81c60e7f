"""Time the headline queries and the published benchmark scenario; print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is written to the no-op sink, so all of its rows are computed; the better
of two runs counts. ``corpus_*`` are the steps of the published scenario: a synthetic
repository of 1,526 files, chunked, embedded and searched.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [HERE, os.path.join(HERE, "tests")]

import corpus  # noqa: E402

from recollect.catalog.queries import QUERIES  # noqa: E402
from recollect.engine import Engine  # noqa: E402

HEADLINE = [
    "recall_notes", "recall_notes_stats", "recall_turns", "dedup_greedy", "knn_top_k", "knn_per_project",
    "knn_min_score", "pack_budget", "hash_embedding", "shingle_counts", "neighbour_jaccard", "estimate_tokens",
    "hit_costs", "exact_duplicates", "project_counts", "index_digest", "value_percentiles", "list_newest",
    "ingest_diff", "ingest_totals", "range_overlaps", "line_windows", "code_chunks", "python_chunks", "migrate_v1",
]


def timed(run, times: int = 1) -> float:
    best = float("inf")
    for _ in range(times):
        started = time.perf_counter()
        run()
        best = min(best, time.perf_counter() - started)
    return round(best, 3)


def corpus_steps(spark: SparkSession, folder: str) -> dict[str, float]:
    project = "orchard"
    for rel, text in corpus.files(project):
        path = os.path.join(folder, "src", rel)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as handle:
            handle.write(text)
    engine = Engine(spark, os.path.join(folder, "home"))

    def ingest() -> None:
        engine.ingest_codebase(os.path.join(folder, "src"), project)

    steps = {"corpus_ingest_cold": timed(ingest), "corpus_ingest_unchanged": timed(ingest)}
    edited = os.path.join(folder, "src", "orchard", "area0", "part0.go")
    with open(edited) as handle:
        text = handle.read()
    with open(edited, "w") as handle:
        handle.write(text.replace("return best", "return best + 1", 1))
    steps["corpus_ingest_one_edit"] = timed(ingest)
    asked = [(i, project, q) for i, q in enumerate(corpus.questions(project, 60))]
    queries = spark.createDataFrame(asked, "query_id long, project string, query string")
    engine.warm(project)
    for name, limit, budget in [("corpus_recall_60", 10, None), ("corpus_recall_60_budget", 10, 2000)]:
        sized = queries.selectExpr("*", f"{limit} AS limit", f"{budget or 'CAST(NULL AS INT)'} AS max_tokens")
        steps[name] = timed(lambda: engine.recall_many(sized).where("chosen").write.format("noop").mode("overwrite").save(), 2)
    single = [timed(lambda q=q: engine.search(q[2], 10, project)) for q in asked[:7]]
    steps["corpus_recall_single_p50"] = round(statistics.median(single), 3)
    return steps


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("recollect-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        seconds[name] = timed(lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save(), 2)
        print(name, seconds[name], file=sys.stderr)
    folder = tempfile.mkdtemp(prefix="recollect-bench-")
    try:
        seconds.update(corpus_steps(spark, folder))
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir).removeprefix("sf")}))


if __name__ == "__main__":
    main()
