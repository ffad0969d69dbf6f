"""Times the headline queries; prints one JSON line.

Warm session, one untimed run each, then the median of two, or a single run where that
takes over ten seconds. Results go to the ``noop`` sink, so no rows are collected.
``fit_*`` is the fit alone, on vectors that are held and counted first. Figures are printed
as they come; after ``LIMIT`` seconds the rest is named under ``left_out``.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from coterie.operators import clustering
from coterie.operators.features import assemble
from coterie.session import local_session
from coterie.workload import QUERIES
from coterie.workload.clustering import grouped_points

HEADLINE = [
    "kmeans_scores",
    "bisecting_scores",
    "mixture_scores",
    "cluster_job",
    "kmeans_embeddings",
    "silhouette_fixed",
    "nearest_centre",
    "minmax_scale",
    "synthetic_table",
    "training_labels",
    "recommend_jobs",
    "file_profile",
    "file_shape_check",
    "dataset_intake",
    "request_rule",
    "run_state",
    "csv_round_trip",
    "csv_text_round_trip",
    "csv_files_check",
    "training_labels_csv",
    "forest_accuracy",
    "algorithm_benchmark",
    "sweep_synthetic",
    "exact_split",
    "compacted_ledger",
    "indexed_result",
]
RUNS, LONG, LIMIT = 2, 10, 600


def median_seconds(action) -> float:
    action()
    times = []
    while len(times) < RUNS and sum(times) < LONG:
        started = time.perf_counter()
        action()
        times.append(time.perf_counter() - started)
    return round(statistics.median(times), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    chosen = sys.argv[1:] or HEADLINE
    spark = local_session("coterie-bench", cores)
    spark.sparkContext.setLogLevel("ERROR")

    seconds, left_out, began = {}, [], time.perf_counter()
    for name in chosen:
        if time.perf_counter() - began > LIMIT:
            left_out.append(name)
            continue
        seconds[name] = median_seconds(
            lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        )
        print(name, seconds[name], file=sys.stderr, flush=True)
    if chosen is HEADLINE and not left_out:
        points = assemble(grouped_points(spark, sf_dir), ["x", "y"], keep_input=False)
        with clustering.held(points, 8) as vectors:
            for entry in clustering.ALGORITHMS:
                fits = [clustering.fit(vectors, entry.name, 3, 20) for _ in range(RUNS)]
                seconds[f"fit_{entry.name}"] = round(
                    statistics.median(fit.seconds for fit in fits), 3
                )
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, median seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cores": cores,
                "left_out": left_out,
            }
        )
    )


if __name__ == "__main__":
    main()
