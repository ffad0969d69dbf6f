"""The benchmark sweep: every algorithm at every grid point, into the ledger."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession, functions as F

from coterie.functions import fixed
from coterie.operators import clustering
from coterie.operators.features import assemble, byte_size
from coterie.operators.grid import grid, remaining
from coterie.operators.synthetic import generate_table
from coterie.sources.ledgers import append_sweep, read_sweep

POINT_KEYS = ["RecordCount", "FeaturesCount", "Clusters", "maxIteration"]


def fit_all(
    vectors: DataFrame, k: int, max_iter: int, seed: int = clustering.DEFAULT_SEED
) -> list[clustering.Fit]:
    """All algorithms on the same vectors, one after the other so that their
    times can be compared."""
    return [
        clustering.fit(vectors, entry.name, k, max_iter, seed) for entry in clustering.ALGORITHMS
    ]


def ledger_rows(
    spark: SparkSession,
    fits: Sequence[clustering.Fit],
    *,
    k: int,
    max_iter: int,
    workers: int,
    rows: int,
    features: int,
    run_id: str,
) -> DataFrame:
    """One ledger row per fit. The size counts an id column beside the features."""
    return spark.createDataFrame(
        [
            (
                max_iter,
                k,
                workers,
                byte_size(rows, features + 1),
                rows,
                features,
                float(one.seconds),
                float(one.quality),
                one.algorithm.name,
                run_id,
            )
            for one in fits
        ],
        fixed.LEDGER_SCHEMA,
    )


def benchmark_table(
    df: DataFrame,
    features: Sequence[str],
    *,
    workers: int,
    clusters: Sequence[int] = tuple(fixed.GRID_CLUSTERS),
    max_iterations: Sequence[int] = tuple(fixed.GRID_MAX_ITERATIONS),
    ledger_path: str | None = None,
    seed: int = clustering.DEFAULT_SEED,
    run_id: str | None = None,
    partitions: int | None = None,
) -> list[DataFrame]:
    """Every (clusters, max_iterations) on one table, which is held throughout.

    Returns the ledger rows of each point, appended to ``ledger_path`` as soon as
    the point is done when a path is given.
    """
    spark, run_id = df.sparkSession, run_id or uuid.uuid4().hex
    done = []
    with clustering.held(assemble(df, features, keep_input=False), partitions) as vectors:
        rows = vectors.count()
        for k in clusters:
            for max_iter in max_iterations:
                point = ledger_rows(
                    spark,
                    fit_all(vectors, k, max_iter, seed),
                    k=k,
                    max_iter=max_iter,
                    workers=workers,
                    rows=rows,
                    features=len(features),
                    run_id=run_id,
                )
                if ledger_path is not None:
                    append_sweep(point, ledger_path)
                done.append(point)
    return done


def completed(ledger: DataFrame, workers: int) -> DataFrame:
    """Grid points of this worker count for which some run has a row for every algorithm."""
    return (
        ledger.filter(F.col("Workers") == workers)
        .groupBy(*POINT_KEYS, "run_id")
        .agg(F.count_distinct("Algorithm").alias("algorithms"))
        .filter(F.col("algorithms") == len(clustering.ALGORITHMS))
        .select(*POINT_KEYS)
        .distinct()
    )


def sweep(
    spark: SparkSession,
    ledger_path: str,
    workers: int,
    points: DataFrame | None = None,
    make_table: Callable[[SparkSession, int, int, int], DataFrame] = generate_table,
    seed: int = clustering.DEFAULT_SEED,
    run_id: str | None = None,
) -> int:
    """Runs the grid points that the ledger lacks; returns how many.

    Stop it at any time and start it again: a point counts once its three rows
    are written. Each call writes under a ``run_id`` of its own unless one is given, so
    what a stopped run left of a point is never mixed with a later one. The points are a few hundred parameter rows, looped over on the
    driver; tables are generated, held and fitted on the executors.
    """
    run_id = run_id or uuid.uuid4().hex
    points = grid(spark) if points is None else points
    missing = remaining(points, completed(read_sweep(spark, ledger_path), workers), POINT_KEYS)
    todo = [tuple(row) for row in missing.select(*POINT_KEYS).orderBy(*POINT_KEYS).collect()]
    for (rows, features), same_table in groupby(todo, key=lambda point: point[:2]):
        table = make_table(spark, rows, features, seed)
        names = [name for name in table.columns if name != "id"]
        with clustering.held(assemble(table, names, keep_input=False)) as vectors:
            for _, _, k, max_iter in same_table:
                append_sweep(
                    ledger_rows(
                        spark,
                        fit_all(vectors, k, max_iter, seed),
                        k=k,
                        max_iter=max_iter,
                        workers=workers,
                        rows=rows,
                        features=features,
                        run_id=run_id,
                    ),
                    ledger_path,
                )
    return len(todo)
