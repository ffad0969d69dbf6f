"""The grid of a sweep, and what is left of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from coterie.functions import fixed


def expand(df: DataFrame, choices: dict[str, Sequence[int]]) -> DataFrame:
    """Every row once for each combination of the choices.

    A row is exploded in place, so nothing is shuffled or joined.
    """
    for name, values in choices.items():
        options = F.array(*[F.lit(value).cast("int") for value in values])
        df = df.select("*", F.explode(options).alias(name))
    return df


def grid(
    spark: SparkSession,
    rows: Sequence[int] = tuple(fixed.GRID_ROWS),
    features: Sequence[int] = tuple(fixed.GRID_FEATURES),
    clusters: Sequence[int] = tuple(fixed.GRID_CLUSTERS),
    max_iterations: Sequence[int] = tuple(fixed.GRID_MAX_ITERATIONS),
) -> DataFrame:
    """All combinations: RecordCount, FeaturesCount, Clusters, maxIteration."""
    one = spark.range(1).select()
    points = expand(
        one,
        {
            "RecordCount": rows,
            "FeaturesCount": features,
            "Clusters": clusters,
            "maxIteration": max_iterations,
        },
    )
    return points.withColumn("RecordCount", F.col("RecordCount").cast("bigint"))


def remaining(points: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points whose keys are not in ``done``, whatever order they were done in."""
    return points.join(done.select(*keys), list(keys), "left_anti")
