"""Synthetic tables: random columns scaled to 0..1."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from coterie.operators.features import min_max_scale

ROWS_PER_PARTITION = 1_000_000


def uniform(seed: int, row: Column) -> Column:
    """In 0..1, both ends excluded: a hash of the seed and the row's id.

    A draw depends on nothing else, so a table is the same in any number of partitions,
    and a part of it can be drawn alone.
    """
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), row.cast("long")), 12)
    return (bits + F.lit(0.5)) * F.lit(2.0**-52)


def normal(seed: int, row: Column) -> Column:
    """Mean 0 and deviation 1, from two uniform draws."""
    angle = F.lit(2 * math.pi) * uniform(-seed - 1, row)
    return F.sqrt(F.lit(-2.0) * F.log(uniform(seed, row))) * F.cos(angle)


def exponential(seed: int, row: Column) -> Column:
    return -F.log(uniform(seed, row))


DISTRIBUTIONS = (uniform, normal, exponential)


def choose_distributions(features: int, seed: int) -> list:
    """One distribution a column, each equally likely, fixed by the seed."""
    draw = random.Random(seed)
    return [draw.choice(DISTRIBUTIONS) for _ in range(features)]


def random_table(
    spark: SparkSession,
    rows: int,
    features: int,
    seed: int,
    rows_per_partition: int = ROWS_PER_PARTITION,
) -> DataFrame:
    """``id`` and unscaled ``feature_0 .. feature_{n-1}``.

    Every column has its own seed, and a value depends on that and the id alone: the table
    is the same whatever its partitions, and a lost one comes back with the same values.
    """
    ids = spark.range(0, rows, 1, max(1, math.ceil(rows / rows_per_partition)))
    chosen = choose_distributions(features, seed)
    return ids.select(
        "id",
        *[
            distribution(seed * 1_000_003 + i, F.col("id")).alias(f"feature_{i}")
            for i, distribution in enumerate(chosen)
        ],
    )


def generate_table(
    spark: SparkSession,
    rows: int,
    features: int,
    seed: int,
    rows_per_partition: int = ROWS_PER_PARTITION,
) -> DataFrame:
    """``random_table`` with every feature scaled to 0..1."""
    raw = random_table(spark, rows, features, seed, rows_per_partition)
    return min_max_scale(raw, [name for name in raw.columns if name != "id"])
