"""Scores computed with plain expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from coterie.operators.columns import quoted


def class_accuracy(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Share of rows whose label equals the prediction, for several pairs of
    columns in one pass. Result columns carry the keys of ``pairs``."""
    return df.agg(
        *[
            F.avg(quoted(label).eqNullSafe(quoted(prediction)).cast("int")).alias(name)
            for name, (label, prediction) in pairs.items()
        ]
    )


def squared_distance(names: Sequence[str], centre: Sequence[float]) -> Column:
    terms = [(quoted(name) - F.lit(float(at))) ** 2 for name, at in zip(names, centre)]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def nearest_centre(
    df: DataFrame, names: Sequence[str], centres: Sequence[Sequence[float]]
) -> DataFrame:
    """Adds ``prediction``, the first nearest centre, and ``cost``, its squared
    distance: what a K-Means model assigns, as an expression over the columns."""
    distances = F.array(*[squared_distance(names, centre) for centre in centres])
    with_distances = df.withColumn("distances", distances)
    cost = F.array_min("distances")
    return (
        with_distances.withColumn("cost", cost)
        .withColumn("prediction", (F.array_position("distances", F.col("cost")) - 1).cast("int"))
        .drop("distances")
    )
