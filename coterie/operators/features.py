"""Feature projection, bounds, scaling and vector assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Row, functions as F

from coterie.functions.fixed import BYTES_PER_VALUE
from coterie.operators.columns import quoted, require_columns

RESERVED = ("features", "prediction", "probability")


def parse_features(text: str) -> list[str]:
    """A comma separated request text as the list the other functions take."""
    return text.split(",")


def bounds(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row with ``<name>_min`` and ``<name>_max`` for every column, in one pass."""
    require_columns(df, names)
    # Adding zero turns a negative zero into a plain one.
    return df.agg(
        *[
            f(quoted(name) + F.lit(0.0)).alias(f"{name}_{suffix}")
            for name in names
            for f, suffix in ((F.min, "min"), (F.max, "max"))
        ]
    )


def scale_to(df: DataFrame, limits: Row, names: Sequence[str]) -> DataFrame:
    """Columns replaced by ``(x - min) / (max - min)``; null where max = min."""

    def scaled(name: str):
        low, high = limits[f"{name}_min"], limits[f"{name}_max"]
        span = None if low is None else high - low
        return F.try_divide(quoted(name) - F.lit(low), F.lit(span).cast("double"))

    return df.select(
        *[
            scaled(name).alias(name) if name in names else quoted(name)
            for name in df.columns
        ]
    )


def min_max_scale(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns scaled to 0..1. One aggregate over all columns, then a projection;
    only the bounds, two numbers a column, pass through the driver."""
    return scale_to(df, bounds(df, names).first(), names)


def assemble(
    df: DataFrame,
    names: Sequence[str],
    handle_invalid: str = "error",
    keep_input: bool = True,
) -> DataFrame:
    """Adds the ``features`` vector, its entries in the order of ``names``.

    ``handle_invalid`` is ``error``, ``skip`` or ``keep`` and covers nulls and
    NaN. Columns are first aliased by position, so any column name works.
    """
    require_columns(df, names)
    taken = [name for name in df.columns if name in RESERVED]
    if keep_input and taken:
        raise ValueError(f"rename these input columns first: {', '.join(taken)}")
    inputs = [f"feature_input_{i}" for i in range(len(names))]
    kept = [quoted(name) for name in df.columns] if keep_input else []
    aliased = df.select(*kept, *[quoted(n).alias(i) for n, i in zip(names, inputs)])
    assembler = VectorAssembler(
        inputCols=inputs, outputCol="features", handleInvalid=handle_invalid
    )
    return assembler.transform(aliased).drop(*inputs)


def byte_size(rows: int, columns: int) -> int:
    """Size estimate of a table of plain numbers."""
    return rows * columns * BYTES_PER_VALUE


def table_size(df: DataFrame) -> DataFrame:
    """One row: ``row_count`` and the estimate ``byte_size``. Counts once."""
    width = len(df.columns)
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn(
        "byte_size", F.col("row_count") * F.lit(width * BYTES_PER_VALUE).cast("bigint")
    )


def vectors_from_arrays(df: DataFrame, name: str) -> DataFrame:
    """Adds ``features`` from a column that holds the numbers as an array."""
    return df.withColumn("features", array_to_vector(quoted(name)))
