"""Column selection and preview."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def quoted(name: str) -> Column:
    """A column by its exact name, also when it holds dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def select_named(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns in the order given."""
    require_columns(df, names)
    return df.select(*[quoted(name) for name in names])


def select_all_but(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[quoted(name) for name in df.columns if name not in names])


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    unknown = [name for name in names if name not in df.columns]
    if unknown:
        raise ValueError(f"no such column: {', '.join(unknown)}")


def preview(df: DataFrame, rows: int = 20) -> DataFrame:
    """The first rows in no particular order."""
    return df.limit(rows)
