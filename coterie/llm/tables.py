"""Small helpers the operators share: written tables, Arrow columns, free names."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from coterie.session import scratch_path, ship  # noqa: F401


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them back.

    A lost executor then costs tasks, not the lineage. The table lies below
    ``spark.checkpoint.dir`` and stays until that folder is cleaned, as the frame
    that is returned reads it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the frame has not got, whatever its case."""
    taken = {name.lower() for name in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return [text or b"" for text in column.cast(pa.binary()).to_pylist()]


def blocks(sizes: list[int], most: int) -> Iterator[slice]:
    """Runs of neighbouring items of at most ``most`` bytes, or of one item."""
    begin = total = 0
    for k, size in enumerate(sizes):
        if k > begin and total + size > most:
            yield slice(begin, k)
            begin, total = k, 0
        total += size
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def make_room() -> None:
    """Gives back what earlier tasks of this Python worker left: encoders with their memos,
    which only tasks that encode have a use for, and freed memory that is still held."""
    words = sys.modules.get("coterie.llm.word_tokens")
    if words is not None:
        words.word_encoder.cache_clear()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        getattr(ctypes.CDLL(None), "malloc_trim", int)(0)
