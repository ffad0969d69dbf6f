"""Places of rows within groups of any size, in a given order.

A group may hold a third of all rows, so no task numbers a whole one: rows are dealt out by
ranges of the order, each task numbers the groups of its range, and what earlier tasks
hold of a group is added. Only groups that lie in several ranges have something to add,
so no more than a row for each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coterie.llm.tables import stage


def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task and the place within it; the first column is the group, in order."""
    task = TaskContext.get().partitionId()
    last, count = None, 0  # the group of the row before, and its rows so far
    for batch in batches:
        if not batch.num_rows:
            continue
        coded = batch.column(0).dictionary_encode("encode")
        codes = coded.indices.to_numpy(zero_copy_only=False)
        begins = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        runs = np.diff(np.r_[begins, len(codes)])
        places = np.arange(len(codes)) - np.repeat(begins, runs)
        values = batch.column(0).take(pa.array([0, len(codes) - 1])).to_pylist()
        if last == [values[0]]:
            places[: runs[0]] += count
        last, count = [values[1]], int(places[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(codes), task, np.int32)), pa.array(places)],
            names=[*batch.schema.names, "task", "inner"],
        )


def placed(rows: DataFrame, group: str, order: list, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``place`` from 0 in each ``group``, (group, size)), both written.

    A null group is a group. ``order`` are the columns to order by within a group; of rows
    that are alike in them any may come first. ``rows`` must give the same values whenever
    they are read.
    """
    by = [F.col(group).asc_nulls_first(), *order]
    columns = [group, *(c for c in rows.columns if c != group)]
    dealt = rows.select(columns).repartitionByRange(*by).sortWithinPartitions(*by)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    found = stage(dealt.mapInArrow(number, f"{shape}, task int, inner bigint"), name)
    held = found.groupBy(group, "task").agg((F.max("inner") + 1).alias("n"))
    in_group = Window.partitionBy(group)
    held = stage(
        held.select(
            F.col(group).alias("held"), "task", "n",
            (F.sum("n").over(in_group.orderBy("task")) - F.col("n")).alias("before"),
            F.sum("n").over(in_group).alias("size"),
        ),
        name,
    )
    # a row for each task at most: only its first group can have begun earlier
    late = held.where("before > 0").select("held", F.col("task").alias("of"), "before")
    same = F.col(group).eqNullSafe(F.col("held")) & (F.col("task") == F.col("of"))
    full = found.join(F.broadcast(late), same, "left").select(
        *columns, (F.col("inner") + F.coalesce("before", F.lit(0))).alias("place")
    )
    sizes = held.where("before = 0").select(F.col("held").alias(group), "size")
    return full, sizes
