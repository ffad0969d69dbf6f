"""Dense row numbers without a pass through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from coterie.session import scratch_path

WITHIN = 33  # bits of Spark's row id below the partition number


def with_row_index(df: DataFrame, name: str = "row_index", first: bool = True) -> DataFrame:
    """Adds ``name``, 0 to n - 1 in the order of the frame's partitions.

    Every task numbers its own rows while they are written to the shared folder; only a
    count for each partition is summed up, and joined back. What is numbered is what was
    written, so a lost executor or another division into partitions changes nothing.
    ``first`` puts the column in front.
    """
    if name.lower() in (column.lower() for column in df.columns):
        raise ValueError(f"rename this input column first: {name}")
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "numbered")
    columns = [f"c{i}" for i in range(len(df.columns))]
    numbered = df.toDF(*columns).withColumn("at", F.monotonically_increasing_id())
    numbered.write.parquet(path)
    rows = spark.read.schema(numbered.schema).parquet(path).withColumn("task", F.shiftright("at", WITHIN))
    counts = rows.groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    # a row for each partition
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = (F.col("at") - F.shiftleft("task", WITHIN) + F.col("offset")).alias(name)
    kept = [F.col(c).alias(original) for c, original in zip(columns, df.columns)]
    return rows.join(F.broadcast(offsets), "task").select(*([place, *kept] if first else [*kept, place]))
