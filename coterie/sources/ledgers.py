"""Append-only parquet ledgers, and trained models."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from coterie.functions.fixed import LEDGER_CSV_SCHEMA, LEDGER_SCHEMA
from coterie.session import scratch_path


FILE = "ledger_file"
MANIFEST = f"{FILE} string, folder string"


def append(rows: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    rows.write.mode("append").partitionBy(*partition_by).parquet(path)


def append_few(rows: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """``append`` for a handful of rows: one task, one file."""
    append(rows.coalesce(1), path, partition_by)


def compact(spark: SparkSession, path: str, schema: str, target: str, files: int = 1) -> None:
    """Writes the ledger at ``path`` to the new folder ``target`` in few files."""
    read_ledger(spark, path, schema).coalesce(files).write.mode("error").parquet(target)


def compact_in_place(spark: SparkSession, path: str, schema: str, files: int = 1) -> int:
    """Rewrites the ledger in few files; returns the version, from 1.

    Appends may go on meanwhile. A compaction takes the files that are there when it
    begins, writes their rows to a folder of its own, and then, in one step, a version
    that names the folder and the files it stands for. Readers follow the latest version
    and add the files that it does not name, so a row is read once, before, during and
    after. Of two compactions at a time, the one that ends last fails and changes nothing.
    """
    before = latest(spark, path)
    version = (before or 0) + 1
    taken = live_files(spark, path, schema, before)
    folder = f"{path}/_compacted/{version}-{uuid.uuid4().hex}"
    rows = parquet(spark, path, schema).join(taken, FILE, "left_semi").drop(FILE)
    if before is not None:
        rows = rows.unionByName(compacted(spark, path, schema, before))
    rows.coalesce(files).write.mode("error").parquet(folder)
    named = taken if before is None else taken.union(manifest(spark, path, before).select(FILE))
    named = named.filter(f"{FILE} is not null").withColumn("folder", F.lit(folder))
    nothing = spark.createDataFrame([(None, folder)], MANIFEST)  # a version without files has its folder
    staged = f"{path}/_versions/_{uuid.uuid4().hex}"
    named.unionByName(nothing).coalesce(1).write.mode("error").parquet(staged)
    if not rename(spark, staged, f"{path}/_versions/{version}"):
        raise RuntimeError(f"another compaction of {path} ended first")
    return version


def vacuum(spark: SparkSession, path: str) -> None:
    """Deletes what the latest version stands for, and older versions. Readers that began
    before that version must have ended."""
    version = latest(spark, path)
    if version is None:
        return
    jvm, system = hadoop(spark, path)
    rows = manifest(spark, path, version).collect()  # one row for each file since the last call
    kept = rows[0]["folder"].rsplit("/", 1)[-1]
    for row in rows:
        if row[FILE] is not None:
            system.delete(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(row[FILE])), False)
    for parent, name in (("_compacted", kept), ("_versions", str(version))):
        for entry in system.listStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/{parent}")):
            if entry.getPath().getName() != name:
                system.delete(entry.getPath(), True)


def hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    return jvm, jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """In one step, unless ``new`` is there already."""
    jvm, system = hadoop(spark, old)
    target = jvm.org.apache.hadoop.fs.Path(new)
    return not system.exists(target) and system.rename(jvm.org.apache.hadoop.fs.Path(old), target)


def latest(spark: SparkSession, path: str) -> int | None:
    jvm, system = hadoop(spark, path)
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/_versions")
    if not system.exists(folder):
        return None
    names = [entry.getPath().getName() for entry in system.listStatus(folder)]
    return max((int(name) for name in names if name.isdigit()), default=None)


def manifest(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/_versions/{version}")


def compacted(spark: SparkSession, path: str, schema: str, version: int) -> DataFrame:
    folder = manifest(spark, path, version).filter(f"{FILE} is null").first()["folder"]
    return spark.read.schema(schema).parquet(folder)


def parquet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The appended rows, each with the file it lies in."""
    rows = spark.read.schema(schema).parquet(path)
    return rows.withColumn(FILE, F.col("_metadata.file_path"))


def live_files(spark: SparkSession, path: str, schema: str, version: int | None) -> DataFrame:
    """The files beside those that a version names, as they are now: a written table."""
    files = parquet(spark, path, schema).select(FILE).distinct()  # no rows are decoded
    if version is not None:
        files = files.join(manifest(spark, path, version).select(FILE), FILE, "left_anti")
    target = scratch_path(spark, "live-files")
    files.write.parquet(target)
    return spark.read.schema(f"{FILE} string").parquet(target)


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The ledger, or no rows when nothing has been appended yet."""
    try:
        rows = parquet(spark, path, schema)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    version = latest(spark, path)
    if version is None:
        return rows.drop(FILE)
    named = manifest(spark, path, version).filter(f"{FILE} is not null").select(FILE)
    later = rows.join(named, FILE, "left_anti").drop(FILE)
    return later.unionByName(compacted(spark, path, schema, version))


def append_sweep(rows: DataFrame, path: str) -> None:
    """Partitioned by worker count, so reading one count prunes the others."""
    append_few(rows, path, ["Workers"])


def read_sweep(spark: SparkSession, path: str) -> DataFrame:
    return read_ledger(spark, path, LEDGER_SCHEMA)


def read_sweep_csv(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """Ledgers kept as CSV files, one per worker count, as one frame. They have no run
    id, so each point is taken to be swept once."""
    return spark.read.schema(LEDGER_CSV_SCHEMA).csv(list(paths), header=True)


def union_ledgers(ledgers: Sequence[DataFrame]) -> DataFrame:
    """All rows of all ledgers, matched by column name, duplicates kept."""
    return reduce(lambda left, right: left.unionByName(right), ledgers)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
