"""Dataset intake: files offered by users, checked and catalogued in bulk."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from coterie.functions.fixed import FILE_MISSING
from coterie.operators.profile import file_error, profile_files
from coterie.operators.requests import check_labels
from coterie.sources.files import plain_path, read_file_sizes, read_lines


def intake(uploads: DataFrame, files: DataFrame, lines: DataFrame, catalog: DataFrame) -> DataFrame:
    """``uploads`` (user, label, path, seq) with the file's metadata and an ``error``,
    null when accepted. The label rules come before the file rules.

    ``seq`` is the order in which the uploads came: of several that are right but for
    sharing user and label, the first is accepted and its label is taken for the others.
    ``files`` names every file there is, also those without bytes.
    """
    profiled = profile_files(files, lines).drop("error").withColumn("there", F.lit(True))
    found = uploads.join(profiled, "path", "left")
    filename = F.coalesce("filename", F.substring_index("path", "/", -1))
    of_file = F.when(F.col("there").isNull(), FILE_MISSING).otherwise(
        file_error(filename, F.col("lines"), F.col("bad_line"))
    )
    checked = check_labels(found.withColumn("file_error", of_file), catalog, later_error="file_error")
    return checked.withColumns({"filename": filename, "size": F.coalesce("size", F.lit(0))}).drop(
        "file_error", "bad_line", "there"
    )


def intake_files(
    spark: SparkSession, uploads: DataFrame, paths: str | Iterable[str], catalog: DataFrame
) -> DataFrame:
    """``intake`` for files below ``paths``, however the uploads spell their paths."""
    spelled = uploads.withColumn("path", plain_path(spark, F.col("path")))
    return intake(spelled, read_file_sizes(spark, paths), read_lines(spark, paths), catalog)


def catalog_events(accepted: DataFrame, seq: int = 0) -> DataFrame:
    """Dataset ledger events for the accepted uploads, in their order from ``seq`` on."""
    now = F.current_timestamp()
    return accepted.filter(F.col("error").isNull()).select(
        "user",
        "label",
        now.alias("at"),
        (F.col("seq") + seq).cast("bigint").alias("seq"),
        F.lit("put").alias("action"),
        "filename",
        "size",
        "lines",
        "headers",
        now.alias("date"),
    )
