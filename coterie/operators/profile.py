"""Checks and metadata of delimited files, from their lines.

Input is the frame of ``sources.files.read_lines`` or ``text_lines``: ``path,
block, position, line``. A file's lines are spread over many tasks; per file only
partial aggregates meet, so one very large file is no heavier than many small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from coterie.functions.fixed import FILE_EMPTY, FILE_SHAPE, FILE_TYPE
from coterie.functions.text import field_count, fields, has_csv_extension, strip


def _filled(lines: DataFrame) -> DataFrame:
    """Non-blank lines, numbered within their task: ``path, block, number, text, width``.

    The numbers are given after the blank lines are gone, so between two lines of
    one split they differ by the count of non-blank lines from one to the other.
    """
    stripped = lines.select("path", "block", "position", strip(F.col("line")).alias("text"))
    return stripped.filter(F.col("text") != "").select(
        "path",
        "block",
        F.monotonically_increasing_id().alias("number"),
        "text",
        field_count(F.col("text")).alias("width"),
    )


def _splits(lines: DataFrame) -> DataFrame:
    """One row per split with a non-blank line. Whatever the header turns out to be,
    the first bad line of a split is its first line or the first that differs from it.

    The scan keeps counts and smallest numbers by (file, split, field count), so it
    aggregates by hash before the one small shuffle.
    """
    widths = _filled(lines).groupBy("path", "block", "width").agg(
        F.count(F.lit(1)).alias("filled"), F.min("number").alias("first")
    )
    rank = F.row_number().over(Window.partitionBy("path", "block").orderBy("first"))
    return (
        widths.withColumn("rank", rank)
        .groupBy("path", "block")
        .agg(
            F.sum("filled").alias("filled"),
            F.min("first").alias("first"),
            F.max(F.when(F.col("rank") == 1, F.col("width"))).alias("width"),
            F.max(F.when(F.col("rank") == 2, F.col("first"))).alias("other"),
        )
    )


def _blank_headers(lines: DataFrame) -> DataFrame:
    """``path, blank_header``: whether the first line of all is blank."""
    filled = (strip(F.col("line")) != "").cast("bigint")
    first = (
        lines.filter("block = 0")
        .groupBy("path")
        .agg(F.min(F.col("position") * 2 + filled).alias("first"))
    )
    return first.select("path", (F.col("first") % 2 == 0).alias("blank_header"))


def check_shape(lines: DataFrame) -> DataFrame:
    """Per file ``path, bad_line``: the number of the first line whose field count
    differs from that of the first line, null when there is none.

    Blank lines are skipped and not counted; the first line is the header even
    when blank. Numbers start at 1 for the header. The lines must come as they are
    read, each split in order within one task. Splits are only ever compared with
    others of the same scan; what two scans share is the path.
    """
    return _shapes(lines, _splits(lines)).select("path", "bad_line")


def _shapes(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """``path, lines, bad_line``; no row where every line is blank but one for each path."""
    file = Window.partitionBy("path")
    in_order = file.orderBy("block")
    marked = (
        _blank_headers(lines)
        .join(splits, "path", "left")
        .select(
            "*",
            F.when(F.col("blank_header"), 1)
            .otherwise(F.first("width").over(in_order))
            .alias("header_width"),
            F.coalesce(F.sum("filled").over(in_order) - F.col("filled"), F.lit(0)).alias("before"),
        )
    )
    bad = F.when(F.col("width") != F.col("header_width"), F.col("first")).otherwise(F.col("other"))
    place = F.col("before") + bad - F.col("first") + F.when(F.col("blank_header"), 2).otherwise(1)
    return marked.groupBy("path").agg(
        (F.sum("filled") - 1).alias("lines"), F.min(place).alias("bad_line")
    )


def _headers(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """``path, header``: the first non-blank line.

    It is nearly always in the first split, so only that one is looked through;
    other splits are read for the files whose first split is blank throughout.
    """
    filled = _filled(lines)
    here = filled.filter("block = 0").groupBy("path").agg(F.min_by("text", "number").alias("header"))
    late = splits.groupBy("path").agg(F.min("block").alias("least")).filter("least > 0").select("path")
    there = (
        filled.join(late, "path", "left_semi")
        .groupBy("path")
        .agg(F.min_by("text", F.struct("block", "number")).alias("header"))
    )
    return here.unionByName(there)


def profile(lines: DataFrame) -> DataFrame:
    """Per file ``path, lines, headers, bad_line``; the first two are null for a file of
    blank lines."""
    splits = _splits(lines)
    return (
        _shapes(lines, splits)
        .join(_headers(lines, splits), "path", "left")
        .select("path", "lines", fields(F.col("header")).alias("headers"), "bad_line")
    )


def metadata(lines: DataFrame) -> DataFrame:
    """Per file ``path, lines, headers``: non-blank lines less one, and the fields
    of the first non-blank line. Files of blank lines have no row."""
    return profile(lines).filter(F.col("lines").isNotNull()).drop("bad_line")


def file_error(filename: Column, lines: Column, bad_line: Column) -> Column:
    """The first rule a file breaks, null when it breaks none. ``lines`` is null
    for a file without any non-blank line."""
    return (
        F.when(~has_csv_extension(filename), FILE_TYPE)
        .when(lines.isNull(), FILE_EMPTY)
        .when(bad_line.isNotNull(), F.concat(F.lit(FILE_SHAPE), bad_line.cast("string")))
    )


def profile_files(files: DataFrame, lines: DataFrame) -> DataFrame:
    """``path, filename, size, lines, headers, bad_line, error`` for every file.

    ``files`` has ``path, filename, size``, as ``sources.files.read_file_sizes``
    gives.
    """
    return files.join(profile(lines), "path", "left").select(
        "path",
        "filename",
        "size",
        "lines",
        "headers",
        "bad_line",
        file_error(F.col("filename"), F.col("lines"), F.col("bad_line")).alias("error"),
    )
