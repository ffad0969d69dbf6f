"""Files as lines and as entries with a size."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from coterie.session import scratch_path


def read_lines(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """One row per line: ``path, block, position, line``.

    ``block`` is the byte offset of the file split and ``position`` grows with
    the line order inside a split, so (block, position) orders a file's lines
    while every split is still read by its own task. Lines end at ``\\n`` only.
    """
    text = spark.read.option("lineSep", "\n").text(
        paths if isinstance(paths, str) else list(paths)
    )
    return text.select(
        plain_path(spark, decoded(F.col("_metadata.file_path"))).alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("position"),
        F.col("value").alias("line"),
    )


def text_lines(df: DataFrame, path: Column, text: Column) -> DataFrame:
    """The same shape as ``read_lines`` for texts held in a column, one file a row."""
    return df.select(
        path.alias("path"),
        F.lit(0).cast("bigint").alias("block"),
        F.posexplode(F.split(text, "\n", -1)).alias("position", "line"),
    ).withColumn("position", F.col("position").cast("bigint"))


def read_file_sizes(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """One row per file below ``paths``: ``path, filename, size``. Names that begin with
    ``_`` or ``.`` are left out, as Spark does when it reads. A path that does not exist
    gives no row.

    Spark lists the folders, in parallel where there are many, and gives the sizes with the
    scan; contents are not read. A scan leaves out files without bytes: these are the
    listed names that it did not give. The listing is written once, as it is now.
    """
    there = [name for name in ([paths] if isinstance(paths, str) else paths) if exists(spark, name)]
    if not there:
        return spark.createDataFrame([], "path string, filename string, size bigint")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(there)
    sized = files.select(plain_path(spark, F.col("path")).alias("path"), F.col("length").alias("size"))
    listed = listed_names(files).select(plain_path(spark, decoded(F.col("value"))).alias("path"))
    found = listed.distinct().join(sized.groupBy("path").agg(F.max("size").alias("size")), "path", "left")
    found = found.select(
        "path",
        F.regexp_extract("path", "([^/]*)$", 1).alias("filename"),
        F.coalesce("size", F.lit(0)).cast("bigint").alias("size"),
    )
    target = scratch_path(spark, "file-sizes")
    found.write.parquet(target)
    return spark.read.schema(found.schema).parquet(target)


def exists(spark: SparkSession, name: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def listed_names(files: DataFrame) -> DataFrame:
    """The names of a frame's files as ``value``; they do not pass through Python."""
    spark, jvm = files.sparkSession, files.sparkSession.sparkContext._jvm
    names = jvm.org.apache.spark.sql.functions.lit(files._jdf.inputFiles())
    one = DataFrame(spark.range(1)._jdf.withColumn("names", names), spark)
    return one.select(F.explode("names").alias("value"))


def decoded(uri: Column) -> Column:
    """Spark gives paths as URIs; a plus sign stands for itself there."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def plain_path(spark: SparkSession, path: Column) -> Column:
    """One spelling of a path: with the scheme, of the default file system where there
    is none, ``file:/`` for local files, and no percent codes."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    system = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(conf).toString()
    whole = F.when(path.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), path).otherwise(
        F.concat(F.lit(system.rstrip("/")), path)
    )
    return F.regexp_replace(whole, "^file:/*", "file:/")
