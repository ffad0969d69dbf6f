"""CSV datasets in and labelled rows out. Paths are any Hadoop file system URI."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from coterie.operators.columns import quoted
from coterie.operators.numbering import with_row_index


# Values in quotes hold commas, doubled quotes and blanks as they are.
QUOTING = {"quote": '"', "escape": '"'}
# Stands for "" while a file is read, where Spark would make it a null.
EMPTY = "\u0000"


def read_csv(
    spark: SparkSession,
    paths: str | Iterable[str],
    schema: StructType | str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Files with a header row. Texts come as they are written, numbers without the
    blanks around them.

    Give a schema for large inputs: without one Spark reads the data twice, the
    first time to infer types. Names come from the header only when inferring.
    ``multi_line`` allows line breaks in quotes; such a file cannot be split, so each
    is read by one task. A row with more or fewer fields than the header is an error.
    """
    paths = paths if isinstance(paths, str) else list(paths)
    trimmed = {"ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
    reader = spark.read.options(header=True, multiLine=multi_line, mode="FAILFAST", emptyValue=EMPTY, **QUOTING)
    if schema is None:
        schema = reader.options(inferSchema=True, **trimmed).csv(paths).schema
    elif isinstance(schema, str):
        schema = spark.createDataFrame([], schema).schema
    kept = reader.options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    texts = StructType([StructField(f.name, StringType()) for f in schema.fields])
    rows = kept.schema(texts).csv(paths)
    return rows.select(
        *[
            F.when(quoted(f.name) == EMPTY, "").otherwise(quoted(f.name)).alias(f.name)
            if isinstance(f.dataType, StringType)
            else F.trim(quoted(f.name)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def write_csv(df: DataFrame, path: str, multi_line: bool = False) -> None:
    """Part files with a header each, replacing what was there.

    Blanks at the ends of texts stay, an empty text is ``""`` and a null is nothing.
    Texts with line breaks are refused, as a reader that splits files would cut them;
    ``multi_line`` writes them for readers that do not.
    """
    if not multi_line:
        checked = []
        for field in df.schema.fields:
            column = quoted(field.name)
            if isinstance(field.dataType, StringType):
                broken = F.raise_error(F.lit(f"line break in column {field.name}; pass multi_line=True"))
                column = F.when(column.rlike("[\\n\\r]"), broken.cast("string")).otherwise(column)
            checked.append(column.alias(field.name))
        df = df.select(*checked)
    df.write.mode("overwrite").options(
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue='""', **QUOTING
    ).csv(path, header=True)


def printable(df: DataFrame) -> DataFrame:
    """Vector columns become JSON lists, since CSV has no vector type."""
    vectors = {f.name for f in df.schema.fields if isinstance(f.dataType, VectorUDT)}
    return df.select(
        *[
            F.to_json(vector_to_array(quoted(name))).alias(name) if name in vectors else quoted(name)
            for name in df.columns
        ]
    )


def write_labelled(
    labelled: DataFrame, path: str, multi_line: bool = False, row_index: str | None = None
) -> None:
    """Labelled rows without the feature vector, written by all executors.

    ``row_index`` names a first column with the numbers 0 to n - 1, which costs one more
    copy of the rows in the shared folder.
    """
    rows = printable(labelled.drop("features"))
    write_csv(rows if row_index is None else with_row_index(rows, row_index), path, multi_line)
