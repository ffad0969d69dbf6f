import math
from decimal import ROUND_HALF_EVEN, Decimal

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from coterie.functions import text

LABELS = [
    "abc", "a b", "a_b", "1a", "", "é9", "abc\n", "²x", "x²", "①", "٣a", "日本", "a-b", "ﬁ",
    "Ⅷ", "½", "á", " ", " a",
]
LINES = [
    "a,b", " a,b ", "a,b\r", "", "   ", "\t", " x　", ",", ",,", "a,", "\x1c1,2\x85",
    '"a,b",c', "﻿a,b",
]


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def evaluate(df, expression):
    return [row[0] for row in df.orderBy("i").select(expression).collect()]


def test_label_rules(spark):
    df = column(spark, LABELS)
    v = F.col("v")
    assert evaluate(df, text.is_alphanumeric(v)) == [s.isalnum() for s in LABELS]
    assert evaluate(df, text.starts_with_digit(v)) == [s[:1].isdigit() for s in LABELS]
    assert evaluate(df, text.has_space(v)) == [" " in s for s in LABELS]


def test_strip_and_fields(spark):
    df = column(spark, LINES)
    stripped = text.strip(F.col("v"))
    assert evaluate(df, stripped) == [s.strip() for s in LINES]
    assert evaluate(df, text.fields(stripped)) == [s.strip().split(",") for s in LINES]
    assert evaluate(df, text.field_count(stripped)) == [len(s.strip().split(",")) for s in LINES]


@settings(max_examples=5, deadline=None, derandomize=True, database=None)
@given(st.lists(st.text(max_size=8), min_size=1, max_size=200))
def test_any_text(spark, values):
    values = [v for v in values if v.isprintable() or v.isspace()] or ["a"]
    df = column(spark, values)
    stripped = text.strip(F.col("v"))
    assert evaluate(df, stripped) == [s.strip() for s in values]
    assert evaluate(df, text.field_count(stripped)) == [len(s.strip().split(",")) for s in values]


def test_csv_extension(spark):
    names = ["a.csv", "a.CSV", "csv", "a.csv.txt", "a.txt.csv", ".csv", "a.", ""]
    expected = [True, True, False, False, True, True, False, False]
    assert evaluate(column(spark, names), text.has_csv_extension(F.col("v"))) == expected


def test_two_decimals_rounds_the_binary_value(spark):
    values = [0.125, 1.005, 2.675, 0.375, 1234567.891, -0.125, 0.0, 99.995, 12.5, 3.14159]
    exact = [
        str(Decimal(v).quantize(Decimal("0.01"), ROUND_HALF_EVEN)) for v in values
    ]
    assert exact == ["%.2f" % v for v in values]
    assert evaluate(column(spark, values, "double"), text.two_decimals(F.col("v"))) == exact
    assert math.isclose(float(exact[4]), 1234567.89)


def test_list_and_numbers(spark):
    df = column(spark, ['["a","b c"]', "[]", "it's", '["it\'s"]'])
    assert evaluate(df, text.parse_list(F.col("v"))) == [["a", "b c"], [], None, ["it's"]]
    df = column(spark, ["3", " 4 ", "x", "", "-2"])
    assert evaluate(df, text.to_int(F.col("v"))) == [3, 4, None, None, -2]


def test_timestamp_text(spark):
    df = spark.sql("SELECT 1 AS i, TIMESTAMP '2024-03-09 07:05:01.9' AS v")
    assert evaluate(df, text.timestamp_text(F.col("v"))) == ["09-03-2024 07:05:01"]
