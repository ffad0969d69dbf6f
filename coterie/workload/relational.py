"""Scans, projections, filters, unions, bounds, scaling, scalar functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from coterie.functions import text
from coterie.functions.text import WHITE_SPACE
from coterie.operators.columns import preview, select_all_but, select_named
from coterie.operators.features import bounds as column_bounds
from coterie.operators.features import min_max_scale, table_size
from coterie.operators.metrics import class_accuracy as accuracy_of
from coterie.session import scratch_path
from coterie.sources.csv import read_csv, write_csv
from coterie.sources.ledgers import union_ledgers as union_all
from coterie.workload.registry import query, table

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

# White space characters as an SQL expression.
SQL_WHITE_SPACE = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)


@query("SELECT c_name, c_acctbal FROM customer WHERE c_acctbal > 5000")
def filter_select(spark, sf):
    rich = table(spark, sf, "customer").filter(F.col("c_acctbal") > 5000)
    return select_named(rich, ["c_name", "c_acctbal"])


@query("SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
def drop_column(spark, sf):
    return select_all_but(table(spark, sf, "supplier"), "s_name")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, sf):
    path = scratch_path(spark, "customer-csv")
    write_csv(table(spark, sf, "customer"), path)
    return read_csv(spark, path).select(
        F.col("c_custkey").cast("bigint"),
        "c_name",
        F.col("c_nationkey").cast("int"),
        F.col("c_acctbal").cast("double"),
        "c_mktsegment",
    )


@query(
    """
    SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, text, lang AS kind FROM documents
    UNION ALL
    SELECT 'c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR),
           ' "' || text || '" ', role
    FROM conversations
    """
)
def csv_text_round_trip(spark, sf):
    """Texts with line breaks, quotes and blanks at the ends come back as they were."""
    path = scratch_path(spark, "texts-csv")
    documents = table(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text", F.col("lang").alias("kind")
    )
    turns = table(spark, sf, "conversations").select(
        F.concat_ws("-", F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.col("turn").cast("string")).alias("id"),
        F.concat(F.lit(' "'), "text", F.lit('" ')).alias("text"),
        F.col("role").alias("kind"),
    )
    write_csv(documents.unionByName(turns), path, multi_line=True)
    return read_csv(spark, path, "id string, text string, kind string", multi_line=True)


@query("SELECT c_name, c_nationkey FROM customer WHERE c_nationkey > 12")
def csv_filter_job(spark, sf):
    """CSV in, rows and columns chosen, CSV out."""
    source, target = scratch_path(spark, "people"), scratch_path(spark, "chosen")
    write_csv(table(spark, sf, "customer"), source)
    chosen = read_csv(spark, source).filter(F.col("c_nationkey") > 12)
    write_csv(select_named(chosen, ["c_name", "c_nationkey"]), target)
    return read_csv(spark, target, "c_name string, c_nationkey int")


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge,
           round(-ln(l_quantity), 9) AS negative_log,
           l_extendedprice / l_quantity AS unit_price,
           l_tax > l_discount AS taxed_more,
           l_tax < l_discount AS taxed_less
    FROM lineitem
    """
)
def computed_columns(spark, sf):
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    discount, tax = F.col("l_discount"), F.col("l_tax")
    return table(spark, sf, "lineitem").select(
        *LINE_KEYS,
        (price * (1 - discount) * (1 + tax)).alias("charge"),
        F.round(-F.log(quantity), 9).alias("negative_log"),
        (price / quantity).alias("unit_price"),
        (tax > discount).alias("taxed_more"),
        (tax < discount).alias("taxed_less"),
    )


@query(
    """
    SELECT o_orderstatus, count(*) AS order_count, round(sum(o_totalprice), 2) AS total
    FROM orders GROUP BY o_orderstatus
    """
)
def union_ledgers(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderstatus", "o_totalprice")
    parts = [orders.filter(F.col("o_orderstatus") == status) for status in ("O", "F", "P")]
    return (
        union_all(parts)
        .groupBy("o_orderstatus")
        .agg(
            F.count(F.lit(1)).alias("order_count"),
            F.round(F.sum("o_totalprice"), 2).alias("total"),
        )
    )


@query(
    """
    SELECT least(count(*), 20) AS shown, least(count(*), 20) AS known,
           6 AS column_count
    FROM part
    """
)
def preview_rows(spark, sf):
    part = table(spark, sf, "part")
    shown = preview(part, 20)
    known = part.select(F.col("p_partkey").alias("known_key"))
    return shown.join(known, F.col("p_partkey") == F.col("known_key"), "left").agg(
        F.count(F.lit(1)).alias("shown"),
        F.count("known_key").alias("known"),
        F.lit(len(part.columns)).alias("column_count"),
    )


@query(
    """
    SELECT p_partkey,
           array_to_string(string_split(p_name, ' '), ',') AS words,
           len(string_split(p_name, ' ')) AS word_count,
           replace(p_name, ' ', '_') AS joined_name,
           lower(p_brand) AS brand,
           string_split(p_brand, '#')[-1] AS brand_number,
           contains(p_name, ' ') AS spaced,
           regexp_full_match(p_type, '[\\p{L}\\p{N}]+') AS plain_type,
           regexp_matches(CAST(p_size AS VARCHAR) || p_name, '^\\p{Nd}') AS digit_first
    FROM part
    """
)
def string_functions(spark, sf):
    name = F.col("p_name")
    words = F.split(name, " ", -1)
    return table(spark, sf, "part").select(
        "p_partkey",
        text.join_list(words).alias("words"),
        F.size(words).cast("bigint").alias("word_count"),
        F.replace(name, F.lit(" "), F.lit("_")).alias("joined_name"),
        F.lower("p_brand").alias("brand"),
        F.substring_index("p_brand", "#", -1).alias("brand_number"),
        text.has_space(name).alias("spaced"),
        text.is_alphanumeric(F.col("p_type")).alias("plain_type"),
        text.starts_with_digit(F.concat(F.col("p_size").cast("string"), name)).alias(
            "digit_first"
        ),
    )


@query(
    f"""
    SELECT doc_id,
           length(trim(text, {SQL_WHITE_SPACE})) AS stripped_length,
           len(string_split(text, chr(10))) AS line_count,
           len(string_split(trim(text, {SQL_WHITE_SPACE}), ',')) AS field_count,
           contains(text, ' ') AS spaced,
           regexp_full_match(text, '[\\p{{L}}\\p{{N}}]+') AS plain,
           regexp_matches(text, '^\\p{{Nd}}') AS digit_first
    FROM documents
    """
)
def text_rules(spark, sf):
    whole = F.col("text")
    stripped = text.strip(whole)
    return table(spark, sf, "documents").select(
        "doc_id",
        F.length(stripped).cast("bigint").alias("stripped_length"),
        F.size(F.split(whole, "\n", -1)).cast("bigint").alias("line_count"),
        text.field_count(stripped).cast("bigint").alias("field_count"),
        text.has_space(whole).alias("spaced"),
        text.is_alphanumeric(whole).alias("plain"),
        text.starts_with_digit(whole).alias("digit_first"),
    )


@query(
    """
    SELECT conv_id, turn, 2 AS item_count, role || ',' || text AS joined
    FROM conversations
    """
)
def json_list(spark, sf):
    listed = F.to_json(F.array("role", "text"))
    return (
        table(spark, sf, "conversations")
        .select("conv_id", "turn", text.parse_list(listed).alias("items"))
        .select(
            "conv_id",
            "turn",
            F.size("items").alias("item_count"),
            text.join_list(F.col("items")).alias("joined"),
        )
    )


@query("SELECT event_id, strftime(ts, '%d-%m-%Y %H:%M:%S') AS at_text FROM events")
def timestamp_text(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", text.timestamp_text(F.col("ts")).alias("at_text")
    )


@query(
    """
    SELECT c_custkey, printf('%.2f', c_acctbal / 8) AS amount_text,
           printf('%.2f', c_acctbal / 10000 * 100) || ' %' AS share_text
    FROM customer
    """
)
def number_text(spark, sf):
    balance = F.col("c_acctbal")
    return table(spark, sf, "customer").select(
        "c_custkey",
        text.two_decimals(balance / 8).alias("amount_text"),
        text.percent_text(balance / 10000).alias("share_text"),
    )


@query(
    """
    SELECT c_custkey,
           TRY_CAST(string_split(c_name, '#')[-1] AS INTEGER) AS number,
           TRY_CAST(c_mktsegment AS INTEGER) AS not_a_number,
           CAST(CAST(c_custkey AS VARCHAR) AS BIGINT) AS key_again
    FROM customer
    """
)
def casts(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey",
        text.to_int(F.substring_index("c_name", "#", -1)).alias("number"),
        text.to_int(F.col("c_mktsegment")).alias("not_a_number"),
        F.col("c_custkey").cast("string").cast("bigint").alias("key_again"),
    )


@query(
    "SELECT "
    + ", ".join(
        f"{f}({name} + 0.0::DOUBLE) AS {name}_{f}" for name in MEASURES for f in ("min", "max")
    )
    + " FROM lineitem"
)
def bounds(spark, sf):
    return column_bounds(table(spark, sf, "lineitem"), MEASURES)


@query(
    "SELECT "
    + ", ".join(f"l.{name}" for name in LINE_KEYS)
    + ", "
    + ", ".join(f"(l.{m} - b.{m}_min) / (b.{m}_max - b.{m}_min) AS {m}" for m in MEASURES)
    + " FROM lineitem l, (SELECT "
    + ", ".join(f"{f}({m} + 0.0) AS {m}_{f}" for m in MEASURES for f in ("min", "max"))
    + " FROM lineitem) b"
)
def minmax_scale(spark, sf):
    lines = select_named(table(spark, sf, "lineitem"), LINE_KEYS + MEASURES)
    return min_max_scale(lines, MEASURES)


# Columns per table, for the oracle only.
WIDTHS = dict(zip(TABLES, [2, 3, 5, 4, 6, 6, 11, 6, 5, 3, 3, 2, 3, 4]))


@query(
    " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS row_count, "
        f"CAST(count(*) * {width} * 8 AS BIGINT) AS byte_size FROM {name}"
        for name, width in WIDTHS.items()
    )
)
def size_estimate(spark, sf):
    sizes = [
        table_size(table(spark, sf, name)).select(
            F.lit(name).alias("table_name"), "row_count", "byte_size"
        )
        for name in TABLES
    ]
    return reduce(lambda left, right: left.unionByName(right), sizes)


@query(
    """
    SELECT avg(CAST(quality = toxic AS INTEGER)) AS agreement,
           avg(CAST(quality = 1 AS INTEGER)) AS always_one
    FROM labels
    """
)
def class_accuracy(spark, sf):
    labels = table(spark, sf, "labels").withColumn("one", F.lit(1))
    return accuracy_of(labels, {"agreement": ("quality", "toxic"), "always_one": ("quality", "one")})
