"""File checks and metadata, label rules, intake."""

from __future__ import annotations

from pyspark.sql import functions as F

from coterie.functions import fixed
from coterie.operators.profile import check_shape, metadata, profile_files
from coterie.operators.requests import check_labels
from coterie.operators.runs import dataset_catalog as fold_datasets
from coterie.plans.intake import catalog_events, intake, intake_files
from coterie.session import scratch_path
from coterie.sources.csv import write_csv
from coterie.sources.files import read_file_sizes, read_lines, text_lines
from coterie.workload.registry import query, table
from coterie.workload.relational import SQL_WHITE_SPACE

DOCUMENT_PATH = "'doc' || CAST(doc_id AS VARCHAR)"

# Lines of the documents, with field counts, as common table expressions.
SQL_LINES = f"""
    split_lines AS (
      SELECT {DOCUMENT_PATH} AS path,
             unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS pos
      FROM documents
    ),
    lines AS (
      SELECT path, pos, trim(line, {SQL_WHITE_SPACE}) AS s,
             length(s) - length(replace(s, ',', '')) + 1 AS width, s <> '' AS filled
      FROM split_lines
    ),
    profiles AS (
      SELECT path, count(*) - 1 AS lines, arg_min(s, pos) AS header
      FROM lines WHERE filled GROUP BY path
    ),
    numbered AS (
      SELECT path, pos, filled, width,
             first_value(width) OVER (PARTITION BY path ORDER BY pos) AS header_width,
             1 + sum(CASE WHEN filled AND pos > 1 THEN 1 ELSE 0 END)
                   OVER (PARTITION BY path ORDER BY pos) AS number
      FROM lines
    ),
    shapes AS (
      SELECT path,
             CAST(min(number) FILTER (WHERE filled AND width <> header_width AND pos > 1)
                  AS BIGINT) AS bad_line
      FROM numbered GROUP BY path
    )
"""


def document_path():
    return F.concat(F.lit("doc"), F.col("doc_id").cast("string"))


def document_lines(spark, sf):
    return text_lines(table(spark, sf, "documents"), document_path(), F.col("text"))


@query(f"WITH {SQL_LINES} SELECT path, lines, header FROM profiles")
def file_profile(spark, sf):
    return metadata(document_lines(spark, sf)).select(
        "path", "lines", F.array_join("headers", ",").alias("header")
    )


@query(f"WITH {SQL_LINES} SELECT path, bad_line FROM shapes")
def file_shape_check(spark, sf):
    return check_shape(document_lines(spark, sf))


PLAIN_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]


@query(
    f"""
    SELECT CAST(sum(length(concat_ws(',', {", ".join(PLAIN_COLUMNS)})) + 1) AS BIGINT)
             AS data_bytes,
           count(*) AS data_lines,
           '{",".join(PLAIN_COLUMNS)}' AS header,
           0::BIGINT AS errors
    FROM customer
    """
)
def csv_files_profile(spark, sf):
    path = scratch_path(spark, "customer-plain")
    write_csv(table(spark, sf, "customer").select(*PLAIN_COLUMNS), path)
    files = read_file_sizes(spark, path).filter(F.col("filename").endswith(".csv"))
    profiled = profile_files(files, read_lines(spark, path))
    header = F.array_join("headers", ",")
    return profiled.agg(
        F.sum(F.col("size") - F.octet_length(header) - 1).alias("data_bytes"),
        F.sum("lines").alias("data_lines"),
        F.max(header).alias("header"),
        F.count("error").alias("errors"),
    )


@query(
    f"""
    WITH parts AS (
      SELECT o_orderkey AS k, o_orderkey // 1000 AS part,
             row_number() OVER (PARTITION BY o_orderkey // 1000 ORDER BY o_orderkey) AS n
      FROM orders
    ),
    bad AS (SELECT part, min(n) AS n FROM parts WHERE k % 4096 = 77 GROUP BY part)
    SELECT 'part' || CAST(part AS VARCHAR) AS label, count(*) AS lines,
           CASE WHEN max(bad.n) IS NOT NULL
                THEN '{fixed.FILE_SHAPE}' || CAST(max(bad.n) + 1 AS VARCHAR) END AS error,
           CASE WHEN max(bad.n) IS NULL THEN count(*) END AS lines_in_catalog
    FROM parts LEFT JOIN bad USING (part) GROUP BY part
    """
)
def csv_files_check(spark, sf):
    """Files written with blank and bad lines and cut into splits, taken in by path and
    catalogued: the last column is what the catalog holds of the accepted ones."""
    path = scratch_path(spark, "orders-files")
    key = F.col("o_orderkey")
    orders = table(spark, sf, "orders").select(F.floor(key / 1000).alias("part"), key)
    surplus = F.when(key % 4096 == 77, F.lit("surplus"))
    lines = (
        orders.select("part", F.lit(-1).alias("at"), F.lit("key,name").alias("value"))
        .distinct()
        .unionByName(
            orders.select(
                "part",
                (key * 2).alias("at"),
                F.concat_ws(",", key.cast("string"), F.lit("n"), surplus).alias("value"),
            )
        )
        # a line of blanks follows every third row
        .unionByName(
            orders.filter(key % 3 == 0).select("part", (key * 2 + 1).alias("at"), F.lit("  ").alias("value"))
        )
    )
    as_is = {
        "sep": "\u0001", "quote": "\u0000", "emptyValue": "",
        "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
    }
    lines.repartition(4, "part").sortWithinPartitions("part", "at").select("part", "value").write.options(
        **as_is
    ).partitionBy("part").csv(path)
    number = F.regexp_extract("path", "part=([0-9]+)", 1)
    uploads = read_file_sizes(spark, path).select(
        F.lit("u").alias("user"),
        F.concat(F.lit("part"), number).alias("label"),
        number.cast("bigint").alias("seq"),
        F.regexp_replace("path", "^file:/", "file:///").alias("path"),
    )
    nothing = spark.createDataFrame([], "user string, label string")
    taken_in = intake_files(spark, uploads, path, nothing)
    known = fold_datasets(catalog_events(taken_in)).select(
        "user", "label", F.col("lines").alias("lines_in_catalog")
    )
    return taken_in.join(known, ["user", "label"], "left").select(
        "label", "lines", "error", "lines_in_catalog"
    )


SQL_LABEL_INPUTS = """
    SELECT 'name' AS kind, c_custkey AS id, c_custkey * 10 AS seq, c_nationkey AS user,
           c_name AS label FROM customer
    UNION ALL
    SELECT 'plain', c_custkey, c_custkey * 10 + 1, c_nationkey, replace(c_name, '#', '')
    FROM customer
    UNION ALL
    SELECT 'number', c_custkey, c_custkey * 10 + 2, c_nationkey, CAST(c_custkey AS VARCHAR)
    FROM customer
    UNION ALL
    SELECT 'segment', c_custkey, c_custkey * 10 + 3, c_nationkey,
           CASE WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE c_mktsegment END FROM customer
    UNION ALL
    SELECT 'part', p_partkey, p_partkey * 10 + 4, 0, p_name FROM part
    UNION ALL
    SELECT 'language', doc_id, doc_id * 10 + 5, 0, lang FROM documents
"""


def sql_label_error(label: str, taken: str, prefix: str) -> str:
    """The oracle's label rule, for the messages of one kind of label."""
    message = {
        "LABEL": (
            fixed.LABEL_MISSING, fixed.LABEL_SPACES, fixed.LABEL_CHARACTERS,
            fixed.LABEL_DIGIT, fixed.LABEL_TAKEN,
        ),
        "REQUEST_LABEL": (
            fixed.REQUEST_LABEL_MISSING, fixed.REQUEST_LABEL_SPACES,
            fixed.REQUEST_LABEL_CHARACTERS, fixed.REQUEST_LABEL_DIGIT,
            fixed.REQUEST_LABEL_TAKEN,
        ),
    }[prefix]
    return f"""
      CASE WHEN coalesce({label}, '') = '' THEN '{message[0]}'
           WHEN contains({label}, ' ') THEN '{message[1]}'
           WHEN NOT regexp_full_match({label}, '[\\p{{L}}\\p{{N}}]+') THEN '{message[2]}'
           WHEN regexp_matches({label}, '^\\p{{Nd}}') THEN '{message[3]}'
           WHEN {taken} THEN '{message[4]}' END
    """


@query(
    f"""
    WITH inputs AS ({SQL_LABEL_INPUTS}),
    known AS (
      SELECT DISTINCT c_nationkey AS user, replace(c_name, '#', '') AS label
      FROM customer WHERE c_acctbal < 2000
    ),
    alone AS (
      SELECT i.*, k.label IS NOT NULL AS taken,
             {sql_label_error("i.label", "k.label IS NOT NULL", "LABEL")} AS wrong
      FROM inputs i LEFT JOIN known k ON i.user = k.user AND i.label = k.label
    ),
    batch AS (
      SELECT *, coalesce(min(seq) FILTER (WHERE wrong IS NULL)
                OVER (PARTITION BY user, label) < seq, FALSE) AS earlier
      FROM alone
    )
    SELECT kind, id, user, label, {sql_label_error("label", "taken OR earlier", "LABEL")} AS error
    FROM batch
    """
)
def label_rule(spark, sf):
    customer = table(spark, sf, "customer")
    key = F.col("c_custkey")
    nation = F.col("c_nationkey")
    plain = F.replace("c_name", F.lit("#"), F.lit(""))

    def labels(frame, number, kind, id, user, label):
        return frame.select(
            F.lit(kind).alias("kind"),
            id.alias("id"),
            (id * 10 + number).alias("seq"),
            user.alias("user"),
            label.alias("label"),
        )

    def of_customers(number, kind, label):
        return labels(customer, number, kind, key, nation, label)

    segment = F.when(F.col("c_mktsegment") == "MACHINERY", "").otherwise(F.col("c_mktsegment"))
    part, documents = table(spark, sf, "part"), table(spark, sf, "documents")
    parts = labels(part, 4, "part", F.col("p_partkey"), F.lit(0), F.col("p_name"))
    languages = labels(documents, 5, "language", F.col("doc_id"), F.lit(0), F.col("lang"))
    inputs = (
        of_customers(0, "name", F.col("c_name"))
        .unionByName(of_customers(1, "plain", plain))
        .unionByName(of_customers(2, "number", key.cast("string")))
        .unionByName(of_customers(3, "segment", segment))
        .unionByName(parts)
        .unionByName(languages)
    )
    known = customer.filter(F.col("c_acctbal") < 2000).select(nation.alias("user"), plain.alias("label"))
    return check_labels(inputs, known).select("kind", "id", "user", "label", "error")


@query(
    f"""
    WITH {SQL_LINES},
    uploads AS (
      SELECT {DOCUMENT_PATH} AS path, source AS user,
             'set' || CAST(doc_id // 60 AS VARCHAR) || CASE WHEN lang = 'fr' THEN '_' ELSE '' END
               AS label, doc_id AS seq,
             {DOCUMENT_PATH} || CASE WHEN lang = 'de' THEN '.txt' ELSE '.CSV' END AS filename,
             strlen(text) AS size
      FROM documents
    ),
    known AS (
      SELECT DISTINCT d.source AS user, 'set' || CAST(d.doc_id // 60 AS VARCHAR) AS label
      FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 0 AND l.toxic = 1
    ),
    joined AS (
      SELECT u.*, p.lines, k.label IS NOT NULL AS taken,
             CASE WHEN NOT u.filename ILIKE '%.csv' THEN '{fixed.FILE_TYPE}'
                  WHEN p.lines IS NULL THEN '{fixed.FILE_EMPTY}'
                  WHEN s.bad_line IS NOT NULL
                  THEN '{fixed.FILE_SHAPE}' || CAST(s.bad_line AS VARCHAR) END AS file_error
      FROM uploads u
      LEFT JOIN known k ON u.user = k.user AND u.label = k.label
      LEFT JOIN profiles p ON u.path = p.path
      LEFT JOIN shapes s ON u.path = s.path
    ),
    alone AS (
      SELECT *, coalesce({sql_label_error("label", "taken", "LABEL")}, file_error) AS wrong FROM joined
    ),
    batch AS (
      SELECT *, coalesce(min(seq) FILTER (WHERE wrong IS NULL)
                OVER (PARTITION BY user, label) < seq, FALSE) AS earlier
      FROM alone
    )
    SELECT path, user, label, filename, size, lines,
           coalesce({sql_label_error("label", "taken OR earlier", "LABEL")}, file_error) AS error
    FROM batch
    """
)
def dataset_intake(spark, sf):
    documents = table(spark, sf, "documents")
    lang = F.col("lang")
    suffix = F.when(lang == "fr", "_").otherwise("")
    label = F.concat(F.lit("set"), F.floor(F.col("doc_id") / 60).cast("string"))
    uploads = documents.select(
        document_path().alias("path"),
        F.col("source").alias("user"),
        F.concat(label, suffix).alias("label"),
        F.col("doc_id").alias("seq"),
    )
    files = documents.select(
        document_path().alias("path"),
        F.concat(document_path(), F.when(lang == "de", ".txt").otherwise(".CSV")).alias(
            "filename"
        ),
        F.octet_length("text").cast("bigint").alias("size"),
    )
    poor = table(spark, sf, "labels").filter("quality = 0 and toxic = 1").select("doc_id")
    known = documents.join(poor, "doc_id", "left_semi").select(
        F.col("source").alias("user"), label.alias("label")
    )
    checked = intake(uploads, files, document_lines(spark, sf), known)
    return checked.select("path", "user", "label", "filename", "size", "lines", "error")
