"""Request rules, the run and dataset ledgers, and the results listing."""

from __future__ import annotations

from pyspark.sql import functions as F

from coterie.functions import fixed
from coterie.operators.requests import check_requests, known_only
from coterie.operators.runs import (
    RUN_EVENTS_SCHEMA,
    dataset_catalog as fold_datasets,
    listing,
    run_states,
)
from coterie.session import scratch_path
from coterie.sources.ledgers import append, read_ledger
from coterie.streaming.runs import keep_listing, run_event_stream
from coterie.workload.profiling import sql_label_error
from coterie.workload.registry import query, table

SQL_REQUESTS = """
    catalog AS (
      SELECT 'u' || CAST(c_nationkey AS VARCHAR) AS user, c_mktsegment AS label,
             count(*) AS lines, ['c_custkey', 'c_acctbal', 'c_name'] AS headers
      FROM customer GROUP BY ALL
    ),
    requests AS (
      SELECT o_orderkey AS id, 'u' || CAST(o_custkey % 25 AS VARCHAR) AS user,
             CASE o_orderstatus WHEN 'O' THEN 'BUILDING' WHEN 'F' THEN 'MACHINERY'
                  ELSE CASE WHEN o_totalprice > 400000 THEN 'none' ELSE 'FURNITURE' END
             END AS dataset_label,
             CAST(o_custkey % 17 AS VARCHAR) AS clusters,
             CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE 'K-means' END AS algorithm,
             CASE o_orderkey % 5 WHEN 0 THEN '["c_custkey"]' WHEN 1 THEN '["c_custkey","other"]'
                  ELSE '["c_custkey","c_acctbal"]' END AS headers,
             CASE o_orderkey % 11 WHEN 0 THEN '' WHEN 1 THEN 'a b' WHEN 2 THEN 'a_b'
                  WHEN 3 THEN '1run' ELSE 'run' || CAST(o_orderkey // 3 % 400 AS VARCHAR) END
               AS cluster_label,
             CAST(o_orderkey % 29 AS VARCHAR) AS max_iterations,
             CASE WHEN o_orderkey % 13 <> 5 THEN CAST(o_orderkey % 13 AS INTEGER) END AS workers
      FROM orders
    ),
    runs AS (
      SELECT 'u' || CAST(o_custkey % 25 AS VARCHAR) AS user,
             'run' || CAST(o_orderkey // 3 % 400 AS VARCHAR) AS label
      FROM orders WHERE o_totalprice < 3000
    )
"""


def sql_feature_count(column: str) -> str:
    return f"(length({column}) - length(replace({column}, ',', '')) + 1)"


def sql_request_error(taken: str) -> str:
    label = sql_label_error("cluster_label", taken, "REQUEST_LABEL")
    return f"""
      CASE WHEN NOT known THEN '{fixed.REQUEST_DATASET}'
           WHEN clusters = '0' THEN '{fixed.REQUEST_CLUSTERS}'
           WHEN algorithm = '' THEN '{fixed.REQUEST_ALGORITHM}'
           WHEN {sql_feature_count("headers")} < 2 THEN '{fixed.REQUEST_FEATURES}'
           WHEN ({label}) IS NOT NULL THEN {label}
           WHEN max_iterations = '0' THEN '{fixed.REQUEST_MAX_ITERATIONS}'
           WHEN CAST(clusters AS INTEGER) > lines THEN '{fixed.REQUEST_ROWS}'
           WHEN CAST(clusters AS INTEGER) < 2 THEN 'At least 2 clusters are required'
           WHEN CAST(max_iterations AS INTEGER) < 10 THEN 'At least 10 iterations are required'
           WHEN contains(headers, 'other') THEN 'Features must be headers of the dataset'
           WHEN coalesce(workers, 0) <= 0 THEN 'No worker is available' END
    """


@query(
    f"""
    WITH {SQL_REQUESTS},
    joined AS (
      SELECT q.*, c.lines, c.label IS NOT NULL AS known, r.label IS NOT NULL AS run_known
      FROM requests q
      LEFT JOIN catalog c ON q.user = c.user AND q.dataset_label = c.label
      LEFT JOIN (SELECT DISTINCT * FROM runs) r ON q.user = r.user AND q.cluster_label = r.label
    ),
    alone AS (SELECT *, {sql_request_error("run_known")} AS wrong FROM joined),
    batch AS (
      SELECT *, coalesce(min(id) FILTER (WHERE wrong IS NULL)
                OVER (PARTITION BY user, cluster_label) < id, FALSE) AS earlier
      FROM alone
    )
    SELECT id, {sql_request_error("run_known OR earlier")} AS error FROM batch
    """
)
def request_rule(spark, sf):
    return check_requests(
        requests(spark, sf), catalog(spark, sf), known_runs(spark, sf)
    ).select("id", "error")


@query(
    f"""
    WITH {SQL_REQUESTS}
    SELECT id FROM requests q
    WHERE EXISTS (SELECT 1 FROM catalog c WHERE c.user = q.user AND c.label = q.dataset_label)
    """
)
def known_datasets(spark, sf):
    return known_only(
        requests(spark, sf), catalog(spark, sf), {"user": "user", "dataset_label": "label"}
    ).select("id")


def customer_user():
    return F.concat(F.lit("u"), (F.col("o_custkey") % 25).cast("string")).alias("user")


def order_run():
    number = F.floor(F.col("o_orderkey") / 3) % 400
    return F.concat(F.lit("run"), number.cast("string"))


def requests(spark, sf):
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        key.alias("id"),
        customer_user(),
        F.when(status == "O", "BUILDING")
        .when(status == "F", "MACHINERY")
        .when(F.col("o_totalprice") > 400000, "none")
        .otherwise("FURNITURE")
        .alias("dataset_label"),
        (F.col("o_custkey") % 17).cast("string").alias("clusters"),
        F.when(F.col("o_orderpriority") == "5-LOW", "")
        .otherwise(fixed.KMEANS_TITLE)
        .alias("algorithm"),
        F.when(key % 5 == 0, '["c_custkey"]')
        .when(key % 5 == 1, '["c_custkey","other"]')
        .otherwise('["c_custkey","c_acctbal"]')
        .alias("headers"),
        F.when(key % 11 == 0, "")
        .when(key % 11 == 1, "a b")
        .when(key % 11 == 2, "a_b")
        .when(key % 11 == 3, "1run")
        .otherwise(order_run())
        .alias("cluster_label"),
        (key % 29).cast("string").alias("max_iterations"),
        F.when(key % 13 != 5, (key % 13).cast("int")).alias("workers"),
        key.alias("seq"),
    )


def catalog(spark, sf):
    user = F.concat(F.lit("u"), F.col("c_nationkey").cast("string"))
    return (
        table(spark, sf, "customer")
        .groupBy(user.alias("user"), F.col("c_mktsegment").alias("label"))
        .agg(F.count(F.lit(1)).alias("lines"))
        .withColumn("headers", F.array(*map(F.lit, ["c_custkey", "c_acctbal", "c_name"])))
    )


def known_runs(spark, sf):
    cheap = table(spark, sf, "orders").filter(F.col("o_totalprice") < 3000)
    return cheap.select(customer_user(), order_run().alias("label"))


# --- the events table as a run ledger -----------------------------------------

SQL_STATES = """
    ledger AS (
      SELECT 'u' || CAST(user_id AS VARCHAR) AS user,
             'r' || CAST(CAST(props->>'$.k' AS INTEGER) // 10 AS VARCHAR) AS label,
             row_number() OVER (ORDER BY ts, event_id) AS pos,
             CASE event_type WHEN 'signup' THEN 'put' WHEN 'error' THEN 'delete'
                  ELSE 'set' END AS action,
             CASE event_type WHEN 'signup' THEN 'SUBMITTED' WHEN 'click' THEN 'RUNNING'
                  WHEN 'purchase' THEN 'FINISHED'
                  WHEN 'view' THEN CASE WHEN value > 20 THEN 'FAILED' END END AS status,
             CASE WHEN event_type = 'purchase' THEN value END AS time_taken,
             CASE WHEN event_type IN ('purchase', 'view') THEN value / 500 END AS accuracy,
             CASE WHEN event_type = 'signup' THEN props END AS dataset_label
      FROM events
    ),
    resets AS (
      SELECT user, label, max(pos) FILTER (WHERE action IN ('put', 'delete')) AS reset,
             max(pos) FILTER (WHERE action = 'delete') AS deleted,
             max(pos) FILTER (WHERE action <> 'delete') AS written
      FROM ledger GROUP BY user, label
    ),
    states AS (
      SELECT l.user, l.label,
             arg_max(l.status, l.pos) FILTER (WHERE l.status IS NOT NULL) AS status,
             arg_max(l.time_taken, l.pos) FILTER (WHERE l.time_taken IS NOT NULL) AS time_taken,
             arg_max(l.accuracy, l.pos) FILTER (WHERE l.accuracy IS NOT NULL) AS accuracy,
             arg_max(l.dataset_label, l.pos) FILTER (WHERE l.dataset_label IS NOT NULL)
               AS dataset_label
      FROM ledger l JOIN resets r ON l.user = r.user AND l.label = r.label
      WHERE l.pos >= coalesce(r.reset, 0) AND r.written > coalesce(r.deleted, 0)
      GROUP BY l.user, l.label
    )
"""


def run_events(spark, sf):
    kind, value = F.col("event_type"), F.col("value")
    key = F.get_json_object("props", "$.k").cast("int")
    status = (
        F.when(kind == "signup", fixed.SUBMITTED)
        .when(kind == "click", fixed.RUNNING)
        .when(kind == "purchase", fixed.FINISHED)
        .when((kind == "view") & (value > 20), fixed.FAILED)
    )
    given = {
        "user": F.concat(F.lit("u"), F.col("user_id").cast("string")),
        "label": F.concat(F.lit("r"), F.floor(key / 10).cast("string")),
        "at": F.col("ts").cast("timestamp"),
        "seq": F.col("event_id"),
        "action": F.when(kind == "signup", "put").when(kind == "error", "delete").otherwise("set"),
        "status": status,
        "time_taken": F.when(kind == "purchase", value),
        "accuracy": F.when(kind.isin("purchase", "view"), value / 500),
        "dataset_label": F.when(kind == "signup", F.col("props")),
    }
    schema = spark.createDataFrame([], RUN_EVENTS_SCHEMA).schema
    return table(spark, sf, "events").select(
        *[
            given.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name)
            for field in schema.fields
        ]
    )


@query(
    f"WITH {SQL_STATES} SELECT user, label, status, time_taken, accuracy, dataset_label FROM states"
)
def run_state(spark, sf):
    """Latest value of each field, from a ledger written and read back."""
    path = scratch_path(spark, "run-ledger")
    append(run_events(spark, sf), path)
    states = run_states(read_ledger(spark, path, RUN_EVENTS_SCHEMA))
    return states.select("user", "label", "status", "time_taken", "accuracy", "dataset_label")


SQL_LISTING = f"""
    WITH {SQL_STATES}
    SELECT user, label,
           CASE WHEN status IN ('RUNNING', 'SUBMITTED') THEN '{fixed.LISTING_RUNNING}'
                WHEN status = 'FAILED' THEN '{fixed.LISTING_FAILED}'
                WHEN status = 'UNKNOWN' THEN '{fixed.LISTING_UNKNOWN}' END AS message,
           CASE WHEN status = 'FINISHED' THEN printf('%.2f', time_taken) || ' sec' END AS time_text,
           CASE WHEN status = 'FINISHED' THEN printf('%.2f', accuracy * 100) || ' %' END
             AS accuracy_text
    FROM states
"""
LISTED = ["user", "label", "message", "time_text", "accuracy_text"]


@query(SQL_LISTING)
def run_listing(spark, sf):
    return listing(run_states(run_events(spark, sf))).select(*LISTED)


@query(SQL_LISTING)
def run_listing_stream(spark, sf):
    """The listing kept by a stream over the ledger, in two rounds."""
    ledger, kept, state = (
        scratch_path(spark, name) for name in ("stream-ledger", "stream-listing", "stream-state")
    )
    events = run_events(spark, sf)
    for late in (False, True):
        append(events.filter((F.dayofmonth("at") > 15) == late), ledger)
        batch = keep_listing(run_event_stream(spark, ledger), kept, state)
    return spark.read.parquet(f"{kept}/{batch}").select(*LISTED)


@query(
    """
    WITH ledger AS (
      SELECT 'u' || CAST(o_custkey AS VARCHAR) AS user, o_orderpriority AS label,
             row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS pos,
             CASE o_orderstatus WHEN 'O' THEN 'put' WHEN 'F' THEN 'set' ELSE 'delete' END AS action,
             CASE WHEN o_orderstatus = 'O' THEN 'f' || CAST(o_orderkey AS VARCHAR) END AS filename,
             CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice) AS BIGINT) END AS size,
             CASE WHEN o_orderstatus = 'O' THEN o_orderkey END AS lines
      FROM orders
    ),
    resets AS (
      SELECT user, label, max(pos) FILTER (WHERE action IN ('put', 'delete')) AS reset,
             max(pos) FILTER (WHERE action = 'delete') AS deleted,
             max(pos) FILTER (WHERE action <> 'delete') AS written
      FROM ledger GROUP BY user, label
    )
    SELECT l.user, l.label,
           arg_max(l.filename, l.pos) FILTER (WHERE l.filename IS NOT NULL) AS filename,
           arg_max(l.size, l.pos) FILTER (WHERE l.size IS NOT NULL) AS size,
           arg_max(l.lines, l.pos) FILTER (WHERE l.lines IS NOT NULL) AS lines
    FROM ledger l JOIN resets r ON l.user = r.user AND l.label = r.label
    WHERE l.pos >= coalesce(r.reset, 0) AND r.written > coalesce(r.deleted, 0)
    GROUP BY l.user, l.label
    """
)
def dataset_catalog(spark, sf):
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    events = table(spark, sf, "orders").select(
        F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("user"),
        F.col("o_orderpriority").alias("label"),
        F.col("o_orderdate").alias("at"),
        key.alias("seq"),
        F.when(status == "O", "put").when(status == "F", "set").otherwise("delete").alias("action"),
        F.when(status == "O", F.concat(F.lit("f"), key.cast("string"))).alias("filename"),
        F.when(status != "P", F.floor("o_totalprice")).alias("size"),
        F.when(status == "O", key).alias("lines"),
        F.lit(None).cast("array<string>").alias("headers"),
        F.lit(None).cast("timestamp").alias("date"),
    )
    return fold_datasets(events).select("user", "label", "filename", "size", "lines")
