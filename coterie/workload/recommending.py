"""Labels, the forests, and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from coterie.functions import fixed
from coterie.functions.fixed import LEDGER_KEYS
from coterie.operators import recommend
from coterie.operators.columns import select_named
from coterie.plans.recommender import Recommender, train_recommender
from coterie.session import scratch_path
from coterie.sources.csv import write_csv
from coterie.sources.ledgers import append_sweep, compact_in_place, read_sweep, read_sweep_csv, vacuum
from coterie.workload.registry import query, table

LEDGER_COLUMNS = [*LEDGER_KEYS, "ExecutionSpeed", "Accuracy", "Algorithm"]
KINDS = ["click", "view", "purchase"]


def sql_best(values: list[str], names: list[str]) -> str:
    a, b, c = values
    return f"""
      CASE WHEN NOT isnan({a}) AND NOT isnan({b}) AND NOT isnan({c}) AND {a} < {b} AND {a} < {c}
           THEN '{names[0]}'
           WHEN NOT isnan({a}) AND NOT isnan({b}) AND NOT isnan({c}) AND {b} < {a} AND {b} < {c}
           THEN '{names[1]}'
           ELSE '{names[2]}' END
    """


@query(
    f"""
    WITH totals AS (
      SELECT user_id,
             sum(value) FILTER (WHERE event_type = 'click') AS v0,
             sum(value) FILTER (WHERE event_type = 'view') AS v1,
             sum(value) FILTER (WHERE event_type = 'purchase') AS v2,
             count(*) FILTER (WHERE event_type = 'click') AS n0,
             count(*) FILTER (WHERE event_type = 'view') AS n1,
             count(*) FILTER (WHERE event_type = 'purchase') AS n2
      FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY user_id
    )
    SELECT user_id, {sql_best(["v0", "v1", "v2"], KINDS)} AS best_by_value,
           {sql_best(["n0::DOUBLE", "n1::DOUBLE", "n2::DOUBLE"], KINDS)} AS best_by_count
    FROM totals WHERE n0 > 0 AND n1 > 0 AND n2 > 0
    """
)
def best_of_three(spark, sf):
    """The event type with the smallest total and with the fewest events, for users that
    have all three."""
    sums = (
        table(spark, sf, "events")
        .filter(F.col("event_type").isin(KINDS))
        .groupBy("user_id", "event_type")
        .agg(F.sum("value").alias("value"), F.count(F.lit(1)).cast("double").alias("events"))
    )
    return recommend.best_by(
        sums,
        ["user_id"],
        "event_type",
        KINDS,
        {"best_by_value": "value", "best_by_count": "events"},
    )


# --- a sweep ledger aggregated from lineitem ----------------------------------
# Six keys from the row, the algorithm from the return flag, the figures from
# quantity and price.

SQL_LEDGER = f"""
    keyed AS (
      SELECT CAST([10, 25, 50][l_linenumber % 3 + 1] AS INTEGER) AS maxIteration,
             CAST(l_partkey % 4 + 2 AS INTEGER) AS Clusters,
             CAST(l_suppkey % 5 + 1 AS INTEGER) AS Workers,
             CASE WHEN l_quantity > 25 THEN 1000 ELSE 100 END AS RecordCount,
             CAST(l_orderkey % 7 + 2 AS INTEGER) AS FeaturesCount,
             CASE l_returnflag WHEN 'A' THEN '{fixed.KMEANS}' WHEN 'N' THEN '{fixed.BISECTING}'
                  ELSE '{fixed.MIXTURE}' END AS Algorithm,
             l_quantity, l_extendedprice
      FROM lineitem
    ),
    ledger AS (
      SELECT maxIteration, Clusters, Workers,
             CAST(RecordCount * (FeaturesCount + 1) * 8 AS BIGINT) AS ByteSize,
             CAST(RecordCount AS BIGINT) AS RecordCount, FeaturesCount, Algorithm,
             avg(l_quantity) AS ExecutionSpeed, avg(l_extendedprice) AS Accuracy
      FROM keyed GROUP BY ALL
    )
"""

SQL_TRAINING = f"""
    figures AS (
      SELECT {", ".join(LEDGER_KEYS)},
             max(ExecutionSpeed) FILTER (WHERE Algorithm = '{fixed.KMEANS}') AS s0,
             max(ExecutionSpeed) FILTER (WHERE Algorithm = '{fixed.BISECTING}') AS s1,
             max(ExecutionSpeed) FILTER (WHERE Algorithm = '{fixed.MIXTURE}') AS s2,
             max(Accuracy) FILTER (WHERE Algorithm = '{fixed.KMEANS}') AS a0,
             max(Accuracy) FILTER (WHERE Algorithm = '{fixed.BISECTING}') AS a1,
             max(Accuracy) FILTER (WHERE Algorithm = '{fixed.MIXTURE}') AS a2
      FROM ledger GROUP BY ALL
      HAVING count(*) = 3 AND count(DISTINCT Algorithm) = 3
    ),
    training AS (
      SELECT {", ".join(LEDGER_KEYS)},
             {sql_best(["s0", "s1", "s2"], recommend.NAMES)} AS BestBySpeed,
             {sql_best(["a0", "a1", "a2"], recommend.NAMES)} AS BestByAccuracy
      FROM figures
    )
"""


def keyed_lines(spark, sf):
    iterations = F.array(*[F.lit(i) for i in fixed.GRID_MAX_ITERATIONS])
    features = (F.col("l_orderkey") % 7 + 2).cast("int")
    records = F.when(F.col("l_quantity") > 25, 1000).otherwise(100).cast("bigint")
    flag = F.col("l_returnflag")
    return table(spark, sf, "lineitem").select(
        F.element_at(iterations, F.col("l_linenumber") % 3 + 1).alias("maxIteration"),
        (F.col("l_partkey") % 4 + 2).cast("int").alias("Clusters"),
        (F.col("l_suppkey") % 5 + 1).cast("int").alias("Workers"),
        (records * (features + 1) * fixed.BYTES_PER_VALUE).alias("ByteSize"),
        records.alias("RecordCount"),
        features.alias("FeaturesCount"),
        F.when(flag == "A", fixed.KMEANS)
        .when(flag == "N", fixed.BISECTING)
        .otherwise(fixed.MIXTURE)
        .alias("Algorithm"),
        "l_quantity",
        "l_extendedprice",
    )


def line_ledger(spark, sf):
    return (
        keyed_lines(spark, sf)
        .groupBy(*LEDGER_KEYS, "Algorithm")
        .agg(
            F.avg("l_quantity").alias("ExecutionSpeed"),
            F.avg("l_extendedprice").alias("Accuracy"),
        )
    )


@query(
    f"WITH {SQL_LEDGER}, {SQL_TRAINING} "
    f"SELECT {', '.join(LEDGER_KEYS)}, BestBySpeed, BestByAccuracy FROM training"
)
def training_labels(spark, sf):
    return recommend.training_set(line_ledger(spark, sf))


@query(
    f"WITH {SQL_LEDGER}, {SQL_TRAINING} "
    f"SELECT {', '.join(LEDGER_KEYS)}, BestBySpeed, BestByAccuracy FROM training"
)
def training_labels_csv(spark, sf):
    """The same from ledgers kept as CSV files, one per worker count."""
    kept = scratch_path(spark, "line-ledger")
    append_sweep(line_ledger(spark, sf), kept)
    ledger = read_sweep(spark, kept)
    paths = []
    for workers in range(1, 6):
        paths.append(scratch_path(spark, f"ledger-csv-{workers}"))
        one = select_named(ledger.filter(F.col("Workers") == workers), LEDGER_COLUMNS)
        write_csv(one, paths[-1])
    return recommend.training_set(read_sweep_csv(spark, paths))


@query(
    f"""
    WITH keyed AS (
      SELECT CAST(l_suppkey % 5 + 1 AS INTEGER) AS Workers, CAST(l_orderkey % 7 + 2 AS INTEGER) AS FeaturesCount,
             l_linestatus AS run_id, l_orderkey % 3 AS kind, l_quantity, l_extendedprice
      FROM lineitem WHERE NOT (l_suppkey % 5 = 2 AND l_orderkey % 3 = 1 AND l_linestatus = 'O')
    ),
    one AS (
      SELECT Workers, FeaturesCount, run_id, kind, avg(l_quantity) AS speed, avg(l_extendedprice) AS cost
      FROM keyed GROUP BY ALL
      -- a row written twice
      UNION ALL SELECT 1, 2, 'F', 0, 9.0, 9.0
    ),
    points AS (
      SELECT Workers, FeaturesCount, run_id,
             count(*) = 3 AND count(DISTINCT kind) = 3 AS complete,
             max(speed) FILTER (WHERE kind = 0) AS s0, max(speed) FILTER (WHERE kind = 1) AS s1,
             max(speed) FILTER (WHERE kind = 2) AS s2, max(cost) FILTER (WHERE kind = 0) AS a0,
             max(cost) FILTER (WHERE kind = 1) AS a1, max(cost) FILTER (WHERE kind = 2) AS a2
      FROM one GROUP BY ALL
    )
    SELECT Workers, FeaturesCount, run_id,
           CASE WHEN complete THEN {sql_best(["s0", "s1", "s2"], recommend.NAMES)} END AS BestBySpeed,
           CASE WHEN complete THEN {sql_best(["a0", "a1", "a2"], recommend.NAMES)} END AS BestByAccuracy
    FROM points
    """
)
def training_labels_runs(spark, sf):
    """A ledger with several runs, points that lack a row and one with a row too many:
    labels for the complete points, nulls for those that are left out."""
    kind = F.col("l_orderkey") % 3
    lacking = (F.col("l_suppkey") % 5 == 2) & (kind == 1) & (F.col("l_linestatus") == "O")
    keyed = table(spark, sf, "lineitem").filter(~lacking).select(
        (F.col("l_suppkey") % 5 + 1).cast("int").alias("Workers"),
        (F.col("l_orderkey") % 7 + 2).cast("int").alias("FeaturesCount"),
        F.col("l_linestatus").alias("run_id"),
        F.element_at(F.array(*map(F.lit, recommend.NAMES)), (kind + 1).cast("int")).alias("Algorithm"),
        "l_quantity",
        "l_extendedprice",
    )
    rows = keyed.groupBy("Workers", "FeaturesCount", "run_id", "Algorithm").agg(
        F.avg("l_quantity").alias("ExecutionSpeed"), F.avg("l_extendedprice").alias("Accuracy")
    )
    twice = spark.createDataFrame([(1, 2, "F", fixed.KMEANS, 9.0, 9.0)], rows.schema)
    path = scratch_path(spark, "runs-ledger")
    append_sweep(
        rows.unionByName(twice).withColumns(
            {
                "maxIteration": F.lit(10),
                "Clusters": F.lit(2),
                "ByteSize": F.lit(80).cast("bigint"),
                "RecordCount": F.lit(10).cast("bigint"),
            }
        ),
        path,
    )
    ledger = read_sweep(spark, path)
    labels = recommend.training_set(ledger)
    left_out = recommend.incomplete(ledger)
    shown = ["Workers", "FeaturesCount", "run_id", "BestBySpeed", "BestByAccuracy"]
    return labels.unionByName(left_out, allowMissingColumns=True).select(*shown)


@query(
    f"""
    WITH {SQL_LEDGER}
    SELECT Workers, Algorithm, count(*) AS row_count, CAST(sum(RecordCount) AS BIGINT) AS records,
           round(sum(ExecutionSpeed), 6) AS speeds, 2 AS version
    FROM ledger GROUP BY Workers, Algorithm
    """
)
def compacted_ledger(spark, sf):
    """A ledger that is appended to between two compactions, and cleaned after them."""
    path = scratch_path(spark, "compacted-ledger")
    ledger = line_ledger(spark, sf)
    for workers in range(1, 6):
        append_sweep(ledger.filter(F.col("Workers") == workers), path)
        if workers % 2 == 0:
            version = compact_in_place(spark, path, fixed.LEDGER_SCHEMA)
    vacuum(spark, path)
    return (
        read_sweep(spark, path)
        .groupBy("Workers", "Algorithm")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.sum("RecordCount").alias("records"),
            F.round(F.sum("ExecutionSpeed"), 6).alias("speeds"),
            F.lit(version).alias("version"),
        )
    )


SQL_SHARE = (
    "CAST('0x' || substr(md5('42|' || concat_ws('|', "
    + ", ".join(LEDGER_KEYS)
    + ")), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"
)


@query(
    f"""
    WITH {SQL_LEDGER}, {SQL_TRAINING}
    SELECT CASE WHEN {SQL_SHARE} < 0.2 THEN 'test' ELSE 'train' END AS side,
           {", ".join(LEDGER_KEYS)}, BestBySpeed, BestByAccuracy
    FROM training
    """
)
def train_test_split(spark, sf):
    training, test = recommend.split(recommend.training_set(line_ledger(spark, sf)))
    return training.withColumn("side", F.lit("train")).unionByName(
        test.withColumn("side", F.lit("test"))
    )


SQL_HASH = (
    "CAST('0x' || substr(md5('42|' || concat_ws('|', " + ", ".join(LEDGER_KEYS) + ")), 1, 15) AS BIGINT)"
)


@query(
    f"""
    WITH {SQL_LEDGER}, {SQL_TRAINING},
    ranked AS (
      SELECT *, row_number() OVER (ORDER BY {SQL_HASH}, {", ".join(LEDGER_KEYS)}, BestBySpeed, BestByAccuracy) AS place,
             count(*) OVER () AS n
      FROM training
    )
    SELECT CASE WHEN place <= ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS side,
           {", ".join(LEDGER_KEYS)}, BestBySpeed, BestByAccuracy
    FROM ranked
    """
)
def exact_split(spark, sf):
    """A fifth of the rows, to the row, held out."""
    path = scratch_path(spark, "exact-split")
    recommend.training_set(line_ledger(spark, sf)).write.parquet(path)
    training, test = recommend.split_exact(spark.read.parquet(path))
    return training.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


# --- a ledger with a plain rule behind it, which forests can learn ------------

SQL_SPEED_RULE = "CASE WHEN {c} <= 2 THEN 0 WHEN {c} <= 3 THEN 1 ELSE 2 END"
SQL_ACCURACY_RULE = "CASE WHEN {f} <= 4 THEN 2 WHEN {f} <= 6 THEN 0 ELSE 1 END"


def speed_rule():
    clusters = F.col("Clusters")
    return F.when(clusters <= 2, 0).when(clusters <= 3, 1).otherwise(2)


def accuracy_rule():
    features = F.col("FeaturesCount")
    return F.when(features <= 4, 2).when(features <= 6, 0).otherwise(1)


def ruled_ledger(spark, sf):
    """The figures of ``line_ledger`` for every algorithm, with a large penalty on
    all but the one the rule names."""
    figures = (
        keyed_lines(spark, sf)
        .groupBy(*LEDGER_KEYS)
        .agg(F.avg("l_quantity").alias("quantity"), F.avg("l_extendedprice").alias("price"))
    )
    names = F.array(*[F.lit(name) for name in recommend.NAMES])
    each = figures.select("*", F.posexplode(names).alias("number", "Algorithm"))
    number = F.col("number")
    return each.select(
        *LEDGER_KEYS,
        "Algorithm",
        (F.col("quantity") + F.when(number == speed_rule(), 0).otherwise(1e3)).alias(
            "ExecutionSpeed"
        ),
        (F.col("price") + F.when(number == accuracy_rule(), 0).otherwise(1e9)).alias("Accuracy"),
    )


FOREST = {"trees": 20, "max_depth": 12}


@query("SELECT 1.0::DOUBLE AS speed, 1.0::DOUBLE AS accuracy, TRUE AS tested")
def forest_accuracy(spark, sf):
    models, test = train_recommender(ruled_ledger(spark, sf), **FOREST)
    return models.evaluate(test).withColumn("tested", F.lit(not test.isEmpty()))


@query("SELECT 1.0::DOUBLE AS speed, 1.0::DOUBLE AS accuracy, 100 AS trees, TRUE AS tested")
def forest_defaults(spark, sf):
    """The forests at their own size, 100 trees, and exactly a fifth held out."""
    models, test = train_recommender(ruled_ledger(spark, sf), exact=True)
    forests = [model.stages[1] for model in (models.speed, models.accuracy)]
    return models.evaluate(test).withColumns(
        {
            "trees": F.lit(min(forest.getNumTrees for forest in forests)),
            "tested": F.lit(not test.isEmpty()),
        }
    )


SQL_TITLES = f"['{fixed.KMEANS_TITLE}', '{fixed.BISECTING_TITLE}', '{fixed.MIXTURE_TITLE}']"


@query(
    f"""
    WITH jobs AS (
      SELECT o_orderkey, CAST(o_custkey % 4 + 2 AS INTEGER) AS Clusters,
             CAST(o_orderkey % 7 + 2 AS INTEGER) AS FeaturesCount
      FROM orders
    ),
    named AS (
      SELECT o_orderkey,
             {SQL_TITLES}[({SQL_SPEED_RULE.format(c="Clusters")}) + 1] AS recommended_speed,
             {SQL_TITLES}[({SQL_ACCURACY_RULE.format(f="FeaturesCount")}) + 1]
               AS recommended_accuracy
      FROM jobs
    )
    SELECT o_orderkey, recommended_speed, recommended_accuracy,
           recommended_speed || ',' || recommended_accuracy || ',{fixed.KMEANS_TITLE}'
             AS choices
    FROM named
    """
)
def recommend_jobs(spark, sf):
    """Models trained, saved, loaded, and used to score a table of jobs."""
    models, _ = train_recommender(ruled_ledger(spark, sf), **FOREST)
    path = scratch_path(spark, "recommender")
    models.save(path)
    features = (F.col("o_orderkey") % 7 + 2).cast("int")
    iterations = F.array(*[F.lit(i) for i in fixed.GRID_MAX_ITERATIONS])
    records = F.when(F.col("o_totalprice") > 250000, 1000).otherwise(100).cast("bigint")
    jobs = table(spark, sf, "orders").select(
        "o_orderkey",
        F.element_at(iterations, (F.col("o_orderkey") % 3 + 1).cast("int")).alias("maxIteration"),
        (F.col("o_custkey") % 4 + 2).cast("int").alias("Clusters"),
        (F.col("o_custkey") % 5 + 1).cast("int").alias("Workers"),
        (records * (features + 1) * fixed.BYTES_PER_VALUE).alias("ByteSize"),
        records.alias("RecordCount"),
        features.alias("FeaturesCount"),
        F.lit(fixed.KMEANS_TITLE).alias("algorithm"),
    )
    scored = recommend.choices(Recommender.load(path).recommend(jobs))
    return scored.select(
        "o_orderkey",
        "recommended_speed",
        "recommended_accuracy",
        F.array_join("choices", ",").alias("choices"),
    )


@query(
    f"""
    SELECT l_returnflag, l_linestatus, count(*) AS row_count,
           CASE l_returnflag WHEN 'A' THEN '{fixed.KMEANS_TITLE}'
                WHEN 'N' THEN '{fixed.BISECTING_TITLE}'
                WHEN 'R' THEN CASE WHEN l_linestatus = 'O' THEN '{fixed.MIXTURE_TITLE}' END END
             AS title
    FROM lineitem GROUP BY l_returnflag, l_linestatus
    """
)
def name_map(spark, sf):
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    name = (
        F.when(flag == "A", fixed.KMEANS)
        .when(flag == "N", fixed.BISECTING)
        .otherwise(F.when(status == "O", fixed.MIXTURE).otherwise("something else"))
    )
    return (
        table(spark, sf, "lineitem")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(F.count(F.lit(1)).alias("row_count"))
        .withColumn("title", recommend.display_name(name))
    )
