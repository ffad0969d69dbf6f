"""Synthetic tables, the grid, and the sweep."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, functions as F

from coterie.functions import fixed
from coterie.operators.grid import expand, grid, remaining
from coterie.operators.synthetic import exponential, generate_table, normal, uniform
from coterie.plans.sweep import POINT_KEYS, benchmark_table, sweep
from coterie.session import scratch_path
from coterie.sources.ledgers import read_sweep, union_ledgers
from coterie.workload.clustering import SQL_PAIR, paired_points
from coterie.workload.registry import query, table

FEATURES = 6


def exact(number: int) -> Column:
    """A whole number as a literal, beyond what a long holds too."""
    return F.lit(str(number)).cast("decimal(38,0)")


@query(
    f"""
    SELECT 'feature_' || CAST(f AS VARCHAR) AS name, count(*) AS filled,
           0.0::DOUBLE AS low, 1.0::DOUBLE AS high, count(*) AS ids, TRUE AS ids_whole
    FROM orders, range({FEATURES}) r(f) GROUP BY f
    """
)
def synthetic_table(spark, sf):
    """As many generated rows as there are orders: bounds and fill per column."""
    rows = table(spark, sf, "orders").count()
    generated = generate_table(spark, rows, FEATURES, seed=7)
    names = [name for name in generated.columns if name != "id"]
    whole = F.col("id").cast("decimal(19,0)")
    # One pass over the rows, then one small row turned into a row per column.
    summary = generated.agg(
        F.count("id").alias("ids"),
        # ids 0 to n - 1, each once: by their bounds, sum and sum of squares
        (
            (F.min("id") == 0)
            & (F.max("id") == rows - 1)
            & (F.sum(whole) == exact(rows * (rows - 1) // 2))
            & (F.sum(whole * whole) == exact((rows - 1) * rows * (2 * rows - 1) // 6))
        ).alias("ids_whole"),
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.count(name).alias("filled"),
                F.min(name).alias("low"),
                F.max(name).alias("high"),
            ).alias(name)
            for name in names
        ],
    )
    return summary.select("ids", "ids_whole", F.inline(F.array(*names)))


@query(
    """
    SELECT count(*) AS row_count, TRUE AS uniform_fits, TRUE AS normal_fits,
           TRUE AS exponential_fits
    FROM lineitem
    """
)
def random_columns(spark, sf):
    """A random column of each kind beside the rows of a table: the means are
    within five standard errors of 1/2, 0 and 1."""
    row = F.monotonically_increasing_id()
    drawn = table(spark, sf, "lineitem").select(
        uniform(11, row).alias("u"), normal(12, row).alias("n"), exponential(13, row).alias("e")
    )

    def fits(name, mean, deviation):
        error = F.lit(5 * deviation) / F.sqrt(F.count(F.lit(1)))
        return F.abs(F.avg(name) - mean) < error

    return drawn.agg(
        F.count(F.lit(1)).alias("row_count"),
        fits("u", 0.5, 12**-0.5).alias("uniform_fits"),
        fits("n", 0.0, 1.0).alias("normal_fits"),
        fits("e", 1.0, 1.0).alias("exponential_fits"),
    )


# Up to 200 partitions a task writes its rows straight to files; more it would sort in memory.
MOST_VALUE_PARTITIONS, VALUES_PER_PARTITION = 200, 250_000


def distinct_values(rows, partitions: int, *aggregates):
    """A row for each ``value`` of a ``place``. The rows are dealt out by both first, so that
    the task that made them, which may be a single one, holds none of the values."""
    keys = ["value", "place"]
    return rows.repartition(partitions, *keys).groupBy(*keys).agg(*(aggregates or [F.lit(1)]))


@query(
    """
    SELECT parts, count(*) AS row_count, TRUE AS same, TRUE AS apart
    FROM orders, (SELECT unnest([1, 4, 16]) AS parts) GROUP BY parts
    """
)
def random_repeats(spark, sf):
    """Three random columns by order, drawn in 1, 4 and 16 partitions: the same values, row by
    row, and no value twice in a column."""
    orders = table(spark, sf, "orders").select("o_orderkey")
    row = F.col("o_orderkey")
    drawn = [uniform(21, row).alias("u"), normal(22, row).alias("n"), exponential(23, row).alias("e")]
    values = orders.count() * len(drawn)
    parts_of_values = max(1, min(MOST_VALUE_PARTITIONS, math.ceil(values / VALUES_PER_PARTITION)))
    keyed = orders.select(row.alias("value"), F.lit(0).alias("place"))
    keys = distinct_values(keyed, parts_of_values).count()

    def summary(parts):
        # A row for each value; the first of an order's bears the print of all of them.
        print_ = F.xxhash64("o_orderkey", "u", "n", "e")
        values = F.array(
            *[
                F.struct(
                    F.col(name).alias("value"),
                    F.lit(place).alias("place"),
                    (F.lit(None).cast("long") if place else print_).alias("print"),
                )
                for place, name in enumerate("une")
            ]
        )
        rows = orders.repartition(parts).select("o_orderkey", *drawn).select(F.inline(values))
        return distinct_values(
            rows,
            parts_of_values,
            F.count("print").alias("n"),
            F.bit_xor("print").alias("xor"),
            F.sum(F.pmod("print", F.lit(1 << 40))).alias("total"),
        ).agg(
            F.lit(parts).alias("parts"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
            F.struct(F.bit_xor("xor"), F.sum("total")).alias("print"),
            F.array_min(
                F.array(*[F.count_if(F.col("place") == place) == keys for place in range(len(drawn))])
            ).alias("apart"),
        )

    found = union_ledgers([summary(parts) for parts in (1, 4, 16)])
    whole = Window.partitionBy(F.lit(0))  # three rows
    same = F.min("print").over(whole) == F.max("print").over(whole)
    return found.select("parts", "row_count", same.alias("same"), "apart")


SQL_POINTS = """
    points AS (
      SELECT c.c_nationkey, c.RecordCount, f.FeaturesCount, k.Clusters, i.maxIteration
      FROM (SELECT c_nationkey, count(*) AS RecordCount FROM customer GROUP BY c_nationkey) c,
           (SELECT unnest([3, 5, 10, 25]) AS FeaturesCount) f,
           (SELECT unnest([2, 3, 5]) AS Clusters) k,
           (SELECT unnest([10, 25, 50]) AS maxIteration) i
    )
"""


def sweep_points(spark, sf):
    """The parameter grid for each nation's customers."""
    datasets = (
        table(spark, sf, "customer")
        .groupBy("c_nationkey")
        .agg(F.count(F.lit(1)).alias("RecordCount"))
    )
    return expand(
        datasets,
        {
            "FeaturesCount": fixed.GRID_FEATURES,
            "Clusters": fixed.GRID_CLUSTERS,
            "maxIteration": fixed.GRID_MAX_ITERATIONS,
        },
    )


@query(
    f"WITH {SQL_POINTS} "
    "SELECT c_nationkey, RecordCount, FeaturesCount, Clusters, maxIteration FROM points"
)
def sweep_grid(spark, sf):
    return sweep_points(spark, sf)


@query(
    f"""
    WITH {SQL_POINTS}
    SELECT c_nationkey, RecordCount, FeaturesCount, Clusters, maxIteration
    FROM points p WHERE NOT EXISTS (
      SELECT 1 FROM supplier s
      WHERE s.s_nationkey = p.c_nationkey AND s.s_acctbal > 5000
        AND (p.Clusters = 2 OR p.Clusters = 5) AND p.maxIteration = 10)
    """
)
def sweep_resume(spark, sf):
    """The grid without the points a ledger already holds, gaps included."""
    suppliers = table(spark, sf, "supplier").filter(F.col("s_acctbal") > 5000)
    done = expand(
        suppliers.select(F.col("s_nationkey").alias("c_nationkey")),
        {"FeaturesCount": fixed.GRID_FEATURES, "Clusters": [2, 5], "maxIteration": [10]},
    )
    keys = ["c_nationkey", "FeaturesCount", "Clusters", "maxIteration"]
    return remaining(sweep_points(spark, sf), done, keys)


SQL_THREE = f"""
    (SELECT unnest(['{fixed.KMEANS}', '{fixed.BISECTING}', '{fixed.MIXTURE}']) AS Algorithm) a
"""


@query(
    f"""
    WITH {SQL_PAIR},
    costs AS (
      SELECT sum(n) AS n, sum(cost) AS cost FROM (
        SELECT count(*) AS n, count(*) * (var_pop(x) + var_pop(y)) AS cost
        FROM points GROUP BY g)
    )
    SELECT a.Algorithm, i.maxIteration, 2 AS Clusters, 4 AS Workers,
           CAST(n * 3 * 8 AS BIGINT) AS ByteSize, CAST(n AS BIGINT) AS RecordCount,
           2 AS FeaturesCount, TRUE AS timed,
           CASE WHEN a.Algorithm <> '{fixed.MIXTURE}' THEN round(cost / n, 4) END AS mean_cost
    FROM costs, {SQL_THREE}, (SELECT unnest([10, 25]) AS maxIteration) i
    """
)
def algorithm_benchmark(spark, sf):
    """All algorithms on one table for two iteration limits. The mixture's
    likelihood depends on its start, so only the two costs are compared."""
    points = benchmark_table(
        paired_points(spark, sf), ["x", "y"], workers=4, clusters=[2], max_iterations=[10, 25]
    )
    cost = F.round(F.col("Accuracy") / F.col("RecordCount"), 4)
    return union_ledgers(points).select(
        "Algorithm",
        "maxIteration",
        "Clusters",
        "Workers",
        "ByteSize",
        "RecordCount",
        "FeaturesCount",
        (F.col("ExecutionSpeed") > 0).alias("timed"),
        F.when(F.col("Algorithm") != fixed.MIXTURE, cost).alias("mean_cost"),
    )


@query(
    f"""
    SELECT a.Algorithm, 10 AS maxIteration, 2 AS Clusters, 1 AS Workers,
           CAST(n * 4 * 8 AS BIGINT) AS ByteSize, n AS RecordCount, 3 AS FeaturesCount,
           TRUE AS timed, 1 AS first_run, 0 AS second_run
    FROM (SELECT count(*) AS n FROM supplier) s, {SQL_THREE}
    """
)
def sweep_synthetic(spark, sf):
    """The sweep over a generated table of as many rows as there are suppliers,
    started twice on the same ledger: the second start finds nothing to do."""
    ledger = scratch_path(spark, "sweep-ledger")
    points = grid(
        spark,
        rows=[table(spark, sf, "supplier").count()],
        features=[3],
        clusters=[2],
        max_iterations=[10],
    )
    runs = [sweep(spark, ledger, 1, points) for _ in range(2)]
    return read_sweep(spark, ledger).select(
        "Algorithm",
        "Workers",
        "ByteSize",
        *POINT_KEYS,
        (F.col("ExecutionSpeed") > 0).alias("timed"),
        F.lit(runs[0]).alias("first_run"),
        F.lit(runs[1]).alias("second_run"),
    )
