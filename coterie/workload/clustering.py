"""Fits, assignment and scores.

Fitted models cannot be predicted by SQL in general. Where the rows are moved
into groups that lie far apart, the right clusters are the groups, so sizes,
centres, costs, silhouettes and likelihoods all have a closed form to match.
"""

from __future__ import annotations

import math

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from coterie.functions import fixed
from coterie.operators import clustering
from coterie.operators.features import assemble, vectors_from_arrays
from coterie.operators.metrics import nearest_centre as nearest
from coterie.operators.runs import RUN_EVENTS_SCHEMA, listing, run_states
from coterie.plans.clustering import cluster, run_cluster_job
from coterie.session import scratch_path
from coterie.sources.csv import read_csv, write_csv, write_labelled
from coterie.sources.ledgers import read_ledger
from coterie.workload.registry import query, table

# The given tables are one file each. The number of partitions depends on the rows alone, so
# that fits repeat on any machine, and no task gets more rows as a table grows.
PARTITIONS, PARTITION_ROWS = 8, 500_000


def partitions(points) -> int:
    return max(PARTITIONS, math.ceil(points.count() / PARTITION_ROWS))


# --- lineitem moved into three groups far apart -------------------------------

SQL_GROUPS = """
    points AS (
      SELECT l_linenumber % 3 AS g,
             l_quantity + CASE l_linenumber % 3 WHEN 0 THEN 0 WHEN 1 THEN 1000 ELSE 500 END AS x,
             l_extendedprice / 1000
               + CASE l_linenumber % 3 WHEN 2 THEN 1000 ELSE 0 END AS y
      FROM lineitem
    )
"""

# Two groups, closer together: far enough that no row is in doubt, near enough
# for the mixture's first means to tell them apart.
SQL_PAIR = """
    points AS (
      SELECT l_linenumber % 2 AS g,
             l_quantity + 150 * (l_linenumber % 2) AS x,
             l_extendedprice / 2000 + 150 * (l_linenumber % 2) AS y
      FROM lineitem
    )
"""

# Mean silhouette of (g, x, y) rows in closed form, from a count, a sum vector
# and a sum of squares per cluster.
SQL_SILHOUETTE = """
    stats AS (
      SELECT g, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x + y * y) AS p
      FROM points GROUP BY g
    ),
    numbered AS (SELECT *, row_number() OVER () AS id FROM points),
    distances AS (
      SELECT q.id, q.g = s.g AS own, s.n,
             q.x * q.x + q.y * q.y + s.p / s.n - 2 * (q.x * s.sx + q.y * s.sy) / s.n AS d
      FROM numbered q, stats s
    ),
    pairs AS (
      SELECT id, min(d * n / (n - 1)) FILTER (WHERE own) AS a,
             min(d) FILTER (WHERE NOT own) AS b
      FROM distances GROUP BY id
    ),
    silhouettes AS (
      SELECT avg(CASE WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END) AS silhouette
      FROM pairs
    )
"""


def grouped_points(spark, sf):
    group = F.col("l_linenumber") % 3
    right = F.when(group == 0, 0).when(group == 1, 1000).otherwise(500)
    up = F.when(group == 2, 1000).otherwise(0)
    return table(spark, sf, "lineitem").select(
        (F.col("l_quantity") + right).alias("x"),
        (F.col("l_extendedprice") / 1000 + up).alias("y"),
    )


def paired_points(spark, sf):
    moved = F.lit(150) * (F.col("l_linenumber") % 2)
    return table(spark, sf, "lineitem").select(
        (F.col("l_quantity") + moved).alias("x"),
        (F.col("l_extendedprice") / 2000 + moved).alias("y"),
    )


def cluster_rows(labelled):
    """A row per cluster, without the arbitrary cluster number."""
    return (
        labelled.groupBy("prediction")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.round(F.avg("x"), 6).alias("centre_x"),
            F.round(F.avg("y"), 6).alias("centre_y"),
        )
        .drop("prediction")
    )


def one_row(points, **values):
    """The row count beside numbers known to the driver."""
    return points.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.lit(value).alias(name) for name, value in values.items()],
    )


SQL_CLUSTER_ROWS = f"""
    WITH {SQL_GROUPS}
    SELECT count(*) AS row_count, round(avg(x), 6) AS centre_x, round(avg(y), 6) AS centre_y
    FROM points GROUP BY g
"""

SQL_COST_SCORES = f"""
    WITH {SQL_GROUPS}, {SQL_SILHOUETTE},
    costs AS (
      SELECT sum(n) AS n, sum(cost) AS cost FROM (
        SELECT count(*) AS n, count(*) * (var_pop(x) + var_pop(y)) AS cost
        FROM points GROUP BY g)
    )
    SELECT CAST(n AS BIGINT) AS row_count, round(cost / n, 4) AS mean_cost,
           round(silhouette, 8) AS silhouette, TRUE AS timed
    FROM costs, silhouettes
"""


def assigned(spark, sf, name):
    """The rows of three groups with the cluster a fitted model gives them."""
    points = grouped_points(spark, sf)
    with clustering.held(assemble(points, ["x", "y"], keep_input=False), partitions(points)) as vectors:
        fitted = clustering.fit(vectors, name, k=3, max_iter=20)
    return clustering.assign(fitted.model, assemble(points, ["x", "y"]))


def scores(spark, sf, name):
    points = grouped_points(spark, sf)
    result = cluster(points, ["x", "y"], name, k=3, max_iter=20, partitions=partitions(points))
    total = points.count()
    return one_row(
        points,
        mean_cost=round(result.quality / total, 4),
        silhouette=round(result.silhouette, 8),
        timed=result.seconds > 0,
    )


@query(SQL_CLUSTER_ROWS)
def kmeans_groups(spark, sf):
    return cluster_rows(assigned(spark, sf, fixed.KMEANS))


@query(SQL_CLUSTER_ROWS)
def bisecting_groups(spark, sf):
    return cluster_rows(assigned(spark, sf, fixed.BISECTING))


@query(SQL_COST_SCORES)
def kmeans_scores(spark, sf):
    return scores(spark, sf, fixed.KMEANS)


@query(SQL_COST_SCORES)
def bisecting_scores(spark, sf):
    return scores(spark, sf, fixed.BISECTING)


def best_mixture(vectors, k, seeds=(1, 2, 3)):
    """The likeliest of a few fits: a single start may end in a poor optimum."""
    fits = [clustering.fit(vectors, fixed.MIXTURE, k, 100, seed) for seed in seeds]
    return max(fits, key=lambda one: one.quality)


@query(
    f"""
    WITH {SQL_PAIR}
    SELECT count(*) AS row_count, round(avg(x), 5) AS centre_x, round(avg(y), 5) AS centre_y,
           round(count(*) / sum(count(*)) OVER (), 6) AS weight, 1.0::DOUBLE AS certainty
    FROM points GROUP BY g
    """
)
def mixture_groups(spark, sf):
    points = paired_points(spark, sf)
    with clustering.held(assemble(points, ["x", "y"], keep_input=False), partitions(points)) as vectors:
        model = best_mixture(vectors, 2).model
    weights = F.array(*[F.lit(float(w)) for w in model.weights])
    labelled = clustering.assign(model, assemble(points, ["x", "y"]))
    return (
        labelled.groupBy("prediction")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.round(F.avg("x"), 5).alias("centre_x"),
            F.round(F.avg("y"), 5).alias("centre_y"),
            F.round(F.avg(F.array_max(vector_to_array("probability"))), 6).alias("certainty"),
        )
        .withColumn("weight", F.round(F.element_at(weights, F.col("prediction") + 1), 6))
        .drop("prediction")
    )


@query(
    f"""
    WITH {SQL_PAIR}, {SQL_SILHOUETTE},
    shapes AS (
      SELECT count(*) AS n, count(*) / sum(count(*)) OVER () AS weight,
             var_pop(x) * var_pop(y) - covar_pop(x, y) * covar_pop(x, y) AS determinant
      FROM points GROUP BY g
    ),
    likelihood AS (
      SELECT sum(n) AS n, sum(n * (ln(weight) - ln(2 * pi()) - ln(determinant) / 2 - 1)) AS total
      FROM shapes
    )
    SELECT CAST(n AS BIGINT) AS row_count, round(total / n, 5) AS mean_log_likelihood,
           round(silhouette, 8) AS silhouette
    FROM likelihood, silhouettes
    """
)
def mixture_scores(spark, sf):
    points = paired_points(spark, sf)
    with clustering.held(assemble(points, ["x", "y"], keep_input=False), partitions(points)) as vectors:
        best = best_mixture(vectors, 2)
        score = clustering.silhouette(clustering.assign(best.model, vectors))
        total = vectors.count()
    return one_row(
        points,
        mean_log_likelihood=round(best.quality / total, 5),
        silhouette=round(score, 8),
    )


@query(
    f"""
    WITH points AS (
      SELECT CAST(least(floor((l_quantity - 1) / 17), 2) AS INTEGER) AS g,
             l_quantity AS x, l_discount * 100 AS y
      FROM lineitem
    ), {SQL_SILHOUETTE}
    SELECT round(silhouette, 9) AS silhouette FROM silhouettes
    """
)
def silhouette_fixed(spark, sf):
    """The score of given clusters, here bands of the quantity."""
    lineitem = table(spark, sf, "lineitem")
    band = F.least(F.floor((F.col("l_quantity") - 1) / 17), F.lit(2)).cast("int")
    banded = lineitem.select(
        band.alias("band"), "l_quantity", (F.col("l_discount") * 100).alias("discount")
    )
    labelled = assemble(banded, ["l_quantity", "discount"]).withColumnRenamed("band", "prediction")
    score = clustering.silhouette(labelled)
    return spark.range(1).select(F.round(F.lit(score), 9).alias("silhouette"))


CENTRES = [[10.0, 20.0, 5.0], [25.0, 50.0, 2.0], [40.0, 30.0, 8.0], [45.0, 90.0, 5.0]]


def sql_squared(i: int) -> str:
    x, y, z = CENTRES[i]
    return f"(x - {x}) ** 2 + (y - {y}) ** 2 + (z - {z}) ** 2"


@query(
    f"""
    WITH points AS (
      SELECT l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z FROM lineitem
    ),
    measured AS (
      SELECT x, y, z, [{", ".join(sql_squared(i) for i in range(len(CENTRES)))}] AS d FROM points
    ),
    chosen AS (
      SELECT x, y, z, list_min(d) AS cost,
             CAST(list_position(d, list_min(d)) - 1 AS INTEGER) AS prediction
      FROM measured
    )
    SELECT prediction, count(*) AS row_count, round(sum(cost) / count(*), 6) AS mean_cost,
           round(avg(x), 6) AS mean_x
    FROM chosen GROUP BY prediction
    """
)
def nearest_centre(spark, sf):
    points = table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("x"),
        (F.col("l_extendedprice") / 1000).alias("y"),
        (F.col("l_discount") * 100).alias("z"),
    )
    return (
        nearest(points, ["x", "y", "z"], CENTRES)
        .groupBy("prediction")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.round(F.sum("cost") / F.count(F.lit(1)), 6).alias("mean_cost"),
            F.round(F.avg("x"), 6).alias("mean_x"),
        )
    )


def embedding_vectors(spark, sf):
    return vectors_from_arrays(table(spark, sf, "embeddings"), "embedding")


def embedding_clusters(spark, sf):
    embeddings = embedding_vectors(spark, sf)
    with clustering.held(embeddings.select("features"), partitions(embeddings)) as vectors:
        fitted = clustering.fit(vectors, fixed.KMEANS, k=10, max_iter=20)
    return (
        clustering.assign(fitted.model, embeddings)
        .groupBy("prediction")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


@query(
    """
    SELECT count(*) AS row_count, 0::BIGINT AS outside, 0::BIGINT AS not_nearest,
           10::BIGINT AS clusters, TRUE AS cost_agrees
    FROM embeddings
    """
)
def kmeans_embeddings(spark, sf):
    """K-Means over the embeddings: every vector is with its nearest centre of all ten, no
    cluster is empty, and the distances add up to the cost."""
    embeddings = embedding_vectors(spark, sf)
    with clustering.held(embeddings.select("features"), partitions(embeddings)) as vectors:
        fitted = clustering.fit(vectors, fixed.KMEANS, k=10, max_iter=20)
    labelled = clustering.assign(fitted.model, embeddings).withColumn(
        "values", vector_to_array("features")
    )
    centres = [[float(v) for v in centre] for centre in fitted.model.clusterCenters()]

    def square(centre):
        pairs = F.zip_with("values", F.array(*map(F.lit, centre)), lambda a, b: (a - b) * (a - b))
        return F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x)

    distances = labelled.select("prediction", F.array(*map(square, centres)).alias("distances"))
    own, least = F.element_at("distances", F.col("prediction") + 1), F.array_min("distances")
    # The last move of the centres follows the last cost, hence the tolerance.
    agrees = F.abs(F.sum(least) / F.lit(fitted.quality) - 1) < 0.01
    return distances.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(~F.col("prediction").between(0, 9)).alias("outside"),
        F.count_if(own > least + 1e-9).alias("not_nearest"),
        F.count_distinct("prediction").alias("clusters"),
        agrees.alias("cost_agrees"),
    )


@query(
    """
    SELECT count(*) AS row_count, 10 AS clusters_allowed, 0::BIGINT AS outside,
           0::BIGINT AS not_nearest, TRUE AS cost_agrees
    FROM lineitem
    """
)
def kmeans_check(spark, sf):
    """On data without clear groups: every row is with its nearest centre and the
    training cost is the sum of squared distances to it."""
    names = ["x", "y"]
    points = table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y")
    )
    with clustering.held(assemble(points, names, keep_input=False), partitions(points)) as vectors:
        fitted = clustering.fit(vectors, fixed.KMEANS, k=10, max_iter=20)
    centres = [list(map(float, centre)) for centre in fitted.model.clusterCenters()]
    labelled = clustering.assign(fitted.model, assemble(points, names)).drop("features")
    theirs = labelled.withColumnRenamed("prediction", "assigned")
    checked = nearest(theirs, names, centres)
    offset = [F.lit(c[0]) for c in centres], [F.lit(c[1]) for c in centres]
    at = F.col("assigned") + 1
    own = (F.col("x") - F.element_at(F.array(*offset[0]), at)) ** 2 + (
        F.col("y") - F.element_at(F.array(*offset[1]), at)
    ) ** 2
    # The last move of the centres follows the last cost, hence the tolerance.
    agrees = F.abs(F.sum("cost") / F.lit(fitted.quality) - 1) < 0.01
    return checked.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(10).alias("clusters_allowed"),
        F.count_if(~F.col("assigned").between(0, 9)).alias("outside"),
        F.count_if(own > F.col("cost") * (1 + 1e-9) + 1e-9).alias("not_nearest"),
        agrees.alias("cost_agrees"),
    )


@query(
    """
    SELECT count(*) AS row_count, 0::BIGINT AS outside, 0::BIGINT AS not_summing_to_one,
           0::BIGINT AS not_likeliest, 1.0::DOUBLE AS weights
    FROM customer
    """
)
def mixture_check(spark, sf):
    """On data without clear groups: probabilities sum to one and the prediction
    is the likeliest component."""
    names = ["c_acctbal", "c_nationkey"]
    customer = table(spark, sf, "customer").select(*names)
    with clustering.held(assemble(customer, names, keep_input=False), partitions(customer)) as vectors:
        fitted = clustering.fit(vectors, fixed.MIXTURE, k=3, max_iter=20)
    labelled = clustering.assign(fitted.model, assemble(customer, names))
    shares = vector_to_array("probability")
    total = F.aggregate(shares, F.lit(0.0), lambda a, b: a + b)
    own = F.element_at(shares, F.col("prediction") + 1)
    return labelled.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(~F.col("prediction").between(0, 2)).alias("outside"),
        F.count_if(F.abs(total - 1) > 1e-9).alias("not_summing_to_one"),
        F.count_if(own < F.array_max(shares)).alias("not_likeliest"),
        F.lit(round(float(sum(fitted.model.weights)), 9)).alias("weights"),
    )


@query(
    f"""
    WITH {SQL_GROUPS}, {SQL_SILHOUETTE}
    SELECT count(*) AS row_count, round(avg(x), 6) AS centre_x, round(avg(y), 6) AS centre_y,
           '{fixed.FINISHED}' AS status, 3 AS clusters_amount,
           (SELECT printf('%.2f', silhouette * 100) || ' %' FROM silhouettes) AS accuracy_text
    FROM points GROUP BY g
    """
)
def cluster_job(spark, sf):
    """A CSV dataset in, a labelled CSV and a recorded run out."""
    dataset = scratch_path(spark, "job-dataset")
    result = scratch_path(spark, "job-result")
    ledger = scratch_path(spark, "job-ledger")
    # A column name with spaces and a parenthesis, and one with a dot.
    renamed = grouped_points(spark, sf).toDF("quantity (moved)", "price.k")
    write_csv(renamed, dataset)
    run_cluster_job(
        read_csv(spark, dataset, "`quantity (moved)` double, `price.k` double"),
        user="u1",
        label="run1",
        dataset_label="lines",
        features=["quantity (moved)", "price.k"],
        algorithm=fixed.KMEANS_TITLE,
        k=3,
        max_iter=20,
        partitions=partitions(renamed),
        result_path=result,
        ledger_path=ledger,
    )
    run = listing(run_states(read_ledger(spark, ledger, RUN_EVENTS_SCHEMA))).first()
    labelled = read_csv(spark, result).toDF("x", "y", "prediction")
    return cluster_rows(labelled).withColumns(
        {
            "status": F.lit(run["status"]),
            "clusters_amount": F.lit(run["clusters_amount"]),
            "accuracy_text": F.lit(run["accuracy_text"]),
        }
    )


@query(
    f"""
    WITH {SQL_GROUPS}
    SELECT g AS prediction, count(*) AS row_count, round(sum(x), 4) AS x_total,
           TRUE AS dense, (SELECT count(*) FROM points) - 1 AS last
    FROM points GROUP BY g
    """
)
def indexed_result(spark, sf):
    """A labelled result with the row numbers 0 to n - 1 in front."""
    points = grouped_points(spark, sf)
    group = F.when(F.col("y") >= 1000, 2).when(F.col("x") >= 1000, 1).otherwise(0)
    labelled = assemble(points, ["x", "y"]).withColumn("prediction", group)
    path = scratch_path(spark, "indexed-result")
    write_labelled(labelled, path, row_index="number")
    written = read_csv(spark, path, "number bigint, x double, y double, prediction int")
    whole = written.agg(F.count(F.lit(1)).alias("n"), F.max("number").alias("last"), F.count_distinct("number").alias("numbers"))
    dense = (F.col("n") == F.col("numbers")) & (F.col("last") == F.col("n") - 1)
    found = whole.select(dense.alias("dense"), "last").first()  # one row
    return written.groupBy("prediction").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.round(F.sum("x"), 4).alias("x_total"),
        F.lit(found["dense"]).alias("dense"),
        F.lit(found["last"]).cast("bigint").alias("last"),
    )
