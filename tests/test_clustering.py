import math

import pytest
from pyspark.errors import PySparkException
from pyspark.ml import clustering as library
from pyspark.sql import functions as F

from coterie.functions import fixed
from coterie.operators import clustering
from coterie.operators.features import assemble, min_max_scale, bounds, parse_features
from coterie.operators.runs import RUN_EVENTS_SCHEMA, run_states
from coterie.operators.synthetic import choose_distributions, generate_table
from coterie.plans.clustering import cluster, run_cluster_job
from coterie.sources.csv import read_csv, write_labelled
from coterie.sources.ledgers import read_ledger

TITLES = [fixed.KMEANS_TITLE, fixed.BISECTING_TITLE, fixed.MIXTURE_TITLE]


@pytest.fixture(scope="module")
def points(spark):
    """Two groups of 200 points with awkward column names."""
    n = F.col("id")
    return spark.range(400).select(
        n,
        (F.rand(1) + F.when(n < 200, 0).otherwise(6)).alias("a.b"),
        (F.rand(2) + F.when(n < 200, 0).otherwise(6)).alias("Income (k$), =x`y"),
    )


@pytest.mark.parametrize("title", TITLES)
def test_every_algorithm_finds_the_groups(spark, points, title):
    names = points.columns[1:]
    result = cluster(points, names, title, k=2, max_iter=50)
    rows = result.labelled.groupBy((F.col("id") < 200).alias("low"), "prediction").count()
    assert sorted(r["count"] for r in rows.collect()) == [200, 200]
    assert 0.9 < result.silhouette <= 1
    assert result.seconds > 0
    assert ("probability" in result.labelled.columns) == (title == fixed.MIXTURE_TITLE)


def test_feature_order_is_the_vector_order(spark):
    df = spark.createDataFrame([(1, 2.0, True)], "a int, b double, c boolean")
    row = assemble(df, ["c", "b", "a"]).first()
    assert list(row["features"].toArray()) == [1.0, 2.0, 1.0]
    assert parse_features("b,a") == ["b", "a"]


def test_refusals(spark, points):
    names = points.columns[1:]
    with pytest.raises(ValueError, match="unknown algorithm"):
        cluster(points, names, "DBSCAN", 2, 10)
    with pytest.raises(ValueError, match="no such column"):
        cluster(points, ["nope"], TITLES[0], 2, 10)
    with pytest.raises(ValueError, match="rename"):
        cluster(points.withColumn("prediction", F.lit(1)), names, TITLES[0], 2, 10)
    for title in TITLES:
        with pytest.raises(PySparkException):
            cluster(points, names, title, 1, 10, solver="row")
    with pytest.raises(PySparkException):
        cluster(points.withColumn("t", F.lit("x")), ["t", "id"], TITLES[0], 2, 10)


def test_nulls(spark):
    df = spark.createDataFrame(
        [(float(i), float(i % 7)) for i in range(50)] + [(None, 1.0)], "x double, y double"
    )
    with pytest.raises(Exception, match="null"):
        cluster(df, ["x", "y"], TITLES[0], 2, 10)
    kept = cluster(df, ["x", "y"], TITLES[0], 2, 10, handle_invalid="skip")
    assert kept.labelled.count() == 50


def test_more_clusters_than_rows(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 5.0), (9.0, 9.0)], "x double, y double")
    for title in TITLES[:2]:
        result = cluster(df, ["x", "y"], title, 5, 10, solver="row")
        assert result.labelled.select("prediction").distinct().count() == 3


def test_more_clusters_than_distinct_rows(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("x"), (F.col("id") % 2).alias("y"))
    with pytest.raises(RuntimeError, match="solver='row'"):
        cluster(df, ["x", "y"], TITLES[0], 4, 10)
    result = cluster(df, ["x", "y"], TITLES[0], 4, 10, solver="row")
    assert result.labelled.select("prediction").distinct().count() == 2
    assert result.quality == 0


def test_fits_repeat_wherever_the_rows_come_from(spark):
    rows = spark.range(3000).select(
        F.col("id"), (F.xxhash64("id") % 1000 / 10).alias("x"), (F.xxhash64("id", "id") % 1000 / 10).alias("y")
    )
    for title in TITLES:
        found = []
        for parts in (1, 2, 4):
            result = cluster(rows.repartition(parts), ["x", "y"], title, 4, 10, partitions=4)
            labels = [r[0] for r in result.labelled.orderBy("id").select("prediction").collect()]
            found.append((result.quality, labels))
        assert found[0][1] == found[1][1] == found[2][1]
        # sums of partitions come in any order
        assert [quality for quality, _ in found] == pytest.approx([found[0][0]] * 3, rel=1e-12)


def test_few_partitions_are_dealt_out_by_rows(spark, monkeypatch):
    monkeypatch.setattr(clustering, "SPREAD_ROWS", 100)
    monkeypatch.setattr(clustering, "SPREAD", 6)
    for parts, rows, expected in ((1, 250, 3), (2, 10_000, 6), (8, 10_000, 8), (1, 50, 1)):
        frame = spark.range(rows, numPartitions=parts).select(F.col("id").cast("double").alias("x"))
        with clustering.held(assemble(frame, ["x"], keep_input=False)) as vectors:
            assert vectors.rdd.getNumPartitions() == expected
            assert vectors.count() == rows
            assert vectors.storageLevel.useDisk and not vectors.storageLevel.useMemory


def test_rows_above_a_fit_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(500, numPartitions=3).select(
        (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 11).cast("double").alias("y")
    )
    counted = assemble(df.mapInArrow(count, df.schema), ["x", "y"], keep_input=False)
    with clustering.held(counted) as vectors:
        clustering.fit(vectors, fixed.KMEANS, 3, 5)
        assert vectors.rdd.getNumPartitions() == 3
    assert seen.value == 500


@pytest.mark.parametrize("title", TITLES)
def test_job_writes_rows_and_records_the_run(spark, points, tmp_path, title):
    paths = {"result_path": f"{tmp_path}/result", "ledger_path": f"{tmp_path}/runs"}
    job = dict(
        user="ann", label="r1", dataset_label="d1", features=points.columns[1:],
        algorithm=title, max_iter=50, **paths,
    )
    result = run_cluster_job(points, k=2, **job)
    state = run_states(read_ledger(spark, paths["ledger_path"], RUN_EVENTS_SCHEMA)).first()
    assert state["status"] == fixed.FINISHED
    assert state["accuracy"] == result.silhouette
    assert state["time_taken"] == result.seconds
    assert state["features"] == points.columns[1:]
    written = read_csv(spark, paths["result_path"])
    assert "features" not in written.columns
    assert written.count() == 400
    if title == fixed.MIXTURE_TITLE:
        shares = F.from_json("probability", "array<double>")
        assert written.filter(F.abs(shares[0] + shares[1] - 1) > 1e-6).count() == 0

    with pytest.raises(Exception):
        run_cluster_job(points, k=1, **{**job, "label": "r2"})
    states = run_states(read_ledger(spark, paths["ledger_path"], RUN_EVENTS_SCHEMA))
    assert {r["label"]: r["status"] for r in states.collect()} == {
        "r1": fixed.FINISHED,
        "r2": fixed.FAILED,
    }


def test_scaling(spark):
    df = spark.createDataFrame(
        [(1, 5.0, 2.0, None), (2, 5.0, 4.0, None), (3, 5.0, 3.0, None), (4, None, None, None)],
        "i int, same double, x double, nothing double",
    )
    assert bounds(df, ["x"]).first().asDict() == {"x_min": 2.0, "x_max": 4.0}
    rows = min_max_scale(df, ["same", "x", "nothing"]).orderBy("i").collect()
    assert [r["x"] for r in rows] == [0.0, 1.0, 0.5, None]
    assert [r["same"] for r in rows] == [None] * 4
    assert [r["nothing"] for r in rows] == [None] * 4


def test_generated_tables_repeat(spark):
    first, second = (
        generate_table(spark, 1000, 5, seed=3, rows_per_partition=100) for _ in range(2)
    )
    assert first.rdd.getNumPartitions() == 10
    assert first.exceptAll(second).count() == 0
    assert first.columns == ["id", *[f"feature_{i}" for i in range(5)]]
    for size in (1000, 250, 63):  # 1, 4 and 16 partitions
        other = generate_table(spark, 1000, 5, seed=3, rows_per_partition=size)
        assert sorted(other.collect()) == sorted(first.collect())
    part = generate_table(spark, 1000, 5, seed=4)
    assert part.select("feature_0").exceptAll(first.select("feature_0")).count() > 900
    assert choose_distributions(9, 4) == choose_distributions(9, 4)
    assert len(set(choose_distributions(50, 4))) == 3


def test_draws_are_spread_like_their_distributions(spark):
    from coterie.operators.synthetic import exponential, normal, uniform

    rows = spark.range(20_000).select(
        uniform(5, F.col("id")).alias("u"), uniform(6, F.col("id")).alias("v"),
        normal(7, F.col("id")).alias("n"), exponential(8, F.col("id")).alias("e"),
    )
    found = rows.agg(
        F.min("u"), F.max("u"), F.corr("u", "v"), F.skewness("n"), F.stddev("n"), F.stddev("e"),
        F.avg((F.abs("n") < 1.959964).cast("int")), F.avg((F.col("e") > 1).cast("int")),
        F.kurtosis("n"),
    ).first()
    assert 0 < found[0] < 0.001 and 0.999 < found[1] < 1
    assert abs(found[2]) < 0.03 and abs(found[3]) < 0.08 and abs(found[8]) < 0.2
    assert found[4] == pytest.approx(1, abs=0.02) and found[5] == pytest.approx(1, abs=0.04)
    assert found[6] == pytest.approx(0.95, abs=0.01) and found[7] == pytest.approx(math.exp(-1), abs=0.015)


def test_row_index_is_dense(spark, tmp_path):
    from coterie.operators.numbering import with_row_index

    frame = spark.range(1000, numPartitions=7).filter("id % 5 <> 0 and id > 300").select(F.col("id").alias("a.b"), "id")
    numbered = with_row_index(frame, "n")
    assert numbered.columns == ["n", "a.b", "id"]
    rows = sorted(numbered.collect())
    assert [r[0] for r in rows] == list(range(frame.count()))
    assert [r[1] for r in rows] == sorted(r[1] for r in rows)  # the order of the partitions
    assert with_row_index(frame.limit(0), "n").collect() == []
    with pytest.raises(ValueError, match="rename"):
        with_row_index(frame, "ID")
    labelled = assemble(frame.select("id"), ["id"]).withColumn("prediction", F.lit(0))
    write_labelled(labelled, str(tmp_path / "r"), row_index="row")
    back = read_csv(spark, str(tmp_path / "r"))
    assert back.columns == ["row", "id", "prediction"]
    assert sorted(r[0] for r in back.collect()) == list(range(frame.count()))


def test_labelled_rows_replace_old_ones(spark, tmp_path):
    df = assemble(spark.range(3).withColumn("x", F.col("id") * 1.5), ["x"])
    for _ in range(2):
        write_labelled(df, str(tmp_path / "r"))
    assert read_csv(spark, str(tmp_path / "r")).columns == ["id", "x"]
    assert read_csv(spark, str(tmp_path / "r")).count() == 3


@pytest.mark.parametrize("name", ["cluster_job", "kmeans_check", "kmeans_groups", "kmeans_scores"])
def test_fits_of_more_rows_have_more_partitions(spark, monkeypatch, name):
    from coterie.workload import QUERIES, clustering as workload

    seen, placed = [], clustering.placed
    monkeypatch.setattr(clustering, "placed", lambda rows, parts: seen.append(parts) or placed(rows, parts))
    monkeypatch.setattr(workload, "PARTITION_ROWS", 500, raising=False)
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert QUERIES[name](spark, sf).count() > 0
    assert seen == [math.ceil(rows / 500)] and seen[0] > 8


@pytest.mark.parametrize("parts", [None, 3])
@pytest.mark.parametrize("title", TITLES)
def test_a_fit_decodes_held_rows_once(spark, points, monkeypatch, title, parts):
    kind = clustering.algorithm(title).estimator
    levels, fit = [], kind.fit
    monkeypatch.setattr(kind, "fit", lambda self, rows: levels.append(rows.storageLevel) or fit(self, rows))
    with clustering.held(assemble(points, points.columns[1:], keep_input=False), parts) as vectors:
        assert vectors.storageLevel.useDisk
        clustering.fit(vectors, title, 2, 5)
    # an estimator keeps the decoded rows of a frame that is not held, and of no other
    assert [(level.useDisk, level.useMemory) for level in levels] == [(False, False)]


@pytest.fixture(scope="module")
def spread(spark):
    """Four groups that overlap, in three columns."""
    shifted = [F.randn(7 + i) + 4 * (F.col("id") % 4) * (i - 0.5) for i in range(3)]
    rows = spark.range(2000, numPartitions=3).select(*[x.alias(f"x{i}") for i, x in enumerate(shifted)])
    vectors = assemble(rows, rows.columns, keep_input=False).persist()
    vectors.count()
    yield vectors
    vectors.unpersist()


@pytest.mark.parametrize("k, max_iter", [(2, 1), (2, 20), (7, 5)])
@pytest.mark.parametrize("title", [fixed.BISECTING_TITLE, fixed.MIXTURE_TITLE])
def test_rounds_over_blocks_are_those_of_the_library(spark, spread, title, k, max_iter):
    bisecting = title == fixed.BISECTING_TITLE
    kind = library.BisectingKMeans if bisecting else library.GaussianMixture
    theirs = kind(k=k, maxIter=max_iter, seed=5).fit(spread)
    ours = clustering.fit(spread, title, k, max_iter, 5)
    assert type(ours.model) is type(theirs)
    assert ours.quality == pytest.approx(
        theirs.summary.trainingCost if bisecting else theirs.summary.logLikelihood, rel=1e-9
    )
    assert ours.model.summary.clusterSizes == theirs.summary.clusterSizes
    assert ours.model.summary.numIter == theirs.summary.numIter
    labels = [[r["prediction"] for r in model.transform(spread).collect()] for model in (ours.model, theirs)]
    assert labels[0] == labels[1]


def test_no_round_passes_over_single_rows(spark, spread, monkeypatch):
    asked = []
    monkeypatch.setattr(library.BisectingKMeans, "fit", lambda self, rows: pytest.fail("rounds over rows"))
    fit = library.GaussianMixture.fit
    monkeypatch.setattr(
        library.GaussianMixture, "fit", lambda self, rows: asked.append(self.getMaxIter()) or fit(self, rows)
    )
    for title in (fixed.BISECTING_TITLE, fixed.MIXTURE_TITLE):
        clustering.fit(spread, title, 2, 5)
    assert asked == [0]  # the start alone


def test_a_cost_far_from_zero_is_exact(spark):
    far = spark.range(400, numPartitions=2).select((F.col("id") % 2 * 100 + F.col("id") % 4 + 1e9).alias("x"))
    fitted = clustering.fit(assemble(far, ["x"], keep_input=False), fixed.BISECTING_TITLE, 2, 5)
    assert fitted.quality == pytest.approx(400)  # one from the centre, each of 400


def test_rounds_refuse_what_has_no_distance(spark):
    rows = spark.range(10).select(F.when(F.col("id") == 3, F.lit("nan").cast("double")).otherwise(1.0).alias("x"))
    for title in (fixed.BISECTING_TITLE, fixed.MIXTURE_TITLE):
        with pytest.raises(Exception):
            clustering.fit(assemble(rows, ["x"], "keep", keep_input=False), title, 2, 5)
        with pytest.raises(Exception):
            clustering.fit(assemble(rows.limit(0), ["x"], keep_input=False), title, 2, 5)
