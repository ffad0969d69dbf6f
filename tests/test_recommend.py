import itertools
import math
import threading

import pytest
from pyspark.sql import functions as F

from coterie.functions import fixed
from coterie.operators import recommend
from coterie.operators.grid import grid, remaining
from coterie.plans.recommender import Recommender, train_recommender
from coterie.plans.sweep import POINT_KEYS, completed, sweep
from coterie.sources.ledgers import append_sweep, read_sweep, read_sweep_csv, union_ledgers
from coterie.sources.csv import write_csv

NAMES = recommend.NAMES
NAN = float("nan")


def ledger(spark, triples, key=lambda i: (10, 2, 1, 80, 10 + i, 3), run=lambda i: "run"):
    rows = []
    for i, (speeds, costs) in enumerate(triples):
        for name, speed, cost in zip(NAMES, speeds, costs):
            rows.append((*key(i), float(speed), float(cost), name, run(i)))
    return spark.createDataFrame(rows, fixed.LEDGER_SCHEMA)


def literal_best(values):
    a, b, c = values
    if a < b and a < c:
        return NAMES[0]
    if b < a and b < c:
        return NAMES[1]
    return NAMES[2]


def test_best_of_three_on_all_small_cases(spark):
    cases = list(itertools.product([1.0, 2.0, 3.0, -1.0, NAN], repeat=3))
    frame = ledger(spark, [(c, c[::-1]) for c in cases]).orderBy(F.rand(1))
    got = {r["RecordCount"] - 10: r for r in recommend.training_set(frame).collect()}
    assert len(got) == len(cases)
    for i, case in enumerate(cases):
        assert got[i]["BestBySpeed"] == literal_best(case), case
        assert got[i]["BestByAccuracy"] == literal_best(case[::-1]), case


def test_larger_wins_and_run_id(spark):
    frame = ledger(spark, [((1, 2, 3), (0.2, 0.9, 0.5))]).withColumn("run_id", F.lit(1))
    again = ledger(spark, [((3, 2, 1), (0.9, 0.2, 0.5))]).withColumn("run_id", F.lit(2))
    both = union_ledgers([frame, again.select(*reversed(again.columns))])
    rows = recommend.training_set(both, ["run_id"], ["BestByAccuracy"]).orderBy("run_id").collect()
    assert [r["BestBySpeed"] for r in rows] == [NAMES[0], NAMES[2]]
    assert [r["BestByAccuracy"] for r in rows] == [NAMES[1], NAMES[0]]


def test_points_without_one_row_of_each_get_no_label(spark):
    whole = ledger(spark, [((1, 2, 3), (3, 2, 1))] * 4)
    lacks = whole.filter("not (RecordCount = 11 and Algorithm = 'GaussianMixture')")
    twice = whole.filter("RecordCount = 12 and Algorithm = 'KMeans'").withColumn("ExecutionSpeed", F.lit(9.0))
    other_run = whole.filter("RecordCount = 13").withColumn("run_id", F.lit("other"))
    both = lacks.unionByName(twice).unionByName(other_run)
    labels = [(r["RecordCount"], r["run_id"], r["BestBySpeed"]) for r in recommend.training_set(both).collect()]
    assert sorted(labels) == [(10, "run", NAMES[0]), (13, "other", NAMES[0]), (13, "run", NAMES[0])]
    left_out = recommend.incomplete(both).orderBy("RecordCount").collect()
    assert [(r["RecordCount"], r["run_id"]) for r in left_out] == [(11, "run"), (12, "run")]


def test_split_is_stable(spark):
    frame = recommend.training_set(ledger(spark, [((1, 2, 3), (3, 2, 1))] * 1000))
    train, test = recommend.split(frame)
    again = recommend.split(frame.repartition(7))[1]
    assert train.count() + test.count() == 1000
    assert 150 < test.count() < 250
    assert test.exceptAll(again).count() == 0
    other = recommend.split(frame, seed=1)[1]
    assert other.exceptAll(test).count() > 0


def test_models_with_a_class_that_never_wins(spark, tmp_path):
    def key(i):
        return 10, 2 + i % 4, 1 + i % 5, 80, 100 + i % 10, 3 + i % 7

    triples = [((1, 2, 3) if i % 4 < 2 else (2, 1, 3), (1, 1, 0)) for i in range(700)]
    models, test = train_recommender(ledger(spark, triples, key, str), trees=10, max_depth=8)
    scores = models.evaluate(test).first()
    assert scores["speed"] == 1.0 and scores["accuracy"] == 1.0
    models.save(str(tmp_path / "models"))
    jobs = recommend.jobs_frame(
        spark,
        [
            dict(maxIteration=10, Clusters=2, Workers=1, ByteSize=80, RecordCount=100, FeaturesCount=3),
            dict(maxIteration=10, Clusters=5, Workers=4, ByteSize=80, RecordCount=103, FeaturesCount=6),
        ],
    ).withColumn("algorithm", F.lit("K-means"))
    scored = Recommender.load(str(tmp_path / "models")).recommend(jobs)
    rows = recommend.choices(scored).orderBy("Clusters").collect()
    assert [r["choices"] for r in rows] == [
        ["K-means", "Gaussian mixture", "K-means"],
        ["Bisecting K-Means", "Gaussian mixture", "K-means"],
    ]


def test_display_name(spark):
    names = spark.createDataFrame([(n,) for n in [*NAMES, "other", None]], "n string")
    got = [r[0] for r in names.select(recommend.display_name(F.col("n"))).collect()]
    assert got == ["K-means", "Bisecting K-Means", "Gaussian mixture", None, None]


def test_grid(spark):
    points = grid(spark)
    assert points.count() == 216 == points.distinct().count()
    done = points.filter("Clusters = 3 AND RecordCount <> 100")
    left = remaining(points, done, POINT_KEYS)
    assert left.count() == 216 - done.count()
    assert left.filter("Clusters = 3").select("RecordCount").distinct().count() == 1


def test_sweep_resumes_after_a_gap(spark, tmp_path):
    path = str(tmp_path / "ledger")
    points = grid(spark, [10, 30], [3], [2], [10, 25])
    assert read_sweep(spark, path).count() == 0
    # One point done, one with two of its three rows.
    done = ledger(spark, [((1, 1, 1), (1, 1, 1))], lambda i: (10, 2, 7, 320, 10, 3))
    half = ledger(spark, [((1, 1, 1), (1, 1, 1))], lambda i: (25, 2, 7, 320, 10, 3))
    append_sweep(done.unionByName(half.filter(F.col("Algorithm") != NAMES[0])), path)
    assert completed(read_sweep(spark, path), 7).count() == 1
    assert sweep(spark, path, 7, points) == 3
    assert sweep(spark, path, 7, points) == 0
    rows = read_sweep(spark, path)
    assert rows.filter("RecordCount = 30").count() == 6
    assert {r["ByteSize"] for r in rows.filter("RecordCount = 30").collect()} == {30 * 4 * 8}
    assert all(math.isfinite(r["Accuracy"]) for r in rows.collect())
    # the interrupted point was swept again; what was left of it is not mixed in
    assert recommend.training_set(rows).count() == 4
    assert recommend.incomplete(rows).count() == 1


def sweep_row(spark, i):
    return ledger(spark, [((1, 2, 3), (1, 2, 3))], lambda _: (10, 2, 1 + i % 2, 80, i, 3))


def counts(rows):
    return sorted(r[0] for r in rows.select("RecordCount").collect())


def test_appends_during_a_compaction_are_kept(spark, tmp_path, monkeypatch):
    from coterie.sources import ledgers

    path = str(tmp_path / "ledger")
    for i in range(3):
        append_sweep(sweep_row(spark, i), path)
    begun = read_sweep(spark, path)
    plain = ledgers.rename

    def late(*args):  # after the rows were taken, before the version is there
        append_sweep(sweep_row(spark, 3), path)
        assert counts(read_sweep(spark, path)) == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 3]
        return plain(*args)

    monkeypatch.setattr(ledgers, "rename", late)
    assert ledgers.compact_in_place(spark, path, fixed.LEDGER_SCHEMA) == 1
    monkeypatch.setattr(ledgers, "rename", plain)
    assert counts(begun) == [0, 0, 0, 1, 1, 1, 2, 2, 2]
    assert counts(read_sweep(spark, path)) == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 3]
    assert read_sweep(spark, path).columns == begun.columns

    append_sweep(sweep_row(spark, 4), path)
    writer = threading.Thread(target=lambda: [append_sweep(sweep_row(spark, i), path) for i in range(5, 9)])
    writer.start()
    versions = [ledgers.compact_in_place(spark, path, fixed.LEDGER_SCHEMA) for _ in range(2)]
    writer.join()
    assert versions == [2, 3]
    everything = [i for i in range(9) for _ in range(3)]
    assert counts(read_sweep(spark, path)) == everything
    ledgers.vacuum(spark, path)
    assert counts(read_sweep(spark, path)) == everything
    assert counts(read_sweep(spark, path).filter("Workers = 2")) == [i for i in everything if i % 2]
    assert ledgers.compact_in_place(spark, path, fixed.LEDGER_SCHEMA) == 4
    ledgers.vacuum(spark, path)
    assert counts(read_sweep(spark, path)) == everything
    assert len(spark.read.parquet(*(str(p) for p in (tmp_path / "ledger" / "_compacted").iterdir())).inputFiles()) == 1


def test_second_of_two_compactions_changes_nothing(spark, tmp_path, monkeypatch):
    from coterie.sources import ledgers

    path = str(tmp_path / "ledger")
    append_sweep(sweep_row(spark, 0), path)
    plain, other = ledgers.rename, []

    def late(*args):
        if not other:
            other.append(1)
            ledgers.compact_in_place(spark, path, fixed.LEDGER_SCHEMA)
        return plain(*args)

    monkeypatch.setattr(ledgers, "rename", late)
    with pytest.raises(RuntimeError, match="ended first"):
        ledgers.compact_in_place(spark, path, fixed.LEDGER_SCHEMA)
    assert counts(read_sweep(spark, path)) == [0, 0, 0]


def test_exact_split(spark):
    rows = [(k, k % 3, f"t{k}") for k in range(1001)] + [(7, 0, "same")] * 500 + [(None, None, None)] * 3
    frame = spark.createDataFrame(rows, "a int, b int, `c d` string")
    for share, keys in ((0.2, ["a", "b"]), (0.5, ["b"]), (0.0, ["a"]), (1.0, ["a"]), (0.333, ["b", "c d"])):
        sides = [recommend.split_exact(frame.repartition(n), share, 42, keys) for n in (1, 5)]
        (train, test), other = [[sorted(map(repr, side.collect())) for side in pair] for pair in sides]
        assert [train, test] == other
        assert len(test) == math.ceil(len(rows) * share)
        assert sorted(train + test) == sorted(repr(r) for r in frame.collect())
    assert [side.count() for side in recommend.split_exact(frame.limit(0), 0.2, 42, ["a"])] == [0, 0]


def test_few_rows_make_one_file_and_ledgers_compact(spark, tmp_path):
    from coterie.sources.ledgers import compact

    path, target = str(tmp_path / "ledger"), str(tmp_path / "compacted")
    for i in range(3):
        append_sweep(ledger(spark, [((1, 2, 3), (1, 2, 3))], lambda _: (10, 2, 1, 80, i, 3)), path)
    assert len(read_sweep(spark, path).inputFiles()) == 3
    compact(spark, path, fixed.LEDGER_SCHEMA, target)
    assert len(spark.read.parquet(target).inputFiles()) == 1
    names = read_sweep(spark, path).columns
    assert read_sweep(spark, path).exceptAll(read_sweep(spark, target).select(names)).count() == 0


def test_ledger_csv_files(spark, tmp_path):
    frames = [ledger(spark, [((1, 2, 3), (1, 2, 3))] * w) for w in (1, 2)]
    paths = [str(tmp_path / f"ledger-{i}") for i in range(2)]
    for frame, path in zip(frames, paths):
        write_csv(frame.drop("run_id"), path)
    assert read_sweep_csv(spark, paths).count() == 9


def test_unknown_name_is_refused():
    from coterie.operators.clustering import algorithm

    with pytest.raises(ValueError):
        algorithm("k-means")
