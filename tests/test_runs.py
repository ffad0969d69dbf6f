import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from coterie.functions import fixed
from coterie.operators.requests import check_requests, with_existence
from coterie.operators.runs import RUN_EVENTS_SCHEMA, listing, run_states
from coterie.sources.ledgers import append
from coterie.streaming.runs import keep_listing, run_event_stream

FIELDS = ["status", "time_taken", "accuracy"]


def events_frame(spark, events):
    schema = spark.createDataFrame([], RUN_EVENTS_SCHEMA).schema
    rows = [tuple(event.get(field.name) for field in schema) for event in events]
    return spark.createDataFrame(rows, schema)


def random_events(count, labels=6):
    draw = random.Random(8)
    start = datetime(2024, 1, 1)
    events = []
    for seq in range(count):
        event = {
            "user": "u",
            "label": f"r{draw.randrange(labels)}",
            "at": start + timedelta(minutes=seq // 3),
            "seq": seq,
            "action": draw.choices(["put", "set", "delete"], [1, 6, 1])[0],
        }
        if event["action"] != "delete":
            for field, values in {
                "status": ["RUNNING", "FAILED", "FINISHED"],
                "time_taken": [1.25, 3.0],
                "accuracy": [0.5, 0.75],
            }.items():
                if draw.random() < 0.4:
                    event[field] = draw.choice(values)
        events.append(event)
    return events


def literal_fold(events):
    states = {}
    for event in events:
        if event["action"] == "delete":
            states.pop(event["label"], None)
            continue
        if event["action"] == "put":
            states[event["label"]] = {}
        state = states.setdefault(event["label"], {})
        state.update({f: event[f] for f in FIELDS if event.get(f) is not None})
    return states


def test_fold_is_a_replay(spark):
    for count in (1, 7, 40, 400):
        events = random_events(count)
        frame = events_frame(spark, events).repartition(5).orderBy(F.rand(count))
        got = {
            r["label"]: {f: r[f] for f in FIELDS if r[f] is not None}
            for r in run_states(frame).collect()
        }
        assert got == literal_fold(events)


def test_listing(spark):
    rows = [("RUNNING", None, None), ("SUBMITTED", None, None), ("FAILED", None, None),
            ("UNKNOWN", None, None), ("FINISHED", 1.005, 0.66125), ("other", None, None)]
    frame = spark.createDataFrame(rows, "status string, time_taken double, accuracy double")
    got = {r["status"]: (r["message"], r["time_text"], r["accuracy_text"]) for r in listing(frame).collect()}
    assert got == {
        "RUNNING": (fixed.LISTING_RUNNING, None, None),
        "SUBMITTED": (fixed.LISTING_RUNNING, None, None),
        "FAILED": (fixed.LISTING_FAILED, None, None),
        "UNKNOWN": (fixed.LISTING_UNKNOWN, None, None),
        "FINISHED": (None, "%.2f sec" % 1.005, "%.2f %%" % (0.66125 * 100)),
        "other": (None, None, None),
    }


def test_request_rules_in_order(spark):
    good = ("u", "d", "3", "K-means", '["a","b"]', "run1", "10", 2)
    cases = [
        (good, None),
        (("u", "x", *good[2:]), fixed.REQUEST_DATASET),
        (("v", *good[1:]), fixed.REQUEST_DATASET),
        (("u", "d", "0", "", *good[4:]), fixed.REQUEST_CLUSTERS),
        (("u", "d", "3", "", *good[4:]), fixed.REQUEST_ALGORITHM),
        ((*good[:4], '["a"]', "", "0", 2), fixed.REQUEST_FEATURES),
        ((*good[:4], "[]", "run1", "10", 2), fixed.REQUEST_FEATURES),
        ((*good[:5], "", "0", 2), fixed.REQUEST_LABEL_MISSING),
        ((*good[:5], "a b", "10", 2), fixed.REQUEST_LABEL_SPACES),
        ((*good[:5], "a_b", "10", 2), fixed.REQUEST_LABEL_CHARACTERS),
        ((*good[:5], "1a", "10", 2), fixed.REQUEST_LABEL_DIGIT),
        ((*good[:5], "old", "0", 2), fixed.REQUEST_LABEL_TAKEN),
        ((*good[:6], "0", 2), fixed.REQUEST_MAX_ITERATIONS),
        (("u", "d", "11", *good[3:]), fixed.REQUEST_ROWS),
        (("u", "d", "10", *good[3:]), None),
        (("u", "d", "1", *good[3:]), "At least 2 clusters are required"),
        ((*good[:6], "9", 2), "At least 10 iterations are required"),
        ((*good[:3], "DBSCAN", *good[4:]), fixed.REQUEST_ALGORITHM_UNKNOWN),
        ((*good[:4], '["a","z"]', "run1", "10", 2), "Features must be headers of the dataset"),
        ((*good[:7], 0), "No worker is available"),
        ((*good[:7], None), "No worker is available"),
    ]
    # labels that are right are told apart, as a batch takes each only once
    cases = [
        ((*case[:5], f"run1x{i}" if case[5] == "run1" else case[5], *case[6:]), error)
        for i, (case, error) in enumerate(cases)
    ]
    requests = spark.createDataFrame(
        [(i, *case) for i, (case, _) in enumerate(cases)],
        "seq int, user string, dataset_label string, clusters string, algorithm string, "
        "headers string, cluster_label string, max_iterations string, workers int",
    )
    catalog = spark.createDataFrame(
        [("u", "d", 10, ["a", "b", "c"])], "user string, label string, lines bigint, headers array<string>"
    )
    runs = spark.createDataFrame([("u", "old"), ("u", "old"), ("v", "run1")], "user string, label string")
    checked = check_requests(requests, catalog, runs).orderBy("seq").collect()
    assert [r["error"] for r in checked] == [error for _, error in cases]
    unbounded = check_requests(requests, catalog, runs, form_bounds=False).orderBy("seq").collect()
    assert [r["error"] for r in unbounded[-6:]] == [None] * 6


REQUESTS = (
    "seq int, user string, dataset_label string, clusters string, algorithm string, "
    "headers string, cluster_label string, max_iterations string, workers int"
)


def test_requests_of_one_batch_and_nulls(spark):
    good = ("u", "d", "3", "K-means", '["a","b"]', "run1", "10", 2)
    rows = [
        (5, *good),  # comes after the valid one below
        (3, *good[:6], "0", 2),  # wrong by itself, but the label is taken first
        (1, *good[:6], "0", 2),  # wrong by itself, takes nothing
        (2, *good),
        (4, "v", *good[1:]),  # another user's
        (6, *good[:4], '["a","a"]', "run2", "10", 2),
        (7, "u", "bare", *good[2:5], "run3", "10", 2),
        (8, "u", "wide", *good[2:5], "run4", "10", 2),
    ]
    catalog = spark.createDataFrame(
        [("u", "d", 10, ["a", "b"]), ("v", "d", 10, ["a", "b"]), ("u", "bare", None, ["a", "b"]), ("u", "wide", 10, None)],
        "user string, label string, lines bigint, headers array<string>",
    )
    runs = spark.createDataFrame([], "user string, label string")
    checked = check_requests(spark.createDataFrame(rows, REQUESTS).repartition(3), catalog, runs)
    assert {r["seq"]: r["error"] for r in checked.collect()} == {
        1: fixed.REQUEST_MAX_ITERATIONS,
        2: None,
        3: fixed.REQUEST_LABEL_TAKEN,
        4: None,
        5: fixed.REQUEST_LABEL_TAKEN,
        6: fixed.REQUEST_FEATURES,
        7: fixed.REQUEST_ROWS,
        8: "Features must be headers of the dataset",
    }


def test_stream_ends_where_the_batch_does(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / name) for name in ("ledger", "listing", "state"))
    events = random_events(60)
    for start in (0, 20, 40):
        append(events_frame(spark, events[start : start + 20]), path)
        batch = keep_listing(run_event_stream(spark, path), out, checkpoint)
        streamed = spark.read.parquet(f"{out}/{batch}")
        expected = listing(run_states(spark.read.schema(RUN_EVENTS_SCHEMA).parquet(path)))
        assert streamed.exceptAll(expected).count() == 0
        assert streamed.count() == expected.count()
    assert keep_listing(run_event_stream(spark, path), out, checkpoint) is None


def test_listing_keeps_two_folders_and_forgets_deleted_runs(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / name) for name in ("ledger", "listing", "state"))
    events = random_events(60) + [
        {"user": "u", "label": label, "at": datetime(2025, 1, 1), "seq": 1, "action": "delete"}
        for label in ("r0", "r1", "r2")
    ]
    for start in range(0, len(events), 16):
        append(events_frame(spark, events[start : start + 16]), path)
        batch = keep_listing(run_event_stream(spark, path), out, checkpoint)
    kept = spark.read.parquet(f"{out}/{batch}")
    assert {r["label"] for r in kept.collect()} == set(literal_fold(events))
    assert sorted(name for name in os.listdir(out) if name.isdigit()) == sorted([str(batch - 1), str(batch)])


def test_hot_key_is_split(spark):
    """Both sides are shuffled for the join alone, which adaptive execution can split."""
    requests = spark.range(3000).select(
        F.lit("u").alias("user"), F.lit("d").alias("label"), F.col("id")
    )
    known = spark.createDataFrame([("u", "d"), ("v", "d")], "user string, label string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = with_existence(requests, known, {"user": "user", "label": "label"}, "found")
        assert found.filter("found").count() == 3000
        assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
