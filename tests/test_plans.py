"""What the physical plans must and must not contain."""

import pytest

from coterie.operators.profile import _splits, check_shape
from coterie.operators.runs import run_states
from coterie.sources.files import read_lines
from coterie.workload import QUERIES
from coterie.workload.runs import run_events

SF = "/root/testdata/sf0.001"

# Queries whose result is a lazy plan over the tables; the others fit models or
# write tables first.
LAZY = [
    "filter_select", "drop_column", "computed_columns", "union_ledgers", "string_functions",
    "text_rules", "json_list", "timestamp_text", "number_text", "casts", "bounds",
    "minmax_scale", "size_estimate", "class_accuracy", "file_profile", "label_rule",
    "best_of_three", "training_labels", "train_test_split", "name_map", "request_rule",
    "known_datasets", "run_listing", "dataset_catalog", "sweep_grid", "sweep_resume",
    "random_columns", "nearest_centre",
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert unwanted not in text


def test_filter_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["filter_select"](spark, SF))
    assert "GreaterThan(c_acctbal,5000.0)" in text
    assert "ReadSchema: struct<c_name:string,c_acctbal:double>" in text
    assert "Exchange" not in text


def test_one_shuffle_for_both_labels(spark):
    frame = QUERIES["training_labels"](spark, SF)
    # One for the ledger itself, one for its labels.
    assert plan(frame).count("Exchange hashpartitioning") == 2


def test_grid_expands_in_place(spark):
    assert plan(QUERIES["sweep_grid"](spark, SF)).count("Exchange") == 1


def test_shape_check_aggregates_lines_by_hash(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    text = plan(_splits(read_lines(spark, str(tmp_path))))
    lowest = text[text.rindex("Window") :]
    assert "HashAggregate" in lowest and "SortAggregate" not in lowest
    assert "SortAggregate" not in plan(check_shape(read_lines(spark, str(tmp_path))))


def test_synthetic_table_is_reduced_before_its_shuffle(spark):
    frame = QUERIES["synthetic_table"](spark, SF)
    text = frame._jdf.queryExecution().toString()
    assert "count(distinct" not in text and "Expand" not in text


def test_look_up_adds_no_copies(spark):
    text = plan(QUERIES["label_rule"](spark, SF))
    assert "Generate" not in text


def test_fold_is_one_shuffle_with_partial_results(spark):
    text = plan(run_states(run_events(spark, SF)))
    assert text.count("Exchange hashpartitioning") == 1
    assert "partial_max_by" in text


def test_random_draws_are_dealt_out_by_value_before_they_are_counted(spark, monkeypatch):
    from coterie.workload import sweeping

    monkeypatch.setattr(sweeping, "VALUES_PER_PARTITION", 100)
    text = plan(QUERIES["random_repeats"](spark, SF))
    assert "Expand" not in text and "Exchange hashpartitioning(value" in text
    for drawn in text.split("Exchange hashpartitioning(value")[1:]:
        assert "REPARTITION_BY_NUM" in drawn.splitlines()[0]
        assert "HashAggregate" not in drawn.split("Exchange")[0]  # nothing is held by the drawing task


def test_a_value_drawn_twice_is_seen(spark, monkeypatch):
    from coterie.workload import sweeping

    monkeypatch.setattr(sweeping, "uniform", lambda seed, row: (row - row % 64).cast("double"))
    found = QUERIES["random_repeats"](spark, SF).collect()
    assert [(r["same"], r["apart"]) for r in found] == [(True, False)] * 3


@pytest.mark.parametrize("name", ["normal", "exponential"])
def test_a_value_drawn_twice_is_seen_in_every_column(spark, monkeypatch, name):
    from coterie.workload import sweeping

    monkeypatch.setattr(sweeping, name, lambda seed, row: (row - row % 64).cast("double"))
    found = QUERIES["random_repeats"](spark, SF).collect()
    assert [(r["same"], r["apart"]) for r in found] == [(True, False)] * 3
