"""Event ledgers of datasets and runs, and the state they fold to.

An event is ``user, label, at, seq, action`` plus the fields it sets (null where
it sets none). ``(at, seq)`` orders the events of a label. Actions:

``put``     starts the label afresh with the fields given
``set``     changes the fields given
``delete``  removes the label
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from coterie.functions import fixed
from coterie.functions.text import percent_text, two_decimals

RUN_FIELDS = [
    "dataset_label",
    "algorithm",
    "clusters_amount",
    "max_iterations",
    "headers",
    "features",
    "date",
    "status",
    "time_taken",
    "accuracy",
]
RUN_EVENTS_SCHEMA = (
    "user string, label string, at timestamp, seq bigint, action string, "
    "dataset_label string, algorithm string, clusters_amount int, max_iterations int, "
    "headers array<string>, features array<string>, date timestamp, status string, "
    "time_taken double, accuracy double"
)
DATASET_FIELDS = ["filename", "size", "lines", "headers", "date"]
DATASET_EVENTS_SCHEMA = (
    "user string, label string, at timestamp, seq bigint, action string, "
    "filename string, size bigint, lines bigint, headers array<string>, date timestamp"
)


def fold(
    events: DataFrame, fields: Sequence[str], keys: Sequence[str] = ("user", "label")
) -> DataFrame:
    """The latest value of every field per label; deleted labels are left out."""
    return folds(events, fields, keys).filter("alive").drop("alive")


def folds(
    events: DataFrame, fields: Sequence[str], keys: Sequence[str] = ("user", "label")
) -> DataFrame:
    """The latest value of every field per label, and ``alive``, false once deleted.

    One aggregate whose partial results are a row per label and task, so a label
    with very many events is reduced before it is shuffled.
    """
    position = F.struct("at", "seq")
    action = F.col("action")
    latest = events.groupBy(*keys).agg(
        F.max(F.when(action != "delete", position)).alias("last_write"),
        F.max(F.when(action == "delete", position)).alias("last_delete"),
        F.max(F.when(action.isin("put", "delete"), position)).alias("last_reset"),
        *[
            F.max_by(
                F.struct(position.alias("position"), F.col(name).alias("value")),
                F.when(F.col(name).isNotNull(), position),
            ).alias(name)
            for name in fields
        ],
    )
    alive = F.col("last_delete").isNull() | (F.col("last_write") > F.col("last_delete"))

    def value(name: str) -> Column:
        kept = F.col("last_reset").isNull() | (
            F.col(f"{name}.position") >= F.col("last_reset")
        )
        return F.when(kept, F.col(f"{name}.value")).alias(name)

    alive = F.coalesce(F.col("last_write").isNotNull() & alive, F.lit(False))
    return latest.select(*keys, *[value(name) for name in fields], alive.alias("alive"))


def run_states(events: DataFrame) -> DataFrame:
    return fold(events, RUN_FIELDS)


def run_folds(events: DataFrame) -> DataFrame:
    return folds(events, RUN_FIELDS)


def dataset_catalog(events: DataFrame) -> DataFrame:
    return fold(events, DATASET_FIELDS)


def listing(states: DataFrame) -> DataFrame:
    """Runs as a results page words them: ``message`` or time and accuracy."""
    status = F.col("status")
    finished = status == fixed.FINISHED
    return states.withColumns(
        {
            "message": F.when(
                status.isin(fixed.RUNNING, fixed.SUBMITTED), fixed.LISTING_RUNNING
            )
            .when(status == fixed.FAILED, fixed.LISTING_FAILED)
            .when(status == fixed.UNKNOWN, fixed.LISTING_UNKNOWN),
            "time_text": F.when(
                finished, F.concat(two_decimals(F.col("time_taken")), F.lit(" sec"))
            ),
            "accuracy_text": F.when(finished, percent_text(F.col("accuracy"))),
        }
    )
