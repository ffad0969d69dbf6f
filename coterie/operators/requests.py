"""Label rules and clustering request rules, as one error column each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from coterie.functions import fixed
from coterie.functions.text import (
    has_space,
    is_alphanumeric,
    parse_list,
    starts_with_digit,
    to_int,
)
from coterie.operators.clustering import ALGORITHMS

NAMES = [name for entry in ALGORITHMS for name in (entry.name, entry.title)]


@dataclass(frozen=True)
class LabelMessages:
    missing: str
    spaces: str
    characters: str
    digit: str
    taken: str


DATASET_LABEL = LabelMessages(
    fixed.LABEL_MISSING,
    fixed.LABEL_SPACES,
    fixed.LABEL_CHARACTERS,
    fixed.LABEL_DIGIT,
    fixed.LABEL_TAKEN,
)
RUN_LABEL = LabelMessages(
    fixed.REQUEST_LABEL_MISSING,
    fixed.REQUEST_LABEL_SPACES,
    fixed.REQUEST_LABEL_CHARACTERS,
    fixed.REQUEST_LABEL_DIGIT,
    fixed.REQUEST_LABEL_TAKEN,
)


def label_error(
    label: Column, taken: Column, messages: LabelMessages = DATASET_LABEL
) -> Column:
    """The first rule a label breaks, null when it breaks none."""
    return (
        F.when(F.coalesce(label, F.lit("")) == "", messages.missing)
        .when(has_space(label), messages.spaces)
        .when(~is_alphanumeric(label), messages.characters)
        .when(starts_with_digit(label), messages.digit)
        .when(taken, messages.taken)
    )


def look_up(df: DataFrame, known: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Left join of ``df`` with ``known``, which has one row per key.

    ``keys`` maps columns of ``df`` to columns of ``known``, which are dropped. A plain
    equality join: Spark broadcasts ``known`` when its measured size allows, and else
    shuffles both sides for this join alone, so that adaptive execution can split the
    partition of a key that very many rows hold.
    """
    renamed = known.withColumnsRenamed({theirs: f"known_{theirs}" for theirs in keys.values()})
    condition = [F.col(ours) == F.col(f"known_{theirs}") for ours, theirs in keys.items()]
    return df.join(renamed, condition, "left").drop(*[f"known_{theirs}" for theirs in keys.values()])


def with_existence(df: DataFrame, known: DataFrame, keys: dict[str, str], flag: str) -> DataFrame:
    """Adds ``flag``: whether the row's keys occur in ``known``."""
    present = known.select(*keys.values()).distinct().withColumn(flag, F.lit(True))
    return look_up(df, present, keys).withColumn(flag, F.coalesce(flag, F.lit(False)))


def known_only(df: DataFrame, known: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Rows whose keys occur in ``known``."""
    names = known.select(*[F.col(theirs).alias(ours) for ours, theirs in keys.items()])
    return df.join(names, list(keys), "left_semi")


def first_of_batch(checked: DataFrame, key: list[str], valid: Column, order: str) -> DataFrame:
    """Adds ``earlier``: whether an earlier row that is valid by itself has the key.

    One aggregate by key, looked up again, so a key that very many rows hold is never
    gathered in one place.
    """
    first = (
        checked.filter(valid).groupBy(*key).agg(F.min(order).alias("first_of_key"))
    )
    found = look_up(checked, first, {name: name for name in key})
    earlier = F.coalesce(F.col("first_of_key") < F.col(order), F.lit(False))
    return found.withColumn("earlier", earlier).drop("first_of_key")


def check_labels(
    labels: DataFrame,
    known: DataFrame,
    messages: LabelMessages = DATASET_LABEL,
    order: str = "seq",
    later_error: str | None = None,
) -> DataFrame:
    """``labels`` (user, label and ``order``) with an ``error`` column; ``known`` has the
    first two.

    Rows count one after another by ``order``, which differs between rows of one key: a
    label is taken when an earlier row of the batch got it. ``later_error`` names a column
    with what else is wrong with a row; it counts after the label's own rules.
    """
    key = {"user": "user", "label": "label"}
    flagged = with_existence(labels, known, key, "taken")
    alone = label_error(F.col("label"), F.col("taken"), messages)
    rest = F.col(later_error) if later_error else F.lit(None).cast("string")
    flagged = first_of_batch(flagged, list(key), F.coalesce(alone, rest).isNull(), order)
    taken = F.col("taken") | F.col("earlier")
    error = F.coalesce(label_error(F.col("label"), taken, messages), rest)
    return flagged.withColumn("error", error).drop("taken", "earlier")


def check_requests(
    requests: DataFrame,
    catalog: DataFrame,
    runs: DataFrame,
    form_bounds: bool = True,
    order: str = "seq",
) -> DataFrame:
    """Clustering requests with an ``error`` column, null for a valid request.

    ``requests``: user, dataset_label, clusters, algorithm, headers (JSON list),
    cluster_label, max_iterations (both numbers as text), workers and ``order``, by which
    they count one after another: a run label is taken when an earlier valid request of
    the batch has it. ``order`` differs between requests of one user and label.
    ``catalog``: user, label, lines, headers; unique per (user, label).
    ``runs``: user, label of the runs so far.
    ``form_bounds`` adds the limits that a request form sets by itself: the
    smallest numbers, a known algorithm, features from the dataset's headers, and a live
    worker. What is null is not enough for a rule.
    """
    datasets = catalog.select(
        "user",
        "label",
        F.col("lines").alias("dataset_lines"),
        F.col("headers").alias("dataset_headers"),
        F.lit(True).alias("dataset_known"),
    )
    joined = look_up(requests, datasets, {"user": "user", "dataset_label": "label"})
    joined = with_existence(
        joined, runs, {"user": "user", "cluster_label": "label"}, "run_known"
    )
    features = F.coalesce(parse_list(F.col("headers")), F.array().cast("array<string>"))
    clusters = to_int(F.col("clusters"))
    max_iterations = to_int(F.col("max_iterations"))

    def error(taken: Column) -> Column:
        label = label_error(F.col("cluster_label"), taken, RUN_LABEL)
        found = (
            F.when(F.col("dataset_known").isNull(), fixed.REQUEST_DATASET)
            .when(clusters.isNull() | (F.col("clusters") == "0"), fixed.REQUEST_CLUSTERS)
            .when(F.coalesce("algorithm", F.lit("")) == "", fixed.REQUEST_ALGORITHM)
            .when(F.size(F.array_distinct(features)) < 2, fixed.REQUEST_FEATURES)
            .when(label.isNotNull(), label)
            .when(
                max_iterations.isNull() | (F.col("max_iterations") == "0"),
                fixed.REQUEST_MAX_ITERATIONS,
            )
            .when(clusters > F.coalesce("dataset_lines", F.lit(0)), fixed.REQUEST_ROWS)
        )
        if not form_bounds:
            return found
        known = F.coalesce("dataset_headers", F.array().cast("array<string>"))
        return (
            found.when(
                clusters < fixed.MIN_CLUSTERS,
                f"At least {fixed.MIN_CLUSTERS} clusters are required",
            )
            .when(
                max_iterations < fixed.MIN_MAX_ITERATIONS,
                f"At least {fixed.MIN_MAX_ITERATIONS} iterations are required",
            )
            .when(~F.col("algorithm").isin(NAMES), fixed.REQUEST_ALGORITHM_UNKNOWN)
            .when(
                F.size(F.array_except(features, known)) > 0,
                "Features must be headers of the dataset",
            )
            .when(F.coalesce("workers", F.lit(0)) <= 0, "No worker is available")
        )

    joined = first_of_batch(
        joined, ["user", "cluster_label"], error(F.col("run_known")).isNull(), order
    )
    taken = F.col("run_known") | F.col("earlier")
    return joined.withColumn("error", error(taken)).drop(
        "dataset_known", "dataset_lines", "dataset_headers", "run_known", "earlier"
    )
