"""The clustering job: dataset in, labelled rows, score and fit time out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from coterie.functions import fixed
from coterie.operators import clustering
from coterie.operators.features import assemble
from coterie.operators.runs import RUN_EVENTS_SCHEMA
from coterie.sources.csv import write_labelled
from coterie.sources.ledgers import append_few


@dataclass(frozen=True)
class ClusterResult:
    labelled: DataFrame
    silhouette: float
    seconds: float
    quality: float
    model: object


def cluster(
    df: DataFrame,
    features: Sequence[str],
    algorithm: str,
    k: int,
    max_iter: int,
    seed: int = clustering.DEFAULT_SEED,
    handle_invalid: str = "error",
    partitions: int | None = None,
    solver: str = "block",
) -> ClusterResult:
    """Fits on the feature columns and labels the whole rows. ``partitions`` as in
    ``clustering.held``, ``solver`` as in ``clustering.fit``.

    Only the feature vectors are held for the fit and the score. The labelled
    rows are a projection of the input: they are read again when written, and
    no copy of the wide rows is kept.
    """
    vectors = assemble(df, features, handle_invalid, keep_input=False)
    labelled_input = assemble(df, features, handle_invalid)
    with clustering.held(vectors, partitions) as kept:
        fitted = clustering.fit(kept, algorithm, k, max_iter, seed, solver)
        score = clustering.silhouette(clustering.assign(fitted.model, kept))
    return ClusterResult(
        clustering.assign(fitted.model, labelled_input),
        score,
        fitted.seconds,
        fitted.quality,
        fitted.model,
    )


def run_event(spark: SparkSession, user: str, label: str, seq: int, action: str, **fields) -> DataFrame:
    """One row for the run ledger, with nulls for the fields not given."""
    at = datetime.now(timezone.utc)
    row = {"user": user, "label": label, "at": at, "seq": seq, "action": action, **fields}
    return spark.createDataFrame([row], RUN_EVENTS_SCHEMA)


def run_cluster_job(
    df: DataFrame,
    *,
    user: str,
    label: str,
    dataset_label: str,
    features: Sequence[str],
    algorithm: str,
    k: int,
    max_iter: int,
    result_path: str,
    ledger_path: str,
    seed: int = clustering.DEFAULT_SEED,
    partitions: int | None = None,
    solver: str = "block",
    multi_line: bool = False,
    row_index: str | None = None,
) -> ClusterResult:
    """``cluster``, with the labelled rows written and the run recorded: RUNNING
    first, then FINISHED with time and silhouette, or FAILED. ``multi_line`` as in
    ``sources.csv.write_csv``, ``row_index`` as in ``write_labelled``."""
    spark = df.sparkSession
    append_few(
        run_event(
            spark, user, label, 0, "put",
            dataset_label=dataset_label,
            algorithm=algorithm,
            clusters_amount=k,
            max_iterations=max_iter,
            headers=list(df.columns),
            features=list(features),
            date=datetime.now(timezone.utc),
            status=fixed.RUNNING,
        ),
        ledger_path,
    )
    try:
        result = cluster(
            df, features, algorithm, k, max_iter, seed, partitions=partitions, solver=solver
        )
        write_labelled(result.labelled, result_path, multi_line, row_index)
    except Exception:
        append_few(run_event(spark, user, label, 1, "set", status=fixed.FAILED), ledger_path)
        raise
    append_few(
        run_event(
            spark, user, label, 1, "set",
            status=fixed.FINISHED,
            time_taken=result.seconds,
            accuracy=result.silhouette,
        ),
        ledger_path,
    )
    return result
