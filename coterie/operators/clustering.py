"""The three clustering algorithms behind one registry, and their scores."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

from py4j.protocol import Py4JError
from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from coterie.functions import fixed
from coterie.operators.rounds import BisectingKMeans, GaussianMixture

DEFAULT_SEED = 1
SPREAD, SPREAD_ROWS = 64, 25_000  # partitions an input of few is dealt out to, and rows in each


@dataclass(frozen=True)
class Algorithm:
    """``name`` is what ledgers hold, ``title`` what people see and request."""

    name: str
    title: str
    estimator: Callable[[], Any]
    quality: Callable[[Any], float]


@dataclass(frozen=True)
class Fit:
    algorithm: Algorithm
    model: Any
    seconds: float
    quality: float


ALGORITHMS = (
    Algorithm(
        fixed.KMEANS,
        fixed.KMEANS_TITLE,
        KMeans,
        lambda model: model.summary.trainingCost,
    ),
    Algorithm(
        fixed.BISECTING,
        fixed.BISECTING_TITLE,
        BisectingKMeans,
        lambda model: model.summary.trainingCost,
    ),
    Algorithm(
        fixed.MIXTURE,
        fixed.MIXTURE_TITLE,
        GaussianMixture,
        lambda model: model.summary.logLikelihood,
    ),
)


def algorithm(name: str) -> Algorithm:
    """By ledger name or by title."""
    for entry in ALGORITHMS:
        if name in (entry.name, entry.title):
            return entry
    raise ValueError(f"unknown algorithm: {name}")


def placed(vectors: DataFrame, partitions: int) -> DataFrame:
    """The vectors in a fixed number of partitions, dealt and sorted by their values.

    Estimators draw at random by partition, so a seed gives the same model again only
    for the same rows in the same places, wherever the rows come from.
    """
    values = vector_to_array("features")
    return (
        vectors.withColumn("values", values)
        .repartition(partitions, "values")
        .sortWithinPartitions("values")
        .drop("values")
    )


@contextmanager
def held(vectors: DataFrame, partitions: int | None = None) -> Iterator[DataFrame]:
    """The vectors persisted and counted, so that a timed fit measures the fit and not
    the scan. They lie on the executors' disks: a fit keeps the decoded rows in memory, see
    ``fit``, and that is the only copy there. Partitions of a lost executor are computed
    again from the source.

    The partitions are the input's own, whatever the cluster, but for an input of fewer
    than 64 that hold more than 25,000 rows each, such as a single file: it is dealt out
    to as many as its rows need. With ``partitions`` it is dealt out to that many, see
    ``placed``; give a number where fits must repeat.
    """
    kept = vectors if partitions is None else placed(vectors, partitions)
    kept = kept.persist(StorageLevel.DISK_ONLY)
    try:
        wanted = min(SPREAD, math.ceil(kept.count() / SPREAD_ROWS))
        if partitions is None and kept.rdd.getNumPartitions() < wanted:
            few, kept = kept, placed(kept, wanted).persist(StorageLevel.DISK_ONLY)
            kept.count()
            few.unpersist()
        yield kept
    finally:
        kept.unpersist()


def fit(
    vectors: DataFrame,
    name: str,
    k: int,
    max_iter: int,
    seed: int = DEFAULT_SEED,
    solver: str = "block",
) -> Fit:
    """Fits one algorithm; ``seconds`` covers the fit alone, which is the same for all
    three: the held rows are decoded once, and kept decoded, in blocks, while the estimator passes
    over them again and again.

    For the same rows in the same partitions, and the same seed, labels are the same again.
    Sums come from the partitions in any order, so ``quality`` agrees to some twelve digits.

    ``solver`` is for K-Means. "block" multiplies whole blocks of rows with the centres
    and takes about half the time on dense columns; it cannot leave clusters empty, so
    fewer distinct rows than clusters need "row".
    """
    chosen = algorithm(name)
    estimator = chosen.estimator().setK(k).setMaxIter(max_iter).setSeed(seed)
    by_block = chosen.name == fixed.KMEANS and solver == "block"
    if chosen.name == fixed.KMEANS:
        estimator = estimator.setSolver(solver)
    # With a frame that is not itself held the estimator holds what it decodes for the fit;
    # of one that is held it decodes the rows in every round. The held column selected alone,
    # under whatever name, counts as held; a constant beside it does not.
    vectors = vectors.select("features", F.lit(1.0).alias("once"))
    started = time.perf_counter()
    try:
        model = estimator.fit(vectors)
    except (Py4JError, PySparkException) as error:
        if not by_block:
            raise
        raise RuntimeError(
            "K-Means failed with the block solver; if there may be fewer distinct rows than "
            "clusters, pass solver='row'"
        ) from error
    seconds = time.perf_counter() - started
    return Fit(chosen, model, seconds, chosen.quality(model))


def assign(model: Any, df: DataFrame) -> DataFrame:
    """Adds ``prediction``, and ``probability`` for a mixture."""
    return model.transform(df)


def silhouette(labelled: DataFrame) -> float:
    """Mean silhouette with squared Euclidean distance.

    Two passes over the rows; only a count, a sum vector and a sum of squares per
    cluster leave the executors.
    """
    return ClusteringEvaluator(
        metricName="silhouette", distanceMeasure="squaredEuclidean"
    ).evaluate(labelled.select("features", "prediction"))
