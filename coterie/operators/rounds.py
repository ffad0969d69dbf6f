"""Bisecting K-Means and the Gaussian mixture, by rounds over blocks of rows.

The rounds, starts and rules are those of Spark's own estimators, and so are the models.
Theirs keep an object for each row and take rows one at a time in every round; here a task
packs its vectors into blocks of numbers once, which take eight bytes a number, and a
round is array arithmetic on whole blocks. Tasks return sums alone, which the driver adds
in the order of the partitions.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.errors import IllegalArgumentException
from pyspark.ml import clustering as library
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.sql import DataFrame, Row

from coterie.session import ship

EPSILON = float(np.finfo(float).eps)
MOST_LEVELS = 63  # numbers of nodes are longs
TOGETHER = 8  # partitions of rows to one of blocks, while every core has two
MOST_SUMS = 8_000_000  # numbers that reach the driver in a round
BLOCK = "width int, block binary"


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block for each batch of vectors: all first numbers, then all second ones, and so on."""
    for batch in batches:
        vectors = batch.column(0)
        if not len(vectors):
            continue
        if vectors.null_count:
            raise ValueError("a vector is null")
        widths = np.diff(vectors.offsets.to_numpy())
        if widths.min() != widths.max():
            raise ValueError("vectors of different lengths")
        rows = vectors.flatten().to_numpy().reshape(len(vectors), -1)
        if not np.isfinite(rows).all():
            raise ValueError("a vector holds NaN or infinite numbers")
        block = np.ascontiguousarray(rows.T, dtype="<f8").tobytes()
        columns = [pa.array([rows.shape[1]], pa.int32()), pa.array([block], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["width", "block"])


def array(block: Row) -> np.ndarray:
    """A row of ``pack`` as an array with a line for each column."""
    return np.frombuffer(block["block"], "<f8").reshape(block["width"], -1)


@contextmanager
def packed(rows: DataFrame) -> Iterator[RDD]:
    """The vectors in blocks, held in memory, and on disk where that does not suffice. As a
    block is far smaller than its rows were, a task takes up to eight of their partitions."""
    spark = rows.sparkSession
    ship(spark)
    tasks = max(2 * spark.sparkContext.defaultParallelism, math.ceil(rows.rdd.getNumPartitions() / TOGETHER))
    arrays = rows.select(vector_to_array("features").alias("values"))
    blocks = arrays.coalesce(tasks).mapInArrow(pack, BLOCK).rdd.map(array)
    blocks.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield blocks
    finally:
        blocks.unpersist()


def add_blocks(
    sums: Callable[[np.ndarray], np.ndarray], blocks: Iterator[np.ndarray]
) -> Iterator[np.ndarray]:
    """The sums over the blocks of a task, if it has any."""
    total = None
    for block in blocks:
        part = sums(block)
        total = part if total is None else total + part
    if total is not None:
        yield total


def one_round(blocks: RDD, sums: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sums, ``size`` numbers, over all blocks. Where many tasks had many to return,
    fewer tasks take more blocks each."""
    most = max(blocks.context.defaultParallelism, MOST_SUMS // size)
    if blocks.getNumPartitions() > most:
        blocks = blocks.coalesce(most)
    found = blocks.mapPartitions(partial(add_blocks, sums)).collect()
    if not found:
        raise ValueError("there are no rows to fit")
    return sum(found)


def width_of(blocks: RDD) -> int:
    found = blocks.map(len).distinct(1).collect()
    if len(found) != 1:
        raise ValueError("vectors of different lengths" if found else "there are no rows to fit")
    return found[0]


class Estimator:
    """The settings of both, which are set as those of Spark's own are."""

    k = max_iter = 2
    seed = 0

    def setK(self, k: int):
        self.k = k
        return self

    def setMaxIter(self, max_iter: int):
        self.max_iter = max_iter
        return self

    def setSeed(self, seed: int):
        self.seed = seed
        return self

    def finished(self, wrapper, java_model, summary, rows: DataFrame):
        """The model in Python, with its settings and its summary."""
        model = wrapper(java_model)
        model._set(k=self.k, maxIter=self.max_iter, seed=self.seed)
        labelled = model.transform(rows)._jdf
        java_model.setSummary(rows.sparkSession._jvm.scala.Some(summary(labelled)))
        return model


# --- bisecting K-Means --------------------------------------------------------


def nodes_of(block: np.ndarray, splits: dict[int, dict[int, np.ndarray]]) -> np.ndarray:
    """The node of each row. Node 1 has all rows; ``splits`` holds a node's children,
    2 n and 2 n + 1, with their centres, and a row goes to the nearer one."""
    at = np.ones(block.shape[1], np.int64)
    for node in sorted(splits):
        rows = slice(None) if node == 1 else np.flatnonzero(at == node)
        part = block[:, rows]
        (left, *right), (centre, *other) = splits[node], splits[node].values()
        nearer = squares(part - other[0][:, None]) < squares(part - centre[:, None]) if right else False
        at[rows] = np.where(nearer, right[0] if right else left, left)
    return at


def squares(away: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->j", away, away)


def node_sums(
    splits: dict[int, dict[int, np.ndarray]], centres: dict[int, np.ndarray], block: np.ndarray
) -> np.ndarray:
    """For each node in ``centres`` its rows, the sum of their distances from the centre by
    column, and that of their squared distances."""
    at, width = nodes_of(block, splits), len(block)
    found = np.zeros((len(centres), width + 2))
    for sums, (node, centre) in zip(found, centres.items()):
        away = block.take(np.flatnonzero(at == node), axis=1) - centre[:, None]
        sums[0], sums[1:-1], sums[-1] = away.shape[1], away.sum(axis=1), np.vdot(away, away)
    return found.ravel()


class BisectingKMeans(Estimator):
    def fit(self, rows: DataFrame) -> library.BisectingKMeansModel:
        """As Spark's own: from one cluster of all rows, level by level, clusters are halved
        by ``max_iter`` rounds each, the largest ones where not all need be."""
        if self.k < 2 or self.max_iter < 1:
            raise IllegalArgumentException("at least two clusters and one round are needed")
        random = rows.sparkSession._jvm.java.util.Random(self.seed)
        with packed(rows) as blocks:
            nodes = self.halved(blocks, random)
        return self.model(rows, nodes)

    def halved(self, blocks: RDD, random) -> dict[int, tuple]:
        """Size, centre and cost of every node, inner ones too."""
        def summaries(splits, centres):
            """Size, centre and cost of each node that has rows."""
            found = one_round(blocks, partial(node_sums, splits, centres), len(centres) * (width + 2))
            return {
                node: (int(sums[0]), centre + sums[1:-1] / sums[0], max(0.0, sums[-1] - sums[1:-1] @ sums[1:-1] / sums[0]))
                for (node, centre), sums in zip(centres.items(), found.reshape(len(centres), -1))
                if sums[0]
            }

        width = width_of(blocks)
        active = summaries({}, {1: np.zeros(width)})
        active = summaries({}, {1: active[1][1]})  # the cost from rows about their mean
        nodes, splits, needed, level = dict(active), {}, self.k - 1, 1
        while needed > 0 and level < MOST_LEVELS:
            divisible = [n for n, (size, _, cost) in active.items() if cost > EPSILON * size]
            if len(divisible) > needed:
                divisible = sorted(divisible, key=lambda n: -active[n][0])[:needed]
            if not divisible:
                break
            centres = {}
            for node in divisible:
                centre = active[node][1]
                noise = np.array([random.nextDouble() for _ in range(width)])
                noise *= 1e-4 * math.sqrt(centre @ centre)
                centres |= {2 * node: centre - noise, 2 * node + 1: centre + noise}
            for _ in range(self.max_iter):
                level_splits = splits | children_of(divisible, centres)
                active = summaries(level_splits, centres)
                centres = {node: centre for node, (_, centre, _) in active.items()}
            splits |= children_of(divisible, centres)
            nodes |= active
            needed -= len(divisible)
            level += 1
        return nodes

    def model(self, rows: DataFrame, nodes: dict) -> library.BisectingKMeansModel:
        context = rows.sparkSession.sparkContext
        jvm, gateway = context._jvm, context._gateway
        old = jvm.org.apache.spark.mllib.clustering
        leaves, inner, cost = 0, -1, 0.0

        def tree(node: int):
            nonlocal leaves, inner, cost
            size, centre, own_cost = nodes[node]
            children = [n for n in (2 * node, 2 * node + 1) if n in nodes] if 2 * node in nodes else []
            if children:
                index, inner = inner, inner - 1
                height = max(math.dist(centre, nodes[n][1]) for n in children)
            else:
                index, leaves, height = leaves, leaves + 1, 0.0
                cost += own_cost
            below = gateway.new_array(old.ClusteringTreeNode, len(children))
            for place, child in enumerate(children):
                below[place] = tree(child)
            vector = old.VectorWithNorm(_py2java(context, Vectors.dense(centre)).toArray())
            return old.ClusteringTreeNode(index, size, vector, float(own_cost), float(height), below)

        root = tree(1)
        new = jvm.org.apache.spark.ml.clustering
        java_model = new.BisectingKMeansModel(
            f"BisectingKMeans_{uuid.uuid4().hex[:12]}", old.BisectingKMeansModel(root, "euclidean", float(cost))
        )

        def summary(labelled):
            return new.BisectingKMeansSummary(
                labelled, "prediction", "features", self.k, self.max_iter, float(cost)
            )

        return self.finished(library.BisectingKMeansModel, java_model, summary, rows)


def children_of(parents: list[int], centres: dict[int, np.ndarray]) -> dict[int, dict[int, np.ndarray]]:
    """For each parent its children that have rows, the left one first."""
    pairs = {node: {n: centres[n] for n in (2 * node, 2 * node + 1) if n in centres} for node in parents}
    return {node: children for node, children in pairs.items() if children}


# --- Gaussian mixture ---------------------------------------------------------


def density(mean: np.ndarray, covariance: np.ndarray) -> tuple[np.ndarray, float]:
    """The root of the covariance's (pseudo) inverse, and the logarithm of the density's
    factor. Directions without spread are left out."""
    spreads, directions = np.linalg.eigh(covariance)
    kept = spreads > EPSILON * spreads.max() * len(mean)
    root = directions[:, kept].T / np.sqrt(spreads[kept])[:, None]
    return root, -0.5 * (len(mean) * math.log(2 * math.pi) + np.log(spreads[kept]).sum())


def mixture_sums(parts: list[tuple], block: np.ndarray) -> np.ndarray:
    """The log-likelihood, then for each part, given as weight, mean, root and factor: its
    share of the rows, and the sums and products of their distances from its mean."""
    width, rows = block.shape
    shares = np.empty((len(parts), rows))
    for share, (weight, mean, root, factor) in zip(shares, parts):
        spread = root @ (block - mean[:, None])
        np.exp(factor - 0.5 * squares(spread), out=share)
        share *= weight
        share += EPSILON
    likelihoods = shares.sum(axis=0)
    shares /= likelihoods
    found = [[np.log(likelihoods).sum()]]
    for share, (_, mean, _, _) in zip(shares, parts):
        away = block - mean[:, None]
        found += [[share.sum()], away @ share, ((away * share) @ away.T).ravel()]
    return np.concatenate(found)


class GaussianMixture(Estimator):
    tolerance = 0.01  # the default of Spark's own

    def fit(self, rows: DataFrame) -> library.GaussianMixtureModel:
        """As Spark's own, from its start: rounds until the likelihood changes by no more
        than the tolerance, ``max_iter`` at most."""
        start = library.GaussianMixture(k=self.k, maxIter=0, seed=self.seed).fit(rows)
        weights = np.array(start.weights)
        shapes = [(one.mean.toArray(), one.cov.toArray()) for one in start.gaussians]
        likelihood, before, rounds = -np.finfo(float).max, 0.0, 0
        with packed(rows) as blocks:
            width = len(shapes[0][0])
            size = 1 + width + width * width
            while rounds < self.max_iter and abs(likelihood - before) > self.tolerance:
                parts = [(w, mean, *density(mean, c)) for w, (mean, c) in zip(weights, shapes)]
                found = one_round(blocks, partial(mixture_sums, parts), 1 + self.k * size)
                before, likelihood, rounds = likelihood, float(found[0]), rounds + 1
                sums = found[1:].reshape(self.k, size)
                weights = sums[:, 0] / sums[:, 0].sum()
                moved = [(one[1 : 1 + width] / one[0], one[1 + width :].reshape(width, width) / one[0]) for one in sums]
                shapes = [(mean + by, square - np.outer(by, by)) for (mean, _), (by, square) in zip(shapes, moved)]
        return self.model(rows, weights, shapes, likelihood, rounds)

    def model(self, rows: DataFrame, weights, shapes, likelihood: float, rounds: int):
        context = rows.sparkSession.sparkContext
        jvm, gateway = context._jvm, context._gateway
        new = jvm.org.apache.spark.ml
        gaussian = new.stat.distribution.MultivariateGaussian
        gaussians = gateway.new_array(gaussian, self.k)
        for place, (mean, covariance) in enumerate(shapes):
            matrix = DenseMatrix(len(mean), len(mean), covariance.ravel(order="F"))
            gaussians[place] = gaussian(_py2java(context, Vectors.dense(mean)), _py2java(context, matrix))
        java_model = new.clustering.GaussianMixtureModel(
            f"GaussianMixture_{uuid.uuid4().hex[:12]}", _py2java(context, Vectors.dense(weights)).toArray(), gaussians
        )

        def summary(labelled):
            return new.clustering.GaussianMixtureSummary(
                labelled, "prediction", "probability", "features", self.k, likelihood, rounds
            )

        return self.finished(library.GaussianMixtureModel, java_model, summary, rows)
