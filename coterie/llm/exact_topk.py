"""Exact top-k by inner product: long vectors first, pruned by Cauchy-Schwarz bounds.

Candidates are sorted by descending length. Vectors are rotated by the right singular
vectors of all candidates, so that a few leading components carry most of an inner
product; leading part plus the product of the rests' lengths bounds it from above. A
block of candidates whose length alone cannot reach a query's k-th score is passed over
for it, and of the others only those whose bound reaches it are scored exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coterie.llm.tables import stage
from coterie.llm.vectors import matrix, usable

QUERY_BLOCK = 4096  # queries that are broadcast at once, about
SEEDS = 2048  # longest candidates, which give each query its first threshold
STEP = 1024  # candidates that are bounded in one go
LEAD = 0.25  # share of the components in the leading part
EXACT = 2**53
LONG = (-(2**63), 2**63 - 1)
NINES = str.maketrans("0123456789", "9876543210")
MOST = 1e150  # larger components count as this, so that products stay finite


def prepare(width: int) -> Callable:
    """(vec_id, length, vector) with components floor(1024 * x), kept as doubles."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = np.floor(1024 * np.clip(matrix(batch.column(1), width), -MOST, MOST))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(lengths(whole)),
                    pa.array([one.tobytes() for one in whole], pa.binary()),
                ],
                names=["vec_id", "length", "vector"],
            )

    return apply


def lengths(rows: np.ndarray) -> np.ndarray:
    longest = np.abs(rows).max(axis=1, initial=0)
    safe = np.where(longest > 0, longest, 1)
    return np.linalg.norm(rows / safe[:, None], axis=1) * longest


def unpack(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist())).reshape(-1, width)


def gram(width: int) -> Callable:
    """A task's sum of outer products of unit vectors, as (place, value)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            rows = unpack(batch.column(1), width)
            length = batch.column(0).to_numpy()
            rows = rows / np.where(length > 0, length, 1)[:, None]
            total += rows.T @ rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width * width)), pa.array(total.ravel())], names=["place", "value"]
        )

    return apply


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of integer-valued doubles, one row for each query.

    Doubles hold them exactly unless components are very large; then Python's integers
    do.
    """
    most = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * queries.shape[1]
    if most < EXACT:
        return (queries @ rows.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return whole(queries) @ whole(rows).T


def sort_text(score: int) -> str:
    """A text that orders as the score does, however large that is."""
    digits = str(abs(score))
    if score >= 0:
        return f"1{len(digits):04}{digits}"
    return f"0{9999 - len(digits):04}{digits.translate(NINES)}"


def at_most(score: int) -> float:
    """The double next to the score that is not above it."""
    near = float(score)
    return near if near <= score else float(np.nextafter(near, -np.inf))


class Best:
    """The k best (score, id) of each query so far; ties go to smaller ids.

    ``least`` is the k-th best score, or the double next below where none is equal to it.
    """

    def __init__(self, ids: np.ndarray, k: int, least: np.ndarray):
        self.ids, self.k, self.least = ids, k, least.astype(np.float64)
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]

    def add(self, query: int, new_scores: np.ndarray, new_ids: np.ndarray) -> None:
        reached = (new_scores >= self.least[query]).astype(np.bool_)
        keep = (new_ids != self.ids[query]) & reached
        if keep.any():
            both = self.found[query] + [(-s, i) for s, i in zip(new_scores[keep].tolist(), new_ids[keep].tolist())]
            self.found[query] = both = sorted(both)[: self.k]
            if len(both) == self.k:
                self.least[query] = max(self.least[query], at_most(-both[-1][0]))


def search(state, k: int) -> Callable:
    """Each task's best candidates for every query of the block."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, least, turn = state.value
        width = queries.shape[1]
        lead = max(1, int(LEAD * width))
        best = Best(ids, k, least)
        turned = queries @ turn
        rest, whole = lengths(turned[:, lead:]), lengths(queries)
        for batch in batches:
            rows, row_ids = unpack(batch.column(2), width), batch.column(0).to_numpy()
            length = batch.column(1).to_numpy()
            for begin in range(0, len(rows), STEP):
                part = slice(begin, begin + STEP)
                slack = 1 + 1e-9  # bounds are computed in doubles
                live = np.flatnonzero(whole * length[part].max() * slack >= best.least)
                if not len(live):
                    continue
                chosen = rows[part]
                moved = chosen @ turn
                bound = turned[live, :lead] @ moved[:, :lead].T
                bound += rest[live, None] * lengths(moved[:, lead:])[None, :]
                bound += 1e-9 * whole[live, None] * length[part][None, :]
                reach = ~(bound < best.least[live, None])
                some = np.flatnonzero(reach.any(axis=0))
                if not len(some):
                    continue
                exact = scores(queries[live], chosen[some])
                own = row_ids[part][some]
                for row, query in enumerate(live):
                    hit = reach[row, some]
                    if hit.any():
                        best.add(query, exact[row, hit], own[hit])
        out = [(q, -s, i) for q, one in zip(ids.tolist(), best.found) for s, i in one]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([row[0] for row in out], pa.int64()),
                pa.array([min(max(row[1], LONG[0]), LONG[1]) for row in out], pa.int64()),
                pa.array([row[2] for row in out], pa.int64()),
                pa.array([sort_text(row[1]) for row in out], pa.string()),
            ],
            names=["query_id", "score", "vec_id", "sorts"],
        )

    return apply


def first_thresholds(queries: np.ndarray, ids: np.ndarray, seeds: list, k: int, width: int) -> np.ndarray:
    """The k-th best score among the longest candidates; lowest where there are fewer."""
    least = np.full(len(ids), -np.inf)
    if seeds:
        rows = np.frombuffer(b"".join(row.vector for row in seeds)).reshape(-1, width)
        own = np.array([row.vec_id for row in seeds])
        best = Best(ids, k, least)
        exact = scores(queries, rows)
        for query in range(len(ids)):
            best.add(query, exact[query], own)
        least = best.least
    return least


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query, exactly.

    Both frames have ``vec_id`` (integers) and ``embedding``. Components become
    floor(1024 * x) with x as a double, components beyond 1e150 counting as that; the score
    is the inner product, and ties go to the smaller vec_id. Scores that no long can hold are
    ordered by what they are and given as the nearest long. Candidates are all rows of ``vectors`` but those with the
    query's vec_id, repeated rows one by one; a query with fewer gets all. Vectors that
    are null or hold null or non-finite components take no part, nor do null ids.
    Shorter vectors count as ending in zeros. Where query rows share a vec_id, the least
    of their vectors is the query. Other columns are not looked at.

    Queries are searched in blocks of about ``QUERY_BLOCK``, which are all that is
    broadcast; each block passes once over the candidates.
    """
    spark = vectors.sparkSession
    wanted = usable("embedding") & F.col("vec_id").isNotNull()
    clean = [
        frame.where(wanted).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
        for frame in (vectors, queries)
    ]
    width = max([1, *(frame.agg(F.max(F.size("embedding"))).first()[0] or 0 for frame in clean)])
    shape = "vec_id bigint, length double, vector binary"
    rows, asked = (frame.mapInArrow(prepare(width), shape) for frame in clean)
    ordered = stage(
        rows.repartitionByRange(F.desc("length"), F.xxhash64("vec_id")).sortWithinPartitions(
            F.desc("length"), "vec_id"
        ),
        "by-length",
    )
    sums = ordered.select("length", "vector").mapInArrow(gram(width), "place bigint, value double")
    total = np.zeros(width * width)
    for row in sums.groupBy("place").agg(F.sum("value").alias("value")).collect():
        total[row.place] = row.value
    turn = np.linalg.eigh(total.reshape(width, width))[1][:, ::-1].copy()
    seeds = ordered.orderBy(F.desc("length"), "vec_id", "vector").limit(SEEDS).collect()

    asked = stage(asked.groupBy("vec_id").agg(F.min("vector").alias("vector")), "queries")
    count = asked.count()
    blocks = -(-count // QUERY_BLOCK)
    found = spark.createDataFrame([], "query_id bigint, score bigint, vec_id bigint, sorts string")
    for block in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).collect()
        ids = np.array([row.vec_id for row in some], np.int64)
        if not len(ids):
            continue
        values = np.frombuffer(b"".join(bytes(row.vector) for row in some)).reshape(-1, width)
        least = first_thresholds(values, ids, seeds, k, width)
        state = spark.sparkContext.broadcast((ids, values, least, turn))
        part = ordered.mapInArrow(search(state, k), found.schema)
        found = found.unionByName(stage(part, "top-part"))
    place = Window.partitionBy("query_id").orderBy(F.desc("sorts"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(place))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
