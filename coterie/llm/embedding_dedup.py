"""Near-duplicate embeddings by randomised-rotation binary codes.

A unit vector is rotated at random; the signs of its components are its code, and
the inner product of the code with the vector is stored as its correction factor. Code
of one and rotated vector of the other give an unbiased estimate of their inner
product, with a confidence bound; a pair whose upper bound stays below the threshold is
dropped, all others are computed exactly in double precision. Nothing is linked on an
estimate.

Pairs to estimate are those that agree in a band of code bits. The width of the bands
follows the number of vectors, so buckets stay small, and their number follows from the
width, so that a pair right at the threshold is met with probability ``recall``. Buckets
that are large all the same are dealt out in blocks, and pairs of blocks are compared in
different tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.llm.components import components
from coterie.llm.tables import stage
from coterie.llm.vectors import matrix, usable

BLOCK = 1024  # vectors of one bucket that are compared in one go, twice that at most
SIGMAS = 3.0  # width of the confidence bound
SEED = 7


def rotations(width: int, bits: int) -> np.ndarray:
    """Stacked random rotations, at least ``bits`` rows; the first ``width`` are one."""
    rng = np.random.default_rng(SEED)
    count = max(1, -(-bits // width))
    return np.concatenate(
        [np.linalg.qr(rng.standard_normal((width, width)))[0] for _ in range(count)]
    )


def plan_bands(rows: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits in a band, bands): buckets of about 16, and ``recall`` at the threshold."""
    width = max(4, min(30, math.ceil(math.log2(max(rows, 2))) - 4))
    agree = (1 - math.acos(threshold) / math.pi) ** width
    return width, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def encode(width: int, band_bits: int, bands: int) -> Callable:
    """(vec_id, print, bands, factor, vector) of (vec_id, embedding)."""
    turn = rotations(width, band_bits * bands)
    powers = 1 << np.arange(band_bits, dtype=np.int64)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column(1), width)
            longest = np.abs(rows).max(axis=1, initial=0)
            scaled = rows / np.where(longest > 0, longest, 1)[:, None]
            length = np.linalg.norm(scaled, axis=1)
            unit = scaled / np.where(length > 0, length, 1)[:, None]
            rotated = unit @ turn.T
            signs = rotated > 0
            codes = signs[:, : band_bits * bands].reshape(-1, bands, band_bits) @ powers
            factor = np.abs(rotated[:, :width]).sum(axis=1) / math.sqrt(width)
            prints = [xxhash.xxh3_128_digest(one.tobytes()) if n else None for one, n in zip(rows, length)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(prints, pa.binary()),
                    pa.array(list(codes.astype(np.int32)), pa.list_(pa.int32())),
                    pa.array(factor),
                    pa.array([one.tobytes() for one in unit], pa.binary()),
                ],
                names=["vec_id", "print", "bands", "factor", "vector"],
            )

    return apply


def upper_bounds(unit: np.ndarray, other: np.ndarray, factor: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Estimates of inner products by the codes of ``unit``, plus their confidence."""
    width = turn.shape[1]
    codes = np.where(unit @ turn.T > 0, 1, -1) / math.sqrt(width)
    estimate = codes @ (other @ turn.T).T / factor[:, None]
    spread = np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(max(1, width - 1))
    return estimate + SIGMAS * spread[:, None]


def compare(width: int, threshold: float) -> Callable:
    """Rows (item, links, root) of sorted bucket rows, one for each vector with a link.

    A pair counts in the first band in which it agrees, so in one bucket only.
    """
    turn = rotations(width, width)[:width]

    def run(rows: dict[str, np.ndarray], first: int, second: int, band: int):
        left = np.flatnonzero(rows["block"] == first)
        right = np.flatnonzero(rows["block"] == second)
        a, b = rows["vector"][left], rows["vector"][right]
        upper = np.maximum(
            upper_bounds(a, b, rows["factor"][left], turn),
            upper_bounds(b, a, rows["factor"][right], turn).T,
        )
        x, y = np.nonzero(upper >= threshold)
        keep = x < y if first == second else np.ones(len(x), np.bool_)
        x, y = x[keep], y[keep]
        exact = np.concatenate(
            [
                np.einsum("ij,ij->i", a[x[k : k + 65536]], b[y[k : k + 65536]])
                for k in range(0, len(x), 65536)
            ]
            or [np.empty(0)]
        )
        x, y = left[x[exact >= threshold]], right[y[exact >= threshold]]
        if band:
            bands = rows["bands"]
            new = ~(bands[x, :band] == bands[y, :band]).any(axis=1)
            x, y = x[new], y[new]
        if not len(x):
            return None
        size = len(rows["item"])
        links = np.bincount(x, rows["weight"][y], size) + np.bincount(y, rows["weight"][x], size)
        root = np.arange(size)
        while True:  # the smallest place that links reach
            low = np.minimum(root[x], root[y])
            before = root.copy()
            np.minimum.at(root, x, low)
            np.minimum.at(root, y, low)
            if (before == root).all():
                break
        some = np.flatnonzero(links)
        return rows["item"][some], links[some].astype(np.int64), rows["item"][root[some]]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            yield from close(held, False)
            held = held.slice(held.num_rows - tail(held))
        if held is not None:
            yield from close(held, True)

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        return np.stack([batch.column(k).to_numpy() for k in range(4)])

    def tail(batch: pa.RecordBatch) -> int:
        """Rows of the last key, which may go on in the next batch."""
        k = keys(batch)
        change = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0))
        return batch.num_rows - (change[-1] + 1 if len(change) else 0)

    def close(batch: pa.RecordBatch, all_of_it: bool) -> Iterator[pa.RecordBatch]:
        end = batch.num_rows - (0 if all_of_it else tail(batch))
        if not end:
            return
        k = keys(batch.slice(0, end))
        begins = np.flatnonzero(np.r_[True, (k[:, 1:] != k[:, :-1]).any(axis=0)])
        ends = np.r_[begins[1:], end]
        found = []
        for begin, stop in zip(begins, ends):
            if stop - begin < 2:
                continue
            part = batch.slice(begin, stop - begin)
            rows = {
                "block": part.column(4).to_numpy(),
                "item": part.column(5).to_numpy(),
                "weight": part.column(6).to_numpy(),
                "factor": part.column(7).to_numpy(),
                "bands": np.asarray(part.column(8).flatten()).reshape(stop - begin, -1),
                "vector": np.frombuffer(b"".join(part.column(9).to_pylist())).reshape(-1, width),
            }
            out = run(rows, int(k[2, begin]), int(k[3, begin]), int(k[0, begin]))
            if out:
                found.append(out)
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(one)) for one in zip(*found)], names=["item", "links", "root"]
            )

    return apply


def bucket_rows(classes: DataFrame) -> DataFrame:
    """A row for each vector, band and pair of blocks that it is compared in."""
    rows = classes.select(
        "item", "weight", "factor", "bands", "vector", F.posexplode("bands").alias("band", "bucket")
    )
    large = (
        classes.select(F.posexplode("bands").alias("band", "bucket"))
        .groupBy("band", "bucket")
        .count()
        .where(F.col("count") > BLOCK)
        .select("band", "bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    )
    dealt = rows.join(stage(large, "large-buckets"), ["band", "bucket"], "left").withColumn(
        "blocks", F.coalesce("blocks", F.lit(1))
    )
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    return dealt.select(
        "band",
        "bucket",
        F.least("block", "other").alias("first"),
        F.greatest("block", "other").alias("second"),
        "block",
        "item",
        "weight",
        "factor",
        "bands",
        "vector",
    )


def link_embeddings(
    vectors: DataFrame, threshold: float = 0.9, recall: float = 0.95
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row with an ``embedding``.

    Two rows link when they are met and the cosine of their vectors, in double
    precision, is ``threshold`` or more. ``n_links`` counts the other rows that link with
    a row, ``component_id`` is the smallest vec_id reachable, itself included, and
    ``kept`` says that it is the row's own. A vector that is null or zero, or holds null
    or non-finite components, links with nothing. Shorter vectors count as ending in
    zeros. Equal vectors are compared once, with their number as weight. Rows that share
    a vec_id are vectors of their own; a null vec_id is never the smallest, and what has
    no other has a null component and is not kept. Other columns are not looked at.
    """
    spark, id_type = vectors.sparkSession, vectors.schema["vec_id"].dataType.simpleString()
    source = vectors.select("vec_id", F.when(usable("embedding"), F.col("embedding")).alias("embedding"))
    rows, width = source.agg(F.count("embedding"), F.max(F.size("embedding"))).first()
    width = max(1, width or 1)
    band_bits, bands = plan_bands(rows, threshold, recall)
    codes = stage(
        source.mapInArrow(
            encode(width, band_bits, bands),
            f"vec_id {id_type}, print binary, bands array<int>, factor double, vector binary",
        ),
        "codes",
    )
    classes = stage(
        codes.where("print is not null")
        .groupBy("print")
        .agg(
            F.min("vec_id").alias("first_id"),
            F.count("*").alias("weight"),
            F.first(F.struct("bands", "factor", "vector")).alias("code"),
        )
        .select(F.xxhash64("print").alias("item"), "print", "first_id", "weight", "code.*"),
        "vector-classes",
    )
    found = stage(
        bucket_rows(classes)
        .repartition("band", "bucket", "first", "second")
        .sortWithinPartitions("band", "bucket", "first", "second")
        .mapInArrow(compare(width, threshold), "item bigint, links bigint, root bigint"),
        "vector-links",
    )
    roots = components(found.select(F.col("item").alias("a"), F.col("root").alias("b")))
    counted = found.groupBy("item").agg(F.sum("links").alias("links"))
    named = (
        classes.select("item", "print", "first_id", "weight")
        .join(counted, "item", "left")
        .join(roots.select(F.col("node").alias("item"), "root"), "item", "left")
        .withColumn("root", F.coalesce("root", "item"))
    )
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_class = stage(
        named.join(least, "root").select(
            "print", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")
        ),
        "vector-components",
    )
    return (
        codes.select("vec_id", "print")
        .join(of_class, "print", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            F.when(F.col("print").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )
