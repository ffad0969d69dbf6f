"""N-gram Jaccard join: documents whose word shingles overlap, by a grouped prefix join.

A document's shingles are put in one order for all, rare ones first, and only a
prefix of them is joined: two sets that are similar enough share a shingle of their
prefixes. Documents with equal sets collapse into a class, classes with the same
prefix and size into a group. Groups that share a prefix shingle with no other are
done; the members of the rest are expanded, filtered by size and position, and
verified on their whole texts.

Links are wanted for the components they form, so members that are connected already
are not compared again. Each round compares the members of a shared shingle with one
pivot; a last round compares all that still lie in different components.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coterie.llm.components import components
from coterie.llm.tables import make_room, stage, utf8

CELL_BITS = 26  # of the sketch that orders shingles by frequency: 32 MB when broadcast
PART_BITS = 20
ROUNDS = 2
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words.

    Words are runs of anything but ``[\\x20\\x09-\\x0D]``, A-Z lowered. Fewer words than
    ``size`` make one shingle, none make none.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    size = min(size, len(words))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    last = len(words) - size + 1
    mixed = np.full(last, size, np.uint64)
    for k in range(size):
        mixed = (mixed ^ hashes[k : k + last]) * MIX
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64((1 << CELL_BITS) - 1)).astype(np.uint32)


def count_cells(size: int) -> Callable:
    """How many documents of a task have a shingle in each cell: steps between the cells
    of a part that have any, and their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        seen = [np.empty(0, np.uint32)]
        for batch in batches:
            seen += [cells(shingles(text, size)) for text in utf8(batch.column(0))]
        found, counts = np.unique(np.concatenate(seen), return_counts=True)
        ends = np.searchsorted(found >> np.uint32(PART_BITS), np.arange(1, (1 << CELL_BITS - PART_BITS) + 1))
        begin = 0
        for part, end in enumerate(ends.tolist()):
            if end > begin:
                steps = np.diff(found[begin:end] & np.uint32((1 << PART_BITS) - 1), prepend=np.uint32(0))
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([part], pa.int32()),
                        "steps": [squeeze(steps)],
                        "counts": [squeeze(counts[begin:end])],
                    }
                )
            begin = end

    return count


def squeeze(values: np.ndarray) -> bytes:
    """In the fewest bytes each that hold the largest, compressed; the first byte says how many."""
    width = next(w for w in (1, 2, 4, 8) if int(values.max(initial=0)) < 1 << 8 * w)
    return bytes([width]) + zlib.compress(values.astype(f"<u{width}").tobytes(), 1)


def expand(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), f"<u{data[0]}")


def sum_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the parts up and keeps half a power of two of each count, in four bits."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for row in batch.to_pylist():
            total = totals.setdefault(row["part"], np.zeros(1 << PART_BITS, np.uint32))
            counts = np.minimum(expand(row["counts"]).astype(np.uint64), 1 << 16).astype(np.uint32)
            total[np.cumsum(expand(row["steps"]), dtype=np.int64)] += counts
    for part, total in totals.items():
        level = np.minimum(15, 2 * np.log2(np.maximum(total, 1))).astype(np.uint8)
        packed = level[::2] | level[1::2] << 4
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([part], pa.int32()), "data": [zlib.compress(packed.tobytes(), 1)]}
        )


def frequency_levels(texts: DataFrame, size: int) -> np.ndarray:
    """A frequency level for each cell, over all rows, two to a byte. It does not grow."""
    found = (
        texts.mapInArrow(count_cells(size), "part int, steps binary, counts binary")
        .repartition("part")
        .mapInArrow(sum_cells, "part int, data binary")
    )
    levels = np.zeros(1 << CELL_BITS - 1, np.uint8)
    for row in found.toLocalIterator():
        part = np.frombuffer(zlib.decompress(row.data), np.uint8)
        levels[row.part * len(part) : (row.part + 1) * len(part)] = part
    return levels


def prefix(hashes: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles in the common order: level first, then hash."""
    n = len(hashes)
    length = n - (percent * n + 99) // 100 + 1
    cell = cells(hashes)
    level = levels[cell >> np.uint32(1)] >> (cell & np.uint32(1)).astype(np.uint8) * np.uint8(4) & np.uint8(15)
    order = (level.astype(np.uint64) << np.uint64(60)) | (hashes >> np.uint64(4))
    if length < n:
        order = np.partition(order, length - 1)[:length]
    return np.sort(order).view(np.int64)


def profile(levels, size: int, percent: int) -> Callable:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for batch in batches:
            counts, prints, groups, prefixes, keys = [], [], [], [], []
            for text in utf8(batch.column(1)):
                found = shingles(text, size)
                counts.append(len(found))
                prints.append(xxhash.xxh3_128_digest(found.tobytes()))
                front = prefix(found, levels.value, percent) if len(found) else found.view(np.int64)
                groups.append(xxhash.xxh3_128_digest(front.tobytes() + len(found).to_bytes(8)))
                prefixes.append(front)
                keys.append(hashlib.md5(text, usedforsecurity=False).digest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(prints, pa.binary()),
                    pa.array(groups, pa.binary()),
                    pa.array(prefixes, pa.list_(pa.int64())),
                    pa.array(keys, pa.binary()),
                ],
                names=["doc_id", "n", "print", "grp", "prefix", "text_md5"],
            )

    return apply


def verify(size: int, percent: int) -> Callable:
    """Keeps (a, b) of (a, b, text_a, text_b) whose whole sets are similar enough."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        last, first = None, None
        for batch in batches:
            keep = []
            for k, (a, text_a, text_b) in enumerate(
                zip(batch.column(0).to_pylist(), utf8(batch.column(2)), utf8(batch.column(3)))
            ):
                if a != last:
                    last, first = a, shingles(text_a, size)
                second = shingles(text_b, size)
                common = len(np.intersect1d(first, second, assume_unique=True))
                if 100 * common >= percent * (len(first) + len(second) - common):
                    keep.append(k)
            rows = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows)], names=["a", "b"]
            )

    return apply


def similar_enough(n: str, at: str, m: str, mt: str, percent: int) -> F.Column:
    """Whether sizes, and places of a shared shingle, leave room for the overlap."""
    n, at, m, mt = F.col(n), F.col(at), F.col(m), F.col(mt)
    room = F.least(n - at, m - mt)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (
        (100 + percent) * room >= percent * (n + m)
    )


def link_documents(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Two documents link when ``100 * intersection >= percent * union`` of their sets of
    ``size``-word shingles. ``component_id`` is the smallest doc_id reachable by links,
    itself included. A document without words has an empty set and is its own
    component. Rows that share a doc_id are documents of their own and answer with the
    smallest doc_id of what each reaches. A null doc_id is never the smallest; what has
    no other has a null component. Other columns are not looked at. No rows, no rows.
    """
    return link_rows(docs, size, percent).select("doc_id", "n_shingles", "component_id")


def link_rows(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``link_documents`` with ``text_md5`` of each row's text and ``first_md5``.

    The latter is that of the component's row with the smallest doc_id, of several the one
    with the smallest md5, so that doc_id and md5 together name one document of each
    component. It is null where the component has no doc_id, or the row no words.
    """
    texts = docs.select("doc_id", "text")
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    levels = spark.sparkContext.broadcast(frequency_levels(texts.select("text"), size))
    profiles = stage(
        texts.mapInArrow(
            profile(levels, size, percent),
            f"doc_id {id_type}, n bigint, print binary, grp binary, prefix array<bigint>, text_md5 binary",
        ),
        "profiles",
    )
    classes = stage(
        profiles.where("n > 0")
        .groupBy("print", "n", "grp")
        .agg(
            F.min("doc_id").alias("first_id"),
            F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_md5"))).alias("first"),
        )
        .withColumn("item", F.xxhash64("print")),
        "classes",
    )
    shared = shared_shingles(profiles.where("n > 0"), classes)
    roots = connect(shared, classes, texts, size, percent)

    linked = classes.select("print", "item", "first").join(
        roots.select(F.col("node").alias("item"), "root"), "item", "left"
    )
    named = linked.withColumn("root", F.coalesce("root", "item"))
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    of_class = stage(
        named.join(least, "root").select(
            "print",
            F.col("least.doc_id").alias("component_id"),
            F.col("least.text_md5").alias("first_md5"),
        ),
        "class-components",
    )
    return (
        profiles.select("doc_id", "n", "print", "text_md5")
        .join(of_class, "print", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
            "text_md5",
            F.when(F.col("n") > 0, F.col("first_md5")).alias("first_md5"),
        )
    )


def shared_shingles(profiles: DataFrame, classes: DataFrame) -> DataFrame:
    """(token, item, n, at) for the members of groups that share a prefix shingle.

    One shuffle of the groups' prefixes; a group of two or more classes keeps its first
    shingle even if no other group has it, as its members have to be compared.
    """
    groups = profiles.groupBy("grp").agg(
        F.first("prefix").alias("prefix"), (F.min("print") != F.max("print")).alias("several")
    )
    rows = groups.select(
        F.xxhash64("grp").alias("group"), "several", F.posexplode("prefix").alias("at", "token")
    )
    shared = (
        rows.withColumn("others", F.count("*").over(Window.partitionBy("token")))
        .where("others > 1 or (several and at = 0)")
        .select("token", "group", "at")
    )
    members = classes.select(F.xxhash64("grp").alias("group"), "item", "n")
    return stage(shared.join(members, "group").select("token", "item", "n", "at"), "shared-shingles")


def with_print(size: int) -> Callable:
    """Rows (item, text) of (item, print, text) whose set is the one that is meant."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = (
                xxhash.xxh3_128_digest(shingles(text, size).tobytes()) for text in utf8(batch.column(2))
            )
            keep = [k for k, (x, y) in enumerate(zip(prints, batch.column(1).to_pylist())) if x == y]
            rows = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(2).take(rows)], names=["item", "text"]
            )

    return apply


def connect(
    shared: DataFrame, classes: DataFrame, texts: DataFrame, size: int, percent: int
) -> DataFrame:
    """(node, root) of the items that link."""
    wanted = classes.join(shared.select("item").distinct(), "item").select("item", "print", "first_id")
    joined = wanted.join(texts, wanted["first_id"].eqNullSafe(texts["doc_id"]))
    sources = stage(
        # several rows may have the doc_id: one of them has the class's set
        joined.select("item", "print", "text")
        .mapInArrow(with_print(size), "item bigint, text string")
        .dropDuplicates(["item"]),
        "shared-texts",
    )
    roots = None
    for turn in range(ROUNDS + 1):
        live = shared.withColumn("comp", F.col("item"))
        if roots is not None:
            known = roots.select(F.col("node").alias("item"), "root")
            live = shared.join(known, "item", "left").withColumn("comp", F.coalesce("root", "item"))
        live = live.select("token", "item", "comp", "n", "at")
        pairs = pivot_pairs(live, turn, percent) if turn < ROUNDS else other_pairs(live, percent)
        found = stage(
            pairs.join(sources.select(F.col("item").alias("b"), F.col("text").alias("text_b")), "b")
            .join(sources.select(F.col("item").alias("a"), F.col("text").alias("text_a")), "a")
            .select("a", "b", "text_a", "text_b")
            .mapInArrow(verify(size, percent), "a bigint, b bigint"),
            "links",
        )
        if not found.isEmpty():
            if roots is not None:
                found = found.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
            roots = components(found)
    if roots is None:
        roots = classes.select(F.col("item").alias("node"), F.col("item").alias("root")).where("false")
    return roots


def pivot_pairs(live: DataFrame, turn: int, percent: int) -> DataFrame:
    """Each member of a shingle with its pivot, where they are not connected yet.

    The pivot is the member that has the fewest rarer shingles before the shared one, so
    the least edited of a set of copies: it is the likeliest to link with the others. Each
    later turn takes it from another quarter of the items.
    """
    mixed = F.xxhash64("item", F.lit(turn))
    order = F.struct(
        (F.pmod(mixed, F.lit(4 if turn else 1)) != 0).alias("outside"), "at", mixed.alias("h"),
        "item", "comp", "n",
    )
    pivot = F.min(order)
    rows = live.withColumn("p", pivot.over(Window.partitionBy("token"))).select(
        F.col("p.item").alias("a"), F.col("p.n").alias("a_n"), F.col("p.at").alias("a_at"),
        F.col("item").alias("b"), F.col("n").alias("b_n"), F.col("at").alias("b_at"),
        (F.col("p.comp") != F.col("comp")).alias("apart"),
    )
    near = similar_enough("a_n", "a_at", "b_n", "b_at", percent)
    return rows.where(F.col("apart") & near).select("a", "b").distinct()


def other_pairs(live: DataFrame, percent: int) -> DataFrame:
    """All pairs of members of a shingle that still lie in different components."""
    one = Window.partitionBy("token")
    mixed = live.withColumns(
        {"low": F.min("comp").over(one), "high": F.max("comp").over(one)}
    )
    mixed = stage(mixed.where("low <> high").drop("low", "high"), "mixed-shingles")
    left, right = (
        mixed.select(
            "token", F.col("comp").alias(f"{side}_comp"), F.col("item").alias(side),
            F.col("n").alias(f"{side}_n"), F.col("at").alias(f"{side}_at"),
        )
        for side in "ab"
    )
    near = similar_enough("a_n", "a_at", "b_n", "b_at", percent)
    return left.join(right, "token").where((F.col("a_comp") < F.col("b_comp")) & near).select("a", "b").distinct()
