"""Line dedup: lines that many documents repeat stay in one document only.

Two Bloom filters over the hashes of line keys, one of keys seen once and one of
keys seen twice, are built inside the tasks and merged. Only lines that the second
one holds are shuffled, to be counted exactly and to choose the document that keeps
them. A false positive costs a shuffled row, never a wrong line; a key seen twice is
always in the second filter, as all its bits were set twice.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.llm.tables import free_name, stage, utf8

CHUNK_BITS = 20  # the filters travel in pieces of so many (as a power of two) bits
CHUNK_BYTES = 1 << (CHUNK_BITS - 3)
MOST_BITS = 30  # a filter of 128 MB is the largest that is broadcast


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line stripped of ASCII white space with A-Z lowered; None if it is short."""
    if len(line) < min_chars:
        return None
    key = line.strip().lower()
    if len(key) < min_chars:
        return None
    long = key.isascii() or len(key) >= 4 * min_chars or len(key.decode()) >= min_chars
    return key if long else None


def document_keys(text: bytes, min_chars: int) -> list[bytes]:
    """The distinct keys of one document."""
    keys = {line_key(line, min_chars) for line in text.split(b"\n")}
    keys.discard(None)
    return list(keys)


def positions(keys: list[bytes], bits: int) -> np.ndarray:
    """Two bit positions for each key, in two rows."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
    mask = np.uint64((1 << bits) - 1)
    return np.stack([hashes & mask, (hashes >> np.uint64(64 - MOST_BITS)) & mask])


def partial_filters(bits: int, min_chars: int) -> Callable:
    """What one task saw: rows of (chunk, twice, dense, data)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []
        for batch in batches:
            keys = [k for text in utf8(batch.column(0)) for k in document_keys(text, min_chars)]
            seen.append(positions(keys, bits).ravel())
        found, counts = np.unique(np.concatenate(seen or [np.empty(0, np.uint64)]), return_counts=True)
        for twice, bit in ((False, found), (True, found[counts > 1])):
            chunk = (bit >> np.uint64(CHUNK_BITS)).astype(np.int32)
            offset = (bit & np.uint64((1 << CHUNK_BITS) - 1)).astype(np.uint32)
            starts = np.flatnonzero(np.diff(chunk, prepend=-1))
            rows = []
            for begin, end in zip(starts, [*starts[1:], len(chunk)]):
                part = offset[begin:end]
                dense = part.nbytes > CHUNK_BYTES
                rows.append(
                    {
                        "chunk": int(chunk[begin]),
                        "twice": twice,
                        "dense": dense,
                        "data": (bitmap(part) if dense else part).tobytes(),
                    }
                )
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=PARTIAL)

    return build


PARTIAL = pa.schema(
    [("chunk", pa.int32()), ("twice", pa.bool_()), ("dense", pa.bool_()), ("data", pa.binary())]
)


def bitmap(offsets: np.ndarray) -> np.ndarray:
    flags = np.zeros(1 << CHUNK_BITS, np.bool_)
    flags[offsets] = True
    return np.packbits(flags, bitorder="little")


def merge_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk, the bits that were set twice or more. Holds two bitmaps a chunk."""
    state: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            once, twice = state.setdefault(
                row["chunk"], (np.zeros(CHUNK_BYTES, np.uint8), np.zeros(CHUNK_BYTES, np.uint8))
            )
            if row["dense"]:
                new = np.frombuffer(row["data"], np.uint8)
            else:
                new = bitmap(np.frombuffer(row["data"], np.uint32))
            if row["twice"]:
                twice |= new
            else:
                twice |= once & new
                once |= new
    for chunk, (_, twice) in state.items():
        yield pa.RecordBatch.from_pydict(
            {"chunk": pa.array([chunk], pa.int32()), "data": [zlib.compress(twice.tobytes(), 1)]}
        )


def twice_filter(texts: DataFrame, bits: int, min_chars: int) -> np.ndarray:
    """The filter of keys that two rows hold, as bytes: at most 2**bits bits."""
    merged = (
        texts.mapInArrow(
            partial_filters(bits, min_chars), "chunk int, twice boolean, dense boolean, data binary"
        )
        .repartition("chunk")
        .mapInArrow(merge_filters, "chunk int, data binary")
    )
    held = np.zeros((1 << bits) >> 3, np.uint8)
    for row in merged.toLocalIterator():
        part = np.frombuffer(zlib.decompress(row.data), np.uint8)
        begin = row.chunk * CHUNK_BYTES
        held[begin : begin + CHUNK_BYTES] = part[: len(held) - begin]
    return held


def suspects(texts: DataFrame, held, bits: int, min_chars: int) -> DataFrame:
    """(key, id) for the lines that may be repeated, once for each row."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = held.value
        for batch in batches:
            found = [document_keys(text, min_chars) for text in utf8(batch.column(0))]
            keys = [key for one in found for key in one]
            rows = np.repeat(np.arange(len(found)), [len(one) for one in found])
            keep = np.ones(len(keys), np.bool_)
            for bit in positions(keys, bits):
                keep &= (twice[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(np.bool_)
            chosen = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[k] for k in chosen], pa.binary()),
                    batch.column(1).take(pa.array(rows[chosen])),
                ],
                names=["key", "id"],
            )

    id_type = texts.schema[1].dataType.simpleString()
    return texts.mapInArrow(probe, f"key binary, id {id_type}")


def filter_bits(total_bytes: int, min_chars: int) -> int:
    """Eight bits for each key that the bytes can hold, up to MOST_BITS."""
    keys = max(1, total_bytes // max(1, min_chars))
    return min(MOST_BITS, max(CHUNK_BITS, (8 * keys - 1).bit_length()))


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, bits: int | None = None
) -> DataFrame:
    """The documents without lines that ``min_docs`` or more of them hold.

    Lines are split at ``\\n``. Two lines are equal when they are after stripping
    ``[\\x20\\x09-\\x0D]`` and lowering A-Z. A line of ``min_chars`` code points or more
    that is found in ``min_docs`` rows loses all its copies, but for those in the
    largest doc_id that holds it. The rest stays, joined by ``\\n``.

    Every column is kept; ``text`` is replaced, ``n_lines`` (before) and ``n_dropped``
    are added, or replaced where the input has them. A null text counts as one empty
    line and becomes empty. Each row counts as a document, so a row that occurs twice
    counts twice, and rows of one doc_id keep or lose a line together. A null doc_id
    is smaller than all others. An empty table gives an empty table.

    ``bits`` sizes the filters, as a power of two. By default it follows the bytes of
    text up to ``MOST_BITS`` (128 MB), which is what is broadcast at most. Beyond that
    more lines are shuffled for the exact count; no result changes.
    """
    spark = docs.sparkSession
    texts = docs.select("text", F.col("doc_id").alias("id"))
    if bits is None:
        total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = filter_bits(total, min_chars)
    held = spark.sparkContext.broadcast(twice_filter(texts, bits, min_chars))
    found = stage(suspects(texts, held, bits, min_chars), "line-suspects")
    repeated = stage(
        found.groupBy("key")
        .agg(F.count("*").alias("rows"), F.max("id").alias("keeper"))
        .where(F.col("rows") >= min_docs)
        .select("key", "keeper"),
        "line-repeats",
    )
    losing = (
        found.join(repeated, "key")
        .where(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy("id")
        .agg(F.collect_set("key").alias("drop"))
    )
    kept = docs.drop("n_lines", "n_dropped")
    drop, other = free_name(kept, "drop"), free_name(kept, "id")
    losing = losing.select(F.col("id").alias(other), F.col("drop").alias(drop))
    joined = kept.join(losing, kept["doc_id"].eqNullSafe(losing[other]), "left").drop(other)
    schema = kept.schema.add("n_lines", "long").add("n_dropped", "long")
    return joined.mapInArrow(rewrite(min_chars), schema)


def rewrite(min_chars: int) -> Callable:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            at = names.index("text")
            texts, lines, dropped = [], [], []
            for text, drop in zip(utf8(batch.column(at)), batch.column(len(names) - 1).to_pylist()):
                whole = text.split(b"\n")
                lines.append(len(whole))
                if drop:
                    gone = set(drop)
                    rest = [line for line in whole if line_key(line, min_chars) not in gone]
                    dropped.append(len(whole) - len(rest))
                    texts.append(b"\n".join(rest))
                else:
                    dropped.append(0)
                    texts.append(text)
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
                names=[*names[:-1], "n_lines", "n_dropped"],
            )

    return apply
