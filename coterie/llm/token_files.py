"""Token ids in binary files: frequency-ranked ids in a byte-aligned coding.

An id is replaced by its rank by frequency over the whole corpus, so common ids take
one byte. Ranks are written with as many bytes as they need; their lengths (two bits
each, four to a byte) are kept apart from the data, so that a reader finds all places
with one table lookup and a running sum.

A folder holds ``ranks`` (rank, id) and ``blocks``, Parquet files of

    shard, block   place in the order of documents: ascending shard, then block
    start          ids before the block in its shard
    doc_id, n      for each document, its id and its number of tokens
    control, data  of its documents one after another; each document's control ends
                   with a whole byte

Spark's writer commits the files, so a lost executor leaves no half file behind.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from coterie.llm.tables import blocks, stage, utf8
from coterie.llm.word_tokens import BLOCK_BYTES, WORD_BPE, word_encoder

BLOCK_IDS = 1 << 18  # a block is closed when it has so many ids
SHIFTS = np.array([0, 2, 4, 6], np.uint8)
#: For each control byte, which of the bytes of its four numbers are written.
WRITTEN = np.arange(4) <= (np.arange(256)[:, None] >> SHIFTS & 3)[:, :, None]


def slots(counts: np.ndarray) -> np.ndarray:
    """Where each document's numbers go when each starts with a new control byte."""
    pad = -counts % 4
    return np.arange(counts.sum()) + np.repeat(np.cumsum(pad) - pad, counts)


def pack(numbers: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control and data bytes of each of the documents whose numbers follow each other."""
    extra = (numbers > 0xFF).astype(np.uint8)
    extra += numbers > 0xFFFF
    extra += numbers > 0xFFFFFF
    quads = -(-counts // 4)
    codes = np.zeros(4 * quads.sum(), np.uint8)
    codes[slots(counts)] = extra
    control = np.bitwise_or.reduce(codes.reshape(-1, 4) << SHIFTS, axis=1).tobytes()
    whole = numbers.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = whole[np.arange(4) <= extra[:, None]].tobytes()
    at = np.r_[0, np.cumsum(extra, dtype=np.int64) + np.arange(1, len(extra) + 1)][np.r_[0, np.cumsum(counts)]]
    return cut(control, np.r_[0, np.cumsum(quads)]), cut(data, at)


def cut(flat: bytes, at: np.ndarray) -> list[bytes]:
    places = at.tolist()
    return [flat[a:b] for a, b in zip(places, places[1:])]


def unpack(control: bytes, data: bytes, counts: np.ndarray) -> np.ndarray:
    """The numbers again: the control bytes say by table which bytes are there."""
    written = WRITTEN[np.frombuffer(control, np.uint8)].reshape(-1, 4)[slots(counts)]
    out = np.zeros(written.shape, np.uint8)
    out[written] = np.frombuffer(data, np.uint8)
    return out.view("<u4").ravel()


def encode_ids(path: str, end_id: int, kind: str, size: int, id_type: pa.DataType) -> Callable:
    """(doc_id, ids, counts): a row for each document, and one with how often the task saw
    each of the ``size`` ids."""
    tail = np.array([end_id], "<u4").tobytes()
    width = np.dtype(kind).itemsize

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        total = np.zeros(size, np.int64)
        for batch in batches:
            texts = utf8(batch.column(1))
            for part in blocks([len(text) for text in texts], BLOCK_BYTES):
                flat, at = encoder.encode_block(texts[part], tail)
                total += np.bincount(flat, minlength=size)
                rows = batch.column(0).slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays(
                    [rows, binary(flat.astype(kind), width * at), pa.nulls(len(rows), pa.binary())],
                    names=["doc_id", "ids", "counts"],
                )
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, id_type), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())],
            names=["doc_id", "ids", "counts"],
        )

    return encode


def binary(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    """Binary values that lie one after the other, without a copy of each."""
    if at[-1] < 1 << 31:
        return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(flat)])
    return pa.array(cut(flat.tobytes(), at), pa.binary())


def sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n) of the ids that some of the tasks saw."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        for one in batch.column(0).to_pylist():
            counts = np.frombuffer(one, np.int64)
            total = counts + total if len(total) else counts
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in smaller batches, as what is worked out of them takes several times their size."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(1)).to_pylist()
        for part in blocks(lengths, BLOCK_IDS):
            yield batch.slice(part.start, part.stop - part.start)


def rank_ids(rank_of, bounds, kind: str) -> Callable:
    """(shard, doc_id, n, control, data) of (doc_id, ids).

    ``bounds`` are the doc_ids at which the next shard begins. One that many rows share
    occurs several times there; its rows are dealt out over the shards in between.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, edges = rank_of.value, bounds.value
        for batch in slices(batches):
            rows = batch.column(1).to_pylist()
            flat = np.frombuffer(b"".join(rows), kind)
            counts = np.array([len(one) for one in rows], np.int64) // np.dtype(kind).itemsize
            control, data = pack(ranks[flat], counts)
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            doc_id = batch.column(0).fill_null(0).to_numpy()
            first, last = (np.searchsorted(edges, doc_id, side) for side in ("left", "right"))
            deal = np.arange(len(rows)) % (last - first + 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.where(known, first + deal, 0), pa.int32()),
                    batch.column(0),
                    pa.array(counts, pa.int32()),
                    pa.array(control, pa.binary()),
                    pa.array(data, pa.binary()),
                ],
                names=["shard", "doc_id", "n", "control", "data"],
            )

    return apply


BLOCKS = (
    "shard int, block int, start bigint, doc_id array<{id}>, n array<int>, control binary, data binary"
)


def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the documents of a shard, which come in order."""
    shard, block, start, ids, kind = None, 0, 0, 0, pa.int64()
    held: list[tuple] = []

    def close() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([shard], pa.int32()),
                pa.array([block], pa.int32()),
                pa.array([start], pa.int64()),
                pa.array([[row[1] for row in held]], pa.list_(kind)),
                pa.array([[row[2] for row in held]], pa.list_(pa.int32())),
                pa.array([b"".join(row[3] for row in held)], pa.binary()),
                pa.array([b"".join(row[4] for row in held)], pa.binary()),
            ],
            names=["shard", "block", "start", "doc_id", "n", "control", "data"],
        )

    for batch in batches:
        kind = batch.schema.field("doc_id").type
        for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if held and (row[0] != shard or ids >= BLOCK_IDS):
                yield close()
                block, start, ids, held = block + 1, start + ids, 0, []
            if row[0] != shard:
                shard, block, start = row[0], 0, 0
            held.append(row)
            ids += row[2]
    if held:
        yield close()


def write_token_files(
    docs: DataFrame, path: str, end_id: int, tokenizer: str = WORD_BPE, shards: int | None = None
) -> None:
    """Encodes ``text`` of every row, appends ``end_id`` and writes the folder ``path``.

    Documents lie in ascending doc_id order (integers) over shards and blocks, nulls
    first; rows that share a doc_id lie next to each other, in no given order. A null or
    empty text is the end id alone. Other columns are not looked at. An empty table gives
    files without rows. ``shards`` defaults to the session's shuffle partitions.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = max(end_id + 1, Tokenizer.from_file(tokenizer).get_vocab_size())
    kind = "<u2" if size <= 1 << 16 else "<u4"
    id_type = docs.schema["doc_id"].dataType.simpleString()
    encoded = stage(
        docs.select("doc_id", "text").mapInArrow(
            encode_ids(tokenizer, end_id, kind, size, to_arrow_type(docs.schema["doc_id"].dataType)),
            f"doc_id {id_type}, ids binary, counts binary"
        ),
        "token-ids",
    )
    counts = encoded.where("counts is not null").select("counts").mapInArrow(sum_counts, "id bigint, n bigint")
    counts = counts.groupBy("id").agg(F.sum("n").alias("n"))
    tokens = encoded.where("counts is null").select("doc_id", "ids")
    # at most as many rows as the vocabulary has
    order = [row.id for row in counts.orderBy(F.desc("n"), "id").select("id").collect()]
    rank_of = np.zeros(max(order, default=0) + 1, np.uint32)
    rank_of[order] = np.arange(len(order))
    spark.createDataFrame(list(enumerate(order)), "rank int, id bigint").coalesce(1).write.parquet(
        f"{path}/ranks"
    )
    steps = [k / shards for k in range(1, shards)]
    found = tokens.agg(F.percentile_approx("doc_id", steps or [0.5], 100 * shards)).first()[0]
    bounds = np.array(found if found and steps else [], np.int64)
    share = spark.sparkContext.broadcast
    coded = tokens.mapInArrow(
        rank_ids(share(rank_of), share(bounds), kind),
        f"shard int, doc_id {id_type}, n int, control binary, data binary",
    )
    coded.repartition(shards, "shard").sortWithinPartitions("shard", "doc_id").mapInArrow(
        to_blocks, BLOCKS.format(id=id_type)
    ).write.option("compression", "none").parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the folder.

    ``ids`` holds little-endian unsigned 32-bit ids; ``start`` counts the ids of all
    documents before it.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()  # the vocabulary at most
    by_rank = spark.sparkContext.broadcast(np.array([row.id for row in ranks], np.uint32))
    totals = blocks.groupBy("shard").agg(
        F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("ids")
    )
    before = totals.select(  # a row for each shard, small enough to broadcast
        "shard",
        (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("before"),
    )
    id_type = blocks.schema["doc_id"].dataType.elementType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = by_rank.value
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.array(row["n"], np.int64)
                ids = table[unpack(row["control"], row["data"], counts)].astype("<u4").tobytes()
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_id"], batch.schema.field("doc_id").type.value_type),
                        pa.array(row["before"] + row["start"] + ends - counts),
                        pa.array(counts),
                        pa.array(cut(ids, 4 * np.r_[0, ends]), pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return blocks.join(F.broadcast(before), "shard").mapInArrow(
        decode, f"doc_id {id_type}, start bigint, n_tokens bigint, ids binary"
    )
