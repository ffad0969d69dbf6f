"""Packing documents into sequences: best fit, then a local search over swaps.

Pieces are dealt into groups of bounded size. In each group the pieces are packed by
best fit in descending order; then pieces move between underfull sequences, or are
exchanged one for one or two for one, wherever that raises the sum of squared fills,
so that full ones fill up and the emptiest ones empty out. The emptiest sequences of
all groups are then opened and packed again together, level by level.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.llm.tables import blocks, free_name, stage, utf8
from coterie.llm.word_tokens import BLOCK_BYTES, WORD_BPE, word_encoder

GROUP_ROWS = 8192  # pieces a group holds, about
OPENED = 128  # sequences a group hands to the next level at most
PASSES = 8  # of the local search


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Sequences as lists of places, by best fit in descending order of length."""
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a sequence with room r is open
    bins: list[list[int]] = []
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        fitting = rooms >> size
        if fitting:
            room = size + ((fitting & -fitting).bit_length() - 1)
            place = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms ^= 1 << room
            bins[place].append(item)
        else:
            room, place = capacity, len(bins)
            bins.append([item])
        room -= size
        if room:
            open_by_room[room].append(place)
            rooms |= 1 << room
    return bins


def two_of_each(items: list[int], lengths: list[int]) -> list[int]:
    """The first two of each length; no exchange of others brings more."""
    seen: dict[int, int] = {}
    kept = []
    for item in items:
        size = lengths[item]
        seen[size] = seen.get(size, 0) + 1
        if seen[size] <= 2:
            kept.append(item)
    return kept


def best_exchange(taker: list[int], giver: list[int], lengths: list[int], room: int):
    """The exchange that brings the taker most, at most ``room``: (gain, out, in).

    A move, one for one, two of the taker's for one, or one of the taker's for two.
    """
    best = (0, (), ())
    order = sorted(giver, key=lengths.__getitem__)
    taker = two_of_each(taker, lengths)
    sizes = [lengths[k] for k in order]

    def offer(out: tuple, size: int) -> None:
        """The largest of the giver's that is at most ``room`` longer than ``out``."""
        nonlocal best
        k = bisect.bisect_right(sizes, size + room) - 1
        if k >= 0 and sizes[k] - size > best[0]:
            best = (sizes[k] - size, out, (order[k],))

    offer((), 0)
    for a, item in enumerate(taker):
        offer((item,), lengths[item])
        for other in taker[a + 1 :]:
            offer((item, other), lengths[item] + lengths[other])
        low, high = 0, len(order) - 1
        while low < high:  # two of the giver's for this one
            gain = sizes[low] + sizes[high] - lengths[item]
            if gain > room:
                high -= 1
            else:
                if gain > best[0]:
                    best = (gain, (item,), (order[low], order[high]))
                low += 1
    return best


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Raises the sum of squared fills until a pass changes nothing, or PASSES.

    The emptiest sequence gives, the fullest that can use it takes, so every exchange
    raises the sum: what the taker gains goes from a fill that is smaller than its own.
    """
    size = lengths.tolist()
    fill = [sum(size[k] for k in one) for one in bins]
    under = [k for k in range(len(bins)) if fill[k] < capacity]
    for _ in range(PASSES):
        changed = False
        under.sort(key=lambda k: fill[k])
        for giver in under:
            for taker in sorted(under[-64:], key=lambda k: -fill[k]):
                if not bins[giver]:
                    break
                while taker != giver and fill[giver] <= fill[taker] < capacity and bins[giver]:
                    gain, out, taken = best_exchange(
                        bins[taker], bins[giver], size, capacity - fill[taker]
                    )
                    if not gain:
                        break
                    bins[taker] = [k for k in bins[taker] if k not in out] + list(taken)
                    bins[giver] = [k for k in bins[giver] if k not in taken] + list(out)
                    fill[taker] += gain
                    fill[giver] -= gain
                    changed = True
        under = [k for k in under if bins[k] and fill[k] < capacity]
        if not changed:
            break
    return [one for one in bins if one]


def pack_lengths(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def pack_group(capacity: int, level: int, last: bool, names: dict[str, str]) -> Callable:
    """Packs one group; all but ``last`` leave their emptiest sequences open.

    Those hold half of the group's pieces at most, so every level has at most half as
    many rows as the one before, whatever the lengths.
    """

    def pack(group: pa.Table) -> pa.Table:
        lengths = group.column(names["length"]).to_numpy().astype(np.int64)
        bins = pack_lengths(lengths, capacity)
        bins.sort(key=lambda one: -int(lengths[one].sum()))
        begin, handed = len(bins), 0  # where the open ones begin, and their pieces
        while begin and not last and len(bins) - begin < OPENED:
            handed += len(bins[begin - 1])
            if 2 * handed > len(lengths):
                break
            begin -= 1
        number = group.column(names["group"])[0].as_py()
        sequence = np.empty(len(lengths), np.int64)
        offset = np.empty(len(lengths), np.int64)
        opened = np.zeros(len(lengths), np.bool_)
        for k, one in enumerate(bins):
            part = lengths[one]
            sequence[one] = (level << 58) + (number << 20) + k
            offset[one] = np.cumsum(part) - part
            opened[one] = k >= begin and part.sum() < capacity
        for name, values in (("sequence", sequence), ("offset", offset), ("opened", opened)):
            at = group.schema.get_field_index(names[name])
            group = group.set_column(at, names[name], pa.array(values))
        return group

    return pack


def pack_pieces(pieces: DataFrame, capacity: int = 4096, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity``.

    All columns stay; an input column of either name is replaced. ``deal`` is the
    column that says which group a row goes to: an evenly spread number, whatever the
    rows hold (``token_pieces`` gives one). Sequences hold no two rows at one place and
    leave no gap. An empty table stays empty. A group has about ``group_rows`` rows on
    every level, so memory is bounded; each level packs only what the one before left
    open, at most half of its rows.
    """
    kept = pieces.drop("sequence_id", "offset")
    names = {"length": "length"}
    for key, base in (("group", "grp"), ("sequence", "seq"), ("offset", "off"), ("opened", "opened")):
        names[key] = free_name(kept, base)
    done = None
    rows, level = kept.count(), 0
    while True:
        groups = max(1, -(-rows // group_rows))
        dealt = kept.withColumns(
            {
                names["group"]: F.pmod(F.col("deal"), F.lit(groups)).cast("long"),
                names["sequence"]: F.lit(0).cast("long"),
                names["offset"]: F.lit(0).cast("long"),
                names["opened"]: F.lit(False),
            }
        )
        packed = stage(
            dealt.groupBy(names["group"]).applyInArrow(
                pack_group(capacity, level, groups == 1, names), dealt.schema
            ),
            "packed",
        )
        final = packed.where(~F.col(names["opened"]))
        done = final if done is None else done.unionByName(final)
        if groups == 1:
            break
        kept = packed.where(names["opened"]).select(kept.columns)
        rows, level = kept.count(), level + 1
    return done.withColumnsRenamed(
        {names["sequence"]: "sequence_id", names["offset"]: "offset"}
    ).drop(names["group"], names["opened"])


def spread(count: int, begin: int) -> np.ndarray:
    """Numbers that deal rows evenly: a mixed row counter of this task."""
    x = np.arange(begin, begin + count, dtype=np.uint64)
    x += np.uint64(TaskContext.get().partitionId()) << np.uint64(40)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(1)).astype(np.int64)


def text_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        texts = utf8(batch.column(1))
        for part in blocks([len(text) for text in texts], BLOCK_BYTES):
            yield batch.slice(part.start, part.stop - part.start), texts[part]


def cut(path: str, end_id: int, capacity: int) -> Callable:
    tail = np.array([end_id], "<u4").tobytes()
    width = 4 * capacity

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = word_encoder(path), 0
        for batch, texts in text_blocks(batches):
            ids = encoder.encode(texts, tail)
            parts = [
                (row, k, one[k * width : (k + 1) * width])
                for row, one in enumerate(ids)
                for k in range(-(-len(one) // width))
            ]
            numbers = np.array([part[1] for part in parts], np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([part[0] for part in parts], pa.int32())),
                    pa.array(numbers),
                    pa.array(numbers.astype(np.int64) * capacity),
                    pa.array([len(part[2]) // 4 for part in parts], pa.int64()),
                    pa.array([part[2] for part in parts], pa.binary()),
                    pa.array(spread(len(parts), seen)),
                ],
                names=["doc_id", "piece", "start", "length", "ids", "deal"],
            )
            seen += len(parts)

    return pieces


def token_pieces(
    docs: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer: str = WORD_BPE
) -> DataFrame:
    """(doc_id, piece, start, length, ids, deal): each document's ids, cut if too long.

    ``ids`` holds little-endian unsigned 32-bit ids. Null texts are empty: the end id
    alone. Only documents of more than ``capacity`` ids are cut; only their last piece
    may be shorter. Rows that share a doc_id, or have none, are documents of their own.
    Write the frame before reading it twice: ``deal`` follows the reading tasks.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        cut(tokenizer, end_id, capacity),
        f"doc_id {id_type}, piece int, start bigint, length bigint, ids binary, deal bigint",
    )
