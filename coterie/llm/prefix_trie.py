"""A trie of the beginnings that conversations share, built as a burst trie.

A turn is an id of fixed width: a hash of role and text, then the text's length. A
conversation is the sequence of its ids, and equal ones count as one with a weight. At first
all lie in one container below the root. A container that is too large bursts by the next
id: its head becomes a node of the trie above, and its suffixes, one id shorter, go to a
container for each id. What is left fits a task: shards hold many containers, sorted by
suffix, and one sweep over the sorted suffixes makes their nodes.

No row grows with a conversation: one of very many turns is cut into segments, and the
suffixes of a later segment lie in a container whose head is named by a running sum of
hashes of what comes before. What such a container holds below its head is added up where
its smallest conversation passes, which is below every node above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coterie.llm.places import placed
from coterie.llm.tables import stage

SEGMENT = 10  # turns of a conversation in one row, as bits of a depth
WIDTH = 20  # bytes of a turn's id
BURST = 1 << 16  # bytes of suffixes that a container holds at most
CHUNK = 1 << 16  # characters of conversation ids that are joined before the last shuffle
FAMILY, TAKEN = 5, 9  # conversations that share a beginning, and of fewer turns than this


def turn_id(role: Column, text: Column) -> Column:
    """Forty hex digits: an MD5 of both, and the text's length in UTF-8."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    return F.concat(F.md5(whole), F.lpad(F.lower(F.hex(F.octet_length(text).cast("long"))), 8, "0"))


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, place, id) of every turn, (conv_id, size))."""
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), turn_id(role, text).alias("id")
    )
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("id")]
    rows, sizes = placed(stage(rows, "turns"), "conv_id", order, "turns")
    return rows.select("conv_id", "place", "id"), sizes


def grafted(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(conv_id, turns, depth, id): conversations that begin as the first of their family.

    The first h turns come from conversation c - c % 5, the others, from the h-th on, are the
    conversation's own; h is the crc32 of the decimal id modulo 9. One without any turn has
    a single row with nulls.
    """
    own = sizes.select(
        "conv_id",
        (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % TAKEN).alias("h"),
        "size",
    )
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    plan = own.join(bases, "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("base_size", F.lit(0))).alias("taken"),
        F.greatest(F.col("size") - F.col("h"), F.lit(0)).alias("kept"),
    )
    plan = stage(plan.withColumn("turns", F.col("taken") + F.col("kept")), "grafts")
    later = rows.join(plan, "conv_id").where("place >= h")
    later = later.select("conv_id", "turns", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "id")
    first = rows.where(F.col("place") < TAKEN - 1).withColumnRenamed("conv_id", "base")
    first = first.join(plan, "base").where("place < h").select("conv_id", "turns", F.col("place").alias("depth"), "id")
    bare = plan.where("turns = 0").select("conv_id", "turns", F.expr("cast(null as bigint)"), F.expr("cast(null as string)"))
    return later.union(first).union(bare)


def segments(paths: DataFrame) -> DataFrame:
    """(conv_id, seg, path, head, next, top): a conversation's turns, 1024 to a row.

    The last segment has fewer, perhaps none, and no ``next``. ``head`` and ``next`` name
    what comes before the segment and before the one after it; ``top`` is the length of the
    text before it.
    """
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("depth", "id"))), lambda x: x["id"])
    seg = F.shiftright("depth", SEGMENT)
    some = paths.where("id is not null").groupBy("conv_id", "turns", seg.alias("seg"))
    some = some.agg(F.unhex(F.array_join(in_order, "")).alias("path"))  # 1024 at most
    last = F.shiftright("turns", SEGMENT)
    full = paths.where((F.col("turns") % (1 << SEGMENT) == 0) & (F.coalesce("depth", F.lit(0)) == 0))
    some = some.unionByName(full.select("conv_id", "turns", last.alias("seg"), F.unhex(F.lit("")).alias("path")))
    nothing = F.lit(None).cast("string")
    short = some.where(F.col("turns") < 1 << SEGMENT).select(
        "conv_id", "seg", "path", F.lit("").alias("head"), nothing.alias("next"), F.lit(0).cast("long").alias("top")
    )
    # four sums of 32 bits each name a beginning, whatever its length
    mark = F.sha2(F.concat(F.concat(F.col("seg").cast("string"), F.lit(":")).cast("binary"), F.col("path")), 256)
    pieces = [F.conv(F.substring("mark", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    talk = Window.partitionBy("conv_id").orderBy("seg")
    upto = [F.sum(piece).over(talk.rowsBetween(Window.unboundedPreceding, 0)) for piece in pieces]
    sums = some.where(F.col("turns") >= 1 << SEGMENT).withColumn("mark", mark)
    sums = sums.withColumn("upto", F.md5(F.concat_ws(",", (F.col("seg") + 1).cast("string"), *upto).cast("binary")))
    before = F.substring(F.lag("path").over(talk), -4, 4)
    sums = sums.select(
        "conv_id", "seg", "path",
        F.coalesce(F.lag("upto").over(talk), F.lit("")).alias("head"),
        F.when(F.col("seg") < last, F.col("upto")).alias("next"),
        F.coalesce(F.conv(F.hex(before), 16, 10).cast("long"), F.lit(0)).alias("top"),
    )
    return short.union(sums)


def suffixes(segs: DataFrame) -> DataFrame:
    """Equal segments with equal heads as one row, with how many and the smallest one."""
    end = F.sha2(F.concat(F.col("head").cast("binary"), F.col("path")), 256)
    return segs.groupBy("head", "seg", "next", "path").agg(
        F.count("*").alias("n"),
        F.min("conv_id").alias("conv"),
        F.first("top").alias("top"),
        F.sum("leaves").alias("leaves"),
        F.sum("saved").alias("saved"),
    ).select(
        "head", F.shiftleft("seg", SEGMENT).alias("depth"), "top", F.lit(None).cast("long").alias("up"),
        F.lit(None).cast("string").alias("up_head"), "path", "n", "conv",
        F.when(F.col("next").isNull(), end).alias("end"), "next", "leaves", "saved",
    )


def burst(strings: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """(containers small enough, heads of burst ones by round, suffixes that leave a segment)."""
    whole, heads, leaving, rest = [], [], [], strings
    while True:
        sizes = rest.groupBy("head").agg(
            F.sum(F.length("path") + WIDTH).alias("size"),
            F.sum("n").alias("n_convs"),
            F.min("conv").alias("least"),
            *(F.max(name).alias(f"{name}_") for name in ("depth", "top", "up", "up_head")),
            F.max(F.when(F.length("path") == 0, F.col("end"))).alias("end_"),
        )
        big = stage(sizes.where(F.col("size") > BURST).withColumnRenamed("head", "key"), "burst-heads")
        if big.isEmpty():
            return whole_of(whole, rest), heads, whole_of(leaving, rest.limit(0))
        heads.append(big)
        marked = rest.join(big.select("key", "least"), F.col("head") == F.col("key"), "left")
        marked = stage(marked, "burst")
        whole.append(marked.where("key is null").drop("key", "least"))
        block = F.substring("path", 1, WIDTH)
        inside = marked.where("key is not null and length(path) > 0").select(
            F.md5(F.concat(F.lit("burst"), "head", F.hex(block)).cast("binary")).alias("head"),
            (F.col("depth") + 1).alias("depth"),
            F.conv(F.hex(F.substring("path", WIDTH - 3, 4)), 16, 10).cast("long").alias("top"),
            F.col("least").alias("up"),
            F.col("head").alias("up_head"),
            F.expr(f"substring(path, {WIDTH + 1})").alias("path"),
            "n", "conv", "end", "next", "leaves", "saved",
        )
        gone = F.col("next").isNotNull() & (F.length("path") == 0)
        leaving.append(inside.where(gone))
        rest = inside.where(~gone)


def whole_of(parts: list[DataFrame], last: DataFrame) -> DataFrame:
    for part in parts:
        last = last.unionByName(part)
    return last


class Container:
    """The nodes of one container; suffixes come sorted."""

    def __init__(self, row: dict):
        self.row = row
        self.bytes, self.parent = [row["top"]], [-1]
        self.n, self.conv, self.children = [0], [None], [0]
        self.leaves, self.saved, self.end = [0], [0], [None]
        self.next: list[tuple[str, int]] = []
        self.open, self.path = [0], b""

    def shared(self, path: bytes) -> int:
        """Turns that the path before begins with too."""
        low, high = 0, min(len(path), len(self.path)) // WIDTH
        while low < high:
            half = (low + high + 1) // 2
            same = path[: half * WIDTH] == self.path[: half * WIDTH]
            low, high = (half, high) if same else (low, half - 1)
        return low

    def add(self, path: bytes, n: int, conv: int, end, following, leaves: int, saved: int) -> None:
        begin = self.shared(path)
        # the last turn before another segment is the head of that one's container
        stop = len(path) // WIDTH - (following is not None)
        del self.open[begin + 1 :]
        for k in range(begin, stop):
            self.children[self.open[-1]] += 1
            self.parent.append(self.open[-1])
            self.open.append(len(self.n))
            self.bytes.append(int.from_bytes(path[(k + 1) * WIDTH - 4 : (k + 1) * WIDTH], "big"))
            for column, value in ((self.n, 0), (self.conv, None), (self.children, 0), (self.leaves, 0), (self.saved, 0), (self.end, None)):
                column.append(value)
        at = self.open[-1]
        self.n[at] += n
        self.conv[at] = conv if self.conv[at] is None else min(self.conv[at], conv)
        self.leaves[at] += leaves
        self.saved[at] += saved
        if following is None:
            self.end[at] = end
        else:
            self.children[at] += 1
            self.next.append((following, at))
        self.path = path

    def rows(self) -> Iterator[tuple]:
        """(kind, key, up_head, conv_id, depth, parent, n_convs, n_children, n_leaves, saved, end)."""
        for k in range(len(self.n) - 1, -1, -1):  # what lies below a node comes after it
            self.leaves[k] += self.children[k] == 0
            self.saved[k] += (self.n[k] - 1) * self.bytes[k]
            up = self.parent[k]
            if up >= 0:
                self.n[up] += self.n[k]
                self.conv[up] = self.conv[k] if self.conv[up] is None else min(self.conv[up], self.conv[k])
                self.leaves[up] += self.leaves[k]
                self.saved[up] += self.saved[k]
        depth = [self.row["depth"]]
        for k, up in enumerate(self.parent):
            if up >= 0:
                depth.append(depth[up] + 1)
            first = (1, self.row["head"], self.row["up_head"]) if up < 0 else (0, None, None)
            above = self.row["up"] if up < 0 else self.conv[up]
            yield (*first, self.conv[k], depth[k], above, self.n[k], self.children[k], self.leaves[k], self.saved[k], self.end[k])
        for key, at in self.next:
            yield (2, key, None, None, None, self.conv[at], None, None, None, None, None)


SWEPT = (
    "kind int, key string, up_head string, conv_id bigint, depth bigint, parent_conv_id bigint, "
    "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, end string"
)
KINDS = [pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 7, pa.string()]
NAMES = [part.split()[0] for part in SWEPT.split(", ")]


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([row[k] for row in rows], kind) for k, kind in enumerate(KINDS)], names=NAMES
    )


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a shard's containers, one after the other."""
    current, out = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if current is None or current.row["head"] != row["head"]:
                if current is not None:
                    out += current.rows()
                current = Container(row)
                if len(out) > 1 << 14:
                    yield batch_of(out)
                    out = []
            current.add(*(row[name] for name in ("path", "n", "conv", "end", "next", "leaves", "saved")))
    if current is not None:
        out += current.rows()
    if out:
        yield batch_of(out)


def shards(containers: DataFrame) -> DataFrame:
    sorted_rows = containers.repartition("head").sortWithinPartitions("head", "path")
    return stage(sorted_rows.mapInArrow(sweep, SWEPT), "trie-nodes")


def raised(swept: DataFrame, heads: list[DataFrame], leaving: DataFrame) -> DataFrame:
    """The nodes of burst containers, from the last round to the first."""
    columns = ["up_head", "n_leaves", "saved_tokens"]
    below = swept.where("kind = 1 and up_head is not null").select(columns)
    below = below.unionByName(leaving.select("up_head", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")))
    nodes = swept.limit(0)
    for big in reversed(heads):
        sums = below.withColumnRenamed("up_head", "at").groupBy("at").agg(
            F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("inner")
        )
        found = big.join(sums, F.col("key") == F.col("at")).select(
            F.lit(1).alias("kind"), "key", F.col("up_head_").alias("up_head"), F.col("least").alias("conv_id"),
            F.col("depth_").alias("depth"), F.col("up_").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
            (F.col("inner") + (F.col("n_convs") - 1) * F.col("top_")).alias("saved_tokens"), F.col("end_").alias("end"),
        )
        found = stage(found, "trie-heads")
        nodes = nodes.unionByName(found)
        below = below.unionByName(found.where("up_head is not null").select(columns))
    return nodes


def build(strings: DataFrame) -> DataFrame:
    """The nodes (kind 0 and 1) and what leaves segments (kind 2) of all containers."""
    containers, heads, leaving = burst(strings)
    swept = shards(containers)
    links = leaving.select(F.col("next").alias("key"), F.col("up").alias("parent_conv_id"))
    nodes = swept.unionByName(raised(swept, heads, leaving))
    return nodes.unionByName(links.withColumn("kind", F.lit(2)), allowMissingColumns=True)


def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring (end, conv_id) of one end as (end, first, text)."""
    end, first, held, size, out = None, 0, [], 0, []
    for batch in batches:
        for key, conv in zip(*(column.to_pylist() for column in batch.columns)):
            if held and (key != end or size > CHUNK):
                out.append((end, first, ",".join(held)))
                held, size = [], 0
            if not held:
                end, first = key, conv
            held.append(str(conv))
            size += len(held[-1]) + 1
        if held:
            out.append((end, first, ",".join(held)))
            held, size = [], 0
        if out:
            columns = [pa.array(column, kind) for column, kind in zip(zip(*out), (pa.string(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["end", "first", "ids"])
            out = []


def hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of an end's chunks, which come in order; no more than one is held."""
    end, state, out = None, None, []
    for batch in batches:
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if key == end:
                state.update(b",")
            else:
                if state:
                    out.append((end, state.hexdigest()))
                end, state = key, hashlib.sha256()
            state.update(ids.encode())
        if len(out) > 1 << 14:
            yield pa.RecordBatch.from_pydict(dict(zip(("end", "ends_sha256"), map(list, zip(*out)))))
            out = []
    if state:
        out.append((end, state.hexdigest()))
        yield pa.RecordBatch.from_pydict(dict(zip(("end", "ends_sha256"), map(list, zip(*out)))))


def end_hashes(segs: DataFrame) -> DataFrame:
    """(end, ends_sha256): a hash of the ids of the conversations that end together.

    A hash has to read its input in order, so an end that very many share is one task's
    reading, of ids that were joined to long texts before.
    """
    end = F.sha2(F.concat(F.col("head").cast("binary"), F.col("path")), 256)
    ends = segs.where("next is null").select(end.alias("end"), "conv_id")
    chunks = ends.repartitionByRange("end", "conv_id").sortWithinPartitions("end", "conv_id")
    chunks = chunks.mapInArrow(join_ids, "end string, first bigint, ids string")
    return chunks.repartition("end").sortWithinPartitions("end", "first").mapInArrow(
        hash_ids, "end string, ends_sha256 string"
    )


def with_deeper(segs: DataFrame, later: DataFrame) -> DataFrame:
    """``segs`` with what the later segments' containers hold, where they are smallest."""
    own = build(suffixes(later)).where("kind = 1 and up_head is null").select(
        F.col("conv_id").alias("c"), F.shiftright("depth", SEGMENT).alias("s"), "n_leaves", "saved_tokens"
    )
    after = Window.partitionBy("conv_id").orderBy(F.desc("seg")).rowsBetween(Window.unboundedPreceding, -1)
    found = segs.drop("leaves", "saved").join(own, (F.col("conv_id") == F.col("c")) & (F.col("seg") == F.col("s")), "left")
    return found.withColumns(
        {
            "leaves": F.coalesce(F.sum("n_leaves").over(after), F.lit(0)),
            "saved": F.coalesce(F.sum("saved_tokens").over(after), F.lit(0)),
        }
    ).drop("c", "s", "n_leaves", "saved_tokens")


def prefix_trie(paths: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv_id, turns, depth, id), see ``grafted``.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256), a row for each distinct beginning, the empty one too. ``conv_id`` is the
    smallest of the conversations that begin so. No conversations, no rows.
    """
    zero = F.lit(0).cast("long")
    segs = stage(segments(paths).withColumns({"leaves": zero, "saved": zero}), "segments")
    later = segs.where("seg > 0")
    if not later.isEmpty():
        segs = stage(with_deeper(segs, later), "segments")
    nodes = stage(build(stage(suffixes(segs), "suffixes")), "trie")
    links = nodes.where("kind = 2").select(F.col("key").alias("of"), F.col("parent_conv_id").alias("above"))
    nodes = nodes.where("kind < 2").withColumnRenamed("parent_conv_id", "known")
    # only heads of later segments look for what is above them
    inner = nodes.where("kind = 0 or up_head is not null or depth = 0").withColumnRenamed("known", "parent_conv_id")
    later = nodes.where("kind = 1 and up_head is null and depth > 0")
    later = later.join(links, F.col("key") == F.col("of")).withColumnRenamed("above", "parent_conv_id")
    nodes = inner.select(NAMES).unionByName(later.select(NAMES))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    none = F.sha2(F.lit("").cast("binary"), 256)
    passed = nodes.where("end is null").select(*columns, none.alias("ends_sha256"))
    ended = nodes.where("end is not null").join(end_hashes(segs), "end")
    return passed.unionByName(ended.select(*columns, "ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """``prefix_trie`` of conversations that begin as the first of their family.

    Turns are ordered by ``turn``, null first, those that share one by role and then by a
    hash of role and text. A null role or text is empty. Rows without a conv_id belong to
    no conversation. Repeated rows are turns of their own. Other columns are not looked at.
    """
    return prefix_trie(grafted(*numbered(conversations)))
