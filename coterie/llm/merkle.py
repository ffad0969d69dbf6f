"""A Merkle manifest of a dataset, and proofs for many rows by octopus multiproofs.

Every row is a leaf, leaves of one source make a tree of runs of 16, and the trees' tops, in
the order of sources, make another one whose top is the root. A proof of a leaf is what
stands beside it in its run, and beside each run above it, up to the root.

Proofs are made for blocks of neighbouring leaves. A block works out which nodes its
proofs need that it cannot derive from its own leaves: a run is known if all of it is, else
what it lacks is missing. It fetches the union of these once, derives the runs that its
proofs share, and expands each proof by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coterie.llm.places import placed
from coterie.llm.tables import stage

RUN = 4  # a run has 16 nodes: so many bits of a place
BLOCK = 12  # leaves of a block, as bits of a place
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """Its UTF-8 length, a colon and itself; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Lower-case hex SHA-256 of a row."""
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def tampered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def is_tampered(doc_id: Column) -> Column:
    """Whether 5 divides the crc32 of the id's decimal digits; never without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """(source, doc_id, leaf, shown): the row's hash, and that of the row as it is shown."""
    values = [F.col(name) for name in FIELDS]
    other = [*values[:-1], tampered(values[-1])]
    return docs.select(
        "source",
        "doc_id",
        leaf(*values).alias("leaf"),
        F.when(is_tampered(F.col("doc_id")), leaf(*other)).alias("shown"),
    )


def joined(nodes: Column) -> Column:
    """H of (place, hash) of a run, in order."""
    in_order = F.transform(F.sort_array(nodes), lambda node: node["hash"])
    return F.sha2(F.array_join(in_order, "").cast("binary"), 256)


def grow(bottom: DataFrame, name: str) -> DataFrame:
    """(tree, level, place, size, hash) of all nodes above and with (tree, place, size, hash).

    ``size`` is the number of nodes of the tree on that level. Every level is a sixteenth
    of the one below, written before the next.
    """
    level, nodes = 0, bottom.select("tree", F.lit(0).alias("level"), "place", "size", "hash")
    below = nodes.where("size > 1")
    while not below.isEmpty():
        level += 1
        up = below.groupBy("tree", F.shiftright("place", RUN).alias("place")).agg(
            F.shiftright(F.max("size") + (1 << RUN) - 1, RUN).alias("size"),
            joined(F.collect_list(F.struct("place", "hash"))).alias("hash"),  # 16 at most
        )
        above = stage(up.select("tree", F.lit(level).alias("level"), "place", "size", "hash"), name)
        nodes = nodes.unionByName(above)
        below = above.where("size > 1")
    return nodes


class Manifest:
    """The written tree of a table: ``leaves`` with their places, ``nodes``, ``tops``.

    ``leaves``  source, doc_id, leaf, shown, place, size, top_place, top_size
    ``nodes``   top (whether of the tree over sources), tree, level, place, size, hash
    ``root``    the root's hash, None without rows
    """

    def __init__(self, docs: DataFrame):
        found = stage(leaves(docs), "merkle-leaves")
        rows, sizes = placed(found, "source", [F.asc_nulls_first("doc_id"), F.asc("leaf")], "merkle")
        sizes = sizes.withColumnsRenamed({"source": "of", "size": "n"})
        rows = rows.join(sizes, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumnRenamed("n", "size")
        bottom = rows.select(F.col("source").alias("tree"), "place", "size", F.col("leaf").alias("hash"))
        within = grow(bottom, "merkle-nodes")
        tops = stage(within.where("size = 1").select("tree", F.col("hash").alias("subroot")), "merkle-tops")
        one = F.lit(0)  # the tree over sources is a single group
        ranked, total = placed(tops.withColumn("all", one), "all", [F.asc_nulls_first("tree")], "merkle-tops")
        ranked = stage(ranked.join(F.broadcast(total), "all").drop("all"), "merkle-tops")  # one row
        over = grow(ranked.select(F.lit(None).cast("string").alias("tree"), "place", "size", F.col("subroot").alias("hash")), "merkle-nodes")
        self.nodes = within.withColumn("top", F.lit(False)).unionByName(over.withColumn("top", F.lit(True)))
        last = over.where("size = 1").select("hash").first()  # a single node
        self.root = last and last["hash"]
        at = ranked.select(
            F.col("tree").alias("of"), F.col("place").alias("top_place"), F.col("size").alias("top_size"), "subroot"
        )
        self.leaves = rows.join(at, F.col("source").eqNullSafe(F.col("of"))).drop("of")


def run_of(place: int, size: int) -> range:
    begin = place >> RUN << RUN
    return range(begin, min(begin + (1 << RUN), size))


def levels(size: int) -> Iterator[int]:
    """How many nodes each level with something to prove has."""
    while size > 1:
        yield size
        size = -(-size >> RUN)


def missing(places: set[int], size: int) -> Iterator[tuple[int, int]]:
    """(level, place) of the fewest nodes from which proofs of ``places`` follow."""
    for level, count in enumerate(levels(size)):
        runs = {place >> RUN for place in places}
        for run in sorted(runs):
            yield from ((level, p) for p in run_of(run << RUN, count) if p not in places)
        places = runs


def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, source, top, level, place) that a block of leaves has to fetch."""
    out: list[tuple] = []
    for batch in batches:
        for row in batch.to_pylist():
            both = ((False, set(row["places"]), row["size"]), (True, {row["top_place"]}, row["top_size"]))
            for top, places, size in both:
                out += [(row["source"], row["block"], top, *node) for node in missing(places, size)]
        if out:
            columns = [pa.array(column) for column in zip(*out)]
            kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [c.cast(k) for c, k in zip(columns, kinds)], names=["source", "block", "top", "level", "place"]
            )
            out = []


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Trees:
    """What a block knows of a tree: its own leaves, what it fetched, what follows."""

    def __init__(self, known: dict[tuple[int, int], str], size: int):
        self.known, self.sizes = known, list(levels(size))
        self.memo: dict[tuple[int, int, str], str] = {}
        self.beside: dict[tuple[int, int], str] = {}

    def derive(self, places: set[int]) -> None:
        """The runs above ``places``, each once."""
        for level, count in enumerate(self.sizes):
            places = {place >> RUN for place in places}
            for run in places:
                nodes = [self.known[level, p] for p in run_of(run << RUN, count)]
                self.known.setdefault((level + 1, run), digest("".join(nodes)))

    def siblings(self, level: int, place: int) -> list[str]:
        return [self.known[level, p] for p in run_of(place, self.sizes[level]) if p != place]

    def path(self, level: int, place: int) -> str:
        """The siblings of a node and of all above it, left to right, level by level."""
        if level == len(self.sizes):
            return ""
        found = self.beside.get((level, place))
        if found is None:
            found = "".join(self.siblings(level, place)) + self.path(level + 1, place >> RUN)
            if level:  # those of leaves are asked for once
                self.beside[level, place] = found
        return found

    def fold(self, value: str, place: int) -> str:
        """The top that ``value`` gives at ``place`` with the siblings as they are."""
        for level, count in enumerate(self.sizes):
            found = self.memo.get((level, place, value))
            if found is None:
                run = run_of(place, count)
                nodes = [value if p == place else self.known[level, p] for p in run]
                found = self.memo[level, place, value] = digest("".join(nodes))
            value, place = found, place >> RUN
        return value


def expander(siblings: bool):
    """Proofs of one block of leaves from its leaves and what it fetched."""

    def expand(own: pa.Table, fetched: pa.Table) -> pa.Table:
        rows = own.to_pylist()
        first = rows[0]
        known: dict[bool, dict] = {False: {}, True: {}}
        for node in fetched.to_pylist():
            known[node["top"]][node["level"], node["place"]] = node["hash"]
        known[False].update(((0, row["place"]), row["leaf"]) for row in rows)
        known[True][0, first["top_place"]] = first["subroot"]
        source = Trees(known[False], first["size"])
        source.derive({row["place"] for row in rows})
        over = Trees(known[True], first["top_size"])
        over.derive({first["top_place"]})
        top = over.path(0, first["top_place"])
        out = []
        for row in rows:
            text = source.path(0, row["place"]) + top
            shown = row["leaf"] if row["shown"] is None else row["shown"]
            folded = over.fold(source.fold(shown, row["place"]), first["top_place"])
            out.append((row["doc_id"], row["source"], row["leaf"], row["subroot"], digest(text), folded))
            if siblings:
                out[-1] += ([text[k : k + 64] for k in range(0, len(text), 64)],)
        names = ["doc_id", "source", "leaf", "subroot", "proof_sha256", "folded_root", "siblings"]
        columns = dict(zip(names, zip(*out)))
        kinds = {"doc_id": own.schema.field("doc_id").type, "siblings": pa.list_(pa.string())}
        return pa.table({name: pa.array(list(c), kinds.get(name, pa.string())) for name, c in columns.items()})

    return expand


def prove(manifest: Manifest, of: DataFrame | None = None, siblings: bool = True) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified, siblings).

    Proofs for the leaves in ``of``, some rows of ``manifest.leaves``, or for all.
    ``siblings`` is the proof, level by level from the leaf's run to the root's, left to
    right, and ``proof_sha256`` its hash. ``folded_root`` is what the row as it is shown gives
    with the proof, and ``verified`` whether that is the root. A block of 4096 places of a
    source is proved by one task; nodes that many blocks ask for are joined, not gathered.
    """
    rows = (manifest.leaves if of is None else of).withColumn("block", F.shiftright("place", BLOCK))
    blocks = rows.groupBy("source", "block").agg(
        F.collect_list("place").alias("places"),  # 4096 at most
        *(F.first(name).alias(name) for name in ("size", "top_place", "top_size")),
    )
    asked = blocks.mapInArrow(wanted, "source string, block bigint, top boolean, level int, place bigint")
    asked = asked.withColumn("tree", F.when(~F.col("top"), F.col("source")))
    asked = asked.withColumnsRenamed({"top": "t", "level": "l", "place": "p", "tree": "s"})
    same = (F.col("top") == F.col("t")) & (F.col("level") == F.col("l")) & (F.col("place") == F.col("p"))
    same = same & F.col("tree").eqNullSafe(F.col("s"))
    nodes = manifest.nodes
    if of is None:  # what lies within whole blocks follows from their leaves
        nodes = nodes.where(F.col("top") | (F.col("level") >= BLOCK // RUN))
    fetched = asked.join(nodes, same).select("source", "block", "top", "level", "place", "hash")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {id_type}, source string, leaf string, subroot string, proof_sha256 string, folded_root string"
    proofs = (
        rows.groupBy("source", "block")
        .cogroup(fetched.groupBy("source", "block"))
        .applyInArrow(expander(siblings), shape + ", siblings array<string>" * siblings)
    )
    root = F.lit(manifest.root).cast("string")
    proofs = proofs.withColumns({"root": root, "verified": F.col("folded_root") == root})
    names = ["doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return proofs.select(*names, *["siblings"] * siblings)


def prove_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    Rows whose id's crc32 is divisible by 5 are shown with A-Z lowered. Nulls in any field
    are ``-`` in the hash; a null source is the first of the sources, and null ids come
    first in theirs. Rows that share source and doc_id are ordered by their hash; repeated
    rows are leaves of their own. No rows, no result. Other columns are not looked at.
    """
    return prove(Manifest(docs), siblings=False).drop("source")
