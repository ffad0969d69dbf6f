"""Byte-level BPE as DuckDB queries inside the tasks.

Encoding: a row for each byte of each distinct word, with the word's number, the byte's
position and what comes next. A recursive query joins neighbouring tokens with the merge
table, contracts each word's leftmost pair of minimum rank and goes on until no word has
a pair; of the other rows only the two that a contraction touches are joined again. Decoding: a row for each id, joined with the vocabulary, and an aggregation that
concatenates in order. DuckDB runs in the memory of the Python worker, on one thread,
over blocks of bounded size.

Texts repeat words, so each distinct word is encoded once and remembered. Ids are decoded
text by text. Long texts are worked on in parts: a text is cut before spaces that follow a
character other than white space, where the pattern always cuts, and ids anywhere.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.functions import col

from coterie.llm.tables import blocks, utf8

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
QUERY_BYTES = 1 << 19  # bytes of words in one query
QUERY_IDS = 1 << 20  # that are decoded by one query
PART_IDS = 1 << 16  # in one group of the ordered aggregation
LONG = 128  # a round contracts one pair of a word; longer words take too many rounds
MEMO = 400_000  # of each of the two generations of words that a worker remembers
BLOCK_BYTES = 4 << 20  # of text that is worked on at once
PART_CHARS = 1 << 20  # after which a long text is cut where it can be

ENCODE = """
WITH RECURSIVE step(word, place, token, after, next, pair, round) AS (
    SELECT word, place, token, after, next, merged, 0
    FROM start LEFT JOIN merges ON merges.pair = (token::BIGINT << 32) | next
  UNION ALL
    (WITH best AS (
        SELECT word, min((pair::BIGINT << 16) | (place << 8) | after) AS least
        FROM step WHERE pair IS NOT NULL GROUP BY word
    ), hit AS (
        SELECT word, (least >> 16)::INTEGER AS new, ((least >> 8) & 255)::INTEGER AS spot, place AS gone,
               after AS new_after, next AS new_next
        FROM step JOIN best USING (word) WHERE place = (least & 255)
    ), moved AS (
        SELECT word, place, round, pair AS kept,
               CASE WHEN place = spot THEN new ELSE token END AS token,
               CASE WHEN place = spot THEN new_after ELSE after END AS after,
               CASE WHEN place = spot THEN new_next WHEN after = spot THEN new ELSE next END AS next,
               place = spot OR after = spot IS TRUE AS changed
        FROM step JOIN hit USING (word) WHERE place <> gone
    )
    SELECT word, place, token, after, next, CASE WHEN changed THEN merged ELSE kept END, round + 1
    FROM moved LEFT JOIN merges ON merges.pair = CASE WHEN changed THEN (token::BIGINT << 32) | next END)
), ended AS (
    SELECT word, max(round) AS round FROM step GROUP BY word
)
SELECT word, list(token ORDER BY place) AS ids
FROM step JOIN ended USING (word, round) GROUP BY word ORDER BY word
"""

DECODE = """
SELECT part, string_agg(bytes, '' ORDER BY place) AS bytes
FROM ids JOIN vocabulary USING (id) GROUP BY part ORDER BY part
"""


@functools.lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def merge_rows(ranks: dict[bytes, int]) -> pa.Table:
    """(pair, merged): every two tokens whose bytes together are a token."""
    rows = [
        (ranks[whole[:k]] << 32 | ranks[whole[k:]], token)
        for whole, token in ranks.items()
        for k in range(1, len(whole))
        if whole[:k] in ranks and whole[k:] in ranks
    ]
    return pa.table({"pair": pa.array([r[0] for r in rows]), "merged": pa.array([r[1] for r in rows])})


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one long word, by a heap of pairs and linked neighbours."""
    end = len(word)
    stop = {k: k + 1 for k in range(end)}  # of the token that begins at k
    before = {k: k - 1 for k in range(end)}

    def pair(k: int):
        nxt = stop.get(k, end)
        rank = ranks.get(word[k : stop[nxt]]) if nxt < end else None
        return None if rank is None else (rank, k, nxt, stop[nxt])

    heap = [found for k in range(end - 1) if (found := pair(k))]
    heapq.heapify(heap)
    while heap:
        _, k, nxt, last = heapq.heappop(heap)
        if stop.get(k) != nxt or stop.get(nxt) != last:
            continue  # one of the two is gone or has grown
        stop[k] = last
        del stop[nxt]
        if last < end:
            before[last] = k
        for changed in (before[k], k):
            if changed >= 0 and (found := pair(changed)):
                heapq.heappush(heap, found)
    return [ranks[word[k : stop[k]]] for k in sorted(stop)]


class Memo:
    """What was worked out before, in two generations of bounded size."""

    def __init__(self):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, keys: set[str], work_out: Callable) -> dict[str, bytes]:
        """A table that has all ``keys``; ``work_out`` gives pairs for the ones not known."""
        if len(self.new) > MEMO:
            self.new, self.old = {}, self.new
        missing = keys.difference(self.new)
        self.new.update((key, self.old[key]) for key in missing.intersection(self.old))
        self.new.update(work_out(list(missing.difference(self.old))))
        return self.new


class Coder:
    """Both directions for one rank file and pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.safe_cut = regex.compile(r"(?<=\S)(?= )")
        self.database = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        merges = merge_rows(self.ranks)
        vocabulary = pa.table(
            {
                "id": pa.array(self.ranks.values(), pa.int32()),
                "bytes": [token.decode("latin-1") for token in self.ranks],  # a character for each byte
            }
        )
        for name, rows in (("merges", merges), ("vocabulary", vocabulary)):
            self.database.register("rows", rows)
            self.database.execute(f"CREATE TABLE {name} AS SELECT * FROM rows")
        self.of_byte = np.array([self.ranks[bytes([k])] for k in range(256)], np.int32)
        self.known = np.zeros(max(self.ranks.values()) + 1, np.bool_)
        self.known[list(self.ranks.values())] = True
        self.word_ids = Memo()

    def parts(self, text: str) -> Iterator[str]:
        """A long text, cut where the pattern cuts in any case."""
        begin = 0
        while len(text) - begin > PART_CHARS and (cut := self.safe_cut.search(text, begin + PART_CHARS)):
            yield text[begin : cut.start()]
            begin = cut.start()
        yield text[begin:]

    def encode_words(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each word with its ids, in another order: words of a length take as many rounds."""
        coded = sorted(((text.encode(), text) for text in texts), key=lambda word: len(word[0]))
        words, texts = [word for word, _ in coded], [text for _, text in coded]
        short = sum(len(word) <= LONG for word in words)
        for word, text in zip(words[short:], texts[short:], strict=True):
            yield text, np.array(merge_long(word, self.ranks), "<u4").tobytes()
        for block in blocks([len(word) for word in words[:short]], QUERY_BYTES):
            part = words[block]
            lengths = np.array([len(word) for word in part])
            ends = np.cumsum(lengths)
            place = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
            token = self.of_byte[np.frombuffer(b"".join(part), np.uint8)]
            last = np.zeros(ends[-1], np.bool_)
            last[ends - 1] = True
            start = pa.table(
                {
                    "word": np.repeat(np.arange(len(part), dtype=np.int32), lengths),
                    "place": place.astype(np.int32),
                    "token": token,
                    "after": pa.array((place + 1).astype(np.int32), mask=last),
                    "next": pa.array(np.roll(token, -1), mask=last),
                }
            )
            self.database.register("start", start)
            ids = self.database.sql(ENCODE).to_arrow_table().column("ids").combine_chunks()
            flat = ids.flatten().to_numpy().astype("<u4").tobytes()
            at = (4 * (ids.offsets.to_numpy() - ids.offsets[0].as_py())).tolist()
            yield from zip(texts[block], (flat[a:b] for a, b in zip(at, at[1:])), strict=True)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [list(self.parts(text)) for text in texts]
        parts = [part for one in cut for part in one]
        coded = []
        for block in blocks([len(part) for part in parts], BLOCK_BYTES):
            split = [self.pattern.findall(part) for part in parts[block]]
            ids = self.word_ids.get(set().union(*split), self.encode_words)
            coded += [b"".join(map(ids.__getitem__, words)) for words in split]
        each = iter(coded)
        return [b"".join(islice(each, len(one))) for one in cut]

    def decode(self, coded: list[bytes]) -> list[bytes]:
        """The bytes of each text's ids; an id that is not in the file is an error."""
        counts = [max(1, -(-len(one) // (4 * PART_IDS))) for one in coded]
        step = 4 * PART_IDS
        parts = [one[k * step : (k + 1) * step] for one, count in zip(coded, counts) for k in range(count)]
        decoded = []
        for block in blocks([len(part) // 4 for part in parts], QUERY_IDS):
            lengths = np.array([len(part) // 4 for part in parts[block]])
            ids = np.frombuffer(b"".join(parts[block]), "<u4")
            if not self.known.take(ids, mode="clip").all() or ids.max(initial=0) >= len(self.known):
                raise ValueError("an id is not in the rank file")
            begins = np.cumsum(lengths) - lengths
            rows = pa.table(
                {
                    "part": np.repeat(np.arange(len(lengths), dtype=np.int32), lengths),
                    "place": (np.arange(len(ids)) - np.repeat(begins, lengths)).astype(np.int32),
                    "id": ids.astype(np.int32),
                }
            )
            self.database.register("ids", rows)
            found = self.database.sql(DECODE).to_arrow_table()
            out = [b""] * len(lengths)
            for k, text in zip(found.column("part").to_pylist(), found.column("bytes").to_pylist()):
                out[k] = text.encode("latin-1")
            decoded += out
        each = iter(decoded)
        return [b"".join(islice(each, count)) for count in counts]


@functools.lru_cache(maxsize=1)
def coder(path: str, pattern: str) -> Coder:
    """One for each Python worker."""
    return Coder(path, pattern)


@dataclass(frozen=True)
class Run:
    """What a task does to (doc_id, text) or (doc_id, ids)."""

    path: str
    pattern: str
    encode: bool
    decode: bool

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = coder(self.path, self.pattern)
        for batch in batches:
            values = utf8(batch.column(1))
            for part in blocks([len(value) for value in values], BLOCK_BYTES):
                ids = tool.encode([v.decode() for v in values[part]]) if self.encode else values[part]
                columns = {"doc_id": batch.column(0).slice(part.start, part.stop - part.start)}
                if self.encode:
                    columns["ids"] = pa.array(ids, pa.binary())
                if self.decode:
                    columns["decoded"] = pa.array(tool.decode(ids), pa.binary())
                yield pa.RecordBatch.from_pydict(columns)


def run(frame: DataFrame, column: str, path: str, pattern: str, encode: bool, decode: bool) -> DataFrame:
    shape = f"doc_id {frame.schema['doc_id'].dataType.simpleString()}"
    shape += ", ids binary" * encode + ", decoded binary" * decode
    task: Callable = Run(path, pattern, encode, decode)
    return frame.select("doc_id", col(column)).mapInArrow(task.__call__, shape)


def encode_texts(docs: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids) of every row's whole text, ids as little-endian unsigned 32 bit.

    Each match of ``pattern`` is merged by itself, without special tokens. A null text
    is empty and has no ids. Rows come out one for one, also repeated ones and those
    without a doc_id. Other columns are not looked at. No shuffle.
    """
    return run(docs, "text", path, pattern, True, False)


def decode_ids(coded: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, decoded) of (doc_id, ids): the bytes that the ids stand for."""
    return run(coded, "ids", path, pattern, False, True)


def round_trip(docs: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids, decoded): both directions in one task, so the ids are not written."""
    return run(docs, "text", path, pattern, True, True)
