"""Token counts: encodes in batches of equal bytes and returns lengths only."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from coterie.llm.tables import blocks, utf8

PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
BATCH_BYTES = 1 << 19
LONG = 1 << 16  # longer texts are split
SPACE = "▁"  # how the vocabulary writes a space
BOUNDARY = re.compile(rb"(?<=[A-Za-z]) (?=[A-Za-z])")


@functools.lru_cache(maxsize=2)
def piece_model(path: str) -> tuple[sentencepiece.SentencePieceProcessor, bool]:
    """The model, and whether a text may be split before a word.

    It may if no piece holds a space after another character (then no merge crosses
    the boundary) and each text gets a space in front (which stands for the one that
    the split takes away). Both are read off the model.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    safe = not any(SPACE in piece.lstrip(SPACE) for piece in pieces)
    same = model.encode("a a", out_type=str) == 2 * model.encode("a", out_type=str)
    return model, safe and same


def split_long(text: bytes, most: int = LONG) -> list[bytes]:
    """Parts of about ``most`` bytes, cut at a space between two ASCII letters.

    A stretch without such a space stays whole.
    """
    parts, begin = [], 0
    while len(text) - begin > most:
        cut = BOUNDARY.search(text, begin + most)
        if not cut:
            break
        parts.append(text[begin : cut.start()])
        begin = cut.end()
    return [*parts, text[begin:]]


def lengths(path: str, limit: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, splits = piece_model(path)
        for batch in batches:
            texts = utf8(batch.column(1))
            parts = [split_long(text) if splits else [text] for text in texts]
            flat = [part.decode() for one in parts for part in one]
            sizes = [len(part) for one in parts for part in one]
            counts = np.zeros(len(flat) + 1, np.int64)
            for block in blocks(sizes, BATCH_BYTES):
                encoded = model.encode(flat[block], num_threads=1)
                counts[block.start + 1 : block.stop + 1] = [len(ids) for ids in encoded]
            upto = np.cumsum(counts)
            ends = np.cumsum([len(one) for one in parts])
            totals = np.diff(upto[ends], prepend=0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(text) for text in texts], pa.int64()),
                    pa.array(totals),
                    pa.array(totals > limit),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return count


def count_tokens(docs: DataFrame, model: str = PIECE_BPE, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row's whole text.

    ``model`` is a sentencepiece file that each executor can open. A null text counts
    as an empty one: 0 bytes, 0 tokens. Rows come out one for one, repeated ones and
    those with a null doc_id too; other columns are not looked at. No shuffle.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        lengths(model, limit),
        f"doc_id {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean",
    )
