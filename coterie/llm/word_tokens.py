"""Encoding texts with a tokenizers file, each distinct word once.

The vocabulary drops white space before any merge and joins nothing across it, so a
text's ids are those of its white-space-separated words in order. Words repeat: Arrow
numbers the distinct ones of a block, the library encodes those not seen yet, and a
bounded memo gives the others.
"""

from __future__ import annotations

import functools
import json
import os
import re
import string

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, models, pre_tokenizers

from coterie.llm.tables import blocks

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
MOST_WORDS = 400_000  # of each of the memo's two generations
BLOCK_BYTES = 4 << 20
RUN = 256  # words encoded in one go
MARK = "\x01"  # a word of its own, which no other word's ids hold
#: Letters that neither composition nor lower-casing changes, whatever letters are beside them.
PLAIN = string.ascii_lowercase + "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
PLAIN_WORD = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
POINTS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
#: Last bytes of letters and digits: ASCII, and after C3.
ENDS, ENDS_C3 = np.zeros((2, 256), np.bool_)
ENDS[list((string.ascii_letters + string.digits).encode())] = True
ENDS_C3[[*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)]] = True


def halves(words: pa.StringArray) -> pa.StringArray:
    """Each word as two parts that lie next to each other: up to a letter or digit that only
    points follow, and these points. A merge never crosses from one to the other. Other
    words, and those that may hold a special string, stay whole; their second part is empty.
    """
    _, at, flat = words.buffers()
    at = np.frombuffer(at, np.int32)[: len(words) + 1]
    size = pc.binary_length(pc.ascii_rtrim(words, characters=POINTS)).to_numpy()
    whole = pc.match_substring(words, "<").to_numpy(zero_copy_only=False) | (size == 0)
    middle = at[:-1] + size
    if not whole.all():
        data = np.frombuffer(flat, np.uint8)
        last, before = data[middle - 1], data[np.maximum(middle - 2, 0)]
        whole |= ~(ENDS[last] | ENDS_C3[last] & (before == 0xC3))
    cuts = np.append(np.column_stack([at[:-1], np.where(whole, at[1:], middle)]), at[-1:])
    return pa.StringArray.from_buffers(2 * len(words), pa.py_buffer(cuts.astype(np.int32)), flat)


def joined(parts: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
    """Every two neighbours as one value."""
    _, at, flat = parts.buffers()
    cuts = np.frombuffer(at, np.int64)[: len(parts) + 1 : 2].copy()
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(parts) // 2, [None, pa.py_buffer(cuts), flat])


def letters_only(path: str) -> tuple[Tokenizer, np.ndarray] | None:
    """The file's merges without its normalizer and patterns, for words of PLAIN letters,
    and which ids end a word; None if such words do not come out the same.

    No cache: each word comes once.
    """
    with open(path, encoding="utf-8") as file:
        spec = {key: value for key, value in json.load(file)["model"].items() if value is not None}
    if spec.pop("type", "") != "BPE" or not spec.get("end_of_word_suffix"):
        return None
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec.pop("merges")]
    light = Tokenizer(models.BPE(merges=merges, cache_capacity=0, **spec))
    bytewise = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    light.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), bytewise])
    suffix, vocab = spec["end_of_word_suffix"], spec["vocab"]
    last = np.zeros(max(vocab.values()) + 1, np.bool_)
    last[[number for token, number in vocab.items() if token.endswith(suffix)]] = True
    whole = Tokenizer.from_file(path)
    samples = [PLAIN, PLAIN[::-1], *PLAIN]
    same = all(
        light.encode(one, add_special_tokens=False).ids == whole.encode(one, add_special_tokens=False).ids
        for one in samples
    )
    spelt = {letter for piece, _ in bytewise.pre_tokenize_str(PLAIN) for letter in piece}
    return (light, last) if same and all({c, c + suffix} <= vocab.keys() for c in spelt) else None


class WordEncoder:
    """Gives ids as bytes, little-endian unsigned 32 bit."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives one task one core
        self.tokenizer = Tokenizer.from_file(path)
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        small, large = (
            self.tokenizer.encode(letters, add_special_tokens=False).ids
            for letters in (string.ascii_lowercase, string.ascii_uppercase)
        )
        self.folds = small == large
        self.light = letters_only(path)
        self.memo: dict[bytes, bytes] = {b"": b""}
        self.old: dict[bytes, bytes] = {}

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [np.array(one.ids, "<u4").tobytes() for one in found]

    def encode_runs(self, words: list[bytes]) -> list[bytes]:
        """The same for words without the mark: runs of them, cut at the marks' ids."""
        mark = f" {MARK} ".encode()
        runs = [mark.join(words[k : k + RUN]).decode() for k in range(0, len(words), RUN)]
        out = []
        for one in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False):
            ids = np.array(one.ids, "<u4")
            ends = np.flatnonzero(ids == self.mark)
            flat, cuts = ids.tobytes(), (4 * ends).tolist()
            out += [flat[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(flat)])]
        return out

    def encode_plain(self, words: list[bytes]) -> list[bytes]:
        """The same for words of PLAIN letters, whose last tokens tell themselves."""
        light, last = self.light
        runs = [b" ".join(words[k : k + RUN]).decode() for k in range(0, len(words), RUN)]
        out = []
        for one in light.encode_batch_fast(runs, add_special_tokens=False):
            ids = np.array(one.ids, "<u4")
            flat, cuts = ids.tobytes(), (4 * np.flatnonzero(last[ids]) + 4).tolist()
            out += [flat[a:b] for a, b in zip([0, *cuts], cuts)]
        return out

    def learn(self, new: list[bytes]) -> None:
        mark = MARK.encode()
        plain = [word for word in new if PLAIN_WORD.fullmatch(word)] if self.light else []
        others = set(new).difference(plain)
        odd = [word for word in others if mark in word] if self.mark is not None else list(others)
        rest = list(others.difference(odd))
        self.memo.update(zip(plain, self.encode_plain(plain), strict=True))
        self.memo.update(zip(odd, self.encode_words(odd), strict=True))
        self.memo.update(zip(rest, self.encode_runs(rest), strict=True))

    def look_up(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of the words, which are distinct."""
        if len(self.memo) > MOST_WORDS:
            self.memo, self.old = {b"": b""}, self.memo
        memo, old = self.memo, self.old
        found = list(map(memo.get, words))
        missing = [k for k, ids in enumerate(found) if ids is None]
        self.learn([words[k] for k in missing if words[k] not in old])
        for k in missing:
            word = words[k]
            if (ids := memo.get(word)) is None:  # brought over
                ids = memo[word] = old[word]
            found[k] = ids
        return found

    def folded(self, text: bytes) -> bytes:
        """With A-Z lowered, if the vocabulary does so in any case. A capital before a
        combining mark (lead bytes CC and CD) may not compose as its small letter does, and
        capitals in special strings make them ordinary text."""
        safe = self.folds and b"\xcc" not in text and b"\xcd" not in text and b"<|" not in text
        return text.lower() if safe else text

    def encode_block(self, texts: list[bytes], tail: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, each with ``tail``, and where each text
        begins, with the end of all. Texts are parted at ASCII white space, which the
        vocabulary drops."""
        words = pc.ascii_split_whitespace(pa.array([self.folded(text) for text in texts], pa.string()))
        coded = words.flatten().dictionary_encode()
        parts = halves(coded.dictionary).dictionary_encode()
        known = self.look_up(parts.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist())
        pairs = np.r_[parts.indices.to_numpy(), len(known), len(known) + 1]
        ids = joined(pa.array([*known, tail, b""], pa.large_binary()).take(pa.array(pairs)))
        ends = words.offsets.to_numpy()[1:]
        places = np.insert(coded.indices.to_numpy(), ends, len(coded.dictionary))
        _, at, flat = ids.take(pa.array(places)).buffers()
        at = np.frombuffer(at, np.int64)[np.r_[0, ends + np.arange(1, len(ends) + 1)]] // 4
        return np.frombuffer(flat, "<u4", at[-1]) if at[-1] else np.zeros(0, "<u4"), at

    def encode(self, texts: list[bytes], tail: bytes = b"") -> list[bytes]:
        """The ids of each text, and ``tail``."""
        out = []
        for block in blocks([len(text) for text in texts], BLOCK_BYTES):
            ids, at = self.encode_block(texts[block], tail)
            flat, cuts = ids.tobytes(), (4 * at).tolist()
            out += [flat[a:b] for a, b in zip(cuts, cuts[1:])]
        return out


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One for each Python worker, so the memo lasts over its tasks."""
    return WordEncoder(path)
