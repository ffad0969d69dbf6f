"""Tokens, packing and files against the libraries themselves."""

import base64
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from coterie.llm import byte_bpe, packing, token_counts, token_files, word_tokens
from coterie.llm.queries import QUERIES

ODD = "ab cC\n\t '  séß漢字12 .!? 　\x85\x1c\x01🙂éJ̌Å<|endoftext|>'s"
SCHEMA = "doc_id long, text string, ids string, shard int, length string"


def odd_texts(seed, count=300):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(80))) for _ in range(count)]
    return texts + ["", " ", "\n", "a" * 2000, "<|endoftext|>", "x<|endoftext|> y <|startoftext|>", "\x01 \x01a", "J̌ H̱"]


def documents(spark, folder):
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    return {r.doc_id: r.text or "" for r in frame.collect()}


def edge_rows():
    rows = [(k, text) for k, text in enumerate(odd_texts(4, 60))]
    return rows + [(None, "no id"), (3, None), (3, "again"), (3, "again"), (90, "word " * 60_000)]


def edge_docs(spark):
    return spark.createDataFrame([(*row, "x", 1, "y") for row in edge_rows()], SCHEMA).repartition(4)


def word_ids(texts):
    tokenizer = Tokenizer.from_file(word_tokens.WORD_BPE)
    return [one.ids for one in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_words_encode_as_whole_texts(monkeypatch):
    monkeypatch.setattr(word_tokens, "MOST_WORDS", 50)  # the memo turns over
    encoder = word_tokens.WordEncoder(word_tokens.WORD_BPE)
    for seed in range(3):
        texts = odd_texts(seed)
        found = [np.frombuffer(one, "<u4").tolist() for one in encoder.encode([t.encode() for t in texts])]
        assert found == word_ids(texts)


def test_plain_words_go_straight_to_the_merges(monkeypatch):
    """Only what composes, folds or parts goes through the normalizer and the patterns."""
    whole = []
    for name in ("encode_words", "encode_runs"):
        method = getattr(word_tokens.WordEncoder, name)
        monkeypatch.setattr(word_tokens.WordEncoder, name, lambda self, words, m=method: whole.extend(words) or m(self, words))
    encoder = word_tokens.WordEncoder(word_tokens.WORD_BPE)
    text = "Plain words, straßen; Été. naïve### don't 3rd x÷"
    assert np.frombuffer(encoder.encode([text.encode()])[0], "<u4").tolist() == word_ids([text])[0]
    assert sorted(whole) == sorted(", ; . ### Été don't 3rd x÷".encode().split())



def test_words_of_letters_and_points_encode_as_whole_texts():
    rng = random.Random(9)
    encoder = word_tokens.WordEncoder(word_tokens.WORD_BPE)
    letters = "".join(map(chr, [*range(0x21, 0x7F), *range(0xA1, 0x100)])) + "̸̧́ſİ字"
    texts = [" ".join("".join(rng.choices(letters, k=rng.randrange(1, 7))) for _ in range(50)) for _ in range(200)]
    texts += [" ".join(a + b for a in word_tokens.PLAIN for b in one) for one in letters]
    texts += [" ".join("x" + a + b + c for b in letters[:94] for c in "=.a'̸") for a in letters]
    found = encoder.encode([t.encode() for t in texts], b"tail")
    assert [np.frombuffer(one[:-4], "<u4").tolist() for one in found] == word_ids(texts)
    assert {one[-4:] for one in found} == {b"tail"}


def test_halves_and_blocks_of_nothing():
    encoder = word_tokens.word_encoder(word_tokens.WORD_BPE)
    assert word_tokens.halves(pa.array([], pa.string())).to_pylist() == []
    found = word_tokens.halves(pa.array(["", "a", "a.", "...", "é!", "×!", "x<.", "字.", "ab#c$$"])).to_pylist()
    assert found == ["", "", "a", "", "a", ".", "...", "", "é", "!", "×!", "", "x<.", "", "字.", "", "ab#c", "$$"]
    for texts, tail in (([b""], b""), ([b"", b" \n"], b""), ([b"", b"a", b"  "], b"tail")):
        ids, at = encoder.encode_block(texts, tail)
        assert at.tolist()[-1] == len(ids) and len(at) == len(texts) + 1
    assert encoder.encode([]) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=8))
def test_words_encode_as_any_text(texts):
    found = [np.frombuffer(one, "<u4").tolist() for one in word_tokens.word_encoder(word_tokens.WORD_BPE).encode([t.encode() for t in texts])]
    assert found == word_ids(texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=9), max_size=6))
def test_numbers_come_back(documents):
    counts = np.array([len(one) for one in documents], np.int64)
    numbers = np.array([n for one in documents for n in one], np.uint32)
    control, data = token_files.pack(numbers, counts)
    assert [len(c) for c in control] == [-(-len(one) // 4) for one in documents]
    assert token_files.unpack(b"".join(control), b"".join(data), counts).tolist() == numbers.tolist()
    for one, c, d in zip(documents, control, data):
        assert token_files.unpack(c, d, np.array([len(one)])).tolist() == one


def test_token_files_of_edge_cases(spark, tmp_path):
    for shards in (1, 7):
        path = str(tmp_path / f"files{shards}")
        token_files.write_token_files(edge_docs(spark), path, end_id=2, shards=shards)
        found = token_files.read_token_files(spark, path).orderBy("start").collect()
        rows = edge_rows()
        expected = sorted((d is not None, d or 0, ids + [2]) for (d, _), ids in zip(rows, word_ids([t or "" for _, t in rows])))
        got = [(r.doc_id is not None, r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist()) for r in found]
        assert sorted(got) == expected
        assert [g[:2] for g in got] == [e[:2] for e in expected]  # in order
        assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)])[:-1].tolist()
        blocks = spark.read.parquet(f"{path}/blocks")
        size = blocks.agg(F.sum(F.octet_length("control") + F.octet_length("data"))).first()[0]
        assert size < 2 * sum(len(e[2]) for e in expected)


def test_token_files_of_nothing(spark, tmp_path):
    path = str(tmp_path / "none")
    token_files.write_token_files(edge_docs(spark).where("false"), path, end_id=2)
    assert token_files.read_token_files(spark, path).collect() == []


def test_op10(spark, small):
    docs, start = documents(spark, small), 0
    ids = dict(zip(docs, word_ids(list(docs.values()))))
    for row in sorted(QUERIES["op10_token_files"](spark, small).collect()):
        whole = np.array(ids[row.doc_id] + [2], "<u4")
        assert tuple(row) == (row.doc_id, start, len(whole), zlib.crc32(whole.tobytes()))
        start += len(whole)


def packed_well(rows, ids, capacity):
    """Every document whole, every sequence gapless; the number of sequences."""
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length))
    for one in sequences.values():
        end = 0
        for offset, length in sorted(one):
            assert offset == end
            end += length
        assert end <= capacity
    for doc_id, one in pieces.items():
        one.sort()
        assert [p[0] for p in one] == list(range(len(one)))
        assert sum(p[2] for p in one) == len(ids[doc_id])
        assert all(p[2] == capacity for p in one[:-1])
    return len(sequences)


def test_op5(spark, small):
    docs = documents(spark, small)
    ids = {k: v + [1] for k, v in zip(docs, word_ids(list(docs.values())))}
    count = packed_well(QUERIES["op5_best_fit_packing"](spark, small).collect(), ids, 4096)
    assert count <= -(-sum(map(len, ids.values())) // 4096) + 1


def test_packing_over_several_groups(spark):
    rng = random.Random(2)
    rows = [(k, rng.randrange(1, 101), rng.randrange(2**40), "x") for k in range(3000)]
    pieces = spark.createDataFrame(rows, "doc_id long, length long, deal long, grp string")
    found = packing.pack_pieces(pieces, 100, group_rows=300).collect()
    assert sorted(r.doc_id for r in found) == list(range(3000)) and {r.grp for r in found} == {"x"}
    fill = defaultdict(list)
    for r in found:
        fill[r.sequence_id].append((r.offset, r.length))
    for one in fill.values():
        one.sort()
        assert [o for o, _ in one] == np.cumsum([0, *(n for _, n in one)])[:-1].tolist()
        assert sum(n for _, n in one) <= 100
    assert len(fill) <= 1.03 * sum(r[1] for r in rows) / 100


def test_local_search_empties_sequences():
    lengths = np.array([6, 6, 5, 5, 4, 4, 3, 3, 2, 2])  # 40 in four of ten
    poor = [[0, 6], [1, 7], [2, 4], [3, 5], [8], [9]]
    better = packing.local_search([list(one) for one in poor], lengths, 10)
    assert sorted(k for one in better for k in one) == list(range(10))
    assert all(lengths[one].sum() <= 10 for one in better) and len(better) == 4


def test_token_pieces_of_edge_cases(spark):
    found = packing.token_pieces(edge_docs(spark), capacity=50).collect()
    rows = edge_rows()
    whole = sorted([np.array(ids + [1], "<u4").tobytes() for ids in word_ids([t or "" for _, t in rows])])
    assert sum(r.length for r in found) == sum(len(one) // 4 for one in whole)
    assert sum(r.piece == 0 for r in found) == len(rows)
    assert all(len(r.ids) == 4 * r.length <= 200 and r.start == 50 * r.piece for r in found)
    assert packing.pack_pieces(packing.token_pieces(edge_docs(spark).where("false"))).collect() == []


def test_token_counts(spark, small):
    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.PIECE_BPE)
    docs = documents(spark, small)
    for row in QUERIES["op7_token_counts"](spark, small).collect():
        n = len(model.encode(docs[row.doc_id]))
        assert tuple(row) == (row.doc_id, len(docs[row.doc_id].encode()), n, n > 4096)
    found = token_counts.count_tokens(edge_docs(spark), limit=5).collect()
    expected = [(d, len((t or "").encode()), len(model.encode(t or ""))) for d, t in edge_rows()]
    assert sorted(map(repr, ((r.doc_id, r.n_bytes, r.n_tokens) for r in found))) == sorted(map(repr, expected))
    assert all(r.over_limit == (r.n_tokens > 5) for r in found)
    assert token_counts.count_tokens(edge_docs(spark).where("false")).collect() == []


def test_long_texts_split_where_no_token_crosses():
    model, splits = token_counts.piece_model(token_counts.PIECE_BPE)
    assert splits
    rng = random.Random(7)
    for _ in range(20):
        text = "".join(rng.choice("ab cde  \n.é字 1<s>") for _ in range(3000))
        parts = token_counts.split_long(text.encode(), 200)
        assert sum(len(model.encode(p.decode())) for p in parts) == len(model.encode(text))
    assert token_counts.split_long(b"a" * 500, 200) == [b"a" * 500]


def reference():
    with open(byte_bpe.RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(spark, small, monkeypatch):
    encoding = reference()
    docs = documents(spark, small)
    import hashlib

    for row in QUERIES["op6_byte_bpe"](spark, small).collect():
        ids = np.array(encoding.encode_ordinary(docs[row.doc_id]), "<u4").tobytes()
        assert (row.n_tokens, row.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(docs[row.doc_id].encode()).hexdigest()
    coded = byte_bpe.encode_texts(edge_docs(spark))
    assert [f.name for f in coded.schema] == ["doc_id", "ids"]
    back = byte_bpe.decode_ids(coded).collect()
    assert sorted(repr((r.doc_id, bytes(r.decoded))) for r in back) == sorted(
        repr((d, (t or "").encode())) for d, t in edge_rows()
    )
    assert byte_bpe.round_trip(edge_docs(spark).where("false")).collect() == []


def test_byte_bpe_of_odd_texts(monkeypatch):
    encoding = reference()
    monkeypatch.setattr(byte_bpe, "MEMO", 40)
    monkeypatch.setattr(byte_bpe, "QUERY_BYTES", 500)
    coder = byte_bpe.Coder(byte_bpe.RANKS, public_tokenizers.PATTERN)
    rng = random.Random(1)
    texts = odd_texts(11) + ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (127, 128, 129, 400)]
    found = coder.encode(texts)
    assert [np.frombuffer(one, "<u4").tolist() for one in found] == [encoding.encode_ordinary(t) for t in texts]
    assert coder.decode(found) == [t.encode() for t in texts]


def test_byte_bpe_of_long_texts_in_parts(monkeypatch):
    """Texts and ids are worked on in parts; nothing changes where they are cut."""
    encoding = reference()
    for name, size in (("PART_CHARS", 50), ("BLOCK_BYTES", 300), ("PART_IDS", 7), ("QUERY_IDS", 40)):
        monkeypatch.setattr(byte_bpe, name, size)
    coder = byte_bpe.Coder(byte_bpe.RANKS, public_tokenizers.PATTERN)
    rng = random.Random(3)
    texts = ["".join(rng.choice(["ab", "I'll", " ", "  ", "\n", "\t", "é", "字", "12", "!?", "\0", "\x1c", "\u3000"]) for _ in range(n)) for n in (0, 1, 60, 400, 3000)]
    texts += ["", "x" * 400, " " * 400, "\n " * 200, "a " * 300]
    found = coder.encode(texts)
    assert [np.frombuffer(one, "<u4").tolist() for one in found] == [encoding.encode_ordinary(t) for t in texts]
    assert coder.decode(found) == [t.encode() for t in texts]
    assert coder.encode([]) == [] == coder.decode([])
    with pytest.raises(ValueError):
        coder.decode([np.array([5, 10**6], "<u4").tobytes()])


def test_packing_of_short_equal_pieces_keeps_groups_bounded(spark, tmp_path, monkeypatch):
    """A level that opens all it packed still hands on half of its rows at most."""
    pack_lengths = packing.pack_lengths

    def noted(lengths, capacity):
        (tmp_path / f"{len(lengths)}-{random.random()}").touch()
        return pack_lengths(lengths, capacity)

    monkeypatch.setattr(packing, "pack_lengths", noted)
    pieces = spark.range(6000).select(
        F.lit(30).cast("long").alias("length"), F.col("id").alias("deal"), F.col("id").alias("n")
    )
    found = packing.pack_pieces(pieces, 4096, group_rows=300).collect()
    sizes = [int(one.name.split("-")[0]) for one in tmp_path.iterdir()]
    assert max(sizes) <= 300 and sum(sizes) <= 2 * 6000
    assert sorted(r.n for r in found) == list(range(6000))
    places = defaultdict(list)
    for row in found:
        places[row.sequence_id].append(row.offset)
    assert all(sorted(one) == [30 * k for k in range(len(one))] for one in places.values())
    assert max(map(len, places.values())) == 136 and len(places) <= 47


def test_exchanges_ignore_further_equal_lengths():
    rng = random.Random(6)
    for _ in range(300):
        lengths = [rng.choice([3, 5, 7, 11, 20]) for _ in range(24)]
        taker, giver = list(range(14)), list(range(14, 24))
        room = rng.randrange(1, 12)
        gains = [lengths[b] - sum(lengths[a] for a in out) for b in giver for out in [(), *((a,) for a in taker), *((a, c) for a in taker for c in taker if a < c)]]
        gains += [lengths[b] + lengths[c] - lengths[a] for a in taker for b in giver for c in giver if b < c]
        gain, out, taken = packing.best_exchange(taker, giver, lengths, room)
        assert gain == max([g for g in gains if 0 < g <= room], default=0)
        assert gain == sum(lengths[k] for k in taken) - sum(lengths[k] for k in out)
