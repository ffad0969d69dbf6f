"""The trie beside one built from nested dictionaries in plain Python."""

import hashlib
import random
import zlib

import pytest

from coterie.llm import prefix_trie
from coterie.llm.prefix_trie import conversation_trie

SHAPE = "conv_id bigint, turn bigint, role string, text string"


def rebuilt(rows):
    talks = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            size = len(text.encode())
            print_ = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest() + f"{size:08x}"
            talks.setdefault(conv, []).append((turn is not None, turn or 0, role, print_, text))
    talks = {conv: [(t[2], t[4]) for t in sorted(said)] for conv, said in talks.items()}
    out = {}
    for conv, said in talks.items():
        h = zlib.crc32(str(conv).encode()) % 9
        base = conv - (conv % 5 if conv >= 0 else -(-conv % 5))
        out[conv] = talks.get(base, [])[:h] + said[h:]
    return out


def brute(rows):
    members = {}
    talks = rebuilt(rows)
    for conv, said in talks.items():
        for d in range(len(said) + 1):
            members.setdefault(tuple(said[:d]), []).append(conv)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    found = {}
    for node in sorted(members, key=len, reverse=True):
        below = [found[child] for child in children.get(node, [])]
        saved = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        leaves = sum(b[0] for b in below) if below else 1
        found[node] = (leaves, saved + sum(b[1] for b in below))
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(talks[c]) == len(node))
        out.append(
            (min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children.get(node, [])))
            + found[node]
            + (hashlib.sha256(ends.encode()).hexdigest(),)
        )
    return sorted(out, key=repr)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def conversations(seed, talks, most, texts):
    rng = random.Random(seed)
    rows = []
    for conv in range(-talks // 4, talks):
        for turn in range(rng.randrange(1, most)):
            rows.append((conv, turn, rng.choice(["user", "assistant"]), "é" * rng.randrange(texts)))
    return rows


@pytest.mark.parametrize("segment, burst", [(10, 1 << 16), (2, 200), (10, 60)])
def test_matches_brute_force(spark, segment, burst, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    monkeypatch.setattr(prefix_trie, "BURST", burst)
    monkeypatch.setattr(prefix_trie, "CHUNK", 20)
    rows = conversations(1, 80, 14, 2)
    # copies, and conversations that share more than a segment
    rows += [(conv, turn, "user", "same") for conv in range(200, 230) for turn in range(10)]
    rows += [(conv, 10, "user", f"other {conv % 3}") for conv in range(200, 230, 2)]
    frame = spark.createDataFrame(rows, SHAPE).repartition(7)
    assert found(conversation_trie(frame)) == brute(rows)


def test_nulls_ties_and_repeats(spark):
    rows = [(None, 0, "user", "lost"), (1, None, None, "a"), (1, 0, "user", None), (1, 0, "bot", "z"), (1, 0, "bot", "z")]
    rows += [(2, 5, "user", "b"), (3, -1, "", ""), (3, 7, "user", "long " * 300_000), (25, 0, "user", "b")]
    assert found(conversation_trie(spark.createDataFrame(rows, SHAPE))) == brute(rows)


def test_no_rows_and_extra_columns(spark):
    rows = [(5, 0, "user", "hello"), (6, 0, "user", "hello")]
    frame = spark.createDataFrame(rows, SHAPE)
    more = frame.selectExpr("*", "1 as id", "2 as head", "3 as depth", "4 as place", "5 as n")
    assert found(conversation_trie(more)) == brute(rows)
    assert conversation_trie(frame.limit(0)).collect() == []


def test_one_very_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SEGMENT", 5)
    rows = [(conv, turn, "user", str(turn % 3)) for conv in (0, 1, 5, 50) for turn in range(400)]
    assert found(conversation_trie(spark.createDataFrame(rows, SHAPE))) == brute(rows)
