"""Line dedup against a plain reading of its rule."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from coterie.llm.line_dedup import CHUNK_BITS, drop_repeated_lines

SCHEMA = "doc_id long, text string, n_lines string, drop string, id string"
SPACES = " \t\n\x0b\x0c\r"


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACES))


def plain(rows, min_chars, min_docs):
    holders = defaultdict(list)
    for doc_id, text in rows:
        for k in {key(line) for line in (text or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].append(doc_id)
    keeper = {
        k: max(ids, key=lambda d: (d is not None, d)) for k, ids in holders.items() if len(ids) >= min_docs
    }
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        rest = [x for x in lines if keeper.get(key(x), doc_id) == doc_id]
        out.append((doc_id, "\n".join(rest), len(lines), len(lines) - len(rest)))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    lines = ["x" * 9, "é" * 10, "É" * 10, "A line that repeats", "a LINE that repeats \t", "", "  ", "漢字" * 6]
    lines += [f"line number {k}" for k in range(12)]
    rows = [(rng.randrange(40), "\n".join(rng.choices(lines, k=rng.randrange(6)))) for _ in range(60)]
    return rows + [(None, "A line that repeats"), (None, None), (7, None), (8, ""), rows[0], rows[0]]


def result(spark, rows, **options):
    docs = spark.createDataFrame([(*row, "a", "b", "c") for row in rows], SCHEMA).repartition(5)
    found = drop_repeated_lines(docs, **options)
    assert found.columns == ["doc_id", "text", "drop", "id", "n_lines", "n_dropped"]
    assert {(r.drop, r.id) for r in found.collect()} == {("b", "c")}
    return sorted(
        ((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in found.collect()), key=repr
    )


def test_matches_the_rule(spark):
    for seed in range(3):
        rows = corpus(seed)
        for bits in (None, CHUNK_BITS):
            found = result(spark, rows, min_chars=10, min_docs=3, bits=bits)
            assert found == plain(rows, 10, 3)


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    rows = corpus(9)
    import numpy as np

    from coterie.llm import line_dedup

    monkeypatch.setattr(line_dedup, "twice_filter", lambda texts, bits, chars: np.full(1 << 17, 255, np.uint8))
    assert result(spark, rows, min_chars=10, min_docs=3, bits=20) == plain(rows, 10, 3)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert drop_repeated_lines(docs).collect() == []


def test_very_long_text(spark):
    line = "the same line with forty characters or more, again"
    rows = [(k, "\n".join([line] * 20_000)) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_dropped, r.n) for r in drop_repeated_lines(docs).select("doc_id", "n_dropped", F.length("text").alias("n")).collect()}
    assert found == {k: (20_000, 0) for k in range(4)} | {4: (0, len(rows[4][1]))}
