"""Held-out accuracy, pairwise interactions and edge cases of the classifier."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from coterie.llm import toxicity
from coterie.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"
PLAIN = ["".join(p) for p in itertools.product("bdfg", "aeio", "lmnr", "aou")]


def test_held_out_accuracy(spark):
    """On rows it never saw; a few labels of the table are noise."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = QUERIES["op3_toxicity"](spark, SF).join(labels, "doc_id").where("held_out").collect()
    toxic = [r for r in scored if r.toxic]
    clean = [r for r in scored if not r.toxic]
    assert np.mean([r.predicted for r in toxic]) > 0.8
    assert np.mean([r.predicted for r in clean]) < 0.005
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in scored)


def test_folds_follow_the_id(spark):
    rows = spark.range(200).select(F.col("id").alias("doc_id"))
    for row in rows.withColumn("held_out", toxicity.held_out()).collect():
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 3 == 1)


def test_a_pair_counts_for_more_than_its_parts():
    """Toxic only where an insult meets the mention of a group."""
    rng = random.Random(1)
    rows, labels = [], []
    for _ in range(3000):
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        text = rng.choices(PLAIN, k=12) + ["dolt"] * insult + ["marsians"] * group
        rows.append(toxicity.buckets(" ".join(text).encode()))
        labels.append(float(insult and group))
    machine = toxicity.fit(rows, np.array(labels))
    place = {bucket: k for k, bucket in enumerate(machine.inputs.tolist())}

    def score(text):
        return machine.score(np.array(sorted(place[b] for b in toxicity.buckets(text.encode()) if b in place), int))

    assert score("bala dolt marsians") > 0.7
    assert score("bala dolt") < 0.3 and score("dilo marsians") < 0.3 and score("bala") < 0.3


def plain_score(bias, weights, factors, present):
    total = bias + sum(weights[i] for i in present)
    for i, j in itertools.combinations(present, 2):
        total += sum(a * b for a, b in zip(factors[i], factors[j]))
    return 1 / (1 + np.exp(-total))


def test_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    machine = toxicity.Machine(-0.3, np.arange(9), rng.normal(size=9), rng.normal(size=(9, 4)))
    for size in range(10):
        present = np.sort(rng.choice(9, size, replace=False))
        wanted = plain_score(machine.bias, machine.weights, machine.factors, present.tolist())
        assert machine.score(present) == pytest.approx(wanted, rel=1e-12)


def test_pair_interactions_match_plain_counts():
    """The z scores of pairs beside log odds ratios counted one by one."""
    rng = np.random.default_rng(4)
    terms = np.array([3, 8, 21, 40, 77], np.int64)
    rows = [np.sort(rng.choice(terms, rng.integers(0, 6), replace=False)).astype(np.int32) for _ in range(900)]
    labels = rng.integers(0, 2, len(rows))
    one = [row for row, label in zip(rows, labels) if label]
    zero = [row for row, label in zip(rows, labels) if not label]

    def z(a, b):
        ratio = spread = 0.0
        for part, sign in ((one, 1), (zero, -1)):
            cells = np.full((2, 2), 0.5)
            for row in part:
                cells[int(a in row), int(b in row)] += 1
            ratio += sign * np.log(cells[1, 1] * cells[0, 0] / cells[0, 1] / cells[1, 0])
            spread += (1 / cells).sum()
        return abs(ratio) / np.sqrt(spread)

    wanted = [max(z(a, b) for b in terms if b != a) for a in terms]
    assert toxicity.interactions(one, zero, terms) == pytest.approx(wanted, rel=1e-4)


def test_words_of_a_long_text():
    text = " ".join("".join(p) for p in itertools.product("abcdefgh", repeat=6)).encode()
    found = toxicity.buckets(text)
    assert len(found) > 200_000 and (np.diff(found) > 0).all()


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, score string, label int, held_out int")


def test_edge_rows(spark):
    rng = random.Random(3)
    rows = [
        (k, " ".join(rng.choices(PLAIN, k=8)) + (" you fool" if k % 4 == 0 else ""), "x", 7, 0)
        for k in range(400)
    ]
    rows += [(None, "you fool", "x", 1, 0), (1000, None, "x", 1, 0), (1001, "", "x", 1, 0), (1001, "you FOOL, " * 30_000, "x", 1, 0)]
    labels = spark.createDataFrame(
        [(k, int(k % 4 == 0)) for k in range(400)] + [(None, 1), (1000, None), (5, 3)], "doc_id long, toxic int"
    )
    found = toxicity.classify(frame(spark, rows).repartition(3), labels).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found if r.doc_id != 1001}
    assert by_id[None].predicted == 1 and not by_id[None].held_out
    assert by_id[1000].predicted == 0
    assert sorted(r.predicted for r in found if r.doc_id == 1001) == [0, 1]
    assert all(by_id[k].predicted == (k % 4 == 0) for k in range(400))
    kept = toxicity.without_toxic(frame(spark, rows).repartition(3), labels)
    assert kept.columns == ["doc_id", "text", "score", "label", "held_out"]
    assert kept.count() == 300 + 2


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(1, 1)]])
def test_little_to_learn_from(spark, labels):
    docs = frame(spark, [(1, "a b", "x", 1, 0), (2, None, "x", 1, 0)])
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    assert [0 <= r.score <= 1 for r in toxicity.classify(docs, known).collect()] == [True, True]
    assert toxicity.classify(docs.where("false"), known).collect() == []


def test_reading_is_parallel_and_the_fit_bounded(spark, tmp_path, monkeypatch):
    """Every partition's texts are hashed in a task of their own; a shared id adds no rows."""
    buckets, fit = toxicity.buckets, toxicity.fit

    def noted_buckets(text):
        from pyspark import TaskContext

        (tmp_path / f"task-{TaskContext.get().taskAttemptId()}").touch()
        return buckets(text)

    def noted_fit(rows, labels):
        (tmp_path / "rows").write_text(str(len(rows)))
        return fit(rows, labels)

    monkeypatch.setattr(toxicity, "buckets", noted_buckets)
    monkeypatch.setattr(toxicity, "fit", noted_fit)
    rng = random.Random(4)
    rows = [(7 if k % 2 else k, " ".join(rng.choices(PLAIN, k=8)), "x", 0, 0) for k in range(1200)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 6), frame(spark, rows[:1]).schema)
    labels = spark.createDataFrame([(k, k % 4 // 2) for k in range(0, 1200, 2)] + [(7, 1)], "doc_id long, label int")
    toxicity.train(docs, labels, rows=300)
    assert len(list(tmp_path.glob("task-*"))) == 6
    assert int((tmp_path / "rows").read_text()) == 300


@pytest.mark.parametrize("rule", ["both", "one of two", "both or neither"])
def test_pairs_whose_parts_say_little(rule):
    """Log odds of the parts: 1.1 for ``both``, 0 for the others."""
    rng = random.Random(1)
    rows, labels = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        text = rng.choices(PLAIN, k=12) + ["dolt"] * a + ["marsians"] * b
        rows.append(toxicity.buckets(" ".join(text).encode()))
        labels.append(float({"both": a and b, "one of two": a != b, "both or neither": a == b}[rule]))
    machine = toxicity.fit(rows, np.array(labels))
    place = {bucket: k for k, bucket in enumerate(machine.inputs.tolist())}

    def toxic(text):
        return machine.score(np.array(sorted(place[b] for b in toxicity.buckets(text.encode()) if b in place), int)) > 0.7

    found = [toxic(text) for text in ("bala dolt marsians", "bala dolt", "dilo marsians", "bala")]
    assert found == {
        "both": [True, False, False, False],
        "one of two": [False, True, True, False],
        "both or neither": [True, False, False, True],
    }[rule]
