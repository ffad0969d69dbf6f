"""Quotations against their SQL, on a fixture that has all of their forms."""

import random

import duckdb
from pyspark.sql import functions as F

from coterie.llm.queries import QUOTATION_SQL
from coterie.llm.quotations import link_quotations

SCHEMA = "conv_id long, turn long, role string, text string"


def by_sql(frame, path):
    frame.coalesce(1).write.parquet(path)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}/*.parquet')")
    return sorted(map(repr, connection.execute(QUOTATION_SQL).fetchall()))


def by_spark(frame):
    return sorted(repr(tuple(r)) for r in link_quotations(frame).collect())


def test_all_forms(spark, tmp_path):
    rows = [
        (1, 0, "user", "Hello there\nHow are you?\n\nSecond para\nmore"),
        (1, 1, "assistant", "> hello   THERE\n> How are you?\nFine."),
        (1, 2, "user", "> Fine.\n>> Hello there\n>> how are you?\nGood"),
        (1, 3, "user", "unrelated"),
        (1, 4, "user", "> nothing that was said\nyes"),
        (1, 5, "user", ">Second para\n> more\nok"),
        (1, 6, "user", "intro\n> how are you?\n> extra words\n"),
        (1, 7, "user", "> > fine.\n\n\nlate\n"),
        (1, 8, "user", "> Good\n\n> yes"),
        (2, 0, None, None),
        (2, 1, "user", ">"),
        (2, 2, "user", "> Fine."),  # said in another conversation only
        (None, 3, "user", "> Fine.\nq"),
        (1, None, "user", "> Fine.\nq"),
        (1, 2, "user", "> Fine.\n>> Hello there\n>> how are you?\nGood"),
        (1, 2, "other", "> ok"),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = {(r.turn, r.role): r for r in link_quotations(frame.where("conv_id = 1")).collect()}
    assert found[1, "assistant"].text == "Fine." and found[1, "assistant"].reply_to == 0
    nested = found[2, "user"]
    assert (nested.text, nested.n_quotes, nested.n_linked, nested.reply_to, nested.thread) == ("Good", 2, 2, 1, 0)
    assert (found[4, "user"].n_linked, found[4, "user"].reply_to) == (0, None)
    assert (found[5, "user"].reply_to, found[6, "user"].reply_to, found[8, "user"].reply_to) == (0, 0, 4)
    assert by_spark(frame) == by_sql(frame, str(tmp_path / "c"))


def test_long_conversations(spark, tmp_path):
    """A chain of replies, over many blocks of turns, and a text of many lines."""
    rng = random.Random(2)
    rows = [(7, 0, "user", "line 0")]
    for turn in range(1, 3000):
        before = turn - 1 if turn < 1500 else rng.randrange(turn)
        rows.append((7, turn, "user", f"> line {before}\nline {turn}" if rng.random() < 0.9 else f"line {turn}"))
    rows.append((8, 0, "user", "\n".join(f"said {k}" for k in range(5000))))
    rows.append((8, 1, "user", "\n".join(f"> said {k}" for k in range(5000)) + "\nyes"))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert by_spark(frame) == by_sql(frame, str(tmp_path / "c"))


def test_native_and_empty(spark):
    frame = spark.createDataFrame([(1, 0, "u", "a", 1, 2)], SCHEMA + ", own int, print int")
    found = link_quotations(frame)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert not any(word in text for word in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))
    assert link_quotations(frame.where(F.lit(False))).collect() == []
    assert [r.text for r in found.collect()] == ["a"]
