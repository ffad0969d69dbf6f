"""Quotation linking: messages without their quotes, in the order of replies.

Lines that begin with ``>`` marks are quoted, as deep as there are marks. A passage, a
run of lines of one depth, is normalised and hashed, and joined to the message of the
same conversation that said it first: its whole text, a paragraph or a line. The
outermost passage that is found names the message that is replied to. Replies then
follow what they reply to, thread by thread. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coterie.llm.tables import stage

MARKS = r"^((?:[ \t]*>)+)"
QUOTED = r"(^|\n)[ \t]*>"
SPACE = r"[\x20\x09-\x0D]+"
PARAGRAPH = r"\n[ \t\r]*\n"
BLOCK = 10  # messages are numbered in blocks of so many (as a power of two) turns
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["conv_id", "turn", "print"]


def normal(text: Column) -> Column:
    """A-Z lowered, runs of ASCII white space one space, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), SPACE, " "))


def digest(text: Column) -> Column:
    return F.sha2(normal(text).cast("binary"), 256)


def depth(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def content(line: Column) -> Column:
    """The line without its marks and one blank after them."""
    return F.regexp_replace(line, MARKS + "[ \t]?", "")


def own_text(text: Column) -> Column:
    """The lines that are not quoted, without blank lines at the ends if any are."""
    rest = F.array_join(F.filter(F.split(text, "\n"), lambda line: ~line.rlike(MARKS)), "\n")
    return F.when(text.rlike(QUOTED), F.regexp_replace(rest, r"^(?:[ \t\r]*\n)+|(?:\n[ \t\r]*)+$", "")).otherwise(text)


def passages(quoting: DataFrame) -> DataFrame:
    """(KEY, passage, depth, lines) of messages with quoted lines."""
    split = quoting.withColumn("line", F.split("text", "\n")).withColumns(
        {
            "deep": F.transform("line", depth),
            "rest": F.transform("line", content),
            "size": F.size("line"),
        }
    )
    begins = F.filter(
        F.sequence(F.lit(1), F.col("size")),
        lambda k: (k == 1) | (F.element_at("deep", k) != F.element_at("deep", F.greatest(k - 1, F.lit(1)))),
    )
    runs = split.withColumn("begin", begins).select(*KEY, "deep", "rest", "size", "begin", F.posexplode("begin").alias("k", "at"))
    end = F.coalesce(F.try_element_at("begin", F.col("k") + 2), F.col("size") + 1)
    return runs.select(
        *KEY,
        F.col("k").alias("passage"),
        F.element_at("deep", F.col("at")).alias("depth"),
        F.slice("rest", F.col("at"), end - F.col("at")).alias("lines"),
    ).where("depth > 0")


def said_first(messages: DataFrame) -> DataFrame:
    """(conv_id, said, first): the first turn that has each text, paragraph or line."""
    units = F.concat(F.array("own"), F.split("own", PARAGRAPH), F.split("own", "\n"))
    said = messages.select("conv_id", "turn", F.explode(F.array_distinct(F.transform(units, normal))).alias("unit"))
    return (
        said.where("unit <> ''")
        .groupBy("conv_id", F.sha2(F.col("unit").cast("binary"), 256).alias("said"))
        .agg(F.min("turn").alias("first"))
    )


def links(messages: DataFrame) -> DataFrame:
    """(KEY, n_quotes, n_linked, reply_to) of the messages that quote."""
    quoting = messages.where(F.col("text").rlike(QUOTED)).select(*KEY, "text").distinct()
    found = stage(passages(quoting), "passages")
    whole = F.struct(F.lit(0).alias("part"), digest(F.array_join("lines", "\n")).alias("said"))
    lines = F.transform(
        F.filter("lines", lambda line: normal(line) != ""),
        lambda line: F.struct(F.lit(1).alias("part"), digest(line).alias("said")),
    )
    asked = found.select(*KEY, "passage", "depth", F.explode(F.array_distinct(F.concat(F.array(whole), lines))).alias("a"))
    asked = asked.select(*KEY, "passage", "depth", "a.part", "a.said")
    talks = found.select("conv_id").distinct()
    sayings = stage(said_first(messages.join(talks, "conv_id", "left_semi")), "sayings")
    matched = asked.join(sayings, ["conv_id", "said"]).where("first < turn")
    # the whole passage before its lines, then the latest of the messages
    best = matched.groupBy(*KEY, "passage", "depth").agg(
        F.min(F.struct("part", (-F.col("first")).alias("back"))).alias("best")
    )
    of_message = best.groupBy(*KEY).agg(
        F.count("*").alias("n_linked"),
        F.min(F.struct("depth", "best.part", "best.back")).alias("chosen"),
    )
    counted = found.groupBy(*KEY).agg(F.count("*").alias("n_quotes"))
    return counted.join(of_message, KEY, "left").select(
        *KEY, "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), (-F.col("chosen.back")).alias("reply_to")
    )


def threads(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, thread): the turn at which each reply's thread begins.

    Every round doubles the distance that is looked back, so a chain of any length
    takes as many rounds as its length has binary digits.
    """
    # a turn that several rows share goes on from the earliest of what they reply to
    state = stage(replies.groupBy("conv_id", "turn").agg(F.min("reply_to").alias("thread")), "threads")
    while True:
        up = state.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("further"))
        state = stage(
            state.join(up, ["conv_id", "thread"], "left").select(
                "conv_id",
                "turn",
                F.coalesce("further", "thread").alias("thread"),
                F.col("further").isNotNull().alias("moved"),
            ),
            "threads",
        )
        if state.where("moved").isEmpty():
            return state.drop("moved")
        state = state.drop("moved")


def positions(rows: DataFrame) -> DataFrame:
    """Adds ``position``: from 0 in each conversation, by thread and turn.

    No task numbers a whole conversation: threads are counted in blocks, the blocks of
    a conversation and the threads of a block are summed up, and rows are numbered
    within a block of turns of one thread.
    """
    rows = rows.withColumns(
        {"threads_": F.shiftright("thread", BLOCK), "turns_": F.shiftright("turn", BLOCK)}
    )
    counts = rows.groupBy("conv_id", "threads_", "thread", "turns_").agg(F.count("*").alias("n"))
    blocks = counts.groupBy("conv_id", "threads_").agg(F.sum("n").alias("n"))
    in_talk = Window.partitionBy("conv_id").orderBy("threads_")
    in_block = Window.partitionBy("conv_id", "threads_").orderBy("thread", "turns_")
    before = blocks.select(
        F.col("conv_id").alias("c"), F.col("threads_").alias("b"), (F.sum("n").over(in_talk) - F.col("n")).alias("base")
    )
    offsets = counts.withColumn("inner", F.sum("n").over(in_block) - F.col("n")).join(
        before, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("threads_").eqNullSafe(F.col("b"))
    )
    offsets = offsets.select(
        F.col("conv_id").alias("c"), F.col("thread").alias("t"), F.col("turns_").alias("u"),
        (F.col("base") + F.col("inner")).alias("offset"),
    )
    in_turns = Window.partitionBy("conv_id", "thread", "turns_").orderBy("turn", "role", "print")
    numbered = rows.withColumn("inner", F.row_number().over(in_turns) - 1)
    same = (
        F.col("conv_id").eqNullSafe(F.col("c"))
        & F.col("thread").eqNullSafe(F.col("t"))
        & F.col("turns_").eqNullSafe(F.col("u"))
    )
    return (
        numbered.join(offsets, same)
        .withColumn("position", (F.col("offset") + F.col("inner")).cast("long"))
        .drop("c", "t", "u", "offset", "inner", "threads_", "turns_")
    )


def link_quotations(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n_quotes, n_linked, reply_to, thread, position).

    One row for each of the input, ``text`` without quoted lines. ``n_quotes`` counts
    its quoted passages and ``n_linked`` those of which an earlier turn of the
    conversation holds the passage, or else one of its lines; of several turns the first
    one said it. ``reply_to`` is the turn behind the least deep passage that links, of
    several the latest, null if none does. ``thread`` is the turn at the end of the chain
    of replies and ``position`` the place in the conversation, by thread and then turn,
    so an answer never comes before what it answers.

    A null text is empty. Rows that share conversation and turn stay rows of their own;
    where they reply to different turns, the earliest is followed. Messages with a null
    conversation or turn link with nothing; they sort first. Other columns are not looked at.
    """
    messages = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    messages = messages.withColumns(
        {"print": F.sha2(F.col("text").cast("binary"), 256), "own": own_text(F.col("text"))}
    )
    found = stage(links(messages), "quote-links")
    begun = threads(found.where("reply_to is not null")).withColumnRenamed("thread", "root")
    found = found.withColumnsRenamed({name: f"{name}_" for name in KEY})
    same = [F.col(name).eqNullSafe(F.col(f"{name}_")) for name in KEY]
    rows = (
        messages.drop("text")
        .join(found, same[0] & same[1] & same[2], "left")
        .join(begun, ["conv_id", "turn"], "left")
        .select(
            "conv_id", "turn", "role", F.col("own").alias("text"), "print",
            F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
            F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
            "reply_to", F.coalesce("root", "turn").alias("thread"),
        )
    )
    return positions(rows).select(
        "conv_id", "turn", "role", "text", "n_quotes", "n_linked", "reply_to", "thread", "position"
    )
