"""Connected components of links between long ids, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.llm.tables import stage

SALTS = 8  # a node with very many links is joined in so many parts


def least_of(links: DataFrame) -> DataFrame:
    """(a, b, m) with m the smallest id among a and all its b; a's parts are salted."""
    least = links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    parts = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = links.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    return salted.join(parts, ["a", "salt"]).drop("salt")


def both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def large_star(links: DataFrame) -> DataFrame:
    found = least_of(both_ways(links)).where("b > a")
    return found.select(F.col("b").alias("a"), F.col("m").alias("b"))


def small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    found = least_of(down)
    own = found.select("a", F.col("m").alias("b"))
    rest = found.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return own.unionByName(rest)


def mark(links: DataFrame) -> tuple:
    """A few numbers that change whenever the links do."""
    pair = F.xxhash64("a", "b")
    row = links.agg(
        F.count("*"), F.bit_xor(pair), F.sum(F.pmod(pair, F.lit(1 << 30)))
    ).first()
    return tuple(row)


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every id in ``links`` (a, b); root is the smallest reachable.

    Each round is written to the shared folder. Links to oneself and nulls have no
    effect; repeated links neither. No links, no rows.
    """
    links = stage(links.select("a", "b").where("a <> b").distinct(), name)
    before = mark(links)
    while before[0]:
        links = stage(
            small_star(large_star(links).where("a <> b").distinct()).where("a <> b").distinct(), name
        )
        after = mark(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
