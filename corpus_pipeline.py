"""Documents to packed sequences: no toxic ones, no repeated lines, no near copies.

Each stage works on all that the one before kept; its result is written as Parquet and
read again, so a lost executor costs tasks of one stage. All stages but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.llm.line_dedup import drop_repeated_lines
from coterie.llm.ngram_join import link_rows
from coterie.llm.packing import pack_pieces, token_pieces
from coterie.llm.tables import free_name, ship, stage
from coterie.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.7, by the labels that are not held out."""
    ship(spark)
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that five or more of them hold, but for one holder.

    ``n_chars`` follows the text where lines went.
    """
    ship(spark)
    kept = drop_repeated_lines(docs)
    if "n_chars" in docs.columns:
        shorter = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
        kept = kept.withColumn("n_chars", shorter.cast(docs.schema["n_chars"].dataType))
    return kept.select(docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies.

    Near copies share 0.8 or more of their five-word shingles. Documents without words
    are no copies of each other. Rows are kept or dropped one by one: a document is a
    doc_id with its text, so rows that share an id may stay or go, and of near copies under
    one id a single one stays. Rows without a doc_id stay, but for exact repeats.
    """
    ship(spark)
    linked = link_rows(docs, size=5, percent=80)
    names = [free_name(docs, base) for base in ("other_id", "other_md5")]
    copies = linked.where("doc_id <> component_id or text_md5 <> first_md5").select(
        F.col("doc_id").alias(names[0]), F.lower(F.hex("text_md5")).alias(names[1])
    )
    same = (docs["doc_id"] == copies[names[0]]) & (F.md5(docs["text"].cast("binary")) == copies[names[1]])
    kept = docs.join(copies, same, "left_anti")
    return kept.dropDuplicates(["doc_id", "text"])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces of at most 4096 tokens, and their place in a sequence."""
    ship(spark)
    pieces = token_pieces(docs).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "deal"
    )
    return pack_pieces(stage(pieces, "pieces")).drop("deal")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("packing", packing),
]

#: A learned score and a packing are not SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
