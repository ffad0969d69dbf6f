"""From sweep ledgers to a recommended algorithm."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from coterie.functions.fixed import JOB_SCHEMA, LEDGER_KEYS
from coterie.operators.clustering import ALGORITHMS
from coterie.operators.columns import quoted
from coterie.operators.metrics import class_accuracy
from coterie.operators.numbering import with_row_index

NAMES = [entry.name for entry in ALGORITHMS]
HASH, HASH_BITS, STEP_BITS = "split_hash", 60, 15
TARGETS = {"BestBySpeed": "speed", "BestByAccuracy": "accuracy"}


def best_of_three(
    values: Sequence[Column], names: Sequence[Column], larger_wins: bool = False
) -> Column:
    """The first value strictly better than both others, else the second, else the
    third: a tie for the best place, or a NaN, goes to the third."""

    def better(a: Column, b: Column) -> Column:
        comparable = ~F.isnan(a) & ~F.isnan(b)
        return comparable & ((a > b) if larger_wins else (a < b))

    first, second, third = values
    return (
        F.when(better(first, second) & better(first, third), names[0])
        .when(better(second, first) & better(second, third), names[1])
        .otherwise(names[2])
    )


def tell_apart(df: DataFrame, keys: Sequence[str], kind: str, kinds: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per key: ``value_i`` for each value and kind, and ``complete``, whether
    each kind has exactly one row and no other kind has any."""
    rows = [F.count_if(F.col(kind) == name) for name in kinds]
    complete = F.count(F.lit(1)) == len(kinds)
    for one in rows:
        complete = complete & (one == 1)
    return df.groupBy(*keys).agg(
        complete.alias("complete"),
        *[
            F.max(F.when(F.col(kind) == name, F.col(value))).alias(f"{value}_{i}")
            for value in values
            for i, name in enumerate(kinds)
        ],
    )


def best_by(
    df: DataFrame,
    keys: Sequence[str],
    kind: str,
    kinds: Sequence[str],
    targets: dict[str, str],
    larger_wins: Sequence[str] = (),
) -> DataFrame:
    """One row per key with the best of three kinds for each target column.

    ``targets`` maps a result column to the value column it compares. Only keys with
    exactly one row of each kind are compared; ``incomplete`` has the others. The row
    order of the input plays no part, and one shuffle serves all targets.
    """
    values = list(dict.fromkeys(targets.values()))
    picked = tell_apart(df, keys, kind, kinds, values).filter("complete")
    labels = [F.lit(name) for name in kinds]
    return picked.select(
        *keys,
        *[
            best_of_three(
                [F.col(f"{value}_{i}") for i in range(3)], labels, target in larger_wins
            ).alias(target)
            for target, value in targets.items()
        ],
    )


def ledger_keys(ledger: DataFrame, extra_keys: Sequence[str] = ()) -> list[str]:
    """The columns that name one point of one run."""
    run = ["run_id"] if "run_id" in ledger.columns else []
    return list(dict.fromkeys([*LEDGER_KEYS, *run, *extra_keys]))


def training_set(
    ledger: DataFrame, extra_keys: Sequence[str] = (), larger_wins: Sequence[str] = ()
) -> DataFrame:
    """One row per point and run with ``BestBySpeed`` and ``BestByAccuracy``.

    The smaller accuracy wins unless ``BestByAccuracy`` is in ``larger_wins``
    (for ledgers that hold silhouettes). ``run_id`` is a key where the ledger has it.
    Points without exactly one row of each algorithm get no label, as the missing or
    doubled one might be the best; ``incomplete`` tells how many there are.
    """
    return best_by(
        ledger,
        ledger_keys(ledger, extra_keys),
        "Algorithm",
        NAMES,
        {"BestBySpeed": "ExecutionSpeed", "BestByAccuracy": "Accuracy"},
        larger_wins,
    )


def incomplete(ledger: DataFrame, extra_keys: Sequence[str] = ()) -> DataFrame:
    """The points of each run that ``training_set`` leaves out."""
    keys = ledger_keys(ledger, extra_keys)
    return tell_apart(ledger, keys, "Algorithm", NAMES, []).filter("not complete").select(*keys)


def split_share(keys: Sequence[str], seed: int = 42) -> Column:
    """A number in 0..1 that depends on the row's keys and the seed alone."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(key).cast("string") for key in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(16.0**8)


def split(
    df: DataFrame, test_share: float = 0.2, seed: int = 42, keys: Sequence[str] = tuple(LEDGER_KEYS)
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows. A row falls on the same side for every target, and
    also when it is computed again or the input is partitioned differently."""
    marked = df.withColumn("share", split_share(keys, seed))
    return (
        marked.filter(F.col("share") >= test_share).drop("share"),
        marked.filter(F.col("share") < test_share).drop("share"),
    )


def split_exact(
    df: DataFrame, test_share: float = 0.2, seed: int = 42, keys: Sequence[str] = tuple(LEDGER_KEYS)
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows with exactly ``ceil(n * test_share)`` rows to test.

    The rows with the smallest hashes of their keys are held out. Where the cut falls is
    found by counting rows by the first bits of the hash, then by the next bits among those
    that share them, so nothing is sorted as a whole. Of the rows that share the hash at
    the cut, the first by their keys and other columns are held out. The same rows give
    the same sides, however they are divided into partitions. ``df`` is read a few times.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(key).cast("string") for key in keys])
    marked = df.withColumn(HASH, F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint"))
    wanted = math.ceil(df.count() * test_share)
    if wanted == 0:
        return df, df.limit(0)
    begin, left = 0, wanted  # hashes below ``begin`` are held out, ``left`` rows still to find
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        within = (F.col(HASH) >= begin) & (F.col(HASH) <= begin + (1 << (shift + STEP_BITS)) - 1)
        counts = marked.filter(within).groupBy(F.shiftright(HASH, shift).alias("first")).count()
        for first, count in counts.orderBy("first").collect():  # 2 ** STEP_BITS at most
            begin = first << shift
            if count >= left:
                break
            left -= count
    marked = marked.withColumn(HASH, F.col(HASH) - begin)
    same = marked.filter(F.col(HASH) == 0).drop(HASH)
    order = [*keys, *(name for name in df.columns if name not in keys)]
    ranked = same.repartitionByRange(*map(quoted, order)).sortWithinPartitions(*map(quoted, order))
    ranked = with_row_index(ranked, HASH)
    return (
        marked.filter(F.col(HASH) > 0).drop(HASH).unionByName(ranked.filter(F.col(HASH) >= left).drop(HASH)),
        marked.filter(F.col(HASH) < 0).drop(HASH).unionByName(ranked.filter(F.col(HASH) < left).drop(HASH)),
    )


def train(
    training: DataFrame,
    target: str,
    trees: int = 100,
    max_depth: int = 30,
    max_bins: int = 128,
    seed: int = 42,
) -> PipelineModel:
    """A forest that adds ``<target>_predicted``, an algorithm name.

    The classes are the three algorithms in their fixed order, so no pass over
    the data is spent on finding them and a class may be absent from the ledger.
    """
    index = F.array_position(F.array(*[F.lit(name) for name in NAMES]), F.col(target)) - 1
    nominal = {"ml_attr": {"type": "nominal", "name": "label", "vals": NAMES}}
    labelled = training.select(
        *LEDGER_KEYS, index.cast("double").alias("label", metadata=nominal)
    )
    vector, position = f"{target}_features", f"{target}_index"
    stages = [
        VectorAssembler(inputCols=LEDGER_KEYS, outputCol=vector),
        RandomForestClassifier(
            featuresCol=vector,
            labelCol="label",
            predictionCol=position,
            probabilityCol=f"{target}_probability",
            rawPredictionCol=f"{target}_votes",
            numTrees=trees,
            maxDepth=max_depth,
            maxBins=max_bins,
            featureSubsetStrategy="sqrt",
            seed=seed,
        ),
        IndexToString(inputCol=position, outputCol=f"{target}_predicted", labels=NAMES),
    ]
    return Pipeline(stages=stages).fit(labelled)


def predict(model: PipelineModel, jobs: DataFrame, target: str) -> DataFrame:
    """``jobs`` with ``<target>_predicted``."""
    return model.transform(jobs).drop(
        f"{target}_features", f"{target}_index", f"{target}_probability", f"{target}_votes"
    )


def jobs_frame(spark: SparkSession, jobs: Sequence[dict]) -> DataFrame:
    """Jobs given in the program, one mapping with the six ledger keys each."""
    rows = [[job[key] for key in LEDGER_KEYS] for job in jobs]
    return spark.createDataFrame(rows, JOB_SCHEMA)


def display_name(name: Column) -> Column:
    """Ledger name to title; null for anything else."""
    titles = F.when(name == ALGORITHMS[0].name, ALGORITHMS[0].title)
    for entry in ALGORITHMS[1:]:
        titles = titles.when(name == entry.name, entry.title)
    return titles


def recommend(jobs: DataFrame, speed: PipelineModel, accuracy: PipelineModel) -> DataFrame:
    """``jobs`` (the six ledger keys, anything else kept) with the titles
    ``recommended_speed`` and ``recommended_accuracy``."""
    scored = predict(accuracy, predict(speed, jobs, "BestBySpeed"), "BestByAccuracy")
    return scored.withColumns(
        {
            "recommended_speed": display_name(F.col("BestBySpeed_predicted")),
            "recommended_accuracy": display_name(F.col("BestByAccuracy_predicted")),
        }
    ).drop("BestBySpeed_predicted", "BestByAccuracy_predicted")


def choices(recommended: DataFrame, chosen: str = "algorithm") -> DataFrame:
    """The three options offered for a request, in order, as ``choices``."""
    return recommended.withColumn(
        "choices", F.array("recommended_speed", "recommended_accuracy", chosen)
    )


def evaluate(
    test: DataFrame, speed: PipelineModel, accuracy: PipelineModel
) -> DataFrame:
    """Held-out accuracy of both models: one row, ``speed`` and ``accuracy``."""
    scored = predict(accuracy, predict(speed, test, "BestBySpeed"), "BestByAccuracy")
    return class_accuracy(
        scored, {short: (name, f"{name}_predicted") for name, short in TARGETS.items()}
    )
