"""Training the recommender from ledgers, and keeping the two models."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from coterie.operators import recommend
from coterie.session import scratch_path
from coterie.sources.ledgers import load_model, save_model


@dataclass(frozen=True)
class Recommender:
    speed: PipelineModel
    accuracy: PipelineModel

    def recommend(self, jobs: DataFrame) -> DataFrame:
        return recommend.recommend(jobs, self.speed, self.accuracy)

    def evaluate(self, test: DataFrame) -> DataFrame:
        return recommend.evaluate(test, self.speed, self.accuracy)

    def save(self, path: str) -> None:
        save_model(self.speed, f"{path}/speed")
        save_model(self.accuracy, f"{path}/accuracy")

    @classmethod
    def load(cls, path: str) -> Recommender:
        return cls(load_model(f"{path}/speed"), load_model(f"{path}/accuracy"))


def train_recommender(
    ledger: DataFrame,
    extra_keys: Sequence[str] = (),
    larger_wins: Sequence[str] = (),
    test_share: float = 0.2,
    seed: int = 42,
    exact: bool = False,
    **forest,
) -> tuple[Recommender, DataFrame]:
    """Both forests, trained on the same 80 percent, and the held-out rows. ``exact`` holds
    out exactly that share, see ``recommend.split_exact``.

    The configurations are written once and read by both fits and the test.
    """
    spark = ledger.sparkSession
    path = scratch_path(spark, "training-set")
    recommend.training_set(ledger, extra_keys, larger_wins).write.parquet(path)
    split = recommend.split_exact if exact else recommend.split
    training, test = split(spark.read.parquet(path), test_share, seed)
    if training.isEmpty():
        raise ValueError("no point of the ledger has exactly one row of each algorithm")
    models = Recommender(
        recommend.train(training, "BestBySpeed", seed=seed, **forest),
        recommend.train(training, "BestByAccuracy", seed=seed, **forest),
    )
    return models, test
