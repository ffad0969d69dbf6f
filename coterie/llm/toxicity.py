"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words and the beginnings of its words, hashed into
buckets. Buckets that are distributed differently over the two labels become inputs, and
so do pairs of frequent buckets that say more together than alone. The machine learns a
weight for each and a short vector, whose inner products weigh pairs: an insult beside the
mention of a group may count for more than both alone, and two words for something though
neither does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.llm.tables import make_room, utf8

BUCKETS = 1 << 20
STEM = 4  # letters of a word's beginning
TRAIN_ROWS = 24_000  # labelled rows the fit takes at most
INPUTS = 2048  # buckets that become inputs at most
# z score of a bucket's difference, and of a pair's interaction; 5 rather than 3 to 6 for the best
# log loss in three folds of the rows that are not held out, where 6 to 10 for pairs is the same
LEAST_Z, PAIR_Z = 5.0, 8.0
PAIR_SHARE = 0.01  # share of the rows that a bucket of a tested pair is in, and is not in
PAIR_TERMS = 8192  # buckets whose pairs are tested at most, the most frequent
PAIR_BLOCK, ROW_BLOCK = 512, 512  # of them, and of rows, at once
FACTORS = 4
EPOCHS, BATCH, RATE = 16, 256, 0.05
DECAY = (0.0, 0.01, 0.5)  # of the bias, the weights and the factors, for each unit of RATE
SEED = 3
MEMO = 1 << 18
LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def words(text: bytes) -> set[bytes]:
    """Distinct lower-case words: runs of ASCII letters and of other characters."""
    return set(text.decode().lower().encode().translate(LETTERS).split())


def term_buckets(word: bytes) -> tuple[int, ...]:
    """The buckets of a word and of its beginning."""
    whole = xxhash.xxh3_64_intdigest(word, seed=1) % BUCKETS
    stem = word.decode(errors="ignore")[:STEM].encode()
    return (whole, xxhash.xxh3_64_intdigest(stem, seed=2) % BUCKETS) if len(stem) >= STEM else (whole,)


def buckets(text: bytes) -> np.ndarray:
    return np.unique(np.array([b for word in words(text) for b in term_buckets(word)], np.int32))


@dataclass
class Machine:
    """bias + sum of weights + sum of pairs' inner products; inputs are 0 or 1."""

    bias: float
    inputs: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    factors: np.ndarray = field(default_factory=lambda: np.empty((0, FACTORS)))

    def score(self, present: np.ndarray) -> float:
        """0 to 1 from the places of the inputs that a text has."""
        vectors = self.factors[present]
        pairs = 0.5 * float((vectors.sum(axis=0) ** 2 - (vectors**2).sum(axis=0)).sum())
        return float(sigmoid(self.bias + self.weights[present].sum() + pairs))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def count(rows: list[np.ndarray]) -> np.ndarray:
    """In how many rows each bucket is."""
    total = np.zeros(BUCKETS, np.int64)
    for k in range(0, len(rows), ROW_BLOCK):
        total += np.bincount(np.concatenate(rows[k : k + ROW_BLOCK]), minlength=BUCKETS)
    return total


def choose_inputs(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Buckets whose share of the rows differs between the labels, or that interact."""
    one = [row for row, label in zip(rows, labels) if label]
    zero = [row for row, label in zip(rows, labels) if not label]
    counts = [count(part) for part in (one, zero)]
    share = [(c + 0.5) / (len(part) + 1) for c, part in zip(counts, (one, zero))]
    pooled = (counts[0] + counts[1] + 0.5) / (len(rows) + 1)
    spread = np.sqrt(pooled * (1 - pooled) * (1 / len(one) + 1 / len(zero)))
    z = np.abs(share[0] - share[1]) / spread
    z[counts[0] + counts[1] == 0] = 0
    terms = frequent(counts[0] + counts[1], len(rows))
    together = np.zeros(BUCKETS)
    together[terms] = interactions(one, zero, terms)
    found = np.flatnonzero((z >= LEAST_Z) | (together >= PAIR_Z))
    z = np.maximum(z, together)
    return np.sort(found[np.argsort(-z[found], kind="stable")[:INPUTS]])


def frequent(counts: np.ndarray, rows: int) -> np.ndarray:
    """Buckets that enough rows have, and have not, for their pairs to be tested."""
    least = max(1, PAIR_SHARE * rows)
    found = np.flatnonzero((counts >= least) & (counts <= rows - least))
    return np.sort(found[np.argsort(-counts[found], kind="stable")[:PAIR_TERMS]])


def interactions(one: list[np.ndarray], zero: list[np.ndarray], terms: np.ndarray) -> np.ndarray:
    """Each term's largest z score of an interaction with another one.

    That is the difference between the labels of the log odds ratio of the two terms: what
    the pair adds in a logistic model, whatever the two say alone.
    """
    parts = [(places(one, terms), 1), (places(zero, terms), -1)]
    best = np.zeros(len(terms))
    for begin in range(0, len(terms), PAIR_BLOCK):
        end = min(begin + PAIR_BLOCK, len(terms))
        shape = (end - begin, len(terms) - begin)
        ratio, spread = np.zeros(shape, np.float32), np.zeros(shape, np.float32)
        for present, sign in parts:
            both, count = np.zeros(shape, np.float32), np.zeros(shape[1], np.float32)
            for k in range(0, len(present), ROW_BLOCK):
                x = dense(present[k : k + ROW_BLOCK], begin, len(terms))
                both += x[:, : end - begin].T @ x
                count += x.sum(axis=0)
            first, second = count[: end - begin, None] - both, count[None, :] - both
            neither = len(present) - both
            neither -= first
            neither -= second
            for cell, turn in ((both, sign), (neither, sign), (first, -sign), (second, -sign)):
                cell += 0.5
                ratio += turn * np.log(cell)
                np.reciprocal(cell, out=cell)
                spread += cell
        z = np.abs(ratio, out=ratio)
        z /= np.sqrt(spread, out=spread)
        np.fill_diagonal(z, 0)
        best[begin:end] = np.maximum(best[begin:end], z.max(axis=1))
        best[begin:] = np.maximum(best[begin:], z.max(axis=0))
    return best


def places(rows: list[np.ndarray], terms: np.ndarray) -> list[np.ndarray]:
    """Where each row's terms stand in ``terms``, in order."""
    place = np.full(BUCKETS, -1, np.int16)
    place[terms] = np.arange(len(terms))
    found = (place[row] for row in rows)
    return [row[row >= 0] for row in found]


def dense(rows: list[np.ndarray], begin: int, end: int) -> np.ndarray:
    """1 where a row has a term, for some rows and the terms of a range."""
    out = np.zeros((len(rows), end - begin), np.float32)
    for k, row in enumerate(rows):
        out[k, row[np.searchsorted(row, begin) :] - begin] = 1
    return out


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Machine:
    """Logistic loss by Adam over shuffled batches, the same for the same rows.

    With one label only, or no input that differs, the score is the share of label 1,
    drawn a little towards one half.
    """
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    machine = Machine(float(np.log(share / (1 - share))))
    if not len(labels) or labels.min() == labels.max():
        return machine
    inputs = choose_inputs(rows, labels)
    if not len(inputs):
        return machine
    present = [np.searchsorted(inputs, row[np.isin(row, inputs, assume_unique=True)]) for row in rows]
    rng = np.random.default_rng(SEED)
    bias = np.array([machine.bias])
    # the rarer label counts for more, by the root of how much rarer it is
    cost = np.where(labels == 1, np.sqrt((1 - share) / share), 1.0)
    weights = np.zeros(len(inputs))
    factors = rng.normal(0, 0.01, (len(inputs), FACTORS))
    params = [bias, weights, factors]
    first, second = ([np.zeros_like(p) for p in params] for _ in range(2))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(present))
        for begin in range(0, len(order), BATCH):
            some = order[begin : begin + BATCH]
            x = np.zeros((len(some), len(inputs)))
            for k, row in enumerate(some):
                x[k, present[row]] = 1
            sums = x @ factors
            pairs = 0.5 * (sums**2 - x @ factors**2).sum(axis=1)
            error = (sigmoid(bias[0] + x @ weights + pairs) - labels[some]) * cost[some] / len(some)
            grads = [
                np.array([error.sum()]),
                x.T @ error,
                x.T @ (error[:, None] * sums) - factors * (x.T @ error)[:, None],
            ]
            step += 1
            for p, g, m, v, decay in zip(params, grads, first, second, DECAY):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * decay * p
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Machine(float(bias[0]), inputs, weights, factors)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """Fits on at most ``rows`` labelled documents, chosen by a hash of their id.

    ``labels`` has doc_id and label (0 or 1; other rows do not count). Texts are read and
    hashed by all tasks of the scan; only the chosen ones' distinct buckets go to the one
    task that fits. Where rows share a doc_id and that makes more than ``rows``, they
    are chosen by a hash of their buckets. The model comes back.
    """
    chosen = (
        labels.where("label in (0, 1) and doc_id is not null")
        .select("doc_id", F.col("label").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(rows)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # ``rows`` small rows

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for batch in batches:
            found = [buckets(text).astype("<i4", copy=False).tobytes() for text in utf8(batch.column(0))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(found, pa.binary())], names=["label", "buckets"]
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(row["buckets"], row["label"]) for b in batches for row in b.to_pylist()]
        rows.sort(key=lambda row: (xxhash.xxh3_64_intdigest(row[0]), row[1]))
        model = fit([np.frombuffer(row[0], "<i4") for row in rows], np.array([row[1] for row in rows], np.float64))
        rows.clear()
        make_room()
        yield pa.RecordBatch.from_pydict(
            {
                "bias": [model.bias],
                "inputs": [model.inputs.tobytes()],
                "weights": [model.weights.tobytes()],
                "factors": [model.factors.tobytes()],
            }
        )

    row = (
        texts.select("text", "label")
        .mapInArrow(extract, "label int, buckets binary")
        # copies of a text count once, or what they hold by chance becomes evidence
        .distinct()
        .orderBy(F.xxhash64("buckets"), "buckets", "label")
        .limit(rows)
        .repartition(1)
        .mapInArrow(learn, "bias double, inputs binary, weights binary, factors binary")
        .first()
    )
    if row is None:  # no labelled rows, no task
        return fit([], np.empty(0))
    return Machine(
        row.bias,
        np.frombuffer(row.inputs, np.int64),
        np.frombuffer(row.weights),
        np.frombuffer(row.factors).reshape(-1, FACTORS),
    )


def scoring(model) -> Callable:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.value
        place = {bucket: k for k, bucket in enumerate(machine.inputs.tolist())}
        memo: dict[bytes, tuple[int, ...]] = {}
        for batch in batches:
            scores = []
            for text in utf8(batch.column(1)):
                present = set()
                for word in words(text):
                    found = memo.get(word)
                    if found is None:
                        found = tuple(place[b] for b in term_buckets(word) if b in place)
                        if len(memo) < MEMO:
                            memo[word] = found
                    present.update(found)
                scores.append(machine.score(np.array(sorted(present), np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"]
            )
        memo.clear()
        make_room()

    return apply


def score_texts(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) of every row's whole text; null texts score as empty ones.

    Rows come out one for one, repeated ones and those without a doc_id too. Only the
    text decides. Other columns are not looked at.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    model = docs.sparkSession.sparkContext.broadcast(machine)  # INPUTS rows at most
    return docs.select("doc_id", "text").mapInArrow(scoring(model), f"doc_id {id_type}, score double")


def held_out(doc_id: str = "doc_id"):
    """Whether a row's label is kept from training: crc32 of the id as text, by thirds."""
    fold = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3
    return F.coalesce(fold == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Learns from the rows of ``labels`` (doc_id, toxic) that are not held out. Without
    any, every score is one half. A null doc_id is not held out and has no label.
    """
    known = labels.where(~held_out()).select("doc_id", F.col("toxic").alias("label"))
    scored = score_texts(docs, train(docs, known))
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that ``classify`` would not predict as toxic, all columns kept.

    One pass over the rows, without a shuffle of them.
    """
    known = labels.where(~held_out()).select("doc_id", F.col("toxic").alias("label"))
    model = docs.sparkSession.sparkContext.broadcast(train(docs, known))
    place = docs.columns.index("text")
    score = scoring(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pairs() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held.append(batch)
                texts = batch.column(place)
                yield pa.RecordBatch.from_arrays([texts, texts], names=["doc_id", "text"])

        for scored in score(pairs()):
            below = pc.less(scored.column(1), threshold)
            yield held.pop().filter(below)

    return docs.mapInArrow(keep, docs.schema)
