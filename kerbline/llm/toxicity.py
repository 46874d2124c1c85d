"""Toxicity by a counterfactual-regularised linear classifier (operator 3).

Features are the distinct words of a text and the character n-grams of those words, each counted once per text; the
``FEATURES`` that tell the labels apart best are kept. The classifier is a logistic regression whose loss also
holds, for every training text that names a group of people, the squared change of its logit when the group's
name is swapped for another of the same kind, so that a neutral mention of a group does not move the score.

It is fitted on at most ``TRAIN_ROWS`` labelled rows (those with the smallest hash of their id), in shards of fixed
content: in each round every shard improves the shared weights on its own rows and the results are averaged.
Scoring covers all rows and whole texts, in place, without a shuffle. Null texts count as empty; an empty text
scores the intercept. Without labels of both kinds the score is the share of label 1 among the labels (0 if there
are none). Repeated labels of a document count as often as they occur.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.llm.common import fold, map_arrow, ship_package, stored

TRAIN_ROWS = 20_000
FEATURES = 8_192
#: A feature has to occur in so many training words' texts.
MIN_COUNT = 3
GRAM_SIZES = (4, 5)
SHARDS = 8
ROUNDS = 6
EPOCHS = 3
RATE = 0.3
RIDGE = 1e-4
#: Weight of the squared logit change under a swap of identity terms.
SWAP_PENALTY = 1.0
THRESHOLD = 0.5
HELD_OUT_FOLDS = 5
HELD_OUT_FOLD = 0
#: Tokens a task remembers; about 25 MB.
MEMO_ENTRIES = 100_000

#: Names of groups of people; those of one line replace one another in counterfactual texts.
IDENTITY_GROUPS = [
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("girl", "boy"),
    ("female", "male"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("transgender", "cisgender"),
    ("black", "white", "asian", "latino"),
    ("muslim", "christian", "jewish", "hindu", "buddhist"),
    ("muslims", "christians", "jews", "hindus", "buddhists"),
    ("immigrants", "natives", "refugees"),
    ("elderly", "young"),
    ("disabled", "abled"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
]

WORD = re.compile(r"[^\W_]+")


def swaps_of(groups: list[tuple[str, ...]]) -> dict[str, str]:
    """Each identity term and the next one of its group."""
    return {term: group[(i + 1) % len(group)] for group in groups for i, term in enumerate(group)}


def words_of(text: str | None) -> set[str]:
    return {word for token in set((text or "").lower().split()) for word in WORD.findall(token)}


def features_of(word: str) -> set[str]:
    marked = f"^{word}$"
    grams = {marked[i : i + n] for n in GRAM_SIZES for i in range(len(marked) - n + 1)}
    return grams | {f"={word}"}


@dataclass
class Model:
    """Weights by feature; at most ``FEATURES`` of them."""

    weights: dict[str, float]
    intercept: float

    def word_features(self, word: str) -> list[str]:
        """Those of ``features_of`` that have a weight; more than once where the word repeats them."""
        # The model's own strings, so that what remembers them holds no copies.
        named, marked = self.named.get, f"^{word}$"
        found = [named(f"={word}")]
        for size in GRAM_SIZES:
            found += [named(marked[i : i + size]) for i in range(len(marked) - size + 1)]
        return [name for name in found if name is not None]

    @cached_property
    def named(self) -> dict[str, str]:
        return {name: name for name in self.weights}

    @cached_property
    def scorer(self) -> Scorer:
        """Lasts as long as the model does in a worker, over all its tasks."""
        return Scorer(self)

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "intercept": self.intercept}


def sigmoid(z: float) -> float:
    if z >= 0:
        return 1 / (1 + math.exp(-z))
    return math.exp(z) / (1 + math.exp(z))


class Scorer:
    """Scores texts; remembers the features of tokens, up to a fixed count."""

    def __init__(self, model: Model) -> None:
        self.model, self.memo = model, _Memo(model)

    def score(self, text: str | None) -> float:
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        tokens = set((text or "").lower().split())
        present = {f for found in map(self.memo.__getitem__, tokens) if found for f in found}
        return sigmoid(self.model.intercept + math.fsum(map(self.model.weights.__getitem__, present)))


class _Memo(dict):
    """Token to the weighted features of its words, filled on demand."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> tuple[str, ...]:
        found = self[token] = tuple({f for word in WORD.findall(token) for f in self.model.word_features(word)})
        return found


# ---- fitting ------------------------------------------------------------------------------------


def training_rows(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int
) -> DataFrame:
    """``id, text, label`` of at most ``rows`` labelled documents outside the held-out fold."""
    usable = labels.where(F.col(label_col).isin(0, 1) & (fold(F.col(id_col), HELD_OUT_FOLDS) != HELD_OUT_FOLD))
    chosen = usable.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "label").limit(rows)
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), F.col("doc") == F.col("id")).select("id", "text", "label")


def words_per_row(rows: DataFrame) -> DataFrame:
    def work():
        def compute(texts: pa.Array) -> list[pa.Array]:
            return [pa.array([sorted(words_of(text)) for text in texts.to_pylist()], pa.list_(pa.string()))]

        return compute

    return map_arrow(rows, ["text"], ["id", "label"], [T.StructField("words", T.ArrayType(T.StringType()))], work)


def telling_features(rows: DataFrame, positives: int, total: int, features: int) -> list[str]:
    """The features whose share of label 1 is furthest from the average, by chi-squared."""
    words = rows.select("label", F.explode("words").alias("word"))
    counts = words.groupBy("word").agg(F.sum("label").alias("ones"), F.count("*").alias("all"))

    def work():
        def compute(column: pa.Array) -> list[pa.Array]:
            return [pa.array([sorted(features_of(word)) for word in column.to_pylist()], pa.list_(pa.string()))]

        return compute

    added = [T.StructField("features", T.ArrayType(T.StringType()))]
    by_word = map_arrow(counts, ["word"], ["ones", "all"], added, work)
    by_feature = by_word.select(F.explode("features").alias("feature"), "ones", "all").groupBy("feature")
    rate = positives / total
    summed = by_feature.agg(F.sum("ones").alias("ones"), F.sum("all").alias("all")).where(F.col("all") >= MIN_COUNT)
    distance = F.pow(F.col("ones") - F.col("all") * rate, 2) / (F.col("all") * rate * (1 - rate))
    best = summed.orderBy(distance.desc(), "feature").limit(features)
    return sorted(row.feature for row in best.select("feature").collect())


def indexed(rows: DataFrame, names: list[str], groups: list[tuple[str, ...]]) -> DataFrame:
    """``shard, id, label, own, swapped``: feature numbers of the text and of its counterfactual (null if it has none)."""
    shared = rows.sparkSession.sparkContext.broadcast({name: i for i, name in enumerate(names)})
    swaps = swaps_of(groups)
    numbers = T.ArrayType(T.IntegerType())

    def work():
        index = shared.value

        def numbers_of(words: set[str]) -> list[int]:
            return sorted({index[f] for word in words for f in features_of(word) if f in index})

        def compute(column: pa.Array) -> list[pa.Array]:
            own, swapped = [], []
            for words in column.to_pylist():
                own.append(numbers_of(set(words)))
                named = any(word in swaps for word in words)
                swapped.append(numbers_of({swaps.get(word, word) for word in words}) if named else None)
            return [pa.array(own, pa.list_(pa.int32())), pa.array(swapped, pa.list_(pa.int32()))]

        return compute

    added = [T.StructField("own", numbers), T.StructField("swapped", numbers)]
    made = map_arrow(rows, ["words"], ["id", "label"], added, work)
    return made.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(SHARDS)))


def improve(rows: pd.DataFrame, start: np.ndarray, penalty: float) -> np.ndarray:
    """Adaptive gradient steps over a shard's rows; the intercept is the last weight."""
    weights, squares = start.copy(), np.full(len(start), 1e-2)
    rows = rows.sort_values(["id", "label"], kind="stable")
    bias = len(start) - 1
    examples = [
        (np.append(own, bias).astype(np.int64), label, None if swapped is None else np.append(swapped, bias).astype(np.int64))
        for own, label, swapped in zip(rows["own"], rows["label"], rows["swapped"], strict=True)
    ]

    def step(places: np.ndarray, gradient: np.ndarray | float) -> None:
        slope = gradient + RIDGE * weights[places]
        squares[places] += slope**2
        weights[places] -= RATE * slope / np.sqrt(squares[places])

    for _ in range(EPOCHS):
        for own, label, swapped in examples:
            step(own, sigmoid(float(weights[own].sum())) - label)
            if swapped is not None:
                gone, come = np.setdiff1d(own, swapped), np.setdiff1d(swapped, own)
                change = float(weights[own].sum() - weights[swapped].sum())
                # The step is bounded so that the penalty cannot overshoot at any weight.
                factor = min(2 * penalty, 1 / max(1, len(gone) + len(come))) * change
                weights[gone] -= factor
                weights[come] += factor
    return weights


def round_of(shared: Broadcast, penalty: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def work(shard: pd.DataFrame) -> pd.DataFrame:
        better = improve(shard, shared.value, penalty)
        return pd.DataFrame({"rows": [len(shard)], "weights": [better.tolist()]})

    return work


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    rows: int = TRAIN_ROWS,
    features: int = FEATURES,
    penalty: float = SWAP_PENALTY,
    groups: list[tuple[str, ...]] = IDENTITY_GROUPS,
) -> Model:
    chosen = stored(words_per_row(training_rows(docs, labels, id_col, text_col, label_col, rows)), "toxicity-words")
    total, positives = chosen.agg(F.count("*"), F.sum("label")).first()
    if not total or positives in (0, total):
        return Model({}, 20.0 if total and positives else -math.inf)
    names = telling_features(chosen, positives, total, features)
    examples = stored(indexed(chosen, names, groups), "toxicity-rows")
    ship_package(docs.sparkSession)
    weights = np.zeros(len(names) + 1)
    weights[-1] = math.log(positives / (total - positives))
    for _ in range(ROUNDS):
        shared = docs.sparkSession.sparkContext.broadcast(weights)
        improved = examples.groupBy("shard").applyInPandas(round_of(shared, penalty), "rows long, weights array<double>")
        # At most SHARDS rows of FEATURES numbers come back.
        parts = improved.collect()
        parts = sorted(parts, key=lambda part: (part.rows, part.weights))
        weights = np.average([part.weights for part in parts], axis=0, weights=[part.rows for part in parts])
        shared.unpersist()
    return Model(dict(zip(names, weights[:-1].tolist(), strict=True)), float(weights[-1]))


# ---- scoring ------------------------------------------------------------------------------------


def add_score(
    docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", keep: list[str] | None = None
) -> DataFrame:
    """``keep`` (all columns by default, but one named ``score_col``) and the score of each whole text, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        scorer = shared.value.scorer

        def compute(texts: pa.Array) -> list[pa.Array]:
            return [pa.array([scorer.score(text) for text in texts.to_pylist()], pa.float64())]

        return compute

    keep = [name for name in (docs.columns if keep is None else keep) if name != score_col]
    return map_arrow(docs, [text_col], keep, [T.StructField(score_col, T.DoubleType())], work)


def is_toxic(score: Column, threshold: float = THRESHOLD) -> Column:
    return score >= threshold


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns."""
    model = fit(docs, labels, id_col, text_col)
    return add_score(docs, model, text_col, "__toxicity").where(~is_toxic(F.col("__toxicity"))).drop("__toxicity")

