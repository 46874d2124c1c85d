"""Quality classifier by co-training of two views (operator 9).

The text view describes the content of a document (shares of kinds of characters, word and line statistics); the
metadata view describes where it comes from (source, language, stated length, host of the page that shows it). Each
view has its own logistic regression. In every round each classifier labels the pool of unlabelled documents, and
those it is confident of (``CONFIDENT``) join the training rows of the other view with a reduced weight. Then each
view is calibrated on labelled rows that it did not train on, and the views are combined as independent evidence: the
sum of their calibrated log-odds less the log-odds of the prior.

Fitting uses at most ``TRAIN_ROWS`` labelled documents (those with the smallest hash of their id); the pool is all
unlabelled documents, so that what the views teach each other grows with the corpus. Rows of fold ``HELD_OUT_FOLD`` are never learned from, those of ``CALIBRATION_FOLD`` only calibrate. All
documents are scored by whole texts, in place. Null texts count as empty, missing metadata as a value of its
own. Without training rows of both labels the score is the share of label 1 among them (0 if there are none).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import FeatureHasher, StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.llm.common import fold, map_arrow, stored

TRAIN_ROWS = 20_000
ROUNDS = 3
#: A view passes on a label when its score is at least this far to one side.
CONFIDENT = 0.95
PSEUDO_WEIGHT = 0.5
FOLDS, HELD_OUT_FOLD, CALIBRATION_FOLD = 5, 0, 1
#: Slots of the metadata view, most of which hosts take.
HASHED = 1 << 16
#: Every iteration of a fit is a job over its rows; few tasks keep a small fit from being all scheduling.
FIT_TASKS, FIT_ROWS = 6, 50_000
RIDGE = 1e-3
THRESHOLD = 0.5

TEXT_FEATURES = [
    "log_bytes", "word_bytes", "upper", "lower", "digit", "space", "symbol", "mark", "other",
    "distinct_words", "words_per_line", "repeated_lines", "long_words",
]
META_FEATURES = ["source", "lang", "length", "host"]

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGIT = bytes(range(48, 58))
SPACE = b"\t\n\x0b\x0c\r "
MARK = b".,;:!?'\"()-"
SYMBOL = bytes(set(range(33, 127)) - set(UPPER + LOWER + DIGIT + MARK))
LONG_WORD = re.compile(rb"[^\s]{20,}")


def text_features(text: str | None) -> list[float]:
    """Numbers that describe a whole text, in the order of ``TEXT_FEATURES``; all zero for an empty one."""
    data = (text or "").encode()
    size = len(data)
    if not size:
        return [0.0] * len(TEXT_FEATURES)
    kinds = [size - len(data.translate(None, kind)) for kind in (UPPER, LOWER, DIGIT, SPACE, SYMBOL, MARK)]
    words, lines = data.split(), data.split(b"\n")
    n_words = max(1, len(words))
    return [
        float(size.bit_length()),
        sum(map(len, words)) / n_words,
        *(count / size for count in kinds),
        (size - sum(kinds)) / size,
        len(set(words)) / n_words,
        n_words / len(lines),
        1 - len(set(lines)) / len(lines),
        len(LONG_WORD.findall(data)) / n_words,
    ]


def with_text_view(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    def work():
        def compute(texts: pa.Array) -> list[pa.Array]:
            return [pa.array([text_features(text) for text in texts.to_pylist()], pa.list_(pa.float64()))]

        return compute

    rows = map_arrow(docs, [text_col], keep, [T.StructField("text_view", T.ArrayType(T.DoubleType()))], work)
    return rows.select(*keep, *(F.get("text_view", i).alias(name) for i, name in enumerate(TEXT_FEATURES)))


def as_text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("(none)"))


def views(docs: DataFrame, hosts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, the features of both views, and the vectors ``text_raw`` and ``meta``; ``hosts`` has ``doc_id, host``."""
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        as_text(F.col("source")).alias("source"),
        as_text(F.col("lang")).alias("lang"),
        F.log2(1 + F.coalesce(F.col("n_chars"), F.lit(0))).cast("int").cast("string").alias("length"),
    )
    rows = with_text_view(rows, "text", ["id", "source", "lang", "length"])
    shown = hosts.groupBy("doc_id").agg(F.min("host").alias("host"))
    rows = rows.join(shown, rows["id"] == shown["doc_id"], "left").drop("doc_id")
    rows = rows.withColumn("host", as_text(F.col("host")))
    rows = VectorAssembler(inputCols=TEXT_FEATURES, outputCol="text_raw").transform(rows)
    return FeatureHasher(inputCols=META_FEATURES, outputCol="meta", numFeatures=HASHED).transform(rows)


@dataclass
class Calibrated:
    """A view's classifier and the slope and offset of its calibrated log-odds."""

    classifier: LogisticRegressionModel
    slope: float
    offset: float

    def log_odds(self, vector: str) -> Column:
        return self.slope * raw_log_odds(vector) + self.offset


def raw_log_odds(scored: str) -> Column:
    return F.get(vector_to_array(F.col(f"{scored}_raw_score")), 1)


@dataclass
class Model:
    scaler: StandardScalerModel | None
    text: Calibrated | None
    meta: Calibrated | None
    prior: float


def in_few_tasks(rows: DataFrame) -> DataFrame:
    """``rows`` in tasks of about ``FIT_ROWS``; only small inputs end up in few."""
    return rows.coalesce(max(FIT_TASKS, -(-rows.count() // FIT_ROWS)))


def train(rows: DataFrame, vector: str) -> LogisticRegressionModel:
    return LogisticRegression(
        featuresCol=vector,
        labelCol="label",
        weightCol="weight",
        rawPredictionCol=f"{vector}_raw_score",
        probabilityCol=f"{vector}_share",
        predictionCol=f"{vector}_label",
        regParam=RIDGE,
        maxIter=25,
    ).fit(in_few_tasks(rows))


def both_labels(rows: DataFrame) -> bool:
    return rows.select("label").distinct().count() == 2


def confident(pool: DataFrame, classifier: LogisticRegressionModel, vector: str) -> DataFrame:
    """Pool rows the classifier is sure of, with its label."""
    share = F.get(vector_to_array(F.col(f"{vector}_share")), 1)
    rows = classifier.transform(pool).where((share >= CONFIDENT) | (share <= 1 - CONFIDENT))
    label = (share >= 0.5).cast("double")
    return rows.select("id", "text_view", "meta", label.alias("label"), F.lit(PSEUDO_WEIGHT).alias("weight"))


def calibrate(rows: DataFrame, classifier: LogisticRegressionModel, vector: str) -> Calibrated:
    """Slope and offset of the log-odds on rows the classifier was not trained on."""
    scored = classifier.transform(rows).select("label", "weight", F.array(raw_log_odds(vector)).alias("odds"))
    if not both_labels(scored):
        return Calibrated(classifier, 1.0, 0.0)
    scored = VectorAssembler(inputCols=["odd"], outputCol="features").transform(scored.withColumn("odd", F.get("odds", 0)))
    line = LogisticRegression(labelCol="label", weightCol="weight", regParam=RIDGE, maxIter=25).fit(in_few_tasks(scored))
    return Calibrated(classifier, max(0.0, float(line.coefficients[0])), float(line.intercept))


def fit(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Co-train on ``rows`` (a stored result of ``views``) with the given ``labels``."""
    usable = labels.where(F.col(label_col).isin(0, 1) & (fold(F.col(id_col), FOLDS) != HELD_OUT_FOLD))
    known = usable.select(F.col(id_col).alias("known_id"), F.col(label_col).cast("double").alias("label"))
    known = known.orderBy(F.xxhash64("known_id"), "known_id", "label").limit(TRAIN_ROWS)
    known = stored(known, "quality-labels")
    chosen = rows.join(F.broadcast(known), rows["id"] == known["known_id"]).drop("known_id")
    chosen = stored(chosen.select("id", "text_raw", "meta", "label", F.lit(1.0).alias("weight")), "quality-rows")
    # Labelled ids are no part of the pool; held-out rows are neither.
    every = labels.select(F.col(id_col).alias("known_id")).where("known_id is not null").distinct()
    pool = rows.where(fold(F.col("id"), FOLDS) != HELD_OUT_FOLD).select("id", "text_raw", "meta")
    pool = pool.join(every, pool["id"] == every["known_id"], "left_anti")

    training = chosen.where(fold(F.col("id"), FOLDS) != CALIBRATION_FOLD)
    calibration = chosen.where(fold(F.col("id"), FOLDS) == CALIBRATION_FOLD)
    total, ones = training.agg(F.count("*"), F.sum("label")).first()
    if not total or ones in (0, total):
        return Model(None, None, None, (ones or 0) / total if total else 0.0)
    scaler = StandardScaler(inputCol="text_raw", outputCol="text_view", withMean=True).fit(training)
    columns = ["id", "text_view", "meta", "label", "weight"]
    training = stored(scaler.transform(training).select(columns), "quality-training")
    calibration = scaler.transform(calibration)
    pool = stored(scaler.transform(pool).select("id", "text_view", "meta"), "quality-pool")
    for_text, for_meta = training, training
    by_text, by_meta = train(for_text, "text_view"), train(for_meta, "meta")
    for _ in range(ROUNDS):
        for_meta = training.union(confident(pool, by_text, "text_view"))
        for_text = training.union(confident(pool, by_meta, "meta"))
        by_text, by_meta = train(for_text, "text_view"), train(for_meta, "meta")
    text = calibrate(calibration, by_text, "text_view")
    meta = calibrate(calibration, by_meta, "meta")
    return Model(scaler, text, meta, ones / total)


def score(rows: DataFrame, model: Model) -> DataFrame:
    """``id`` and ``score``, the chance of label 1, for each of ``rows``."""
    if model.scaler is None:
        return rows.select("id", F.lit(float(model.prior)).alias("score"))
    scored = model.scaler.transform(rows)
    scored = model.meta.classifier.transform(model.text.classifier.transform(scored))
    prior = F.log(F.lit(model.prior / (1 - model.prior)))
    log_odds = model.text.log_odds("text_view") + model.meta.log_odds("meta") - prior
    return scored.select("id", (1 / (1 + F.exp(-log_odds))).alias("score"))


def quality_scores(
    docs: DataFrame, labels: DataFrame, hosts: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """One row per row of ``docs``: its id, ``held_out``, ``score`` and ``predicted``."""
    rows = stored(views(docs, hosts, id_col, text_col).drop(*TEXT_FEATURES, *META_FEATURES), "quality-views")
    scored = score(rows, fit(rows, labels, id_col, label_col))
    return scored.select(
        F.col("id").alias(id_col),
        (fold(F.col("id"), FOLDS) == HELD_OUT_FOLD).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
