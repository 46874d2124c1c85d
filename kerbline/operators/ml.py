"""Text classification of severity with MLlib, its metrics and its robustness drills."""

from __future__ import annotations

import math
import time
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import IDF, HashingTF, IDFModel, StopWordsRemover, StringIndexer, StringIndexerModel, Tokenizer
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from kerbline import fixed
from kerbline.functions.cells import pick, scoring_text, unit_draw
from kerbline.operators.fitting import fit_side_by_side
from kerbline.session import scratch_path, store

UNKNOWN_LABEL = "__unknown"
CLASSES_AT_ONCE = 4
ROWS_PER_TASK = 10_000


def labelled(df: DataFrame) -> DataFrame:
    """Rows with text and label; an empty corpus is an error, not an untrained model."""
    kept = df.where(F.col("text").isNotNull() & F.col("severity").isNotNull())
    if kept.isEmpty():
        raise RuntimeError("no labelled records: check the path and the format of the corpus")
    return kept


def build_text_classifier(classifier: str = "logreg") -> Pipeline:
    """Tokens, stop words, hashed term frequencies, IDF, label index, then the classifier."""
    shared = {"featuresCol": "features", "labelCol": "label"}
    if classifier == "logreg":
        last = LogisticRegression(
            maxIter=fixed.CLASSIFIER_ITERATIONS,
            regParam=fixed.CLASSIFIER_REG,
            elasticNetParam=fixed.CLASSIFIER_ELASTIC_NET,
            family="multinomial",
            **shared,
        )
    elif classifier == "svm":
        one = LinearSVC(maxIter=fixed.CLASSIFIER_ITERATIONS, regParam=fixed.CLASSIFIER_REG, **shared)
        last = OneVsRest(classifier=one, parallelism=CLASSES_AT_ONCE, **shared)
    else:
        raise ValueError(f"unknown classifier {classifier!r}: logreg or svm")
    return Pipeline(
        stages=[
            Tokenizer(inputCol="text", outputCol="words"),
            StopWordsRemover(inputCol="words", outputCol="filtered"),
            HashingTF(inputCol="filtered", outputCol="raw_features", numFeatures=fixed.HASHED_TERMS),
            IDF(inputCol="raw_features", outputCol="features", minDocFreq=fixed.MIN_DOC_FREQ),
            StringIndexer(inputCol="severity", outputCol="label", handleInvalid="keep"),
            last,
        ]
    )


def word_features(train: DataFrame) -> tuple[PipelineModel, DataFrame]:
    """The fitted stages before the label index, and the training rows with their ``features`` instead of the text.

    A text is cut into words once: its hashed counts are stored, and everything behind them works from there; a lost
    executor costs a read and not the whole preparation. A small set is put in few tasks.
    """
    *cut, weigh = build_text_classifier().getStages()[:4]
    counted = store(PipelineModel(cut).transform(train).drop("text", "words", "filtered"), "counted")
    weighed = weigh.fit(counted)
    tasks = -(-weighed.numDocs // ROWS_PER_TASK)
    rows = weighed.transform(counted.coalesce(max(tasks, 1))).drop("raw_features")
    return PipelineModel([*cut, weighed]), rows


def index_labels(words: PipelineModel, rows: DataFrame) -> tuple[PipelineModel, DataFrame]:
    """The fitted stages before the classifier, and its training rows, from what ``word_features`` gave."""
    indexer = build_text_classifier().getStages()[4].fit(rows)
    return PipelineModel([*words.stages, indexer]), indexer.transform(rows).select("label", "features")


def text_features(train: DataFrame) -> tuple[PipelineModel, DataFrame]:
    return index_labels(*word_features(train))


def fit_classifiers(rows: DataFrame, wanted: Sequence[tuple[PipelineModel, str, str]]) -> list[PipelineModel]:
    """The whole models, one per wanted ``(stages in front, label column, classifier)``, all of the same ``features``.

    They are fitted side by side: the rows are kept once, however many models there are, and a pass serves them all.
    """
    stages = [build_text_classifier(classifier).getStages()[-1] for _, _, classifier in wanted]
    weights = next(s for s in wanted[0][0].stages if isinstance(s, IDFModel)).idf.toArray()
    labels = [label for _, label, _ in wanted]
    fitted = fit_side_by_side(rows, weights, list(zip(stages, labels, strict=True)))
    return [
        PipelineModel([*front.stages, last or _fit_alone(rows.select(F.col(label).alias("label"), "features"), stage)])
        for (front, label, _), stage, last in zip(wanted, stages, fitted, strict=True)
    ]


def _fit_alone(rows: DataFrame, stage):
    """MLlib's own fit. The model is taken back from its saved form: a fresh one carries its training summary into every
    scoring task, and with it the session, which may not serialize."""
    fitted = stage.fit(rows)
    path = scratch_path(rows.sparkSession, "classifier")
    fitted.write().save(path)
    return type(fitted).load(path)


def fit_classifier(front: PipelineModel, rows: DataFrame, classifier: str = "logreg") -> PipelineModel:
    return fit_classifiers(rows, [(front, "label", classifier)])[0]


def fit_text_classifier(train: DataFrame, classifier: str = "logreg") -> PipelineModel:
    return fit_classifier(*text_features(train), classifier)


def split_train_test(df: DataFrame, key: str, train_share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """A seeded split decided by each row's key: stable under any partitioning, without a sort."""
    in_train = unit_draw(F.col(key), seed) < train_share
    return df.where(in_train), df.where(~in_train)


def drop_out_text(df: DataFrame, key: str, share: float = 0.2, seed: int = 1) -> DataFrame:
    """Replace the text of about ``share`` of the rows by one constant sentence."""
    lost = unit_draw(F.col(key), seed) < share
    return df.withColumn("text", F.when(lost, fixed.DROPOUT_TEXT).otherwise(F.col("text")))


def relabel(df: DataFrame, key: str, labels: list[str], share: float = 0.1, seed: int = 2) -> DataFrame:
    """Draw a new label for about ``share`` of the rows; it may equal the old one."""
    hit = unit_draw(F.col(key), seed) < share
    return df.withColumn(
        "severity", F.when(hit, pick(labels, unit_draw(F.col(key), seed + 1))).otherwise(F.col("severity"))
    )


def confusion(predictions: DataFrame, *by: str) -> DataFrame:
    """Counts per true and predicted class index, per ``by``; a few rows whatever the input."""
    return predictions.groupBy(*by, "label", "prediction").agg(F.count(F.lit(1)).cast("double").alias("n"))


def _scores(cells: DataFrame, *by: str) -> DataFrame:
    """``accuracy`` and weighted ``f1`` of confusion counts (``label, prediction, n``), unrounded, per ``by``."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0.0)
    sides = cells.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col("label").alias("cls"), F.col("n").alias("actual"), F.lit(0.0).alias("guessed"), hit.alias("hits")),
                F.struct(F.col("prediction").alias("cls"), F.lit(0.0).alias("actual"), F.col("n").alias("guessed"), F.lit(0.0).alias("hits")),
            )
        ).alias("s"),
    )
    per_class = sides.groupBy(*by, "s.cls").agg(
        F.sum("s.actual").alias("actual"), F.sum("s.guessed").alias("guessed"), F.sum("s.hits").alias("hits")
    )
    f1 = 2 * F.col("hits") / (F.col("actual") + F.col("guessed"))
    return per_class.groupBy(*by).agg(
        (F.sum("hits") / F.sum("actual")).alias("accuracy"), (F.sum(f1 * F.col("actual")) / F.sum("actual")).alias("f1")
    )


def evaluate(predictions: DataFrame, *by: str) -> DataFrame:
    """Accuracy and weighted F1, four decimals, per ``by``, from one pass over the predictions."""
    return _scores(confusion(predictions, *by), *by).select(*by, *(F.round(name, 4).alias(name) for name in ("accuracy", "f1")))


REPLICATES = 200
CONFIDENCE = 0.95
BOOTSTRAP_SEED = 100
DRAWS_PER_DIGEST = 4


def poisson_steps() -> list[float]:
    """The shares of a Poisson variable of mean 1 at most 0, 1, 2, ..., as far as 32 bits tell them from 1."""
    steps, term, total = [], math.exp(-1), 0.0
    while 1 - total > 2.0**-33:
        total += term
        steps.append(total)
        term /= len(steps)
    return steps


def bootstrap_cells(predictions: DataFrame, key: str, replicates: int = REPLICATES, by: Sequence[str] = ()) -> DataFrame:
    """``by, replicate, label, prediction, n``: how often each replicate draws a pair of classes.

    A row's weights follow from its key alone (a Poisson draw of mean 1 each), so a task that runs again draws the same
    and no replicate needs the rows together. One digest gives four draws, summed side by side before the shuffle; a row
    without a key is drawn into none.
    """
    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // DRAWS_PER_DIGEST) - 1)))
    keyed = predictions.where(F.col(key).isNotNull())
    rows = keyed.select(*by, "label", "prediction", F.col(key).cast("string").alias("_key"), blocks.alias("_block"))
    seed = (F.col("_block") + BOOTSTRAP_SEED).cast("string")
    rows = rows.withColumn("_digest", F.md5(F.concat(seed, F.lit(":"), "_key")))

    # Eight hex digits order as the numbers they stand for, so a draw is compared as it lies in the digest.
    below = [f"{least:08x}" for least in (math.ceil(step * 2**32) for step in poisson_steps()) if least < 2**32]

    def weight(place: int) -> Column:
        drawn = F.substring("_digest", 8 * place + 1, 8)
        cases = F.when(drawn < below[0], 0)
        for number, limit in enumerate(below[1:], 1):
            cases = cases.when(drawn < limit, number)
        return cases.otherwise(len(below))

    places = range(DRAWS_PER_DIGEST)
    summed = rows.groupBy(*by, "label", "prediction", "_block").agg(*(F.sum(weight(p)).alias(f"_n{p}") for p in places))
    apart = F.posexplode(F.array(*(f"_n{p}" for p in places))).alias("_place", "_n")
    made = summed.select(*by, "label", "prediction", "_block", apart).select(
        *by, (F.col("_block") * DRAWS_PER_DIGEST + F.col("_place")).alias("replicate"), "label", "prediction",
        F.col("_n").cast("double").alias("n"),
    )
    return made.where((F.col("n") > 0) & (F.col("replicate") < replicates))


def intervals(
    predictions: DataFrame,
    key: str,
    replicates: int = REPLICATES,
    confidence: float = CONFIDENCE,
    by: Sequence[str] = (),
) -> DataFrame:
    """Accuracy and weighted F1 with the bounds of their bootstrap intervals, four decimals, in one row per ``by``.

    Weights are summed per replicate and pair of classes before the shuffle; what remains is ``replicates`` times the
    squared number of classes. Without predictions all are null, and there is no row per ``by``.
    """
    drawn = _scores(bootstrap_cells(predictions, key, replicates, by), *by, "replicate")
    shares = [(1 - confidence) / 2, (1 + confidence) / 2]
    bounds = drawn.groupBy(*by).agg(
        *(
            F.round(F.percentile(name, share), 4).alias(f"{name}_{side}")
            for name in ("accuracy", "f1")
            for side, share in zip(("low", "high"), shares, strict=True)
        )
    )
    both = evaluate(predictions, *by).unionByName(bounds, allowMissingColumns=True)
    return both.groupBy(*by).agg(*(F.max(name).alias(name) for name in both.columns if name not in by))


def predicted(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Scored rows; with ``features`` of the model's words at hand, no text is cut again."""
    if "features" not in df.columns:
        return model.transform(df)
    place = next(i for i, s in enumerate(model.stages) if isinstance(s, StringIndexerModel))
    return PipelineModel(model.stages[place:]).transform(df)


def store_predictions(predictions: DataFrame, key: str, classifier: str, condition: str, path: str) -> DataFrame:
    """Write the key, class indices and names of scored test rows; what was written."""
    folder = f"{path}/classifier={classifier}/condition={condition}"
    rows = predictions.select(F.col(key).cast("string").alias("key"), "severity", "label", "prediction")
    rows.write.mode("overwrite").parquet(folder)
    return predictions.sparkSession.read.schema(rows.schema).parquet(folder)


def train_and_evaluate(
    train: DataFrame,
    test: DataFrame,
    classifier: str = "logreg",
    condition: str = "clean",
    prepared: tuple[PipelineModel, DataFrame] | None = None,
    keep: tuple[str, str] | None = None,
    fitted: tuple[PipelineModel, float] | None = None,
) -> tuple[PipelineModel, Row]:
    """Fit and evaluate; ``prepared`` is the ``text_features`` of the training rows where they are known.

    With ``keep``, the key column and a folder, the predictions are stored and evaluated as they were written. A model
    that was ``fitted`` before comes with the seconds its fit took, which count; fits side by side took the same seconds.
    """
    started = time.perf_counter()
    model, before = fitted or (fit_classifier(*(prepared or text_features(train)), classifier), 0.0)
    predictions = predicted(model, test)
    if keep:
        predictions = store_predictions(predictions, keep[0], classifier, condition, keep[1])
    scores = evaluate(predictions).first()
    elapsed = round(before + time.perf_counter() - started, 2)
    return model, Row(
        classifier=classifier,
        condition=condition,
        accuracy=scores["accuracy"],
        f1=scores["f1"],
        elapsed_sec=elapsed,
    )


def run_classifier(
    corpus: DataFrame,
    key: str = "id",
    model_path: str | None = None,
    labels: list[str] = fixed.SEVERITIES,
    predictions_path: str | None = None,
) -> tuple[PipelineModel, DataFrame]:
    """Train both classifiers, save the first, run both drills; the model and one metrics row each.

    With ``predictions_path`` the predictions behind each metrics row lie there by classifier and condition.

    All three fits take the same words, so the stages in front are fitted once, drawing new labels needs no text, and the
    fits run side by side. Training and test texts are cut into words once each; only texts that are lost are cut again.
    """
    spark = corpus.sparkSession
    kept = labelled(corpus).select(key, "text", "severity")
    keep = (key, predictions_path) if predictions_path else None
    train, test = split_train_test(kept, key)
    words, rows = word_features(train)
    tested = store(words.transform(test).select(key, "severity", "features"), "tested")

    started = time.perf_counter()
    front, noisy_front = index_labels(words, rows)[0], index_labels(words, relabel(rows, key, labels))[0]
    named = front.stages[-1].transform(rows).withColumnRenamed("label", "clean")
    both = noisy_front.stages[-1].transform(relabel(named, key, labels)).withColumnRenamed("label", "noisy")
    wanted = [(front, "clean", "logreg"), (front, "clean", "svm"), (noisy_front, "noisy", "logreg")]
    models = fit_classifiers(both.select("clean", "noisy", "features"), wanted)
    fitted = [(found, time.perf_counter() - started) for found in models]

    model, clean = train_and_evaluate(train, tested, "logreg", "clean", keep=keep, fitted=fitted[0])
    if model_path:
        model.write().overwrite().save(model_path)
    _, svm = train_and_evaluate(train, tested, "svm", "clean", keep=keep, fitted=fitted[1])
    lost = drop_out_text(tested.withColumn("text", F.lit(None).cast("string")), key)
    again = words.transform(lost.where(F.col("text").isNotNull()).drop("features")).select(*tested.columns)
    dropped = predicted(model, lost.where(F.col("text").isNull()).drop("text").unionByName(again))
    if keep:
        dropped = store_predictions(dropped, key, "logreg", "null_20pct", predictions_path)
    dropped = evaluate(dropped).first()
    no_text = Row(classifier="logreg", condition="null_20pct", elapsed_sec=None, **dropped.asDict())
    _, noisy = train_and_evaluate(train, tested, "logreg", "noisy_labels_10pct", keep=keep, fitted=fitted[2])
    rows = [tuple(r[c] for c in ("classifier", "condition", "accuracy", "f1", "elapsed_sec")) for r in (clean, svm, no_text, noisy)]
    return model, spark.createDataFrame(
        rows, "classifier string, condition string, accuracy double, f1 double, elapsed_sec double"
    )


def with_predicted_severity(predictions: DataFrame, model: PipelineModel) -> DataFrame:
    """Turn class indices back into names; the index after the last name stands for unseen labels."""
    indexer = next(s for s in model.stages if isinstance(s, StringIndexerModel))
    names = [*indexer.labels, UNKNOWN_LABEL]
    index = F.col("prediction").cast("int")
    return predictions.withColumn(
        "predicted_severity", F.get(F.array(*[F.lit(n) for n in names]), index)
    )


def score(features: DataFrame, model: PipelineModel) -> DataFrame:
    """Score feature records with a saved model: the hand-over columns and ``predicted_severity``."""
    predictions = model.transform(features.withColumn("text", scoring_text()))
    return with_predicted_severity(predictions, model).select(*fixed.SCORED_COLUMNS, "predicted_severity")
