import hashlib
from collections import Counter

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import Observation
from pyspark.sql import functions as F

import fault_drill as faults
from kerbline import fixed
from kerbline.operators import ml
from kerbline.operators.features import add_scores


def corpus(spark, n=400):
    """Reports whose text names their class."""
    level = F.element_at(F.array(*[F.lit(s) for s in fixed.SEVERITIES]), (F.col("id") % 4 + 1).cast("int"))
    text = F.concat_ws(" ", F.lit("collision on road"), F.col("id") % 7, F.lit("priority"), level)
    return spark.range(n).select(F.col("id").cast("string").alias("id"), text.alias("text"), level.alias("severity"))


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("model") / "m")
    # a session that has counted rows while writing, as the ETL job does, before it trains
    seen = Observation("seen")
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    assert seen.get["rows"] == 3
    model, metrics = ml.run_classifier(corpus(spark), "id", path)
    return model, {(r.classifier, r.condition): r for r in metrics.collect()}, path


def test_conditions_and_metrics(trained):
    _, metrics, _ = trained
    assert set(metrics) == {("logreg", "clean"), ("svm", "clean"), ("logreg", "null_20pct"), ("logreg", "noisy_labels_10pct")}
    assert metrics["logreg", "clean"].accuracy == metrics["svm", "clean"].f1 == 1.0
    assert 0.6 < metrics["logreg", "null_20pct"].accuracy < 0.97
    assert metrics["logreg", "noisy_labels_10pct"].accuracy > 0.95


def test_saved_model_scores_features(spark, trained):
    from kerbline.sources.readers import load_model

    _, _, path = trained
    rows = [("1", "X", "north", 50.0, "low", "car", 3, "clear", 8), ("2", "X", "north", 20.0, "critical", "police", 3, "foggy", 23)]
    records = add_scores(spark.createDataFrame(rows, "event_id string, intersection_id string, zone string, speed_kmh float, congestion string, vehicle_type string, vehicle_count int, weather string, hour int"))
    scored = ml.score(records, load_model(path))
    assert scored.columns == [*fixed.SCORED_COLUMNS, "predicted_severity"]
    got = {r.event_id: r.predicted_severity for r in scored.collect()}
    assert got == {"1": "low", "2": "critical"}


def test_metrics_equal_the_evaluator(spark, trained):
    model, _, _ = trained
    test = ml.relabel(corpus(spark), "id", fixed.SEVERITIES, share=0.5)
    predictions = model.transform(test)
    mine = ml.evaluate(predictions).first()
    for name, value in (("accuracy", mine.accuracy), ("f1", mine.f1)):
        theirs = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction", metricName=name).evaluate(predictions)
        assert value == round(theirs, 4)


def test_index_beyond_the_labels_is_unknown(spark, trained):
    model, _, _ = trained
    named = ml.with_predicted_severity(spark.createDataFrame([(4.0,), (0.0,)], "prediction double"), model).collect()
    assert named[0].predicted_severity == ml.UNKNOWN_LABEL
    assert named[1].predicted_severity in fixed.SEVERITIES


def test_draws_do_not_depend_on_partitions(spark):
    df = corpus(spark, 1000)
    train, test = ml.split_train_test(df, "id")
    again, _ = ml.split_train_test(df.repartition(7), "id")
    assert {r.id for r in train.collect()} == {r.id for r in again.collect()}
    assert train.count() + test.count() == 1000
    assert 750 < train.count() < 850
    lost = ml.drop_out_text(df, "id").where(F.col("text") == fixed.DROPOUT_TEXT).count()
    assert 150 < lost < 250
    changed = ml.relabel(df, "id", fixed.SEVERITIES).join(df.withColumnRenamed("severity", "old"), "id").where("severity <> old").count()
    assert 45 < changed < 105


def test_no_labelled_rows_is_an_error(spark):
    with pytest.raises(RuntimeError):
        ml.labelled(spark.createDataFrame([("t", None), (None, "low")], "text string, severity string"))
    with pytest.raises(ValueError):
        ml.build_text_classifier("tree")


def test_batch_faults_drop_a_fortieth(spark):
    n = 20000
    good = spark.range(n).select(
        F.col("id").cast("string").alias("event_id"), F.lit("2024-01-15T08:30:00").alias("timestamp"),
        F.lit("X").alias("intersection_id"), F.lit("north").alias("zone"), F.lit(50.0).cast("float").alias("speed_kmh"),
        F.lit("low").alias("congestion"), F.lit("car").alias("vehicle_type"), F.lit(3).alias("vehicle_count"),
        F.lit("clear").alias("weather"), F.lit("red").alias("signal_phase"), F.lit(False).alias("incident_flag"),
        F.lit("normal").alias("record_type"),
    )
    from kerbline.operators.cleaning import quality_stats

    stats = quality_stats(faults.inject_batch_faults(good)).first()
    assert 2.0 < stats.drop_rate_pct < 3.0


def test_new_labels_take_the_words_that_are_there(spark):
    train = corpus(spark, 200)
    words, rows = ml.word_features(train)
    assert set(rows.columns) == {"id", "severity", "features"}
    noisy = ml.relabel(rows, "id", fixed.SEVERITIES, share=0.5)
    front, made = ml.index_labels(words, noisy)
    whole = ml.relabel(train, "id", fixed.SEVERITIES, share=0.5)
    expected = Pipeline(stages=ml.build_text_classifier().getStages()[:-1]).fit(whole).transform(whole)
    assert Counter(map(tuple, made.collect())) == Counter(map(tuple, expected.select("label", "features").collect()))
    assert front.transform(train.limit(3)).select("features").count() == 3


def test_intervals_by_run_are_those_of_each_run(spark):
    rows = [(run, key, float(i % 3), float(i * i % 3)) for run in ("a", "b") for i in range(90) for key in (str(i // 2), None)]
    rows = [(run, key, label, label if run == "b" else guess) for run, key, label, guess in rows]
    predictions = spark.createDataFrame(rows, "run string, key string, label double, prediction double")

    expected = Counter()
    for run, key, label, guess in rows:
        for replicate in range(10 if key is not None else 0):
            block, place = divmod(replicate, ml.DRAWS_PER_DIGEST)
            digest = hashlib.md5(f"{block + ml.BOOTSTRAP_SEED}:{key}".encode()).hexdigest()
            drawn = int(digest[8 * place : 8 * place + 8], 16) / 4294967296
            expected[run, replicate, label, guess] += sum(drawn >= step for step in ml.poisson_steps())
    cells = ml.bootstrap_cells(predictions, "key", 10, ["run"])
    assert cells.columns == ["run", "replicate", "label", "prediction", "n"]
    assert {tuple(r)[:4]: r.n for r in cells.collect()} == {cell: n for cell, n in expected.items() if n}

    together = {r.run: tuple(r)[1:] for r in ml.intervals(predictions, "key", by=["run"]).collect()}
    apart = {run: tuple(ml.intervals(predictions.where(F.col("run") == run), "key").first()) for run in ("a", "b")}
    assert together == apart
    assert apart["a"] != apart["b"]
    assert tuple(ml.intervals(predictions.where("run = 'c'"), "key").first()) == (None,) * 6
