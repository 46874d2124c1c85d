import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from kerbline.operators import fitting, ml


def corpus(spark, n=240, classes=3):
    """Texts of seven words out of forty, drawn by digest; a third of the words lean to a class of the row."""
    cls = F.col("id") % classes
    draw = lambda i: F.conv(F.substring(F.md5(F.concat_ws(":", "id", F.lit(str(i)))), 1, 6), 16, 10).cast("int")
    words = [F.concat(F.lit("w"), (draw(i) % 40).cast("string")) for i in range(6)]
    words.append(F.concat(F.lit("c"), F.when(draw(9) % 4 == 0, draw(8) % classes).otherwise(cls).cast("string")))
    text = F.when(F.col("id") % 50 == 7, F.lit("the")).otherwise(F.concat_ws(" ", *words))
    return spark.range(n).select(F.col("id").cast("string").alias("id"), text.alias("text"), F.concat(F.lit("s"), cls).alias("severity"))


@pytest.fixture(scope="module")
def prepared(spark):
    return ml.text_features(corpus(spark))


def short(classifier):
    stage = ml.build_text_classifier(classifier).getStages()[-1]
    (stage.getClassifier() if classifier == "svm" else stage).setMaxIter(12)
    return stage


@pytest.mark.parametrize("few", [0, fitting.FEW_WORDS])
def test_models_are_those_of_mllib(prepared, monkeypatch, few):
    monkeypatch.setattr(fitting, "FEW_WORDS", few)
    front, rows = prepared
    weights = front.stages[3].idf.toArray()
    logreg, svm = fitting.fit_side_by_side(rows, weights, [(short("logreg"), "label"), (short("svm"), "label")])
    theirs = short("logreg").fit(rows)
    assert logreg.numClasses == theirs.numClasses == 4
    assert np.allclose(logreg.coefficientMatrix.toArray(), theirs.coefficientMatrix.toArray(), atol=1e-6)
    assert np.allclose(logreg.interceptVector.toArray(), theirs.interceptVector.toArray(), atol=1e-6)
    for mine, other in zip(svm.models, short("svm").fit(rows).models, strict=True):
        assert np.allclose(mine.coefficients.toArray(), other.coefficients.toArray(), atol=1e-6)
        assert mine.intercept == pytest.approx(other.intercept, abs=1e-6)


def test_one_set_of_rows_serves_all_fits(spark, prepared, monkeypatch):
    front, rows = prepared
    kept, asked, together = [], [], fitting._together

    def seen(blocks, tasks, *rest):
        asked.append(len(tasks))
        kept.append(spark.sparkContext._jsc.sc().getPersistentRDDs().size())
        return together(blocks, tasks, *rest)

    monkeypatch.setattr(fitting, "_together", seen)
    monkeypatch.setattr(fitting, "FEW_WORDS", 0)
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    models = ml.fit_classifiers(rows, [(front, "label", "logreg"), (front, "label", "svm")])
    assert asked[0] == 4  # the regression and three classes in one pass
    assert max(kept) <= before + 1
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == before
    assert [type(m.stages[-1]).__name__ for m in models] == ["LogisticRegressionModel", "OneVsRestModel"]


def test_a_single_class_is_left_to_mllib(spark):
    front, rows = ml.text_features(corpus(spark, 20, classes=1))
    model = ml.fit_classifier(front, rows)
    assert {r.prediction for r in model.transform(corpus(spark, 5, classes=1)).collect()} == {0.0}


def test_blocks_hold_all_words(monkeypatch):
    """Rows without words, beyond a block, with many of a word and with values that are no counts, against dense sums."""
    monkeypatch.setattr(fitting, "BLOCK_WORDS", 4)
    weights = np.array([0.5, 0.0, 1.25, 2.0, 3.0, 0.1])
    rows = [{}, {0: 1, 2: 2}, {i: i + 1 for i in (0, 2, 3, 4, 5)}, {}, {2: 700}, {1: 3}, {3: 0.3}, {5: 1}]
    dense = np.array([[row.get(j, 0) * weights[j] for j in range(6)] for row in rows])
    batch = pa.RecordBatch.from_pydict(
        {
            "label": pa.array([float(i % 3) for i in range(len(rows))]),
            "columns": pa.array([list(row) for row in rows], pa.list_(pa.int32())),
            "values": pa.array([[row[j] * weights[j] for j in row] for row in rows], pa.list_(pa.float64())),
        }
    )
    blocks = [r for made in fitting._packed(weights, ["label"])([batch.slice(0, 5), batch.slice(5)]) for r in made["block"].to_pylist()]
    assert len(blocks) > 3
    rng = np.random.default_rng(1)
    slopes, offsets = rng.normal(size=(3, 6)), rng.normal(size=4)
    scale = np.divide(1, weights, out=np.zeros(6), where=weights != 0)
    counts, label = dense * scale, np.arange(len(rows)) % 3

    class Shared:
        value = ([("softmax", 0, 3, 0), ("hinge", 0, 1, 2)], slopes, offsets)

    (losses, totals, sums), *more = fitting._sums(iter(blocks), Shared)
    assert not more
    margins = counts @ np.vstack([slopes[:2], -slopes[:2].sum(axis=0)]).T + offsets[:3]
    chances = np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)
    off = chances - np.eye(3)[label]
    assert losses[0] == pytest.approx(-np.log(chances[np.arange(len(rows)), label]).sum())
    assert np.allclose(totals[:3], off.sum(axis=0))
    assert np.allclose(sums[:2], (off.T @ counts)[:2])
    sign = np.where(label == 2, 1.0, -1.0)
    loss = np.maximum(1 - sign * (counts @ slopes[2] + offsets[3]), 0)
    assert losses[1] == pytest.approx(loss.sum())
    assert np.allclose(sums[2], np.where(loss > 0, -sign, 0.0) @ counts)


def test_lost_texts_are_scored_as_the_constant(spark, tmp_path):
    texts = corpus(spark)
    model, metrics = ml.run_classifier(texts, "id", labels=["s0", "s1", "s2"], predictions_path=str(tmp_path))
    _, test = ml.split_train_test(texts, "id")
    for condition, rows in (("clean", test), ("null_20pct", ml.drop_out_text(test, "id"))):
        stored = spark.read.parquet(f"{tmp_path}/classifier=logreg/condition={condition}")
        expected = {r.id: (r.severity, r.label, r.prediction) for r in model.transform(rows).collect()}
        assert {r.key: (r.severity, r.label, r.prediction) for r in stored.collect()} == expected
    assert all(r.elapsed_sec > 0 for r in metrics.collect() if r.condition != "null_20pct")


def test_sparse_rows_of_dense_columns_keep_their_place(spark):
    """Columns of one value have no deviation and take no part, as in MLlib."""
    rows = spark.createDataFrame(
        [(float(i % 2), Vectors.sparse(4, {0: 2.0, 1: float(1 + i % 5), 2: float(1 + (i * 7 + i % 2) % 3)})) for i in range(40)], ["label", "features"]
    )
    weights = np.array([1.0, 1.0, 1.0, 1.0])
    (mine,) = fitting.fit_side_by_side(rows, weights, [(short("logreg"), "label")])
    theirs = short("logreg").fit(rows.repartition(1))
    assert np.allclose(mine.coefficientMatrix.toArray(), theirs.coefficientMatrix.toArray(), atol=1e-6)
    assert not mine.coefficientMatrix.toArray()[:, [0, 3]].any()
