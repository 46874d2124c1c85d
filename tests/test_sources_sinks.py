import json

import pytest

from kerbline import fixed
from kerbline.operators import reports
from kerbline.operators.features import add_features
from kerbline.operators.ml import labelled
from kerbline.plans import sensor_views as views
from kerbline.plans.etl import run_features
from kerbline.plans.scoring import run_decisions
from kerbline.session import scratch_path, shared_dir
from kerbline.sources import readers, writers


def test_registered_tables_see_their_partitions(spark, sf_dir, tmp_path):
    clean, feats = str(tmp_path / "clean"), str(tmp_path / "it's features")
    writers.write_clean(views.sensor_clean(spark, sf_dir), clean)
    run_features(clean, feats, spark)
    names = ("kerbline_clean_t", "kerbline_features_t")
    listed = {r.tableName for r in writers.register_tables(spark, clean, feats, names).collect()}
    assert set(names) <= listed
    assert spark.table(names[1]).count() == views.sensor_clean(spark, sf_dir).count()
    share = {r.severity_label: r.pct for r in reports.severity_share_sql(spark, names[1]).collect()}
    assert 99.5 < sum(share.values()) < 100.5
    writers.register_tables(spark, clean, feats, names)
    for name in names:
        spark.sql(f"DROP TABLE {name}")


def test_missing_input_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        run_features(str(tmp_path / "none"), str(tmp_path / "out"), spark)
    with pytest.raises(ValueError):
        writers.write_clean(readers.sample_events(spark), str(tmp_path / "x"), "merge")


def test_sample_events_have_features(spark):
    rows = {r.event_id: r for r in add_features(readers.sample_events(spark)).collect()}
    assert rows["demo-b"].severity_label == "critical"
    assert rows["demo-a"].severity_label == "low" and rows["demo-a"].hour_bin == "night"
    assert rows["demo-c"].zone_avg_speed == 51.0


def test_corpora_of_json_arrays(spark, tmp_path):
    cases = [{"id": str(i), "severity": "low", "text": f"t{i}", "road": "r"} for i in range(5)]
    (tmp_path / "cases.json").write_text(json.dumps(cases, indent=2))
    assert labelled(readers.read_incidents(spark, str(tmp_path / "cases.json"), multi_line=True)).count() == 5
    (tmp_path / "p.json").write_text(json.dumps([{"policy_id": "b", "text": "first"}, {"policy_id": "a", "text": "second"}], indent=2))
    docs = readers.read_corpus(spark, str(tmp_path / "p.json"), fixed.POLICY_SCHEMA, multi_line=True)
    assert [r.text for r in docs.orderBy("doc_ord").collect()] == ["first", "second"]


def test_score_and_decide_between_folders(spark, sf_dir, tmp_path):
    from kerbline.functions import cells
    from kerbline.operators import ml
    from pyspark.sql import functions as F

    records = views.sensor_scores(spark, sf_dir)
    feats, model = str(tmp_path / "feats"), str(tmp_path / "model")
    writers.write_features(records, feats)
    corpus = records.select(cells.scoring_text().alias("text"), F.col("severity_label").alias("severity"))
    ml.fit_text_classifier(corpus).write().save(model)
    (tmp_path / "p.json").write_text(json.dumps([{"text": "low congestion is fine"}]))
    decided = run_decisions(
        spark, feats, model, str(tmp_path / "p.json"), str(tmp_path / "none.json"),
        str(tmp_path / "scored"), str(tmp_path / "decided"), limit=20, multi_line=True,
    )
    first = [r.event_id for r in records.orderBy("event_id").limit(20).collect()]
    assert sorted(r.event_id for r in decided.collect()) == first
    scored = spark.read.json(str(tmp_path / "scored"))
    assert scored.where("predicted_severity is null").count() == 0


def test_shared_folder_follows_the_session(spark):
    folder = shared_dir(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert folder == configured
    assert scratch_path(spark, "x").startswith(folder.rstrip("/") + "/kerbline/x-")


def test_the_whole_way_between_folders(spark, sf_dir, tmp_path):
    from kerbline.functions import cells
    from kerbline.plans.jobs import run_all
    from pyspark.sql import functions as F

    raw = views.sensor_raw(spark, sf_dir)
    writers.write_json(raw, str(tmp_path / "raw"))
    texts = views.sensor_scores(spark, sf_dir).select(
        F.col("event_id").alias("id"), cells.scoring_text().alias("text"), F.col("severity_label").alias("severity")
    )
    writers.write_json(texts, str(tmp_path / "corpus"))
    writers.write_json(spark.createDataFrame([("1", "low congestion car clear")], "policy_id string, text string"), str(tmp_path / "policies"))
    done = run_all(
        spark, str(tmp_path / "raw"), str(tmp_path / "corpus"), str(tmp_path / "policies"), str(tmp_path / "none"), str(tmp_path / "out")
    )
    clean = views.sensor_clean(spark, sf_dir).count()
    assert done["etl"]["total_raw"] == raw.count() and done["etl"]["total_clean"] == clean
    assert {(r.classifier, r.condition) for r in done["metrics"].collect()} == {
        ("logreg", "clean"), ("svm", "clean"), ("logreg", "null_20pct"), ("logreg", "noisy_labels_10pct")
    }
    assert done["decisions"].count() == done["summary"].count() == clean
    assert readers.load_model(str(tmp_path / "out" / "model")).stages
