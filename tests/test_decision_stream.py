"""Raw events as a stream to decisions: the rows of the batch job, exactly once, whatever happens on the way."""

import json

import pytest
from pyspark.sql import functions as F

from kerbline import fixed
from kerbline.operators import cleaning, decisions
from kerbline.operators.features import add_scores
from kerbline.plans import sensor_views as views
from kerbline.plans import stream as jobs
from kerbline.sources import writers
from kerbline.streaming import dedup


@pytest.fixture(scope="module")
def tables(spark):
    sf_dir = "/root/testdata/sf0.001"
    return decisions.lookups(
        decisions.all_profiles(spark),
        views.sensor_edges(spark, sf_dir),
        views.sensor_targets(spark, sf_dir),
        views.policy_docs(spark, sf_dir),
        views.protocol_docs(spark, sf_dir),
        "H0",
    )


def start(spark, root, tables):
    texts = jobs.raw_stream(spark, f"{root}/raw", max_files=1)
    return jobs.run_decision_stream(texts, tables, f"{root}/out", f"{root}/check", trigger={"availableNow": True})


def land(spark, root, sf_dir, parts):
    writers.write_json(views.sensor_raw(spark, sf_dir).repartition(parts, "event_id"), f"{root}/raw", mode="append")


def decided(spark, root, schema):
    rows = spark.read.schema(schema).json(f"{root}/out").drop("batch")
    return sorted(r.j for r in rows.select(F.to_json(F.struct("*")).alias("j")).collect())


def expected(spark, sf_dir, tables):
    rows = decisions.decide_by(views.sensor_scores(spark, sf_dir), tables)
    return rows.schema, sorted(r.j for r in rows.select(F.to_json(F.struct("*")).alias("j")).collect())


def test_stream_equals_batch_over_a_failure_and_a_lost_commit(spark, sf_dir, tmp_path, tables, monkeypatch):
    land(spark, tmp_path, sf_dir, 4)
    schema, rows = expected(spark, sf_dir, tables)
    write, calls = dedup.write_batch, []

    def failing(batch, path, tag, file_format="parquet"):
        write(batch, path, tag, file_format)
        calls.append(tag)
        if len(calls) == 2:
            raise RuntimeError("lost after the write")

    monkeypatch.setattr(jobs, "write_batch", failing)
    with pytest.raises(Exception, match="lost after the write"):
        start(spark, tmp_path, tables).awaitTermination()
    start(spark, tmp_path, tables).awaitTermination()
    assert calls[1] == calls[2]
    assert decided(spark, tmp_path, schema) == rows
    # A commit that got lost: the last batch runs again and replaces its folder.
    commits = tmp_path / "check" / "commits"
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (commits / name).unlink(missing_ok=True)
    start(spark, tmp_path, tables).awaitTermination()
    assert decided(spark, tmp_path, schema) == rows
    # The same events once more add nothing.
    land(spark, tmp_path, sf_dir, 2)
    start(spark, tmp_path, tables).awaitTermination()
    assert decided(spark, tmp_path, schema) == rows


def test_profiles_cover_all_clean_values(spark, sf_dir, tables):
    assert tables.contexts.count() == 4 * 6 * 5 * 2 * 4
    found = decisions.decide_by(views.sensor_scores(spark, sf_dir), tables)
    assert not found.where("va.message is null or tla.policy_context is null or ida.protocol is null").count()


def test_model_on_the_stream(spark, sf_dir, tmp_path, tables):
    """A saved model scores the micro-batches; its label decides."""

    class Fixed:
        """Predicts the class of index 1 for all rows."""

        stages = []

        def transform(self, rows):
            return rows.withColumn("prediction", F.lit(1.0))

    def named(predictions, model):
        return predictions.withColumn("predicted_severity", F.lit("high"))

    from kerbline.operators import ml

    patched, ml.with_predicted_severity = ml.with_predicted_severity, named
    try:
        land(spark, tmp_path, sf_dir, 2)
        texts = jobs.raw_stream(spark, f"{tmp_path}/raw")
        jobs.run_decision_stream(
            texts, tables, f"{tmp_path}/out", f"{tmp_path}/check", Fixed(), "predicted_severity", {"availableNow": True}
        ).awaitTermination()
    finally:
        ml.with_predicted_severity = patched
    labels = {json.loads(line)["ida"]["spark_predicted_sev"] for f in (tmp_path / "out").rglob("*.json") for line in f.read_text().splitlines()}
    assert labels == {"high"}


def test_a_batch_reads_no_more_as_history_grows(spark, tmp_path):
    """Twenty batches of equal size: the state is written by change, and no batch reads earlier output."""
    schema = "event_id string, event_ts timestamp, place string"
    for n in range(20):
        rows = spark.range(50).select(
            F.concat(F.lit(f"{n}-"), "id").alias("event_id"), F.lit("2024-01-15 08:00:00").cast("timestamp").alias("event_ts"), F.lit("x").alias("place")
        )
        rows.union(rows.limit(5)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    plans = []
    write = dedup.write_batch

    def watched(rows, path, tag, file_format="parquet"):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        write(rows, path, tag, file_format)

    dedup.write_batch = watched
    try:
        query = dedup.dedup_into(stream, f"{tmp_path}/out", f"{tmp_path}/check", trigger={"availableNow": True})
        query.awaitTermination()
    finally:
        dedup.write_batch = write
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    assert spark.read.parquet(f"{tmp_path}/out").select("event_id").distinct().count() == 20 * 50
    assert len(plans) >= 20 and not any(f"{tmp_path}/out" in text for text in plans)
    state = [p.stateOperators[0] for p in query.recentProgress if p.numInputRows]
    assert state[-1].numRowsTotal == 1000 and max(s.numRowsUpdated for s in state) <= 55


def test_session_keeps_its_state_settings(spark):
    with dedup.keyed_state(spark):
        assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("RocksDBStateStoreProvider")
    assert not spark.conf.get("spark.sql.streaming.stateStore.providerClass", "none").endswith("RocksDBStateStoreProvider")


def test_cleaning_steps_of_the_stream_are_those_of_the_batch(spark, sf_dir):
    raw = views.sensor_raw(spark, sf_dir)
    assert add_scores(cleaning.clean(raw)).columns == views.sensor_scores(spark, sf_dir).columns
    assert fixed.VEHICLE_AGENT == "VehicleAgent"
