import json
import time
from pathlib import Path

from pyspark.sql import functions as F

from kerbline.operators import validation
from kerbline.plans import sensor_views as views
from kerbline.sources import readers
from kerbline.streaming import ingest as ingest_module
from kerbline.streaming.dedup import dedup_stream, untimed_events
from kerbline.streaming.ingest import RunningCounts, ingest, progress_counts


def drain(spark, root, **kwargs):
    stream = readers.read_text_stream(spark, f"{root}/in", **kwargs)
    query = ingest(stream, f"{root}/good", f"{root}/bad", f"{root}/check", {"availableNow": True})
    query.awaitTermination()
    return query


def outputs(spark, root):
    good = sorted(r.value for r in spark.read.text(f"{root}/good").select("value").collect())
    bad = [json.loads(line) for f in Path(f"{root}/bad").rglob("*.json") for line in f.read_text().splitlines()]
    return good, bad


def test_stream_equals_batch_and_restart_adds_nothing(spark, sf_dir, tmp_path):
    texts = views.sensor_json(spark, sf_dir)
    texts.select("value").repartition(3).write.text(f"{tmp_path}/in")
    checked = validation.validate(texts)
    query = drain(spark, tmp_path)
    good, bad = outputs(spark, tmp_path)
    assert good == sorted(r.value for r in validation.valid_records(checked).collect())
    reasons = {r.reason: r.records for r in validation.reason_counts(checked).collect()}
    del reasons["ok"]
    assert {k: sum(b["reason"] == k for b in bad) for k in reasons} == reasons
    assert len(bad) == sum(reasons.values())
    assert set(bad[0]) == {"reason", "raw", "timestamp"}
    counts = progress_counts(query)
    assert counts["valid"] == len(good)
    assert counts["invalid"] + counts["parse_error"] == len(bad)
    drain(spark, tmp_path)
    assert outputs(spark, tmp_path) == (good, bad)
    assert readers.read_events(spark, f"{tmp_path}/good").select("event_id", "date", "hour").count() == len(good)


def test_a_batch_run_again_replaces_its_own_output(spark, tmp_path):
    """Lose the commit of the last batch, as a crash after the write would, and add new input."""
    folder = tmp_path / "in"
    folder.mkdir()
    good = {f: "x" for f in ("event_id", "timestamp", "intersection_id", "zone", "vehicle_type", "weather")}
    good |= {"congestion": "low", "speed_kmh": 1.5, "vehicle_count": 1}
    (folder / "a.txt").write_text("\n".join([json.dumps({**good, "event_id": str(i)}) for i in range(10)] + ["broken"]))
    drain(spark, tmp_path)
    (folder / "b.txt").write_text(json.dumps({**good, "event_id": "late"}))
    drain(spark, tmp_path)
    commits = tmp_path / "check" / "commits"
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (commits / name).unlink(missing_ok=True)
    drain(spark, tmp_path)
    ids = sorted(json.loads(line)["event_id"] for line in outputs(spark, tmp_path)[0])
    assert ids == sorted([*map(str, range(10)), "late"])
    assert len(outputs(spark, tmp_path)[1]) == 1


def test_dedup_keeps_one_row_of_a_hot_id_across_batches(spark, tmp_path):
    key = F.when(F.col("id") % 3 == 0, "HOT").otherwise((F.col("id") % 100).cast("string"))
    rows = spark.range(3000).select(key.alias("event_id"), F.lit("2024-01-15 08:00:00").cast("timestamp").alias("event_ts"))
    unreadable = spark.createDataFrame([("none", None)], rows.schema)
    rows.unionByName(unreadable).repartition(6).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    query = (
        dedup_stream(stream)
        .writeStream.format("parquet")
        .option("path", f"{tmp_path}/out")
        .option("checkpointLocation", f"{tmp_path}/check")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    got = sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect())
    expected = {"HOT" if i % 3 == 0 else str(i % 100) for i in range(3000)}
    assert got == sorted(expected)
    assert [r.event_id for r in untimed_events(spark.read.parquet(f"{tmp_path}/in")).collect()] == ["none"]


def test_running_counts_add_up_over_batches(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for n in range(3):
        (folder / f"{n}.txt").write_text('broken\n{"event_id": 1}\n')
    totals = RunningCounts()
    spark.streams.addListener(totals)
    try:
        drain(spark, tmp_path, max_files=1)
        waited = 0
        while sum(totals.totals.values()) < 6 and waited < 100:
            time.sleep(0.1)
            waited += 1
    finally:
        spark.streams.removeListener(totals)
    assert totals.totals == {"valid": 0, "invalid": 3, "parse_error": 3}


def test_topic_options():
    options = readers.kafka_options("host:1", "t", group=None, min_records=7, max_delay="5s")
    assert options == {
        "kafka.bootstrap.servers": "host:1",
        "subscribe": "t",
        "startingOffsets": "earliest",
        "minOffsetsPerTrigger": "7",
        "maxTriggerDelay": "5s",
        "maxOffsetsPerTrigger": "1000000",
    }
    assert readers.kafka_options()["kafka.group.id"] == "traffic-consumer-group"
    assert ingest_module.METRICS == "ingest"


def test_dedup_into_accounts_for_late_and_untimed_rows(spark, tmp_path):
    from kerbline.streaming.dedup import dedup_into

    schema = "event_id string, event_ts timestamp, place string"

    def land(n, rows):
        texts = [(i, ts, p) for i, ts, p in rows]
        frame = spark.createDataFrame(texts, "event_id string, ts string, place string")
        frame.select("event_id", F.col("ts").cast("timestamp").alias("event_ts"), "place").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{n}")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        dedup_into(stream, f"{tmp_path}/out", f"{tmp_path}/check", trigger={"availableNow": True}).awaitTermination()
        return sorted(((r.event_id or "null"), str(r.event_ts), r.place) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    land(0, [("a", "2024-01-15 12:00:00", "x"), ("a", "2024-01-15 11:00:00", "y"), ("b", "2024-01-15 18:00:00", "x")])
    land(1, [("late", "2024-01-15 01:00:00", "x"), ("c", "2024-01-15 18:01:00", "x"), ("untimed", None, "x"), ("a", None, "z"), (None, None, "n")])
    first = run()
    land(2, [("late", "2024-01-15 02:00:00", "w"), ("untimed", "2024-01-15 02:00:00", "w"), (None, "2024-01-15 02:00:00", "w"), ("d", "2020-01-01 00:00:00", "w")])
    rows = run()
    assert [r[0] for r in first] == ["a", "b", "c", "late", "null", "untimed"]
    assert [r[0] for r in rows] == ["a", "b", "c", "d", "late", "null", "untimed"]
    assert ("a", "2024-01-15 11:00:00", "y") in rows and ("late", "2024-01-15 01:00:00", "x") in rows


def test_stream_job_routes_and_keeps_one_row_per_id(spark, sf_dir, tmp_path):
    from kerbline.operators import validation
    from kerbline.plans import sensor_views as views
    from kerbline.plans.stream import run_stream

    texts = views.sensor_json(spark, sf_dir)
    texts.select("value").repartition(3).write.text(f"{tmp_path}/in")
    stream = readers.read_text_stream(spark, f"{tmp_path}/in", max_files=1)
    for query in run_stream(stream, f"{tmp_path}/out", {"availableNow": True}):
        query.awaitTermination()
    checked = validation.validate(texts)
    good = checked.where("reason = 'ok'")
    assert spark.read.json(f"{tmp_path}/out/quarantine").count() == checked.count() - good.count()
    events = [r.event_id for r in spark.read.parquet(f"{tmp_path}/out/events").select("event_id").collect()]
    assert sorted(events) == sorted(r.event_id for r in good.select("event_id").distinct().collect())
