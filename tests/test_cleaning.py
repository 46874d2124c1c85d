from pyspark.sql import functions as F

from kerbline import fixed
from kerbline.operators import cleaning
from kerbline.plans.etl import run_etl
from kerbline.sources.readers import read_events

SCHEMA = fixed.SENSOR_SCHEMA
BASE = {
    "event_id": "a",
    "timestamp": "2024-01-15T08:30:00",
    "intersection_id": "X",
    "zone": "north",
    "speed_kmh": 50.0,
    "congestion": "low",
    "vehicle_type": "car",
    "vehicle_count": 5,
    "weather": "clear",
    "signal_phase": "green",
    "incident_flag": False,
    "record_type": "normal",
}


def events(spark, *changes):
    rows = [tuple({**BASE, **change}[f.name] for f in SCHEMA) for change in changes]
    return spark.createDataFrame(rows, SCHEMA)


def ids(df):
    return sorted((r[0] for r in df.select("event_id").collect()), key=str)


def test_only_fully_keyless_rows_go(spark):
    no_keys = {"event_id": None, "timestamp": None, "intersection_id": None}
    df = events(spark, {}, no_keys, {**no_keys, "intersection_id": "Y"})
    assert cleaning.drop_keyless(df).count() == 2


def test_defaults_fill_null_and_nan(spark):
    empty = {name: None for name in fixed.FIELD_DEFAULTS}
    df = events(spark, empty, {"speed_kmh": float("nan")})
    first, second = cleaning.fill_defaults(df).collect()
    assert {name: first[name] for name in fixed.FIELD_DEFAULTS} == fixed.FIELD_DEFAULTS
    assert second["speed_kmh"] == 30.0


def test_text_that_is_no_number_gets_the_default(spark):
    df = spark.createDataFrame([("1", "FAST", "many"), ("2", "12.5", "7"), ("3", None, None)], "event_id string, speed_kmh string, vehicle_count string")
    got = [(r.speed_kmh, r.vehicle_count) for r in cleaning.cast_or_default(df).orderBy("event_id").collect()]
    assert got == [(30.0, 1), (12.5, 7), (30.0, 1)]


def test_ranges_are_inclusive(spark):
    df = events(
        spark,
        {"event_id": "0", "speed_kmh": 0.0},
        {"event_id": "200", "speed_kmh": 200.0},
        {"event_id": "201", "speed_kmh": 200.5},
        {"event_id": "-1", "speed_kmh": -0.5},
        {"event_id": "c500", "vehicle_count": 500},
        {"event_id": "c501", "vehicle_count": 501},
        {"event_id": "c-1", "vehicle_count": -1},
    )
    assert ids(cleaning.filter_ranges(df)) == ["0", "200", "c500"]


def test_domains(spark):
    df = events(
        spark,
        {"event_id": "ok"},
        {"event_id": "c", "congestion": "gridlock"},
        {"event_id": "v", "vehicle_type": "tram"},
        {"event_id": "w", "weather": "snow"},
    )
    assert ids(cleaning.filter_domains(df)) == ["ok"]


def test_unreadable_time_is_null_not_an_error(spark):
    df = cleaning.with_event_time(events(spark, {"timestamp": "soon"}, {}))
    rows = df.select("event_ts", "date", "hour").collect()
    assert tuple(rows[0]) == (None, None, None)
    assert rows[1].hour == 8


def test_earliest_duplicate_stays_and_unreadable_times_come_last(spark):
    df = events(
        spark,
        {"timestamp": "soon", "zone": "east"},
        {"timestamp": "2024-01-15T09:00:00", "zone": "west"},
        {"timestamp": "2024-01-15T08:00:00", "zone": "south"},
    )
    assert [r.zone for r in cleaning.dedup_by_event(df).collect()] == ["south"]


def test_null_ids_count_as_one_id(spark):
    df = events(spark, {"event_id": None, "zone": "east"}, {"event_id": None, "zone": "west"}, {})
    assert cleaning.clean(df).count() == 2


def test_id_goes_when_its_survivor_breaks_a_domain(spark):
    df = events(
        spark,
        {"timestamp": "2024-01-15T08:00:00", "weather": "snow"},
        {"timestamp": "2024-01-15T09:00:00", "weather": "clear"},
    )
    assert cleaning.clean(df).count() == 0


def test_event_time_replaces_arrival_partition(spark):
    df = events(spark, {}).withColumn("date", F.lit("1999-01-01").cast("date")).withColumn("hour", F.lit(23))
    row = cleaning.clean(df).first()
    assert (str(row.date), row.hour) == ("2024-01-15", 8)


def test_cleaning_its_own_output_changes_nothing(spark):
    df = events(spark, {}, {"event_id": "b", "speed_kmh": None}, {"event_id": "c", "weather": "snow"}, {})
    once = cleaning.clean(df)
    raw_again = once.withColumn("timestamp", F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss"))
    twice = cleaning.clean(raw_again.drop("event_ts"))
    columns = sorted(once.columns)
    assert sorted(map(tuple, once.select(columns).collect())) == sorted(map(tuple, twice.select(columns).collect()))


def test_quality_counts_agree_with_the_chain(spark):
    none = dict.fromkeys(BASE)
    df = events(spark, {}, {}, none, {"event_id": "b", "speed_kmh": 999.0}, {"event_id": "c", "weather": "snow"}, {"event_id": None})
    stats = cleaning.quality_stats(df).first()
    assert (stats.total_raw, stats.total_clean) == (6, cleaning.clean(df).count())
    assert stats.dropped == stats.total_raw - stats.total_clean
    empty = cleaning.quality_stats(df.limit(0)).first()
    assert (empty.total_raw, empty.total_clean, empty.drop_rate_pct) == (0, 0, 0.0)


def test_json_lines_repair_and_job_counts(spark, tmp_path):
    folder = tmp_path / "raw" / "date=2030-01-01" / "hour=05" / "batch=q-0"
    folder.mkdir(parents=True)
    lines = [
        '{"event_id":"1","timestamp":"2024-01-15T08:30:00","intersection_id":"X","zone":"north","speed_kmh":"FAST","vehicle_count":"many"}',
        "{ broken json ::::17",
        '{"event_id":"2","timestamp":"2024-01-15T23:10:00","intersection_id":"X","zone":"east","speed_kmh":999.9}',
        '{"event_id":"3","timestamp":"2024-01-16T00:10:00","intersection_id":"X","zone":"east","speed_kmh":20}',
    ]
    (folder / "part.json").write_text("\n".join(lines))
    raw = read_events(spark, str(tmp_path / "raw"))
    assert raw.where("event_id = '1'").first().speed_kmh is None
    out = str(tmp_path / "clean")
    stats = run_etl(str(tmp_path / "raw"), out, spark)
    assert (stats["total_raw"], stats["total_clean"], stats["dropped"]) == (4, 2, 2)
    assert spark.read.parquet(out).where("event_id = '1'").first().speed_kmh == 30.0
    run_etl(str(tmp_path / "raw"), out, spark)
    assert spark.read.parquet(out).count() == 4
    run_etl(str(tmp_path / "raw"), out, spark, mode="replace")
    assert spark.read.parquet(out).count() == 2


def test_rule_counts_add_up(spark):
    raw = spark.createDataFrame(
        [
            ("a", "2024-01-15T08:00:00", "X", 10.0, "low"), ("a", "2024-01-15T09:00:00", "X", 10.0, "low"), ("b", None, None, 500.0, "low"),
            ("c", None, "X", 10.0, "gridlock"), (None, None, None, 10.0, "low"), (None, None, None, 900.0, "low"), ("a", None, "X", -1.0, "low"),
        ],
        "event_id string, timestamp string, intersection_id string, speed_kmh float, congestion string",
    )
    full = raw.selectExpr("*", "'north' AS zone", "'car' AS vehicle_type", "3 AS vehicle_count", "'clear' AS weather")
    got = {r["rule"]: r["rows"] for r in cleaning.rule_counts(full).collect()}
    assert got == {"raw": 7, "keyless": 2, "out_of_range": 2, "duplicate": 1, "out_of_domain": 1, "clean": 1}
    assert cleaning.clean(full).count() == got["clean"]
    assert {r["rows"] for r in cleaning.rule_counts(full.limit(0)).collect()} == {0}


def test_unreadable_lines_and_values_are_rescued(spark, tmp_path):
    from kerbline.sources.readers import read_events, read_events_rescued

    lines = [
        '{"event_id": "1", "speed_kmh": 3.5, "zone": "north"}', '{"event_id": "2", "speed_kmh": "FAST", "vehicle_count": 3.5, "zone": "x"}',
        '{"event_id": "3", "spee', "no json", "", '{"event_id": "4", "speed_kmh": null}',
    ]
    (tmp_path / "in.json").write_text("\n".join(lines))
    rows = read_events_rescued(spark, str(tmp_path)).collect()
    assert len(rows) == 5 == read_events(spark, str(tmp_path)).count()
    found = {r.rescued: r for r in rows if r.rescued is not None}
    assert found[lines[1]].rescued_fields == ["speed_kmh", "vehicle_count"] and found[lines[1]].zone == "x"
    assert found[lines[3]].rescued_fields == [] and set(found) == {lines[1], lines[2], lines[3]}
