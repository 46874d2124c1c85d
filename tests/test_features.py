import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbline.functions import cells
from kerbline.operators import features, reports
from kerbline.plans import sensor_views as views

# --- fixed values: scored records whose results are known ---
# congestion, weather, vehicle, speed, congestion score, risk, label, emergency, bad weather
KNOWN = [
    ("medium", "dusty", "bus", 75.1, 50, 52.5, "high", 0, 1),
    ("medium", "dusty", "police", 34.5, 50, 64.7, "high", 1, 1),
    ("high", "rainy", "truck", 78.3, 75, 64.0, "high", 0, 1),
    ("high", "hot", "motorcycle", 52.9, 75, 51.6, "high", 0, 0),
    ("high", "dusty", "bus", 48.0, 75, 73.1, "high", 0, 1),
    ("low", "rainy", "motorcycle", 32.0, 25, 52.9, "high", 0, 1),
    ("high", "rainy", "bus", 53.7, 75, 71.4, "high", 0, 1),
    ("low", "dusty", "bus", 25.4, 25, 54.9, "high", 0, 1),
    ("critical", "clear", "police", 92.3, 100, 52.3, "high", 1, 0),
    ("low", "rainy", "bus", 14.0, 25, 58.3, "high", 0, 1),
]


def test_known_records(spark):
    rows = [(str(i), *row[:4], 11) for i, row in enumerate(KNOWN)]
    df = spark.createDataFrame(rows, "event_id string, congestion string, weather string, vehicle_type string, speed_kmh float, hour int")
    got = features.add_scores(df).orderBy("event_id").collect()
    for row, known in zip(got, KNOWN, strict=True):
        assert (row.congestion_score, row.risk_score, row.severity_label, row.is_emergency, row.is_bad_weather) == known[4:]
        assert row.hour_bin == "off_peak"


def test_hour_bins_cover_the_day(spark):
    bins = {r.h: r.b for r in spark.range(24).select(F.col("id").alias("h"), cells.hour_bin(F.col("id")).alias("b")).collect()}
    for hours, name in [((6, 7, 8, 9), "morning_rush"), ((12, 13, 14), "lunch_rush"), ((16, 17, 18, 19), "evening_rush"),
                        ((22, 23, 0, 1, 2, 3, 4, 5), "night"), ((10, 11, 15, 20, 21), "off_peak")]:
        assert {bins[h] for h in hours} == {name}
    assert spark.range(1).select(cells.hour_bin(F.lit(None).cast("int"))).first()[0] == "off_peak"


@pytest.mark.parametrize("risk, label, index", [(-17.5, "low", 0), (24.9, "low", 0), (25.0, "medium", 1), (49.9, "medium", 1), (50.0, "high", 2), (75.0, "critical", 3), (None, "critical", 3)])
def test_severity_limits(spark, risk, label, index):
    named = cells.severity_label(F.lit(risk).cast("double"))
    assert tuple(spark.range(1).select(named, cells.severity_index(named)).first()) == (label, index)


def test_risk_is_not_clamped(spark):
    low = cells.risk_score(F.lit(25), F.lit(2.0), F.lit(0))
    high = cells.risk_score(F.lit(100), F.lit(0.0), F.lit(1))
    assert tuple(spark.range(1).select(low, high).first()) == (-17.5, 100.0)


def test_zone_averages_equal_the_window(spark, sf_dir):
    scored = views.sensor_scores(spark, sf_dir).withColumn("zone", F.when(F.col("zone") != "west", F.col("zone")))
    zone = Window.partitionBy("zone")
    expected = scored.select(
        "event_id",
        F.round(F.avg("congestion_score").over(zone), 1).alias("c"),
        F.round(F.avg("speed_kmh").over(zone), 1).alias("s"),
    )
    got = features.add_zone_averages(scored).select("event_id", "zone_avg_congestion", "zone_avg_speed")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    assert got.where("zone_avg_speed IS NULL").count() == 0


def test_scoring_text_skips_nulls(spark):
    df = spark.createDataFrame([("X", "low", "car", None, "night", 1)], "intersection_id string, congestion string, vehicle_type string, weather string, hour_bin string, is_emergency int")
    assert df.select(cells.scoring_text()).first()[0] == "X low car night emergency vehicle"


def test_top_risk_ties_go_by_name(spark):
    df = spark.createDataFrame([("b", 10.0), ("a", 10.0), ("c", 5.0)], "intersection_id string, risk_score double")
    assert [r[0] for r in reports.top_risk_intersections(df, 2).collect()] == ["a", "b"]


def test_severity_index_grows_with_risk(spark):
    risks = spark.range(-20, 101).select(F.col("id").cast("double").alias("r"))
    rows = risks.select("r", cells.severity_index(cells.severity_label(F.col("r"))).alias("i")).orderBy("r").collect()
    assert all(a.i <= b.i for a, b in zip(rows, rows[1:], strict=False))
