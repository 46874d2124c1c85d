import json

import pytest
from pyspark.sql import functions as F

from kerbline import fixed
from kerbline.operators import decisions
from kerbline.sources import readers, writers

# --- fixed values: records whose decisions are known ---
# id, intersection, zone, congestion, risk, vehicle, emergency, weather, speed, hour bin, label
RECORDS = [
    ("1", "Al_Waziriyah_x_Sitteen", "south", "medium", 52.5, "bus", 0, "dusty", 75.0999984741211, "off_peak", "high"),
    ("2", "Al_Waziriyah_x_Sitteen", "south", "medium", 64.7, "police", 1, "dusty", 34.5, "off_peak", "high"),
    ("3", "Prince_Sultan_x_Sari", "south", "high", 64.0, "truck", 0, "rainy", 78.30000305175781, "off_peak", "high"),
    ("4", "King_Road_x_Palestine", "north", "critical", 99.9, "ambulance", 1, "foggy", 12.25, "night", "critical"),
    ("5", "King_Road_x_Palestine", "north", "critical", 80.0, "car", 0, "clear", 12.75, "night", "critical"),
    ("6", "nowhere", "east", "low", 10.0, "car", 0, "clear", 100.0, "night", "low"),
    ("7", "nowhere", "east", "high", 40.0, "police", 1, "clear", 100.0, "night", "medium"),
    ("8", "nowhere", "east", "low", 40.0, "police", 1, "clear", 100.0, "night", "medium"),
]
SCHEMA = "event_id string, intersection_id string, zone string, congestion string, risk_score double, vehicle_type string, is_emergency int, weather string, speed_kmh float, hour_bin string, severity_label string"
POLICIES = [
    "Slow the bus lane while congestion lasts: rule A.",
    "Keep side streets shut during congestion: rule B.",
    "A severity of high calls for activate_reroute: rule C.",
]
PROTOCOLS = [
    "An ambulance may pass every queue on its left side.",
    "Crews with a ladder truck choose the wider street.",
    "With a police car behind, hold the side street until it has gone.",
]


def corpus(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_ord int, text string")


def decide(spark, **kwargs):
    return decisions.decide(
        spark.createDataFrame(RECORDS, SCHEMA),
        readers.road_edges(spark),
        readers.hospitals(spark),
        corpus(spark, POLICIES),
        corpus(spark, PROTOCOLS),
        **kwargs,
    )


@pytest.fixture(scope="module")
def decided(spark):
    return {r.event_id: r.asDict(recursive=True) for r in decide(spark).collect()}


def test_known_vehicle_results(decided):
    va = decided["1"]["va"]
    assert va["message"] == (
        "[VA] Intersection Al_Waziriyah_x_Sitteen (zone: south) — bus at 75.1 km/h. Congestion: medium. Weather: dusty. "
        "Period: off_peak. Risk score: 52.5. Policy context: Slow the bus lane while congestion lasts: rule A.; "
        "Keep side streets shut during congestion: rule B.."
    )
    assert (va["alerts"], va["risk"], va["neighbors"]) == ([], 52.5, [])
    assert decided["3"]["va"]["neighbors"] == ["Al_Hamra_x_Falastin"]
    assert decided["3"]["va"]["alerts"] == []
    assert decided["4"]["va"]["alerts"] == [
        f"[VA→{n}] High-risk spillover warning from King_Road_x_Palestine (risk=99.9)"
        for n in ("Haram_Road_x_Madinah", "King_Fahd_Hospital")
    ]


def test_speed_ties_go_to_the_even_digit(decided):
    assert "at 12.2 km/h" in decided["4"]["va"]["message"]
    assert "at 12.8 km/h" in decided["5"]["va"]["message"]


def test_known_incident_results(decided):
    assert decided["1"]["ida"] == {
        "agent": "IncidentDetectionAgent",
        "intersection_id": "Al_Waziriyah_x_Sitteen",
        "severity": "high",
        "spark_predicted_sev": "high",
        "risk_score": 52.5,
        "is_emergency": False,
        "recommended_action": "activate_reroute",
        "protocol": "Follow standard emergency protocol",
        "nearest_hospital": "Al_Noor_Hospital",
        "va_risk_confirmed": True,
    }
    assert decided["2"]["ida"]["protocol"] == PROTOCOLS[2]
    assert (decided["3"]["ida"]["protocol"], decided["3"]["ida"]["nearest_hospital"]) == (PROTOCOLS[1], "King_Fahd_Hospital")
    assert decided["6"]["ida"]["nearest_hospital"] is None
    assert decided["7"]["ida"]["severity"] == "critical"
    assert decided["7"]["ida"]["nearest_hospital"] == fixed.DEFAULT_HOSPITAL
    assert not decided["7"]["ida"]["va_risk_confirmed"]
    assert decided["8"]["ida"]["severity"] == "medium"


def test_signal_results(decided):
    timing = {i: tuple(d["tla"]["timing_sec"].values()) for i, d in decided.items()}
    assert timing == {
        "1": (20, 5, 45), "2": (20, 5, 45), "3": (20, 5, 45), "4": (60, 3, 0),
        "5": (0, 3, 60), "6": (30, 5, 25), "7": (60, 3, 0), "8": (25, 5, 30),
    }
    assert decided["1"]["tla"]["policy_context"] == POLICIES[2]
    assert decided["4"]["tla"]["decision"] == "EMERGENCY OVERRIDE: Full green phase for King_Road_x_Palestine. Clear all lanes."
    assert decided["5"]["tla"]["decision"] == "Normal monitoring at King_Road_x_Palestine. Standard timing maintained."
    assert decided["8"]["tla"]["decision"] == "Rebalancing signal timing at nowhere to ease medium congestion."


def test_without_documents_the_default_texts_stand(spark, tmp_path):
    none = readers.read_corpus(spark, str(tmp_path / "missing.json"), fixed.POLICY_SCHEMA)
    got = decisions.decide(
        spark.createDataFrame(RECORDS[:1], SCHEMA), readers.road_edges(spark), readers.hospitals(spark), none, none
    ).first()
    assert got.va.message.endswith(f"Policy context: {fixed.NO_POLICY_TEXT}.")
    assert (got.ida.protocol, got.tla.policy_context) == (fixed.NO_PROTOCOL_TEXT, fixed.NO_TIMING_TEXT)


def test_large_tables_decide_the_same(spark, decided, force_large):
    assert {r.event_id: r.asDict(recursive=True) for r in decide(spark).collect()} == decided


def test_another_label_column_can_lead(spark):
    records = spark.createDataFrame(RECORDS[:1], SCHEMA).withColumn("predicted_severity", F.lit("low"))
    got = decisions.decide(
        records, readers.road_edges(spark), readers.hospitals(spark), corpus(spark, POLICIES), corpus(spark, PROTOCOLS),
        label_col="predicted_severity",
    ).first()
    assert (got.ida.severity, got.ida.spark_predicted_sev) == ("low", "low")


def test_summary_and_nested_json(spark, tmp_path):
    result = decide(spark)
    row = {r.event_id: r for r in decisions.summarize(result).collect()}["1"]
    assert (row.severity, row.action, row.green, row.red) == ("high", "activate_reroute", 20, 45)
    assert row.decision == "Rerouting activated at Al_Waziriyah_x_Sitteen. Extended red to divert traffic."[:70]
    writers.write_json(result, str(tmp_path / "out"))
    lines = [json.loads(line) for f in (tmp_path / "out").glob("*.json") for line in f.read_text().splitlines()]
    assert len(lines) == len(RECORDS)
    assert set(lines[0]) == {"event_id", "part", "va", "ida", "tla"}
    assert {"event_id": "6", "nearest_hospital": None} in [
        {"event_id": line["event_id"], "nearest_hospital": line["ida"]["nearest_hospital"]} for line in lines
    ]
