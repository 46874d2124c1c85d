import json

import pytest

from kerbline import fixed
from kerbline.operators import validation

GOOD = {
    "event_id": "1",
    "timestamp": "2024-01-15T08:30:00",
    "intersection_id": "X",
    "zone": "north",
    "speed_kmh": 50.5,
    "congestion": "low",
    "vehicle_type": "car",
    "vehicle_count": 5,
    "weather": "clear",
}


def without(*names):
    return {k: v for k, v in GOOD.items() if k not in names}


CASES = [
    (json.dumps(GOOD), "ok"),
    (json.dumps({**GOOD, "extra": {"a": [1]}}), "ok"),
    ("\n " + json.dumps(GOOD, indent=1), "ok"),
    (json.dumps({**GOOD, "weather": "snow", "vehicle_type": "tram"}), "ok"),
    ("{ broken json ::::17", "json_parse_error"),
    ("", "json_parse_error"),
    (None, "json_parse_error"),
    ("[1, 2]", "not_a_dict"),
    ('"text"', "not_a_dict"),
    ("17", "not_a_dict"),
    ("null", "not_a_dict"),
    ("{}", "missing_field:event_id"),
    (json.dumps({**GOOD, "speed_kmh": 0}), "ok"),
    (json.dumps({**GOOD, "speed_kmh": 200}), "ok"),
    (json.dumps({**GOOD, "speed_kmh": True}), "ok"),
    (json.dumps({**GOOD, "vehicle_count": True}), "ok"),
    (json.dumps({**GOOD, "speed_kmh": 200.01}), "speed_out_of_range"),
    (json.dumps({**GOOD, "speed_kmh": -0.1}), "speed_out_of_range"),
    (json.dumps(GOOD).replace("50.5", "1e400"), "speed_out_of_range"),
    (json.dumps({**GOOD, "vehicle_count": 500}), "ok"),
    (json.dumps({**GOOD, "vehicle_count": 501}), "count_out_of_range"),
    (json.dumps({**GOOD, "vehicle_count": -1}), "count_out_of_range"),
    (json.dumps({**GOOD, "vehicle_count": 10**19}), "count_out_of_range"),
    (json.dumps({**GOOD, "vehicle_count": 10**49}), "count_out_of_range"),
    (json.dumps({**GOOD, "vehicle_count": 3.0}), "wrong_type:vehicle_count"),
    (json.dumps(GOOD).replace(": 5,", ": 3e0,"), "wrong_type:vehicle_count"),
    (json.dumps({**GOOD, "vehicle_count": "5"}), "wrong_type:vehicle_count"),
    (json.dumps({**GOOD, "speed_kmh": "FAST", "vehicle_count": "many"}), "wrong_type:speed_kmh"),
    (json.dumps({**GOOD, "zone": 7}), "wrong_type:zone"),
    (json.dumps({**GOOD, "zone": {"a": 1}}), "wrong_type:zone"),
    (json.dumps({**GOOD, "congestion": "gridlock"}), "invalid_congestion_value"),
    (json.dumps({**GOOD, "congestion": "gridlock", "vehicle_count": 501, "speed_kmh": 999}), "speed_out_of_range"),
    (json.dumps(GOOD)[:-1] + ', "speed_kmh": 999}', "speed_out_of_range"),
    (json.dumps({**GOOD, "event_id": None, "zone": 7}), "null_field:event_id"),
    (json.dumps({**without("zone"), "event_id": None}), "null_field:event_id"),
    *[(json.dumps(without(f)), f"missing_field:{f}") for f in fixed.REQUIRED_FIELDS],
    *[(json.dumps({**GOOD, f: None}), f"null_field:{f}") for f in fixed.REQUIRED_FIELDS],
]


@pytest.fixture(scope="module")
def checked(spark):
    rows = [(i, text) for i, (text, _) in enumerate(CASES)]
    return validation.validate(spark.createDataFrame(rows, "n int, value string"))


def test_reasons(checked):
    got = {r.n: r.reason for r in checked.collect()}
    assert {n: (CASES[n][0], r) for n, r in got.items()} == dict(enumerate(CASES))


def test_good_and_bad_are_all_rows_once(checked):
    good, bad = validation.valid_records(checked), validation.quarantine_records(checked)
    assert sorted(r.n for r in good.collect()) == [n for n, (_, reason) in enumerate(CASES) if reason == "ok"]
    assert sorted(r.n for r in bad.select("n").collect()) == [n for n, (_, reason) in enumerate(CASES) if reason != "ok"]


def test_good_records_are_single_lines_of_the_same_json(checked):
    for row in validation.valid_records(checked).collect():
        assert "\n" not in row.value
        assert json.loads(row.value) == json.loads(CASES[row.n][0])


def test_quarantine_keeps_objects_as_objects(checked, tmp_path):
    bad = validation.quarantine_records(checked).where("n in (4, 7, 11, 30)").select("n", "raw")
    bad.coalesce(1).write.json(str(tmp_path / "bad"))
    lines = [json.loads(line) for f in (tmp_path / "bad").glob("*.json") for line in f.read_text().splitlines()]
    raw = {line["n"]: line["raw"] for line in lines}
    assert raw[4] == "{ broken json ::::17"
    assert raw[7] == "[1, 2]"
    assert raw[11] == {}
    assert raw[30]["congestion"] == "gridlock"


def test_status_counts(checked):
    counts = {r.status: r.records for r in validation.status_counts(checked).collect()}
    reasons = [reason for _, reason in CASES]
    assert counts["valid"] == reasons.count("ok")
    assert counts["parse_error"] == reasons.count("json_parse_error")
    assert sum(counts.values()) == len(CASES)
