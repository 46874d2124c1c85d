"""Reports from partial sums against reports over all records."""

import pytest
from pyspark.sql import functions as F

from kerbline.operators import reports
from kerbline.operators.features import add_scores
from kerbline.plans import rollup
from kerbline.plans import sensor_views as views
from kerbline.sources.writers import write_clean

SAME = [
    (rollup.severity_by_zone, reports.severity_by_zone),
    (rollup.risk_by_hour_bin, reports.risk_by_hour_bin),
    (rollup.emergency_incidents, reports.emergency_incidents),
    (rollup.top_risk_intersections, reports.top_risk_intersections),
]


def held_against_all_records(spark, root):
    merged, records = rollup.sums(spark, f"{root}/sums"), add_scores(spark.read.parquet(f"{root}/clean"))
    for mine, plain in SAME:
        assert [tuple(r) for r in mine(merged).collect()] == [tuple(r) for r in plain(records).collect()], mine.__name__
    shares = {r.severity_label: (r["count"], r.pct) for r in rollup.severity_share(merged).collect()}
    total = records.count()
    assert {k: n for k, (n, _) in shares.items()} == {r.severity_label: r["count"] for r in records.groupBy("severity_label").count().collect()}
    assert all(pct == pytest.approx(100 * n / total, abs=0.051) for n, pct in shares.values())
    zones = {r.zone: r for r in records.groupBy("zone").agg(F.avg("speed_kmh").alias("s"), F.avg("congestion_score").alias("c")).collect()}
    for r in rollup.zone_averages(merged).collect():
        assert (r.zone_avg_speed, r.zone_avg_congestion) == (pytest.approx(zones[r.zone].s, abs=0.051), pytest.approx(zones[r.zone].c, abs=0.051))


def test_only_changed_folders_are_read(spark, sf_dir, tmp_path):
    clean = views.sensor_clean(spark, sf_dir)
    days = sorted(str(r.date) for r in clean.select("date").distinct().collect())
    first, second = F.col("date") < days[len(days) // 2], F.col("date") >= days[len(days) // 2]
    write_clean(clean.where(first).repartition(1), f"{tmp_path}/clean")
    changed = rollup.update(spark, f"{tmp_path}/clean", f"{tmp_path}/sums")
    assert len(changed) == clean.where(first).select("zone", "date").distinct().count()
    held_against_all_records(spark, tmp_path)
    write_clean(clean.where(second).repartition(1), f"{tmp_path}/clean")
    changed = rollup.update(spark, f"{tmp_path}/clean", f"{tmp_path}/sums")
    assert changed and all(folder.rsplit("date=", 1)[1] >= days[len(days) // 2] for folder in changed)
    assert rollup.update(spark, f"{tmp_path}/clean", f"{tmp_path}/sums") == []
    # One folder is replaced, another goes.
    some = clean.where((F.col("date") == days[0]) & (F.col("zone") == "north"))
    write_clean(some.limit(1), f"{tmp_path}/clean", mode="replace")
    gone = next((tmp_path / "clean" / "zone=east").iterdir())
    for file in gone.iterdir():
        file.unlink()
    changed = rollup.update(spark, f"{tmp_path}/clean", f"{tmp_path}/sums")
    assert [folder.split("/clean/")[1] for folder in changed] == [f"zone=north/date={days[0]}"]
    held_against_all_records(spark, tmp_path)


def test_a_failed_update_leaves_the_last_record_in_force(spark, sf_dir, tmp_path, monkeypatch):
    clean = views.sensor_clean(spark, sf_dir).where("zone = 'north'")
    write_clean(clean.where("hour < 12").repartition(1), f"{tmp_path}/clean")
    rollup.update(spark, f"{tmp_path}/clean", f"{tmp_path}/sums")
    before = rollup.severity_by_zone(rollup.sums(spark, f"{tmp_path}/sums")).collect()
    write_clean(clean.where("hour >= 12").repartition(1), f"{tmp_path}/clean")
    partials = rollup.partials

    def failing(rows):
        # The sums are written; the record is not.
        partials(rows).write.mode("overwrite").parquet(f"{tmp_path}/sums/partials/run=1")
        raise RuntimeError("lost")

    monkeypatch.setattr(rollup, "partials", failing)
    with pytest.raises(RuntimeError, match="lost"):
        rollup.update(spark, f"{tmp_path}/clean", f"{tmp_path}/sums")
    assert rollup.severity_by_zone(rollup.sums(spark, f"{tmp_path}/sums")).collect() == before
    monkeypatch.setattr(rollup, "partials", partials)
    rollup.update(spark, f"{tmp_path}/clean", f"{tmp_path}/sums")
    held_against_all_records(spark, tmp_path)


def test_no_rollup_is_an_error(spark, tmp_path):
    with pytest.raises(RuntimeError, match="run an update first"):
        rollup.sums(spark, f"{tmp_path}/none")
