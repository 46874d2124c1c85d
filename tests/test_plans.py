"""What the physical plans must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F

from kerbline.operators import cleaning, decisions, features, reports, retrieval
from kerbline.plans import registry
from kerbline.plans import sensor_views as views
from kerbline.sources import writers

NEVER = re.compile(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython|MapInPandas|PythonUDF")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["etl_clean", "etl_quality_stats", "win_zone_averages", "rep_risk_by_zone_sql", "val_reasons", "val_quarantine",
     "graph_hops", "graph_nearest_target", "graph_spillover", "text_topk_overlap", "text_record_context", "decide_messages"],
)
def test_no_cross_join_and_no_python(spark, sf_dir, name):
    assert not NEVER.search(plan(registry.QUERIES[name](spark, sf_dir)))


def test_dedup_combines_before_its_only_shuffle(spark, sf_dir):
    text = plan(views.sensor_clean(spark, sf_dir))
    assert text.count("Exchange") == 1
    assert "partial_min" in text


def test_zone_averages_do_not_shuffle_the_records(spark, sf_dir):
    records = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_type").alias("zone"), F.col("value").alias("speed_kmh"), F.lit(25).alias("congestion_score")
    )
    text = plan(features.add_zone_averages(records))
    assert "BroadcastHashJoin" in text
    assert "Exchange hashpartitioning" not in text
    assert "Window" not in text


def test_top_k_and_reports(spark, sf_dir):
    scored = views.sensor_scores(spark, sf_dir)
    assert "TakeOrderedAndProject" in plan(reports.top_risk_intersections(scored))
    assert "partial_count" in plan(reports.severity_by_zone(scored))


def test_rank_limit_works_before_the_shuffle(spark, sf_dir):
    queries = views.sensor_scores(spark, sf_dir).select(decisions.vehicle_query().alias("query"))
    docs = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_ord"), "text")
    text = plan(retrieval.retrieve(queries, docs))
    assert re.search(r"WindowGroupLimit .*Partial", text)


def test_validation_parses_once(spark, sf_dir):
    text = plan(registry.val_quarantine(spark, sf_dir))
    # once for the rules, once for the object that quarantine keeps
    assert text.count("parseJson") <= 2


def test_partition_and_column_pruning(spark, sf_dir, tmp_path):
    path = str(tmp_path / "features")
    writers.write_features(views.sensor_scores(spark, sf_dir), path)
    text = plan(spark.read.parquet(path).where("severity_label = 'high' AND risk_score > 60").select("event_id"))
    assert re.search(r"PartitionFilters: \[.*severity_label.* = high", text)
    assert "GreaterThan(risk_score,60.0)" in text
    assert "ReadSchema: struct<event_id:string,risk_score:double>" in text


def test_only_needed_event_columns_are_read(spark, sf_dir):
    raw = views.sensor_raw(spark, sf_dir)
    text = plan(cleaning.fill_defaults(raw).select("event_id", "zone"))
    assert "ReadSchema: struct<event_id:bigint>" in text
