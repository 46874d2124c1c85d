"""Time the headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from kerbline.functions import cells  # noqa: E402
from kerbline.operators import cleaning, ml  # noqa: E402
from kerbline.plans import sensor_views as views  # noqa: E402
from kerbline.plans.etl import run_etl, run_features  # noqa: E402
from kerbline.plans.registry import QUERIES  # noqa: E402
from kerbline.session import build_session, scratch_path  # noqa: E402
from kerbline.sources.writers import write_json  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

# Query name and how often it is timed after one warm-up; the median counts. Long ones are timed once, without.
TIMED = {
    "etl_clean": RUNS,
    "etl_quality_stats": RUNS,
    "feat_risk_score": RUNS,
    "win_zone_averages": RUNS,
    "rep_severity_by_zone": RUNS,
    "rep_risk_by_hour_bin": RUNS,
    "rep_emergency_incidents": RUNS,
    "rep_top3_intersections": RUNS,
    "rep_risk_by_zone_sql": RUNS,
    "win_severity_share": RUNS,
    "val_reasons": RUNS,
    "stream_ingest_available_now": 1,
    "stream_dedup": RUNS,
    "graph_hops": RUNS,
    "graph_spillover": RUNS,
    "text_topk_overlap": 1,
    "text_record_context": 1,
    "decide_summary": 1,
}


def timed(action) -> float:
    started = time.perf_counter()
    action()
    return time.perf_counter() - started


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions=CPUS,
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    # The two file-to-file jobs, on the raw events as JSON lines; staging is not timed.
    raw_path = scratch_path(spark, "raw")
    staged = views.sensor_raw(spark, SF_DIR).repartition(int(CPUS))
    write_json(staged, raw_path)
    etl, features = [], []
    for _ in range(RUNS):
        clean_path = scratch_path(spark, "clean")
        etl.append(timed(lambda: run_etl(raw_path, clean_path, spark)))
        features.append(timed(lambda: run_features(clean_path, scratch_path(spark, "features"), spark)))
    seconds["job_etl"] = statistics.median(etl)
    seconds["job_features"] = statistics.median(features)

    for name, runs in TIMED.items():
        query = QUERIES[name]
        if runs > 1:
            query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        taken = [
            timed(lambda: query(spark, SF_DIR).write.format("noop").mode("overwrite").save()) for _ in range(runs)
        ]
        seconds[name] = statistics.median(taken)

    train, test = ml.split_train_test(ml.labelled(views.quality_corpus(spark, SF_DIR)), "doc_id")
    seconds["ml_logreg_fit_and_evaluate"] = timed(lambda: ml.train_and_evaluate(train, test, "logreg"))

    # As many short texts as the published fits had.
    texts = views.sensor_scores(spark, SF_DIR).select("event_id", cells.scoring_text().alias("text"), F.col("severity_label").alias("severity"))
    short_train, short_test = ml.split_train_test(texts.orderBy("event_id").limit(1500).persist(), "event_id")
    for classifier in ("logreg", "svm"):
        name = f"ml_{classifier}_1500_fit_and_evaluate"
        seconds[name] = timed(lambda kind=classifier: ml.train_and_evaluate(short_train, short_test, kind))

    raw_rows = cleaning.quality_stats(views.sensor_raw(spark, SF_DIR)).first()["total_raw"]
    both = seconds["job_etl"] + seconds["job_features"]
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": {name: round(taken, 3) for name, taken in seconds.items()},
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
                "raw_records": raw_rows,
                "etl_and_features_records_per_sec": round(raw_rows / both),
            }
        )
    )


if __name__ == "__main__":
    main()
