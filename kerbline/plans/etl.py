"""Batch jobs between folders: raw events to clean table to feature table."""

from __future__ import annotations

import time

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from kerbline.operators.cleaning import clean
from kerbline.operators.features import add_features
from kerbline.session import build_session
from kerbline.sources.readers import read_events, read_table
from kerbline.sources.writers import gathered, write_clean, write_features


def run_etl(input_path: str, output_path: str, spark: SparkSession | None = None, mode: str = "append") -> dict:
    """Clean raw events into Parquet; counts and elapsed seconds. The input is read once.

    Raw rows are counted behind the scan and clean rows while they are written. Tasks of a write count once even if
    they run again; tasks of the scan that run again because an executor was lost with their output count again, so
    after such a loss ``total_raw`` is an upper bound (``cleaning.rule_counts`` counts exactly).
    """
    session = spark or build_session("kerbline-etl")
    started = time.perf_counter()
    read, written = Observation("raw"), Observation("clean")
    raw = read_events(session, input_path).observe(read, F.count(F.lit(1)).alias("rows"))
    ready = gathered(clean(raw), "zone", "date").observe(written, F.count(F.lit(1)).alias("rows"))
    write_clean(ready, output_path, mode)
    total_raw, total_clean = read.get["rows"], written.get["rows"]
    if spark is None:
        session.stop()
    return {
        "total_raw": total_raw,
        "total_clean": total_clean,
        "dropped": total_raw - total_clean,
        "elapsed_sec": round(time.perf_counter() - started, 2),
    }


def run_features(input_path: str, output_path: str, spark: SparkSession | None = None) -> dict:
    """Feature table from the clean table; an unreadable input is an error."""
    session = spark or build_session("kerbline-features")
    started = time.perf_counter()
    write_features(add_features(read_table(session, input_path)), output_path)
    if spark is None:
        session.stop()
    return {"elapsed_sec": round(time.perf_counter() - started, 2)}
