"""Reports kept up to date: partial aggregates per folder of the clean table, merged when a report is asked for.

A folder of the clean table is aggregated once, over all the columns that reports group by; its sums merge with those of
other folders by addition. An update lists the files, works out the folders that are new or were replaced since the last
one, reads those only, and records which run holds each folder's sums. Sums of folders that were replaced or removed are
no longer referred to. An update that fails leaves the last record in force, and running it again starts from there.

Risk scores have one decimal, so tenths are summed as whole numbers and merge without rounding.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.operators.features import add_scores

KEYS = ["zone", "hour_bin", "severity_label", "vehicle_type", "is_emergency", "intersection_id"]


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def folder_states(spark: SparkSession, table_path: str) -> DataFrame:
    """``folder, state``: the folders of a table and a fingerprint of the names, sizes and times of their files.

    The files are listed and not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(table_path)
    entry = F.xxhash64("path", "modificationTime", "length").cast("decimal(20,0)")
    return files.groupBy(folder_of(F.col("path")).alias("folder")).agg(
        F.concat_ws(":", F.count(F.lit(1)), F.sum(entry)).alias("state")
    )


def partials(clean: DataFrame) -> DataFrame:
    """``folder``, the report keys, and sums that merge by addition; combined before the shuffle."""
    placed = clean.withColumn("folder", folder_of(F.col("_metadata.file_path")))
    return (
        add_scores(placed)
        .groupBy("folder", *KEYS)
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.sum(F.round(F.col("risk_score") * 10).cast("long")).alias("risk_tenths"),
            F.count("risk_score").alias("risks"),
            F.sum("congestion_score").alias("congestion"),
            F.sum(F.col("speed_kmh").cast("double")).alias("speed"),
        )
    )


def _record(spark: SparkSession, rollup_path: str) -> tuple[DataFrame | None, int]:
    """The record in force (``folder, state, run``) and its version; nothing and -1 before the first update."""
    try:
        records = spark.read.parquet(f"{rollup_path}/folders")
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None, -1
    version = records.agg(F.max("version")).first()[0]
    return records.where(F.col("version") == version).drop("version"), version


def update(spark: SparkSession, clean_path: str, rollup_path: str) -> list[str]:
    """Bring the rollup up to the clean table; the folders that were read."""
    record, version = _record(spark, rollup_path)
    now, run = folder_states(spark, clean_path), version + 1
    if record is None:
        known = now.withColumn("run", F.lit(None).cast("int"))
    else:
        known = now.join(record, ["folder", "state"], "left")
    # One row per folder of the table.
    states = [(r.folder, r.state, r.run) for r in known.collect()]
    changed = sorted(folder for folder, _, found in states if found is None)
    if changed:
        clean = spark.read.option("basePath", clean_path).parquet(*changed)
        partials(clean).write.mode("overwrite").parquet(f"{rollup_path}/partials/run={run}")
    schema = "folder string, state string, run int"
    rows = [(folder, state, run if found is None else found) for folder, state, found in states]
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{rollup_path}/folders/version={run}")
    return changed


def sums(spark: SparkSession, rollup_path: str) -> DataFrame:
    """The partial sums that the record in force refers to."""
    record, _ = _record(spark, rollup_path)
    if record is None:
        raise RuntimeError(f"no rollup at {rollup_path}: run an update first")
    runs = [r.run for r in record.select("run").distinct().collect()]
    rows = spark.read.option("basePath", f"{rollup_path}/partials").parquet(*(f"{rollup_path}/partials/run={run}" for run in runs))
    return rows.join(record.select("folder", "run"), ["folder", "run"], "left_semi")


# ---- reports ------------------------------------------------------------------------------------


def _average(total: str, count: str, digits: int = 1) -> Column:
    return F.round(F.sum(total) / F.sum(count), digits)


def _risk() -> Column:
    return F.round(F.sum("risk_tenths") / F.lit(10.0) / F.sum("risks"), 1).alias("avg_risk")


def severity_by_zone(merged: DataFrame) -> DataFrame:
    return merged.groupBy("zone", "severity_label").agg(F.sum("events").alias("count")).orderBy("zone", "severity_label")


def risk_by_hour_bin(merged: DataFrame) -> DataFrame:
    return merged.groupBy("hour_bin").agg(_risk(), F.sum("events").alias("events")).orderBy(F.desc("avg_risk"), "hour_bin")


def emergency_incidents(merged: DataFrame) -> DataFrame:
    counts = merged.where(F.col("is_emergency") == 1).groupBy("vehicle_type", "severity_label").agg(F.sum("events").alias("count"))
    return counts.orderBy("vehicle_type", "count", "severity_label")


def top_risk_intersections(merged: DataFrame, k: int = 3) -> DataFrame:
    return merged.groupBy("intersection_id").agg(_risk()).orderBy(F.desc("avg_risk"), "intersection_id").limit(k)


def risk_by_zone(merged: DataFrame) -> DataFrame:
    averages = merged.groupBy("zone").agg(
        _risk(), _average("congestion", "events").alias("avg_congestion"), F.sum("events").alias("event_count")
    )
    return averages.orderBy(F.desc("avg_risk"), "zone")


def severity_share(merged: DataFrame) -> DataFrame:
    """Share of each severity; the total is one row next to four."""
    counts = merged.groupBy("severity_label").agg(F.sum("events").alias("count"))
    total = merged.agg(F.sum("events")).first()[0] or 0
    return counts.withColumn("pct", F.round(F.col("count") * 100.0 / F.lit(total), 1)).orderBy("severity_label")


def zone_averages(merged: DataFrame) -> DataFrame:
    return merged.groupBy("zone").agg(
        _average("congestion", "events").alias("zone_avg_congestion"), _average("speed", "events").alias("zone_avg_speed")
    )
