"""Sinks: partitioned Parquet, JSON, catalog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def gathered(df: DataFrame, *partition_cols: str) -> DataFrame:
    """Bring rows of one output folder together before a partitioned write.

    Without it every task writes a file into every folder. A rebalance shuffles by the partition
    columns, splits the large ones into several evenly sized tasks and merges the small ones.
    """
    return df.hint("rebalance", *[F.col(c) for c in partition_cols])


def write_clean(df: DataFrame, path: str, mode: str = "append") -> None:
    """Clean events by ``zone`` and ``date``.

    ``append`` adds to what is there. ``replace`` overwrites exactly the folders the data has rows
    for, so running it again gives the same table.
    """
    if mode not in ("append", "replace"):
        raise ValueError(f"mode {mode!r}: append or replace")
    writer = df.write.partitionBy("zone", "date")
    if mode == "append":
        writer.mode("append").parquet(path)
    else:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_features(df: DataFrame, path: str) -> None:
    """Feature records by ``zone`` and ``severity_label``, replacing the whole table."""
    writer = gathered(df, "zone", "severity_label").write.mode("overwrite")
    writer.option("partitionOverwriteMode", "static").partitionBy("zone", "severity_label").parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Scored records, nested decisions or metric rows as JSON lines, written by the executors."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def register_table(spark: SparkSession, name: str, path: str) -> None:
    """An external table over Parquet files, if absent, with the partitions found in its folders."""
    spark.sql("CREATE TABLE IF NOT EXISTS IDENTIFIER(:name) USING parquet LOCATION " + _quoted(path), args={"name": name})
    if any(column.isPartition for column in spark.catalog.listColumns(name)):
        spark.catalog.recoverPartitions(name)


def register_tables(
    spark: SparkSession,
    processed: str,
    features: str,
    names: tuple[str, str] = ("traffic_processed", "traffic_features"),
) -> DataFrame:
    """Register both tables and list what the catalog has."""
    register_table(spark, names[0], processed)
    register_table(spark, names[1], features)
    return spark.sql("SHOW TABLES")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
