"""Reports over feature records. All aggregates combine map-side, so key skew costs nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def severity_by_zone(df: DataFrame) -> DataFrame:
    return df.groupBy("zone", "severity_label").count().orderBy("zone", "severity_label")


def risk_by_hour_bin(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("hour_bin")
        .agg(F.round(F.avg("risk_score"), 1).alias("avg_risk"), F.count("*").alias("events"))
        .orderBy(F.desc("avg_risk"), "hour_bin")
    )


def emergency_incidents(df: DataFrame) -> DataFrame:
    return (
        df.where(F.col("is_emergency") == 1)
        .groupBy("vehicle_type", "severity_label")
        .count()
        .orderBy("vehicle_type", "count", "severity_label")
    )


def top_risk_intersections(df: DataFrame, k: int = 3) -> DataFrame:
    """The k riskiest intersections; plans to a per-task top-k, not to a full sort."""
    return (
        df.groupBy("intersection_id")
        .agg(F.round(F.avg("risk_score"), 1).alias("avg_risk"))
        .orderBy(F.desc("avg_risk"), "intersection_id")
        .limit(k)
    )


def class_distribution(df: DataFrame, label: str = "severity") -> DataFrame:
    return df.groupBy(label).count().orderBy(label)


def risk_by_zone_sql(spark: SparkSession, table: str) -> DataFrame:
    return spark.sql(
        """
        SELECT zone,
               round(avg(risk_score), 1)       AS avg_risk,
               round(avg(congestion_score), 1) AS avg_congestion,
               count(*)                        AS event_count
        FROM IDENTIFIER(:table)
        GROUP BY zone
        ORDER BY avg_risk DESC, zone
        """,
        args={"table": table},
    )


def severity_share_sql(spark: SparkSession, table: str) -> DataFrame:
    """Share of each severity; the window runs over the aggregate, four rows, not over the records."""
    return spark.sql(
        """
        SELECT severity_label,
               count(*)                                                            AS count,
               CAST(round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS double)  AS pct
        FROM IDENTIFIER(:table)
        GROUP BY severity_label
        ORDER BY severity_label
        """,
        args={"table": table},
    )
