"""Feature engineering on clean sensor events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.functions import cells
from kerbline.operators.lookup import lookup
from kerbline.session import pin


def add_scores(df: DataFrame) -> DataFrame:
    """Every feature that depends on its own row only; no shuffle."""
    return (
        df.withColumns(
            {
                "congestion_score": cells.congestion_score(F.col("congestion")),
                "speed_ratio": cells.speed_ratio(F.col("speed_kmh")),
                "is_emergency": cells.is_emergency(F.col("vehicle_type")),
                "is_bad_weather": cells.is_bad_weather(F.col("weather")),
                "hour_bin": cells.hour_bin(F.col("hour")),
            }
        )
        .withColumn(
            "risk_score",
            cells.risk_score(F.col("congestion_score"), F.col("speed_ratio"), F.col("is_bad_weather")),
        )
        .withColumn("severity_label", cells.severity_label(F.col("risk_score")))
        .withColumn("severity_index", cells.severity_index(F.col("severity_label")))
    )


def zone_averages(df: DataFrame) -> DataFrame:
    """One row per zone; reads three columns and combines map-side."""
    return df.groupBy("zone").agg(
        F.round(F.avg("congestion_score"), 1).alias("zone_avg_congestion"),
        F.round(F.avg("speed_kmh"), 1).alias("zone_avg_speed"),
    )


def add_zone_averages(df: DataFrame) -> DataFrame:
    """Whole-zone averages on every row, as a window over ``zone`` would give.

    A window would move all rows to as many tasks as there are zones. Here the averages are
    aggregated and pinned first, measured, and looked up.
    """
    return lookup(df, pin(zone_averages(df)), ["zone"])


def add_features(df: DataFrame) -> DataFrame:
    return df.transform(add_scores).transform(add_zone_averages)
