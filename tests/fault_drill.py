"""Broken variants of good records, for tests of cleaning and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.functions.cells import pick, unit_draw

BATCH_FAULTS = ["null_speed", "null_congestion", "wrong_type", "out_of_range"]


def _fault(key: Column, share: float, kinds: list[str], seed: int) -> Column:
    """The kind of fault a row gets, null for most; decided by the row's key alone."""
    return F.when(unit_draw(key, seed) < share, pick(kinds, unit_draw(key, seed + 1)))


def inject_batch_faults(df: DataFrame, share: float = 0.1, seed: int = 7) -> DataFrame:
    """Give about ``share`` of the records one of four faults.

    The count becomes text, because a wrong type is one of the faults; cleaning casts it back.
    """
    fault = _fault(F.col("event_id"), share, BATCH_FAULTS, seed)
    return (
        df.withColumn("_fault", fault)
        .withColumns(
            {
                "speed_kmh": F.when(F.col("_fault") == "null_speed", F.lit(None))
                .when(F.col("_fault") == "out_of_range", 999.9)
                .otherwise(F.col("speed_kmh")),
                "congestion": F.when(F.col("_fault") == "null_congestion", F.lit(None)).otherwise(F.col("congestion")),
                "vehicle_count": F.when(F.col("_fault") == "wrong_type", "many").otherwise(
                    F.col("vehicle_count").cast("string")
                ),
                "record_type": F.when(F.col("_fault").isNotNull(), "adversarial").otherwise("normal"),
            }
        )
        .drop("_fault")
    )
