"""Ingest validation: reasons, good and quarantined records, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.functions.rules import OK, PARSE_ERROR, starts_object, with_reason


def validate(df: DataFrame, value_col: str = "value") -> DataFrame:
    """One row per input row, with the first broken rule in ``reason`` (``ok`` if none)."""
    return with_reason(df, value_col)


def valid_records(checked: DataFrame, value_col: str = "value") -> DataFrame:
    """Accepted records as one JSON line each, whatever extra fields they carry.

    A line break between JSON tokens is white space, so a blank in its place is the same record.
    """
    good = checked.where(F.col("reason") == OK)
    return good.withColumn(value_col, F.translate(value_col, "\r\n", "  "))


def quarantine_records(checked: DataFrame, value_col: str = "value") -> DataFrame:
    """Refused records: the reason and the record, as an object where it is one, else as text."""
    text = F.col(value_col)
    is_object = (F.col("reason") != PARSE_ERROR) & starts_object(text)
    raw = F.when(is_object, F.try_parse_json(text)).otherwise(text.cast("variant"))
    return checked.where(F.col("reason") != OK).withColumn("raw", raw).drop(value_col)


def reason_counts(checked: DataFrame) -> DataFrame:
    return checked.groupBy("reason").agg(F.count(F.lit(1)).alias("records"))


def status_counts(checked: DataFrame) -> DataFrame:
    """Running totals of the ingest loop: valid, invalid and unreadable records."""
    status = (
        F.when(F.col("reason") == OK, "valid").when(F.col("reason") == PARSE_ERROR, "parse_error").otherwise("invalid")
    )
    return checked.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("records"))
