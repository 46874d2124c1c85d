"""Cleaning of raw sensor events: ``DataFrame -> DataFrame`` steps and their composition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline import fixed
from kerbline.functions import cells

KEY_COLUMNS = ["event_id", "timestamp", "intersection_id"]


def drop_keyless(df: DataFrame) -> DataFrame:
    """Drop rows in which all three identifying columns are null (unreadable lines end up so)."""
    return df.dropna("all", subset=KEY_COLUMNS)


def fill_defaults(df: DataFrame) -> DataFrame:
    """Replace nulls (and NaN in float columns) by the field defaults."""
    present = {name: value for name, value in fixed.FIELD_DEFAULTS.items() if name in df.columns}
    return df.fillna(present)


def cast_or_default(df: DataFrame) -> DataFrame:
    """Speed as float and count as int; what cannot be read as such gets the default."""
    return df.withColumns(
        {
            "speed_kmh": cells.cast_or(F.col("speed_kmh"), "float", fixed.FIELD_DEFAULTS["speed_kmh"]),
            "vehicle_count": cells.cast_or(F.col("vehicle_count"), "int", fixed.FIELD_DEFAULTS["vehicle_count"]),
        }
    )


def in_range() -> Column:
    return F.col("speed_kmh").between(*fixed.SPEED_RANGE) & F.col("vehicle_count").between(*fixed.COUNT_RANGE)


def filter_ranges(df: DataFrame) -> DataFrame:
    return df.where(in_range())


def in_domain(prefix: str = "") -> Column:
    return (
        F.col(f"{prefix}congestion").isin(fixed.CONGESTION_LEVELS)
        & F.col(f"{prefix}vehicle_type").isin(fixed.VEHICLE_TYPES)
        & F.col(f"{prefix}weather").isin(fixed.WEATHER_CONDITIONS)
    )


def filter_domains(df: DataFrame) -> DataFrame:
    return df.where(in_domain())


def with_event_time(df: DataFrame) -> DataFrame:
    """Event timestamp, date and hour from the ISO text; they replace any arrival date and hour."""
    return df.withColumn("event_ts", cells.event_ts(F.col("timestamp"))).withColumns(
        {"date": F.to_date("event_ts"), "hour": F.hour("event_ts")}
    )


def _survivor(columns: list[str]) -> Column:
    """Rows of one id compare by event time (unreadable times last), then by all other columns."""
    others = [c for c in columns if c not in ("event_id", "event_ts")]
    return F.struct(F.col("event_ts").isNull().alias("_no_time"), "event_ts", *others)


def dedup_by_event(df: DataFrame) -> DataFrame:
    """Keep the earliest row per ``event_id``; null ids count as one id.

    ``min`` of a struct is combined map-side, so an id that holds a large share of all rows leaves
    every map task as one row. A plain window would send all of its rows to one task.
    """
    columns = df.columns
    timed = df if "event_ts" in columns else df.withColumn("event_ts", cells.event_ts(F.col("timestamp")))
    kept = timed.groupBy("event_id").agg(F.min(_survivor(timed.columns)).alias("kept"))
    return kept.select("event_id", "kept.*").select(*columns)


def clean(raw: DataFrame) -> DataFrame:
    """The whole cleaning chain, in the order that decides which duplicate survives.

    Duplicates go after the range filter and before the domain filter, so an id whose surviving row
    breaks a domain disappears. Event time is computed before the only shuffle, as part of the scan.
    """
    return (
        raw.transform(drop_keyless)
        .transform(fill_defaults)
        .transform(cast_or_default)
        .transform(filter_ranges)
        .transform(with_event_time)
        .transform(dedup_by_event)
        .transform(filter_domains)
        .drop("timestamp")
    )


def quality_stats(raw: DataFrame) -> DataFrame:
    """Raw, clean and dropped counts and the drop rate, in one pass and one shuffle.

    Rows that the cleaning drops before de-duplication stay in as null survivors, so that one
    map-side combined aggregate counts both sides.
    """
    prepared = raw.transform(fill_defaults).transform(cast_or_default).transform(with_event_time)
    keyed = F.coalesce(*[F.col(c).cast("string") for c in KEY_COLUMNS]).isNotNull()
    keep = F.when(keyed & in_range(), _survivor(prepared.columns))
    per_id = prepared.groupBy("event_id").agg(F.count(F.lit(1)).alias("rows"), F.min(keep).alias("kept"))
    totals = per_id.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_raw"),
        F.count_if(F.col("kept").isNotNull() & in_domain("kept.")).alias("total_clean"),
    )
    dropped = F.col("total_raw") - F.col("total_clean")
    return totals.select(
        "total_raw",
        "total_clean",
        dropped.alias("dropped"),
        F.round(dropped.cast("double") / F.greatest("total_raw", F.lit(1)) * 100, 1).alias("drop_rate_pct"),
    )


RULES = ["raw", "keyless", "out_of_range", "duplicate", "out_of_domain", "clean"]


def rule_counts(raw: DataFrame) -> DataFrame:
    """``rule, rows``: the rows read, those that each cleaning rule drops, and those that remain; they add up.

    One pass and one shuffle, as in ``quality_stats``: what a rule drops before de-duplication is counted per id next to
    the surviving row, and both sides are combined map-side.
    """
    prepared = raw.transform(fill_defaults).transform(cast_or_default).transform(with_event_time)
    keyed = F.coalesce(*[F.col(c).cast("string") for c in KEY_COLUMNS]).isNotNull()
    keep = F.when(keyed & in_range(), _survivor(prepared.columns))
    per_id = prepared.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~keyed).alias("keyless"),
        F.count_if(keyed & ~F.coalesce(in_range(), F.lit(False))).alias("beyond"),
        F.min(keep).alias("kept"),
    )
    survives = F.col("kept").isNotNull()
    known = F.coalesce(in_domain("kept."), F.lit(False))

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0))

    repeats = F.col("rows") - F.col("keyless") - F.col("beyond") - survives.cast("int")
    totals = per_id.agg(
        total(F.col("rows")).alias("raw"),
        total(F.col("keyless")).alias("keyless"),
        total(F.col("beyond")).alias("out_of_range"),
        total(repeats).alias("duplicate"),
        F.count_if(survives & ~known).alias("out_of_domain"),
        F.count_if(survives & known).alias("clean"),
    )
    return totals.select(F.inline(F.array(*(F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("rows")) for rule in RULES))))
