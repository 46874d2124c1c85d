"""Column expressions on one sensor record: event time, scores, flags and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbline import fixed


def cases(subject: Column, table: dict, default=None) -> Column:
    """A CASE over a small fixed table; stays inside generated code, no join needed."""
    head, *rest = table.items()
    chain = reduce(
        lambda built, item: built.when(subject == item[0], F.lit(item[1])),
        rest,
        F.when(subject == head[0], F.lit(head[1])),
    )
    return chain if default is None else chain.otherwise(F.lit(default))


# ---- event time -------------------------------------------------------------------------------


def event_ts(text: Column) -> Column:
    """ISO text to timestamp; unreadable text gives null instead of an error."""
    return F.try_to_timestamp(text)


def arrival_date(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd")


def arrival_hour(moment: Column) -> Column:
    return F.date_format(moment, "HH")


# ---- repair -----------------------------------------------------------------------------------


def cast_or(value: Column, type_name: str, default) -> Column:
    """Cast, and put the default where the value is missing or cannot be cast."""
    return F.coalesce(value.try_cast(type_name), F.lit(default).cast(type_name))


# ---- scores and labels ------------------------------------------------------------------------


def congestion_score(congestion: Column) -> Column:
    return cases(congestion, fixed.CONGESTION_SCORES, 0)


def speed_ratio(speed: Column) -> Column:
    return F.round(speed / F.lit(100.0), 3)


def is_emergency(vehicle: Column) -> Column:
    return vehicle.isin(fixed.EMERGENCY_VEHICLES).cast("int")


def is_bad_weather(weather: Column) -> Column:
    return weather.isin(fixed.BAD_WEATHER).cast("int")


def hour_bin(hour: Column) -> Column:
    first, *rest = fixed.HOUR_BINS
    chain = F.when(hour.between(first[0], first[1]), first[2])
    for low, high, name in rest:
        chain = chain.when(hour.between(low, high), name)
    return chain.otherwise("off_peak")


def risk_score(score: Column, ratio: Column, bad_weather: Column) -> Column:
    """Half congestion, up to 30 for slowness, 20 for bad weather; not clamped."""
    slowness = (F.lit(1) - ratio) * 100 * 0.3
    return F.round(score * 0.5 + slowness + bad_weather * 20, 1)


def severity_label(risk: Column) -> Column:
    """A null risk is critical: it fails every comparison."""
    return F.when(risk < 25, "low").when(risk < 50, "medium").when(risk < 75, "high").otherwise("critical")


def severity_index(label: Column) -> Column:
    return cases(label, {name: rank for rank, name in enumerate(fixed.SEVERITIES)}, 0)


def scoring_text() -> Column:
    """One line of text per feature record for the text classifier; null parts are skipped."""
    vehicle_kind = F.when(F.col("is_emergency") == 1, "emergency vehicle").otherwise("normal vehicle")
    return F.concat_ws(" ", "intersection_id", "congestion", "vehicle_type", "weather", "hour_bin", vehicle_kind)


# ---- reproducible draws -----------------------------------------------------------------------


def unit_draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends only on the row's key and the seed.

    ``rand`` depends on partition and row order, so a retried task could draw differently; this
    gives the same draw wherever and however often the row is computed.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def pick(choices: list, draw: Column) -> Column:
    """One of a few literals, chosen by a draw in [0, 1)."""
    return F.get(F.array(*[F.lit(c) for c in choices]), F.floor(draw * len(choices)).cast("int"))
