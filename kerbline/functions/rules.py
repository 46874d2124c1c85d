"""Ingest rules as column expressions over one JSON text column.

VARIANT keeps apart what the rules need apart: an absent field (no value at the path), a JSON null
(kind VOID) and a value of another kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline import fixed

OK = "ok"
PARSE_ERROR = "json_parse_error"
NOT_AN_OBJECT = "not_a_dict"


def starts_object(text: Column) -> Column:
    return F.ltrim(text, F.lit(" \t\r\n")).startswith("{")


def _kind_matches(kind: Column, wanted: str, text: Column, field: str) -> Column:
    """Whether a JSON kind satisfies a field's type; true and false count as whole numbers."""
    if wanted == "string":
        return kind == "STRING"
    if wanted == "number":
        return kind.isin("BIGINT", "DOUBLE", "FLOAT", "BOOLEAN") | kind.startswith("DECIMAL")
    # A whole number beyond 64 bits is held as DECIMAL(p,0) or DOUBLE, as 3.0 is; only the literal
    # itself tells them apart, and it is looked at only for those kinds.
    literal = F.get_json_object(text, f"$.{field}")
    return kind.isin("BIGINT", "BOOLEAN") | (
        (kind.startswith("DECIMAL") | (kind == "DOUBLE")) & literal.rlike("^-?[0-9]+$")
    )


def _problem(kind: Column, wanted: str, text: Column, field: str) -> Column:
    """What is wrong with one field, null if nothing."""
    return (
        F.when(kind.isNull(), "missing_field")
        .when(kind == "VOID", "null_field")
        .when(~_kind_matches(kind, wanted, text, field), "wrong_type")
    )


def with_reason(df: DataFrame, value_col: str = "value") -> DataFrame:
    """Add ``reason``: the first rule the JSON text breaks, or ``ok``."""
    text = F.col(value_col)
    kept = [F.col(c) for c in df.columns]
    # The parse, the kinds and the problems sit in projections of their own, so that each is
    # computed once per row and the rule chain stays short generated code.
    parsed = df.select(*kept, F.try_parse_json(text).alias("_doc"))
    kinds = parsed.select(
        *kept,
        F.col("_doc").isNull().alias("_unreadable"),
        *[
            F.schema_of_variant(F.try_variant_get("_doc", f"$.{field}", "variant")).alias(f"_kind_{field}")
            for field in fixed.REQUIRED_FIELDS
        ],
        F.try_variant_get("_doc", "$.speed_kmh", "double").alias("_speed"),
        F.try_variant_get("_doc", "$.vehicle_count", "double").alias("_count"),
        F.try_variant_get("_doc", "$.congestion", "string").alias("_congestion"),
    )
    problems = kinds.select(
        *kept,
        "_unreadable",
        *[
            _problem(F.col(f"_kind_{field}"), wanted, text, field).alias(f"_problem_{field}")
            for field, wanted in fixed.REQUIRED_FIELDS.items()
        ],
        (~F.col("_speed").between(*fixed.SPEED_RANGE)).alias("_bad_speed"),
        (~F.col("_count").between(*fixed.COUNT_RANGE)).alias("_bad_count"),
        (~F.col("_congestion").isin(fixed.CONGESTION_LEVELS)).alias("_bad_congestion"),
    )
    reason = F.when(F.col("_unreadable"), PARSE_ERROR).when(~starts_object(text), NOT_AN_OBJECT)
    for field in fixed.REQUIRED_FIELDS:
        problem = F.col(f"_problem_{field}")
        reason = reason.when(problem.isNotNull(), F.concat(problem, F.lit(f":{field}")))
    reason = (
        reason.when(F.col("_bad_speed"), "speed_out_of_range")
        .when(F.col("_bad_count"), "count_out_of_range")
        .when(F.col("_bad_congestion"), "invalid_congestion_value")
        .otherwise(OK)
    )
    # The reason goes through an explode of one element. A filter on a plain column would be moved
    # below these projections, and with them merged in it would parse the text once per rule.
    return problems.select(*kept, F.explode(F.array(reason)).alias("reason"))
