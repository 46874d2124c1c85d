"""From feature table and saved model to scored records and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kerbline import fixed
from kerbline.operators.decisions import decide
from kerbline.operators.ml import score
from kerbline.sources.readers import hospitals, load_model, read_corpus, read_table, road_edges
from kerbline.sources.writers import write_json


def load_and_score(spark: SparkSession, features_path: str, model_path: str, limit: int | None = None) -> DataFrame:
    """Scored records, all of them or the first ``limit`` by ``event_id``."""
    records = read_table(spark, features_path)
    if limit is not None:
        records = records.orderBy("event_id").limit(limit)
    return score(records, load_model(model_path))


def run_decisions(
    spark: SparkSession,
    features_path: str,
    model_path: str,
    policies_path: str,
    protocols_path: str,
    scored_out: str,
    decisions_out: str,
    limit: int | None = None,
    label_col: str = "severity_label",
    multi_line: bool = False,
) -> DataFrame:
    """Score, decide and write both results as JSON; the written decisions.

    The corpora are JSON lines, or files of one array each with ``multi_line``.
    """
    write_json(load_and_score(spark, features_path, model_path, limit), scored_out)
    schema = ", ".join(f"{c} {t}" for c, t in SCORED_TYPES.items())
    scored = spark.read.schema(schema).json(scored_out)
    decided = decide(
        scored,
        road_edges(spark),
        hospitals(spark),
        read_corpus(spark, policies_path, fixed.POLICY_SCHEMA, multi_line),
        read_corpus(spark, protocols_path, fixed.PROTOCOL_SCHEMA, multi_line),
        label_col=label_col,
    )
    write_json(decided, decisions_out)
    return spark.read.schema(decided.schema).json(decisions_out)


SCORED_TYPES = {
    **{name: "string" for name in fixed.SCORED_COLUMNS},
    "congestion_score": "int",
    "risk_score": "double",
    "is_emergency": "int",
    "is_bad_weather": "int",
    "speed_kmh": "float",
    "vehicle_count": "int",
    "predicted_severity": "string",
}
