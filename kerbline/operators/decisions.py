"""Decisions on scored records as column expressions: vehicle, incident, traffic light."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline import fixed
from kerbline.functions.cells import cases
from kerbline.operators.graph import NeighborLists, alert_text, attach_neighbors, nearest_target, neighbor_lists
from kerbline.operators.lookup import fits_broadcast, lookup
from kerbline.operators.retrieval import cut_texts, retrieve
from kerbline.session import pin, store

PROFILE = ["congestion", "vehicle_type", "weather", "is_emergency", "_label"]


def one_decimal(value: Column) -> Column:
    """Ties go to the even digit, as in the message format; the rest as usual."""
    return F.bround(value.cast("double"), 1)


# ---- rules ------------------------------------------------------------------------------------


def incident_severity(label: Column, emergency: Column, congestion: Column) -> Column:
    """An emergency vehicle in dense traffic is critical, whatever the label."""
    return F.when(emergency & congestion.isin("high", "critical"), "critical").otherwise(label)


def recommended_action(severity: Column) -> Column:
    return cases(severity, fixed.ACTIONS)


def is_serious(severity: Column) -> Column:
    return severity.isin("high", "critical")


def is_override(emergency: Column, action: Column) -> Column:
    return emergency & (action == fixed.ACTIONS["critical"])


def phase_seconds(phase: int, severity: Column, action: Column, emergency: Column) -> Column:
    """Seconds of one phase (0 green, 1 yellow, 2 red)."""
    base = cases(severity, {name: seconds[phase] for name, seconds in fixed.PHASE_SECONDS.items()})
    if phase == 2:
        base = F.when(action == fixed.ACTIONS["high"], base + fixed.REROUTE_EXTRA_RED).otherwise(base)
    return F.when(is_override(emergency, action), fixed.OVERRIDE_SECONDS[phase]).otherwise(base)


def decision_text(intersection: Column, action: Column, emergency: Column) -> Column:
    """A critical record without an emergency vehicle falls to the last text; kept on purpose."""

    def text(pattern: str) -> Column:
        return F.format_string(pattern, intersection)

    # --- fixed values: wording of the four decisions ---
    return (
        F.when(
            is_override(emergency, action), text("EMERGENCY OVERRIDE: Full green phase for %s. Clear all lanes.")
        )
        .when(
            action == fixed.ACTIONS["high"], text("Rerouting activated at %s. Extended red to divert traffic.")
        )
        .when(
            action == fixed.ACTIONS["medium"], text("Rebalancing signal timing at %s to ease medium congestion.")
        )
        .otherwise(text("Normal monitoring at %s. Standard timing maintained."))
    )


# ---- query texts ------------------------------------------------------------------------------


def vehicle_query() -> Column:
    return F.concat_ws(" ", "congestion", F.lit("congestion"), "vehicle_type", "weather")


def incident_query(severity: Column) -> Column:
    return F.concat_ws(" ", "vehicle_type", severity, "congestion")


def signal_query(severity: Column, action: Column) -> Column:
    return F.concat_ws(" ", severity, action, F.lit("signal"))


# ---- composition ------------------------------------------------------------------------------


def _label(records: DataFrame, label_col: str) -> Column:
    """The chosen label where it is a known severity, else the rule label, else ``low``."""
    names = [name for name in dict.fromkeys((label_col, "severity_label")) if name in records.columns]
    known = [F.when(F.col(name).isin(*fixed.SEVERITIES), F.col(name)) for name in names]
    return F.coalesce(*known, F.lit("low"))


def _prepared(records: DataFrame, label_col: str) -> DataFrame:
    return records.withColumns(
        {
            "is_emergency": F.col("is_emergency").cast("boolean"),
            "_label": _label(records, label_col),
        }
    )


def all_profiles(spark: SparkSession) -> DataFrame:
    """Every combination of the values a clean record can have in the ``PROFILE`` columns."""
    values = {
        "congestion": fixed.CONGESTION_LEVELS,
        "vehicle_type": fixed.VEHICLE_TYPES,
        "weather": fixed.WEATHER_CONDITIONS,
        "is_emergency": [False, True],
        "_label": fixed.SEVERITIES,
    }
    rows = spark.range(1).select()
    for name in PROFILE:
        rows = rows.select("*", F.explode(F.array(*map(F.lit, values[name]))).alias(name))
    return rows


def context_table(profiles: DataFrame, policies: DataFrame, protocols: DataFrame) -> DataFrame:
    """The three retrieved texts of each profile; retrieval runs once per distinct query text."""
    severity = incident_severity(F.col("_label"), F.col("is_emergency"), F.col("congestion"))
    profiles = pin(profiles).withColumns(
        {
            "_vehicle_query": vehicle_query(),
            "_incident_query": incident_query(severity),
            "_signal_query": signal_query(severity, recommended_action(severity)),
        }
    )

    def asked(query_col: str) -> DataFrame:
        return profiles.select(F.col(query_col).alias("query")).distinct()

    # Vehicle and signal queries go to the same documents, so one retrieval serves both.
    policy_queries = asked("_vehicle_query").union(asked("_signal_query"))
    from_policies = pin(retrieve(policy_queries, policies, k=2).select("query", "rank", "text"))
    from_protocols = retrieve(asked("_incident_query"), protocols, k=1)
    wanted = [
        ("_vehicle_query", "vehicle_context", from_policies, 2, 80, fixed.NO_POLICY_TEXT),
        ("_incident_query", "protocol", from_protocols, 1, 100, fixed.NO_PROTOCOL_TEXT),
        ("_signal_query", "signal_context", from_policies, 1, 80, fixed.NO_TIMING_TEXT),
    ]
    texts = profiles
    for query_col, name, found, k, width, default in wanted:
        cut = cut_texts(asked(query_col), found, k, width, default).toDF(query_col, name)
        texts = texts.join(cut, query_col, "left")
    return texts.drop(*[query_col for query_col, *_ in wanted])


def nearest_table(edges: DataFrame, targets: DataFrame, default: str) -> DataFrame:
    """The nearest target of each node of the graph, as ``intersection_id, _nearest``."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nearest_target(nodes, edges, targets, default).select(
        F.col("node").alias("intersection_id"), F.col("target").alias("_nearest")
    )


@dataclass(frozen=True)
class Lookups:
    """The tables that decisions look up, worked out and measured once."""

    contexts: DataFrame
    nearest: DataFrame
    neighbors: NeighborLists
    default_target: str
    small_contexts: bool
    small_nearest: bool


def lookups(
    profiles: DataFrame, edges: DataFrame, targets: DataFrame, policies: DataFrame, protocols: DataFrame, default_target: str
) -> Lookups:
    """What records of ``profiles`` need to be decided; the graph and the corpora are not read after this."""
    contexts = store(context_table(profiles, policies, protocols), "contexts")
    nearest = store(nearest_table(edges, targets, default_target), "nearest")
    return Lookups(
        contexts, nearest, neighbor_lists(edges), default_target, fits_broadcast(contexts), fits_broadcast(nearest)
    )


def vehicle_message(context: Column) -> Column:
    # --- fixed values: wording of the vehicle message ---
    return F.format_string(
        "[VA] Intersection %s (zone: %s) — %s at %.1f km/h. Congestion: %s. Weather: %s. "
        "Period: %s. Risk score: %.1f. Policy context: %s.",
        "intersection_id",
        "zone",
        "vehicle_type",
        one_decimal(F.col("speed_kmh")),
        "congestion",
        "weather",
        "hour_bin",
        one_decimal(F.col("risk_score")),
        context,
    )


def vehicle_struct() -> Column:
    alerts = F.when(
        F.col("risk_score") >= 75,
        F.transform(
            "neighbors",
            lambda n: alert_text(n, F.col("intersection_id"), one_decimal(F.col("risk_score"))),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return F.struct(
        F.lit(fixed.VEHICLE_AGENT).alias("agent"),
        vehicle_message(F.col("vehicle_context")).alias("message"),
        alerts.alias("alerts"),
        F.col("risk_score").alias("risk"),
        "neighbors",
    )


def incident_struct() -> Column:
    """Reads ``_severity`` and ``_action``."""
    severity = F.col("_severity")
    return F.struct(
        F.lit(fixed.INCIDENT_AGENT).alias("agent"),
        "intersection_id",
        severity.alias("severity"),
        F.col("_label").alias("spark_predicted_sev"),
        "risk_score",
        "is_emergency",
        F.col("_action").alias("recommended_action"),
        "protocol",
        F.when(is_serious(severity), F.col("_nearest")).alias("nearest_hospital"),
        ((F.col("risk_score") >= 50) & is_serious(severity)).alias("va_risk_confirmed"),
    )


def signal_struct() -> Column:
    """Reads ``_severity`` and ``_action``."""
    severity, action, emergency = F.col("_severity"), F.col("_action"), F.col("is_emergency")
    timing = F.struct(
        *[phase_seconds(i, severity, action, emergency).alias(n) for i, n in enumerate(["green", "yellow", "red"])]
    )
    return F.struct(
        F.lit(fixed.SIGNAL_AGENT).alias("agent"),
        "intersection_id",
        severity.alias("severity"),
        action.alias("action"),
        timing.alias("timing_sec"),
        decision_text(F.col("intersection_id"), action, emergency).alias("decision"),
        F.col("signal_context").alias("policy_context"),
        "is_emergency",
    )


def decide(
    records: DataFrame,
    edges: DataFrame,
    targets: DataFrame,
    policies: DataFrame,
    protocols: DataFrame,
    default_target: str = fixed.DEFAULT_HOSPITAL,
    label_col: str = "severity_label",
) -> DataFrame:
    """``event_id`` and ``part`` with the nested ``va``, ``ida`` and ``tla`` results of every record.

    A record has one row, of part 0, unless its intersection has more neighbours than one list takes: then each
    further part holds the next neighbours and alerts and repeats the rest.

    Only small tables (profiles, graph nodes) are computed on the way; the records themselves pass
    through one chain of lookups and expressions and are never collected. What is retrieved depends on five categorical
    columns only, whose distinct combinations are taken in one pass.
    """
    profiles = _prepared(records, label_col).select(*PROFILE).distinct()
    return decide_by(records, lookups(profiles, edges, targets, policies, protocols, default_target), label_col)


def decide_by(records: DataFrame, tables: Lookups, label_col: str = "severity_label") -> DataFrame:
    """``decide`` with the tables it looks up; runs no job of its own, so it also serves the micro-batches of a stream."""
    known = lookup(_prepared(records, label_col), tables.contexts, PROFILE, small=tables.small_contexts)
    near = lookup(attach_neighbors(known, tables.neighbors), tables.nearest, ["intersection_id"], small=tables.small_nearest)
    enriched = near.withColumn("_nearest", F.coalesce("_nearest", F.lit(tables.default_target)))
    severity = incident_severity(F.col("_label"), F.col("is_emergency"), F.col("congestion"))
    ruled = enriched.withColumn("_severity", severity).withColumn("_action", recommended_action(F.col("_severity")))
    return ruled.select(
        "event_id", "part", vehicle_struct().alias("va"), incident_struct().alias("ida"), signal_struct().alias("tla")
    )


def summarize(decisions: DataFrame) -> DataFrame:
    """The short form of each decision."""
    return decisions.where("part = 0").select(
        "event_id",
        F.col("tla.intersection_id").alias("intersection_id"),
        F.col("ida.severity").alias("severity"),
        F.col("tla.action").alias("action"),
        F.col("tla.timing_sec.green").alias("green"),
        F.col("tla.timing_sec.red").alias("red"),
        F.substring("tla.decision", 1, 70).alias("decision"),
    )
