"""Road graph as edge tables: successors, hop counts, nearest target, spillover.

``edges`` has ``src``, ``dst`` and ``ord`` (insertion order); ``targets`` has ``node`` and ``ord``
(listing order).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.operators.lookup import fits_broadcast, lookup, measured, spread_join
from kerbline.session import pin, store

LISTED_SUCCESSORS = 10_000
LEVELS_PER_STORE = 10


def successors(edges: DataFrame) -> DataFrame:
    """One row per node and successor, with its place in insertion order."""
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbor"), "ord")


def successor_lists(edges: DataFrame, listed: int = LISTED_SUCCESSORS) -> DataFrame:
    """``node, part, hub, neighbors``: the successors of each node in insertion order, for nested output.

    A node with up to ``listed`` successors has one row. One with more (a hub) has them in several rows, by ranges
    of ``listed`` insertion numbers; ``part`` counts those ranges from 0. ``ord`` has to be unique per node.
    """
    degrees = edges.groupBy("src").agg(F.count(F.lit(1)).alias("_degree"), F.min("ord").alias("_first"))
    sized = lookup(edges, pin(degrees), ["src"])
    hub = F.col("_degree") > listed
    part = F.when(hub, F.floor(F.col("ord") / listed) - F.floor(F.col("_first") / listed)).otherwise(0)
    parts = sized.select("src", "dst", "ord", hub.alias("hub"), part.cast("int").alias("part")).groupBy("src", "part", "hub")
    ordered = F.sort_array(F.collect_list(F.struct("ord", "dst")))
    return parts.agg(ordered.alias("pairs")).select(
        F.col("src").alias("node"), "part", "hub", F.col("pairs.dst").alias("neighbors")
    )


def hop_counts(edges: DataFrame, targets: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Fewest directed hops from each source to each target it can reach, target itself at 0."""
    start = targets.select(F.col("node").alias("source"), F.col("node").alias("target")).distinct()

    def step(frontier: DataFrame, small: bool) -> DataFrame:
        arrived = frontier.withColumnRenamed("source", "dst")
        return spread_join(edges.select("src", "dst"), arrived, "dst", "src", small).select(
            F.col("src").alias("source"), "target"
        ).distinct()

    return _by_levels(start, step, ["source", "target"], max_hops).select("source", "target", "hops")


def nearest_target(
    nodes: DataFrame, edges: DataFrame, targets: DataFrame, default: str, max_hops: int | None = None
) -> DataFrame:
    """Nearest target per node; among equally near ones the first listed; ``default`` if none.

    One search backwards from all targets at once: a node first reached at some level takes the
    first-listed target among the successors that were reached one level earlier. The state is one
    row per node, whatever the number of targets.
    """
    start = targets.groupBy("node").agg(F.min(F.struct("ord", F.col("node").alias("target"))).alias("best"))

    def step(frontier: DataFrame, small: bool) -> DataFrame:
        arrived = frontier.select(F.col("node").alias("dst"), "best")
        reached = spread_join(edges.select("src", "dst"), arrived, "dst", "src", small)
        return reached.groupBy(F.col("src").alias("node")).agg(F.min("best").alias("best"))

    found = _by_levels(start, step, ["node"], max_hops)
    return nodes.join(found, "node", "left").select(
        "node", F.coalesce("best.target", F.lit(default)).alias("target"), "hops"
    )


def _by_levels(start: DataFrame, step, keys: list[str], max_hops: int | None) -> DataFrame:
    """Breadth-first levels until nothing new is reached; each level is stored and measured once."""
    frontier = store(start.withColumn("hops", F.lit(0)), "level")
    reached = frontier
    level = 0
    while max_hops is None or level < max_hops:
        rows, small = measured(frontier)
        if rows == 0:
            break
        level += 1
        fresh = step(frontier.drop("hops"), small).join(reached.select(*keys), keys, "left_anti")
        frontier = store(fresh.withColumn("hops", F.lit(level)), "level")
        reached = reached.unionByName(frontier)
        if level % LEVELS_PER_STORE == 0:
            reached = store(reached, "levels")
    return reached


@dataclass(frozen=True)
class NeighborLists:
    """Successor lists by ``intersection_id``: of nodes with one list, and of hubs, whose lists have several parts."""

    one: DataFrame
    hubs: DataFrame | None
    #: Nodes of ``one`` and hubs alike, a hub without its lists.
    marks: DataFrame
    small_marks: bool
    small_hubs: bool


def neighbor_lists(edges: DataFrame, listed: int = LISTED_SUCCESSORS) -> NeighborLists:
    """The lists that ``attach_neighbors`` looks up, worked out and measured once."""
    lists = store(successor_lists(edges, listed).withColumnRenamed("node", "intersection_id"), "neighbors")
    one = lists.where(~F.col("hub")).drop("hub")
    hubs = lists.where("hub").drop("hub")
    if hubs.isEmpty():
        return NeighborLists(one, None, one, fits_broadcast(one), False)
    marks = one.withColumn("_hub", F.lit(False)).unionByName(
        hubs.select("intersection_id").distinct().withColumn("_hub", F.lit(True)), allowMissingColumns=True
    )
    marks = store(marks, "neighbor-marks")
    return NeighborLists(one, hubs, marks, fits_broadcast(marks), fits_broadcast(hubs))


def attach_neighbors(records: DataFrame, lists: NeighborLists) -> DataFrame:
    """Add the list of neighbouring nodes and its ``part``; an unknown intersection has an empty one.

    A record at a hub becomes one row per part of the hub's list, so that no list outgrows a row.
    """
    empty = F.array().cast(lists.one.schema["neighbors"].dataType)
    found = lookup(records, lists.marks, ["intersection_id"], small=lists.small_marks)
    if lists.hubs is not None:
        at_hubs = found.where(F.col("_hub")).drop("_hub", "neighbors", "part")
        spread = spread_join(at_hubs, lists.hubs, "intersection_id", "event_id", small=lists.small_hubs)
        found = found.where(~F.coalesce("_hub", F.lit(False))).drop("_hub").unionByName(spread)
    return found.withColumns({"neighbors": F.coalesce("neighbors", empty), "part": F.coalesce("part", F.lit(0))})


def with_neighbors(records: DataFrame, edges: DataFrame, listed: int = LISTED_SUCCESSORS) -> DataFrame:
    """``attach_neighbors`` with the successors of ``edges``."""
    return attach_neighbors(records, neighbor_lists(edges, listed))


def spillover(records: DataFrame, edges: DataFrame, threshold: float = 75) -> DataFrame:
    """One row per high-risk record and neighbour, with the alert text."""
    risky = records.where(F.col("risk_score") >= threshold)
    near = successors(edges).select(F.col("node").alias("intersection_id"), "neighbor", F.col("ord").alias("edge_ord"))
    return spread_join(risky, near, "intersection_id", "event_id").select(
        "event_id",
        "intersection_id",
        "neighbor",
        "edge_ord",
        alert_text("neighbor", "intersection_id", "risk_score").alias("alert"),
    )


def alert_text(neighbor, intersection, risk):
    return F.format_string("[VA→%s] High-risk spillover warning from %s (risk=%.1f)", neighbor, intersection, risk)
