"""Merkle dataset manifest with octopus multiproofs (operator 12).

Every row is a leaf: the SHA-256 of its encoded fields. The leaves of a group (column ``group_col``) form a tree in the
order of their ids: while more than one node remains, each run of ``ARITY`` consecutive nodes (the last run may have
fewer, even one) becomes the hash of its nodes' hex digests. The groups' subroots, ordered by group (null first, text
by its UTF-8 bytes), form the tree above them in the same way; its root stands for the whole table.

Leaves are dealt to partitions of ``ARITY ** LEVELS`` consecutive leaves, so that a hot group is many bounded pieces.
Trees are built ``LEVELS`` levels at a time. For proofs each leaf partition works out the minimal union of node coordinates
that its leaves need and that cannot be derived from them, the union is fetched once by a join with the stored nodes, shared
interior nodes are derived, and the proof of each leaf is expanded in the partition. Coordinates that many partitions
ask for (those near the root) are looked up by broadcast, at most ``common.HOT_SHARE`` of them.

Order and odd rows: a null id comes before all others; rows that share an id are ordered by their leaves (equal leaves are
interchangeable). A null group is a group of its own. Null fields are encoded as ``-``, so that they differ from empty ones.
An empty table has no leaves, no nodes and no proofs. Rows are never moved with their texts, only with their digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.common import join_hot, ship_package, stored
from kerbline.operators.lookup import lookup

ARITY = 8
#: Levels of a tree that one task builds: a partition holds up to ``ARITY ** LEVELS`` nodes.
LEVELS = 4
#: Number of the tree above the groups' subroots.
TOP = -1
#: Hex digits of a digest.
DIGITS = 64

NODE = "tree long, level int, idx long, hash string"


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon, and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    """Lowercase hex digest of a row's encoded fields."""
    return F.sha2(F.concat(*map(encoded, values)), 256)


def digest(hashes: Iterable[str]) -> str:
    return hashlib.sha256("".join(hashes).encode()).hexdigest()


def height(leaves: int) -> int:
    """Levels above the leaves."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // ARITY), levels + 1
    return levels


def missing(leaves: Iterable[int], size: int) -> list[tuple[int, int]]:
    """The least set of nodes ``(level, idx)`` that proofs of all ``leaves`` of a tree of ``size`` leaves need besides them."""
    known, level, wanted = set(leaves), 0, []
    while size > 1:
        runs = {i // ARITY for i in known}
        places = (i for run in sorted(runs) for i in range(run * ARITY, min(run * ARITY + ARITY, size)))
        wanted += [(level, i) for i in places if i not in known]
        known, size, level = runs, -(-size // ARITY), level + 1
    return wanted


# ---- leaves in order ----------------------------------------------------------------------------


def ranked(rows: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """``rows`` stored with ``pos``, the place within its ``key``, without bringing a key together in one task.

    Rows are range partitioned by key and order and numbered where they lie; a key's place in a partition is moved by
    the key's rows in earlier partitions, of which there is one count per key and partition.
    """
    rows = rows.repartitionByRange(F.col(key).asc_nulls_first(), *order)
    rows = rows.sortWithinPartitions(F.col(key).asc_nulls_first(), *order)
    rows = stored(rows.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), name)
    spans = rows.groupBy(key, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0))).drop("__rows")
    found = lookup(rows, stored(spans, f"{name}-spans"), [key, "__part"])
    pos = F.col("__at") - F.col("__first") + F.col("__before")
    return found.withColumn("pos", pos).drop("__part", "__at", "__first", "__before")


# ---- building -----------------------------------------------------------------------------------


def levels_above(first: int, hashes: list[str], levels: int) -> list[tuple[int, int, str]]:
    """``level, idx, hash`` of the nodes above consecutive nodes that begin at the aligned index ``first``."""
    made = []
    for level in range(1, levels + 1):
        hashes = [digest(hashes[i : i + ARITY]) for i in range(0, len(hashes), ARITY)]
        first //= ARITY
        made += [(level, first + i, value) for i, value in enumerate(hashes)]
    return made


def tier(base: int, levels: int):
    """Nodes of the ``levels`` levels above the nodes of level ``base``, for a partition of them."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        tree, first = int(rows["tree"].iloc[0]), int(rows["idx"].iloc[0])
        above = min(levels, height(int(rows["size"].iloc[0])) - base)
        made = levels_above(first, rows["hash"].tolist(), above)
        return pd.DataFrame(
            [(tree, base + level, idx, value) for level, idx, value in made], columns=["tree", "level", "idx", "hash"]
        )

    return build


def interior(leaves: DataFrame, name: str, levels: int) -> DataFrame:
    """All nodes above ``leaves`` (``tree, idx, hash, size``; ``size`` is the number of the tree's leaves)."""
    ship_package(leaves.sparkSession)
    largest = leaves.agg(F.max("size")).first()[0] or 1
    tiers, below, base = [], leaves, 0
    while not tiers or base < height(largest):
        parts = below.where(F.col("size") > ARITY**base).groupBy("tree", F.floor(F.col("idx") / ARITY**levels))
        tiers.append(stored(parts.applyInPandas(tier(base, levels), NODE), f"{name}-{base}"))
        base += levels
        sizes = leaves.select("tree", "size").distinct()
        below = lookup(tiers[-1].where(F.col("level") == base), sizes, ["tree"])
    nodes = tiers[0]
    for more in tiers[1:]:
        nodes = nodes.unionByName(more)
    return nodes


def roots(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """``tree, hash`` of each tree's root; the leaf itself where there is but one."""
    alone = leaves.where("size = 1").select("tree", "hash")
    last = nodes.groupBy("tree").agg(F.max("level").alias("level"))
    return alone.unionByName(nodes.join(last, ["tree", "level"]).select("tree", "hash"))


@dataclass
class Manifest:
    """The stored trees: leaves (``tree, pos`` and what they came with), interior nodes, subroots and the root."""

    leaves: DataFrame
    nodes: DataFrame
    #: ``tree``, the group, ``size`` and ``subroot``; one row per group.
    groups: DataFrame
    root: str | None
    levels: int = LEVELS

    def all_nodes(self) -> DataFrame:
        below = self.leaves.select("tree", F.lit(0).alias("level"), F.col("pos").alias("idx"), F.col("leaf").alias("hash"))
        top = self.groups.select(
            F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("idx"), F.col("subroot").alias("hash")
        )
        return self.nodes.unionByName(below).unionByName(top)


def build(
    leaves: DataFrame, id_col: str = "doc_id", group_col: str = "lang", leaf_col: str = "leaf", levels: int = LEVELS
) -> Manifest:
    """The manifest of ``leaves``, which has an id, a group and a digest per row; other columns stay with the leaves."""
    rows = leaves.withColumnsRenamed({id_col: "id", group_col: "group", leaf_col: "leaf"})
    rows = stored(rows.withColumn("__row", F.monotonically_increasing_id()), "merkle-hashes")
    sizes = rows.groupBy("group").agg(F.count("*").alias("size")).withColumn("__all", F.lit(0))
    groups = ranked(sizes, "__all", [F.col("group").asc_nulls_first()], "merkle-groups")
    groups = stored(groups.select(F.col("pos").alias("tree"), "group", "size"), "merkle-trees")
    order = [F.col("id").asc_nulls_first(), F.col("leaf"), F.col("__row")]
    placed = ranked(rows, "group", order, "merkle-places").drop("__row")
    placed = stored(lookup(placed, groups, ["group"]), "merkle-leaves")
    nodes = interior(placed.select("tree", F.col("pos").alias("idx"), F.col("leaf").alias("hash"), "size"), "merkle-nodes", levels)
    under = roots(placed.select("tree", F.col("leaf").alias("hash"), "size"), nodes).withColumnRenamed("hash", "subroot")
    groups = stored(groups.join(under, "tree"), "merkle-subroots")
    trees = groups.count()
    top = groups.select(
        F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("subroot").alias("hash"), F.lit(trees).alias("size")
    )
    above = interior(top, "merkle-top", levels)
    last = roots(top, above).first()
    return Manifest(placed, nodes.unionByName(above), groups, last.hash if last else None, levels)


# ---- proofs -------------------------------------------------------------------------------------


def coordinates(trees: int):
    """What the leaves of a partition need: rows of the partition and of a node's tree, level and index."""

    def wanted(rows: pd.DataFrame) -> pd.DataFrame:
        tree, size = int(rows["tree"].iloc[0]), int(rows["size"].iloc[0])
        part = int(rows["part"].iloc[0])
        found = [(tree, part, tree, *node) for node in missing(rows["pos"].tolist(), size)]
        found += [(tree, part, TOP, *node) for node in missing([tree], trees)]
        return pd.DataFrame(found, columns=["tree", "part", "of", "level", "idx"])

    return wanted


def derived(known: dict[int, str], size: int, fetched: dict[tuple[int, int], str]) -> list[dict[int, str]]:
    """The nodes by index, level by level, from leaves and what was fetched; the root's level is left out."""
    levels, level = [], 0
    while size > 1:
        nodes = known | {idx: value for (at, idx), value in fetched.items() if at == level}
        levels.append(nodes)
        runs = sorted({i // ARITY for i in known})
        known = {
            run: digest(nodes[i] for i in range(run * ARITY, min(run * ARITY + ARITY, size))) for run in runs
        }
        size, level = -(-size // ARITY), level + 1
    return levels


def siblings(levels: list[dict[int, str]], at: int) -> list[str]:
    """Per level the digests of the other nodes of the run, left to right, as one text."""
    found = []
    for nodes in levels:
        run = at // ARITY * ARITY
        found.append("".join(nodes[i] for i in range(run, run + ARITY) if i != at and i in nodes))
        at //= ARITY
    return found


def places(at: int, levels: int) -> list[int]:
    return [at // ARITY**level % ARITY for level in range(levels)]


def expand(trees: int, columns: list[str]):
    """The proofs of a partition's leaves from the nodes it fetched."""

    def proofs(rows: pd.DataFrame, fetched: pd.DataFrame) -> pd.DataFrame:
        tree, size = int(rows["tree"].iloc[0]), int(rows["size"].iloc[0])
        got: dict[int, dict[tuple[int, int], str]] = {tree: {}, TOP: {}}
        for of, level, idx, value in zip(fetched["of"], fetched["level"], fetched["idx"], fetched["hash"], strict=True):
            got[int(of)][int(level), int(idx)] = value
        levels = derived(dict(zip(rows["pos"].tolist(), rows["leaf"], strict=True)), size, got[tree])
        # The subroot itself is no part of a proof above it; any text stands for it.
        above = derived({tree: ""}, trees, got[TOP])
        shared, shared_places = siblings(above, tree), places(tree, len(above))
        # A run's leaves share all that lies above the run.
        upper: dict[int, list[str]] = {}
        proof, place = [], []
        for at in rows["pos"].tolist():
            run = at // ARITY
            if run not in upper:
                upper[run] = siblings(levels[1:], run) + shared
            proof.append(siblings(levels[:1], at) + upper[run])
            place.append(places(at, len(levels)) + shared_places)
        return rows[columns].assign(proof=proof, places=place)

    return proofs


def prove(manifest: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """``wanted`` (rows of ``manifest.leaves``, all by default) with ``proof``, ``places``, ``subroot`` and ``root``.

    ``proof`` has one text per level, from the leaf's run up to the run below the root: the digests of the run's other
    nodes, left to right. ``places`` has the place of the leaf's own branch in each run.
    """
    leaves = (manifest.leaves if wanted is None else wanted).withColumn("part", F.floor(F.col("pos") / ARITY**manifest.levels))
    trees = manifest.groups.count()
    asked = leaves.select("tree", "part", "pos", "size").groupBy("tree", "part")
    asked = asked.applyInPandas(coordinates(trees), "tree long, part long, of long, level int, idx long")
    asked = stored(asked, "merkle-coordinates")
    levels = [row.level for row in asked.select("level").distinct().collect()]
    nodes = manifest.all_nodes().where(F.col("level").isin(levels)).withColumnRenamed("tree", "of")
    fetched = join_hot(asked, nodes, ["of", "level", "idx"])
    columns = [name for name in leaves.columns if name != "part"]
    schema = ", ".join(f"`{name}` {leaves.schema[name].dataType.simpleString()}" for name in columns)
    both = leaves.groupBy("tree", "part").cogroup(fetched.groupBy("tree", "part"))
    proven = both.applyInPandas(expand(trees, columns), f"{schema}, proof array<string>, places array<int>")
    subroots = manifest.groups.select("tree", "subroot")
    return lookup(proven, subroots, ["tree"]).withColumn("root", F.lit(manifest.root).cast("string"))


def fold_proof(leaf: Column, proof: Column, place: Column) -> Column:
    """The root that a leaf and its proof give."""
    steps = F.arrays_zip(proof.alias("others"), place.alias("place"))

    def step(current: Column, run: Column) -> Column:
        left = run["place"] * DIGITS
        others = run["others"]
        return F.sha2(F.concat(others.substr(F.lit(1), left), current, others.substr(left + 1, F.length(others))), 256)

    return F.aggregate(steps, leaf, step)


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(proof, ""), 256)

