"""Filter interaction audit by forward-backward path counting (operator 11).

A set of filters is applied in some order; what each removes depends on the order. The states of an audit are the
subsets of filters already applied, its edges add one filter to a state. A document's outcome depends on its failure
mask (the filters it fails) only, so documents are counted once per part and mask, and every edge's numbers are sums over
masks: what the edge removes, keeps, and loses. Orders are paths through the lattice: ``forward`` counts those that reach
a state and ``backward`` those that leave it, so an edge lies on ``forward * backward`` orders. These weights times the edge's
removals, summed over the edges of a filter, are its Shapley total; the steps of each order are read from the same edges.

Documents are read once. Copies (filter ``E``: the text of a smaller id) are found by the text's SHA-256 over the whole
table: documents are combined by digest, part and labels before they meet, so a text that holds a third of all rows
is a few rows per task.

Odd rows: null and empty texts are the same text. A null id is larger than every id; rows that share their text's smallest id
are all first. Of several labels of an id the largest counts, a null label counts as 0. A null part is the empty string. An
empty table has no parts and so no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.llm.common import map_arrow, stored

#: Filters decided by a document alone, in the order of their bits; copies have the next letter.
MIN_WORDS = 50
DISTINCT_PERCENT = 65
UPPER_PERCENT = 5
SYMBOLS = re.compile(rb"[#$%&*|]")
UPPER = bytes(range(65, 91))
LETTERS = "ABCDE"
#: Orders grow with the factorial of the filters; the audit lists them all.
MOST_FILTERS = 7


def failures(text: str | None) -> int:
    """Mask of the filters a whole text fails: few words, repeated words, capitals, symbols."""
    data = (text or "").encode()
    words = data.split()
    few = len(words) < MIN_WORDS
    repeated = 100 * len(set(words)) < DISTINCT_PERCENT * len(words)
    capitals = 100 * (len(data) - len(data.translate(None, UPPER))) > UPPER_PERCENT * len(text or "")
    return few | repeated << 1 | capitals << 2 | (SYMBOLS.search(data) is not None) << 3


def masks(docs: DataFrame, part_col: str, id_col: str, text_col: str, fails: Callable[[str | None], int] = failures) -> DataFrame:
    """``part, id, sha, mask`` per row."""

    def work():
        def compute(texts: pa.Array) -> list[pa.Array]:
            # Each text becomes a Python value by itself.
            return [pa.array((fails(text.as_py()) for text in texts), pa.int32(), size=len(texts))]

        return compute

    rows = docs.select(
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("sha"),
    )
    return map_arrow(rows, ["text"], ["part", "id", "sha"], [T.StructField("mask", T.IntegerType())], work)


def label_flags(labels: DataFrame, id_col: str, good_col: str, toxic_col: str) -> DataFrame:
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("of"))
    return known.agg(F.max((F.col(good_col) == 1).cast("int")).alias("good"), F.max((F.col(toxic_col) == 1).cast("int")).alias("toxic"))


def counted(rows: DataFrame, flags: DataFrame, copy_bit: int) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by part and failure mask, the copies' filter included."""
    # Repeated rows are one row from here on, so that of each group one row holds the smallest id.
    single = rows.groupBy("id", "part", "sha", "mask").agg(F.count("*").alias("n"))
    single = single.join(flags, single["id"] == flags["of"], "left")
    flagged = single.withColumns({name: F.coalesce(name, F.lit(0)) for name in ("good", "toxic")})
    lowest = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "n")).alias("lowest")
    groups = flagged.groupBy("sha", "mask", "part", "good", "toxic").agg(F.sum("n").alias("n"), lowest)
    first = F.struct(F.col("lowest.unknown").alias("unknown"), F.col("lowest.id").alias("id"))
    # A text has a row per part and labels here, however often it occurs.
    least = F.min(first).over(Window.partitionBy("sha"))
    firsts = F.when(F.col("lowest.id").isNull() & least["unknown"], F.col("n"))
    firsts = firsts.when(F.col("lowest.id") == least["id"], F.col("lowest.n")).otherwise(0)
    kinds = groups.withColumn("firsts", firsts).select(
        "part",
        "good",
        "toxic",
        F.inline(
            F.array(
                F.struct(F.col("mask").alias("mask"), F.col("firsts").alias("n")),
                F.struct(F.col("mask").bitwiseOR(F.lit(1 << copy_bit)).alias("mask"), (F.col("n") - F.col("firsts")).alias("n")),
            )
        ),
    )
    kinds = kinds.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
    return kinds.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )


def path_counts(filters: int) -> tuple[list[int], list[int]]:
    """Per state, the number of orders that reach it from none applied, and that leave it to all applied."""
    states = 1 << filters
    forward, backward = [1] + [0] * (states - 1), [0] * (states - 1) + [1]
    for state in range(states):
        for bit in range(filters):
            if not state >> bit & 1:
                forward[state | 1 << bit] += forward[state]
    for state in reversed(range(states)):
        for bit in range(filters):
            if not state >> bit & 1:
                backward[state] += backward[state | 1 << bit]
    return forward, backward


def edges(letters: str) -> list[tuple[int, int, int, list[tuple[str, int]]]]:
    """``state, bit, weight, steps`` per edge; ``steps`` lists the orders on it and the step they take there."""
    forward, backward = path_counts(len(letters))
    steps: dict[tuple[int, int], list[tuple[str, int]]] = {}
    for order in permutations(range(len(letters))):
        state = 0
        for step, bit in enumerate(order, 1):
            steps.setdefault((state, bit), []).append(("".join(letters[i] for i in order), step))
            state |= 1 << bit
    return [(state, bit, forward[state] * backward[state | 1 << bit], found) for (state, bit), found in sorted(steps.items())]


EDGE = "state int, bit int, weight long, steps array<struct<filter_order: string, step: int>>"
SUMS = ["kept", "removed", "fails", "unique_fails", "good_lost", "toxic_lost"]


def edge_sums(counts: DataFrame, filters: int) -> DataFrame:
    """``part, state, bit`` and the sums of every edge, zeros included."""
    states, bits = F.sequence(F.lit(0), F.lit((1 << filters) - 1)), F.sequence(F.lit(0), F.lit(filters - 1))
    every = counts.select("*", F.explode(states).alias("state")).select("*", F.explode(bits).alias("bit"))
    every = every.withColumn("own", F.call_function("shiftleft", F.lit(1), F.col("bit")))
    every = every.where(F.col("state").bitwiseAND(F.col("own")) == 0)
    passed = F.col("mask").bitwiseAND(F.col("state")) == 0
    fails = F.col("mask").bitwiseAND(F.col("own")) != 0

    def total(condition: Column, value: str) -> Column:
        return F.sum(F.when(condition, F.col(value)).otherwise(0))

    return every.groupBy("part", "state", "bit").agg(
        total(passed & ~fails, "n").alias("kept"),
        total(passed & fails, "n").alias("removed"),
        total(fails, "n").alias("fails"),
        total(F.col("mask") == F.col("own"), "n").alias("unique_fails"),
        total(passed & fails, "good").alias("good_lost"),
        total(passed & fails, "toxic").alias("toxic_lost"),
    )


def audit_counts(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """The audit of ``counts`` (``part, mask, n, good, toxic``): one row per part, order and step."""
    if len(letters) > MOST_FILTERS:
        raise ValueError(f"{len(letters)} filters: an audit lists all orders of at most {MOST_FILTERS}")
    lattice = counts.sparkSession.createDataFrame(edges(letters), EDGE)
    # One row per edge, of which there are ``n * 2 ** (n - 1)``.
    sums = edge_sums(counts, len(letters)).join(F.broadcast(lattice), ["state", "bit"])
    own = Window.partitionBy("part", "bit")
    sums = sums.withColumn("shapley", F.sum(F.col("weight") * F.col("removed")).over(own))
    return sums.select("*", F.inline("steps")).select(
        "part",
        "filter_order",
        "step",
        "kept",
        "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails",
        "good_lost",
        "toxic_lost",
        "shapley",
    )


def audit(
    docs: DataFrame,
    labels: DataFrame,
    part_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    good_col: str = "quality",
    toxic_col: str = "toxic",
) -> DataFrame:
    """The audit of the five filters over ``docs``; ``labels`` says which documents are good or toxic."""
    flags = label_flags(labels, id_col, good_col, toxic_col)
    counts = counted(masks(docs, part_col, id_col, text_col), flags, len(LETTERS) - 1)
    return audit_counts(stored(counts, "audit-counts"))
