"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import join_groups, stored


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (columns ``a``, ``b``): the smallest node it reaches.

    Each round points the larger neighbours of a node to its smallest neighbour, then the smaller ones; rounds
    end when the links no longer change, after a number that grows with the logarithm of the longest path. A
    round keeps at most as many links as there are. Smallest neighbours are combined before the shuffle, and nodes that
    hold more than one in ``common.HOT_SHARE`` of the links are looked up by broadcast. Each round is stored in the
    shared folder.
    """
    edges = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct()
    edges = stored(edges, "links")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("lo"), F.col("hi"))).toDF("node", "other")
        smallest = both.groupBy("node").agg(F.min("other").alias("low"), F.count("*").alias("held"))
        smallest = smallest.withColumn("low", F.least("low", "node"))
        larger = join_groups(both.where("other > node"), smallest, ["node"], "held", 2 * state[0])
        large = larger.select(F.col("other").alias("hi"), F.col("low").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("low"), F.count("*").alias("held"))
        pairs = join_groups(large, lowest, ["hi"], "held", state[0])
        small = pairs.select(F.when(F.col("lo") == F.col("low"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("low").alias("lo"))
        edges = stored(small.distinct(), "links")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)
