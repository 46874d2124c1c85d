"""Joins of a large table to a smaller one, safe for hot keys at any size of either."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.session import pin

MAX_BROADCAST_ROWS = 500_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
HOT_SHARE = 1000  # a key is hot when it holds more than one in this many rows


def measured(dim: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> tuple[int, bool]:
    """Rows of a table and whether it is small enough to broadcast: one map-side combined aggregate."""
    width = F.octet_length(F.to_json(F.struct("*")))
    seen = dim.agg(F.count(F.lit(1)).alias("rows"), F.sum(width).alias("bytes")).first()
    return seen["rows"], seen["rows"] <= max_rows and (seen["bytes"] or 0) <= MAX_BROADCAST_BYTES


def fits_broadcast(dim: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    return measured(dim, max_rows)[1]


def lookup(
    fact: DataFrame,
    dim: DataFrame,
    keys: list[str],
    max_rows: int = MAX_BROADCAST_ROWS,
    small: bool | None = None,
) -> DataFrame:
    """Left join ``fact`` to ``dim``, which has one row per key; null is a key like any other.

    A small ``dim`` (measured here unless the caller did) is broadcast and ``fact`` is not shuffled.
    Otherwise both are shuffled by key, with the hot keys of ``fact`` split into shards and their rows
    of ``dim`` copied per shard. Besides that, only the key columns of ``fact`` are read once more.
    """
    if fits_broadcast(dim, max_rows) if small is None else small:
        return _left(fact, F.broadcast(dim), keys)
    shards = _hot_shards(fact, keys)
    # A wide row of ``dim`` is copied once per shard of a hot key, at most twice ``HOT_SHARE`` times in all.
    sharded = _sharded(fact, shards, keys, F.struct("*"))
    return _left(sharded, _copied(dim, shards, keys), [*keys, "_shard"]).drop("_shard")


def spread_join(
    many: DataFrame, few: DataFrame, key: str, spread_by: str, small: bool | None = None
) -> DataFrame:
    """Inner join on ``key`` in which ``few`` may hold several rows per key.

    A small ``few`` (measured here unless the caller did) is broadcast. Otherwise both sides are shuffled by key, and
    the hot keys of ``many`` are split into shards by ``spread_by``: only their rows of ``few`` are copied, once per shard.
    """
    if fits_broadcast(few) if small is None else small:
        return many.join(F.broadcast(few), key)
    shards = _hot_shards(many, [key])
    sharded = _sharded(many.where(F.col(key).isNotNull()), shards, [key], F.col(spread_by))
    return sharded.join(_copied(few, shards, [key]), [key, "_shard"]).drop("_shard")


def _hot_shards(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``_shards`` of the hot keys; with that many shards none holds more than the hot share of the rows.

    At most ``HOT_SHARE`` rows, since each stands for more than that share. Only the key columns are read.
    """
    counts = pin(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")))
    total = counts.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    shares = F.col("_rows") * HOT_SHARE
    hot = counts.where(shares > total)
    return hot.select(*keys, F.ceil(shares / F.lit(max(total, 1))).cast("int").alias("_shards"))


def _sharded(df: DataFrame, shards: DataFrame, keys: list[str], spread_by: Column) -> DataFrame:
    """``df`` with its shard; 0 for all keys that are not hot."""
    numbered = df.withColumn("_spread", F.xxhash64(spread_by))
    known = _left(numbered, F.broadcast(shards), keys)
    return known.withColumn("_shard", F.coalesce(F.pmod("_spread", "_shards"), F.lit(0)).cast("int")).drop("_spread", "_shards")


def _copied(df: DataFrame, shards: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with a copy per shard of its key; one for all keys that are not hot."""
    known = _left(df, F.broadcast(shards), keys)
    numbers = F.sequence(F.lit(0), F.coalesce("_shards", F.lit(1)) - 1)
    # Size estimates do not see what an explode adds, so the planner is told not to broadcast.
    return known.withColumn("_shard", F.explode(numbers)).drop("_shards").hint("merge")


def _same(left: str, right: str, keys: list[str]) -> Column:
    return reduce(and_, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def _left(fact: DataFrame, dim: DataFrame, keys: list[str]) -> DataFrame:
    added = [F.col(f"d.{c}") for c in dim.columns if c not in keys]
    return fact.alias("f").join(dim.alias("d"), _same("f", "d", keys), "left").select("f.*", *added)
