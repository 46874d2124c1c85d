"""Streaming de-duplication of events.

``first_rows`` and ``dedup_into`` keep a row of every id, late and untimed ones included: the ids seen are keyed state in
RocksDB, so a micro-batch costs what it holds itself and not what was written before. ``dedup_stream`` keeps its state for a
watermark delay only; rows later than that and rows without a time are no part of its result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SHARDS = 32

#: Keyed state on local disk, of which each micro-batch saves only what it changed.
KEYED_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def timed_events(stream: DataFrame) -> DataFrame:
    """Only rows with a readable event time: a null time would pass any watermark and never leave the state."""
    return stream.where(F.col("event_ts").isNotNull())


def untimed_events(stream: DataFrame) -> DataFrame:
    """The rows that :func:`timed_events` leaves out, for quarantine."""
    return stream.where(F.col("event_ts").isNull())


def dedup_stream(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """One row per ``event_id`` within the watermark delay.

    Two stages: first within a shard, then over all shards. The shard is the input task, so an id
    that holds a large share of the stream is reduced in many tasks to a row per shard before its
    rows meet, and a task that is run again puts its rows in the same shard.
    """
    return (
        timed_events(stream)
        .withColumn("_shard", F.pmod(F.spark_partition_id(), F.lit(SHARDS)))
        .withWatermark("event_ts", delay)
        .dropDuplicatesWithinWatermark(["event_id", "_shard"])
        .dropDuplicatesWithinWatermark(["event_id"])
        .drop("_shard")
    )


# ---- one row of every id ------------------------------------------------------------------------


def first_rows(stream: DataFrame, key: str = "event_id") -> DataFrame:
    """The first row of every ``key`` as keyed state, for output mode ``update``; read a batch of it with :func:`fresh_rows`.

    Of the micro-batch in which a key comes first, the row with the smallest ``event_ts`` counts (then by the other
    columns; rows without a time come last). It is an aggregate, so rows are combined before the shuffle and a key
    that holds a large share of a batch leaves each task as one row. Null keys count as one. Nothing is dropped as late.
    """
    others = [name for name in stream.columns if name != "event_ts"]
    # The time of a micro-batch is part of its checkpoint: a batch that runs again has the same.
    timed = stream.withColumn("_arrived", F.current_timestamp())
    order = F.struct("_arrived", F.col("event_ts").isNull().alias("_untimed"), "event_ts", *others)
    return timed.groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("_row"), F.max("_arrived").alias("_latest"))


def fresh_rows(batch: DataFrame) -> DataFrame:
    """Of the keys that a micro-batch of ``first_rows`` touched, the rows of those that it saw first."""
    names = [name for name in batch.schema["_row"].dataType.names if name not in ("_arrived", "_untimed")]
    return batch.where(F.col("_row._arrived") == F.col("_latest")).select(*(F.col(f"_row.{name}").alias(name) for name in names))


def write_batch(rows: DataFrame, path: str, tag: str, file_format: str = "parquet") -> None:
    """Write a micro-batch to its own folder below ``path``; a batch that runs again replaces that folder only."""
    writer = rows.withColumn("batch", F.lit(tag)).write.mode("overwrite").format(file_format)
    if file_format == "json":
        writer = writer.option("ignoreNullFields", False)
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("batch").save(path)


def batch_tag(batch: DataFrame, batch_id: int) -> str:
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return f"{query}-{batch_id}"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state as ``KEYED_STATE`` says; the session is left as it was."""
    before = {name: spark.conf.get(name, None) for name in KEYED_STATE}
    for name, value in KEYED_STATE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def start_keyed(
    rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None, name: str
) -> StreamingQuery:
    """Start a query over the state of ``first_rows`` that hands every micro-batch to ``write``."""
    writer = rows.writeStream.queryName(name).outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    if trigger:
        writer = writer.trigger(**trigger)
    with keyed_state(rows.sparkSession):
        return writer.start()


def dedup_into(
    stream: DataFrame, path: str, checkpoint: str, key: str = "event_id", trigger: dict | None = None
) -> StreamingQuery:
    """Append the first row of every ``key`` of ``stream`` to Parquet folders below ``path``; nothing is dropped as late.

    A batch reads its own rows and looks its keys up in the state. What other queries wrote below ``path`` before is
    looked up as well. A batch that runs again replaces its own folder.
    """
    earlier: dict[str, DataFrame | None] = {}

    def write(batch: DataFrame, batch_id: int) -> None:
        tag = batch_tag(batch, batch_id)
        if "keys" not in earlier:
            earlier["keys"] = _keys_of_others(batch.sparkSession, path, key, tag)
        fresh = fresh_rows(batch)
        if earlier["keys"] is not None:
            fresh = fresh.join(earlier["keys"], F.col(key).eqNullSafe(F.col("_written")), "left_anti")
        write_batch(fresh, path, tag)

    return start_keyed(first_rows(stream, key), write, checkpoint, trigger, "dedup")


def _keys_of_others(session: SparkSession, path: str, key: str, tag: str) -> DataFrame | None:
    """Keys that other queries than that of ``tag`` have written; None if there are none."""
    try:
        there = session.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    query = tag.rsplit("-", 1)[0]
    # Decided by folder names: folders of this query are not read.
    others = there.where(~F.col("batch").startswith(f"{query}-"))
    return None if others.isEmpty() else others.select(F.col(key).alias("_written"))
