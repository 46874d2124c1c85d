"""Continuous ingest: validate a stream of JSON texts and route it to two outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from kerbline.functions.cells import arrival_date, arrival_hour
from kerbline.functions.rules import OK, PARSE_ERROR
from kerbline.operators.validation import quarantine_records, valid_records, validate

METRICS = "ingest"
STATUSES = ("valid", "invalid", "parse_error")


def checked_stream(stream: DataFrame) -> DataFrame:
    """Validated records with their UTC arrival partition, and counts per status as stream metrics.

    The arrival time is that of the micro-batch, which its checkpoint records: a batch that is run
    again gets the same folders.
    """
    arrived = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    reason = F.col("reason")
    return (
        validate(stream.select("value"))
        .withColumns({"date": arrival_date(arrived), "hour": arrival_hour(arrived)})
        .withColumn("timestamp", F.date_format(arrived, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .observe(
            METRICS,
            F.count_if(reason == OK).alias("valid"),
            F.count_if((reason != OK) & (reason != PARSE_ERROR)).alias("invalid"),
            F.count_if(reason == PARSE_ERROR).alias("parse_error"),
        )
    )


def _route(good_path: str, bad_path: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        # The folder name holds the query and the batch, and only that folder is replaced: a batch
        # that is run again after a failure rewrites its own output and nothing else.
        query_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        tagged = batch.withColumn("batch", F.lit(f"{query_id}-{batch_id}")).persist()
        try:
            good = valid_records(tagged).select("value", "date", "hour", "batch")
            _replace(good, "date", "hour", "batch").text(good_path)
            bad = quarantine_records(tagged).select("reason", "raw", "timestamp", "date", "batch")
            _replace(bad, "date", "batch").json(bad_path)
        finally:
            tagged.unpersist()

    return write


def _replace(df: DataFrame, *partition_cols: str):
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    return writer.partitionBy(*partition_cols)


def ingest(
    stream: DataFrame,
    good_path: str,
    bad_path: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start routing ``stream`` (text column ``value``).

    Accepted records land as JSON lines in ``date=/hour=`` folders, refused ones with their reason
    in ``date=`` folders. ``trigger`` is a ``DataStreamWriter.trigger`` argument; by default a batch
    starts as soon as the source has one, which for a topic is decided by count or delay. Pass
    ``{"availableNow": True}`` to drain what is there and stop.
    """
    writer = (
        checked_stream(stream)
        .writeStream.queryName("ingest")
        .foreachBatch(_route(good_path, bad_path))
        .option("checkpointLocation", checkpoint)
    )
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start()


def progress_counts(query: StreamingQuery) -> dict[str, int]:
    """Valid, invalid and unreadable counts of the last micro-batch."""
    progress = query.lastProgress
    return _counts(progress.observedMetrics if progress else {})


def _counts(metrics: dict) -> dict[str, int]:
    row = metrics.get(METRICS)
    return {name: row[name] if row else 0 for name in STATUSES}


class RunningCounts(StreamingQueryListener):
    """Running totals over all micro-batches; add it with ``spark.streams.addListener``."""

    def __init__(self) -> None:
        self.totals = dict.fromkeys(STATUSES, 0)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, count in _counts(event.progress.observedMetrics).items():
            self.totals[name] += count

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
