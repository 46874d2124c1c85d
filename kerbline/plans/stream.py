"""The streaming jobs: JSON texts in, checked and de-duplicated events or decisions out."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kerbline import fixed
from kerbline.operators import cleaning
from kerbline.operators.cleaning import with_event_time
from kerbline.operators.decisions import Lookups, decide_by
from kerbline.operators.features import add_scores
from kerbline.operators.ml import score
from kerbline.streaming.dedup import batch_tag, dedup_into, first_rows, fresh_rows, start_keyed, write_batch
from kerbline.streaming.ingest import ingest


def raw_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Sensor events from JSON lines as a stream; the stream counterpart of ``read_events``."""
    reader = spark.readStream.schema(fixed.SENSOR_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def run_decision_stream(
    records: DataFrame,
    tables: Lookups,
    decisions_out: str,
    checkpoint: str,
    model: PipelineModel | None = None,
    label_col: str = "severity_label",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Raw sensor events as a stream, to nested decisions as JSON lines below ``decisions_out``.

    Events are cleaned in the order of the batch job; the first row of every id counts, by keyed state. A micro-batch is
    scored (with ``model`` also by the classifier, whose label ``predicted_severity`` then is at hand for ``label_col``),
    looked up in ``tables``, which were worked out before, and written to a folder of its own. A batch that runs again after
    a failure finds the same state and replaces that folder, so each id is decided exactly once.
    """
    ready = (
        records.transform(cleaning.drop_keyless)
        .transform(cleaning.fill_defaults)
        .transform(cleaning.cast_or_default)
        .transform(cleaning.filter_ranges)
        .transform(with_event_time)
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        scored = fresh_rows(batch).transform(cleaning.filter_domains).drop("timestamp").transform(add_scores)
        if model is not None:
            scored = score(scored, model)
        write_batch(decide_by(scored, tables, label_col), decisions_out, batch_tag(batch, batch_id), "json")

    return start_keyed(first_rows(ready), write, checkpoint, trigger, "decisions")


def event_stream(spark: SparkSession, processed: str, max_files: int | None = None) -> DataFrame:
    """Accepted records as a stream of typed events."""
    reader = spark.readStream.schema(fixed.SENSOR_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return with_event_time(reader.json(f"{processed}/date=*/hour=*/batch=*"))


def run_stream(texts: DataFrame, root: str, trigger: dict | None = None) -> list:
    """Start both queries over ``texts`` (column ``value``): validate and route, then de-duplicate what was accepted.

    Below ``root``: ``processed`` and ``quarantine`` as JSON lines, ``events`` as Parquet with one row per id. With
    ``{"availableNow": True}`` the second query starts when the first has drained its source.
    """
    spark = texts.sparkSession
    processed = f"{root}/processed"
    routed = ingest(texts, processed, f"{root}/quarantine", f"{root}/checkpoint/ingest", trigger)
    if trigger and "availableNow" in trigger:
        routed.awaitTermination()
    single = dedup_into(event_stream(spark, processed), f"{root}/events", f"{root}/checkpoint/dedup", trigger=trigger)
    return [routed, single]
