"""Sources: files, Kafka, literal tables, saved models."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline import fixed


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Sensor events from JSON lines: a wrong-typed field becomes null, an unreadable line all null.

    Arrival ``date=/hour=`` folders add those two columns; cleaning replaces them by event time. The
    ``batch=`` level below them only serves the writer.
    """
    return spark.read.schema(fixed.SENSOR_SCHEMA).json(path).drop("batch")


def read_events_rescued(spark: SparkSession, path: str) -> DataFrame:
    """Sensor events as ``read_events`` gives them, with what could not be read kept beside them.

    ``rescued`` is the whole line where the line or one of its fields could not be read, else null; ``rescued_fields``
    lists the fields whose value was there but of another type (none for a line that is no JSON object at all).
    """
    schema = T.StructType([*fixed.SENSOR_SCHEMA.fields, T.StructField("rescued", T.StringType())])
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "rescued").json(path).drop("batch")
    parsed = F.try_parse_json("rescued")
    lost = [
        F.when(F.col(f.name).isNull() & F.try_variant_get(parsed, f"$.{f.name}", "string").isNotNull(), f.name)
        for f in fixed.SENSOR_SCHEMA
    ]
    fields = F.when(F.col("rescued").isNotNull(), F.array_compact(F.array(*lost)))
    return rows.withColumn("rescued_fields", fields)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Clean or feature records from partitioned Parquet."""
    return spark.read.parquet(path)


def read_incidents(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The labelled corpus as JSON lines, which large files are split by.

    ``multi_line`` reads files of one JSON array each; such a file is parsed by one task.
    """
    return spark.read.schema(fixed.INCIDENT_SCHEMA).option("multiLine", multi_line).json(path)


def read_corpus(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """Documents with ``text`` and their order in ``doc_ord``; a missing file is an empty corpus.

    The order is that of the files by name, and within a file that of its records.
    """
    try:
        rows = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        order = F.lit(None).cast("struct<file:string,position:bigint>")
        return spark.createDataFrame([], schema).withColumn("doc_ord", order)
    position = F.monotonically_increasing_id()
    return rows.withColumn("doc_ord", F.struct(F.col("_metadata.file_path").alias("file"), position.alias("position")))


def read_graph_asset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph stored as one JSON object with two arrays."""
    schema = (
        "nodes array<struct<id string, label string, type string, speed_limit_kmh int, lanes int>>, "
        "edges array<struct<`from` string, `to` string, relation string>>"
    )
    whole = spark.read.schema(schema).option("multiLine", True).json(path)
    nodes = whole.select(F.inline("nodes"))
    edges = whole.select(F.posexplode("edges").alias("ord", "e")).select(
        F.col("e.from").alias("src"), F.col("e.to").alias("dst"), F.col("e.relation").alias("type"), "ord"
    )
    return nodes, edges


def kafka_options(
    servers: str = fixed.TOPIC_SERVERS,
    topic: str = fixed.TOPIC,
    group: str | None = fixed.TOPIC_GROUP,
    min_records: int = fixed.TOPIC_MIN_RECORDS,
    max_delay: str = fixed.TOPIC_MAX_DELAY,
    max_records: int = 1_000_000,
) -> dict[str, str]:
    """Options of the topic source: from the earliest offset, a micro-batch per count or delay.

    A batch takes at most ``max_records``, so that a backlog is worked off in several; none of it is dropped.
    """
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest",
        "minOffsetsPerTrigger": str(min_records),
        "maxTriggerDelay": max_delay,
        "maxOffsetsPerTrigger": str(max(max_records, min_records)),
    }
    if group:
        options["kafka.group.id"] = group
    return options


def read_topic(spark: SparkSession, **options) -> DataFrame:
    """The topic as a stream with one text column ``value``; needs the Kafka connector package."""
    stream = spark.readStream.format("kafka").options(**kafka_options(**options)).load()
    return stream.select(F.col("value").cast("string").alias("value"))


def read_text_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Text files as a stream of ``value``; the file counterpart of the topic."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path)


def road_edges(spark: SparkSession) -> DataFrame:
    """The fixed road graph."""
    rows = [(*edge, ord_) for ord_, edge in enumerate(fixed.ROAD_EDGES)]
    return spark.createDataFrame(rows, "src string, dst string, type string, dist_km double, ord int")


def road_nodes(spark: SparkSession) -> DataFrame:
    names = [name for name, _ in fixed.ZONE_OF_INTERSECTION] + fixed.HOSPITALS + fixed.ZONES
    return spark.createDataFrame([(name,) for name in names], "node string")


def hospitals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, i) for i, n in enumerate(fixed.HOSPITALS)], "node string, ord int")


def zone_of_intersection(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixed.ZONE_OF_INTERSECTION, "intersection_id string, zone string")


def sample_events(spark: SparkSession) -> DataFrame:
    """Three clean events for trying things out; used only when asked for, never in place of data."""
    schema = T.StructType([f for f in fixed.SENSOR_SCHEMA if f.name != "timestamp"]).add("event_ts", T.StringType())
    rows = [
        ("demo-a", "Corniche_x_Andalus", "west", 88.0, "low", "motorcycle", 4, "hot", "green", False, "normal", "2025-06-02 05:15:00"),
        ("demo-b", "Airport_Road_x_Asfan", "east", 12.5, "critical", "police", 95, "dusty", "red", True, "normal", "2025-06-02 13:40:00"),
        ("demo-c", "Al_Hamra_x_Falastin", "north", 51.0, "medium", "bus", 33, "rainy", "yellow", False, "normal", "2025-06-02 21:05:00"),
    ]
    events = spark.createDataFrame(rows, schema).withColumn("event_ts", F.to_timestamp("event_ts"))
    return events.withColumns({"date": F.to_date("event_ts"), "hour": F.hour("event_ts")})


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
