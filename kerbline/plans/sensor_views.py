"""Sensor-shaped views over the ``events`` and text tables of a test-data folder.

The tables have no traffic columns; these views map their columns onto the sensor schema by fixed
rules, so every operator can run over whole tables and be compared with SQL on the same files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline import fixed
from kerbline.functions.cells import cases
from kerbline.operators.cleaning import clean
from kerbline.operators.features import add_scores

ZONE_BY_RESIDUE = dict(enumerate(zone for _, zone in fixed.ZONE_OF_INTERSECTION))
CONGESTION_BY_TYPE = dict(zip(["view", "click", "signup"], fixed.CONGESTION_LEVELS, strict=False))
VEHICLE_BY_RESIDUE = dict(enumerate(fixed.VEHICLE_TYPES))
WEATHER_BY_RESIDUE = dict(enumerate([*fixed.WEATHER_CONDITIONS[1:], "snow"]))  # one value outside the domain
PHASE_BY_RESIDUE = {0: "green", 1: "red", 2: "yellow"}
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table whose rows are costly to read, with work for every core.

    A scan that has fewer splits than there are cores is hashed out once by key. A large table has
    more splits than cores and is left as it is read.
    """
    scan = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, key)


def as_sensor(events: DataFrame) -> DataFrame:
    """Raw sensor events, with gaps, values out of range or domain, and every fiftieth id twice."""
    k = F.get_json_object("props", "$.k").cast("int")
    number, user = F.col("event_id"), F.col("user_id")
    vehicle = cases(user % 7, VEHICLE_BY_RESIDUE)
    weather = cases(user % 11, WEATHER_BY_RESIDUE)
    copies = F.explode(F.when(number % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return events.select("*", k.alias("k"), copies.alias("copy")).select(
        number.cast("string").alias("event_id"),
        F.date_format("ts", ISO).alias("timestamp"),
        F.concat(F.lit("I"), (number % 8).cast("string")).alias("intersection_id"),
        cases(number % 8, ZONE_BY_RESIDUE).alias("zone"),
        F.when(F.col("k") % 17 != 0, F.col("value")).alias("speed_kmh"),
        F.when(F.col("k") % 13 == 0, F.lit(None))
        .when(F.col("k") % 29 == 1, "gridlock")
        .otherwise(cases(F.col("event_type"), CONGESTION_BY_TYPE, "critical"))
        .alias("congestion"),
        F.when((user % 7 == 6) & (F.col("k") % 2 == 1), "tram").otherwise(vehicle).alias("vehicle_type"),
        (F.col("k") * 6).alias("vehicle_count"),
        F.when(user % 11 > 5, "clear").otherwise(weather).alias("weather"),
        cases(F.col("k") % 4, PHASE_BY_RESIDUE).alias("signal_phase"),
        F.when(F.col("k") % 20 != 1, F.col("k") % 20 == 0).alias("incident_flag"),
        F.lit(None).cast("string").alias("record_type"),
    )


def sensor_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_sensor(table(spark, sf_dir, "events"))


def sensor_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(sensor_raw(spark, sf_dir))


def sensor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature records without the whole-zone averages."""
    return add_scores(sensor_clean(spark, sf_dir))


def as_json_text(raw: DataFrame) -> DataFrame:
    """Sensor events as JSON texts, broken in nine ways by the residue of the id modulo 20."""
    residue = F.col("event_id").cast("long") % 20

    def text(value: Column) -> Column:
        return F.coalesce(F.concat(F.lit('"'), value, F.lit('"')), F.lit("null"))

    def number(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit("null"))

    speed = (
        F.when(residue == 3, F.lit("null"))
        .when(residue == 4, F.lit('"FAST"'))
        .when(residue == 6, F.lit("999.9"))
        .otherwise(number(F.col("speed_kmh")))
    )
    count = (
        F.when(residue == 5, F.lit("3.0")).when(residue == 7, F.lit("501")).otherwise(number(F.col("vehicle_count")))
    )
    congestion = F.when(residue == 8, F.lit('"gridlock"')).otherwise(text(F.col("congestion")))
    zone = F.when(residue == 2, F.lit("")).otherwise(F.concat(F.lit('"zone":'), text(F.col("zone")), F.lit(",")))
    body = F.concat(
        F.lit('{"event_id":'), text(F.col("event_id")),
        F.lit(',"timestamp":'), text(F.col("timestamp")),
        F.lit(',"intersection_id":'), text(F.col("intersection_id")),
        F.lit(","), zone,
        F.lit('"speed_kmh":'), speed,
        F.lit(',"congestion":'), congestion,
        F.lit(',"vehicle_type":'), text(F.col("vehicle_type")),
        F.lit(',"vehicle_count":'), count,
        F.lit(',"weather":'), text(F.col("weather")),
        F.lit("}"),
    )
    broken = (
        F.when(residue == 0, F.substring(body, F.lit(1), F.length(body) - 5))
        .when(residue == 1, F.concat(F.lit("["), body, F.lit("]")))
        .otherwise(body)
    )
    return raw.select("event_id", broken.alias("value"))


def sensor_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_json_text(as_sensor(text_table(spark, sf_dir, "events", "event_id")))


def user_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of users: two outgoing edges each, in the order given by ``ord``."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("src")).distinct()
    near, far = (F.col("src") * 3 + 1) % 150, (F.col("src") + 7) % 150
    pairs = users.select("src", F.explode(F.array_distinct(F.array(near, far))).alias("dst"))
    return pairs.withColumn("ord", F.when(F.col("dst") == near, 0).otherwise(1))


def user_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users 0 and 75, where the table has them."""
    wanted = table(spark, sf_dir, "events").select(F.col("user_id").alias("node")).where(F.col("node").isin(0, 75))
    return wanted.distinct().withColumn("ord", (F.col("node") == 75).cast("int"))


def sensor_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roads between the sensor intersections, and two hospitals."""
    seen = table(spark, sf_dir, "events").select((F.col("event_id") % 8).alias("n")).distinct()
    road = F.struct(F.concat(F.lit("I"), (F.col("n") * 3 + 1) % 8).alias("dst"), F.col("n").alias("ord"))
    ward = F.struct(F.concat(F.lit("H"), F.col("n")).alias("dst"), (F.col("n") + 100).alias("ord"))
    out = F.when(F.col("n").isin(1, 4), F.array(road, ward)).otherwise(F.array(road))
    return seen.select(F.concat(F.lit("I"), "n").alias("src"), F.inline(out))


def sensor_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = sensor_edges(spark, sf_dir)
    return edges.where(F.col("ord") >= 100).select(F.col("dst").alias("node"), "ord")


def policy_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_table(spark, sf_dir, "documents", "doc_id").select(F.col("doc_id").alias("doc_ord"), "text")


def protocol_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_ord"), "text")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text as a query, whole."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))


def quality_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: text and quality as the class."""
    labels = table(spark, sf_dir, "labels")
    docs = text_table(spark, sf_dir, "documents", "doc_id")
    return docs.join(labels, "doc_id").select("doc_id", "text", F.col("quality").cast("string").alias("severity"))


def language_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their language as the class."""
    return text_table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text", F.col("lang").alias("severity"))
