"""Every operator as a named query over a test-data folder: ``(spark, sf_dir) -> DataFrame``.

All of them run over whole tables. Floats, dates and timestamps are shown as doubles and text, so
that the same result reads the same in another engine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline import fixed
from kerbline.functions import cells
from kerbline.operators import cleaning, decisions, features, graph, ml, reports, retrieval, validation
from kerbline.operators.lookup import lookup
from kerbline.plans import rollup
from kerbline.plans import sensor_views as views
from kerbline.plans.stream import raw_stream, run_decision_stream
from kerbline.session import pin, scratch_path
from kerbline.sources import readers, writers
from kerbline.streaming.dedup import dedup_into
from kerbline.streaming.ingest import ingest

SECONDS = "yyyy-MM-dd HH:mm:ss.SSSSSS"
RAW_COLUMNS = [f.name for f in fixed.SENSOR_SCHEMA]
CLEAN_COLUMNS = [c for c in RAW_COLUMNS if c != "timestamp"] + ["event_ts", "date", "hour"]
NO_TARGET = "none"
WARD_DEFAULT = "H0"


def shown(df: DataFrame) -> DataFrame:
    """Column types that read the same everywhere."""
    formats = {
        "float": lambda c: F.col(c).cast("double"),
        "date": lambda c: F.date_format(c, "yyyy-MM-dd"),
        "timestamp": lambda c: F.date_format(c, SECONDS),
    }
    return df.select(*[formats[t](c).alias(c) if t in formats else F.col(c) for c, t in df.dtypes])


# ---- cleaning ---------------------------------------------------------------------------------


def etl_drop_all_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("event_id").cast("long")
    gappy = views.sensor_raw(spark, sf_dir).select(
        F.when(number % 3 != 0, F.col("event_id")).alias("event_id"),
        F.when(number % 5 != 0, F.col("timestamp")).alias("timestamp"),
        F.when(number % 2 != 0, F.col("intersection_id")).alias("intersection_id"),
        "zone",
    )
    return cleaning.drop_keyless(gappy)


def etl_fill_defaults(spark, sf_dir):
    return cleaning.fill_defaults(views.sensor_raw(spark, sf_dir))


def etl_cast_or_default(spark, sf_dir):
    raw = views.sensor_raw(spark, sf_dir)
    text = raw.select(
        "event_id",
        F.coalesce(F.col("speed_kmh").cast("string"), F.lit("FAST")).alias("speed_kmh"),
        F.when(F.col("vehicle_count") % 60 == 0, "many")
        .otherwise(F.col("vehicle_count").cast("string"))
        .alias("vehicle_count"),
    )
    return shown(cleaning.cast_or_default(text))


def etl_range_filter(spark, sf_dir):
    raw = views.sensor_raw(spark, sf_dir)
    typed = raw.transform(cleaning.fill_defaults).transform(cleaning.cast_or_default)
    return shown(cleaning.filter_ranges(typed).select("event_id", "speed_kmh", "vehicle_count"))


def etl_domain_filter(spark, sf_dir):
    filled = cleaning.fill_defaults(views.sensor_raw(spark, sf_dir))
    return cleaning.filter_domains(filled).select("event_id", "congestion", "vehicle_type", "weather")


def etl_dedup_by_event(spark, sf_dir):
    return cleaning.dedup_by_event(views.sensor_raw(spark, sf_dir))


def etl_dedup_hot_key(spark, sf_dir):
    """A third of all rows share one id, the rest come in small groups; the earliest row stays."""
    raw = views.sensor_raw(spark, sf_dir)
    number = F.col("event_id").cast("long")
    shared = F.when(number % 3 == 0, "HOT").otherwise((number % 997).cast("string"))
    return cleaning.dedup_by_event(raw.withColumn("event_id", shared)).select(
        "event_id", "timestamp", "intersection_id", "speed_kmh", "vehicle_count"
    )


def etl_event_time_parts(spark, sf_dir):
    raw = views.sensor_raw(spark, sf_dir)
    garbled = raw.withColumn(
        "timestamp", F.when(F.col("event_id").cast("long") % 7 == 0, "not a time").otherwise(F.col("timestamp"))
    )
    return shown(cleaning.with_event_time(garbled).select("event_id", "event_ts", "date", "hour"))


def etl_clean(spark, sf_dir):
    return shown(views.sensor_clean(spark, sf_dir).select(*CLEAN_COLUMNS))


def etl_quality_stats(spark, sf_dir):
    return cleaning.quality_stats(views.sensor_raw(spark, sf_dir))


# ---- features and windows ---------------------------------------------------------------------


def _scores(*columns: str):
    def query(spark, sf_dir):
        return shown(views.sensor_scores(spark, sf_dir).select("event_id", *columns))

    return query


def win_zone_averages(spark, sf_dir):
    scored = views.sensor_scores(spark, sf_dir)
    return features.add_zone_averages(scored).select("event_id", "zone", "zone_avg_congestion", "zone_avg_speed")


def win_severity_share(spark, sf_dir):
    views.sensor_scores(spark, sf_dir).createOrReplaceTempView("kerbline_scores")
    return reports.severity_share_sql(spark, "kerbline_scores")


# ---- reports ----------------------------------------------------------------------------------


def _report(report):
    def query(spark, sf_dir):
        return report(views.sensor_scores(spark, sf_dir))

    return query


def rep_risk_by_zone_sql(spark, sf_dir):
    views.sensor_scores(spark, sf_dir).createOrReplaceTempView("kerbline_scores")
    return reports.risk_by_zone_sql(spark, "kerbline_scores")


def rep_class_distribution(spark, sf_dir):
    return reports.class_distribution(ml.labelled(views.quality_corpus(spark, sf_dir)))


def rep_first_n_records(spark, sf_dir):
    scored = views.sensor_scores(spark, sf_dir)
    return shown(scored.orderBy("event_id").limit(50).select(*fixed.SCORED_COLUMNS))


def join_zone_lookup(spark, sf_dir):
    rows = [(f"I{n}", zone) for n, zone in views.ZONE_BY_RESIDUE.items()]
    zones = spark.createDataFrame(rows, "intersection_id string, zone string")
    records = views.sensor_raw(spark, sf_dir).select("event_id", "intersection_id")
    return lookup(records, zones, ["intersection_id"])


# ---- sources and sinks ------------------------------------------------------------------------


def src_sink_parquet_roundtrip(spark, sf_dir):
    """Clean table appended, feature table from it, both read back by partition."""
    clean_path, feature_path = scratch_path(spark, "clean"), scratch_path(spark, "features")
    cleaned = views.sensor_clean(spark, sf_dir)
    writers.write_clean(writers.gathered(cleaned, "zone", "date"), clean_path)
    writers.write_features(features.add_features(readers.read_table(spark, clean_path)), feature_path)
    return shown(readers.read_table(spark, feature_path))


def sink_replace_is_idempotent(spark, sf_dir):
    """The clean table written twice with replaced folders holds every row once."""
    path = scratch_path(spark, "clean")
    ready = writers.gathered(views.sensor_clean(spark, sf_dir), "zone", "date")
    writers.write_clean(ready, path, "replace")
    writers.write_clean(ready, path, "replace")
    return shown(readers.read_table(spark, path).select("event_id", "zone", "date"))


def src_catalog_table(spark, sf_dir):
    """The feature table registered over its folders and queried by name."""
    path = scratch_path(spark, "features")
    writers.write_features(views.sensor_scores(spark, sf_dir), path)
    name = "kerbline_" + path.rsplit("-", 1)[1]
    writers.register_table(spark, name, path)
    return reports.risk_by_zone_sql(spark, name)


def src_table_listing(spark, sf_dir):
    """Both tables registered and listed by the catalog, with the rows that their names give."""
    root = scratch_path(spark, "listed")
    writers.write_clean(views.sensor_clean(spark, sf_dir), f"{root}/clean")
    writers.write_features(views.sensor_scores(spark, sf_dir), f"{root}/features")
    tag = root.rsplit("-", 1)[1]
    names = {f"kerbline_clean_{tag}": "clean", f"kerbline_features_{tag}": "features"}
    listing = writers.register_tables(spark, f"{root}/clean", f"{root}/features", tuple(names))
    listed = listing.where(F.col("tableName").isin(list(names))).select(cells.cases(F.col("tableName"), names).alias("table"), "isTemporary")
    rows = [spark.table(name).groupBy(F.lit(kind).alias("table")).agg(F.count(F.lit(1)).alias("rows")) for name, kind in names.items()]
    return listed.join(reduce(DataFrame.unionByName, rows), "table").select("table", F.col("isTemporary").alias("temporary"), "rows")


def src_arrival_folders(spark, sf_dir):
    """Accepted records by the folder of their arrival, written partitioned and read back by folder names."""
    path = scratch_path(spark, "arrivals")
    events = views.table(spark, sf_dir, "events")
    placed = events.select("event_id", cells.arrival_date(F.col("ts")).alias("date"), cells.arrival_hour(F.col("ts")).alias("hour"))
    writers.gathered(placed, "date").write.partitionBy("date", "hour").parquet(path)
    back = spark.read.option("basePath", path).schema("event_id long, date string, hour string").parquet(path)
    return back.groupBy("date", "hour").agg(F.count(F.lit(1)).alias("records"))


def ml_labelled_guard(spark, sf_dir):
    """The labelled records of a corpus, and whether a corpus without any is refused instead of trained on."""
    corpus = views.language_corpus(spark, sf_dir)
    kept = ml.labelled(corpus)
    try:
        ml.labelled(corpus.withColumn("text", F.lit(None).cast("string")))
        refused = False
    except RuntimeError:
        refused = True
    return kept.groupBy("severity").agg(F.count(F.lit(1)).alias("records")).withColumn("empty_refused", F.lit(refused))


def src_json_roundtrip(spark, sf_dir):
    """Raw events as JSON lines, read back under the fixed schema."""
    path = scratch_path(spark, "raw")
    writers.write_json(views.sensor_raw(spark, sf_dir), path)
    return shown(readers.read_events(spark, path).select(*RAW_COLUMNS))


def sink_scored_json(spark, sf_dir):
    """The hand-over columns written as JSON and read back, all of them."""
    path = scratch_path(spark, "scored")
    scored = views.sensor_scores(spark, sf_dir).select(*fixed.SCORED_COLUMNS)
    writers.write_json(scored, path)
    return shown(spark.read.schema(scored.schema).json(path))


def src_incident_corpus(spark, sf_dir):
    """The labelled corpus as JSON lines, read in splits under its schema."""
    path = scratch_path(spark, "incidents")
    corpus = views.language_corpus(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "text", "severity")
    writers.write_json(corpus, path)
    return readers.read_incidents(spark, path).select("id", "text", "severity")


def src_policy_corpus(spark, sf_dir):
    """A retrieval corpus as JSON lines; its documents are numbered in the order of its files."""
    path = scratch_path(spark, "policies")
    texts = views.protocol_docs(spark, sf_dir).select(F.col("doc_ord").cast("string").alias("policy_id"), "text")
    writers.write_json(texts, path)
    numbered = readers.read_corpus(spark, path, fixed.POLICY_SCHEMA)
    return numbered.select("policy_id", "text", F.col("doc_ord").isNotNull().alias("numbered"))


# ---- validation -------------------------------------------------------------------------------


def val_reasons(spark, sf_dir):
    return validation.validate(views.sensor_json(spark, sf_dir)).select("event_id", "reason")


def val_reason_counts(spark, sf_dir):
    return validation.reason_counts(validation.validate(views.sensor_json(spark, sf_dir)))


def val_status_counts(spark, sf_dir):
    return validation.status_counts(validation.validate(views.sensor_json(spark, sf_dir)))


def val_quarantine(spark, sf_dir):
    """Refused records; ``raw`` field by field where it is an object, else as its text."""
    refused = validation.quarantine_records(validation.validate(views.sensor_json(spark, sf_dir)))
    is_object = F.schema_of_variant("raw").startswith("OBJECT")

    def field(name: str, kind: str = "string"):
        return F.when(is_object, F.try_variant_get("raw", f"$.{name}", kind)).alias(f"raw_{name}")

    texts = ["event_id", "timestamp", "intersection_id", "zone", "congestion", "vehicle_type", "weather"]
    return refused.select(
        "event_id",
        "reason",
        F.when(~is_object, F.try_variant_get("raw", "$", "string")).alias("raw_text"),
        *(field(name) for name in texts),
        field("speed_kmh", "double"),
        field("vehicle_count", "double"),
    )


# ---- streaming --------------------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = views.table(spark, sf_dir, "events").schema
    # A pattern, because the stream source takes a folder or a pattern, and the table may be one file.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")


def stream_ingest_available_now(spark, sf_dir):
    """The whole table as a stream of JSON texts, routed to both outputs, which are read back."""
    root = scratch_path(spark, "ingest")
    texts = views.as_json_text(views.as_sensor(_event_stream(spark, sf_dir)))
    query = ingest(texts, f"{root}/processed", f"{root}/quarantine", f"{root}/checkpoint", {"availableNow": True})
    query.awaitTermination()
    good = readers.read_events(spark, f"{root}/processed").select(F.lit("ok").alias("reason"), "event_id")
    bad = spark.read.schema("reason string, raw variant").json(f"{root}/quarantine")
    refused = bad.select("reason", F.try_variant_get("raw", "$.event_id", "string").alias("event_id"))
    return good.unionByName(refused)


def stream_dedup(spark, sf_dir):
    """One row of every id of the table as a stream, late and untimed rows included."""
    root = scratch_path(spark, "dedup")
    sensor = cleaning.with_event_time(views.as_sensor(_event_stream(spark, sf_dir)))
    stream = sensor.select("event_id", "intersection_id", "event_ts")
    dedup_into(stream, f"{root}/events", f"{root}/checkpoint", trigger={"availableNow": True}).awaitTermination()
    return shown(spark.read.parquet(f"{root}/events").drop("batch"))


def stream_decisions(spark, sf_dir):
    """The short decisions of all records, from a stream of JSON files that stops half way and goes on from its checkpoint."""
    root = scratch_path(spark, "decision-stream")
    raw = views.sensor_raw(spark, sf_dir)
    tables = decisions.lookups(
        decisions.all_profiles(spark),
        views.sensor_edges(spark, sf_dir),
        views.sensor_targets(spark, sf_dir),
        views.policy_docs(spark, sf_dir),
        views.protocol_docs(spark, sf_dir),
        WARD_DEFAULT,
    )
    early = F.col("event_id").cast("long") % 2 == 0
    schema = None
    for half in (early, ~early):
        writers.write_json(raw.where(half).coalesce(4), f"{root}/raw", mode="append")
        texts = raw_stream(spark, f"{root}/raw", max_files=3)
        run_decision_stream(texts, tables, f"{root}/decisions", f"{root}/checkpoint", trigger={"availableNow": True}).awaitTermination()
        schema = schema or decisions.decide_by(views.sensor_scores(spark, sf_dir), tables).schema
    return decisions.summarize(spark.read.schema(schema).json(f"{root}/decisions"))


# ---- graph ------------------------------------------------------------------------------------


def graph_successors(spark, sf_dir):
    return graph.successors(views.user_edges(spark, sf_dir))


def graph_hops(spark, sf_dir):
    return graph.hop_counts(views.user_edges(spark, sf_dir), views.user_targets(spark, sf_dir))


def graph_nearest_target(spark, sf_dir):
    edges, targets = views.sensor_edges(spark, sf_dir), views.sensor_targets(spark, sf_dir)
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return graph.nearest_target(nodes, edges, targets, NO_TARGET)


def graph_neighbor_lists(spark, sf_dir):
    records = views.sensor_raw(spark, sf_dir).select("event_id", "intersection_id")
    listed = graph.with_neighbors(records, views.sensor_edges(spark, sf_dir))
    return listed.select("event_id", F.array_join("neighbors", "|").alias("neighbors"))


def graph_spillover(spark, sf_dir):
    return graph.spillover(views.sensor_scores(spark, sf_dir), views.sensor_edges(spark, sf_dir))


# ---- retrieval --------------------------------------------------------------------------------


def text_topk_overlap(spark, sf_dir):
    queries = views.benchmark_queries(spark, sf_dir)
    found = retrieval.retrieve(queries, views.policy_docs(spark, sf_dir), k=2)
    return found.select("query", "rank", "score", F.col("doc_ord").alias("doc_id"))


def text_record_context(spark, sf_dir):
    """Every record with the cut texts of the two documents that fit it best."""
    records = views.sensor_scores(spark, sf_dir).withColumn("query", decisions.vehicle_query())
    found = retrieval.contexts(
        records, views.policy_docs(spark, sf_dir), k=2, width=80, default=fixed.NO_POLICY_TEXT
    )
    return lookup(records.select("event_id", "query"), pin(found), ["query"])


# ---- decisions --------------------------------------------------------------------------------


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.decide(
        views.sensor_scores(spark, sf_dir),
        views.sensor_edges(spark, sf_dir),
        views.sensor_targets(spark, sf_dir),
        views.policy_docs(spark, sf_dir),
        views.protocol_docs(spark, sf_dir),
        WARD_DEFAULT,
    )


def decide_incident(spark, sf_dir):
    ida = _decided(spark, sf_dir).select("event_id", "ida.*")
    return ida.drop("agent")


def decide_signal(spark, sf_dir):
    tla = _decided(spark, sf_dir).select("event_id", "tla.*")
    return tla.select("*", "timing_sec.green", "timing_sec.yellow", "timing_sec.red").drop("agent", "timing_sec")


def decide_summary(spark, sf_dir):
    return decisions.summarize(_decided(spark, sf_dir))


def decide_messages(spark, sf_dir):
    va = _decided(spark, sf_dir).select("event_id", "va.*")
    return va.select(
        "event_id",
        "message",
        F.array_join("alerts", "|").alias("alerts"),
        "risk",
        F.array_join("neighbors", "|").alias("neighbors"),
    )


def decide_nested_json(spark, sf_dir):
    """Nested decisions written as JSON by the executors and read back."""
    path = scratch_path(spark, "decisions")
    decided = _decided(spark, sf_dir)
    writers.write_json(decided, path)
    back = spark.read.schema(decided.schema).json(path)
    return back.select(
        "event_id",
        "part",
        "va.message",
        F.array_join("va.alerts", "|").alias("alerts"),
        F.array_join("va.neighbors", "|").alias("neighbors"),
        "va.risk",
        "ida.severity",
        "ida.spark_predicted_sev",
        "ida.recommended_action",
        "ida.protocol",
        "ida.nearest_hospital",
        "ida.va_risk_confirmed",
        "tla.action",
        "tla.decision",
        "tla.policy_context",
        "tla.is_emergency",
        *(f"tla.timing_sec.{phase}" for phase in ("green", "yellow", "red")),
    )


# ---- classification ---------------------------------------------------------------------------


def score_text_column(spark, sf_dir):
    return views.sensor_scores(spark, sf_dir).select("event_id", cells.scoring_text().alias("text"))


def ml_split(spark, sf_dir):
    train, test = ml.split_train_test(views.quality_corpus(spark, sf_dir), "doc_id")
    return train.select("doc_id", F.lit("train").alias("part")).unionByName(
        test.select("doc_id", F.lit("test").alias("part"))
    )


def ml_null_text(spark, sf_dir):
    return ml.drop_out_text(views.quality_corpus(spark, sf_dir), "doc_id").select("doc_id", "text")


def ml_noisy_labels(spark, sf_dir):
    corpus = views.language_corpus(spark, sf_dir)
    return ml.relabel(corpus, "doc_id", ["de", "en", "es", "fr"]).select("doc_id", "severity")


def _classified(classifier: str):
    """Predictions for documents that also hold two hundred words of their class, so that the right answer is known."""

    def query(spark, sf_dir):
        of_class = F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.concat("severity", F.lit("word"), i.cast("string")))
        naming = F.array_join(of_class, " ")
        named = views.language_corpus(spark, sf_dir).withColumn("text", F.concat_ws(" ", naming, "text"))
        train, test = ml.split_train_test(ml.labelled(named), "doc_id")
        model = ml.fit_text_classifier(train, classifier)
        found = ml.with_predicted_severity(model.transform(test), model)
        return found.select("doc_id", "severity", "predicted_severity")

    return query


def ml_metrics(spark, sf_dir):
    """The metrics rows written and read back, held against the stored predictions.

    ``majority_share`` is the accuracy of always naming the commonest class of the test rows, which a classifier that
    learned anything beats; ``agrees`` says that the written figures are those of the stored predictions and lie
    between their bootstrap bounds.
    """
    kept, path = scratch_path(spark, "predictions"), scratch_path(spark, "metrics")
    _, metrics = ml.run_classifier(
        views.language_corpus(spark, sf_dir), "doc_id", labels=["de", "en", "es", "fr"], predictions_path=kept
    )
    writers.write_json(metrics, path)
    written = spark.read.schema(metrics.schema).json(path)
    runs = ["classifier", "condition"]
    predictions = spark.read.parquet(kept)
    classes = predictions.groupBy(*runs, "severity").agg(F.count(F.lit(1)).alias("n"))
    sizes = classes.groupBy(*runs).agg(
        F.sum("n").alias("test_rows"), F.round(F.max("n") / F.sum("n"), 4).alias("majority_share")
    )
    found = ml.intervals(predictions, "key", by=runs)
    stored = F.struct(*(c for c in found.columns if c not in runs)).alias("stored")
    joined = written.join(found.select(*runs, stored), runs).join(sizes, runs)
    agrees = (F.col("accuracy") == F.col("stored.accuracy")) & (F.col("f1") == F.col("stored.f1"))
    between = F.col("accuracy").between(F.col("stored.accuracy_low"), F.col("stored.accuracy_high"))
    return joined.select(
        *runs,
        "test_rows",
        "majority_share",
        (F.col("accuracy") > F.col("majority_share")).alias("learned"),
        (agrees & between).alias("agrees"),
        F.col("elapsed_sec").isNotNull().alias("timed"),
    )


def ml_intervals(spark, sf_dir):
    """Accuracy and weighted F1 of a guess by the document number, with the bounds of their bootstrap intervals."""
    corpus = views.quality_corpus(spark, sf_dir)
    return ml.intervals(
        corpus.select(
            "doc_id", F.col("severity").cast("double").alias("label"), (F.col("doc_id") % 3 % 2).cast("double").alias("prediction")
        ),
        "doc_id",
    )


def ml_score_features(spark, sf_dir):
    """A model trained on the records' own texts, saved, loaded, and applied to all records."""
    records = views.sensor_scores(spark, sf_dir)
    corpus = records.select("event_id", cells.scoring_text().alias("text"), F.col("severity_label").alias("severity"))
    path = scratch_path(spark, "model")
    ml.fit_text_classifier(corpus, "logreg").write().overwrite().save(path)
    scored = ml.score(records, readers.load_model(path))
    known = F.col("predicted_severity").isin(*fixed.SEVERITIES)
    return shown(scored.select(*fixed.SCORED_COLUMNS, known.alias("has_known_severity")))


def ml_confusion_metrics(spark, sf_dir):
    """Accuracy and weighted F1 of a guess that depends on the document number only."""
    corpus = views.quality_corpus(spark, sf_dir)
    guesses = corpus.select(
        F.col("severity").cast("double").alias("label"), (F.col("doc_id") % 3 % 2).cast("double").alias("prediction")
    )
    return ml.evaluate(guesses)


# ---- metrics --------------------------------------------------------------------------------


def quality_metrics(spark, sf_dir):
    """The quality row written and read back as JSON."""
    path = scratch_path(spark, "quality")
    stats = cleaning.quality_stats(views.sensor_raw(spark, sf_dir))
    writers.write_json(stats, path)
    return spark.read.schema(stats.schema).json(path)


def etl_rule_counts(spark, sf_dir):
    return cleaning.rule_counts(views.sensor_raw(spark, sf_dir))


def src_rescued_lines(spark, sf_dir):
    """Lines and fields of the broken JSON texts that could not be read, by field."""
    path = scratch_path(spark, "broken")
    views.sensor_json(spark, sf_dir).select("value").write.text(path)
    rescued = readers.read_events_rescued(spark, path).where("rescued is not null")
    return rescued.groupBy(F.array_join("rescued_fields", "|").alias("fields")).agg(F.count(F.lit(1)).alias("lines"))


def _rolled_up(report):
    """A report from partial sums, kept up to date over three appends of which the last replaces its folders."""

    def query(spark, sf_dir):
        root = scratch_path(spark, "rollup")
        clean = views.sensor_clean(spark, sf_dir)
        third = F.col("event_id").cast("long") % 3
        for part in range(3):
            writers.write_clean(clean.where(third == part), f"{root}/clean")
            rollup.update(spark, f"{root}/clean", f"{root}/sums")
        north = (F.col("zone") == "north") & (F.col("event_id").cast("long") % 2 == 0)
        writers.write_clean(clean.where(north), f"{root}/clean", mode="replace")
        rollup.update(spark, f"{root}/clean", f"{root}/sums")
        return shown(report(rollup.sums(spark, f"{root}/sums")))

    return query


QUERIES = {
    "etl_rule_counts": etl_rule_counts,
    "src_rescued_lines": src_rescued_lines,
    "roll_severity_by_zone": _rolled_up(rollup.severity_by_zone),
    "roll_risk_by_zone": _rolled_up(rollup.risk_by_zone),
    "etl_drop_all_null_keys": etl_drop_all_null_keys,
    "etl_fill_defaults": etl_fill_defaults,
    "etl_cast_or_default": etl_cast_or_default,
    "etl_range_filter": etl_range_filter,
    "etl_domain_filter": etl_domain_filter,
    "etl_dedup_by_event": etl_dedup_by_event,
    "etl_dedup_hot_key": etl_dedup_hot_key,
    "etl_event_time_parts": etl_event_time_parts,
    "etl_clean": etl_clean,
    "etl_quality_stats": etl_quality_stats,
    "feat_congestion_score": _scores("congestion", "congestion_score"),
    "feat_speed_ratio": _scores("speed_kmh", "speed_ratio"),
    "feat_flags": _scores("vehicle_type", "is_emergency", "weather", "is_bad_weather"),
    "feat_hour_bin": _scores("hour", "hour_bin"),
    "feat_risk_score": _scores("risk_score"),
    "feat_severity": _scores("severity_label", "severity_index"),
    "win_zone_averages": win_zone_averages,
    "win_severity_share": win_severity_share,
    "rep_severity_by_zone": _report(reports.severity_by_zone),
    "rep_risk_by_hour_bin": _report(reports.risk_by_hour_bin),
    "rep_emergency_incidents": _report(reports.emergency_incidents),
    "rep_top3_intersections": _report(reports.top_risk_intersections),
    "rep_risk_by_zone_sql": rep_risk_by_zone_sql,
    "rep_class_distribution": rep_class_distribution,
    "rep_first_n_records": rep_first_n_records,
    "join_zone_lookup": join_zone_lookup,
    "src_sink_parquet_roundtrip": src_sink_parquet_roundtrip,
    "sink_replace_is_idempotent": sink_replace_is_idempotent,
    "src_catalog_table": src_catalog_table,
    "src_table_listing": src_table_listing,
    "src_arrival_folders": src_arrival_folders,
    "ml_labelled_guard": ml_labelled_guard,
    "src_json_roundtrip": src_json_roundtrip,
    "sink_scored_json": sink_scored_json,
    "src_incident_corpus": src_incident_corpus,
    "src_policy_corpus": src_policy_corpus,
    "val_reasons": val_reasons,
    "val_reason_counts": val_reason_counts,
    "val_status_counts": val_status_counts,
    "val_quarantine": val_quarantine,
    "stream_ingest_available_now": stream_ingest_available_now,
    "stream_dedup": stream_dedup,
    "stream_decisions": stream_decisions,
    "graph_successors": graph_successors,
    "graph_hops": graph_hops,
    "graph_nearest_target": graph_nearest_target,
    "graph_neighbor_lists": graph_neighbor_lists,
    "graph_spillover": graph_spillover,
    "text_topk_overlap": text_topk_overlap,
    "text_record_context": text_record_context,
    "decide_incident": decide_incident,
    "decide_signal": decide_signal,
    "decide_summary": decide_summary,
    "decide_messages": decide_messages,
    "decide_nested_json": decide_nested_json,
    "score_text_column": score_text_column,
    "ml_split": ml_split,
    "ml_null_text": ml_null_text,
    "ml_noisy_labels": ml_noisy_labels,
    "ml_logreg_score": _classified("logreg"),
    "ml_svm_score": _classified("svm"),
    "ml_metrics": ml_metrics,
    "ml_intervals": ml_intervals,
    "ml_score_features": ml_score_features,
    "ml_confusion_metrics": ml_confusion_metrics,
    "quality_metrics": quality_metrics,
}
