"""Folder-to-folder jobs for training and for the whole way from raw events to decisions."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from kerbline.operators.decisions import summarize
from kerbline.operators.ml import run_classifier
from kerbline.plans.etl import run_etl, run_features
from kerbline.plans.scoring import run_decisions
from kerbline.sources.readers import read_incidents
from kerbline.sources.writers import write_json


def run_training(
    spark: SparkSession, corpus_path: str, model_path: str, metrics_path: str, multi_line: bool = False
) -> tuple[PipelineModel, DataFrame]:
    """Corpus in, saved model and metrics out; the model and the metrics as they were written."""
    model, metrics = run_classifier(read_incidents(spark, corpus_path, multi_line), model_path=model_path)
    write_json(metrics, metrics_path)
    return model, spark.read.schema(metrics.schema).json(metrics_path)


def run_all(
    spark: SparkSession,
    raw_path: str,
    corpus_path: str,
    policies_path: str,
    protocols_path: str,
    out: str,
    multi_line: bool = False,
) -> dict[str, DataFrame | dict]:
    """Clean, score by rules, train, classify, decide and summarise; every step's result lies below ``out``.

    The short decisions are written to ``out/summary``.
    """
    etl = run_etl(raw_path, f"{out}/clean", spark, mode="replace")
    run_features(f"{out}/clean", f"{out}/features", spark)
    _, metrics = run_training(spark, corpus_path, f"{out}/model", f"{out}/metrics", multi_line)
    decided = run_decisions(
        spark, f"{out}/features", f"{out}/model", policies_path, protocols_path, f"{out}/scored", f"{out}/decisions",
        multi_line=multi_line,
    )
    summary = summarize(decided)
    write_json(summary, f"{out}/summary")
    return {"etl": etl, "metrics": metrics, "decisions": decided, "summary": spark.read.schema(summary.schema).json(f"{out}/summary")}
