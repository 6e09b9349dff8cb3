"""Checking landed transactions as they arrive: the batch check over a file stream, which needs no state, under rules
that are fixed or that are accepted and withdrawn while it runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covary.operators.check import check_changes

SCHEMA = "repo_id string, event_id string, components array<string>"


def transactions(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(path)


def start_check(spark: SparkSession, path: str, rules: DataFrame, out: str, checkpoint: str):
    """Findings as Parquet; exactly once, by the sink's log."""
    findings = check_changes(transactions(spark, path), rules)
    return findings.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


RULES = "repo_id string, a string, b string, accepted boolean, severity string"


def current_rules(spark: SparkSession, path: str) -> DataFrame:
    """The newest word on every rule: path holds a folder `version=N` per change of mind, with the rules it changes."""
    rows = spark.read.schema(f"{RULES}, version bigint").parquet(path)
    newest = rows.groupBy("repo_id", "a", "b").agg(F.max_by(F.struct("accepted", "severity"), "version").alias("r"))
    return newest.select("repo_id", "a", "b", "r.accepted", "r.severity")


def start_versioned_check(spark: SparkSession, path: str, rules_path: str, out: str, checkpoint: str, per_trigger: int = 100, **trigger):
    """Findings under the rules as they stand when a micro-batch begins, a folder `batch=N` of out for each. A batch that
    is run again after a failure replaces its own folder, so every finding is there once."""

    def check(batch: DataFrame, number: int) -> None:
        findings = check_changes(batch, current_rules(batch.sparkSession, rules_path))
        findings.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return transactions(spark, path, per_trigger).writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
