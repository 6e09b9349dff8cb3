"""Checking new transactions against accepted rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_changes(tx: DataFrame, rules: DataFrame) -> DataFrame:
    """tx(repo_id, event_id, components) x rules(repo_id, a, b, accepted, severity) -> a finding for each transaction
    with a and not b under an accepted rule; severity is `warn` unless the rule says `block`. tx may be a stream."""
    accepted = rules.where("accepted").select("repo_id", "a", "b", F.when(F.col("severity") == "block", "block").otherwise("warn").alias("severity"))
    hit = tx.select("repo_id", "event_id", "components", F.explode("components").alias("a")).join(accepted, ["repo_id", "a"])
    return hit.where(~F.array_contains("components", F.col("b"))).select("repo_id", "event_id", "a", "b", "severity")
