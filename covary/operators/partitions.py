"""Temporal partitions: cutoffs at percentiles of the event chain, and the five slices between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covary.functions.scalars import SHUFFLE_TAG, joined_hash
from covary.operators.ranking import ranked
from covary.sources.store import stored

PERCENTILES = (60, 70, 80, 90)
FULL = 100
#: Slice s (1 to 5) is part of the training data of every snapshot from the s-th on.
SNAPSHOTS = (*PERCENTILES, FULL)


def cutoffs(events: DataFrame, percentiles=PERCENTILES) -> DataFrame:
    """(repo_id, n, percentile, bound, cutoff_id): bound = floor(p * n / 100) over all events; id null if 0."""
    sizes = events.groupBy("repo_id").agg(F.count("*").alias("n"))
    rows = sizes.select("repo_id", "n", F.explode(F.array(*map(F.lit, percentiles))).alias("percentile"))
    rows = rows.withColumn("bound", F.expr("CAST(n * percentile DIV 100 AS INT)"))
    at = events.select("repo_id", F.col("seq").alias("bound"), F.col("event_id").alias("cutoff_id"))
    return rows.join(at, ["repo_id", "bound"], "left").select("repo_id", "n", "percentile", "bound", "cutoff_id")


def slices(events: DataFrame, percentiles=PERCENTILES) -> DataFrame:
    """events with `slice`: 1 up to the first cutoff, ... 5 after the last."""
    return sliced(events, events, percentiles)


def sliced(rows: DataFrame, events: DataFrame, percentiles=PERCENTILES) -> DataFrame:
    """rows(repo_id, seq, ..), numbered as the events are, with `slice`. The events of each repository are counted and
    stored first, so that the join knows how few rows that makes and deals nothing out by repository."""
    n = stored(events.groupBy("repo_id").agg(F.count("*").alias("n_events")))
    passed = sum((F.expr(f"CAST(seq > n_events * {p} DIV 100 AS INT)") for p in percentiles), F.lit(1))
    return rows.join(n, "repo_id").withColumn("slice", passed).drop("n_events")


def with_slices(tx: DataFrame, events: DataFrame) -> DataFrame:
    """Transactions with the slice of their event."""
    return tx.join(slices(events).select("repo_id", "event_id", "slice"), ["repo_id", "event_id"])


def partition_records(events: DataFrame, tx: DataFrame, displayed: DataFrame) -> DataFrame:
    """Per cutoff: id, inclusive one-based training and evaluation ranges, eligible counts, pair observations of the
    training part and displayed candidates. tx has `slice`."""
    bounds = cutoffs(events, SNAPSHOTS)
    nxt = F.lead("bound").over(Window.partitionBy("repo_id").orderBy("percentile"))
    rows = bounds.withColumn("eval_last", nxt).where(F.col("percentile") < FULL)
    per_slice = tx.groupBy("repo_id", "slice").agg(F.count("*").alias("t"), F.sum(F.col("k").cast("bigint") * (F.col("k") - 1)).alias("pairs"))
    at = F.explode(F.array(*[F.struct(F.lit(p).alias("percentile"), F.lit(i + 1).alias("last")) for i, p in enumerate(PERCENTILES)])).alias("x")
    counts = per_slice.select("*", at).groupBy("repo_id", F.col("x.percentile").alias("percentile")).agg(
        F.sum(F.when(F.col("slice") <= F.col("x.last"), F.col("t"))).alias("train"),
        F.sum(F.when(F.col("slice") == F.col("x.last") + 1, F.col("t"))).alias("eval"),
        F.sum(F.when(F.col("slice") <= F.col("x.last"), F.col("pairs"))).alias("pair_observations"),
    )
    shown = displayed.groupBy("repo_id", F.col("partition").alias("percentile")).agg(F.count("*").alias("shown"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    key = ["repo_id", "percentile"]
    return rows.join(counts, key, "left").join(shown, key, "left").select(
        *key, "cutoff_id", F.lit(1).alias("train_first"), F.col("bound").alias("train_last"), (F.col("bound") + 1).alias("eval_first"), "eval_last",
        zero("train").alias("train_eligible"), zero("eval").alias("eval_eligible"), zero("pair_observations").alias("pair_observations"), zero("shown").alias("displayed"),
    )


def shuffled_order(events: DataFrame) -> DataFrame:
    """events renumbered by the hash of repository object (the tip) and event id: the control ordering. No repository is
    sorted in one task."""
    tips = events.groupBy("repo_id").agg(F.max_by("event_id", "seq").alias("tip"))
    hashed = events.join(tips, "repo_id").withColumn("h", joined_hash(SHUFFLE_TAG, F.col("tip"), F.col("event_id")))
    return ranked(hashed.drop("seq"), ["repo_id"], ["h", "event_id"], "seq").drop("h", "tip").select(*events.columns)
