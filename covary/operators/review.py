"""Reproducible review samples, ordered by hash, and the gates over review labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covary.functions.scalars import base64url, review_hash
from covary.operators.calibrate import conjunctive_outcome


def _b64(c: str):
    return base64url(F.col(c))


def sample_candidates(final: DataFrame, n: int = 8) -> DataFrame:
    """The n lowest-hash candidates of each repository's final proposal; final(repo_id, repository, a, b)."""
    h = review_hash(F.col("repository"), "inferred-candidate", "inferred", _b64("a"), _b64("b"))
    rows = final.select("repo_id", "repository", "a", "b").distinct().withColumn("hash", h)
    w = Window.partitionBy("repo_id").orderBy("hash")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def sample_deviations(devs: DataFrame, sampled: DataFrame, n: int = 10) -> DataFrame:
    """devs(repo_id, repository, a, b, cutoff_id, event_id): the lowest-hash deviation of each sampled candidate, then
    the lowest of the rest, n in all, in hash order. No candidate has more than its n + 1 lowest picked from, which each
    task cuts it to before it sends any; equal rows have equal hashes and go after that."""
    h = review_hash(F.col("repository"), "deviation", "inferred", _b64("a"), _b64("b"), F.col("cutoff_id"), F.col("event_id"))
    rows = devs.join(sampled.select("repo_id", "a", "b"), ["repo_id", "a", "b"], "left_semi").select("repo_id", "repository", "a", "b", "cutoff_id", "event_id").withColumn("hash", h)
    own = F.dense_rank().over(Window.partitionBy("repo_id", "a", "b").orderBy("hash"))
    rows = rows.withColumn("own", own).where(F.col("own") <= n + 1).distinct().withColumn("later", (F.col("own") > 1).cast("int")).drop("own")
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy("later", "hash"))
    picked = rows.withColumn("p", place).where(F.col("p") <= n)
    return picked.withColumn("place", F.row_number().over(Window.partitionBy("repo_id").orderBy("hash"))).drop("p", "later")


#: Units needed and useful labels among them: of eight candidates six decisions, of ten deviations six worth a review.
NEED = {"candidate": (8, 6, "decision"), "deviation": (10, 6, "review-worthy")}


def label_precision(labels: DataFrame) -> DataFrame:
    """labels(repo_id, unit_kind, unit_id, label) -> useful and labelled units and the outcome; unclear labels stay in
    the denominator; fewer units than needed are inconclusive."""
    case = lambda i: F.coalesce(*[F.when(F.col("unit_kind") == k, F.lit(v[i])) for k, v in NEED.items()])
    g = labels.withColumn("useful", (F.col("label") == case(2)).cast("int")).groupBy("repo_id", "unit_kind").agg(F.count("*").alias("units"), F.sum("useful").alias("useful"))
    outcome = F.when(F.col("units") < case(0), "inconclusive").when(F.col("useful") >= case(1), "pass").otherwise("fail")
    return g.withColumn("outcome", outcome)


def adoption_gate(log: DataFrame, need: int = 3, within: float = 600.0, by: tuple[str, ...] = ("repo_id",)) -> DataFrame:
    """log(repo_id, elapsed, useful, interrupted): seconds to the need-th useful acceptance and the outcome, for each
    value of `by`."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("elapsed"))
    nth = log.where("useful").withColumn("nth", nth).where(F.col("nth") == need).select(*by, F.col("elapsed").alias("reached"))
    g = log.groupBy(*by).agg(F.count("*").alias("proposals"), F.bool_or("interrupted").alias("interrupted")).join(nth, list(by), "left")
    outcome = F.when(F.col("interrupted"), "inconclusive").when(F.coalesce(F.col("reached") <= within, F.lit(False)) & (F.col("proposals") >= need), "pass").otherwise("fail")
    return g.select(*by, "proposals", "reached", outcome.alias("outcome"))


#: What each lane must pass: all of it, and overall both lanes.
LANES = {"inferred": ("candidate_precision", "deviation_precision", "adoption", "rediscovery"), "profile": ("adoption",)}


def lane_dimensions(precision: DataFrame, adoption: DataFrame, rediscovery: DataFrame) -> DataFrame:
    """(repo_id, lane, dimension, outcome) from label_precision(), adoption_gate() by lane and (repo_id, rediscovered)."""
    found = F.when(F.col("rediscovered"), "pass").otherwise("fail")
    return (
        precision.select("repo_id", F.lit("inferred").alias("lane"), F.concat("unit_kind", F.lit("_precision")).alias("dimension"), "outcome")
        .union(adoption.select("repo_id", "lane", F.lit("adoption"), "outcome"))
        .union(rediscovery.select("repo_id", F.lit("inferred"), F.lit("rediscovery"), found))
    )


def lane_outcome(dimensions: DataFrame, lanes: dict[str, tuple[str, ...]] = LANES) -> DataFrame:
    """dimensions(repo_id, lane, dimension, outcome) -> the outcome of each lane and, as lane `overall`, of both. A
    dimension that is required and absent is inconclusive, so that neither lane makes up for the other."""
    required = F.explode(F.array(*[F.struct(F.lit(k).alias("lane"), F.lit(d).alias("dimension")) for k, ds in lanes.items() for d in ds])).alias("x")
    every = dimensions.select("repo_id").distinct().select("repo_id", required).select("repo_id", "x.*")
    rows = every.join(dimensions, ["repo_id", "lane", "dimension"], "left").fillna("inconclusive", ["outcome"])
    return conjunctive_outcome(rows, ["repo_id", "lane"]).unionByName(conjunctive_outcome(rows, ["repo_id"]).withColumn("lane", F.lit("overall")))
