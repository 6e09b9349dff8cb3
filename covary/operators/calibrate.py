"""Calibration over the configuration grid: metrics, gates, selection and the lock.

The configuration is a column, not a loop: one aggregation of the history serves all 81."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covary.functions.scalars import WEIGHTS
from covary.operators import baselines as bas
from covary.operators import evaluate as evl
from covary.operators import mining, partitions
from covary.sources.store import stored

RC = ["repo_id", "config_id"]
SEVERITY = {"pass": 0, "inconclusive": 1, "fail": 2}
GAIN = {"development": 0.10, "holdout": 0.05}


def both_orders(tx: DataFrame, events: DataFrame) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]:
    """((sliced tx, pair counts) of the chain, (the same) of the hash-shuffled control). The two differ in a
    transaction's slice only, so pairs are made once, with both slices, and the counts of each follow from those."""
    of = ["repo_id", "event_id"]
    shuffled = partitions.slices(partitions.shuffled_order(events)).select(*of, F.col("slice").alias("other"))
    sliced = stored(partitions.with_slices(tx, events).join(shuffled, of))
    pairs = sliced.select("repo_id", "slice", "other", "k", "components", F.explode("components").alias("a"))
    pairs = pairs.select("repo_id", "slice", "other", "k", "a", F.explode("components").alias("b")).where("a != b")
    joint = stored(pairs.groupBy("repo_id", "a", "b", "k", "slice", "other").agg(F.count("*").alias("n")))
    counts = lambda c: joint.groupBy("repo_id", F.col(c).alias("slice"), "a", "b", "k").agg(F.sum("n").alias("n"))
    return (sliced.drop("other"), counts("slice")), (sliced.drop("slice").withColumnRenamed("other", "slice"), counts("other"))


def calibrate(events: DataFrame, tx: DataFrame, grid: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metrics, gains, displayed) of every repository and configuration, baselines and the shuffled control included.
    tx are unsliced transactions."""
    (sliced, pair), (shuffled, shuffled_pair) = both_orders(tx, events)
    comp, shuffled_comp = stored(mining.component_stats(sliced)), stored(mining.component_stats(shuffled))
    measured = stored(mining.pair_metrics(pair, comp, mining.totals(sliced)))
    shown = stored(mining.displayed(measured, grid))
    metrics = stored(evl.repository_metrics(shown, sliced, comp, pair, grid))
    control = mining.displayed(mining.pair_metrics(shuffled_pair, shuffled_comp, mining.totals(shuffled)), grid)
    others = {
        "frequent": bas.measured(bas.frequent_consequent(shown, comp), comp, pair),
        "unweighted": bas.measured(mining.displayed(measured, bas.unweighted(grid)), comp, pair),
        "shuffled": bas.measured(control, shuffled_comp, shuffled_pair),
    }
    return metrics, stored(bas.gain_over_baselines(metrics, others, grid)), shown


def calibration_controls(events: DataFrame, tx: DataFrame, displayed: DataFrame, grid: DataFrame, roles: DataFrame) -> DataFrame:
    """(repo_id, control, observed, outcome): the no-history control of every repository, and those that roles ask for."""
    none = bas.no_history_outcomes(tx, grid).select("repo_id", F.lit("no_history").alias("control"), F.col("candidates").alias("observed"), "outcome")
    return none.union(bas.control_outcomes(displayed, tx, events, roles))


def engineering_gates(metrics: DataFrame, gains: DataFrame, displayed: DataFrame, floor: DataFrame, role: str = "development") -> DataFrame:
    """(repo_id, config_id, gate, outcome, metric, operator, threshold, reason). floor is inference_floor()'s frame. Gains are compared at nine places, so that
    a difference of two equal means isn't below zero by its last bit."""

    def needs(value, ok):
        return F.when(value.isNull(), "inconclusive").when(ok, "pass").otherwise("fail")

    shown = displayed.groupBy(*RC, "partition").agg(F.count("*").alias("c"))
    per = metrics.select(*RC).join(floor.where(F.col("partition") < partitions.FULL), "repo_id").join(shown, [*RC, "partition"], "left")
    count = F.when(F.col("abstains"), 1).when(F.coalesce("c", F.lit(0)).between(1, mining.DISPLAY), 0).otherwise(2)
    fewest = F.min(F.when(~F.col("abstains"), F.coalesce("c", F.lit(0)))).alias("fewest")
    emitted = per.groupBy(*RC).agg(F.max(count).alias("s"), fewest).select(*RC, "fewest", F.element_at(F.array(F.lit("pass"), F.lit("inconclusive"), F.lit("fail")), F.col("s") + 1).alias("candidate_count"))
    least = gains.select(*RC, "baseline", F.round(F.least("micro_gain", "macro_gain"), 9).alias("g"), "reason")
    g = least.groupBy(*RC).agg(
        *[F.max(F.when(F.col("baseline") == b, F.col("g"))).alias(b) for b in ("frequent", "unweighted", "shuffled")],
        F.max(F.when(F.col("baseline") == "unweighted", F.col("reason"))).alias("same"),
    )
    j = metrics.join(emitted, RC, "left").join(g, RC, "left")
    col = F.col
    same, none = col("same") == "identical_baseline", F.lit(None).cast("string")
    # outcome, metric, threshold and, where the metric is undefined, why
    gates = {
        "candidate_count": (F.coalesce("candidate_count", F.lit("inconclusive")), col("fewest"), 1.0, F.when(col("fewest").isNull(), "below_inference_floor")),
        "coverage": (needs(col("coverage"), col("coverage") >= 0.05), col("coverage"), 0.05, F.when(col("coverage").isNull(), "no_eligible_evaluation_events")),
        "window_coverage": (needs(col("least_covered"), col("least_covered") >= 1), col("least_covered"), 1.0, F.when(col("least_covered").isNull(), "no_eligible_evaluation_events")),
        "gain_frequent": (needs(col("frequent"), col("frequent") >= GAIN[role]), col("frequent"), GAIN[role], F.when(col("frequent").isNull(), "no_opportunities")),
        "not_below_unweighted": (F.when(same, "pass").otherwise(needs(col("unweighted"), col("unweighted") >= 0)), F.when(~F.coalesce(same, F.lit(False)), col("unweighted")), 0.0, F.when(same, "identical_baseline").when(col("unweighted").isNull(), "no_opportunities")),
        "gain_shuffled": (needs(col("shuffled"), col("shuffled") >= 0.05), col("shuffled"), 0.05, F.when(col("shuffled").isNull(), "no_opportunities")),
        "stability": (F.when(col("n_jaccard") < 3, "inconclusive").otherwise(needs(col("min_jaccard"), col("min_jaccard") >= 0.5)), col("min_jaccard"), 0.5, F.when(col("min_jaccard").isNull(), "empty_candidate_sets")),
    }
    each = [F.struct(F.lit(k).alias("gate"), o.alias("outcome"), m.cast("double").alias("metric"), F.lit(">=").alias("operator"), F.lit(t).alias("threshold"), F.coalesce(why, none).alias("reason")) for k, (o, m, t, why) in gates.items()]
    return j.select(*RC, F.explode(F.array(*each)).alias("x")).select(*RC, "x.*")


def conjunctive_outcome(gates: DataFrame, keys: list[str]) -> DataFrame:
    """fail if any fails, else inconclusive if any is, else pass."""
    worst = F.max(F.coalesce(*[F.when(F.col("outcome") == k, F.lit(v)) for k, v in SEVERITY.items()]))
    return gates.groupBy(*keys).agg(worst.alias("s")).select(*keys, F.element_at(F.array(*map(F.lit, SEVERITY)), F.col("s") + 1).alias("outcome"))


def select_configuration(metrics: DataFrame, gains: DataFrame, gates: DataFrame, grid: DataFrame, controls: DataFrame | None = None) -> DataFrame:
    """The one configuration that passes all gates on every repository and ranks first, or no row; no row either if any
    of the required controls fails."""
    passing = conjunctive_outcome(gates, ["config_id"]).where("outcome = 'pass'")
    if controls is not None:
        broken = controls.where("outcome != 'pass'").groupBy().agg(F.count("*").alias("broken")).where("broken = 0")
        passing = passing.join(broken)  # one row or none
    worst = gains.where("baseline = 'frequent'").groupBy("config_id").agg(F.min(F.least("micro_gain", "macro_gain")).alias("worst_gain"))
    least = metrics.groupBy("config_id").agg(F.min("coverage").alias("worst_coverage"), F.min("min_jaccard").alias("min_jaccard"))
    simple = F.array_position(F.array(*map(F.lit, WEIGHTS)), F.col("weight"))
    ranked = passing.select("config_id").join(worst, "config_id").join(least, "config_id").join(F.broadcast(grid), "config_id")
    order = [F.desc(F.round("worst_gain", 9)), F.desc(F.round("worst_coverage", 9)), F.desc(F.round("min_jaccard", 9)), simple, "min_opportunity", "min_confidence", "min_lift", "config_id"]
    return ranked.orderBy(*order).limit(1).select("config_id", "worst_gain", "worst_coverage", "min_jaccard")
