"""Baselines and controls that a model's holdout adherence is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covary.operators.evaluate import RC, holdout_counts, micro_macro
from covary.operators.mining import DISPLAY, FLOOR, cumulative_training, display


def frequent_consequent(displayed: DataFrame, components: DataFrame) -> DataFrame:
    """displayed with b replaced by the component most frequent in training other than a (ties by bytes)."""
    raw = cumulative_training(components).groupBy("repo_id", "partition", "a").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("repo_id", "partition").orderBy(F.desc("n"), "a"))
    top = raw.withColumn("place", place).where("place <= 2").groupBy("repo_id", "partition").agg(F.min_by("a", "place").alias("top1"), F.max_by("a", "place").alias("top2"))
    best = F.when(F.col("top1") != F.col("a"), F.col("top1")).otherwise(F.when(F.col("top2") != F.col("a"), F.col("top2")))
    return displayed.join(top, ["repo_id", "partition"]).withColumn("b", best).drop("top1", "top2").where("b IS NOT NULL")


def unweighted(grid: DataFrame) -> DataFrame:
    """The grid's non-unit configurations with unit weight in their place."""
    return grid.where("weight != 'unit'").withColumn("weight", F.lit("unit"))


def unweighted_baseline(tx: DataFrame, grid: DataFrame, k: int = DISPLAY, floor: int = FLOOR) -> DataFrame:
    """What the non-unit configurations would display under unit weight."""
    return display(tx, unweighted(grid), k, floor)


def no_history_control(tx: DataFrame, grid: DataFrame) -> DataFrame:
    """Candidates of an empty training partition: there must be none."""
    return display(tx.limit(0), grid)


def no_history_outcomes(tx: DataFrame, grid: DataFrame) -> DataFrame:
    """(repo_id, transactions, candidates, outcome): what each repository displays when trained on none of its own."""
    shown = no_history_control(tx, grid).groupBy("repo_id").agg(F.count("*").alias("candidates"))
    n = F.coalesce("candidates", F.lit(0)).cast("bigint")
    have = tx.groupBy("repo_id").agg(F.count("*").alias("transactions")).join(shown, "repo_id", "left")
    return have.select("repo_id", "transactions", n.alias("candidates"), F.when(n == 0, "pass").otherwise("fail").alias("outcome"))


def gain_over_baselines(model: DataFrame, baselines: dict[str, DataFrame], grid: DataFrame) -> DataFrame:
    """(repo_id, config_id, baseline, micro_gain, macro_gain, reason): model and baselines are micro_macro frames."""
    out = None
    for name, df in baselines.items():
        b = df.select(*RC, F.col("micro").alias("bmi"), F.col("macro").alias("bma"))
        j = model.join(b, RC, "left").join(F.broadcast(grid.select("config_id", "weight")), "config_id")
        same = (F.lit(name) == "unweighted") & (F.col("weight") == "unit")
        gain = lambda x, y, same=same: F.when(~same, F.col(x) - F.col(y))
        reason = F.when(same, "identical_baseline").when(F.col("bmi").isNull() | F.col("micro").isNull(), "no_opportunities")
        one = j.select(*RC, F.lit(name).alias("baseline"), gain("micro", "bmi").alias("micro_gain"), gain("macro", "bma").alias("macro_gain"), reason.alias("reason"))
        out = one if out is None else out.union(one)
    return out


def measured(displayed: DataFrame, components: DataFrame, pairs: DataFrame) -> DataFrame:
    return micro_macro(holdout_counts(displayed, components, pairs))


def control_outcomes(displayed: DataFrame, tx: DataFrame, events: DataFrame, roles: DataFrame) -> DataFrame:
    """(repo_id, control, observed, outcome) for the roles(repo_id, role) of control repositories: a `young` one must
    display nothing, and of a `template_origin` no root event may be evidence."""
    shown = displayed.groupBy("repo_id").agg(F.count("*").alias("n")).withColumn("role", F.lit("young"))
    roots = tx.join(events.where("kind = 'root'"), ["repo_id", "event_id"], "left_semi").groupBy("repo_id").agg(F.count("*").alias("n")).withColumn("role", F.lit("template_origin"))
    own = roles.where(F.col("role").isin("young", "template_origin")).select("repo_id", "role").distinct()
    observed = F.coalesce("n", F.lit(0)).cast("bigint")
    out = own.join(shown.unionByName(roots), ["repo_id", "role"], "left")
    return out.select("repo_id", F.col("role").alias("control"), observed.alias("observed"), F.when(observed == 0, "pass").otherwise("fail").alias("outcome"))
