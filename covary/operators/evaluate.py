"""Holdout evaluation of displayed candidates in the slice after their training snapshot.

Counts of a candidate in its window are the component and pair counts of that slice, so the transactions are touched
again only for coverage and for listing deviations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covary.operators.partitions import FULL, PERCENTILES

RC = ["repo_id", "config_id"]


def window(partition: Column) -> Column:
    """The slice in which candidates of a cutoff are evaluated."""
    return F.coalesce(*[F.when(partition == p, F.lit(i + 2)) for i, p in enumerate(PERCENTILES)])


def evaluated(displayed: DataFrame) -> DataFrame:
    """Displayed candidates of the four cutoffs with their window's `slice`."""
    return displayed.where(F.col("partition") < FULL).withColumn("slice", window(F.col("partition")))


def cases(repos: DataFrame, grid: DataFrame) -> DataFrame:
    """Every (repository, configuration): both sides are small, one by the corpus, one by the grid."""
    return repos.select("repo_id").distinct().join(F.broadcast(grid.select("config_id")))


def holdout_counts(displayed: DataFrame, components: DataFrame, pairs: DataFrame) -> DataFrame:
    """displayed with opportunities, adherences and adherence (null without opportunity) in the window."""
    c = components.groupBy("repo_id", "slice", "a").agg(F.sum("n").alias("opportunities"))
    p = pairs.groupBy("repo_id", "slice", "a", "b").agg(F.sum("n").alias("adherences"))
    out = evaluated(displayed).join(c, ["repo_id", "slice", "a"], "left").join(p, ["repo_id", "slice", "a", "b"], "left")
    out = out.withColumns({x: F.coalesce(x, F.lit(0)).cast("bigint") for x in ("opportunities", "adherences")})
    return out.withColumn("adherence", F.try_divide("adherences", "opportunities"))


def micro_macro(counts: DataFrame) -> DataFrame:
    """(repo_id, config_id, micro, macro, deviation): pooled and averaged adherence; null without opportunities. The mean
    is folded over the sorted adherences, at most 40 a group, so that it doesn't depend on the order of a shuffle."""
    micro = F.try_divide(F.sum("adherences"), F.sum("opportunities"))
    g = counts.groupBy(*RC).agg(micro.alias("micro"), F.sort_array(F.collect_list("adherence")).alias("each"))
    macro = F.try_divide(F.aggregate("each", F.lit(0.0), lambda acc, x: acc + x), F.size("each"))
    return g.select(*RC, "micro", macro.alias("macro"), (1 - F.col("micro")).alias("deviation"))


def coverage(displayed: DataFrame, tx: DataFrame, grid: DataFrame) -> DataFrame:
    """(repo_id, config_id, slice, eligible, covered) per window: transactions with a displayed antecedent. Of a
    transaction only the antecedents matter that any configuration displays: transactions with the same of them are
    counted together, and only these counts are held against the configurations."""
    later = tx.where("slice > 1")
    n = later.groupBy("repo_id", "slice").agg(F.count("*").alias("eligible"))
    a = evaluated(displayed).select(*RC, "slice", "a").distinct()
    every = a.groupBy("repo_id", "slice").agg(F.collect_set("a").alias("every"))  # ten a configuration at most
    own = F.array_sort(F.array_intersect("components", "every")).alias("own")
    alike = later.join(every, ["repo_id", "slice"]).groupBy("repo_id", "slice", own).agg(F.count("*").alias("n"))
    hit = alike.select("repo_id", "slice", "own", "n", F.explode("own").alias("a")).join(a, ["repo_id", "slice", "a"])
    covered = hit.select(*RC, "slice", "own", "n").distinct().groupBy(*RC, "slice").agg(F.sum("n").alias("covered"))
    return n.join(F.broadcast(grid.select("config_id"))).join(covered, [*RC, "slice"], "left").select(*RC, "slice", "eligible", F.coalesce("covered", F.lit(0)).cast("bigint").alias("covered"))


def pooled_coverage(windows: DataFrame) -> DataFrame:
    """(repo_id, config_id, coverage, least_covered)."""
    return windows.groupBy(*RC).agg(F.try_divide(F.sum("covered"), F.sum("eligible")).alias("coverage"), F.min("covered").alias("least_covered"))


def cutoff_abstention(displayed: DataFrame, repos: DataFrame, grid: DataFrame) -> DataFrame:
    """(repo_id, config_id, abstention, displayed): the share of the cutoffs that show nothing."""
    shown = displayed.where(F.col("partition") < FULL).groupBy(*RC).agg(F.count_distinct("partition").alias("some"), F.count("*").alias("displayed"))
    some = F.coalesce("some", F.lit(0))
    return cases(repos, grid).join(shown, RC, "left").select(*RC, ((len(PERCENTILES) - some) / len(PERCENTILES)).alias("abstention"), F.coalesce("displayed", F.lit(0)).cast("bigint").alias("displayed"))


def _adjacent(displayed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates as the earlier and as the later side of neighbouring cutoffs, keyed by the earlier one."""
    d = displayed.where(F.col("partition") < FULL)
    early = d.where(F.col("partition") < PERCENTILES[-1]).select(*RC, F.col("partition").alias("cutoff"), "a", "b", F.col("rank").alias("r1"))
    late = d.where(F.col("partition") > PERCENTILES[0]).select(*RC, (F.col("partition") - 10).alias("cutoff"), "a", "b", F.col("rank").alias("r2"))
    return early, late


def _neighbours(repos: DataFrame, grid: DataFrame) -> DataFrame:
    return cases(repos, grid).select("*", F.explode(F.array(*map(F.lit, PERCENTILES[:-1]))).alias("cutoff"))


def adjacent_jaccard(displayed: DataFrame, repos: DataFrame, grid: DataFrame) -> DataFrame:
    """(repo_id, config_id, cutoff, jaccard, reason) of each cutoff and the next."""
    early, late = _adjacent(displayed)
    both = early.join(late, [*RC, "cutoff", "a", "b"], "full").groupBy(*RC, "cutoff").agg(F.count_if(F.col("r1").isNotNull() & F.col("r2").isNotNull()).alias("i"), F.count("*").alias("u"))
    out = _neighbours(repos, grid).join(both, [*RC, "cutoff"], "left")
    return out.select(*RC, "cutoff", F.try_divide("i", "u").alias("jaccard"), F.when(F.col("u").isNull(), "empty_candidate_sets").alias("reason"))


def kendall_tau_b(displayed: DataFrame, repos: DataFrame, grid: DataFrame) -> DataFrame:
    """(repo_id, config_id, cutoff, survivors, tau, reason) over candidates ranked at both cutoffs; ranks have no ties."""
    early, late = _adjacent(displayed)
    stay = early.join(late, [*RC, "cutoff", "a", "b"]).groupBy(*RC, "cutoff").agg(F.sort_array(F.collect_list(F.struct("r1", "r2"))).alias("s"))  # at most 10
    sign = lambda x, y: F.signum((y["r2"] - x["r2"]).cast("double"))
    total = F.aggregate(F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: sign(x, y)))), F.lit(0.0), lambda acc, v: acc + v)
    n = F.coalesce(F.size("s"), F.lit(0))
    out = _neighbours(repos, grid).join(stay, [*RC, "cutoff"], "left").withColumn("survivors", F.when(F.col("s").isNull(), 0).otherwise(n))
    enough = F.col("survivors") >= 2
    return out.select(*RC, "cutoff", "survivors", F.when(enough, total / (F.col("survivors") * (F.col("survivors") - 1) / 2)).alias("tau"), F.when(~enough, "insufficient_rank_overlap").alias("reason"))


def holdout_deviations(displayed: DataFrame, tx: DataFrame) -> DataFrame:
    """(repo_id, config_id, partition, a, b, event_id): window events with a and without b."""
    d = evaluated(displayed).select(*RC, "partition", "slice", "a", "b")
    hit = tx.select("repo_id", "slice", "event_id", "components", F.explode("components").alias("a")).join(d, ["repo_id", "slice", "a"])
    return hit.where(~F.array_contains("components", F.col("b"))).select(*RC, "partition", "a", "b", "event_id")


def repository_metrics(displayed: DataFrame, tx: DataFrame, components: DataFrame, pairs: DataFrame, grid: DataFrame) -> DataFrame:
    """A row per repository and configuration, each null measure with its reason."""
    mm = micro_macro(holdout_counts(displayed, components, pairs))
    cov = pooled_coverage(coverage(displayed, tx, grid))
    jac = adjacent_jaccard(displayed, tx, grid).groupBy(*RC).agg(F.min("jaccard").alias("min_jaccard"), F.count("jaccard").alias("n_jaccard"))
    at = lambda c: F.max(F.when(F.col("cutoff") == c, F.col("tau"))).alias(f"tau_{c}")
    tau = kendall_tau_b(displayed, tx, grid).groupBy(*RC).agg(*map(at, PERCENTILES[:-1]))  # a diagnostic, null with fewer than two survivors
    out = cutoff_abstention(displayed, tx, grid).join(mm, RC, "left").join(cov, RC, "left").join(jac, RC, "left").join(tau, RC, "left")
    why = F.when(F.col("micro").isNull(), F.when(F.col("displayed") == 0, "no_candidates").otherwise("no_opportunities"))
    return out.select(
        *RC, "micro", "macro", why.alias("adherence_reason"), "coverage", F.when(F.col("coverage").isNull(), "no_eligible_evaluation_events").alias("coverage_reason"),
        "least_covered", "abstention", "displayed", "min_jaccard", "n_jaccard", F.when(F.col("min_jaccard").isNull(), "empty_candidate_sets").alias("jaccard_reason"),
        *[f"tau_{c}" for c in PERCENTILES[:-1]],
    )
