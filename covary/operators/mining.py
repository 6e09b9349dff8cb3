"""Directional co-change: counts, weighted measures, eligibility and ranking.

Weighted sums must not depend on the order in which a shuffle adds doubles, so counts are kept as integers per
component count k (`hist`) and folded over ascending k only after aggregation. The same counts serve all three size
weights, and slices of the chain are summed once and then handed to every cutoff that includes them."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from covary.functions.scalars import WEIGHTS, candidate_id, size_weight
from covary.operators.partitions import SNAPSHOTS
from covary.sources.store import stored

FLOOR, SUPPORT, DISPLAY = 100, 3, 10
RANKING = ("confidence desc", "lift desc", "support desc", "opportunity desc", "a", "b")
OPPORTUNITIES, CONFIDENCES, LIFTS = (5, 10, 20), (0.70, 0.80, 0.90), (1.25, 1.50, 2.00)
DEFAULT = "weight=inverse-component;opportunities=5;confidence=0.70;lift=1.25"
GRID = "config_id string, weight string, min_opportunity int, min_confidence double, min_lift double"


def config_grid(spark: SparkSession, only: str | None = None) -> DataFrame:
    """The 81 configurations, or the one named."""
    rows = [(f"weight={w};opportunities={o};confidence={c:.2f};lift={x:.2f}", w, o, c, x) for w, o, c, x in product(WEIGHTS, OPPORTUNITIES, CONFIDENCES, LIFTS)]
    return spark.createDataFrame([r for r in rows if only in (None, r[0])], GRID)


def component_stats(tx: DataFrame) -> DataFrame:
    """(repo_id, slice, a, k, n): transactions of k components that have a."""
    return tx.select("repo_id", "slice", "k", F.explode("components").alias("a")).groupBy("repo_id", "slice", "a", "k").agg(F.count("*").alias("n"))


def pair_stats(tx: DataFrame) -> DataFrame:
    """(repo_id, slice, a, b, k, n): the same for ordered pairs. Pairs come out of the row's own array, no self-join;
    partial counts absorb hot pairs before the shuffle."""
    pairs = tx.select("repo_id", "slice", "k", "components", F.explode("components").alias("a"))
    pairs = pairs.select("repo_id", "slice", "k", "a", F.explode("components").alias("b")).where("a != b")
    return pairs.groupBy("repo_id", "slice", "a", "b", "k").agg(F.count("*").alias("n"))


def totals(tx: DataFrame) -> DataFrame:
    """(repo_id, slice, k, n)."""
    return tx.groupBy("repo_id", "slice", "k").agg(F.count("*").alias("n"))


def cumulative_training(stats: DataFrame) -> DataFrame:
    """Slice counts -> `partition` counts: slice s counts for every snapshot from the s-th on."""
    keys = [c for c in stats.columns if c not in ("slice", "n")]
    at = F.explode(F.slice(F.array(*map(F.lit, SNAPSHOTS)), F.col("slice"), F.lit(len(SNAPSHOTS)))).alias("partition")
    return stats.select(*keys, "n", at).groupBy("partition", *keys).agg(F.sum("n").alias("n"))


def snapshots(stats: DataFrame, weights=WEIGHTS) -> DataFrame:
    """Slice counts by k -> a row per key with `raw`, the count in each snapshot, and `value`, the weighted sum in each
    snapshot under the first size weight, then the second, and so on. Both follow from one exchange on the key: the
    slices are summed up within it, and a key's few (k, counts, products) are added over ascending k within its row."""
    keys = [c for c in stats.columns if c not in ("slice", "k", "n")]
    at = range(len(SNAPSHOTS))
    upto = [F.sum(F.when(F.col("slice") <= i + 1, F.col("n")).otherwise(0)).alias(f"n{i}") for i in at]
    by_k = stats.repartition(*keys).groupBy(*keys, "k").agg(*upto)
    products = F.array(*[F.col(f"n{i}").cast("double") * size_weight(F.lit(w), F.col("k")) for w in weights for i in at])
    each = F.struct("k", F.array(*[f"n{i}" for i in at]).alias("raw"), products.alias("value"))
    hist = by_k.groupBy(*keys).agg(F.sort_array(F.collect_list(each)).alias("hist"))  # an entry per k

    def total(name: str, zero: Column) -> Column:
        start = F.array_repeat(zero, len(SNAPSHOTS) * (len(weights) if name == "value" else 1))
        return F.aggregate("hist", start, lambda acc, x: F.zip_with(acc, x[name], lambda u, v: u + v)).alias(name)

    return hist.select(*keys, total("raw", F.lit(0).cast("bigint")), total("value", F.lit(0.0)))


def pair_metrics(pairs: DataFrame, components: DataFrame, total: DataFrame, weights=WEIGHTS) -> DataFrame:
    """Slice counts -> per pair, snapshot and weight: raw and weighted measures. Undefined ones are null. Pairs are joined
    to their components once, with all snapshots and weights in the row; only then a row per snapshot and weight is
    made, of those that the pair occurs in."""
    p, c, t = (snapshots(x, weights).withColumnsRenamed({"raw": f"{n}_raw", "value": f"{n}_value"}) for n, x in (("p", pairs), ("c", components), ("t", total)))
    b = c.select("repo_id", F.col("a").alias("b"), F.col("c_value").alias("b_value"))
    j = p.join(c, ["repo_id", "a"]).join(b, ["repo_id", "b"]).join(t, "repo_id")

    def one(i: int, k: int) -> Column:
        names = {"opportunity": F.col("c_raw")[i], "support": F.col("p_raw")[i], "transactions": F.col("t_raw")[i]}
        names |= {n: F.col(f"{x}_value")[k * len(SNAPSHOTS) + i] for n, x in (("weighted_exposure", "c"), ("weighted_support", "p"), ("b_exposure", "b"), ("total_weight", "t"))}
        return F.struct(F.lit(SNAPSHOTS[i]).alias("partition"), F.lit(weights[k]).alias("weight"), *[v.alias(n) for n, v in names.items()])

    every = F.array(*[one(i, k) for i in range(len(SNAPSHOTS)) for k in range(len(weights))])
    j = j.select("repo_id", "a", "b", F.explode(F.filter(every, lambda x: x["support"] > 0)).alias("x")).select("repo_id", "a", "b", "x.*")
    j = j.withColumn("confidence", F.try_divide("weighted_support", "weighted_exposure")).withColumn("prevalence", F.try_divide("b_exposure", "total_weight"))
    j = j.withColumn("lift", F.try_divide("confidence", "prevalence"))
    return j.select("repo_id", "partition", "weight", "a", "b", "opportunity", "support", "weighted_exposure", "weighted_support", "confidence", "prevalence", "lift", "transactions")


def metrics_of(tx: DataFrame, weights=WEIGHTS) -> DataFrame:
    """pair_metrics over all snapshots of sliced transactions."""
    return pair_metrics(*(f(tx) for f in (pair_stats, component_stats, totals)), weights)


def inference_floor(total: DataFrame, floor: int = FLOOR) -> DataFrame:
    """Cumulative totals -> (repo_id, partition, transactions, abstains, reason)."""
    n = total.groupBy("repo_id", "partition").agg(F.sum("n").alias("transactions"))
    low = F.col("transactions") < floor
    return n.select("*", low.alias("abstains"), F.when(low, "below_inference_floor").alias("reason"))


def loosely(metrics: DataFrame, floor: int = FLOOR) -> DataFrame:
    """Pairs that meet the loosest thresholds of all."""
    return metrics.where(
        (F.col("support") >= SUPPORT) & (F.col("opportunity") >= min(OPPORTUNITIES)) & (F.col("confidence") >= min(CONFIDENCES)) & (F.col("lift") >= min(LIFTS)) & (F.col("transactions") >= floor)
    )


def eligible(metrics: DataFrame, grid: DataFrame, floor: int = FLOOR) -> DataFrame:
    """Pairs that meet every threshold of a configuration. The loosest thresholds go first; the grid is at most 81
    rows, so it is broadcast and joined on the weight."""
    meets = (F.col("opportunity") >= F.col("min_opportunity")) & (F.col("confidence") >= F.col("min_confidence")) & (F.col("lift") >= F.col("min_lift"))
    return loosely(metrics, floor).join(F.broadcast(grid), "weight").where(meets).drop("min_opportunity", "min_confidence", "min_lift")


def _order() -> list[Column]:
    return [F.desc("confidence"), F.desc("lift"), F.desc("support"), F.desc("opportunity"), F.asc("a"), F.asc("b")]


def rank_candidates(pairs: DataFrame, k: int = DISPLAY) -> DataFrame:
    """The first k of each (repository, configuration, partition), with `rank`."""
    rank = F.row_number().over(Window.partitionBy("repo_id", "config_id", "partition").orderBy(*_order()))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def best_of_cells(metrics: DataFrame, grid: DataFrame, k: int = DISPLAY) -> DataFrame:
    """Of each snapshot's pairs the first k of every cell between the grid's thresholds. A pair's cell tells which
    thresholds it meets, and a configuration takes whole cells: what it displays is among the first k of each, so that
    only these are held against the configurations, however many pairs there are."""
    grid_rows = grid.collect()  # at most 81
    cell = {f"cell_{m}": sum((F.when(F.col(m) >= t, 1).otherwise(0) for t in sorted({r[f"min_{m}"] for r in grid_rows})), F.lit(0)) for m in ("opportunity", "confidence", "lift")}
    place = F.row_number().over(Window.partitionBy("repo_id", "partition", "weight", *cell).orderBy(*_order()))
    return metrics.withColumns(cell).withColumn("place", place).where(F.col("place") <= k).drop("place", *cell)


def displayed(metrics: DataFrame, grid: DataFrame, k: int = DISPLAY, floor: int = FLOOR) -> DataFrame:
    """Measures -> displayed candidates with ids."""
    ranked = rank_candidates(eligible(best_of_cells(loosely(metrics, floor), grid, k), grid, floor), k)
    return ranked.withColumn("candidate_id", candidate_id(F.col("a"), F.col("b")))


def display(tx: DataFrame, grid: DataFrame, k: int = DISPLAY, floor: int = FLOOR) -> DataFrame:
    """Sliced transactions -> displayed candidates."""
    return displayed(metrics_of(tx), grid, k, floor)


def final_proposal(displayed: DataFrame) -> DataFrame:
    """What the full history proposes."""
    return displayed.where(F.col("partition") == SNAPSHOTS[-1])


def preregistered_check(metrics: DataFrame, displayed: DataFrame, evidence: DataFrame, grid: DataFrame, expected: list[tuple[str, str, str, str, str]]) -> DataFrame:
    """expected are a handful of (id, a, b, path_a, path_b): measures of the named pairs over the full history, every threshold that
    rejects them, and whether they are displayed and some supporting event touches both files."""
    full = SNAPSHOTS[-1]
    config = F.broadcast(grid)
    repos = metrics.select("repo_id").distinct()
    named = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("id", "a", "b", "path_a", "path_b"), x, strict=True)]) for x in expected])
    want = repos.select("repo_id", F.explode(named).alias("x")).select("repo_id", "x.id", "x.a", "x.b").join(config)
    m = metrics.where(F.col("partition") == full).select("repo_id", "weight", "a", "b", "opportunity", "support", "confidence", "lift")
    rows = want.join(m, ["repo_id", "weight", "a", "b"], "left").fillna(0, ["opportunity", "support"])
    fails = [
        F.when(F.col("support") < SUPPORT, "support"),
        F.when(F.col("opportunity") < F.col("min_opportunity"), "opportunities"),
        F.when(~(F.coalesce("confidence", F.lit(-1.0)) >= F.col("min_confidence")), "confidence"),
        F.when(~(F.coalesce("lift", F.lit(-1.0)) >= F.col("min_lift")), "lift"),
    ]
    rows = rows.withColumn("excluded_by", F.array_join(F.filter(F.array(*fails), lambda x: x.isNotNull()), ",")).withColumn("eligible", F.col("excluded_by") == "")
    shown = displayed.where(F.col("partition") == full).select("repo_id", "config_id", "a", "b", F.lit(True).alias("displayed"))
    # the named files that an event touches, then the pairs of which it touches both
    paths = sorted({p for x in expected for p in x[3:]})
    touched = evidence.where(F.col("path").isin(paths)).groupBy("repo_id", "event_id").agg(F.collect_set("path").alias("paths"))
    both = F.filter(named, lambda x: F.array_contains("paths", x["path_a"]) & F.array_contains("paths", x["path_b"]))
    together = touched.select("repo_id", F.explode(both).alias("x")).select("repo_id", "x.id", F.lit(True).alias("together")).distinct()
    out = rows.join(shown, ["repo_id", "config_id", "a", "b"], "left").join(together, ["repo_id", "id"], "left")
    found = F.coalesce("displayed", F.lit(False)) & F.coalesce("together", F.lit(False))
    return out.select("repo_id", "config_id", "id", "a", "b", "opportunity", "support", "confidence", "lift", "eligible", "excluded_by", found.alias("rediscovered"))


#: Limits of one repository's run; more than that is a failure, never a cut.
LIMITS = {"events": 200_000, "paths_per_event": 2000, "unique_paths": 2_000_000, "unique_components": 50_000, "pair_observations": 20_000_000, "unique_pairs": 2_000_000, "report_rows": 100_000}


def _observed(df: DataFrame) -> DataFrame:
    """(repo_id, name, ..) counts -> a row each."""
    names = [c for c in df.columns if c != "repo_id"]
    return df.select("repo_id", F.expr(f"stack({len(names)}, " + ", ".join(f"'{c}', CAST({c} AS BIGINT)" for c in names) + ") AS (id, observed)"))


def work_counts(events: DataFrame, paths: DataFrame, tx: DataFrame) -> DataFrame:
    """(repo_id, id, observed): what a repository's run amounts to, as far as it can be told before any pair is made.
    paths has distinct (event, path) rows."""
    n_events = events.groupBy("repo_id").agg(F.count("*").alias("events"))
    n_paths = paths.groupBy("repo_id", "path").count().groupBy("repo_id").agg(F.count("*").alias("unique_paths"))
    widest = paths.groupBy("repo_id", "event_id").count().groupBy("repo_id").agg(F.max("count").alias("paths_per_event"))
    parts = tx.select("repo_id", F.explode("components").alias("a")).distinct().groupBy("repo_id").agg(F.count("*").alias("unique_components"))
    pairs = tx.groupBy("repo_id").agg(F.sum(F.col("k").cast("bigint") * (F.col("k") - 1)).alias("pair_observations"))
    out = _observed(n_events)
    for df in (n_paths, widest, parts, pairs):
        out = out.union(_observed(df))
    return out


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(repo_id, id, observed): the distinct pairs, from pair_stats()."""
    return _observed(pairs.select("repo_id", "a", "b").distinct().groupBy("repo_id").agg(F.count("*").alias("unique_pairs")))


def report_row_counts(parts: list[DataFrame]) -> DataFrame:
    """(repo_id, id, observed): the records of all kinds that a report would hold."""
    each = None
    for df in parts:
        n = df.groupBy("repo_id").agg(F.count("*").alias("n"))
        each = n if each is None else each.union(n)
    return _observed(each.groupBy("repo_id").agg(F.sum("n").alias("report_rows")))


def budget_check(counts: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """(repo_id, id, observed, limit, outcome, failure)."""
    limit = F.coalesce(*[F.when(F.col("id") == k, F.lit(v)) for k, v in limits.items()]).cast("bigint")
    over = F.col("observed") > F.col("limit")
    return counts.withColumn("limit", limit).where("limit IS NOT NULL").select(
        "*", F.when(over, "fail").otherwise("pass").alias("outcome"), F.when(over, F.concat(F.lit("budget_"), "id")).alias("failure")
    )


def within_budget(df: DataFrame, checked: DataFrame) -> DataFrame:
    """Rows of df whose repositories exceeded no limit: one over a limit fails as a whole, nothing of it is cut."""
    return df.join(checked.where("outcome = 'fail'").select("repo_id").distinct(), "repo_id", "left_anti")


def guarded_pairs(events: DataFrame, paths: DataFrame, tx: DataFrame, limits: dict[str, int] = LIMITS, made: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, checked): pair_stats() of the repositories within all limits, and what was checked of every repository. A
    repository over a limit that can be told from its events, paths and components never reaches the pair step; one over
    the limit of distinct pairs goes no further. `made` observes how many transactions and pairs that step takes."""
    checked = stored(budget_check(work_counts(events, paths, tx), limits))
    taken = within_budget(tx, checked)
    if made is not None:
        taken = taken.observe(made, F.count("*").alias("transactions"), F.sum(F.col("k").cast("bigint") * (F.col("k") - 1)).alias("pairs"))
    pairs = stored(pair_stats(taken))
    checked = checked.union(budget_check(pair_counts(pairs), limits))
    return within_budget(pairs, checked), checked
