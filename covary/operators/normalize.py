"""From change records to component transactions, with every event and path accounted for.

Everything up to the transactions groups by (repo_id, event_id), so one exchange serves all steps; repo_id alone would
send a large repository to one task. Events over the path limit are dropped on their count, before anything is
collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covary.functions.scalars import component_of, is_gitlink, is_vendor_path

PATH_LIMIT, COMPONENT_LIMIT = 2000, 100
KEY = ["repo_id", "event_id"]


def dedup_paths(changes: DataFrame, placed: bool = False) -> DataFrame:
    """A row per (event, path): the first record decides. The rows are dealt by event, unless they are `placed` already,
    as a stored history's are."""
    first = F.min_by(F.struct("src_mode", "dst_mode", "status"), "pos")
    return (changes if placed else changes.repartition(*KEY)).groupBy(*KEY, "path").agg(first.alias("r")).select(*KEY, "path", "r.src_mode", "r.dst_mode", "r.status")


def path_kinds(paths: DataFrame) -> DataFrame:
    """paths with `kind`: vendor_path, gitlink_path or eligible."""
    vendor, link = is_vendor_path(F.col("path")), is_gitlink(F.col("src_mode"), F.col("dst_mode"))
    return paths.withColumn("path_kind", F.when(vendor, "vendor_path").when(link, "gitlink_path").otherwise("eligible"))


def event_path_limit(paths: DataFrame, limit: int = PATH_LIMIT) -> DataFrame:
    """(repo_id, event_id, n_paths) of events with more distinct paths than the limit, before any other filter."""
    return paths.groupBy(*KEY).agg(F.count("*").alias("n_paths")).where(F.col("n_paths") > limit)


def classify_events(events: DataFrame, changes: DataFrame, path_limit: int = PATH_LIMIT, component_limit: int = COMPONENT_LIMIT) -> DataFrame:
    """events with n_paths, n_vendor, n_gitlink, n_components and exactly one `outcome`."""
    return classified(events, path_kinds(dedup_paths(changes)), path_limit, component_limit)


def classified(events: DataFrame, kinds: DataFrame, path_limit: int = PATH_LIMIT, component_limit: int = COMPONENT_LIMIT) -> DataFrame:
    """classify_events() of the path_kinds() of all events."""
    kind = lambda k: F.count_if(F.col("path_kind") == k)
    eligible = F.when(F.col("path_kind") == "eligible", component_of(F.col("path")))
    per_component = kinds.groupBy(*KEY, eligible.alias("c")).agg(F.count("*").alias("n"), kind("vendor_path").alias("v"), kind("gitlink_path").alias("g"))
    per_event = per_component.groupBy(*KEY).agg(
        F.sum("n").alias("n_paths"), F.sum("v").alias("n_vendor"), F.sum("g").alias("n_gitlink"), F.count("c").alias("n_components")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    joined = events.join(per_event, KEY, "left").select(*[events[c] for c in events.columns], *map(zero, ("n_paths", "n_vendor", "n_gitlink", "n_components")))
    outcome = (
        F.when(F.col("kind") == "root", "root_event")
        .when(F.col("n_paths") > path_limit, "event_path_limit")
        .when(F.col("n_components") == 0, "no_eligible_paths")
        .when(F.col("n_components") > component_limit, "event_component_limit")
        .otherwise("eligible")
    )
    return joined.withColumn("outcome", outcome)


def exclusion_counts(classified: DataFrame) -> DataFrame:
    """(repo_id, scope, reason, count), non-zero ones only; roots and events over the path limit count no paths."""
    by_event = classified.where("outcome != 'eligible'").select("repo_id", F.lit("event").alias("scope"), F.col("outcome").alias("reason"), F.lit(1).cast("bigint").alias("n"))
    kept = classified.where("outcome NOT IN ('root_event', 'event_path_limit')")
    by_path = kept.select("repo_id", F.lit("path").alias("scope"), F.expr("stack(2, 'vendor_path', n_vendor, 'gitlink_path', n_gitlink) AS (reason, n)"))
    return by_event.union(by_path).groupBy("repo_id", "scope", "reason").agg(F.sum("n").alias("count")).where("count > 0")


def event_evidence(events: DataFrame, changes: DataFrame, path_limit: int = PATH_LIMIT) -> DataFrame:
    """(repo_id, seq, event_id, kind, path, status, component): the paths behind the transactions."""
    return evidence_paths(events, path_kinds(dedup_paths(changes)), path_limit)


def evidence_paths(events: DataFrame, kinds: DataFrame, path_limit: int = PATH_LIMIT) -> DataFrame:
    """event_evidence() of the path_kinds() of whole events, all or some."""
    over = event_path_limit(kinds, path_limit).select(*KEY)
    kept = kinds.where("path_kind = 'eligible'").join(over, KEY, "left_anti")
    return kept.join(events.where("kind != 'root'").select(*KEY, "seq", "kind"), KEY).select(
        "repo_id", "seq", "event_id", "kind", "path", "status", component_of(F.col("path")).alias("component")
    )


def build_transactions(events: DataFrame, changes: DataFrame, path_limit: int = PATH_LIMIT, component_limit: int = COMPONENT_LIMIT, placed: bool = False) -> DataFrame:
    """(repo_id, seq, event_id, components, k) of the eligible events; components are sorted and distinct."""
    return transactions(events, path_kinds(dedup_paths(changes, placed)), path_limit, component_limit)


def transactions(events: DataFrame, kinds: DataFrame, path_limit: int = PATH_LIMIT, component_limit: int = COMPONENT_LIMIT) -> DataFrame:
    """build_transactions() of the path_kinds() of all events."""
    own = kinds.select(*KEY, F.when(F.col("path_kind") == "eligible", component_of(F.col("path"))).alias("c"))
    each = own.groupBy(*KEY, "c").agg(F.count("*").alias("n"))
    of = Window.partitionBy(*KEY)  # its rows lie together already, and those of a large event may go to disk
    sized = each.withColumns({"n_paths": F.sum("n").over(of), "k": F.count("c").over(of)})
    fits = sized.where((F.col("n_paths") <= path_limit) & F.col("k").between(1, component_limit) & F.col("c").isNotNull())
    fits = fits.groupBy(*KEY, "k").agg(F.collect_list("c").alias("components"))
    return fits.join(events.where("kind != 'root'").select(*KEY, "seq"), KEY).select("repo_id", "seq", "event_id", F.sort_array("components").alias("components"), F.col("k").cast("int").alias("k"))

