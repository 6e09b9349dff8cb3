"""The records of an experiment as a content-addressed graph: each artifact is canonical text with its SHA-256, and names
those it rests on by their digests.

grid <- lock -> development reports; report <- review manifest <- review result; evidence index -> all of them. Every
builder returns (repo_id, kind, body, digest), repo_id being null where an artifact is of no single repository. Numbers
that aren't whole are strings of six places, so that equal inputs give equal bytes everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covary.functions.scalars import WEIGHTS, six
from covary.operators import mining

KEEP_NULLS = {"ignoreNullFields": "false"}
SELECTOR = "development-selector-v1"


def artifact(df: DataFrame, kind: str, *fields: str | Column, repo: Column | None = None) -> DataFrame:
    """A row of df as an artifact of these fields in this order, the schema first."""
    body = F.to_json(F.struct(F.lit(f"{kind}/v1").alias("schema"), *fields), KEEP_NULLS)
    out = df.select((F.lit(None).cast("string") if repo is None else repo).alias("repo_id"), F.lit(kind).alias("kind"), body.alias("body"))
    return out.withColumn("digest", F.sha2(F.col("body").cast("binary"), 256))


def texts(values, form: str = "{}") -> Column:
    return F.array(*[F.lit(form.format(v)) for v in values])


def grid_artifact(grid: DataFrame) -> DataFrame:
    """The frozen limits, thresholds and ranking keys, and the ids of the grid's configurations (81 at most)."""
    one = grid.agg(F.array_sort(F.collect_list("config_id")).alias("configurations"))
    whole = [F.lit(v).alias(k) for k, v in (("minimum_training_transactions", mining.FLOOR), ("minimum_raw_support", mining.SUPPORT))]
    thresholds = [F.array(*map(F.lit, mining.OPPORTUNITIES)).alias("opportunity_thresholds"), texts(mining.CONFIDENCES, "{:.2f}").alias("confidence_thresholds"), texts(mining.LIFTS, "{:.2f}").alias("lift_thresholds")]
    return artifact(one, "grid", *whole, texts(WEIGHTS).alias("size_weights"), *thresholds, F.lit(mining.DISPLAY).alias("display_limit"), texts(mining.RANKING).alias("ranking_keys"), "configurations")


def lock_artifact(selected: DataFrame, grid: DataFrame, grid_digest: DataFrame, corpus: DataFrame, reports: DataFrame, environment: dict[str, str | None]) -> DataFrame:
    """selected is select_configuration()'s row; corpus(repo_id, object_id) and reports(repo_id, digest) have a row per
    development and control repository."""
    ids = corpus.agg(F.array_sort(F.collect_list(F.struct("repo_id", "object_id"))).alias("corpus"))
    pairs = reports.agg(F.array_sort(F.collect_list(F.struct("repo_id", F.col("digest").alias("report_digest")))).alias("development_reports"))
    row = selected.join(F.broadcast(grid), "config_id").join(grid_digest.select(F.col("digest").alias("grid_digest"))).join(ids).join(pairs)  # a row each
    env = F.struct(*[F.lit(v).cast("string").alias(k) for k, v in environment.items()]).alias("environment")
    parameters = F.struct("weight", "min_opportunity", six(F.col("min_confidence")).alias("min_confidence"), six(F.col("min_lift")).alias("min_lift")).alias("parameters")
    measured = F.array(*[F.struct(F.lit(m).alias("metric"), six(F.col(m)).alias("value")) for m in ("worst_gain", "worst_coverage", "min_jaccard")]).alias("selector_metrics")
    return artifact(row, "dev-lock", "corpus", env, "grid_digest", F.lit(SELECTOR).alias("selector"), F.col("config_id").alias("configuration_id"), parameters, "development_reports", measured)


def manifest_artifact(candidates: DataFrame, deviations: DataFrame, evidence: DataFrame, reports: DataFrame) -> DataFrame:
    """The samples (at most 8 and 10 a repository) with the evidence(repo_id, a, b, event_id) shown for them."""
    key = ["repo_id", "a", "b"]
    shown = evidence.join(candidates.select(*key), key, "left_semi").groupBy(*key).agg(F.array_sort(F.collect_set("event_id")).alias("events"))
    c = candidates.join(shown, key, "left").groupBy("repo_id", "repository").agg(F.array_sort(F.collect_list(F.struct("hash", "a", "b", F.coalesce("events", F.array().cast("array<string>")).alias("evidence")))).alias("candidates"))
    d = deviations.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("hash", "a", "b", "cutoff_id", "event_id"))).alias("deviations"))
    row = c.join(d, "repo_id", "left").join(reports.select("repo_id", F.col("digest").alias("report_digest")), "repo_id")
    none = F.array().cast("array<struct<hash:string,a:string,b:string,cutoff_id:string,event_id:string>>")
    return artifact(row, "review-manifest", "report_digest", F.col("repository").alias("repository_object_id"), "candidates", F.coalesce("deviations", none).alias("deviations"), repo=F.col("repo_id"))


def result_artifact(manifests: DataFrame, labels: DataFrame, interrupted: DataFrame, relationship: str = "maintainer") -> DataFrame:
    """labels(repo_id, unit_kind, unit_id, label) of each reviewed repository; interrupted(repo_id) are invalid runs."""
    units = labels.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("unit_kind", F.col("unit_id").cast("string").alias("unit_id"), "label"))).alias("labels"))
    row = manifests.select("repo_id", F.col("digest").alias("manifest_digest")).join(units, "repo_id").join(interrupted.select("repo_id", F.lit(True).alias("cut")).distinct(), "repo_id", "left")
    status, why = F.when(F.col("cut"), "invalid").otherwise("complete").alias("status"), F.when(F.col("cut"), "external_interruption").alias("invalidation_reason")
    return artifact(row, "review-result", status, "manifest_digest", F.lit(relationship).alias("reviewer_relationship"), "labels", why, repo=F.col("repo_id"))


def index_artifact(experiment: str, parts: DataFrame, gates: DataFrame, lanes: DataFrame) -> DataFrame:
    """The envelope: every part's kind and digest, the analytical gates' and the lanes' outcomes. A row per repository
    and part, so it's as long as the corpus has repositories."""
    listed = parts.agg(F.array_sort(F.collect_list(F.struct("kind", "repo_id", "digest"))).alias("artifacts"))
    analytical = gates.agg(F.array_sort(F.collect_list(F.struct("repo_id", "outcome"))).alias("analytical_outcomes"))
    product = lanes.agg(F.array_sort(F.collect_list(F.struct("repo_id", "lane", "outcome"))).alias("lane_outcomes"))
    return artifact(listed.join(analytical).join(product), "evidence", F.lit(experiment).alias("experiment_id"), "artifacts", "analytical_outcomes", "lane_outcomes")


def references(artifacts: DataFrame) -> DataFrame:
    """(repo_id, kind, digest, to_kind, to_digest): what each artifact's text names."""
    schema = "grid_digest string, report_digest string, manifest_digest string, development_reports array<struct<report_digest:string>>, artifacts array<struct<kind:string,digest:string>>"
    said = artifacts.select("repo_id", "kind", "digest", F.from_json("body", schema).alias("j"))
    one = lambda kind, c: F.array(F.struct(F.lit(kind).alias("to_kind"), c.alias("to_digest")))
    reports = F.transform("j.development_reports", lambda x: F.struct(F.lit("report").alias("to_kind"), x["report_digest"].alias("to_digest")))
    listed = F.transform("j.artifacts", lambda x: F.struct(x["kind"].alias("to_kind"), x["digest"].alias("to_digest")))
    none = F.array().cast("array<struct<to_kind:string,to_digest:string>>")
    every = F.concat(one("grid", F.col("j.grid_digest")), one("report", F.col("j.report_digest")), one("review-manifest", F.col("j.manifest_digest")), F.coalesce(reports, none), F.coalesce(listed, none))
    return said.select("repo_id", "kind", "digest", F.explode(every).alias("x")).select("repo_id", "kind", "digest", "x.*").where("to_digest IS NOT NULL")


def check_artifacts(artifacts: DataFrame) -> DataFrame:
    """(repo_id, kind, digest, violation, of): `changed` texts, whose SHA-256 isn't their digest, and `dangling`
    references, whose target (of) no text of that kind has for its SHA-256. One changed byte shows as the former, or,
    where the digest was changed with it, as the latter in all that rest on it."""
    real = artifacts.select("repo_id", "kind", "digest", F.sha2(F.col("body").cast("binary"), 256).alias("real"))
    changed = real.where("digest != real").select("repo_id", "kind", "digest", F.lit("changed").alias("violation"), F.col("real").alias("of"))
    there = real.select(F.col("kind").alias("to_kind"), F.col("real").alias("to_digest")).distinct()
    dangling = references(artifacts).join(there, ["to_kind", "to_digest"], "left_anti")
    return changed.union(dangling.select("repo_id", "kind", "digest", F.lit("dangling"), "to_digest"))


def holdout_repositories(artifacts: DataFrame, repos: DataFrame) -> DataFrame:
    """repos(repo_id, object_id) that the development lock covers; none at all if there is no lock or anything in the
    graph has been changed or is missing."""
    sound = check_artifacts(artifacts).agg(F.count("*").alias("violations")).where("violations = 0")
    corpus = artifacts.where("kind = 'dev-lock'").join(sound).select(F.explode(F.from_json("body", "corpus array<struct<repo_id:string,object_id:string>>")["corpus"]).alias("c")).select("c.*")
    return repos.join(corpus, ["repo_id", "object_id"], "left_semi")
