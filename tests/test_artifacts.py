"""The digest graph: whatever byte changes anywhere is named, and nothing of the holdout is handed out."""

import json

import pytest
from pyspark.sql import functions as F

from covary.operators import artifacts, mining


@pytest.fixture(scope="module")
def graph(spark):
    grid = mining.config_grid(spark)
    selected = spark.createDataFrame([(mining.DEFAULT, 0.25, 0.5, 1.0)], "config_id string, worst_gain double, worst_coverage double, min_jaccard double")
    rows = spark.createDataFrame([("a", ["x"]), ("b", ["y", "z"])], "repo_id string, candidates array<string>")
    reports = artifacts.artifact(rows, "report", "candidates", repo=F.col("repo_id"))
    corpus = spark.createDataFrame([("a", "1" * 40), ("b", "2" * 40)], "repo_id string, object_id string")
    g = artifacts.grid_artifact(grid)
    lock = artifacts.lock_artifact(selected, grid, g, corpus, reports, {"architecture": "amd64", "helper": None})
    candidates = spark.createDataFrame([("a", "1" * 40, "p", "q", "h1"), ("b", "2" * 40, "p", "q", "h2")], "repo_id string, repository string, a string, b string, hash string")
    deviations = spark.createDataFrame([("a", "p", "q", "c", "e", "d1")], "repo_id string, a string, b string, cutoff_id string, event_id string, hash string")
    evidence = spark.createDataFrame([("a", "p", "q", "e2"), ("a", "p", "q", "e1"), ("a", "other", "q", "e3")], "repo_id string, a string, b string, event_id string")
    manifests = artifacts.manifest_artifact(candidates, deviations, evidence, reports)
    labels = spark.createDataFrame([("a", "candidate", 1, "decision"), ("b", "candidate", 2, "unclear")], "repo_id string, unit_kind string, unit_id bigint, label string")
    results = artifacts.result_artifact(manifests, labels, spark.createDataFrame([("b",)], "repo_id string"))
    gates = spark.createDataFrame([("a", "pass"), ("b", "fail")], "repo_id string, outcome string")
    lanes = spark.createDataFrame([("a", "overall", "inconclusive")], "repo_id string, lane string, outcome string")
    parts = g.union(reports).union(lock).union(manifests).union(results)
    rows = parts.union(artifacts.index_artifact("t", parts, gates, lanes)).collect()
    return spark.createDataFrame(rows, parts.schema), corpus


def test_the_artifacts_hold_all_their_fields(graph):
    docs = {}
    for x in graph[0].collect():
        docs.setdefault(x.kind, []).append(json.loads(x.body))
    lock = docs["dev-lock"][0]
    assert list(lock) == ["schema", "corpus", "environment", "grid_digest", "selector", "configuration_id", "parameters", "development_reports", "selector_metrics"]
    assert lock["parameters"] == {"weight": "inverse-component", "min_opportunity": 5, "min_confidence": "0.700000", "min_lift": "1.250000"} and lock["environment"] == {"architecture": "amd64", "helper": None}
    assert len(docs["grid"][0]["configurations"]) == 81 and docs["grid"][0]["ranking_keys"] == list(mining.RANKING)
    manifest = next(d for d in docs["review-manifest"] if d["deviations"])
    assert manifest["candidates"][0]["evidence"] == ["e1", "e2"] and manifest["deviations"][0]["event_id"] == "e"
    assert {(d["status"], d["invalidation_reason"]) for d in docs["review-result"]} == {("complete", None), ("invalid", "external_interruption")}
    assert len(docs["evidence"][0]["artifacts"]) == 8


def test_a_sound_graph_hands_out_what_the_lock_covers(graph):
    assert artifacts.check_artifacts(graph[0]).isEmpty()
    repos = graph[1].union(graph[1].limit(1).select(F.lit("c"), "object_id"))
    assert sorted(x.repo_id for x in artifacts.holdout_repositories(*graph[:1], repos).collect()) == ["a", "b"]
    assert artifacts.holdout_repositories(graph[0].where("kind != 'dev-lock'"), repos).isEmpty()


@pytest.mark.parametrize("kind", ["grid", "report", "dev-lock", "review-manifest", "review-result", "evidence"])
def test_one_changed_byte_is_named(graph, kind):
    all_of, corpus = graph
    one = all_of.where(F.col("kind") == kind).orderBy("digest").first()
    mine = (F.col("kind") == kind) & (F.col("digest") == one.digest)
    bent = all_of.withColumn("body", F.when(mine, F.concat("body", F.lit(" "))).otherwise(F.col("body")))
    found = artifacts.check_artifacts(bent).collect()
    assert [(x.kind, x.digest) for x in found if x.violation == "changed"] == [(kind, one.digest)]
    assert artifacts.holdout_repositories(bent, corpus).isEmpty()
    # with the digest changed alike only those that rest on it can tell
    again = bent.withColumn("digest", F.when(mine, F.sha2(F.col("body").cast("binary"), 256)).otherwise(F.col("digest")))
    found = artifacts.check_artifacts(again).collect()
    assert {x.violation for x in found} == ({"dangling"} if kind != "evidence" else set()) and all(x.of == one.digest for x in found)
    assert artifacts.check_artifacts(all_of.where(~mine)).isEmpty() == (kind == "evidence")
