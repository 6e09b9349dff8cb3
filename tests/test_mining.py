"""Partitions, mining, evaluation, gates, review and profiles on tiny frames."""

import pytest
from pyspark.sql import functions as F

from covary.functions import scalars as sc
from covary.operators import artifacts, baselines, calibrate, check, evaluate, mining, partitions, profiles, report, review
from covary.streaming import check_stream


def txs(spark, rows):
    """rows: (repo, seq, components)"""
    data = [(r, s, f"e{s}", sorted(c), len(c)) for r, s, c in rows]
    return spark.createDataFrame(data, "repo_id string, seq int, event_id string, components array<string>, k int")


def events(spark, n, repo="r"):
    return spark.createDataFrame([(repo, i, f"e{i}", "root" if i == 1 else "single-parent") for i in range(1, n + 1)], "repo_id string, seq int, event_id string, kind string")


@pytest.fixture(scope="module")
def mined(spark):
    n = 333
    rows = [("r", s, {"a", "b"} if s % 10 else {"a", "c"}) if s % 2 else ("r", s, {"d", "e", "f"} if s % 4 else {"c"}) for s in range(2, n + 1)]
    ev, tx = events(spark, n), txs(spark, rows)
    return ev, tx, partitions.with_slices(tx, ev).cache()


@pytest.mark.parametrize("n", [1, 7, 100, 333])
def test_cutoffs(spark, n):
    got = {r.percentile: (r.bound, r.cutoff_id) for r in partitions.cutoffs(events(spark, n)).collect()}
    assert got == {p: (p * n // 100, f"e{p * n // 100}" if p * n // 100 else None) for p in (60, 70, 80, 90)}


def test_slices_are_disjoint_and_nested(spark):
    got = {r.seq: r.slice for r in partitions.slices(events(spark, 100)).collect()}
    assert [got[s] for s in (60, 61, 70, 71, 80, 81, 90, 91, 100)] == [1, 2, 2, 3, 3, 4, 4, 5, 5]


def test_weights(spark):
    df = spark.createDataFrame([(1,), (2,), (4,)], "k int")
    got = [[r[0] for r in df.select(sc.size_weight(F.lit(w), F.col("k"))).collect()] for w in sc.WEIGHTS]
    assert got == [[1, 1, 1], [1, 1, 1 / 3], [1, 0.5, 1 / 12]]


def test_measures(spark, mined):
    _, tx, sliced = mined
    m = {(r.a, r.b): r for r in mining.metrics_of(sliced, ("unit",)).where("partition = 100").collect()}
    rows = [set(r.components) for r in tx.collect()]
    ab, a, b = (sum(x <= c for c in rows) for x in ({"a", "b"}, {"a"}, {"b"}))
    assert (m["a", "b"].support, m["a", "b"].opportunity) == (ab, a)
    assert m["a", "b"].confidence == pytest.approx(ab / a) and m["a", "b"].lift == pytest.approx(ab / a / (b / len(rows)))


def test_no_leak_from_the_future(spark, mined):
    ev, tx, sliced = mined
    other = partitions.with_slices(tx.withColumn("components", F.when(F.col("seq") > 300, F.array(F.lit("x"), F.lit("y"))).otherwise(F.col("components"))), ev)
    pick = lambda t: sorted(map(tuple, mining.metrics_of(t).where("partition <= 90").select("partition", "weight", "a", "b", "support", "confidence", "lift").collect()))
    assert pick(sliced) == pick(other)


def test_bytes_do_not_depend_on_partitioning(spark, mined):
    _, _, sliced = mined
    pick = lambda t: sorted(map(tuple, mining.metrics_of(t).select("partition", "weight", "a", "b", "confidence", "lift").collect()))
    assert pick(sliced) == pick(sliced.repartition(13))


def test_floor_and_grid(spark, mined):
    _, tx, sliced = mined
    assert mining.config_grid(spark).count() == 81
    grid = mining.config_grid(spark, mining.DEFAULT)
    assert mining.display(sliced, grid).count() > 0
    assert mining.display(sliced.limit(50), grid).count() == 0
    assert baselines.no_history_control(sliced, grid).count() == 0


def test_jaccard_and_tau(spark):
    grid = spark.createDataFrame([("c", "unit")], "config_id string, weight string")
    repos = spark.createDataFrame([("r",)], "repo_id string")
    rows = [("r", "c", 60, 1, "a", "b"), ("r", "c", 60, 2, "b", "a"), ("r", "c", 70, 2, "a", "b"), ("r", "c", 70, 1, "b", "a")]
    shown = spark.createDataFrame(rows, "repo_id string, config_id string, partition int, rank int, a string, b string")
    j = {r.cutoff: (r.jaccard, r.reason) for r in evaluate.adjacent_jaccard(shown, repos, grid).collect()}
    assert j == {60: (1.0, None), 70: (0.0, None), 80: (None, "empty_candidate_sets")}
    t = {r.cutoff: (r.survivors, r.tau, r.reason) for r in evaluate.kendall_tau_b(shown, repos, grid).collect()}
    assert t == {60: (2, -1.0, None), 70: (0, None, "insufficient_rank_overlap"), 80: (0, None, "insufficient_rank_overlap")}


def test_gate_outcomes(spark):
    rows = [("x", "pass"), ("x", "fail"), ("x", "inconclusive"), ("y", "pass"), ("y", "inconclusive"), ("z", "pass")]
    got = {r.g: r.outcome for r in calibrate.conjunctive_outcome(spark.createDataFrame(rows, "g string, outcome string"), ["g"]).collect()}
    assert got == {"x": "fail", "y": "inconclusive", "z": "pass"}


def test_calibration_and_lock(spark, mined):
    ev, tx, sliced = mined
    grid = mining.config_grid(spark)
    metrics, gains, shown = calibrate.calibrate(ev, tx, grid)
    assert metrics.count() == 81
    same = gains.where("reason = 'identical_baseline'").select("config_id").distinct().count()
    assert same == 27
    corpus = spark.createDataFrame([("r", "e333")], "repo_id string, object_id string")
    selected = spark.createDataFrame([(mining.DEFAULT, 0.1, 0.5, 1.0)], "config_id string, worst_gain double, worst_coverage double, min_jaccard double")
    g, reports = artifacts.grid_artifact(grid), artifacts.artifact(corpus, "report", "object_id", repo=F.col("repo_id"))
    graph = g.union(reports).union(artifacts.lock_artifact(selected, grid, g, corpus, reports, {"library": "1"}))
    more = corpus.union(spark.createDataFrame([("q", "e1")], corpus.schema))
    assert [r.repo_id for r in artifacts.holdout_repositories(graph, more).collect()] == ["r"]
    assert artifacts.holdout_repositories(graph.where("kind != 'grid'"), more).count() == 0


def test_adoption_and_precision(spark):
    log = [("p", float(t), True, False) for t in (10, 20, 600)] + [("late", float(t), True, False) for t in (10, 20, 601)] + [("few", 1.0, True, False)] + [("cut", float(t), True, t == 2) for t in (1, 2, 3)]
    got = {r.repo_id: r.outcome for r in review.adoption_gate(spark.createDataFrame(log, "repo_id string, elapsed double, useful boolean, interrupted boolean")).collect()}
    assert got == {"p": "pass", "late": "fail", "few": "fail", "cut": "inconclusive"}
    labels = [("r", "candidate", i, "decision" if i < 6 else "unclear") for i in range(8)] + [("r", "deviation", i, "review-worthy") for i in range(9)]
    got = {r.unit_kind: (r.useful, r.outcome) for r in review.label_precision(spark.createDataFrame(labels, "repo_id string, unit_kind string, unit_id int, label string")).collect()}
    assert got == {"candidate": (6, "pass"), "deviation": (9, "inconclusive")}


def test_profiles(spark):
    tree = spark.createDataFrame([("r", p, "100644") for p in ("main.go", "a/b/c/x.go", "utils/u.go", "vendor/v/y.go", "t/only_test.go", "mod/in/z.go")], "repo_id string, path string, mode string")
    modules = spark.createDataFrame(
        [("r", ".", "example.com/m", "1.24", [("github.com/onsi/ginkgox", "v1")], [("a", "../a", "")]), ("r", "mod", "gopkg.in/yaml.v3", "1.25.1", [("github.com/onsi/ginkgo/v2", "v2")], None)],
        "repo_id string, root string, module_path string, go_version string, requires array<struct<path:string,version:string>>, replaces array<struct<old_path:string,new_path:string,new_version:string>>",
    )
    near = {r.dir: (r.root, r.depth) for r in profiles.nearest_module_root(profiles.package_dirs(tree), modules).collect()}
    assert near == {".": (".", 0), "a/b/c": (".", 3), "utils": (".", 1), "mod/in": ("mod", 1)}
    got = {r.rule: (r.compliant, r.evidence) for r in profiles.profile_candidates(tree, modules, tree).collect()}
    assert got["module-topology"] == (True, ".=example.com/m,mod=gopkg.in/yaml.v3")
    assert got["go-version-floor"] == (False, ".=1.24") and got["no-local-replace"] == (False, ".")
    assert got["semantic-import-version"] == (True, "") and got["no-heavy-test-frameworks"] == (False, "mod")
    assert got["max-package-depth"] == (False, "a/b/c") and got["no-generic-packages"] == (False, "utils") and got["domain-over-layers"] == (True, "")
    with pytest.raises(ValueError, match="unknown tiers"):
        profiles.profile_candidates(tree, modules, tree, ("other",))


def test_report_rows_are_strict(spark):
    rows = spark.createDataFrame([('{"a":1}',)], "value string")
    assert report.read_report_rows(rows, "a int").first().a == 1
    with pytest.raises(Exception, match="unknown fields|MALFORMED"):
        report.read_report_rows(spark.createDataFrame([('{"a":1,"z":2}',)], "value string"), "a int").collect()
    codes = spark.createDataFrame([("root_event",), ("other",), (None,)], "reason string")
    assert [r.code for r in report.check_report_vocabulary(codes, "reason", report.EXCLUSIONS).collect()] == ["other"]


def test_check_batch_and_stream(spark, tmp_path):
    tx = spark.createDataFrame([("r", "e1", ["a"]), ("r", "e2", ["a", "b"]), ("q", "e3", ["a"])], check_stream.SCHEMA)
    rules = spark.createDataFrame([("r", "a", "b", True, "block"), ("r", "a", "c", False, None), ("r", "a", "d", True, None)], "repo_id string, a string, b string, accepted boolean, severity string")
    want = {("r", "e1", "a", "b", "block"), ("r", "e1", "a", "d", "warn"), ("r", "e2", "a", "d", "warn")}
    assert set(map(tuple, check.check_changes(tx, rules).collect())) == want
    tx.write.parquet(f"{tmp_path}/in")
    q = check_stream.start_check(spark, f"{tmp_path}/in", rules, f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(60)
    assert set(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("repo_id", "event_id", "a", "b", "severity").collect())) == want
