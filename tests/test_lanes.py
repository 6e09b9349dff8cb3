"""Lanes, budgets, cells and controls on small frames."""

import random

from pyspark.sql import Observation
from pyspark.sql import functions as F

from covary.operators import baselines, calibrate, mining, review


def test_one_lane_never_passes_overall(spark):
    rows = [("both", lane, d, "pass") for lane, ds in review.LANES.items() for d in ds]
    rows += [("one", "profile", "adoption", "pass")]
    rows += [("half", "inferred", d, "pass") for d in review.LANES["inferred"][:3]] + [("half", "profile", "adoption", "pass")]
    rows += [("bad", "inferred", "adoption", "fail"), ("bad", "profile", "adoption", "pass")]
    dims = spark.createDataFrame(rows, "repo_id string, lane string, dimension string, outcome string")
    got = {(x.repo_id, x.lane): x.outcome for x in review.lane_outcome(dims).collect()}
    assert [got["both", x] for x in ("inferred", "profile", "overall")] == ["pass"] * 3
    assert [got["one", x] for x in ("inferred", "profile", "overall")] == ["inconclusive", "pass", "inconclusive"]
    assert [got["half", x] for x in ("inferred", "profile", "overall")] == ["inconclusive", "pass", "inconclusive"]  # no rediscovery
    assert [got["bad", x] for x in ("inferred", "profile", "overall")] == ["fail", "pass", "fail"]


def test_pairs_of_a_repository_over_a_limit_are_never_made(spark):
    kind = "repo_id string, slice int, event_id string, components array<string>, k int"
    tx = [("ok", 1, f"e{i}", ["a", "b"], 2) for i in range(3)] + [("wide", 1, "w", [f"c{i:02d}" for i in range(40)], 40)] + [("many", 1, f"m{i}", [f"x{i}", f"y{i}"], 2) for i in range(9)]
    tx = spark.createDataFrame(tx, kind)
    events = tx.select("repo_id", "event_id")
    paths = tx.select("repo_id", "event_id", F.explode("components").alias("path"))
    made = Observation()
    pairs, checked = mining.guarded_pairs(events, paths, tx, mining.LIMITS | {"pair_observations": 100, "unique_pairs": 10}, made)
    assert {x.repo_id for x in pairs.collect()} == {"ok"}
    assert {(x.repo_id, x.failure) for x in checked.where("outcome = 'fail'").collect()} == {("wide", "budget_pair_observations"), ("many", "budget_unique_pairs")}
    assert made.get == {"transactions": 12, "pairs": 24}  # the 1,560 of `wide` aren't among them
    assert checked.where("repo_id = 'wide' AND id = 'unique_pairs'").isEmpty()


def test_best_of_cells_equal_ranking_all(spark):
    r = random.Random(6)
    rows = []
    for i in range(900):
        opportunity = r.choice([3, 5, 9, 10, 19, 20, 50])
        rows.append(("r", r.choice([60, 100]), r.choice(["unit", "pair-normalized"]), f"a{i % 30:02d}", f"b{i}", opportunity, r.choice([2, 3, 5]), 1.0, 1.0, r.choice([0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 1.0]), 0.5, r.choice([1.0, 1.25, 1.3, 1.5, 2.0, 2.5]), r.choice([99, 100, 500])))
    m = spark.createDataFrame(rows, "repo_id string, partition int, weight string, a string, b string, opportunity bigint, support bigint, weighted_exposure double, weighted_support double, confidence double, prevalence double, lift double, transactions bigint")
    grid = mining.config_grid(spark)
    for g in (grid, grid.where("min_lift > 1.3 AND min_opportunity = 10"), baselines.unweighted(grid)):
        key = ["repo_id", "config_id", "partition", "rank", "a", "b"]
        want = sorted(map(tuple, mining.rank_candidates(mining.eligible(m, g)).select(*key).collect()))
        assert want and sorted(map(tuple, mining.displayed(m, g).select(*key).collect())) == want


def test_controls_by_role(spark):
    shown = spark.createDataFrame([("y1", "c"), ("t", "c")], "repo_id string, config_id string")
    events = spark.createDataFrame([("y1", "a", "root"), ("y2", "a", "root"), ("t", "a", "root"), ("u", "a", "root")], "repo_id string, event_id string, kind string")
    tx = spark.createDataFrame([("u", "a")], "repo_id string, event_id string")
    roles = spark.createDataFrame([("y1", "young"), ("y2", "young"), ("t", "template_origin"), ("u", "template_origin"), ("d", "development")], "repo_id string, role string")
    got = {(x.repo_id, x.control, x.observed, x.outcome) for x in baselines.control_outcomes(shown, tx, events, roles).collect()}
    assert got == {("y1", "young", 1, "fail"), ("y2", "young", 0, "pass"), ("t", "template_origin", 0, "pass"), ("u", "template_origin", 1, "fail")}


def test_both_orders_count_pairs_once(spark):
    r = random.Random(9)
    events = [("r", i + 1, f"e{i}", "root" if i == 0 else "single-parent") for i in range(60)]
    events = spark.createDataFrame(events, "repo_id string, seq int, event_id string, kind string")
    tx = [("r", i + 1, f"e{i}", c, len(c)) for i in range(60) for c in [sorted(r.sample("abcd", r.randint(1, 3)))]]
    tx = spark.createDataFrame(tx, "repo_id string, seq int, event_id string, components array<string>, k int")
    (own, pairs), (other, shuffled) = calibrate.both_orders(tx, events)
    for sliced, counted in ((own, pairs), (other, shuffled)):
        cols = ["repo_id", "slice", "a", "b", "k", "n"]
        assert sorted(map(tuple, counted.select(*cols).collect())) == sorted(map(tuple, mining.pair_stats(sliced).select(*cols).collect()))
    assert pairs.exceptAll(shuffled.select(*pairs.columns)).count() > 0
