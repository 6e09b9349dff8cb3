"""Numbers and running maxima over groups that lie in many tasks; chains, boundaries and evidence on top of them."""

import random

import pytest
from pyspark.sql import functions as F

from covary.functions.scalars import base64url, review_hash
from covary.operators import chain, evidence, normalize, partitions, review
from covary.operators.ranking import ranked, running_max


@pytest.mark.parametrize("parts", ["1", "7"])
def test_numbers_equal_a_window(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        r = random.Random(1)
        rows = [(r.choice(["hot"] * 9 + ["a", "b"]), r.randint(0, 10**6), i) for i in range(3000)]
        out = ranked(spark.createDataFrame(rows, "g string, x int, i int").repartition(5), ["g"], ["x", "i"], "n").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {}
    for g in "hot", "a", "b":
        want |= {row[2]: k + 1 for k, row in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: x[1:]))}
    assert {x.i: x.n for x in out} == want and len(out) == len(rows)


def test_running_maximum_over_chunks(spark):
    r = random.Random(2)
    rows = [("a", i, r.randint(0, 500)) for i in range(400) if r.random() < 0.7] + [("b", 3, 1), ("b", 900, 0)]
    out = running_max(spark.createDataFrame(rows, "g string, at int, v int"), ["g"], "at", "v", "m", chunk=16).collect()
    assert len(out) == len(rows)
    for x in out:
        assert x.m == max((v for g, at, v in rows if g == x.g and at < x.at), default=None)


def events(spark, n, repo="r"):
    rows = [(repo, i + 1, f"e{i}", f"e{i - 1}" if i else None, 1 if i else 0, "single-parent" if i else "root") for i in range(n)]
    return spark.createDataFrame(rows, "repo_id string, seq int, event_id string, first_parent string, n_parents int, kind string")


def test_boundaries_out_of_step(spark):
    """The streams that a decoder in step with the chain refuses: moved, repeated, surplus and missing boundaries."""
    e = events(spark, 8)
    none = spark.createDataFrame([], "repo_id string, event_id string")

    def found(*ids):
        b = spark.createDataFrame([("r", i + 1, x) for i, x in enumerate(ids)], "repo_id string, ordinal bigint, event_id string")
        return sorted((x.violation, x.event_id, x.ordinal) for x in chain.check_alignment(e, none, b).collect())

    ids = [f"e{i}" for i in range(8)]
    assert found(*ids) == []
    assert found(*ids[:-1]) == [("missing_boundary", "e7", None)]
    assert found(*ids, "e8") == [("surplus_boundary", "e8", 9)]
    assert found("x", *ids) == [("surplus_boundary", "x", 1)]
    assert found(*ids, "e7") == [("repeated_boundary", "e7", 9)]
    assert found("e0", "e0", *ids[1:]) == [("repeated_boundary", "e0", 2)]
    assert found("e1", "e0", *ids[2:]) == [("out_of_order_boundary", "e0", 2)]
    assert found(*ids[:2], *ids[3:7], "e2", "e7") == [("out_of_order_boundary", "e2", 7)]
    assert found("e0", "e4", "e2", "e3", "e1", "e2", "e5", "e6", "e7") == [("out_of_order_boundary", "e1", 5), ("out_of_order_boundary", "e2", 3), ("out_of_order_boundary", "e3", 4), ("repeated_boundary", "e2", 6)]


def test_no_plan_puts_a_repository_into_one_task(spark):
    e = events(spark, 50)
    tx = spark.createDataFrame([("r", i, f"e{i}", ["a", "b"] if i % 3 else ["a"], 2) for i in range(50)], "repo_id string, seq int, event_id string, components array<string>, k int")
    cands = spark.createDataFrame([("r", "a", "b")], "repo_id string, a string, b string")
    plans = {
        "chain": chain.check_chain(e),
        "shuffled": partitions.shuffled_order(e),
        "evidence": evidence.candidate_evidence_events(cands, tx, 3, 2),
    }
    text = {k: df._jdf.queryExecution().optimizedPlan().toString() for k, df in plans.items()}
    assert "Window" not in text["chain"] and "Window [row_number" not in text["shuffled"]
    assert text["evidence"].count("WindowGroupLimit") == 2  # each end is cut before the shuffle
    got = sorted((x.role, x.seq, x.total) for x in plans["evidence"].collect())
    support = [i for i in range(50) if i % 3]
    exception = [i for i in range(50) if not i % 3]
    want = [("support", i, len(support)) for i in support[:3] + support[-2:]] + [("exception", i, len(exception)) for i in exception[:3] + exception[-2:]]
    assert got == sorted(want)
    few = evidence.candidate_evidence_events(cands, tx.where("seq < 4"), 10, 10).collect()
    assert sorted((x.role, x.seq, x.total) for x in few) == [("exception", 0, 2), ("exception", 3, 2), ("support", 1, 2), ("support", 2, 2)]


def test_deviations_are_cut_before_they_are_sent(spark):
    """Of each candidate no more than can be picked leave a task, however often a deviation is listed."""
    sampled = spark.createDataFrame([("r", "a", "b"), ("r", "a", "c")], "repo_id string, a string, b string")
    rows = [("r", "tip", "a", b, f"c{i % 3}", f"e{i}") for b in "bcd" for i in range(40)] * 2
    devs = spark.createDataFrame(rows, "repo_id string, repository string, a string, b string, cutoff_id string, event_id string")
    out = review.sample_deviations(devs, sampled, 5)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("WindowGroupLimit") == 2
    hashed = devs.where("b != 'd'").distinct().withColumn("h", review_hash(F.col("repository"), F.lit("deviation"), F.lit("inferred"), *[base64url(F.col(c)) for c in "ab"], F.col("cutoff_id"), F.col("event_id")))
    every = sorted((x.h, x.b, x.event_id) for x in hashed.collect())
    first = [next(x for x in every if x[1] == b) for b in "bc"]
    want = sorted(first + [x for x in every if x not in first][: 5 - len(first)])
    assert sorted((x.hash, x.b, x.event_id, x.place) for x in out.collect()) == [(*x, k + 1) for k, x in enumerate(want)]


def test_transactions_make_their_paths_once(spark):
    c = spark.createDataFrame([("r", f"e{i}", p, "100644", "100644", "M", f"{'abc'[p % 3]}/f{p}") for i in range(6) for p in range(i)], "repo_id string, event_id string, pos int, src_mode string, dst_mode string, status string, path string")
    tx = normalize.build_transactions(events(spark, 6), c, 4, 2)
    assert tx._jdf.queryExecution().optimizedPlan().toString().count("min_by(") == 1
    assert sorted((x.event_id, x.components, x.k) for x in tx.collect()) == [("e1", ["a"], 1), ("e2", ["a", "b"], 2)]


def test_evidence_does_not_deal_out_all_components(spark):
    """However the candidates were made, the join knows how few they are."""
    tx = spark.range(0, 2000, 1, 4).select(F.lit("r").alias("repo_id"), F.col("id").cast("int").alias("seq"), F.concat(F.lit("e"), "id").alias("event_id"), F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("components"))
    many = spark.range(10_000_000).select(F.lit("r").alias("repo_id"), F.concat(F.lit("x"), "id").alias("a"), F.lit("b").alias("b"))
    cands = many.where("a = 'x5'").withColumn("a", F.lit("a"))
    plan = evidence.candidate_evidence_events(cands, tx)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
