"""Registered queries against their SQL, on the smallest tables."""

import hashlib
import json
import os
import shutil

import duckdb
import pytest

from covary.operators import calibrate, mining, report
from covary.plans import queries as plans
from covary.plans.history import History
from covary.plans.queries import ORACLE, QUERIES, history_of
from covary.sources import landing
from covary.sources.store import scratch

DATA = "/root/testdata/sf0.001"
#: One session's queries share the derived history, so all of them are compared.
SOME = sorted(ORACLE)


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = QUERIES[name](spark, DATA)
    r = con.execute(ORACLE[name])
    cols = [c[0] for c in r.description]
    assert sorted(got.columns) == sorted(cols)
    want = sorted([tuple(map(plain, x)) for x in r.fetchall()], key=str)
    assert sorted([tuple(plain(x[c]) for c in cols) for x in got.collect()], key=str) == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_gates_do_not_depend_on_partitioning(spark):
    """CAL2 compares differences of means with zero; what a shuffle's order does to a mean's last bit mustn't show."""
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("1", "4", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            h = History(spark, DATA)
            seen.append(sorted(map(tuple, calibrate.engineering_gates(*h.calibrated, mining.inference_floor(mining.cumulative_training(mining.totals(h.tx)))).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] and seen[0] == seen[1] == seen[2]


def test_every_query_has_sql_but_the_documents():
    assert set(QUERIES) - set(ORACLE) == {"SNK2_canonical_report"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_canonical_reports_are_identical_across_runs(spark):
    first = sorted(map(tuple, QUERIES["SNK2_canonical_report"](spark, DATA).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert sorted(map(tuple, QUERIES["SNK2_canonical_report"](spark, DATA).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_canonical_reports_have_every_section_in_order(spark):
    row = QUERIES["SNK2_canonical_report"](spark, DATA).first()
    doc = json.loads(row.report)
    assert list(doc) == ["schema", "kind", "status", "tool", "repository", *report.SECTIONS, "failure"] and row.report.endswith("}\n")
    assert doc["status"] == "complete" and doc["failure"] is None and all(doc[name] for name in report.SECTIONS if name != "profiles")
    assert hashlib.sha256(row.report.encode()).hexdigest() == row.digest
    assert [x["code"] for x in doc["limitations"]] == sorted(report.LIMITATIONS) and len(report.LIMITATIONS) == 14 and len(report.FAILURES) == 21
    final = [c for c in doc["candidates"] if c["partition"] == 100]
    assert final and all(len(c["supporting"]) == min(20, c["total_supporting"]) and len(c["exceptions"]) == min(20, c["total_exceptions"]) for c in final)
    assert all(not c["supporting"] for c in doc["candidates"] if c["partition"] < 100)
    assert {b["id"] for b in doc["baselines"]} == {"frequent", "unweighted", "shuffled", "no_history"} and len(doc["gates"]) == 7
    assert all(g["operator"] == ">=" and g["threshold"] and (g["metric"] is None) == (g["reason"] is not None) for g in doc["gates"])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_reports_hold_nothing_that_their_form_does_not_know(spark):
    assert report.check_report(QUERIES["SNK2_canonical_report"](spark, DATA)).collect() == []


def test_strict_reading_names_fields_and_codes_at_any_depth(spark):
    form = {"a": ("x", "y"), "b": [{"c": ("z",), "d": {"e": None}}]}
    docs = {"ok": '{"a":"x","b":[{"c":"z","d":{"e":[1,2]}},{"c":null,"d":null}]}', "code": '{"a":"q","b":[{"c":"z"},{"c":"w"},{"c":"w"}]}', "field": '{"b":[{"d":{"e":1,"f":{"g":{"h":1}}}}],"i":[{"j":1}]}'}
    got = {(x.repo_id, x.path, x.violation, x.value, x.n) for x in report.check_report(spark.createDataFrame(list(docs.items()), "repo_id string, report string"), form=form).collect() if "e[" not in x.path}
    assert got == {("code", "$.a", "unknown_code", "q", 1), ("code", "$.b[].c", "unknown_code", "w", 2), ("field", "$.b[].d.f", "unknown_field", None, 1), ("field", "$.i", "unknown_field", None, 1)}


def test_a_repository_over_its_budget_fails_whole(spark):
    repos = spark.createDataFrame([("a", 1), ("b", 2)], "repo_id string, n int")
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "repo_id string, code string")
    over = spark.createDataFrame([("b", "budget_events", "mine", 5, 4, None)], "repo_id string, code string, operation string, observed bigint, limit bigint, diagnostic_digest string")
    docs = {x.repo_id: json.loads(x.report) for x in report.canonical_report(repos, {"limitations": rows}, over, {"library": "1"}).collect()}
    assert (docs["a"]["status"], docs["a"]["limitations"], docs["a"]["failure"]) == ("complete", [{"code": "x"}], None)
    assert (docs["b"]["status"], docs["b"]["limitations"], docs["b"]["failure"]["code"]) == ("failed", [], "budget_events")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_strict_reading_equals_sql_beyond_the_budgets(spark, monkeypatch):
    """The SQL knows no budgets: repositories with more events than a report's limit are read whole."""
    monkeypatch.setitem(mining.LIMITS, "events", 200)
    test_query_equals_sql(spark, "SNK4_strict_reading")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_no_section_of_a_failed_report_is_made(spark, monkeypatch):
    monkeypatch.setitem(mining.LIMITS, "events", 300)
    seen = []
    calibrated = calibrate.calibrate
    monkeypatch.setattr(calibrate, "calibrate", lambda events, tx, grid: seen.append({r.repo_id for r in tx.select("repo_id").distinct().collect()}) or calibrated(events, tx, grid))
    monkeypatch.setattr(plans, "_HISTORIES", {})
    docs = {x.repo_id: json.loads(x.report) for x in QUERIES["SNK2_canonical_report"](spark, DATA).collect()}
    fits = {r for r, d in docs.items() if d["repository"]["first_parent_events"] <= 300}
    assert 0 < len(fits) < len(docs) and seen == [fits]
    for r, d in docs.items():
        assert d["status"] == ("complete" if r in fits else "failed") and d["repository"]["reachable_commits"]
        assert all(bool(d[s]) == (r in fits) for s in report.SECTIONS if s != "profiles")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_object_ids_follow_behind_the_exchanges(spark):
    """They are as long as all else of a record, and hashes don't compress."""
    h = History(spark, DATA)
    dealt = h.records(landing.deal(h.numbered.where("kind != 'root'"), 4))
    for df, step in ((h.changes, "Window"), (dealt, "RepartitionByExpression")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert 0 <= plan.index("sha2") < plan.index(step) and "sha2" not in plan[plan.index(step) :]
    name = landing.write_history(h.events, dealt, scratch(spark), parts=2, buckets=4, dealt=True)
    kept = landing.load_history(spark, name)[1]
    assert sorted(map(tuple, kept.select(*h.changes.columns).collect())) == sorted(map(tuple, h.changes.collect()))
    assert "Exchange" not in kept.groupBy("repo_id", "event_id").count()._jdf.queryExecution().executedPlan().toString()


def test_a_session_shares_a_history_while_it_is_there(spark, tmp_path):
    first = history_of(spark, DATA)
    assert history_of(spark, DATA) is first and history_of(spark, DATA, path_limit=6) is not first
    gone = spark.range(1)
    gone.write.parquet(f"{tmp_path}/t")
    held, first.__dict__["events"] = first.__dict__.get("events"), spark.read.parquet(f"{tmp_path}/t")
    assert first.still_there()
    shutil.rmtree(f"{tmp_path}/t")
    assert not first.still_there() and history_of(spark, DATA) is not first
    if held is None:
        del first.__dict__["events"]
