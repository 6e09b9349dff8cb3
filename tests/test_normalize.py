"""Paths, components, exclusions and transactions."""

import pytest
import hashlib

from pyspark.sql import functions as F

from covary.functions import scalars as sc
from covary.operators import normalize

CH = "repo_id string, event_id string, pos int, src_mode string, dst_mode string, status string, path string"
EV = "repo_id string, event_id string, seq int, kind string"


def changes(spark, paths, link=()):
    rows = [("r", e, i, "100644", "160000" if p in link else "100644", "M", p) for e, ps in paths.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, CH)


def history(spark, paths):
    rows = [("r", e, i + 1, "root" if i == 0 else "single-parent") for i, e in enumerate(paths)]
    return spark.createDataFrame(rows, EV)


@pytest.mark.parametrize(("path", "vendor"), [("vendor", True), ("vendor/x/lib.go", True), ("a/vendor/lib.go", True), ("a/b/vendor", True), ("vendored/lib.go", False), ("Vendor/lib.go", False), ("a/myvendor/lib.go", False), ("a/vendor.go", False)])
def test_vendor(spark, path, vendor):
    assert spark.range(1).select(sc.is_vendor_path(F.lit(path))).first()[0] is vendor


def test_component(spark):
    df = spark.createDataFrame([("README.md", "."), ("a/b/c.go", "a/b"), ("a/x", "a"), ("a b/\n/c", "a b/\n")], "p string, c string")
    assert all(r[0] for r in df.select(sc.component_of(F.col("p")) == F.col("c")).collect())


def test_classification(spark):
    paths = {"e1": [], "e2": ["kept.txt"], "e3": ["dir/od\ndd \tname\xff.txt", "vendor/x/lib.go", "src/main.go"], "e4": ["vendor/x/lib.go"], "e5": [], "e6": ["modules/sub"]}
    e, c = history(spark, paths), changes(spark, paths, link={"modules/sub"})
    tx = {r.event_id: r.components for r in normalize.build_transactions(e, c).collect()}
    assert tx == {"e2": ["."], "e3": ["dir", "src"]}
    got = {(r.scope, r.reason): r["count"] for r in normalize.exclusion_counts(normalize.classify_events(e, c)).collect()}
    assert got == {("event", "root_event"): 1, ("event", "no_eligible_paths"): 3, ("path", "vendor_path"): 2, ("path", "gitlink_path"): 1}


def test_limits(spark):
    paths = {"e1": [], "e2": ["a.txt", "b.txt", "vendor/c"], "e3": ["a.txt", "a.txt", "b.txt"], "e4": ["a/1", "b/2"]}
    e, c = history(spark, paths), changes(spark, paths)
    out = {r.event_id: r.outcome for r in normalize.classify_events(e, c, path_limit=2, component_limit=1).collect()}
    assert out == {"e1": "root_event", "e2": "event_path_limit", "e3": "eligible", "e4": "event_component_limit"}
    got = {(r.scope, r.reason): r["count"] for r in normalize.exclusion_counts(normalize.classify_events(e, c, 2, 1)).collect()}
    assert ("path", "vendor_path") not in got
    assert [r.event_id for r in normalize.build_transactions(e, c, 2, 1).collect()] == ["e3"]


def test_first_record_decides_gitlink(spark):
    rows = [("r", "e2", 1, "100644", "160000", "M", "p"), ("r", "e2", 0, "100644", "100644", "A", "p")]
    out = normalize.path_kinds(normalize.dedup_paths(spark.createDataFrame(rows, CH))).first()
    assert (out.path_kind, out.status) == ("eligible", "A")


def test_worked_candidate_id(spark):
    row = spark.range(1).select(sc.candidate_id(F.lit("config"), F.lit("charts/app")), sc.candidate_id(F.lit("config"), F.lit("charts/app"), tag="other-v2")).first()
    want = [hashlib.sha256(b"\0".join([tag, b"inferred", b"Y29uZmln", b"Y2hhcnRzL2FwcA"])).hexdigest() for tag in (b"candidate-v1", b"other-v2")]
    assert list(row) == want


def test_byte_identity_metric_escape(spark):
    df = spark.createDataFrame([(bytearray(b"internal/report"),), (bytearray(b"\xff"),), (bytearray(b"x" * 100),)], "p binary")
    got = [r[0] for r in df.select(sc.byte_identity(F.col("p"))).collect()]
    assert got[0].bytes_b64url == "aW50ZXJuYWwvcmVwb3J0" and got[0].display == "internal/report"
    assert got[1].display is None and got[1].bytes_b64url == "_w"
    assert len(got[2].bytes_b64url) == 134
    m = spark.createDataFrame([(0.8125,), (-0.0,), (None,), (float("nan"),)], "v double").select(sc.metric(F.col("v"), F.lit("no_opportunities")).alias("m"))
    assert [(r.m.value, r.m.reason) for r in m.collect()] == [("0.812500", None), ("0.000000", None), (None, "no_opportunities"), (None, "no_opportunities")]
    assert spark.range(1).select(sc.escape_control(F.lit("a\x1b[1m\n\x85é\\x09"))).first()[0] == "a\\x1b[1m\\x0a\\x85é\\\\x09"
