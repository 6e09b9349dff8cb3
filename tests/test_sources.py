"""Landed listings, change dumps and module metadata, with the reference's own accepted and rejected cases."""

import random

import pytest

from covary.functions.scalars import is_object_id
from covary.operators import chain, normalize
from covary.sources import landing
from covary.sources.store import stored
from covary.streaming import check_stream

A, B, C, D = (c * 40 for c in "abcd")


def events(spark, content):
    df = spark.createDataFrame([("r", content)], "repo_id string, content string")
    good, bad = landing.parse_listing(df)
    return sorted(good.collect(), key=lambda r: r.seq), [r.reason for r in bad.collect()]


@pytest.mark.parametrize(("content", "kinds"), [(f"{A}\n", ["root"]), (f"{A}\n{B} {A}\n", ["root", "single-parent"]), (f"{A}\n{B} {A} {C} {D}\n", ["root", "merge-result"])])
def test_accepted_listings(spark, content, kinds):
    good, bad = events(spark, content)
    assert [r.kind for r in good] == kinds and not bad
    assert [r.seq for r in good] == list(range(1, len(kinds) + 1))


@pytest.mark.parametrize(
    ("content", "reason"),
    [("", "empty"), (A, "no_final_newline"), (f"{A[:39]}\n", "object_id"), (f"{A.upper()}\n", "object_id"), (f"{A}\r\n", "carriage_return"), (f"{A}\n{B}  {A}\n", "separator"), (f"{A}\n{B} {A} \n", "separator"), (f"{A}\n\n", "separator")],
)
def test_rejected_listings(spark, content, reason):
    assert reason in events(spark, content)[1]


@pytest.mark.parametrize(("content", "violation"), [(f"{A}\n{B}\n", "second_root"), (f"{B} {A}\n", "not_root_start"), (f"{A}\n{B} {C}\n", "broken_link"), (f"{A}\n{B} {A}\n", None)])
def test_chain_violations(spark, content, violation):
    df = spark.createDataFrame([("r", content)], "repo_id string, content string")
    found = [r.violation for r in chain.check_chain(landing.parse_listing(df)[0]).collect()]
    assert found == ([violation] if violation else [])


def record(path=b"a.txt", status="M", src="100644", dst="100644"):
    return f":{src} {dst} {A} {B} {status}".encode() + b"\0" + path + b"\0"


def decode(spark, content):
    return landing.decode_changes(spark.createDataFrame([("r", bytearray(content))], "repo_id string, content binary")).collect()


def test_hostile_paths(spark):
    paths = [b":100644 100644", A.encode(), record()[:-7], b"dir/od\ndd \tname\xff.txt", b"-x"]
    rows = [r for r in decode(spark, A.encode() + b"\0" + b"".join(map(record, paths)) + B.encode() + b"\0" + record(b"z")) if r.pos >= 0]
    assert [bytes(r.path) for r in rows] == [*paths, b"z"]
    assert [(r.event_id, r.pos) for r in rows] == [(A, i) for i in range(len(paths))] + [(B, 0)]


@pytest.mark.parametrize(
    ("content", "reason"),
    [(b"x\0", "malformed_boundary"), (record(), "record_before_boundary"), (A.encode(), "truncated"), (A.encode() + b"\0" + record()[:-1], "truncated"), (A.encode() + b"\0" + record(b""), "malformed_path"), (A.encode() + b"\0:a b\0p\0", "malformed_header"), (A.encode() + b"\0" + record().split(b"\0")[0] + b"\0", "truncated")],
)
def test_rejected_dumps(spark, content, reason):
    assert decode(spark, content)[-1].reason == reason


def test_record_checks(spark):
    rows = [("100644", "100644", A, B, s, "p") for s in "MADT"] + [("160000", "100644", A, B, "M", "p")]
    bad = [("100644", "100644", A, B, "R100", "p", "rename_or_copy"), ("100644", "100644", A, B, "C", "p", "rename_or_copy"), ("100644", "100644", A, B, "X", "p", "status"), ("10064x", "100644", A, B, "M", "p", "mode"), ("100644", "100644", A[:39], B, "M", "p", "object_id"), ("100644", "100644", A, B, "M", "", "empty_path")]
    rows += [b[:6] for b in bad]
    df = spark.createDataFrame([("r", "e", i, *r) for i, r in enumerate(rows)], "repo_id string, event_id string, pos int, src_mode string, dst_mode string, src_oid string, dst_oid string, status string, path string")
    got = {r.pos: r.violation for r in chain.check_change_records(df).collect()}
    assert got == {5 + i: b[6] for i, b in enumerate(bad)}


def test_object_id_rejects_final_newline(spark):
    df = spark.createDataFrame([(A,), (A + "\n",), (A[:39],), (None,)], "x string")
    assert [r[0] for r in df.select(is_object_id(df.x)).collect()] == [True, False, False, False]


def test_modules(spark):
    good = '{"root":".","module_path":"m","go_version":"1.25","requires":[],"replaces":[]}'
    df = spark.createDataFrame([("r", good), ("r", "{"), ("r", '{"root":"."}')], "repo_id string, value string")
    assert sorted(str(r.failure) for r in landing.parse_modules(df).collect()) == ["None", "malformed_json", "unexpected_json"]


def test_a_stored_history_needs_no_exchange_by_event_and_prunes(spark, tmp_path):
    repos = [f"r{i}" for i in range(12)]
    e = spark.createDataFrame([(r, k + 1, f"{r}e{k}", "single-parent" if k else "root") for r in repos for k in range(5)], "repo_id string, seq int, event_id string, kind string")
    c = spark.createDataFrame([(r, f"{r}e{k}", p, "100644", "100644", "M", f"d{p}/f{k}") for r in repos for k in range(1, 5) for p in range(3)], "repo_id string, event_id string, pos int, src_mode string, dst_mode string, status string, path string")
    name = landing.write_history(e, c, f"file://{tmp_path}/h", parts=6, buckets=4)
    events, changes = landing.load_history(spark, name, parts=6)
    assert sorted(events.collect()) == sorted(e.collect()) and sorted(changes.collect()) == sorted(c.collect())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tx = normalize.build_transactions(events, changes, placed=True)
        plan = tx._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
        assert sorted(map(tuple, tx.collect())) == sorted(map(tuple, normalize.build_transactions(e, c).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    some_events, some_changes = landing.load_history(spark, name, ["r3", "r7"], parts=6)
    assert {r.repo_id for r in some_events.collect()} == {"r3", "r7"} and some_changes.count() == 24
    assert "PartitionFilters: [part" in some_changes._jdf.queryExecution().executedPlan().toString()
    assert len(some_changes.inputFiles()) < len(changes.inputFiles())


def test_rules_change_while_the_stream_runs(spark, tmp_path):
    root = f"file://{tmp_path}"

    def land(k, components):
        spark.createDataFrame([("r", f"e{k}", components)], check_stream.SCHEMA).coalesce(1).write.parquet(f"{root}/tx/{k}")

    def rule(version, accepted, severity="warn"):
        spark.createDataFrame([("r", "a", "b", accepted, severity)], check_stream.RULES).write.parquet(f"{root}/rules/version={version}")

    def run():
        q = check_stream.start_versioned_check(spark, f"{root}/tx/*", f"{root}/rules", f"{root}/out", f"{root}/checkpoint", per_trigger=1)
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted((x.event_id, x.severity) for x in spark.read.parquet(f"{root}/out").collect())

    rule(1, False)
    land(0, ["a"])
    assert run() == []
    rule(2, True)
    land(1, ["a"])
    land(2, ["a", "b"])
    assert run() == [("e1", "warn")]
    rule(3, True, "block")
    land(3, ["a", "c"])
    assert run() == [("e1", "warn"), ("e3", "block")]
    rule(4, False)
    land(4, ["a"])
    # the last batch isn't known to be done: it runs again, under the same number
    last = max((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (tmp_path / "checkpoint" / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    found = run()
    assert [x for x in found if x[0] == "e1"] == [("e1", "warn")] and len(found) == len(set(found)) and "e4" not in dict(found)


def test_listings_in_several_rows(spark):
    df = spark.createDataFrame([("r", f"{A}\n{B} {A}\n", 0), ("r", f"{C} {B}\n{D} {C}\n", 2)], "repo_id string, content string, before int")
    assert sorted((r.seq, r.event_id) for r in landing.parse_listing(df)[0].collect()) == [(1, A), (2, B), (3, C), (4, D)]


def test_first_parent_chains_by_doubling(spark):
    line = [("r", f"c{i}", [f"c{i - 1}", f"s{i}"] if i == 9 else [f"c{i - 1}"] if i else []) for i in range(21)]
    side = [("r", "s9", ["s8", "t1"]), ("r", "s8", ["s7"]), ("r", "s7", ["c3"]), ("r", "t1", None), ("r", "alone", [])]
    bent = [("m", "x", ["y"]), ("m", "y", ["gone"]), ("o", "p", ["q"]), ("o", "q", ["p"])]
    commits = spark.createDataFrame(line + side + bent, "repo_id string, id string, parents array<string>")
    tips = spark.createDataFrame([("r", "c20"), ("m", "x"), ("o", "p")], "repo_id string, tip string")
    out = chain.first_parent_chain(commits, tips)
    assert "InPandas" not in out._jdf.queryExecution().toString()
    got = sorted((r.repo_id, r.seq, r.event_id, r.first_parent, r.n_parents, r.reachable, r.broken) for r in out.collect())
    want = [("r", i + 1, f"c{i}", f"c{i - 1}" if i else None, len(line[i][2]), 25, None) for i in range(21)]
    want += [("m", 1, "y", "gone", 1, 2, "missing_object"), ("m", 2, "x", "y", 1, 2, "missing_object"), ("o", 1, "q", "p", 1, 2, "cycle"), ("o", 2, "p", "q", 1, 2, "cycle")]
    assert got == sorted(want, key=lambda r: r[:2])


@pytest.mark.parametrize("small", [0, 40])
def test_first_parent_chains_past_taken_out_commits(spark, monkeypatch, small):
    """Rounds that take commits out change nothing of the chain, and a long one takes far fewer rows than a table of jumps
    for each power of two."""
    r, rows, want = random.Random(4), [], {}
    for repo in "a", "b":
        up = {i: i - 1 for i in range(1, 150)} | {i: r.randrange(i) for i in range(150, 260)}
        up |= {0: 90} if repo == "b" else {}  # a cycle behind the tip
        other = {i: r.randrange(260) for i in r.sample(range(1, 260), 12)}
        parents = {i: [p for p in (up.get(i), other.get(i) if i in up else None) if p is not None] for i in range(260)}
        rows += [(repo, f"c{i}", [f"c{p}" for p in ps]) for i, ps in parents.items()]
        walk, at = [], 149
        while at is not None and at not in walk:
            walk.append(at)
            at = up.get(at)
        seen, todo = set(), [149]
        while todo:
            i = todo.pop()
            if i not in seen:
                seen.add(i)
                todo += parents[i]
        want |= {(repo, len(walk) - k): (f"c{i}", len(seen)) for k, i in enumerate(walk)}
    made = []
    monkeypatch.setattr(chain, "SMALL", small, raising=False)
    monkeypatch.setattr(chain, "stored", lambda df: made.append(stored(df)) or made[-1])
    commits = spark.createDataFrame(rows, "repo_id string, id string, parents array<string>")
    out = chain.first_parent_chain(commits, spark.createDataFrame([("a", "c149"), ("b", "c149")], "repo_id string, tip string"))
    assert {(x.repo_id, x.seq): (x.event_id, x.reachable) for x in out.collect()} == want
    assert {x.broken for x in out.collect()} == {None, "cycle"}
    assert any("via" in df.columns for df in made) and sum(df.count() for df in made) < 8 * len(rows)
