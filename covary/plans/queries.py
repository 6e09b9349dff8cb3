"""The registered queries: every operator over the derived history, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covary.functions import scalars as sc
from covary.operators import artifacts, baselines, calibrate, chain, check, evaluate, evidence, mining, normalize, partitions, profiles, report, review
from covary.plans import oracle as o
from covary.plans.history import History
from covary.sources import landing
from covary.sources.store import scratch, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_HISTORIES: dict[tuple, History] = {}


def history_of(spark: SparkSession, sf_dir: str, **limits) -> History:
    """The derived history of a folder; a session's queries share it, so that each derives only what is its own."""
    key = (spark.sparkContext.applicationId, sf_dir, *sorted(limits.items()))
    if key not in _HISTORIES or not _HISTORIES[key].still_there():
        for old in [k for k in _HISTORIES if k[0] != key[0]]:
            del _HISTORIES[old]
        _HISTORIES[key] = History(spark, sf_dir, **limits)
    return _HISTORIES[key]


def query(name: str, sql: str | None = None, **limits):
    """Registers f(history) under its name, with its SQL."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(history_of(spark, sf_dir, **limits))
        if sql:
            ORACLE[name] = sql
        return f

    return register


def six(df: DataFrame, *cols: str) -> DataFrame:
    """Six places, and no zero with a sign."""
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in cols})


H = o.history()
HEX = lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 40)
EV = "e.repo_id, CAST(e.seq AS INT) AS seq"

# ---------------------------------------------------------------- sources


def _listing(h: History) -> DataFrame:
    """Landed listings, 500 lines a row."""
    line = F.concat_ws(" ", HEX(F.col("event_id")), F.when(F.col("first_parent").isNotNull(), HEX(F.col("first_parent"))), F.when(F.col("n_parents") == 2, HEX(F.concat(F.lit("side"), "event_id"))))
    before = F.floor((F.col("seq") - 1) / 500) * 500
    rows = h.events.select("repo_id", before.alias("before"), F.struct("seq", line.alias("line")).alias("x"))
    lines = F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"])
    return rows.groupBy("repo_id", "before").agg(F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("content"))


@query("SRC1_read_event_listing", f"{H} SELECT repo_id, CAST(seq AS INT) AS seq, substr(sha256(event_id), 1, 40) AS event_id, substr(sha256(first_parent), 1, 40) AS first_parent, n_parents, kind FROM events")
def _(h):
    path = scratch(h.spark)  # a folder per repository, its listing in parts
    _listing(h).select("repo_id", F.col("before").cast("bigint").alias("before"), F.regexp_replace("content", "\n\\z", "").alias("value")).repartition("repo_id", "before").write.partitionBy("repo_id", "before").text(path)
    return landing.read_event_listing(h.spark, f"{path}/*/*/part-*")[0]


@query("SRC2_read_change_stream", f"{H} SELECT c.repo_id, substr(sha256(c.event_id), 1, 40) AS event_id, CAST(pos - 1 AS INT) AS pos, src_mode, dst_mode, src_oid, dst_oid, status, path FROM changes c")
def _(h):
    record = F.concat(F.lit(":"), F.concat_ws(" ", "src_mode", "dst_mode", "src_oid", "dst_oid", "status"), F.lit("\0"), F.col("path"), F.lit("\0"))
    rows = h.changes.select("repo_id", "event_id", F.struct("pos", record.alias("r")).alias("x")).groupBy("repo_id", "event_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["r"]), "").alias("records"))
    own = h.events.where("kind != 'root'").join(rows, ["repo_id", "event_id"], "left")
    body = F.concat(HEX(F.col("event_id")), F.lit("\0"), F.coalesce("records", F.lit("")))
    dumps = own.groupBy("repo_id", (F.col("seq") / 500).cast("int").alias("part")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", body.alias("b")))), lambda x: x["b"]), "").alias("content"))
    path = scratch(h.spark)  # the writer ends a row with the NUL that ends a dump
    dumps.select("repo_id", "part", F.regexp_replace("content", "\0\\z", "").alias("value")).repartition("repo_id", "part").write.partitionBy("repo_id", "part").option("lineSep", "\0").text(path)
    return landing.read_change_stream(h.spark, f"{path}/*/*/part-*").where("pos >= 0").select("repo_id", "event_id", "pos", "src_mode", "dst_mode", "src_oid", "dst_oid", "status", F.col("path").cast("string").alias("path"))


@query("SRC3_read_modules", f"{o.PROFILES} SELECT repo_id, root, module_path, go_version, req AS require, rep AS replacement FROM modules")
def _(h):
    text = h.modules.select("repo_id", F.to_json(F.struct("root", "module_path", "go_version", "requires", "replaces")).alias("value"))
    path = scratch(h.spark)
    text.repartition("repo_id").write.partitionBy("repo_id").text(path)
    return landing.read_modules(h.spark, f"{path}/*/part-*").where("failure IS NULL").select("repo_id", "root", "module_path", "go_version", F.get("requires", F.lit(0))["path"].alias("require"), F.get("replaces", F.lit(0))["new_version"].alias("replacement"))


@query("SRC4_read_tree", f"{o.PROFILES} SELECT repo_id, path, mode FROM tree")
def _(h):
    path = scratch(h.spark)
    h.tree.write.parquet(path)
    return landing.read_tree(h.spark, path)


@query("SRC5_load_history", f"{H} SELECT e.repo_id, CAST(e.seq AS INT) AS seq, e.event_id, count(c.path) AS n FROM events e LEFT JOIN changes c ON e.repo_id = c.repo_id AND e.event_id = c.event_id GROUP BY ALL")
def _(h):
    changes = h.records(landing.deal(h.numbered.where("kind != 'root'"), 4))
    name = landing.write_history(h.events, changes, scratch(h.spark), parts=2, buckets=4, dealt=True)
    events, changes = landing.load_history(h.spark, name)
    n = changes.groupBy("repo_id", "event_id").agg(F.count("*").alias("n"))
    return events.join(n, ["repo_id", "event_id"], "left").select("repo_id", "seq", "event_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


# ---------------------------------------------------------------- validation


@query("VAL1_is_object_id", f"{H} SELECT repo_id, count_if(length(id) = 40 AND regexp_full_match(id, '[0-9a-f]+')) AS valid, count(*) AS n FROM (SELECT repo_id, CASE okey % 4 WHEN 0 THEN substr(sha256(event_id), 1, 40) WHEN 1 THEN upper(substr(sha256(event_id), 1, 40)) WHEN 2 THEN substr(sha256(event_id), 1, 39) ELSE substr(sha256(event_id), 1, 40) || chr(10) END AS id FROM events) GROUP BY ALL")
def _(h):
    x, k = HEX(F.col("event_id")), F.col("o_orderkey") % 4
    oid = F.when(k == 0, x).when(k == 1, F.upper(x)).when(k == 2, F.left(x, F.lit(39))).otherwise(F.concat(x, F.lit("\n")))
    return h.events.groupBy("repo_id").agg(F.count_if(sc.is_object_id(oid)).alias("valid"), F.count("*").alias("n"))


@query("VAL2_event_kind", f"{H} SELECT repo_id, kind, count(*) AS n FROM events GROUP BY ALL")
def _(h):
    return h.events.groupBy("repo_id", sc.event_kind(F.col("n_parents")).alias("kind")).agg(F.count("*").alias("n"))


@query("VAL3_first_parent_chain", f"{H} SELECT repo_id, CAST(seq AS INT) AS seq, event_id, first_parent, n_parents, CAST(n + count_if(kind = 'merge-result') OVER (PARTITION BY repo_id) AS BIGINT) AS reachable FROM events")
def _(h):
    return _chain(h).select("repo_id", "seq", "event_id", "first_parent", "n_parents", "reachable")


def _chain(h: History) -> DataFrame:
    side = F.when(F.col("n_parents") == 2, F.concat(F.lit("side"), "event_id"))
    own = h.events.select("repo_id", F.col("event_id").alias("id"), F.array_compact(F.array("first_parent", side)).alias("parents"))
    branch = h.events.where("n_parents = 2").select("repo_id", F.concat(F.lit("side"), "event_id").alias("id"), F.array("first_parent").alias("parents"))
    tips = h.tips.withColumnRenamed("repository", "tip")
    return chain.first_parent_chain(own.union(branch), tips)


@query("VAL4_check_chain", f"{H}, kept AS (SELECT *, CASE WHEN seq % 700 = 5 THEN 0 ELSE n_parents END AS np FROM events WHERE seq % 500 <> 7), v AS (SELECT repo_id, seq, event_id, CASE WHEN seq = 1 AND np <> 0 THEN 'not_root_start' WHEN seq > 1 AND np = 0 THEN 'second_root' WHEN seq > 1 AND first_parent IS DISTINCT FROM lag(event_id) OVER (PARTITION BY repo_id ORDER BY seq) THEN 'broken_link' END AS violation FROM kept) SELECT repo_id, CAST(seq AS INT) AS seq, event_id, violation FROM v WHERE violation IS NOT NULL")
def _(h):
    bent = h.events.where("seq % 500 != 7").withColumn("n_parents", F.when(F.col("seq") % 700 == 5, 0).otherwise(F.col("n_parents")))
    return chain.check_chain(bent)


_BENT = f"""{H}, bent AS (SELECT repo_id, event_id, pos, CASE WHEN pos = 3 AND CAST(event_id AS BIGINT) % 10 = 0 THEN '10064x' ELSE src_mode END AS src_mode, dst_mode, CASE WHEN pos = 2 AND CAST(event_id AS BIGINT) % 10 = 1 THEN 'R100' WHEN pos = 2 AND CAST(event_id AS BIGINT) % 10 = 2 THEN 'X' ELSE status END AS status,
  CASE WHEN pos = 1 AND CAST(event_id AS BIGINT) % 50 = 3 THEN '' ELSE path END AS path, CASE WHEN pos = 1 AND CAST(event_id AS BIGINT) % 50 = 4 THEN upper(src_oid) ELSE src_oid END AS src_oid FROM changes)
SELECT repo_id, event_id, CAST(pos AS INT) AS pos, violation FROM (SELECT *, CASE WHEN NOT regexp_full_match(src_mode, '[0-7]+') THEN 'mode' WHEN NOT regexp_full_match(src_oid, '[0-9a-f]+') THEN 'object_id' WHEN status[1] IN ('R', 'C') THEN 'rename_or_copy' WHEN status NOT IN ('A', 'D', 'M', 'T') THEN 'status' WHEN path = '' THEN 'empty_path' END AS violation FROM bent) WHERE violation IS NOT NULL"""


@query("VAL5_check_change_records", _BENT)
def _(h):
    key, pos = F.col("event_id").cast("bigint"), F.col("pos")
    bent = h.changes.withColumns(
        {
            "src_mode": F.when((pos == 3) & (key % 10 == 0), "10064x").otherwise(F.col("src_mode")),
            "status": F.when((pos == 2) & (key % 10 == 1), "R100").when((pos == 2) & (key % 10 == 2), "X").otherwise(F.col("status")),
            "path": F.when((pos == 1) & (key % 50 == 3), "").otherwise(F.col("path")),
            "src_oid": F.when((pos == 1) & (key % 50 == 4), F.upper("src_oid")).otherwise(F.col("src_oid")),
        }
    )
    return chain.check_change_records(bent)


_ALIGNED = f"""{H}, known AS (SELECT * FROM events WHERE seq % 900 <> 2), c AS (SELECT DISTINCT repo_id, event_id FROM all_changes), landed AS (SELECT * FROM events WHERE seq % 400 <> 3), placed AS (
  SELECT repo_id, event_id, seq * 10 + CASE WHEN seq % 350 = 11 THEN 25 ELSE 0 END AS place FROM landed UNION ALL SELECT repo_id, event_id, seq * 10 + 5005 FROM landed WHERE seq % 700 = 9 UNION ALL SELECT repo_id, 'x' || event_id, seq * 10 + 3 FROM landed WHERE seq % 90 = 5
), bounds AS (
  SELECT b.repo_id, b.event_id, ordinal, k.seq, ordinal = min(ordinal) OVER (PARTITION BY b.repo_id, b.event_id) AS first FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY place) AS ordinal FROM placed) b LEFT JOIN known k ON b.repo_id = k.repo_id AND b.event_id = k.event_id
), late AS (
  SELECT *, max(seq) OVER (PARTITION BY repo_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM bounds WHERE first AND seq IS NOT NULL
)
SELECT repo_id, event_id, CAST(NULL AS BIGINT) AS ordinal, 'unknown_event' AS violation FROM c WHERE event_id NOT IN (SELECT event_id FROM known) UNION ALL SELECT repo_id, event_id, NULL, 'missing_boundary' FROM known WHERE event_id NOT IN (SELECT event_id FROM bounds)
UNION ALL SELECT c.repo_id, c.event_id, NULL, 'change_on_root' FROM c JOIN known k ON c.event_id = k.event_id WHERE k.kind = 'root'
UNION ALL SELECT repo_id, event_id, ordinal, 'surplus_boundary' FROM bounds WHERE seq IS NULL UNION ALL SELECT repo_id, event_id, ordinal, 'repeated_boundary' FROM bounds WHERE seq IS NOT NULL AND NOT first UNION ALL SELECT repo_id, event_id, ordinal, 'out_of_order_boundary' FROM late WHERE seq < reached"""


@query("VAL6_check_alignment", _ALIGNED)
def _(h):
    return chain.check_alignment(h.events.where("seq % 900 != 2"), h.all_changes, h.boundaries)


@query("VAL7_repository_counts", f"{H} SELECT repo_id, count(*) AS first_parent_events, count_if(kind = 'single-parent') AS single_parent_events, count_if(kind = 'merge-result') AS merge_result_events, count(*) + count_if(kind = 'merge-result') AS reachable_commits, arg_min(event_id, seq) AS root_id, arg_max(event_id, seq) AS tip_id FROM events GROUP BY ALL")
def _(h):
    return chain.repository_counts(h.events, _chain(h))


# ---------------------------------------------------------------- normalization


@query("NRM1_dedup_paths", f"{H} SELECT repo_id, event_id, path, src_mode, dst_mode, status FROM dedup")
def _(h):
    return normalize.dedup_paths(h.changes)


@query("NRM2_is_gitlink", f"{H} SELECT repo_id, count_if(src_mode = '160000' OR dst_mode = '160000') AS gitlinks, count(*) AS n FROM changes GROUP BY ALL")
def _(h):
    return h.changes.groupBy("repo_id").agg(F.count_if(sc.is_gitlink(F.col("src_mode"), F.col("dst_mode"))).alias("gitlinks"), F.count("*").alias("n"))


@query("NRM3_is_vendor_path", f"{H} SELECT repo_id, path, list_contains(string_split(path, '/'), 'vendor') AS vendor FROM (SELECT DISTINCT repo_id, path FROM changes)")
def _(h):
    return h.changes.select("repo_id", "path").distinct().withColumn("vendor", sc.is_vendor_path(F.col("path")))


@query("NRM4_event_path_limit", f"{H} SELECT repo_id, event_id, count(*) AS n_paths FROM dedup GROUP BY ALL HAVING count(*) > 6")
def _(h):
    return normalize.event_path_limit(normalize.dedup_paths(h.changes), 6)


_CLS = "SELECT repo_id, event_id, CAST(seq AS INT) AS seq, n_paths, CAST(n_vendor AS BIGINT) AS n_vendor, CAST(n_gitlink AS BIGINT) AS n_gitlink, n_components, outcome FROM classified"


@query("NRM5_classify_events", f"{o.history(path_limit=6)} {_CLS}", path_limit=6)
def _(h):
    return h.classified.select("repo_id", "event_id", "seq", "n_paths", "n_vendor", "n_gitlink", "n_components", "outcome")


@query("NRM5_classify_events_component_limit", f"{o.history(component_limit=4)} {_CLS}", component_limit=4)
def _(h):
    return h.classified.select("repo_id", "event_id", "seq", "n_paths", "n_vendor", "n_gitlink", "n_components", "outcome")


@query("NRM6_exclusion_counts", f"{o.history(path_limit=6)}, x AS (SELECT repo_id, 'event' AS scope, outcome AS reason, 1 AS n FROM classified WHERE outcome <> 'eligible' UNION ALL SELECT repo_id, 'path', 'vendor_path', n_vendor FROM classified WHERE outcome NOT IN ('root_event', 'event_path_limit') UNION ALL SELECT repo_id, 'path', 'gitlink_path', n_gitlink FROM classified WHERE outcome NOT IN ('root_event', 'event_path_limit')) SELECT repo_id, scope, reason, CAST(sum(n) AS BIGINT) AS count FROM x GROUP BY ALL HAVING sum(n) > 0", path_limit=6)
def _(h):
    return normalize.exclusion_counts(h.classified)


@query("NRM7_component_of", f"{H} SELECT DISTINCT path, component FROM kinds")
def _(h):
    return h.changes.select("path").distinct().withColumn("component", sc.component_of(F.col("path")))


_TX = "SELECT repo_id, CAST(seq AS INT) AS seq, event_id, array_to_string(components, ',') AS components, CAST(k AS INT) AS k FROM tx0"


@query("NRM8_build_transactions", f"{o.history(component_limit=4)} {_TX}", component_limit=4)
def _(h):
    return h.transactions.withColumn("components", F.array_join("components", ","))


@query("NRM9_event_evidence", f"{H} SELECT repo_id, CAST(seq AS INT) AS seq, event_id, kind, path, status, component FROM evid")
def _(h):
    return h.evidence


# ---------------------------------------------------------------- partitions


@query("PRT1_cutoffs", f"{H} SELECT repo_id, n, percentile, bound, cutoff_id FROM cuts WHERE percentile < 100")
def _(h):
    return partitions.cutoffs(h.events)


@query("PRT2_slices", f"{H} SELECT repo_id, event_id, CAST(pos AS INT) AS seq, slice FROM sl")
def _(h):
    return partitions.slices(h.events).select("repo_id", "event_id", "seq", "slice")


@query("PRT3_partition_records", f"{H}, nxt AS (SELECT *, lead(bound) OVER (PARTITION BY repo_id ORDER BY percentile) AS eval_last FROM cuts) SELECT c.repo_id, c.percentile, c.cutoff_id, 1 AS train_first, c.bound AS train_last, c.bound + 1 AS eval_first, c.eval_last, (SELECT count(*) FROM tx WHERE tx.repo_id = c.repo_id AND slice <= last) AS train_eligible, (SELECT count(*) FROM tx WHERE tx.repo_id = c.repo_id AND slice = last + 1) AS eval_eligible, (SELECT CAST(coalesce(sum(k * (k - 1)), 0) AS BIGINT) FROM tx WHERE tx.repo_id = c.repo_id AND slice <= last) AS pair_observations, (SELECT count(*) FROM shown WHERE shown.repo_id = c.repo_id AND shown.partition = c.percentile) AS displayed FROM nxt c JOIN snap ON percentile = partition WHERE percentile < 100")
def _(h):
    return partitions.partition_records(h.events, h.tx, h.displayed)


@query("PRT4_shuffled_order", f"{o.history(shuffled=True)} SELECT repo_id, event_id, CAST(pos AS INT) AS seq, slice FROM sl")
def _(h):
    return partitions.slices(partitions.shuffled_order(h.events)).select("repo_id", "event_id", "seq", "slice")


# ---------------------------------------------------------------- mining


@query("AGG1_size_weight", f"{H} SELECT repo_id, weight, k, round({o.weight('weight', 'k')}, 9) AS value, n FROM (SELECT repo_id, CAST(k AS INT) AS k, count(*) AS n FROM tx GROUP BY ALL), w")
def _(h):
    n = h.tx.groupBy("repo_id", "k").agg(F.count("*").alias("n"))
    return n.select("repo_id", F.explode(F.array(*map(F.lit, sc.WEIGHTS))).alias("weight"), "k", "n").withColumn("value", F.round(sc.size_weight(F.col("weight"), F.col("k")), 9))


@query("AGG2_component_stats", f"{H} SELECT repo_id, slice, a, CAST(k AS INT) AS k, n FROM cstat")
def _(h):
    return h.components


@query("AGG3_pair_stats", f"{H} SELECT repo_id, slice, a, b, CAST(k AS INT) AS k, n FROM pstat")
def _(h):
    return h.pairs


@query("AGG4_totals", f"{H} SELECT repo_id, slice, CAST(k AS INT) AS k, n FROM tot")
def _(h):
    return mining.totals(h.tx)


@query("AGG5_cumulative_training", f"{H} SELECT repo_id, partition, a, b, CAST(k AS INT) AS k, CAST(n AS BIGINT) AS n FROM pcum")
def _(h):
    return mining.cumulative_training(h.pairs)


@query("AGG6_pair_metrics", f"{H} SELECT repo_id, partition, weight, a, b, opportunity, support, {o.R6('weighted_exposure', 'weighted_support', 'confidence', 'prevalence', 'lift')}, transactions FROM metrics")
def _(h):
    return six(h.metrics, "weighted_exposure", "weighted_support", "confidence", "prevalence", "lift")


#: A limit that some repositories exceed before any pair is made, and one that none quite reaches.
_TIGHT = mining.LIMITS | {"events": 3000, "unique_pairs": 2550}
_WORK = f"""{H}, obs AS (
  SELECT repo_id, 'events' AS id, count(*) AS observed FROM events GROUP BY ALL UNION ALL SELECT repo_id, 'unique_paths', count(DISTINCT path) FROM dedup GROUP BY ALL
  UNION ALL SELECT repo_id, 'unique_components', count(DISTINCT a) FROM xc GROUP BY ALL UNION ALL SELECT repo_id, 'pair_observations', CAST(sum(k * (k - 1)) AS BIGINT) FROM tx GROUP BY ALL
  UNION ALL SELECT repo_id, 'paths_per_event', max(n) FROM (SELECT repo_id, count(*) AS n FROM dedup GROUP BY repo_id, event_id) GROUP BY ALL
), lim(id, "limit") AS (VALUES {', '.join(map(str, _TIGHT.items()))}), early AS (
  SELECT DISTINCT repo_id FROM obs JOIN lim ON obs.id = lim.id WHERE observed > "limit"
), upairs AS (
  SELECT repo_id, 'unique_pairs' AS id, count(DISTINCT (a, b)) AS observed FROM pstat WHERE repo_id NOT IN (FROM early) GROUP BY ALL
), late AS (
  SELECT repo_id FROM early UNION SELECT repo_id FROM upairs WHERE observed > {_TIGHT["unique_pairs"]}
), report AS (
  SELECT repo_id, 'report_rows' AS id, count(*) AS observed FROM (
    SELECT repo_id FROM cuts WHERE percentile < 100 UNION ALL SELECT repo_id FROM shown UNION ALL SELECT repo_id FROM rm UNION ALL SELECT repo_id FROM jac UNION ALL SELECT repo_id FROM tau
    UNION ALL SELECT repo_id FROM (SELECT repo_id, scope, reason FROM (SELECT repo_id, 'event' AS scope, outcome AS reason, 1 AS n FROM classified WHERE outcome <> 'eligible' UNION ALL SELECT repo_id, 'path', 'vendor_path', n_vendor FROM classified WHERE outcome NOT IN ('root_event', 'event_path_limit') UNION ALL SELECT repo_id, 'path', 'gitlink_path', n_gitlink FROM classified WHERE outcome NOT IN ('root_event', 'event_path_limit')) GROUP BY ALL HAVING sum(n) > 0)
    UNION ALL SELECT repo_id FROM repos, range({len(report.LIMITATIONS)})
  ) WHERE repo_id NOT IN (FROM late) GROUP BY ALL
)
SELECT repo_id, x.id, observed, CAST("limit" AS BIGINT) AS "limit", CASE WHEN observed > "limit" THEN 'fail' ELSE 'pass' END AS outcome, CASE WHEN observed > "limit" THEN 'budget_' || x.id END AS failure
FROM (FROM obs UNION ALL FROM upairs UNION ALL FROM report) x JOIN lim ON x.id = lim.id"""


@query("AGG7_budget_check", _WORK)
def _(h):
    paths = normalize.dedup_paths(h.changes).select("repo_id", "event_id", "path")
    pairs, checked = mining.guarded_pairs(h.events, paths, h.tx, _TIGHT)
    tx = stored(mining.within_budget(h.tx, checked))
    comp = mining.component_stats(tx)
    shown = stored(mining.displayed(mining.pair_metrics(pairs, comp, mining.totals(tx)), h.grid))
    limits = h.tips.select("repo_id", F.explode(F.array(*map(F.lit, report.LIMITATIONS))))
    parts = [partitions.cutoffs(h.events), shown, evaluate.repository_metrics(shown, tx, comp, pairs, h.grid), evaluate.adjacent_jaccard(shown, tx, h.grid), evaluate.kendall_tau_b(shown, tx, h.grid), normalize.exclusion_counts(h.classified), limits]
    rows = mining.within_budget(mining.report_row_counts(parts), checked)
    return checked.union(mining.budget_check(rows, _TIGHT))


# ---------------------------------------------------------------- candidates


@query("CND1_config_grid", f"{o.history(grid='all')} SELECT repo_id, g.* FROM cases JOIN grid g USING (config_id)")
def _(h):
    return evaluate.cases(h.tx, h.full_grid).join(F.broadcast(h.full_grid), "config_id")


@query("CND2_inference_floor", f"{o.history(repo='n_nationkey')} SELECT repo_id, partition, CAST(sum(n) AS BIGINT) AS transactions, sum(n) < 100 AS abstains, CASE WHEN sum(n) < 100 THEN 'below_inference_floor' END AS reason FROM tcum GROUP BY ALL", repo="n_nationkey")
def _(h):
    return mining.inference_floor(mining.cumulative_training(mining.totals(h.tx)))


@query("CND3_eligible", f"{o.history(grid='all')} SELECT config_id, repo_id, partition, count(*) AS n, round(sum(confidence), 4) AS confidence FROM elig GROUP BY ALL")
def _(h):
    return mining.eligible(h.metrics, h.full_grid).groupBy("config_id", "repo_id", "partition").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"))


_SHOWN = ["repo_id", "config_id", "partition", "rank", "a", "b", "candidate_id", "opportunity", "support", "weighted_exposure", "weighted_support", "confidence", "prevalence", "lift"]


@query("CND4_rank_candidates", f"{H} {o.SHOWN}")
def _(h):
    return six(h.displayed.select(*_SHOWN), *_SHOWN[-5:])


@query("CND5_final_proposal", f"{o.history(grid='all')} {o.SHOWN} WHERE partition = 100")
def _(h):
    return six(mining.final_proposal(h.displayed_all).select(*_SHOWN), *_SHOWN[-5:])


@query("CND6_candidate_id", f"{H} SELECT DISTINCT a, b, {o.nul(repr(sc.CANDIDATE_TAG), repr('inferred'), o.b64('a'), o.b64('b'))} AS candidate_id FROM pstat")
def _(h):
    return h.pairs.select("a", "b").distinct().withColumn("candidate_id", sc.candidate_id(F.col("a"), F.col("b")))


_WANT = [("config-chart", "svc/b1", "charts/b1", "svc/b1/red_widget.go", "charts/b1/values.yaml"), ("chart-config", "charts/b2", "svc/b2", "charts/b2/values.yaml", "svc/b2/red_widget.go"), ("unseen", "charts/b2", "nowhere", "charts/b2/values.yaml", "nowhere/x")]


@query("CND7_preregistered_check", f"""{H}, want(id, a, b, path_a, path_b) AS (VALUES {', '.join(map(str, _WANT))}), j AS (
  SELECT r.repo_id, g.config_id, w.id, w.a, w.b, w.path_a, w.path_b, coalesce(m.opportunity, 0) AS opportunity, coalesce(m.support, 0) AS support, m.confidence, m.lift, g.min_opportunity, g.min_confidence, g.min_lift
  FROM repos r CROSS JOIN want w CROSS JOIN grid g LEFT JOIN metrics m ON m.partition = 100 AND m.repo_id = r.repo_id AND m.weight = g.weight AND m.a = w.a AND m.b = w.b), x AS (
  SELECT *, concat_ws(',', CASE WHEN support < 3 THEN 'support' END, CASE WHEN opportunity < min_opportunity THEN 'opportunities' END, CASE WHEN NOT coalesce(confidence, -1) >= min_confidence THEN 'confidence' END, CASE WHEN NOT coalesce(lift, -1) >= min_lift THEN 'lift' END) AS excluded_by FROM j)
SELECT repo_id, config_id, id, a, b, opportunity, support, {o.R6('confidence', 'lift')}, excluded_by = '' AS eligible, excluded_by,
  EXISTS (SELECT 1 FROM shown s WHERE s.partition = 100 AND s.repo_id = x.repo_id AND s.config_id = x.config_id AND s.a = x.a AND s.b = x.b)
  AND EXISTS (SELECT 1 FROM evid p JOIN evid q ON p.repo_id = q.repo_id AND p.event_id = q.event_id WHERE p.repo_id = x.repo_id AND p.path = x.path_a AND q.path = x.path_b) AS rediscovered FROM x""")
def _(h):
    return six(mining.preregistered_check(h.metrics, h.displayed, h.evidence, h.grid, _WANT), "confidence", "lift")


# ---------------------------------------------------------------- evidence

_EVD = f"""{H}, c AS (SELECT DISTINCT repo_id, a, b FROM shown WHERE partition = 100), r AS (
  SELECT c.repo_id, c.a, c.b, CASE WHEN list_contains(components, c.b) THEN 'support' ELSE 'exception' END AS role, seq, event_id FROM c JOIN xc ON c.repo_id = xc.repo_id AND c.a = xc.a), e AS (
  SELECT * EXCLUDE (up) FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, a, b, role ORDER BY seq) AS up, count(*) OVER (PARTITION BY repo_id, a, b, role) AS total FROM r) WHERE up <= 10 OR up > total - 10)"""


@query("EVD1_candidate_evidence_events", f"{_EVD} SELECT repo_id, a, b, role, CAST(seq AS INT) AS seq, event_id, total FROM e")
def _(h):
    return evidence.candidate_evidence_events(mining.final_proposal(h.displayed), h.tx)


@query("EVD2_candidate_evidence_paths", f"{_EVD}, p AS (SELECT e.repo_id, a, b, role, e.seq, e.event_id, path, status, component IN (a, b) AS own FROM e JOIN evid v ON e.repo_id = v.repo_id AND e.event_id = v.event_id) SELECT repo_id, a, b, role, CAST(seq AS INT) AS seq, event_id, string_agg(path || ':' || status, ',' ORDER BY path) FILTER (own OR nth <= 2) AS paths, count(*) AS total_paths FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, a, b, event_id, own ORDER BY path) AS nth FROM p) GROUP BY ALL")
def _(h):
    events = evidence.candidate_evidence_events(mining.final_proposal(h.displayed), h.tx)
    out = evidence.candidate_evidence_paths(events, h.evidence, others=2)
    return out.withColumn("paths", F.array_join(F.transform("paths", lambda x: F.concat_ws(":", x["path"], x["status"])), ","))


# ---------------------------------------------------------------- evaluation


@query("EVL1_holdout_counts", f"{H} SELECT repo_id, config_id, partition, rank, a, b, opportunities, adherences, round(adherence, 6) AS adherence FROM hold")
def _(h):
    out = evaluate.holdout_counts(h.displayed, h.components, h.pairs)
    return six(out.select("repo_id", "config_id", "partition", "rank", "a", "b", "opportunities", "adherences", "adherence"), "adherence")


@query("EVL2_micro_macro", f"{o.history(grid='all')} SELECT repo_id, config_id, {o.R6('micro', 'macro')}, round(1 - micro, 6) AS deviation FROM mm")
def _(h):
    return six(evaluate.micro_macro(evaluate.holdout_counts(h.displayed_all, h.components, h.pairs)), "micro", "macro", "deviation")


@query("EVL3_coverage", f"{H} SELECT repo_id, config_id, slice, eligible, covered FROM wcov")
def _(h):
    return evaluate.coverage(h.displayed, h.tx, h.grid)


@query("EVL4_cutoff_abstention", f"{o.history(grid='all')} SELECT * FROM abst")
def _(h):
    return evaluate.cutoff_abstention(h.displayed_all, h.tx, h.full_grid)


@query("EVL5_adjacent_jaccard", f"{H} SELECT repo_id, config_id, cutoff, round(jaccard, 6) AS jaccard, CASE WHEN jaccard IS NULL THEN 'empty_candidate_sets' END AS reason FROM jac")
def _(h):
    return six(evaluate.adjacent_jaccard(h.displayed, h.tx, h.grid), "jaccard")


@query("EVL6_kendall_tau_b", f"{H} SELECT repo_id, config_id, cutoff, survivors, round(tau, 6) + 0.0::DOUBLE AS tau, CASE WHEN survivors < 2 THEN 'insufficient_rank_overlap' END AS reason FROM tau")
def _(h):
    return six(evaluate.kendall_tau_b(h.displayed, h.tx, h.grid), "tau")


@query("EVL7_holdout_deviations", f"{H} SELECT * FROM devs")
def _(h):
    return evaluate.holdout_deviations(h.displayed, h.tx)


def _metrics(h: History, grid: DataFrame) -> DataFrame:
    shown = h.displayed_all if grid is h.full_grid else h.displayed
    return six(evaluate.repository_metrics(shown, h.tx, h.components, h.pairs, grid), "micro", "macro", "coverage", "min_jaccard", "tau_60", "tau_70", "tau_80")


@query("EVL8_repository_metrics", f"{o.history(grid='all')} SELECT {o.RM} FROM rm")
def _(h):
    return _metrics(h, h.full_grid)


# ---------------------------------------------------------------- baselines


@query("BAS1_frequent_consequent", f"{H} SELECT repo_id, config_id, partition, rank, a, b FROM freq WHERE b IS NOT NULL")
def _(h):
    return baselines.frequent_consequent(h.displayed, h.components).select("repo_id", "config_id", "partition", "rank", "a", "b")


@query("BAS2_unweighted_baseline", f"{o.history(grid='all', unit=True)} {o.SHOWN}")
def _(h):
    return six(baselines.unweighted_baseline(h.tx, h.full_grid).select(*_SHOWN), *_SHOWN[-5:])


@query("BAS3_shuffled_control", f"{o.history(shuffled=True)} {o.SHOWN}")
def _(h):
    return six(mining.display(h.shuffled_tx, h.grid).select(*_SHOWN), *_SHOWN[-5:])


@query("BAS4_no_history_control", f"{H}, none AS ({o.history(untrained=True)} SELECT repo_id, count(*) AS candidates FROM shown GROUP BY ALL) SELECT t.repo_id, count(*) AS transactions, max(coalesce(candidates, 0)) AS candidates, CASE WHEN max(coalesce(candidates, 0)) = 0 THEN 'pass' ELSE 'fail' END AS outcome FROM tx t LEFT JOIN none ON t.repo_id = none.repo_id GROUP BY ALL")
def _(h):
    return baselines.no_history_outcomes(h.tx, h.grid)


@query("BAS5_gain_over_baselines", f"{o.gains('one')} SELECT repo_id, config_id, baseline, {o.R6('micro_gain', 'macro_gain')}, reason FROM gains")
def _(h):
    return six(calibrate.calibrate(h.events, h.transactions, h.grid)[1], "micro_gain", "macro_gain")


_CONTROLS = """SELECT r.repo_id, role AS control, coalesce(c.n, 0) AS observed, CASE WHEN coalesce(c.n, 0) = 0 THEN 'pass' ELSE 'fail' END AS outcome FROM (SELECT DISTINCT repo_id, CASE WHEN CAST(repo_id AS INT) % 3 = 0 THEN 'template_origin' ELSE 'young' END AS role FROM events) r
LEFT JOIN (SELECT 'young' AS kind, repo_id, count(*) AS n FROM shown GROUP BY ALL UNION ALL SELECT 'template_origin', t.repo_id, count(*) FROM tx t JOIN events e ON t.repo_id = e.repo_id AND t.event_id = e.event_id WHERE e.kind = 'root' GROUP BY ALL) c ON r.role = c.kind AND r.repo_id = c.repo_id"""


@query("BAS6_control_outcomes", f"{o.history(repo='n_nationkey')} {_CONTROLS}", repo="n_nationkey")
def _(h):
    return baselines.control_outcomes(h.displayed, h.tx, h.events, h.roles)


# ---------------------------------------------------------------- calibration


@query("CAL1_calibrate", f"{o.gains('all')} SELECT a.repo_id, a.config_id, {o.R6('micro', 'macro', 'coverage', 'min_jaccard')}, round(f.micro_gain, 6) AS frequent_gain, round(u.micro_gain, 6) AS unweighted_gain, round(s.micro_gain, 6) AS shuffled_gain FROM rm a JOIN gains f ON f.baseline = 'frequent' AND a.repo_id = f.repo_id AND a.config_id = f.config_id JOIN gains u ON u.baseline = 'unweighted' AND a.repo_id = u.repo_id AND a.config_id = u.config_id JOIN gains s ON s.baseline = 'shuffled' AND a.repo_id = s.repo_id AND a.config_id = s.config_id")
def _(h):
    metrics, gains, _ = h.calibrated
    one = gains.groupBy("repo_id", "config_id").agg(*[F.max(F.when(F.col("baseline") == b, F.col("micro_gain"))).alias(f"{b}_gain") for b in ("frequent", "unweighted", "shuffled")])
    cols = ["micro", "macro", "coverage", "min_jaccard", "frequent_gain", "unweighted_gain", "shuffled_gain"]
    return six(metrics.join(one, ["repo_id", "config_id"]).select("repo_id", "config_id", *cols), *cols)


@query("CAL1_calibrate_controls", f"{o.history(repo='n_nationkey')}, none AS ({o.history(untrained=True, repo='n_nationkey')} SELECT repo_id, count(*) AS candidates FROM shown GROUP BY ALL) {_CONTROLS} UNION ALL SELECT DISTINCT t.repo_id, 'no_history', coalesce(candidates, 0), CASE WHEN coalesce(candidates, 0) = 0 THEN 'pass' ELSE 'fail' END FROM tx t LEFT JOIN none ON t.repo_id = none.repo_id", repo="n_nationkey")
def _(h):
    return calibrate.calibration_controls(h.events, h.tx, h.displayed, h.grid, h.roles)


def _gates(h: History, grid: DataFrame, role: str = "development"):
    metrics, gains, shown = h.calibrated
    floor = mining.inference_floor(mining.cumulative_training(mining.totals(h.tx)))
    return metrics, gains, calibrate.engineering_gates(metrics, gains, shown, floor, role)


@query("CAL2_engineering_gates", f"{o.gates('all')} SELECT repo_id, config_id, gate, outcome FROM gates")
def _(h):
    return _gates(h, h.full_grid)[2].select("repo_id", "config_id", "gate", "outcome")


_RECORD = lambda gate, metric, threshold, reason: f"SELECT repo_id, config_id, '{gate}' AS gate, round(CAST({metric} AS DOUBLE), 6) + 0.0::DOUBLE AS metric, '>=' AS operator, {threshold}::DOUBLE AS threshold, {reason} AS reason FROM facts"
_RECORDS = " UNION ALL ".join(
    _RECORD(*x)
    for x in (
        ("candidate_count", "fewest", 1, "CASE WHEN fewest IS NULL THEN 'below_inference_floor' END"),
        ("coverage", "coverage", 0.05, "CASE WHEN coverage IS NULL THEN 'no_eligible_evaluation_events' END"),
        ("window_coverage", "least_covered", 1, "CASE WHEN least_covered IS NULL THEN 'no_eligible_evaluation_events' END"),
        ("gain_frequent", "frequent", calibrate.GAIN["development"], "CASE WHEN frequent IS NULL THEN 'no_opportunities' END"),
        ("not_below_unweighted", "CASE WHEN same IS DISTINCT FROM 'identical_baseline' THEN unweighted END", 0, "CASE WHEN same = 'identical_baseline' THEN 'identical_baseline' WHEN unweighted IS NULL THEN 'no_opportunities' END"),
        ("gain_shuffled", "shuffled", 0.05, "CASE WHEN shuffled IS NULL THEN 'no_opportunities' END"),
        ("stability", "min_jaccard", 0.5, "CASE WHEN min_jaccard IS NULL THEN 'empty_candidate_sets' END"),
    )
)


@query("CAL2_gate_records", f"""{o.gates('all')}, few AS (SELECT r.repo_id, r.config_id, min(CASE WHEN f.transactions >= 100 THEN coalesce(s.c, 0) END) AS fewest FROM rm r JOIN (SELECT repo_id, partition, sum(n) AS transactions FROM tcum WHERE partition < 100 GROUP BY ALL) f ON r.repo_id = f.repo_id
LEFT JOIN (SELECT repo_id, config_id, partition, count(*) AS c FROM shown GROUP BY ALL) s ON r.repo_id = s.repo_id AND r.config_id = s.config_id AND f.partition = s.partition GROUP BY ALL),
facts AS (SELECT r.repo_id, r.config_id, fewest, coverage, least_covered, frequent, unweighted, shuffled, same, min_jaccard FROM rm r LEFT JOIN few ON r.repo_id = few.repo_id AND r.config_id = few.config_id LEFT JOIN g ON r.repo_id = g.repo_id AND r.config_id = g.config_id) {_RECORDS}""")
def _(h):
    return six(_gates(h, h.full_grid)[2].drop("outcome"), "metric")


@query("CAL2_engineering_gates_holdout", f"{o.gates('all', 'holdout')} SELECT repo_id, config_id, gate, outcome FROM gates")
def _(h):
    return _gates(h, h.full_grid, "holdout")[2].select("repo_id", "config_id", "gate", "outcome")


@query("CAL3_conjunctive_outcome", f"{o.gates('all')} SELECT repo_id, config_id, {o.WORST} FROM gates GROUP BY repo_id, config_id")
def _(h):
    return calibrate.conjunctive_outcome(_gates(h, h.full_grid)[2], ["repo_id", "config_id"])


_SELECTED = f"ok AS (SELECT config_id, {o.WORST} FROM gates GROUP BY config_id) SELECT config_id, {o.R6('worst_gain', 'worst_coverage', 'min_jaccard')} FROM (SELECT ok.config_id, w.worst_gain, l.worst_coverage, l.min_jaccard, g.weight, min_opportunity, min_confidence, min_lift FROM ok JOIN (SELECT config_id, min(least(micro_gain, macro_gain)) AS worst_gain FROM gains WHERE baseline = 'frequent' GROUP BY ALL) w ON ok.config_id = w.config_id JOIN (SELECT config_id, min(coverage) AS worst_coverage, min(min_jaccard) AS min_jaccard FROM rm GROUP BY ALL) l ON ok.config_id = l.config_id JOIN grid g ON ok.config_id = g.config_id WHERE outcome = 'pass') ORDER BY round(worst_gain, 9) DESC NULLS LAST, round(worst_coverage, 9) DESC NULLS LAST, round(min_jaccard, 9) DESC NULLS LAST, CASE weight WHEN 'unit' THEN 1 WHEN 'inverse-component' THEN 2 ELSE 3 END, min_opportunity, min_confidence, min_lift, config_id LIMIT 1"


@query("CAL4_select_configuration", f"{o.gates('all', drift=True)}, {_SELECTED}", drift=True)
def _(h):
    metrics, gains, gates = _gates(h, h.full_grid)
    controls = baselines.no_history_outcomes(h.tx, h.grid)
    return six(calibrate.select_configuration(metrics, gains, gates, h.full_grid, controls), "worst_gain", "worst_coverage", "min_jaccard")


_ENVIRONMENT = {"architecture": "amd64", "git_version": None, "library": "1", "helper": None}
#: In place of a whole report its repository's displayed candidates, in order.
_REPORTS = """rep AS (SELECT repo_id, '{"schema":"report/v1","candidates":[' || string_agg('"' || candidate_id || '"', ',' ORDER BY partition, rank) || ']}' AS body FROM shown GROUP BY ALL)"""
_LOCK = f"""{o.gates('all', drift=True)}, sel AS (SELECT s.*, weight, min_opportunity, min_confidence, min_lift FROM (WITH {_SELECTED}) s JOIN grid g ON s.config_id = g.config_id), {_REPORTS.replace('FROM shown', f"FROM shown WHERE config_id = '{mining.DEFAULT}'")},
gd AS (SELECT '{{"schema":"grid/v1","minimum_training_transactions":{mining.FLOOR},"minimum_raw_support":{mining.SUPPORT},"size_weights":["{'","'.join(sc.WEIGHTS)}"],"opportunity_thresholds":[{','.join(map(str, mining.OPPORTUNITIES))}],"confidence_thresholds":["{'","'.join(f'{x:.2f}' for x in mining.CONFIDENCES)}"],"lift_thresholds":["{'","'.join(f'{x:.2f}' for x in mining.LIFTS)}"],"display_limit":{mining.DISPLAY},"ranking_keys":["{'","'.join(mining.RANKING)}"],"configurations":["' || string_agg(config_id, '","' ORDER BY config_id) || '"]}}' AS body FROM grid),
cp AS (SELECT string_agg('{{"repo_id":"' || repo_id || '","object_id":"' || event_id || '"}}', ',' ORDER BY repo_id) AS c FROM events WHERE seq = n AND repo_id <> '3'), rp AS (SELECT string_agg('{{"repo_id":"' || repo_id || '","report_digest":"' || sha256(body) || '"}}', ',' ORDER BY repo_id) AS r FROM rep),
lk AS (SELECT '{{"schema":"dev-lock/v1","corpus":[' || c || '],"environment":{{{','.join(f'"{k}":' + ('null' if v is None else f'"{v}"') for k, v in _ENVIRONMENT.items())}}},"grid_digest":"' || sha256(gd.body) || '","selector":"development-selector-v1","configuration_id":"' || config_id || '","parameters":{{"weight":"' || weight || '","min_opportunity":' || min_opportunity || ',"min_confidence":"' || format('{{:.6f}}', min_confidence) || '","min_lift":"' || format('{{:.6f}}', min_lift)
  || '"}},"development_reports":[' || r || '],"selector_metrics":[{{"metric":"worst_gain","value":"' || format('{{:.6f}}', worst_gain) || '"}},{{"metric":"worst_coverage","value":"' || format('{{:.6f}}', worst_coverage) || '"}},{{"metric":"min_jaccard","value":"' || format('{{:.6f}}', min_jaccard) || '"}}]}}' AS body FROM sel, gd, cp, rp)"""


def _digested(h: History) -> DataFrame:
    """(repo_id, kind, body, digest) of the repositories' reports, short ones."""
    ids = F.array_sort(F.collect_list(F.struct("partition", "rank", "candidate_id")))
    rows = h.displayed.groupBy("repo_id").agg(F.transform(ids, lambda x: x["candidate_id"]).alias("candidates"))
    return artifacts.artifact(rows, "report", "candidates", repo=F.col("repo_id"))


def _locked(h: History) -> DataFrame:
    """Grid, reports and lock."""
    metrics, gains, gates = _gates(h, h.full_grid)
    grid, reports = artifacts.grid_artifact(h.full_grid), _digested(h)
    selected = six(calibrate.select_configuration(metrics, gains, gates, h.full_grid), "worst_gain", "worst_coverage", "min_jaccard")
    corpus = h.tips.where("repo_id != '3'").select("repo_id", F.col("repository").alias("object_id"))
    return stored(grid.union(reports).union(artifacts.lock_artifact(selected, h.full_grid, grid, corpus, reports, _ENVIRONMENT)))


@query("CAL5_grid_digest_lock", f"{_LOCK} SELECT NULL::VARCHAR AS repo_id, 'grid' AS kind, sha256(body) AS digest FROM gd UNION ALL SELECT repo_id, 'report', sha256(body) FROM rep UNION ALL SELECT NULL, 'dev-lock', sha256(body) FROM lk", drift=True)
def _(h):
    return _locked(h).select("repo_id", "kind", "digest")


@query("CAL6_holdout_guard", f"{_LOCK} SELECT repo_id, event_id AS object_id FROM events WHERE seq = n AND repo_id <> '3' AND EXISTS (FROM lk)", drift=True)
def _(h):
    return artifacts.holdout_repositories(_locked(h), h.tips.select("repo_id", F.col("repository").alias("object_id")))


@query("CAL6_changed_artifacts", f"{_LOCK}, bad AS (SELECT repo_id, replace(body, '\"candidates\"', '\"Candidates\"') AS body, sha256(body) AS old FROM rep WHERE repo_id = '1') SELECT repo_id, 'report' AS kind, old AS digest, 'changed' AS violation, sha256(body) AS of FROM bad UNION ALL SELECT NULL, 'dev-lock', sha256(lk.body), 'dangling', old FROM lk, bad", drift=True)
def _(h):
    body = F.when((F.col("kind") == "report") & (F.col("repo_id") == "1"), F.replace("body", F.lit('"candidates"'), F.lit('"Candidates"'))).otherwise(F.col("body"))
    return artifacts.check_artifacts(_locked(h).withColumn("body", body))


# ---------------------------------------------------------------- review


def _final(h: History) -> DataFrame:
    return mining.final_proposal(h.displayed).join(h.tips, "repo_id").select("repo_id", "repository", "a", "b")


def _samples(h: History):
    candidates = stored(review.sample_candidates(_final(h)))
    cuts = partitions.cutoffs(h.events).select("repo_id", F.col("percentile").alias("partition"), "cutoff_id")
    devs = evaluate.holdout_deviations(h.displayed, h.tx).join(cuts, ["repo_id", "partition"]).join(h.tips, "repo_id")
    return candidates, review.sample_deviations(devs, candidates)


@query("REV1_review_hash", f"{o.REVIEW} SELECT repo_id, a, b, {o.nul(repr(sc.REVIEW_TAG), 'repository', repr('inferred-candidate'), repr('inferred'), o.b64('a'), o.b64('b'))} AS hash FROM fin")
def _(h):
    hashed = sc.review_hash(F.col("repository"), "inferred-candidate", "inferred", sc.base64url(F.col("a")), sc.base64url(F.col("b")))
    return _final(h).select("repo_id", "a", "b", hashed.alias("hash"))


@query("REV2_sample_candidates", f"{o.REVIEW} SELECT * FROM sc")
def _(h):
    return _samples(h)[0]


@query("REV3_sample_deviations", f"{o.REVIEW} SELECT * FROM sd")
def _(h):
    return _samples(h)[1]


_EVENTS = """evt AS (SELECT DISTINCT c.repo_id, c.a, c.b, event_id FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, a, b, role ORDER BY seq) AS up, count(*) OVER (PARTITION BY repo_id, a, b, role) AS total FROM (
  SELECT c.repo_id, c.a, c.b, CASE WHEN list_contains(components, c.b) THEN 'support' ELSE 'exception' END AS role, seq, event_id FROM sc c JOIN xc ON c.repo_id = xc.repo_id AND c.a = xc.a)) c WHERE up <= 10 OR up > total - 10)"""
_MANIFEST = f"""{o.REVIEW}, {_REPORTS}, {_EVENTS}, el AS (SELECT repo_id, a, b, string_agg('"' || event_id || '"', ',' ORDER BY event_id) AS x FROM evt GROUP BY ALL),
c AS (SELECT sc.repo_id, repository, count(*) AS n, string_agg('{{"hash":"' || hash || '","a":"' || sc.a || '","b":"' || sc.b || '","evidence":[' || coalesce(x, '') || ']}}', ',' ORDER BY hash) AS x FROM sc LEFT JOIN el ON sc.repo_id = el.repo_id AND sc.a = el.a AND sc.b = el.b GROUP BY ALL),
d AS (SELECT repo_id, count(*) AS n, string_agg('{{"hash":"' || hash || '","a":"' || a || '","b":"' || b || '","cutoff_id":"' || cutoff_id || '","event_id":"' || event_id || '"}}', ',' ORDER BY hash) AS x FROM sd GROUP BY ALL),
mf AS (SELECT c.repo_id, c.n AS n_candidates, coalesce(d.n, 0) AS n_deviations, '{{"schema":"review-manifest/v1","report_digest":"' || sha256(rep.body) || '","repository_object_id":"' || repository || '","candidates":[' || c.x || '],"deviations":[' || coalesce(d.x, '') || ']}}' AS body FROM c JOIN rep ON c.repo_id = rep.repo_id LEFT JOIN d ON c.repo_id = d.repo_id)"""


def _manifests(h: History) -> DataFrame:
    candidates, deviations = _samples(h)
    return artifacts.manifest_artifact(candidates, deviations, evidence.candidate_evidence_events(candidates, h.tx), _digested(h))


@query("REV4_review_manifest", f"{_MANIFEST} SELECT repo_id, 'review-manifest' AS kind, body, sha256(body) AS digest FROM mf")
def _(h):
    return _manifests(h)


@query("REV5_label_precision", f"{o.LABELS} SELECT * FROM prec")
def _(h):
    return review.label_precision(h.review_labels)


@query("REV6_adoption_gate", f"{o.LABELS} SELECT repo_id, proposals, round(reached, 6) AS reached, outcome FROM adop")
def _(h):
    return six(review.adoption_gate(h.acceptances), "reached")


_LANES = f"""WITH dims AS ({o.LABELS} SELECT repo_id, 'inferred' AS lane, unit_kind || '_precision' AS dimension, outcome FROM prec UNION ALL SELECT repo_id, lane, 'adoption', outcome FROM lanes),
seen AS ({ORACLE["CND7_preregistered_check"]}), every AS (
  SELECT * FROM (SELECT DISTINCT repo_id FROM (SELECT repo_id FROM dims UNION SELECT repo_id FROM seen)), (VALUES ('inferred', 'candidate_precision'), ('inferred', 'deviation_precision'), ('inferred', 'adoption'), ('inferred', 'rediscovery'), ('profile', 'adoption')) AS t(lane, dimension)
), rows AS (
  SELECT e.repo_id, e.lane, coalesce(d.outcome, 'inconclusive') AS outcome FROM every e LEFT JOIN (FROM dims UNION ALL SELECT repo_id, 'inferred', 'rediscovery', CASE WHEN rediscovered THEN 'pass' ELSE 'fail' END FROM seen WHERE id = '{_WANT[1][0]}') d ON e.repo_id = d.repo_id AND e.lane = d.lane AND e.dimension = d.dimension
)
SELECT repo_id, lane, {o.WORST} FROM rows GROUP BY repo_id, lane UNION ALL SELECT repo_id, 'overall', {o.WORST} FROM rows GROUP BY repo_id"""


def _lanes(h: History) -> DataFrame:
    seen = mining.preregistered_check(h.metrics, h.displayed, h.evidence, h.grid, _WANT).where(F.col("id") == _WANT[1][0])
    return review.lane_outcome(review.lane_dimensions(review.label_precision(h.review_labels), review.adoption_gate(h.acceptances, by=("repo_id", "lane")), seen))


@query("REV7_lane_outcome", _LANES)
def _(h):
    return _lanes(h)


# ---------------------------------------------------------------- profiles

P = profiles


@query("PRF1_package_dirs", f"{o.PROFILES} SELECT * FROM dirs")
def _(h):
    return P.package_dirs(h.tree)


@query("PRF2_nearest_module_root", f"{o.PROFILES} SELECT repo_id, dir, root, CAST(depth AS INT) AS depth FROM near")
def _(h):
    return P.nearest_module_root(P.package_dirs(h.tree), h.modules)


_RULES = {
    "PRF3_module_topology": (P.CORE, "module-topology", lambda h: P.rule_module_topology(h.modules)),
    "PRF4_go_version_floor": (P.CORE, "go-version-floor", lambda h: P.rule_go_version_floor(h.modules)),
    "PRF5_no_local_replace": (P.CORE, "no-local-replace", lambda h: P.rule_no_local_replace(h.modules)),
    "PRF6_semantic_import_version": (P.CORE, "semantic-import-version", lambda h: P.rule_semantic_import_version(h.modules)),
    "PRF7_max_package_depth": (P.IDIOMATIC, "max-package-depth", lambda h: P.rule_max_package_depth(P.package_dirs(h.tree), h.modules)),
    "PRF8_domain_over_layers": (P.IDIOMATIC, "domain-over-layers", lambda h: P.rule_domain_over_layers(P.package_dirs(h.tree))),
    "PRF9_no_generic_packages": (P.IDIOMATIC, "no-generic-packages", lambda h: P.rule_no_generic_packages(P.package_dirs(h.tree))),
    "PRF10_no_heavy_test_frameworks": (P.IDIOMATIC, "no-heavy-test-frameworks", lambda h: P.rule_no_heavy_test_frameworks(h.modules)),
}
for _name, (_tier, _rule, _f) in _RULES.items():
    query(_name, f"{o.PROFILES} {o.RULE_ROWS[_tier, _rule]}")(_f)


@query("PRF11_profile_candidates", f"""{o.PROFILES}, every(tier_order, tier, rule) AS (VALUES {', '.join(str((i, t, r)) for i, (t, rs) in enumerate(P.RULES.items()) for r in rs)}), rp AS (SELECT DISTINCT repo_id FROM tree)
SELECT rp.repo_id, tier_order, e.tier, e.rule, {o.nul(repr(sc.CANDIDATE_TAG), repr('profile'), 'e.tier', 'e.rule')} AS candidate_id, 'profile' AS origin, e.tier || '/v1' AS profile_version, r.compliant IS NOT NULL AS applicable, r.compliant, r.evidence,
CASE WHEN r.compliant IS NULL THEN 'profile_not_applicable' END AS reason FROM rp CROSS JOIN every e LEFT JOIN rules r ON rp.repo_id = r.repo_id AND e.tier = r.tier AND e.rule = r.rule""")
def _(h):
    return P.profile_candidates(h.tree, h.modules, h.tree)


@query("PRF12_profile_input_checks", f"{o.PROFILES} SELECT repo_id, 'module_files' AS failure FROM modules GROUP BY repo_id HAVING count(*) > 1 UNION ALL SELECT repo_id, 'source_paths' FROM tree WHERE ends_with(path, '.go') GROUP BY repo_id HAVING count(*) > 90 UNION ALL SELECT DISTINCT repo_id, 'duplicate_module_path' FROM (SELECT repo_id FROM modules GROUP BY repo_id, module_path HAVING count(*) > 1) UNION ALL SELECT DISTINCT repo_id, 'module_file_size' FROM modules WHERE ends_with(module_path, '/v2') UNION ALL SELECT DISTINCT repo_id, CASE CAST(repo_id AS INT) % 5 WHEN 1 THEN 'unknown_tier' ELSE 'unknown_rule' END FROM tree WHERE CAST(repo_id AS INT) % 5 IN (1, 2)")
def _(h):
    sized = h.modules.withColumn("size", F.when(F.col("module_path").endswith("/v2"), 2 << 20).otherwise(900))
    k = F.col("repo_id").cast("int") % 5
    enabled = h.tree.select("repo_id", F.when(k == 1, "no-tier").otherwise(P.CORE).alias("tier"), F.when(k == 2, "no-rule").otherwise(P.RULES[P.CORE][0]).alias("rule"))
    return P.profile_input_checks(sized, h.tree, enabled, files=1, sources=90)


# ---------------------------------------------------------------- formats and reports


@query("FMT1_byte_identity", f"{H} SELECT DISTINCT path, {o.b64('path')} AS bytes_b64url, path AS display FROM changes")
def _(h):
    return h.changes.select("path").distinct().withColumn("x", sc.byte_identity(F.col("path"))).select("path", "x.bytes_b64url", "x.display")


@query("FMT2_metric", f"{o.history(grid='all')} SELECT repo_id, config_id, format('{{:.6f}}', micro) AS value, CASE WHEN micro IS NULL THEN 'no_candidates' END AS reason FROM rm")
def _(h):
    m = evaluate.repository_metrics(h.displayed_all, h.tx, h.components, h.pairs, h.full_grid)
    return m.select("repo_id", "config_id", sc.metric(F.col("micro"), F.lit("no_candidates")).alias("m")).select("repo_id", "config_id", "m.value", "m.reason")


@query("FMT3_escape_control", f"{H} SELECT DISTINCT path, replace(path, '/', '\\x09') || '\\x1b' AS shown FROM changes")
def _(h):
    return h.changes.select("path").distinct().withColumn("shown", sc.escape_control(F.concat(F.replace("path", F.lit("/"), F.lit("\t")), F.lit("\x1b"))))


@query("SNK1_write_report_rows", f"{o.history(path_limit=6)} {o.SHOWN}", path_limit=6)
def _(h):
    path = scratch(h.spark)
    rows = six(h.displayed.select(*_SHOWN), *_SHOWN[-5:])
    report.write_report_rows(rows, path, ["config_id", "partition", "rank", "candidate_id", "repo_id"])
    return h.spark.read.schema(rows.schema).json(path)


def _reports(h: History, limits: dict[str, int] = mining.LIMITS) -> DataFrame:
    whole = h
    h.keep("kinds", "tx")
    pairs, checked = mining.guarded_pairs(h.events, h.kinds.select("repo_id", "event_id", "path"), h.tx, limits)
    checked = stored(checked)
    h = h.within(checked, pairs)  # a failed repository's report has no sections, so none are made
    h.keep("components")
    say, why = (lambda c: sc.six(F.col(c)).alias(c)), (lambda c, r: sc.metric(F.col(c), F.col(r) if isinstance(r, str) else r))
    ends = sc.byte_identity(F.col("a")).alias("antecedent"), sc.byte_identity(F.col("b")).alias("consequent")
    metrics, gains, gates = stored(_metrics(h, h.grid)), *_gates(h, h.full_grid)[1:]
    only = lambda df: df.join(F.broadcast(h.grid.select("config_id")), "config_id", "left_semi")
    controls = baselines.no_history_outcomes(h.tx, h.grid).select("repo_id", F.lit("no_history").alias("id"), F.col("candidates").alias("observed"), "outcome")
    controls = controls.union(baselines.control_outcomes(h.displayed, h.tx, h.events, h.roles).select("repo_id", "control", "observed", "outcome"))
    seen = mining.preregistered_check(h.metrics, h.displayed, h.evidence, h.grid, _WANT)
    tau = evaluate.kendall_tau_b(h.displayed, h.tx, h.grid).groupBy("repo_id", "config_id").agg(F.array_sort(F.collect_list(F.struct("cutoff", why("tau", "reason").alias("tau")))).alias("rank_correlation"))
    shown, none = mining.final_proposal(h.displayed).select("repo_id", "a", "b").distinct(), F.array()
    events = stored(evidence.candidate_evidence_events(shown, h.tx))
    kinds = h.kinds.join(events.select("repo_id", "event_id"), ["repo_id", "event_id"], "left_semi")
    touched = evidence.candidate_evidence_paths(events, normalize.evidence_paths(h.events, kinds, h.limits[0])).join(h.events.select("repo_id", "event_id", "kind"), ["repo_id", "event_id"])
    record = F.struct("seq", "event_id", "kind", F.transform("paths", lambda x: F.struct(sc.byte_identity(x["path"]).alias("path"), x["status"].alias("status"))).alias("paths"), "total_paths")
    of_role = lambda role: F.array_sort(F.collect_list(F.when(F.col("role") == role, record)))  # noqa: E731  20 at most
    behind = touched.groupBy("repo_id", "a", "b").agg(of_role("support").alias("supporting"), of_role("exception").alias("exceptions"))
    totals = events.groupBy("repo_id", "a", "b").agg(*[F.coalesce(F.max(F.when(F.col("role") == r, F.col("total"))), F.lit(0)).alias(n) for r, n in (("support", "total_supporting"), ("exception", "total_exceptions"))])
    # the full-history proposal carries its evidence, the cutoffs' candidates have none
    final = F.col("partition") == F.lit(partitions.FULL)
    candidates = h.displayed.join(behind.join(totals, ["repo_id", "a", "b"]).withColumn("partition", F.lit(partitions.FULL)), ["repo_id", "a", "b", "partition"], "left")
    kept = lambda c: F.when(final & F.col(c).isNotNull(), F.col(c)).otherwise(none.cast(candidates.schema[c].dataType)).alias(c)
    untrained = baselines.no_history_outcomes(h.tx, h.grid).join(F.broadcast(h.grid.select("config_id"))).select("repo_id", "config_id", F.lit("no_history").alias("id"), *[F.lit(None).cast("struct<value:string,reason:string>").alias(c) for c in ("micro_gain", "macro_gain")], F.col("candidates").alias("observed"), "outcome")
    parts = {
        "configurations": h.tips.select("repo_id").join(F.broadcast(h.grid)).select("repo_id", "config_id", F.lit(None).cast("string").alias("development_lock_digest"), "weight", "min_opportunity", say("min_confidence"), say("min_lift")),
        "budgets": checked.select("repo_id", "id", F.coalesce(*[F.when(F.col("id") == i, u) for i, u in report.UNITS.items()]).alias("unit"), "limit", "observed", "outcome"),
        "partitions": partitions.partition_records(h.events, h.tx, h.displayed).select("repo_id", "percentile", "cutoff_id", "train_first", "train_last", "eval_first", "eval_last", "train_eligible", "eval_eligible", "displayed", "pair_observations"),
        "exclusions": normalize.exclusion_counts(h.classified).select("repo_id", "scope", "reason", "count"),
        "candidates": candidates.select("repo_id", "config_id", "partition", "rank", "candidate_id", F.lit("inferred").alias("origin"), *ends, "opportunity", "support", say("weighted_exposure"), say("weighted_support"), say("confidence"), say("prevalence"), say("lift"), kept("supporting"), "total_supporting", kept("exceptions"), "total_exceptions"),
        "baselines": only(gains).select("repo_id", "config_id", F.col("baseline").alias("id"), why("micro_gain", "reason").alias("micro_gain"), why("macro_gain", "reason").alias("macro_gain"), F.lit(None).cast("bigint").alias("observed"), F.lit(None).cast("string").alias("outcome")).union(untrained),
        "controls": controls,
        "profiles": P.profile_candidates(h.tree, h.modules, h.tree).select("repo_id", "tier_order", "rule", "candidate_id", "tier", "profile_version", "applicable", "compliant", "evidence", "reason"),
        "preregistered_checks": seen.select("repo_id", "id", *ends, "opportunity", "support", say("confidence"), say("lift"), "eligible", "excluded_by"),
        "metrics": metrics.join(tau, ["repo_id", "config_id"]).select("repo_id", "config_id", why("micro", "adherence_reason").alias("micro_adherence"), why("macro", "adherence_reason").alias("macro_adherence"), why("coverage", "coverage_reason").alias("coverage"), say("abstention"), why("min_jaccard", "jaccard_reason").alias("minimum_jaccard"), "rank_correlation"),
        "gates": only(gates).select("repo_id", F.col("gate").alias("id"), "config_id", "outcome", say("metric"), "operator", say("threshold"), "reason"),
        "limitations": h.tips.select("repo_id", F.explode(F.array(*[F.lit(x) for x in sorted(report.LIMITATIONS)])).alias("code")),
    }
    failures = checked.where("outcome = 'fail'").select("repo_id", F.col("failure").alias("code"), F.lit("mine").alias("operation"), "observed", "limit", F.lit(None).cast("string").alias("diagnostic_digest"))
    counts = chain.repository_counts(whole.events, _chain(whole)).select("repo_id", F.lit("sha1").alias("object_format"), "root_id", "tip_id", "reachable_commits", "first_parent_events", "single_parent_events", "merge_result_events")
    return report.canonical_report(counts, parts, failures, {"library_version": "1", "library_sha256": None, "git_version": None, "helper_version": None})


@query("SNK2_canonical_report")
def _(h):
    return _reports(h)


_INDEX = f"""WITH lab AS ({o.LABELS} SELECT repo_id, unit_kind, unit_id, label FROM rl), lane AS ({_LANES}), {_MANIFEST.strip().removeprefix("WITH ")}, gate AS ({o.gates('one')} SELECT repo_id, {o.WORST} FROM gates GROUP BY repo_id),
rs AS (SELECT mf.repo_id, '{{"schema":"review-result/v1","status":"complete","manifest_digest":"' || any_value(sha256(mf.body)) || '","reviewer_relationship":"maintainer","labels":[' || string_agg('{{"unit_kind":"' || unit_kind || '","unit_id":"' || unit_id || '","label":"' || label || '"}}', ',' ORDER BY unit_kind, CAST(unit_id AS VARCHAR)) || '],"invalidation_reason":null}}' AS body FROM mf JOIN lab ON mf.repo_id = lab.repo_id GROUP BY mf.repo_id),
pa AS (SELECT 'report' AS kind, repo_id, sha256(body) AS digest FROM rep UNION ALL SELECT 'review-manifest', repo_id, sha256(body) FROM mf UNION ALL SELECT 'review-result', repo_id, sha256(body) FROM rs),
ix AS (SELECT '{{"schema":"evidence/v1","experiment_id":"derived","artifacts":[' || (SELECT string_agg('{{"kind":"' || kind || '","repo_id":"' || repo_id || '","digest":"' || digest || '"}}', ',' ORDER BY kind, repo_id) FROM pa) || '],"analytical_outcomes":[' || (SELECT string_agg('{{"repo_id":"' || repo_id || '","outcome":"' || outcome || '"}}', ',' ORDER BY repo_id) FROM gate)
  || '],"lane_outcomes":[' || (SELECT string_agg('{{"repo_id":"' || repo_id || '","lane":"' || lane || '","outcome":"' || outcome || '"}}', ',' ORDER BY repo_id, lane) FROM lane) || ']}}' AS body)
SELECT kind, repo_id, digest FROM pa UNION ALL SELECT 'evidence', NULL, sha256(body) FROM ix"""


@query("SNK3_evidence_index", _INDEX)
def _(h):
    manifests = stored(_manifests(h))
    results = artifacts.result_artifact(manifests, h.review_labels, h.tips.where("false"))
    parts = stored(_digested(h).union(manifests).union(results))
    gates = calibrate.conjunctive_outcome(_gates(h, h.full_grid)[2].join(F.broadcast(h.grid.select("config_id")), "config_id", "left_semi"), ["repo_id"])
    return parts.union(artifacts.index_artifact("derived", parts, gates, _lanes(h))).select("kind", "repo_id", "digest")


@query("SNK4_check_report_vocabulary", f"{H} SELECT 'root_event' AS code, count(*) AS rows FROM repos")
def _(h):
    rows = normalize.exclusion_counts(h.classified)
    return report.check_report_vocabulary(rows, "reason", [r for r in report.EXCLUSIONS if r != "root_event"])


_DAMAGED = f"""{o.gates('one')}, odd AS (SELECT repo_id, count(*) AS n FROM gates WHERE outcome = 'pass' AND repo_id = '0' GROUP BY ALL)
SELECT repo_id, '$.gates[].outcome' AS path, 'unknown_code' AS violation, 'passed' AS value, n FROM odd UNION ALL SELECT repo_id, '$.exclusions[].reason', 'unknown_code', 'first_event', count(*) FROM events WHERE kind = 'root' AND repo_id = '1' GROUP BY ALL
UNION ALL SELECT repo_id, '$.candidates[].antecedent.text', 'unknown_field', NULL, count(*) FROM shown WHERE repo_id = '2' GROUP BY ALL UNION ALL SELECT repo_id, '$.preregistered_checks[].antecedent.text', 'unknown_field', NULL, count(*) FROM repos, grid, range({len(_WANT)}) WHERE repo_id = '2' GROUP BY ALL UNION ALL SELECT repo_id, '$.extra', 'unknown_field', NULL, 1 FROM repos WHERE repo_id = '3'"""


@query("SNK4_strict_reading", _DAMAGED)
def _(h):
    """Reports of which four have been damaged, each in its own way and depth. They are whole, as in the SQL: a report
    that a budget cut short would have nothing to read."""
    swap = lambda repo, old, new: (F.col("repo_id") == repo, F.replace("report", F.lit(old), F.lit(new)))
    swaps = [swap("0", '"outcome":"pass","metric"', '"outcome":"passed","metric"'), swap("1", '"reason":"root_event"', '"reason":"first_event"'), swap("2", '"antecedent":{', '"antecedent":{"text":[1,{"a":2}],'), swap("3", '{"schema"', '{"extra":{"deep":1},"schema"')]
    body = F.col("report")
    for where, changed in swaps:
        body = F.when(where, changed).otherwise(body)
    return report.check_report(_reports(h, dict.fromkeys(mining.LIMITS, (1 << 63) - 1)).withColumn("report", body))


@query("CHK1_check_changes", f"{H}, rules AS (SELECT repo_id, a, b, CASE WHEN rank <= 3 THEN 'block' ELSE 'warn' END AS severity FROM shown WHERE partition = 60 AND rank <= 6) SELECT xc.repo_id, xc.event_id, r.a, r.b, severity FROM xc JOIN rules r ON xc.repo_id = r.repo_id AND xc.a = r.a WHERE slice > 1 AND NOT list_contains(components, r.b)")
def _(h):
    rules = h.displayed.where("partition = 60").select("repo_id", "a", "b", (F.col("rank") <= 6).alias("accepted"), F.when(F.col("rank") <= 3, "block").alias("severity"))
    return check.check_changes(h.tx.where("slice > 1"), rules)
