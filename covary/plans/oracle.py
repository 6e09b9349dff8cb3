"""The registered queries as DuckDB SQL: one chain of CTEs, and a final SELECT per query."""

from __future__ import annotations

from covary.functions.scalars import CANDIDATE_TAG, REVIEW_TAG, SHUFFLE_TAG
from covary.operators.calibrate import GAIN
from covary.operators.mining import CONFIDENCES, DEFAULT, LIFTS, OPPORTUNITIES
from covary.plans.history import DRIFT, LOOSER
from covary.operators.profiles import CORE, FRAMEWORKS, GENERIC, IDIOMATIC, LAYERS, RULES

B64 = "replace(replace(replace(base64(encode({0})), '=', ''), '+', '-'), '/', '_')"


def b64(col: str) -> str:
    return B64.format(col)


def nul(*fields: str) -> str:
    return "sha256(concat_ws(chr(0), " + ", ".join(fields) + "))"


def weight(mode: str, k: str) -> str:
    return f"CASE {mode} WHEN 'unit' THEN 1.0::DOUBLE WHEN 'inverse-component' THEN 1.0::DOUBLE / greatest(1, {k} - 1) ELSE 1.0::DOUBLE / greatest(1, {k} * ({k} - 1)) END"


def fold(keys: str, source: str, raw: str, value: str) -> str:
    return (
        f"SELECT {keys}, weight, CAST(sum(n) AS BIGINT) AS {raw}, list_reduce(list(CAST(n AS DOUBLE) * ({weight('weight', 'k')}) ORDER BY k), lambda x, y: x + y) AS {value} "
        f"FROM {source}, w GROUP BY {keys}, weight"
    )


def history(path_limit: int = 2000, component_limit: int = 100, shuffled: bool = False, grid: str = "one", unit: bool = False, repo: str = "n_regionkey", drift: bool = False, untrained: bool = False) -> str:
    """The CTEs. grid: one, or all 81 configurations; unit: non-unit configurations under unit weight; untrained: no
    transaction at all."""
    order = "row_number() OVER (PARTITION BY repo_id ORDER BY " + (nul(f"'{SHUFFLE_TAG}'", "tip", "event_id") + ", event_id" if shuffled else "seq") + ")"
    only = f"WHERE config_id = '{DEFAULT}'" if grid == "one" else ""
    values = lambda xs, f="{}": ", ".join(f"({f.format(x)})" for x in xs)
    return f"""
WITH ev0 AS (
  SELECT CAST({repo} AS VARCHAR) AS repo_id, o_orderkey AS okey, CAST(o_orderkey AS VARCHAR) AS event_id, o_orderstatus AS st, o_orderpriority AS prio,
         row_number() OVER (PARTITION BY {repo} ORDER BY o_orderdate, o_orderkey) AS seq
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
), events AS (
  SELECT repo_id, okey, event_id, prio, seq, CASE WHEN seq = 1 THEN 'root' WHEN st = 'P' THEN 'merge-result' ELSE 'single-parent' END AS kind,
         lag(event_id) OVER (PARTITION BY repo_id ORDER BY seq) AS first_parent, CASE WHEN seq = 1 THEN 0 WHEN st = 'P' THEN 2 ELSE 1 END AS n_parents,
         count(*) OVER (PARTITION BY repo_id) AS n, last_value(event_id) OVER (PARTITION BY repo_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tip
  FROM ev0
), lp AS (
  SELECT *, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS bn, CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'M' ELSE 'D' END AS status
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN (SELECT okey, seq, n FROM events) e ON l_orderkey = e.okey
), raw AS (
  SELECT l_orderkey AS okey, 'svc/b' || bn || '/' || replace(p_name, ' ', '_') || '.go' AS path, status, '100644' AS dst_mode FROM lp WHERE (l_orderkey * 7 + l_partkey * 13) % 80 >= bn {f"+ {LOOSER} OR seq * 100 > n * {DRIFT}" if drift else ""}
  UNION ALL SELECT l_orderkey, 'charts/b' || bn || '/values.yaml', status, '100644' FROM lp WHERE p_size <= 25 AND l_orderkey % 10 <> 0
  UNION ALL SELECT l_orderkey, 'vendor/' || p_type || '/lib.go', status, '100644' FROM lp WHERE p_type = 'PROMO'
  UNION ALL SELECT l_orderkey, 'modules/s' || l_suppkey, status, '160000' FROM lp WHERE l_quantity >= 50
  UNION ALL SELECT okey, 'README.md', 'M', '100644' FROM events WHERE prio = '1-URGENT'
), all_changes AS (
  SELECT repo_id, event_id, kind, row_number() OVER (PARTITION BY raw.okey ORDER BY path, status, dst_mode) AS pos, '100644' AS src_mode, dst_mode,
         substr(sha256(path), 1, 40) AS src_oid, substr(sha256(path || status), 1, 40) AS dst_oid, status, path
  FROM raw JOIN events ON raw.okey = events.okey
), changes AS (
  SELECT * FROM all_changes WHERE kind <> 'root'
), dedup AS (
  SELECT repo_id, event_id, path, arg_min(src_mode, pos) AS src_mode, arg_min(dst_mode, pos) AS dst_mode, arg_min(status, pos) AS status FROM changes GROUP BY ALL
), kinds AS (
  SELECT *, CASE WHEN list_contains(string_split(path, '/'), 'vendor') THEN 'vendor_path' WHEN src_mode = '160000' OR dst_mode = '160000' THEN 'gitlink_path' ELSE 'eligible' END AS path_kind,
         CASE WHEN strpos(path, '/') = 0 THEN '.' ELSE regexp_replace(path, '/[^/]*$', '') END AS component FROM dedup
), per_event AS (
  SELECT repo_id, event_id, count(*) AS n_paths, count_if(path_kind = 'vendor_path') AS n_vendor, count_if(path_kind = 'gitlink_path') AS n_gitlink,
         count(DISTINCT CASE WHEN path_kind = 'eligible' THEN component END) AS n_components FROM kinds GROUP BY ALL
), classified AS (
  SELECT e.repo_id, e.event_id, e.seq, e.kind, coalesce(n_paths, 0) AS n_paths, coalesce(n_vendor, 0) AS n_vendor, coalesce(n_gitlink, 0) AS n_gitlink, coalesce(n_components, 0) AS n_components,
         CASE WHEN e.kind = 'root' THEN 'root_event' WHEN coalesce(n_paths, 0) > {path_limit} THEN 'event_path_limit' WHEN coalesce(n_components, 0) = 0 THEN 'no_eligible_paths'
              WHEN n_components > {component_limit} THEN 'event_component_limit' ELSE 'eligible' END AS outcome
  FROM events e LEFT JOIN per_event p ON e.repo_id = p.repo_id AND e.event_id = p.event_id
), evid AS (
  SELECT k.repo_id, c.seq, k.event_id, c.kind, k.path, k.status, k.component FROM kinds k JOIN classified c ON k.repo_id = c.repo_id AND k.event_id = c.event_id
  WHERE path_kind = 'eligible' AND outcome NOT IN ('root_event', 'event_path_limit')
), tx0 AS (
  SELECT e.repo_id, e.seq, e.event_id, list_sort(list(DISTINCT e.component)) AS components, count(DISTINCT e.component) AS k
  FROM evid e JOIN classified c ON e.repo_id = c.repo_id AND e.event_id = c.event_id WHERE outcome = 'eligible' GROUP BY ALL
), ord AS (
  SELECT repo_id, event_id, n, kind, {order} AS pos FROM events
), sl AS (
  SELECT repo_id, event_id, pos, n, kind, 1 + CAST(pos > n * 60 // 100 AS INT) + CAST(pos > n * 70 // 100 AS INT) + CAST(pos > n * 80 // 100 AS INT) + CAST(pos > n * 90 // 100 AS INT) AS slice FROM ord
), tx AS (
  SELECT tx0.*, slice FROM tx0 JOIN sl ON tx0.repo_id = sl.repo_id AND tx0.event_id = sl.event_id {"WHERE false" if untrained else ""}
), xc AS (
  SELECT repo_id, event_id, seq, slice, k, components, unnest(components) AS a FROM tx
), cstat AS (
  SELECT repo_id, slice, a, k, count(*) AS n FROM xc GROUP BY ALL
), pstat AS (
  SELECT repo_id, slice, a, b, k, count(*) AS n FROM (SELECT repo_id, slice, k, a, unnest(components) AS b FROM xc) WHERE a <> b GROUP BY ALL
), tot AS (
  SELECT repo_id, slice, k, count(*) AS n FROM tx GROUP BY ALL
), snap(partition, last) AS (
  VALUES (60, 1), (70, 2), (80, 3), (90, 4), (100, 5)
), ccum AS (
  SELECT repo_id, partition, a, k, sum(n) AS n FROM cstat JOIN snap ON slice <= last GROUP BY ALL
), pcum AS (
  SELECT repo_id, partition, a, b, k, sum(n) AS n FROM pstat JOIN snap ON slice <= last GROUP BY ALL
), tcum AS (
  SELECT repo_id, partition, k, sum(n) AS n FROM tot JOIN snap ON slice <= last GROUP BY ALL
), w(weight) AS (
  VALUES ('unit'), ('inverse-component'), ('pair-normalized')
), cw AS (
  {fold('repo_id, partition, a', 'ccum', 'opportunity', 'weighted_exposure')}
), pw AS (
  {fold('repo_id, partition, a, b', 'pcum', 'support', 'weighted_support')}
), tw AS (
  {fold('repo_id, partition', 'tcum', 'transactions', 'total_weight')}
), metrics AS (
  SELECT *, confidence / prevalence AS lift FROM (
    SELECT p.repo_id, p.partition, p.weight, p.a, p.b, opportunity, support, c.weighted_exposure, weighted_support, weighted_support / c.weighted_exposure AS confidence,
           b.weighted_exposure / total_weight AS prevalence, transactions
    FROM pw p JOIN cw c ON p.repo_id = c.repo_id AND p.partition = c.partition AND p.weight = c.weight AND p.a = c.a
    JOIN (SELECT repo_id, partition, weight, a AS b, weighted_exposure FROM cw) b ON p.repo_id = b.repo_id AND p.partition = b.partition AND p.weight = b.weight AND p.b = b.b
    JOIN tw t ON p.repo_id = t.repo_id AND p.partition = t.partition AND p.weight = t.weight)
), grid0 AS (
  SELECT 'weight=' || weight || ';opportunities=' || o || ';confidence=' || c || ';lift=' || x AS config_id, weight, o AS min_opportunity, CAST(c AS DOUBLE) AS min_confidence, CAST(x AS DOUBLE) AS min_lift
  FROM w, (VALUES {values(OPPORTUNITIES)}) AS t1(o), (VALUES {values(CONFIDENCES, "'{:.2f}'")}) AS t2(c), (VALUES {values(LIFTS, "'{:.2f}'")}) AS t3(x)
), grid AS (
  SELECT config_id, {"'unit'" if unit else "weight"} AS weight, min_opportunity, min_confidence, min_lift FROM grid0 {only} {("AND" if only else "WHERE") + " weight <> 'unit'" if unit else ""}
), elig AS (
  SELECT m.*, config_id FROM metrics m JOIN grid g ON m.weight = g.weight
  WHERE support >= 3 AND transactions >= 100 AND opportunity >= min_opportunity AND confidence >= min_confidence AND lift >= min_lift
), shown AS (
  SELECT *, {nul(f"'{CANDIDATE_TAG}'", "'inferred'", b64('a'), b64('b'))} AS candidate_id FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_id, config_id, partition ORDER BY confidence DESC, lift DESC, support DESC, opportunity DESC, a, b) AS rank FROM elig)
  WHERE rank <= 10
), repos AS (
  SELECT DISTINCT repo_id FROM tx
), cases AS (
  SELECT repo_id, config_id FROM repos, grid
), ev AS (
  SELECT s.*, last + 1 AS slice FROM shown s JOIN snap ON s.partition = snap.partition WHERE s.partition < 100
), hold AS (
  SELECT ev.*, CAST(coalesce(c.n, 0) AS BIGINT) AS opportunities, CAST(coalesce(p.n, 0) AS BIGINT) AS adherences, CASE WHEN coalesce(c.n, 0) > 0 THEN CAST(coalesce(p.n, 0) AS DOUBLE) / c.n END AS adherence
  FROM ev LEFT JOIN (SELECT repo_id, slice, a, sum(n) AS n FROM cstat GROUP BY ALL) c ON ev.repo_id = c.repo_id AND ev.slice = c.slice AND ev.a = c.a
  LEFT JOIN (SELECT repo_id, slice, a, b, sum(n) AS n FROM pstat GROUP BY ALL) p ON ev.repo_id = p.repo_id AND ev.slice = p.slice AND ev.a = p.a AND ev.b = p.b
), mm AS (
  SELECT repo_id, config_id, CASE WHEN sum(opportunities) > 0 THEN sum(adherences)::DOUBLE / sum(opportunities) END AS micro, avg(adherence) AS macro FROM hold GROUP BY ALL
), top2 AS (
  SELECT repo_id, partition, a AS c, row_number() OVER (PARTITION BY repo_id, partition ORDER BY sum(n) DESC, a) AS place FROM ccum GROUP BY repo_id, partition, a QUALIFY place <= 2
), freq AS (
  SELECT s.* EXCLUDE (b), CASE WHEN t1.c <> s.a THEN t1.c ELSE t2.c END AS b FROM shown s
  JOIN top2 t1 ON t1.repo_id = s.repo_id AND t1.partition = s.partition AND t1.place = 1 LEFT JOIN top2 t2 ON t2.repo_id = s.repo_id AND t2.partition = s.partition AND t2.place = 2
), freq_hold AS (
  SELECT f.repo_id, f.config_id, f.partition, f.rank, f.a, f.b, CAST(coalesce(c.n, 0) AS BIGINT) AS opportunities, CAST(coalesce(p.n, 0) AS BIGINT) AS adherences,
         CASE WHEN coalesce(c.n, 0) > 0 THEN CAST(coalesce(p.n, 0) AS DOUBLE) / c.n END AS adherence
  FROM (SELECT freq.*, last + 1 AS slice FROM freq JOIN snap ON freq.partition = snap.partition WHERE freq.partition < 100) f
  LEFT JOIN (SELECT repo_id, slice, a, sum(n) AS n FROM cstat GROUP BY ALL) c ON f.repo_id = c.repo_id AND f.slice = c.slice AND f.a = c.a
  LEFT JOIN (SELECT repo_id, slice, a, b, sum(n) AS n FROM pstat GROUP BY ALL) p ON f.repo_id = p.repo_id AND f.slice = p.slice AND f.a = p.a AND f.b = p.b
), freq_mm AS (
  SELECT repo_id, config_id, CASE WHEN sum(opportunities) > 0 THEN sum(adherences)::DOUBLE / sum(opportunities) END AS micro, avg(adherence) AS macro FROM freq_hold GROUP BY ALL
), wcov AS (
  SELECT n.repo_id, g.config_id, n.slice, n.eligible, coalesce(c.covered, 0) AS covered
  FROM (SELECT repo_id, slice, count(*) AS eligible FROM tx WHERE slice > 1 GROUP BY ALL) n CROSS JOIN grid g
  LEFT JOIN (SELECT ev.repo_id, config_id, ev.slice, count(DISTINCT event_id) AS covered FROM ev JOIN xc ON ev.repo_id = xc.repo_id AND ev.slice = xc.slice AND ev.a = xc.a GROUP BY ALL) c
  ON n.repo_id = c.repo_id AND g.config_id = c.config_id AND n.slice = c.slice
), cov AS (
  SELECT repo_id, config_id, sum(covered)::DOUBLE / sum(eligible) AS coverage, min(covered) AS least_covered FROM wcov GROUP BY ALL
), abst AS (
  SELECT c.repo_id, c.config_id, (4 - count(DISTINCT s.partition)) / 4.0::DOUBLE AS abstention, count(s.partition) AS displayed
  FROM cases c LEFT JOIN shown s ON c.repo_id = s.repo_id AND c.config_id = s.config_id AND s.partition < 100 GROUP BY ALL
), adj AS (
  SELECT coalesce(x.repo_id, y.repo_id) AS repo_id, coalesce(x.config_id, y.config_id) AS config_id, coalesce(x.partition, y.partition - 10) AS cutoff, x.rank AS r1, y.rank AS r2
  FROM (SELECT * FROM shown WHERE partition < 90) x FULL JOIN (SELECT * FROM shown WHERE partition BETWEEN 70 AND 90) y
  ON x.repo_id = y.repo_id AND x.config_id = y.config_id AND x.partition = y.partition - 10 AND x.a = y.a AND x.b = y.b
), jac AS (
  SELECT c.repo_id, c.config_id, c.cutoff, CASE WHEN count(r1) + count(r2) > 0 THEN count_if(r1 IS NOT NULL AND r2 IS NOT NULL)::DOUBLE / count_if(r1 IS NOT NULL OR r2 IS NOT NULL) END AS jaccard
  FROM (SELECT * FROM cases, (VALUES (60), (70), (80)) AS t(cutoff)) c LEFT JOIN adj ON c.repo_id = adj.repo_id AND c.config_id = adj.config_id AND c.cutoff = adj.cutoff GROUP BY ALL
), surv AS (
  SELECT * FROM adj WHERE r1 IS NOT NULL AND r2 IS NOT NULL
), tau AS (
  SELECT c.repo_id, c.config_id, c.cutoff, CAST(coalesce(n, 0) AS INT) AS survivors, CASE WHEN n >= 2 THEN coalesce(t, 0)::DOUBLE / (n * (n - 1) / 2) END AS tau
  FROM (SELECT * FROM cases, (VALUES (60), (70), (80)) AS v(cutoff)) c LEFT JOIN (SELECT repo_id, config_id, cutoff, count(*) AS n FROM surv GROUP BY ALL) m ON c.repo_id = m.repo_id AND c.config_id = m.config_id AND c.cutoff = m.cutoff
  LEFT JOIN (SELECT x.repo_id, x.config_id, x.cutoff, sum(sign(y.r2 - x.r2)) AS t FROM surv x JOIN surv y ON x.repo_id = y.repo_id AND x.config_id = y.config_id AND x.cutoff = y.cutoff AND x.r1 < y.r1 GROUP BY ALL) t ON c.repo_id = t.repo_id AND c.config_id = t.config_id AND c.cutoff = t.cutoff
), taus AS (
  SELECT repo_id, config_id, max(tau) FILTER (cutoff = 60) AS tau_60, max(tau) FILTER (cutoff = 70) AS tau_70, max(tau) FILTER (cutoff = 80) AS tau_80 FROM tau GROUP BY ALL
), rm AS (
  SELECT tau_60, tau_70, tau_80, a.repo_id, a.config_id, micro, macro, CASE WHEN micro IS NULL THEN CASE WHEN displayed = 0 THEN 'no_candidates' ELSE 'no_opportunities' END END AS adherence_reason, coverage,
         CASE WHEN coverage IS NULL THEN 'no_eligible_evaluation_events' END AS coverage_reason, least_covered, abstention, displayed, min_jaccard, n_jaccard,
         CASE WHEN min_jaccard IS NULL THEN 'empty_candidate_sets' END AS jaccard_reason
  FROM abst a LEFT JOIN taus ON a.repo_id = taus.repo_id AND a.config_id = taus.config_id LEFT JOIN mm ON a.repo_id = mm.repo_id AND a.config_id = mm.config_id LEFT JOIN cov ON a.repo_id = cov.repo_id AND a.config_id = cov.config_id
  LEFT JOIN (SELECT repo_id, config_id, min(jaccard) AS min_jaccard, count(jaccard) AS n_jaccard FROM jac GROUP BY ALL) j ON a.repo_id = j.repo_id AND a.config_id = j.config_id
), devs AS (
  SELECT ev.repo_id, config_id, ev.partition, ev.a, ev.b, xc.event_id FROM ev JOIN xc ON ev.repo_id = xc.repo_id AND ev.slice = xc.slice AND ev.a = xc.a WHERE NOT list_contains(components, b)
), cuts AS (
  SELECT s.repo_id, s.n, p AS percentile, CAST(s.n * p // 100 AS INT) AS bound, e.event_id AS cutoff_id
  FROM (SELECT repo_id, count(*) AS n FROM ord GROUP BY ALL) s CROSS JOIN (VALUES (60), (70), (80), (90), (100)) AS t(p) LEFT JOIN ord e ON e.repo_id = s.repo_id AND e.pos = s.n * p // 100
)"""


def sub(sql: str) -> str:
    """A whole query with its own CTEs, as a subquery."""
    return f"({sql})"


MM = "SELECT repo_id, config_id, micro, macro FROM mm"
R6 = lambda *cols: ", ".join(f"round({c}, 6) + 0.0::DOUBLE AS {c}" for c in cols)
RM = f"repo_id, config_id, {R6('micro', 'macro')}, adherence_reason, {R6('coverage')}, coverage_reason, CAST(least_covered AS BIGINT) AS least_covered, abstention, displayed, {R6('min_jaccard')}, n_jaccard, jaccard_reason, {R6('tau_60', 'tau_70', 'tau_80')}"
SHOWN = f"SELECT repo_id, config_id, partition, rank, a, b, candidate_id, opportunity, support, {R6('weighted_exposure', 'weighted_support', 'confidence', 'prevalence', 'lift')} FROM shown"


def gains(grid: str, **of) -> str:
    """repo_id, config_id, baseline, micro_gain, macro_gain, reason"""
    h = history(grid=grid, **of)
    unw, shuf = history(grid=grid, unit=True, **of) + " " + MM, history(grid=grid, shuffled=True, **of) + " " + MM
    one = lambda name, src: (
        f"SELECT a.repo_id, a.config_id, '{name}' AS baseline, CASE WHEN '{name}' <> 'unweighted' OR g.weight <> 'unit' THEN m.micro - s.micro END AS micro_gain, "
        f"CASE WHEN '{name}' <> 'unweighted' OR g.weight <> 'unit' THEN m.macro - s.macro END AS macro_gain, "
        f"CASE WHEN '{name}' = 'unweighted' AND g.weight = 'unit' THEN 'identical_baseline' WHEN s.micro IS NULL OR m.micro IS NULL THEN 'no_opportunities' END AS reason "
        f"FROM rm a JOIN grid g ON a.config_id = g.config_id LEFT JOIN mm m ON a.repo_id = m.repo_id AND a.config_id = m.config_id LEFT JOIN {src} s ON a.repo_id = s.repo_id AND a.config_id = s.config_id"
    )
    return f"{h}, unw AS {sub(unw)}, shuf AS {sub(shuf)}, gains AS ({one('frequent', 'freq_mm')} UNION ALL {one('unweighted', 'unw')} UNION ALL {one('shuffled', 'shuf')})"


def gates(grid: str, role: str = "development", **of) -> str:
    need = lambda v, ok: f"CASE WHEN {v} IS NULL THEN 'inconclusive' WHEN {ok} THEN 'pass' ELSE 'fail' END"
    return f"""{gains(grid, **of)}, emitted AS (
  SELECT r.repo_id, r.config_id, max(CASE WHEN f.transactions < 100 THEN 1 WHEN coalesce(s.c, 0) BETWEEN 1 AND 10 THEN 0 ELSE 2 END) AS s
  FROM rm r JOIN (SELECT repo_id, partition, sum(n) AS transactions FROM tcum WHERE partition < 100 GROUP BY ALL) f ON r.repo_id = f.repo_id
  LEFT JOIN (SELECT repo_id, config_id, partition, count(*) AS c FROM shown GROUP BY ALL) s ON r.repo_id = s.repo_id AND r.config_id = s.config_id AND f.partition = s.partition GROUP BY ALL
), g AS (
  SELECT repo_id, config_id, max(CASE WHEN baseline = 'frequent' THEN round(least(micro_gain, macro_gain), 9) END) AS frequent, max(CASE WHEN baseline = 'unweighted' THEN round(least(micro_gain, macro_gain), 9) END) AS unweighted,
         max(CASE WHEN baseline = 'shuffled' THEN round(least(micro_gain, macro_gain), 9) END) AS shuffled, max(CASE WHEN baseline = 'unweighted' THEN reason END) AS same FROM gains GROUP BY ALL
), wide AS (
  SELECT r.repo_id, r.config_id, CASE e.s WHEN 0 THEN 'pass' WHEN 2 THEN 'fail' ELSE 'inconclusive' END AS candidate_count, {need('coverage', 'coverage >= 0.05')} AS coverage,
         {need('least_covered', 'least_covered >= 1')} AS window_coverage, {need('frequent', f'frequent >= {GAIN[role]}')} AS gain_frequent,
         CASE WHEN same = 'identical_baseline' THEN 'pass' ELSE {need('unweighted', 'unweighted >= 0')} END AS not_below_unweighted, {need('shuffled', 'shuffled >= 0.05')} AS gain_shuffled,
         CASE WHEN n_jaccard < 3 THEN 'inconclusive' ELSE {need('min_jaccard', 'min_jaccard >= 0.5')} END AS stability
  FROM rm r LEFT JOIN emitted e ON r.repo_id = e.repo_id AND r.config_id = e.config_id LEFT JOIN g ON r.repo_id = g.repo_id AND r.config_id = g.config_id
), gates AS (
  UNPIVOT wide ON candidate_count, coverage, window_coverage, gain_frequent, not_below_unweighted, gain_shuffled, stability INTO NAME gate VALUE outcome
)"""


WORST = "CASE max(CASE outcome WHEN 'pass' THEN 0 WHEN 'inconclusive' THEN 1 ELSE 2 END) WHEN 0 THEN 'pass' WHEN 1 THEN 'inconclusive' ELSE 'fail' END AS outcome"

REVIEW = f"""{history()}, fin AS (
  SELECT s.repo_id, e.event_id AS repository, s.a, s.b FROM shown s JOIN (SELECT repo_id, event_id FROM events WHERE seq = n) e ON s.repo_id = e.repo_id WHERE s.partition = 100
), sc AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY hash) AS place FROM (
    SELECT *, {nul(f"'{REVIEW_TAG}'", 'repository', "'inferred-candidate'", "'inferred'", b64('a'), b64('b'))} AS hash FROM fin)) WHERE place <= 8
), dv AS (
  SELECT DISTINCT d.repo_id, sc.repository, d.a, d.b, c.cutoff_id, d.event_id, {nul(f"'{REVIEW_TAG}'", 'sc.repository', "'deviation'", "'inferred'", b64('d.a'), b64('d.b'), 'c.cutoff_id', 'd.event_id')} AS hash
  FROM devs d JOIN sc ON d.repo_id = sc.repo_id AND d.a = sc.a AND d.b = sc.b JOIN cuts c ON d.repo_id = c.repo_id AND d.partition = c.percentile
), sd AS (
  SELECT * EXCLUDE (p, later), row_number() OVER (PARTITION BY repo_id ORDER BY hash) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY later, hash) AS p FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY repo_id, a, b ORDER BY hash) > 1 AS INT) AS later FROM dv)) WHERE p <= 10
)"""

LABELS = """WITH l00 AS (
  SELECT doc_id // 1000 AS part, CASE WHEN doc_id % 2 = 0 THEN 'candidate' ELSE 'deviation' END AS unit_kind, doc_id AS unit_id, quality, toxic FROM labels
), l0 AS (
  SELECT *, CAST(part * 100 + (row_number() OVER (PARTITION BY part, unit_kind ORDER BY unit_id) - 1) // CASE unit_kind WHEN 'candidate' THEN 8 ELSE 10 END AS VARCHAR) AS repo_id FROM l00
), rl AS (
  SELECT *, CASE WHEN toxic = 1 THEN 'accident' WHEN quality = 1 THEN CASE unit_kind WHEN 'candidate' THEN 'decision' ELSE 'review-worthy' END ELSE 'unclear' END AS label FROM l0
), prec AS (
  SELECT repo_id, unit_kind, count(*) AS units, CAST(count_if(label = CASE unit_kind WHEN 'candidate' THEN 'decision' ELSE 'review-worthy' END) AS BIGINT) AS useful,
         CASE WHEN count(*) < CASE unit_kind WHEN 'candidate' THEN 8 ELSE 10 END THEN 'inconclusive' WHEN count_if(label = CASE unit_kind WHEN 'candidate' THEN 'decision' ELSE 'review-worthy' END) >= 6 THEN 'pass' ELSE 'fail' END AS outcome
  FROM rl GROUP BY repo_id, unit_kind
), acc AS (
  SELECT CAST(user_id AS VARCHAR) AS repo_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6::DOUBLE / 3600 AS elapsed, event_type = 'purchase' AS useful, event_type = 'error' AND value > 99 AS interrupted, event_id, CASE WHEN event_id % 2 = 0 THEN 'inferred' ELSE 'profile' END AS lane FROM events
), adop AS (
  SELECT a.repo_id, a.proposals, n.elapsed AS reached, CASE WHEN a.interrupted THEN 'inconclusive' WHEN coalesce(n.elapsed <= 600, false) AND proposals >= 3 THEN 'pass' ELSE 'fail' END AS outcome
  FROM (SELECT repo_id, count(*) AS proposals, bool_or(interrupted) AS interrupted FROM acc GROUP BY ALL) a
  LEFT JOIN (SELECT repo_id, elapsed, row_number() OVER (PARTITION BY repo_id ORDER BY elapsed) AS k FROM acc WHERE useful) n ON a.repo_id = n.repo_id AND n.k = 3
), lanes AS (
  SELECT a.repo_id, a.lane, CASE WHEN a.interrupted THEN 'inconclusive' WHEN coalesce(n.elapsed <= 600, false) AND proposals >= 3 THEN 'pass' ELSE 'fail' END AS outcome
  FROM (SELECT repo_id, lane, count(*) AS proposals, bool_or(interrupted) AS interrupted FROM acc GROUP BY ALL) a
  LEFT JOIN (SELECT repo_id, lane, elapsed, row_number() OVER (PARTITION BY repo_id, lane ORDER BY elapsed) AS k FROM acc WHERE useful) n ON a.repo_id = n.repo_id AND a.lane = n.lane AND n.k = 3
)"""

_in = lambda xs: ", ".join(f"'{x}'" for x in xs)
PROFILES = f"""WITH tree AS (
  SELECT CAST(p_partkey // 140 AS VARCHAR) AS repo_id, 'mod' || (p_partkey % 7) || '/' || CASE p_size % 10 WHEN 0 THEN 'service' WHEN 1 THEN 'utils' WHEN 2 THEN 'vendor' ELSE split_part(p_name, ' ', 1) END
         || CASE WHEN p_partkey % 4 = 0 THEN '/' || split_part(p_name, ' ', 2) ELSE '' END || '/p' || p_partkey || CASE p_size % 3 WHEN 0 THEN '_test.go' WHEN 1 THEN '.go' ELSE '.md' END AS path,
         CASE WHEN p_partkey % 50 = 7 THEN '160000' ELSE '100644' END AS mode FROM part
), modules AS (
  SELECT CAST(s_suppkey // 7 AS VARCHAR) AS repo_id, CASE WHEN s_suppkey % 7 = 0 THEN '.' ELSE 'mod' || (s_suppkey % 7) END AS root,
         'example.com/r' || (s_suppkey // 7) || '/m' || (s_suppkey % 7) || CASE (s_suppkey % 7) % 3 WHEN 1 THEN '/v2' WHEN 2 THEN '/v1' ELSE '' END AS module_path, '1.' || (22 + s_nationkey % 8) AS go_version,
         CASE WHEN s_acctbal > 5000 THEN 'github.com/onsi/ginkgo/v2' ELSE 'github.com/onsi/ginkgox' END AS req, CASE WHEN s_nationkey % 4 = 0 THEN '' ELSE 'v1.0.0' END AS rep
  FROM supplier
), dirs AS (
  SELECT DISTINCT repo_id, regexp_replace(path, '/[^/]*$', '') AS dir FROM tree
  WHERE NOT list_contains(string_split(path, '/'), 'vendor') AND mode <> '160000' AND ends_with(path, '.go') AND NOT ends_with(path, '_test.go')
), nearest AS (
  SELECT d.repo_id, d.dir, arg_max(m.root, CASE m.root WHEN '.' THEN 0 ELSE len(string_split(m.root, '/')) END) AS root, max(CASE m.root WHEN '.' THEN 0 ELSE len(string_split(m.root, '/')) END) AS size
  FROM dirs d LEFT JOIN modules m ON d.repo_id = m.repo_id AND (m.root = '.' OR d.dir = m.root OR starts_with(d.dir, m.root || '/')) GROUP BY ALL
), near AS (
  SELECT repo_id, dir, root, CASE WHEN root IS NOT NULL THEN len(string_split(dir, '/')) - size END AS depth FROM nearest
), checks AS (
  SELECT repo_id, '{CORE}' AS tier, 'module-topology' AS rule, NULL AS good, root || '=' || module_path AS e FROM modules
  UNION ALL SELECT repo_id, '{CORE}', 'go-version-floor', CAST(split_part(go_version, '.', 2) AS INT) >= 25, root || '=' || go_version FROM modules
  UNION ALL SELECT repo_id, '{CORE}', 'no-local-replace', rep <> '', root FROM modules
  UNION ALL SELECT repo_id, '{CORE}', 'semantic-import-version', NOT ends_with(module_path, '/v1'), root || '=' || module_path FROM modules
  UNION ALL SELECT repo_id, '{IDIOMATIC}', 'max-package-depth', coalesce(depth <= 1, true), dir FROM near
  UNION ALL SELECT repo_id, '{IDIOMATIC}', 'domain-over-layers', split_part(dir, '/', -1) NOT IN ({_in(LAYERS)}), dir FROM dirs
  UNION ALL SELECT repo_id, '{IDIOMATIC}', 'no-generic-packages', split_part(dir, '/', -1) NOT IN ({_in(GENERIC)}), dir FROM dirs
  UNION ALL SELECT repo_id, '{IDIOMATIC}', 'no-heavy-test-frameworks', NOT ({' OR '.join(f"req = '{f}' OR starts_with(req, '{f}/')" for f in FRAMEWORKS)}), root FROM modules
), rules AS (
  SELECT repo_id, tier, rule, coalesce(bool_and(good), true) AS compliant, coalesce(string_agg(e, ',' ORDER BY e) FILTER (good IS NULL OR NOT good), '') AS evidence FROM checks GROUP BY ALL
)"""
RULE_ROWS = {(t, r): f"SELECT repo_id, tier, rule, compliant, evidence FROM rules WHERE rule = '{r}'" for t, rs in RULES.items() for r in rs}
