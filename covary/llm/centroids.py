"""Operator 11: centroid clustering with ns-bounds (norm-of-sum bounds on centroid displacement).

Vectors are integers, so that every sum, mean and distance is exact and no result depends on how rows are dealt out.
Each vector keeps, for every centroid, its exact squared distance when it was last measured and the round of that
measurement. The history of all centroids is kept. Before a new round a stored distance is loosened by the norm of the
total displacement of that centroid since the measurement, |c(now) - c(then)|, which is never more than the sum of its
drifts round by round. If the loosened lower bounds of all other centroids lie above the upper bound of the assigned
one, nothing is measured; else the assigned one is measured, and then just the centroids whose bound still fails.
Bounds are floats with a margin of MARGIN; a centroid is ruled out only if it is strictly farther, so that ties still go
to the smaller number.

Only the centroid history (k x components x rounds, parameters all) and one row per cluster and round pass through the
driver. The state is a table in the shared folder, written once a round and removed when the next one is there: rows are
never shuffled, sums are partial aggregates of k rows a task, and a hot vector is no key of anything.

Kept are vectors of exactly `size` components, none null or non-finite; others (null vectors too) have no row. A
component beyond 2**21 in absolute value can't have a squared distance that fits a long: the job fails and says so.
Repeated rows and equal vectors each keep their row; a null id is kept and hashed as the empty text; among equal hashes
the smaller vector comes first. With fewer vectors than `k` there are as many centroids as vectors, with none the result
is empty. Columns beside the two named ones are ignored, so their names can't clash."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covary.llm.shared import Tables, quoted, table

SCALE, SIZE, K, ROUNDS = 64, 64, 16, 3
#: Relative width by which bounds are drawn wider than their floats say.
MARGIN = 1e-9
#: Largest absolute component: 64 squares of twice its size stay within a long.
LARGEST = 1 << 27
#: Rows measured at a time: bounds the memory of a task.
BLOCK = 4096


def kept_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = SCALE, size: int = SIZE) -> DataFrame:
    """(id, x) of the vectors that are clustered, x on the integer grid."""
    rows = df.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(vec_col)).cast("array<double>").alias("v"))
    all_of = lambda ok: F.coalesce(F.forall("v", ok), F.lit(False))
    rows = rows.where((F.size("v") == size) & all_of(lambda c: ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    far = F.raise_error(F.lit("a component is too large for exact distances")).cast("array<int>")
    whole = F.transform("v", lambda c: F.floor(c * F.lit(float(scale))).cast("int"))
    return rows.select("id", F.when(all_of(lambda c: F.abs(c) <= LARGEST / scale), whole).otherwise(far).alias("x"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of smallest sha256 of `seed:id`; a distributed top-k of k rows."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    return np.array([r.x for r in vectors.select("x", key.alias("key")).orderBy("key", "x").limit(k).collect()], np.int64)


def measure(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to rows."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def assigned(x: np.ndarray, cluster: np.ndarray | None, dist: np.ndarray | None, when: np.ndarray | None, history: np.ndarray, exact: bool = False):
    """(cluster, dist, when) after round len(history) - 1 of the rows x, from their state after an earlier round."""
    now, k, n = len(history) - 1, history.shape[1], len(x)
    c = history[now]
    if cluster is None:
        dist = np.stack([measure(x, c[j]) for j in range(k)], axis=1)
        return dist.argmin(axis=1).astype(np.int32), dist, np.zeros((n, k), np.int16)
    shift = (history - c).astype(np.float64)
    moved = np.sqrt(np.einsum("tkd,tkd->tk", shift, shift)) * (1 + MARGIN)
    rows, each = np.arange(n), np.arange(k)
    low = np.sqrt(dist) * (1 - MARGIN) - moved[when, each]
    up = np.sqrt(dist[rows, cluster]) * (1 + MARGIN) + moved[when[rows, cluster], cluster]
    low[rows, cluster] = np.inf
    dist, when = dist.copy(), when.copy()
    fails = (low <= up[:, None]).any(axis=1)
    own = np.flatnonzero(fails | (exact & (when[rows, cluster] != now)))
    own = own[when[own, cluster[own]] != now]
    dist[own, cluster[own]] = measure(x[own], c[cluster[own]])
    when[own, cluster[own]] = now
    up[own] = np.sqrt(dist[own, cluster[own]]) * (1 + MARGIN)
    at = np.flatnonzero(fails)
    i, j = np.nonzero(low[at] <= up[at, None])
    i = at[i]
    dist[i, j] = measure(x[i], c[j])
    when[i, j] = now
    # all that could be nearest are measured now; the others are strictly farther than the assigned one
    rivals = np.where(when[at] == now, dist[at], np.iinfo(np.int64).max)
    cluster = cluster.copy()
    cluster[at] = rivals.argmin(axis=1)
    return cluster, dist, when


def _arrays(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def _lists(a: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(np.ascontiguousarray(a).ravel()))


def assign(state: DataFrame, history: np.ndarray, exact: bool = False) -> DataFrame:
    """The state (id, x, cluster, dist, when) after another round; a first one takes (id, x)."""
    size, k, begins = history.shape[2], history.shape[1], "cluster" not in state.columns

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                x = _arrays(b.column(1), size, np.int64)
                old = (None, None, None) if begins else (b.column(2).to_numpy(), _arrays(b.column(3), k, np.int64), _arrays(b.column(4), k, np.int16))
                cluster, dist, when = assigned(x, *old, history, exact)
                yield pa.record_batch([b.column(0), b.column(1), pa.array(cluster), _lists(dist), _lists(when)], names=["id", "x", "cluster", "dist", "when"])

    added = [T.StructField(n, t) for n, t in (("cluster", T.IntegerType()), ("dist", T.ArrayType(T.LongType())), ("when", T.ArrayType(T.ShortType())))]
    return state.mapInArrow(run, T.StructType([state.schema["id"], state.schema["x"], *added]))


def means(state: DataFrame, before: np.ndarray) -> np.ndarray:
    """Each cluster's componentwise floor of the mean; an empty one stays. k rows reach the driver."""
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.get("x", F.lit(i)).cast("bigint")).alias(f"s{i}") for i in range(before.shape[1])])
    out = before.copy()
    for r in sums.collect():
        out[r["cluster"]] = [r[2 + i] // r["n"] for i in range(before.shape[1])]
    return out


def cluster_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, rounds: int = ROUNDS, seed: int = 1, scale: int = SCALE, size: int = SIZE):
    """((id, cluster, distance) of every kept vector, the final centroids) after `rounds` rounds of assignment and
    update and one assignment more."""
    spark = df.sparkSession
    before, now = Tables(spark), Tables(spark)
    state = now.written(kept_vectors(df, id_col, vec_col, scale, size))
    history = first_centroids(state, k, seed).reshape(1, -1, size)
    if not history.size:
        return state.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), np.zeros((0, size), np.int64)
    for last in [False] * rounds + [True]:
        moved = assign(state, history, exact=last)
        before, now = now, Tables(spark)
        if last:
            distance = F.element_at("dist", F.col("cluster") + 1).alias("distance")
            state = now.written(moved.select("id", "cluster", distance))
        else:
            state = now.written(moved)
            history = np.concatenate([history, means(state, history[-1])[None]])
        before.drop()
    return state, history[-1]


def query(spark, sf_dir: str) -> DataFrame:
    """op11: every kept vector's cluster and distance, with the sums of distances and the centroid's digest."""
    of, centroids = cluster_vectors(table(spark, sf_dir, "embeddings"))
    digests = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())]
    digest = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    sums = of.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # k rows
    total = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    facts = sums.join(F.broadcast(digest), "cluster").join(F.broadcast(total))
    return of.join(F.broadcast(facts), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """One pair of CTEs per round: the assignment to cN, and the centroids c(N + 1) that follow."""
    gap = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    steps = [
        """WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda y: CAST(floor(CAST(y AS DOUBLE) * 64) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = 64
), c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INT) AS k, x FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM v ORDER BY h, x LIMIT 16)
)"""
    ]
    for n in range(ROUNDS + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, arg_min(k, (d, k)) AS k, CAST(min(d) AS BIGINT) AS d FROM (SELECT v.r, c.k, {gap} AS d FROM v, c{n} c) GROUP BY r)")
        if n < ROUNDS:
            s, m = "sum(v.x[i])", "count(*)"
            floored = f"({s} - (({s} % {m}) + {m}) % {m}) // {m}"
            mean = f"SELECT k, list(m ORDER BY i) AS x FROM (SELECT a.k, i, CAST({floored} AS BIGINT) AS m FROM v JOIN a{n} a ON v.r = a.r, range(1, 65) AS t(i) GROUP BY a.k, i) GROUP BY k"
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN ({mean}) m ON c.k = m.k)")
    return (
        ", ".join(steps)
        + f"""
SELECT v.vec_id, a.k AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM v JOIN a{ROUNDS} a ON v.r = a.r JOIN c{ROUNDS} c ON a.k = c.k"""
    )


SQL = _sql()
