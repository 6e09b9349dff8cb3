"""Operator 9: sharding by extendible hashing.

A document's 60-bit key is cut out of the md5 of its id and text (which any engine can compute, and which spreads
documents evenly even if one id or source holds many of them). The directory is indexed by the key's leading bits; a bucket that exceeds the byte limit, and no other, is split on the next bit. A document's
shard is therefore the shortest prefix of its key whose bucket fits. Sizes are summed once per key prefix of `bits`
leading bits (a partial sum per task); all shorter prefixes follow from those sums, so the directory comes out of one
shuffle of sizes whatever its depth. Buckets still too large at that depth are cut on the following bits, their
documents only, until all fit or the bits end.

Only ids and sizes travel, no text. Only rows equal in id and text share every bit; a bucket of such copies that is
too large at the last bit is counted as one group and dealt out in runs of the limit, `part` 0, 1, ... A document
larger than the limit gets a shard of its own, marked `oversize`. A null id or text counts as the empty one, of size
0. Every input row yields one row; other columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covary.llm.shared import table, written

LIMIT = 1 << 20
BITS = 60
STEP = 1000


def key_of(doc_id: Column, text: Column) -> Column:
    """60 leading bits of the md5 of id and text."""
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, 15), 16, 10).cast("bigint")


def prefix(key: Column, depth: Column) -> Column:
    """The first `depth` bits of a 60-bit key as text."""
    return F.substring(F.lpad(F.bin(key), BITS, "0"), F.lit(1), depth)


def directory(sizes: DataFrame, limit: int, step: int = 16) -> DataFrame:
    """(key, size) -> (bucket, depth, bytes): the leaves, as bit prefixes."""
    grown, leaves, below = sizes, None, 0
    while below < BITS:
        upto = min(BITS, below + step)
        fine = grown.groupBy(prefix(F.col("key"), F.lit(upto)).alias("p")).agg(F.sum("size").alias("size"))
        depth = F.explode(F.sequence(F.lit(below), F.lit(upto))).alias("depth")
        every = fine.select("p", "size", depth).groupBy(F.expr("substring(p, 1, depth)").alias("bucket"), "depth").agg(F.sum("size").alias("bytes"))
        every = written(every)
        # a bucket exists if the one above it (one bit shorter) is too large; the first of a round exists anyway
        large = every.where(F.col("bytes") > limit)
        above = large.where(F.col("depth") < upto).select(F.explode(F.array(F.concat("bucket", F.lit("0")), F.concat("bucket", F.lit("1")))).alias("bucket"))
        there = every.join(above, "bucket", "left_semi").union(every.where(F.col("depth") == below))
        fits = there.where((F.col("bytes") <= limit) | (F.col("depth") == BITS))
        leaves = fits if leaves is None else leaves.union(fits)
        rest = large.where(F.col("depth") == upto)
        if upto == BITS or not rest.head(1):
            return leaves
        grown = written(grown.withColumn("bucket", prefix(F.col("key"), F.lit(upto))).join(rest.select("bucket"), "bucket", "left_semi").drop("bucket"))
        below = upto
    return leaves


def shards(docs: DataFrame, limit: int = LIMIT, step: int = 16) -> DataFrame:
    """(doc_id, size, bucket, part, oversize, shard): one row per row of docs."""
    kind = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("size"), key_of(F.col("doc_id"), F.col("text")).alias("key"))
    rows = written(rows)
    leaves = written(directory(rows.groupBy("key").agg(F.sum("size").alias("size")), limit, step))
    depths = [r[0] for r in leaves.select("depth").distinct().collect()]  # at most 61
    at = F.explode(F.array(*[F.lit(d) for d in sorted(depths)] or [F.lit(0)])).alias("depth")
    mine = rows.select("*", at).withColumn("bucket", prefix(F.col("key"), F.col("depth")))
    held = mine.join(leaves.select("bucket", F.col("bytes")), "bucket")
    whole = held.where(F.col("bytes") <= limit).select("doc_id", "size", "bucket", F.lit(0).cast("bigint").alias("part"))
    # what no bit can split: copies of one id. Equal (id, text) rows are one group with a count.
    same = held.where(F.col("bytes") > limit).groupBy("bucket", "doc_id", "key", "size").agg(F.count("*").alias("n"))
    w = Window.partitionBy("bucket").orderBy("doc_id", "key", "size")
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("size", F.lit(1)))).cast("bigint")
    runs = same.withColumn("need", F.ceil(F.col("n") / each)).withColumn("from", F.coalesce(F.sum("need").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # n rows again, in steps of STEP * STEP, STEP and one, so that no array grows with n beyond n / STEP^2 entries
    numbered = runs
    for upper, stride in ((F.col("n"), STEP * STEP), (F.least(F.lit(STEP * STEP), F.col("n") - F.col("i0")), STEP), (F.least(F.lit(STEP), F.col("n") - F.col("i1")), 1)):
        at = {STEP * STEP: "i0", STEP: "i1", 1: "i2"}[stride]
        base = {"i0": F.lit(0), "i1": F.col("i0"), "i2": F.col("i1")}[at]
        first = F.explode(F.sequence(F.lit(0).cast("bigint"), upper.cast("bigint") - 1, F.lit(stride).cast("bigint"))).alias("x")
        numbered = numbered.select("*", first).withColumn(at, base + F.col("x")).drop("x")
    cut = numbered.select(F.col("doc_id").cast(kind), "size", "bucket", (F.col("from") + F.floor(F.col("i2") / each)).alias("part"))
    return whole.union(cut).select(
        "doc_id", "size", "bucket", "part", (F.col("size") > limit).alias("oversize"), F.concat_ws("-", F.lit("s"), "bucket", "part").alias("shard")
    )


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """docs as one Parquet folder per shard; meant for documents whose id is unique."""
    place = shards(docs.select("doc_id", "text"), limit).select("doc_id", "shard")
    docs.join(place, "doc_id").repartition("shard").sortWithinPartitions("shard", "doc_id").write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every document's shard under the limit of one MiB."""
    return shards(table(spark, sf_dir, "documents"))


SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS size,
         lpad(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT)), {BITS}, '0') AS bits FROM documents
), b(bucket, depth, bytes) AS (
  SELECT '', 0, CAST(sum(size) AS BIGINT) FROM d
  UNION ALL
  SELECT substr(d.bits, 1, b.depth + 1), b.depth + 1, CAST(sum(d.size) AS BIGINT)
  FROM b JOIN d ON substr(d.bits, 1, b.depth) = b.bucket WHERE b.bytes > {LIMIT} AND b.depth < {BITS} GROUP BY 1, 2
)
SELECT doc_id, CAST(size AS BIGINT) AS size, bucket, CAST(0 AS BIGINT) AS part, size > {LIMIT} AS oversize, 's-' || bucket || '-0' AS shard
FROM d JOIN b ON starts_with(d.bits, b.bucket) WHERE b.bytes <= {LIMIT}
"""
