"""What the operators of this subpackage have in common."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from covary.sources.store import shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as it must be written where it holds dots or back ticks."""
    return "`" + name.replace("`", "``") + "`"


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else. Pure ASCII strings take the much faster byte path of lower()."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(
        F.translate(col, UPPER, UPPER.lower())
    )


def id_fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def row_key(*cols: Column) -> Column:
    """A 128-bit key that rows share only if they agree in all these columns; nulls are told from empty texts."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in cols]
    return F.unhex(F.md5(F.concat(*told).cast("binary")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once, wherever the body's own functions use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Rows that a task turns into its output at a time. Batches of thousands of whole texts would stand in a worker twice.
SLICE_ROWS = 256


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, cut into pieces of SLICE_ROWS rows."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE_ROWS):
            yield b.slice(at, SLICE_ROWS)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: later jobs don't compute it again and a lost executor
    doesn't lose it. (checkpoint() would compute a plan without a shuffle twice.)"""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """Intermediate tables of one operator; those not needed for its result are removed once that is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame) -> DataFrame:
        self.paths.append(f"{shared_folder(self.spark)}/tables/{uuid.uuid4().hex}")
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def drop(self) -> None:
        """Removes the tables. The driver's collector is asked to run then, as Spark removes the shuffle files and
        broadcasts of finished plans only when their objects are collected, and a driver of a long pipeline collects late."""
        if not self.paths:
            return
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        self.paths = []
        jvm.System.gc()


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links of any orderable ids -> (node, component), component being the smallest id reachable.

    Alternating large-star and small-star steps until the links no longer change: the number of rounds grows with the
    logarithm of the longest chain, every round is joins and partial minima only, and nothing but one checksum per
    round reaches the driver. Loops (a = b) and repeated links are allowed; without links the result is empty."""

    def mins(e: DataFrame, low: Column) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least(low, F.col("m")).alias("m"))

    def checksum(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()

    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    before, now = Tables(edges.sparkSession), Tables(edges.sparkSession)
    e = now.written(e)
    last = checksum(e)
    while last[0]:
        before.drop()
        before, now = now, Tables(edges.sparkSession)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(mins(both, F.col("u")), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        m = mins(large, F.col("u"))
        small = large.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(m.select("u", F.col("m").alias("v")))
        e = now.written(small.where("u > v").distinct())
        sums = checksum(e)
        if sums == last:
            break
        last = sums
    before.drop()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
