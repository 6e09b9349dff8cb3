"""A version-control history, tree and review records derived from the driver's tables (see FIXTURES.md), for the
registered queries. All arithmetic is on integers, so any engine derives the same history."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from covary.operators import calibrate, mining, normalize, partitions
from covary.operators.ranking import ranked
from covary.sources.store import stored

#: Parts and suppliers of a repository's tree and modules: the repositories grow with the tables.
PARTS, MODULES = 140, 7
#: Where a history with drift changes, in hundredths of its events, and by how many eightieths exceptions are more
#: frequent before.
DRIFT, LOOSER = 55, 6


class History:
    """The derived frames; each is built once per object and shared by the plans that use it."""

    def __init__(self, spark: SparkSession, sf_dir: str, path_limit: int = normalize.PATH_LIMIT, component_limit: int = normalize.COMPONENT_LIMIT, repo: str = "n_regionkey", drift: bool = False):
        """drift: behind DRIFT hundredths of its events a repository has no exceptions from the planted rule any more, and
        before it has more of them."""
        self.spark, self.dir, self.limits, self.repo, self.drift = spark, sf_dir, (path_limit, component_limit), repo, drift
        self.kept: set[str] = set()

    def still_there(self) -> bool:
        """Whether what was stored hasn't been removed from the shared folder."""
        files = self.events.inputFiles() if "events" in self.__dict__ else []
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        paths = [jvm.org.apache.hadoop.fs.Path(f) for f in files[:1]]
        return all(p.getFileSystem(conf).exists(p) for p in paths)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        o, c, n = self.table("orders"), self.table("customer"), self.table("nation")
        rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
        rows = rows.select(F.expr(self.repo).cast("string").alias("repo_id"), "o_orderdate", "o_orderkey", "o_orderstatus", "o_orderpriority")
        rows = ranked(rows, ["repo_id"], ["o_orderdate", "o_orderkey"], "seq").withColumn("event_id", F.col("o_orderkey").cast("string"))
        kind = F.when(F.col("seq") == 1, "root").when(F.col("o_orderstatus") == "P", "merge-result").otherwise("single-parent")
        n_parents = F.when(F.col("seq") == 1, 0).when(F.col("o_orderstatus") == "P", 2).otherwise(1)
        parents = rows.select("repo_id", (F.col("seq") + 1).alias("seq"), F.col("event_id").alias("first_parent"))
        return stored(rows.join(parents, ["repo_id", "seq"], "left").select("repo_id", "event_id", "o_orderkey", "o_orderpriority", "seq", kind.alias("kind"), "first_parent", n_parents.alias("n_parents")))

    @cached_property
    def numbered(self) -> DataFrame:
        """Change records by order, those of root events included, without what follows from their other columns."""
        li, p = self.table("lineitem"), self.table("part")
        n = self.events.groupBy("repo_id").agg(F.count("*").alias("n_events"))
        late = self.events.join(n, "repo_id").where(F.lit(self.drift) & (F.col("seq") * 100 > F.col("n_events") * DRIFT)).select(F.col("o_orderkey").alias("l_orderkey"), F.lit(True).alias("late"))
        j = li.join(p, li.l_partkey == p.p_partkey).join(late, "l_orderkey", "left").withColumn("N", F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int"))
        status = F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "N", "M").otherwise("D")
        brand = F.concat(F.lit("b"), F.col("N"))

        def branch(where, path, mode="100644", status=status):
            return F.when(where, F.struct(path.alias("path"), status.alias("status"), F.lit(mode).alias("dst_mode")))

        branches = F.array(
            branch(((F.col("l_orderkey") * 7 + F.col("l_partkey") * 13) % 80 >= F.col("N") + (LOOSER if self.drift else 0)) | F.col("late"), F.concat(F.lit("svc/"), brand, F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".go"))),
            branch((F.col("p_size") <= 25) & (F.col("l_orderkey") % 10 != 0), F.concat(F.lit("charts/"), brand, F.lit("/values.yaml"))),
            branch(F.col("p_type") == "PROMO", F.concat(F.lit("vendor/"), F.col("p_type"), F.lit("/lib.go"))),
            branch(F.col("l_quantity") >= 50, F.concat(F.lit("modules/s"), F.col("l_suppkey")), mode="160000"),
        )
        rows = j.select(F.col("l_orderkey").alias("o_orderkey"), F.explode(F.filter(branches, lambda x: x.isNotNull())).alias("x")).select("o_orderkey", "x.*")
        readme = self.events.where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.lit("README.md").alias("path"), F.lit("M").alias("status"), F.lit("100644").alias("dst_mode"))
        rows = rows.unionByName(readme).join(self.events.select("o_orderkey", "repo_id", "event_id", "kind"), "o_orderkey")
        w = Window.partitionBy("o_orderkey").orderBy("path", "status", "dst_mode")
        return rows.select("repo_id", "event_id", "kind", F.row_number().over(w).alias("pos"), "dst_mode", "status", "path")

    @staticmethod
    def records(numbered: DataFrame) -> DataFrame:
        """Change records with the columns that follow from the others: object ids are as long as all else."""
        oid = lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 40)
        ids = oid(F.col("path")).alias("src_oid"), oid(F.concat("path", "status")).alias("dst_oid")
        return numbered.select("repo_id", "event_id", "pos", F.lit("100644").alias("src_mode"), "dst_mode", *ids, "status", "path")

    @cached_property
    def all_changes(self) -> DataFrame:
        """Change records, those of root events included."""
        return self.records(self.numbered)

    @cached_property
    def changes(self) -> DataFrame:
        return self.records(self.numbered.where("kind != 'root'"))

    @cached_property
    def kinds(self) -> DataFrame:
        """A row per (event, path), told apart."""
        return normalize.path_kinds(normalize.dedup_paths(self.changes)).select("repo_id", "event_id", "path", "status", "path_kind")

    def keep(self, *names: str) -> None:
        """Stores the named frames, each of which a plan is about to use many times; a query that uses one once, or is cut
        short by what it asks of it, is better off without."""
        for name in (n for n in names if n not in self.kept):
            self.__dict__[name] = stored(getattr(self, name))
            self.kept.add(name)
            for derived in {"classified", "evidence", "tx", "shuffled_tx", "components", "pairs", "metrics"} - self.kept:
                self.__dict__.pop(derived, None)

    def within(self, checked: DataFrame, pairs: DataFrame) -> History:
        """The history without the repositories that exceed a limit, with what guarded_pairs() stored and checked of it;
        this one where none does."""
        over = checked.where("outcome = 'fail'").select("repo_id").distinct()
        out = self
        if not over.isEmpty():
            out = History(self.spark, self.dir, *self.limits, self.repo, self.drift)
            for name in ("events", "changes", "kinds", "tx", "transactions"):
                out.__dict__[name] = getattr(self, name).join(over, "repo_id", "left_anti")
        out.__dict__["pairs"] = pairs
        out.kept.add("pairs")
        return out

    @cached_property
    def classified(self) -> DataFrame:
        return normalize.classified(self.events, self.kinds, *self.limits)

    @cached_property
    def evidence(self) -> DataFrame:
        return normalize.evidence_paths(self.events, self.kinds, self.limits[0])

    @cached_property
    def boundaries(self) -> DataFrame:
        """The boundaries of a change stream that has lost, moved and repeated some, and holds some of no event."""
        e, seq = self.events.where("seq % 400 != 3").select("repo_id", "event_id", "seq"), F.col("seq") * 10
        own = e.select("repo_id", "event_id", (seq + F.when(F.col("seq") % 350 == 11, 25).otherwise(0)).alias("place"))
        again = e.where("seq % 700 = 9").select("repo_id", "event_id", (seq + 5005).alias("place"))
        none = e.where("seq % 90 = 5").select("repo_id", F.concat(F.lit("x"), "event_id"), (seq + 3).alias("place"))
        return ranked(own.union(again).union(none), ["repo_id"], ["place"], "ordinal").select("repo_id", "ordinal", "event_id")

    @cached_property
    def transactions(self) -> DataFrame:
        return stored(normalize.transactions(self.events, self.kinds, *self.limits))

    @cached_property
    def tx(self) -> DataFrame:
        """Transactions with their slice, as their own number tells it."""
        return partitions.sliced(self.transactions, self.events)

    @cached_property
    def shuffled_tx(self) -> DataFrame:
        return partitions.with_slices(self.transactions, partitions.shuffled_order(self.events))

    @cached_property
    def components(self) -> DataFrame:
        return mining.component_stats(self.tx)

    @cached_property
    def pairs(self) -> DataFrame:
        return mining.pair_stats(self.tx)

    @cached_property
    def metrics(self) -> DataFrame:
        return mining.pair_metrics(self.pairs, self.components, mining.totals(self.tx))

    @cached_property
    def grid(self) -> DataFrame:
        return mining.config_grid(self.spark, mining.DEFAULT)

    @cached_property
    def full_grid(self) -> DataFrame:
        return mining.config_grid(self.spark)

    @cached_property
    def displayed(self) -> DataFrame:
        return stored(mining.displayed(self.metrics, self.grid))

    @cached_property
    def displayed_all(self) -> DataFrame:
        """What every configuration of the grid displays."""
        return stored(mining.displayed(self.metrics, self.full_grid))

    @cached_property
    def roles(self) -> DataFrame:
        """Every third repository is a template's offspring, the others are young ones."""
        role = F.when(F.col("repo_id").cast("int") % 3 == 0, "template_origin").otherwise("young")
        return self.events.select("repo_id", role.alias("role")).distinct()

    @cached_property
    def calibrated(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Metrics, gains and displayed candidates of the whole grid."""
        return calibrate.calibrate(self.events, self.transactions, self.full_grid)

    @cached_property
    def tips(self) -> DataFrame:
        return self.events.groupBy("repo_id").agg(F.max_by("event_id", "seq").alias("repository"))

    # tree, modules and review records

    @cached_property
    def tree(self) -> DataFrame:
        p = self.table("part")
        word = F.split("p_name", " ")
        middle = F.when(F.col("p_size") % 10 == 0, "service").when(F.col("p_size") % 10 == 1, "utils").when(F.col("p_size") % 10 == 2, "vendor").otherwise(F.get(word, F.lit(0)))
        tail = F.when(F.col("p_size") % 3 == 0, "_test.go").when(F.col("p_size") % 3 == 1, ".go").otherwise(".md")
        deep = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("/"), F.get(word, F.lit(1)))).otherwise("")
        path = F.concat(F.lit("mod"), F.col("p_partkey") % 7, F.lit("/"), middle, deep, F.lit("/p"), F.col("p_partkey"), tail)
        mode = F.when(F.col("p_partkey") % 50 == 7, "160000").otherwise("100644")
        return p.select(F.expr(f"CAST(p_partkey DIV {PARTS} AS STRING)").alias("repo_id"), path.alias("path"), mode.alias("mode"))

    @cached_property
    def modules(self) -> DataFrame:
        s = self.table("supplier")
        repo, i = F.expr(f"CAST(s_suppkey DIV {MODULES} AS INT)"), F.col("s_suppkey") % MODULES
        suffix = F.when(i % 3 == 1, "/v2").when(i % 3 == 2, "/v1").otherwise("")
        req = F.when(F.col("s_acctbal") > 5000, "github.com/onsi/ginkgo/v2").otherwise("github.com/onsi/ginkgox")
        rep = F.when(F.col("s_nationkey") % 4 == 0, "").otherwise("v1.0.0")
        return s.select(
            repo.cast("string").alias("repo_id"), F.when(i == 0, ".").otherwise(F.concat(F.lit("mod"), i)).alias("root"),
            F.concat(F.lit("example.com/r"), repo, F.lit("/m"), i, suffix).alias("module_path"), F.concat(F.lit("1."), 22 + F.col("s_nationkey") % 8).alias("go_version"),
            F.array(F.struct(req.alias("path"), F.lit("v1.0.0").alias("version"))).alias("requires"),
            F.array(F.struct(F.lit("example.com/a").alias("old_path"), F.lit("example.com/b").alias("new_path"), rep.alias("new_version"))).alias("replaces"),
        )

    @cached_property
    def review_labels(self) -> DataFrame:
        """All labels, in order: eight candidates or ten deviations to a repository."""
        unit = F.when(F.col("doc_id") % 2 == 0, "candidate").otherwise("deviation")
        rows = self.table("labels").select(F.expr("doc_id DIV 1000").alias("part"), unit.alias("unit_kind"), F.col("doc_id").alias("unit_id"), "quality", "toxic")
        good = F.when(F.col("unit_kind") == "candidate", "decision").otherwise("review-worthy")
        label = F.when(F.col("toxic") == 1, "accident").when(F.col("quality") == 1, good).otherwise("unclear")
        nth = F.row_number().over(Window.partitionBy("part", "unit_kind").orderBy("unit_id"))
        of = F.floor((nth - 1) / F.when(F.col("unit_kind") == "candidate", 8).otherwise(10))
        return rows.select((F.col("part") * 100 + of).cast("string").alias("repo_id"), "unit_kind", "unit_id", label.alias("label"))

    @cached_property
    def acceptances(self) -> DataFrame:
        """Per user, as a repository: what happened how many seconds after their first event."""
        e = self.table("events")
        at = F.unix_micros(F.col("ts").cast("timestamp"))
        elapsed = at - F.min(at).over(Window.partitionBy("user_id"))
        lane = F.when(F.col("event_id") % 2 == 0, "inferred").otherwise("profile")
        return e.select(F.col("user_id").cast("string").alias("repo_id"), lane.alias("lane"), (elapsed / 1e6 / 3600).alias("elapsed"), (F.col("event_type") == "purchase").alias("useful"), ((F.col("event_type") == "error") & (F.col("value") > 99)).alias("interrupted"), "event_id")
