"""Profile rules over module metadata and tree layouts.

Every rule returns (repo_id, tier, rule, applicable, compliant, evidence): evidence is a sorted array of strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covary.functions.scalars import GITLINK, basename, component_of, is_vendor_path, profile_candidate_id

# Fixed values of profiles/v1.
CORE, IDIOMATIC = "go-core", "spf13-idiomatic"
LAYERS = ("service", "repository", "controller", "domain")
GENERIC = ("utils", "helpers", "common")
FRAMEWORKS = ("github.com/onsi/ginkgo", "github.com/golang/mock", "go.uber.org/mock")
RULES = {
    CORE: ("go-version-floor", "module-topology", "no-local-replace", "semantic-import-version"),
    IDIOMATIC: ("domain-over-layers", "max-package-depth", "no-generic-packages", "no-heavy-test-frameworks"),
}
FLOOR = (1, 25)


def package_dirs(tree: DataFrame) -> DataFrame:
    """(repo_id, dir): directories with a non-test source file, outside vendor and gitlinks."""
    own = ~is_vendor_path(F.col("path")) & (F.col("mode") != GITLINK)
    source = F.col("path").endswith(".go") & ~F.col("path").endswith("_test.go")
    return tree.where(own & source).select("repo_id", component_of(F.col("path")).alias("dir")).distinct()


def prefixes(path: Column) -> Column:
    """A directory and its ancestors, `.` included."""
    parts = F.split(path, "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.array_union(F.array(F.lit(".")), up)


def nearest_module_root(dirs: DataFrame, modules: DataFrame) -> DataFrame:
    """(repo_id, dir, root, depth): the longest module root above each directory, by an equi-join on its ancestors;
    depth counts the segments below it. Directories outside any module have a null root."""
    up = dirs.select("repo_id", "dir", F.explode(prefixes(F.col("dir"))).alias("root"))
    hit = up.join(modules.select("repo_id", "root").distinct(), ["repo_id", "root"])
    size = F.when(F.col("root") == ".", 0).otherwise(F.size(F.split("root", "/")))
    best = hit.withColumn("size", size).groupBy("repo_id", "dir").agg(F.max(F.struct("size", "root")).alias("m"))
    below = F.when(F.col("dir") == ".", 0).otherwise(F.size(F.split("dir", "/"))) - F.col("m.size")
    return dirs.join(best, ["repo_id", "dir"], "left").select("repo_id", "dir", F.col("m.root").alias("root"), below.alias("depth"))


def _said(rows: DataFrame, tier: str, rule: str, good: Column | None, evidence: Column, when: Column | None = None) -> DataFrame:
    """One row per repository that has any of rows; evidence is that of the rows that break the rule (of all if good
    is None: topology is kept, not judged)."""
    bad = F.lit(True) if good is None else ~F.coalesce(good, F.lit(False))
    shown = F.array_sort(F.collect_list(F.when(bad, evidence)))
    ok = F.lit(True) if good is None else F.bool_and(~bad)
    return rows.groupBy("repo_id").agg(ok.alias("compliant"), shown.alias("evidence")).select("repo_id", F.lit(tier).alias("tier"), F.lit(rule).alias("rule"), "compliant", F.array_join("evidence", ",").alias("evidence"))


def _pair(a: str, b: str) -> Column:
    return F.concat_ws("=", a, b)


def rule_module_topology(modules: DataFrame) -> DataFrame:
    return _said(modules, CORE, "module-topology", None, _pair("root", "module_path"))


def rule_go_version_floor(modules: DataFrame) -> DataFrame:
    v = F.split("go_version", "\\.")
    major, minor = F.get(v, F.lit(0)).try_cast("int"), F.coalesce(F.get(v, F.lit(1)).try_cast("int"), F.lit(0))
    return _said(modules, CORE, "go-version-floor", (major > FLOOR[0]) | ((major == FLOOR[0]) & (minor >= FLOOR[1])), _pair("root", "go_version"))


def rule_no_local_replace(modules: DataFrame) -> DataFrame:
    local = F.exists(F.coalesce("replaces", F.array().cast("array<struct<old_path:string,new_path:string,new_version:string>>")), lambda r: F.coalesce(r["new_version"], F.lit("")) == "")
    return _said(modules, CORE, "no-local-replace", ~local, F.col("root"))


def rule_semantic_import_version(modules: DataFrame) -> DataFrame:
    path = F.col("module_path")
    gopkg = path.rlike(r"^gopkg\.in/")
    major = F.regexp_extract(path, r"/v([0-9]+)$", 1)
    good = gopkg & path.rlike(r"\.v[0-9]+$") | ~gopkg & ((major == "") | (major.try_cast("bigint") >= 2) & ~major.startswith("0"))
    return _said(modules, CORE, "semantic-import-version", good, _pair("root", "module_path"))


def rule_max_package_depth(dirs: DataFrame, modules: DataFrame, most: int = 1) -> DataFrame:
    return _said(nearest_module_root(dirs, modules), IDIOMATIC, "max-package-depth", F.coalesce(F.col("depth") <= most, F.lit(True)), F.col("dir"))


def rule_domain_over_layers(dirs: DataFrame) -> DataFrame:
    return _said(dirs, IDIOMATIC, "domain-over-layers", ~basename(F.col("dir")).isin(*LAYERS), F.col("dir"))


def rule_no_generic_packages(dirs: DataFrame) -> DataFrame:
    return _said(dirs, IDIOMATIC, "no-generic-packages", ~basename(F.col("dir")).isin(*GENERIC), F.col("dir"))


def rule_no_heavy_test_frameworks(modules: DataFrame) -> DataFrame:
    heavy = lambda r: F.array(*[(r["path"] == f) | r["path"].startswith(f + "/") for f in FRAMEWORKS])
    used = F.exists(F.coalesce("requires", F.array().cast("array<struct<path:string,version:string>>")), lambda r: F.array_contains(heavy(r), True))
    return _said(modules, IDIOMATIC, "no-heavy-test-frameworks", ~used, F.col("root"))


def profile_candidates(tree: DataFrame, modules: DataFrame, repos: DataFrame, tiers=(CORE, IDIOMATIC)) -> DataFrame:
    """One row per enabled rule and repository; a rule without input is not applicable and says so."""
    if unknown := set(tiers) - set(RULES):
        raise ValueError(f"unknown tiers: {sorted(unknown)}")
    dirs = package_dirs(tree)
    found = [
        rule_module_topology(modules), rule_go_version_floor(modules), rule_no_local_replace(modules), rule_semantic_import_version(modules),
        rule_max_package_depth(dirs, modules), rule_domain_over_layers(dirs), rule_no_generic_packages(dirs), rule_no_heavy_test_frameworks(modules),
    ]
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    rules = F.explode(F.array(*[F.struct(F.lit(i).alias("tier_order"), F.lit(t).alias("tier"), F.lit(r).alias("rule")) for i, t in enumerate(tiers) for r in RULES[t]])).alias("x")
    every = repos.select("repo_id").distinct().select("repo_id", rules).select("repo_id", "x.*")
    out = every.join(rows, ["repo_id", "tier", "rule"], "left")
    applicable = F.col("compliant").isNotNull()
    return out.select(
        "repo_id", "tier_order", "tier", "rule", profile_candidate_id(F.col("tier"), F.col("rule")).alias("candidate_id"), F.lit("profile").alias("origin"), F.concat("tier", F.lit("/v1")).alias("profile_version"),
        applicable.alias("applicable"), "compliant", "evidence", F.when(~applicable, "profile_not_applicable").alias("reason"),
    )


def profile_input_checks(modules: DataFrame, tree: DataFrame, enabled: DataFrame | None = None, files: int = 32, size: int = 1 << 20, sources: int = 100_000) -> DataFrame:
    """(repo_id, failure): duplicate module paths, too many or too large module files (modules has their `size`), too many
    source paths, and enabled(repo_id, tier, rule) that aren't known."""
    said = lambda df, why: df.select("repo_id", (F.lit(why) if isinstance(why, str) else why).alias("failure")).distinct()
    twice = modules.groupBy("repo_id", "module_path").count().where("count > 1")
    many = modules.groupBy("repo_id").count().where(F.col("count") > files)
    wide = tree.where(F.col("path").endswith(".go")).groupBy("repo_id").count().where(F.col("count") > sources)
    out = said(twice, "duplicate_module_path").union(said(many, "module_files")).union(said(wide, "source_paths"))
    if "size" in modules.columns:
        out = out.union(said(modules.where(F.col("size") > size), "module_file_size"))
    if enabled is not None:
        tier = F.coalesce(F.col("tier").isin(*RULES), F.lit(False))
        rule = F.coalesce(F.concat_ws("/", "tier", "rule").isin(*[f"{t}/{r}" for t, rs in RULES.items() for r in rs]), F.lit(False))
        out = out.union(said(enabled.where(~rule), F.when(tier, "unknown_rule").otherwise("unknown_tier")))
    return out
