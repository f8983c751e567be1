"""Change impact: methods that a diff touches, tests that verify or merely run them, and where nothing verifies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEAK_MOST = 3


def strength(killers: Column) -> Column:
    """UNVERIFIED, weak or strong, by how many tests notice a mutant."""
    return F.when(killers == 0, "UNVERIFIED").when(killers <= WEAK_MOST, "weak").otherwise("strong")


def changed_methods(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """(method) whose span holds a touched line (file, line)."""
    return lines.join(spans, "file").where(F.col("line").between(F.col("line_start"), F.col("line_end"))).select(F.col("fqn").alias("method")).distinct()


def invert(pairs: DataFrame) -> DataFrame:
    """(method, tests) from (method, test)."""
    return pairs.groupBy("method").agg(F.array_sort(F.collect_set("test")).alias("tests"))


def covering(coverage: DataFrame, method: str) -> DataFrame:
    """(test) that cover a method, in order."""
    return coverage.where(F.col("method") == method).select("test").distinct().orderBy("test")


def killers(mutants: DataFrame) -> DataFrame:
    """(method, test) that notice a mutant."""
    return mutants.where("detected and test != ''").select("method", "test").distinct()


def regions(mutants: DataFrame) -> DataFrame:
    """(method, line, killers) with zeros where mutants survive."""
    return mutants.groupBy("method", "line").agg(F.sum(F.when(F.col("detected") & (F.col("test") != ""), 1).otherwise(0)).alias("killers"))


def tiers(changed: DataFrame, coverage: DataFrame, kills: DataFrame) -> DataFrame:
    """(test, tier): 1 runs a changed method and notices mutants of one, 2 only runs one, 0 notices without running."""
    ran = coverage.join(changed.select("method").distinct(), "method", "left_semi").select("test").distinct().withColumn("ran", F.lit(True))
    noticed = kills.join(changed.select("method").distinct(), "method", "left_semi").select("test").distinct().withColumn("noticed", F.lit(True))
    return ran.join(noticed, "test", "full").select("test", F.when(F.col("ran") & F.col("noticed"), 1).when(F.col("ran"), 2).otherwise(0).alias("tier"))


def rated_regions(changed: DataFrame, regions_: DataFrame) -> DataFrame:
    """Regions of changed methods with their strength."""
    return regions_.join(changed.select("method").distinct(), "method", "left_semi").withColumn("strength", strength(F.col("killers")))


def blind_spots(changed: DataFrame, coverage: DataFrame, regions_: DataFrame, tiers_: DataFrame) -> DataFrame:
    """(kind, subject): changed methods that no test runs, regions that no test notices, tests that notice but don't run."""
    methods = changed.select("method").distinct()
    bare = methods.join(coverage.select("method").distinct(), "method", "left_anti").select(F.lit("uncovered").alias("kind"), F.col("method").alias("subject"))
    weak = regions_.join(methods, "method", "left_semi").where("killers = 0").select(F.lit("unverified").alias("kind"),
        F.concat_ws(": ", "method", "label").alias("subject"))
    odd = tiers_.where("tier = 0").select(F.lit("mismatch").alias("kind"), F.col("test").alias("subject"))
    return bare.union(weak).union(odd)


def iteration_diff(before: DataFrame, after: DataFrame, key: str = "test") -> DataFrame:
    """(key, change): failing keys that were fixed, broke, or still fail between two runs."""
    a, b = before.select(key).distinct().withColumn("_a", F.lit(True)), after.select(key).distinct().withColumn("_b", F.lit(True))
    return a.join(b, key, "full").select(key, F.when(F.col("_a") & F.col("_b"), "still").when(F.col("_a"), "fixed").otherwise("broke").alias("change"))


def iteration_changes(before: DataFrame, after: DataFrame, behaviours_before: DataFrame, behaviours_after: DataFrame) -> DataFrame:
    """(subject, change): failing tests (test) that were fixed, broke or still fail between two runs, and behaviour classes
    (class) that are new or gone."""
    tests = iteration_diff(before, after).select(F.col("test").alias("subject"), "change")
    classes = iteration_diff(behaviours_before, behaviours_after, "class").where("change != 'still'")
    named = F.when(F.col("change") == "fixed", "behaviour gone").otherwise("behaviour new")
    return tests.union(classes.select(F.col("class").alias("subject"), named.alias("change")))


def ran_only(rows: DataFrame, executed: DataFrame, key: str = "test") -> DataFrame:
    """Rows of tests that ran."""
    return rows.join(executed.select(key).distinct(), key, "left_semi")
