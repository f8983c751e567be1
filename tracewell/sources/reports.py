"""Reading XML reports with the built-in reader: executed lines, mutants, test results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import basename, from_slashes
from ..operators import dyadic
from ..operators.traverse import checkpoint

EXECUTION = "_name string, sourcefile array<struct<_name:string,line:array<struct<_nr:int,_mi:int,_ci:int,_mb:int,_cb:int>>>>"
MUTANT = "_detected string, _status string, mutatedClass string, mutatedMethod string, lineNumber int, killingTest string"
CASE = "_classname string, _name string, failure array<struct<_VALUE:string,_type:string,_message:string>>, error array<struct<_VALUE:string,_type:string,_message:string>>, skipped string"


def execution(spark: SparkSession, path) -> DataFrame:
    """(package, file, line, mi, ci, mb, cb, report) of every line of a coverage report."""
    rows = spark.read.schema(EXECUTION).option("rowTag", "package").xml(path).select(F.translate("_name", "/",
        ".").alias("package"), F.explode("sourcefile").alias("s"), F.input_file_name().alias("report"))
    rows = rows.select("package", F.col("s._name").alias("name"), F.explode("s.line").alias("l"), "report")
    return rows.select("package", F.concat(F.translate("package", ".", "/"), F.lit("/"), F.col("name")).alias("file"),
        F.col("l._nr").alias("line"), *[F.coalesce(F.col(f"l._{c}"), F.lit(0)).alias(c) for c in ("mi", "ci", "mb", "cb")],
        "report")


def executed(lines: DataFrame) -> DataFrame:
    """(file, line) of executed lines."""
    return lines.where("ci > 0").select("file", "line").distinct()


def corridor_counters(lines: DataFrame, low: int, high: int, around: int = 40) -> DataFrame:
    """Lines of a region and `around` either side, with their counters."""
    return lines.where(F.col("line").between(low - around, high + around)).select("file", "line", "mi", "ci", "mb", "cb")


def coverage_from_execution(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """(method, test): methods with an executed line in their span, by full path, or by file name if no path fits. The
    report's file name is its test. Files look their paths up among the ends of each path, so only lines and spans of one file
    meet, and those by dyadic intervals."""
    test = F.regexp_replace(basename("report"), r"\.xml$", "")
    ran = checkpoint(lines.where("ci > 0").select("file", "line", test.alias("test"), basename("file").alias("name")).distinct())
    known = spans.select("fqn", F.col("file").alias("path"), "line_start", "line_end", basename("file").alias("name"))
    ends = F.transform(F.sequence(F.length("name"), F.length("path")), lambda n: F.right("path", n))
    fitting = known.select("path", F.explode(ends.alias("x")).alias("file")).distinct().join(ran.select("file").distinct(), "file")
    exact = dyadic.in_spans(ran.drop("name"), known.drop("name").join(fitting, "path"), "line", "line_start", "line_end", ["file"])
    exact = checkpoint(exact.select("file", "fqn", "test").distinct())
    rest = ran.join(exact.select("file").distinct(), "file", "left_anti").select("name", "line", "test").distinct()
    named = dyadic.in_spans(rest, known, "line", "line_start", "line_end", ["name"])
    return exact.select("fqn", "test").union(named.select("fqn", "test")).select(F.col("fqn").alias("method"), "test").distinct()


def mutants(spark: SparkSession, path) -> DataFrame:
    """(method, line, detected, test) of every mutant."""
    rows = spark.read.schema(MUTANT).option("rowTag", "mutation").xml(path)
    return rows.select(F.concat_ws(".", "mutatedClass", "mutatedMethod").alias("method"), F.col("lineNumber").alias("line"),
        (F.lower("_detected") == "true").alias("detected"), F.regexp_replace(F.coalesce("killingTest", F.lit("")), r"\(.*\)$|\[.*$",
        "").alias("test"))


def test_cases(spark: SparkSession, path) -> DataFrame:
    """(test, ok, exc_type, message, trace) of every case that ran; of several failures the first text counts."""
    rows = spark.read.schema(CASE).option("rowTag", "testcase").xml(path).where("skipped is null")
    bad = F.coalesce(F.col("failure")[0], F.col("error")[0])
    return rows.select(F.concat_ws(".", "_classname", "_name").alias("test"), bad.isNull().alias("ok"),
        bad["_type"].alias("exc_type"), bad["_message"].alias("message"), bad["_VALUE"].alias("trace"))


def failures(cases: DataFrame, width: int = 300) -> DataFrame:
    """(test, type, message) of failed cases, messages cut, in order."""
    return cases.where("not ok").select("test", F.col("exc_type").alias("type"),
        F.substring(F.coalesce("message", F.lit("")), 1, width).alias("message")).orderBy("test")


def slashed_class(column: str):
    """A tool's class name, dotted."""
    return from_slashes(column)
