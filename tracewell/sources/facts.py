"""Reading dynamic facts: coverage, mutation and span documents, and the tables that probes write."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _map(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A document of one object, or, in a folder that ends in .jsonl, an object a line."""
    return spark.read.text(path,
        wholetext=not path.rstrip("/").endswith(".jsonl")).select(F.explode(F.from_json("value", f"map<string,{kind}>",
        {"mode": "FAILFAST"})).alias("method", "x"))


def coverage(spark: SparkSession, path: str) -> DataFrame:
    """(method, test) from {method: [test]}."""
    return _map(spark, path, "array<string>").select("method", F.explode("x").alias("test")).distinct()


def mutation(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(killers, regions) from {method: {killers, regions}}."""
    rows = _map(spark, path, "struct<killers:array<string>,regions:array<struct<label:string,lines:array<int>,killers:int>>>")
    regions = rows.select("method", F.inline("x.regions")).select("method", "label", F.array_min("lines").alias("line_lo"),
        F.array_max("lines").alias("line_hi"), "killers")
    return rows.select("method", F.explode("x.killers").alias("test")).distinct(), regions


def spans(spark: SparkSession, path: str) -> DataFrame:
    """(fqn, file, line_start, line_end) from {method: {file, start, end}}."""
    return _map(spark, path, "struct<file:string,start:int,end:int>").select(F.col("method").alias("fqn"), "x.file",
        F.col("x.start").alias("line_start"), F.col("x.end").alias("line_end"))


def capture_matrix(spark: SparkSession, paths, attribution: str = "outer", executed: DataFrame | None = None) -> DataFrame:
    """(method, test) from rows (method, test, kind): outermost only or all; with `executed` only of tests that ran."""
    rows = spark.read.schema("method string, test string, kind string").option("sep", "\t").option("quote", "").csv(paths).where("test is not null")
    rows = rows.where("kind = 'outer'") if attribution == "outer" else rows
    rows = rows.select("method", "test").distinct()
    return rows if executed is None else rows.join(executed.select("test").distinct(), "test", "left_semi").select("method", "test")


def parse_values(lines: DataFrame) -> DataFrame:
    """(method, test, args, result, throws, ord) from lines (value, ord) with two or three parts before the result."""
    cut = lines.where(F.contains("value", F.lit("\t=> "))).select("ord", F.substring_index("value", "\t=> ", 1).alias("head"),
        F.expr("substring(value, instr(value, '\t=> ') + 4)").alias("result"))
    cut = cut.withColumn("parts", F.split("head", "\t", -1)).where("size(parts) in (2, 3)")
    args = F.element_at("parts", -1)
    test = F.when((F.size("parts") == 3) & (F.col("parts")[1] != "-"), F.col("parts")[1])
    return cut.select(F.col("parts")[0].alias("method"), test.alias("test"),
        F.when(args == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(args, r" \| "),
        lambda a: F.trim(a))).alias("args"), "result", F.col("result").startswith("throws ").alias("throws"), "ord")


def captured_values(spark: SparkSession, paths, limit: int = 5) -> DataFrame:
    """Captured calls, equal ones once, the first `limit` of each method."""
    lines = spark.read.text(paths).withColumn("ord", F.monotonically_increasing_id())
    return first_distinct(parse_values(lines), limit)


def first_distinct(values: DataFrame, limit: int) -> DataFrame:
    """The first `limit` distinct calls of each method."""
    once = values.groupBy("method", "args", "result").agg(F.min_by(F.struct("test", "throws", "ord"),
        "ord").alias("x")).select("method", "x.test", "args", "result", "x.throws", "x.ord")
    return once.withColumn("n", F.row_number().over(Window.partitionBy("method").orderBy("ord"))).where(F.col("n") <= limit).drop("n")


def chain_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """(chain_id, test, steps) from a chains document."""
    doc = spark.read.schema("chains array<struct<test:string,steps:array<struct<caller:string,callee:string,virtual:boolean>>>>").option("multiLine",
        True).json(path)
    return doc.select(F.posexplode("chains").alias("chain_id", "c")).select(F.col("chain_id").cast("long").alias("chain_id"), "c.test", "c.steps")


@dataclass
class Config:
    """Settings of a run, from a document or found by scanning sources."""

    target: str
    package: str
    project: str = "."
    test_globs: list[str] = field(default_factory=list)
    export: str | None = None
    pool: str | None = None
    extra: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> "Config":
        with open(path) as f:
            raw = json.load(f)
        known = {k: raw.pop(k) for k in list(raw) if k in cls.__dataclass_fields__ and k != "extra"}
        return cls(**known, extra=raw)

    @classmethod
    def scan(cls, types: DataFrame, target: str) -> "Config":
        """From a table of types (fqn, file): main before test, shortest path first."""
        name = target.partition("#")[0]
        row = types.where((F.col("fqn") == name) | F.col("fqn").endswith("." + name)).orderBy(F.contains("file", F.lit("/test/")),
            F.length("file"), "file").first()
        if row is None:
            raise ValueError(f"no source for {target}")
        return cls(target=target, package=row["fqn"].rpartition(".")[0], extra={"file": row["file"]})

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(self.__dict__, f, indent=2, sort_keys=True)
