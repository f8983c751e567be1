"""Program-graph analogues over the star-schema tables: parts call parts, orders test suppliers, and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.traverse import checkpoint

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): a part and the next one in an order, loops left out."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    following = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return items.select(F.col("l_partkey").alias("src"), following.alias("dst")).where("dst is not null and src != dst").distinct()


def part_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same edges as calls (caller, callee, virtual, ord)."""
    return part_edges(spark, sf_dir).select(F.col("src").alias("caller"), F.col("dst").alias("callee"),
        F.lit(False).alias("virtual"), F.lit(0).cast("long").alias("ord"))


def part_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node) of small parts, which stand for tests."""
    return table(spark, sf_dir, "part").where("p_size <= 5").select(F.col("p_partkey").alias("node"))


def written_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part_calls(), computed once for all that a traversal asks of them."""
    return checkpoint(part_calls(spark, sf_dir))


def busiest(spark: SparkSession, sf_dir: str, calls: DataFrame | None = None) -> DataFrame:
    """(node): the part that most parts call, no test; the smallest on ties."""
    edges = part_calls(spark, sf_dir) if calls is None else calls
    degree = edges.groupBy(F.col("callee").alias("node")).agg(F.count("*").alias("n"))
    return degree.join(part_tests(spark, sf_dir), "node", "left_anti").orderBy(F.desc("n"), "node").limit(1).select("node")


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(method, test): suppliers run by orders."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("method"),
        F.col("l_orderkey").cast("string").alias("test")).distinct()


def orders_of(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    """(test) of orders of a status."""
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status).select(F.col("o_orderkey").cast("string").alias("test"))


def mutants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(method, line, detected, test): parts' lines, noticed where the item came back."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("method"),
        F.col("l_linenumber").alias("line"), (F.col("l_returnflag") == "R").alias("detected"),
        F.col("l_orderkey").cast("string").alias("test"))


def event_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of each user's events of a day, as steps between event types."""
    events = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", "event_type")
    chains = events.groupBy("user_id",
        "day").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))),
        lambda x: x["event_type"]).alias("types"), F.min("event_id").alias("chain_id"))
    steps = F.transform("types", lambda t: F.struct(t.alias("caller"), t.alias("callee"), F.lit(False).alias("virtual")))
    return chains.select("chain_id", F.col("user_id").cast("string").alias("test"), F.size("types").alias("depth"),
        F.lit(0).alias("virtual_steps"), steps.alias("steps"))
