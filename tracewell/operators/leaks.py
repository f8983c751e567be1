"""Runs of words that two tables of texts share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def runs(words: str, n: Column) -> Column:
    """All runs of n words of an array, as texts."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))


def word_runs(docs: DataFrame, items: DataFrame, least: int = 8) -> DataFrame:
    """(item_id, doc_id) of which the document holds any `least` words in a row of the item (item_id, text), or all of a shorter
    one. Both sides are joined by the hash of a run, the document's as numbers without their texts; what meets is then held
    against the texts, so a hash that two runs share gives no pair."""
    split = lambda df, key: df.where("text != ''").select(key, F.split("text", " ", -1).alias("ws"))
    wanted = split(items, "item_id").withColumn("n", F.least(F.size("ws"), F.lit(least)))
    lengths = sorted(r["n"] for r in wanted.select("n").distinct().collect())  # `least` of them at most
    wanted = wanted.select("item_id", F.explode(F.array_distinct(runs("ws", F.col("n")))).alias("run")).withColumn("h", F.xxhash64("run"))
    words = split(docs, "doc_id")
    hashed = [F.when(F.size("ws") >= n, F.transform(runs("ws", F.lit(n)), lambda r: F.xxhash64(r))).otherwise(F.array().cast("array<bigint>")) for n in lengths]
    found = words.select("doc_id", F.explode(F.array_distinct(F.concat(F.array().cast("array<bigint>"), *hashed))).alias("h"))
    met = found.join(wanted, "h").select("doc_id", "item_id", "run").distinct()
    texts = docs.select("doc_id", F.concat(F.lit(" "), "text", F.lit(" ")).alias("text"))
    return met.join(texts, "doc_id").where(F.contains("text", F.concat(F.lit(" "), "run", F.lit(" ")))).select("item_id", "doc_id").distinct()
