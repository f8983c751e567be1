"""Windows: caps, first distinct, exemplars, islands, numbering, nearest, as-of, cumulative cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .prefix import numbered, running
from .traverse import checkpoint


def first_per_key(df: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows of each key in a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def distinct_first(df: DataFrame, keys: list[str], value: str, order: list, n: int) -> DataFrame:
    """The first n distinct values of each key, by where each stands first."""
    once = first_per_key(df, [*keys, value], order)
    return first_per_key(once, keys, order, n)


def quotas(df: DataFrame, keys: list[str], is_other: Column, order: list, most: int, most_other: int) -> DataFrame:
    """Separate caps for two sorts of rows of a key."""
    return df.withColumns({"_o": is_other}).withColumn("_n",
        F.row_number().over(Window.partitionBy(*keys, "_o").orderBy(*order))).where(F.col("_n") <= F.when(F.col("_o"),
        most_other).otherwise(most)).drop("_o", "_n")


def islands(df: DataFrame, keys: list[str], value: str, order: list) -> DataFrame:
    """Adds `island`, which counts up where the value differs from the row before."""
    by = Window.partitionBy(*keys).orderBy(*order)
    changed = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(by))).cast("int"), F.lit(1))
    first = F.row_number().over(by) == 1
    return df.withColumn("_c", F.when(first, 1).otherwise(changed)).withColumn("island",
        F.sum("_c").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_c")


def sites_of_steps(steps: DataFrame, sites: DataFrame, order: list) -> DataFrame:
    """Steps (caller, callee, ...) with the first call site of the caller that calls the callee, sites being (caller, callee,
    ...); the pick is made once for each pair, before it meets the steps. Steps without a site keep nulls."""
    rest = [c for c in sites.columns if c not in ("caller", "callee")]
    first = sites.groupBy("caller", "callee").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_site"))
    return steps.join(first, ["caller", "callee"], "left").select(*steps.columns, "_site.*")


def collapse(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """One row for each run of equal values: (keys, island, value, first, last, n)."""
    return islands(df, keys, value, [order]).groupBy(*keys, "island").agg(F.first(value).alias(value), F.min(order).alias("first"),
        F.max(order).alias("last"), F.count("*").alias("n"))


def runs_of(df: DataFrame, keys: list[str], hit: str, order: str, least: int = 5) -> DataFrame:
    """Runs of at least so many rows that hit: (keys, first, last, n)."""
    return collapse(df, keys, hit, order).where(F.col(hit) & (F.col("n") >= least)).select(*keys, "first", "last", "n")


def numbered_references(df: DataFrame, prefix: Column, order: list) -> DataFrame:
    """Adds `ref`: T1, T2, M1 ... by kind of prefix; a kind of any size spreads over tasks."""
    rows = numbered(df.withColumn("_p", prefix), order, "_number", ["_p"])
    return rows.withColumn("ref", F.concat("_p", F.col("_number").cast("string"))).drop("_p", "_number")


def nearest_by(df: DataFrame, keys: list[str], distance: Column, tie: list[str]) -> DataFrame:
    """The row of each key at the least distance."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(distance, *tie)).alias("x")).select(*keys, "x.*")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, name: str, tie: list[str] | None = None) -> DataFrame:
    """Adds the right side's last value at or before each left row, by key: both sides in one window, no join of pairs."""
    extra = [c for c in left.columns if c not in (*keys, at)]
    a = left.select(*keys, at, F.lit(1).alias("_side"), F.struct(*extra).alias("_l"),
        F.lit(None).cast(right.schema[value].dataType).alias("_v"),
        *[F.lit(None).cast(right.schema[t].dataType).alias(f"_t_{t}") for t in tie or []])
    b = right.select(*keys, at, F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"),
        F.col(value).alias("_v"), *[F.col(t).alias(f"_t_{t}") for t in tie or []])
    by = Window.partitionBy(*keys).orderBy(at, "_side", *[f"_t_{t}" for t in tie or []]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return a.unionByName(b).withColumn(name, F.last("_v", ignorenulls=True).over(by)).where("_side = 1").select(*keys, at, "_l.*", name)


def until(df: DataFrame, keys: list[str], order: list, size: Column, budget: int) -> DataFrame:
    """Rows in order while their sizes add up to no more than a budget."""
    return running(df, keys, order, {"running": size}).where(F.col("running") <= budget)


def flat_top(df: DataFrame, keys: list[str], score: str, order: list, gap: float = 0.05) -> DataFrame:
    """Adds `flat`: whether the first row's score is less than `gap` from the second's."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({"rank": F.row_number().over(by), "flat": F.coalesce(F.abs(F.col(score) - F.lead(score).over(by)) < gap, F.lit(False))})


def cut_with_marker(df: DataFrame, most: int, text: str = "text", order: str = "n", marker: str = "…") -> DataFrame:
    """The first most - 1 lines and a marker where there are more than most."""
    total = df.count()
    if total <= most:
        return df
    kept = df.orderBy(order).limit(most - 1)
    last = kept.agg((F.max(order) + 1).alias(order)).select(F.col(order), F.lit(marker).alias(text))
    return kept.select(order, text).union(last)


def previous_of(df: DataFrame, keys: list[str], order: list, columns: list[str]) -> DataFrame:
    """Adds previous_<column> of the row before."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({f"previous_{c}": F.lag(c).over(by) for c in columns})


def by_priority(df: DataFrame, keys: list[str], priority: Column, order: list, n: int) -> DataFrame:
    """The first n rows of each key among those of its best priority; rows without one are left out."""
    by = Window.partitionBy(*keys)
    ranked = df.withColumn("_p", priority).where("_p is not null").withColumn("_best", F.min("_p").over(by)).where("_p = _best").drop("_best")
    return first_per_key(ranked, keys, order, n).drop("_p")


def range_join(points: DataFrame, spans: DataFrame, on: str, at: str, low: str, high: str) -> DataFrame:
    """Points inside spans of one key: a hash join on the key with the range as its condition."""
    return points.join(spans, on).where(F.col(at).between(F.col(low), F.col(high)))


def bucketed_range_join(points: DataFrame, spans: DataFrame, at: str, low: str, high: str, width: int) -> DataFrame:
    """Points inside spans without another key: spans go to each bucket that they touch, points to theirs."""
    a = points.withColumn("_b", F.floor(F.col(at) / width))
    b = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return a.join(b, "_b").where(F.col(at).between(F.col(low), F.col(high))).drop("_b")


def in_any_range(points: DataFrame, spans: DataFrame, at: str, low: str, high: str, width: int) -> DataFrame:
    """Points that lie in any of the spans, once each: the same buckets, as a semi join."""
    a = points.withColumn("_b", F.floor(F.col(at) / width))
    b = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))).withColumnRenamed("_b", "_bucket")
    return a.join(b, (F.col("_b") == F.col("_bucket")) & F.col(at).between(F.col(low), F.col(high)), "left_semi").drop("_b")


def longest_prefix(rows: DataFrame, prefixes: DataFrame, text: str, prefix: str) -> DataFrame:
    """The longest prefix that fits each text. A text looks up each of its own beginnings, so the join is on equality."""
    lengths = [r[0] for r in prefixes.select(F.length(prefix)).distinct().collect()]
    own = rows.select(text).distinct().withColumn("_n",
        F.explode(F.array(*map(F.lit, lengths or [0])))).where(F.col("_n") <= F.length(text)).withColumn(prefix,
        F.substring(F.col(text), F.lit(1), F.col("_n")))
    best = own.join(prefixes, prefix).groupBy(text).agg(F.max_by(F.struct(*prefixes.columns), "_n").alias("_x"))
    return rows.join(best, text, "left").select(*rows.columns, "_x.*")


def or_join(left: DataFrame, right: DataFrame, first: tuple[str, str], second: tuple[str, str], key: list[str], order: list[str]) -> DataFrame:
    """One match for each left row on either of two equalities, the first one preferred; `order` (columns of the right side) tells
    which of several. Each value's first right row is picked before it meets left rows, so no pairs are made."""

    def met(on: tuple[str, str], rank: int) -> DataFrame:
        best = right.groupBy(F.col(on[1]).alias("_k")).agg(F.min_by(F.struct(*right.columns), F.struct(*order)).alias("_r"))
        return left.join(best, left[on[0]] == best["_k"]).select(*left.columns, "_r.*", F.lit(rank).alias("_p"))

    return first_per_key(met(first, 0).unionByName(met(second, 1)), key, ["_p", *order]).drop("_p")


def split_join(left: DataFrame, right: DataFrame, keys: list[str], most: int = 200) -> DataFrame:
    """An inner join whose result may be far larger than both sides: a key with more than `most` right rows has them in parts, each
    of which meets a copy of the key's left rows, so pairs of a key spread over tasks and none holds all of its rows. Both are dealt
    to all shuffle partitions, as their own sizes don't tell the result's."""
    parts = right.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias("_parts")).where("_parts > 1")
    parts = checkpoint(parts)
    if parts.isEmpty():
        return left.join(right, keys)
    n = F.coalesce("_parts", F.lit(1))
    rest = [c for c in right.columns if c not in keys]
    b = right.join(parts, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*rest), n).cast("int")).drop("_parts")
    a = left.join(parts, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), n - 1))).drop("_parts")
    dealt = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = (x.repartition(dealt, *keys, "_part") for x in (a, b))
    return a.join(b, [*keys, "_part"]).drop("_part")


def zip_by_rank(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """One-to-one assignment: the n-th left row of a key takes the n-th right row."""
    rank = lambda df, order: df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return rank(left, left_order).join(rank(right, right_order), [*keys, "_n"]).drop("_n")


def round_robin(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """The n-th left row of a key takes right row n mod their number."""
    a = left.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*left_order)) - 1)
    b = right.withColumns({"_j": F.row_number().over(Window.partitionBy(*keys).orderBy(*right_order)) - 1, "_m": F.count("*").over(Window.partitionBy(*keys))})
    sizes = b.select(*keys, "_m").distinct()
    return a.join(sizes, keys).withColumn("_j", F.col("_i") % F.col("_m")).drop("_m").join(b.drop("_m"), [*keys, "_j"]).drop("_i", "_j")
