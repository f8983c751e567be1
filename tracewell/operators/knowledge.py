"""A knowledge graph of a target method's observed behaviour, as node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import last_dotted, test_class
from .ranking import first_per_key

def upper_median(values: Column) -> Column:
    """The element at position n div 2 of the sorted array."""
    return F.get(F.array_sort(values), (F.size(values) / 2).cast("int"))


def behaviour_classes(values: DataFrame, pattern: str) -> DataFrame:
    """Captured calls (method, test, args, result, throws, ord) with row, col and their behaviour class; calls whose first
    two arguments are no integers are left out. `pattern` tells how a project's results name a place: its two groups are
    the second and the first coordinate."""
    rows = values.withColumns({"row": F.get("args", F.lit(0)).try_cast("int"), "col": F.get("args", F.lit(1)).try_cast("int"),
        "value": F.array_join(F.slice("args", 3, F.greatest(F.size("args") - 2, F.lit(0))),
        " | ")}).where("row is not null and col is not null")
    dcol = F.regexp_extract("result", "^" + pattern, 1).try_cast("int") - F.col("col")
    drow = F.regexp_extract("result", "^" + pattern, 2).try_cast("int") - F.col("row")
    signed = lambda c: F.format_string("%+d", c)
    cls = F.when(F.col("throws"), F.concat(F.lit("throws:"),
        F.regexp_replace(F.substring_index("result", ":", 1), "throws ", ""))).when(dcol.isNotNull(),
        F.concat(F.lit("dcol"), signed(dcol), F.lit("_drow"), signed(drow))).otherwise(F.concat(F.lit("other:"),
        F.substring("result", 1, 30)))
    return rows.withColumns({"class": cls, "length": F.length("value")})


def median_of(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, name): the element at position n div 2 of each key's sorted values, nulls left out. Values are counted first, so
    a hot key costs one row for each distinct value."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    by = Window.partitionBy(*keys)
    upto = F.sum("_n").over(by.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counts = counts.withColumns({"_upto": upto, "_all": F.sum("_n").over(by)}).where("_upto > floor(_all / 2)")
    return counts.groupBy(*keys).agg(F.min(value).alias(name))


def class_summary(classed: DataFrame, first: int = 5) -> DataFrame:
    """(class, count, length_min, length_max, representatives), most frequent first."""
    shown = F.struct("ord", "row", "col", F.substring("value", 1, 70).alias("value"), F.substring("result", 1, 70).alias("result"), "test")
    top = first_per_key(classed, ["class"], ["ord"], first).groupBy("class").agg(F.array_sort(F.collect_list(shown)).alias("representatives"))
    out = classed.groupBy("class").agg(F.count("*").alias("count"), F.min("length").alias("length_min"),
        F.max("length").alias("length_max"), F.min("ord").alias("first"))
    return out.join(top, "class").orderBy(F.desc("count"), "first").drop("first")


def input_profile(values: DataFrame) -> DataFrame:
    """One row: n, non_throwing, histograms of the first two arguments, and least, upper median and greatest value length."""
    numeric = F.get("args", F.lit(0)).rlike("^[0-9]+$")
    rows = values.withColumns({"ok": ~F.col("throws"), "num": F.coalesce(numeric, F.lit(False)), "row": F.get("args", F.lit(0)),
        "col": F.get("args", F.lit(1)),
        "length": F.length(F.array_join(F.slice("args", 3, F.greatest(F.size("args") - 2, F.lit(0))), " | "))})
    hist = lambda c: rows.where(F.col("num") & F.col(c).rlike("^[0-9]+$")).groupBy(c).count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c,
        "count")))).alias(f"{c}_hist"))
    total = rows.agg(F.count(F.when(F.col("num"), 1)).alias("n"), F.count(F.when(F.col("ok"), 1)).alias("non_throwing"),
        F.min(F.when(F.col("num"), F.col("length"))).alias("length_min"),
        F.max(F.when(F.col("num"), F.col("length"))).alias("length_max"))
    counts = rows.where("num").groupBy("length").count()
    by = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    median = counts.withColumns({"upto": F.sum("count").over(by),
        "all": F.sum("count").over(Window.partitionBy())}).where(F.col("upto") > F.floor(F.col("all") / 2)).agg(F.min("length").alias("length_median"))
    facts = [total.withColumn("_at", F.lit(0)), median.withColumn("_at", F.lit(1)), hist("row").withColumn("_at", F.lit(2)),
        hist("col").withColumn("_at", F.lit(3))]
    rows = facts[0]
    for f in facts[1:]:
        rows = rows.unionByName(f, allowMissingColumns=True)
    return rows.agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c) for c in rows.columns if c != "_at"])  # four rows


def co_coverage(coverage: DataFrame, target: str, places: int = 3) -> DataFrame:
    """(method, shared, jaccard, covered_by) of every other covered method with the target. Only rows of the target's tests
    are joined; sizes come from one count."""
    pairs = coverage.select("method", "test").distinct()
    sizes = pairs.groupBy("method").agg(F.count("*").alias("covered_by"))
    own = pairs.where(F.col("method") == target).select("test")
    n = own.count()
    shared = pairs.join(own, "test", "left_semi").groupBy("method").agg(F.count("*").alias("shared"))
    out = sizes.where(F.col("method") != target).join(shared, "method", "left").select("method",
        F.coalesce("shared", F.lit(0)).cast("long").alias("shared"), "covered_by")
    return out.select("method", "shared", F.round(F.col("shared") / (F.col("covered_by") + n - F.col("shared")), places).alias("jaccard"), "covered_by")


def chokepoint(co: DataFrame, callers: DataFrame) -> DataFrame:
    """The production caller (caller) of the greatest Jaccard similarity; the first by name on ties."""
    return co.join(callers.select(F.col("caller").alias("method")).distinct(), "method",
        "left_semi").where("jaccard > 0").orderBy(F.desc("jaccard"), "method").limit(1)


def universe_by_class(tests: DataFrame) -> DataFrame:
    """(cls, n) of tests, largest first."""
    return tests.select("test").distinct().groupBy(test_class("test").alias("cls")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cls")


def exemplars(tests: DataFrame, per_class: int = 2) -> DataFrame:
    """The first tests of each class by name."""
    return first_per_key(tests.select("test").distinct().withColumn("cls", test_class("test")), ["cls"], ["test"], per_class)


def golden_outputs(failures: DataFrame, most: int = 4) -> DataFrame:
    """The shortest multi-line expected sides of comparison failures: (test, excerpt)."""
    short = F.regexp_extract("message", r"expected:<(.{40,300}?)> but was", 1)
    open_ = F.regexp_extract("message", r"expected:<(.{40,300})$", 1)
    rows = failures.where(F.contains("type", F.lit("ComparisonFailure"))).select("test", F.when(short != "", short).otherwise(open_).alias("excerpt"))
    return rows.where(F.contains("excerpt", F.lit("\\n "))).orderBy(F.length("excerpt"), "test").limit(most)


def focus_set(calls: DataFrame, target: str, methods: DataFrame, words: list[str], most: int = 10) -> DataFrame:
    """Direct callers of the target, then methods whose name holds one of the words, up to `most` of those."""
    direct = calls.where(F.col("callee") == target).select(F.col("caller").alias("fqn")).distinct().withColumn("why", F.lit("caller"))
    pattern = "(?i)" + "|".join(words) if words else "(?!)"
    named = methods.where(last_dotted("fqn").rlike(pattern)).select("fqn").distinct().join(direct.select("fqn"), "fqn",
        "left_anti").orderBy("fqn").limit(most).withColumn("why", F.lit("name"))
    return direct.union(named)


def build(target: str, values: DataFrame, coverage: DataFrame, failures: DataFrame, covering: DataFrame, examples: DataFrame,
    pattern: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): nodes (id, type, label, props, ev), edges (src, rel, dst, props); props are JSON text. No edge has an
    unknown end."""
    props = lambda *c: F.to_json(F.struct(*c))
    none = F.lit(None).cast("string")
    node = lambda df, id_, kind, label, p, ev: df.select(id_.alias("id"), F.lit(kind).alias("type"), label.alias("label"),
        p.alias("props"), F.lit(ev).alias("ev"))
    edge = lambda df, a, rel, b, p=none: df.select(a.alias("src"), F.lit(rel).alias("rel"), b.alias("dst"), p.alias("props"))
    spark = values.sparkSession
    red = failures.groupBy("test").agg(F.max_by("type", "message").alias("red_type"), F.max(F.substring("message", 1, 140)).alias("red_msg"))
    tests = covering.select("test").distinct().join(examples.select("test", F.lit(True).alias("exemplar")).distinct(), "test",
        "left").join(red, "test", "left").withColumn("exemplar", F.coalesce("exemplar", F.lit(False)))
    tid = F.concat(F.lit("t:"), "test")
    nodes = [node(spark.range(1), F.lit("m:target"), "Method", F.lit(target), none, "target"),
        node(tests, tid, "Test", last_dotted("test"), props(test_class("test").alias("class"), "exemplar", "red_type", "red_msg"),
        "red run")]
    edges = [edge(tests, tid, "COVERS", F.lit("m:target"))]
    mode = F.concat(F.lit("f:mode:"), last_dotted("red_type"))
    nodes.append(node(red.groupBy("red_type").agg(F.count("*").alias("count")), mode, "FailureMode", F.col("red_type"), props("count"), "red run failures"))
    edges.append(edge(tests.where("red_type is not null"), tid, "FAILS_WITH", mode))
    own = values.where(F.col("method") == target)
    classed = behaviour_classes(own, pattern)
    summary = class_summary(classed)
    bid = F.concat(F.lit("bc:"), "class")
    nodes.append(node(summary, bid, "BehaviorClass", F.concat(F.lit("target I/O class "), "class"),
        props("count", "length_min", "length_max", "representatives"), "value capture"))
    edges.append(edge(summary, bid, "OBSERVED_AT", F.lit("m:target")))
    shown = summary.select("class", F.explode("representatives").alias("r")).select("class", F.col("r.test").alias("test")).distinct()
    edges.append(edge(shown.join(tests.select("test"), "test", "left_semi"), tid, "EXHIBITS", bid))
    profile = input_profile(own).where("n > 0")
    nodes.append(node(profile, F.lit("profile:target-inputs"), "InputProfile", F.lit("observed input domain"),
        props("n", "non_throwing", "row_hist", "col_hist", "length_min", "length_median", "length_max"), "value capture"))
    edges.append(edge(profile, F.lit("profile:target-inputs"), "OBSERVED_AT", F.lit("m:target")))
    co = co_coverage(coverage, target)
    mid = F.concat(F.lit("m:co:"), last_dotted("method"))
    nodes.append(node(first_per_key(co.withColumn("id", mid), ["id"], ["method"]), mid, "Method", F.col("method"), props("covered_by"), "coverage matrix"))
    edges.append(edge(co, mid, "CO_COVERED_WITH", F.lit("m:target"), props(F.col("shared").alias("shared_tests"), "jaccard")))
    golden = golden_outputs(failures).withColumn("i", F.row_number().over(Window.orderBy(F.length("excerpt"), "test")) - 1)
    gid = F.concat(F.lit("gn:"), F.col("i").cast("string"))
    nodes.append(node(golden, gid, "GoldenOutput", F.concat(F.lit("golden expected output ("), last_dotted("test"), F.lit(")")),
        props("excerpt", "test"), "expected side of failures"))
    edges.append(edge(golden.join(tests.select("test"), "test", "left_semi"), gid, "ASSERTED_BY", tid))
    all_nodes, all_edges = nodes[0], edges[0]
    for n in nodes[1:]:
        all_nodes = all_nodes.union(n)
    for e in edges[1:]:
        all_edges = all_edges.union(e)
    return all_nodes, all_edges
