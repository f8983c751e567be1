"""Traversal by levels: each round is a join, a left anti join against what was seen, and one pick a node.

Every level is written to the checkpoint folder, so plans stay short and a lost executor costs no earlier level; only
counts reach the driver. Edges are kept partitioned by the end that a traversal looks up.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.storagelevel import StorageLevel


def shared_path(spark: SparkSession, name: str) -> str:
    """A path that nothing else uses in the folder that driver and executors share; in local mode a temporary folder serves
    if none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.match(r"local(\[|$)", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="tracewell-")
        sc.setCheckpointDir(folder)
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """An eager reliable checkpoint."""
    shared_path(df.sparkSession, "checkpoint")  # sets the folder
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """A table written to the shared folder and read again, which takes a fraction of a checkpoint's bytes."""
    path = shared_path(df.sparkSession, "written")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_order(df: DataFrame, *by, name: str = "seq") -> DataFrame:
    """Adds numbers that grow in an order but have gaps: rows are dealt out by ranges and sorted there, so no task sees all
    of them. Checkpoint the result, as the ranges come from a sample."""
    return df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id())


class TooMany(ValueError):
    """A traversal that met more nodes than allowed."""


def bfs(edges: DataFrame, seeds: DataFrame, *, src: str = "src", dst: str = "dst", key: str | None = None,
    order: list[str] | None = None, stop: DataFrame | None = None, blocked: Column | None = None, max_depth: int | None = None,
    max_nodes: int | None = None, fail: bool = False) -> DataFrame:
    """(node, depth, parent, seq) of breadth-first search from seeds (node) along src → dst.

    `key` separates searches: seeds and results carry it, and each runs on its own. `stop` has nodes (node) that are
    reached but not left, unless they are seeds. `blocked` is a condition on dst not to go on through. `order` are edge
    columns that break ties between parents of one rank; `seq` then grows in order of discovery within a depth. Over
    max_nodes the result keeps the first by (depth, seq), or fails with TooMany."""
    keys = [key] if key else []
    arcs = edges.where(F.col(src) != F.col(dst)).withColumnsRenamed({src: "_from", dst: "_to"}).select("_from", "_to", *(order or [])).distinct()
    if blocked is not None:
        arcs = arcs.withColumnRenamed("_to", dst).where(~blocked).withColumnRenamed(dst, "_to")
    first = arcs  # seeds are left even where they are stops
    if stop is not None:
        arcs = arcs.join(stop.select(F.col("node").alias("_from")).distinct(), "_from", "left_anti")
    arcs = arcs.repartition("_from").persist(StorageLevel.MEMORY_AND_DISK)  # recomputed from its source if an executor is lost
    numbered = lambda df, by: in_order(df, *keys, by) if order else df.withColumn("seq", F.lit(0).cast("long"))
    start = seeds.select(*keys, "node").distinct()
    start = start.select(*keys, "node", F.lit(0).alias("depth"), F.lit(None).cast(seeds.schema["node"].dataType).alias("parent"))
    level = checkpoint(numbered(start, "node"))
    seen, depth, met = level, 0, level.count() if max_nodes else 0
    while max_depth is None or depth < max_depth:
        depth += 1
        found = level.select(*keys, F.col("node").alias("_from"), F.col("seq").alias("_seq")).join(first if depth == 1 else arcs, "_from")
        pick = found.groupBy(*keys, F.col("_to").alias("node")).agg(F.min(F.struct("_seq", *(order or []), F.col("_from").alias("parent"))).alias("x"))
        fresh = pick.join(seen.select(*keys, "node"), [*keys, "node"], "left_anti")
        fresh = fresh.select(*keys, "node", F.lit(depth).alias("depth"), F.col("x.parent").alias("parent"), F.struct("x", "node").alias("by"))
        level = checkpoint(numbered(fresh, "by").drop("by"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
        if max_nodes is not None:
            met += level.count()
            if met > max_nodes:
                if fail:
                    raise TooMany(f"more than {max_nodes} nodes")
                break
    arcs.unpersist()
    if max_nodes is not None:
        if keys:
            rank = Window.partitionBy(*keys).orderBy("depth", "seq", "node")
            seen = seen.withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= max_nodes).drop("_n")
        elif met > max_nodes:
            seen = seen.orderBy("depth", "seq", "node").limit(max_nodes)
    return seen


def reverse_chains(calls: DataFrame, target: str, tests: DataFrame, max_depth: int | None = 100, most: int | None = 100_000) -> DataFrame:
    """Chains from tests to the target: the reverse breadth-first tree from the target, never left through a test, and
    for each edge from a test into the tree that edge followed by the tree path. (chain_id, test, depth, virtual_steps,
    steps), the first `most`, or all, in order of depth, virtual steps and discovery; with `most`, chain_id counts from 0, else it
    grows in that order. `calls` has (caller, callee, virtual, ord), `tests` (node)."""
    spark = calls.sparkSession
    seed = spark.createDataFrame([(target,)], "node string").select(F.col("node").cast(calls.schema["callee"].dataType).alias("node"))
    tree = bfs(calls.select("caller", "callee", "virtual", "ord"), seed, src="callee", dst="caller", order=["virtual", "ord"], stop=tests, max_depth=max_depth)
    inner = tree.join(tests.select("node").distinct(), "node", "left_anti").union(tree.where("depth = 0")).distinct()
    by_edge = calls.groupBy("caller", "callee").agg(F.min("virtual").alias("virtual"))
    step = F.struct(F.col("caller"), F.col("callee"), F.col("virtual"))
    # Paths grow level by level from the target outwards.
    paths = inner.where("depth = 0").select("node", "seq", F.array().cast(f"array<struct<caller:{calls.schema['caller'].dataType.simpleString()},callee:{calls.schema['callee'].dataType.simpleString()},virtual:boolean>>").alias("steps"))
    all_paths = paths
    deepest = inner.agg(F.max("depth")).first()[0] or 0
    for depth in range(1, deepest + 1):
        here = inner.where(F.col("depth") == depth).select(F.col("node").alias("caller"), F.col("parent").alias("callee"),
            "seq").join(by_edge, ["caller", "callee"])
        paths = checkpoint(here.join(paths.select(F.col("node").alias("callee"), "steps"),
            "callee").select(F.col("caller").alias("node"), "seq", F.concat(F.array(step), "steps").alias("steps")))
        all_paths = all_paths.unionByName(paths)
    entry = calls.select("caller", "callee", "virtual").distinct().join(tests.select(F.col("node").alias("caller")).distinct(),
        "caller", "left_semi").where(F.col("caller") != F.col("callee"))
    found = entry.join(all_paths.select(F.col("node").alias("callee"), "seq", "steps"),
        "callee").select(F.col("caller").alias("test"), "seq", F.col("virtual"), F.concat(F.array(step), "steps").alias("steps"))
    found = found.withColumns({"depth": F.size("steps"), "virtual_steps": F.size(F.filter("steps", lambda s: s["virtual"]))})
    order = ["depth", "virtual_steps", "seq", "test", "virtual"]
    if most is None:
        found = checkpoint(in_order(found, *order, name="chain_id"))
    else:
        found = found.orderBy(*order).limit(most)  # a distributed top-n, so numbering sees no more rows than that
        found = found.withColumn("chain_id", F.row_number().over(Window.orderBy(*order)).cast("long") - 1)
    return found.select("chain_id", "test", "depth", "virtual_steps", "steps")


def entry_depths(calls: DataFrame, target, tests: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(test, entry, depth) of the same chains without their steps, for graphs too large to spell paths out."""
    seed = target if isinstance(target, DataFrame) else calls.sparkSession.createDataFrame([(target,)], ["node"])
    tree = bfs(calls, seed.select("node"), src="callee", dst="caller", stop=tests, max_depth=max_depth)
    inner = tree.join(tests.select("node").distinct(), "node", "left_anti").union(tree.where("depth = 0")).distinct()
    edge = calls.select(F.col("caller").alias("test"), F.col("callee").alias("entry")).distinct().where("test != entry")
    return edge.join(tests.select(F.col("node").alias("test")).distinct(), "test",
        "left_semi").join(inner.select(F.col("node").alias("entry"), (F.col("depth") + 1).alias("depth")), "entry").select("test",
        "entry", "depth")


def reachable_callers(calls: DataFrame, target, max_depth: int | None = None, max_methods: int = 500) -> DataFrame:
    """(node, depth) of callers, tests included; fails over max_methods."""
    seed = target if isinstance(target, DataFrame) else calls.sparkSession.createDataFrame([(target,)], ["node"])
    return bfs(calls, seed, src="callee", dst="caller", max_depth=max_depth, max_nodes=max_methods, fail=True).select("node", "depth")


def within(edges: DataFrame, seeds: DataFrame, hops: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, depth) within so many hops; a bounded walk is a fixed number of joins."""
    out = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    level = out
    arcs = edges.select(F.col(src).alias("_from"), F.col(dst).alias("_to")).distinct()
    for depth in range(1, hops + 1):
        level = level.join(arcs, level["node"] == arcs["_from"]).select(F.col("_to").alias("node")).distinct().withColumn("depth", F.lit(depth))
        out = out.union(level)
    return out.groupBy("node").agg(F.min("depth").alias("depth"))


def reach_with_paths(edges: DataFrame, seeds: DataFrame, hops: int = 3, src: str = "caller", dst: str = "callee") -> DataFrame:
    """(node, depth, path) forward within so many hops; of several paths of one length the least."""
    out = seeds.select("node").distinct().select("node", F.lit(0).alias("depth"), F.array("node").alias("path"))
    level = out
    arcs = edges.select(F.col(src).alias("_from"), F.col(dst).alias("_to")).distinct()
    for depth in range(1, hops + 1):
        level = level.join(arcs,
            level["node"] == arcs["_from"]).groupBy(F.col("_to").alias("node")).agg(F.min(F.concat("path",
            F.array("_to"))).alias("path")).select("node", F.lit(depth).alias("depth"), "path")
        level = level.join(out.select("node"), "node", "left_anti")
        out = out.union(level)
    return out


def corridor(calls: DataFrame, target: DataFrame, hops: int = 2, keep: DataFrame | None = None) -> DataFrame:
    """Nodes within so many hops either way, restricted to `keep` (node) if given."""
    both = within(calls, target, hops, "caller", "callee").select("node").union(within(calls, target, hops, "callee", "caller").select("node")).distinct()
    return both if keep is None else both.join(keep.select("node").distinct(), "node", "left_semi")


def chop(edges: DataFrame, target: DataFrame, sources: DataFrame, *, blocked: Column | None = None, max_depth: int = 12, max_nodes: int = 800) -> DataFrame:
    """(node): backward from the target met with forward from sources; at most max_nodes each way, nearest first."""
    back = bfs(edges, target, src="dst", dst="src", blocked=blocked, max_depth=max_depth, max_nodes=max_nodes).select("node")
    forth = bfs(edges, sources, src="src", dst="dst", blocked=blocked, max_depth=max_depth, max_nodes=max_nodes).select("node")
    return back.intersect(forth)


def literal_closure(nodes: DataFrame, literals: DataFrame, ddg: DataFrame) -> DataFrame:
    """The nodes and the literals whose data flows into one of them."""
    used = ddg.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    return nodes.select("node").union(literals.join(used, "id", "left_semi").select(F.col("id").alias("node"))).distinct()


def simple_paths(spark, edges: DataFrame, start: DataFrame, end: DataFrame, max_depth: int = 25, most: int | None = 5000) -> DataFrame:
    """(path, depth) of paths without repeats from start to end nodes, shortest first: the first `most`, or all. Each node knows
    its distance to the end, and a path goes on only where what is left can still bring it there; lengths are taken one after
    another until there are enough, so rows in between follow what can be found and not what can be walked."""
    arcs = checkpoint(edges.select("src", "dst").where("src != dst").distinct())
    left = bfs(arcs, end.select("node"), src="dst", dst="src", max_depth=max_depth).select(F.col("node").alias("dst"), F.col("depth").alias("_left"))
    ends = end.select(F.col("node").alias("at")).distinct()
    onward = checkpoint(arcs.join(left, "dst")).repartition("src").persist(StorageLevel.MEMORY_AND_DISK)
    first = start.select("node").distinct().join(left.withColumnRenamed("dst", "node"), "node")
    shortest = first.agg(F.min("_left")).first()[0]
    done = spark.createDataFrame([], start.select(F.array("node").alias("path")).schema)
    if shortest is None:
        return done.select("path", (F.size("path") - 1).alias("depth"))
    length = shortest
    while True:
        live = first.where(F.col("_left") <= length).select(F.col("node").alias("at"), F.array("node").alias("path"))
        found = live.join(ends, "at", "left_semi").select("path") if length else live.select("path")
        for depth in range(1, length + 1):
            step = live.join(onward, live["at"] == onward["src"]).where((F.col("_left") + depth <= length) & ~F.array_contains("path", F.col("dst")))
            live = checkpoint(step.select(F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path")))
            found = found.union(live.join(ends, "at", "left_semi").select("path"))
        enough = most is not None and found.limit(most).count() >= most
        if enough or length >= max_depth:
            break
        length += 1 if most is not None else max_depth - length
    onward.unpersist()
    found = found.select("path", (F.size("path") - 1).alias("depth"))
    return found if most is None else found.orderBy("depth", "path").limit(most)


def katz(edges: DataFrame, nodes: DataFrame, alpha: float = 0.01, tolerance: float = 1e-8, rounds: int = 100) -> DataFrame:
    """(node, score): x = 1 + alpha * sum of x over distinct in-neighbours, from 1, until it moves less than tolerance."""
    arcs = edges.select("src", "dst").where("src != dst").distinct().cache()
    x = checkpoint(nodes.select("node").distinct().withColumn("score", F.lit(1.0)))
    for _ in range(rounds):
        gained = arcs.join(x, arcs["src"] == x["node"]).groupBy(F.col("dst").alias("node")).agg(F.sum("score").alias("s"))
        new = x.select("node", F.col("score").alias("old")).join(gained, "node", "left").select("node",
            (1 + alpha * F.coalesce("s", F.lit(0.0))).alias("score"), "old")
        new = checkpoint(new)
        moved = new.agg(F.max(F.abs(F.col("score") - F.col("old")))).first()[0] or 0.0
        x = new.select("node", "score")
        if moved < tolerance:
            break
    arcs.unpersist()
    return x


def best_by_name(scores: DataFrame, names: DataFrame) -> DataFrame:
    """(fqn, score): the greatest score of the nodes with a name; 0 for names without one."""
    return names.join(scores, "node", "left").groupBy("fqn").agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("score"))


def owner_graph(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """Edges between nodes as distinct edges between their owners (node, owner), loops left out."""
    a, b = owners.select(F.col("node").alias("src"), F.col("owner").alias("a")), owners.select(F.col("node").alias("dst"), F.col("owner").alias("b"))
    return edges.join(a, "src").join(b, "dst").where("a != b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def callers(calls: DataFrame, target: DataFrame, tests: DataFrame) -> DataFrame:
    """(caller, is_test) of the target's direct callers."""
    return calls.join(target.select(F.col("node").alias("callee")), "callee",
        "left_semi").select("caller").distinct().join(tests.select(F.col("node").alias("caller"),
        F.lit(True).alias("t")).distinct(), "caller", "left").select("caller", F.coalesce("t", F.lit(False)).alias("is_test"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are among the nodes."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
