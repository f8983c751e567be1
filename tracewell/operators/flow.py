"""Control flow, post-dominators and control dependence of all methods at once, by joins.

No task sees a method as a whole. What a statement leads to, or who lies above it in a tree, is found by doubling: a table
holds each node's ancestors 1, 2, 4, ... steps up, made by joining it to itself as often as the longest way has bits. So the
number of joins grows with the logarithm of the longest method, and rows with nodes times that. Each round is written to the
checkpoint folder; only counts and one width reach the driver.

Cases: empty tables give empty results; repeated statements or edges count once; a method or end that is null joins nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .traverse import shared_path

EXIT = -1
LOOPS = ("FOR", "FOREACH", "WHILE", "DO")


def checkpoint(df: DataFrame) -> DataFrame:
    """The rows, written and read. A checkpoint of Spark's own hands on the constraints of the plan before, which double with
    each round of joins of a table to itself."""
    path = shared_path(df.sparkSession, "flow")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lifted(parents: DataFrame) -> DataFrame:
    """(method, node, ups, depth) from (method, node, up) with one parent a node: the ancestors 1, 2, 4, ... steps up, and the
    steps to EXIT, which is its own parent. Nodes on a cycle, or above one, never come to EXIT: their last ancestor tells."""
    ends = parents.select("method").distinct().select("method", F.lit(EXIT).alias("node"), F.array(F.lit(EXIT)).alias("ups"), F.lit(0).alias("depth"))
    table = checkpoint(parents.select("method", "node", F.array("up").alias("ups"), F.lit(1).alias("depth")).unionByName(ends))
    last = F.element_at("ups", -1)
    left = table.where(last != EXIT).count()
    while left:
        above = table.select("method", F.col("node").alias("_at"), last.alias("_far"), F.col("depth").alias("_more"))
        table = checkpoint(table.withColumn("_at", last).join(above, ["method", "_at"]).select("method", "node",
            F.concat("ups", F.array("_far")).alias("ups"), (F.col("depth") + F.col("_more")).alias("depth")))
        # As long as a node on the way to EXIT is open, one at half its distance or less has just come there.
        before, left = left, table.where(last != EXIT).count()
        if left == before:
            break
    return table


def _width(table: DataFrame) -> int:
    """How many ancestors each row of a lifted table holds; the same for all."""
    row = table.select(F.size("ups").alias("n")).first()
    return row["n"] if row else 0


def _cut(rows: DataFrame, k: int) -> DataFrame:
    """Every other step writes its rows: planning time grows much faster than the number of joins in a plan."""
    return checkpoint(rows) if k % 2 else rows


def _up(rows: DataFrame, table: DataFrame, at: str, k: int, when: Column) -> DataFrame:
    """Moves `at` 2^k steps up where a condition holds."""
    above = table.select("method", F.col("node").alias(at), F.col("ups")[k].alias("_up"))
    return rows.join(above, ["method", at]).withColumn(at, F.when(when, F.col("_up")).otherwise(F.col(at))).drop("_up")


def nearest_common(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Pairs (method, a, b, ...) with `common`, their nearest common ancestor-or-self, and its depth: the deeper end is lifted
    to the other's depth, then both as far as they stay apart."""
    width = _width(table)
    depth = lambda c, d: table.select("method", F.col("node").alias(c), F.col("depth").alias(d))
    rows = pairs.join(depth("a", "_da"), ["method", "a"]).join(depth("b", "_db"), ["method", "b"])
    swap = F.col("_da") < F.col("_db")
    rows = rows.withColumns({"_deep": F.when(swap, F.col("b")).otherwise(F.col("a")), "_flat": F.when(swap, F.col("a")).otherwise(F.col("b")),
        "_gap": F.abs(F.col("_da") - F.col("_db")), "_depth": F.least("_da", "_db")}).drop("_da", "_db")
    for k in range(width):
        rows = _cut(_up(rows, table, "_deep", k, F.col("_gap").bitwiseAND(1 << k) != 0), k)
    rows = checkpoint(rows.drop("_gap"))
    for k in reversed(range(width)):
        ends = [table.select("method", F.col("node").alias(c), F.col("ups")[k].alias(f"_to{c}")) for c in ("_deep", "_flat")]
        apart = F.col("_to_deep") != F.col("_to_flat")
        rows = rows.join(ends[0], ["method", "_deep"]).join(ends[1], ["method", "_flat"]).withColumns({
            "_deep": F.when(apart, F.col("_to_deep")).otherwise(F.col("_deep")), "_flat": F.when(apart, F.col("_to_flat")).otherwise(F.col("_flat")),
            "_depth": F.when(apart, F.col("_depth") - (1 << k)).otherwise(F.col("_depth"))}).drop("_to_deep", "_to_flat")
        rows = _cut(rows, k)
    same = F.col("_deep") == F.col("_flat")
    above = table.select("method", F.col("node").alias("_deep"), F.col("ups")[0].alias("_up"))
    return rows.join(above, ["method", "_deep"]).withColumns({"common": F.when(same, F.col("_deep")).otherwise(F.col("_up")),
        "common_depth": F.when(same, F.col("_depth")).otherwise(F.col("_depth") - 1)}).drop("_deep", "_flat", "_depth", "_up")


def _changed(parents: DataFrame, changes: DataFrame) -> DataFrame:
    """Parents with some of them replaced."""
    new = changes.select("method", "node", F.col("up").alias("_new"))
    return parents.join(new, ["method", "node"], "left").select("method", "node", F.coalesce("_new", "up").alias("up"))


def _spanning(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A lifted tree in which each node's parent is one of its successors and EXIT the root, and the edges. Each node takes its
    farthest successor in the text; those that go in circles are hung to successors that don't, until none is left. Where a
    method's rest cannot come to EXIT at all, its last node gets an edge there."""
    forward = F.max(F.when(F.col("dst") > F.col("src"), F.col("dst")))
    pick = F.coalesce(F.min(F.when(F.col("dst") == EXIT, F.col("dst"))), forward, F.max("dst"))
    parents = edges.groupBy("method", F.col("src").alias("node")).agg(pick.alias("up"))
    while True:
        table = lifted(parents)
        home = F.element_at("ups", -1) == EXIT
        lost, safe = table.where(~home).select("method", "node"), table.where(home).select("method", F.col("node").alias("dst"))
        if lost.isEmpty():
            return table, edges
        hung = checkpoint(edges.join(lost.withColumnRenamed("node", "src"), ["method", "src"], "left_semi").join(safe, ["method", "dst"],
            "left_semi").groupBy("method", F.col("src").alias("node")).agg(F.max("dst").alias("up")))
        stuck = lost.join(hung.select("method"), "method", "left_anti").groupBy("method").agg(F.max("node").alias("node")).withColumn("up", F.lit(EXIT))
        stuck = checkpoint(stuck)
        edges = checkpoint(edges.unionByName(stuck.select("method", F.col("node").alias("src"), F.col("up").alias("dst"))))
        parents = _changed(table.where(F.col("node") != EXIT).select("method", "node", F.col("ups")[0].alias("up")), hung.unionByName(stuck))


def _closed(cfg: DataFrame) -> DataFrame:
    """Edges with one to EXIT for each node that leads nowhere."""
    plain = cfg.select("method", F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst")).where("method is not null and src is not null and dst is not null").distinct()
    ends = plain.select("method", F.col("dst").alias("src")).distinct().join(plain.select("method", "src"), ["method", "src"], "left_anti")
    return checkpoint(plain.unionByName(ends.withColumn("dst", F.lit(EXIT))))


def _post_dominators(cfg: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lifted tree of nearest post-dominators, and the edges with those to EXIT. From a spanning tree, a node's parent moves
    up to the nearest common ancestor of its parent and its successors, until no parent moves: every post-dominator of a node
    stays above it throughout, and in the end nothing else does."""
    table, edges = _spanning(_closed(cfg))
    while True:
        pairs = edges.join(table.select("method", F.col("node").alias("src"), F.col("ups")[0].alias("a")), ["method", "src"]).where("a <> dst")
        met = nearest_common(pairs.select("method", F.col("src").alias("node"), "a", F.col("dst").alias("b")), table)
        best = met.groupBy("method", "node", F.col("a").alias("old")).agg(F.min_by("common", "common_depth").alias("up"))
        moves = checkpoint(best.where("up <> old").select("method", "node", "up"))
        if moves.isEmpty():
            return table, edges
        table = lifted(_changed(table.where(F.col("node") != EXIT).select("method", "node", F.col("ups")[0].alias("up")), moves))


def post_dominators(cfg: DataFrame) -> DataFrame:
    """(method, node, post) with each node's nearest post-dominator, from flow edges (method, src, dst); EXIT (-1) stands for the
    end of the method, which nodes without successors lead to."""
    return _post_dominators(cfg)[0].where(F.col("node") != EXIT).select("method", "node", F.col("ups")[0].alias("post"))


def control_dependence(cfg: DataFrame) -> DataFrame:
    """(method, src, dst): dst runs or not by src's choice. Each flow edge of a node with several marks the ways from its end up
    to below the node's own post-dominator; a way is cut in halves of powers of two until single nodes are left, so rows in
    between are no more than the result's."""
    table, edges = _post_dominators(cfg)
    several = edges.groupBy("method", "src").agg(F.count("*").alias("n")).where("n > 1").select("method", "src")
    of = lambda c, depth: table.select("method", F.col("node").alias(c), F.col("depth").alias(depth))
    rows = edges.join(several, ["method", "src"], "left_semi").join(of("dst", "_at"), ["method", "dst"]).join(of("src", "_own"), ["method", "src"])
    # The post-dominator lies one step above the node itself.
    rows = rows.select("method", "src", F.col("dst").alias("at"), (F.col("_at") - F.col("_own") + 1).alias("n")).where("n > 0")
    for k in reversed(range(_width(table))):
        above = table.select("method", F.col("node").alias("at"), F.col("ups")[k].alias("_up"))
        step = lambda at, n: F.struct(F.col(at).alias("at"), n.cast("int").alias("n"))
        parts = F.when(F.col("n") > (1 << k), F.array(step("at", F.lit(1 << k)), step("_up", F.col("n") - (1 << k)))).otherwise(F.array(step("at", F.col("n"))))
        rows = _cut(rows.join(above, ["method", "at"]).select("method", "src", F.inline(parts)), k)
    return rows.where("at <> src").select("method", "src", F.col("at").alias("dst")).distinct()


def control_flow(statements: DataFrame) -> DataFrame:
    """(method, src, dst) between ordinals, from statements (method, ordinal, kind, parent, branch): a statement leads to the
    next one in its block; a predicate leads into its blocks; a block's end leads on after its predicate, or back to a loop.
    Returns and throws lead nowhere; try, switch, break and continue are single nodes; a do loop starts at its predicate.
    Where a block's end leads on is found by doubling over the predicates around it."""
    rows = checkpoint(statements.select("method", F.col("ordinal").cast("int").alias("ordinal"), "kind", F.col("parent").cast("int").alias("parent"),
        "branch").dropDuplicates(["method", "ordinal"]))
    loop = F.col("kind").isin(*LOOPS)
    block = Window.partitionBy("method", "parent", "branch").orderBy("ordinal")
    over = rows.select("method", F.col("ordinal").alias("parent"), F.col("kind").alias("_over"))
    placed = rows.withColumns({"_next": F.lead("ordinal").over(block), "_first": F.row_number().over(block) == 1}).join(over, ["method", "parent"], "left")
    # A block is part of the flow if it is the body, or the block of a predicate that is.
    linked = (F.col("parent") == EXIT) & (F.col("branch") == "body") | F.col("_over").isin(*LOOPS) & (F.col("branch") == "then") | (F.col("_over") == "IF") & F.col("branch").isin("then", "else")
    placed = checkpoint(placed.withColumn("_linked", F.coalesce(linked, F.lit(False))))
    around = lifted(placed.select("method", F.col("ordinal").alias("node"), F.when(F.col("_linked"), F.col("parent")).otherwise(F.col("ordinal")).alias("up")))
    live = around.where((F.element_at("ups", -1) == EXIT) & (F.col("node") != EXIT)).select("method", F.col("node").alias("ordinal"))
    placed = checkpoint(placed.join(live, ["method", "ordinal"], "left_semi"))
    # The nearest statement, itself or around it, whose end is not the end of a branch: where that leads is where all lead.
    passes = F.col("_next").isNull() & (F.col("_over") == "IF")
    chain = lifted(placed.select("method", F.col("ordinal").alias("node"), F.when(passes, F.col("parent")).otherwise(F.lit(EXIT)).alias("up")))
    width = _width(chain)
    ends = chain.where(F.col("node") != EXIT).select("method", F.col("node").alias("ordinal"), F.col("node").alias("_top"), (F.col("depth") - 1).alias("_gap"))
    for k in range(width):
        ends = _cut(_up(ends, chain, "_top", k, F.col("_gap").bitwiseAND(1 << k) != 0), k)
    target = F.coalesce("_next", F.when(F.col("_over").isin(*LOOPS), F.col("parent")))
    onward = placed.select("method", F.col("ordinal").alias("_top"), target.alias("dst")).where("dst is not null")
    after = ends.join(onward, ["method", "_top"]).select("method", F.col("ordinal"), "dst")
    heads = placed.where(F.col("_first") & (F.col("parent") != EXIT)).select("method", F.col("parent").alias("src"), F.col("ordinal").alias("dst"), "branch")
    kinds = placed.select("method", "ordinal", "kind", loop.alias("_loop"))
    held = heads.groupBy("method", F.col("src").alias("ordinal")).agg(F.max((F.col("branch") == "then").cast("int")).alias("_then"), F.max((F.col("branch") == "else").cast("int")).alias("_else"))
    kinds = kinds.join(held, ["method", "ordinal"], "left").fillna(0, ["_then", "_else"])
    # A branch with both blocks leads on from those alone.
    on = kinds.where(~F.col("kind").isin("RETURN", "THROW") & ~((F.col("kind") == "IF") & (F.col("_then") == 1) & (F.col("_else") == 1)))
    flows = on.join(after, ["method", "ordinal"]).select("method", F.col("ordinal").alias("src"), "dst")
    idle = kinds.where("_loop and _then = 0").select("method", F.col("ordinal").alias("src"), F.col("ordinal").alias("dst"))
    return heads.select("method", "src", "dst").unionByName(flows).unionByName(idle).distinct()
