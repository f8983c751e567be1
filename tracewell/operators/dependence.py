"""Program dependence: control flow of statements, control and data dependence, their composition across calls, and the
chop that each target statement touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .flow import control_dependence, control_flow, post_dominators  # noqa: F401
from .ranking import round_robin
from .traverse import bfs


def data_dependence(exprs: DataFrame) -> DataFrame:
    """(method, name, src, dst) statement ordinals: the last definition of a name, by place in the text, before each use. One
    window over definitions and uses. Declarations and parameters define; assignments don't."""
    rows = exprs.where(F.col("kind").isin("PARAM", "LOCAL_DEF", "LOCAL_USE"))
    by = Window.partitionBy("method", "name").orderBy("line", "col", F.col("kind") == "LOCAL_USE", "stmt_ordinal").rowsBetween(Window.unboundedPreceding, -1)
    source = F.last(F.when(F.col("kind") != "LOCAL_USE", F.col("stmt_ordinal")), ignorenulls=True).over(by)
    return rows.withColumn("src", source).where("kind = 'LOCAL_USE' and src is not null").select("method", "name", "src",
        F.col("stmt_ordinal").alias("dst")).distinct()


def compose(pdg: DataFrame, calls: DataFrame, sites: DataFrame, params: DataFrame, returns: DataFrame) -> DataFrame:
    """(layer, src, dst, resolution) over elements of all methods: each method's own edges (layer, src, dst), and for each call
    (caller, callee, virtual) one of the caller's sites (method, callee_name, node) in turn: to the callee's method node (CG),
    to its parameters (ARG_PASS), and from its return values back (RETURN_BIND)."""
    name = F.substring_index("callee", ".", -1)
    distinct = calls.select("caller", "callee", "virtual").distinct().withColumn("callee_name", name)
    bound = round_robin(distinct, sites.select(F.col("method").alias("caller"), "callee_name", "node"), ["caller", "callee_name"], ["callee"], ["node"])
    kind = F.when(F.col("virtual"), "VIRTUAL").otherwise("EXACT")
    cg = bound.select(F.lit("CG").alias("layer"), F.col("node").alias("src"), F.concat(F.lit("m:"), "callee").alias("dst"), kind.alias("resolution"))
    arg = bound.join(params.select(F.col("method").alias("callee"), F.col("node").alias("to")),
        "callee").select(F.lit("ARG_PASS").alias("layer"), F.col("node").alias("src"), F.col("to").alias("dst"),
        kind.alias("resolution"))
    ret = bound.join(returns.select(F.col("method").alias("callee"), F.col("node").alias("out")),
        "callee").select(F.lit("RETURN_BIND").alias("layer"), F.col("out").alias("src"), F.col("node").alias("dst"),
        kind.alias("resolution"))
    own = pdg.select("layer", "src", "dst", F.lit("EXACT").alias("resolution"))
    return own.unionByName(cg).unionByName(arg).unionByName(ret)


BACKWARD = ["DDG", "CDG", "CFG", "ARG_PASS", "CG", "OVERRIDES"]
FORWARD = ["DDG", "CFG", "RETURN_BIND", "CG", "OVERRIDES"]


def touched(edges: DataFrame, statements: DataFrame) -> DataFrame:
    """(stmt, node): what each target statement (stmt, node) reaches back over one set of layers or forth over another, as a
    bridge table. All statements search at once, each under its own key."""
    seeds = statements.select("stmt", "node")
    back = bfs(edges.where(F.col("layer").isin(BACKWARD)), seeds, src="dst", dst="src", key="stmt")
    forth = bfs(edges.where(F.col("layer").isin(FORWARD)), seeds, src="src", dst="dst", key="stmt")
    return back.select("stmt", "node").union(forth.select("stmt", "node")).distinct()


def touched_edges(edges: DataFrame, bridge: DataFrame) -> DataFrame:
    """(stmt, layer, src, dst) of edges whose both ends a statement touches."""
    a = bridge.select("stmt", F.col("node").alias("src"))
    b = bridge.select("stmt", F.col("node").alias("dst"))
    return edges.join(a, "src").join(b, ["stmt", "dst"], "left_semi").select("stmt", "layer", "src", "dst")


def view(edges: DataFrame, bridge: DataFrame | None = None, layers: list[str] | None = None, statement: str | None = None) -> DataFrame:
    """Edges of some layers, and with a statement only those that it touches."""
    out = edges if layers is None else edges.where(F.col("layer").isin(layers))
    return out if bridge is None or statement is None else touched_edges(out, bridge.where(F.col("stmt") == statement)).drop("stmt")
