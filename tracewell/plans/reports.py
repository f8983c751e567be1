"""The engine's questions end to end: slice, paths, chop, impact, crash, pool. Each returns tables and a rendered text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import Target, class_and_method, last_dotted, owner, parameters, simple
from ..functions.predicates import readable_source, trimmed_helper
from ..operators import chains as ch
from ..operators import impact as im
from ..operators import knowledge as kg
from ..operators import localize as lo
from ..operators.ingest import Graph
from ..operators.traverse import best_by_name, katz, reverse_chains
from ..sources import sinks
from ..sources import text as tx


class NotFound(ValueError):
    """No method fits a target."""


class Ambiguous(ValueError):
    """Several methods fit a target."""


def locate(methods: DataFrame, target: Target) -> dict:
    """The one method that fits; parameters, where given, are held against the signature."""
    cls = owner("fqn")
    fits = (last_dotted("fqn") == target.name) & (simple(cls) == target.simple_class)
    if target.cls:
        fits &= cls == target.cls
    if target.file:
        fits &= F.col("file").endswith(target.file)
    found = methods.where(fits)
    if target.params:
        short = F.transform(parameters("signature"), lambda p: F.element_at(F.split(p, r"[.$]"), -1))
        found = found.where(short == F.array(*map(F.lit, target.params)))
    rows = found.orderBy("id").limit(2).collect()
    if not rows:
        near = methods.where(F.levenshtein(last_dotted("fqn"), F.lit(target.name), 2) >= 0).select("fqn").distinct().orderBy("fqn").limit(5)
        raise NotFound(f"no method {target.simple_class}.{target.name}; near: {', '.join(r[0] for r in near.collect()) or 'none'}")
    if len(rows) > 1:
        raise Ambiguous(f"several methods fit {target.simple_class}.{target.name}; give its parameters")
    return rows[0].asDict()


def paths(graph: Graph, target: Target, max_chains: int = 5000) -> DataFrame:
    """Ranked chains from tests to the target, at most max_chains."""
    node = locate(graph.methods, target)["id"]
    tests = graph.methods.where("is_test").select(F.col("id").alias("node"))
    return reverse_chains(graph.calls(), node, tests).orderBy("chain_id").limit(max_chains)


def local_context(graph: Graph, node: dict) -> dict[str, DataFrame]:
    """Siblings of the target (own class and classes nested in it), fields that it reads or writes, and types that it uses."""
    cls = node["fqn"].rpartition(".")[0]
    siblings = graph.methods.where(((owner("fqn") == cls) | owner("fqn").startswith(cls + "$")) & (F.col("id") != node["id"])).where(readable_source())
    touched = graph.of_kind("READS", "WRITES").where(F.col("src") == node["id"]).select(F.col("dst").alias("id"), "kind").distinct()
    fields = graph.fields.where(F.col("owner") == cls).join(touched, "id")
    used = graph.of_kind("REF_TYPE").where(F.col("src").isin(node["id"], "t:" + cls)).select(F.col("dst").alias("id")).distinct()
    types = graph.types.join(used, "id", "left_semi")
    members = graph.methods.withColumn("cls", owner("fqn")).join(types.select(F.col("fqn").alias("cls")), "cls",
        "left_semi").groupBy("cls").agg(F.array_sort(F.collect_list("signature")).alias("signatures"))
    return {"siblings": siblings, "fields": fields, "types": types, "signatures": members}


def sibling_bodies(siblings: DataFrame, lines: DataFrame, whole: int = 30, first: int = 10) -> DataFrame:
    """(key, text): members of up to `whole` lines in full, of longer ones the first lines and a mark."""
    long = (F.col("line_end") - F.col("line_start") + 1) > whole
    wanted = siblings.select(F.col("fqn").alias("key"), "file", "line_start",
        F.when(long, F.col("line_start") + first - 1).otherwise(F.col("line_end")).alias("line_end"), long.alias("long"))
    return tx.fragment(lines, wanted).join(wanted.select("key", "long"), "key").select("key",
        F.when(F.col("long"), F.concat("text", F.lit("\n    // ..."))).otherwise(F.col("text")).alias("text"))


#: Parts of a slice's text by mode.
MODES = {"budgeted": ["target", "statistics", "consumers", "members", "long_tail"], "full": ["target", "statistics", "consumers", "members", "long_tail"], "bare": ["target", "consumers"], "spec": ["target", "siblings", "consumers", "members"]}


def slice_report(graph: Graph, target: Target, *, max_chains: int = 5000, cluster_cap: int = 10, coverage: int = 90,
    consumer_cap: int = 5, rank_by_hubs: bool = False, budget: int = 20_000, mode: str = "budgeted") -> dict:
    """Chains, clusters (capped), consumers and a Markdown text for one target: within a budget, `full` without one, `bare` with
    target and consumers alone, or `spec` with the siblings that specify it, helpers left out. `dropped` lists what gave way."""
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}; one of {', '.join(MODES)}")
    node = locate(graph.methods, target)
    names = graph.methods.select(F.col("id").alias("node"), "fqn")
    found = paths(graph, target, max_chains).cache()
    clusters = ch.capped(ch.clusters(found, names), cluster_cap, coverage).cache()
    if rank_by_hubs:
        edges = graph.of_kind("CALLS").select("src", "dst")
        scores = best_by_name(katz(edges, names.select("node")), names)
        clusters = ch.hub_order(clusters, scores)
    consumers = ch.consumers(clusters.where("selected")).limit(consumer_cap)
    parts = {"target": f"# {node['fqn']}\n{node['signature']}", "statistics": sinks.markdown_table(ch.statistics(found)),
        "consumers": "## Consumers\n" + sinks.markdown_table(consumers),
        "members": "## Clusters\n" + sinks.markdown_table(clusters.where("selected").select("entry", "consumer", "n", "tests",
        "depth")), "long_tail": "## Long tail\n" + sinks.markdown_table(clusters.where("not selected").groupBy("consumer").agg(F.count("*").alias("clusters"),
        F.sum("n").alias("chains")).orderBy("consumer"))}
    context = local_context(graph, node)
    if mode == "spec":
        shown = context["siblings"].where(~trimmed_helper(F.concat_ws(" ", F.array_join("modifiers", " "), "signature")))
        parts["siblings"] = "## Siblings\n" + sinks.markdown_table(shown.select("fqn", "signature").orderBy("fqn", "signature"))
    parts = {k: v for k, v in parts.items() if k in MODES[mode]}
    if mode != "budgeted":
        return {"chains": found, "clusters": clusters, "consumers": consumers, "context": context, "dropped": [], "markdown": "\n\n".join(parts.values())}
    table = found.sparkSession.createDataFrame([("doc", k, v) for k, v in parts.items()], "doc string, part string, text string")
    fit = ch.fit_budget(table, budget).first()
    if fit["tier"] is None:
        raise ValueError("the smallest document is over the budget")
    kept = [v for k, v in parts.items() if k not in fit["dropped"]]
    return {"chains": found, "clusters": clusters, "consumers": consumers, "context": context,
        "dropped": [k for k in fit["dropped"] if k in parts], "markdown": "\n\n".join(kept)}


def impact_report(diff: DataFrame, spans: DataFrame, coverage: DataFrame, killers: DataFrame, regions: DataFrame, total_tests: int | None = None) -> dict:
    """What a diff changes, which tests verify it, and where nothing does."""
    changed = im.changed_methods(tx.deleted_lines(diff), spans).cache()
    tiers = im.tiers(changed, coverage, killers).cache()
    rated = im.rated_regions(changed, regions)
    blind = im.blind_spots(changed, coverage, regions, tiers)
    n = {r["tier"]: r["n"] for r in tiers.groupBy("tier").agg(F.count("*").alias("n")).collect()}
    command = " ".join(f"--tests {r['cls']}" for r in ch.test_command_classes(tiers.where("tier > 0")).collect())
    of = f" of {total_tests}" if total_tests else ""
    text = f"# Change impact\n\nChanged methods: {changed.count()}. Affected tests: {n.get(1, 0) + n.get(2, 0)}{of}; {n.get(1, 0)} verify, {n.get(2, 0)} only run.\n\n## Regions\n{sinks.markdown_table(rated.orderBy('method', 'label'))}\n\n## Blind spots\n{sinks.markdown_table(blind.orderBy('kind', 'subject'))}\n\n{command}\n"
    return {"changed": changed, "tiers": tiers, "regions": rated, "blind_spots": blind, "markdown": text}


def crash_report(cases: DataFrame, package: str, spans: DataFrame, statements: DataFrame, guards: DataFrame, data_flow: DataFrame,
    frames: int = 6, most_lines: int = 45) -> dict:
    """The corridor of each exception: its project frames, seed statements, what guards them and where their data comes from.
    `statements` has (method_id, line, id, label, name, code, ord), `guards` and `data_flow` (node, back)."""
    traces = cases.where("not ok and trace is not null").select(F.col("test").alias("trace_id"), "trace")
    all_frames = tx.frames(traces)
    own = tx.root_causes(all_frames, package).where(F.col("cls").startswith(package))
    from ..operators.ranking import first_per_key

    top = first_per_key(own, ["trace_id"], ["frame_ix"], frames)
    from pyspark.sql.window import Window

    by = Window.partitionBy("trace_id").orderBy("frame_ix")
    top = top.withColumns({"deeper_cls": F.lag("cls").over(by), "deeper_method": F.lag("method").over(by),
        "exc": F.when(F.row_number().over(by) == 1, last_dotted("exc_type"))})
    resolved = lo.resolve_methods(top, spans)
    seeds = lo.crash_seeds(lo.statements_at(resolved, statements)).select("trace_id", "frame_ix", "id", "line", "code", "ord")
    key = F.concat_ws("#", "trace_id", F.col("frame_ix").cast("string"))
    starts = seeds.select(key.alias("key"), F.col("id").alias("node"))
    lines = statements.select(F.col("id").alias("node"), "line", "code", "ord")
    guarding = lo.distinct_codes(lo.walk(guards, starts).join(lines, "node"), 3, ["depth", "ord"]).select("key", F.lit("guard").alias("role"), "entry")
    feeding = lo.distinct_codes(lo.walk(data_flow, starts).join(lines, "node"), 4, ["depth", "ord"]).select("key", F.lit("definition").alias("role"), "entry")
    seeded = lo.distinct_codes(seeds.withColumn("key", key), 3, ["ord"]).select("key", F.lit("seed").alias("role"), "entry")
    corridor = seeded.union(guarding).union(feeding)
    rows = corridor.orderBy("key", F.col("role") != "seed", "role", "entry").limit(most_lines).collect()
    return {"frames": top, "corridor": corridor, "markdown": "# Crash slice\n\n" + "\n".join(f"- {r['key']} {r['role']}: `{r['entry']}`" for r in rows)}


def suspects_report(boundary: DataFrame, coverage: DataFrame | None, failing: DataFrame, passing: DataFrame, calls: DataFrame,
    production: DataFrame, hops: int = 3, most: int = 3) -> dict:
    """Ranked suspects behind failing assertions; without a matrix the boundary alone."""
    from ..operators.traverse import reach_with_paths

    if coverage is None:
        ranked = lo.boundary_suspects(boundary, calls, production, most).withColumn("mode", F.lit("BOUNDARY-ONLY"))
    else:
        reach = reach_with_paths(calls, boundary.select(F.col("method").alias("node")), hops).select(F.col("node").alias("method"), "path")
        ranked = lo.suspects(coverage, failing, passing, reach, most).join(reach, "method", "left")
    return {"suspects": ranked, "boundary": lo.aggregate_boundary(boundary), "by_class": lo.failures_by_class(failing),
        "markdown": "# Suspects\n\n" + sinks.markdown_table(ranked.orderBy("rank").withColumn("method",
        class_and_method("method")))}


def pool(target: str, values: DataFrame, coverage: DataFrame, failures: DataFrame, folder: str, pattern: str) -> None:
    """Knowledge graph, failures and universe of a target, written below a folder."""
    covering = im.covering(coverage, target)
    nodes, edges = kg.build(target, values, coverage, failures, covering, kg.exemplars(covering), pattern)
    sinks.write_tables(folder, kg_nodes=nodes, kg_edges=edges, universe=kg.universe_by_class(covering))
    sinks.write_failures(failures, f"{folder}/failures")


def chop_report(files: DataFrame, calls: DataFrame, target: str, max_methods: int = 500, layers: list[str] | None = None) -> dict:
    """The chop of a target from sources (file, content) and named calls (caller, callee, virtual): callers by reverse
    search, each one's control flow and dependences, their composition, and what each target statement touches."""
    from ..functions.predicates import layers as checked
    from ..operators import dependence as dp
    from ..operators.traverse import reachable_callers
    from ..sources import java

    near = reachable_callers(calls, calls.sparkSession.createDataFrame([(target,)], "node string"),
        max_methods=max_methods).select(F.col("node").alias("method"))
    inside = lambda df: df.join(near, "method", "left_semi")
    statements, exprs = inside(java.statements_table(files)).cache(), inside(java.expressions_table(files)).cache()
    flow = dp.control_flow(statements).cache()
    node = lambda c: F.concat_ws("#", "method", F.col(c).cast("string"))
    layer = lambda df, name: df.select(F.lit(name).alias("layer"), node("src").alias("src"), node("dst").alias("dst"))
    pdg = layer(flow, "CFG").union(layer(dp.control_dependence(flow), "CDG")).union(layer(dp.data_dependence(exprs), "DDG"))
    sites = exprs.where("kind = 'CALLSITE'").select("method", F.col("name").alias("callee_name"), node("stmt_ordinal").alias("node")).distinct()
    params = exprs.where("kind = 'PARAM'").select("method", node("stmt_ordinal").alias("node")).distinct()
    returns = exprs.where("kind = 'RETURN_VALUE'").select("method", node("stmt_ordinal").alias("node")).distinct()
    known = calls.join(near.select(F.col("method").alias("caller")), "caller",
        "left_semi").join(near.select(F.col("method").alias("callee")), "callee", "left_semi")
    edges = dp.compose(pdg, known, sites, params, returns).cache()
    own = statements.where(F.col("method") == target).select(node("ordinal").alias("stmt"), node("ordinal").alias("node"))
    bridge = dp.touched(edges, own)
    shown = dp.view(edges, layers=checked(layers) if layers else None)
    return {"methods": near, "statements": statements, "edges": shown, "touched": bridge,
        "cytoscape": sinks.cytoscape(statements.select(node("ordinal").alias("id"), "kind", F.col("text").alias("label")), shown)}


def graph_statements(graph: Graph) -> DataFrame:
    """(method_id, line, id, label, name, code, ord) of a graph's calls, returns and branches, in order of line and id."""
    calls = graph.call_sites.select("method_id", "line", "id", F.lit("CALL").alias("label"), F.col("callee").alias("name"), "code")
    other = graph.statements.select("method_id", "line", "id",
        F.when(F.col("kind") == "RETURN", "RETURN").otherwise("OTHER").alias("label"), F.lit(None).cast("string").alias("name"),
        "code")
    return calls.union(other).withColumn("ord", F.struct("line", "id"))


def crash_from_graph(graph: Graph, cases: DataFrame, package: str) -> dict:
    """crash_report() with spans, statements, guards and data flow of a graph."""
    spans = graph.methods.select("fqn", "id", "file", "line_start", "line_end")
    back = lambda kind: graph.of_kind(kind).select(F.col("dst").alias("node"), F.col("src").alias("back"))
    return crash_report(cases, package, spans, graph_statements(graph), back("CDG"), back("DDG"))


def named_calls(files: DataFrame) -> DataFrame:
    """(caller, callee, virtual) between methods of sources (file, content), by the callee's simple name."""
    from ..sources import java

    methods = java.methods_table(files).select(F.col("fqn").alias("callee"), last_dotted("fqn").alias("name")).distinct()
    sites = java.expressions_table(files).where("kind = 'CALLSITE'").select(F.col("method").alias("caller"), "name").distinct()
    return sites.join(methods, "name").select("caller", "callee", F.lit(False).alias("virtual")).distinct()


#: Sections of a bundle, in order.
SECTIONS = ["target", "direct tests", "focus", "consumer", "target values", "consumer values", "medoids", "snippets", "goldens", "co-covered"]


def bundle_sections(target: str, stub: str, calls: DataFrame, methods: DataFrame, values: DataFrame, coverage: DataFrame,
    failures: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """(section, text, kept, dropped) of all that a bundle about a target shows, capped."""
    from ..operators import pool as pl

    spark = values.sparkSession
    covering = im.covering(coverage, target)
    line = lambda df, section, order, text: df.select(F.lit(section).alias("section"), order.cast("string").alias("ord"), text.alias("line"))
    found = pl.consumer(calls, methods, coverage, target)
    first = found.first()
    direct = pl.callers_of(calls, methods, target).where("is_test")
    out = [
        line(spark.createDataFrame([(target, stub)], "t string, s string"), "target", F.lit(0), F.concat(F.lit("`"), "t", F.lit("`: `"), "s", F.lit("`"))),
        line(direct, "direct tests", F.col("fqn"), F.concat(F.lit("- "), "fqn")),
        line(pl.focus_tests(calls, methods, covering, target), "focus", F.concat_ws(" ", "why", "test"), F.concat(F.lit("- "), "test", F.lit(" ("), "why", F.lit(")"))),
        line(found, "consumer", F.lit(0), F.format_string("- %s shares %s tests, %s of all of both", "method", "shared", "jaccard")),
        line(kg.co_coverage(coverage, target), "co-covered", F.lpad((F.lit(1000) - F.col("jaccard") * 1000).cast("int").cast("string"), 5, "0"), F.format_string("- %s (%s)", "method", "jaccard")),
        line(kg.golden_outputs(failures), "goldens", F.col("test"), F.concat(F.lit("- "), "test", F.lit(": "), "excerpt")),
    ]
    for method, section in ((target, "target values"), (first["method"] if first else None, "consumer values")):
        if method:
            shown = pl.value_lines(values, method, section)
            out.append(shown.select("section", F.lpad(F.col("ord").cast("string"), 20, "0").alias("ord"), "line"))
    if chains is not None:
        clusters = ch.clusters(chains)
        out.append(line(pl.medoids(chains, clusters), "medoids", F.lpad(F.col("rank").cast("string"), 5, "0"), F.concat(F.lit("- "), "path")))
        out.append(line(pl.chain_edges(chains, target), "snippets", F.lpad(F.col("dist").cast("string"), 5, "0"),
            F.format_string("- %s calls %s", "caller", "callee")))
    rows = out[0]
    for o in out[1:]:
        rows = rows.union(o)
    return pl.capped_sections(rows)


def bundle(target: str, stub: str, *tables: DataFrame, chains: DataFrame | None = None) -> str:
    """The bundle of bundle_sections() as one text."""
    from ..operators import pool as pl

    return pl.bundle(bundle_sections(target, stub, *tables, chains=chains), SECTIONS, f"What is known about {target}", stub)


def evaluate(runs: DataFrame, baseline: str) -> dict:
    """Arms of an evaluation: rates with intervals, lifts over a baseline, and a text."""
    from ..operators import stats

    summary = stats.by_arm(runs).join(stats.bootstrap(runs), "arm")
    lifts = stats.lifts(summary, baseline)
    shown = summary.select("arm", "n", F.round("pass_at_one", 3).alias("rate"), F.round("low", 3).alias("low"),
        F.round("high", 3).alias("high"), "cycles_median")
    return {"summary": summary, "lifts": lifts,
        "markdown": f"# Arms\n\n{sinks.markdown_table(shown.orderBy('arm'))}\n\n# Against {baseline}\n\n{sinks.markdown_table(lifts.orderBy('arm'))}\n"}
