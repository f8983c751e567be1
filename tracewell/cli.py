"""Command line: paths, slice, inspect, impact, ingest, chop, crash, bundle, pool, eval. Exit codes: 2 no or several methods,
3 over budget, 4 over a limit."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from .functions.names import Target
from .operators.ingest import ingest
from .operators.traverse import TooMany
from .plans import reports
from .session import local_session
from .sources import facts, graph, sinks, text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracewell")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("paths", "slice", "inspect", "ingest"):
        c = sub.add_parser(name)
        c.add_argument("--graph", required=True, help="exported graph document")
        c.add_argument("--out", required=name != "paths")
        if name in ("paths", "slice"):
            c.add_argument("--target", required=True)
            c.add_argument("--max-chains", type=int, default=5000)
        if name == "paths":
            c.add_argument("--max-print", type=int, default=50)
        if name == "slice":
            c.add_argument("--budget-tokens", type=int, default=20_000)
            c.add_argument("--cluster-cap", type=int, default=10)
            c.add_argument("--cluster-coverage", type=int, default=90)
            c.add_argument("--consumer-cap", type=int, default=5)
            c.add_argument("--katz-rank", action="store_true")
            c.add_argument("--mode", choices=list(reports.MODES), default="budgeted")
            c.add_argument("--stamp", action="store_true", help="note the time in the graph document")
        if name == "inspect":
            c.add_argument("--graphml", action="store_true")
            c.add_argument("--dot", action="store_true")
    c = sub.add_parser("impact")
    for x in ("coverage", "mutation", "methods"):
        c.add_argument(f"--{x}", required=True)
    c.add_argument("--diff")
    c.add_argument("--repo")
    c.add_argument("--base", default="HEAD")
    c.add_argument("--total-tests", type=int)
    c = sub.add_parser("chop", help="what a target's statements depend on, from sources")
    c.add_argument("--sources", required=True)
    c.add_argument("--target", required=True, help="qualified method name")
    c.add_argument("--layers", nargs="*")
    c.add_argument("--max-methods", type=int, default=500)
    c.add_argument("--out", required=True)
    c = sub.add_parser("crash", help="corridors of failing tests, from a graph and test results")
    c.add_argument("--graph", required=True)
    c.add_argument("--junit", required=True)
    c.add_argument("--package", required=True)
    for name in ("pool", "bundle"):
        c = sub.add_parser(name)
        for x in ("coverage", "values", "junit", "target", "out"):
            c.add_argument(f"--{x}", required=True)
        if name == "pool":
            c.add_argument("--pattern", required=True, help="how results name a place: two groups of digits")
        else:
            c.add_argument("--graph", required=True)
            c.add_argument("--stub", required=True, help="the line that stands for the target's body")
    c = sub.add_parser("eval", help="arms of an evaluation, from lines of JSON")
    c.add_argument("--runs", required=True)
    c.add_argument("--baseline", required=True)
    return p


def _other(spark, args) -> None:
    """Commands that need no model of a graph, or make it themselves."""
    from .sources import reports as xml

    if args.command == "chop":
        files = text.read_sources(spark, args.sources)
        out = reports.chop_report(files, reports.named_calls(files), args.target, args.max_methods, args.layers)
        sinks.write_tables(args.out, methods=out["methods"], statements=out["statements"], touched=out["touched"], cytoscape=out["cytoscape"])
    elif args.command == "crash":
        g = ingest(*graph.read(spark, args.graph))
        print(reports.crash_from_graph(g, xml.test_cases(spark, args.junit), args.package)["markdown"])
    elif args.command == "eval":
        runs = spark.read.schema("arm string, target string, seed long, passed boolean, cycles long").json(args.runs)
        print(reports.evaluate(runs, args.baseline)["markdown"])
    else:
        values, coverage = facts.captured_values(spark, args.values, 100), facts.coverage(spark, args.coverage)
        failures = xml.failures(xml.test_cases(spark, args.junit))
        if args.command == "pool":
            reports.pool(args.target, values, coverage, failures, args.out, args.pattern)
        else:
            from .functions.predicates import test_code

            g = ingest(*graph.read(spark, args.graph))
            names = g.methods.select(F.col("id"), "fqn")
            calls = g.calls().join(names.select(F.col("id").alias("caller"), F.col("fqn").alias("a")), "caller").join(names.select(F.col("id").alias("callee"), F.col("fqn").alias("b")), "callee").select(F.col("a").alias("caller"), F.col("b").alias("callee"))
            sinks.write_atomic(args.out, reports.bundle(args.target, args.stub, calls, test_code(g.methods).select("fqn", "is_test_code"), values, coverage, failures))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = local_session()
    try:
        if args.command == "impact":
            raw = open(args.diff).read() if args.diff else text.git_diff(args.repo or ".", args.base)
            killers, regions = facts.mutation(spark, args.mutation)
            print(reports.impact_report(text.numbered(spark, raw), facts.spans(spark, args.methods), facts.coverage(spark, args.coverage), killers, regions, args.total_tests)["markdown"])
            return 0
        if args.command in ("chop", "crash", "pool", "bundle", "eval"):
            _other(spark, args)
            return 0
        g = ingest(*graph.read(spark, args.graph))
        if args.command == "ingest":
            sinks.write_tables(args.out, methods=g.methods, types=g.types, fields=g.fields, params=g.params, call_sites=g.call_sites, statements=g.statements, literals=g.literals, edges=g.edges)
        elif args.command == "inspect":
            nodes = g.methods.selectExpr("id", "'METHOD' as kind", "fqn as label").union(g.types.selectExpr("id", "'TYPE' as kind", "fqn as label"))
            edges = g.multigraph().select("src", "dst", "kind")
            sinks.html_page(nodes, edges, f"{args.out}.html")
            if args.graphml:
                sinks.graphml(nodes, edges, f"{args.out}.graphml")
            if args.dot:
                sinks.dot(nodes, edges, f"{args.out}.dot")
        elif args.command == "paths":
            found = reports.paths(g, Target.parse(args.target), args.max_chains)
            for r in sinks.chain_text(found).orderBy("chain_id").limit(args.max_print).collect():
                print(r["text"])
            if args.out:
                sinks.sidecar(found, args.out)
        else:
            out = reports.slice_report(g, Target.parse(args.target), max_chains=args.max_chains, cluster_cap=args.cluster_cap, coverage=args.cluster_coverage, consumer_cap=args.consumer_cap, rank_by_hubs=args.katz_rank, budget=args.budget_tokens, mode=args.mode)
            sinks.write_atomic(f"{args.out}.md", out["markdown"])
            sinks.write_atomic(f"{args.out}.graph.json", sinks.chains_document(out["chains"], args.target, stamp=args.stamp))
            sinks.sidecar(out["chains"], f"{args.out}.json")
    except (reports.NotFound, reports.Ambiguous) as e:
        print(e, file=sys.stderr)
        return 2
    except TooMany as e:
        print(e, file=sys.stderr)
        return 4
    except ValueError as e:
        print(e, file=sys.stderr)
        return 3
    return 0


if __name__ == "__main__":
    sys.exit(main())
