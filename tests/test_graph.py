"""Ingestion, traversal and dependence, held against small facts and naive versions."""

import json
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tracewell.functions.names import Target
from tracewell.operators import chains, dependence, traverse
from tracewell.operators.ingest import ingest, virtual_calls
from tracewell.plans import reports
from tracewell.sources import graph, sinks

VERTICES = [
    ("1", "METHOD", {"FULL_NAME": "p.T.t1:void()", "SIGNATURE": "void()", "FILENAME": "src/__t__/java/p/T.java", "LINE_NUMBER": 3, "LINE_NUMBER_END": 6, "IS_TEST": "true"}),
    ("2", "METHOD", {"FULL_NAME": "p.C.target:int(int)", "SIGNATURE": "int(int)", "FILENAME": "src/main/java/p/C.java", "LINE_NUMBER": 5, "LINE_NUMBER_END": 9}),
    ("3", "TYPE_DECL", {"FULL_NAME": "p.C", "FILENAME": "src/main/java/p/C.java"}),
    ("4", "CALL", {"METHOD_FULL_NAME": "p.C.target:int(int)", "LINE_NUMBER": "4", "CODE": "c.target(1)", "PARENT_METHOD_ID": "1"}),
    ("5", "LITERAL", {"CODE": "1", "LINE_NUMBER": 4, "PARENT_METHOD_ID": "1"}),
]
EDGES = [("CALL", "4", "2"), ("AST", "1", "4"), ("REACHING_DEF", "5", "4"), ("CALL", "4", "99")]


def flat(vertices=VERTICES, edges=EDGES):
    return {"vertices": [{"id": i, "label": k, "properties": p} for i, k, p in vertices], "edges": [{"label": k, "outV": a, "inV": b} for k, a, b in edges]}


def wrapped():
    v = lambda x: {"@type": "g:Int32", "@value": x} if isinstance(x, int) else x
    prop = lambda x: {"@type": "g:List", "@value": [{"@type": "g:VertexProperty", "@value": {"value": v(x)}}]}
    vertices = [{"@type": "g:Vertex", "@value": {"id": v(int(i)), "label": k, "properties": {n: prop(x) for n, x in p.items()}}} for i, k, p in VERTICES]
    edges = [{"@type": "g:Edge", "@value": {"label": k, "outV": v(int(a)), "inV": v(int(b))}} for k, a, b in EDGES]
    return {"@type": "tinker:graph", "@value": {"vertices": vertices, "edges": edges}}


@pytest.mark.parametrize("form", [flat, wrapped])
def test_ingest_both_forms(spark, tmp_path, form):
    (tmp_path / "g.json").write_text(json.dumps(form()))
    g = ingest(*graph.read(spark, str(tmp_path / "g.json")))
    assert g.nodes().count() == 5
    assert sorted((r["kind"], r["src"], r["dst"]) for r in g.edges.collect() if r["kind"] in ("CALLS", "DDG")) == [("CALLS", "m:p.T.t1:void()", "m:p.C.target:int(int)"), ("DDG", "lit:5", "cs:4")]
    t = g.methods.where("fqn = 'p.T.t1'").first()
    assert t["is_test"] and t["file"] == "src/test/java/p/T.java" and (t["line_start"], t["line_end"]) == (3, 6)
    found = reports.paths(g, Target.parse("p.C#target(int)")).collect()
    assert [(r["test"], r["depth"]) for r in found] == [("m:p.T.t1:void()", 1)]


def test_enclosing_method_by_tree(spark):
    vertices = [("1", "METHOD", {"FULL_NAME": "p.A.m:void()"}), ("2", "BLOCK", {}), ("3", "LITERAL", {"CODE": "7"})]
    edges = [("AST", "1", "2"), ("AST", "2", "3")]
    path = __import__("tempfile").mkdtemp() + "/g.json"
    open(path, "w").write(json.dumps(flat(vertices, edges)))
    g = ingest(*graph.read_flat(spark, path))
    assert g.literals.first()["method_id"] == "m:p.A.m:void()"


def naive(calls, target, tests):
    """Breadth-first tree from the target and test edges into it: (test, entry, depth)."""
    back = {}
    for a, b in calls:
        back.setdefault(b, set()).add(a)
    depth, queue = {target: 0}, deque([target])
    while queue:
        n = queue.popleft()
        if n in tests and n != target:
            continue
        for a in back.get(n, ()):
            if a not in depth and a != n:
                depth[a] = depth[n] + 1
                queue.append(a)
    return {(t, b, depth[b] + 1) for t, b in calls if t in tests and t != b and b in depth and (b not in tests or b == target)}


def test_chains_equal_naive_on_random_graphs(spark):
    rng = random.Random(4)
    for _ in range(6):
        n = rng.randint(3, 9)
        calls = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, 20))}
        tests = {x for x in range(n) if rng.random() < 0.3}
        df = spark.createDataFrame([(str(a), str(b), False, i) for i, (a, b) in enumerate(sorted(calls))], "caller string, callee string, virtual boolean, ord long")
        t = spark.createDataFrame([(str(x),) for x in tests], "node string")
        want = {(str(a), str(b), d) for a, b, d in naive(calls, 0, tests)}
        assert {tuple(r) for r in traverse.entry_depths(df, spark.createDataFrame([("0",)], "node string"), t).collect()} == want
        full = traverse.reverse_chains(df, "0", t).collect()
        assert {(r["test"], r["steps"][0]["callee"], r["depth"]) for r in full} == want and len(full) == len(want)
        for r in full:
            assert r["steps"][-1]["callee"] == "0" and all(a["callee"] == b["caller"] for a, b in zip(r["steps"], r["steps"][1:]))


def test_virtual_calls_and_diamond(spark):
    direct = spark.createDataFrame([("t1", "I.do", 0)], "caller string, callee string, ord long")
    over = spark.createDataFrame([("Impl.do", "I.do")], "child string, parent string")
    calls = virtual_calls(direct, over)
    tests = spark.createDataFrame([("t1",)], "node string")
    r = traverse.reverse_chains(calls, "Impl.do", tests).collect()
    assert len(r) == 1 and r[0]["virtual_steps"] == 1
    diamond = spark.createDataFrame([("t", "a", False, 0), ("a", "b", False, 1), ("a", "c", False, 2), ("b", "d", False, 3), ("c", "d", False, 4)], "caller string, callee string, virtual boolean, ord long")
    assert traverse.reverse_chains(diamond, "d", spark.createDataFrame([("t",)], "node string")).count() == 1
    edges = diamond.selectExpr("caller as src", "callee as dst")
    one = lambda x: spark.createDataFrame([(x,)], "node string")
    assert sorted(map(tuple, (r["path"] for r in traverse.simple_paths(spark, edges, one("t"), one("d")).collect()))) == [("t", "a", "b", "d"), ("t", "a", "c", "d")]


def test_katz_prefers_hubs_and_limits_fail(spark):
    edges = spark.createDataFrame([("l1", "hub"), ("l2", "hub"), ("l3", "hub"), ("hub", "t"), ("t", "t")], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in ("l1", "l2", "l3", "hub", "t")], "node string")
    s = {r["node"]: r["score"] for r in traverse.katz(edges, nodes).collect()}
    assert s["hub"] > s["t"] > s["l1"] == 1.0 and s["hub"] == pytest.approx(1.03)
    calls = edges.selectExpr("src as caller", "dst as callee")
    with pytest.raises(traverse.TooMany):
        traverse.reachable_callers(calls, spark.createDataFrame([("t",)], "node string"), max_methods=2).count()


def test_control_and_data_dependence(spark):
    rows = [("m", 0, "DECL", -1, "body"), ("m", 1, "IF", -1, "body"), ("m", 2, "EXPR", 1, "then"), ("m", 3, "RETURN", -1, "body")]
    cfg = dependence.control_flow(spark.createDataFrame(rows, "method string, ordinal int, kind string, parent int, branch string"))
    assert sorted((r["src"], r["dst"]) for r in cfg.collect()) == [(0, 1), (1, 2), (1, 3), (2, 3)]
    assert [(r["src"], r["dst"]) for r in dependence.control_dependence(cfg).collect()] == [(1, 2)]
    exprs = spark.createDataFrame([("m", 0, "LOCAL_DEF", "x", 1, 1), ("m", 1, "LOCAL_USE", "x", 2, 1), ("m", 2, "LOCAL_DEF", "x", 3, 1), ("m", 3, "LOCAL_USE", "x", 4, 1)], "method string, stmt_ordinal int, kind string, name string, line int, col int")
    assert sorted((r["src"], r["dst"]) for r in dependence.data_dependence(exprs).collect()) == [(0, 1), (2, 3)]


def test_touched_and_composition(spark):
    pdg = spark.createDataFrame([("DDG", "a1", "a2"), ("DDG", "b1", "b2")], "layer string, src string, dst string")
    calls = spark.createDataFrame([("A.a", "B.b", False)], "caller string, callee string, virtual boolean")
    sites = spark.createDataFrame([("A.a", "b", "a2")], "method string, callee_name string, node string")
    params, returns = spark.createDataFrame([("B.b", "b1")], "method string, node string"), spark.createDataFrame([("B.b", "b2")], "method string, node string")
    g = dependence.compose(pdg, calls, sites, params, returns)
    assert {(r["layer"], r["src"], r["dst"]) for r in g.collect()} >= {("CG", "a2", "m:B.b"), ("ARG_PASS", "a2", "b1"), ("RETURN_BIND", "b2", "a2")}
    bridge = dependence.touched(g, spark.createDataFrame([("s", "b2")], "stmt string, node string"))
    assert {r["node"] for r in bridge.collect()} == {"b2", "b1", "a2", "a1", "m:B.b"}
    assert dependence.view(g, bridge, ["DDG"], "s").count() == 2


def test_clusters_caps_and_budget(spark):
    step = lambda a, b: (a, b, False)
    rows = [(i, f"p.T.t{i}", 2, 0, [step(f"t{i}", "x"), step("x", "y")]) for i in range(5)] + [(9, "p.T.t9", 2, 0, [step("t9", "z"), step("z", "y")])]
    df = spark.createDataFrame(rows, "chain_id long, test string, depth int, virtual_steps int, steps array<struct<caller:string,callee:string,virtual:boolean>>")
    c = chains.clusters(df)
    assert {(tuple(r["signature"]), r["n"], r["consumer"]) for r in c.collect()} == {(("x", "y"), 5, "x"), (("z", "y"), 1, "z")}
    assert [r["n"] for r in chains.capped(c).where("selected").collect()] == [5]
    parts = spark.createDataFrame([("d", "target", "x" * 400), ("d", "long_tail", "x" * 400), ("d", "snippets", "x" * 400)], "doc string, part string, text string")
    fit = lambda n: chains.fit_budget(parts, n).first()
    assert (fit(300)["tier"], fit(250)["tier"], fit(100)["tier"], fit(50)["tier"]) == (0, 1, 2, None)
    assert fit(100)["dropped"] == ["long_tail", "snippets"]


def test_signals(spark):
    schema = "cluster string, member int, args array<string>, oracle_kind string, expected string, message string, type string"
    rows = [("c", 1, ['"alpha"', "1"], "EQUALS", "got alpha", None, None), ("c", 2, ['"beta"', "1"], "EQUALS", "got beta", None, None), ("e", 1, ["1"], "EXCEPTION", None, None, "X"), ("e", 2, ["2"], "EXCEPTION", None, None, "X"), ("one", 1, ["1"], "NONE", None, None, None)]
    got = {(r["cluster"], r["signal"]) for r in chains.signals(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("c", "arg1_invariant_in_cluster"), ("c", "arg0_propagates_to_oracle"), ("c", "oracle_varies_only_with_arg0"), ("e", "exception_type_consistent_across_cluster"), ("e", "oracle_independent_of_target_args")}
    slices = spark.createDataFrame([("c", 1, "n", "RESOLVED"), ("c", 0, "s", "UNRESOLVED")], "cluster string, arg_index int, name string, kind string")
    got = {r["signal"] for r in chains.signals(spark.createDataFrame(rows, schema), slices).where("cluster = 'c'").collect()}
    assert "arg1_invariant_in_cluster" not in got and {"n_resolves_to_literal", "s_requires_dynamic_value", "cluster_partial_resolution"} <= got


def test_sinks_round_trip(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps(flat()))
    v, e = graph.read_flat(spark, str(tmp_path / "g.json"))
    sinks.flat_document(v, e, str(tmp_path / "h.json"))
    again = graph.read_flat(spark, str(tmp_path / "h.json"))
    assert sorted(map(tuple, again[0].collect()), key=str) == sorted(map(tuple, v.collect()), key=str) and again[1].count() == 4
    g = ingest(v, e)
    nodes = g.methods.selectExpr("id", "'METHOD' as kind", "fqn as label")
    edges = g.of_kind("CALLS").select("src", "dst", "kind")
    sinks.graphml(nodes, edges, str(tmp_path / "g.xml"))
    sinks.dot(nodes, edges, str(tmp_path / "g.dot"))
    sinks.html_page(nodes, edges, str(tmp_path / "g.html"))
    assert (tmp_path / "g.xml").read_text().count("<edge ") == 1 and "->" in (tmp_path / "g.dot").read_text()
    out = reports.slice_report(g, Target.parse("p.C#target"))
    assert out["markdown"].startswith("# p.C.target")
    doc = json.loads(sinks.chains_document(out["chains"], "p.C#target"))
    assert doc["stats"]["chains"] == 1
    with pytest.raises(reports.NotFound):
        reports.locate(g.methods, Target.parse("p.C#targte"))
