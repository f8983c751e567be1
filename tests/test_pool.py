"""Bundles, modes and commands over small facts."""

import json

import pytest

from tests.test_graph import EDGES, VERTICES, flat
from tracewell import cli
from tracewell.functions.names import Target
from tracewell.operators import pool
from tracewell.operators.ingest import enclosing_methods, ingest
from tracewell.plans import reports
from tracewell.sources import graph, sinks

CHAIN = "chain_id long, test string, depth int, virtual_steps int, steps array<struct<caller:string,callee:string,virtual:boolean>>"
JAVA = """package p;
class C {
  int target(int a) {
    int x = a;
    if (x > 1) {
      x = help(x);
    }
    return x;
  }
  int help(int b) { return b; }
}
class T {
  @Test void t1() { new C().target(2); }
}
"""


def test_paths_and_edges_of_chains(spark):
    steps = [("p.T.t", "p.A.a", False), ("p.A.a", "p.examples.X.x", False), ("p.examples.X.x", "p.A.b", False), ("p.A.b", "p.A.b", False), ("p.A.b", "p.C.target", False)]
    rows = spark.createDataFrame([(0, "p.T.t", 5, 0, steps), (1, "p.T.u", 2, 0, [("p.T.u", "p.A.b", False), ("p.A.b", "p.C.target", False)])], CHAIN)
    from tracewell.operators import chains

    paths = {r["test"]: r["path"] for r in pool.medoids(rows, chains.clusters(rows)).collect()}
    assert paths == {"p.T.t": "T.t → A.a → A.b → C.target", "p.T.u": "T.u → A.b → C.target"}
    assert [(r["caller"], r["callee"], r["dist"], r["more"]) for r in pool.chain_edges(rows, "p.C.target").collect()] == [("p.A.b", "p.C.target", 0, 0)]
    wanted = spark.createDataFrame([("p.A.b", "p.T.u"), ("elsewhere", "p.T.t")], "entry string, test string")
    assert {(r["entry"], r["chain_id"]) for r in pool.representatives(rows, wanted).collect()} == {("p.A.b", 1), ("elsewhere", 0)}


def test_windows_around_calls(spark):
    code = "\n".join(["void f() {", *[f"  line{i};" for i in range(20)], "  go(1);", *[f"  more{i};" for i in range(20)], "}"])
    got = spark.createDataFrame([(code, "go"), ("a\nb", "go"), (code, "none")], "code string, callee string").select(pool.call_window("code", "callee").alias("c")).collect()
    lines = got[0]["c"].split("\n")
    assert len(lines) <= 10 and lines[0] == "void f() {" and lines[1] == "    // ..." and "  go(1);" in lines and lines[-1] == "    // ..."
    assert got[1]["c"] == "a\nb" and got[2]["c"].split("\n")[-1] == "}"


def test_bundle_shows_stub_and_counts(spark, tmp_path):
    calls = spark.createDataFrame([("p.T.t1", "p.C.target"), ("p.D.use", "p.C.target"), ("p.E.use", "p.C.target")], "caller string, callee string")
    methods = spark.createDataFrame([("p.T.t1", True), ("p.D.use", False), ("p.E.use", False)], "fqn string, is_test_code boolean")
    values = spark.createDataFrame([("p.C.target", None, [str(i)], "r", False, i) for i in range(15)] + [("p.D.use", None, ["7"], "s", False, 99)], "method string, test string, args array<string>, result string, throws boolean, ord long")
    cov = spark.createDataFrame([("p.C.target", "p.T.t1"), ("p.C.target", "p.CTest.x"), ("p.D.use", "p.T.t1"), ("p.E.use", "q")], "method string, test string")
    fails = spark.createDataFrame([("p.T.t1", "org.junit.ComparisonFailure", "expected:<" + "x" * 45 + "\\n > but was:<z>")], "test string, type string, message string")
    text = reports.bundle("p.C.target", "throw stub();", calls, methods, values, cov, fails)
    assert "left out: 3 target values" in text and "p.D.use shares 1 tests" in text and "- p.T.t1 (direct)" in text and "- `(7) => s`" in text
    assert text.index("## target") < text.index("## focus") < text.index("## goldens") and "x" * 45 in text
    sections = reports.bundle_sections("p.C.target", "stub", calls, methods, values, cov, fails)
    with pytest.raises(ValueError):
        pool.bundle(sections, reports.SECTIONS, "t", "no such marker")
    document = spark.createDataFrame([(1, "# A")], "n long, text string")
    assert [r["text"] for r in pool.with_examples(document, values, "p.D.use").orderBy("n").collect()][-1] == "- `use(7) => s`"
    assert pool.with_examples(document, values, "p.None.x").count() == 1


def test_ladder(spark):
    parts = spark.createDataFrame([("d", "call_sites", "x" * 40), ("d", "body", "x" * 40)], "doc string, part string, text string")
    chains = spark.createDataFrame([("d", k, "x" * 40) for k in range(1, 5)], "doc string, rank int, text string")
    plan = lambda n: tuple(pool.ladder_plan(parts, chains, n).first())
    assert plan(60) == ("d", [], 4, 60) and plan(50) == ("d", ["call_sites"], 4, 50) and plan(35) == ("d", pool.LADDER, 2, 30) and plan(5) == ("d", pool.LADDER, 1, None)


def test_modes_and_stamp(spark, tmp_path):
    extra = [("6", "METHOD", {"FULL_NAME": "p.C.other:int(int)", "SIGNATURE": "int(int)", "FILENAME": "src/main/java/p/C.java", "LINE_NUMBER": 11, "LINE_NUMBER_END": 12})]
    (tmp_path / "g.json").write_text(json.dumps(flat(VERTICES + extra, EDGES)))
    g = ingest(*graph.read(spark, str(tmp_path / "g.json")))
    text = {m: reports.slice_report(g, Target.parse("p.C#target"), mode=m)["markdown"] for m in reports.MODES}
    assert "## Clusters" in text["full"] and "## Clusters" not in text["bare"] and "p.C.other" in text["spec"]
    with pytest.raises(ValueError):
        reports.slice_report(g, Target.parse("p.C#target"), mode="none")
    found = reports.paths(g, Target.parse("p.C#target"))
    assert "generated_at" in json.loads(sinks.chains_document(found, "t", stamp=True)) and "generated_at" not in json.loads(sinks.chains_document(found, "t"))


def test_deep_trees_and_rings(spark):
    deep = [("AST", "m", "n0")] + [("AST", f"n{i}", f"n{i + 1}") for i in range(30)] + [("AST", "a", "b"), ("AST", "b", "a")]
    vertices = spark.createDataFrame([("m", "METHOD", None)] + [(f"n{i}", "CALL", None) for i in range(31)] + [("a", "CALL", None), ("b", "CALL", None)], "id string, label string, parent_method_id string")
    got = {r["raw"]: r["method_raw"] for r in enclosing_methods(vertices, spark.createDataFrame(deep, "label string, out_v string, in_v string")).collect()}
    assert got == {f"n{i}": "m" for i in range(31)}


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/C.java").write_text(JAVA)
    assert cli.main(["chop", "--sources", str(tmp_path / "src"), "--target", "p.C.target", "--out", str(tmp_path / "chop")]) == 0
    touched = spark.read.parquet(str(tmp_path / "chop/touched"))
    assert touched.where("stmt = 'p.C.target#3'").count() > 1
    branch = ("7", "CONTROL_STRUCTURE", {"CONTROL_STRUCTURE_TYPE": "IF", "LINE_NUMBER": 6, "CODE": "if (x)", "PARENT_METHOD_ID": "2"})
    call = ("8", "CALL", {"METHOD_FULL_NAME": "p.C.help:int(int)", "LINE_NUMBER": 7, "CODE": "help(x)", "PARENT_METHOD_ID": "2"})
    (tmp_path / "g.json").write_text(json.dumps(flat([*VERTICES, branch, call], [*EDGES, ("CDG", "7", "8")])))
    trace = "p.Bad: no\n\tat p.C.target(C.java:7)\n\tat p.T.t1(T.java:4)"
    (tmp_path / "r.xml").write_text(f'<testsuite><testcase classname="p.T" name="t1"><error type="p.Bad" message="no">{trace}</error></testcase></testsuite>')
    assert cli.main(["crash", "--graph", str(tmp_path / "g.json"), "--junit", str(tmp_path / "r.xml"), "--package", "p."]) == 0
    out = capsys.readouterr().out
    assert "seed: `L7: help(x)`" in out and "guard: `L6: if (x)`" in out
    runs = [{"arm": a, "target": "t", "seed": i, "passed": i % 4 > 0 or a == "new", "cycles": i} for a in ("old", "new") for i in range(40)]
    (tmp_path / "runs.json").write_text("\n".join(map(json.dumps, runs)))
    assert cli.main(["eval", "--runs", str(tmp_path / "runs.json"), "--baseline", "old"]) == 0
    assert "| new | 0.25 | True |" in capsys.readouterr().out
    (tmp_path / "cov.json").write_text(json.dumps({"p.C.target": ["p.T.t1"]}))
    (tmp_path / "values.txt").write_text("p.C.target\tp.T.t1\t1 | 2\t=> 3\n")
    common = ["--coverage", str(tmp_path / "cov.json"), "--values", str(tmp_path / "values.txt"), "--junit", str(tmp_path / "r.xml"), "--target", "p.C.target"]
    assert cli.main(["bundle", *common, "--graph", str(tmp_path / "g.json"), "--stub", "throw stub();", "--out", str(tmp_path / "b.md")]) == 0
    assert "- `(1, 2) => 3`" in (tmp_path / "b.md").read_text() and "- p.T.t1 (direct)" in (tmp_path / "b.md").read_text()
    assert cli.main(["pool", *common, "--pattern", "x(\\d+)y(\\d+)", "--out", str(tmp_path / "pool")]) == 0
    assert spark.read.parquet(str(tmp_path / "pool/kg_nodes")).count() > 1
