"""Reports, diffs, traces, impact, localisation, knowledge and statistics."""

import json

import pytest

from tracewell.functions import names, predicates
from tracewell.operators import impact, knowledge, localize, ranking, stats
from tracewell.plans import reports
from tracewell.sources import facts, reports as xml, sinks, text


def lines(spark, s):
    return text.numbered(spark, s)


DIFF = """diff --git a/A.java b/A.java
--- a/A.java
+++ b/A.java
@@ -10,4 +10,5 @@
 context
-gone
+new
+more
 context
-gone too
@@ -30,0 +31,2 @@
+only new
+lines
--- a/B.java
+++ b/B.java
@@ -5 +5 @@
-x
+y
"""


def test_diff_counts_base_lines(spark):
    got = {(r["file"], r["line"]) for r in text.deleted_lines(lines(spark, DIFF)).collect()}
    assert got == {("A.java", 11), ("A.java", 13), ("A.java", 30), ("B.java", 5)}
    spans = spark.createDataFrame([("p.A.m", "A.java", 25, 31), ("p.A.n", "A.java", 40, 50), ("p.B.x", "B.java", 5, 5)], "fqn string, file string, line_start int, line_end int")
    assert {r["method"] for r in impact.changed_methods(text.deleted_lines(lines(spark, DIFF)), spans).collect()} == {"p.A.m", "p.B.x"}


TRACE = """java.lang.RuntimeException: outer: text
\tat org.junit.Runner.run(Runner.java:10)
Caused by: java.lang.IllegalStateException: bad
\tat p.Tbl.get(Tbl.java:41)
\tat p.TblTest.reads(TblTest.java:9)
\t... 3 more
Caused by: java.io.IOException
\tat java.io.File.open(File.java)
"""


def test_traces(spark):
    df = text.frames(spark.createDataFrame([("t", TRACE)], "trace_id string, trace string"))
    rows = df.orderBy("cause_ix", "frame_ix").collect()
    assert [(r["cause_ix"], r["exc_type"], r["frame_ix"], r["cls"], r["line"]) for r in rows] == [(0, "java.lang.RuntimeException", 0, "org.junit.Runner", 10), (1, "java.lang.IllegalStateException", 0, "p.Tbl", 41), (1, "java.lang.IllegalStateException", 1, "p.TblTest", 9), (2, "java.io.IOException", 0, "java.io.File", -1)]
    assert {r["cause_ix"] for r in text.root_causes(df, "p.").collect()} == {1}


def test_xml_and_tables(spark, tmp_path):
    (tmp_path / "j.xml").write_text('<report name="x"><package name="p/q"><sourcefile name="A.java"><line nr="10" mi="0" ci="2" mb="0" cb="0"/><line nr="12" mi="1" ci="0" mb="0" cb="0"/></sourcefile></package></report>')
    ex = xml.execution(spark, str(tmp_path / "j.xml"))
    assert [(r["file"], r["line"]) for r in xml.executed(ex).collect()] == [("p/q/A.java", 10)]
    spans = spark.createDataFrame([("p.q.A.m", "src/main/java/p/q/A.java", 9, 11), ("z.A.m", "src/main/java/z/A.java", 9, 11)], "fqn string, file string, line_start int, line_end int")
    assert [tuple(r) for r in xml.coverage_from_execution(ex, spans).collect()] == [("p.q.A.m", "j")]
    (tmp_path / "m.xml").write_text('<mutations><mutation detected="true"><mutatedClass>p.A</mutatedClass><mutatedMethod>m</mutatedMethod><lineNumber>12</lineNumber><killingTest>p.T.a(p.T)</killingTest></mutation><mutation detected="true"><mutatedClass>p.A</mutatedClass><mutatedMethod>m</mutatedMethod><lineNumber>12</lineNumber><killingTest>p.T.b</killingTest></mutation><mutation detected="false"><mutatedClass>p.A</mutatedClass><mutatedMethod>m</mutatedMethod><lineNumber>6</lineNumber><killingTest/></mutation></mutations>')
    mu = xml.mutants(spark, str(tmp_path / "m.xml"))
    assert {(r["line"], r["killers"]) for r in impact.regions(mu).collect()} == {(12, 2), (6, 0)}
    assert {r["test"] for r in impact.killers(mu).collect()} == {"p.T.a", "p.T.b"}
    (tmp_path / "t.xml").write_text('<testsuite><testcase classname="p.T" name="ok"/><testcase classname="p.T" name="bad"><failure type="E" message="m">trace</failure></testcase><testcase classname="p.T" name="no"><skipped/></testcase></testsuite>')
    cases = xml.test_cases(spark, str(tmp_path / "t.xml"))
    assert {(r["test"], r["ok"]) for r in cases.collect()} >= {("p.T.ok", True), ("p.T.bad", False)}
    assert [tuple(r) for r in xml.failures(cases).collect()] == [("p.T.bad", "E", "m")]
    (tmp_path / "v.tsv").write_text("p.A.m\tp.T.a\t1 | 2 | x\t=> r\np.A.m\t1 | 2 | x\t=> r\np.A.m\t-\t3 | 4\t=> throws E: no\nbroken line\n")
    got = facts.captured_values(spark, str(tmp_path / "v.tsv"), 5).orderBy("ord").collect()
    assert [(r["test"], r["args"], r["throws"]) for r in got] == [("p.T.a", ["1", "2", "x"], False), (None, ["3", "4"], True)]
    (tmp_path / "c.tsv").write_text("m\tt1\touter\nm\tt2\tinner\n")
    assert facts.capture_matrix(spark, str(tmp_path / "c.tsv")).count() == 1 and facts.capture_matrix(spark, str(tmp_path / "c.tsv"), "all").count() == 2


def test_impact_documents(spark, tmp_path):
    (tmp_path / "coverage.json").write_text(json.dumps({"A.m": ["wrap", "bounds", "cover_only"], "A.n": ["x"]}))
    (tmp_path / "mutation.json").write_text(json.dumps({"A.m": {"killers": ["wrap", "bounds", "ghost"], "regions": [{"label": "empty", "lines": [3, 4], "killers": 0}, {"label": "a", "lines": [5], "killers": 1}, {"label": "b", "lines": [6], "killers": 284}]}}))
    cov = facts.coverage(spark, str(tmp_path / "coverage.json"))
    kil, reg = facts.mutation(spark, str(tmp_path / "mutation.json"))
    changed = spark.createDataFrame([("A.m",)], "method string")
    tiers = impact.tiers(changed, cov, kil)
    assert {tuple(r) for r in tiers.collect()} == {("wrap", 1), ("bounds", 1), ("cover_only", 2), ("ghost", 0)}
    assert {(r["label"], r["strength"]) for r in impact.rated_regions(changed, reg).collect()} == {("empty", "UNVERIFIED"), ("a", "weak"), ("b", "strong")}
    assert {tuple(r) for r in impact.blind_spots(changed, cov, reg, tiers).collect()} == {("unverified", "A.m: empty"), ("mismatch", "ghost")}
    spans = spark.createDataFrame([("A.m", "A.java", 1, 40)], "fqn string, file string, line_start int, line_end int")
    out = reports.impact_report(lines(spark, DIFF), spans, cov, kil, reg, 10)
    assert "Affected tests: 3 of 10; 2 verify, 1 only run." in out["markdown"]
    sinks.write_facts(str(tmp_path / "out"), spans, cov, kil, reg)
    assert facts.coverage(spark, str(tmp_path / "out/coverage.jsonl")).count() == 4
    again = facts.mutation(spark, str(tmp_path / "out/mutation.jsonl"))
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))
    assert same(again[0], kil) and same(again[1], reg) and same(facts.spans(spark, str(tmp_path / "out/methods.jsonl")), spans)


def test_suspects(spark):
    cov = spark.createDataFrame([("p.add", "f1"), ("p.add", "f2[1]"), ("p.add", "p1"), ("p.put", "f1"), ("p.flush", "f1"), ("p.flush", "f2"), ("p.idle", "p2")], "method string, test string")
    red = spark.createDataFrame([("f1",), ("f2[1]",), ("f2[2]",)], "test string")
    green = spark.createDataFrame([(f"p{i}",) for i in range(5)], "test string")
    reach = spark.createDataFrame([("p.add",), ("p.put",)], "method string")
    got = localize.suspects(cov, red, green, reach).orderBy("rank").collect()
    assert [(r["method"], round(r["score"], 4), r["mode"]) for r in got] == [("p.add", 0.8165, "CONTRAST"), ("p.put", 0.7071, "CONTRAST"), ("p.flush", 1.0, "CONTRAST")]
    few = localize.suspects(cov, red, green.limit(2)).collect()
    assert few[0]["mode"] == "FREQUENCY" and all(r["score"] == r["ef"] for r in few)
    boundary = spark.createDataFrame([("f1", "p.put"), ("f2", "p.put")], "test string, method string")
    calls = spark.createDataFrame([("p.put", "p.add"), ("p.put", "t.x")], "caller string, callee string")
    prod = spark.createDataFrame([("p.add",), ("p.put",)], "method string")
    got = localize.boundary_suspects(boundary, calls, prod).orderBy("rank").collect()
    assert [(r["method"], r["direct"], r["via"]) for r in got] == [("p.put", True, None), ("p.add", False, "p.put")]


def test_assertion_boundary(spark):
    st = "method_id string, line int, id string, label string, name string, code string, ord int"
    statements = spark.createDataFrame([("t", 3, "s1", "CALL", "p.Tbl.add", "t.add(1)", 1), ("t", 4, "s2", "CALL", "p.Tbl.get", "t.get(0)", 2), ("t", 5, "s3", "CALL", "org.A.assertEquals", "assertEquals(1, x)", 3), ("t", 6, "s4", "CALL", "p.Tbl.flush", "t.flush()", 4)], st)
    flow = spark.createDataFrame([("s3", "s2")], "node string, back string")
    targets = spark.createDataFrame([("s1",), ("s2",), ("s4",)], "id string")
    got = localize.boundary(spark.createDataFrame([("T.t", "t", 5)], "test string, method_id string, line int"), statements, flow, targets)
    assert {(r["method"], r["label"]) for r in got.collect()} == {("p.Tbl.get", "actual-side"), ("p.Tbl.add", "prior-call")}


CELL = r"Cell\{column=(\d+), row=(\d+)\}"


def test_knowledge_graph(spark):
    values = spark.createDataFrame([("A.m", "p.T.a", ["1", "2", "abc"], "Cell{column=3, row=1}", False, 0), ("A.m", "p.T.b", ["1", "2", "x"], "throws E: no", True, 1), ("A.m", None, ["9", "9", ""], "else", False, 2)], "method string, test string, args array<string>, result string, throws boolean, ord long")
    cov = spark.createDataFrame([("A.m", "p.T.a"), ("A.m", "p.T.b"), ("A.n", "p.T.a")], "method string, test string")
    fails = spark.createDataFrame([("p.T.b", "org.junit.ComparisonFailure", "expected:<" + "x" * 40 + "\\n y> but was:<z>")], "test string, type string, message string")
    covering = impact.covering(cov, "A.m")
    nodes, edges = knowledge.build("A.m", values, cov, fails, covering, knowledge.exemplars(covering), CELL)
    ids = {r["id"] for r in nodes.collect()}
    assert {r["type"] for r in nodes.collect()} == {"Method", "Test", "FailureMode", "BehaviorClass", "InputProfile", "GoldenOutput"}
    assert all(r["src"] in ids and r["dst"] in ids for r in edges.collect())
    assert "bc:dcol+1_drow+0" in ids and "bc:throws:E" in ids
    assert {r["rel"] for r in edges.collect()} == {"COVERS", "FAILS_WITH", "CO_COVERED_WITH", "EXHIBITS", "OBSERVED_AT", "ASSERTED_BY"}
    co = knowledge.co_coverage(cov, "A.m").first()
    assert (co["method"], co["shared"], co["jaccard"]) == ("A.n", 1, 0.5)


def test_statistics(spark):
    rows = [("a", "x", i, i < 8, i) for i in range(10)] + [("b", "x", i, i < 3, i + 2) for i in range(10)]
    runs = spark.createDataFrame(rows, "arm string, target string, seed int, passed boolean, cycles int")
    s = {r["arm"]: r for r in stats.by_arm(runs).collect()}
    assert s["a"]["pass_at_one"] == 0.8 and s["a"]["cycles_median"] == 4
    b = {r["arm"]: (r["low"], r["high"]) for r in stats.bootstrap(runs).collect()}
    assert b["a"][0] < 0.8 < b["a"][1]
    p, effect = stats.mcnemar(stats.paired(runs, "a", "b"))
    assert p == pytest.approx(2 * 0.5**5) and effect == 0.5
    assert stats.signed_rank(stats.paired(runs, "a", "b")) < 0.01 and stats.signed_rank(stats.paired(runs, "a", "a")) == 1.0
    with pytest.raises(ValueError):
        stats.paired(runs.where("not (arm = 'b' and seed = 3)"), "a", "b")
    summary = spark.createDataFrame([("base", 0.3, 0.2, 0.4), ("good", 0.8, 0.6, 0.9), ("near", 0.34, 0.3, 0.5)], "arm string, pass_at_one double, low double, high double")
    assert {r["arm"]: r["confirmed"] for r in stats.lifts(summary, "base").collect()} == {"good": True, "near": False}
    assert stats.additive(summary, "good", ["base", "near"]).first()[0] and not stats.additive(summary, "good", ["base", "gone"]).first()[0]


def test_windows(spark):
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate("aabbba")], "k string, n int, v string")
    assert [(r["v"], r["n"]) for r in ranking.collapse(df, ["k"], "v", "n").orderBy("island").collect()] == [("a", 2), ("b", 3), ("a", 1)]
    p = spark.createDataFrame([("/a/", "x"), ("/a/b/", "y")], "prefix string, who string")
    got = ranking.longest_prefix(spark.createDataFrame([("/a/b/c",), ("/a/z",), ("/q",)], "path string"), p, "path", "prefix")
    assert {r["path"]: r["who"] for r in got.collect()} == {"/a/b/c": "y", "/a/z": "x", "/q": None}
    pts = spark.createDataFrame([(5,), (25,)], "at int")
    spans = spark.createDataFrame([("s", 0, 10), ("w", 4, 30)], "name string, low int, high int")
    assert {(r["at"], r["name"]) for r in ranking.bucketed_range_join(pts, spans, "at", "low", "high", 10).collect()} == {(5, "s"), (5, "w"), (25, "w")}
    a, b = spark.createDataFrame([("k", i) for i in range(3)], "k string, x int"), spark.createDataFrame([("k", i) for i in range(2)], "k string, y int")
    assert {(r["x"], r["y"]) for r in ranking.round_robin(a, b, ["k"], ["x"], ["y"]).collect()} == {(0, 0), (1, 1), (2, 0)}
    assert {(r["x"], r["y"]) for r in ranking.zip_by_rank(a, b, ["k"], ["x"], ["y"]).collect()} == {(0, 0), (1, 1)}


def test_names_and_predicates(spark):
    assert names.Target.parse("src/A.java#A.m(int, String)") == names.Target("m", "A", file="src/A.java", params=("int", "String"))
    assert names.Target.parse("p.O$I#m").simple_class == "I"
    with pytest.raises(ValueError):
        names.Target.parse("nothing")
    df = spark.createDataFrame([("p.ATest.testX", "x/src/test/java/A.java", False), ("p.A.run", "x/demo/A.java", None)], "fqn string, file string, is_test boolean")
    assert [r[0] for r in df.select(predicates.is_entry()).collect()] == [True, False]
    assert [r[0] for r in df.select(predicates.peripheral("file", "fqn")).collect()] == [False, True]
    code = spark.createDataFrame([("this.put(1)", "  put( 1 );"), ("a.b()", "c.d();"), ("x", "")], "code string, line string")
    assert [r[0] for r in code.select(predicates.consistent_source("code", "line")).collect()] == [True, False, False]
    one = spark.createDataFrame([("src/__t__/a__t__/__ts__/X.java", "a b\n  c", "int(java.lang.String,int)", "p.A.m")], "p string, t string, s string, f string")
    r = one.select(names.unstage("p"), names.one_line("t", 4), names.readable_signature("f", "s"), names.token_estimate("t")).first()
    assert tuple(r) == ("src/test/a__t__/tests/X.java", "a b…", "m(String, int)", 2)
    assert predicates.layers(["ddg"]) == ["DDG"]
    with pytest.raises(ValueError):
        predicates.layers(["none"])


def test_fingerprint_and_redaction(spark):
    files = spark.createDataFrame([("b", "2"), ("a", "1")], "file string, content string")
    d = lambda df, s="": text.fingerprint(df, s).first()[0]
    assert d(files) == d(files.orderBy("file")) != d(files.limit(1)) and d(files) != d(files, "salt")
    dis = "class p.A {\n  public int m();\n    Code:\n       0: aload\n\n  public int n();\n    Code:\n       0: iload\n\n}"
    rows = text.lines(spark.createDataFrame([("A", dis)], "file string, content string"))
    out = "\n".join(r["text"] for r in text.redacted(rows, "m").orderBy("line").collect())
    assert "aload" not in out and "iload" in out and "public int m();" in out
