"""The source reader, streams, command line and registered queries."""

import json

import duckdb
import pytest

from tracewell import cli
from tracewell.operators.dependence import control_flow, data_dependence
from tracewell.sources import java
from tracewell.streaming import capture

SOURCE = '''package p;
/** Holds. Things. */
public class Tbl {
    enum Kind { RED, GREEN; int x; }
    /** Puts { a value. */
    public static int put(int row, String v) {
        int limit = 2 + 3;
        if (row > limit) { // } not here
            throw new IllegalStateException("} no");
        }
        for (int i = 0; i < row; i++) { add(i); }
        return row * limit;
    }
    void add(int i) { put(i, "x" + "y"); }
    int twice(Tbl t) {
        try { int r = t.put(7, null); return r; } catch (IllegalStateException | RuntimeException e) { return 0; }
    }
    @Test void checks() {
        Tbl t = new Tbl();
        assertEquals(6, t.put(3, "s"));
        try { t.put(9, "q"); } catch (IllegalStateException e) { assertEquals("no", e.getMessage()); }
    }
}
'''


@pytest.fixture()
def files(spark):
    return spark.createDataFrame([("p/Tbl.java", SOURCE), ("p/Empty.java", ""), ("p/Bad.java", "class { ((")], "file string, content string")


def test_methods_types_statements(spark, files):
    m = {r["fqn"]: r for r in java.methods_table(files).collect()}
    assert set(m) == {"p.Tbl.put", "p.Tbl.add", "p.Tbl.twice", "p.Tbl.checks"}
    assert m["p.Tbl.put"]["signature"] == "int(int,String)" and m["p.Tbl.checks"]["is_test"] and m["p.Tbl.put"]["is_static"] and (m["p.Tbl.put"]["line_start"], m["p.Tbl.put"]["line_end"]) == (6, 13)
    t = {r["fqn"]: r["enum_constants"] for r in java.types_table(files).collect()}
    assert t["p.Tbl$Kind"] == ["RED", "GREEN"] and "p.Tbl" in t
    st = java.statements_table(files)
    assert [r["kind"] for r in st.where("method = 'p.Tbl.put'").orderBy("ordinal").collect()] == ["DECL", "IF", "THROW", "FOR", "EXPR", "RETURN"]
    flow = {(r["src"], r["dst"]) for r in control_flow(st.where("method = 'p.Tbl.put'")).collect()}
    assert flow == {(0, 1), (1, 2), (1, 3), (3, 4), (4, 3), (3, 5)}
    ddg = {(r["name"], r["src"], r["dst"]) for r in data_dependence(java.expressions_table(files).where("method = 'p.Tbl.put'")).collect()}
    assert ("limit", 0, 1) in ddg and ("limit", 0, 5) in ddg


def test_oracles_usages_arguments(spark, files):
    o = {(r["kind"], r["expected"], r["message"]) for r in java.oracles_table(files).where("test = 'p.Tbl.checks'").collect()}
    assert o == {("EQUALS", "6", None), ("EXCEPTION_MESSAGE", None, "no")}
    assert {(r["consumer"], r["kind"]) for r in java.usages_table(files, "put").collect()} >= {("p.Tbl.add", "DISCARDED"), ("p.Tbl.twice", "ASSIGNED_TO_LOCAL"), ("p.Tbl.checks", "PASSED_AS_ARG")}
    assert {tuple(r) for r in java.catches_table(files, "put").collect()} == {("p.Tbl.twice", "IllegalStateException"), ("p.Tbl.twice", "RuntimeException"), ("p.Tbl.checks", "IllegalStateException")}
    a = {(r["method"], r["arg_index"]): (r["origin"], r["kind"], r["value"]) for r in java.arguments_table(files, "put").where("line < 20").collect()}
    assert a["p.Tbl.add", 1] == ("UNKNOWN", "RESOLVED", '"xy"')
    assert a["p.Tbl.add", 0][0] == "PARAMETER" and a["p.Tbl.add", 0][1:] == ("PARAM_FROM_CALLER", "0 < ... i < row")
    assert a["p.Tbl.twice", 0] == ("LITERAL", "RESOLVED", "7")


def test_resolution_and_snippets():
    m = {"open": 0, "end": 0, "params": [], "name": "m"}
    r = lambda e: java.resolve(e, "", "", m, [], 0)
    assert r("7 / 2 * 2") == ("RESOLVED", "6") and r("7.5 + 1") == ("RESOLVED", "8") and r("1 / 0")[0] == "DERIVED"
    assert r('true ? "a" : "b"') == ("RESOLVED", '"a"') and r("x.y") == ("UNRESOLVED", "FIELD_READ") and r("Class.forName(n)")[1] == "REFLECTION"
    assert r("q ? 1 : 2") == ("BRANCH_UNION", "1 | 2") and r("new int[]{1, 2}") == ("DERIVED", "ARRAY_LITERAL(1, 2)")
    code, cut = java.snippet(SOURCE, 12)
    assert "int limit" in code and "return row * limit" in code and not cut
    assert "9" in java.replaced_body(SOURCE, "add", "return 9;")


def test_chop_and_requirements(spark, files):
    from tracewell.operators.chains import implied_requirements
    from tracewell.plans.reports import chop_report

    calls = spark.createDataFrame([("p.Tbl.checks", "p.Tbl.put", False), ("p.Tbl.twice", "p.Tbl.put", False), ("p.Tbl.put", "p.Tbl.add", False)], "caller string, callee string, virtual boolean")
    out = chop_report(files, calls, "p.Tbl.put")
    assert {r["method"] for r in out["methods"].collect()} == {"p.Tbl.put", "p.Tbl.checks", "p.Tbl.twice"}
    assert {r["layer"] for r in out["edges"].collect()} == {"CFG", "CDG", "DDG", "CG", "ARG_PASS", "RETURN_BIND"}
    reach = {(r["stmt"], r["node"]) for r in out["touched"].collect()}
    assert ("p.Tbl.put#5", "p.Tbl.put#0") in reach and ("p.Tbl.put#2", "p.Tbl.put#1") in reach
    assert out["cytoscape"].count() > 10
    need = {tuple(r) for r in implied_requirements(java.usages_table(files, "put"), java.catches_table(files, "put")).collect()}
    assert ("p.Tbl.add", "only side effects are observed") in need and ("p.Tbl.twice", "exceptions are caught: IllegalStateException, RuntimeException") in need
    b = {r["method"]: r for r in java.bodies_table(files, "put").collect()}
    assert "t.put(7" in b["p.Tbl.twice"]["consumer_body"] and "p.Tbl.put" not in b
    assert java.consumer_body(SOURCE, "put", "add", whole=2).count("// ...") == 2 and java.test_region(SOURCE, "put", whole=1).endswith("return row * limit")


def test_strip_sections(spark):
    from tracewell.sources import text

    doc = "# A\n\n\nx\n## Drop me\ny\n### Below\nz\n## Keep\nw"
    got = [r["text"] for r in text.strip_sections(text.numbered(spark, doc).withColumnRenamed("value", "text"), "Drop").orderBy("n").collect()]
    assert got == ["# A", "", "x", "## Keep", "w"]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.tsv").write_text("m\tt\touter\nm\tt\touter\nm\tu\tinner\n")
    q = capture.matrix_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("matrix").outputMode("append").start()
    q.processAllAvailable()
    (tmp_path / "in/b.tsv").write_text("m\tt\touter\nn\tt\touter\n")
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("matrix").collect())) == [("m", "t"), ("n", "t")]
    (tmp_path / "f").mkdir()
    (tmp_path / "f/1.json").write_text('{"test":"a"}\n{"test":"b"}\n')
    got = {}
    q = capture.feedback(spark.readStream.schema("test string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "f")), str(tmp_path / "state"), lambda df, e: got.update({e: {tuple(r) for r in df.collect()}}))
    q.processAllAvailable()
    (tmp_path / "f/2.json").write_text('{"test":"b"}\n{"test":"c"}\n')
    q.processAllAvailable()
    q.stop()
    assert got == {0: {("a", "broke"), ("b", "broke")}, 1: {("a", "fixed"), ("b", "still"), ("c", "broke")}}


def test_capped_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"method": "m", "test": "t", "args": str(i), "result": "r", "throws": i % 2 == 1, "ord": i} for i in range(20)]
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, reversed(rows))))
    stream = spark.readStream.schema("method string, test string, args string, result string, throws boolean, ord long").json(str(tmp_path / "in"))
    q = capture.capped_values(stream).writeStream.format("memory").queryName("capped").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("capped").groupBy("throws").count().collect()
    assert {r["throws"]: r["count"] for r in got} == {False: 6, True: 2}
    assert {int(r["args"]) for r in spark.table("capped").where("not throws").collect()} == set(range(0, 12, 2))


def test_cli(spark, tmp_path, capsys):
    from tests.test_graph import flat

    (tmp_path / "g.json").write_text(json.dumps(flat()))
    assert cli.main(["paths", "--graph", str(tmp_path / "g.json"), "--target", "p.C#target"]) == 0
    assert "m:p.T.t1:void() -> m:p.C.target:int(int)" in capsys.readouterr().out
    assert cli.main(["slice", "--graph", str(tmp_path / "g.json"), "--target", "p.C#none", "--out", str(tmp_path / "o")]) == 2
    assert cli.main(["slice", "--graph", str(tmp_path / "g.json"), "--target", "p.C#target", "--out", str(tmp_path / "o")]) == 0
    assert (tmp_path / "o.md").exists() and (tmp_path / "o.graph.json").exists()


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="needs the driver's tables")
def test_queries_equal_sql(spark):
    import importlib

    catalog = [importlib.import_module(f"tracewell.plans.{n}") for n in ("catalog", "catalog_more", "catalog_graph", "catalog_sources", "catalog_pool")][0]

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, f in catalog.QUERIES.items():
        want = con.execute(f"select * from ({catalog.ORACLE_SQL[name]})").df()
        got = f(spark, SF).toPandas()
        assert sorted(got.columns) == sorted(want.columns), name
        cols = sorted(got.columns)
        assert _rows(got[cols]) == _rows(want[cols]), name


def test_leak_runs_equal_brute_force(spark, tmp_path):
    from tracewell.plans import catalog

    words = [f"w{i}" for i in range(20)]
    items = {1: words, 2: words[:9], 3: ["x", "y", "z"], 4: ["solo"], 5: []}
    docs = {1: words[1:], 2: ["a", *words[12:], "b"], 3: words[13:], 4: ["a", "x", "y", "z"], 5: ["x", "y", "a", "z"], 6: words[:8], 7: ["solo"], 8: ["xx", "y", "z"], 9: []}
    for name, key, rows in (("benchmark", "item_id", items), ("documents", "doc_id", docs)):
        spark.createDataFrame([(k, " ".join(v)) for k, v in rows.items()], f"{key} long, text string").write.parquet(str(tmp_path / f"{name}.parquet"))
    runs = lambda ws, n: {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}
    want = {(i, d) for i, a in items.items() for d, b in docs.items() if a and runs(a, min(8, len(a))) & runs(b, min(8, len(a)))}
    got = [(r["item_id"], r["doc_id"]) for r in catalog.leak_runs(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and {(1, 1), (1, 2), (3, 4), (4, 7)} <= want


def _rows(df):
    """Rows as sorted text, numbers rounded, nulls alike."""
    import pandas as pd

    show = lambda v: "" if v is None or v is pd.NA or v != v else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(show(getattr(v, "item", lambda v=v: v)()) for v in r) for r in df.astype(object).itertuples(index=False))
