"""Registered queries on what is read and written: documents, reports, traces, sources, streams, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ingest, knowledge, localize, stats
from ..operators.traverse import shared_path
from ..functions.names import Target
from ..sources import facts, java, reports, sinks, text
from ..streaming import capture
from . import derived as d
from . import program as p
from . import reports as plans
from .catalog import ORACLE_SQL, QUERIES, query
from .derived import table
from .program import METHODS

__all__ = ["ORACLE_SQL", "QUERIES"]


def _written(rows: DataFrame, name: str, root: str | None = None) -> str:
    """Lines (value) as text files in the shared folder; their path. With a root each file is a document of that element."""
    path = shared_path(rows.sparkSession, name)
    if root:

        def document(batches):
            import pandas as pd

            yield pd.DataFrame({"value": [f"<{root}>"]})
            yield from batches
            yield pd.DataFrame({"value": [f"</{root}>"]})

        rows = rows.mapInPandas(document, "value string")
    rows.write.text(path)
    return path


def _regions(spark, sf):
    one = d.mutants(spark, sf).groupBy("method", "line").agg(F.count(F.when(F.col("detected"), 1)).cast("int").alias("killers"))
    return one.select("method", F.concat(F.lit("line "), F.col("line").cast("string")).alias("label"),
        F.col("line").alias("line_lo"), F.col("line").alias("line_hi"), "killers")


def _facts(spark, sf) -> str:
    """Spans, coverage, killers and regions as written documents; their folder."""
    folder = shared_path(spark, "facts")
    spans = table(spark, sf, "part").select(p.method_name().alias("fqn"), p.source_file().alias("file"),
        F.col("p_size").alias("line_start"), (F.col("p_size") + 9).alias("line_end"))
    kills = d.mutants(spark, sf).where("detected").select("method", "test")
    sinks.write_facts(folder, spans, d.coverage(spark, sf), kills, _regions(spark, sf))
    return folder


@query("SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS method, CAST(l_orderkey AS VARCHAR) AS test FROM lineitem")
def coverage_written_and_read(spark, sf):
    return facts.coverage(spark, _facts(spark, sf) + "/coverage.jsonl")


@query("SELECT CAST(l_partkey AS VARCHAR) AS method, 'line ' || l_linenumber AS label, l_linenumber AS line_lo, l_linenumber AS line_hi, count(*) FILTER (WHERE l_returnflag = 'R') AS killers FROM lineitem GROUP BY l_partkey, l_linenumber")
def regions_written_and_read(spark, sf):
    found = facts.mutation(spark, _facts(spark, sf) + "/mutation.jsonl")[1]
    return found.select("method", "label", *[F.col(c).cast("long").alias(c) for c in ("line_lo", "line_hi", "killers")])


@query("SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS method, CAST(l_orderkey AS VARCHAR) AS test FROM lineitem WHERE l_returnflag = 'R'")
def killers_written_and_read(spark, sf):
    return facts.mutation(spark, _facts(spark, sf) + "/mutation.jsonl")[0]


@query(f"WITH {METHODS} SELECT fqn, file, size AS line_start, size + 9 AS line_end FROM pm")
def spans_written_and_read(spark, sf):
    found = facts.spans(spark, _facts(spark, sf) + "/methods.jsonl")
    return found.select("fqn", "file", *[F.col(c).cast("long").alias(c) for c in ("line_start", "line_end")])


def _execution(spark, sf) -> DataFrame:
    """Parts as lines of their brand's file in an execution report; one in three never ran."""
    row = F.format_string(
        '<package name="pkg/%s"><sourcefile name="F.java"><line nr="%s" mi="1" ci="%s" mb="0" cb="2"/></sourcefile></package>',
        p.brand(), F.col("p_partkey").cast("string"), (F.col("p_size") % 3).cast("string"),
    )
    return reports.execution(spark, _written(table(spark, sf, "part").select(row.alias("value")), "execution", "report"))


@query("SELECT DISTINCT 'pkg/' || translate(p_brand, '# ', '__') || '/F.java' AS file, p_partkey AS line FROM part WHERE p_size % 3 > 0")
def executed_lines(spark, sf):
    return reports.executed(_execution(spark, sf)).select("file", F.col("line").cast("long").alias("line"))


@query("SELECT 'pkg/' || translate(p_brand, '# ', '__') || '/F.java' AS file, p_partkey AS line, 1 AS mi, p_size % 3 AS ci, 0 AS mb, 2 AS cb FROM part WHERE p_partkey BETWEEN 60 AND 150")
def counters_around_a_region(spark, sf):
    out = reports.corridor_counters(_execution(spark, sf), 100, 110)
    return out.select("file", *[F.col(c).cast("long").alias(c) for c in ("line", "mi", "ci", "mb", "cb")])


@query("""SELECT DISTINCT 'pkg.' || translate(p_brand, '# ', '__') || '.block' || (p_partkey // 50) AS method FROM part WHERE p_size % 3 > 0""")
def methods_that_ran(spark, sf):
    """Blocks of fifty parts of a brand are methods; those with an executed line ran."""
    block = F.floor(F.col("p_partkey") / 50).cast("long")
    spans = table(spark, sf, "part").select(p.brand().alias("b"), block.alias("k")).distinct()
    spans = spans.select(F.concat(F.lit("pkg."), "b", F.lit(".block"), F.col("k").cast("string")).alias("fqn"),
        F.concat(F.lit("src/pkg/"), "b", F.lit("/F.java")).alias("file"), (F.col("k") * 50).alias("line_start"),
        (F.col("k") * 50 + 49).alias("line_end"))
    return reports.coverage_from_execution(_execution(spark, sf), spans).select("method").distinct()


@query("SELECT 'C' || l_suppkey || '.m' AS method, l_linenumber AS line, l_returnflag = 'R' AS detected, CASE WHEN l_returnflag = 'R' THEN 'T.t' || l_orderkey ELSE '' END AS test, count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4")
def mutants_reported(spark, sf):
    hit = F.col("l_returnflag") == "R"
    row = F.format_string(
        "<mutation detected='%s' status='%s'><mutatedClass>C%s</mutatedClass><mutatedMethod>m</mutatedMethod><lineNumber>%s</lineNumber><killingTest>%s</killingTest></mutation>",
        hit.cast("string"), F.when(hit, "KILLED").otherwise("SURVIVED"), F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string"),
        F.when(hit, F.concat(F.lit("T.t"), F.col("l_orderkey").cast("string"), F.lit("(T)"))).otherwise(""),
    )
    found = reports.mutants(spark, _written(table(spark, sf, "lineitem").select(row.alias("value")), "mutations", "mutations"))
    return found.groupBy("method", F.col("line").cast("long").alias("line"), "detected", "test").agg(F.count("*").alias("n"))


@query("SELECT 'C' || o_custkey || '.t' || o_orderkey AS test, 'org.E' AS type, 'was ' || o_orderpriority AS message FROM orders WHERE o_orderstatus = 'F'")
def failures_reported(spark, sf):
    """Orders as test cases: failed, passed, or skipped while pending."""
    inner = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit('<failure type="org.E" message="was '), "o_orderpriority",
        F.lit('">trace</failure>'))).when(F.col("o_orderstatus") == "P", "<skipped>x</skipped>").otherwise("")
    row = F.concat(F.format_string('<testcase classname="C%s" name="t%s">', F.col("o_custkey").cast("string"),
        F.col("o_orderkey").cast("string")), inner, F.lit("</testcase>"))
    return reports.failures(reports.test_cases(spark, _written(table(spark, sf, "orders").select(row.alias("value")), "junit", "testsuite")))


@query("SELECT DISTINCT 'M' || l_suppkey AS method, 'T' || l_orderkey AS test FROM lineitem WHERE l_returnflag <> 'N'")
def matrix_of_a_probe(spark, sf):
    """Lines of a probe; those of nested calls are left out."""
    kind = F.when(F.col("l_returnflag") == "N", "inner").otherwise("outer")
    row = F.concat_ws("\t", F.concat(F.lit("M"), F.col("l_suppkey").cast("string")), F.concat(F.lit("T"), F.col("l_orderkey").cast("string")), kind)
    return facts.capture_matrix(spark, _written(table(spark, sf, "lineitem").select(row.alias("value")), "probe"))


# -- traces ------------------------------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 4 AS v FROM orders), f AS (
SELECT k, 0 AS cause_ix, 'a.Outer' AS exc_type, 'it: failed' AS message, 0 AS frame_ix, 'p.C$In' AS cls, '<init>' AS method,
  'C.java' AS file, CAST(k % 1000 AS BIGINT) AS line FROM o
UNION ALL SELECT k, 0, 'a.Outer', 'it: failed', 1, 'java.lang.Thread', 'run', 'Thread.java', 7 FROM o WHERE v = 1
UNION ALL SELECT k, 1, 'b.Deep', '', 0, 'q.R', 'go', 'Native Method', -1 FROM o WHERE v >= 2
UNION ALL SELECT k, 1, 'b.Deep', '', 1, 'q.R', 'lambda$0', 'R.java', 9 FROM o WHERE v = 3)
SELECT CAST(k AS VARCHAR) AS trace_id, cause_ix, exc_type, message, frame_ix, cls, method, file, line FROM f""")
def frames_of_traces(spark, sf):
    """Orders as traces of four shapes: plain, with a module's frame, with a native cause, with a deeper cause."""
    key = F.col("o_orderkey")
    head = F.concat(F.lit("a.Outer: it: failed\n\tat p.C$In.<init>(C.java:"), (key % 1000).cast("string"), F.lit(")\n"))
    rest = (
        F.when(key % 4 == 1, "\tat java.base/java.lang.Thread.run(Thread.java:7)\n").when(key % 4 == 2, "Caused by: b.Deep\n\tat q.R.go(Native Method)\n\t... 3 more\n")
        .when(key % 4 == 3, "Caused by: b.Deep\n\tat q.R.go(Native Method)\n    at q.R.lambda$0(R.java:9)\n").otherwise("")
    )
    found = text.frames(table(spark, sf, "orders").select(key.cast("string").alias("trace_id"), F.concat(head, rest).alias("trace")))
    return found.select("trace_id", F.col("cause_ix").cast("long").alias("cause_ix"), "exc_type", "message",
        F.col("frame_ix").cast("long").alias("frame_ix"), "cls", "method", "file", F.col("line").cast("long").alias("line"))


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS t, l_linenumber AS n, l_suppkey AS s,
  CASE WHEN l_suppkey % 4 = 0 THEN 0 WHEN l_suppkey % 4 = 1 THEN 1 WHEN l_suppkey % 4 = 2 THEN 2 ELSE 3 END AS p
  FROM lineitem), b AS (SELECT *, min(p) OVER (PARTITION BY t) AS best FROM s)
SELECT t, n AS ord, s FROM b WHERE p = best QUALIFY row_number() OVER (PARTITION BY t ORDER BY n, s) <= 3""")
def seeds_of_crashes(spark, sf):
    """Statements of a frame: exact calls of the deeper method first, then calls of its name, then throws, then any."""
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("t"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("s")).distinct()
    r = F.col("s") % 4
    rows = items.select(
        F.col("t").alias("trace_id"), F.lit(0).alias("frame_ix"), F.struct("n", "s").alias("ord"), F.when(r < 2, "CALL").otherwise("OTHER").alias("label"),
        F.when(r == 0, "p.Deep.go").when(r == 1, "p.Other.go").otherwise("x").alias("name"), F.when(r == 2, "  throw e;").otherwise("y()").alias("code"),
        F.lit("p.Deep").alias("deeper_cls"), F.lit("go").alias("deeper_method"), F.lit("E").alias("exc"),
    )
    return localize.crash_seeds(rows).select(F.col("trace_id").alias("t"), F.col("ord.n").alias("ord"), F.col("ord.s").alias("s"))


@query("""WITH a AS (SELECT DISTINCT trim(t, ' ') AS t FROM (SELECT unnest(string_split(text, chr(10))) AS t FROM benchmark)
  WHERE length(trim(t, ' ')) > 25), e AS (SELECT DISTINCT trim(t, ' ') AS t FROM (SELECT unnest(string_split(text, chr(10))) AS t
  FROM conversations)),
o AS (SELECT doc_id, trim(t, ' ') AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents UNION ALL
  SELECT -1, unnest(string_split(text, chr(10))) FROM benchmark)) SELECT DISTINCT CAST(doc_id AS VARCHAR) AS file, o.t AS text FROM o
  WHERE o.t IN (SELECT t FROM a) AND o.t NOT IN (SELECT t FROM e)""")
def leaked_lines(spark, sf):
    """Distinctive lines of benchmark items found in documents; item texts themselves are among what is searched."""
    lines = lambda df, key: df.select(key.cast("string").alias("file"), F.explode(F.split("text", "\n", -1)).alias("text"))
    items, docs, talk = (table(spark, sf, t) for t in ("benchmark", "documents", "conversations"))
    return java.leak_sweep(lines(items, F.col("item_id")), lines(talk, F.col("conv_id")), lines(docs, F.col("doc_id")).union(lines(items, F.lit(-1))))


# -- sources -----------------------------------------------------------------------------------------------------------


def _java(spark, sf) -> DataFrame:
    """A class for each part, with a method that branches on its size and a test of it."""
    code = F.format_string(
        """package pkg;
class C%s {
  /** Makes it. */
  int m(int a, String b) {
    int x = %s;
    if (a > x) {
      x = helper(a);
    }
    try { check(x); } catch (Broken | p.Lost e) { stop(); }
    return helper(x);
  }

  @Test
  void t() {
    assertEquals(%s, m(%s + 1, "s"));
    assertThrows(p.Bad.class, () -> m(0, null));
  }
}
""", F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), F.col("p_size").cast("string"), F.col("p_partkey").cast("string"))  # fmt: skip
    return table(spark, sf, "part").select(F.concat(F.lit("C"), F.col("p_partkey").cast("string"), F.lit(".java")).alias("file"), code.alias("content"))


@query("SELECT 'pkg.C' || p_partkey || '.m' AS fqn, 'int(int,String)' AS signature, 4 AS line_start, 11 AS line_end, false AS is_test FROM part UNION ALL SELECT 'pkg.C' || p_partkey || '.t', 'void()', 13, 17, true FROM part")
def methods_of_sources(spark, sf):
    found = java.methods_table(_java(spark, sf))
    return found.select("fqn", "signature", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"), "is_test")


@query("SELECT 'pkg.C' || p_partkey AS fqn, 'CLASS' AS kind, 2 AS line_start, 18 AS line_end FROM part")
def types_of_sources(spark, sf):
    return java.types_table(_java(spark, sf)).select("fqn", "kind", F.col("line_start").cast("long").alias("line_start"),
        F.col("line_end").cast("long").alias("line_end"))


@query("""WITH s(ordinal, kind, parent, branch, line) AS (VALUES (0, 'DECL', -1, 'body', 5), (1, 'IF', -1, 'body', 6), (2,
  'EXPR', 1, 'then', 7), (3, 'TRY', -1, 'body', 9), (4, 'EXPR', 3, 'then', 9), (5, 'CATCH', -1, 'body', 9), (6,
  'EXPR', 5, 'then', 9), (7, 'RETURN', -1, 'body', 10))
SELECT 'pkg.C' || p_partkey || '.m' AS method, ordinal, kind, parent, branch, line FROM part, s UNION ALL SELECT 'pkg.C' || p_partkey || '.t', o, 'EXPR', -1, 'body', 15 + o - 0 - 0 FROM part, (VALUES (0), (1)) v(o)""".replace("15 + o - 0 - 0", "15 + o"))
def statements_of_sources(spark, sf):
    found = java.statements_table(_java(spark, sf))
    long = lambda a, b: F.col(a).cast("long").alias(b)
    return found.select("method", long("ordinal", "ordinal"), "kind", long("parent", "parent"), "branch", long("line_start", "line"))


@query("""WITH k(kind, n) AS (VALUES ('PARAM', 2), ('LOCAL_DEF', 1), ('LOCAL_USE', 6), ('CALLSITE', 4), ('BRANCH_PREDICATE', 1),
  ('RETURN_VALUE', 1), ('LITERAL', 1)) SELECT 'pkg.C' || p_partkey || '.m' AS method, kind, n FROM part, k""")
def expressions_of_sources(spark, sf):
    found = java.expressions_table(_java(spark, sf)).where(F.col("method").endswith(".m"))
    return found.groupBy("method", "kind").agg(F.count("*").alias("n"))


@query("""SELECT 'pkg.C' || p_partkey || '.t' AS test, 'EQUALS' AS kind,
  CAST(p_size AS VARCHAR) AS expected, 'm(' || p_partkey || ' + 1, "s")' AS expr, CAST(NULL AS VARCHAR) AS type FROM part
UNION ALL SELECT 'pkg.C' || p_partkey || '.t', 'EXCEPTION', NULL, NULL, 'Bad' FROM part""")
def oracles_of_sources(spark, sf):
    return java.oracles_table(_java(spark, sf)).where(F.col("test").endswith(".t")).select("test", "kind", "expected", "expr", "type")


@query("SELECT 'pkg.C' || p_partkey || '.m' AS consumer, k AS kind FROM part, (VALUES ('ASSIGNED_TO_LOCAL'), ('RETURNED_UNCHANGED')) v(k)")
def usages_in_sources(spark, sf):
    return java.usages_table(_java(spark, sf), "helper").select("consumer", "kind")


@query("SELECT 'pkg.C' || p_partkey || '.m' AS consumer, t AS type FROM part, (VALUES ('Broken'), ('Lost')) v(t)")
def catches_in_sources(spark, sf):
    return java.catches_table(_java(spark, sf), "check")


@query("""SELECT 'pkg.C' || p_partkey || '.t' AS method, 15 AS line, 0 AS arg_index, 'RESOLVED' AS kind,
  CAST(p_partkey + 1 AS VARCHAR) AS value FROM part UNION ALL SELECT 'pkg.C' || p_partkey || '.t', 15, 1, 'RESOLVED', '"s"' FROM part
UNION ALL SELECT 'pkg.C' || p_partkey || '.t', 16, 0, 'RESOLVED', '0' FROM part UNION ALL
  SELECT 'pkg.C' || p_partkey || '.t', 16, 1, 'RESOLVED', 'null' FROM part""")
def arguments_in_sources(spark, sf):
    """Constants that reach the calls of a method, sums folded."""
    found = java.arguments_table(_java(spark, sf), "m")
    return found.select("method", F.col("line").cast("long").alias("line"), F.col("arg_index").cast("long").alias("arg_index"), "kind", "value")


@query("""SELECT 'C' || p_partkey AS key,
  '    int x = ' || p_size || ';' || chr(10) || '    if (a > x) {' || chr(10) || '      x = helper(a);' AS code FROM part""")
def snippets_of_sources(spark, sf):
    """The call in line 7 with what defines and encloses it."""
    files = _java(spark, sf)
    wanted = files.select(F.substring_index("file", ".", 1).alias("key"), "file", F.lit(7).alias("line"))
    return java.snippets_table(files, wanted).select("key", "code")


@query("SELECT 'pkg.C' || p_partkey || '.t' AS method, 4 AS lines FROM part")
def bodies_of_callers(spark, sf):
    found = java.bodies_table(_java(spark, sf), "assertThrows")
    return found.select("method", F.size(F.filter(F.split("consumer_body", "\n"), lambda x: F.trim(x) != "@Test")).cast("long").alias("lines"))


# -- the model ---------------------------------------------------------------------------------------------------------


def _graph(spark, sf):
    return ingest.ingest(p.vertices(spark, sf), p.edges(spark, sf))


@query(f"""WITH {METHODS}, t AS (SELECT min(k) AS k FROM pm), o AS (SELECT split_part(fqn, '.m', 1) AS cls FROM pm
  WHERE k = (SELECT k FROM t)) SELECT fqn FROM pm WHERE split_part(fqn, '.m', 1) = (SELECT cls FROM o) AND k <> (SELECT k
  FROM t) AND size > 0""")
def siblings_of_a_target(spark, sf):
    """The target is located by name; its siblings are the other methods of its class."""
    first = table(spark, sf, "part").orderBy("p_partkey").select(p.brand().alias("b"), "p_partkey").first()
    g = _graph(spark, sf)
    node = plans.locate(g.methods, Target.parse(f"pkg.{first['b']}#m{first['p_partkey']}"))
    return plans.local_context(g, node)["siblings"].select("fqn")


@query(f"""WITH {METHODS} SELECT 'CALLS' AS kind, count(DISTINCT (a.fqn, b.fqn)) AS n FROM pc JOIN pm a ON a.k = l_partkey
  JOIN pm b ON b.k = l_suppkey UNION ALL SELECT 'OVERRIDES', count(*) FROM pm a JOIN pm b ON b.k = a.k - 1 WHERE a.size = 7
UNION ALL SELECT 'AST_CONTAINS', (SELECT count(*) FROM pc JOIN pm ON k = l_partkey) + (SELECT count(*) FROM orders JOIN pm ON k = o_custkey)""")
def multigraph_edges(spark, sf):
    return _graph(spark, sf).multigraph().select("kind", "src", "dst").distinct().groupBy("kind").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT 'p' || p_partkey AS id, CASE WHEN p_size <= 5 THEN 'T' ELSE substr(p_type, 1, 1) END AS l FROM part)
  SELECT id, l || row_number() OVER (PARTITION BY l ORDER BY id) AS ref FROM n""")
def typed_entities(spark, sf):
    """Parts as entities with typed references; small ones are tests."""
    nodes = table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"),
        F.col("p_type").alias("kind"), (F.col("p_size") <= 5).alias("is_test"), F.lit(False).alias("is_target"))
    edges = spark.createDataFrame([], "src string, dst string, kind string")
    return sinks.rag_slice(nodes, edges, d.event_chains(spark, sf))[0].select("id", "ref")


@query("""SELECT '{"data":{"id":"s' || s_suppkey || '","kind":"METHOD"}}' AS json FROM supplier UNION ALL
  SELECT '{"data":{"source":"c' || c_custkey || '","target":"n' || c_nationkey || '","layer":"DDG"}}' FROM customer""")
def viewer_elements(spark, sf):
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    nodes = table(spark, sf, "supplier").select(key("s", "s_suppkey").alias("id"), F.lit("METHOD").alias("kind"))
    return sinks.cytoscape(nodes, table(spark, sf, "customer").select(key("c", "c_custkey").alias("src"),
        key("n", "c_nationkey").alias("dst"), F.lit("DDG").alias("layer")))


@query("""WITH u AS (SELECT DISTINCT user_id FROM events
  WHERE event_type = 'view'), c AS (SELECT CASE WHEN event_type = 'error' THEN 'throws:E' ELSE 'other:' || event_type END AS class
  FROM events)
SELECT 'Test' AS type, count(*) AS n FROM u UNION ALL SELECT 'Method', 1 + (SELECT count(DISTINCT event_type) FROM events
  WHERE event_type <> 'view') UNION ALL SELECT 'BehaviorClass', count(DISTINCT class) FROM c UNION ALL SELECT 'InputProfile', 1
UNION ALL SELECT 'FailureMode', count(DISTINCT user_id % 3) FROM events WHERE event_type = 'error'""")
def knowledge_of_a_target(spark, sf):
    """Views stand for the target: its tests, behaviour classes, inputs, failure modes and methods covered beside it."""
    events = table(spark, sf, "events")
    user = F.concat(F.lit("U.u"), F.col("user_id").cast("string"))
    bad = F.col("event_type") == "error"
    values = events.select(F.lit("view").alias("method"), user.alias("test"),
        F.array((F.col("user_id") % 10).cast("string"), F.lit("2"), "props").alias("args"),
        F.when(bad, "throws E: no").otherwise(F.col("event_type")).alias("result"), bad.alias("throws"),
        F.col("event_id").alias("ord"))
    coverage = events.select(F.col("event_type").alias("method"), user.alias("test")).distinct()
    fails = events.where(bad).select(user.alias("test"), F.concat(F.lit("org.E"),
        (F.col("user_id") % 3).cast("string")).alias("type"), F.lit("m").alias("message")).distinct()
    covering = coverage.where("method = 'view'").select("test")
    nodes, _ = knowledge.build("view", values, coverage, fails, covering, knowledge.exemplars(covering), "no (place) (here)")
    return nodes.groupBy("type").agg(F.count("*").alias("n"))


# -- statistics --------------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS b,
  count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS c FROM labels WHERE doc_id < 40), k AS (SELECT b + c AS n, least(b, c) AS k
  FROM c)
SELECT round(least(1.0, 2 * (SELECT sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) - n * ln(2.0))) FROM generate_series(0, (SELECT k FROM k)) g(i))), 6) AS p FROM k""".replace(" WHERE doc_id < 40", ""))
def paired_test_p(spark, sf):
    """The exact two-sided p of quality against toxicity as paired outcomes."""
    pairs = table(spark, sf, "labels").select(F.col("quality").alias("a"), F.col("toxic").alias("b"))
    return spark.createDataFrame([(round(float(stats.mcnemar(pairs)[0]), 6),)], "p double")


@query("SELECT source AS arm, true AS inside FROM documents JOIN labels USING (doc_id) GROUP BY source")
def bootstrap_holds_the_rate(spark, sf):
    """Whether each arm's resampled interval holds its pass rate."""
    both = table(spark, sf, "documents").select("doc_id", F.col("source").alias("arm")).join(table(spark, sf, "labels"), "doc_id")
    runs = both.select("arm", (F.col("quality") == 1).alias("passed"))
    rate = runs.groupBy("arm").agg(F.avg(F.col("passed").cast("double")).alias("rate"))
    return stats.bootstrap(runs).join(rate, "arm").select("arm", F.col("rate").between(F.col("low") - 1e-9, F.col("high") + 1e-9).alias("inside"))


@query("""WITH s AS (SELECT source, avg(CAST(quality AS DOUBLE)) AS p FROM documents JOIN labels USING (doc_id) GROUP BY 1)
  SELECT (SELECT p FROM s WHERE source = 'src0') >= greatest((SELECT p FROM s WHERE source = 'src1'), (SELECT p FROM s
  WHERE source = 'src2')) AS additive""")
def arm_at_least_its_parts(spark, sf):
    both = table(spark, sf, "documents").select("doc_id", F.col("source").alias("arm")).join(table(spark, sf, "labels"), "doc_id")
    return stats.additive(both.groupBy("arm").agg(F.avg(F.col("quality").cast("double")).alias("pass_at_one")), "src0", ["src1", "src2"])


# -- streams -----------------------------------------------------------------------------------------------------------


def _drained(stream: DataFrame, name: str) -> DataFrame:
    """All that a stream gives over what lies there, written and read."""
    spark = stream.sparkSession
    folder = shared_path(spark, name)
    stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation",
        f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


@query("SELECT DISTINCT 'M' || l_suppkey AS method, 'T' || l_orderkey AS test FROM lineitem WHERE l_returnflag <> 'N'")
def matrix_as_a_stream(spark, sf):
    kind = F.when(F.col("l_returnflag") == "N", "inner").otherwise("outer")
    row = F.concat_ws("\t", F.concat(F.lit("M"), F.col("l_suppkey").cast("string")), F.concat(F.lit("T"), F.col("l_orderkey").cast("string")), kind)
    return _drained(capture.matrix_stream(spark, _written(table(spark, sf, "lineitem").select(row.alias("value")), "probe")), "matrix")


@query("""SELECT event_type AS method, CAST(user_id AS VARCHAR) AS test,
  CAST(event_id AS VARCHAR) AS args, event_type = 'error' AS throws FROM events
  QUALIFY row_number() OVER (PARTITION BY event_type, user_id
  ORDER BY event_id) <= CASE WHEN event_type = 'error' THEN 2 ELSE 6 END""")
def values_capped_as_a_stream(spark, sf):
    """The first calls of each method and test, fewer of those that threw; one file, so one batch in order."""
    path = shared_path(spark, "values")
    rows = table(spark, sf, "events").select(F.col("event_type").alias("method"), F.col("user_id").cast("string").alias("test"),
        F.col("event_id").cast("string").alias("args"), F.lit("r").alias("result"),
        (F.col("event_type") == "error").alias("throws"), F.col("event_id").alias("ord"))
    rows.write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    return _drained(capture.capped_values(stream), "capped").select("method", "test", "args", "throws")
