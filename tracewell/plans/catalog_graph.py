"""Registered queries on the program graph: reading, indexing, chains, dependence, predicates and names."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names, predicates
from ..operators import chains, dependence, dyadic, impact, ingest, knowledge, localize, ranking, traverse
from ..sources import graph, sinks, text
from . import derived as d
from . import program as p
from .catalog import BACK, ORACLE_SQL, QUERIES, query
from .derived import table
from .program import METHODS

__all__ = ["ORACLE_SQL", "QUERIES"]


@query(f"WITH {METHODS} SELECT 'vertex' AS part, 'METHOD' AS label, count(*) AS n FROM pm UNION ALL SELECT 'vertex', 'TYPE_DECL', count(DISTINCT p_brand) FROM part UNION ALL SELECT 'vertex', 'CALL', count(*) FROM pc"
       " UNION ALL SELECT 'vertex', 'CONTROL_STRUCTURE', count(*) FROM orders UNION ALL SELECT 'edge', 'CALL', count(*) FROM pc UNION ALL SELECT 'edge', 'AST', count(*) FROM orders UNION ALL SELECT 'edge', 'OVERRIDES', count(*) FROM pm WHERE size = 7")  # fmt: skip
def graph_label_counts(spark, sf):
    return graph.label_counts(p.vertices(spark, sf), p.edges(spark, sf))


@query(f"WITH {METHODS} SELECT DISTINCT pm.fqn AS caller, 'pkg.X.m' || l_suppkey AS callee FROM pc JOIN pm ON pm.k = pc.l_partkey")
def graph_call_map(spark, sf):
    return graph.call_map(p.vertices(spark, sf))


@query(f"WITH {METHODS} SELECT fqn, replace(file, '/__t__/', '/test/') AS file, size AS line_start, size + 9 AS line_end FROM pm")
def graph_method_index(spark, sf):
    index = graph.method_index(p.vertices(spark, sf))
    return index.select("fqn", "file", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"))


@query(f"""WITH {METHODS} SELECT DISTINCT 'CALLS' AS kind, 'm:' || a.fqn || ':void(int)' AS src,
  'm:' || b.fqn || ':void(int)' AS dst FROM pc JOIN pm a ON a.k = l_partkey JOIN pm b ON b.k = l_suppkey
UNION ALL SELECT 'AST_CONTAINS', 'm:' || fqn || ':void(int)', 'cs:' || id FROM pc JOIN pm ON k = l_partkey
UNION ALL SELECT 'AST_CONTAINS', 'm:' || fqn || ':void(int)', 's:o' || o_orderkey FROM orders JOIN pm ON k = o_custkey
UNION ALL SELECT 'OVERRIDES', 'm:' || a.fqn || ':void(int)', 'm:' || b.fqn || ':void(int)' FROM pm a JOIN pm b ON b.k = a.k - 1 WHERE a.size = 7""")
def ingest_edges(spark, sf):
    """Calls from their enclosing methods, containment and overriding, between model ids."""
    return ingest.ingest(p.vertices(spark, sf), p.edges(spark, sf)).edges.select("kind", "src", "dst").distinct()


@query(f"""WITH {METHODS} SELECT 'METHOD' AS kind, count(*) AS n FROM pm UNION ALL SELECT 'TYPE', count(DISTINCT p_brand) FROM part
  UNION ALL SELECT 'CALL_SITE', count(*) FROM pc JOIN pm ON k = l_partkey
UNION ALL SELECT 'STMT', count(*) FROM orders JOIN pm ON k = o_custkey""")
def ingest_node_counts(spark, sf):
    return ingest.ingest(p.vertices(spark, sf), p.edges(spark, sf)).nodes().groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""WITH {METHODS} SELECT fqn, replace(file, '__t__', 'test') AS file, size <= 5 AS is_test FROM pm""")
def ingest_methods(spark, sf):
    """Methods with their own flag and file names as they were before staging."""
    return ingest.ingest(p.vertices(spark, sf), p.edges(spark, sf)).methods.select("fqn", "file", "is_test")


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n FROM lineitem), m AS (SELECT o, min(n) AS low FROM l
  GROUP BY o), r AS (SELECT l.o, l.n, row_number() OVER (PARTITION BY l.o ORDER BY l.n) AS k FROM l)
SELECT o || '#' || n AS raw, 'o' || o AS method_raw FROM r WHERE k > 1 OR n IN (SELECT low FROM m WHERE m.o = r.o)""")
def enclosing_by_climbing(spark, sf):
    """Lines of an order hang below each other, the first one below the order, which is the method."""
    return ingest.enclosing_methods(*enclosing_tree(spark, sf))


def enclosing_tree(spark, sf):
    """That tree: (vertices, edges)."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").repartition("l_orderkey").distinct()  # and its windows need no other order
    node = F.concat_ws("#", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    above = F.lag(node).over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    order = F.concat(F.lit("o"), F.col("l_orderkey").cast("string"))
    tree = lines.select(F.lit("AST").alias("label"), F.coalesce(above, order).alias("out_v"), node.alias("in_v"))
    nothing = F.lit(None).cast("string").alias("parent_method_id")
    nodes = lines.select(node.alias("id"), F.lit("CALL").alias("label"), nothing).union(lines.select(order, F.lit("METHOD"), nothing).distinct())
    return nodes, tree


@query("""SELECT CAST(c.p_partkey AS VARCHAR) AS child, CAST(q.p_partkey AS VARCHAR) AS parent FROM part c
  JOIN part q ON c.p_type = q.p_type AND c.p_size % 10 = q.p_size % 10
WHERE (c.p_brand = 'Brand#1' AND q.p_brand = 'Brand#2') OR (c.p_brand = 'Brand#2' AND q.p_brand = 'Brand#3')""")
def overrides_by_signature(spark, sf):
    """Parts of a brand override those of the next one with the same type and last digit of the size."""
    fqn = F.concat_ws(".", F.translate("p_brand", "#", "_"), F.translate("p_type", " ", "_"))
    methods = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), fqn.alias("fqn"),
        (F.col("p_size") % 10).cast("string").alias("signature"))
    inherits = spark.createDataFrame([("Brand_1", "Brand_2"), ("Brand_2", "Brand_3")], "sub string, super string")
    return graph.derived_overrides(methods, inherits)


@query("""WITH b AS (SELECT p_brand AS owner, p_type AS name, CAST(p_partkey AS VARCHAR) AS id
  FROM part), f AS (SELECT name, min_by(id, (owner, id)) AS any_id FROM b GROUP BY name),
a AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS m,
  CASE WHEN l_returnflag = 'R' THEN '' ELSE p_brand END AS r, p_type AS name, l_linestatus = 'O' AS w FROM lineitem
  JOIN part ON p_partkey = l_partkey),
x AS (SELECT m, coalesce(b.id, CASE WHEN r = '' THEN any_id END) AS id, w FROM a LEFT JOIN b ON b.owner = a.r AND b.name = a.name
  LEFT JOIN f ON f.name = a.name)
SELECT DISTINCT m AS method_id, id AS field_id, 'READS' AS kind FROM x WHERE id IS NOT NULL UNION SELECT DISTINCT m, id, 'WRITES'
  FROM x WHERE w AND id IS NOT NULL""")
def field_access_by_owner(spark, sf):
    """Orders read fields named by type, of the part's brand or of an unknown owner; open items also write."""
    part, items = table(spark, sf, "part"), table(spark, sf, "lineitem")
    members = part.select(F.col("p_brand").alias("owner"), F.col("p_type").alias("name"), F.col("p_partkey").cast("string").alias("id"))
    met = items.join(part.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type"), "l_partkey")
    receiver = F.when(F.col("l_returnflag") == "R", "").otherwise(F.col("p_brand"))
    accesses = met.select(F.col("l_orderkey").cast("string").alias("method_id"), receiver.alias("receiver"),
        F.col("p_type").alias("name"), (F.col("l_linestatus") == "O").alias("is_target")).distinct()
    return graph.derived_field_access(accesses, members)


@query("SELECT DISTINCT c_name AS sub, n_name AS super FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1")
def inherits_known_types(spark, sf):
    """Customers inherit from their nation where it is known, which those of one region are."""
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    stated = table(spark, sf, "customer").join(nation, "c_nationkey").select(F.col("c_name").alias("sub"), F.col("n_name").alias("super"))
    return graph.resolved_inherits(stated, nation.where("n_regionkey = 1").select(F.col("n_name").alias("fqn")))


@query("SELECT p_partkey, p_name AS plain, p_partkey AS wrapped, p_size AS listed, p_brand AS deep FROM part")
def unwrapped_properties(spark, sf):
    """Each part as a document whose properties are plain, typed, in a list, and in a typed list of vertex properties."""
    value = lambda v: F.struct(F.lit("t").alias("@type"), v.alias("@value"))
    doc = F.struct(
        F.col("p_name").alias("plain"), value(F.col("p_partkey")).alias("wrapped"), F.array("p_size", F.lit(-1)).alias("listed"),
        value(F.array(value(F.struct(value(F.col("p_brand")).alias("value"))))).alias("deep"),
    )
    rows = table(spark, sf, "part").select("p_partkey", F.parse_json(F.to_json(doc)).alias("v"))
    take = lambda c: graph.unwrap(F.col("v"), f"$.{c}")
    return rows.select("p_partkey", take("plain").alias("plain"), take("wrapped").cast("long").alias("wrapped"),
        take("listed").cast("long").alias("listed"), take("deep").alias("deep"))


# -- chains ------------------------------------------------------------------------------------------------------------


@query(BACK.format(most=60) + """ SELECT CAST(pg.src AS VARCHAR) AS test,
  CAST(pg.dst AS VARCHAR) AS entry, i.depth + 1 AS depth, true AS linked FROM pg JOIN inner_ i ON i.node = pg.dst
WHERE pg.src IN (SELECT node FROM tests) AND (i.depth = 0 OR pg.dst NOT IN (SELECT node FROM tests))""")
def reverse_chains_with_steps(spark, sf):
    """Every chain from a test to the busiest part with its steps, which follow each other and end at the target."""
    found = d.written_calls(spark, sf)
    calls = found.select(F.col("caller").cast("string").alias("caller"), F.col("callee").cast("string").alias("callee"), "virtual", "ord")
    target = str(d.busiest(spark, sf, found).first()["node"])
    tests = d.part_tests(spark, sf).select(F.col("node").cast("string").alias("node"))
    found = traverse.reverse_chains(calls, target, tests, max_depth=None, most=None)
    follows = F.forall(F.sequence(F.lit(1), F.size("steps")),
        lambda i: F.when(i == F.size("steps"), F.element_at("steps", i)["callee"] == target).otherwise(F.get("steps",
        i - 1)["callee"] == F.get("steps", i)["caller"]))
    return found.select("test", F.col("steps")[0]["callee"].alias("entry"), F.col("depth").cast("long").alias("depth"), follows.alias("linked"))


@query("""WITH ev AS (SELECT user_id, CAST(ts AS DATE) AS day, min(event_id) AS chain_id, string_agg(event_type, ' -> '
  ORDER BY ts, event_id) AS s FROM events GROUP BY 1, 2) SELECT chain_id, CAST(user_id AS VARCHAR) || ' -> ' || s AS text FROM ev""")
def chain_lines(spark, sf):
    return sinks.chain_text(d.event_chains(spark, sf))


@query("""WITH ev AS (SELECT user_id, CAST(ts AS DATE) AS day, min(event_id) AS chain_id, string_agg(event_type, '>'
  ORDER BY ts, event_id) AS s, count(*) AS n FROM events GROUP BY 1, 2)
SELECT min(chain_id) OVER (PARTITION BY s) AS first_chain, chain_id, CAST(user_id AS VARCHAR) AS test FROM ev WHERE n >= 2""")
def cluster_members(spark, sf):
    found = d.event_chains(spark, sf)
    return chains.members(found, chains.clusters(found))


@query("""WITH ev AS (SELECT user_id, CAST(ts AS DATE) AS day, min(event_id) AS chain_id, list(event_type
  ORDER BY ts, event_id) AS types FROM events GROUP BY 1, 2), c AS (SELECT types, min(chain_id) AS first_chain FROM ev
  WHERE len(types) >= 2 GROUP BY types),
sc AS (SELECT event_type AS fqn, CAST(count(*) AS DOUBLE) AS score FROM events WHERE event_type <> 'view'
  GROUP BY 1), f AS (SELECT DISTINCT first_chain, unnest(types) AS fqn
  FROM c), j AS (SELECT first_chain, fqn, score, row_number() OVER (PARTITION BY first_chain ORDER BY score DESC, fqn) AS k FROM f
  JOIN sc USING (fqn))
SELECT c.first_chain, max(score) AS hub_score, string_agg(fqn, ',' ORDER BY k) FILTER (WHERE k <= 2) AS hubs FROM c LEFT
  JOIN j ON j.first_chain = c.first_chain GROUP BY c.first_chain""")
def clusters_by_hubs(spark, sf):
    """Clusters with the greatest score on their way and the two methods that have it; views score nothing."""
    scores = table(spark, sf, "events").where("event_type != 'view'").groupBy(F.col("event_type").alias("fqn")).agg(F.count("*").cast("double").alias("score"))
    out = chains.hub_order(chains.clusters(d.event_chains(spark, sf)), scores)
    return out.select("first_chain", "hub_score", F.array_join("hubs", ",").alias("hubs"))


@query("""SELECT 'pkg.WidgetTest.t' || doc_id AS test, 'assert Widget ' || n_chars AS snippet FROM documents
  ORDER BY length('assert Widget ' || n_chars), test LIMIT 6""")
def shortest_behavioural_tests(spark, sf):
    """The shortest snippets that assert about the target's class; documents of other languages lie in other classes."""
    docs = table(spark, sf, "documents")
    rows = docs.select(F.concat(F.lit("pkg.WidgetTest.t"), F.col("doc_id").cast("string")).alias("test"),
        F.concat(F.lit("assert Widget "), F.col("n_chars").cast("string")).alias("snippet"))
    other = docs.select(F.concat(F.lit("pkg.OtherTest.t"), F.col("doc_id").cast("string")).alias("test"), F.lit("assert Widget").alias("snippet"))
    silent = docs.select(F.concat(F.lit("pkg.WidgetTest.s"), F.col("doc_id").cast("string")).alias("test"), F.lit("Widget").alias("snippet"))
    return chains.behavioural_tests(rows.union(other).union(silent), "pkg.Widget").select("test", "snippet")


@query("""WITH d AS (SELECT DISTINCT source, lang FROM documents), n AS (SELECT source, count(*) FILTER (WHERE lang = 'en') AS en,
  count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'fr') AS fr FROM d GROUP BY source)
SELECT source AS consumer, 'result is never null: it is dereferenced' AS requirement FROM n WHERE en > 0 UNION ALL
  SELECT source, 'result steers the caller''s control flow' FROM n WHERE de > 0 UNION ALL
  SELECT source, 'result goes on to another method' FROM n WHERE fr > 0
UNION ALL SELECT source, CASE WHEN fr > 0 THEN 'exceptions are caught: E_fr' ELSE 'exceptions reach the caller' END FROM n""")
def implied_by_usages(spark, sf):
    """What usages and handlers of a source's documents imply: languages stand for kinds of usage."""
    docs = table(spark, sf, "documents").select(F.col("source").alias("consumer"), "lang").distinct()
    kind = F.when(F.col("lang") == "en", "METHOD_CALL_ON_RESULT").when(F.col("lang") == "de",
        "USED_IN_CONDITION").when(F.col("lang") == "fr", "PASSED_AS_ARG").otherwise("ASSIGNED_TO_LOCAL")
    return chains.implied_requirements(docs.select("consumer", kind.alias("kind"), F.lit(None).cast("string").alias("field")),
        docs.where("lang = 'fr'").select("consumer", F.lit("E_fr").alias("type")))


@query("SELECT DISTINCT replace(p_brand, ' ', '_') AS cls FROM part")
def test_command_classes(spark, sf):
    rows = table(spark, sf, "part").select(F.concat_ws(".", F.translate("p_brand", " ", "_"), F.col("p_partkey").cast("string")).alias("test"))
    return chains.test_command_classes(rows)


# -- dependence --------------------------------------------------------------------------------------------------------

STEPS = """l AS (SELECT o, row_number() OVER (PARTITION BY o ORDER BY line) AS n
  FROM (SELECT DISTINCT l_orderkey AS o, l_linenumber AS line FROM lineitem)), w AS (SELECT o, max(n) AS last, count(*) AS size FROM l
  GROUP BY o)"""


def _statements(spark, sf):
    """Orders as methods: the first line is a branch over the second, the others follow."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    rows = rows.select("l_orderkey", n.alias("n"))
    n = F.col("n")
    return rows.select(F.col("l_orderkey").cast("string").alias("method"), n.cast("int").alias("ordinal"),
        F.when(n == 1, "IF").otherwise("EXPR").alias("kind"), F.when(n == 2, 1).otherwise(-1).cast("int").alias("parent"),
        F.when(n == 2, "then").otherwise("body").alias("branch"))


@query(f"""WITH {STEPS} SELECT CAST(o AS VARCHAR) AS method, 1 AS src, 2 AS dst FROM w WHERE size >= 2 UNION ALL
  SELECT CAST(o AS VARCHAR), 1, 3 FROM w WHERE size >= 3 UNION ALL SELECT CAST(o AS VARCHAR), 2, 3 FROM w WHERE size >= 3
UNION ALL SELECT CAST(o AS VARCHAR), n - 1, n FROM l WHERE n > 3""")
def control_flow_of_orders(spark, sf):
    return dependence.control_flow(_statements(spark, sf)).select("method", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))


@query(f"""WITH {STEPS} SELECT CAST(o AS VARCHAR) AS method, 1 AS src, 2 AS dst FROM w WHERE size >= 3""")
def control_dependence_of_orders(spark, sf):
    """The second line runs or not by the first one's choice."""
    return dependence.control_dependence(dependence.control_flow(_statements(spark, sf))).select("method",
        F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))


@query("""WITH c AS (SELECT DISTINCT o_custkey AS a, l_suppkey AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  WHERE o_orderpriority = '1-URGENT')
SELECT 'CG' AS layer, 'n' || a || '.' || b AS src, 'm:S.' || b AS dst, 'EXACT' AS resolution FROM c UNION ALL
  SELECT 'ARG_PASS', 'n' || a || '.' || b, 'p' || b, 'EXACT' FROM c UNION ALL SELECT 'RETURN_BIND', 'r' || b, 'n' || a || '.' || b,
  'EXACT' FROM c""")
def composed_calls(spark, sf):
    """Customers call the suppliers of their urgent orders at one place each; suppliers have a parameter and a return."""
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"),
        F.col("o_custkey").cast("string").alias("a"))
    met = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").cast("string").alias("b")).join(urgent, "l_orderkey").select("a", "b").distinct()
    calls = met.select(F.col("a").alias("caller"), F.concat(F.lit("S."), "b").alias("callee"), F.lit(False).alias("virtual"))
    sites = met.select(F.col("a").alias("method"), F.col("b").alias("callee_name"), F.concat(F.lit("n"), "a", F.lit("."), "b").alias("node"))
    ends = lambda c: met.select(F.concat(F.lit("S."), "b").alias("method"), F.concat(F.lit(c), "b").alias("node")).distinct()
    none = spark.createDataFrame([], "layer string, src string, dst string")
    return dependence.compose(none, calls, sites, ends("p"), ends("r"))


@query("""WITH e AS (SELECT DISTINCT l_orderkey || '.' || l_linenumber AS node, l_orderkey || '.' || (l_linenumber - 1) AS back
  FROM lineitem WHERE l_linenumber > 1), s AS (SELECT DISTINCT l_orderkey AS key, l_orderkey || '.' || l_linenumber AS node
  FROM lineitem WHERE l_linenumber = 4)
SELECT s.key, e.back AS node, 1 AS depth FROM s JOIN e ON e.node = s.node UNION ALL SELECT s.key, f.back, 2 FROM s
  JOIN e ON e.node = s.node JOIN e f ON f.node = e.back""")
def walk_two_steps_back(spark, sf):
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    node = lambda k: F.concat_ws(".", F.col("l_orderkey").cast("string"), (F.col("l_linenumber") - k).cast("string"))
    back = items.where("l_linenumber > 1").select(node(0).alias("node"), node(1).alias("back"))
    seeds = items.where("l_linenumber = 4").select(F.col("l_orderkey").alias("key"), node(0).alias("node"))
    return localize.walk(back, seeds).withColumn("depth", F.col("depth").cast("long"))


# -- locating and ranking ----------------------------------------------------------------------------------------------


@query("""WITH f AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n, l_suppkey AS s, CAST(l_quantity AS BIGINT) AS line
  FROM lineitem WHERE l_returnflag = 'R'), m AS (SELECT f.*, p_partkey AS id, p_size AS a, p_size + 9 AS b FROM f
  JOIN part ON p_partkey % 100 = s % 100)
SELECT o, n, s, line, id AS method_id FROM m QUALIFY row_number() OVER (PARTITION BY o, n, s, line
  ORDER BY CASE WHEN line BETWEEN a AND b THEN 0 ELSE 1 END, a, CAST(id AS VARCHAR)) = 1""")
def overloads_by_line(spark, sf):
    """Frames name a supplier's group of parts; the overload is the one whose lines hold the frame's, else the first."""
    items = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_suppkey",
        F.col("l_quantity").cast("long").alias("line")).distinct()
    frames = items.select(F.concat_ws("#",
        *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_suppkey", "line")]).alias("trace_id"),
        F.lit(0).alias("cause_ix"), F.lit(0).alias("frame_ix"), F.lit("G").alias("cls"),
        (F.col("l_suppkey") % 100).cast("string").alias("method"), "line", F.col("l_orderkey").alias("o"),
        F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("s"))
    spans = table(spark, sf, "part").select(F.concat(F.lit("G."), (F.col("p_partkey") % 100).cast("string")).alias("fqn"),
        F.col("p_partkey").cast("string").alias("id"), F.col("p_size").alias("line_start"), (F.col("p_size") + 9).alias("line_end"),
        F.lit("f").alias("file"))
    return localize.resolve_methods(frames, spans).select("o", "n", "s", "line", F.col("method_id").cast("long").alias("method_id"))


@query("""SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_size BETWEEN s_nationkey * 2 AND s_nationkey * 2 + 3""")
def ranges_without_a_key(spark, sf):
    """Parts whose size lies in a supplier's span."""
    spans = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_nationkey") * 2).alias("low"), (F.col("s_nationkey") * 2 + 3).alias("high"))
    return dyadic.in_spans(table(spark, sf, "part").select("p_partkey", "p_size"), spans, "p_size", "low", "high").select("p_partkey", "s_suppkey")


@query("""SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM supplier
  WHERE s_acctbal > 5000 AND p_size BETWEEN s_nationkey * 2 AND s_nationkey * 2 + 3)""")
def ranges_that_exist(spark, sf):
    """Parts whose size lies in any span of a supplier with a large balance."""
    spans = table(spark, sf, "supplier").where("s_acctbal > 5000").select((F.col("s_nationkey") * 2).alias("low"), (F.col("s_nationkey") * 2 + 3).alias("high"))
    return dyadic.in_any(table(spark, sf, "part").select("p_partkey", "p_size"), spans, "p_size", "low", "high").select("p_partkey")


@query("""WITH d AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS fqn FROM lineitem
  WHERE l_suppkey = 1), n AS (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS fqn FROM part
  WHERE CAST(p_partkey AS VARCHAR) LIKE '%7%' AND CAST(p_partkey AS VARCHAR) NOT IN (SELECT fqn FROM d) ORDER BY fqn LIMIT 10)
SELECT fqn, 'caller' AS why FROM d UNION ALL SELECT fqn, 'name' FROM n""")
def focus_of_a_target(spark, sf):
    """Callers of a supplier, then ten parts whose number holds a seven."""
    calls = table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("caller"), F.col("l_suppkey").cast("string").alias("callee"))
    methods = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("fqn"))
    return knowledge.focus_set(calls, "1", methods, ["7"])


@query("""WITH x AS (SELECT doc_id, 'expected:<' || substr(regexp_replace(text, '[^a-z]', '', 'g'), 1,
  40 + doc_id % 30) || '\\n ' || '> but was' AS m FROM documents WHERE length(regexp_replace(text, '[^a-z]', '', 'g')) >= 100)
SELECT 'T.t' || doc_id AS test, substr(m, 11, length(m) - 19) AS excerpt FROM x ORDER BY length(m), test LIMIT 4""")
def golden_outputs(spark, sf):
    """The shortest expected sides of comparison failures, one for each long document."""
    letters = F.regexp_replace("text", "[^a-z]", "")
    docs = table(spark, sf, "documents").where(F.length(letters) >= 100)
    message = F.concat(F.lit("expected:<"), F.expr("substr(regexp_replace(text, '[^a-z]', ''), 1, cast(40 + doc_id % 30 as int))"), F.lit("\\n > but was"))
    rows = docs.select(F.concat(F.lit("T.t"), F.col("doc_id").cast("string")).alias("test"),
        F.lit("org.ComparisonFailure").alias("type"), message.alias("message"))
    return knowledge.golden_outputs(rows)


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS test,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'assertion' WHEN o_orderpriority = '2-HIGH' THEN 'n-a' ELSE 'exception' END AS kind
  FROM orders WHERE o_orderstatus = 'F'""")
def kinds_of_red_orders(spark, sf):
    """Failed orders by where their deepest cause lies: test code, production code, or nowhere in the project."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("test"), (F.col("o_orderstatus") != "F").alias("ok"), "o_orderpriority")
    cls = F.when(F.col("o_orderpriority") == "1-URGENT", "p.Test").when(F.col("o_orderpriority") == "2-HIGH", "q.Lib").otherwise("p.Code")
    roots = orders.select(F.col("test").alias("trace_id"), F.lit(0).alias("frame_ix"), cls.alias("cls"), F.lit("m").alias("method"))
    return localize.kinds_of_red(orders, roots, spark.createDataFrame([("p.Test.m",)], "fqn string"), "p.")


@query("""WITH t AS (SELECT l_orderkey AS o, l_linenumber AS n, l_suppkey AS s, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_suppkey) AS k FROM lineitem WHERE l_returnflag = 'A') SELECT o AS key, 'L' || n || ': s' || s AS entry
  FROM (SELECT o, n, s, min(k) AS k FROM t GROUP BY o, n, s) QUALIFY row_number() OVER (PARTITION BY o ORDER BY n, s) <= 3""")
def first_distinct_lines(spark, sf):
    rows = table(spark, sf, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("key"),
        F.col("l_linenumber").alias("line"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("code"), "l_suppkey")
    return localize.distinct_codes(rows, 3, ["line", "l_suppkey"]).select("key", "entry")


@query("""WITH s AS (SELECT l_orderkey AS m, l_linenumber AS n, min(l_returnflag) AS f FROM lineitem
  GROUP BY 1, 2), x AS (SELECT m, n, f = 'R' AS strong, max(CASE WHEN f = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY m) AS any_ FROM s)
SELECT CAST(m AS VARCHAR) AS method_id, n AS line FROM x WHERE strong OR any_ = 0 QUALIFY row_number() OVER (PARTITION BY m ORDER BY n) <= 3""")
def value_shaping_lines(spark, sf):
    """Returned lines of an order, or its first three lines where nothing was returned."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"))
    n = F.col("l_linenumber")
    rows = lines.select(F.col("l_orderkey").cast("string").alias("method_id"), n.alias("line"),
        F.concat_ws("#", F.col("l_orderkey").cast("string"), n.cast("string")).alias("id"),
        F.when(F.col("f") == "R", "RETURN").otherwise("CALL").alias("label"), F.lit("x").alias("name"), F.lit("x").alias("code"),
        n.alias("ord"))
    none = spark.createDataFrame([], "node string, back string")
    return localize.value_shaping(rows, spark.createDataFrame([], "method string"), none).select("method_id", F.col("line").cast("long").alias("line"))


@query("""WITH c AS (SELECT p_partkey AS k, CASE WHEN p_size > 45 THEN 'org.other.' ELSE 'pkg.' END || p_type AS name FROM part)
  SELECT k FROM c WHERE name LIKE 'pkg.%' AND name IN (SELECT 'pkg.' || p_type FROM part WHERE p_size BETWEEN 6 AND 20)""")
def calls_to_production(spark, sf):
    part = table(spark, sf, "part")
    calls = part.select(F.col("p_partkey").alias("k"), F.concat(F.when(F.col("p_size") > 45, "org.other.").otherwise("pkg."), "p_type").alias("name"))
    methods = part.select(F.concat(F.lit("pkg."), "p_type").alias("fqn"), (~F.col("p_size").between(6, 20)).alias("is_test_code"))
    return localize.production_targets(calls, "pkg.", methods).select("k")


@query("""SELECT n_nationkey AS n, n_name AS text FROM nation WHERE n_nationkey < 6 UNION ALL SELECT 6, '…'""")
def cut_after_seven(spark, sf):
    """A list of nations cut to seven lines, the last of which says so."""
    return ranking.cut_with_marker(table(spark, sf, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("text")), 7).select("n", "text")


# -- predicates and names ----------------------------------------------------------------------------------------------


@query(f"""WITH {METHODS}, f AS (SELECT k, fqn, file, size <= 5 AS t, file LIKE '%/__t__/%' AS folder, split_part(fqn, '.m', 1) AS cls FROM pm)
SELECT k, t OR folder OR cls IN (SELECT cls FROM f WHERE folder) AS is_test_code, t AS is_entry FROM f""")
def test_code_flags(spark, sf):
    """Parts flagged, in the test folder, or with a sibling there; entry points by flag and name alone here."""
    part = table(spark, sf, "part")
    rows = part.select(F.col("p_partkey").alias("k"), p.method_name().alias("fqn"), p.source_file().alias("file"), (F.col("p_size") <= 5).alias("is_test"))
    flagged = predicates.test_code(rows)
    return flagged.select("k", "is_test_code", predicates.is_entry().alias("is_entry"))


@query("""WITH a AS (SELECT l_partkey AS k, min(l_returnflag) AS f FROM lineitem GROUP BY 1)
  SELECT p_partkey AS k, coalesce(f = 'A', false) OR p_size > 48 AS is_test FROM part LEFT JOIN a ON a.k = p_partkey""")
def annotated_test_flags(spark, sf):
    """Parts whose least return flag is A have a test annotation as a child; large ones lie in the test folder."""
    part = table(spark, sf, "part")
    methods = part.select(F.col("p_partkey").cast("string").alias("id"), F.lit(None).cast("boolean").alias("is_test"),
        F.when(F.col("p_size") > 48, "src/test/java/X.java").otherwise("src/main/java/X.java").alias("file"))
    least = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.min("l_returnflag").alias("f"))
    child = F.concat(F.lit("a"), F.col("l_partkey").cast("string"))
    ast = least.select(F.col("l_partkey").cast("string").alias("src"), child.alias("dst"))
    notes = least.select(child.alias("id"), F.when(F.col("f") == "A", "org.Test").otherwise("org.Other").alias("full_name"), F.lit("x").alias("name"))
    out = predicates.promote_test_folders(predicates.annotated_tests(methods, ast, notes), True)
    return out.select(F.col("id").cast("long").alias("k"), "is_test")


@query("""WITH n AS (SELECT p_partkey AS k,
  CASE p_size % 6 WHEN 0 THEN 'java.util.L.add' WHEN 1 THEN 'pkg.A$1.run' WHEN 2 THEN 'kotlin.X.y' WHEN 3 THEN 'pkg.FooTest.x' WHEN 4 THEN 'pkg.Foo.testIt' ELSE 'pkg.Foo.x' END AS fqn,
  CASE WHEN p_size > 40 THEN 'a/samples/F.java' WHEN p_size > 30 THEN 'a/x-examples/F.java' ELSE 'a/main/F.java' END AS file
  FROM part)
SELECT k, regexp_matches(fqn, '^(java|kotlin)\\.') AS platform, file NOT LIKE 'a/main/%' OR fqn LIKE '%$1%' AS peripheral,
  fqn LIKE '%FooTest%' OR fqn LIKE '%.test%' AS entry FROM n""")
def method_predicates(spark, sf):
    r = F.col("p_size") % 6
    fqn = F.when(r == 0, "java.util.L.add").when(r == 1, "pkg.A$1.run").when(r == 2, "kotlin.X.y").when(r == 3,
        "pkg.FooTest.x").when(r == 4, "pkg.Foo.testIt").otherwise("pkg.Foo.x")
    file = F.when(F.col("p_size") > 40, "a/samples/F.java").when(F.col("p_size") > 30, "a/x-examples/F.java").otherwise("a/main/F.java")
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), fqn.alias("fqn"), file.alias("file"), F.lit(False).alias("is_test"))
    return rows.select("k", predicates.platform("fqn").alias("platform"), predicates.peripheral("file", "fqn").alias("peripheral"),
        predicates.is_entry().alias("entry"))


@query("""SELECT p_partkey AS k, p_size % 5 = 0 OR p_size % 5 = 1 OR p_size % 5 = 3 AS in_views, p_size % 5 IN (0, 1, 2) AS in_slices FROM part""")
def assertion_like_names(spark, sf):
    """Calls that assert by their simple name; slices ignore case and know two prefixes alone."""
    r = F.col("p_size") % 5
    name = F.when(r == 0, "org.A.assertEquals").when(r == 1, "x.B.failFast").when(r == 2, "x.B.AssertThat").when(r == 3, "y.verifyAll").otherwise("y.Assert.go")
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), name.alias("name"))
    return rows.select("k", predicates.assertion_like("name", "view").alias("in_views"), predicates.assertion_like("name").alias("in_slices"))


@query("""WITH s AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS m, l_linenumber AS n, CAST(l_suppkey AS VARCHAR) AS id
  FROM lineitem), f AS (SELECT DISTINCT o_orderkey AS t, CAST(o_custkey AS VARCHAR) AS m, o_orderkey % 7 AS n FROM orders
  WHERE o_orderstatus = 'F') SELECT t, s.id FROM f JOIN s ON s.m = f.m AND s.n = f.n""")
def statements_on_frames(spark, sf):
    """Failed orders as frames in the part with the customer's number; statements of that part on the frame's line."""
    frames = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("t"),
        F.col("o_custkey").cast("string").alias("method_id"), (F.col("o_orderkey") % 7).alias("line")).distinct()
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("method_id"),
        F.col("l_linenumber").alias("line"), F.col("l_suppkey").cast("string").alias("id")).distinct()
    return localize.statements_at(frames, rows).select("t", "id")


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'IF' WHEN 'O' THEN 'LOOP' ELSE 'OTHER' END AS kind,
  o_orderstatus = 'F' AS readable FROM orders""")
def control_kinds(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F",
        "switch").when(F.col("o_orderstatus") == "O", "FOREACH").otherwise("TRY").alias("t"),
        F.when(F.col("o_orderstatus") == "O", "<empty>").otherwise("F.java").alias("file"), F.lit(3).alias("line_start"),
        F.when(F.col("o_orderstatus") == "F", 9).otherwise(2).alias("line_end"))
    return rows.select("o_orderkey", predicates.control_kind("t").alias("kind"), predicates.readable_source().alias("readable"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents)
  SELECT doc_id, count(*) FILTER (WHERE trim(t, ' ') = '' OR regexp_full_match(trim(t, ' '), '[})\\];]+') OR ends_with(trim(t, ' '),
  '{') OR starts_with(trim(t, ' '), '//') OR starts_with(trim(t, ' '), '/*') OR starts_with(trim(t, ' '), '*')) AS structural FROM l GROUP BY doc_id""")
def structural_lines(spark, sf):
    rows = text.lines(table(spark, sf, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("content")))
    return rows.groupBy(F.col("file").alias("doc_id")).agg(F.count(F.when(predicates.structural_line("text"), 1)).alias("structural"))


@query("""SELECT p_partkey, p_size % 3 < 2 AS trimmed, p_size % 2 = 0 AS consistent FROM part""")
def source_line_checks(spark, sf):
    r = F.col("p_size") % 3
    first = F.when(r == 0, "  @Deprecated void a() {").when(r == 1, "static int b;").otherwise("int staticField;")
    rows = table(spark, sf, "part").select("p_partkey", first.alias("first"),
        F.concat(F.lit("this.call( "), F.col("p_partkey").cast("string"), F.lit(")")).alias("code"),
        F.concat(F.lit("  call("), F.when(F.col("p_size") % 2 == 0, F.col("p_partkey")).otherwise(-1).cast("string"),
        F.lit(");")).alias("line"))
    return rows.select("p_partkey", predicates.trimmed_helper("first").alias("trimmed"), predicates.consistent_source("code", "line").alias("consistent"))


@query("""SELECT page_id, 'at ' || url AS text FROM pages""")
def scrubbed_paths(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.concat(F.lit("at /home/me/"), "url").alias("text"))
    return rows.select("page_id", predicates.scrub_paths("text", ["/home/me", "/home"]).alias("text"))


@query("""WITH e AS (SELECT 'DDG' AS layer, l_orderkey AS src FROM lineitem WHERE l_returnflag = 'R' UNION ALL
  SELECT 'CFG', l_orderkey FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT 'CDG', l_orderkey FROM lineitem
  WHERE l_returnflag = 'N') SELECT layer, count(*) AS n FROM e WHERE layer <> 'CFG' GROUP BY layer""")
def layers_of_a_view(spark, sf):
    layer = F.when(F.col("l_returnflag") == "R", "DDG").when(F.col("l_returnflag") == "A", "CFG").otherwise("CDG")
    edges = table(spark, sf, "lineitem").select(layer.alias("layer"), F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return dependence.view(edges, layers=predicates.layers(["ddg", " cdg "])).groupBy("layer").agg(F.count("*").alias("n"))


@query(f"""WITH {METHODS} SELECT k, fqn AS name, 'm' || k || '(int, Map)' AS readable, replace(fqn, '.m', '.') AS dotted,
  'T.a' AS canonical, regexp_replace(file, '^src/main/java/', '') AS package FROM pm""")
def readable_names(spark, sf):
    """Names without signature, readable signatures, tools' slashes as dots, tests without parameters, paths from the package on."""
    part = table(spark, sf, "part")
    rows = part.select(F.col("p_partkey").alias("k"), p.method_name().alias("fqn"), p.source_file().alias("file"))
    rows = rows.withColumns({"full": F.concat("fqn", F.lit(":void(int,java.util.Map)")), "sig": F.lit("void(int, java.util.Map)"),
        "cls": F.translate(names.owner("fqn"), ".", "/"), "num": F.col("k").cast("string"),
        "t": F.concat(F.lit("T.a["), F.col("k").cast("string"), F.lit("]"))})
    return rows.select("k", names.without_signature("full").alias("name"), names.readable_signature("fqn", "sig").alias("readable"),
        names.from_slashes("cls", "num").alias("dotted"), names.canonical_test("t").alias("canonical"),
        names.package_path("file").alias("package"))


@query("""SELECT p_partkey AS k, replace(p_name, ' ', '\\|') AS piped, '&lt;' || p_name || '&gt;' AS marked,
  'Makes ' || p_name || '.' AS sentence FROM part""")
def escaped_texts(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.translate("p_name", " ", "|").alias("bars"),
        F.concat(F.lit("<"), "p_name", F.lit(">")).alias("tags"),
        F.concat(F.lit("/**\n * Makes "), "p_name", F.lit(".\n * More text. And more.\n */")).alias("doc"))
    return rows.select("k", names.escape_pipes("bars").alias("piped"), names.escape_html("tags").alias("marked"), names.first_sentence("doc").alias("sentence"))


@query("SELECT page_id, url AS path FROM pages WHERE page_id % 3 <> 0")
def staged_files(spark, sf):
    """Pages in folders that staging leaves out are every third one."""
    path = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("a/build/"), "url")).otherwise(F.col("url"))
    return text.staged(table(spark, sf, "pages").select("page_id", path.alias("path")))


@query("""WITH e AS (SELECT sha256(CAST(doc_id AS VARCHAR) || chr(0) || sha256(coalesce(text, ''))) AS h
  FROM documents), g AS (SELECT substr(h, 1, 4) AS g, sha256(string_agg(h, '' ORDER BY h)) AS h FROM e GROUP BY 1)
  SELECT sha256('salt' || sha256(string_agg(h, '' ORDER BY h))) AS digest FROM g""")
def digest_of_all_sources(spark, sf):
    files = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file"), F.coalesce("text", F.lit("")).alias("content"))
    return text.fingerprint(files, "salt")


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 0 END AS hidden FROM orders""")
def redacted_members(spark, sf):
    """Each order as a disassembly of two members; the secret one's body goes where there is one."""
    secret = F.when(F.col("o_orderkey") % 2 == 0, "secret").otherwise("other")
    body = F.concat(F.lit("class A {\n  void keep();\n    code 1\n\n  int "), secret, F.lit("(int);\n    code 2\n    code 3\n\n}"))
    rows = text.lines(table(spark, sf, "orders").select(F.col("o_orderkey").alias("file"), body.alias("content")))
    return text.redacted(rows, "secret").groupBy(F.col("file").alias("k")).agg(F.count(F.when(F.col("text") == "    // body removed", 1)).alias("hidden"))


@query("""WITH c AS (SELECT 'm' || l_suppkey AS src, 'm' || l_partkey AS dst FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey
  FROM supplier WHERE s_nationkey = 3)) SELECT DISTINCT src, dst FROM c WHERE dst IN (SELECT 'm' || p_partkey FROM part
  WHERE p_size < 10)""")
def changed_methods_run(spark, sf):
    """Lines of changed suppliers that fall into the spans of small parts: the part's number is its only line."""
    near = table(spark, sf, "supplier").where("s_nationkey = 3").select(F.col("s_suppkey").alias("l_suppkey"))
    lines = table(spark, sf, "lineitem").join(near, "l_suppkey",
        "left_semi").select(F.concat(F.lit("m"), F.col("l_suppkey").cast("string")).alias("file"),
        F.col("l_partkey").alias("line")).distinct()
    files = lines.select("file").distinct()
    small = table(spark, sf, "part").where("p_size < 10").select(F.col("p_partkey").alias("line_start"), F.col("p_partkey").alias("line_end"))
    spans = lines.join(small, F.col("line") == F.col("line_start")).select(F.concat_ws("|", "file",
        F.concat(F.lit("m"), F.col("line").cast("string"))).alias("fqn"), "file", "line_start", "line_end").join(files, "file",
        "left_semi")
    parts = F.split("method", r"\|")
    return impact.changed_methods(lines, spans).select(parts[0].alias("src"), parts[1].alias("dst"))
