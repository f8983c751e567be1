"""Registered queries on what a bundle about a target shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import chains, pool
from ..sources import sinks
from . import derived as d
from .catalog import ORACLE_SQL, QUERIES, query
from .derived import table

__all__ = ["ORACLE_SQL", "QUERIES"]

#: Orders as chains: from each part to the next one, virtual where the item came back.
ORDERS = """r AS (SELECT l_orderkey AS o, 'pkg.P.m' || l_partkey AS c, lead('pkg.P.m' || l_partkey) OVER w AS nx,
  l_returnflag = 'R' AS v, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) - 1 AS depth
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag)), st AS (SELECT *
  FROM r WHERE nx IS NOT NULL)"""


def _chains(spark, sf) -> DataFrame:
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    name = F.concat(F.lit("pkg.P.m"), F.col("l_partkey").cast("string"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", name.alias("caller"), F.lead(name).over(by).alias("callee"),
        (F.col("l_returnflag") == "R").alias("virtual"), F.row_number().over(by).alias("i")).where("callee is not null")
    steps = F.transform(F.array_sort(F.collect_list(F.struct("i", "caller", "callee", "virtual"))),
        lambda s: F.struct(s["caller"].alias("caller"), s["callee"].alias("callee"), s["virtual"].alias("virtual")))
    rows = rows.groupBy(F.col("l_orderkey").alias("chain_id")).agg(steps.alias("steps"))
    virtual = F.size(F.filter("steps", lambda s: s["virtual"]))
    return rows.select("chain_id", F.concat(F.lit("T.t"), F.col("chain_id").cast("string")).alias("test"),
        F.size("steps").alias("depth"), virtual.alias("virtual_steps"), "steps")


@query(f"""WITH {ORDERS}, e AS (SELECT c, nx, min(depth - 1 - i) AS dist FROM st
  WHERE i > 0 AND NOT v AND c <> nx AND c <> 'pkg.P.m1' GROUP BY c, nx) SELECT c AS caller, nx AS callee, dist, (SELECT count(*)
  FROM e) - 16 AS more FROM e ORDER BY dist, c, nx LIMIT 16""")
def edges_next_to_a_target(spark, sf):
    found = pool.chain_edges(_chains(spark, sf), "pkg.P.m1")
    return found.select("caller", "callee", F.col("dist").cast("long").alias("dist"), "more")


@query(f"""WITH {ORDERS}, g AS (SELECT o, string_agg(nx, '>' ORDER BY i) AS s, string_agg(replace(nx, 'pkg.', ''), ' → '
  ORDER BY i) AS p FROM (SELECT *, coalesce(lag(nx) OVER (PARTITION BY o ORDER BY i) = nx, false) AS again FROM st) WHERE NOT again
  GROUP BY o),
f AS (SELECT o, string_agg(nx, '>' ORDER BY i) AS s, count(*) AS depth FROM st
  GROUP BY o), c AS (SELECT s, count(*) AS n, min(o) AS first FROM f WHERE depth >= 2
  GROUP BY s), t AS (SELECT *, row_number() OVER (ORDER BY n DESC, first) AS rank FROM c ORDER BY n DESC, first LIMIT 8)
SELECT t.rank, 'T.t' || t.first AS test, 'T.t' || t.first || ' → ' || g.p AS path FROM t JOIN g ON g.o = t.first""")
def medoid_paths(spark, sf):
    """The largest clusters of orders by their first one, as paths of simple names."""
    rows = _chains(spark, sf)
    return pool.medoids(rows, chains.clusters(rows)).select(F.col("rank").cast("long").alias("rank"), "test", "path")


@query(f"""WITH {ORDERS}, f AS (SELECT o, min(nx) FILTER (WHERE i = 0) AS entry FROM st GROUP BY o)
  SELECT 'T.t' || o AS test, entry, o AS chain_id FROM f""")
def representative_chains(spark, sf):
    """Each test's chain that starts at the wanted entry; wanted are their own entries."""
    rows = _chains(spark, sf)
    wanted = rows.select("test", F.col("steps")[0]["callee"].alias("entry"))
    return pool.representatives(rows, wanted).select("test", "entry", "chain_id")


@query("""WITH k AS (SELECT p_partkey, p_size % 25 + 2 AS pos
  FROM part), w AS (SELECT p_partkey, least(30, pos + 3) AS hi, greatest(1, pos - 4, least(30, pos + 3) - 7) AS lo FROM k)
SELECT p_partkey, least(10, 1 + CASE WHEN lo > 1 THEN 1 ELSE 0 END + hi - lo + CASE WHEN hi < 30 THEN 1 ELSE 0 END) AS lines, true AS shown FROM w""")
def windows_around_calls(spark, sf):
    """Texts of thirty lines with a call in one of them, cut to ten."""
    at = (F.col("p_size") % 25 + 2).cast("int")
    code = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(29)),
        lambda i: F.when(i == at, "  go (x);").otherwise(F.concat(F.lit("  line"), i.cast("string")))), "\n")
    rows = table(spark, sf, "part").select("p_partkey", code.alias("code"), F.lit("go").alias("callee"))
    cut = rows.select("p_partkey", pool.call_window("code", "callee").alias("cut"))
    return cut.select("p_partkey", F.size(F.split("cut", "\n")).cast("long").alias("lines"), F.contains("cut", F.lit("go (x)")).alias("shown"))


@query("""WITH cov AS (SELECT DISTINCT l_suppkey AS m, l_orderkey AS t FROM lineitem), n AS (SELECT m, count(*) AS n FROM cov
  GROUP BY m), own AS (SELECT t FROM cov WHERE m = 1), s AS (SELECT m, count(*) AS shared FROM cov WHERE t IN (SELECT t FROM own)
  GROUP BY m),
j AS (SELECT CAST(n.m AS VARCHAR) AS method, s.shared, round(s.shared / CAST(n.n + (SELECT count(*)
  FROM own) - s.shared AS DOUBLE), 3) AS jaccard, n.n AS covered_by FROM n JOIN s ON s.m = n.m JOIN supplier ON s_suppkey = n.m
  WHERE n.m <> 1 AND s_acctbal > 2000)
SELECT * FROM j WHERE jaccard > 0 ORDER BY jaccard DESC, method LIMIT 1""")
def consumer_of_a_target(spark, sf):
    """Suppliers with a balance over 2000 are production callers of the first; the one most of its orders pass through."""
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("fqn"), (F.col("s_acctbal") <= 2000).alias("is_test_code"))
    calls = rows.select(F.col("fqn").alias("caller"), F.lit("1").alias("callee"))
    return pool.consumer(calls, rows, d.coverage(spark, sf), "1")


@query("""WITH c AS (SELECT DISTINCT 'T.widget' || o_orderkey AS t, o_orderpriority AS p FROM orders WHERE o_orderkey % 2 = 0 UNION
  SELECT DISTINCT 'T.other' || o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1), direct AS (SELECT t FROM c
  WHERE p = '1-URGENT')
SELECT t AS test, 'direct' AS why FROM direct UNION ALL SELECT * FROM (SELECT t, 'named' FROM c
  WHERE t LIKE '%widget%' AND t NOT IN (SELECT t FROM direct) ORDER BY t LIMIT 10)""")
def focus_tests_of_a_target(spark, sf):
    """Urgent orders call the target, every other one is named after it."""
    key = F.col("o_orderkey")
    tests = table(spark, sf, "orders").select(F.concat(F.when(key % 2 == 0, "T.widget").otherwise("T.other"),
        key.cast("string")).alias("test"), "o_orderpriority")
    methods = tests.select(F.col("test").alias("fqn"), F.lit(True).alias("is_test_code"))
    calls = tests.where("o_orderpriority = '1-URGENT'").select(F.col("test").alias("caller"), F.lit("pkg.Widget.run").alias("callee"))
    return pool.focus_tests(calls, methods, tests.select("test"), "pkg.Widget.run")


@query("""WITH l AS (SELECT event_type AS section, event_id, user_id, row_number() OVER (PARTITION BY event_type
  ORDER BY event_id) AS n FROM events), c(section, cap) AS (VALUES ('view', 12), ('error', 4))
SELECT l.section, string_agg('u' || user_id, chr(10) ORDER BY n) FILTER (WHERE cap IS NULL OR n <= cap) AS text,
  count(*) FILTER (WHERE cap IS NULL OR n <= cap) AS kept, count(*) FILTER (WHERE n > cap) AS dropped FROM l LEFT
  JOIN c ON c.section = l.section GROUP BY l.section""")
def capped_sections(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("section"), F.col("event_id").alias("ord"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("line"))
    return pool.capped_sections(rows, {"view": 12, "error": 4})


@query("""WITH x AS (SELECT n_nationkey + 1 AS n, n_name AS text FROM nation), t AS (SELECT max(n) AS n
  FROM x), e AS (SELECT event_id, '- `go(' || user_id || ', ' || props || ') => ok`' AS text FROM events
  WHERE event_type = 'purchase')
SELECT n, text FROM x UNION ALL SELECT n + 1, '' FROM t UNION ALL
  SELECT n + 2, '## Observed calls (of the present code: hints, no oracle)' FROM t UNION ALL SELECT n + 3, '' FROM t UNION ALL
  SELECT (SELECT n FROM t) + 3 + row_number() OVER (ORDER BY event_id), text FROM e""")
def observed_examples(spark, sf):
    """A document of nations followed by what purchases were called with."""
    document = table(spark, sf, "nation").select((F.col("n_nationkey") + 1).alias("n"), F.col("n_name").alias("text"))
    values = table(spark, sf, "events").where("event_type = 'purchase'").select(F.lit("p.Shop.go").alias("method"),
        F.array(F.col("user_id").cast("string"), "props").alias("args"), F.lit("ok").alias("result"),
        F.col("event_id").alias("ord"))
    return pool.with_examples(document, values, "p.Shop.go")


@query("""WITH p AS (SELECT conv_id AS doc, sum((length(role) + 3) // 4) AS sites,
  sum((length(text) + 3) // 4) FILTER (WHERE turn = 0) AS first_ FROM conversations
  GROUP BY 1), c AS (SELECT conv_id AS doc, sum((length(text) + 3) // 4) OVER (PARTITION BY conv_id
  ORDER BY turn, text ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS rank
  FROM conversations),
w AS (SELECT doc, max(upto) AS total, count(*) AS n FROM c
  GROUP BY doc), x AS (SELECT p.doc, sites, total, n, sites + total <= 300 AS all_, total <= 300 AS without FROM p
  JOIN w ON w.doc = p.doc)
SELECT x.doc, CASE WHEN all_ THEN 0 WHEN without THEN 1 ELSE 4 END AS dropped, CASE WHEN without THEN n ELSE (SELECT count(*) FROM c
  WHERE c.doc = x.doc AND (upto <= 300 OR rank = 1)) END AS chains,
CASE WHEN all_ THEN sites + total WHEN without THEN total ELSE (SELECT max(upto) FROM c WHERE c.doc = x.doc AND upto <= 300) END AS tokens FROM x""")
def older_ladder(spark, sf):
    """Conversations as documents: turns are chains, roles the call sites that go first."""
    rows = table(spark, sf, "conversations").withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text")))
    parts = rows.select(F.col("conv_id").alias("doc"), F.lit("call_sites").alias("part"), F.col("role").alias("text"))
    out = pool.ladder_plan(parts, rows.select(F.col("conv_id").alias("doc"), "rank", "text"), 300)
    return out.select("doc", F.size("dropped").cast("long").alias("dropped"), "chains", "tokens")


@query("""SELECT 'p' || p_partkey AS id, CASE WHEN p_size > 25 THEN 'method' ELSE 'widget' END AS kind_name,
  CASE WHEN p_size > 25 THEN 'method ' ELSE 'widget ' END || p_name AS title FROM part""")
def displayed_nodes(spark, sf):
    nodes = table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"),
        F.when(F.col("p_size") > 25, "METHOD").otherwise("WIDGET").alias("kind"), F.col("p_name").alias("label"))
    return sinks.displayed(nodes).select("id", "kind_name", "title")


@query("""WITH ev AS (SELECT user_id, CAST(ts AS DATE) AS day, min(event_id) AS chain_id, list(event_type
  ORDER BY ts, event_id) AS t FROM events GROUP BY 1, 2), c AS (SELECT t, min(chain_id) AS first_chain, count(*) AS n,
  count(DISTINCT user_id) AS tests FROM ev WHERE len(t) >= 2 GROUP BY t)
SELECT first_chain, t[1] AS entry, CAST(n AS BIGINT) AS chains, greatest(n - 20, 0) AS more FROM c""")
def cluster_documents(spark, sf):
    """Clusters as objects of schema 2.2, read back."""
    rows = d.event_chains(spark, sf)
    found = chains.clusters(rows)
    lines = sinks.cluster_lines(found, chains.members(rows, found))
    get = lambda k: F.get_json_object("json", f"$.{k}")
    return lines.select("first_chain", get("entry").alias("entry"), get("chains").cast("long").alias("chains"), get("more").cast("long").alias("more"))
