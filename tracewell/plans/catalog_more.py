"""Further registered queries: name columns, windows, joins, text readers and graph views over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names, predicates
from ..operators import chains, dependence, impact, ingest, knowledge, localize, ranking, stats, traverse
from ..sources import facts, graph, sinks, text
from . import derived as d
from .catalog import ORACLE_SQL, PG, QUERIES, SIG, query
from .derived import table

__all__ = ["ORACLE_SQL", "QUERIES"]


@query("SELECT p_partkey, string_split(p_type, ' ')[-1] AS last_word, regexp_replace(p_name, '[^A-Za-z0-9_]', '_', 'g') AS ident, CASE WHEN length(p_name) > 12 THEN substr(p_name, 1, 11) || '…' ELSE p_name END AS short, (length(p_name) + 3) // 4 AS tokens FROM part")
def part_names(spark, sf):
    dotted = F.translate("p_type", " ", ".")
    return table(spark, sf, "part").select("p_partkey", names.simple(dotted).alias("last_word"),
        names.identifier("p_name").alias("ident"), names.one_line("p_name", 12).alias("short"),
        names.token_estimate("p_name").cast("long").alias("tokens"))


@query("""SELECT page_id, CASE WHEN contains(url, '://') THEN 1 ELSE 0 END AS has_scheme,
  array_to_string(list_transform(string_split(url, '/'),
  lambda x: CASE x WHEN '__t__' THEN 'test' WHEN '__ts__' THEN 'tests' ELSE x END), '/') AS path, string_split(url, '/')[-1] AS base
  FROM pages""")
def page_paths(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.contains("url", F.lit("://")).cast("int").alias("has_scheme"),
        names.unstage(F.col("url")).alias("path"), names.basename("url").alias("base"))


@query("SELECT event_type, count(*) FILTER (WHERE regexp_matches(event_type, '^(assert|fail|verify|expect|then)')) AS view_like, count(*) FILTER (WHERE regexp_matches(lower(event_type), '^(assert|fail)')) AS slice_like, count(*) AS n FROM events GROUP BY event_type")
def assertion_like_events(spark, sf):
    rows = table(spark, sf, "events")
    return rows.groupBy("event_type").agg(F.count(F.when(predicates.assertion_like("event_type", "view"), 1)).alias("view_like"),
        F.count(F.when(predicates.assertion_like("event_type"), 1)).alias("slice_like"), F.count("*").alias("n"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents)
  SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE trim(t) = '') AS blank, max(length(t)) AS longest FROM l
  GROUP BY doc_id""")
def source_lines(spark, sf):
    rows = text.lines(table(spark, sf, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("content")))
    return rows.groupBy(F.col("file").alias("doc_id")).agg(F.count("*").alias("lines"),
        F.count(F.when(F.trim("text") == "", 1)).alias("blank"), F.max(F.length("text")).cast("long").alias("longest"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)),
  1) AS n FROM documents) SELECT doc_id, string_agg(t, chr(10) ORDER BY n) AS text FROM l WHERE n <= 4 GROUP BY doc_id""")
def source_fragments(spark, sf):
    docs = table(spark, sf, "documents")
    rows = text.lines(docs.select(F.col("doc_id").alias("file"), F.col("text").alias("content")))
    wanted = docs.select(F.col("doc_id").alias("key"), F.col("doc_id").alias("file"), F.lit(1).alias("line"))
    return text.fragment(rows, text.around(wanted, 3, 3)).select(F.col("key").alias("doc_id"), "text")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS file, CAST(10 + n AS INTEGER) AS line
  FROM (SELECT o_orderkey, unnest(generate_series(0, CAST(o_orderkey % 4 AS INTEGER) - 1)) AS n FROM orders WHERE o_orderkey % 4 > 0)
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 10 FROM orders WHERE o_orderkey % 4 = 0""")
def diff_base_lines(spark, sf):
    """Each order as a diff of one hunk that deletes o_orderkey mod 4 lines, or only inserts."""
    key = F.col("o_orderkey")
    gone = F.transform(F.sequence(F.lit(0), (key % 4).cast("int")), lambda i: F.when(i > 0, F.concat(F.lit("-old "), i.cast("string"))))
    head = F.array(F.concat(F.lit("--- a/"), key.cast("string")), F.concat(F.lit("+++ b/"), key.cast("string")), F.lit("@@ -10,4 +10,2 @@"))
    lines = F.concat(head, F.array_compact(gone), F.array(F.lit("+new"), F.lit(" context")))
    rows = table(spark, sf, "orders").select(key.alias("diff_id"), F.posexplode(lines).alias("n", "value"))
    return text.deleted_lines(rows).select("file", F.col("line").cast("int").alias("line"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS trace_id, 1 AS cause_ix, 'p.Deep' AS exc_type,
  'p.C' || CAST(o_custkey AS VARCHAR) AS cls, CAST(o_orderkey % 100 AS INTEGER) AS line FROM orders WHERE o_orderstatus = 'F'""")
def root_cause_frames(spark, sf):
    """Each failed order as a trace whose deeper cause has the one project frame."""
    trace = F.format_string("a.Outer: text\n\tat q.R.run(R.java:5)\nCaused by: p.Deep: %s\n\tat p.C%s.get(C.java:%s)\n\t... 3 more",
        F.col("o_orderpriority"), F.col("o_custkey").cast("string"), (F.col("o_orderkey") % 100).cast("string"))
    rows = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("trace_id"), trace.alias("trace"))
    return text.root_causes(text.frames(rows), "p.").select("trace_id", "cause_ix", "exc_type", "cls", "line")


@query("""WITH r AS (SELECT event_type AS method, 'u' || CAST(user_id AS VARCHAR) AS test,
  CAST(CAST(floor(value) AS BIGINT) % 7 AS VARCHAR) AS a,
  CASE WHEN event_type = 'error' THEN 'throws E: x' ELSE 'ok' END AS result, event_id AS ord FROM events),
f AS (SELECT method, a, result, min(ord) AS ord FROM r GROUP BY 1, 2, 3)
  SELECT method, a AS arg, result, result LIKE 'throws %' AS throws, ord FROM f QUALIFY row_number() OVER (PARTITION BY method
  ORDER BY ord) <= 5""")
def captured_calls(spark, sf):
    line = F.concat_ws("\t", "event_type", F.concat(F.lit("u"), F.col("user_id").cast("string")), (F.col("value").cast("long") % 7).cast("string"))
    result = F.when(F.col("event_type") == "error", "throws E: x").otherwise("ok")
    rows = facts.parse_values(table(spark, sf, "events").select(F.concat(line, F.lit("\t=> "), result).alias("value"), F.col("event_id").alias("ord")))
    return facts.first_distinct(rows, 5).select("method", F.col("args")[0].alias("arg"), "result", "throws", "ord")


@query("""WITH p AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n
  FROM part), s AS (SELECT p_partkey AS k, p_brand, row_number() OVER (PARTITION BY p_brand
  ORDER BY p_retailprice DESC, p_partkey) AS n FROM part WHERE p_size > 25)
SELECT p.p_partkey, s.k AS site FROM p JOIN s ON p.p_brand = s.p_brand AND p.n = s.n""")
def one_to_one_sites(spark, sf):
    parts = table(spark, sf, "part")
    sites = parts.where("p_size > 25").select("p_brand", F.col("p_partkey").alias("site"), "p_retailprice")
    return ranking.zip_by_rank(parts.select("p_brand", "p_partkey"), sites, ["p_brand"], ["p_partkey"],
        [F.desc("p_retailprice"), "site"]).select("p_partkey", "site")


@query("""WITH c AS (SELECT c_custkey, c_nationkey AS nk, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i
  FROM customer), s AS (SELECT s_suppkey, s_nationkey AS nk, row_number() OVER (PARTITION BY s_nationkey
  ORDER BY s_suppkey) - 1 AS j, count(*) OVER (PARTITION BY s_nationkey) AS m FROM supplier)
SELECT c_custkey, s_suppkey FROM c JOIN s ON c.nk = s.nk AND s.j = c.i % s.m""")
def round_robin_sites(spark, sf):
    a, b = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey"), table(spark, sf,
        "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey")
    return ranking.round_robin(a, b, ["k"], ["c_custkey"], ["s_suppkey"]).select("c_custkey", "s_suppkey")


@query("""WITH m AS (SELECT s_suppkey, p_partkey, CASE WHEN s_suppkey = p_partkey THEN 0 ELSE 1 END AS p FROM supplier
  JOIN part ON s_suppkey = p_partkey OR s_nationkey = p_size)
SELECT s_suppkey, p_partkey FROM m QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY p, p_partkey) = 1""")
def either_key_match(spark, sf):
    s, p = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), table(spark, sf, "part").select("p_partkey", "p_size")
    return ranking.or_join(s, p, ("s_suppkey", "p_partkey"), ("s_nationkey", "p_size"), ["s_suppkey"], ["p_partkey"]).select("s_suppkey", "p_partkey")


@query("""WITH p AS (SELECT DISTINCT substr(url, 1, 12) AS prefix FROM pages UNION SELECT DISTINCT substr(url, 1, 20)
  FROM pages), m AS (SELECT DISTINCT pages.url, p.prefix FROM pages JOIN p ON starts_with(pages.url, p.prefix))
SELECT page_id, (SELECT max_by(prefix, length(prefix)) FROM m WHERE m.url = pages.url) AS prefix FROM pages""")
def longest_prefix(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    prefixes = pages.select(F.substring("url", 1, 12).alias("prefix")).union(pages.select(F.substring("url", 1, 20))).distinct()
    return ranking.longest_prefix(pages, prefixes, "url", "prefix").select("page_id", "prefix")


@query("""WITH j AS (SELECT o_orderkey, l_partkey, l_linenumber, abs(date_diff('day', CAST(o_orderdate AS DATE),
  CAST(l_shipdate AS DATE))) AS dist FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT o_orderkey, min(dist) AS dist, min_by(l_partkey, (dist, l_partkey)) AS l_partkey FROM j GROUP BY 1""")
def nearest_shipment(spark, sf):
    both = table(spark, sf, "orders").select("o_orderkey", "o_orderdate").join(table(spark, sf,
        "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_shipdate"), "o_orderkey")
    both = both.select("o_orderkey", "l_partkey", F.abs(F.datediff("l_shipdate", "o_orderdate")).cast("long").alias("dist"))
    return ranking.nearest_by(both, ["o_orderkey"], F.col("dist"), ["l_partkey"]).select("o_orderkey", "dist", "l_partkey")


@query("SELECT substr(p_type, 1, 1) || CAST(row_number() OVER (PARTITION BY substr(p_type, 1, 1) ORDER BY p_partkey) AS VARCHAR) AS ref, p_partkey FROM part")
def typed_references(spark, sf):
    return ranking.numbered_references(table(spark, sf, "part").select("p_partkey", "p_type"), F.substring("p_type", 1, 1),
        ["p_partkey"]).select("ref", "p_partkey")


@query("""WITH r AS (SELECT user_id, event_id, event_type,
  CASE event_type WHEN 'purchase' THEN 0 WHEN 'error' THEN 1 WHEN 'view' THEN 2 END AS p
  FROM events), b AS (SELECT *, min(p) OVER (PARTITION BY user_id) AS best FROM r WHERE p IS NOT NULL)
SELECT user_id, event_id, event_type FROM b WHERE p = best QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 3""")
def seed_priority(spark, sf):
    p = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "error", 1).when(F.col("event_type") == "view", 2)
    return ranking.by_priority(table(spark, sf, "events"), ["user_id"], p, ["event_id"], 3).select("user_id", "event_id", "event_type")


@query("""WITH e AS (SELECT user_id, event_id, ts, event_type = 'view' AS hit
  FROM events), g AS (SELECT *, row_number() OVER (PARTITION BY user_id
  ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, hit ORDER BY event_id) AS g FROM e)
SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM g WHERE hit GROUP BY user_id, g HAVING count(*) >= 3""")
def runs_of_views(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", (F.col("event_type") == "view").alias("hit"))
    return ranking.runs_of(rows, ["user_id"], "hit", "event_id", 3)


@query("""SELECT user_id, event_type, value FROM (SELECT user_id, event_type, value, event_id,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n
  FROM (SELECT user_id, event_type, min(event_id) AS event_id, min_by(value, event_id) AS value FROM events GROUP BY 1, 2))
  WHERE n <= 2""")
def first_distinct_codes(spark, sf):
    return ranking.distinct_first(table(spark, sf, "events"), ["user_id"], "event_type", ["event_id"], 2).select("user_id", "event_type", "value")


@query("""WITH s AS (SELECT l_returnflag AS cluster, l_linenumber AS arg_index, 'RESOLVED' AS kind, l_linestatus AS value
  FROM lineitem), a AS (SELECT cluster, arg_index, count(DISTINCT value) AS n, list_sort(list(DISTINCT value)) AS vs FROM s
  GROUP BY 1, 2)
SELECT cluster, arg_index, CASE WHEN n = 1 THEN 'RESOLVED' WHEN n > 3 THEN 'UNRESOLVED' ELSE 'BRANCH_UNION' END AS kind,
  CASE WHEN n = 1 THEN vs[1] WHEN n > 3 THEN CAST(n AS VARCHAR) || ' distinct member resolutions' ELSE array_to_string(vs,
  ' | ') END AS value, n AS distinct_results FROM a""")
def argument_aggregation(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("cluster"), F.col("l_linenumber").alias("arg_index"),
        F.lit("RESOLVED").alias("kind"), F.col("l_linestatus").alias("value"))
    return chains.aggregate_arguments(rows, ["cluster"]).withColumn("distinct_results", F.col("distinct_results").cast("long"))


@query("SELECT CAST(l_suppkey AS VARCHAR) AS method, count(DISTINCT l_orderkey) AS tests, CASE WHEN max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 1 THEN 'actual-side' ELSE 'prior-call' END AS label FROM lineitem GROUP BY 1")
def boundary_aggregation(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("test"),
        F.col("l_suppkey").cast("string").alias("method"), F.when(F.col("l_returnflag") == "R",
        "actual-side").otherwise("prior-call").alias("label"))
    return localize.aggregate_boundary(rows)


BOUNDARY = """b AS (SELECT l_suppkey AS m, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey
  FROM supplier WHERE s_nationkey = 7) GROUP BY 1), r AS (SELECT m, n, row_number() OVER (ORDER BY n DESC,
  CAST(m AS VARCHAR)) AS place FROM b),
c AS (SELECT l_partkey AS m, min((r.place, CAST(r.m AS VARCHAR))) AS x FROM lineitem JOIN r ON l_suppkey = r.m
  WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) AND l_partkey NOT IN (SELECT m FROM b) GROUP BY 1)"""


@query(f"""WITH {BOUNDARY}, u AS (SELECT CAST(m AS VARCHAR) AS method, CAST(n AS DOUBLE) AS score, true AS direct, place FROM r
  UNION ALL SELECT CAST(c.m AS VARCHAR), CAST(r.n AS DOUBLE), false, r.place FROM c JOIN r ON r.place = c.x[1])
SELECT method, score, direct, CAST(row_number() OVER (ORDER BY direct DESC, place, method) AS INTEGER) AS rank FROM u
  QUALIFY row_number() OVER (ORDER BY direct DESC, place, method) <= 12""")
def suspects_boundary_only(spark, sf):
    items = table(spark, sf, "lineitem")
    near = table(spark, sf, "supplier").where("s_nationkey = 7").select(F.col("s_suppkey").alias("l_suppkey"))
    boundary = items.join(near, "l_suppkey", "left_semi").select(F.col("l_orderkey").cast("string").alias("test"),
        F.col("l_suppkey").cast("string").alias("method"))
    calls = items.select(F.col("l_suppkey").cast("string").alias("caller"), F.col("l_partkey").cast("string").alias("callee"))
    production = table(spark, sf, "part").where("p_size > 25").select(F.col("p_partkey").cast("string").alias("method"))
    return localize.boundary_suspects(boundary, calls, production, 12).select("method", "score", "direct", "rank")


@query("SELECT regexp_replace(p_name, ' [^ ]*$', '') AS cls, count(*) AS n FROM (SELECT DISTINCT p_name FROM part) WHERE contains(p_name, ' ') GROUP BY 1")
def universe_by_class(spark, sf):
    tests = table(spark, sf, "part").where("p_name like '% %'").select(F.translate("p_name", " ", ".").alias("test"))
    return knowledge.universe_by_class(tests).select(F.translate("cls", ".", " ").alias("cls"), "n")


@query("""SELECT CASE WHEN event_type = 'error' THEN 'throws:E' WHEN value > 50 THEN 'dcol+1_drow+0' ELSE 'other:else' END AS class,
  count(*) AS count, min(length(props)) AS length_min, max(length(props)) AS length_max FROM events GROUP BY 1""")
def behaviour_classes(spark, sf):
    result = F.when(F.col("event_type") == "error", "throws E: no").when(F.col("value") > 50, "Cell{column=3, row=1}").otherwise("else")
    rows = table(spark, sf, "events").select(F.lit("m").alias("method"), F.col("user_id").cast("string").alias("test"),
        F.array(F.lit("1"), F.lit("2"), "props").alias("args"), result.alias("result"),
        (F.col("event_type") == "error").alias("throws"), F.col("event_id").alias("ord"))
    return knowledge.class_summary(knowledge.behaviour_classes(rows, r"Cell\{column=(\d+), row=(\d+)\}")).select("class", "count",
        F.col("length_min").cast("long").alias("length_min"), F.col("length_max").cast("long").alias("length_max"))


@query("""WITH v AS (SELECT length(props) AS n FROM events)
  SELECT count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS non_throwing, min(length(props)) AS length_min,
  (SELECT list_sort(list(n))[count(*) // 2 + 1] FROM v) AS length_median, max(length(props)) AS length_max FROM events""")
def input_profile(spark, sf):
    rows = table(spark, sf, "events").select(F.array((F.col("user_id") % 10).cast("string"), F.lit("2"), "props").alias("args"),
        (F.col("event_type") == "error").alias("throws"))
    return knowledge.input_profile(rows).select("n", "non_throwing", *[F.col(c).cast("long").alias(c) for c in ("length_min", "length_median", "length_max")])


@query("""WITH s AS (SELECT source AS arm, avg(CAST(quality AS DOUBLE)) AS p FROM documents JOIN labels USING (doc_id)
  GROUP BY 1), b AS (SELECT p FROM s WHERE arm = 'src1') SELECT arm, round(p - (SELECT p FROM b), 9) AS diff, p - (SELECT p
  FROM b) >= 0.05 AND p - 0.01 > (SELECT p FROM b) + 0.01 AS confirmed FROM s WHERE arm <> 'src1'""")
def lift_verdicts(spark, sf):
    both = table(spark, sf, "documents").select("doc_id", F.col("source").alias("arm")).join(table(spark, sf, "labels"), "doc_id")
    summary = both.groupBy("arm").agg(F.avg(F.col("quality").cast("double")).alias("pass_at_one")).withColumns({"low": F.col("pass_at_one") - 0.01,
        "high": F.col("pass_at_one") + 0.01})
    return stats.lifts(summary, "src1").withColumn("diff", F.round("diff", 9))


@query(f"""WITH {PG}, o AS (SELECT p_partkey AS child, p_partkey - 1 AS parent FROM part
  WHERE p_size = 7), v AS (SELECT DISTINCT src AS caller, child AS callee FROM pg JOIN o ON pg.dst = o.parent)
SELECT src AS caller, dst AS callee, false AS virtual FROM pg UNION ALL SELECT caller, callee, true FROM v""")
def virtual_call_edges(spark, sf):
    direct = d.part_calls(spark, sf).select("caller", "callee", "ord")
    overrides = table(spark, sf, "part").where("p_size = 7").select(F.col("p_partkey").alias("child"), (F.col("p_partkey") - 1).alias("parent"))
    return ingest.virtual_calls(direct, overrides).select("caller", "callee", "virtual")


@query(f"""WITH RECURSIVE {PG}, own AS (SELECT CAST(a.l_orderkey AS VARCHAR) AS m, a.l_linenumber AS src, b.l_linenumber AS dst
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  WHERE a.l_returnflag = b.l_returnflag),
e AS (SELECT DISTINCT m || '#' || src AS src, m || '#' || dst AS dst
  FROM own), st AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) || '#' || l_linenumber AS s FROM lineitem
  WHERE l_linestatus = 'F' AND l_linenumber = 3),
b(stmt, node) AS (SELECT s, s FROM st UNION SELECT b.stmt, e.src FROM b JOIN e ON e.dst = b.node), f(stmt, node) AS (SELECT s, s
  FROM st UNION SELECT f.stmt, e.dst FROM f JOIN e ON e.src = f.node) SELECT stmt, node FROM b UNION SELECT stmt, node FROM f""")
def statement_bridge(spark, sf):
    """Lines of an order are statements; one flows into the next where both were returned alike."""
    items = table(spark, sf, "lineitem")
    line = lambda n: F.concat_ws("#", F.col("l_orderkey").cast("string"), n.cast("string"))
    here = items.select("l_orderkey", "l_returnflag", F.col("l_linenumber").alias("a"))
    following = items.select("l_orderkey", "l_returnflag", (F.col("l_linenumber") - 1).alias("a"))
    edges = here.join(following, ["l_orderkey", "l_returnflag", "a"]).select(F.lit("DDG").alias("layer"),
        line(F.col("a")).alias("src"), line(F.col("a") + 1).alias("dst")).distinct()
    starts = items.where("l_linestatus = 'F' and l_linenumber = 3").select(line(F.col("l_linenumber")).alias("stmt")).distinct()
    return dependence.touched(edges, starts.select("stmt", F.col("stmt").alias("node")))


@query("""WITH x AS (SELECT l_orderkey AS m, l_linenumber AS line, l_partkey AS c, l_suppkey AS o, 'v' || l_returnflag AS name,
  l_linestatus = 'O' AS is_def FROM lineitem ),
w AS (SELECT *, last_value(CASE WHEN is_def THEN line END IGNORE NULLS) OVER (PARTITION BY m, name ORDER BY line, c,
  NOT is_def, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS src FROM x)
SELECT DISTINCT CAST(m AS VARCHAR) AS method, name, src, line AS dst FROM w WHERE NOT is_def AND src IS NOT NULL""")
def last_definitions(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("method"),
        F.col("l_linenumber").alias("stmt_ordinal"), F.when(F.col("l_linestatus") == "O",
        "LOCAL_DEF").otherwise("LOCAL_USE").alias("kind"), F.concat(F.lit("v"), "l_returnflag").alias("name"),
        F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("col"))
    return dependence.data_dependence(rows)


@query("""SELECT o_orderpriority AS cls, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
def failures_by_class(spark, sf):
    tests = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.concat_ws(".", "o_orderpriority",
        F.col("o_orderkey").cast("string")).alias("test"))
    return localize.failures_by_class(tests)


@query(f"""WITH {SIG}, t AS (SELECT unnest(types) AS a, unnest(list_append(types[2:], NULL)) AS b FROM ev)
  SELECT count(*) AS chains, (SELECT count(DISTINCT user_id) FROM ev) AS tests, (SELECT count(DISTINCT a)
  FROM t) AS methods, max(depth) AS max_depth FROM ev""")
def chain_statistics(spark, sf):
    return chains.statistics(d.event_chains(spark, sf)).withColumn("max_depth", F.col("max_depth").cast("long"))


@query(f"""WITH {SIG}, s AS (SELECT unnest(types) AS c, depth - generate_subscripts(types, 1) + 1 AS dist FROM ev)
  SELECT c AS caller, c AS callee, min(dist) AS dist FROM s GROUP BY 1""")
def nearest_chain_edges(spark, sf):
    return chains.nearest_edges(d.event_chains(spark, sf)).select("caller", "callee", F.col("dist").cast("long").alias("dist"))


@query("""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS doc, (length(text) + 3) // 4 AS b, (length(lang) + 3) // 4 AS l,
  (length(source) + 3) // 4 AS s FROM documents)
SELECT doc, CASE WHEN b + l + s <= 400 THEN 0 WHEN l + s <= 400 THEN 1 END AS tier FROM d""")
def budget_tiers(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc"), "text", "lang", "source")
    parts = docs.select("doc", F.lit("snippets").alias("part"),
        "text").union(docs.select("doc", F.lit("target"), "lang")).union(docs.select("doc", F.lit("siblings"), "source"))
    return chains.fit_budget(parts, 400, ["snippets"]).select("doc", "tier")


@query(f"""WITH {PG}, k AS (SELECT p_partkey AS node FROM part WHERE p_size BETWEEN 20 AND 30), lit AS (SELECT p_partkey AS id
  FROM part WHERE p_size > 40) SELECT node FROM k UNION SELECT src FROM pg WHERE dst IN (SELECT node FROM k) AND src IN (SELECT id
  FROM lit)""")
def literal_closure(spark, sf):
    nodes = table(spark, sf, "part").where("p_size between 20 and 30").select(F.col("p_partkey").alias("node"))
    literals = table(spark, sf, "part").where("p_size > 40").select(F.col("p_partkey").alias("id"))
    return traverse.literal_closure(nodes, literals, d.part_edges(spark, sf))


@query(f"""WITH {PG} SELECT 1 AS part,
  '  p' || CAST(p_partkey AS VARCHAR) || ' [label="' || CASE WHEN length(p_name) > 40 THEN substr(p_name, 1,
  39) || '…' ELSE p_name END || '", shape=box];' AS line FROM part
UNION ALL SELECT 2, '  p' || CAST(src AS VARCHAR) || ' -> p' || CAST(dst AS VARCHAR) || ' [color=blue];' FROM pg""")
def dot_graph(spark, sf):
    pid = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    nodes = table(spark, sf, "part").select(pid("p_partkey").alias("id"), F.lit("METHOD").alias("kind"), F.col("p_name").alias("label"))
    edges = d.part_edges(spark, sf).select(pid("src").alias("src"), pid("dst").alias("dst"), F.lit("DDG").alias("kind"))
    return sinks.dot_lines(nodes, edges)


@query("SELECT url AS path, length(html) // 4 AS tokens FROM pages")
def manifest_tokens(spark, sf):
    return sinks.manifest(table(spark, sf, "pages").select(F.col("url").alias("path"), F.length("html").alias("size")))


@query("""WITH m AS (SELECT p_brand || '.' || p_type AS fqn, p_partkey FROM part) SELECT fqn, max(p_partkey) AS line_start FROM m GROUP BY fqn""")
def last_overloads(spark, sf):
    rows = table(spark, sf, "part").select(F.concat_ws(".", "p_brand", "p_type").alias("fqn"), F.lit("f").alias("file"),
        F.col("p_partkey").cast("int").alias("line_start"), F.col("p_partkey").cast("int").alias("line_end"),
        F.col("p_partkey").cast("string").alias("id"))
    return graph.last_overload(rows).select("fqn", F.col("line_start").cast("long").alias("line_start"))


@query("SELECT lang, source, doc_id FROM documents WHERE contains(lower(lang || ' ' || source), 'c1') AND (lang = 'en' OR lang = 'fr')")
def filtered_view(spark, sf):
    return table(spark, sf, "documents").where(predicates.matches_search(["lang", "source"], "C1") & F.col("lang").isin("en",
        "fr")).select("lang", "source", "doc_id")


@query("SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS test FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') AND l_suppkey = 1")
def covering_that_ran(spark, sf):
    return impact.ran_only(impact.covering(d.coverage(spark, sf), "1"), d.orders_of(spark, sf, "O"))
