"""Registered queries and their SQL counterparts. Every query applies library operators to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import chains, impact, knowledge, localize, matrix, ranking, stats, traverse
from . import derived as d
from .derived import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with SQL for the same rows if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


PG = """pg AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst
  FROM lineitem) WHERE dst IS NOT NULL AND src <> dst),
tests AS (SELECT p_partkey AS node FROM part WHERE p_size <= 5),
target AS (SELECT dst AS node FROM pg WHERE dst NOT IN (SELECT node FROM tests) GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)"""


@query(f"WITH {PG} SELECT src, dst FROM pg")
def pg_edges(spark, sf):
    return d.part_edges(spark, sf)


@query("""SELECT 'part' AS kind, count(*) AS n FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL
  SELECT 'orders', count(*) FROM orders
UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL
  SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'region', count(*) FROM region""")
def node_kind_counts(spark, sf):
    out = None
    for kind in ("part", "supplier", "orders", "lineitem", "customer", "nation", "region"):
        own = table(spark, sf, kind).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = own if out is None else out.union(own)
    return out


@query("SELECT CAST(l_suppkey AS VARCHAR) AS method, count(DISTINCT l_orderkey) AS tests, min(CAST(l_orderkey AS VARCHAR)) AS first_test, max(CAST(l_orderkey AS VARCHAR)) AS last_test FROM lineitem GROUP BY 1")
def calls_inverted(spark, sf):
    cov = d.coverage(spark, sf)
    ends = cov.groupBy("method").agg(F.min("test").alias("first_test"), F.max("test").alias("last_test"))
    return matrix.sizes(matrix.bitmaps(cov, matrix.test_numbers(cov))).join(ends, "method").select("method", "tests", "first_test", "last_test")


BACK = f"""WITH RECURSIVE {PG}, b(node, depth) AS (SELECT node, 0 FROM target UNION SELECT pg.src, b.depth + 1 FROM b JOIN pg ON pg.dst = b.node
  WHERE b.depth < {{most}} AND (b.depth = 0 OR b.node NOT IN (SELECT node FROM tests))),
inner_ AS (SELECT node, min(depth) AS depth FROM b GROUP BY node)"""


@query(BACK.format(most=60) + """ SELECT pg.src AS test, pg.dst AS entry, i.depth + 1 AS depth FROM pg JOIN inner_ i ON i.node = pg.dst
WHERE pg.src IN (SELECT node FROM tests) AND (i.depth = 0 OR pg.dst NOT IN (SELECT node FROM tests))""")
def chains_part_graph(spark, sf):
    calls = d.written_calls(spark, sf)
    return traverse.entry_depths(calls, d.busiest(spark, sf, calls), d.part_tests(spark, sf))


@query(f"""WITH {PG}, h1 AS (SELECT DISTINCT src AS node FROM pg JOIN target ON dst = node), h2 AS (SELECT DISTINCT src AS node
  FROM pg JOIN h1 ON dst = node), h3 AS (SELECT DISTINCT src AS node FROM pg JOIN h2 ON dst = node)
SELECT node, min(depth) AS depth FROM (SELECT node, 0 AS depth FROM target UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2
  FROM h2 UNION ALL SELECT node, 3 FROM h3) GROUP BY node""")
def reach_bounded(spark, sf):
    return traverse.within(d.part_edges(spark, sf), d.busiest(spark, sf), 3, "dst", "src")


@query(f"WITH RECURSIVE {PG}, r(node, depth) AS (SELECT node, 0 FROM target UNION SELECT pg.src, r.depth + 1 FROM r JOIN pg ON pg.dst = r.node WHERE r.depth < 40) SELECT node, min(depth) AS depth FROM r GROUP BY node")
def reach_callers(spark, sf):
    calls = d.written_calls(spark, sf)
    return traverse.reachable_callers(calls, d.busiest(spark, sf, calls), max_methods=1_000_000_000)


@query(f"WITH RECURSIVE {PG}, r(node, depth) AS (SELECT node, 0 FROM target UNION SELECT pg.dst, r.depth + 1 FROM r JOIN pg ON pg.src = r.node WHERE r.depth < 3) SELECT node, min(depth) AS depth FROM r GROUP BY node")
def reach_forward_parent(spark, sf):
    return traverse.reach_with_paths(d.part_edges(spark, sf), d.busiest(spark, sf), 3, "src", "dst").select("node", "depth")


@query(f"""WITH {PG}, o1 AS (SELECT dst AS node FROM pg JOIN target ON src = node), o2 AS (SELECT dst AS node FROM pg
  JOIN o1 ON src = node), i1 AS (SELECT src AS node FROM pg JOIN target ON dst = node), i2 AS (SELECT src AS node FROM pg
  JOIN i1 ON dst = node)
SELECT node FROM target UNION SELECT node FROM o1 UNION SELECT node FROM o2 UNION SELECT node FROM i1 UNION SELECT node FROM i2""")
def corridor_two_hops(spark, sf):
    return traverse.corridor(d.part_calls(spark, sf), d.busiest(spark, sf), 2)


@query(f"""WITH RECURSIVE {PG}, back(node, depth) AS (SELECT node, 0 FROM target UNION SELECT pg.src, back.depth + 1 FROM back
  JOIN pg ON pg.dst = back.node WHERE back.depth < 4),
forth(node, depth) AS (SELECT node, 0 FROM tests UNION SELECT pg.dst, forth.depth + 1 FROM forth JOIN pg ON pg.src = forth.node
  WHERE forth.depth < 4) SELECT node FROM back INTERSECT SELECT node FROM forth""")
def chop_intersection(spark, sf):
    return traverse.chop(d.part_edges(spark, sf), d.busiest(spark, sf), d.part_tests(spark, sf), max_depth=4, max_nodes=10_000_000)


@query(f"""WITH RECURSIVE {PG}, start AS (SELECT DISTINCT src AS node FROM pg
  JOIN target ON dst = node), p(cur, path) AS (SELECT node, [node] FROM start UNION ALL SELECT pg.dst, list_append(p.path, pg.dst)
  FROM p JOIN pg ON pg.src = p.cur WHERE len(p.path) <= 2 AND NOT list_contains(p.path, pg.dst))
SELECT array_to_string(path, '>') AS path, len(path) - 1 AS depth FROM p WHERE cur IN (SELECT node FROM target)""")
def simple_paths_bounded(spark, sf):
    edges, target = d.part_edges(spark, sf), d.busiest(spark, sf)
    start = edges.join(target.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
    found = traverse.simple_paths(spark, edges, start, target, max_depth=2, most=None)
    return found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), F.col("depth").cast("long").alias("depth"))


@query(f"WITH {PG} SELECT DISTINCT src AS caller, src IN (SELECT node FROM tests) AS is_test FROM pg JOIN target ON dst = node")
def direct_callers_split(spark, sf):
    return traverse.callers(d.part_calls(spark, sf), d.busiest(spark, sf), d.part_tests(spark, sf))


@query(f"""WITH {PG}, n AS (SELECT src AS node FROM pg UNION SELECT dst
  FROM pg), x1 AS (SELECT n.node, 1 + 0.01 * count(pg.src) AS s FROM n LEFT JOIN pg ON pg.dst = n.node GROUP BY n.node),
x2 AS (SELECT n.node, 1 + 0.01 * coalesce(sum(x1.s), 0) AS s FROM n LEFT JOIN pg ON pg.dst = n.node LEFT JOIN x1 ON x1.node = pg.src GROUP BY n.node),
x3 AS (SELECT n.node, 1 + 0.01 * coalesce(sum(x2.s), 0) AS s FROM n LEFT JOIN pg ON pg.dst = n.node LEFT JOIN x2 ON x2.node = pg.src
  GROUP BY n.node) SELECT node, round(CAST(s AS DOUBLE), 6) AS score FROM x3""")
def katz_three_rounds(spark, sf):
    edges = d.part_edges(spark, sf)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    return traverse.katz(edges, nodes, rounds=3, tolerance=0.0).select("node", F.round("score", 6).alias("score"))


@query(f"WITH {PG}, o AS (SELECT p_partkey AS node, p_brand AS owner FROM part) SELECT DISTINCT a.owner AS src, b.owner AS dst FROM pg JOIN o a ON a.node = pg.src JOIN o b ON b.node = pg.dst WHERE a.owner <> b.owner")
def owner_graph(spark, sf):
    return traverse.owner_graph(d.part_edges(spark, sf), table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("owner")))


@query(f"WITH {PG}, k AS (SELECT p_partkey AS node FROM part WHERE p_size > 25) SELECT src, dst FROM pg WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k)")
def induced_subgraph(spark, sf):
    return traverse.induced(d.part_edges(spark, sf), table(spark, sf, "part").where("p_size > 25").select(F.col("p_partkey").alias("node")))


SIG = """ev AS (SELECT user_id, CAST(ts AS DATE) AS day, min(event_id) AS chain_id, count(*) AS depth, string_agg(event_type, '>'
  ORDER BY ts, event_id) AS signature,
  list(event_type ORDER BY ts, event_id) AS types FROM events GROUP BY 1, 2),
sig AS (SELECT signature, count(*) AS n, count(DISTINCT user_id) AS tests, min(chain_id) AS first_chain,
  any_value(types[1]) AS entry, any_value(types[-2]) AS consumer, any_value(depth) AS depth FROM ev WHERE depth >= 2
  GROUP BY signature)"""


@query(f"WITH {SIG} SELECT signature, n, tests, first_chain, entry, consumer, depth FROM sig")
def event_signatures(spark, sf):
    found = chains.clusters(d.event_chains(spark, sf))
    return found.select(F.array_join("signature", ">").alias("signature"), "n", "tests", "first_chain", "entry", "consumer",
        F.col("depth").cast("long").alias("depth"))


@query(f"""WITH {SIG}, s AS (SELECT signature, n, row_number() OVER w AS rank,
  coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sig WHERE n > 1
  WINDOW w AS (ORDER BY n DESC, first_chain))
SELECT signature, n, CAST(rank AS INTEGER) AS rank FROM s WHERE before < ceil((SELECT sum(n) FROM sig) * 90 / 100.0) AND rank <= 10""")
def signature_cap(spark, sf):
    found = chains.capped(chains.clusters(d.event_chains(spark, sf)), 10, 90)
    return found.where("selected").select(F.array_join("signature", ">").alias("signature"), "n", "rank")


@query(f"WITH {SIG} SELECT consumer, count(*) AS clusters, CAST(sum(n) AS BIGINT) AS chains FROM sig GROUP BY consumer")
def consumer_rollup(spark, sf):
    return chains.consumers(chains.clusters(d.event_chains(spark, sf)))


MEMBERS = """m AS (SELECT l_returnflag || l_linestatus || CAST(l_linenumber AS VARCHAR) AS cluster,
  row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
  l_shipdate) AS member,
  l_linestatus AS a0, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS a1, l_linestatus AS expected FROM lineitem)"""


@query(f"""WITH {MEMBERS}, g AS (SELECT cluster, count(*) AS members, count(DISTINCT a0) AS v0, count(DISTINCT a1) AS v1,
  count(DISTINCT expected) AS texts FROM m GROUP BY cluster HAVING count(*) >= 2)
SELECT cluster, 'arg0_invariant_in_cluster' AS signal FROM g WHERE v0 = 1 UNION ALL SELECT cluster, 'arg1_invariant_in_cluster' FROM g WHERE v1 = 1
UNION ALL SELECT cluster, 'oracle_independent_of_target_args' FROM g WHERE texts = 1 AND (v0 > 1 OR v1 > 1)
UNION ALL SELECT cluster, CASE WHEN v0 > 1 THEN 'oracle_varies_only_with_arg0' ELSE 'oracle_varies_only_with_arg1' END FROM g
  WHERE texts > 1 AND ((v0 > 1) <> (v1 > 1))""")
def signal_invariants(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus",
        F.col("l_linenumber").cast("string")).alias("cluster"), F.monotonically_increasing_id().alias("member"),
        F.array("l_linestatus", F.col("l_quantity").cast("long").cast("string")).alias("args"),
        F.lit("EQUALS").alias("oracle_kind"), F.col("l_linestatus").alias("expected"), F.lit(None).cast("string").alias("message"),
        F.lit(None).cast("string").alias("type"))
    return chains.signals(rows)


CHANGED = "changed AS (SELECT s_suppkey AS k FROM supplier WHERE s_nationkey = 7)"


def _changed(spark, sf):
    return table(spark, sf, "supplier").where("s_nationkey = 7").select(F.col("s_suppkey").cast("string").alias("method"))


def _kills(spark, sf):
    return table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").cast("string").alias("method"),
        F.col("l_orderkey").cast("string").alias("test")).distinct()


@query(f"""WITH {CHANGED}, a AS (SELECT DISTINCT l_orderkey AS t FROM lineitem WHERE l_suppkey IN (SELECT k
  FROM changed)), r AS (SELECT DISTINCT l_orderkey AS t FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey IN (SELECT k
  FROM changed))
SELECT CAST(t AS VARCHAR) AS test, CASE WHEN t IN (SELECT t FROM r) THEN 1 ELSE 2 END AS tier FROM a""")
def impact_tiers(spark, sf):
    return impact.tiers(_changed(spark, sf), d.coverage(spark, sf), _kills(spark, sf))


@query("""SELECT CAST(l_partkey AS VARCHAR) AS method, l_linenumber AS line,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS killers,
CASE WHEN sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 0 THEN 'UNVERIFIED' WHEN sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) <= 3 THEN 'weak' ELSE 'strong' END AS strength
  FROM lineitem GROUP BY 1, 2""")
def region_strength(spark, sf):
    return impact.regions(d.mutants(spark, sf)).withColumn("strength", impact.strength(F.col("killers")))


@query("""WITH changed AS (SELECT p_partkey AS k FROM part WHERE p_size = 7) SELECT 'uncovered' AS kind,
  CAST(k AS VARCHAR) AS subject FROM changed WHERE k NOT IN (SELECT l_partkey FROM lineitem)
UNION ALL SELECT 'unverified', CAST(l_partkey AS VARCHAR) || ': line ' || CAST(l_linenumber AS VARCHAR) FROM lineitem
  WHERE l_partkey IN (SELECT k FROM changed) GROUP BY l_partkey, l_linenumber HAVING count(*) FILTER (WHERE l_returnflag = 'R') = 0
UNION ALL SELECT 'mismatch', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IN (SELECT k
  FROM changed) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT k FROM changed))""")
def blind_spots(spark, sf):
    changed = table(spark, sf, "part").where("p_size = 7").select(F.col("p_partkey").cast("string").alias("method"))
    mutants = d.mutants(spark, sf)
    regions = impact.regions(mutants).withColumn("label", F.concat(F.lit("line "), F.col("line").cast("string")))
    coverage = mutants.select("method", "test").distinct()
    # Urgent orders stand for tests that notice a mutant of the part with the customer's number.
    kills = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").cast("string").alias("method"), F.col("o_orderkey").cast("string").alias("test"))
    return impact.blind_spots(changed, coverage, regions, impact.tiers(changed, coverage, kills))


@query("""WITH cov AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem), f AS (SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'),
e AS (SELECT l_suppkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS ef, count(*) FILTER (WHERE o_orderstatus = 'O') AS ep
  FROM cov JOIN orders ON o_orderkey = l_orderkey GROUP BY 1),
s AS (SELECT CAST(l_suppkey AS VARCHAR) AS method, ef / sqrt(CAST((SELECT n FROM f) AS DOUBLE) * (ef + ep)) AS score, ef FROM e WHERE ef > 0)
SELECT method, round(score, 6) AS score, ef, CAST(row_number() OVER (ORDER BY score DESC, method) AS INTEGER) AS rank FROM s
  QUALIFY row_number() OVER (ORDER BY score DESC, method) <= 10""")
def suspects_ochiai(spark, sf):
    return localize.suspects(d.coverage(spark, sf), d.orders_of(spark, sf, "F"), d.orders_of(spark, sf, "O"),
        most=10).select("method", F.round("score", 6).alias("score"), "ef", "rank")


@query("""WITH e AS (SELECT CAST(l_suppkey AS VARCHAR) AS method, count(DISTINCT l_orderkey) AS ef FROM lineitem
  JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT method, CAST(ef AS DOUBLE) AS score, ef, 'FREQUENCY' AS mode FROM e ORDER BY ef DESC, method LIMIT 10""")
def suspects_frequency(spark, sf):
    none = spark.createDataFrame([], "test string")
    return localize.suspects(d.coverage(spark, sf), d.orders_of(spark, sf, "F"), none, most=10).select("method", "score", "ef", "mode")


@query("""WITH e AS (SELECT o_orderpriority AS p, CAST(l_suppkey AS VARCHAR) AS method,
  CAST(count(DISTINCT l_orderkey) AS DOUBLE) AS score FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2),
r AS (SELECT p, method, score, row_number() OVER w AS rank, lead(score) OVER w AS next FROM e WINDOW w AS (PARTITION BY p ORDER BY score DESC, method))
SELECT p, method, score, coalesce(abs(score - next) < 0.05, false) AS flat FROM r WHERE rank = 1""")
def flat_ranking_flag(spark, sf):
    both = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("o_orderkey")).join(table(spark, sf,
        "orders").select("o_orderkey", F.col("o_orderpriority").alias("p")), "o_orderkey")
    scores = both.distinct().groupBy("p", F.col("l_suppkey").cast("string").alias("method")).agg(F.count("*").cast("double").alias("score"))
    return ranking.flat_top(scores, ["p"], "score", [F.desc("score"), "method"]).where("rank = 1").select("p", "method", "score", "flat")


CO = """cov AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS method, l_orderkey AS t
  FROM lineitem), n AS (SELECT method, count(*) AS n FROM cov GROUP BY 1),
sh AS (SELECT method, count(*) AS s FROM cov WHERE t IN (SELECT t FROM cov WHERE method = '1') GROUP BY 1),
co AS (SELECT n.method, coalesce(s, 0) AS shared, round(coalesce(s, 0) / CAST(n.n + (SELECT n FROM n
  WHERE method = '1') - coalesce(s, 0) AS DOUBLE), 3) AS jaccard, n.n AS covered_by FROM n LEFT JOIN sh ON sh.method = n.method
  WHERE n.method <> '1')"""


@query(f"WITH {CO} SELECT method, shared, jaccard, covered_by FROM co")
def co_coverage_jaccard(spark, sf):
    return knowledge.co_coverage(d.coverage(spark, sf), "1")


@query(f"WITH {CO} SELECT method, shared, jaccard, covered_by FROM co WHERE jaccard > 0 AND method IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal > 0) ORDER BY jaccard DESC, method LIMIT 1")
def chokepoint(spark, sf):
    callers = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("caller"))
    return knowledge.chokepoint(knowledge.co_coverage(d.coverage(spark, sf), "1"), callers)


@query("SELECT o_orderkey, l_partkey, l_linenumber, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY GROUP BY 1, 2, 3")
def range_join_spans(spark, sf):
    points = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_linenumber", "l_shipdate")
    spans = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("low"),
        (F.col("o_orderdate") + F.expr("interval 30 days")).alias("high"))
    return ranking.range_join(points, spans, "o_orderkey", "l_shipdate", "low", "high").groupBy("o_orderkey", "l_partkey",
        "l_linenumber").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT user_id, event_id, ts, event_type, CASE WHEN event_type = 'view' THEN event_id END AS v FROM events),
w AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts,
  CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_view FROM e)
SELECT user_id, event_id, last_view FROM w WHERE event_type = 'purchase'""")
def asof_last_event(spark, sf):
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    left = events.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return ranking.as_of(left, right, ["user_id"], "ts", "view_id", "last_view", tie=["view_id"]).select("user_id", "event_id", "last_view")


@query("SELECT c_nationkey, c_name FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name, c_custkey) <= 2")
def exemplars(spark, sf):
    return ranking.first_per_key(table(spark, sf, "customer"), ["c_nationkey"], ["c_name", "c_custkey"], 2).select("c_nationkey", "c_name")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) <= CASE WHEN event_type = 'error' THEN 2 ELSE 6 END")
def sampling_caps(spark, sf):
    return ranking.quotas(table(spark, sf, "events"), ["user_id"], F.col("event_type") == "error", ["ts", "event_id"], 6,
        2).select("user_id", "event_id", "event_type")


@query("""WITH e AS (SELECT user_id, event_id, ts, event_type, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT
  FROM event_type THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM e) SELECT user_id,
  CAST(island AS BIGINT) AS island, min(event_type) AS event_type, count(*) AS n FROM i GROUP BY 1, 2""")
def collapse_repeats(spark, sf):
    found = ranking.islands(table(spark, sf, "events"), ["user_id"], "event_type", ["ts", "event_id"])
    return found.groupBy("user_id", F.col("island").cast("long").alias("island")).agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"))


@query("""WITH b AS (SELECT item_id, string_split(text, ' ') AS ws FROM benchmark
  WHERE text <> ''), n AS (SELECT item_id, ws, least(len(ws), 8) AS n FROM b),
bg AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM n)),
w AS (SELECT doc_id, string_split(text, ' ') AS ws FROM documents), k AS (SELECT doc_id, ws, n FROM w JOIN (SELECT DISTINCT n FROM n) ON len(ws) >= n),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM k))
SELECT DISTINCT item_id, doc_id FROM bg JOIN s ON s.g = bg.g""")
def leak_runs(spark, sf):
    """Pairs of which the document holds any eight words in a row of the item, or the whole of a shorter item."""
    from ..operators.leaks import word_runs

    return word_runs(table(spark, sf, "documents"), table(spark, sf, "benchmark"), 8)


@query("SELECT source, doc_id, CAST(running AS BIGINT) AS running FROM (SELECT source, doc_id, sum((length(text) + 3) // 4) OVER (PARTITION BY source ORDER BY doc_id) AS running FROM documents) WHERE running <= 20000")
def token_budget(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id", names.token_estimate("text").cast("long").alias("size"))
    return ranking.until(docs, ["source"], ["doc_id"], F.col("size"), 20_000).select("source", "doc_id", "running")


@query("""WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part) SELECT word AS name, levenshtein(word,
  (SELECT min(word) FROM w)) AS distance FROM w
WHERE levenshtein(word, (SELECT min(word) FROM w)) <= 2 ORDER BY distance, name LIMIT 5""")
def nearest_names(spark, sf):
    words = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("name")).distinct()
    first = words.agg(F.min("name")).first()[0]
    return names.nearest(first, words).select("name", F.col("distance").cast("long").alias("distance"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/?#]+)', 1) AS host, regexp_extract(url, '://[^/?#]+/([a-z]+)/', 1) AS section, TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS number FROM pages")
def trace_like_regex(spark, sf):
    part = lambda r: F.regexp_extract("url", r, 1)
    return table(spark, sf, "pages").select("page_id", part("^([a-z]+)://").alias("scheme"), part("://([^/?#]+)").alias("host"),
        part("://[^/?#]+/([a-z]+)/").alias("section"), part("/([0-9]+)").try_cast("long").alias("number"))


@query("""WITH v AS (SELECT event_type AS class, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events), c AS (SELECT class, k, count(*) AS n FROM v GROUP BY 1, 2)
SELECT class, CAST(sum(n) AS BIGINT) AS n, min(k) AS low, max(k) AS high, (SELECT list_sort(list(v.k))[count(v.k) // 2 + 1] FROM v
  WHERE v.class = c.class) AS median FROM c GROUP BY class""")
def json_props_classes(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("class"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    out = rows.groupBy("class").agg(F.count("*").alias("n"), F.min("k").alias("low"), F.max("k").alias("high"))
    return out.join(knowledge.median_of(rows, ["class"], "k", "median"), "class", "left")


@query("SELECT page_id, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS links, coalesce(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)[1], '') AS first_link FROM pages")
def html_unwrap(spark, sf):
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, sf, "pages").select("page_id", F.size(found).cast("long").alias("links"),
        F.coalesce(F.get(found, F.lit(0)), F.lit("")).alias("first_link"))


@query("SELECT doc_id, sha256(text) AS digest, substr(sha256(text), 1, 16) AS short FROM documents")
def source_fingerprint(spark, sf):
    from ..sources.text import short_digest

    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), short_digest("text").alias("short"))


@query("SELECT conv_id, turn, role, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, text), '') AS previous_role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS depth FROM conversations")
def turn_chain(spark, sf):
    rows = table(spark, sf, "conversations")
    out = ranking.previous_of(rows, ["conv_id"], ["turn", "text"], ["role"])
    from pyspark.sql.window import Window

    return out.select("conv_id", "turn", "role", F.coalesce("previous_role", F.lit("")).alias("previous_role"),
        (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text")) - 1).cast("long").alias("depth"))


@query("""WITH a AS (SELECT DISTINCT user_id FROM events
  WHERE event_type = 'error' AND ts < (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events)), b AS (SELECT DISTINCT user_id
  FROM events WHERE event_type = 'error' AND ts >= (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events))
SELECT CAST(coalesce(a.user_id, b.user_id) AS VARCHAR) AS test,
  CASE WHEN a.user_id IS NULL THEN 'broke' WHEN b.user_id IS NULL THEN 'fixed' ELSE 'still' END AS change FROM a FULL
  JOIN b ON a.user_id = b.user_id""")
def iteration_diff(spark, sf):
    events = table(spark, sf, "events")
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    middle = F.lit(low + (high - low) / 2)
    red = events.where("event_type = 'error'").select(F.col("user_id").cast("string").alias("test"), (F.col("ts") < middle).alias("early"))
    return impact.iteration_diff(red.where("early"), red.where("not early"))


@query("SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS b_count, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS c_count, count(*) AS n, round(avg(CAST(quality - toxic AS DOUBLE)), 9) AS effect FROM labels")
def paired_discordance(spark, sf):
    return stats.discordance(table(spark, sf, "labels").select(F.col("quality").alias("a"),
        F.col("toxic").alias("b"))).withColumn("effect", F.round("effect", 9))


@query("""WITH r AS (SELECT source AS arm, quality = 1 AS passed, n_chars AS cycles FROM documents
  JOIN labels USING (doc_id)), s AS (SELECT arm, count(*) AS n, avg(CAST(passed AS DOUBLE)) AS p FROM r GROUP BY 1)
SELECT arm, n, round(p, 9) AS pass_at_one, (SELECT list_sort(list(r.cycles))[count(*) // 2 + 1] FROM r
  WHERE r.arm = s.arm AND passed) AS cycles_median FROM s""")
def pass_rate_by_arm(spark, sf):
    both = table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    runs = both.select(F.col("source").alias("arm"), (F.col("quality") == 1).alias("passed"), F.col("n_chars").alias("cycles"))
    return stats.by_arm(runs).select("arm", "n", F.round("pass_at_one", 9).alias("pass_at_one"), "cycles_median")


@query("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity >= 49)")
def reads_writes_like(spark, sf):
    return table(spark, sf, "part").join(table(spark, sf,
        "lineitem").where("l_returnflag = 'R' and l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey")), "p_partkey",
        "left_anti").select("p_partkey", "p_name")
