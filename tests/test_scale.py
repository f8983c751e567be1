"""What must hold at any size: split documents, running sums, bitmaps, ranges, resampling, long paths, against brute force."""

import json
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.test_java_and_streams import _rows
from tracewell.operators import dyadic, matrix, prefix, ranking, stats, traverse
from tracewell.schema import PROPERTIES, RAW_EDGE, VERTEX
from tracewell.sources import sinks, splits

SF = "/root/testdata/sf0.001"
ODD = ['x"y', "}", '{"vertices":[', "a\\", '\\"}', "é{漢", '"edges":[{', "", None, "\n}\n", "@value", "\\\\"]


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(1)
    blank = [None] * len(PROPERTIES)
    rows = []
    for i in range(400):
        own = list(blank)
        own[PROPERTIES.index("CODE")], own[PROPERTIES.index("NAME")] = rng.choice(ODD), rng.choice(ODD)
        rows.append((f"v{i:04d}", "METHOD", *own))
    long = list(blank)
    long[PROPERTIES.index("CODE")] = "{" * 3000 + '}"' * 5000
    rows.append(("w", "TYPE", *long))
    arcs = [(rng.choice(["CALL", "AST"]), f"v{rng.randrange(400):04d}", f"v{rng.randrange(400):04d}", i) for i in range(700)]
    return spark.createDataFrame(rows, VERTEX), spark.createDataFrame(arcs, RAW_EDGE)


@pytest.mark.parametrize("wrapped", [False, True])
def test_one_document_in_splits(spark, graph, tmp_path, wrapped):
    """Written by the executors as one document and read in splits of any size, with elements longer than a split."""
    vertices, edges = graph
    path = str(tmp_path / "g.json")
    sinks.flat_document(vertices, edges, path, wrapped)
    doc = json.load(open(path, encoding="utf-8"))
    doc = doc["@value"] if wrapped else doc
    assert len(doc["vertices"]) == 401 and len(doc["edges"]) == 700
    size = os.path.getsize(path)
    for parts in (1, 13):
        got = splits.read(spark, path, size // parts + 1)
        assert sorted(map(str, got[0].select(*vertices.columns).collect())) == sorted(map(str, vertices.collect()))
        assert sorted(map(tuple, got[1].collect())) == sorted(map(tuple, edges.collect()))
    with splits._ranges_of(spark, size // 13 + 1):
        read = splits.pieces(spark, path).groupBy("block").agg(F.sum(F.octet_length("value") + 1).alias("bytes")).collect()
        assert len(read) == 13 and max(r["bytes"] for r in read) <= size // 13 + 4000  # and the piece that its end cuts


def test_other_forms_of_documents(spark, tmp_path):
    """White space, properties before lists, lists in any order, empty lists, nested keys of the same name, own parsers."""
    texts = ['{ "edges" : [ ], "meta": {"vertices": [{"id": "no"}]}, "vertices" : [ {"id":"a","label":"M","properties":{}} ,\n {"id":"b"} ] }\n', '{"vertices":[],"edges":[]}', "{}"]
    for k, text in enumerate(texts):
        path = str(tmp_path / f"{k}.json")
        open(path, "w").write(text)
        v, e = splits.read(spark, path, 16)
        assert sorted(r["id"] for r in v.collect()) == (["a", "b"] if k == 0 else []) and e.count() == 0
    kept = splits.read(spark, str(tmp_path / "0.json"), 16, parse=(lambda rows: rows, lambda rows: rows))[0].collect()
    assert sorted((r["ord"], json.loads(r["text"])["id"]) for r in kept) == [(0, "a"), (1, "b")]


def test_running_sums_over_hot_keys(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), i, rng.randrange(9) or None) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o long, v long")
    want, n, total = {}, Counter(), Counter()
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        n[k] += 1
        total[k] += v or 0
        want[o] = (n[k], total[k])
    got = prefix.running(df, ["k"], ["o"], {"run": F.col("v")}, "n", ranges=16)
    assert {r["o"]: (r["n"], r["run"]) for r in got.collect()} == want
    assert {r["o"]: r["n"] for r in prefix.numbered(df, [F.desc("o")], ranges=9).collect()} == {i: 3000 - i for i in range(3000)}
    assert prefix.numbered(df.limit(0), ["o"]).count() == 0
    dealt = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert dealt < 3000
    assert ranking.until(df, ["k"], ["o"], F.col("v"), 20).count() == sum(t <= 20 for _, t in want.values())


def test_bitmaps_of_a_matrix(spark):
    rng = random.Random(3)
    pairs = [(f"m{rng.randrange(30)}", f"t{rng.randrange(700)}") for _ in range(3000)]
    df = spark.createDataFrame(pairs, "method string, test string")
    tests = df.select("test").distinct()
    numbers = matrix.test_numbers(df)
    bits = matrix.bitmaps(df, numbers)
    red, green = tests.where("test like '%1'"), tests.where("test like '%2%'").union(spark.createDataFrame([("unknown",)], "test string"))
    got = {r["method"]: (r["ef"], r["ep"]) for r in matrix.red_green(bits, matrix.bitmap_of(red, numbers), matrix.bitmap_of(green, numbers)).collect()}
    known = set(pairs)
    assert got == {k: (sum(m == k and t.endswith("1") for m, t in known), sum(m == k and "2" in t for m, t in known)) for k, _ in known}
    assert {r["method"]: r["tests"] for r in matrix.sizes(bits).collect()} == Counter(m for m, _ in known)
    none = tests.limit(0)
    assert all((r["ef"], r["ep"]) == (0, 0) for r in matrix.red_green(bits, matrix.bitmap_of(none, numbers), matrix.bitmap_of(none, numbers)).collect())


def test_points_in_spans_of_any_width(spark):
    rng = random.Random(4)
    place = lambda: rng.choice([rng.randrange(-60, 60), rng.randrange(-(10**12), 10**12), None])
    points = [(i, place()) for i in range(300)]
    spans = [(j, a, None if a is None else a + rng.choice([0, 1, 5, 1000, 10**11, 10**12, -3])) for j in range(80) for a in [place()]]
    p, s = spark.createDataFrame(points, "i long, x long"), spark.createDataFrame(spans, "j long, a long, b long")
    want = sorted((i, j) for i, x in points if x is not None for j, a, b in spans if a is not None and a <= x <= b)
    assert sorted((r["i"], r["j"]) for r in dyadic.in_spans(p, s, "x", "a", "b").collect()) == want and len(want) > 300
    assert sorted(r["i"] for r in dyadic.in_any(p, s, "x", "a", "b").collect()) == sorted({i for i, _ in want})
    assert dyadic.in_spans(p, s.limit(0), "x", "a", "b").count() == 0 and dyadic.in_any(p.limit(0), s, "x", "a", "b").count() == 0
    widest = s.where("a is not null and a <= b").select(F.size(dyadic.cover(F.col("a"), F.col("b"))).alias("n")).agg(F.max("n")).first()[0]
    assert 1 < widest <= 2 * 41


def test_resampled_means_are_near_the_sampling_error(spark):
    rng = random.Random(5)
    rows = [(i, "a" if i % 2 else "b", rng.gauss(10, 3)) for i in range(800)] + [(900, "one", 7.0), (901, "none", None)]
    df = spark.createDataFrame(rows, "id long, arm string, v double")
    means = stats.resampled(df, "arm", F.col("id"), F.col("v"), 400)
    got = {r["arm"]: (r["low"], r["high"]) for r in stats.interval(means, "arm").collect()}
    assert got["one"] == (7.0, 7.0) and "none" not in got
    for arm in "ab":
        low, high = got[arm]
        error = 3 / 400**0.5
        assert 0.7 < (high - low) / (2 * 1.96 * error) < 1.3 and low < sum(v for _, a, v in rows if a == arm) / 400 < high
    again = stats.resampled(df.repartition(7), "arm", F.col("id"), F.col("v"), 400)
    assert sorted(round(r["mean"], 9) for r in again.collect()) == sorted(round(r["mean"], 9) for r in means.collect())


def test_simple_paths_of_any_depth(spark):
    rng = random.Random(6)
    arcs = {(rng.randrange(14), rng.randrange(14)) for _ in range(40)}
    out: list = []

    def walk(path):
        if path[-1] in (3, 9):
            out.append(path)
        for a, b in arcs:
            if a == path[-1] and b not in path and len(path) <= 25:
                walk([*path, b])

    walk([0])
    walk([3])
    edges = spark.createDataFrame(sorted(arcs), "src long, dst long")
    ends = lambda *n: spark.createDataFrame([(x,) for x in n], "node long")
    got = traverse.simple_paths(spark, edges, ends(0, 3), ends(3, 9), max_depth=25, most=None).collect()
    assert sorted(r["path"] for r in got) == sorted(out) and len(out) > 20
    some = traverse.simple_paths(spark, edges, ends(0, 3), ends(3, 9), max_depth=25, most=7).collect()
    assert [(r["depth"], r["path"]) for r in some] == sorted((len(p) - 1, p) for p in out)[:7]
    assert traverse.simple_paths(spark, edges, ends(77), ends(3)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["running_totals_of_events", "red_and_green_by_bitmaps", "interval_of_cycles", "signed_rank_sums", "wrapped_document_in_splits", "changes_between_iterations", "manifest_in_all", "steps_at_call_sites"])
def test_queries_equal_sql(spark, name):
    import duckdb

    from tracewell.plans import catalog_scale as c

    con = duckdb.connect()
    for t in ("part", "supplier", "orders", "lineitem", "events", "documents", "labels", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = c.QUERIES[name](spark, SF).toPandas(), con.execute(c.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and _rows(got[cols]) == _rows(want[cols])


def test_short_climbs_in_one_statement(spark):
    """The recursive statement and the levels find the same methods."""
    from tracewell.operators import ingest

    rng = random.Random(8)
    nodes = [(f"m{i}", "METHOD", None) for i in range(5)] + [(f"c{i}", "CALL", None) for i in range(60)] + [("s", "CALL", "m1")]
    tree = [("AST", f"c{rng.randrange(i)}" if i > 5 and rng.random() < 0.9 else f"m{rng.randrange(5)}", f"c{i}") for i in range(58)]
    v = spark.createDataFrame(nodes, "id string, label string, parent_method_id string")
    e = spark.createDataFrame(tree, "label string, out_v string, in_v string")
    up = {c: p for _, p, c in tree}

    def method(c, left=70):
        return c if c.startswith("m") else method(up[c], left - 1) if c in up and left else None

    want = {("s", "m1")} | {(f"c{i}", method(f"c{i}")) for i in range(58)}
    assert {tuple(r) for r in ingest.enclosing_methods(v, e).collect()} == want
    assert {tuple(r) for r in ingest.enclosing_methods_at_once(v, e, 60).collect()} == want
