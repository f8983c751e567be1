"""Control flow and dependence of many methods at once, held against plain versions by definition."""

import random

from tracewell.operators import flow

STATEMENTS = "method string, ordinal int, kind string, parent int, branch string"
EDGES = "method string, src int, dst int"


def program(rng, method, size):
    """Nested branches, loops, early returns and a try of random depth, as rows."""
    rows = []

    def block(parent, branch, depth):
        for _ in range(rng.randint(0 if depth else 1, 4)):
            if len(rows) >= size:
                return
            kind = rng.choice(["EXPR", "EXPR", "DECL", "IF", "IF", "WHILE", "FOREACH", "RETURN", "THROW", "TRY"])
            me = len(rows)
            rows.append((method, me, kind, parent, branch))
            if kind in ("IF", "WHILE", "FOREACH", "TRY") and depth < 5:
                block(me, "then", depth + 1)
                if kind != "WHILE" and rng.random() < 0.5:
                    block(me, "else", depth + 1)

    block(-1, "body", 0)
    return rows


def walked(rows):
    """Edges of one method by walking its statements in order with the exits that are open."""
    inside = {}
    for _, me, kind, parent, branch in rows:
        inside.setdefault((parent, branch), []).append((me, kind))
    edges = set()

    def walk(parent, branch, open_):
        for me, kind in inside.get((parent, branch), []):
            edges.update((e, me) for e in open_)
            open_ = {me}
            if kind in ("RETURN", "THROW"):
                open_ = set()
            elif kind in ("WHILE", "FOREACH"):
                edges.update((e, me) for e in walk(me, "then", {me}))
            elif kind == "IF":
                open_ = walk(me, "then", {me}) | walk(me, "else", {me})
        return open_

    walk(-1, "body", set())
    return edges


def by_removal(edges):
    """(nearest post-dominators, dependences) of one method: a node post-dominates those that cannot end without it."""
    nodes = {x for e in edges for x in e}
    after = {n: {b for a, b in edges if a == n} or {-1} for n in nodes}

    def ending(without):
        found, grown = {-1}, True
        while grown:
            more = {n for n in nodes - found - {without} if after[n] & found}
            found, grown = found | more, bool(more)
        return found

    while stuck := nodes - ending(None):
        after[max(stuck)] = after[max(stuck)] | {-1}
    cut = {d: nodes - ending(d) for d in nodes}  # those that d post-dominates, itself included
    above = {n: {d for d in nodes if n in cut[d] and d != n} for n in nodes}
    nearest = {n: max(above[n], key=lambda d: len(above[d]), default=-1) for n in nodes}
    depends = {(a, d) for a in nodes if len(after[a]) > 1 for b in after[a] - {-1} for d in above[b] | {b} if d != a and d not in above[a]}
    return nearest, depends


def by_method(df):
    got = {}
    for r in df.collect():
        got.setdefault(r[0], []).append((r[1], r[2]))
    assert all(len(v) == len(set(v)) for v in got.values())
    return {k: set(v) for k, v in got.items()}


def test_flow_and_dependence_of_programs(spark):
    rng = random.Random(5)
    programs = {f"m{i}": program(rng, f"m{i}", 40) for i in range(60)}
    rows = [r for p in programs.values() for r in p]
    cfg = flow.control_flow(spark.createDataFrame(rows + rows[:9], STATEMENTS))
    truth = {m: e for m, p in programs.items() if (e := walked(p))}
    assert by_method(cfg) == truth
    plain = spark.createDataFrame([(m, *e) for m, es in truth.items() for e in es], EDGES)
    found = by_method(flow.control_dependence(plain))
    assert found == {m: d for m, e in truth.items() if (d := by_removal(e)[1])} and found


def test_dependence_of_any_graph(spark):
    """Edges drawn at random: circles without an end, self loops, several ways into a loop."""
    rng = random.Random(11)
    graphs = {f"g{i}": {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, 2 * n))} for i in range(60) for n in [rng.randint(2, 12)]}
    # A long straight line, and a chain of branches each around one statement.
    graphs["line"] = {(i, i + 1) for i in range(25)} | {(0, 25)}
    graphs["ladder"] = {e for i in range(0, 24, 2) for e in ((i, i + 1), (i, i + 2), (i + 1, i + 2))}
    cfg = spark.createDataFrame([(m, *e) for m, es in graphs.items() for e in es] + [("g0", *next(iter(graphs["g0"]))), (None, 1, 2), ("null", None, 1)], EDGES)
    truth = {m: by_removal(e) for m, e in graphs.items()}
    assert by_method(flow.post_dominators(cfg)) == {m: set(near.items()) for m, (near, _) in truth.items()}
    assert by_method(flow.control_dependence(cfg)) == {m: d for m, (_, d) in truth.items() if d}


def test_empty(spark):
    none = spark.createDataFrame([], EDGES)
    assert flow.control_dependence(none).count() == flow.post_dominators(none).count() == 0
    assert flow.control_flow(spark.createDataFrame([], STATEMENTS)).count() == 0
    assert flow.control_flow(spark.createDataFrame([("m", 0, "EXPR", -1, "body")], STATEMENTS)).count() == 0
