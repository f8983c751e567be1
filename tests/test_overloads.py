"""Overloads of a name are picked for each line, with no pair of a frame and an overload."""

import random

from tests.rows import most_rows
from tracewell.operators import localize


def test_overloads_of_a_hot_name(spark):
    rng = random.Random(13)
    spans = [(rng.choice(["A.m", "A.n"]), f"i{k:03d}", rng.choice([rng.randrange(90), None]) if k % 7 == 0 else rng.randrange(90), rng.randrange(100), "f") for k in range(200)]
    frames = [(f"t{k}", 0, k % 2, "A", rng.choice("mnx"), rng.choice([None, rng.randrange(110)])) for k in range(500)]
    found = localize.resolve_methods(spark.createDataFrame(frames, "trace_id string, cause_ix int, frame_ix int, cls string, method string, line int"),
        spark.createDataFrame(spans, "fqn string, id string, line_start int, line_end int, file string"))
    want = set()
    for t, c, f, cls, method, line in frames:
        own = [s for s in spans if s[0] == f"{cls}.{method}"]
        inside = lambda s: None not in (line, s[2], s[3]) and s[2] <= line <= s[3]
        if own:
            want.add((t, f, min(own, key=lambda s: (not inside(s), s[2] is None, s[2] or 0, s[1]))[1]))
    assert {(r["trace_id"], r["frame_ix"], r["method_id"]) for r in found.collect()} == want and len(want) > 200
    assert most_rows(found) <= 20 * 200
