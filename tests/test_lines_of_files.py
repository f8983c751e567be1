"""Executed lines meet spans of their own file alone."""

import random

from tests.rows import most_rows
from tracewell.sources import reports


def test_many_files_of_one_name(spark):
    rng = random.Random(11)
    lines = [(f"p{k}/F.java", n, rng.choice([0, 1]), f"/r/T{n % 2}.xml") for k in range(40) for n in range(-1, 60)]
    lines += [("q/G.java", n, 1, "/r/T.xml") for n in range(30)] + [("F.java", 7, 1, "/r/U.xml"), ("p1/F.java", 500, 1, "/r/T0.xml")]
    spans = [(f"p{k}.m{j}", f"src/p{k}/F.java", j * 9, j * 9 + 6) for k in range(20, 60) for j in range(6)]
    spans += [("z.g", "other/z/G.java", 5, 8), ("z.h", "other/zG.java", 5, 8), ("n", None, 1, 2), ("o", "src/p30/F.java", None, 4), ("e", "src/p30/F.java", 9, 3)]
    got = reports.coverage_from_execution(spark.createDataFrame(lines, "file string, line int, ci int, report string"),
        spark.createDataFrame(spans, "fqn string, file string, line_start int, line_end int"))
    ran = [(f, n, r.split("/")[-1][:-4]) for f, n, ci, r in lines if ci]
    met = [(f, fqn, t, path.endswith(f)) for f, n, t in ran for fqn, path, a, b in spans
        if path and None not in (a, b) and path.split("/")[-1] == f.split("/")[-1] and a <= n <= b]
    has = {f for f, _, _, exact in met if exact}
    want = {(fqn, t) for f, fqn, t, exact in met if exact or f not in has}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 300


def test_lines_and_spans_are_not_paired(spark):
    lines = spark.createDataFrame([(f"p{k}/F.java", n, 1, "/r/T.xml") for k in range(30) for n in range(100)], "file string, line int, ci int, report string")
    spans = spark.createDataFrame([(f"p{k}.m{n}", f"src/p{k}/F.java", n, n) for k in range(30) for n in range(100)], "fqn string, file string, line_start int, line_end int")
    found = reports.coverage_from_execution(lines, spans)
    assert most_rows(found) <= 10 * 3000 and found.count() == 3000
