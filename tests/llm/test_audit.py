"""The retracting audit against counting by definition, whatever order files come in."""

import random
import re
from collections import defaultdict
from itertools import permutations

from tests.llm.test_operators import words
from tracewell.llm import audit

SCHEMA = "doc_id long, text string, source string, mask int"


def brute(rows, labels):
    """(part, order, step, counts...) from the definition alone."""
    bit = dict(zip("ABCDE", (1, 2, 4, 8, 16)))
    known = [x for x in labels if x[0] is not None]
    first: dict = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    docs = defaultdict(list)
    for i, t, source, _ in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": t in first and (i is None or i > first[t])}
        docs[source or ""].append(({f for f in fails if fails[f]}, any(q == 1 for j, q, _ in known if j == i), any(x == 1 for j, _, x in known if j == i)))
    out = []
    for part, found in docs.items():
        removed = {(o, k): [d for d in found if o[k] in d[0] and not d[0] & set(o[:k])] for o in map("".join, permutations(bit)) for k in range(5)}
        shapley = {f: sum(len(v) for (o, k), v in removed.items() if o[k] == f) for f in bit}
        for (o, k), gone in removed.items():
            out.append((part, o, k + 1, sum(not d[0] & set(o[: k + 1]) for d in found), len(gone), sum(o[k] in d[0] and bool(d[0] & set(o[:k])) for d in found),
                sum(d[0] == {o[k]} for d in found), sum(d[1] for d in gone), sum(d[2] for d in gone), shapley[o[k]]))
    return sorted(out)


def test_equals_brute_force_in_any_order(spark, tmp_path):
    rng = random.Random(6)
    texts = [words(rng, rng.choice((5, 60, 90))) for _ in range(25)]
    texts += [texts[9].upper(), "one two " * 80, "5 % of " + texts[1], None, "", " \t\x0b\x0c\r\n ", "É " * 60, "a\x1cb\x85c　d " * 30]
    rows = [(i, rng.choice(texts), rng.choice(("x", "y", "", None)), 7) for i in range(300)]
    rows += rows[:3] + [(5, texts[2], "x", 7), (5, texts[2], "y", 7), (None, texts[2], "x", 7), (None, "only null", "z", 7), (None, "only null", "z", 7)]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in range(0, 300, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute(rows, labels)
    for k, order in enumerate((sorted(rows, key=str), sorted(rows, key=str, reverse=True))):
        path = str(tmp_path / f"t{k}.parquet")
        for at in range(0, len(order), 60):  # a file each, small ids first or last
            spark.createDataFrame(order[at : at + 60], SCHEMA).coalesce(1).write.mode("append").parquet(path)
        got = audit.audit(spark, path, marked, batches=3).collect()
        assert sorted(tuple(r) for r in got) == want


def test_smaller_ids_take_counts_back(spark, tmp_path):
    """Each micro-batch's changes, with a text whose ids come in falling order."""
    path = str(tmp_path / "t.parquet")
    for i in (9, 5, 1, 7):
        spark.createDataFrame([(i, "same", f"s{i}", 0)], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    seen = []

    def look(df, number):
        seen.append(sorted((r["doc_id"], r["mask"], r["change"]) for r in df.collect()))

    flow = audit.changes(audit.masks(stream, 4)).writeStream.foreachBatch(look).option("checkpointLocation", str(tmp_path / "c"))
    flow.trigger(availableNow=True).start().awaitTermination()
    assert seen == [[(9, 1, 1)], [(5, 1, 1), (9, 1, -1), (9, 17, 1)], [(1, 1, 1), (5, 1, -1), (5, 17, 1)], [(7, 17, 1)]]


def test_repeats_within_a_task_are_settled_there(spark):
    rows = spark.createDataFrame([(i, "copy" if i % 3 else f"own {i}", "s", 0) for i in range(600)], SCHEMA).coalesce(1)
    out = audit.masks(rows, 64).collect()
    assert len(out) == 600 and sum(r["text"] is not None for r in out) == 201 and len({r["key"] for r in out if r["text"] is None}) > 50


def test_empty_table(spark, tmp_path):
    path, labels = str(tmp_path / "e.parquet"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    assert audit.audit(spark, path, labels).count() == 0


def test_stores_set_no_space_aside(spark, tmp_path):
    """Each partition's store has a manifest, for which RocksDB would hold 4 MB of disk ahead of use."""
    import os

    path, marked = str(tmp_path / "t.parquet"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    spark.createDataFrame([(i, f"text {i}", "s", 0) for i in range(40)], SCHEMA).coalesce(1).write.parquet(path)
    root = spark._jvm.org.apache.spark.util.Utils.getLocalDir(spark.sparkContext._jsc.sc().conf())
    before = set(_manifests(root))
    audit.audit(spark, path, marked).count()
    found = set(_manifests(root)) - before
    assert found and max(os.stat(f).st_blocks * 512 for f in found) < 1_000_000


def _manifests(root):
    import os

    return [f"{d}/{f}" for d, _, files in os.walk(root) for f in files if f.startswith("MANIFEST")]
