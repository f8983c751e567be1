"""Registered queries and the pipeline over the smallest tables, against SQL and brute force."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import BYTE, brute_classes, brute_spans, ids
from tests.test_java_and_streams import _rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.mark.parametrize("name", ["op4_url_rules", "op5_warc_bundles", "op9_embedding_near_dedup", "op10_suffix_array_dedup", "op11_ranked_lexical_search", "op13_filter_interaction_audit"])
def test_queries_equal_sql(spark, name):
    from tracewell.llm import queries

    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert _rows(got[cols]) == _rows(want[cols])


def test_every_operator_has_one_query(spark):
    from tracewell.llm import queries

    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == [*range(1, 14)]
    assert {n for n in queries.ORACLE_SQL} <= set(queries.QUERIES)


def best_overlap(item, doc):
    """(equal, length) of the best gapless segment of two word lists over all diagonals, +1 and -3."""
    best = (0, 0)
    for diagonal in range(-len(item) + 1, len(doc)):
        lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
        same = item[lo:hi] == doc[lo + diagonal : hi + diagonal]
        total = np.r_[0, np.cumsum(np.where(same, 1, -3))]
        end = int(np.argmax(total - np.minimum.accumulate(total)))
        start = int(np.argmin(total[: end + 1]))
        best = max(best, (int(same[start:end].sum()), end - start))
    return best


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline
    from tracewell.llm import private_data, quality
    from tracewell.llm.common import materialize
    from tracewell.llm.shingles import word_hashes

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    outs, now = [], docs
    for _, stage in corpus_pipeline.STAGES:
        now = materialize(stage(spark, now, SF), "test-stage")
        outs.append(now)
    for o in outs[:-1]:
        assert o.columns == docs.columns
    texts = [{r["doc_id"]: r["text"] for r in o.collect()} for o in (docs, *outs[:-1])]

    good = {r["doc_id"] for r in quality.score(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    assert set(texts[1]) == good and 0 < len(good) < len(texts[0])

    rows = sorted(texts[1].items())
    first: dict = {}
    for (i, _), c in zip(rows, brute_classes(rows)):
        first.setdefault(c, i)
    assert set(texts[2]) == set(first.values())

    bench = [word_hashes(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = set()
    for i, t in texts[2].items():
        w = word_hashes(t)
        for b in bench:
            if len(np.intersect1d(b, w)) >= 6:
                equal, n = best_overlap(b, w)
                if n >= min(13, len(b)) and equal >= 0.8 * n:
                    dirty.add(i)
    assert set(texts[3]) == set(texts[2]) - dirty and dirty

    spans = {r["doc_id"]: r["spans"] for r in private_data.spans(outs[2]).collect()}
    for i, t in texts[3].items():
        assert {f"{s['kind']}:{s['start']}:{s['end']}" for s in spans[i]} >= set(brute_spans(t))
        out, at = "", 0
        for s in spans[i]:
            if s["start"] >= at:
                out += t[at : s["start"]] + f"[{s['kind'].upper()}]"
            at = max(at, s["end"])
        assert texts[4][i] == out + t[at:]

    packed = outs[4].toPandas()
    want = {i: len(ids(BYTE, t)) for i, t in texts[4].items()}
    assert packed.groupby("doc_id")["length"].sum().to_dict() == want
    for _, s in packed.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 1024
    assert packed.sequence_id.nunique() <= -(-sum(want.values()) // 1024) * 1.02 + 1


def test_stages_take_odd_rows(spark):
    """Nulls in any column, empty texts, repeated rows and ids, and an empty table."""
    import corpus_pipeline

    plain = spark.read.parquet(f"{SF}/documents.parquet")
    some = [tuple(r) for r in plain.orderBy("doc_id").limit(30).collect()]
    text = some[3][1]
    odd = [(None, text, "en", "s", 3), (1000, None, None, None, None), (1001, "", "en", None, 0), (1002, text, "en", "s", len(text)), (1002, text, "en", "s", len(text)), (1002, "other " * 50, "en", "s", 300), (None, None, None, None, None)]
    now = spark.createDataFrame(some + odd, plain.schema)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        empty = stage(spark, now.limit(0), SF)
        out = stage(spark, now, SF)
        assert empty.count() == 0 and out.count() > 0
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == plain.columns and out.count() <= now.count()


def test_run_gives_the_last_stage(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.agg(F.sum("length")).first()[0] > 0
