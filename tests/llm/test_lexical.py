"""Ranked search by two trees against scoring every pair."""

import math
import random
import re

import pytest

from tests.llm.test_operators import docs, none, texts, words  # noqa: F401
from tracewell.llm import lexical


def brute(docs, items, most):  # noqa: F811
    """(item_id, rank, doc_id, score) from the definition alone."""
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(i, split(t)) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms, out = len(bags), sum(len(b) for _, b in bags), []
    df: dict = {}
    for _, b in bags:
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    for item, text in set(items):
        found = []
        for i, b in bags:
            m = 50 + 50 * len(b) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b.count(t) // (1000 * b.count(t) + 20 * m)) for t in set(split(text)) if t in b)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(found)[:most])]
    return sorted(out, key=str)


def got(spark, docs, items, most):  # noqa: F811
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in lexical.search(d, q, most).collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    vocabulary = [words(rng, 1) for _ in range(400)]
    sentence = lambda n: " ".join(rng.choice(vocabulary[: rng.choice((20, 400))]) for _ in range(n))
    rows = [(i, sentence(rng.randint(1, 80))) for i in range(900)]
    rows += [(1000 + i, rows[5][1]) for i in range(150)] + [rows[7], (None, rows[5][1]), (None, "Zz"), (2000, None), (2001, ""), (2002, " ...,;"), (2003, "é" * 50000 + " É-é_ZZ"), (2004, " ".join(vocabulary * 200))]
    return rows, [(i, sentence(12)) for i in range(40)] + [(3, rows[5][1]), (3, rows[5][1]), (50, None), (51, "..."), (52, "absent unseen"), (53, "É zz"), (None, rows[9][1])]


def test_equals_all_pairs(spark, corpus):
    rows, items = corpus
    assert got(spark, rows, items, 7) == brute(rows, items, 7)
    assert got(spark, rows, items, 50) == brute(rows, items, 50)


def test_blocks_and_small_trees(spark, corpus, monkeypatch):
    rows, items = corpus
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 9)
    monkeypatch.setattr(lexical, "BATCH_DOCS", 100)
    assert got(spark, rows, items, 5) == brute(rows, items, 5)


def test_pairs_are_pruned(corpus):
    """Most pairs of a clustered corpus are never scored."""
    import numpy as np

    rng = random.Random(2)
    topics = [[words(rng, 1) + str(k) for _ in range(30)] for k in range(40)]
    rows = [" ".join(rng.choice(topics[i % 40]) for _ in range(40)) for i in range(4000)]
    block = lexical.Items([(k, " ".join(topics[k][:10])) for k in range(40)])
    df: dict = {}
    bags = [{block.numbers[t]: x.split().count(t) for t in set(x.split()) if t in block.numbers} for x in rows]
    for b in bags:
        for t in b:
            df[t] = df.get(t, 0) + 1
    search = lexical.Search(block.weigh(4000, df), 4000, 160000, 5, [0] * 40)
    for at in range(0, 4000, 1000):
        part = bags[at : at + 1000]
        ends = np.r_[0, np.cumsum([len(b) for b in part])]
        term, tf = (np.array([x for b in part for x in f(b)], "int64") for f in (dict.keys, dict.values))
        search.add(np.arange(at, at + 1000), np.zeros(1000, bool), np.full(1000, 40), ends, term, tf)
    assert search.pairs == 160000 and search.scored < 0.15 * search.pairs


def test_odd_tables(spark, docs, none, texts):  # noqa: F811
    items = spark.createDataFrame([(1, texts[0])], "item_id long, text string")
    ranked = lexical.search(docs, items, 3).collect()
    assert [(r["rank"], r["doc_id"]) for r in sorted(ranked)] == [(1, 0), (2, 3), (3, 3)]
    assert lexical.search(none, items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs, none.selectExpr("doc_id as item_id", "text", "rank")).columns == ["item_id", "rank", "doc_id", "score"]
