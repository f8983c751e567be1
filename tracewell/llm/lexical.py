"""Ranked lexical search by two trees: each item's best documents, exactly, without scoring most pairs.

1. Documents are read once: how many terms each has, and how often it holds each term of the items (written to the shared
   folder). The corpus' statistics and the terms' weights follow from that.
2. Items form a tree, and so do the documents of each batch that a task reads; neighbours share their weightiest terms.
   A node of items holds each term's greatest weight in any of them, a node of documents each term's greatest share of a
   score. The product of the two is never less than the score of any pair below the two nodes.
3. The trees are descended together. A pair of nodes goes if its bound is less than the weakest k-th score among the items
   below; what is left at the leaves is scored in 64-bit integers. k-th scores start from those in a 32nd of the documents,
   which can only be too low, and rise as a task goes on. Tasks hand on k rows for each item at most, the best of which stay.

Items are the stated query set. They are taken in blocks of bounded size, as many as there are; documents aren't collected.

Cases: null and empty texts have no term: as documents they count for nothing, as items they find nothing; a text of any
length is read whole; of equal scores the smaller doc_id comes first, a null one last; repeated documents are ranked each,
repeated rows of items once, and rows that repeat an item_id with another text are items of their own; an item or a corpus
without a common term, or an empty table, gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import configure, materialize, text_or_empty

#: ASCII letters and digits, and all beyond ASCII.
TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Items and bytes of their texts in a block; a longer item is a block of its own.
BLOCK_ITEMS, BLOCK_BYTES = 256, 1 << 18
#: Children of a node in either tree, and the documents of a tree.
ITEM_FAN, DOC_FAN, BATCH_DOCS = 4, 16, 4096
#: The share of documents that first k-th scores come from.
SEED_SHARE = 32


def terms(text: str) -> list[str]:
    """A text's terms."""
    return TERM.findall(text.translate(_LOWER))


class _Ids(dict):
    """Term as written to its number, or -1; spellings are kept up to a bound."""

    def __init__(self, numbers: dict[str, int]):
        super().__init__()
        self.numbers = numbers

    def __missing__(self, raw: str) -> int:
        if len(self) > 300_000:
            self.clear()
        i = self[raw] = self.numbers.get(raw.translate(_LOWER), -1)
        return i


class Items:
    """A block of items: their terms by number, and the tree over their weights."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [i for i, _ in rows]
        self.terms = [sorted(set(terms(t or ""))) for _, t in rows]
        self.numbers = {t: k for k, t in enumerate(sorted({t for ts in self.terms for t in ts}))}
        self.weights: list[int] = []

    def weigh(self, n_docs: int, df: dict[int, int]) -> "Items":
        """Set terms' weights from the number of documents that hold them."""
        self.weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(k, 0) + 1))) for k in range(len(self.numbers))]
        return self

    def tree(self):
        """(order, levels, places): items in the order of the tree; for each level from the items up a matrix of term by node with
        the greatest weight, and where each node's children start; terms by the first item in that order that has them."""
        import numpy as np

        w = np.array(self.weights, "int64")
        own = [np.array([self.numbers[t] for t in ts], "int64") for ts in self.terms]
        heaviest = [tuple(x[np.argsort(-w[x], kind="stable")[:3]].tolist()) for x in own]
        order = sorted(range(len(own)), key=heaviest.__getitem__)
        dense = np.zeros((len(w), len(own)), "int64")
        for k, i in enumerate(order):
            dense[own[i], k] = w[own[i]]
        levels = [(dense, np.arange(len(own)))]
        while levels[-1][0].shape[1] > ITEM_FAN:
            starts = np.arange(0, levels[-1][0].shape[1], ITEM_FAN)
            levels.append((np.maximum.reduceat(levels[-1][0], starts, axis=1), starts))
        places = np.empty(len(w), "int64")
        places[np.argsort((dense > 0).argmax(1), kind="stable")] = np.arange(len(w))
        return order, levels, places


def profiles(docs: DataFrame, shared) -> DataFrame:
    """(doc_id, n, terms, tf): each document's terms with repeats, and the items' terms that it holds with their counts."""

    def rows(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        ids = _of(shared, "ids", lambda items: _Ids(items.numbers))
        for batch in batches:
            n, which, tf, ends = [], [], [], [0]
            for text in batch.column(1).to_pylist():
                found = TERM.findall(text)
                counts = Counter(map(ids.__getitem__, found))
                counts.pop(-1, 0)
                n.append(len(found))
                which += counts.keys()
                tf += counts.values()
                ends.append(len(which))
            ends = pa.array(np.array(ends), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (which, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tf"])

    return docs.mapInArrow(rows, "doc_id long, n long, terms array<int>, tf array<int>")


def _of(shared, what: str, make, held: dict = {}):  # noqa: B006
    """What is made of a broadcast, once for each worker."""
    if held.get("for") is not shared.value:
        held.clear()
        held["for"] = shared.value
    if what not in held:
        held[what] = make(shared.value)
    return held[what]


def _ranges(starts, lengths):
    """The numbers of several ranges in a row."""
    import numpy as np

    at = np.cumsum(lengths) - lengths
    return np.repeat(starts - at, lengths) + np.arange(int(lengths.sum()))


class Search:
    """The search of one task: its items' best documents so far."""

    def __init__(self, items: Items, n_docs: int, n_terms: int, most: int, least: list[int]):
        import numpy as np

        self.items, self.n_docs, self.n_terms, self.most = items, n_docs, n_terms, most
        self.order, self.levels, self.places = _tree(items)
        self.least = np.maximum(np.array([least[i] for i in self.order], "int64"), 1)
        self.weights = np.array(items.weights, "int64")
        self.best = [(np.zeros(0, "int64"),) * 3 for _ in self.order]
        self.scored = self.pairs = 0

    def shares(self, n, tf):
        """What each term adds to a score for a weight of one."""
        import numpy as np

        lengths, which = np.unique(n, return_inverse=True)
        m = np.array([50 + 50 * int(x) * self.n_docs // self.n_terms for x in lengths], "int64")[which]
        return 1_000_000_000 * tf // (1000 * tf + 20 * m)

    def add(self, doc_id, missing, n, ends, term, tf) -> None:
        """A batch of documents: ids, whether they are null, lengths, where each one's terms end, terms and their counts."""
        import numpy as np

        size = np.diff(ends)
        share = self.shares(np.repeat(n, size), tf)
        some = np.nonzero(size)[0]
        if not len(some):
            return
        # Documents whose weightiest terms agree, or occur in the same items, are neighbours.
        row = np.repeat(np.arange(len(size)), size)
        by = np.lexsort((term, -self.weights[term] * share, row))
        first = ends[:-1][some]
        top = [self.places[term[by[np.minimum(first + k, ends[1:][some] - 1)]]] for k in range(3)]
        some = some[np.lexsort((top[2], top[1], top[0]))]
        pick = _ranges(ends[:-1][some], size[some])
        term, share, size = term[pick], share[pick], size[some]
        doc_id, missing = doc_id[some], missing[some]
        levels = [(term, share, np.r_[0, np.cumsum(size)])]
        while len(levels[-1][2]) - 1 > DOC_FAN:
            levels.append(self._above(*levels[-1]))
        self.pairs += len(some) * len(self.order)
        self._descend(levels, doc_id, missing)

    @staticmethod
    def _above(term, share, ends):
        """The level above: each term's greatest share below a node."""
        import numpy as np

        node = np.repeat(np.arange(len(ends) - 1) // DOC_FAN, np.diff(ends))
        by = np.lexsort((term, node))
        node, term, share = node[by], term[by], share[by]
        start = np.nonzero(np.r_[True, (node[1:] != node[:-1]) | (term[1:] != term[:-1])])[0]
        return term[start], np.maximum.reduceat(share, start), np.searchsorted(node[start], np.arange(node[-1] + 2))

    def _descend(self, levels, doc_id, missing) -> None:
        """From pairs of the uppermost nodes to pairs of documents and items."""
        import numpy as np

        d, q = len(levels) - 1, len(self.levels) - 1
        nodes = np.arange(len(levels[d][2]) - 1)
        live = np.ones((len(nodes), self.levels[q][0].shape[1]), bool)
        while d or q:
            term, share, ends = levels[d]
            weakest = self._weakest(q)
            bound = self._products(term, share, ends, nodes, np.nonzero(live.any(0))[0], q)
            live &= bound >= weakest
            keep = live.any(1)
            nodes, live = nodes[keep], live[keep]
            if not len(nodes):
                return
            down = q > 1 or q == 1 and d != 1  # documents are held against the lowest groups of items before single ones
            if d:
                below = len(levels[d - 1][2]) - 1
                child = _ranges(nodes * DOC_FAN, np.minimum(DOC_FAN, below - nodes * DOC_FAN))
                live, nodes, d = live[np.searchsorted(nodes, child // DOC_FAN)], child, d - 1
            if down:
                live, q = live[:, np.arange(self.levels[q - 1][0].shape[1]) // ITEM_FAN], q - 1
        # Documents in slices that take up again what the ones before have raised.
        for at in range(0, len(nodes), 256):
            self._leaves(levels[0], nodes[at : at + 256], live[at : at + 256], doc_id, missing)

    def _weakest(self, q: int):
        """The weakest k-th score among the items below each node of a level."""
        import numpy as np

        weakest = self.least
        for _, starts in self.levels[1 : q + 1]:
            weakest = np.minimum.reduceat(weakest, starts)
        return weakest

    def _products(self, term, share, ends, nodes, columns, q: int):
        """Sums over terms of share by weight, for nodes by columns; others are -1."""
        import numpy as np

        out = np.full((len(nodes), self.levels[q][0].shape[1]), -1, "int64")
        weight = self.levels[q][0]
        weight = weight if len(columns) == weight.shape[1] else weight[:, columns]
        step = max(1, (1 << 22) // max(1, len(columns)))
        size = ends[nodes + 1] - ends[nodes]
        at = 0
        while at < len(nodes):  # so many terms at once that products stay small
            stop = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), step, "right")) + at)
            pick = _ranges(ends[nodes[at:stop]], size[at:stop])
            starts = np.cumsum(size[at:stop]) - size[at:stop]
            out[at:stop, columns] = np.add.reduceat(weight[term[pick]] * share[pick, None], starts, axis=0)
            at = stop
        return out

    def _leaves(self, level, nodes, live, doc_id, missing) -> None:
        """Score what is left and take the best."""
        import numpy as np

        columns = np.nonzero(live.any(0))[0]
        self.scored += int(live.sum())
        score = self._products(*level, nodes, columns, 0)
        score[~live] = -1
        hit, item = np.nonzero(score >= self.least)
        for i in np.unique(item).tolist():
            at = hit[item == i]
            old = self.best[i]
            s, gone, d = (np.r_[a, b] for a, b in zip(old, (score[at, i], missing[nodes[at]].astype("int64"), doc_id[nodes[at]])))
            by = np.lexsort((d, gone, -s))[: self.most]
            self.best[i] = s[by], gone[by], d[by]
            if len(by) == self.most:
                self.least[i] = max(self.least[i], s[by[-1]])

    def rows(self) -> tuple:
        """(item, doc_id, score) of the best so far; item is the place in the block."""
        import numpy as np
        import pyarrow as pa

        item = np.repeat(self.order, [len(s) for s, _, _ in self.best])
        s, gone, d = (np.concatenate([b[k] for b in self.best]) for k in range(3))
        return pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(d, pa.int64(), mask=gone.astype(bool)), pa.array(s, pa.int64())], names=["item", "doc_id", "score"])


def _tree(items: Items, held: dict = {}):  # noqa: B006
    """The tree of a block, made once for each worker."""
    if held.get("for") is not items:
        held.clear()
        held.update({"for": items, "tree": items.tree()})
    return held["tree"]


def best(found: DataFrame, most: int) -> DataFrame:
    """The first rows of each item by score, with their rank."""
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= most)


def _search(held: DataFrame, shared, most: int, n_docs: int, n_terms: int, least: list[int]) -> DataFrame:
    """Each task's best (item, doc_id, score)."""

    def rows(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        search = Search(shared.value, n_docs, n_terms, most, least)
        kept: list = []

        def flush() -> None:
            batch = pa.Table.from_batches(kept).combine_chunks()
            columns = {c: batch.column(c).chunk(0) if batch.num_rows else None for c in batch.column_names}
            if batch.num_rows:
                doc = columns["doc_id"]
                lists = columns["terms"], columns["tf"]
                ends = np.r_[0, np.cumsum(lists[0].value_lengths().to_numpy(zero_copy_only=False))].astype("int64")
                term, tf = (x.flatten().to_numpy().astype("int64") for x in lists)
                search.add(doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False), columns["n"].to_numpy(), ends, term, tf)
            kept.clear()

        for batch in batches:
            kept.append(batch)
            if sum(b.num_rows for b in kept) >= BATCH_DOCS:
                flush()
        if kept:
            flush()
        yield search.rows()

    return held.mapInArrow(rows, "item int, doc_id long, score long")


def _blocks(items: DataFrame) -> tuple[DataFrame, list[str]]:
    """Items with the block that each belongs to: so many, and so many bytes, that a task and the driver hold one."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text")).distinct()
    total = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.count("*").alias("n")).first()
    tasks = max(1, (total["bytes"] or 0) // BLOCK_BYTES, total["n"] // BLOCK_ITEMS)

    def deal(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        task, block, n, size = TaskContext.get().partitionId(), 0, 0, 0
        for batch in batches:
            names = []
            for text in batch.column(1):
                own = len(text.as_py().encode("utf-8", "replace"))
                if n and (n == BLOCK_ITEMS or size + own > BLOCK_BYTES):
                    block, n, size = block + 1, 0, 0
                n, size = n + 1, size + own
                names.append(f"{task}-{block}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string())], names=["item_id", "text", "block"])

    dealt = materialize(rows.repartition(tasks).mapInArrow(deal, "item_id long, text string, block string"), "items")
    return dealt, sorted(r["block"] for r in dealt.select("block").distinct().collect())


def search(docs: DataFrame, items: DataFrame, most: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's highest-scoring documents."""
    spark = configure(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    dealt, blocks = _blocks(items)
    out = []
    for name in blocks:
        block = Items([(r["item_id"], r["text"]) for r in dealt.where(F.col("block") == name).collect()])  # of bounded size
        shared = spark.sparkContext.broadcast(block)
        held = materialize(profiles(plain, shared), "term-profiles")
        total = held.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).first()
        if not total["terms"]:
            continue
        df = {r["t"]: r["count"] for r in held.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}  # the block's terms at most
        weighed = spark.sparkContext.broadcast(block.weigh(total["docs"], df))
        some = held.select("doc_id", "n", "terms", "tf").where(F.size("terms") > 0)
        seed = some.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(SEED_SHARE)) == 0)
        args = (weighed, most, total["docs"], total["terms"])
        first = best(_search(seed, *args, [0] * len(block.ids)), most).where(F.col("rank") == most).select("item", "score").collect()
        least = [dict(map(tuple, first)).get(i, 0) for i in range(len(block.ids))]
        found = best(_search(some, *args, least), most)
        names = spark.createDataFrame(list(enumerate(block.ids)), "item int, item_id long")
        out.append(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))  # a block's items at most
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
