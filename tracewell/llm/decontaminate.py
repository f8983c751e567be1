"""Benchmark decontamination by spaced seeds.

Each fixed mask looks at some positions of a window of words and ignores the others, so a seed still hits where ignored
words differ. Seeds of the benchmark are hashed into a table; around each hit of a document the two texts are aligned word
by word without gaps: the segment that scores best with +1 for equal and -3 for different words is a verified overlap if
it is long enough and enough of its words are equal. Where it isn't, as in short items with changes near an edge, the best
stretch of the least length or more on the same diagonal is held to the same similarity. Items shorter than the masks are
sought whole, whatever their length.

A benchmark of up to BLOCK_BYTES bytes is broadcast, and documents are streamed past it without a shuffle. A larger one is
joined: seeds of documents that pass a bit table of fixed size meet the benchmark's seeds by hash, and each (text, item)
that met is verified once, with the very same rules. Both ways give the same rows.

Cases: null and empty texts hit nothing, on either side; a text of any length is read whole; a null doc_id or item_id is
reported as such; repeated documents are reported each, repeated benchmark rows once; of overlaps with one item the one
with most equal words is reported, of several the first in the document, then in the item; an empty table on either side gives an empty result; further columns are
ignored by overlaps() and kept by clean().
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SharedBytes, configure, materialize, text_or_empty

#: Masks (fixed values): 1 looks at a word, 0 ignores it.
MASKS = ("110111", "11010011", "1100101011", "111000100011")
#: Bytes of a benchmark's texts up to which it is broadcast, however they fall into words.
BLOCK_BYTES = 8_000_000
#: Bits of the table of seeds in a broadcast, and of the one that documents pass before a join, as powers of two.
TABLE_BITS, JOIN_BITS = 22, 28
WIDEST = max(map(len, MASKS))


def masks(lengths: set[int]) -> list[list[int]]:
    """The positions that each mask looks at; then a whole window for each length of items that masks don't fit into."""
    return [[j for j, c in enumerate(m) if c == "1"] for m in MASKS] + [list(range(n)) for n in sorted(lengths) if 0 < n < WIDEST]


class Seeds:
    """The seeds of benchmark items."""

    def __init__(self, items: list[tuple[int, str]]):
        import numpy as np

        from .shingles import word_hashes

        self.words = [(i, w) for i, w in ((i, word_hashes(t or "")) for i, t in items) if len(w)]
        self.masks = masks({len(w) for _, w in self.words})
        self.tables = []
        for k, mask in enumerate(self.masks):
            whole = k >= len(MASKS)
            found = [(self.hash(w, mask)[:1] if whole else self.hash(w, mask), i) for i,
                (_, w) in enumerate(self.words) if (len(w) == len(mask) if whole else len(w) > mask[-1])]
            h = np.concatenate([x for x, _ in found]) if found else np.zeros(0, "uint64")
            item = np.repeat([i for _, i in found], [len(x) for x, _ in found]).astype("int64") if found else np.zeros(0, "int64")
            at = np.concatenate([np.arange(len(x)) for x, _ in found]) if found else np.zeros(0, "int64")
            order = np.argsort(h, kind="stable")
            seen = np.zeros(1 << TABLE_BITS, bool)
            seen[(h >> np.uint64(64 - TABLE_BITS)).astype("int64")] = True
            self.tables.append((h[order], item[order], at[order], seen))

    @staticmethod
    def hash(words, mask: list[int]):
        """The hash of the mask at each position of a text."""
        import numpy as np

        from .shingles import mix

        n = max(0, len(words) - mask[-1])
        h = np.full(n, np.uint64(len(mask)), "uint64")
        with np.errstate(over="ignore"):
            for j in mask:
                h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
        return mix(h)

    def hits(self, words) -> set[tuple[int, int]]:
        """(item, diagonal) of every seed hit in a text."""
        import numpy as np

        out: set[tuple[int, int]] = set()
        for mask, (h, item, at, seen) in zip(self.masks, self.tables):
            if not len(h) or len(words) <= mask[-1]:
                continue
            own = self.hash(words, mask)
            some = np.nonzero(seen[(own >> np.uint64(64 - TABLE_BITS)).astype("int64")])[0]
            if not len(some):
                continue
            lo, hi = np.searchsorted(h, own[some], "left"), np.searchsorted(h, own[some], "right")
            for p, a, b in zip(some[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                out.update(zip(item[a:b].tolist(), (p - at[a:b]).tolist()))
        return out

    def overlaps(self, text: str, least: int, similarity: float) -> list[tuple]:
        """(item_id, doc_start, doc_end, item_start, item_end, equal, similarity) of the best overlap with each item, in words."""
        from .shingles import word_hashes

        words = word_hashes(text)
        best: dict[int, tuple[tuple, tuple]] = {}
        for item, diagonal in self.hits(words):
            item_id, own = self.words[item]
            if found := aligned(own, words, diagonal, least, similarity):
                order = (-found[4], found[0], found[2])
                if item not in best or order < best[item][0]:
                    best[item] = order, (item_id, *found)
        return [found for _, found in best.values()]


def aligned(own, words, diagonal: int, least: int, similarity: float) -> tuple | None:
    """(doc_start, doc_end, item_start, item_end, equal, similarity) of the overlap of an item with a text on a diagonal."""
    import numpy as np

    lo, hi = max(0, -diagonal), min(len(own), len(words) - diagonal)
    same = own[lo:hi] == words[lo + diagonal : hi + diagonal]
    total = np.r_[0, np.cumsum(np.where(same, 1, -3))]
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.argmin(total[: end + 1]))
    equal, n = int(same[start:end].sum()), end - start
    need = min(least, len(own))
    if (n < need or equal < similarity * n) and len(same) >= need:
        start, end = _stretch(same, need, similarity)
        equal, n = int(same[start:end].sum()), end - start
    if n < need or equal < similarity * n:
        return None
    return lo + start + diagonal, lo + end + diagonal, lo + start, lo + end, equal, equal / n


def _stretch(same, need: int, similarity: float) -> tuple[int, int]:
    """(start, end) of the stretch of at least `need` words whose equal words are most above the similarity; the longest on ties."""
    import numpy as np

    above = np.r_[0, np.cumsum(same)] - similarity * np.arange(len(same) + 1)
    above = np.round(above, 9)
    low = np.minimum.accumulate(above[: len(same) - need + 1])
    over = np.round(above[need:] - low, 9)
    end = need + len(over) - 1 - int(np.argmax(over[::-1]))
    return int(np.argmin(above[: end - need + 1])), end


OVERLAP = "doc_id long, item_id long, doc_start int, doc_end int, item_start int, item_end int, equal_words int, similarity double"


def _batch(found: list):
    import pyarrow as pa

    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=[x.split()[0] for x in OVERLAP.split(", ")])


def _items(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """Distinct items, and how many bytes their texts have."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text")).distinct()
    return items, items.agg(F.sum(F.octet_length("text").cast("long") + 16)).first()[0] or 0  # with room for an item_id


def seeds_of(texts: DataFrame, lengths: list[int], whole: bool, table: SharedBytes | None = None) -> DataFrame:
    """(seed, th) of texts (th, text): hashes of all masks at all places, once each; of items (`whole`) windows of a length
    only from items of that length. With a table, what it lets through."""

    def rows(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .shingles import word_hashes

        every = masks(set(lengths))
        for batch in batches:
            for th, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = word_hashes(text.as_py())
                some = [Seeds.hash(words, m) for k, m in enumerate(every) if len(words) > m[-1] and not (whole and k >= len(MASKS) and len(words) != len(m))]
                h = np.unique(np.concatenate(some)) if some else np.zeros(0, "uint64")
                if table is not None:
                    slot = h >> np.uint64(64 - JOIN_BITS)
                    h = h[(table.value[(slot >> np.uint64(3)).astype("int64")] >> (slot & np.uint64(7)).astype("uint8")) & 1 == 1]
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view("int64")), pa.array([th] * len(h), pa.int64())], names=["seed", "th"])

    return texts.select("th", "text").mapInArrow(rows, "seed long, th long")


def _seed_table(seeds: DataFrame) -> SharedBytes:
    """The bits of seeds, by slices of the table."""
    size = 1 << 15  # bytes in a slice
    at = seeds.select(F.shiftrightunsigned("seed", 64 - JOIN_BITS).alias("at"))
    keyed = at.selectExpr("shiftright(at, 18) as slice", "shiftright(at, 3) as byte", "shiftleft(1, cast(at & 7 as int)) as bit")
    some = keyed.groupBy("slice", "byte").agg(F.bit_or("bit").alias("bit"))

    def slices(key, pdf):
        import numpy as np
        import pandas as pd

        data = np.zeros(size, "uint8")
        data[pdf["byte"].to_numpy() - key[0] * size] = pdf["bit"].to_numpy().astype("uint8")
        return pd.DataFrame({"start": [key[0] * size], "data": [data.tobytes()]})

    done = materialize(some.groupBy("slice").applyInPandas(slices, "start long, data binary"), "seed-bits")
    return SharedBytes(materialize(done.coalesce(8), "seed-table"), 1 << (JOIN_BITS - 3))


def _joined(plain: DataFrame, items: DataFrame, least: int, similarity: float) -> DataFrame:
    """Overlaps by a join of seeds: (text, item) pairs that share one are verified once for each document with the text."""
    keyed = materialize(items.withColumn("th", F.xxhash64("item_id", "text")), "items")
    size = F.size(F.filter(F.split("text", "\\s+"), lambda w: w != ""))
    lengths = [r["n"] for r in keyed.select(size.alias("n")).where(F.col("n") < WIDEST).distinct().collect()]  # under WIDEST of them
    own = materialize(seeds_of(keyed, lengths, True), "seeds")
    docs = plain.withColumn("th", F.xxhash64("text"))
    theirs = seeds_of(docs, lengths, False, _seed_table(own))
    met = materialize(theirs.withColumnRenamed("th", "doc_th").join(own.withColumnRenamed("th", "item_th"), "seed").select("doc_th",
        "item_th").distinct(), "met")
    pairs = met.join(keyed.select(F.col("th").alias("item_th"), "item_id", F.col("text").alias("item")),
        "item_th").select(F.col("doc_th").alias("th"), "item_id", "item")

    def verify(batches) -> Iterator:
        for batch in batches:
            found = []
            for doc_id, text, item_id, item in zip(*(batch.column(i).to_pylist() for i in range(4))):
                found += [(doc_id, *x) for x in _kept((item_id, item)).overlaps(text, least, similarity)]
            if found:
                yield _batch(found)

    return docs.join(pairs, "th").select("doc_id", "text", "item_id", "item").mapInArrow(verify, OVERLAP)


def _kept(item: tuple, held: dict = {}) -> Seeds:  # noqa: B006
    """The seeds of an item; a worker keeps those that it used last."""
    if item not in held:
        if len(held) > 1000:
            held.clear()
        held[item] = Seeds([item])
    return held[item]


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = 13, similarity: float = 0.8) -> DataFrame:
    """The best verified overlap of each document with each benchmark item it holds a passage of."""
    spark = configure(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    items, total = _items(benchmark)
    if total > BLOCK_BYTES:
        return _joined(plain, items, least, similarity)
    shared = spark.sparkContext.broadcast([tuple(r) for r in items.collect()])  # BLOCK_BYTES at most

    def rows(batches) -> Iterator:
        seeds = _seeds(shared)
        for batch in batches:
            found = [(i, *x) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in seeds.overlaps(t, least, similarity)]
            if found:
                yield _batch(found)

    return plain.mapInArrow(rows, OVERLAP)


def clean(docs: DataFrame, benchmark: DataFrame, least: int = 13, similarity: float = 0.8) -> DataFrame:
    """The documents without a verified overlap, with all their columns."""
    spark = configure(docs.sparkSession)
    items, total = _items(benchmark)
    if total > BLOCK_BYTES:
        # Documents are told apart by a hash of their text, which is what an overlap depends on.
        name = "text_hash"
        while name in docs.columns:
            name += "_"
        keyed = docs.withColumn(name, F.xxhash64(text_or_empty()))
        plain = keyed.select(F.col(name).alias("doc_id"), text_or_empty().alias("text"))
        dirty = materialize(_joined(plain, items, least, similarity).select(F.col("doc_id").alias(name)).distinct(), "contaminated")
        return keyed.join(dirty, name, "left_anti").select(docs.columns)
    at = docs.columns.index("text")
    shared = spark.sparkContext.broadcast([tuple(r) for r in items.collect()])  # BLOCK_BYTES at most

    def rows(batches) -> Iterator:
        import pyarrow as pa

        seeds = _seeds(shared)
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array([not seeds.overlaps(t or "", least, similarity) for t in batch.column(at).to_pylist()]))

    return docs.mapInArrow(rows, docs.schema)


_made: list = [None, None]


def _seeds(shared) -> Seeds:
    """The seeds of a broadcast benchmark, made once for each worker."""
    if _made[0] is not shared.value:
        _made[:] = shared.value, Seeds(shared.value)
    return _made[1]
