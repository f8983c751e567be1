"""MinHash near-deduplication: consistent weighted sampling over TF-IDF word shingles, banded, verified exactly.

1. Document frequencies of shingles over all documents, in a table of fixed size that workers read.
2. Texts with equal words merge into one; `bands` keys of `rows` samples each for the rest. Texts that share a key are
   candidates. What is exchanged by key is numbers of texts alone; of keys with the very same members one stays.
3. Each candidate is held against the first text of each of its keys by exact weighted Jaccard similarity. A task streams
   past one such text at a time; a hot one is repeated in many tasks. Components of these links settle what copies have in
   common with their first one.
4. A key whose members then still belong to several components needs the rest: its members are compared in blocks, bounded by
   count and by bytes, through an inverted index, across components only. A block emits a spanning forest of the pairs at or
   over the threshold, never all pairs. Only texts that share a key ever meet, so similarity that is merely passed on from
   text to text brings no further comparisons.
5. Components of all links are the classes; each is named by its smallest doc_id, which is kept.

A pair at the threshold shares a key with a probability of 1 - (1 - 0.8^4)^12 = 99.8 %, a pair at 0.9 practically always.

Cases: null text counts as empty; texts without words are equal to each other; a text of any length is one set of shingles
that one task holds; a null doc_id stays its own class unless its text is a copy, and never names a class that has other
members; a similarity at the threshold links; repeated rows are copies, and rows that repeat a doc_id with another text are
texts of their own, judged by text in keep(); an empty table gives an empty result; further columns are ignored by classes() and kept by keep().
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SUBS, SharedBytes, configure, drop_materialized, materialize, packed, sum_vectors, text_or_empty, unpacked
from .components import components

#: Texts, and bytes of their shingles, in a block of the exact comparison.
BLOCK, BLOCK_BYTES = 1500, 24_000_000
#: Texts that a task holds against one first text.
STREAM = 4000
#: Buckets of the document-frequency table in one row that a task hands on.
SLICE = 1 << 18
#: Bytes of a shingle and its term frequency.
EACH = 12


def document_frequencies(docs: DataFrame) -> SharedBytes:
    """Shares of documents by bucket, as levels. A task counts in a table of its own and hands on its slices."""
    from .shingles import BUCKETS

    def counts(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from .shingles import BUCKETS, bucket, shingles, word_hashes

        total, n = np.zeros(BUCKETS, "uint32"), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total[bucket(np.unique(shingles(word_hashes(text))))] += np.uint32(1)  # a bucket once, whatever meets in it
                n += 1
        if n:
            sub = TaskContext.get().partitionId() % SUBS
            for at, v in [(-1, np.array([n], "uint32")), *((i // SLICE, total[i : i + SLICE]) for i in range(0, BUCKETS, SLICE))]:
                if v.any():
                    wide = v.astype("uint64")
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([sub], pa.int32()),
                        pa.array([packed(wide)], pa.binary())], names=["at", "sub", "v"])

    parts = docs.select(text_or_empty().alias("text")).mapInArrow(counts, "at int, sub int, v binary")
    sums = materialize(sum_vectors(parts, "<u8", small=True), "frequencies")
    first = sums.where("at = -1").first()
    n = int(unpacked(bytes(first["v"]), "<u8")[0]) if first else 0

    def shares(batches) -> Iterator:
        import pyarrow as pa

        from .shingles import levels

        for batch in batches:
            for at, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = levels(unpacked(v.as_py(), "<u8"), n).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([at * SLICE], pa.int64()), pa.array([data], pa.binary())], names=["start", "data"])

    table = SharedBytes(materialize(sums.where("at >= 0").coalesce(8).mapInArrow(shares, "start long, data binary"), "shares"), BUCKETS)
    drop_materialized(docs.sparkSession, sums)
    return table


def fingerprint(words) -> tuple[int, int]:
    """A 128-bit fingerprint of the words of a text, as two signed numbers."""
    import xxhash

    raw = words.tobytes()
    return xxhash.xxh64_intdigest(raw, 1) - (1 << 63), xxhash.xxh64_intdigest(raw, 2) - (1 << 63)


def sketch(docs: DataFrame, table: SharedBytes, bands: int, rows: int) -> DataFrame:
    """doc_id, a hash of the text, the fingerprint of the words (f1, f2), the number of distinct shingles and the band keys."""

    def keys(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .shingles import Sampler, elements, mix, shingles, weights, word_hashes

        sampler = Sampler(bands * rows)
        for batch in batches:
            prints, sizes, own = [], [], []
            for text in batch.column(1).to_pylist():
                words = word_hashes(text)
                prints.append(fingerprint(words))
                e, tf = elements(shingles(words))
                sizes.append(len(e))
                s = sampler.samples(e, tf * weights(table.value, e)).reshape(bands, rows)
                key = np.arange(bands, dtype="uint64")
                with np.errstate(over="ignore"):
                    for j in range(rows):
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, j])
                own.append(key.view("int64") if len(e) else key[:0].view("int64"))
            columns = [batch.column(0), batch.column(2), *(pa.array([x[i] for x in prints], pa.int64()) for i in (0, 1)),
                pa.array(sizes, pa.int32()), pa.array(own, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "f1", "f2", "n", "keys"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("th"))
    return plain.mapInArrow(keys, "doc_id long, th long, f1 long, f2 long, n int, keys array<long>")


def candidates(texts: DataFrame) -> DataFrame:
    """(key, node, n, first, members, size) of the keys that several texts share: `first` is the least of them, `size` all
    their shingles. Keys with equal members bring one pair once."""
    banded = texts.where("rep is not null").select("node", "n", F.posexplode("keys").alias("band", "key"))
    shared = banded.groupBy("key").agg(
        F.count("*").alias("members"), F.bit_xor(F.xxhash64("node")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(7), "node")).alias("s2"),
        F.min("node").alias("first"), F.min("band").alias("band"), F.sum("n").alias("size"),
    ).where("members > 1")
    once = shared.groupBy("members", "s1", "s2").agg(F.min(F.struct("band", "key", "first", "size")).alias("x")).select("x.key", "x.first", "members", "x.size")
    kept = materialize(once, "keys")
    found = materialize(banded.select("key", "node", "n").join(kept, "key"), "members")
    drop_materialized(texts.sparkSession, kept)
    return found


def profiles(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, e, tf): distinct shingles and their term frequencies of the texts (node, doc_id, f1, f2); repeated rows repeat."""

    def make(batches) -> Iterator:
        import pyarrow as pa

        from .shingles import elements, shingles, word_hashes

        for batch in batches:
            rows = []
            for node, f1, f2, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                words = word_hashes(text)
                if fingerprint(words) == (f1, f2):  # another text may have the same doc_id
                    e, tf = elements(shingles(words))
                    rows.append((node, e.tobytes(), tf.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c,
                    k in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], names=["node", "e", "tf"])

    bodies = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(wanted.hint("merge"), "doc_id")
    return bodies.select("node", "f1", "f2", "text").mapInArrow(make, "node long, e binary, tf binary")


LINK = "a long, b long, similarity double"


def _links(found: list):
    """A batch of links."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "similarity"])


def first_links(members: DataFrame, bodies: DataFrame, table: SharedBytes, threshold: float) -> DataFrame:
    """Links of texts to the first text of one of their keys. Rows are sorted so that it comes ahead of those to be held
    against it; a task holds two sets of shingles at a time."""
    pairs = materialize(members.where("node != first").select("first", "node").distinct(), "pairs")
    parts = materialize(pairs.groupBy("first").agg(F.ceil(F.count("*") / STREAM).cast("int").alias("parts")), "parts")
    ahead = parts.select("first", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("first").alias("node"))
    behind = pairs.join(parts, "first").select("first", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node")
    rows = ahead.union(behind).join(bodies, "node").withColumn("later", F.col("node") != F.col("first"))
    rows = rows.select("first", "part", "later", "node", "e", "tf").repartition("first", "part").sortWithinPartitions("first", "part", "later")

    def compare(batches) -> Iterator:
        import numpy as np

        from .shingles import weights

        name = head = None
        for batch in batches:
            found = []
            for first, part, later, node, e, tf in zip(*(batch.column(i).to_pylist() for i in range(6))):
                own = np.frombuffer(e, "uint64")
                weight = (weights(table.value, own) * np.frombuffer(tf, "float32")).astype("float64")
                if not later:
                    name, head = (first, part), (own, weight, weight.sum())
                elif name == (first, part):
                    at = np.minimum(np.searchsorted(head[0], own), len(head[0]) - 1)
                    same = head[0][at] == own
                    overlap = np.minimum(head[1][at[same]], weight[same]).sum()
                    both = head[2] + weight.sum() - overlap
                    if overlap >= (threshold - 1e-12) * both:
                        found.append((node, first, float(overlap / both)))
            if found:
                yield _links(found)

    links = materialize(rows.mapInArrow(compare, LINK), "first-links")
    drop_materialized(members.sparkSession, pairs, parts)
    return links


def block_links(members: DataFrame, bodies: DataFrame, settled: DataFrame, table: SharedBytes, threshold: float) -> DataFrame:
    """Spanning forests of links between texts that share a key and are not in one component (node, component) yet."""
    held = members.join(settled, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = held.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("size") * EACH / BLOCK_BYTES)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = held.join(mixed, "key").withColumn("blocks", blocks).withColumn("own", own).withColumn("other",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "component", "node").join(bodies, "node")
    cells = cells.select("key", "lo", "hi", "own", "component", "node", "e", "tf").repartition("key", "lo",
        "hi").sortWithinPartitions("key", "lo", "hi", "node")

    def compare(batches) -> Iterator:
        name, rows = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(8))):
                if row[:3] != name:
                    if found := _forest(rows, name, table, threshold):
                        yield _links(found)
                    name, rows = row[:3], []
                if not rows or rows[-1][2] != row[5]:  # repeated rows of a text
                    rows.append(row[3:])
        if found := _forest(rows, name, table, threshold):
            yield _links(found)

    return materialize(cells.mapInArrow(compare, LINK), "block-links")


def _forest(rows: list, name, table: SharedBytes, threshold: float) -> list:
    """A spanning forest of the links among rows (own, component, node, e, tf) of a pair of blocks."""
    import numpy as np

    from .shingles import weights

    if len(rows) < 2:
        return []
    sets = [np.frombuffer(r[3], "uint64") for r in rows]
    sizes = [len(x) for x in sets]
    which, every = np.repeat(np.arange(len(rows)), sizes), np.concatenate(sets)
    weight = (weights(table.value, every) * np.concatenate([np.frombuffer(r[4], "float32") for r in rows])).astype("float64")
    total = np.bincount(which, weight, len(rows))
    shared, inverse = np.unique(every, return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    posting, posted = which[order], weight[order]
    ends = np.r_[0, np.cumsum(np.bincount(inverse, minlength=len(shared)))]
    by_row = np.r_[0, np.cumsum(sizes)]
    side, component = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    root, out = np.unique(component, return_inverse=True)[1], []
    for a in range(len(rows) - 1):
        part = slice(by_row[a], by_row[a + 1])
        el = inverse[part]
        several = ends[el + 1] - ends[el] > 1
        el, own = el[several], weight[part][several]
        if not len(el):
            continue
        n = ends[el + 1] - ends[el]
        at = np.repeat(ends[el] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        overlap = np.bincount(posting[at], np.minimum(np.repeat(own, n), posted[at]), len(rows))
        near = (overlap >= (threshold - 1e-12) * (total[a] + total - overlap)) & (root != root[a])
        near[: a + 1] = False
        if name[1] != name[2]:
            near &= side != side[a]
        for b in np.nonzero(near)[0]:
            if root[a] != root[b]:
                root[root == root[b]] = root[a]
                out.append((rows[a][2], rows[b][2], float(overlap[b] / (total[a] + total[b] - overlap[b]))))
    return out


def labelled(docs: DataFrame, threshold: float = 0.8, bands: int = 12, rows: int = 4) -> DataFrame:
    """One row for each document: doc_id, th (a hash of its text), class (a number that tells classes apart), class_id (the
    least doc_id of the class), n_copies (documents with its words)."""
    spark = configure(docs.sparkSession)
    table = document_frequencies(docs)
    sketches = materialize(sketch(docs, table, bands, rows), "sketches")
    merged = sketches.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.first("n").alias("n"),
        F.first("keys").alias("keys"))
    texts = materialize(merged.withColumn("node", F.monotonically_increasing_id()), "texts")
    members = candidates(texts)
    wanted = materialize(members.select("node").distinct().join(texts.select("node", F.col("rep").alias("doc_id"), "f1", "f2"), "node"), "wanted")
    bodies = materialize(profiles(docs, wanted), "profiles")
    near = first_links(members, bodies, table, threshold)
    settled = materialize(components(near), "settled")
    rest = block_links(members, bodies, settled, table, threshold)
    stars = settled.select(F.col("node").alias("a"), F.col("component").alias("b"))  # as good as the first links, and nearly done
    named = materialize(components(stars.union(rest.select("a", "b"))), "named")
    names = named.join(texts.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("class_id"))
    label = texts.select("f1", "f2", "node", "rep", "n_copies").join(named, "node", "left").join(names, "component", "left")
    label = materialize(label.select("f1", "f2", "n_copies", F.coalesce("component", "node").alias("class"), F.coalesce("class_id", "rep").alias("class_id")), "labels")
    drop_materialized(spark, texts, members, wanted, bodies, near, settled, rest, named)
    return sketches.select("doc_id", "th", "f1", "f2").join(label, ["f1", "f2"]).select("doc_id", "th", "class", "class_id", "n_copies")


def classes(docs: DataFrame, **options) -> DataFrame:
    """One row for each document: doc_id, class_id, kept (the class is named by it), n_copies (documents with its words)."""
    return labelled(docs, **options).select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), "n_copies")


def keep(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, with all columns: the one with the least doc_id, of several texts with that doc_id one. Rows
    without a doc_id stay, as no class is named by them; of rows that repeat a kept doc_id and text one stays."""
    found = labelled(docs, **options).where("doc_id = class_id")
    kept = materialize(found.groupBy("class").agg(F.min(F.struct("doc_id", "th")).alias("x"), F.count("*").alias("rows")).select("x.doc_id", "x.th", "rows"), "kept")
    name = "text_hash"
    while name in docs.columns:
        name += "_"
    keyed = docs.withColumn(name, F.xxhash64(text_or_empty()))
    named = keyed.join(kept.select("doc_id", F.col("th").alias(name)).hint("merge"), ["doc_id", name], "left_semi")
    if not kept.where("rows > 1").isEmpty():
        named = named.dropDuplicates(["doc_id", name])
    return named.select(docs.columns).union(docs.where("doc_id is null").select(docs.columns))
