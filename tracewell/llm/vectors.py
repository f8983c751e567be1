"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosine checks, components.

Equal vectors of a label are merged first and carry their count. Each table keys a vector by its label and the signs of
its products with so many random hyperplanes. What is exchanged by key is ids alone: keys that two vectors share are
counted, and of keys with the very same members the one of the first table stays. Only members of these keys fetch their
vectors, in the components' own width. Rows of a key are compared in blocks, so a hot key becomes many tasks. A pair that
meets in several tables counts in the first one only, which both rows' keys tell without a shuffle of pairs. Blocks emit
link counts and one edge a row, never all pairs. The number of hyperplanes grows with the logarithm of the input and the
number of tables follows from the wanted recall, so work per vector stays about level.

Cases: a null label, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing;
vectors of other lengths than their partner's never link; a cosine at the threshold links; a null vec_id gives a row that
is its own component (null); repeated rows count as vectors of their own; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import configure, drop_materialized, materialize
from .components import components

BLOCK = 1024


def plan(n: int, cosine: float, recall: float) -> tuple[int, int]:
    """Hyperplanes a table, and tables, for so many vectors: a pair at the threshold is found with probability `recall`."""
    same = 1 - math.acos(cosine) / math.pi
    bits = min(48, max(8, math.ceil(math.log2(max(2, n)))))
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same**bits)))


def grouped(n: int, a, b):
    """The least index that each of n rows is connected with by pairs (a, b)."""
    import numpy as np

    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_pairs(unit, codes, side, tab: int, cosine: float):
    """(a, b), a < b, of rows at or over the cosine that no earlier table brings together; `side` tells two blocks apart,
    or is None within one."""
    import numpy as np

    left, right = [], []
    for at in range(0, len(unit), 256):
        near = unit[at : at + 256] @ unit.T >= cosine
        if side is not None:
            near &= side[at : at + 256, None] != side[None, :]
        a, b = np.nonzero(near)
        a += at
        fresh = a < b
        a, b = a[fresh], b[fresh]
        for s in range(0, len(a), 100_000):
            x, y = a[s : s + 100_000], b[s : s + 100_000]
            if tab:
                first = ~(codes[x, :tab] == codes[y, :tab]).any(axis=1)
                x, y = x[first], y[first]
            left.append(x)
            right.append(y)
    return (np.concatenate(x) if x else np.zeros(0, int) for x in (left, right))


KEYED = "id long, copies long, v binary, codes binary, keys array<long>"
CELL = ["key", "lo", "hi", "tab"]


def keyed_vectors(distinct: DataFrame, bits: int, tables: int, seed: int, width: str) -> DataFrame:
    """id, copies, the vector's bytes, its sign codes, and by table a hash of label, length, table and code."""
    code = "<u2" if bits <= 16 else "<u4" if bits <= 32 else "<u8"

    def keys(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        from .shingles import mix

        planes: dict = {}
        powers = 1 << np.arange(bits, dtype="uint64")
        tab = mix(np.arange(1, tables + 1, dtype="uint64"))
        for batch in batches:
            by_size: dict[int, list] = {}
            for label, i, copies, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                by_size.setdefault(len(v), []).append((xxhash.xxh64_intdigest(f"{label}|{len(v)}"), i, copies, v.values.to_numpy(zero_copy_only=False)))
            for size, own in by_size.items():
                if size not in planes:
                    planes[size] = np.random.default_rng([seed, size]).standard_normal((size, bits * tables))
                m = np.array([x[3] for x in own], "f8")
                k = ((m @ planes[size]).reshape(len(own), tables, bits) > 0) @ powers
                group = np.array([x[0] for x in own], "uint64")
                with np.errstate(over="ignore"):
                    hashed = mix(mix(k + tab[None, :]) ^ group[:, None]).view("int64")
                columns = [pa.array([x[1] for x in own], pa.int64()), pa.array([x[2] for x in own], pa.int64())]
                columns += [pa.array([x[3].astype(width).tobytes() for x in own], pa.binary()),
                    pa.array([x.tobytes() for x in k.astype(code)], pa.binary()), pa.array(list(hashed), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in KEYED.split(", ")])

    return distinct.select("label", "id", "copies", "v").mapInArrow(keys, KEYED)


def shared_keys(narrow: DataFrame) -> DataFrame:
    """(key, tab, blocks) of keys that several of rows (id, tab, key) share; of keys with equal members the first table's."""
    members = narrow.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("s1"),
        F.bit_xor(F.xxhash64(F.lit(7), "id")).alias("s2"), F.min("tab").alias("tab"))
    once = members.where("n > 1").groupBy("n", "s1", "s2").agg(F.min(F.struct("tab", "key")).alias("x"))
    return once.select("x.key", "x.tab", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))


def compared(cells: DataFrame, cosine: float, width: str, bits: int) -> DataFrame:
    """(id, gained, other): links that each row gains, and an edge to a row of its group, from rows dealt out by CELL."""
    code = "<u2" if bits <= 16 else "<u4" if bits <= 32 else "<u8"

    def compare(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def cell(name, rows):
            if len(rows) < 2:
                return None
            own, ids, copies, v, codes = zip(*rows)
            m = np.frombuffer(b"".join(v), width).reshape(len(rows), -1).astype("f8")
            m = m / np.abs(m).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
            unit = m / np.sqrt((m * m).sum(axis=1, keepdims=True))
            k = np.frombuffer(b"".join(codes), code).reshape(len(rows), -1)
            a, b = near_pairs(unit, k, np.array(own) if name[1] != name[2] else None, name[3], cosine)
            if not len(a):
                return None
            ids, copies = np.array(ids), np.array(copies, "f8")
            gained = (np.bincount(a, copies[b], len(rows)) + np.bincount(b, copies[a], len(rows))).astype("int64")
            label = grouped(len(rows), a, b)
            some = np.nonzero(gained)[0]
            return pa.RecordBatch.from_arrays([pa.array(ids[some], pa.int64()), pa.array(gained[some], pa.int64()),
                pa.array(ids[label[some]], pa.int64())], names=["id", "gained", "other"])

        name, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(9))):
                if row[:4] != name:
                    if held and (found := cell(name, held)) is not None:
                        yield found
                    name, held = row[:4], []
                held.append(row[4:])
        if held and (found := cell(name, held)) is not None:
            yield found

    return cells.select(*CELL, "own", "id", "copies", "v", "codes").mapInArrow(compare, "id long, gained long, other long")


def link(vectors: DataFrame, cosine: float = 0.98, recall: float = 0.9995, seed: int = 5) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for rows of (vec_id, embedding, label)."""
    spark = configure(vectors.sparkSession)
    narrow_type = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind, width = ("float", "<f4") if narrow_type else ("double", "<f8")
    v = F.transform("embedding", lambda x: x.cast(kind))
    number = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(number,
        F.lit(False)) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("v"), usable.alias("usable"))
    usable_rows = rows.where("usable").select("vec_id", "label", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), "v").alias("h2"))
    distinct = materialize(usable_rows.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"),
        F.first("v").alias("v")), "vectors")
    bits, tables = plan(distinct.count(), cosine, recall)
    keyed = materialize(keyed_vectors(distinct, bits, tables, seed, width), "keyed")
    narrow = keyed.select("id", F.posexplode("keys").alias("tab", "key"))
    shared = materialize(shared_keys(narrow), "keys")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    members = narrow.select("id", "key").join(shared, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("id", "key", "tab", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    cells = members.join(keyed.select("id", "copies", "v", "codes"), "id").repartition(*CELL[:3]).sortWithinPartitions(*CELL[:3])
    found = materialize(compared(cells, cosine, width, bits), "links")
    gained = found.groupBy("id").agg(F.sum("gained").alias("gained"))
    parts = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    facts = distinct.join(gained, "id", "left").join(parts.withColumnRenamed("node", "id"), "id", "left")
    facts = materialize(facts.select("label", "h1", "h2", (F.coalesce("gained", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component_id")), "facts")
    drop_materialized(spark, distinct, keyed, shared, found)
    linked = usable_rows.select("vec_id", "label", "h1", "h2").join(facts, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    apart = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(apart).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
