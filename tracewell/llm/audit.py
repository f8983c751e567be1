"""Filter interaction audit as a stream that retracts.

All files of a table go through as available-now micro-batches. A document's failures of the filters that look at it alone are
a mask of bits. Whether its text occurs under a smaller id can only be told from all that has come so far, and may change:
state keyed by text keeps the smallest id and its mask. When a smaller id arrives, the earlier document's mask is taken back
from the counters of its part and counted again with the bit of a repeated text. Each micro-batch adds its changes to the
counters under its own number, so that a batch that is run again counts once.

A key of the state is a bucket of some texts, known by 160-bit hashes, so a batch calls Python once a bucket. Of equal texts
within a task only the smallest id goes to the text's bucket; the others are repeats whatever follows, and are dealt evenly.
So a text that a third of all documents hold meets in no task. State lies in RocksDB, below the shared folder at each commit.

From the counters, by part and mask, follow all orders of the filters: a row for each part, order and step.

Cases: null text counts as empty (it has no words, fails A alone, and is a repeat of other empty ones); a text of any length is
read whole; a null part is an empty string; a null doc_id is larger than any other and never another's smaller id; rows that
repeat doc_id and text are all the first; several labels of a document count as one; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator
from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import configure, shared_path

FILTERS = "ABCDE"
REPEATED = 1 << FILTERS.index("E")
#: Micro-batches that a table is cut into, if it has as many files, and texts in a key of the state.
BATCHES, TEXTS_PER_KEY = 4, 64
#: Texts that a task holds at once to tell repeats among them.
TASK_TEXTS = 50_000
_UPPER, _MARKS = bytes(range(65, 91)), b"#$%&*|"
#: State stores in RocksDB; each partition has one, so space set aside for its logs ahead of use (4 MB a store) would add up.
STORES = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def failures(text: str, data: bytes) -> int:
    """The bits of the filters that a text fails by itself, from the text and its UTF-8 form."""
    words = data.split()  # at ASCII white space alone
    fails = len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * (len(data) - len(data.translate(None, _UPPER))) > 5 * len(text), len(data.translate(None, _MARKS)) < len(data)
    return sum(1 << k for k, f in enumerate(fails) if f)


def masks(docs: DataFrame, keys: int) -> DataFrame:
    """(key, text, doc_id, part, mask): documents by key of the state. Repeats that are settled within a task have no text."""

    def rows(batches) -> Iterator:
        import pyarrow as pa
        from hashlib import blake2b

        held: dict[bytes, tuple] = {}

        def out(found: list):
            columns = [[(hash((doc_id, i)) if text is None else int.from_bytes(text[:8], "little")) % keys for i, (text, doc_id, _, _) in enumerate(found)],
                *([r[k] for r in found] for k in range(4))]
            kinds = (pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "text", "doc_id", "part", "mask"])

        for batch in batches:
            found = []
            for doc_id, text, part in zip(*(batch.column(k).to_pylist() for k in range(3))):
                data = text.encode("utf-8", "surrogatepass")
                row = (blake2b(data, digest_size=20).digest(), doc_id, part, failures(text, data))
                old = held.get(row[0])
                if old is None:
                    held[row[0]] = row
                elif doc_id == old[1]:
                    found.append(row)
                elif _order(doc_id) > _order(old[1]):
                    found.append((None, doc_id, part, row[3] | REPEATED))
                else:
                    found.append((None, *old[1:3], old[3] | REPEATED))
                    held[row[0]] = row
            if len(held) > TASK_TEXTS:
                found += held.values()
                held.clear()
            if found:
                yield out(found)
        if held:
            yield out([*held.values()])

    plain = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("source").cast("string"), F.lit("")))
    return plain.mapInArrow(rows, "key int, text binary, doc_id long, part string, mask int")


def _order(doc_id: int | None) -> tuple:
    """A null id is larger than any."""
    return doc_id is None, doc_id or 0


def changes(rows: DataFrame) -> DataFrame:
    """(doc_id, part, mask, change): what each micro-batch counts (1) and takes back (-1)."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def update(key: tuple, frames: Iterator, state) -> Iterator:
        import pandas as pd

        known: dict[bytes, tuple] = pickle.loads(state.get[0]) if state.exists else {}
        found, fresh = [], False
        for pdf in frames:
            ids = [None if missing else int(i) for i, missing in zip(pdf["doc_id"], pdf["doc_id"].isna())]
            for text, doc_id, part, mask in zip(pdf["text"], ids, pdf["part"], pdf["mask"]):
                mask = int(mask)
                if text is None:
                    found.append((doc_id, part, mask, 1))
                    continue
                text = bytes(text)
                first, holders = known.get(text, (None, None))
                if holders is None or _order(doc_id) < _order(first):
                    for p, m in holders or ():
                        found += [(first, p, m, -1), (first, p, m | REPEATED, 1)]
                    known[text], fresh = (doc_id, [(part, mask)]), True
                elif doc_id == first:
                    holders.append((part, mask))
                    fresh = True
                else:
                    mask |= REPEATED
                found.append((doc_id, part, mask, 1))
        if fresh:
            state.update((pickle.dumps(known),))
        columns = [pd.Series([r[k] for r in found], dtype=t) for k, t in enumerate(("Int64", "object", "int32", "int32"))]
        yield pd.DataFrame(dict(zip(("doc_id", "part", "mask", "change"), columns)))

    return rows.groupBy("key").applyInPandasWithState(update, "doc_id long, part string, mask int, change int", "known binary", "append", GroupStateTimeout.NoTimeout)


def counters(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(part, mask, n, good, toxic): documents of the table at `path` by part and mask of failed filters, of them those labelled
    with quality 1 and toxic 1."""
    configure(spark)
    table = spark.read.parquet(path)
    files, keys = table.inputFiles(), max(16, table.count() // TEXTS_PER_KEY)  # from footers
    place = path.rstrip("/")
    if [f.rsplit("/", 1)[-1] for f in files] == [place.rsplit("/", 1)[-1]]:
        place = f"{place[:-1]}[{place[-1]}]"  # a table of one file: streams take folders or patterns
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", -(-len(files) // batches) or 1).parquet(place)
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    root = shared_path(spark, "filter-audit")

    def add(batch: DataFrame, number: int) -> None:
        labelled = batch.join(known, "doc_id", "left")
        sums = [F.sum("change").alias("n"), *(F.sum(F.col("change") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic"))]
        labelled.groupBy("part", "mask").agg(*sums).write.mode("overwrite").parquet(f"{root}/counters/batch={number}")

    before = {name: spark.conf.get(name, None) for name in STORES}
    for name, value in STORES.items():
        spark.conf.set(name, value)
    try:
        flow = changes(masks(stream, keys)).writeStream.foreachBatch(add).option("checkpointLocation", f"{root}/checkpoint")
        flow.trigger(availableNow=True).start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    kind = "part string, mask int, n long, good long, toxic long"
    written = spark.read.schema(kind + ", batch int").parquet(f"{root}/counters") if table.take(1) else spark.createDataFrame([], kind)
    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    return written.groupBy("part", "mask").agg(*sums).where("n <> 0")


def steps() -> list[dict]:
    """Every order of the filters by steps, with the bits of the filters before and of the step's own."""
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    return [{"filter_order": "".join(order), "step": k + 1, "before": sum(bit[f] for f in order[:k]), "own": bit[f]}
        for order in permutations(FILTERS) for k, f in enumerate(order)]


def report(counted: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from counters."""
    cells = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    plan = F.from_json(F.lit(json.dumps(steps())), "array<struct<filter_order:string,step:int,before:int,own:int>>")
    rows = cells.select("part", "cells", F.inline(plan))
    before, own = F.col("before"), F.col("own")

    def total(value: str, fits):
        return F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(fits(c["mask"]), c[value]).otherwise(0))

    removed = lambda m: (m.bitwiseAND(before) == 0) & (m.bitwiseAND(own) != 0)
    # Of all orders, a filter is the first of a mask's to be applied in an equal share.
    shares = F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(c["mask"].bitwiseAND(own) != 0, (c["n"] * 120 / F.bit_count(c["mask"])).cast("long")).otherwise(0))
    return rows.select("part", "filter_order", "step", total("n", lambda m: m.bitwiseAND(before + own) == 0).alias("kept"), total("n", removed).alias("removed"),
        total("n", lambda m: (m.bitwiseAND(before) != 0) & (m.bitwiseAND(own) != 0)).alias("redundant"), total("n", lambda m: m == own).alias("unique_fails"),
        total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"), shares.alias("shapley"))


def audit(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The report on the table of documents at `path`."""
    return report(counters(spark, path, labels, batches))
