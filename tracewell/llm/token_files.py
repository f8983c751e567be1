"""Token files: equal-length id sequences and masks as fixed-size lists in Arrow's random-access file format.

Documents are dealt out by ranges of doc_id, so the files in order hold all documents in ascending order. Each file has
record batches of `rows` sequences of `length` ids (unsigned 16-bit if the vocabulary allows) and masks of as many booleans,
which Arrow keeps as bits, true for real ids; only the last sequence of a file is padded. A second file gives each document's
place. Readers map the file and take any sequence with its mask, or any document, as views, without decoding or copying others.

Ranges end inside a doc_id too, by the place of a row in the input, so rows without one, or with the same one, spread over
as many files as they need.

Cases: null text is empty and is written as the end id alone; a text of any length is one document, held once while it is
encoded; null doc_ids come first; rows with one doc_id follow each other in the order of the input; an empty table gives no
files and an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import configure, filesystem, materialize, shared_path, text_or_empty

MANIFEST = "part int, path string, documents long, tokens long"


class ShardWriter:
    """Writes one shard; holds no more than a batch of sequences, plus one document."""

    def __init__(self, uri: str, length: int, rows: int, wide: bool):
        import numpy as np
        import pyarrow as pa

        self.fs, self.path = filesystem(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.length, self.rows, self.kind = length, rows, np.dtype("<u4" if wide else "<u2")
        ids = pa.list_(pa.uint32() if wide else pa.uint16(), length)
        self.schema = pa.schema([("ids", ids), ("mask", pa.list_(pa.bool_(), length))])
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.out = self.fs.open_output_stream(self.path)
        self.writer = pa.ipc.new_file(self.out, self.schema)
        self.index_out = self.fs.open_output_stream(self.path + ".index")
        self.index = pa.ipc.new_file(self.index_out, self.index_schema)
        self.held: list = []
        self.n_held = self.tokens = self.documents = 0
        self.places: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        import numpy as np

        own = np.frombuffer(ids, "<u4")
        self.places.append((doc_id, self.tokens, len(own)))
        self.held.append(own.astype(self.kind))
        self.n_held += len(own)
        self.tokens += len(own)
        self.documents += 1
        if self.n_held >= self.length * self.rows:
            self._flush(False)
        if len(self.places) >= 10_000:
            self._flush_places()

    def _flush(self, last: bool) -> None:
        import numpy as np
        import pyarrow as pa

        flat = np.concatenate(self.held) if self.held else np.zeros(0, self.kind)
        size = self.length * self.rows  # all batches but the last are of one size, so readers can find a place by division
        whole = len(flat) if last else len(flat) // size * size
        rest, flat = flat[whole:], flat[:whole]
        for at in range(0, len(flat), size):
            own = flat[at : at + size]
            n = -(-len(own) // self.length)
            padded = np.zeros(n * self.length, self.kind)
            padded[: len(own)] = own
            mask = np.arange(n * self.length) < len(own)
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (padded, mask)]
            self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.held, self.n_held = [rest], len(rest)

    def _flush_places(self) -> None:
        import pyarrow as pa

        columns = list(zip(*self.places)) or [[], [], []]
        self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=self.index_schema))
        self.places = []

    def close(self) -> None:
        self._flush(True)
        self._flush_places()
        for x in (self.writer, self.out, self.index, self.index_out):
            x.close()


class ShardReader:
    """Random access to a shard; sequences and documents come as views where the file is mapped."""

    def __init__(self, uri: str):
        import pyarrow as pa

        fs, path = filesystem(uri)
        local = type(fs).__name__ == "LocalFileSystem"
        self.file = pa.ipc.open_file(pa.memory_map(path) if local else fs.open_input_file(path))
        self.index = pa.ipc.open_file(pa.memory_map(path + ".index") if local else fs.open_input_file(path + ".index"))
        self.length = self.file.schema.field("ids").type.list_size
        self.batches = self.file.num_record_batches
        self.rows = self.file.get_batch(0).num_rows if self.batches else 0

    def batch(self, k: int):
        """(ids, mask) of a batch as views: ids with a row for each sequence, mask as one Arrow array of booleans."""
        ids, mask = self.file.get_batch(k).columns
        return ids.flatten().to_numpy(zero_copy_only=True).reshape(-1, self.length), mask.flatten()

    def schema_of_mask(self) -> str:
        """How masks are kept."""
        return str(self.file.schema.field("mask").type)

    def sequence(self, k: int):
        """The k-th sequence and its mask, which stays in Arrow's bits."""
        ids, mask = self.batch(k // self.rows)
        return ids[k % self.rows], mask.slice(k % self.rows * self.length, self.length)

    def tokens(self, start: int, n: int):
        """Ids start to start + n of the shard; their mask must call all of them real."""
        import numpy as np

        size, out = self.rows * self.length, []
        while n > 0:
            ids, mask = self.batch(start // size)
            at = start % size
            own = ids.reshape(-1)[at : at + n]
            if not len(own) or mask.slice(at, len(own)).true_count < len(own):
                raise ValueError(f"ids {start} to {start + n} are not all in the file")
            out.append(own)
            start, n = start + len(own), n - len(own)
        return out[0] if len(out) == 1 else np.concatenate(out or [np.zeros(0, "<u2")])


def write(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = 1024, rows: int = 256, folder: str | None = None) -> DataFrame:
    """Encode and write documents; the manifest has a row for each file. A repeated or lost task writes under another
    name, and only names in the manifest count."""
    spark = configure(docs.sparkSession)
    folder = folder or shared_path(spark, "token-files")

    def shard(batches) -> Iterator:
        import uuid

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from .tokens import ChunkEncoder

        encoder, part, writer = ChunkEncoder.of(tokenizer), TaskContext.get().partitionId(), None
        end, uri = np.array([end_id], "<u4").tobytes(), f"{folder}/shard-{part:06d}-{uuid.uuid4().hex}.arrow"
        wide = encoder.tokenizer.get_vocab_size() > 65_536 or end_id > 65_535
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                writer = writer or ShardWriter(uri, length, rows, wide)
                writer.add(doc_id, encoder.encode(text.as_py()) + end)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": uri, "documents": writer.documents, "tokens": writer.tokens}],
                schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())]))

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.monotonically_increasing_id().alias("at"))
    parts = max(1, plain.rdd.getNumPartitions())
    ordered = plain.repartitionByRange(parts, "doc_id", "at").sortWithinPartitions("doc_id", "at")
    return materialize(ordered.select("doc_id", "text").mapInArrow(shard, MANIFEST), "token-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Every document from the files: doc_id, start (ids of all documents before it), ids."""
    starts = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def documents(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                reader = ShardReader(row["path"])
                for k in range(reader.index.num_record_batches):
                    places = reader.index.get_batch(k)
                    for at in range(0, places.num_rows, 200):
                        some = places.slice(at, 200)
                        ids = [reader.tokens(s, n) for s, n in zip(some.column(1).to_pylist(), some.column(2).to_pylist())]
                        yield pa.RecordBatch.from_arrays([some.column(0), pa.compute.add(some.column(1), row["base"]),
                            pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], names=["doc_id", "start", "ids"])

    n = max(1, min(manifest.count(), 100_000))
    return starts.repartitionByRange(n, "part").mapInArrow(documents, "doc_id long, start long, ids binary")
