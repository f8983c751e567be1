"""Helpers that the training-data operators share: shared storage, materialised tables, file systems."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Rows in an Arrow batch handed to Python; documents are wide, so batches stay small.
BATCH_ROWS = 500
#: First-level groups of sum_vectors.
SUBS = 64
#: Folders made for local applications that name none.
_local: dict[str, str] = {}
#: Paths of written tables, by application.
_written: dict[str, set[str]] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches small enough for wide text columns, and let workers import this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode a temporary one if unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or _local.get(spark.sparkContext.applicationId)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _local[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="tracewell-")
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete all tables that this application's operators have written and not deleted; call it once results are taken."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _written.pop(spark.sparkContext.applicationId, ()):
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)


def drop_materialized(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables made by materialize() once nothing lazy reads them any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for table in tables:
        for file in table.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(conf).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus folder."""
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def packed(v) -> bytes:
    """A vector of small whole numbers, compressed byte plane by byte plane."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(v.view("uint8").reshape(len(v), -1).T.tobytes())


def unpacked(data: bytes, kind: str):
    """The vector that packed() was given."""
    import numpy as np
    import zstandard

    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "uint8").reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def sum_vectors(parts: DataFrame, kind: str, small: bool = False) -> DataFrame:
    """(at, v): sums of vectors (at int, sub int, v binary of `kind`) by `at`, first by `sub` within it. Tasks take them one
    after another, so none holds more than a vector, however many meet there. `small` ones come and go packed."""

    def add(batches):
        import numpy as np
        import pyarrow as pa

        def out(at, sub, total):
            columns = [pa.array([at], pa.int32()), pa.array([sub], pa.int32()), pa.array([packed(total) if small else total.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["at", "sub", "v"])

        now, total = None, None
        for batch in batches:
            for at, sub, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                v = unpacked(v.as_py(), kind) if small else np.frombuffer(v.as_py(), kind)
                if (at, sub) == now:
                    total += v
                else:
                    if now is not None:
                        yield out(*now, total)
                    now, total = (at, sub), v.copy()
        if now is not None:
            yield out(*now, total)

    schema = "at int, sub int, v binary"
    some = parts.select("at", "sub", "v").repartition("at", "sub").sortWithinPartitions("at", "sub").mapInArrow(add, schema)
    whole = some.select("at", F.lit(0).alias("sub"), "v").repartition("at").sortWithinPartitions("at").mapInArrow(add, schema)
    return whole.select("at", "v")


class SharedBytes:
    """A byte table of fixed size as workers see it: slices (start long, data binary) in the shared folder, which each
    worker reads once."""

    _held: dict = {}

    def __init__(self, slices: DataFrame, size: int):
        self.files, self.size = tuple(slices.inputFiles()), size

    @property
    def value(self):
        import numpy as np
        import pyarrow.parquet as pq

        if self.files not in SharedBytes._held:
            table = np.zeros(self.size, "uint8")
            for file in self.files:
                fs, path = filesystem(file)
                rows = pq.read_table(path, filesystem=fs, partitioning=None)
                for start, data in zip(rows.column("start").to_pylist(), rows.column("data").to_pylist()):
                    table[start : start + len(data)] |= np.frombuffer(data, "uint8")
            SharedBytes._held.clear()
            SharedBytes._held[self.files] = table
        return SharedBytes._held[self.files]


def filesystem(uri: str):
    """The Arrow file system and path of a URI; local paths may come without a scheme."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def text_or_empty(column: str = "text"):
    """Null text counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
