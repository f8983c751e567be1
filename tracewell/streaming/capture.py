"""Streams of what probes write: the coverage matrix, captured values under caps, and feedback between iterations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.impact import iteration_diff


def matrix_stream(spark: SparkSession, folder: str, attribution: str = "outer") -> DataFrame:
    """Distinct (method, test) from files that appear in a folder."""
    rows = spark.readStream.schema("method string, test string, kind string").option("sep", "\t").option("quote", "").csv(folder)
    rows = rows.where("kind = 'outer'") if attribution == "outer" else rows
    return rows.select("method", "test").dropDuplicates(["method", "test"])


def recent_matrix(rows: DataFrame, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The same with event time, so that state older than the watermark goes."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(["method", "test"])


def capped_values(rows: DataFrame, most: int = 6, most_throws: int = 2) -> DataFrame:
    """The first few captured calls of each method and test, returns and throws under caps of their own, across batches; rows
    (method, test, args, result, throws, ord) of a batch go in order of ord."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def cap(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        returns, throws = state.get if state.exists else (0, 0)
        whole = pd.concat(list(batches)).sort_values("ord", kind="stable")
        for pdf in [whole]:
            thrown = pdf["throws"].astype(bool)
            keep = ((~thrown).cumsum() + returns <= most) & ~thrown | (thrown.cumsum() + throws <= most_throws) & thrown
            returns, throws = min(most, returns + int((~thrown).sum())), min(most_throws, throws + int(thrown.sum()))
            yield pdf[keep][["method", "test", "args", "result", "throws"]].astype(object)
        state.update((returns, throws))

    schema = "method string, test string, args string, result string, throws boolean"
    return rows.groupBy("method", "test").applyInPandasWithState(cap, schema, "returns int, throws int", "append", GroupStateTimeout.NoTimeout)


def call_rates(rows: DataFrame, time: str = "ts", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Calls of each method by window of event time."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width), "method").agg(F.count("*").alias("calls"))


def feedback(results: DataFrame, table: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Each batch of failing tests (test) compared with the one before, which is kept as Parquet below `table`; a batch that is
    run again finds the same predecessor."""

    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        df.select("test").distinct().write.mode("overwrite").parquet(f"{table}/epoch={epoch}")
        now = spark.read.schema("test string").parquet(f"{table}/epoch={epoch}")
        before = spark.read.schema("test string").parquet(f"{table}/epoch={epoch - 1}") if epoch else spark.createDataFrame([], "test string")
        sink(iteration_diff(before, now), epoch)

    return results.writeStream.foreachBatch(batch).option("checkpointLocation", f"{table}/_checkpoint").start()
