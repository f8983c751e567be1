"""A sparse matrix takes rows of a few bytes for its pairs, whatever the number of tests."""

from pyspark.sql import functions as F

from tests.rows import most_rows
from tracewell.operators import matrix


def test_bitmaps_are_no_larger_than_pairs(spark):
    tests = spark.range(200_000).select(F.format_string("t%06d", "id").alias("test"), "id")
    pairs = tests.select(F.concat(F.lit("m"), (F.col("id") % 97).cast("string")).alias("method"), "test")
    numbers = matrix.test_numbers(pairs)
    bits = matrix.bitmaps(pairs, numbers)
    assert bits.schema["bits"].dataType.simpleString() == "bigint" and bits.count() <= 200_000
    sides = [matrix.bitmap_of(tests.where(F.col("id") % 3 == k).select("test"), numbers) for k in (0, 1)]
    found = matrix.red_green(bits, *sides)
    got = {r["method"]: (r["ef"], r["ep"]) for r in found.collect()}
    assert got == {f"m{k}": tuple(sum(i % 3 == side for i in range(k, 200_000, 97)) for side in (0, 1)) for k in range(97)}
    assert most_rows(found) <= 200_000
