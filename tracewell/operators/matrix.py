"""The coverage matrix as bitmaps: tests by dense numbers, a method's tests as words of 64 bits.

A method has a row for each word of which it has a bit, so a sparse matrix takes no more rows than it has pairs and a dense one a
64th of them; tests of a kind are a row for each word. How many tests of a kind run a method is the number of bits that both have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import numbered

#: A test's number, shifted by so many bits, is its word; the rest is its place there.
WORD_BITS = 6


def test_numbers(tests: DataFrame) -> DataFrame:
    """(test, number): distinct tests by dense numbers from 1, in order."""
    return numbered(tests.select("test").distinct(), ["test"], "number")


def _words(at: DataFrame, *keys: str) -> DataFrame:
    """(keys, word, bits) of rows with a number."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("number").bitwiseAND(F.lit((1 << WORD_BITS) - 1)).cast("int"))
    return at.groupBy(*keys, F.shiftright("number", WORD_BITS).alias("word")).agg(F.bit_or(bit).alias("bits"))


def bitmaps(pairs: DataFrame, numbers: DataFrame) -> DataFrame:
    """(method, word, bits) of (method, test); a pair counts once however often it occurs."""
    return _words(pairs.join(numbers, "test").select("method", "number"), "method")


def bitmap_of(tests: DataFrame, numbers: DataFrame) -> DataFrame:
    """(word, bits) of a set of tests."""
    return _words(tests.select("test").join(numbers, "test"))


def sizes(matrix: DataFrame) -> DataFrame:
    """(method, tests): how many tests run each method."""
    return matrix.groupBy("method").agg(F.sum(F.bit_count("bits")).alias("tests"))


def red_green(matrix: DataFrame, red: DataFrame, green: DataFrame) -> DataFrame:
    """(method, ef, ep): how many tests of two sets (word, bits) run each method, in one pass over the matrix."""
    sides = red.withColumnRenamed("bits", "ef").join(green.withColumnRenamed("bits", "ep"), "word", "full")
    both = lambda c: F.coalesce(F.sum(F.bit_count(F.col("bits").bitwiseAND(F.col(c)))), F.lit(0).cast("long")).alias(c)
    return matrix.join(sides, "word", "left").groupBy("method").agg(both("ef"), both("ep"))
