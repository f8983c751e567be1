"""Components of edge tables: how much is written, and in how many files."""

import pytest

from tracewell.llm import components as module


@pytest.fixture
def written(spark, monkeypatch):
    """Files of each table that the search writes, with as many shuffle partitions as asked for."""
    files, write = [], module.materialize

    def watched(df, name):
        found = write(df, name)
        files.append(len(found.inputFiles()))
        return found

    monkeypatch.setattr(module, "materialize", watched)
    names = {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield files
    for k, v in before.items():
        spark.conf.set(k, v)


def test_stars_are_written_once(spark, written):
    pairs = [(i, i % 10) for i in range(10, 300)]
    got = {r["node"]: r["component"] for r in module.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: i % 10 for i in range(300)} and len(written) == 1


def test_small_tables_take_few_files(spark, written):
    pairs = [(i, i + 1) for i in range(40) if i % 10 != 9]
    got = {r["node"]: r["component"] for r in module.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: i // 10 * 10 for i in range(40)} and max(written[1:]) <= module.FILES


def test_nothing(spark):
    assert module.components(spark.createDataFrame([(5, 5)], "a long, b long")).count() == 0
