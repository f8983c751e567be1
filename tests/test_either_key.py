"""A match on either key takes no more rows than there are on both sides, however often a value occurs."""

import random

from tests.rows import most_rows
from tracewell.operators import ranking


def test_hot_values_make_no_pairs(spark):
    rng = random.Random(12)
    left = [(i, rng.choice([1, 1, 2, None])) for i in range(600)]
    right = [(2 * i if i % 9 else None, rng.choice([1, 1, 1, 2, None]), i) for i in range(700)]
    l, r = spark.createDataFrame(left, "a long, b int"), spark.createDataFrame(right, "c long, d int, e long")
    found = ranking.or_join(l, r, ("a", "c"), ("b", "d"), ["a"], ["c", "e"])
    order = lambda x: (x[0] is not None, x[0] or 0, x[2])
    want = set()
    for a, b in left:
        for same in ([x for x in right if x[0] == a], [x for x in right if b is not None and x[1] == b]):
            if same:
                want.add((a, b, *min(same, key=order)))
                break
    assert {tuple(x) for x in found.collect()} == want and len(want) > 400
    assert most_rows(found) <= 1300
