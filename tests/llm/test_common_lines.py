"""A common line does not make candidates of texts that are otherwise different, and no link is lost by that."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from statewalk.llm import set_join


def _words(rng, n):
    return " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))


@pytest.mark.parametrize(("n", "percent"), [(5, 80), (3, 90)])
def test_common_lines_join_no_crowd(spark, n, percent):
    rng, join = random.Random(n), set_join.SetJoin(n, percent)
    line = _words(rng, 40)
    rows = [(i, f"{_words(rng, 60)} {line} {_words(rng, 60)}") for i in range(600)]
    rows += [(1000 + i, rows[i][1] + " " + _words(rng, 3)) for i in range(0, 600, 10)]
    docs = spark.createDataFrame(rows, "key long, text string")
    described = set_join.materialize(set_join.describe(docs, join), "described")
    classes = set_join._candidates(described).groupBy("component").count()
    assert classes.agg(F.max("count")).first()[0] <= 4 and classes.count() >= 60
    out = set_join.link_classes(docs, "key", join=join).where("key >= 1000").collect()
    assert len(out) == 60 and all(r["component"] == r["key"] - 1000 for r in out)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_linked_sets_share_more_than_their_surplus(n, percent):
    join, rng = set_join.SetJoin(n, percent), np.random.default_rng(percent + 1)
    seen = 0
    for _ in range(400):
        base = rng.integers(0, 1 << 62, rng.integers(2, 300)).astype(np.uint64)
        gone = rng.integers(0, max(1, len(base) * (100 - percent) // 100) + 1)
        other = np.concatenate([base[gone:], rng.integers(0, 1 << 62, rng.integers(0, gone + 1)).astype(np.uint64)])
        a, b = np.unique(base), np.unique(other)
        shared = len(np.intersect1d(a, b))
        if len(a) == len(b) == shared or not shared or 100 * shared < percent * (len(a) + len(b) - shared):
            continue
        (x, more), (y, most) = set_join.bucketed(a, join), set_join.bucketed(b, join)
        both, kinds = np.intersect1d(x, y), dict(most)
        mask = np.uint64((1 << set_join.CLASS_BITS) - 1)
        met = [(int((both & mask == c).sum()), max(k, kinds[c])) for c, k in more if c in kinds]
        seen += 1
        assert any(n and n > k for n, k in met)
    assert seen > 100
