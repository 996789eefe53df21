"""Candidates of the set join: linked sets agree on a signature, and a crowd's rows grow with its nodes."""

import random

import numpy as np
import pytest

from statewalk.llm import set_join


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_linked_sets_share_a_signature(n, percent):
    join, rng = set_join.SetJoin(n, percent), np.random.default_rng(percent)
    seen = 0
    for _ in range(400):
        base = rng.integers(0, 1 << 62, rng.integers(2, 300)).astype(np.uint64)
        gone = rng.integers(0, max(1, len(base) * (100 - percent) // 100) + 1)
        other = np.concatenate([base[gone:], rng.integers(0, 1 << 62, rng.integers(0, gone + 1)).astype(np.uint64)])
        a, b = np.unique(base), np.unique(other)
        shared = len(np.intersect1d(a, b))
        if len(a) == len(b) == shared or not shared or 100 * shared < percent * (len(a) + len(b) - shared):
            continue
        seen += 1
        assert len(np.intersect1d(set_join.signatures(a, join), set_join.signatures(b, join)))
    assert seen > 100


def test_rows_of_a_crowd_grow_with_its_nodes(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(900):
        words = list(base)
        for k in range(rng.randint(1, 2)):
            words[rng.randrange(60)] = f"own{i}x{k}"
        rows.append((i, " ".join(words)))
    met, plain = [], set_join.materialize

    def watched(df, name):
        out = plain(df, name)
        if name in ("met", "qualified"):
            met.append(out.count())
        return out

    monkeypatch.setattr(set_join, "materialize", watched)
    out = set_join.link_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.count() == 900 and sum(met) <= 4 * 900
