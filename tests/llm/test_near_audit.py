"""Links of sparse pairs across full shards, beside a dense crowd."""

import numpy as np
from pyspark.sql import functions as F

from statewalk.llm import near_vectors


def vectors():
    rng = np.random.default_rng(7)
    crowd = rng.normal(size=24) + rng.normal(size=(700, 24)) * 0.02
    base = rng.normal(size=(700, 24))
    return np.concatenate([crowd, base, base + rng.normal(size=base.shape) * 0.05])


def test_sparse_links_across_shards_are_found(spark):
    all_ = vectors()
    df = spark.createDataFrame([(i, [float(x) for x in v], 1) for i, v in enumerate(all_)], "vec_id long, embedding array<double>, label int")
    settings = near_vectors.Settings(shard=512, degree=3, breadth=4, beam=4)
    got = {r["key"]: r for r in near_vectors.near_duplicates(df, settings=settings).collect()}
    unit = near_vectors._unit(all_)
    want = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    assert (want[700:] == 1).mean() > 0.9 and want[:700].min() > 400
    links = np.array([got[i]["n_links"] for i in range(len(all_))])
    assert (links <= want).all()
    assert (links[700:] >= want[700:]).mean() >= 0.99
    assert (links[:700] / want[:700]).mean() >= 0.99


def test_no_evidence_means_an_exact_scan(monkeypatch):
    rng = np.random.default_rng(3)
    unit = near_vectors._unit(rng.normal(size=(2048, 16))).astype(np.float32)
    graph = near_vectors.Graph.build(unit[:1024], np.arange(1024), near_vectors.Settings(degree=3, breadth=4))
    q = unit[1024:].copy()
    q[1000] = unit[17]  # the only link
    monkeypatch.setattr(near_vectors.Graph, "_widening", lambda *_: (np.zeros(0, int), np.zeros(0, int)))
    a, b = graph.within(q, 0.98)
    assert (1000, 17) in set(zip(a.tolist(), b.tolist(), strict=True))
