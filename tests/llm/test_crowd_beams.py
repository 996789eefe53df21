"""Queries in a large crowd of near copies: bounded beams, then the exact scan."""

import numpy as np

from statewalk.llm import near_vectors


def test_beams_end_at_the_widest(monkeypatch):
    rng = np.random.default_rng(5)
    loose = rng.normal(size=(3000, 16))
    crowd = rng.normal(size=16) + 0.01 * rng.normal(size=(1000, 16))
    units = near_vectors._unit(np.concatenate([loose, crowd])).astype(np.float32)
    units = units[rng.permutation(len(units))]
    settings = near_vectors.Settings(degree=4, breadth=16, audit=1)
    graph = near_vectors.Graph.build(units, np.arange(len(units)), settings)
    widths = []
    beam = near_vectors.Graph._beam

    def watched(self, q, at, layer, width):
        widths.append(width)
        return beam(self, q, at, layer, width)

    monkeypatch.setattr(near_vectors.Graph, "_beam", watched)
    a, b = graph._widening(units, 0.98, settings.beam)
    assert widths and max(widths) <= 128
    true = {(i, j) for i, j in zip(*np.nonzero(units @ units.T >= 0.98), strict=True)}
    assert len(true & set(zip(a.tolist(), b.tolist(), strict=True))) >= 0.99 * len(true)
