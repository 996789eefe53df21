"""Small numeric helpers for one network. A network has p nodes (the signals), so a group here is
at most p^2 numbers; the data size never enters."""

from __future__ import annotations

import numpy as np


def adjacency(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, empty: float) -> np.ndarray:
    a = np.full((n, n), empty)
    a[i, j] = w
    a[j, i] = w
    return a


def all_distances(length: np.ndarray) -> np.ndarray:
    """Floyd-Warshall on a length matrix (inf = no edge)."""
    d = length.copy()
    np.fill_diagonal(d, 0.0)
    for m in range(len(d)):
        np.minimum(d, d[:, m, None] + d[None, m, :], out=d)
    return d


def betweenness(length: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
    """Normalised shortest-path betweenness; paths of equal length share their weight."""
    n = len(length)
    d = all_distances(length)
    edge = np.isfinite(length) & ~np.eye(n, dtype=bool)
    total = np.zeros(n)
    for s in range(n):
        reach = [v for v in np.argsort(d[s], kind="stable") if np.isfinite(d[s, v])]
        gap = np.abs(d[s][:, None] + length - d[s][None, :])
        parent = edge & (gap <= tolerance * np.maximum(1.0, d[s])[None, :])
        paths = np.zeros(n)
        paths[s] = 1.0
        for v in reach:
            if v != s:
                paths[v] = paths[parent[:, v]].sum()
        share = np.zeros(n)
        for v in reversed(reach):
            if v == s:
                continue
            up = np.flatnonzero(parent[:, v])
            share[up] += paths[up] / paths[v] * (1.0 + share[v])
        share[s] = 0.0
        total += share
    return total / ((n - 1) * (n - 2)) if n > 2 else np.full(n, np.nan)


def modularity(a: np.ndarray, member: np.ndarray) -> float:
    twice = a.sum()
    strength = a.sum(axis=1)
    same = member[:, None] == member[None, :]
    return float(((a - np.outer(strength, strength) / twice) * same).sum() / twice)


def louvain(a: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Greedy modularity communities (local moves, then aggregation), numbered 1.. by first node."""
    twice = a.sum()
    member = np.arange(len(a))
    graph = a.copy()
    while True:
        n = len(graph)
        label = np.arange(n)
        strength = graph.sum(axis=1)
        weight_in = strength.copy()
        moving, moved_any = True, False
        while moving:
            moving = False
            for v in rng.permutation(n):
                own = label[v]
                weight_in[own] -= strength[v]
                links = np.bincount(label, weights=graph[v], minlength=n)
                links[own] -= graph[v, v]
                gain = links - strength[v] * weight_in / twice
                best = int(np.argmax(gain))
                if gain[best] <= gain[own] + 1e-12:
                    best = own
                weight_in[best] += strength[v]
                if best != own:
                    label[v] = best
                    moving = moved_any = True
        _, label = np.unique(label, return_inverse=True)
        member = label[member]
        if not moved_any or label.max() + 1 == n:
            break
        hot = np.eye(label.max() + 1)[label]
        graph = hot.T @ graph @ hot
    first = {}
    return np.array([first.setdefault(c, len(first) + 1) for c in member])
