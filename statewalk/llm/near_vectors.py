"""Near-duplicate vectors through hierarchical navigable small-world graphs, one per shard.

Vectors are compared only within a label. Equal vectors of a label are one node. The nodes of a label
are dealt to shards of bounded size by hash, every shard builds its graph, and every shard is asked for
the neighbours of all the label's nodes, shard against shard. A query's beam widens while it is full
of links, and all beams of a pair of shards widen until they find at least ``recall`` of the links that an
exact scan of sampled queries has, both up to ``widest``; what is left then is scanned exactly. The sample grows until ``audit`` queries with few links to others are in
it; where there are not that many, it grows to all queries, and the pair of shards is scanned exactly. Recall
is a mean over queries, once of those with few links and once of those in crowds, so neither hides the
other. Found pairs are verified by their cosine in double precision.

A task holds two shards, whatever the size of the label. It returns link counts by node and a spanning
forest of its links, not the links; Spark sums the counts and unites the forests into components.

Defined cases: vectors that are null, empty, zero or hold null or non-finite values, and vectors with
a null label, have no links and are their own component. Vectors of different length are not compared.
Repeated rows count as different vectors with equal content. Null ids take part; a component's id is its
smallest id that is not null. Empty tables give empty results. Columns beside the three are not carried along.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewalk.llm.graph import components
from statewalk.session import materialize


@dataclass(frozen=True)
class Settings:
    """cosine: least cosine of a link; shard: nodes per shard; degree: links a node keeps per layer
    (twice as many in the lowest); breadth: beam while building; beam: first beam of a query;
    widest: widest beam; queries that fill it, and pairs of shards where it finds too little, are scanned exactly
    audit: audited queries with few links (at most ``beam``, self-links aside) per pair of shards;
    recall: what a search must find of audited queries' links."""

    cosine: float = 0.98
    shard: int = 8192
    degree: int = 12
    breadth: int = 48
    beam: int = 32
    widest: int = 128
    audit: int = 300
    recall: float = 0.99


def _levels(nodes: np.ndarray) -> np.ndarray:
    """Layer of each node: one in sixteen goes one layer up, by its hash."""
    with np.errstate(over="ignore"):
        h = (nodes.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    level = np.zeros(len(nodes), int)
    for _ in range(8):
        up = (h & np.uint64(15)) == 0
        level += up
        h = np.where(up, h >> np.uint64(4), np.uint64(1))
    return level


class Graph:
    """A layered proximity graph over unit vectors (float32)."""

    def __init__(self, units: np.ndarray, settings: Settings, layers: list[np.ndarray] | None = None, entry: int = 0) -> None:
        self.units, self.settings, self.entry = units, settings, entry
        self.layers = layers or []

    @classmethod
    def build(cls, units: np.ndarray, nodes: np.ndarray, settings: Settings) -> Graph:
        level = _levels(nodes)
        n, top = len(nodes), int(level.max(initial=0))
        widths = [2 * settings.degree, *[settings.degree] * top]
        g = cls(units, settings, [np.full((n, w), -1, np.int32) for w in widths])
        order = np.argsort(-level, kind="stable")  # upper layers first, so that the entry is at the top
        g.entry = int(order[0])
        start, size = 1, 1
        while start < n:
            batch = order[start : start + size]
            g._insert(batch, level)
            start += len(batch)
            size = min(256, start)
        return g

    def _insert(self, batch: np.ndarray, level: np.ndarray) -> None:
        q = self.units[batch]
        near = np.full(len(batch), self.entry)
        inner = q @ q.T
        np.fill_diagonal(inner, -2)
        for layer in range(len(self.layers) - 1, -1, -1):
            here = level[batch] >= layer
            if not here.all():
                near[~here] = self._descend(q[~here], near[~here], layer)
            if not here.any():
                continue
            rows = np.flatnonzero(here)
            ids, sims = self._beam(q[rows], near[rows], layer, self.settings.breadth)
            near[rows] = ids[np.arange(len(rows)), sims.argmax(axis=1)]
            for r, i, s in zip(rows, ids, sims, strict=True):
                # Members of the batch see those before them, too.
                own = rows[rows < r]
                own = own[np.argsort(-inner[r, own])[: self.settings.breadth]] if len(own) else own
                c = np.concatenate([i[i >= 0], batch[own]])
                x = np.concatenate([s[i >= 0], inner[r, own]])
                width = self.settings.degree
                kept = self._spread(c, x, width)
                node = batch[r]
                self.layers[layer][node, : len(kept)] = kept
                for other in kept:
                    self._link(other, node, layer)

    def _spread(self, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """Neighbours in different directions: one that is nearer to a chosen one than to the node
        waits until the others have had their turn."""
        order = np.argsort(-sims, kind="stable")
        ids, sims = ids[order], sims[order]
        if len(ids) <= width:
            return ids
        among = self.units[ids] @ self.units[ids].T
        chosen: list[int] = []
        left: list[int] = []
        for i in range(len(ids)):
            if len(chosen) == width:
                break
            (left if chosen and among[i, chosen].max() > sims[i] else chosen).append(i)
        return ids[(chosen + left)[:width]]

    def _link(self, node: int, new: int, layer: int) -> None:
        row = self.layers[layer][node]
        free = np.flatnonzero(row < 0)
        if len(free):
            row[free[0]] = new
            return
        ids = np.append(row, new)
        row[:] = self._spread(ids, self.units[ids] @ self.units[node], len(row))

    def _descend(self, q: np.ndarray, at: np.ndarray, layer: int) -> np.ndarray:
        """Each query walks to a neighbour that is nearer, until there is none."""
        at = at.copy()
        best = np.einsum("ij,ij->i", q, self.units[at])
        active = np.arange(len(q))
        while len(active):
            near = self.layers[layer][at[active]]
            sims = np.einsum("ijk,ik->ij", self.units[near], q[active])
            sims[near < 0] = -2
            j = sims.argmax(axis=1)
            s = sims[np.arange(len(active)), j]
            better = s > best[active]
            moved = active[better]
            at[moved], best[moved] = near[better, j[better]], s[better]
            active = moved
        return at

    def _beam(self, q: np.ndarray, at: np.ndarray, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of the best nodes found from one start, by beams of ``width``; -1 pads."""
        m = len(q)
        ids = np.full((m, width), -1, np.int64)
        sims = np.full((m, width), -2.0, np.float32)
        done = np.zeros((m, width), bool)
        seen = np.zeros((m, len(self.units)), bool)
        ids[:, 0], sims[:, 0] = at, np.einsum("ij,ij->i", q, self.units[at])
        seen[np.arange(m), at] = True
        active = np.arange(m)
        while len(active):
            open_ = np.where(done[active] | (ids[active] < 0), -3, sims[active])
            j = open_.argmax(axis=1)
            going = open_[np.arange(len(active)), j] > -3
            active, j = active[going], j[going]
            if not len(active):
                break
            done[active, j] = True
            near = self.layers[layer][ids[active, j]].astype(np.int64)
            new = (near >= 0) & ~seen[active[:, None], near]
            r, c = np.nonzero(new)
            seen[active[r], near[r, c]] = True
            s = np.full(near.shape, -2, np.float32)
            s[r, c] = np.einsum("ij,ij->i", self.units[near[r, c]], q[active[r]])
            all_s = np.concatenate([sims[active], s], axis=1)
            all_i = np.concatenate([ids[active], np.where(new, near, -1)], axis=1)
            all_d = np.concatenate([done[active], np.zeros(near.shape, bool)], axis=1)
            top = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
            sims[active] = np.take_along_axis(all_s, top, 1)
            ids[active] = np.take_along_axis(all_i, top, 1)
            done[active] = np.take_along_axis(all_d, top, 1)
        return ids, sims

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.full(len(q), self.entry)
        for layer in range(len(self.layers) - 1, 0, -1):
            at = self._descend(q, at, layer)
        return self._beam(q, at, 0, width)

    def scan(self, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of all pairs with at least that cosine, exactly."""
        return np.nonzero(q @ self.units.T >= least)

    def _audit(self, q: np.ndarray, least: float, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(audited, query, node): which queries were scanned, and all their pairs."""
        order = np.random.default_rng(len(q)).permutation(len(q))
        audited = np.zeros(len(q), bool)
        found_a, found_b, few = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for i in range(0, len(q), 512):
            part = order[i : i + 512]
            a, b = self.scan(q[part], least)
            a = part[a]
            audited[part] = True
            found_a.append(a)
            found_b.append(b)
            links = np.bincount(a[a != b] if own else a, minlength=len(q))
            few += int(((links > 0) & (links <= self.settings.beam)).sum())
            if few >= self.settings.audit:
                break
        return audited, np.concatenate(found_a), np.concatenate(found_b)

    def _finds(self, a: np.ndarray, b: np.ndarray, true_a: np.ndarray, true_b: np.ndarray, m: int, own: bool) -> bool:
        """Whether the pairs found hold enough of the audited queries' true ones, self-links aside."""
        n = len(self.units)
        if own:
            true_a, true_b = true_a[true_a != true_b], true_b[true_a != true_b]
        hit = np.isin(true_a * n + true_b, a * n + b)
        links = np.bincount(true_a, minlength=m)
        share = np.bincount(true_a, weights=hit, minlength=m) / np.maximum(links, 1)
        few = (links > 0) & (links <= self.settings.beam)
        many = links > self.settings.beam
        return all(share[x].mean() >= self.settings.recall for x in (few, many) if x.any())

    def within(self, q: np.ndarray, least: float, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of the pairs found with at least that cosine. ``own``: query i is node i."""
        width = self.settings.beam
        audited, true_a, true_b = self._audit(q, least, own)
        while not self._scanned(width) and not audited.all():
            a, b = self._widening(q, least, width)
            if self._finds(a, b, true_a, true_b, len(q), own):
                rest = ~audited[a]
                return np.concatenate([a[rest], true_a]), np.concatenate([b[rest], true_b])
            width *= 2
        rest = np.flatnonzero(~audited)
        out = [(rest[i + a], b) for i in range(0, len(rest), 1024) for a, b in [self.scan(q[rest[i : i + 1024]], least)]]
        return np.concatenate([true_a, *(a for a, _ in out)]), np.concatenate([true_b, *(b for _, b in out)])

    def _scanned(self, width: int) -> bool:
        """Whether a beam of that width would cost more than the exact scan, a matrix product."""
        return width > self.settings.widest or width >= len(self.units) // 4

    def _widening(self, q: np.ndarray, least: float, width: int) -> tuple[np.ndarray, np.ndarray]:
        """One search; queries whose beam is full of links are asked again with a wider one."""
        found_a, found_b = [], []
        todo = np.arange(len(q))
        while len(todo):
            again = []
            for i in range(0, len(todo), 256):
                part = todo[i : i + 256]
                if self._scanned(width):
                    a, b = self.scan(q[part], least)
                    found_a.append(part[a])
                    found_b.append(b)
                    continue
                ids, sims = self.search(q[part], width)
                hit = (sims >= least) & (ids >= 0)
                full = hit.all(axis=1)
                a, j = np.nonzero(hit & ~full[:, None])
                found_a.append(part[a])
                found_b.append(ids[a, j])
                again.append(part[full])
            todo = np.concatenate(again) if again else np.zeros(0, int)
            width *= 2
        return np.concatenate(found_a), np.concatenate(found_b)


def _pack(nodes: np.ndarray, copies: np.ndarray, vectors: np.ndarray, graph: Graph) -> bytes:
    out = io.BytesIO()
    np.savez(out, nodes=nodes, copies=copies, vectors=vectors, entry=graph.entry, **{f"layer{i}": x for i, x in enumerate(graph.layers)})
    return out.getvalue()


def _unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def _unpack(data: bytes, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, Graph]:
    with np.load(io.BytesIO(data)) as z:
        layers = [z[f"layer{i}"] for i in range(sum(k.startswith("layer") for k in z.files))]
        unit = _unit(z["vectors"])
        return z["nodes"], z["copies"], unit, Graph(unit.astype(np.float32), settings, layers, int(z["entry"]))


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            kept.append((x, y))
    return kept


def near_duplicates(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", settings: Settings = Settings()
) -> DataFrame:
    """(key, n_links, component, kept): one row per row of ``df``."""
    v = F.col("vector")
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("vector"), F.col(f"`{label}`").alias("label"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col("label").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    node = F.when(F.coalesce(usable, F.lit(False)), F.xxhash64("label", F.transform(v, lambda x: x + 0.0)))
    rows = rows.withColumn("node", node)
    nodes = materialize(
        rows.where("node IS NOT NULL").groupBy("node").agg(
            F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("key").alias("key")
        ).withColumn("width", F.size("vector")),
        "nodes",
    )
    counts = nodes.groupBy("label", "width").agg(F.ceil(F.count("*") / settings.shard).cast("int").alias("shards"))
    dealt = nodes.join(counts, ["label", "width"]).withColumn("shard", F.pmod(F.xxhash64("node", F.lit("shard")), F.col("shards")).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
        ids = pdf["node"].to_numpy()
        graph = Graph.build(_unit(vectors).astype(np.float32), ids, settings)
        data = _pack(ids, pdf["copies"].to_numpy(), vectors, graph)
        return pd.DataFrame({"place": [f"{pdf['label'].iloc[0]}|{pdf['width'].iloc[0]}"], "shard": pdf["shard"].iloc[:1].to_numpy(),
                             "shards": pdf["shards"].iloc[:1].to_numpy(), "data": [data]})

    graphs = dealt.groupBy("label", "width", "shard").applyInPandas(build, "place string, shard int, shards int, data binary")
    graphs = materialize(graphs, "graphs")
    # Every pair of a label's shards, itself included, as (first, second); the first one's graph is asked.
    other = F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("other")
    sides = graphs.select("place", "shard", "data", other).select(
        "place", F.least("shard", "other").alias("first"), F.greatest("shard", "other").alias("second"), "shard", "data"
    )

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        least = settings.cosine
        sides = {int(s): _unpack(d, settings) for s, d in zip(pdf["shard"], pdf["data"], strict=True)}
        nodes, copies, unit, graph = sides[min(sides)]
        nodes_b, copies_b, unit_b, _ = sides[max(sides)]
        b, a = graph.within(unit_b.astype(np.float32), least - 1e-5, len(sides) == 1)
        if len(sides) == 1:
            # Found from either end counts for both; a pair is one number, which sorts fast.
            pairs = np.unique((np.minimum(a, b).astype(np.int64) * len(unit) + np.maximum(a, b))[a != b])
            a, b = pairs // len(unit), pairs % len(unit)
        exact = np.concatenate([
            np.einsum("ij,ij->i", unit[a[i : i + 65536]], unit_b[b[i : i + 65536]]) for i in range(0, len(a), 65536)
        ]) if len(a) else np.zeros(0)
        a, b = a[exact >= least], b[exact >= least]
        links = pd.concat([
            pd.DataFrame({"a": nodes, "b": np.bincount(a, weights=copies_b[b], minlength=len(nodes)).astype(np.int64)}),
            pd.DataFrame({"a": nodes_b, "b": np.bincount(b, weights=copies[a], minlength=len(nodes_b)).astype(np.int64)}),
        ])
        links = links[links["b"] > 0].assign(edge=False)
        edges = pd.DataFrame(_forest(nodes[a], nodes_b[b]), columns=["a", "b"]).astype("int64").assign(edge=True)
        return pd.concat([links, edges])

    found = materialize(sides.groupBy("place", "first", "second").applyInPandas(ask, "a long, b long, edge boolean"), "found")
    links = found.where("NOT edge").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    joined = components(found.where("edge").select("a", "b"))
    owner = nodes.select("node", "key", "copies").join(links, "node", "left").join(joined, "node", "left").select(
        "node", "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "node").alias("class")
    )
    smallest = owner.groupBy("class").agg(F.min("key").alias("component"))
    owner = materialize(owner.join(smallest, "class").select("node", "links", "component"), "owners")
    out = rows.select("key", "node").join(owner, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component"))
    return out.select("key", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component")).withColumn(
        "kept", F.col("key").eqNullSafe(F.col("component"))
    )
