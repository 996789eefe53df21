"""Topology of state networks from edge tables (state, i, j, w) with i < j and w > 0."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statewalk import config
from statewalk.functions.stats import rescale
from statewalk.operators import graph_kernels as kernels
from statewalk.operators.matrices import symmetrize


def nodes_of(matrix: DataFrame) -> DataFrame:
    return matrix.select("state", F.explode(F.array("i", "j")).alias("node")).distinct()


def positive_edges(matrix: DataFrame, value: str = "r") -> DataFrame:
    """Non-negative network: negative entries and the diagonal drop out."""
    return (
        symmetrize(matrix, value).filter((F.col("i") < F.col("j")) & (F.col(value) > 0))
        .select("state", "i", "j", F.col(value).alias("w"))
    )


def _both_ways(edges: DataFrame) -> DataFrame:
    ends = F.array(
        F.struct(F.col("i").alias("node"), F.col("j").alias("other")),
        F.struct(F.col("j").alias("node"), F.col("i").alias("other")),
    )
    return edges.select("state", "w", F.explode(ends).alias("e")).select("state", "e.*", "w")


def node_degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Degree and strength of every node, zeros included."""
    sums = _both_ways(edges).groupBy("state", "node").agg(
        F.count(F.lit(1)).alias("degree"), F.sum("w").alias("strength")
    )
    return nodes.join(sums, ["state", "node"], "left").select(
        "state", "node", F.coalesce("degree", F.lit(0)).alias("degree"),
        F.coalesce("strength", F.lit(0.0)).alias("strength"),
    )


def network_summary(degrees: DataFrame) -> DataFrame:
    """Edge count, density, mean degree, cost and mean strength per state."""
    p = F.col("p")
    return degrees.groupBy("state").agg(
        F.count(F.lit(1)).alias("p"), (F.sum("degree") / 2).cast("bigint").alias("positive_edges"),
        F.avg("degree").alias("mean_degree"), F.avg("strength").alias("mean_strength"),
    ).select(
        "state", "positive_edges",
        (F.col("positive_edges") * 2 / F.when(p > 1, p * (p - 1))).alias("density"),
        "mean_degree", (F.col("mean_degree") / F.when(p > 1, p - 1)).alias("cost"),
        "mean_strength",
    )


def shortest_paths(edges: DataFrame, keys: Sequence[str] = ("state",)) -> DataFrame:
    """Distances (length 1 / w) between i < j that are connected, one network per ``keys``."""
    keys = list(keys)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, flat = np.unique(pdf[["i", "j"]].to_numpy(), return_inverse=True)
        at = flat.reshape(-1, 2)
        length = kernels.adjacency(
            len(ids), at[:, 0], at[:, 1], 1.0 / pdf["w"].to_numpy(), np.inf
        )
        d = kernels.all_distances(length)
        a, b = np.triu_indices(len(ids), 1)
        ok = np.isfinite(d[a, b])
        out = {k: np.repeat(pdf[k].iloc[0], ok.sum()) for k in keys}
        return pd.DataFrame({**out, "i": ids[a[ok]], "j": ids[b[ok]], "distance": d[a, b][ok]})

    schema = "".join(f"{k} int, " for k in keys) + "i int, j int, distance double"
    return edges.select(*keys, "i", "j", "w").groupBy(*keys).applyInPandas(solve, schema)


def path_metrics(distances: DataFrame, nodes: DataFrame) -> DataFrame:
    """Global efficiency (unreachable pairs add 0) and mean finite path length per state."""
    n = F.col("n")
    size = nodes.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    sums = distances.groupBy("state").agg(
        F.sum(1.0 / F.when(F.col("distance") > 0, F.col("distance"))).alias("inverse"),
        F.avg("distance").alias("average_path_length"),
    )
    return size.join(sums, "state", "left").select(
        "state",
        (2 * F.coalesce("inverse", F.lit(0.0)) / F.when(n > 1, n * (n - 1)))
        .alias("global_efficiency"),
        "average_path_length",
    )


def _closed_pairs(edges: DataFrame) -> DataFrame:
    """(state, node, i, j, w, w_i, w_j): edges i-j whose ends are both neighbours of ``node``.
    Bounded by p^3 per state."""
    ways = _both_ways(edges)
    first = ways.select("state", "node", F.col("other").alias("i"), F.col("w").alias("w_i"))
    second = ways.select("state", "node", F.col("other").alias("j"), F.col("w").alias("w_j"))
    return first.join(edges, ["state", "i"]).join(second, ["state", "node", "j"])


def local_efficiency(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per node: efficiency of the network among its neighbours, weights raised to 1/3; NULL with
    fewer than two neighbours, 0 when the neighbours are not linked."""
    inner = _closed_pairs(edges).select(
        "state", "node", "i", "j", F.pow("w", F.lit(1.0 / 3.0)).alias("w")
    )
    sums = shortest_paths(inner, ["state", "node"]).groupBy("state", "node").agg(
        F.sum(1.0 / F.when(F.col("distance") > 0, F.col("distance"))).alias("inverse")
    )
    k = F.col("degree")
    big = F.count(F.lit(1)).over(Window.partitionBy("state")) >= 3
    return node_degrees(edges, nodes).join(sums, ["state", "node"], "left").select(
        "state", "node",
        F.when(
            big, 2 * F.coalesce("inverse", F.lit(0.0)) / F.when(k > 1, k * (k - 1))
        ).alias("local_efficiency"),
    )


def weighted_clustering(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Barrat clustering per node: closed pairs weighted by the node's two edges; 0 for nodes with
    fewer than two neighbours."""
    closed = _closed_pairs(edges).groupBy("state", "node").agg(
        F.sum(F.col("w_i") + F.col("w_j")).alias("closed")
    )
    usable = F.col("degree") > 1
    ratio = F.coalesce("closed", F.lit(0.0)) / F.when(
        usable, F.col("strength") * (F.col("degree") - 1)
    )
    return node_degrees(edges, nodes).join(closed, ["state", "node"], "left").select(
        "state", "node", "degree", "strength",
        F.coalesce(ratio, F.lit(0.0)).alias("weighted_clustering"),
    )


def _per_state(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges plus the node count, so that kernels see isolated nodes too."""
    size = nodes.groupBy("state").agg(F.max("node").alias("p"))
    return edges.join(F.broadcast(size), "state")


def _matrix(pdf: pd.DataFrame, empty: float, transform=lambda w: w) -> np.ndarray:
    return kernels.adjacency(
        int(pdf["p"].iloc[0]), pdf["i"].to_numpy() - 1, pdf["j"].to_numpy() - 1,
        transform(pdf["w"].to_numpy()), empty,
    )


def node_betweenness(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Normalised weighted betweenness (length 1 / w) per node."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        b = kernels.betweenness(_matrix(pdf, np.inf, lambda w: 1.0 / w))
        return pd.DataFrame(
            {"state": pdf["state"].iloc[0], "node": np.arange(1, len(b) + 1), "betweenness": b}
        )

    found = _per_state(edges, nodes).groupBy("state").applyInPandas(
        solve, "state int, node int, betweenness double"
    )
    return nodes.join(found, ["state", "node"], "left")


def louvain_memberships(
    edges: DataFrame,
    nodes: DataFrame,
    repetitions: int = config.LOUVAIN_REPETITIONS,
    seed: int = config.COMMUNITY_SEED,
) -> DataFrame:
    """(state, rep, node, community): independent runs, one task unit per state and repetition."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        state, rep = int(pdf["state"].iloc[0]), int(pdf["rep"].iloc[0])
        rng = np.random.Generator(np.random.PCG64([seed + state, rep]))
        member = kernels.louvain(_matrix(pdf, 0.0), rng)
        return pd.DataFrame(
            {"state": state, "rep": rep, "node": np.arange(1, len(member) + 1),
             "community": member}
        )

    runs = _per_state(edges, nodes).withColumn(
        "rep", F.explode(F.sequence(F.lit(1), F.lit(repetitions)))
    )
    tasks = edges.sparkSession.sparkContext.defaultParallelism
    return runs.repartition(tasks, "state", "rep").groupBy("state", "rep").applyInPandas(
        solve, "state int, rep int, node int, community int"
    )


def agreement(memberships: DataFrame) -> DataFrame:
    """Share of repetitions in which i < j fall in one community, zeros included. The memberships of a
    repetition (p nodes) are one row; a task adds up which nodes stand together, one p x p block per state, so
    what is shuffled does not depend on the number of repetitions."""
    point = F.struct("node", "community")
    rows = memberships.groupBy("state", "rep").agg(F.array_sort(F.collect_list(point)).alias("m")).select(
        "state", F.col("m.node").alias("nodes"), F.col("m.community").alias("communities")
    )

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        together: dict[tuple, np.ndarray] = {}
        runs: dict[tuple, int] = {}
        for batch in batches:
            for r in batch.itertuples(index=False):
                key, c = (r.state, tuple(r.nodes)), np.asarray(r.communities)
                same = (c[:, None] == c[None, :]).astype(np.int64)
                together[key] = together[key] + same if key in together else same
                runs[key] = runs.get(key, 0) + 1
        for (state, nodes), counts in together.items():
            i, j = np.triu_indices(len(nodes), 1)
            at = np.array(nodes)
            yield pd.DataFrame(
                {"state": state, "i": at[i], "j": at[j], "n": counts[i, j], "runs": runs[state, nodes]}
            )

    parts = rows.mapInPandas(fold, "state int, i int, j int, n bigint, runs bigint")
    return parts.groupBy("state", "i", "j").agg((F.sum("n") / F.sum("runs")).alias("agreement"))


def partition_modularity(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Modularity of a given partition (state, node, community) of every state's network: weight inside
    communities against that expected from strengths. NULL without any weight."""
    ends = partition.select("state", "node", "community")
    inside = edges.join(
        ends.select("state", F.col("node").alias("i"), F.col("community").alias("ci")), ["state", "i"]
    ).join(ends.select("state", F.col("node").alias("j"), F.col("community").alias("cj")), ["state", "j"])
    weights = inside.groupBy("state").agg(
        F.sum("w").alias("total"), F.sum(F.when(F.col("ci") == F.col("cj"), F.col("w")).otherwise(0.0)).alias("within")
    )
    strength = _both_ways(edges).groupBy("state", "node").agg(F.sum("w").alias("s")).join(ends, ["state", "node"])
    expected = strength.groupBy("state", "community").agg(F.sum("s").alias("s")).groupBy("state").agg(
        F.sum(F.col("s") * F.col("s")).alias("squares")
    )
    states = partition.select("state").distinct()
    total = F.when(F.col("total") > 0, F.col("total"))
    return states.join(weights, "state", "left").join(expected, "state", "left").select(
        "state", (F.col("within") / total - F.col("squares") / (4 * total * total)).alias("modularity")
    )


def thresholded_agreement(
    agreements: DataFrame, threshold: float = config.CONSENSUS_THRESHOLD
) -> DataFrame:
    """Full symmetric matrix of the shares that reach the threshold; 0 below it and on the diagonal."""
    kept = F.when(F.col("agreement") >= threshold, F.col("agreement")).otherwise(0.0)
    cells = F.array(F.struct(F.col("i").alias("i"), F.col("j").alias("j")), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    off = agreements.select("state", F.explode(cells).alias("c"), kept.alias("agreement"))
    off = off.select("state", "c.i", "c.j", "agreement")
    diagonal = off.select("state", "i", F.col("i").alias("j"), F.lit(0.0).alias("agreement")).distinct()
    return off.union(diagonal)


def consensus_communities(
    agreements: DataFrame,
    nodes: DataFrame,
    threshold: float = config.CONSENSUS_THRESHOLD,
    seed: int = config.COMMUNITY_SEED,
) -> DataFrame:
    """(state, node, community, modularity): communities of the thresholded agreement network and
    that network's modularity. Without any edge left every node stands alone and modularity is 0;
    a state without any edge from the start is NULL."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        state = int(pdf["state"].iloc[0])
        a = _matrix(pdf, 0.0)
        a[a < threshold] = 0.0
        if a.sum() == 0:
            member, q = np.arange(1, len(a) + 1), 0.0
        else:
            member = kernels.louvain(a, np.random.Generator(np.random.PCG64([seed + state, 0])))
            q = kernels.modularity(a, member)
        return pd.DataFrame(
            {"state": state, "node": np.arange(1, len(a) + 1), "community": member,
             "modularity": q}
        )

    weights = agreements.withColumnRenamed("agreement", "w")
    found = _per_state(weights, nodes).groupBy("state").applyInPandas(
        solve, "state int, node int, community int, modularity double"
    )
    return nodes.join(found, ["state", "node"], "left")


def density_edges(
    edges: DataFrame, nodes: DataFrame, proportions: Sequence[float] = config.EDGE_PROPORTIONS
) -> DataFrame:
    """Strongest edges at fixed densities: max(1, ceil(share * p(p-1)/2)) per state, all if fewer
    exist. Equal weights keep column-wise upper-triangle order."""
    for share in proportions:
        if not 0 < share <= 1:
            raise ValueError("an edge proportion must lie in (0, 1]")
    size = nodes.groupBy("state").agg(F.count(F.lit(1)).alias("p"))
    total = F.col("p") * (F.col("p") - 1) / 2
    ranked = edges.join(F.broadcast(size), "state").withColumn(
        "edge_rank",
        F.row_number().over(Window.partitionBy("state").orderBy(F.desc("w"), "j", "i")),
    )
    levels = F.array(
        *[
            F.struct(
                F.lit(int(round(100 * s))).alias("percent"), F.lit(float(s)).alias("share")
            )
            for s in proportions
        ]
    )
    target = F.greatest(F.lit(1), F.ceil(F.col("level.share") * total)).cast("bigint")
    return (
        ranked.withColumn("level", F.explode(levels))
        .withColumn("target_edges", target)
        .filter(F.col("edge_rank") <= F.col("target_edges"))
        .select("level.percent", "state", "i", "j", "w", "edge_rank", "target_edges",
                total.cast("bigint").alias("possible_edges"))
    )


def density_summary(kept: DataFrame, edges: DataFrame) -> DataFrame:
    available = edges.groupBy("state").agg(F.count(F.lit(1)).alias("available_positive_edges"))
    return (
        kept.groupBy("percent", "state", "target_edges", "possible_edges")
        .agg(F.min("w").alias("threshold"), F.count(F.lit(1)).alias("retained_edges"))
        .join(F.broadcast(available), "state")
        .select(
            "percent", "state", "threshold", "retained_edges", "target_edges",
            "available_positive_edges", "possible_edges",
            (F.col("retained_edges") / F.col("possible_edges")).alias("achieved_density"),
            (F.col("retained_edges") < F.col("target_edges")).alias("short_of_target"),
        )
    )


def edge_widths(kept: DataFrame, low: float = 0.5, high: float = 4.0) -> DataFrame:
    """Line widths for drawing: weights rescaled within each network."""
    return kept.withColumn("width", rescale(F.col("w"), low, high, ["percent", "state"]))


def topology_tables(
    matrix: DataFrame,
    value: str = "r",
    repetitions: int = config.LOUVAIN_REPETITIONS,
    agreements: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Primary metrics, additional metrics and node metrics of every state network."""
    nodes = nodes_of(matrix)
    edges = positive_edges(matrix, value)
    paths = path_metrics(shortest_paths(edges), nodes)
    if agreements is None:
        agreements = agreement(louvain_memberships(edges, nodes, repetitions))
    communities = consensus_communities(agreements, nodes)
    clustering = weighted_clustering(edges, nodes)
    between = node_betweenness(edges, nodes)
    node_table = clustering.join(between, ["state", "node"]).join(
        communities.drop("modularity"), ["state", "node"]
    )
    local = local_efficiency(edges, nodes).groupBy("state").agg(
        F.avg("local_efficiency").alias("local_efficiency")
    )
    modules = communities.groupBy("state").agg(
        F.max("modularity").alias("modularity"),
        F.count_distinct("community").alias("number_of_communities"),
    )
    primary = paths.select("state", "global_efficiency").join(local, "state").join(
        modules, "state"
    )
    means = node_table.groupBy("state").agg(
        F.avg("weighted_clustering").alias("weighted_clustering"),
        F.avg("betweenness").alias("mean_betweenness"),
    )
    additional = (
        network_summary(node_degrees(edges, nodes))
        .join(paths.select("state", "average_path_length"), "state").join(means, "state")
    )
    return primary, additional, node_table
