"""State matrices and networks on hand-computed fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from statewalk.operators import graph, matrices
from statewalk.operators import graph_kernels as kernels

EDGES = [(1, 1, 2, 0.5), (1, 1, 3, 0.25), (1, 2, 3, 0.8), (1, 3, 4, 0.4)]


@pytest.fixture(scope="module")
def net(spark):
    edges = spark.createDataFrame(EDGES, "state int, i int, j int, w double")
    nodes = spark.createDataFrame([(1, n) for n in (1, 2, 3, 4)], "state int, node int")
    return edges, nodes


def by_node(df, column):
    return [r[column] for r in df.orderBy("node").collect()]


def test_paths(net):
    edges, nodes = net
    d = {(r["i"], r["j"]): r["distance"] for r in graph.shortest_paths(edges).collect()}
    assert d == pytest.approx(
        {(1, 2): 2, (1, 3): 3.25, (1, 4): 5.75, (2, 3): 1.25, (2, 4): 3.75, (3, 4): 2.5}
    )
    m = graph.path_metrics(graph.shortest_paths(edges), nodes).first()
    assert m["global_efficiency"] == pytest.approx(0.4080453363062058)
    assert m["average_path_length"] == pytest.approx(3.0833333333333335)


def test_node_metrics(net):
    edges, nodes = net
    local = by_node(graph.local_efficiency(edges, nodes), "local_efficiency")
    assert local[:3] == pytest.approx([0.928317766722556, 0.6299605249474366, 0.2645668419947])
    assert local[3] is None
    clustering = graph.weighted_clustering(edges, nodes)
    assert by_node(clustering, "weighted_clustering") == pytest.approx([1, 1, 0.3620689655172413, 0])
    assert by_node(clustering, "degree") == [2, 2, 3, 1]
    assert by_node(clustering, "strength") == pytest.approx([0.75, 1.3, 1.45, 0.4])
    summary = graph.network_summary(graph.node_degrees(edges, nodes)).first()
    assert summary["density"] == pytest.approx(2 / 3) and summary["cost"] == pytest.approx(2 / 3)
    # 1-3 and 1-4 run through 2 and 3; 2-4 runs through 3.
    assert by_node(graph.node_betweenness(edges, nodes), "betweenness") == pytest.approx(
        [0, 2 / 3, 2 / 3, 0]
    )


def test_isolated_and_unreachable_nodes(spark):
    edges = spark.createDataFrame([(1, 1, 2, 0.5)], "state int, i int, j int, w double")
    nodes = spark.createDataFrame([(1, n) for n in (1, 2, 3)] + [(2, n) for n in (1, 2, 3)],
                                  "state int, node int")
    m = {r["state"]: r for r in graph.path_metrics(graph.shortest_paths(edges), nodes).collect()}
    assert m[1]["global_efficiency"] == pytest.approx(2 * 0.5 / 6)
    assert m[2]["global_efficiency"] == 0 and m[2]["average_path_length"] is None
    between = {(r["state"], r["node"]): r["betweenness"]
               for r in graph.node_betweenness(edges, nodes).collect()}
    assert between[1, 3] == 0 and between[2, 1] is None


def test_shared_shortest_paths():
    square = kernels.adjacency(4, np.array([0, 1, 2, 0]), np.array([1, 2, 3, 3]), np.ones(4), np.inf)
    assert kernels.betweenness(square) == pytest.approx([1 / 6] * 4)


def test_communities(spark):
    rows = []
    for a, b in ((1, 4), (5, 8)):
        rows += [(1, i, j, 1.0) for i in range(a, b + 1) for j in range(i + 1, b + 1)]
    rows.append((1, 4, 5, 0.05))
    edges = spark.createDataFrame(rows, "state int, i int, j int, w double")
    nodes = spark.createDataFrame([(1, n) for n in range(1, 9)], "state int, node int")
    members = graph.louvain_memberships(edges, nodes, repetitions=12)
    again = graph.louvain_memberships(edges, nodes, repetitions=12)
    assert members.exceptAll(again).isEmpty()
    agreed = graph.agreement(members)
    assert agreed.filter("i <= 4 and j >= 5 and agreement > 0").isEmpty()
    out = graph.consensus_communities(agreed, nodes).orderBy("node").collect()
    assert [r["community"] for r in out] == [1] * 4 + [2] * 4
    assert out[0]["modularity"] == pytest.approx(0.5)
    alone = graph.consensus_communities(agreed, nodes, threshold=1.1).collect()
    assert {r["community"] for r in alone} == set(range(1, 9)) and alone[0]["modularity"] == 0


def test_edge_targets(spark):
    n = 20
    rows = [(1, i, j, 1.0 / (i + 20 * j)) for i in range(1, n + 1) for j in range(i + 1, n + 1)]
    edges = spark.createDataFrame(rows, "state int, i int, j int, w double")
    nodes = spark.createDataFrame([(1, v) for v in range(1, n + 1)], "state int, node int")
    kept = graph.density_edges(edges, nodes)
    got = {r["percent"]: r for r in graph.density_summary(kept, edges).collect()}
    assert [got[p]["retained_edges"] for p in (15, 20, 25)] == [29, 38, 48]
    few = edges.limit(10)
    short = graph.density_summary(graph.density_edges(few, nodes, [0.2]), few).first()
    assert short["retained_edges"] == 10 and short["short_of_target"]
    tied = edges.withColumn("w", F.lit(0.5))
    first = [(r["i"], r["j"]) for r in graph.density_edges(tied, nodes, [0.01]).orderBy("edge_rank").collect()]
    assert first == [(1, 2), (1, 3)]
    with pytest.raises(ValueError):
        graph.density_edges(edges, nodes, [0.0])


def test_correlation_from_covariance(spark):
    rows = [(1, 1, 1, 4.0), (1, 1, 2, 2.0), (1, 1, 3, -1.0), (1, 2, 2, 9.0), (1, 2, 3, 3.0), (1, 3, 3, 16.0)]
    cov = spark.createDataFrame(rows, "state int, i int, j int, cov double")
    r = {(x["i"], x["j"]): x["r"] for x in matrices.covariance_to_correlation(cov).collect()}
    assert r == pytest.approx({(1, 1): 1, (2, 2): 1, (3, 3): 1, (1, 2): 1 / 3, (1, 3): -0.125, (2, 3): 0.25})
    with pytest.raises(Exception, match="positive"):
        matrices.covariance_to_correlation(cov.withColumn("cov", -F.col("cov"))).collect()


def test_moments_match_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(5, 2, (400, 5))
    df = spark.createDataFrame([(1 + n % 2, v.tolist()) for n, v in enumerate(x)], "state int, x array<double>")
    got = matrices.state_moments(df.repartition(7))
    for state in (1, 2):
        want = np.cov(x[state - 1 :: 2], rowvar=False)
        for r in got.filter(F.col("state") == state).collect():
            assert r["cov"] == pytest.approx(want[r["i"] - 1, r["j"] - 1])


def test_zscore_guard(spark):
    rows = [(1, 1.0, 2.0), (1, 1.0, 3.0), (2, 0.0, 1.0), (2, 2.0, 5.0)]
    df = spark.createDataFrame(rows, "subject_id bigint, x1 double, x2 double")
    assert matrices.variance_violations(df, ["x1", "x2"]).collect()[0]["signal"] == "x1"
    with pytest.raises(Exception, match="no variance"):
        matrices.zscore_by_subject(df, ["x1", "x2"]).collect()


def test_thresholded_agreement(spark):
    df = spark.createDataFrame([(1, 1, 2, 0.5), (1, 1, 3, 0.49), (1, 2, 3, 1.0)], "state int, i int, j int, agreement double")
    got = {(r["i"], r["j"]): r["agreement"] for r in graph.thresholded_agreement(df).collect()}
    want = {(1, 2): 0.5, (1, 3): 0.0, (2, 3): 1.0}
    assert got == want | {(j, i): v for (i, j), v in want.items()} | {(i, i): 0.0 for i in (1, 2, 3)}


def test_names_must_fit_the_matrix(spark):
    df = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.2)], "state int, i int, mean double")
    assert matrices.roi_names(df, ["a", "b"]).count() == 2
    for names in (["a"], ["a", "b", "c"], ["a", "a"]):
        with pytest.raises(ValueError, match="names"):
            matrices.roi_names(df, names)


def test_moments_merge_about_a_common_mean(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 3)) + 1e7
    rows = [(int(i % 2) + 1, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "state int, x array<double>").repartition(9)
    parts = df.mapInPandas(matrices._task_moments, matrices.MOMENT_SCHEMA)
    assert parts.groupBy("state", "task").count().filter("count > 1").isEmpty()
    for r in matrices.state_moments(df).collect():
        own = x[r["state"] - 1 :: 2]
        assert r["n"] == len(own)
        want = np.cov(own[:, r["i"] - 1], own[:, r["j"] - 1])[0, 1]
        assert abs(r["cov"] - want) < 1e-7
