"""Independent SQL (DuckDB dialect) for the matrix and network queries."""

from __future__ import annotations

P, K = 64, 10

SERIES = """
series AS (
  SELECT l_suppkey AS subject_id, CASE WHEN l_suppkey % 2 = 0 THEN 'TD' ELSE 'Dyslexia' END AS grp,
         'supplier_' || l_suppkey AS file,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber,
                            l_partkey, l_quantity, l_extendedprice) AS timepoint,
         l_quantity AS x1, l_extendedprice AS x2, l_discount AS x3, l_tax AS x4
  FROM lineitem)"""

VALUES = f"""
dims AS (SELECT unnest(range(1, {P + 1})) AS i),
vals AS (
  SELECT label + 1 AS state, vec_id, i, embedding[i]::DOUBLE AS v
  FROM embeddings CROSS JOIN dims)"""

COV = """
cov AS (
  SELECT a.state, a.i, b.i AS j, count(*) AS n, covar_samp(a.v, b.v) AS cov
  FROM vals a JOIN vals b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY ALL),
mu AS (SELECT state, i, avg(v) AS m FROM vals GROUP BY ALL)"""

CORR = """
corr AS (
  SELECT c.state, c.i, c.j,
         CASE WHEN c.i = c.j THEN 1.0
              ELSE greatest(-1.0, least(1.0, c.cov / sqrt(a.cov * b.cov))) END AS r
  FROM cov c JOIN cov a ON a.state = c.state AND a.i = c.i AND a.j = c.i
             JOIN cov b ON b.state = c.state AND b.i = c.j AND b.j = c.j)"""

EDGES = """
edges AS (SELECT state, i, j, r AS w FROM corr WHERE i < j AND r > 0),
ways AS (SELECT state, i, j, w FROM edges UNION ALL SELECT state, j, i, w FROM edges),
nodes AS (SELECT DISTINCT state, i AS node FROM corr),
degrees AS (
  SELECT n.state, n.node, count(w.w) AS degree, coalesce(sum(w.w), 0) AS strength
  FROM nodes n LEFT JOIN ways w ON w.state = n.state AND w.i = n.node GROUP BY ALL)"""


def _paths(source: str, keys: str, rounds: int = 6) -> str:
    """Min-plus squaring: ``rounds`` doublings reach 2^rounds steps."""
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"a.{k} = b.{k}" for k in ks)
    ak = ", ".join(f"a.{k}" for k in ks)
    ctes = [f"""
d0 AS (
  SELECT {keys}, i, j, 1.0 / w AS d FROM {source}
  UNION ALL SELECT DISTINCT {keys}, i, i, 0.0::DOUBLE FROM {source})"""]
    for r in range(1, rounds + 1):
        ctes.append(f"""
d{r} AS (
  SELECT {ak}, a.i, b.j, min(a.d + b.d) AS d FROM d{r - 1} a JOIN d{r - 1} b
  ON {on} AND a.j = b.i GROUP BY ALL)""")
    return ",".join(ctes)


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


def oracle() -> dict[str, str]:
    q: dict[str, str] = {}
    q["observed_series"] = _with(SERIES) + """
SELECT subject_id, grp AS "group", file, timepoint, round(x1, 6) AS x1, round(x2, 6) AS x2,
       round(x3, 6) AS x3, round(x4, 6) AS x4 FROM series"""
    q["zscore_series"] = _with(SERIES) + "SELECT subject_id, grp AS \"group\", file, timepoint, " + ", ".join(
        f"round((x{c} - avg(x{c}) OVER w) / stddev_samp(x{c}) OVER w, 6) + 0.0 AS z{c}" for c in range(1, 5)
    ) + " FROM series WINDOW w AS (PARTITION BY subject_id)"
    q["variance_violations"] = _with(SERIES) + """
SELECT subject_id, 'x4' AS signal, 0.0::DOUBLE AS sd FROM series WHERE subject_id % 3 = 0
GROUP BY subject_id
UNION ALL
SELECT subject_id, signal, round(sd, 6) FROM (
  SELECT subject_id, unnest(['x1', 'x2', 'x3']) AS signal,
         unnest([stddev_samp(x1), stddev_samp(x2), stddev_samp(x3)]) AS sd
  FROM series GROUP BY subject_id) WHERE sd IS NULL OR sd <= 1.4901161193847656e-08"""

    base = (VALUES, COV)
    q["state_covariance"] = _with(*base) + """
SELECT state::BIGINT AS state, i, j, n, round(cov, 6) AS cov FROM cov"""
    q["state_correlation"] = _with(*base, CORR) + """
SELECT state::BIGINT AS state, i, j, round(r, 6) AS r FROM corr"""
    q["state_matrices_from_csv"] = _with(*base, CORR) + """
SELECT state::BIGINT AS state, i, j, round(r, 6) AS r, 'csv' AS matrix_source FROM corr"""
    q["state_correlation_wide"] = _with(*base, CORR, """
full_corr AS (SELECT state, i, j, r FROM corr UNION ALL SELECT state, j, i, r FROM corr WHERE i < j)""") + (
        "SELECT state::BIGINT AS state, i, "
        + ", ".join(f"round(max(r) FILTER (WHERE j = {j}), 6) AS roi_{j}" for j in range(1, P + 1))
        + " FROM full_corr GROUP BY ALL"
    )

    def measures(v: str, mean: str, signed: str, count: str) -> str:
        return f"""
       round(avg({v}), 6) AS mean_all_{mean},
       round(avg({v}) FILTER (WHERE {v} > 0), 6) AS mean_positive_{signed},
       round(avg({v}) FILTER (WHERE {v} < 0), 6) AS mean_negative_{signed}_signed,
       round(avg(-{v}) FILTER (WHERE {v} < 0), 6) AS mean_negative_{signed}_magnitude,
       count(*) FILTER (WHERE {v} > 0) AS number_positive_{count},
       count(*) FILTER (WHERE {v} < 0) AS number_negative_{count},
       count(*) FILTER (WHERE {v} = 0) AS number_zero_{count}"""

    q["state_summary"] = _with(*base, CORR) + f"""
SELECT * FROM (SELECT state::BIGINT AS state, {measures("r", "off_diagonal_correlations", "correlation", "correlations")}
  FROM corr WHERE i < j GROUP BY state) JOIN
 (SELECT state::BIGINT AS state, {measures("m", "roi_signals", "roi_signal", "rois")}
  FROM mu GROUP BY state) USING (state)"""
    roi = "'ROI_' || lpad(i::VARCHAR, 2, '0')"
    q["mean_signal_long"] = _with(*base) + f"""
SELECT state::BIGINT AS state, {roi} AS roi, round(m, 6) AS mean_signal FROM mu"""
    q["mean_signal_wide"] = _with(*base) + f"SELECT {roi} AS roi, " + ", ".join(
        f"round(max(m) FILTER (WHERE state = {s}), 6) AS state_{s}" for s in range(1, K + 1)
    ) + " FROM mu GROUP BY i"
    q["state_similarity"] = _with(*base) + """
SELECT state_1, state_2, round(c, 6) AS covariance_pattern_correlation,
       round(m, 6) AS mean_vector_correlation
FROM (SELECT a.state::BIGINT AS state_1, b.state::BIGINT AS state_2, corr(a.cov, b.cov) AS c
      FROM cov a JOIN cov b ON a.i = b.i AND a.j = b.j AND a.state < b.state AND a.i < a.j GROUP BY ALL)
JOIN (SELECT a.state::BIGINT AS state_1, b.state::BIGINT AS state_2, corr(a.m, b.m) AS m
      FROM mu a JOIN mu b ON a.i = b.i AND a.state < b.state GROUP BY ALL) USING (state_1, state_2)"""

    g = (*base, CORR, EDGES)
    q["positive_edges"] = _with(*g) + """
SELECT state::BIGINT AS state, i, j, round(w, 6) AS w FROM edges"""
    q["node_degrees"] = _with(*g) + """
SELECT state::BIGINT AS state, node, degree, round(strength, 6) AS strength FROM degrees"""
    q["network_summary"] = _with(*g) + f"""
SELECT state::BIGINT AS state, (sum(degree) / 2)::BIGINT AS positive_edges,
       round(sum(degree) / ({P} * ({P} - 1)), 6) AS density, round(avg(degree), 6) AS mean_degree,
       round(avg(degree) / ({P} - 1), 6) AS cost, round(avg(strength), 6) AS mean_strength
FROM degrees GROUP BY state"""
    kept = f"""
levels AS (SELECT unnest([15, 20, 25]) AS percent),
kept AS (
  SELECT percent, e.*, greatest(1, ceil(percent / 100.0::DOUBLE * {P * (P - 1) // 2}))::BIGINT AS target
  FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY w DESC, j, i) AS edge_rank FROM edges) e
  CROSS JOIN levels
  WHERE edge_rank <= greatest(1, ceil(percent / 100.0::DOUBLE * {P * (P - 1) // 2})))"""
    q["density_threshold_edges"] = _with(*g, kept) + f"""
SELECT percent::BIGINT AS percent, state::BIGINT AS state, i, j, round(w, 6) AS w, edge_rank,
       target AS target_edges, {P * (P - 1) // 2}::BIGINT AS possible_edges FROM kept"""
    q["density_threshold_summary"] = _with(*g, kept) + f"""
SELECT percent::BIGINT AS percent, k.state::BIGINT AS state, round(min(k.w), 6) AS threshold,
       count(*) AS retained_edges, any_value(target) AS target_edges,
       any_value(a.n) AS available_positive_edges, {P * (P - 1) // 2}::BIGINT AS possible_edges,
       round(count(*) / {P * (P - 1) // 2}, 6) AS achieved_density,
       count(*) < any_value(target) AS short_of_target
FROM kept k JOIN (SELECT state, count(*) AS n FROM edges GROUP BY state) a ON a.state = k.state
GROUP BY percent, k.state"""
    q["edge_widths"] = _with(*g, kept) + """
SELECT percent::BIGINT AS percent, state::BIGINT AS state, i, j,
       round(0.5 + 3.5 * (w - min(w) OVER s) / (max(w) OVER s - min(w) OVER s), 6) AS width
FROM kept WINDOW s AS (PARTITION BY percent, state)"""
    q["shortest_paths"] = _with(*g, _paths("ways", "state")) + """
SELECT state::BIGINT AS state, i, j, round(d, 6) AS distance FROM d6 WHERE i < j"""
    q["path_metrics"] = _with(*g, _paths("ways", "state")) + f"""
SELECT state::BIGINT AS state,
       round(sum(1 / d) FILTER (WHERE i <> j) / ({P} * ({P} - 1)), 6) AS global_efficiency,
       round(avg(d) FILTER (WHERE i <> j), 6) AS average_path_length
FROM d6 GROUP BY state"""
    q["local_efficiency"] = _with(*g, """
inner_ways AS (
  SELECT e.state, a.i AS node, e.i, e.j, pow(e.w, 1 / 3.0::DOUBLE) AS w
  FROM ways e JOIN ways a ON a.state = e.state AND a.j = e.i
              JOIN ways b ON b.state = e.state AND b.i = a.i AND b.j = e.j)""",
        _paths("inner_ways", "state, node"), """
sums AS (SELECT state, node, sum(1 / d) FILTER (WHERE i <> j) AS s FROM d6 GROUP BY ALL)""") + """
SELECT n.state::BIGINT AS state, n.node, CASE WHEN degree >= 2 THEN
         round(coalesce(s, 0) / (degree * (degree - 1)), 6) END AS local_efficiency
FROM degrees n LEFT JOIN sums USING (state, node)"""
    q["weighted_clustering"] = _with(*g, """
closed AS (
  SELECT a.state, a.i AS node, sum((a.w + b.w) / 2) AS s
  FROM ways a JOIN ways b ON b.state = a.state AND b.i = a.i AND b.j <> a.j
              JOIN ways c ON c.state = a.state AND c.i = a.j AND c.j = b.j GROUP BY ALL)""") + """
SELECT n.state::BIGINT AS state, n.node, CASE WHEN degree >= 2 THEN
         round(coalesce(s, 0) / (strength * (degree - 1)), 6) ELSE 0 END AS weighted_clustering
FROM degrees n LEFT JOIN closed USING (state, node)"""
    q["node_betweenness"] = _with(*g, _paths("ways", "state")) + f"""
SELECT n.state::BIGINT AS state, n.node,
       round(count(x.state) * 2 / (({P} - 1) * ({P} - 2)), 6) AS betweenness
FROM nodes n LEFT JOIN (
  SELECT st.state, sv.j AS node
  FROM d6 st JOIN d6 sv ON sv.state = st.state AND sv.i = st.i AND sv.j <> st.i AND sv.j <> st.j
             JOIN d6 vt ON vt.state = st.state AND vt.i = sv.j AND vt.j = st.j
  WHERE st.i < st.j AND abs(sv.d + vt.d - st.d) < 1e-10) x
  ON x.state = n.state AND x.node = n.node
GROUP BY ALL"""
    def exact(name: str) -> str:
        """A query without its rounding."""
        return q[name].replace("round(", "(").replace(", 6)", ")")

    given = f"""
given AS (SELECT state, node, rep, (node * rep + state) % 5 AS community
          FROM nodes CROSS JOIN (SELECT unnest(range(1, 9)) AS rep))"""
    q["given_partition_agreement"] = _with(*g, given) + """
SELECT a.state::BIGINT AS state, a.node AS i, b.node AS j, round(avg((a.community = b.community)::INT), 6) AS agreement
FROM given a JOIN given b ON a.state = b.state AND a.rep = b.rep AND a.node < b.node GROUP BY ALL"""
    q["given_partition_modularity"] = _with(*g, given) + """
SELECT t.state::BIGINT AS state, round(sum(CASE WHEN x.community = y.community THEN coalesce(w.w, 0) - sx.strength * sy.strength / t.total END) / t.total, 6) AS modularity
FROM (SELECT state, sum(strength) AS total FROM degrees GROUP BY state) t
JOIN given x ON x.state = t.state AND x.rep = 3 JOIN given y ON y.state = t.state AND y.rep = 3
JOIN degrees sx ON sx.state = t.state AND sx.node = x.node JOIN degrees sy ON sy.state = t.state AND sy.node = y.node
LEFT JOIN ways w ON w.state = t.state AND w.i = x.node AND w.j = y.node GROUP BY t.state, t.total"""
    q["topology_additional_metrics"] = f"""
SELECT s.state, s.positive_edges, round(s.density, 6) AS density, round(s.mean_degree, 6) AS mean_degree, round(s.cost, 6) AS cost,
       round(s.mean_strength, 6) AS mean_strength, round(p.average_path_length, 6) AS average_path_length,
       round(c.m, 6) AS weighted_clustering, round(b.m, 6) AS mean_betweenness
FROM ({exact("network_summary")}) s JOIN ({exact("path_metrics")}) p USING (state)
JOIN (SELECT state, avg(weighted_clustering) AS m FROM ({exact("weighted_clustering")}) GROUP BY state) c USING (state)
JOIN (SELECT state, avg(betweenness) AS m FROM ({exact("node_betweenness")}) GROUP BY state) b USING (state)"""
    return q
