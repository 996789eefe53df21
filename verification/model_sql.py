"""Independent SQL (DuckDB dialect) for model choice, state matching and agreement."""

from __future__ import annotations

import numpy as np

from verification.matrix_sql import SERIES

P, K, RUNS = 16, 10, 4

VIEWS = f"""
dims AS (SELECT unnest(range(1, {P + 1})) AS i),
runs AS (SELECT unnest(range(1, {RUNS + 1})) AS run),
vals AS (
  SELECT run, label + 1 AS state, vec_id, i, embedding[(run - 1) * {P} + i]::DOUBLE AS v
  FROM embeddings CROSS JOIN dims CROSS JOIN runs),
sigma AS (
  SELECT a.run, a.state, a.i, b.i AS j, covar_samp(a.v, b.v) AS v
  FROM vals a JOIN vals b ON a.run = b.run AND a.vec_id = b.vec_id AND a.i < b.i GROUP BY ALL),
mu AS (SELECT run, state, i, avg(v) AS v FROM vals GROUP BY ALL),
similarity AS (
  SELECT run_a, run_b, state_a, state_b, c, m,
         (greatest(-1, least(1, 0.5::DOUBLE * c + 0.5::DOUBLE * m)) + 1) / 2 AS score
  FROM (SELECT a.run AS run_a, b.run AS run_b, a.state AS state_a, b.state AS state_b,
               corr(a.v, b.v) AS c
        FROM sigma a JOIN sigma b ON a.i = b.i AND a.j = b.j AND a.run < b.run GROUP BY ALL)
  JOIN (SELECT a.run AS run_a, b.run AS run_b, a.state AS state_a, b.state AS state_b,
               corr(a.v, b.v) AS m
        FROM mu a JOIN mu b ON a.i = b.i AND a.run < b.run GROUP BY ALL)
  USING (run_a, run_b, state_a, state_b))"""

def _best_assignment() -> str:
    """Best one-to-one matching by dynamic programming over sets of used states of run b."""
    steps = ["""
step0 AS (SELECT DISTINCT run_a, run_b, 0 AS used, 0.0::DOUBLE AS total, []::BIGINT[] AS path
          FROM similarity)"""]
    for i in range(1, K + 1):
        steps.append(f"""
step{i} AS (
  SELECT p.run_a, p.run_b, p.used + (1 << (s.state_b - 1)::INT) AS used,
         max(p.total + s.score) AS total,
         arg_max(list_append(p.path, s.state_b::BIGINT), p.total + s.score) AS path
  FROM step{i - 1} p JOIN similarity s
    ON s.run_a = p.run_a AND s.run_b = p.run_b AND s.state_a = {i}
   AND (p.used >> (s.state_b - 1)::INT) % 2 = 0
  GROUP BY 1, 2, 3)""")
    return ",".join(steps) + f""",
best AS (SELECT run_a, run_b, unnest(range(1, {K + 1})) AS state_a, unnest(path) AS state_b
         FROM step{K})"""


MATCH = _best_assignment() + """,
matched AS (
  SELECT run_a, run_b, median(c) AS covariance_correlation_median,
         min(c) AS covariance_correlation_minimum, median(m) AS mean_vector_correlation_median,
         min(m) AS mean_vector_correlation_minimum
  FROM similarity JOIN best USING (run_a, run_b, state_a, state_b) GROUP BY ALL)"""

LABELS = """
labels AS (
  SELECT user_id AS subject_id,
         CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3
                         WHEN 'signup' THEN 4 WHEN 'view' THEN 5 END::BIGINT AS l1,
         least(5, greatest(1, 1 + floor(value / 20)))::BIGINT AS l2,
         (1 + hour(ts) // 5)::BIGINT AS l3
  FROM events)"""

METRICS = (
    "covariance_correlation_median", "covariance_correlation_minimum",
    "mean_vector_correlation_median", "mean_vector_correlation_minimum",
)


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


def _ari(a: str, b: str, run_a: int, run_b: int) -> str:
    return f"""
SELECT {run_a}::BIGINT AS run_a, {run_b}::BIGINT AS run_b,
       round((c - x * y / t) / (0.5::DOUBLE * (x + y) - x * y / t), 6) AS ari
FROM (SELECT (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM labels GROUP BY {a}, {b})) AS c,
             (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM labels GROUP BY {a})) AS x,
             (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM labels GROUP BY {b})) AS y,
             (SELECT count(*) * (count(*) - 1) / 2 FROM labels) AS t)"""


def given_model_sql(init, transition, duration, mu, sigma) -> dict[str, str]:
    """Forward, backward and max-product recursions of a semi-Markov model in recursive SQL, over (state,
    remaining or elapsed duration), with all K x M weights as columns."""
    k, m, p = len(init), duration.shape[1], mu.shape[1]
    states, ages, dims = range(1, k + 1), range(1, m + 1), range(1, p + 1)
    cells = [(j, r) for j in states for r in ages]

    def density(j: int) -> str:
        inverse, norm = np.linalg.inv(sigma[j - 1]), p * np.log(2 * np.pi) + np.log(np.linalg.det(sigma[j - 1]))
        terms = [
            f"({inverse[a - 1, b - 1]!r}::DOUBLE) * (z{a} - ({mu[j - 1, a - 1]!r}::DOUBLE)) * (z{b} - ({mu[j - 1, b - 1]!r}::DOUBLE))"
            for a in dims for b in dims
        ]
        return f"-0.5::DOUBLE * ({norm!r}::DOUBLE + {' + '.join(terms)})".replace("np.float64(", "(")

    def n(value: float) -> str:
        return f"{float(value)!r}::DOUBLE"

    zs = ", ".join(f"(x{i} - avg(x{i}) OVER w) / stddev_samp(x{i}) OVER w AS z{i}" for i in dims)
    head = f"""{SERIES},
scaled AS MATERIALIZED (SELECT subject_id AS sid, grp, file, timepoint AS t, count(*) OVER w AS n, {zs}
                        FROM series WINDOW w AS (PARTITION BY subject_id)),
em AS MATERIALIZED (SELECT sid, grp, file, t, n, {", ".join(f"z{i}" for i in dims)}, {", ".join(f"{density(j)} AS l{j}" for j in states)} FROM scaled)"""
    alphas = ", ".join(f"exp(l{j}) * q{j}_{r} AS a{j}_{r}" for j, r in cells)
    total = " + ".join(f"a{j}_{r}" for j, r in cells)
    enter = {j: " + ".join(f"a{i}_1 * {n(transition[i - 1, j - 1])}" for i in states if i != j) for j in states}
    following = ", ".join(
        f"(({enter[j]}) * {n(duration[j - 1, r - 1])}" + (f" + a{j}_{r + 1}" if r < m else "") + f") / c AS q{j}_{r}" for j, r in cells
    )
    keep = ", ".join(f"a{j}_{r} / c AS a{j}_{r}" for j, r in cells)
    step = f"SELECT sid, t, c, {keep}, {following} FROM (SELECT *, {total} AS c FROM (SELECT e.sid, e.t, {alphas} FROM"
    first = ", ".join(f"{n(init[j - 1])} * {n(duration[j - 1, r - 1])} AS q{j}_{r}" for j, r in cells)
    forward = f"""
fw AS (
  {step} (SELECT *, {first} FROM em WHERE t = 1) e))
  UNION ALL
  {step} em e JOIN fw ON fw.sid = e.sid AND e.t = fw.t + 1)))"""
    # Weights of the future, relative to the forward pass.
    worth = {j: " + ".join(f"{n(duration[j - 1, r - 1])} * g{j}_{r}" for r in ages) for j in states}
    beta = {
        (j, r): " + ".join(f"{n(transition[j - 1, i - 1])} * w{i}" for i in states if i != j) if r == 1 else f"g{j}_{r - 1}"
        for j, r in cells
    }
    g_of = ", ".join(f"exp(l{j}) * b{j}_{r} / c AS g{j}_{r}" for j, r in cells)
    backward = f"""
ahead AS MATERIALIZED (SELECT fw.*, e.n, {", ".join(f"l{j}" for j in states)} FROM fw JOIN em e USING (sid, t)),
bw AS (
  SELECT sid, t, {", ".join(f"b{j}_{r}" for j, r in cells)}, {g_of}
  FROM (SELECT *, {", ".join(f"1.0::DOUBLE AS b{j}_{r}" for j, r in cells)} FROM ahead WHERE t = n)
  UNION ALL
  SELECT sid, t, {", ".join(f"b{j}_{r}" for j, r in cells)}, {g_of}
  FROM (SELECT sid, t, c, {", ".join(f"l{j}" for j in states)}, {", ".join(f"{beta[j, r]} AS b{j}_{r}" for j, r in cells)}
        FROM (SELECT f.sid, f.t, f.c, {", ".join(f"f.l{j}" for j in states)}, {", ".join(f"g{j}_{r}" for j, r in cells)},
                     {", ".join(f"{worth[j]} AS w{j}" for j in states)}
              FROM bw JOIN ahead f ON f.sid = bw.sid AND f.t = bw.t - 1))),
post AS MATERIALIZED (
  SELECT f.sid, f.t, f.n, f.c, {", ".join(f"z{i}" for i in dims)}, {", ".join(f"{' + '.join(f'f.a{j}_{r} * b.b{j}_{r}' for r in ages)} AS p{j}" for j in states)},
         {", ".join(f"f.a{j}_1" for j in states)}, {", ".join(f"b.g{j}_{r}" for j, r in cells)},
         {", ".join(f"lead(b.g{j}_{r}) OVER v AS h{j}_{r}" for j, r in cells)}
  FROM ahead f JOIN bw b USING (sid, t) JOIN em USING (sid, t) WINDOW v AS (PARTITION BY f.sid ORDER BY f.t))"""
    stats = [("loglik", 1, 0, 0, "sum(ln(c))")]
    for j in states:
        opened = {r: f"{n(init[j - 1])} * {n(duration[j - 1, r - 1])} * g{j}_{r}" for r in ages}
        stats.append(("init", j, 0, 0, f"sum({' + '.join(opened.values())}) FILTER (WHERE t = 1)"))
        later = " + ".join(f"a{i}_1 * {n(transition[i - 1, j - 1])}" for i in states if i != j)
        for r in ages:
            stats.append(("duration", j, r, 0, f"sum({opened[r]}) FILTER (WHERE t = 1) + coalesce(sum(({later}) * {n(duration[j - 1, r - 1])} * h{j}_{r}), 0)"))
        for i in states:
            after = " + ".join(f"{n(duration[i - 1, r - 1])} * h{i}_{r}" for r in ages)
            stats.append(("transition", j, i, 0, f"coalesce(sum(a{j}_1 * {n(transition[j - 1, i - 1])} * ({after})), 0)"))
        stats.append(("w", j, 0, 0, f"sum(p{j})"))
        stats.append(("w2", j, 0, 0, f"sum(p{j} * p{j})"))
        for a in dims:
            stats.append(("wx", j, a, 0, f"sum(p{j} * z{a})"))
            stats += [("wxx", j, a, b, f"sum(p{j} * z{a} * z{b})") for b in dims]
    packed = ", ".join(f"{{'part': '{s}', 'a': {a}, 'b': {b}, 'c': {c}, 'v': ({v})::DOUBLE}}" for s, a, b, c, v in stats)
    sums = f"""
sums AS MATERIALIZED (
  SELECT s.part AS part, s.a::BIGINT AS a, s.b::BIGINT AS b, s.c::BIGINT AS c, s.v AS v, n
  FROM (SELECT unnest([{packed}]) AS s, count(*) AS n FROM post))"""
    recursive = f"WITH RECURSIVE {head}, {forward}, {backward}, {sums}\n"
    q = {"given_model_statistics": recursive + "SELECT part, a, b, c, round(v / n, 6) AS value FROM sums"}
    q["given_model_next"] = recursive + """
, parts AS (SELECT s.*, w.v AS w, w2.v AS w2, x.v AS xa, y.v AS xb
            FROM sums s LEFT JOIN sums w ON w.part = 'w' AND w.a = s.a LEFT JOIN sums w2 ON w2.part = 'w2' AND w2.a = s.a
            LEFT JOIN sums x ON x.part = 'wx' AND x.a = s.a AND x.b = s.b LEFT JOIN sums y ON y.part = 'wx' AND y.a = s.a AND y.b = s.c)
SELECT CASE part WHEN 'wx' THEN 'mu' WHEN 'wxx' THEN 'sigma' ELSE part END AS part, a, b, c,
       round(CASE part WHEN 'init' THEN v / sum(v) OVER (PARTITION BY part)
                       WHEN 'wx' THEN v / w
                       WHEN 'wxx' THEN (v / w - xa * xb / (w * w)) / (1 - w2 / (w * w))
                       ELSE v / sum(v) OVER (PARTITION BY part, a) END, 6) AS value
FROM parts WHERE part NOT IN ('loglik', 'w', 'w2')"""
    # Best paths: weights of (state, elapsed), with the best end of every state and the source of every start.
    ends = {j: [f"d{j}_{r} + ln({n(duration[j - 1, r - 1])})" for r in ages] for j in states}
    best_end = ", ".join(f"greatest({', '.join(ends[j])}) AS e{j}" for j in states)
    age_of = ", ".join(
        f"CASE {' '.join(f'WHEN {v} = greatest({chr(44).join(ends[j])}) THEN {r}' for r, v in zip(ages, ends[j]))} END AS u{j}" for j in states
    )
    moves = {j: {i: f"e{i} + ln({n(transition[i - 1, j - 1])})" for i in states if i != j} for j in states}
    source = ", ".join(
        f"CASE {' '.join(f'WHEN {v} = greatest({chr(44).join(moves[j].values())}) THEN {i}' for i, v in moves[j].items())} END AS s{j}" for j in states
    )
    into = ", ".join(f"greatest({', '.join(moves[j].values())}) + l{j} AS d{j}_1" for j in states)
    going = ", ".join(f"d{j}_{r - 1} + l{j} AS d{j}_{r}" for j, r in cells if r > 1)
    order = ", ".join(f"d{j}_{r}" for j, r in cells)
    sources = ", ".join(f"s{j}" for j in states)
    used = ", ".join(f"u{j}" for j in states)
    opened = ", ".join(f"ln({n(init[j - 1])}) + l{j} AS d{j}_1" for j in states)
    never = ", ".join(f"'-infinity'::DOUBLE AS d{j}_{r}" for j, r in cells if r > 1)
    survivor = np.cumsum(duration[:, ::-1], axis=1)[:, ::-1]
    closing = {(j, r): f"d{j}_{r} + ln({n(survivor[j - 1, r - 1])})" for j, r in cells}
    top = f"greatest({', '.join(closing.values())})"
    state_case = " ".join(f"WHEN {v} = {top} THEN {j}" for (j, _), v in closing.items())
    age_case = " ".join(f"WHEN {v} = {top} THEN {r}" for (_, r), v in closing.items())
    prior = " ".join(f"WHEN {j} THEN v.s{j}" for j in states)
    pick = "CASE CASE p.state " + prior + " END " + " ".join(f"WHEN {j} THEN v.u{j}" for j in states) + " END"
    q["given_model_paths"] = f"""WITH RECURSIVE {head},
vt AS (
  SELECT sid, t, {order}, {", ".join(f"0 AS s{j}" for j in states)}, {", ".join(f"0 AS u{j}" for j in states)}
  FROM (SELECT sid, t, {opened}, {never} FROM em WHERE t = 1)
  UNION ALL
  SELECT sid, t, {order}, {sources}, {used}
  FROM (SELECT sid, t, {into}, {going}, {source}, {used}
        FROM (SELECT *, {best_end}, {age_of} FROM (SELECT e.sid, e.t, {", ".join(f"e.l{j}" for j in states)}, {order}
              FROM em e JOIN vt ON vt.sid = e.sid AND e.t = vt.t + 1)))),
walk AS MATERIALIZED (SELECT * FROM vt),
path AS (
  SELECT sid, t, (CASE {state_case} END)::INT AS state, (CASE {age_case} END)::INT AS age FROM walk WHERE t = (SELECT max(t) FROM walk w WHERE w.sid = walk.sid)
  UNION ALL
  SELECT p.sid, p.t - 1, CASE WHEN p.age > 1 THEN p.state ELSE CASE p.state {prior} END END,
         CASE WHEN p.age > 1 THEN p.age - 1 ELSE {pick} END
  FROM path p JOIN walk v ON v.sid = p.sid AND v.t = p.t WHERE p.t > 1)
SELECT p.sid AS subject_id, e.grp AS "group", e.file, p.t AS timepoint, p.state::BIGINT AS state FROM path p JOIN em e USING (sid, t)"""
    near = ", ".join(f"{' + '.join(f'(z{a} - ({n(mu[j - 1, a - 1])})) * (z{a} - ({n(mu[j - 1, a - 1])}))' for a in dims)} AS d{j}" for j in states)
    least = f"least({', '.join(f'd{j}' for j in states)})"
    clusters = f"""WITH {head},
members AS (SELECT *, CASE {" ".join(f"WHEN d{j} = {least} THEN {j}" for j in states)} END AS s FROM (SELECT *, {near} FROM em)),
long AS (SELECT sid, t, s, unnest(range(1, {p + 1})) AS i, unnest([{", ".join(f"z{a}" for a in dims)}]) AS x FROM members),
means AS (SELECT s, i, count(*) AS n, avg(x) AS m, stddev_samp(x) AS sd FROM long GROUP BY s, i)"""
    q["given_model_lloyd_step"] = clusters + """
SELECT 'size' AS part, s::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c, n::DOUBLE AS value FROM means WHERE i = 1
UNION ALL SELECT 'centre', s, i, 0, round(m, 6) FROM means"""
    q["given_model_shrinkage"] = clusters + """,
std AS (SELECT sid, t, s, i, (x - m) / sd AS y FROM long JOIN means USING (s, i)),
pairs AS (SELECT a.s, a.i, b.i AS j, count(*) AS n, sum(a.y * b.y) AS c, sum(a.y * a.y * b.y * b.y) AS c2
          FROM std a JOIN std b USING (sid, t) GROUP BY a.s, a.i, b.i),
vars AS (SELECT *, n / ((n - 1.0) ** 3) * (c2 - c * c / n) AS v, c / (n - 1) AS r FROM pairs),
lam AS (SELECT s, least(1.0, greatest(0.0, sum(v) / sum(r * r))) AS l FROM vars WHERE i <> j GROUP BY s),
mid AS (SELECT s, median(sd * sd) AS target FROM means GROUP BY s),
lamv AS (SELECT s, least(1.0, greatest(0.0, sum(v * sd ** 4) / sum((sd * sd - target) ** 2))) AS l
         FROM vars JOIN means USING (s, i) JOIN mid USING (s) WHERE i = j GROUP BY s),
spread AS (SELECT s, i, lamv.l * target + (1 - lamv.l) * sd * sd AS v FROM means JOIN mid USING (s) JOIN lamv USING (s))
SELECT 'mean' AS part, s::BIGINT AS a, i::BIGINT AS b, 0::BIGINT AS c, round(m, 6) AS value FROM means
UNION ALL
SELECT 'covariance', p.s, p.i, p.j, round(CASE WHEN p.i = p.j THEN 1 ELSE (1 - lam.l) * p.r END * sqrt(x.v) * sqrt(y.v), 6)
FROM vars p JOIN lam ON lam.s = p.s JOIN spread x ON x.s = p.s AND x.i = p.i JOIN spread y ON y.s = p.s AND y.i = p.j"""
    return q


def oracle(given: tuple) -> dict[str, str]:
    q: dict[str, str] = given_model_sql(*given)
    q["information_criteria"] = """
WITH binned AS (
  SELECT k, least(k - 1, floor((l_quantity - 1) * k / 50)) AS bin
  FROM lineitem CROSS JOIN (SELECT unnest(range(2, 11)) AS k)),
fits AS (
  SELECT k, sum(n * ln(n / t)) AS log_lik, any_value(t) AS t
  FROM (SELECT k, bin, count(*) AS n, sum(count(*)) OVER (PARTITION BY k) AS t FROM binned GROUP BY k, bin)
  GROUP BY k),
scored AS (
  SELECT k, log_lik, (k - 1) + k * (k - 2) + k * 20 + k * 210 + k * 199 AS n_parameters, t FROM fits),
ic AS (
  SELECT *, -2 * log_lik + 2 * n_parameters AS aic, -2 * log_lik + ln(t) * n_parameters AS bic
  FROM scored)
SELECT k, round(log_lik, 6) AS log_lik, n_parameters::BIGINT AS n_parameters, round(aic, 6) AS aic,
       round(bic, 6) AS bic, round(bic - min(bic) OVER (), 6) AS delta_bic,
       rank() OVER (ORDER BY bic) AS bic_rank
FROM ic"""
    q["run_similarity"] = _with(VIEWS) + """
SELECT run_a::BIGINT AS run_a, run_b::BIGINT AS run_b, state_a::BIGINT AS state_a,
       state_b::BIGINT AS state_b, round(c, 6) AS covariance_correlation,
       round(m, 6) AS mean_correlation, round(score, 6) AS score FROM similarity"""
    q["matched_states"] = _with(VIEWS, MATCH) + """
SELECT run_a::BIGINT AS run_a, run_b::BIGINT AS run_b, state_a::BIGINT AS state_a,
       state_b::BIGINT AS state_b FROM best"""
    q["matched_correlations"] = _with(VIEWS, MATCH) + (
        "SELECT run_a::BIGINT AS run_a, run_b::BIGINT AS run_b, "
        + ", ".join(f"round({m}, 6) AS {m}" for m in METRICS) + " FROM matched"
    )
    q["stability_metric_summary"] = _with(VIEWS, MATCH) + " UNION ALL ".join(
        f"""SELECT '{m}' AS metric, round(quantile_cont({m}, 0.5), 6) AS median,
 round(quantile_cont({m}, 0.25), 6) AS iqr_low, round(quantile_cont({m}, 0.75), 6) AS iqr_high,
 round(min({m}), 6) AS minimum, round(max({m}), 6) AS maximum FROM matched""" for m in METRICS
    )
    q["pair_agreement"] = _with(LABELS) + " UNION ALL ".join(
        [_ari("l1", "l2", 1, 2), _ari("l1", "l3", 1, 3), _ari("l2", "l3", 2, 3)]
    )
    q["occupancy_correlation"] = _with(LABELS, """
grid AS (SELECT subject_id, state FROM (SELECT DISTINCT subject_id FROM labels)
         CROSS JOIN (SELECT unnest(range(1, 6)) AS state)),
occ AS (
  SELECT g.subject_id, g.state,
         count(*) FILTER (WHERE l1 = g.state) / count(*) AS o1,
         count(*) FILTER (WHERE l2 = g.state) / count(*) AS o2,
         count(*) FILTER (WHERE l3 = g.state) / count(*) AS o3
  FROM grid g JOIN labels l ON l.subject_id = g.subject_id GROUP BY ALL)""") + """
SELECT 1::BIGINT AS run_a, 2::BIGINT AS run_b, round(corr(o1, o2), 6) AS occupancy_correlation FROM occ
UNION ALL SELECT 1, 3, round(corr(o1, o3), 6) FROM occ
UNION ALL SELECT 2, 3, round(corr(o2, o3), 6) FROM occ"""
    return q
