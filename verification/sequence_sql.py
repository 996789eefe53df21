"""Independent SQL (DuckDB dialect) for the decoded-sequence queries."""

from __future__ import annotations

K = 5
PRIME = (1 << 31) - 1
STATES = f"(SELECT unnest(range(1, {K + 1})) AS state)"

DECODED = """
decoded AS (
  SELECT user_id AS subject_id,
         CASE WHEN user_id % 2 = 0 THEN 'TD' ELSE 'Dyslexia' END AS grp,
         'user_' || user_id AS file,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS timepoint,
         CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3
                         WHEN 'signup' THEN 4 WHEN 'view' THEN 5 END AS state
  FROM events)"""

SUBJECTS = """
subjects AS (
  SELECT subject_id, min(grp) AS grp, min(file) AS file, count(*) AS n_timepoints
  FROM decoded GROUP BY subject_id)"""

OCCUPANCY = f"""
occupancy AS (
  SELECT s.subject_id, s.grp, s.file, s.n_timepoints, k.state,
         coalesce(c.n, 0) AS n_state,
         coalesce(c.n, 0) / s.n_timepoints AS occupancy_fraction,
         coalesce(c.n, 0) / s.n_timepoints * 100.0::DOUBLE AS occupancy_percent
  FROM subjects s CROSS JOIN {STATES} k
  LEFT JOIN (SELECT subject_id, state, count(*) AS n FROM decoded GROUP BY ALL) c
    ON c.subject_id = s.subject_id AND c.state = k.state)"""

RUNS = """
marked AS (
  SELECT *, CASE WHEN state = lag(state) OVER w THEN 0 ELSE 1 END AS starts
  FROM decoded WINDOW w AS (PARTITION BY subject_id ORDER BY timepoint)),
numbered AS (
  SELECT *, sum(starts) OVER (PARTITION BY subject_id ORDER BY timepoint) AS run_index FROM marked),
runs AS (
  SELECT subject_id, grp, file, state, run_index, count(*) AS duration,
         max(run_index) OVER (PARTITION BY subject_id) AS n_runs
  FROM numbered GROUP BY subject_id, grp, file, state, run_index)"""

COMPLETE = """
complete AS (
  SELECT subject_id, grp, file, state, duration, run_index AS original_run_index,
         row_number() OVER (PARTITION BY subject_id ORDER BY run_index) AS complete_run_index
  FROM runs WHERE run_index > 1 AND run_index < n_runs)"""

TRANSITIONS = f"""
moves AS (
  SELECT subject_id, state AS to_state,
         lag(state) OVER (PARTITION BY subject_id ORDER BY run_index) AS from_state
  FROM runs),
subject_counts AS (
  SELECT s.subject_id, s.grp, s.file, a.state AS from_state, b.state AS to_state,
         count(m.subject_id) AS cnt
  FROM subjects s CROSS JOIN {STATES} a JOIN {STATES} b ON a.state <> b.state
  LEFT JOIN moves m
    ON m.subject_id = s.subject_id AND m.from_state = a.state AND m.to_state = b.state
  GROUP BY ALL)"""


def _residue(hexdigest: str, start: int) -> str:
    return f"(('0x' || substr({hexdigest}, {start}, 12))::BIGINT % {PRIME})"


def _coefficients(name: str, replicates: int, seed: int, streams: str, draw: int) -> str:
    cells = ", ".join(
        _residue(f"md5(concat_ws('|', {seed} + stream, b, {draw}, {i}))", 1) + f" AS a{i}"
        for i in range(5)
    )
    return f"""
{name} AS (
  SELECT stream, b, {cells}
  FROM (SELECT unnest({streams}) AS stream) CROSS JOIN
       (SELECT unnest(range(1, {replicates + 1})) AS b))"""


def _polynomial(x: str, y: str, c: str) -> str:
    inner = f"(({c}.a3 * {x} + {c}.a2) % {PRIME})"
    inner = f"(({inner} * {x} + {c}.a1) % {PRIME})"
    inner = f"(({inner} * {x} + {c}.a0) % {PRIME})"
    return f"(({inner} + {c}.a4 * {y} % {PRIME}) % {PRIME})"


def _permuted(replicates: int, seed: int, streams: str) -> str:
    """CTEs ending in permuted(stream, b, subject_id, label)."""
    return _coefficients("coef", replicates, seed, streams, 0) + f""",
hashed AS (
  SELECT subject_id, {_residue("md5(subject_id::VARCHAR)", 1)} AS x,
         {_residue("md5(subject_id::VARCHAR)", 13)} AS y
  FROM subjects),
permuted AS (
  SELECT stream, b, subject_id,
         CASE WHEN row_number() OVER (PARTITION BY stream, b ORDER BY h, subject_id)
                   <= (SELECT count(*) FROM subjects WHERE grp = 'Dyslexia')
              THEN 'Dyslexia' ELSE 'TD' END AS label
  FROM (SELECT coef.stream, coef.b, hashed.subject_id, {_polynomial("x", "y", "coef")} AS h
        FROM coef CROSS JOIN hashed))"""


def _bh(source: str, p: str, order: str) -> str:
    """CTE adjusted(*, fdr) over the non-NULL p of ``source``."""
    return f"""
ranked AS (
  SELECT *, row_number() OVER (ORDER BY {p} NULLS LAST, {order}) AS r, count({p}) OVER () AS m
  FROM {source}),
adjusted AS (
  SELECT *, CASE WHEN {p} IS NOT NULL THEN
    least(1.0, min({p} * m / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) END AS fdr
  FROM ranked)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


def oracle(occupancy_b: int, occupancy_seed: int, sojourn_b: int, sojourn_seed: int,
           transition_b: int, transition_seed: int, bootstrap_b: int, bootstrap_seed: int,
           width: int, alpha: float = 0.001, cap: int = 200) -> dict[str, str]:
    q: dict[str, str] = {}

    q["decoded_sequences"] = _with(DECODED) + """
SELECT subject_id, grp AS "group", file, timepoint, state::BIGINT AS state FROM decoded"""

    q["standardize_groups"] = """
SELECT raw AS raw_label,
       CASE WHEN lower(trim(raw)) IN ('control','controls','ctrl','td','typically developing',
                                      'typically_developing') THEN 'TD'
            WHEN lower(trim(raw)) IN ('patient','patients','dyslexia','dyslexic') THEN 'Dyslexia'
            ELSE trim(raw) END AS "group",
       count(*) AS n_rows
FROM (SELECT CASE c_custkey % 12 WHEN 0 THEN ' Controls ' WHEN 1 THEN 'patients' WHEN 2 THEN 'TD'
        WHEN 3 THEN 'Dyslexic' WHEN 4 THEN 'ctrl' WHEN 5 THEN 'PATIENT'
        WHEN 6 THEN 'typically developing' WHEN 7 THEN ' dyslexia' WHEN 8 THEN 'Control'
        WHEN 9 THEN 'Dyslexia' ELSE c_mktsegment END AS raw FROM customer)
GROUP BY ALL"""

    q["subject_checks"] = _with("""
faulty AS (
  SELECT user_id AS subject_id,
         CASE WHEN user_id % 2 = 0 OR (user_id % 7 = 3 AND event_id % 5 = 0)
              THEN 'TD' ELSE 'Dyslexia' END AS grp,
         'user_' || CASE WHEN user_id % 11 = 2 THEN event_id % 2 ELSE user_id END AS file,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)
           + CASE WHEN user_id % 5 = 1 THEN 1 ELSE 0 END AS timepoint
  FROM events)""") + """
SELECT subject_id, count(*) AS n_timepoints,
       bool_and(timepoint = rn) AS is_contiguous,
       count(DISTINCT grp) = 1 AS has_one_group, count(DISTINCT file) = 1 AS has_one_file
FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY timepoint) AS rn FROM faulty)
GROUP BY subject_id"""

    q["row_violations"] = _with(DECODED) + f"""
SELECT count(*) FILTER (WHERE state IS NULL) AS n_missing,
       count(*) FILTER (WHERE state NOT BETWEEN 1 AND {K - 1}) AS n_bad_state,
       count(*) FILTER (WHERE grp NOT IN ('TD', 'Dyslexia')) AS n_bad_group,
       count(*) AS n_rows,
       count(*) FILTER (WHERE grp = 'TD') AS n_rows_td,
       count(*) FILTER (WHERE grp = 'Dyslexia') AS n_rows_dyslexia
FROM decoded"""

    q["subject_information"] = _with(DECODED, SUBJECTS) + """
SELECT subject_id, grp AS "group", file, n_timepoints FROM subjects"""

    q["subject_occupancy"] = _with(DECODED, SUBJECTS, OCCUPANCY) + """
SELECT subject_id, grp AS "group", file, n_timepoints, state, n_state,
       round(occupancy_fraction, 6) AS occupancy_fraction,
       round(occupancy_percent, 6) AS occupancy_percent
FROM occupancy"""

    q["group_occupancy_summary"] = _with(DECODED, SUBJECTS, OCCUPANCY) + """
SELECT grp AS "group", state, count(*) AS n_participants,
       round(avg(occupancy_percent), 6) AS mean_percent,
       round(stddev_samp(occupancy_percent), 6) AS sd_percent,
       round(stddev_samp(occupancy_percent) / sqrt(count(*)), 6) AS se_percent,
       round(quantile_cont(occupancy_percent, 0.5), 6) AS median_percent,
       round(quantile_cont(occupancy_percent, 0.25), 6) AS q25,
       round(quantile_cont(occupancy_percent, 0.75), 6) AS q75,
       round(min(occupancy_percent), 6) AS minimum, round(max(occupancy_percent), 6) AS maximum
FROM occupancy GROUP BY ALL"""

    q["occupancy_bars"] = _with(DECODED, SUBJECTS, OCCUPANCY) + "SELECT state, " + ", ".join(
        f"""round(avg(occupancy_percent) FILTER (WHERE grp = '{g}'), 6) AS {g.lower()}_mean_percent,
 round(stddev_samp(occupancy_percent) FILTER (WHERE grp = '{g}')
       / sqrt(count(*) FILTER (WHERE grp = '{g}')), 6) AS {g.lower()}_se_percent"""
        for g in ("TD", "Dyslexia")
    ) + " FROM occupancy GROUP BY state"

    q["normalized_occupancy"] = _with(DECODED, SUBJECTS, OCCUPANCY) + """
SELECT subject_id, state, round(greatest(n_state, 0.5::DOUBLE)
         / sum(greatest(n_state, 0.5::DOUBLE)) OVER (PARTITION BY subject_id), 6) AS probability
FROM occupancy"""

    q["decoded_from_csv"] = q["decoded_sequences"]

    q["occupancy_permutation_test"] = _with(
        DECODED, SUBJECTS, OCCUPANCY,
        _permuted(occupancy_b, occupancy_seed, f"range(1, {K + 1})"), """
observed AS (
  SELECT state,
         avg(occupancy_percent) FILTER (WHERE grp = 'TD') AS mean_td,
         stddev_samp(occupancy_percent) FILTER (WHERE grp = 'TD') AS sd_td,
         avg(occupancy_percent) FILTER (WHERE grp = 'Dyslexia') AS mean_dys,
         stddev_samp(occupancy_percent) FILTER (WHERE grp = 'Dyslexia') AS sd_dys
  FROM occupancy GROUP BY state)""", """
null_values AS (
  SELECT o.state, p.b,
         avg(occupancy_percent) FILTER (WHERE label = 'Dyslexia')
           - avg(occupancy_percent) FILTER (WHERE label = 'TD') AS d
  FROM permuted p JOIN occupancy o ON o.subject_id = p.subject_id AND o.state = p.stream
  GROUP BY o.state, p.b)""", """
tested AS (
  SELECT observed.*, mean_dys - mean_td AS diff,
         (count(*) FILTER (WHERE round(abs(d), 10) >= round(abs(mean_dys - mean_td), 10)) + 1)
           / (count(*) + 1) AS p
  FROM observed JOIN null_values USING (state) GROUP BY ALL)""",
        _bh("tested", "p", "state")) + """
SELECT state, round(mean_td, 6) AS mean_td_percent, round(sd_td, 6) AS sd_td,
       round(mean_dys, 6) AS mean_dyslexia_percent, round(sd_dys, 6) AS sd_dyslexia,
       round(diff, 6) AS mean_difference, round(p, 6) AS permutation_p_value,
       round(fdr, 6) AS fdr_adjusted_p_value, fdr < 0.05 AS significant_fdr_0_05
FROM adjusted"""

    q["state_runs"] = _with(DECODED, RUNS) + """
SELECT subject_id, grp AS "group", file, state::BIGINT AS state, run_index::BIGINT AS run_index,
       n_runs::BIGINT AS n_runs, duration FROM runs"""

    q["complete_sojourn_runs"] = _with(DECODED, RUNS, COMPLETE) + """
SELECT subject_id, grp AS "group", file, state::BIGINT AS state, duration,
       original_run_index::BIGINT AS original_run_index, complete_run_index FROM complete"""

    q["sojourn_group_summary"] = _with(DECODED, SUBJECTS, RUNS, COMPLETE) + f"""
SELECT g.grp AS "group", k.state,
       (SELECT count(*) FROM subjects s WHERE s.grp = g.grp) AS n_total_participants,
       count(DISTINCT c.subject_id) AS n_participants_with_complete_runs,
       count(c.duration) AS n_complete_runs,
       round(avg(duration), 6) AS mean_duration,
       round(stddev_samp(duration), 6) AS standard_deviation,
       round(quantile_cont(duration, 0.5), 6) AS median_duration,
       round(quantile_cont(duration, 0.25), 6) AS iqr_low,
       round(quantile_cont(duration, 0.75), 6) AS iqr_high,
       min(duration) AS minimum, max(duration) AS maximum
FROM (SELECT unnest(['TD', 'Dyslexia']) AS grp) g CROSS JOIN {STATES} k
LEFT JOIN complete c ON c.grp = g.grp AND c.state = k.state
GROUP BY ALL"""

    bins = f"(SELECT unnest(range(1, (SELECT max(least(duration, {cap})) FROM complete) + 1)) AS bin)"
    q["duration_distribution"] = _with(DECODED, RUNS, COMPLETE, f"""
bins AS {bins},
totals AS (SELECT grp, state, count(*) AS n_runs FROM complete GROUP BY ALL),
filled AS (
  SELECT g.grp, g.state, g.n_runs, b.bin, count(c.duration) AS n
  FROM totals g CROSS JOIN bins b
  LEFT JOIN complete c ON c.grp = g.grp AND c.state = g.state AND least(c.duration, {cap}) = b.bin
  GROUP BY ALL)""") + f"""
SELECT grp AS "group", state::BIGINT AS state, bin, n, n_runs,
       round((n + {alpha}) / (n_runs + {alpha} * (SELECT count(*) FROM bins)), 6) AS probability
FROM filled"""

    observed_kl = f"""
bins AS {bins},
people AS (
  SELECT k.state,
         count(*) FILTER (WHERE grp = 'TD') AS n_td, count(*) FILTER (WHERE grp = 'Dyslexia') AS n_dys,
         count(DISTINCT subject_id) FILTER (WHERE grp = 'TD') AS p_td,
         count(DISTINCT subject_id) FILTER (WHERE grp = 'Dyslexia') AS p_dys,
         avg(duration) FILTER (WHERE grp = 'TD') AS m_td,
         avg(duration) FILTER (WHERE grp = 'Dyslexia') AS m_dys
  FROM {STATES} k LEFT JOIN complete c USING (state) GROUP BY k.state),
dense AS (
  SELECT p.state, b.bin,
         ((SELECT count(*) FROM complete c WHERE c.state = p.state AND c.grp = 'Dyslexia'
             AND least(duration, {cap}) = b.bin) + {alpha})
           / (n_dys + {alpha} * (SELECT count(*) FROM bins)) AS pd,
         ((SELECT count(*) FROM complete c WHERE c.state = p.state AND c.grp = 'TD'
             AND least(duration, {cap}) = b.bin) + {alpha})
           / (n_td + {alpha} * (SELECT count(*) FROM bins)) AS qt
  FROM people p CROSS JOIN bins b WHERE n_td >= 1 AND n_dys >= 1),
observed AS (
  SELECT p.*, p.n_td >= 1 AND p.n_dys >= 1 AS estimable, kl
  FROM people p LEFT JOIN (SELECT state, sum(pd * ln(pd / qt)) AS kl FROM dense GROUP BY state) d
  USING (state))"""
    q["observed_kl"] = _with(DECODED, RUNS, COMPLETE, observed_kl) + """
SELECT state, n_td AS n_td_complete_runs, n_dys AS n_dyslexia_complete_runs,
       p_td AS n_td_participants_with_runs, p_dys AS n_dyslexia_participants_with_runs,
       estimable AS estimable_between_group_kl, round(kl, 6) AS kl_dyslexia_to_td
FROM observed"""

    q["kl_permutation_test"] = _with(
        DECODED, SUBJECTS, RUNS, COMPLETE, observed_kl,
        _permuted(sojourn_b, sojourn_seed, "[0]"), f"""
cells AS (
  SELECT subject_id, state, least(duration, {cap}) AS bin, count(*) AS n FROM complete GROUP BY ALL)""",
        """
null_cells AS (
  SELECT b, state, bin,
         coalesce(sum(n) FILTER (WHERE label = 'Dyslexia'), 0) AS t,
         coalesce(sum(n) FILTER (WHERE label = 'TD'), 0) AS r
  FROM cells JOIN permuted USING (subject_id) GROUP BY ALL),
null_totals AS (
  SELECT b, state, sum(t) AS nt, sum(r) AS nr FROM null_cells GROUP BY ALL),
null_kl AS (
  SELECT n.b, n.state, sum(p * ln(p / q)) AS kl0
  FROM (SELECT z.b, z.state, bins.bin,
""" + f"""
               (coalesce(t, 0) + {alpha}) / (nt + {alpha} * (SELECT count(*) FROM bins)) AS p,
               (coalesce(r, 0) + {alpha}) / (nr + {alpha} * (SELECT count(*) FROM bins)) AS q
        FROM null_totals z CROSS JOIN bins
        LEFT JOIN null_cells c ON c.b = z.b AND c.state = z.state AND c.bin = bins.bin
        WHERE nt >= 1 AND nr >= 1) n
  GROUP BY ALL)""", """
null_count AS (
  SELECT o.state, count(kl0) AS m, count(*) FILTER (WHERE round(kl0, 10) >= round(kl, 10)) AS e
  FROM observed o JOIN null_kl n ON n.state = o.state WHERE o.estimable GROUP BY o.state),
tested AS (
  SELECT o.*, coalesce(m, 0) AS valid, CASE WHEN m > 0 THEN (e + 1) / (m + 1) END AS p
  FROM observed o LEFT JOIN null_count USING (state))""",
        _bh("tested", "p", "state")) + """
SELECT state, n_td AS n_td_complete_runs, n_dys AS n_dyslexia_complete_runs,
       p_td AS n_td_participants_with_runs, p_dys AS n_dyslexia_participants_with_runs,
       round(m_td, 6) AS mean_td_duration, round(m_dys, 6) AS mean_dyslexia_duration,
       round(m_dys - m_td, 6) AS mean_difference, estimable AS estimable_between_group_kl,
       round(kl, 6) AS kl_dyslexia_to_td, valid AS valid_permutations,
       round(p, 6) AS permutation_p_value, round(fdr, 6) AS fdr_adjusted_p_value,
       fdr < 0.05 AS significant_fdr_0_05,
       CASE WHEN estimable THEN 'Between-group duration distribution was estimable.'
            ELSE 'Not estimable: at least one group lacked sufficient complete internal runs for this state.'
       END AS interpretation_note
FROM adjusted"""

    q["subject_transitions"] = _with(DECODED, SUBJECTS, RUNS, TRANSITIONS) + """
SELECT subject_id, grp AS "group", file, from_state, to_state, cnt AS transition_count,
       sum(cnt) OVER w::BIGINT AS total_transitions_from_state,
       round(cnt / nullif(sum(cnt) OVER w, 0), 6) AS conditional_probability
FROM subject_counts WINDOW w AS (PARTITION BY subject_id, from_state)"""

    q["group_transition_matrices"] = _with(DECODED, SUBJECTS, RUNS, TRANSITIONS, f"""
filled AS (
  SELECT g.grp, a.state AS from_state, b.state AS to_state, coalesce(sum(c.cnt), 0) AS n
  FROM (SELECT unnest(['TD', 'Dyslexia']) AS grp) g CROSS JOIN {STATES} a CROSS JOIN {STATES} b
  LEFT JOIN subject_counts c ON c.grp = g.grp AND c.from_state = a.state AND c.to_state = b.state
  GROUP BY ALL)""") + """
SELECT grp AS "group", from_state, to_state, n::BIGINT AS transition_count,
       round(n / nullif(sum(n) OVER (PARTITION BY grp, from_state), 0), 6) AS probability
FROM filled"""

    for name, value in (("count", "transition_count"), ("probability", "probability")):
        cells = ", ".join(f"max({value}) FILTER (WHERE to_state = {j}) AS to_{j}" for j in range(1, K + 1))
        q[f"transition_{name}_matrices"] = f"""SELECT "group", from_state, {cells} FROM ({q["group_transition_matrices"]}) GROUP BY ALL"""
    exact = q["group_transition_matrices"].replace(
        "round(n / nullif(sum(n) OVER (PARTITION BY grp, from_state), 0), 6)", "n / nullif(sum(n) OVER (PARTITION BY grp, from_state), 0)"
    )
    gaps = ", ".join(
        f"""CASE WHEN from_state <> {j} THEN round(max(probability) FILTER (WHERE to_state = {j} AND "group" = 'Dyslexia')
            - max(probability) FILTER (WHERE to_state = {j} AND "group" = 'TD'), 6) END AS to_{j}""" for j in range(1, K + 1)
    )
    q["transition_difference_matrix"] = f"SELECT from_state, {gaps} FROM ({exact}) GROUP BY from_state"
    q["length_check"] = """
SELECT sum(n)::BIGINT AS total_length, sum(n)::BIGINT AS n_rows, true AS equal
FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)"""
    q["occupancy_violations"] = "SELECT DISTINCT user_id AS subject_id, 100.0::DOUBLE AS total_percent, true AS complete FROM events"

    pooled = """
pooled AS (
  SELECT from_state, to_state,
         sum(cnt) FILTER (WHERE grp = 'TD') AS c_td, sum(cnt) FILTER (WHERE grp = 'Dyslexia') AS c_dys
  FROM subject_counts GROUP BY ALL),
observed AS (
  SELECT *, c_td / nullif(sum(c_td) OVER w, 0) AS p_td, c_dys / nullif(sum(c_dys) OVER w, 0) AS p_dys
  FROM pooled WINDOW w AS (PARTITION BY from_state))"""
    null_transitions = """
null_counts AS (
  SELECT b, from_state, to_state, sum(cnt) FILTER (WHERE label = 'TD') AS c_td,
         sum(cnt) FILTER (WHERE label = 'Dyslexia') AS c_dys
  FROM subject_counts JOIN permuted USING (subject_id) GROUP BY ALL),
null_values AS (
  SELECT from_state, to_state,
         c_dys / nullif(sum(c_dys) OVER w, 0) - c_td / nullif(sum(c_td) OVER w, 0) AS d
  FROM null_counts WINDOW w AS (PARTITION BY b, from_state)),
null_count AS (
  SELECT from_state, to_state, count(d) AS m,
         count(*) FILTER (WHERE round(abs(d), 10) >= round(abs(p_dys - p_td), 10)) AS e
  FROM observed JOIN null_values USING (from_state, to_state) GROUP BY from_state, to_state),
tested AS (
  SELECT o.*, p_dys - p_td AS diff,
         CASE WHEN p_dys - p_td IS NOT NULL THEN coalesce(m, 0) ELSE 0 END AS valid,
         CASE WHEN p_dys - p_td IS NOT NULL AND m > 0 THEN (e + 1) / (m + 1) END AS p
  FROM observed o LEFT JOIN null_count USING (from_state, to_state))"""
    tested = _with(
        DECODED, SUBJECTS, RUNS, TRANSITIONS, pooled,
        _permuted(transition_b, transition_seed, "[0]"), null_transitions,
        _bh("tested", "p", "from_state, to_state"))
    columns = """
SELECT from_state, to_state, c_td::BIGINT AS td_count, round(p_td, 6) AS td_probability,
       c_dys::BIGINT AS dyslexia_count, round(p_dys, 6) AS dyslexia_probability,
       round(diff, 6) AS difference, round(p, 6) AS permutation_p_value,
       round(fdr, 6) AS fdr_adjusted_p_value, valid AS valid_permutations,
       fdr < 0.05 AS significant_fdr_0_05, abs(diff) >= 0.075 AS large_descriptive_difference,
       CASE WHEN diff IS NULL THEN 'Not estimable' WHEN diff > 0 THEN 'Higher in Dyslexia'
            WHEN diff < 0 THEN 'Higher in TD' ELSE 'No difference' END AS direction
FROM adjusted"""
    q["transition_permutation_test"] = tested + columns
    q["large_transition_differences"] = tested + columns + " WHERE abs(diff) >= 0.075"
    q["transition_differences_from_half_percent"] = tested + columns + " WHERE abs(diff) >= 0.005"

    positions = f"""
numbered_subjects AS (
  SELECT subject_id, grp, row_number() OVER (PARTITION BY grp ORDER BY
           {_residue("md5(subject_id::VARCHAR)", 1)}, subject_id) - 1 AS position
  FROM subjects),
sizes AS (SELECT grp, count(*) AS n FROM subjects GROUP BY grp),
slots AS (
  SELECT subject_id, grp, n,
         {_residue("md5(concat_ws('|', grp, subject_id))", 1)} AS x,
         {_residue("md5(concat_ws('|', grp, subject_id))", 13)} AS y
  FROM subjects JOIN sizes USING (grp))"""
    q["transition_bootstrap_ci"] = _with(
        DECODED, SUBJECTS, RUNS, TRANSITIONS, positions,
        _coefficients("c1", bootstrap_b, bootstrap_seed, "[0]", 1),
        _coefficients("c2", bootstrap_b, bootstrap_seed, "[0]", 2), f"""
draws AS (
  SELECT c1.b, slots.grp,
         ({_polynomial("x", "y", "c1")} * {PRIME} + {_polynomial("x", "y", "c2")}) % n AS position
  FROM slots CROSS JOIN c1 JOIN c2 ON c1.b = c2.b),
weights AS (
  SELECT d.b, s.subject_id, s.grp, count(*) AS w
  FROM draws d JOIN numbered_subjects s ON s.grp = d.grp AND s.position = d.position GROUP BY ALL),
boot_counts AS (
  SELECT b, c.grp, from_state, to_state, sum(w * cnt) AS c
  FROM weights JOIN subject_counts c USING (subject_id) GROUP BY ALL),
boot AS (
  SELECT b, from_state, to_state,
         max(p) FILTER (WHERE grp = 'TD') AS p_td, max(p) FILTER (WHERE grp = 'Dyslexia') AS p_dys
  FROM (SELECT *, c / nullif(sum(c) OVER (PARTITION BY b, grp, from_state), 0) AS p FROM boot_counts)
  GROUP BY ALL)""") + """
SELECT from_state, to_state,
       round(quantile_cont(p_td, 0.025), 6) AS td_ci_lower,
       round(quantile_cont(p_td, 0.975), 6) AS td_ci_upper, count(p_td) AS td_valid_bootstraps,
       round(quantile_cont(p_dys, 0.025), 6) AS dyslexia_ci_lower,
       round(quantile_cont(p_dys, 0.975), 6) AS dyslexia_ci_upper,
       count(p_dys) AS dyslexia_valid_bootstraps,
       round(quantile_cont(p_dys - p_td, 0.025), 6) AS difference_ci_lower,
       round(quantile_cont(p_dys - p_td, 0.975), 6) AS difference_ci_upper,
       count(p_dys - p_td) AS difference_valid_bootstraps
FROM boot GROUP BY ALL"""

    q["wide_state_sequences"] = _with(DECODED) + "SELECT subject_id, grp AS \"group\", file, " + ", ".join(
        f"(max(state) FILTER (WHERE timepoint = {t}))::BIGINT AS t{t}" for t in range(1, width + 1)
    ) + " FROM decoded GROUP BY ALL"

    q["occupancy_wide"] = _with(DECODED, SUBJECTS, OCCUPANCY) + "SELECT subject_id, grp AS \"group\", file, " + ", ".join(
        f"round(max(occupancy_percent) FILTER (WHERE state = {s}), 6) AS state_{s}"
        for s in range(1, K + 1)
    ) + " FROM occupancy GROUP BY ALL"

    q["labeling_agreement"] = _with(DECODED.replace(
        "END AS state", "END AS state,\n         least(5, greatest(1, 1 + floor(value / 20)::BIGINT)) AS other"
    ), """
cells AS (SELECT state, other, count(*) AS n FROM decoded GROUP BY ALL),
parts AS (
  SELECT (SELECT sum(n * (n - 1) / 2) FROM cells) AS c,
         (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM cells GROUP BY state)) AS a,
         (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM cells GROUP BY other)) AS b,
         (SELECT sum(n) * (sum(n) - 1) / 2 FROM cells) AS t)""") + """
SELECT round((c - a * b / t) / (0.5 * (a + b) - a * b / t), 6) AS ari FROM parts"""
    q["ordered_transition_comparison"] = f"""
SELECT * FROM ({q["transition_permutation_test"]}) t
LEFT JOIN ({q["transition_bootstrap_ci"]}) b USING (from_state, to_state)"""
    return q
