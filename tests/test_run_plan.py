"""Runs come from one shuffle of the rows; only subjects of several slices look at other slices."""

import random

from statewalk.operators import runs


def sequences(spark, lengths):
    rng = random.Random(5)
    rows = [
        (subject, "TD", f"s{subject}", t, rng.choice((1, 1, 1, 2)))
        for subject, n in enumerate(lengths)
        for t in range(1, n + 1)
    ]
    return rows, spark.createDataFrame(
        rows, "subject_id bigint, `group` string, file string, timepoint bigint, state int"
    )


def by_hand(rows):
    found = {}
    for subject, _, _, _, state in rows:
        own = found.setdefault(subject, [])
        if own and own[-1][0] == state:
            own[-1][1] += 1
        else:
            own.append([state, 1])
    return sorted(
        (subject, state, at, len(own), n) for subject, own in found.items() for at, (state, n) in enumerate(own, 1)
    )


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_not_joined_or_grouped_again(spark):
    rows, decoded = sequences(spark, [7, 1, 12, 8])
    found = runs.state_runs(decoded, 100)
    plan = plan_of(found)
    assert "Join" not in plan and "HashAggregate" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert sorted((r["subject_id"], r["state"], r["run_index"], r["n_runs"], r["duration"]) for r in found.collect()) == by_hand(rows)


def test_long_subjects_among_short_ones(spark):
    rows, decoded = sequences(spark, [1, 2, 3, 4, 5, 29, 30, 31, 64])
    for slice_rows in (1, 2, 4, 5, 30):
        found = runs.state_runs(decoded, slice_rows)
        assert "SortMergeJoin" not in plan_of(found)
        got = sorted((r["subject_id"], r["state"], r["run_index"], r["n_runs"], r["duration"]) for r in found.collect())
        assert got == by_hand(rows)
