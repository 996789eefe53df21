"""Agreement of many runs by counters, checks of lengths and percentages, matrices of transitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from statewalk.functions.stats import adjusted_rand_index
from statewalk.model import match
from statewalk.operators import occupancy, transitions, validate


def plain_rand(x, y):
    cells = {}
    for a, b in zip(x, y, strict=True):
        cells[a, b] = cells.get((a, b), 0) + 1
    pairs = lambda v: sum(n * (n - 1) / 2 for n in v)
    rows = [sum(n for (a, _), n in cells.items() if a == i) for i in set(x)]
    columns = [sum(n for (_, b), n in cells.items() if b == j) for j in set(y)]
    total = len(x) * (len(x) - 1) / 2
    expected = pairs(rows) * pairs(columns) / total
    return (pairs(cells.values()) - expected) / (0.5 * (pairs(rows) + pairs(columns)) - expected)


def test_counter_grows_with_labels():
    rng = np.random.default_rng(1)
    labels = np.concatenate([rng.integers(2, 4, (50, 3)), rng.integers(-1, 7, (70, 3))])
    counter = match.Contingency(3)
    for part in np.array_split(labels, 7):
        counter.add(part)
    rows = counter.rows([5, 6, 9])
    assert rows["n"].sum() == 3 * 120
    for r in rows.itertuples():
        a, b = [5, 6, 9].index(r.run_a), [5, 6, 9].index(r.run_b)
        assert r.n == ((labels[:, a] == r.label_a) & (labels[:, b] == r.label_b)).sum()


def test_fifty_runs(spark):
    rng = np.random.default_rng(2)
    labels = rng.integers(1, 5, (400, 50))
    labels[:, 7] = labels[:, 3]
    df = spark.createDataFrame([(i, [int(v) for v in r]) for i, r in enumerate(labels)], "subject_id long, labels array<int>")
    runs = list(range(1, 51))
    found = match.pair_agreement(df.repartition(5), runs)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString().split("MapInPandas")[1]
    got = {(r["run_a"], r["run_b"]): r["ari"] for r in found.collect()}
    assert len(got) == 1225 and got[4, 8] == pytest.approx(1)
    for a, b in ((1, 2), (10, 50), (49, 50)):
        assert got[a, b] == pytest.approx(plain_rand(labels[:, a - 1].tolist(), labels[:, b - 1].tolist()))
    one = df.select(F.col("labels")[0].alias("x"), F.col("labels")[1].alias("y"))
    assert adjusted_rand_index(one, "x", "y").first()["ari"] == pytest.approx(got[1, 2])


def test_pair_table_carries_starts(spark):
    fits = spark.createDataFrame([(1, 4, 40, -9.0), (2, 7, 70, -8.0)], "run int, start int, seed bigint, log_lik double")
    pairs = spark.createDataFrame([(1, 2, 0.5)], "run_a int, run_b int, ari double")
    row = match.with_starts(pairs, fits).first()
    assert (row["start_a"], row["seed_a"], row["start_b"], row["seed_b"], row["log_lik_b"]) == (4, 40, 7, 70, -8.0)


def test_empty_labels(spark):
    none = spark.createDataFrame([], "subject_id long, labels array<int>")
    assert match.pair_agreement(none, [1, 2, 3]).isEmpty()


def test_lengths_and_percentages(spark):
    rows = spark.createDataFrame([(1,), (1,), (2,)], "subject_id bigint")
    good = spark.createDataFrame([(1, 2), (2, 1)], "subject_id bigint, n_timepoints bigint")
    validate.check_lengths(good, rows)
    with pytest.raises(ValueError, match="add up to 3, but there are 2"):
        validate.check_lengths(good, rows.limit(2))
    shares = spark.createDataFrame([(1, 40.0), (1, 60.0), (2, 99.0)], "subject_id bigint, occupancy_percent double")
    with pytest.raises(ValueError, match="subjects 2"):
        occupancy.check_occupancy(shares)
    occupancy.check_occupancy(shares.filter("subject_id = 1"))


def test_difference_matrix_has_no_diagonal(spark, sf_dir):
    from statewalk.plans import catalog

    counts = catalog._counts(spark, sf_dir)
    rows = transitions.difference_matrix(counts, catalog.K).collect()
    assert len(rows) == catalog.K
    for r in rows:
        assert r[f"to_{r['from_state']}"] is None
        assert sum(r[f"to_{j}"] for j in range(1, catalog.K + 1) if j != r["from_state"]) == pytest.approx(0, abs=1e-9)
