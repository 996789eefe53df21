"""Decoded-sequence operators on a small hand-computed fixture and under forced splitting."""

import math

import pytest
from pyspark.sql import functions as F

from statewalk.functions import stats
from statewalk.functions.labels import standardize_group
from statewalk.operators import occupancy, resample, runs, sojourn, transitions, validate
from statewalk.operators.ordering import ordered_index
from statewalk.plans import views

SEQUENCES = {
    1: ("TD", [1, 1, 2, 2, 2, 1, 3, 3]),
    2: ("TD", [2, 2, 1, 1, 1, 1, 2, 2]),
    3: ("Dyslexia", [1, 2, 2, 3, 3, 3, 1, 1]),
    4: ("Dyslexia", [3] * 8),
}


@pytest.fixture(scope="module")
def decoded(spark):
    rows = [
        (sid, group, f"s{sid}", t, state)
        for sid, (group, states) in SEQUENCES.items()
        for t, state in enumerate(states, 1)
    ]
    return spark.createDataFrame(
        rows, "subject_id bigint, `group` string, file string, timepoint bigint, state int"
    )


def run_list(df, sid, order):
    return [
        (r["state"], r["duration"])
        for r in df.filter(F.col("subject_id") == sid).orderBy(order).collect()
    ]


@pytest.mark.parametrize("slice_rows", [2, 3, 4, 8, 1000])
def test_runs_do_not_depend_on_slices(decoded, slice_rows):
    found = runs.state_runs(decoded, slice_rows)
    assert run_list(found, 1, "run_index") == [(1, 2), (2, 3), (1, 1), (3, 2)]
    assert run_list(found, 2, "run_index") == [(2, 2), (1, 4), (2, 2)]
    assert run_list(found, 3, "run_index") == [(1, 1), (2, 2), (3, 3), (1, 2)]
    assert run_list(found, 4, "run_index") == [(3, 8)]
    complete = runs.complete_runs(found)
    assert run_list(complete, 1, "complete_run_index") == [(2, 3), (1, 1)]
    assert run_list(complete, 2, "complete_run_index") == [(1, 4)]
    assert run_list(complete, 3, "complete_run_index") == [(2, 2), (3, 3)]
    assert run_list(complete, 4, "complete_run_index") == []


def test_occupancy(decoded):
    occ = occupancy.subject_occupancy(decoded, 3)
    got = {(r["subject_id"], r["state"]): r["occupancy_percent"] for r in occ.collect()}
    want = {1: (37.5, 37.5, 25), 2: (50, 50, 0), 3: (37.5, 25, 37.5), 4: (0, 0, 100)}
    assert got == {(s, k + 1): v for s, vs in want.items() for k, v in enumerate(vs)}
    assert occupancy.occupancy_violations(occ).isEmpty()


@pytest.mark.parametrize("slice_rows", [3, 1000])
def test_transitions(decoded, slice_rows):
    counts = transitions.subject_counts(decoded, 3, slice_rows)
    pooled = {
        (r["group"], r["from_state"], r["to_state"]): (r["transition_count"], r["probability"])
        for r in transitions.group_transition_matrices(counts, 3).collect()
    }
    assert [pooled["TD", 1, j] for j in (1, 2, 3)] == [(0, 0.0), (2, 2 / 3), (1, 1 / 3)]
    assert [pooled["TD", 2, j] for j in (1, 2, 3)] == [(2, 1.0), (0, 0.0), (0, 0.0)]
    assert [pooled["TD", 3, j][1] for j in (1, 2, 3)] == [None] * 3
    diff = {
        (r["from_state"], r["to_state"]): r["difference"]
        for r in transitions.transition_difference(counts, 3).collect()
    }
    assert diff[1, 2] == pytest.approx(1 / 3) and diff[1, 3] == pytest.approx(-1 / 3)
    assert diff[2, 1] == -1 and diff[2, 3] == 1 and diff[3, 1] is None and diff[3, 2] is None
    table = transitions.subject_transition_table(counts, 3)
    assert table.count() == 4 * 6
    assert table.filter("subject_id = 4 and conditional_probability is not null").isEmpty()


def test_duration_divergence(decoded):
    complete = runs.complete_runs(runs.state_runs(decoded))
    got = {r["state"]: r for r in sojourn.observed_kl(complete, 3).collect()}
    assert got[2]["kl_dyslexia_to_td"] == pytest.approx(6.881229859875717, abs=1e-12)
    assert got[1]["kl_dyslexia_to_td"] is None and got[3]["kl_dyslexia_to_td"] is None
    capped = sojourn.duration_distribution(complete, cap=2)
    assert capped.agg(F.max("bin")).first()[0] == 2
    summary = sojourn.sojourn_group_summary(complete, validate.subject_information(decoded), 3)
    cell = summary.filter("`group` = 'Dyslexia' and state = 1").first()
    assert cell["n_complete_runs"] == 0 and cell["mean_duration"] is None
    assert cell["n_total_participants"] == 2
    one = summary.filter("`group` = 'TD' and state = 2").first()
    assert one["n_complete_runs"] == 1 and one["standard_deviation"] is None


def test_permutation_tests_stay_in_range(decoded):
    occ = occupancy.subject_occupancy(decoded, 3)
    rows = occupancy.occupancy_permutation_test(occ, 3, replicates=60).collect()
    assert len(rows) == 3
    for r in rows:
        assert 1 / 61 <= r["permutation_p_value"] <= 1
        assert r["fdr_adjusted_p_value"] >= r["permutation_p_value"] - 1e-12
    counts = transitions.subject_counts(decoded, 3)
    tested = transitions.transition_permutation_test(counts, 3, replicates=60)
    intervals = transitions.transition_bootstrap(counts, 3, replicates=60)
    table = transitions.transition_comparison(tested, intervals).collect()
    assert len(table) == 6 and table[-1]["difference"] is None
    assert table[-1]["direction"] == "Not estimable" and table[-1]["valid_permutations"] == 0
    sizes = [abs(r["difference"]) for r in table if r["difference"] is not None]
    assert sizes == sorted(sizes, reverse=True)
    assert all(r["large_descriptive_difference"] for r in transitions.large_differences(tested).collect())
    complete = runs.complete_runs(runs.state_runs(decoded))
    kl = sojourn.kl_permutation_test(
        complete, validate.subject_information(decoded), 3, replicates=60
    ).collect()
    assert sum(r["estimable_between_group_kl"] for r in kl) == 1


@pytest.mark.parametrize("sigmas", [0.0, 1.0, 6.0])
def test_permutation_cuts_select_exact_group_size(spark, sigmas):
    n, n_target, b = 700, 260, 40
    subjects = spark.range(n).select(F.col("id").alias("subject_id"))
    cuts = resample.permutation_cuts(subjects, n, n_target, b, 99, (0, 3), sigmas=sigmas)
    assert cuts.count() == 2 * b
    labelled = resample.with_permuted_label(
        subjects.withColumn("s", F.explode(F.array(F.lit(0), F.lit(3)))), cuts, b, n, stream="s"
    )
    sizes = labelled.groupBy("s", "b").agg(F.count_if("is_target").alias("n")).collect()
    assert {r["n"] for r in sizes} == {n_target}
    share = labelled.groupBy("subject_id").agg(F.avg(F.col("is_target").cast("int")).alias("m"))
    low, high = share.agg(F.min("m"), F.max("m")).first()
    assert 0.1 < low < n_target / n < high < 0.7


def test_bootstrap_draws_are_stratified(spark):
    rows = [(i, "TD" if i < 30 else "Dyslexia") for i in range(80)]
    subjects = spark.createDataFrame(rows, "subject_id bigint, `group` string")
    numbered = resample.numbered_in_group(subjects, 80, blocks=4)
    positions = numbered.groupBy("group").agg(
        F.min("position").alias("a"), F.max("position").alias("z"),
        F.count_distinct("position").alias("n"),
    )
    assert {(r["group"], r["a"], r["z"], r["n"]) for r in positions.collect()} == {
        ("TD", 0, 29, 30), ("Dyslexia", 0, 49, 50)
    }
    draws = resample.bootstrap_draws(numbered, {"TD": 30, "Dyslexia": 50}, 25, 7)
    per = draws.groupBy("b", "group").agg(
        F.count(F.lit(1)).alias("n"), F.max("position").alias("top"),
        F.count_distinct("position").alias("d"),
    ).collect()
    assert len(per) == 50
    assert all(r["n"] == (30 if r["group"] == "TD" else 50) and r["top"] < r["n"] for r in per)
    assert any(r["d"] < r["n"] for r in per)


@pytest.mark.parametrize("hot_rows", [1, 60, 10**9])
def test_positions_do_not_depend_on_hot_limit(spark, sf_dir, hot_rows):
    want = {
        (r["user_id"], r["event_id"]): r["n"]
        for r in spark.sql(
            f"select user_id, event_id, row_number() over (partition by user_id order by ts, event_id)"
            f" n from parquet.`{sf_dir}/events.parquet`"
        ).collect()
    }
    got = views.ordered_index(
        views.table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), "user_id",
        ["ts", "event_id"],
        {"day": F.col("ts").cast("date"), "second": views._seconds(F.col("ts"))},
        hot_rows=hot_rows,
    ).collect()
    assert {(r["user_id"], r["event_id"]): r["timepoint"] for r in got} == want


def test_one_hot_key(spark):
    df = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")
    )
    got = ordered_index(df, "k", ["v"], {"a": F.floor(F.col("v") / 100), "b": F.floor(F.col("v") / 7)},
                        "n", hot_rows=50)
    assert got.filter("k = 0 and n != floor(v / 3) + 1").isEmpty()
    assert got.filter("k != 0 and n != 1").isEmpty() and got.count() == 900


def test_quantiles_by_histogram(spark):
    rows = [("a", v) for v in (1.0, 2.0, 4.0, 8.0, 16.0)]
    rows += [("b", float((i * 37) % 101) ** 2) for i in range(500)] + [("c", 5.0)] * 7
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.025, 0.25, 0.5, 0.75, 0.975]
    small = stats.exact_quantiles(df, ["g"], "v", probs, distinct_bound=10)
    large = stats.exact_quantiles(df, ["g"], "v", probs, bins=16)
    a = {r["g"]: [r[c] for c in small.columns[1:]] for r in small.collect()}
    b = {r["g"]: [r[c] for c in small.columns[1:]] for r in large.collect()}
    assert a["a"] == pytest.approx([1.1, 2, 4, 8, 15.2])
    for g in a:
        assert a[g] == pytest.approx(b[g])


def test_adjusted_p_values(spark):
    df = spark.createDataFrame(
        [(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.5), (5, None)], "k int, p double"
    )
    got = {r["k"]: r["q"] for r in stats.benjamini_hochberg(df, "p", "q", ["k"]).collect()}
    assert [got[k] for k in (1, 2, 3, 4)] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.5])
    assert got[5] is None


def test_adjusted_rand_index(spark):
    def ari(x, y):
        df = spark.createDataFrame(list(zip(x, y)), "x int, y int")
        return stats.adjusted_rand_index(df, "x", "y").first()["ari"]

    assert ari([1, 1, 2, 2, 3, 3], [2, 2, 1, 1, 1, 3]) == pytest.approx(0.4444444444444444)
    assert ari([1, 1, 2, 2], [2, 2, 1, 1]) == 1
    assert ari([1], [1]) is None
    assert ari([1, 1, 1], [2, 2, 2]) == 1


def test_small_column_functions(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", 2.0)], "g string, v double"
    )
    got = df.select("g", "v", stats.rescale(F.col("v"), 0.0, 10.0, ["g"]).alias("r")).collect()
    assert {(r["g"], r["v"], r["r"]) for r in got} == {("a", 1.0, 0.0), ("a", 3.0, 10.0), ("b", 2.0, 5.0)}
    bad = spark.createDataFrame([(1, 0.5), (1, None), (1, float("nan")), (1, 0.5)], "g int, v double")
    total = bad.select(stats.normalize_probability(F.col("v"), ["g"]).alias("p")).agg(F.sum("p"))
    assert total.first()[0] == pytest.approx(1.0)
    names = spark.createDataFrame([(" Controls ",), ("PATIENTS",), ("Typically Developing",), (" x ",)], "g string")
    assert [r[0] for r in names.select(standardize_group(F.col("g"))).collect()] == [
        "TD", "Dyslexia", "TD", "x"
    ]


def test_validation(spark, decoded):
    validate.check_decoded(decoded, 3)
    with pytest.raises(validate.ValidationError, match="missing"):
        validate.check_decoded(decoded.drop("file"), 3)
    with pytest.raises(validate.ValidationError, match="state"):
        validate.check_decoded(decoded, 2)
    with pytest.raises(validate.ValidationError, match="group"):
        validate.check_decoded(decoded.withColumn("group", F.lit("other")), 3)
    with pytest.raises(validate.ValidationError, match="both groups"):
        validate.check_decoded(decoded.filter("`group` = 'TD'"), 3)
    with pytest.raises(validate.ValidationError, match="rule"):
        validate.check_decoded(decoded.filter("not (subject_id = 1 and timepoint = 3)"), 3)
    text = spark.createDataFrame(
        [("1.9", " td ", "f", "1", "2"), ("x", "td", "f", "2", "NaN")],
        "subject_id string, `group` string, file string, timepoint string, state string",
    )
    rows = validate.coerce_decoded(text).collect()
    assert tuple(rows[0]) == (1, "TD", "f", 1, 2)
    assert rows[1]["subject_id"] is None and rows[1]["state"] is None


def test_wide_sequences_are_padded(decoded):
    row = occupancy.wide_state_sequences(decoded, 10).filter("subject_id = 3").first()
    assert [row[f"t{t}"] for t in range(1, 11)] == SEQUENCES[3][1] + [None, None]


def test_entropy_of_equal_distributions_is_zero(spark, decoded):
    same = decoded.withColumn(
        "subject_id", F.when(F.col("group") == "TD", F.col("subject_id") + 10).otherwise(99)
    ).filter("subject_id != 99")
    twin = same.withColumn("group", F.lit("Dyslexia")).withColumn("subject_id", F.col("subject_id") + 50)
    complete = runs.complete_runs(runs.state_runs(same.unionByName(twin)))
    kl = [r["kl_dyslexia_to_td"] for r in sojourn.observed_kl(complete, 3).collect()]
    assert all(v is None or math.isclose(v, 0.0, abs_tol=1e-12) for v in kl)
