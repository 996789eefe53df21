"""Sojourn durations: group summary, smoothed distributions and the KL permutation test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statewalk import config
from statewalk.functions.labels import interpretation_note
from statewalk.functions.stats import benjamini_hochberg, exact_quantiles, significant
from statewalk.operators.resample import group_sizes, permutation_cuts, with_permuted_label

TIE_DIGITS = 10


def duration_counts(runs: DataFrame) -> DataFrame:
    """Complete runs folded to (subject, state, duration, n): everything below works on this."""
    return (
        runs.filter(F.col("duration") > 0)
        .groupBy("subject_id", "group", "state", "duration")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _state_grid(df: DataFrame, k: int, groups: tuple[str, ...]) -> DataFrame:
    """groups x states; a fixed handful of rows."""
    cells = [(g, s) for g in groups for s in range(1, k + 1)]
    return df.sparkSession.createDataFrame(cells, "`group` string, state int")


def sojourn_group_summary(
    runs: DataFrame,
    subjects: DataFrame,
    k: int,
    reference: str = config.REFERENCE_GROUP,
    target: str = config.TARGET_GROUP,
) -> DataFrame:
    """Duration summary per group and state; cells without runs have n = 0 and NULL statistics.

    Sums over integer durations are exact. Durations of N timepoints take at most sqrt(2N)
    distinct values, so the weighted quantile buffer stays small.
    """
    counts = duration_counts(runs)
    keys = ["group", "state"]
    d, n = F.col("duration"), F.col("n")
    wide = "decimal(38,0)"
    folded = counts.groupBy(*keys).agg(
        F.count_distinct("subject_id").alias("n_participants_with_complete_runs"),
        F.sum("n").alias("n_complete_runs"),
        F.sum((d * n).cast("decimal(20,0)")).cast(wide).alias("__s1"),
        F.sum((d * d * n).cast("decimal(20,0)")).cast(wide).alias("__s2"),
        F.min(d).alias("minimum"), F.max(d).alias("maximum"),
    )
    total = F.col("n_complete_runs").cast("double")
    mean = F.col("__s1").cast("double") / total
    variance = (
        F.col("__s2").cast("double") - F.col("__s1").cast("double") * mean
    ) / F.when(total > 1, total - 1)
    quartiles = exact_quantiles(
        counts, keys, "duration", [0.25, 0.5, 0.75],
        ["iqr_low", "median_duration", "iqr_high"], weight="n",
        distinct_bound=config.QUANTILE_VALUES,
    )
    totals = subjects.groupBy("group").agg(F.count(F.lit(1)).alias("n_total_participants"))
    stats = folded.join(quartiles, keys).select(
        *keys, "n_participants_with_complete_runs", "n_complete_runs",
        mean.alias("mean_duration"),
        F.sqrt(F.when(variance < 0, 0.0).otherwise(variance)).alias("standard_deviation"),
        "median_duration", "iqr_low", "iqr_high", "minimum", "maximum",
    )
    return (
        _state_grid(runs, k, (reference, target))
        .join(totals, "group", "left").join(stats, keys, "left")
        .select(
            *keys,
            F.coalesce("n_total_participants", F.lit(0)).alias("n_total_participants"),
            *[
                F.coalesce(c, F.lit(0)).alias(c)
                for c in ("n_participants_with_complete_runs", "n_complete_runs")
            ],
            "mean_duration", "standard_deviation", "median_duration", "iqr_low", "iqr_high",
            "minimum", "maximum",
        )
    )


def capped_counts(runs: DataFrame, cap: int = config.DURATION_CAP) -> DataFrame:
    """(subject, group, state, bin, n) with durations pooled at the cap."""
    return duration_counts(runs).groupBy(
        "subject_id", "group", "state",
        F.least(F.col("duration"), F.lit(cap)).cast("int").alias("bin"),
    ).agg(F.sum("n").alias("n"))


def with_bin_count(binned: DataFrame) -> DataFrame:
    """Adds ``n_bins``: the common support 1..n_bins over all groups and states."""
    return binned.withColumn("n_bins", binned.agg(F.max("bin")).scalar())


def duration_distribution(
    runs: DataFrame, alpha: float = config.SOJOURN_ALPHA, cap: int = config.DURATION_CAP
) -> DataFrame:
    """Smoothed duration probabilities per group, state and bin: (n + a) / (N + a * bins).
    At most groups x states x cap rows."""
    cells = with_bin_count(
        capped_counts(runs, cap).groupBy("group", "state", "bin").agg(F.sum("n").alias("n"))
    )
    support = cells.groupBy("group", "state", "n_bins").agg(F.sum("n").alias("n_runs")).withColumn(
        "bin", F.explode(F.sequence(F.lit(1), F.col("n_bins")))
    )
    count = F.coalesce(F.col("n"), F.lit(0))
    return support.join(cells.drop("n_bins"), ["group", "state", "bin"], "left").select(
        "group", "state", "bin", count.alias("n"), "n_runs",
        ((count + alpha) / (F.col("n_runs") + alpha * F.col("n_bins"))).alias("probability"),
    )


def _kl_aggregate(target: Column, reference: Column, alpha: float) -> list[Column]:
    """Pieces of KL(target || reference) over the bins that occur at all. The expression needs the
    totals, so logs of the smoothed counts are summed and finished in ``_kl_finish``."""
    ratio = F.log((target + alpha) / (reference + alpha))
    return [
        F.sum(target).alias("__nt"), F.sum(reference).alias("__nr"),
        F.sum((target + alpha) * ratio).alias("__w"), F.count(F.lit(1)).alias("__seen"),
    ]


def _kl_finish(alpha: float) -> Column:
    """sum p ln(p/q) with p = (t+a)/T, q = (r+a)/R equals (1/T) sum (t+a) ln((t+a)/(r+a)) + ln(R/T);
    bins without any run add nothing to the sum because both counts are equal there."""
    t_total = F.col("__nt") + alpha * F.col("n_bins")
    r_total = F.col("__nr") + alpha * F.col("n_bins")
    return F.col("__w") / t_total + F.log(r_total / t_total)


def observed_kl(
    runs: DataFrame,
    k: int,
    alpha: float = config.SOJOURN_ALPHA,
    cap: int = config.DURATION_CAP,
    min_runs: int = 1,
    min_participants: int = 1,
    reference: str = config.REFERENCE_GROUP,
    target: str = config.TARGET_GROUP,
) -> DataFrame:
    """KL(target || reference) of the duration distributions per state, NULL if not estimable."""
    binned = with_bin_count(capped_counts(runs, cap))
    is_ref, is_target = F.col("group") == reference, F.col("group") == target
    people = binned.groupBy("state").agg(
        F.sum(F.when(is_ref, F.col("n"))).alias("n_td"),
        F.sum(F.when(is_target, F.col("n"))).alias("n_dyslexia"),
        F.count_distinct(F.when(is_ref, F.col("subject_id"))).alias("p_td"),
        F.count_distinct(F.when(is_target, F.col("subject_id"))).alias("p_dyslexia"),
    )
    divergence = (
        binned.groupBy("state", "bin", "n_bins").agg(
            F.sum(F.when(is_target, F.col("n")).otherwise(0)).alias("t"),
            F.sum(F.when(is_ref, F.col("n")).otherwise(0)).alias("r"),
        )
        .groupBy("state", "n_bins").agg(*_kl_aggregate(F.col("t"), F.col("r"), alpha))
        .select("state", _kl_finish(alpha).alias("kl"))
    )
    grid = runs.sparkSession.createDataFrame([(s,) for s in range(1, k + 1)], "state int")
    counts = {
        "n_td_complete_runs": "n_td", "n_dyslexia_complete_runs": "n_dyslexia",
        "n_td_participants_with_runs": "p_td", "n_dyslexia_participants_with_runs": "p_dyslexia",
    }
    out = grid.join(people, "state", "left").join(divergence, "state", "left").select(
        "state", "kl", *[F.coalesce(F.col(c), F.lit(0)).alias(n) for n, c in counts.items()]
    )
    estimable = (
        (F.col("n_td_complete_runs") >= min_runs)
        & (F.col("n_dyslexia_complete_runs") >= min_runs)
        & (F.col("n_td_participants_with_runs") >= min_participants)
        & (F.col("n_dyslexia_participants_with_runs") >= min_participants)
    )
    return out.select(
        "state", *counts, estimable.alias("estimable_between_group_kl"),
        F.when(estimable, F.col("kl")).alias("kl_dyslexia_to_td"),
    )


def kl_permutation_test(
    runs: DataFrame,
    subjects: DataFrame,
    k: int,
    replicates: int = config.SOJOURN_PERMUTATIONS,
    seed: int = config.SOJOURN_SEED,
    alpha: float = config.SOJOURN_ALPHA,
    cap: int = config.DURATION_CAP,
    min_runs: int = 1,
    min_participants: int = 1,
    reference: str = config.REFERENCE_GROUP,
    target: str = config.TARGET_GROUP,
) -> DataFrame:
    """Right-tailed permutation test of the KL divergence. One label permutation per replicate is
    shared by all states; replicates in which a group has too few runs do not count."""
    n_ref, n_target = group_sizes(subjects, reference, target)
    cuts = permutation_cuts(subjects, n_ref + n_target, n_target, replicates, seed)
    observed = observed_kl(
        runs, k, alpha, cap, min_runs, min_participants, reference, target
    )
    binned = with_bin_count(capped_counts(runs, cap))
    # One row per subject with its cells (at most k * cap), so that a label is worked out once per
    # subject and replicate. ``person`` marks one cell per state to count participants by a sum.
    first_bin = F.min("bin").over(Window.partitionBy("subject_id", "state")) == F.col("bin")
    nested = (
        binned.withColumn("person", first_bin.cast("int"))
        .groupBy("subject_id", "n_bins")
        .agg(F.collect_list(F.struct("state", "bin", "n", "person")).alias("cells"))
    )
    n, person = F.col("n"), F.col("person")
    null = (
        with_permuted_label(nested, cuts, replicates, n_ref + n_target, rows_per_subject=k)
        .select("b", "is_target", "n_bins", F.explode("cells").alias("cell"))
        .select("b", "is_target", "n_bins", "cell.*")
        .groupBy("b", "state", "bin", "n_bins")
        .agg(
            F.sum(F.when(F.col("is_target"), n).otherwise(0)).alias("t"),
            F.sum(F.when(~F.col("is_target"), n).otherwise(0)).alias("r"),
            F.sum(F.when(F.col("is_target"), person).otherwise(0)).alias("pt"),
            F.sum(F.when(~F.col("is_target"), person).otherwise(0)).alias("pr"),
        )
        .groupBy("b", "state", "n_bins")
        .agg(
            *_kl_aggregate(F.col("t"), F.col("r"), alpha),
            F.sum("pt").alias("pt"), F.sum("pr").alias("pr"),
        )
        .filter(
            (F.col("__nt") >= min_runs) & (F.col("__nr") >= min_runs)
            & (F.col("pt") >= min_participants) & (F.col("pr") >= min_participants)
        )
        .select("state", _kl_finish(alpha).alias("null_kl"))
    )
    counted = (
        null.join(
            F.broadcast(
                observed.filter("estimable_between_group_kl").select("state", "kl_dyslexia_to_td")
            ),
            "state",
        )
        .groupBy("state")
        .agg(
            F.count(F.lit(1)).alias("valid"),
            F.count_if(
                F.round("null_kl", TIE_DIGITS) >= F.round("kl_dyslexia_to_td", TIE_DIGITS)
            ).alias("extreme"),
        )
    )
    is_ref, is_target = F.col("group") == reference, F.col("group") == target
    means = duration_counts(runs).groupBy("state").agg(
        *[
            (
                F.sum(F.when(c, F.col("duration") * F.col("n")))
                / F.sum(F.when(c, F.col("n")))
            ).alias(name)
            for c, name in ((is_ref, "mean_td_duration"), (is_target, "mean_dyslexia_duration"))
        ]
    )
    tested = (
        observed.join(means, "state", "left").join(counted, "state", "left")
        .withColumn("valid_permutations", F.coalesce("valid", F.lit(0)))
        .withColumn(
            "permutation_p_value",
            (F.col("extreme") + 1) / F.when(F.col("valid") > 0, F.col("valid") + 1),
        )
    )
    adjusted = benjamini_hochberg(
        tested, "permutation_p_value", "fdr_adjusted_p_value", ["state"]
    )
    return adjusted.select(
        "state", "n_td_complete_runs", "n_dyslexia_complete_runs",
        "n_td_participants_with_runs", "n_dyslexia_participants_with_runs",
        "mean_td_duration", "mean_dyslexia_duration",
        (F.col("mean_dyslexia_duration") - F.col("mean_td_duration")).alias("mean_difference"),
        "estimable_between_group_kl", "kl_dyslexia_to_td", "valid_permutations",
        "permutation_p_value", "fdr_adjusted_p_value",
        significant(F.col("fdr_adjusted_p_value")).alias("significant_fdr_0_05"),
        interpretation_note(F.col("estimable_between_group_kl")).alias("interpretation_note"),
    )
