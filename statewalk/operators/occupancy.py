"""State occupancy: per subject, per group, and the label-permutation test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewalk import config
from statewalk.functions.stats import benjamini_hochberg, exact_quantiles, significant
from statewalk.operators.resample import group_sizes, permutation_cuts, permuted_sums

TIE_DIGITS = 10


def subject_occupancy(decoded: DataFrame, k: int) -> DataFrame:
    """Share of timepoints per state, zeros included: one aggregation with one counter per state
    (a very long subject is reduced map-side), then one row per state."""
    counts = decoded.groupBy("subject_id", "group", "file").agg(
        F.count(F.lit(1)).alias("n_timepoints"),
        *[F.count_if(F.col("state") == s).alias(f"s{s}") for s in range(1, k + 1)],
    )
    rows = F.array(
        *[F.struct(F.lit(s).alias("state"), F.col(f"s{s}").alias("n")) for s in range(1, k + 1)]
    )
    return counts.select(
        "subject_id", "group", "file", "n_timepoints", F.explode(rows).alias("r")
    ).select(
        "subject_id", "group", "file", "n_timepoints", "r.state",
        F.col("r.n").alias("n_state"),
        (F.col("r.n") / F.col("n_timepoints")).alias("occupancy_fraction"),
        (F.col("r.n") / F.col("n_timepoints") * 100.0).alias("occupancy_percent"),
    )


def occupancy_wide(occupancy: DataFrame, k: int) -> DataFrame:
    """One row per subject, one percent column per state."""
    return occupancy.groupBy("subject_id", "group", "file").agg(
        *[
            F.max(F.when(F.col("state") == s, F.col("occupancy_percent"))).alias(f"state_{s}")
            for s in range(1, k + 1)
        ]
    )


def occupancy_violations(occupancy: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Subjects whose percentages do not add up to 100."""
    return occupancy_totals(occupancy, tolerance).filter(~F.col("complete")).drop("complete")


def occupancy_totals(occupancy: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Sum of the percentages per subject, and whether it is 100."""
    totals = occupancy.groupBy("subject_id").agg(F.sum("occupancy_percent").alias("total_percent"))
    return totals.withColumn("complete", F.abs(F.col("total_percent") - 100.0) <= tolerance)


def check_occupancy(occupancy: DataFrame) -> None:
    """Every subject's percentages must add up to 100."""
    wrong = occupancy_violations(occupancy).limit(5).collect()
    if wrong:
        raise ValueError("occupancy does not add up to 100 for subjects " + ", ".join(str(r["subject_id"]) for r in wrong))


def group_occupancy_summary(
    occupancy: DataFrame, n_subjects: int | None = None
) -> DataFrame:
    """n, mean, sd, standard error, quartiles and range per group and state."""
    keys = ["group", "state"]
    value = F.col("occupancy_percent")
    moments = occupancy.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_participants"), F.avg(value).alias("mean_percent"),
        F.stddev_samp(value).alias("sd_percent"),
        F.min(value).alias("minimum"), F.max(value).alias("maximum"),
    )
    if n_subjects is None:
        n_subjects = sum(group_sizes(occupancy.filter(F.col("state") == 1)))
    quartiles = exact_quantiles(
        occupancy, keys, "occupancy_percent", [0.25, 0.5, 0.75],
        ["q25", "median_percent", "q75"], distinct_bound=n_subjects,
    )
    return moments.join(quartiles, keys).select(
        *keys, "n_participants", "mean_percent", "sd_percent",
        (F.col("sd_percent") / F.sqrt("n_participants")).alias("se_percent"),
        "median_percent", "q25", "q75", "minimum", "maximum",
    )


def occupancy_bars(
    summary: DataFrame,
    groups: tuple[str, str] = (config.REFERENCE_GROUP, config.TARGET_GROUP),
) -> DataFrame:
    """Mean and standard error per state with one pair of columns per group, as bar charts need
    them; a (group, state) cell that occurs twice is an error."""
    columns = []
    for g in groups:
        here = F.col("group") == g
        once = F.count_if(here) == 1
        for name in ("mean_percent", "se_percent"):
            value = F.max(F.when(here, F.col(name)))
            columns.append(
                F.when(once, value)
                .otherwise(F.raise_error(F.lit("a bar needs one row per group and state")))
                .cast("double").alias(f"{g.lower()}_{name}")
            )
    return summary.groupBy("state").agg(*columns)


def occupancy_permutation_test(
    occupancy: DataFrame,
    k: int,
    replicates: int = config.OCCUPANCY_PERMUTATIONS,
    seed: int = config.OCCUPANCY_SEED,
    reference: str = config.REFERENCE_GROUP,
    target: str = config.TARGET_GROUP,
) -> DataFrame:
    """Two-sided test of mean(target) - mean(reference) per state; every state has its own stream
    (seed + state), p = (1 + #{|null| >= |observed|}) / (1 + replicates)."""
    subjects = occupancy.filter(F.col("state") == 1)
    n_ref, n_target = group_sizes(subjects, reference, target)
    cuts = permutation_cuts(
        subjects, n_ref + n_target, n_target, replicates, seed, tuple(range(1, k + 1))
    )
    value = F.col("occupancy_percent")
    is_ref, is_target = F.col("group") == reference, F.col("group") == target
    observed = occupancy.groupBy("state").agg(
        F.avg(F.when(is_ref, value)).alias("mean_td_percent"),
        F.stddev_samp(F.when(is_ref, value)).alias("sd_td"),
        F.avg(F.when(is_target, value)).alias("mean_dyslexia_percent"),
        F.stddev_samp(F.when(is_target, value)).alias("sd_dyslexia"),
    ).withColumn(
        "mean_difference", F.col("mean_dyslexia_percent") - F.col("mean_td_percent")
    )
    null = (
        permuted_sums(occupancy, "occupancy_percent", cuts, replicates, n_ref + n_target, "state")
        .select(
            F.col("stream").cast(occupancy.schema["state"].dataType).alias("state"),
            F.round(
                F.abs(F.col("in_target") / n_target - F.col("in_reference") / n_ref), TIE_DIGITS
            ).alias("null_size"),
        )
    )
    # One observed row per state, k rows in all.
    extreme = (
        null.join(F.broadcast(observed.select("state", "mean_difference")), "state")
        .groupBy("state")
        .agg(
            F.count_if(
                F.col("null_size") >= F.round(F.abs("mean_difference"), TIE_DIGITS)
            ).alias("n_extreme")
        )
    )
    tested = observed.join(extreme, "state").withColumn(
        "permutation_p_value", (F.col("n_extreme") + 1) / F.lit(replicates + 1)
    )
    adjusted = benjamini_hochberg(
        tested, "permutation_p_value", "fdr_adjusted_p_value", ["state"]
    )
    return adjusted.select(
        "state", "mean_td_percent", "sd_td", "mean_dyslexia_percent", "sd_dyslexia",
        "mean_difference", "permutation_p_value", "fdr_adjusted_p_value",
        significant(F.col("fdr_adjusted_p_value")).alias("significant_fdr_0_05"),
    )


def wide_state_sequences(decoded: DataFrame, width: int = config.DURATION_CAP) -> DataFrame:
    """Subject x time table of the first ``width`` timepoints, NULL after a sequence ends. Only the
    first ``width`` rows of a subject take part, so no group is large."""
    return (
        decoded.filter(F.col("timepoint") <= width)
        .groupBy("subject_id", "group", "file")
        .pivot("timepoint", list(range(1, width + 1)))
        .agg(F.first("state"))
        .select("subject_id", "group", "file",
                *[F.col(str(t)).alias(f"t{t}") for t in range(1, width + 1)])
    )
