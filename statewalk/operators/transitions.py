"""Run-level transitions: counts, probabilities, permutation test and bootstrap intervals.

A subject is one row with a count per ordered state pair, so zero cells need no completion join.
For replicates that row is unfolded by origin state (k rows with k - 1 destination counts): labels
and draws are worked out once per subject and the sums combine map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewalk import config
from statewalk.functions.labels import direction
from statewalk.functions.stats import benjamini_hochberg, significant
from statewalk.operators.resample import (
    bootstrap_draws,
    group_sizes,
    numbered_in_group,
    permutation_cuts,
    with_permuted_label,
)
from statewalk.operators.runs import ID_COLUMNS, with_previous_state

TIE_DIGITS = 10


def state_pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(1, k + 1) for j in range(1, k + 1) if i != j]


def _cell(i: int, j: int) -> str:
    return f"c_{i}_{j}"


def subject_counts(
    decoded: DataFrame, k: int, slice_rows: int = config.SLICE_ROWS
) -> DataFrame:
    """(subject_id, group, file, c_i_j...): changes of state between neighbouring timepoints."""
    moves = with_previous_state(decoded, slice_rows)
    # Counted long first: one hash update per row whatever k is. A first timepoint has no previous
    # state and keeps subjects without any transition in the result.
    long = moves.groupBy(*ID_COLUMNS, "previous_state", "state").agg(F.count(F.lit(1)).alias("n"))
    return long.groupBy(*ID_COLUMNS).agg(
        *[
            F.sum(
                F.when((F.col("previous_state") == i) & (F.col("state") == j), F.col("n"))
                .otherwise(0)
            ).alias(_cell(i, j))
            for i, j in state_pairs(k)
        ]
    )


def _row_total(i: int, k: int) -> Column:
    cells = [F.col(_cell(i, j)) for j in range(1, k + 1) if j != i]
    return sum(cells[1:], cells[0])


def _probability(i: int, j: int, k: int) -> Column:
    """NULL for a row without transitions."""
    total = _row_total(i, k)
    return F.col(_cell(i, j)) / F.when(total > 0, total)


def subject_transition_table(counts: DataFrame, k: int) -> DataFrame:
    """Long participant table, one row per ordered pair of different states."""
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("from_state"), F.lit(j).alias("to_state"),
                F.col(_cell(i, j)).alias("transition_count"),
                _row_total(i, k).alias("total_transitions_from_state"),
                _probability(i, j, k).alias("conditional_probability"),
            )
            for i, j in state_pairs(k)
        ]
    )
    return counts.select("subject_id", "group", "file", F.explode(rows).alias("r")).select(
        "subject_id", "group", "file", "r.*"
    )


def group_transition_matrices(counts: DataFrame, k: int) -> DataFrame:
    """Pooled counts and probabilities per group, diagonal included (0, or NULL for a row without
    transitions)."""
    rows = []
    for i in range(1, k + 1):
        total = _row_total(i, k)
        for j in range(1, k + 1):
            count = F.lit(0).cast("bigint") if i == j else F.col(_cell(i, j))
            rows.append(
                F.struct(
                    F.lit(i).alias("from_state"), F.lit(j).alias("to_state"),
                    count.alias("transition_count"),
                    (count / F.when(total > 0, total)).alias("probability"),
                )
            )
    pooled = counts.groupBy("group").agg(
        *[F.sum(_cell(i, j)).alias(_cell(i, j)) for i, j in state_pairs(k)]
    )
    return pooled.select("group", F.explode(F.array(*rows)).alias("r")).select("group", "r.*")


def wide_matrices(counts: DataFrame, k: int, value: str) -> DataFrame:
    """One row per group and origin, one column per destination; ``value`` is transition_count or
    probability."""
    long = group_transition_matrices(counts, k)
    return long.groupBy("group", "from_state").agg(
        *[F.max(F.when(F.col("to_state") == j, F.col(value))).alias(f"to_{j}") for j in range(1, k + 1)]
    )


def difference_matrix(
    counts: DataFrame, k: int, reference: str = config.REFERENCE_GROUP, target: str = config.TARGET_GROUP
) -> DataFrame:
    """Target minus reference probabilities, one row per origin and one column per destination. The
    diagonal is NULL, as no run is followed by one of its own state."""
    wide = wide_matrices(counts, k, "probability")

    def of(group: str, j: int) -> Column:
        return F.max(F.when(F.col("group") == group, F.col(f"to_{j}")))

    return wide.groupBy("from_state").agg(
        *[
            F.when(F.col("from_state") != j, of(target, j) - of(reference, j)).alias(f"to_{j}")
            for j in range(1, k + 1)
        ]
    )


def _origins(k: int) -> Column:
    """The count row of a subject as an array with one struct per origin state; d1..d(k-1) are the
    destinations in order, the origin left out."""
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("from_state"),
                *[
                    F.col(_cell(i, j)).alias(f"d{n}")
                    for n, j in enumerate([j for j in range(1, k + 1) if j != i], 1)
                ],
            )
            for i in range(1, k + 1)
        ]
    )


def _destination_sums(k: int, prefix: str, condition: Column | None = None) -> list[Column]:
    out = []
    for n in range(1, k):
        value = F.col(f"d{n}")
        if condition is not None:
            value = F.when(condition, value).otherwise(0)
        out.append(F.sum(value).alias(f"{prefix}{n}"))
    return out


def _differences(pooled: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """Long form of rows (keys, from_state, t1.., r1..): counts, probabilities, difference."""
    t_total = sum((F.col(f"t{n}") for n in range(2, k)), F.col("t1"))
    r_total = sum((F.col(f"r{n}") for n in range(2, k)), F.col("r1"))
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("n"), F.col(f"t{n}").alias("t"), F.col(f"r{n}").alias("r"))
            for n in range(1, k)
        ]
    )
    rows = pooled.select(
        *keys, "from_state", t_total.alias("t_total"), r_total.alias("r_total"), F.inline(cells)
    )
    p_target = F.col("t") / F.when(F.col("t_total") > 0, F.col("t_total"))
    p_reference = F.col("r") / F.when(F.col("r_total") > 0, F.col("r_total"))
    return rows.select(
        *keys, "from_state",
        (F.col("n") + F.when(F.col("n") >= F.col("from_state"), 1).otherwise(0)).alias("to_state"),
        F.col("r").alias("td_count"), p_reference.alias("td_probability"),
        F.col("t").alias("dyslexia_count"), p_target.alias("dyslexia_probability"),
        (p_target - p_reference).alias("difference"),
    )


def transition_difference(
    counts: DataFrame, k: int, target: str = config.TARGET_GROUP
) -> DataFrame:
    """Group counts, probabilities and their difference per ordered pair of different states."""
    in_target = F.col("group") == target
    pooled = counts.select("group", F.inline(_origins(k))).groupBy("from_state").agg(
        *_destination_sums(k, "t", in_target), *_destination_sums(k, "r", ~in_target)
    )
    return _differences(pooled, k, [])


def transition_permutation_test(
    counts: DataFrame,
    k: int,
    replicates: int = config.TRANSITION_PERMUTATIONS,
    seed: int = config.TRANSITION_SEED,
    reference: str = config.REFERENCE_GROUP,
    target: str = config.TARGET_GROUP,
) -> DataFrame:
    """Two-sided cell-wise test; one permutation per replicate is shared by all cells and only
    replicates in which the cell is estimable count."""
    n_ref, n_target = group_sizes(counts, reference, target)
    cuts = permutation_cuts(counts, n_ref + n_target, n_target, replicates, seed)
    observed = transition_difference(counts, k, target)
    stats = counts.select("subject_id", _origins(k).alias("origins"))
    # Every replicate relabels the same subjects, so the reference side is total minus target.
    total = stats.select(F.inline("origins")).groupBy("from_state").agg(
        *_destination_sums(k, "all")
    )
    in_target = (
        with_permuted_label(stats, cuts, replicates, n_ref + n_target).filter("is_target")
        .select("b", F.inline("origins"))
        .groupBy("b", "from_state").agg(*_destination_sums(k, "t"))
    )
    pooled = in_target.join(F.broadcast(total), "from_state").select(
        "b", "from_state", *[F.col(f"t{n}") for n in range(1, k)],
        *[(F.col(f"all{n}") - F.col(f"t{n}")).alias(f"r{n}") for n in range(1, k)],
    )
    null = _differences(pooled, k, ["b"]).select(
        "from_state", "to_state", F.col("difference").alias("null_difference")
    )
    cells = ["from_state", "to_state"]
    counted = (
        # k * (k - 1) observed rows.
        null.filter(F.col("null_difference").isNotNull())
        .join(F.broadcast(observed.select(*cells, "difference")), cells)
        .groupBy(*cells)
        .agg(
            F.count(F.lit(1)).alias("valid"),
            F.count_if(
                F.round(F.abs("null_difference"), TIE_DIGITS)
                >= F.round(F.abs("difference"), TIE_DIGITS)
            ).alias("extreme"),
        )
    )
    estimable = F.col("difference").isNotNull() & (F.col("valid") > 0)
    tested = (
        observed.join(counted, cells, "left")
        .withColumn(
            "permutation_p_value",
            F.when(estimable, (F.col("extreme") + 1) / F.when(estimable, F.col("valid") + 1)),
        )
        .withColumn(
            "valid_permutations",
            F.when(F.col("difference").isNotNull(), F.coalesce("valid", F.lit(0))).otherwise(0),
        )
    )
    adjusted = benjamini_hochberg(tested, "permutation_p_value", "fdr_adjusted_p_value", cells)
    return adjusted.select(
        *cells, "td_count", "td_probability", "dyslexia_count", "dyslexia_probability",
        "difference", "permutation_p_value", "fdr_adjusted_p_value", "valid_permutations",
        significant(F.col("fdr_adjusted_p_value")).alias("significant_fdr_0_05"),
        (F.abs("difference") >= config.LARGE_DIFFERENCE).alias("large_descriptive_difference"),
        direction(F.col("difference")).alias("direction"),
    )


def transition_bootstrap(
    counts: DataFrame,
    k: int,
    replicates: int = config.BOOTSTRAPS,
    seed: int = config.BOOTSTRAP_SEED,
    reference: str = config.REFERENCE_GROUP,
    target: str = config.TARGET_GROUP,
) -> DataFrame:
    """Percentile intervals (2.5 %, 97.5 %) from subjects drawn with replacement within groups.
    A cell has one value per replicate, so ``percentile`` buffers are bounded by the setting."""
    n_ref, n_target = group_sizes(counts, reference, target)
    numbered = numbered_in_group(counts, n_ref + n_target)
    draws = bootstrap_draws(
        numbered, {reference: n_ref, target: n_target}, replicates, seed
    )
    drawn = draws.join(
        numbered.select("group", "position", _origins(k).alias("origins")), ["group", "position"]
    )
    in_target = F.col("group") == target
    pooled = drawn.select("b", "group", F.inline("origins")).groupBy("b", "from_state").agg(
        *_destination_sums(k, "t", in_target), *_destination_sums(k, "r", ~in_target)
    )
    boot = _differences(pooled, k, ["b"])
    measures = {
        "td": "td_probability", "dyslexia": "dyslexia_probability", "difference": "difference"
    }
    columns = []
    for name, source in measures.items():
        columns += [
            F.percentile(source, F.lit(0.025)).alias(f"{name}_ci_lower"),
            F.percentile(source, F.lit(0.975)).alias(f"{name}_ci_upper"),
            F.count(source).alias(f"{name}_valid_bootstraps"),
        ]
    return boot.groupBy("from_state", "to_state").agg(*columns)


def transition_comparison(
    tested: DataFrame, intervals: DataFrame
) -> DataFrame:
    """Full result table, largest absolute difference first, cells without one last."""
    cells = ["from_state", "to_state"]
    return tested.join(intervals, cells, "left").orderBy(
        F.desc_nulls_last(F.abs("difference")), *cells
    )


def large_differences(tested: DataFrame, least: float | None = None) -> DataFrame:
    """Cells whose difference is large: as the test marks it, or ``least`` and more."""
    if least is None:
        return tested.filter(F.col("large_descriptive_difference"))
    return tested.filter(F.abs("difference") >= least)
