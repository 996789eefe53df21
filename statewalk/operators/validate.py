"""Checks on decoded sequences, written as violation tables: an empty result means valid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewalk import config
from statewalk.functions.labels import integer_label, standardize_group

DECODED_COLUMNS = ("subject_id", "group", "file", "timepoint", "state")


class ValidationError(ValueError):
    """Input does not satisfy the data model."""


def require_columns(df: DataFrame, required: Sequence[str] = DECODED_COLUMNS) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValidationError("missing required columns: " + ", ".join(missing))


def coerce_decoded(df: DataFrame) -> DataFrame:
    """Integer ids, times and states, and standard group labels."""
    require_columns(df)
    return df.select(
        integer_label(F.col("subject_id").cast("string")).alias("subject_id"),
        standardize_group(F.col("group").cast("string")).alias("group"),
        F.col("file").cast("string").alias("file"),
        integer_label(F.col("timepoint").cast("string")).alias("timepoint"),
        integer_label(F.col("state").cast("string")).cast("int").alias("state"),
    )


def subject_checks(decoded: DataFrame) -> DataFrame:
    """One row per subject with the facts the checks need.

    ``timepoint = 1..n`` is tested without ordering anything: the smallest is 1, the largest is n
    and no timepoint occurs twice.
    """
    repeated = (
        decoded.groupBy("subject_id", "timepoint").agg(F.count(F.lit(1)).alias("__c"))
        .groupBy("subject_id").agg((F.sum("__c") - F.count(F.lit(1))).alias("n_repeated"))
    )
    return (
        decoded.groupBy("subject_id")
        .agg(
            F.count(F.lit(1)).alias("n_timepoints"),
            F.min("timepoint").alias("first_timepoint"),
            F.max("timepoint").alias("last_timepoint"),
            F.min("group").alias("__g0"), F.max("group").alias("__g1"),
            F.min("file").alias("__f0"), F.max("file").alias("__f1"),
        )
        .join(repeated, "subject_id")
        .select(
            "subject_id", "n_timepoints",
            (
                (F.col("first_timepoint") == 1)
                & (F.col("last_timepoint") == F.col("n_timepoints"))
                & (F.col("n_repeated") == 0)
            ).alias("is_contiguous"),
            (F.col("__g0") == F.col("__g1")).alias("has_one_group"),
            (F.col("__f0") == F.col("__f1")).alias("has_one_file"),
        )
    )


def subject_violations(decoded: DataFrame) -> DataFrame:
    """Subjects with gaps or repeats in time, or with more than one group or file."""
    return subject_checks(decoded).filter(
        ~(F.col("is_contiguous") & F.col("has_one_group") & F.col("has_one_file"))
    )


def row_violations(decoded: DataFrame, k: int, groups: Sequence[str]) -> DataFrame:
    """Counts of rows with unusable fields, labels outside 1..k or unexpected groups."""
    fields = ("subject_id", "timepoint", "state")
    missing = F.col(fields[0]).isNull() | F.col(fields[1]).isNull() | F.col(fields[2]).isNull()
    return decoded.agg(
        F.count_if(missing).alias("n_missing"),
        F.count_if(~F.col("state").between(1, k)).alias("n_bad_state"),
        F.count_if(F.col("group").isNull() | ~F.col("group").isin(*groups)).alias("n_bad_group"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("group") == groups[0]).alias("n_rows_" + groups[0].lower()),
        F.count_if(F.col("group") == groups[1]).alias("n_rows_" + groups[1].lower()),
    )


def check_decoded(
    decoded: DataFrame,
    k: int,
    groups: Sequence[str] = (config.REFERENCE_GROUP, config.TARGET_GROUP),
) -> None:
    """Raise when a decoded table breaks the data model."""
    require_columns(decoded)
    facts = row_violations(decoded, k, groups).first()
    if facts["n_rows"] == 0:
        raise ValidationError("decoded table is empty")
    if facts["n_missing"]:
        raise ValidationError(f"{facts['n_missing']} rows with non-finite id, time or state")
    if facts["n_bad_state"]:
        raise ValidationError(f"{facts['n_bad_state']} rows with a state outside 1..{k}")
    if facts["n_bad_group"]:
        raise ValidationError(f"{facts['n_bad_group']} rows with an unexpected group label")
    if not (facts["n_rows_" + groups[0].lower()] and facts["n_rows_" + groups[1].lower()]):
        raise ValidationError("both groups must contain participants")
    bad = subject_violations(decoded).first()
    if bad is not None:
        raise ValidationError(f"subject {bad['subject_id']} breaks a sequence rule: {bad}")


def subject_information(decoded: DataFrame) -> DataFrame:
    """One row per subject with group, file and sequence length."""
    return decoded.groupBy("subject_id").agg(
        F.min("group").alias("group"), F.min("file").alias("file"),
        F.count(F.lit(1)).alias("n_timepoints"),
    )


def length_check(subjects: DataFrame, decoded: DataFrame) -> DataFrame:
    """One row: sum of the sequence lengths, number of rows, and whether they are equal."""
    lengths = subjects.agg(F.coalesce(F.sum("n_timepoints"), F.lit(0)).alias("total_length"))
    rows = decoded.agg(F.count(F.lit(1)).alias("n_rows"))
    # Two one-row tables side by side.
    both = lengths.withColumn("one", F.lit(1)).join(rows.withColumn("one", F.lit(1)), "one").drop("one")
    return both.withColumn("equal", F.col("total_length") == F.col("n_rows"))


def check_lengths(subjects: DataFrame, decoded: DataFrame) -> None:
    row = length_check(subjects, decoded).first()
    if not row["equal"]:
        raise ValueError(f"sequence lengths add up to {row['total_length']}, but there are {row['n_rows']} rows")
