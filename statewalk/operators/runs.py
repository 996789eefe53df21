"""Run-length encoding, complete runs and state changes of decoded sequences.

A subject's sequence is handled in slices of ``slice_rows`` timepoints, so one very long subject
spreads over many window partitions. The last row of a full slice is repeated as a marker at the
head of the next slice, which lets ``lag`` see across the seam without a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statewalk import config

ID_COLUMNS = ("subject_id", "group", "file")


def with_previous_state(decoded: DataFrame, slice_rows: int = config.SLICE_ROWS) -> DataFrame:
    """Adds ``slice`` and ``previous_state`` (NULL on the first timepoint of a subject)."""
    slice_no = F.floor((F.col("timepoint") - 1) / slice_rows).cast("bigint")
    seam = F.col("timepoint") % slice_rows == 0
    placed = F.when(
        seam,
        F.array(
            F.struct(slice_no.alias("slice"), F.lit(False).alias("marker")),
            F.struct((slice_no + 1).alias("slice"), F.lit(True).alias("marker")),
        ),
    ).otherwise(F.array(F.struct(slice_no.alias("slice"), F.lit(False).alias("marker"))))
    w = Window.partitionBy(*ID_COLUMNS, "slice").orderBy("timepoint")
    return (
        decoded.select(*ID_COLUMNS, "timepoint", "state", F.explode(placed).alias("__at"))
        .select(*ID_COLUMNS, "timepoint", "state", "__at.slice", "__at.marker")
        .withColumn("previous_state", F.lag("state").over(w))
        .filter(~F.col("marker"))
        .drop("marker")
    )


def state_runs(decoded: DataFrame, slice_rows: int = config.SLICE_ROWS) -> DataFrame:
    """One row per run: (subject_id, group, file, state, run_index, n_runs, duration).

    The row on which a run starts stands for it; its length is the distance to the next start. Inside a
    slice both come from one shuffle and its sort. Only subjects of more than one slice need what the
    other slices hold: one row of counts per slice, at most 2 N / slice_rows in all, so it is broadcast.
    ``decoded`` should be a stored table: it is first asked whether it has such subjects.
    """
    inside = Window.partitionBy(*ID_COLUMNS, "slice")
    along = inside.orderBy("timepoint")

    def placed(part: DataFrame) -> DataFrame:
        begins = F.col("previous_state").isNull() | (F.col("previous_state") != F.col("state"))
        return with_previous_state(part, slice_rows).select(
            *ID_COLUMNS, "slice", "timepoint", "state", F.coalesce(begins, F.lit(False)).alias("begins"),
            F.row_number().over(along).cast("bigint").alias("at"),
            F.count(F.lit(1)).over(inside).alias("slice_length"),
        )

    starts = (
        placed(decoded).filter("begins")
        .withColumn("next_at", F.lead("at").over(along))
        .withColumn("piece", F.row_number().over(along).cast("bigint"))
        .withColumn("started", F.count(F.lit(1)).over(inside))
    )
    long_subjects = decoded.filter(F.col("timepoint") > slice_rows).select(*ID_COLUMNS)
    run_index, n_runs = F.col("piece"), F.col("started")
    duration = F.coalesce(F.col("next_at"), F.col("slice_length") + 1) - F.col("at")
    if not long_subjects.isEmpty():
        cut = decoded.join(F.broadcast(long_subjects.distinct()), [*ID_COLUMNS], "left_semi")
        starts = starts.join(F.broadcast(_slice_offsets(placed(cut))), [*ID_COLUMNS, "slice"], "left")
        run_index = F.coalesce("runs_before", F.lit(0)) + run_index
        n_runs = F.coalesce("all_runs", n_runs)
        # The last run of a slice goes on to the first start of a later one, or to the end.
        beyond = F.coalesce("next_start", F.col("all_rows") + 1) - F.col("rows_before") - F.col("at")
        duration = F.when(F.col("next_at").isNull(), F.coalesce(beyond, duration)).otherwise(duration)
    return starts.select(
        *ID_COLUMNS, "state", run_index.alias("run_index"), n_runs.alias("n_runs"), duration.alias("duration")
    )


def _slice_offsets(placed: DataFrame) -> DataFrame:
    """What a slice needs to know of the others: rows and runs before it and in all, and the place of the
    first start behind it."""
    slices = placed.groupBy(*ID_COLUMNS, "slice").agg(
        F.count(F.lit(1)).alias("length"),
        F.count_if("begins").alias("started"),
        F.min(F.when(F.col("begins"), F.col("at"))).alias("first_at"),
    )
    whole = Window.partitionBy(*ID_COLUMNS)
    before = whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    behind = whole.orderBy("slice").rowsBetween(1, Window.unboundedFollowing)
    return (
        slices.withColumn("rows_before", F.coalesce(F.sum("length").over(before), F.lit(0)))
        .withColumn("runs_before", F.coalesce(F.sum("started").over(before), F.lit(0)))
        .withColumn("all_rows", F.sum("length").over(whole))
        .withColumn("all_runs", F.sum("started").over(whole))
        .withColumn("next_start", F.min(F.col("rows_before") + F.col("first_at")).over(behind))
        .drop("length", "started", "first_at")
    )


def complete_runs(runs: DataFrame) -> DataFrame:
    """Runs whose start and end were both observed: all but the first and the last of a subject."""
    return runs.filter((F.col("run_index") > 1) & (F.col("run_index") < F.col("n_runs"))).select(
        *ID_COLUMNS, "state", "duration",
        F.col("run_index").alias("original_run_index"),
        (F.col("run_index") - 1).alias("complete_run_index"),
    )
