"""State covariance, correlation and mean-signal tables in long form (state, i, j, value)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statewalk.functions.stats import safe_correlation

MOMENT_SCHEMA = "state int, task bigint, n bigint, mean array<double>, c array<double>"
MERGED = 256
SQRT_EPS = 1.4901161193847656e-08


def zscore_by_subject(series: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Subject-wise standardisation with the sample deviation. Means and deviations come from an
    aggregation with map-side combine and are joined back, so a very long subject is never
    collected; a side small enough is broadcast by Spark, a skewed join is split by AQE."""
    stats = series.groupBy("subject_id").agg(
        *[F.avg(c).alias(f"__m_{c}") for c in columns],
        *[F.stddev_samp(c).alias(f"__s_{c}") for c in columns],
    )
    scaled = []
    for c in columns:
        sd = F.col(f"__s_{c}")
        bad = sd.isNull() | F.isnan(sd) | (sd <= SQRT_EPS)
        z = (F.col(c) - F.col(f"__m_{c}")) / F.when(~bad, sd)
        scaled.append(
            F.when(
                bad, F.raise_error(F.concat(F.lit(f"no variance in {c}, subject "), "subject_id"))
            ).otherwise(z).cast("double").alias("z" + c.lstrip("x"))
        )
    kept = [c for c in series.columns if c not in columns]
    return series.join(stats, "subject_id").select(*kept, *scaled)


def variance_violations(series: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Subjects and signals without usable variance."""
    stats = series.groupBy("subject_id").agg(*[F.stddev_samp(c).alias(c) for c in columns])
    long = stats.unpivot("subject_id", list(columns), "signal", "sd")
    return long.filter(F.col("sd").isNull() | F.isnan("sd") | (F.col("sd") <= SQRT_EPS))


@dataclass
class Moments:
    """Count, mean and centred cross products (upper triangle) of some rows; two of them merge exactly
    about their common mean, so sums of raw products never meet."""

    n: int
    mean: np.ndarray
    cross: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        mean = x.mean(axis=0)
        centred = x - mean
        return cls(len(x), mean, (centred.T @ centred)[np.triu_indices(x.shape[1])])

    def merged(self, other: Moments) -> Moments:
        n = self.n + other.n
        gap = other.mean - self.mean
        i, j = np.triu_indices(len(gap))
        cross = self.cross + other.cross + gap[i] * gap[j] * (self.n * other.n / n)
        return Moments(n, self.mean + gap * (other.n / n), cross)


def _moment_rows(found: dict[int, Moments], task: int) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "state": list(found), "task": task, "n": [m.n for m in found.values()],
            "mean": [m.mean.tolist() for m in found.values()], "c": [m.cross.tolist() for m in found.values()],
        }
    )


def _task_moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found: dict[int, Moments] = {}
    for batch in batches:
        for state, rows in batch.groupby("state"):
            m = Moments.of(np.stack(rows["x"].to_numpy()))
            found[int(state)] = found[int(state)].merged(m) if int(state) in found else m
    if found:
        yield _moment_rows(found, TaskContext.get().partitionId())


def _merge_moments(pdf: pd.DataFrame) -> pd.DataFrame:
    total: Moments | None = None
    for r in pdf.sort_values("task").itertuples():
        m = Moments(int(r.n), np.asarray(r.mean), np.asarray(r.c))
        total = m if total is None else total.merged(m)
    return _moment_rows({int(pdf["state"].iloc[0]): total}, int(pdf["task"].min()))


def state_moments(observations: DataFrame) -> DataFrame:
    """(state, i, j, n, mean_i, mean_j, cov) for i <= j from rows (state, x).

    A task folds its rows to one mergeable record per state; records of ``MERGED`` neighbouring tasks are
    merged at a time, on three levels, so no group holds more.
    """
    parts = observations.select("state", "x").mapInPandas(_task_moments, MOMENT_SCHEMA)
    for level in (1, 2, 3):
        group = F.floor(F.col("task") / MERGED**level)
        keys = ["state"] if level == 3 else ["state", group]
        parts = parts.groupBy(*keys).applyInPandas(_merge_moments, MOMENT_SCHEMA)
    p = F.size("mean")
    cells = F.flatten(
        F.transform(F.sequence(F.lit(1), p), lambda i: F.transform(F.sequence(i, p), lambda j: F.struct(i.alias("i"), j.alias("j"))))
    )
    places = parts.select("state", "n", "mean", F.posexplode(F.arrays_zip(cells.alias("at"), F.col("c").alias("c"))).alias("_", "v"))
    n = F.col("n")
    return places.select(
        "state", F.col("v.at.i").alias("i"), F.col("v.at.j").alias("j"), "n",
        F.get("mean", F.col("v.at.i") - 1).alias("mean_i"), F.get("mean", F.col("v.at.j") - 1).alias("mean_j"),
        (F.col("v.c") / F.when(n > 1, n - 1)).alias("cov"),
    )


def state_means(moments: DataFrame) -> DataFrame:
    return moments.filter(F.col("i") == F.col("j")).select(
        "state", "i", F.col("mean_i").alias("mean_signal")
    )


def symmetrize(matrix: DataFrame, value: str = "value") -> DataFrame:
    """Average of (i, j) and (j, i), returned for i <= j; a one-sided entry stands for both."""
    return matrix.groupBy(
        "state", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")
    ).agg(F.avg(value).alias(value))


def both_triangles(upper: DataFrame, *values: str) -> DataFrame:
    flipped = upper.filter(F.col("i") < F.col("j")).select(
        "state", F.col("j").alias("i"), F.col("i").alias("j"), *values
    )
    return upper.select("state", "i", "j", *values).unionByName(flipped)


def covariance_to_correlation(cov: DataFrame, value: str = "cov") -> DataFrame:
    """Correlations for i <= j: clamped to [-1, 1], diagonal exactly 1. The diagonal lookup is a
    maximum over the row's window: a row of a state matrix has p entries."""
    full = both_triangles(cov, value)
    v = F.col(value)
    on_diagonal = F.when(F.col("i") == F.col("j"), v)
    rows = Window.partitionBy("state", "i")
    cols = Window.partitionBy("state", "j")
    scaled = full.withColumn("__vi", F.max(on_diagonal).over(rows)).withColumn(
        "__vj", F.max(on_diagonal).over(cols)
    )
    usable = (F.col("__vi") > 0) & (F.col("__vj") > 0)
    r = v / F.sqrt(F.when(usable, F.col("__vi") * F.col("__vj")))
    value_or_error = (
        F.when(~usable | F.col("__vi").isNull() | F.col("__vj").isNull(),
               F.raise_error(F.lit("state variances must be positive")))
        .when(F.col("i") == F.col("j"), F.lit(1.0))
        .otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    )
    return scaled.filter(F.col("i") <= F.col("j")).select(
        "state", "i", "j", value_or_error.cast("double").alias("r")
    )


def matrix_wide(upper: DataFrame, value: str, p: int) -> DataFrame:
    """p x p matrix rows per state."""
    return (
        both_triangles(upper, value).groupBy("state", "i").pivot("j", list(range(1, p + 1)))
        .agg(F.first(value))
        .select("state", "i", *[F.col(str(j)).alias(f"roi_{j}") for j in range(1, p + 1)])
    )


def _signed_summary(value: str, mean: str, signed: str, count: str) -> list:
    v = F.col(value)
    return [
        F.avg(v).alias(f"mean_all_{mean}"),
        F.avg(F.when(v > 0, v)).alias(f"mean_positive_{signed}"),
        F.avg(F.when(v < 0, v)).alias(f"mean_negative_{signed}_signed"),
        F.avg(F.when(v < 0, F.abs(v))).alias(f"mean_negative_{signed}_magnitude"),
        F.count_if(v > 0).alias(f"number_positive_{count}"),
        F.count_if(v < 0).alias(f"number_negative_{count}"),
        F.count_if(v == 0).alias(f"number_zero_{count}"),
    ]


def state_summary(correlations: DataFrame, means: DataFrame) -> DataFrame:
    """Fourteen measures per state over unique correlations and mean signals."""
    corr = correlations.filter(F.col("i") < F.col("j")).groupBy("state").agg(
        *_signed_summary("r", "off_diagonal_correlations", "correlation", "correlations")
    )
    mu = means.groupBy("state").agg(
        *_signed_summary("mean_signal", "roi_signals", "roi_signal", "rois")
    )
    return corr.join(mu, "state")


def mean_signal_wide(means: DataFrame, k: int) -> DataFrame:
    return (
        means.groupBy("i").pivot("state", list(range(1, k + 1))).agg(F.first("mean_signal"))
        .select("i", *[F.col(str(s)).alias(f"state_{s}") for s in range(1, k + 1)])
    )


def state_similarity(cov: DataFrame, means: DataFrame, value: str = "cov") -> DataFrame:
    """Correlation of covariance patterns and of mean vectors for every pair of states; a state's
    pattern is p(p-1)/2 numbers whatever the data size."""
    def pairs(df: DataFrame, keys: list[str], v: str, out: str) -> DataFrame:
        left = df.select(*keys, F.col("state").alias("state_1"), F.col(v).alias("v1"))
        right = df.select(*keys, F.col("state").alias("state_2"), F.col(v).alias("v2"))
        return (
            left.join(right, keys).filter(F.col("state_1") < F.col("state_2"))
            .groupBy("state_1", "state_2")
            .agg(safe_correlation(F.col("v1"), F.col("v2")).alias(out))
        )

    upper = cov.filter(F.col("i") < F.col("j"))
    return pairs(upper, ["i", "j"], value, "covariance_pattern_correlation").join(
        pairs(means, ["i"], "mean_signal", "mean_vector_correlation"), ["state_1", "state_2"]
    )


def check_names(df: DataFrame, names: Sequence[str], column: str = "i") -> None:
    """Raise unless the distinct names are as many as the largest index of ``df`` (if it has rows)."""
    size = df.agg(F.max(column)).first()[0]
    if len(set(names)) != len(names):
        raise ValueError("names are not distinct")
    if size is not None and int(size) != len(names):
        raise ValueError(f"{len(names)} names for a matrix of size {size}")


def roi_names(df: DataFrame, names: Sequence[str], column: str = "i", out: str = "roi") -> DataFrame:
    """Attach ROI names to an index column; there must be one name per index."""
    check_names(df, names, column)
    lookup = F.array(*[F.lit(n) for n in names])
    return df.withColumn(out, F.get(lookup, F.col(column) - 1))


