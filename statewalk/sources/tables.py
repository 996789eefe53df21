"""Decoded tables, fitted models and state matrices from files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statewalk.operators.matrices import covariance_to_correlation, symmetrize
from statewalk.operators.validate import coerce_decoded


def read_decoded(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Decoded sequences. CSV is read as text and coerced, so unusable fields become NULL and are
    reported by the checks instead of being guessed."""
    if fmt == "csv":
        raw = spark.read.option("header", True).csv(path)
    else:
        raw = spark.read.format(fmt).load(path)
    return coerce_decoded(raw)


def read_observations(
    spark: SparkSession, path: str, columns: Sequence[str], fmt: str = "parquet"
) -> DataFrame:
    """Series files with subject_id, group, file, timepoint and one column per signal."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path).select(
        F.col("subject_id").cast("bigint"), "group", "file", F.col("timepoint").cast("bigint"),
        *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns, 1)],
    )


def read_models(spark: SparkSession, path: str, k: int | None = None) -> DataFrame:
    """Fit table written by the model stage; with ``k`` the model's size is checked."""
    fits = spark.read.parquet(path)
    missing = {"k", "start", "log_lik", "model"} - set(fits.columns)
    if missing:
        raise ValueError("not a fit table, missing: " + ", ".join(sorted(missing)))
    if k is not None:
        wrong = fits.filter(F.col("model").isNotNull() & (F.size("model.init") != k))
        if not wrong.isEmpty():
            raise ValueError(f"the model does not have {k} states")
    return fits


def model_covariances(fits: DataFrame) -> DataFrame:
    """(state, i, j, cov) for i <= j of a one-row fit table."""
    sigma = fits.select(F.posexplode("model.sigma").alias("s", "rows")).select(
        "s", F.posexplode("rows").alias("i", "cells")
    ).select("s", "i", F.posexplode("cells").alias("j", "cov"))
    return symmetrize(
        sigma.select((F.col("s") + 1).alias("state"), (F.col("i") + 1).alias("i"),
                     (F.col("j") + 1).alias("j"), "cov"),
        "cov",
    )


def model_means(fits: DataFrame) -> DataFrame:
    mu = fits.select(F.posexplode("model.mu").alias("s", "cells"))
    return mu.select((F.col("s") + 1).alias("state"), F.posexplode("cells").alias("i", "mean_signal")).select(
        "state", (F.col("i") + 1).alias("i"), "mean_signal"
    )


def _read_csv(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.option("header", True).csv(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" in str(problem):
            return None
        raise


def _long_matrix(raw: DataFrame) -> DataFrame:
    """(state, i, j, r) for i <= j from wide rows with a ``state`` column and the row name first."""
    label, *names = [c for c in raw.columns if c != "state"]
    order = F.array(*[F.lit(n) for n in names])
    long = raw.select(
        F.col("state").cast("int").alias("state"),
        F.array_position(order, F.col(f"`{label}`")).cast("int").alias("i"),
        F.posexplode(F.array(*[F.col(f"`{n}`").try_cast("double") for n in names])).alias("j", "r"),
    ).withColumn("j", F.col("j") + 1)
    bad = F.count_if((F.col("i") < 1) | F.col("r").isNull() | F.isnan("r"))
    cells = F.count_distinct("i", "j")
    wrong = long.groupBy("state").agg(bad.alias("bad"), cells.alias("n")).filter(
        (F.col("bad") > 0) | (F.col("n") != len(names) ** 2)
    ).first()
    if wrong is not None:
        raise ValueError(f"state {wrong['state']}: the matrix is not square and finite")
    return symmetrize(long, "r").withColumn(
        "r", F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(
            F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("r")))
        )
    )


def read_correlation_csv(spark: SparkSession, path: str, state: int) -> DataFrame | None:
    """One state's matrix file; None when it does not exist."""
    raw = _read_csv(spark, path)
    return None if raw is None else _long_matrix(raw.withColumn("state", F.lit(state)))


def state_correlations(
    spark: SparkSession, folder: str, k: int, fallback: DataFrame | None = None
) -> tuple[DataFrame, str]:
    """Correlations of all states from the folder ``correlation_matrix`` (or from single files
    correlation_matrix_state_<s>.csv), or all of them from model covariances as soon as one state is
    missing; the second value names the source that was used."""
    whole = _read_csv(spark, f"{folder}/correlation_matrix")
    if whole is not None:
        matrix = _long_matrix(whole).filter(F.col("state") <= k)
        if matrix.select("state").distinct().count() == k:
            return matrix, "csv"
    else:
        parts = []
        for s in range(1, k + 1):
            part = read_correlation_csv(spark, f"{folder}/correlation_matrix_state_{s}.csv", s)
            if part is None:
                break
            parts.append(part)
        if len(parts) == k:
            out = reduce(DataFrame.unionByName, parts)
            sizes = out.groupBy("state").agg(F.max("j").alias("p")).select("p").distinct().count()
            if sizes != 1:
                raise ValueError("state matrices differ in size")
            return out, "csv"
    if fallback is None:
        raise FileNotFoundError(f"state matrices are missing in {folder}")
    return covariance_to_correlation(fallback), "model_covariance"
