"""Queries under a model given by constants: one E-step, one M-step, best paths and one k-means step over
all rows of ``lineitem``. They run the same operators as the fits, with results that any engine can
check."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from statewalk.model import fit, kernel, start
from statewalk.model.chunks import Chunks, reduce_chunks, each
from statewalk.model.decode import decoded_rows
from statewalk.model.kernel import Model

# Fixed values of the given model: three states, runs of up to three rows, four signals.
GIVEN = Model(
    init=np.array([0.5, 0.3, 0.2]),
    transition=np.array([[0.0, 0.6, 0.4], [0.7, 0.0, 0.3], [0.5, 0.5, 0.0]]),
    duration=np.array([[0.5, 0.3, 0.2], [0.2, 0.5, 0.3], [0.1, 0.3, 0.6]]),
    mu=np.array([[-1.0, -1.0, 0.0, 0.0], [1.0, 1.0, 0.5, 0.0], [0.0, 0.0, -0.5, 0.5]]),
    sigma=np.array(
        [
            [[1.0, 0.5, 0.0, 0.0], [0.5, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.2], [0.0, 0.0, 0.2, 1.0]],
            [[1.2, 0.6, 0.0, 0.0], [0.6, 1.1, 0.0, 0.0], [0.0, 0.0, 0.9, 0.0], [0.0, 0.0, 0.0, 0.9]],
            [[0.8, 0.0, 0.0, 0.1], [0.0, 0.8, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0], [0.1, 0.0, 0.0, 1.0]],
        ]
    ),
)


def long_form(spark: SparkSession, parts: dict[str, np.ndarray]) -> DataFrame:
    """(part, a, b, c, value): arrays of a model's size as rows; unused places are 0."""
    rows = []
    for name, values in parts.items():
        for at in np.ndindex(values.shape):
            place = [n + 1 for n in at] + [0] * (3 - len(at))
            rows.append((name, *place, float(values[at])))
    return spark.createDataFrame(rows, "part string, a bigint, b bigint, c bigint, value double")


def _sums(chunks: Chunks, model: Model) -> np.ndarray:
    return fit.expected_statistics(chunks, {0: model})[0]


def statistics(chunks: Chunks, model: Model = GIVEN) -> DataFrame:
    """Expected statistics per row of the series: log-likelihood, openings, moves, durations, and weighted
    counts and moments of the signals."""
    parts = kernel.Statistics(model.k, model.m, model.p).unpack(_sums(chunks, model) / chunks.n_rows)
    return long_form(chunks.table.sparkSession, parts)


def next_model(chunks: Chunks, model: Model = GIVEN) -> DataFrame:
    """Parameters after one EM iteration."""
    return long_form(chunks.table.sparkSession, vars(kernel.maximization(_sums(chunks, model), model)))


def best_paths(chunks: Chunks, model: Model = GIVEN) -> DataFrame:
    return decoded_rows(chunks, {0: model}).drop("model_id")


def lloyd_step(chunks: Chunks, model: Model = GIVEN) -> DataFrame:
    """Sizes and centres after one k-means step from the model's means."""
    k = model.k
    sums = reduce_chunks(chunks, {0: model.mu}, each(start._lloyd_step))[0]
    parts = {"size": sums[:k], "centre": sums[k:].reshape(k, -1) / sums[:k, None]}
    return long_form(chunks.table.sparkSession, parts)


def shrunk_covariances(chunks: Chunks, model: Model = GIVEN) -> DataFrame:
    """Shrinkage covariances of the clusters around the model's means."""
    _, means, covs = start._cluster_models(chunks, {0: model.mu})[0]
    return long_form(chunks.table.sparkSession, {"mean": means, "covariance": np.array(covs)})
