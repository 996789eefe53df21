"""Hash-derived randomness: the same draws on every engine, cluster size and retry.

A subject is hashed once (md5, two residues x and y). Replicate r then evaluates its own random
polynomial ((a3 x + a2) x + a1) x + a0 + a4 y modulo the prime 2^31 - 1, with coefficients taken
from md5(seed|r|...). Such values are 4-wise independent across subjects (Carter and Wegman) and
cost a few integer operations per subject and replicate.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1
COEFFICIENTS = 5


def digest(*parts: Column | int | str) -> Column:
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in columns]))


def residue(hexdigest: Column, start: int) -> Column:
    """Twelve hex digits from ``start`` (1-based) as a number modulo the prime."""
    return F.conv(F.substring(hexdigest, start, 12), 16, 10).cast("bigint") % PRIME


def with_residues(df: DataFrame, *identity: Column | str) -> DataFrame:
    h = digest(*[F.col(c) if isinstance(c, str) else c for c in identity])
    return df.withColumn("__x", residue(h, 1)).withColumn("__y", residue(h, 13))


def replicate_coefficients(
    spark: SparkSession, replicates: int, seed: int, streams: tuple[int, ...] = (0,), draw: int = 0
) -> DataFrame:
    """(stream, b, a0..a4): one row per replicate; stream s uses seed + s."""
    base = spark.range(1, replicates + 1).select(
        F.explode(F.array(*[F.lit(int(s)) for s in streams])).alias("stream"),
        F.col("id").cast("int").alias("b"),
    )
    return base.select(
        "stream", "b",
        *[
            residue(digest(F.col("stream") + F.lit(seed), F.col("b"), F.lit(draw), F.lit(i)), 1)
            .alias(f"a{i}")
            for i in range(COEFFICIENTS)
        ],
    )


def replicate_hash(prefix: str = "") -> Column:
    """Value in 0..PRIME-1 of a row with residues, joined to its replicate's coefficients."""
    x, y = F.col("__x"), F.col("__y")
    a = [F.col(f"{prefix}a{i}") for i in range(COEFFICIENTS)]
    value = (a[3] * x + a[2]) % PRIME
    value = (value * x + a[1]) % PRIME
    value = (value * x + a[0]) % PRIME
    return (value + a[4] * y % PRIME) % PRIME


def _reduced(z: np.ndarray) -> np.ndarray:
    """Numbers below 2^62 modulo the prime 2^31 - 1, in place."""
    for _ in range(2):
        high = z >> 31
        z &= PRIME
        z += high
    return np.where(z >= PRIME, z - PRIME, z)


def hash_rows(x: np.ndarray, y: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    """``replicate_hash`` of rows with residues x, y (rows x replicates); coefficients (replicates x 5)."""
    a = coefficients.T
    x, y = x[:, None], y[:, None]
    value = _reduced(a[3] * x + a[2])
    value = _reduced(value * x + a[1])
    value = _reduced(value * x + a[0])
    return _reduced(value + _reduced(a[4] * y))


def hash_block(value: Column, blocks: int) -> Column:
    """Order-preserving block number in 0..blocks-1; blocks are equally likely by construction."""
    return F.floor(value * F.lit(blocks) / F.lit(PRIME)).cast("int")
