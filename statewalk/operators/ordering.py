"""Sequence positions for keys of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statewalk import config
from statewalk.session import materialize


def ordered_index(
    df: DataFrame,
    key: str,
    order_by: Sequence[str],
    blocks: Mapping[str, Column],
    out: str = "timepoint",
    hot_rows: int = config.HOT_ROWS,
) -> DataFrame:
    """Number the rows of each ``key`` 1..n in ``order_by`` order.

    A key with more than ``hot_rows`` rows is cut into ``blocks``: expressions, coarse to fine,
    that never decrease along ``order_by``. Rows are ordered inside a block only, and block
    offsets come from counts, level by level. The list of hot keys has at most
    N / hot_rows entries, which is what makes it safe to broadcast; without any hot key the plan
    is one shuffle and one window.
    """
    hot = (
        df.groupBy(key).agg(F.count(F.lit(1)).alias("__rows"))
        .filter(F.col("__rows") > hot_rows)
        .select(key, F.lit(True).alias("__hot"))
    )
    if hot.isEmpty():
        position = F.row_number().over(Window.partitionBy(key).orderBy(*order_by))
        return df.withColumn(out, position.cast("bigint"))
    hot = materialize(hot, "hot_keys")
    names = [f"__b{i}" for i in range(len(blocks))]
    tagged = df.join(F.broadcast(hot), key, "left").select(
        "*", *[F.when(F.col("__hot"), e).alias(n) for n, e in zip(names, blocks.values())]
    )
    sums = materialize(
        tagged.filter(F.col("__hot")).groupBy(key, *names).agg(F.count(F.lit(1)).alias("__c")),
        "block_counts",
    )
    offsets = sums.select(key, *names)
    for depth in range(len(names), 0, -1):
        level = sums.groupBy(key, *names[:depth]).agg(F.sum("__c").alias("__c"))
        before = Window.partitionBy(key, *names[: depth - 1]).orderBy(names[depth - 1]).rowsBetween(
            Window.unboundedPreceding, -1
        )
        level = level.select(
            key, *names[:depth],
            F.coalesce(F.sum("__c").over(before), F.lit(0)).alias(f"__o{depth}"),
        )
        offsets = offsets.join(level, [key, *names[:depth]])
    total = sum((F.col(f"__o{d}") for d in range(2, len(names) + 1)), F.col("__o1"))
    offsets = offsets.select(key, *names, total.alias("__offset"))
    inside = Window.partitionBy(key, *names).orderBy(*order_by)
    # Rows of other keys have NULL blocks: they match no offset and stay in one window per key.
    return (
        tagged.join(offsets, [key, *names], "left")
        .withColumn(out, F.row_number().over(inside) + F.coalesce(F.col("__offset"), F.lit(0)))
        .select(*df.columns, F.col(out).cast("bigint").alias(out))
    )
