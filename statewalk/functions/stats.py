"""Column-level and small-table statistics shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statewalk import config
from statewalk.session import materialize


def quantile_name(p: float) -> str:
    return "q" + format(100 * p, "g").replace(".", "_")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    names: Sequence[str] | None = None,
    weight: str | None = None,
    distinct_bound: int | None = None,
    bins: int = 4096,
) -> DataFrame:
    """Linear-interpolation quantiles of ``value`` per ``keys``, exact at any size.

    Equal values are first folded into one weighted row. If the number of distinct values per
    group is known (``distinct_bound``) to fit one aggregate buffer, ``percentile`` is used.
    Otherwise a histogram locates the bins that hold the wanted ranks and only those bins are
    ordered, so no group is ever sorted as a whole.
    """
    names = list(names or [quantile_name(p) for p in probs])
    keys = list(keys)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("__v"))
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).cast("long").alias("__c"))
    )
    if distinct_bound is not None and distinct_bound <= config.QUANTILE_VALUES:
        return counts.groupBy(*keys).agg(
            *[F.percentile("__v", F.lit(p), F.col("__c")).alias(n) for p, n in zip(probs, names)]
        )

    counts = materialize(counts, "value_counts")
    span = counts.groupBy(*keys).agg(
        F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.sum("__c").alias("__n")
    )
    width = F.col("__hi") - F.col("__lo")
    position = F.when(width > 0, (F.col("__v") - F.col("__lo")) / F.when(width > 0, width))
    binned = counts.join(span, keys).withColumn(
        "__bin", F.least(F.floor(F.coalesce(position, F.lit(0.0)) * bins), F.lit(bins - 1))
    )
    by_bin = binned.groupBy(*keys, "__bin", "__n").agg(F.sum("__c").alias("__bc"))
    before = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    by_bin = by_bin.withColumn("__start", F.coalesce(F.sum("__bc").over(before), F.lit(0)))
    targets = []
    for index, p in enumerate(probs):
        at = (F.col("__n") - 1) * F.lit(float(p))
        for side, rank in (("low", F.floor(at)), ("high", F.ceil(at))):
            targets.append(
                F.struct(
                    F.lit(index).alias("__q"), F.lit(side).alias("__side"),
                    rank.cast("long").alias("__rank"), (at - F.floor(at)).alias("__frac"),
                )
            )
    wanted = (
        by_bin.withColumn("__t", F.explode(F.array(*targets)))
        .select(*keys, "__bin", "__start", "__bc", "__t.*")
        .filter(
            (F.col("__rank") >= F.col("__start"))
            & (F.col("__rank") < F.col("__start") + F.col("__bc"))
        )
        .drop("__bc")
    )
    hit = binned.select(*keys, "__bin", "__v", "__c").join(
        wanted.select(*keys, "__bin", "__start").distinct(), [*keys, "__bin"]
    )
    inside = Window.partitionBy(*keys, "__bin").orderBy("__v").rowsBetween(
        Window.unboundedPreceding, -1
    )
    hit = hit.withColumn(
        "__first", F.col("__start") + F.coalesce(F.sum("__c").over(inside), F.lit(0))
    ).drop("__start")
    found = hit.join(wanted, [*keys, "__bin"]).filter(
        (F.col("__rank") >= F.col("__first"))
        & (F.col("__rank") < F.col("__first") + F.col("__c"))
    )

    def pick(index: int, side: str) -> Column:
        return F.max(F.when((F.col("__q") == index) & (F.col("__side") == side), F.col("__v")))

    def fraction(index: int) -> Column:
        return F.max(F.when(F.col("__q") == index, F.col("__frac")))

    return found.groupBy(*keys).agg(
        *[
            (pick(i, "low") + fraction(i) * (pick(i, "high") - pick(i, "low"))).alias(n)
            for i, n in enumerate(names)
        ]
    )


def benjamini_hochberg(
    df: DataFrame, p: str, out: str, order: Sequence[str], family: Sequence[str] = ()
) -> DataFrame:
    """FDR-adjusted p-values over the non-NULL ``p`` of a family. A family is one row per state or
    state pair, so its window is a handful of rows whatever the data size."""
    fam = [F.col(c) for c in family] or [F.lit(0)]
    ascending = Window.partitionBy(*fam).orderBy(F.col(p).asc_nulls_last(), *order)
    whole = Window.partitionBy(*fam)
    ranked = df.withColumn("__r", F.row_number().over(ascending)).withColumn(
        "__m", F.count(p).over(whole)
    )
    from_largest = Window.partitionBy(*fam).orderBy(F.col("__r").desc()).rowsBetween(
        Window.unboundedPreceding, 0
    )
    scaled = F.col(p) * F.col("__m") / F.col("__r")
    adjusted = F.least(F.lit(1.0), F.min(scaled).over(from_largest))
    return ranked.withColumn(out, F.when(F.col(p).isNotNull(), adjusted)).drop("__r", "__m")


def significant(q: Column, level: float = config.FDR_LEVEL) -> Column:
    """Three-valued flag: NULL stays NULL."""
    return q < F.lit(level)


def pearson_from_moments(
    n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column
) -> Column:
    """Correlation from sums; a constant side gives 0 instead of a division error."""
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    usable = (vx > 0) & (vy > 0)
    return F.coalesce((n * sxy - sx * sy) / F.sqrt(F.when(usable, vx * vy)), F.lit(0.0))


def safe_correlation(x: Column, y: Column) -> Column:
    """Aggregate form of Pearson correlation with 0 for constant input."""
    sx, sy = F.stddev_samp(x), F.stddev_samp(y)
    usable = (sx > 0) & (sy > 0)
    return F.coalesce(F.covar_samp(x, y) / F.when(usable, sx * sy), F.lit(0.0))


def normalize_probability(value: Column, total_over: Sequence[str], floor: float = 1e-10) -> Column:
    """Lift non-finite and tiny entries to ``floor``, then divide by the group's total."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    lifted = F.when(finite & (value >= floor), value).otherwise(F.lit(floor))
    return lifted / F.sum(lifted).over(Window.partitionBy(*total_over))


def rescale(
    value: Column, low: float, high: float, within: Sequence[str]
) -> Column:
    """Min-max rescaling inside a (small) group; a constant group maps to the middle."""
    w = Window.partitionBy(*within)
    smallest, largest = F.min(value).over(w), F.max(value).over(w)
    spread = F.when(largest > smallest, largest - smallest)
    scaled = low + (value - smallest) / spread * (high - low)
    return F.coalesce(scaled, F.lit((low + high) / 2))


def adjusted_rand_index(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adjusted Rand index of two labelings."""
    return rand_from_cells(df.groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("__n")), x, y, "__n", keys)


def rand_from_cells(cells: DataFrame, x: str, y: str, count: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adjusted Rand index from contingency tables (labels x labels rows), whose cells may come in several
    parts: every part is added to its own pair, its row and its column in one pass."""
    keys = list(keys)
    cells = cells.select(*keys, x, y, F.col(count).alias("__n"))
    a, b, none = F.col(x).cast("string"), F.col(y).cast("string"), F.lit(None).cast("string")
    parts = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), p.alias("a"), q.alias("b"))
            for kind, p, q in (("cell", a, b), ("row", a, none), ("column", none, b))
        ]
    )
    margins = (
        cells.select(*keys, "__n", F.inline(parts))
        .groupBy(*keys, "kind", "a", "b").agg(F.sum("__n").cast("double").alias("m"))
    )
    m = F.col("m")
    sums = margins.groupBy(*keys).agg(
        *[
            F.sum(F.when(F.col("kind") == kind, m * (m - 1) / 2)).alias(name)
            for kind, name in (("cell", "__cells"), ("row", "__rows"), ("column", "__cols"))
        ],
        F.sum(F.when(F.col("kind") == "cell", m)).alias("__total"),
    )
    n = F.col("__total")
    total = n * (n - 1) / 2
    expected = F.col("__rows") * F.col("__cols") / F.when(total > 0, total)
    maximum = 0.5 * (F.col("__rows") + F.col("__cols"))
    gap = maximum - expected
    degenerate = F.abs(gap) < 2.220446049250313e-16
    index = F.when(degenerate, F.lit(1.0)).otherwise(
        (F.col("__cells") - expected) / F.when(~degenerate, gap)
    )
    return sums.select(*keys, F.when(total > 0, index).alias("ari"))
