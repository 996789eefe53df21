"""Analysis-shaped views over the provided tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statewalk import config
from statewalk.functions.labels import standardize_group
from statewalk.operators.ordering import ordered_index

# Event types in the order of their state numbers.
EVENT_STATES = ("click", "error", "purchase", "signup", "view")
EVENT_K = len(EVENT_STATES)
SERIES_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
EMBEDDING_K = 10
EMBEDDING_P = 64

# Raw group spellings by user_id % 10; even users are controls.
RAW_GROUPS = (
    " Controls ", "patients", "TD", "Dyslexic", "ctrl",
    "PATIENT", "typically developing", " dyslexia", "Control", "Dyslexia",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_group(user_id: Column) -> Column:
    return F.element_at(
        F.array(*[F.lit(g) for g in RAW_GROUPS]), (user_id % 10 + 1).cast("int")
    )


def _seconds(ts: Column) -> Column:
    day = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts).cast("int")


def event_state(event_type: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in EVENT_STATES]), event_type).cast("int")


def decoded_events(
    spark: SparkSession, sf_dir: str, hot_rows: int = config.HOT_ROWS
) -> DataFrame:
    """Decoded sequences: one subject per user, one state per event type."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    placed = ordered_index(
        events, "user_id", ["ts", "event_id"],
        {"day": F.col("ts").cast("date"), "second": _seconds(F.col("ts"))}, hot_rows=hot_rows,
    )
    return placed.select(
        F.col("user_id").alias("subject_id"),
        standardize_group(raw_group(F.col("user_id"))).alias("group"),
        F.concat(F.lit("user_"), F.col("user_id")).alias("file"),
        "timepoint",
        event_state(F.col("event_type")).alias("state"),
    )


def observed_series(
    spark: SparkSession, sf_dir: str, hot_rows: int = config.HOT_ROWS
) -> DataFrame:
    """Multivariate series: one subject per supplier, p = 4 signals ``x1..x4``."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", *SERIES_COLUMNS
    )
    placed = ordered_index(
        lines, "l_suppkey",
        ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"],
        {"date": F.col("l_shipdate"), "orders": F.floor(F.col("l_orderkey") / 65536)},
        hot_rows=hot_rows,
    )
    return placed.select(
        F.col("l_suppkey").alias("subject_id"),
        F.when(F.col("l_suppkey") % 2 == 0, F.lit("TD")).otherwise(F.lit("Dyslexia")).alias("group"),
        F.concat(F.lit("supplier_"), F.col("l_suppkey")).alias("file"),
        "timepoint",
        *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(SERIES_COLUMNS, 1)],
    )


def state_observations(
    spark: SparkSession, sf_dir: str, first: int = 1, p: int = EMBEDDING_P
) -> DataFrame:
    """Signal vectors with a known state: (state, x array<double>), p signals from ``first``; by
    default all rows and the whole vector."""
    return table(spark, sf_dir, "embeddings").select(
        (F.col("label") + 1).cast("int").alias("state"),
        F.slice("embedding", first, p).cast("array<double>").alias("x"),
    )
