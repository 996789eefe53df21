"""Writers for result tables, matrices and settings."""

from __future__ import annotations

import platform
from collections.abc import Mapping, Sequence

import numpy
import pandas
import pyarrow
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statewalk.operators.matrices import check_names, matrix_wide


class Output:
    """A result folder. ``fresh`` refuses to write into tables that already exist."""

    def __init__(self, spark: SparkSession, folder: str, fresh: bool = False):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.mode = "errorifexists" if fresh else "overwrite"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def table(self, df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
        """Write a parquet table of any size and return it as read back."""
        writer = df.write.mode(self.mode)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path(name))
        return self.spark.read.parquet(self.path(name))

    def report(self, df: DataFrame, name: str, digits: int | None = None) -> DataFrame:
        """A report table (one row per state, pair or setting) as parquet and as one CSV file."""
        saved = self.table(df, name)
        saved.coalesce(1).write.mode(self.mode).option("header", True).csv(
            self.path(name + "_csv")
        )
        if digits is not None:
            rounded = saved.select(
                *[
                    F.round(f"`{f.name}`", digits).alias(f.name)
                    if f.dataType.typeName() == "double" else F.col(f"`{f.name}`")
                    for f in saved.schema.fields
                ]
            )
            rounded.coalesce(1).write.mode(self.mode).option("header", True).csv(
                self.path(name + "_rounded_csv")
            )
        return saved

    def matrices(
        self, upper: DataFrame, value: str, name: str, names: Sequence[str]
    ) -> None:
        """p x p CSV matrices, row names in the first column, one folder ``state=s`` per state."""
        check_names(upper, names, "j")
        label = F.get(F.array(*[F.lit(n) for n in names]), F.col("i") - 1)
        wide = matrix_wide(upper, value, len(names)).repartition("state").sortWithinPartitions("i")
        wide.select(
            "state", label.alias("roi"),
            *[F.col(f"roi_{j}").alias(n) for j, n in enumerate(names, 1)],
        ).write.mode(self.mode).partitionBy("state").option("header", True).csv(self.path(name))

    def settings(self, values: Mapping[str, object], name: str) -> DataFrame:
        rows = [(k, str(v)) for k, v in values.items()]
        return self.report(self.spark.createDataFrame(rows, "setting string, value string"), name)

    def versions(self, name: str = "package_versions") -> DataFrame:
        rows = [
            ("python", platform.python_version()), ("pyspark", pyspark.__version__),
            ("numpy", numpy.__version__), ("pandas", pandas.__version__),
            ("pyarrow", pyarrow.__version__),
        ]
        return self.report(self.spark.createDataFrame(rows, "package string, version string"), name)
