"""Session creation and lineage cuts that survive executor loss."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
import zlib

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "statewalk", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster pass your own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def one_thread_per_task(spark: SparkSession) -> None:
    """Matrix products of a task use its own core only; the tasks of an executor would otherwise each
    start as many threads as there are cores. Settings the user made stay."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        spark.sparkContext.environment.setdefault(name, "1")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application: a driver may be started from any
    folder, and executors have no other way to it."""
    one_thread_per_task(spark)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="package-"), os.path.basename(root) + ".zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def fingerprint(spark: SparkSession, folder: str) -> int:
    """Changes when a file of a data folder (two levels deep) is added, removed or rewritten."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for pattern in ("/*", "/*/*"):
        for f in files.globStatus(hadoop(folder + pattern)) or ():
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return zlib.crc32(repr(sorted(found)).encode())


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names, or a fresh one in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="statewalk-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and keeps the result on
    storage that outlives the executors that produced it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.parquet(path)
