"""Session helpers shared by every part of the library."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "evidara", cores: int = 8, memory: str = "20g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the submitter's own session is used instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, unless their path has it already (PYTHONPATH, or the folder they start in)."""
    root = Path(__file__).resolve().parent.parent
    paths = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    context = spark.sparkContext
    if context.applicationId in _shipped or any(p and Path(p).resolve() == root for p in paths):
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="evidara-package-"), "evidara"), "zip", root, "evidara")
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def scratch_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs in one process, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("on a cluster, set spark.checkpoint.dir to a folder that all its machines share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="evidara-checkpoint-"))
    return context.getCheckpointDir()


#: With this setting a query's shuffle files go as soon as it has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of df with a reliable checkpoint in the shared folder.

    The shuffle files behind it, which nothing reads again, go at once; else they stay until the driver collects its garbage.
    The plan that is written takes the setting when it is made, so it is made anew here.
    """
    spark = df.sparkSession
    scratch_folder(spark)
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(CLEAN_UP, before)


def durable_by(df: DataFrame, *keys: str) -> DataFrame:
    """As durable, dealt by the keys in a way that later joins and groupings by them find, and so move only their other side.

    A checkpoint keeps how its rows are dealt only where the plan is not re-planned as it runs.
    """
    spark = df.sparkSession
    scratch_folder(spark)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.repartition(shuffle_partitions(spark), *keys).checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's own width for shuffles; operators scale their bucket counts from it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
