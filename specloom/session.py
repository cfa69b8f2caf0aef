"""Session helpers shared by queries, tests and the benchmark."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Checkpoint folders that go when the JVM ends.
_LEAVING: set[str] = set()
ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cpus: str = "8", app: str = "specloom") -> SparkSession:
    """A single-JVM session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", os.environ.get("SPECLOOM_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers on the same file system import this package.

    A cluster whose executors don't share the checkout ships it with ``--py-files``.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder of checkpoints and stage tables: a new one in ``spark.checkpoint.dir``, deleted when the session's JVM ends.

    Where that setting is unset, a local session (tests) gets one in its warehouse; a cluster is told to set it, since
    a folder of the driver's machine isn't shared.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir is unset; it has to name a folder that all executors share")
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        sc.setCheckpointDir(base)
    folder = sc._jsc.sc().getCheckpointDir().get()
    if folder not in _LEAVING:
        _LEAVING.add(folder)
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: what follows plans and recovers from it alone."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
