"""Session settings and lineage handling shared by every operator."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers through Spark's file server, once per application.

    The Arrow functions are pickled by reference, so executors must be able to
    import them whatever their working directory is.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "skyledger")
    sc.addPyFile(shutil.make_archive(target, "zip", os.path.dirname(package), os.path.basename(package)))
    _SHIPPED.add(sc.applicationId)


def apply_runtime_conf(spark: SparkSession) -> SparkSession:
    """Set the session options the operators rely on; safe to call repeatedly."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def local_session(cpus: int | str = 8, app: str = "skyledger") -> SparkSession:
    """A local session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return apply_runtime_conf(spark)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for checkpoints and intermediate tables.

    Taken from ``spark.checkpoint.dir``. A temporary folder is used only where
    the setting is absent and the master is local.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), "skyledger", f"{name}-{uuid.uuid4().hex}")


#: Rows that a task of :func:`tasks_for` holds, about.
TASK_ROWS = 500_000


def tasks_for(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """Tasks for an exchange of ``df``: one for about every ``rows`` rows, so that a task's memory does not grow with the table."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so a lost executor never replays an iteration."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    For an expensive result that several later steps use: the table survives
    executor loss, keeps column pruning, and gives the optimizer a true size.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
