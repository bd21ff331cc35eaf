"""Session helpers. Nothing here is needed on a cluster that brings its own session."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(
    cpus: int | str = "*", app: str = "recordweave", partitions: int = 8, checkpoint_dir: str | None = None
) -> SparkSession:
    """A local session for tests and the bench; on a cluster use the session you are given.

    ``checkpoint_dir`` is taken only where Spark's own defaults name none.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", os.environ.get("RECORDWEAVE_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    if checkpoint_dir and _named_dir(spark) is None:
        spark.stop()
        spark = builder.config("spark.checkpoint.dir", checkpoint_dir).getOrCreate()
    return spark


def _named_dir(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` as the cluster names it.

    There is no fallback: a folder of one machine would not be seen by the others.
    """
    root = _named_dir(spark)
    if not root:
        raise RuntimeError("this job stages its steps: set spark.checkpoint.dir to a folder that all executors can reach")
    return root


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of :func:`shared_dir` for one run of one job."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


# Spark drops the shuffle files of a statement when it ends, and not when the driver next collects garbage
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PARTITIONS = "spark.sql.shuffle.partitions"


def stage(df: DataFrame, name: str, tasks: int = 0) -> DataFrame:
    """Write a step of a job to the shared folder and go on from the written table.

    Use it where several later steps read the same costly result: it is computed
    once, the plan of what follows stays short, and a lost executor costs a reread.
    What was shuffled for it is not read again and goes from the executors' disks as soon as the table is written.
    Its shuffles are cut into at least ``tasks`` parts, where the session asks for fewer.
    """
    spark = df.sparkSession
    path = run_dir(spark, name)
    conf = {FREE_SHUFFLES: "true"}
    if tasks > int(spark.conf.get(PARTITIONS)):
        conf[PARTITIONS] = str(tasks)
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)
