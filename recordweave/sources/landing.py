"""Readers of landed payload files, for batch and for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LANDED = "payload string, probe_desks array<string>, probe_theme string, fetched_at timestamp"


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """Landed answers as parquet or JSON lines with the declared envelope."""
    fmt = "json" if path.rstrip("/").endswith(".json") else "parquet"
    return spark.read.schema(LANDED).format(fmt).load(path)


def read_files(spark: SparkSession, path: str, desks: list[str], theme: str) -> DataFrame:
    """Bare payload files, one payload per file, under one probe."""
    return spark.read.text(path, wholetext=True).select(
        F.col("value").alias("payload"), F.array(*[F.lit(d) for d in desks]).alias("probe_desks"),
        F.lit(theme).alias("probe_theme"), F.current_timestamp().alias("fetched_at"),
    )


def stream_landed(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(LANDED).format("parquet").option("maxFilesPerTrigger", files_per_trigger).load(path)
    )
