"""Idempotent table writes on plain partitioned parquet."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordweave.operators.ingest import RAW_KEY, flag_new
from recordweave.operators.membership import FILTER, key_filter, may_hold


def read_or_empty(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at ``path``, or an empty one of the same columns before its first write."""
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return like.limit(0)


def keys_path(path: str) -> str:
    """Where the key filters of the table at ``path`` lie."""
    return f"{path.rstrip('/')}_keys"


def write_key_filter(rows: DataFrame, path: str, run_id: str, count: int, **options) -> None:
    """Write the key filter of one run's partition, which replaces an earlier one."""
    own = f"{keys_path(path)}/run_id={quote(run_id, safe='')}"
    key_filter(rows, RAW_KEY, count, **options).coalesce(1).write.mode("overwrite").parquet(own)


def runs_to_read(spark: SparkSession, batch: DataFrame, path: str, run_id: str) -> list[str]:
    """Earlier runs whose partitions may hold a key of the batch, by their key filters.

    A run is one name, and there are as many as runs were stored, so the list is short
    whatever the size of the table.
    """
    like = batch.sparkSession.createDataFrame([], FILTER + ", run_id string")
    filters = read_or_empty(spark, keys_path(path), like).filter(F.col("run_id") != run_id)
    return sorted(r[0] for r in may_hold(batch, RAW_KEY, filters, "run_id").select("run_id").distinct().collect())


def append_new(spark: SparkSession, batch: DataFrame, path: str, run_id: str, **options) -> DataFrame:
    """Append unseen records under ``run_id``; returns one row of counts for the run.

    A run writes its own partition and replaces it when it is repeated after a
    failure, so a lost executor or a rerun never doubles a record. Records of the
    run itself do not count as stored.

    Beside each partition lies a filter of its keys. Only partitions that may hold a key of the batch
    are read, and the join with those is exact, so a false positive costs time only. The filter is
    written before the records, so no record is ever without one; ``options`` go to :func:`key_filter`.
    """
    columns = batch.columns
    hits = runs_to_read(spark, batch, path, run_id)
    stored = read_or_empty(spark, path, batch.withColumn("run_id", F.lit(run_id))).filter(F.col("run_id").isin(hits))
    fresh = flag_new(batch, stored).filter("is_new").select(*columns)
    # its own folder is written even without fresh rows, so nothing of an earlier try stays
    own = f"{path}/run_id={quote(run_id, safe='')}"
    fetched = batch.count()
    # at most so many keys are new; a filter for the whole batch also serves a try that failed half way
    write_key_filter(batch, path, run_id, fetched, **options)
    fresh.write.mode("overwrite").parquet(own)
    new = spark.read.schema(batch.schema).parquet(own).agg(F.count("*").alias("new"))
    return new.select(
        F.lit(run_id).alias("run_id"), F.lit(fetched).cast("bigint").alias("fetched"), "new", (F.lit(fetched) - F.col("new")).cast("bigint").alias("duplicate")
    )


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace exactly the partitions present in ``df``; other partitions stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


BRIEF_KEY = ["desk", "date"]


def _versioned(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all versions of a table, with ``version`` as text."""
    schema = spark.read.parquet(path).drop("version").schema
    return spark.read.schema(schema.add("version", "string")).parquet(path)


def replace_briefs(briefs: DataFrame, items: DataFrame, citations: DataFrame, root: str, version: str) -> None:
    """Replace briefs by (desk, date) together with their items and citations, all at once.

    A call writes its rows of the three tables under ``version`` and, last of all, the list of the briefs it
    replaces; :func:`read_briefs` looks only at versions with such a list, so a write that fails half way is never
    seen and no brief is shown with another's citations. Versions sort as text, a later one wins; a call with a version that is
    there already replaces it, so a run or batch can be tried again. A brief that lost its items has none any more. Items
    and citations of briefs that are not in ``briefs`` are left out. Superseded versions stay on disk.
    """
    replaced = briefs.select(*BRIEF_KEY).distinct()
    own = f"version={quote(version, safe='')}"
    # an earlier try of the same version is out of sight from here on
    replaced.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{root}/replaced/{own}")
    same = [F.col(f"c.{c}").eqNullSafe(F.col(f"r.{c}")) for c in BRIEF_KEY]
    briefs.write.mode("overwrite").parquet(f"{root}/briefs/{own}")
    for name, df in (("brief_items", items), ("citations", citations)):
        df.alias("c").join(replaced.alias("r"), same, "left_semi").write.mode("overwrite").parquet(f"{root}/{name}/{own}")
    replaced.coalesce(1).write.mode("overwrite").parquet(f"{root}/replaced/{own}")


def read_briefs(spark: SparkSession, root: str, name: str = "briefs") -> DataFrame:
    """``briefs``, ``brief_items`` or ``citations`` as they stand: for each (desk, date) the rows of its newest complete version."""
    newest = _versioned(spark, f"{root}/replaced").groupBy(*BRIEF_KEY).agg(F.max("version").alias("version"))
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"n.{c}")) for c in [*BRIEF_KEY, "version"]]
    return _versioned(spark, f"{root}/{name}").alias("t").join(newest.alias("n"), same, "left_semi").drop("version")


def write_edges(next_state: DataFrame, root: str, version: str) -> str:
    """Write one version of the edge table, open and closed rows apart; returns its folder.

    Readers take the newest complete version, so a failed write is never seen.
    """
    path = f"{root}/version={version}"
    next_state.withColumn("state", F.when(F.col("valid_to").isNull(), "live").otherwise("closed")).write.mode(
        "overwrite"
    ).partitionBy("state").parquet(path)
    return path
