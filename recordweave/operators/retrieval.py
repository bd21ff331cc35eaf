"""Exact vector retrieval over an embeddings table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordweave import dims
from recordweave.operators.common import top_n


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def seed_vector(seeds: DataFrame, by: str = "desk", vector: str = "embedding") -> DataFrame:
    """Mean of the seed vectors per desk: one averaged value per (desk, dimension)."""
    dims_ = seeds.select(by, F.posexplode(vector).alias("dim", "x"))
    means = dims_.groupBy(by, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    # a vector has a fixed number of dimensions, so the array is bounded
    return means.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v")).select(
        by, F.transform("v", lambda d: d["x"]).alias("query")
    )


def vector_topk(
    rows: DataFrame, queries: DataFrame, k: int = dims.PASSAGE_TOP_K, by: str = "desk", since: str | None = None, at: str = "at",
) -> DataFrame:
    """Nearest ``k`` rows per desk by cosine distance, not older than ``since`` if given.

    A row's ``by`` may be an array; the row then counts for each of its desks.

    ``queries`` has one vector per desk, which Spark sends to the rows if it is small;
    each partition keeps its own best ``k`` before anything is shuffled.
    """
    if since is not None:
        rows = rows.filter(F.col(at) >= F.lit(since).cast("timestamp"))
    if rows.schema[by].dataType.typeName() == "array":
        rows = rows.withColumn(by, F.explode(F.array_distinct(by)))
    near = rows.filter(F.col("embedding").isNotNull()).join(queries, by)
    scored = near.withColumn("distance", F.round(cosine_distance(F.col("embedding"), F.col("query")), 9))
    return top_n(scored.drop("embedding", "query"), [by], ["distance", "record_id"], k)
