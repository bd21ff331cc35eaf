"""Vector search by an inverted file of cells and rings that loses no neighbour.

Vectors are cut to length one, where cosine distance ``c`` and straight-line distance ``d`` say the same:
``d = sqrt(2 c)``. Every vector lies in the cell of its nearest centroid, in a ring of distances
from it. By the triangle inequality a query at distance ``q`` from the centroid is at least ``q - hi`` and
``lo - q`` away from all of a ring (lo, hi), so a ring further than the ``k``-th best found is never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordweave import dims
from recordweave.operators.common import top_n
from recordweave.operators.retrieval import cosine_distance, dot
from recordweave.session import run_dir

# distances are rounded to nine digits, and ties at the k-th place must all be seen
SLACK = 2e-9


@dataclass(frozen=True)
class Index:
    """Where an index lies: rows by cell, centroids, and one line of figures per ring, desk and day."""

    spark: SparkSession
    root: str

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/rows")

    @property
    def centroids(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/centroids")

    @property
    def rings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/rings")


def unit(vector: Column) -> Column:
    """The vector in doubles at length one; null where it is null, empty, zero or holds a null or NaN."""
    size = F.sqrt(dot(vector, vector))
    return F.when((size > 0) & (size < float("inf")), F.transform(vector, lambda x: x.cast("double") / size))


def straight(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def build(
    rows: DataFrame, cells: int = 256, rings: int = 16, sample: int = 100_000, by: str = "desk", at: str = "at",
    root: str | None = None, seed: int = 7,
) -> Index:
    """Index ``rows`` (record_id, embedding, ``by`` one desk or an array, ``at`` timestamp).

    Centroids come from at most about ``sample`` rows; every row is indexed. All vectors have one length. Rows without a direction (see
    :func:`unit`) have no cosine distance and are left out. A ring's figures are kept per desk and day, so a
    search with filters knows how many rows a ring has for it. Rows are cut into files by ranges of (cell, ring, record_id), so a cell
    that holds a third of all rows is spread over many tasks and files.
    """
    spark = rows.sparkSession
    root = root or run_dir(spark, "vector-index")
    desks = F.col(by) if rows.schema[by].dataType.typeName() == "array" else F.array(by)
    clean = rows.select("record_id", "embedding", F.array_compact(F.array_distinct(desks)).alias(by), at, unit(F.col("embedding")).alias("_unit"))
    clean = clean.filter(F.col("_unit").isNotNull()).withColumn("_point", array_to_vector("_unit"))
    count = clean.count()
    if count == 0:
        found = spark.createDataFrame([], "cell int, centroid array<double>")
        placed = clean.drop("_unit", "_point").withColumns({"cell": F.lit(0), "r": F.lit(0.0), "ring": F.lit(0)})
    else:
        few = clean.sample(min(1.0, sample / count), seed).select("_point") if sample < count else clean.select("_point")
        means = KMeans(k=max(1, min(cells, count)), featuresCol="_point", predictionCol="cell", seed=seed, maxIter=10)
        model = means.fit(few) if few.take(1) else means.setK(1).fit(clean.limit(1))
        centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
        found = spark.createDataFrame(centres, "cell int, centroid array<double>").coalesce(1)
        # at most ``cells`` rows, whatever the size of the table
        placed = model.transform(clean).join(F.broadcast(found), "cell").withColumn("r", straight(F.col("_unit"), F.col("centroid")))
        # unit vectors and means of them are at most two apart
        placed = placed.withColumn("ring", F.least(F.floor(F.col("r") * (rings / 2)), F.lit(rings - 1)).cast("int")).drop("_unit", "_point", "centroid")
    found.write.mode("overwrite").parquet(f"{root}/centroids")
    if count == 0:
        placed.coalesce(1).write.mode("overwrite").parquet(f"{root}/rows")  # without folders, so a file tells the columns
    else:
        ordered = placed.repartitionByRange("cell", "ring", "record_id").sortWithinPartitions("cell", "ring")
        ordered.write.mode("overwrite").partitionBy("cell").parquet(f"{root}/rows")
    stored = spark.read.parquet(f"{root}/rows")
    figures = stored.withColumn(by, F.explode(by)).withColumn("day", F.col(at).cast("date")).groupBy("cell", "ring", by, "day").agg(
        F.min("r").alias("lo"), F.max("r").alias("hi"), F.count("*").alias("rows")
    )
    figures.coalesce(1).write.mode("overwrite").parquet(f"{root}/rings")
    return Index(spark, root)


def bounds(index: Index, queries: DataFrame, by: str = "desk", since: str | None = None) -> DataFrame:
    """(query_id, by, query, cell, ring, near, rows): rings of a query's desk with the least distance they allow.

    With ``since`` a day counts as a whole, except that ``rows`` leaves out the day ``since`` falls on: it is
    a number of rows that are there for sure.
    """
    figures = index.rings
    sure = F.col("rows")
    if since is not None:
        day = F.lit(since).cast("timestamp").cast("date")
        figures = figures.filter(F.col("day") >= day)
        sure = F.when(F.col("day") > day, F.col("rows")).otherwise(0)
    figures = figures.groupBy("cell", "ring", by).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum(sure).alias("rows"))
    asked = queries.select("query_id", by, "query", unit(F.col("query")).alias("_unit")).filter(F.col("_unit").isNotNull())
    met = asked.join(figures, by).join(index.centroids, "cell")
    q = straight(F.col("_unit"), F.col("centroid"))
    near = F.greatest(q - F.col("hi"), F.col("lo") - q, F.lit(0.0))
    return met.select("query_id", by, "query", "cell", "ring", near.alias("near"), "rows")


def _scan(index: Index, visits: DataFrame, k: int, by: str, since: str | None, at: str) -> DataFrame:
    """The nearest ``k`` rows of each query among the rings it visits."""
    # cells are folders; there are as many as centroids
    cells = sorted(r[0] for r in visits.select("cell").distinct().collect())
    rows = index.rows.filter(F.col("cell").isin(cells))
    if since is not None:
        rows = rows.filter(F.col(at) >= F.lit(since).cast("timestamp"))
    met = rows.withColumn(by, F.explode(by)).join(visits, ["cell", "ring", by])
    scored = met.withColumn("distance", F.round(cosine_distance(F.col("embedding"), F.col("query")), 9))
    return top_n(scored.select("query_id", by, "record_id", "distance"), ["query_id", by], ["distance", "record_id"], k)


def search(
    index: Index, queries: DataFrame, k: int = dims.PASSAGE_TOP_K, by: str = "desk", since: str | None = None, at: str = "at",
) -> tuple[DataFrame, DataFrame]:
    """(query_id, desk, record_id, distance, rank) of the nearest ``k`` rows, and what was read for it.

    The same rows as a scan of the whole table. ``queries``: query_id, desk, query. First the nearest rings
    that hold ``k`` rows for sure are read, which gives a distance the ``k``-th neighbour cannot exceed; then all rings
    that may hold one as near. The second table has query_id, ``by``, rings and rows read, and rows of the desk in all.
    """
    spark = index.spark
    root = run_dir(spark, "vector-search")
    bounds(index, queries, by, since).write.parquet(f"{root}/bounds")
    reach = spark.read.parquet(f"{root}/bounds")
    order = Window.partitionBy("query_id", by).orderBy("near", "cell", "ring")
    before = F.coalesce(F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = reach.withColumn("_before", before).filter(F.col("_before") < k).drop("_before")
    _scan(index, first, k, by, since, at).filter(F.col("rank") == k).select("query_id", by, F.col("distance").alias("kth")).write.parquet(f"{root}/kth")
    kth = spark.read.parquet(f"{root}/kth")
    # fewer than k rows: everything is visited
    limit = F.sqrt(2 * (F.greatest(F.col("kth"), F.lit(0.0)) + SLACK)) + 1e-7
    visits = reach.join(kth, ["query_id", by], "left").filter(F.col("kth").isNull() | (F.col("near") <= limit)).drop("kth", "near")
    visits.write.parquet(f"{root}/visits")
    visits = spark.read.parquet(f"{root}/visits")
    told = visits.groupBy("query_id", by).agg(F.count("*").alias("rings"), F.sum("rows").alias("rows_read")).join(
        reach.groupBy("query_id", by).agg(F.sum("rows").alias("rows_all")), ["query_id", by]
    )
    return _scan(index, visits.drop("rows"), k, by, since, at), told
