"""Posting lists of items per entity: bitmaps where they are dense, rows where they are sparse.

Items are whole numbers. A bitmap covers 32,768 neighbouring ids in 4 kB, so it pays where an
entity has many items among them; elsewhere its items stay rows. Either way a hot
entity is cut by ranges of ids and is never one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordweave.session import stage

DENSE = 512
SPAN = 32_768


class Postings:
    """Stored posting lists: ``rows`` (entity, bucket, item, dense) and ``bitmaps`` (entity, bucket, bits) of the dense ones."""

    def __init__(self, members: DataFrame, dense: int = DENSE) -> None:
        bucket = F.bitmap_bucket_number("item").alias("bucket")
        own = stage(members.select("entity", F.col("item").cast("bigint").alias("item")).distinct().select("entity", bucket, "item"), "postings")
        full = own.groupBy("entity", "bucket").agg(F.count("*").alias("n")).filter(F.col("n") >= dense).select("entity", "bucket")
        self.rows = own
        self.sparse = own.join(full, ["entity", "bucket"], "left_anti")
        self.bitmaps = stage(
            own.join(full, ["entity", "bucket"], "left_semi").groupBy("entity", "bucket")
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("item")).alias("bits")),
            "bitmaps",
        )


def items_of(bucket: Column, bits: Column) -> Column:
    """The items of a bitmap, as an array of at most 32,768."""
    place = F.filter(F.sequence(F.lit(0), F.length(bits) - 1), lambda i: F.substr(bits, i + 1, F.lit(1)) != F.lit(b"\x00"))
    byte = lambda i: F.conv(F.hex(F.substr(bits, i + 1, F.lit(1))), 16, 10).cast("int")
    eight = lambda i: F.array_compact(F.array(*[F.when(byte(i).bitwiseAND(1 << b) != 0, i * 8 + b) for b in range(8)]))
    places = F.flatten(F.transform(place, eight))
    # ids above zero start at bucket 1, the others count down from bucket 0
    return F.transform(places, lambda p: F.when(bucket > 0, (bucket - 1) * SPAN + p + 1).otherwise(-(-bucket * SPAN + p)))


def union_by(postings: Postings, groups: DataFrame, by: str) -> DataFrame:
    """(by, item): the distinct items of all entities of each group. ``groups``: by, entity.

    Dense lists are united as bitmaps, one row for each range of ids whatever the number of
    items, and only then written out.
    """
    groups = groups.select(by, "entity").distinct()
    dense = postings.bitmaps.join(groups, "entity").groupBy(by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    whole = dense.select(by, F.explode(items_of(F.col("bucket"), F.col("bits"))).alias("item"))
    return whole.union(postings.sparse.join(groups, "entity").select(by, "item")).distinct()


def common_items(postings: Postings, pairs: DataFrame) -> DataFrame:
    """(from_id, to_id, item): the items that hold both ends of each pair.

    Two dense lists are intersected as bitmaps; where one is sparse its few items are
    looked up in the other.
    """
    pairs = pairs.select("from_id", "to_id").distinct()
    end = lambda df, name: df.withColumnRenamed("entity", name)
    first = end(postings.bitmaps, "from_id").join(pairs, "from_id").select("from_id", "to_id", "bucket", "bits")
    second = end(postings.bitmaps, "to_id").join(pairs, "to_id").select("from_id", "to_id", "bucket", "bits")
    both = first.union(second).groupBy("from_id", "to_id", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n"))
    dense = both.filter("n = 2").select("from_id", "to_id", F.explode(items_of(F.col("bucket"), F.col("bits"))).alias("item"))
    # the first end sparse, whatever the second is; then the second sparse and the first dense
    left = end(postings.sparse, "from_id").join(pairs, "from_id").join(end(postings.rows, "to_id").select("to_id", "item"), ["to_id", "item"])
    right = (
        end(postings.sparse, "to_id").join(pairs, "to_id")
        .join(end(postings.bitmaps, "from_id").select("from_id", "bucket"), ["from_id", "bucket"], "left_semi")
        .join(end(postings.rows, "from_id").select("from_id", "item"), ["from_id", "item"])
    )
    columns = ["from_id", "to_id", "item"]
    return dense.select(*columns).union(left.select(*columns)).union(right.select(*columns))
