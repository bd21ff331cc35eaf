"""Which stored partitions may hold a key: blocked Bloom filters kept beside each partition."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 32_768  # one bitmap of Spark's bitmap functions, 4 kB
FILTER = "blocks bigint, block bigint, bitmap binary"


def _hash(key: list[str], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(c).cast("string") for c in key])


def _bits(key: list[str], hashes: int) -> list[Column]:
    return [F.pmod(_hash(key, i + 1), F.lit(BLOCK_BITS)).cast("int") for i in range(hashes)]


def key_filter(rows: DataFrame, key: list[str], count: int, bits_per_key: float = 12.0, hashes: int = 4) -> DataFrame:
    """Filter rows (blocks, block, bitmap) of the keys of one partition that has about ``count`` of them.

    A key sets ``hashes`` bits, all inside the block its first hash names, so that one
    row answers for it. The number of blocks is a power of two that grows with the partition.
    """
    blocks = 1 << max(0, math.ceil(math.log2(max(1.0, count * bits_per_key / BLOCK_BITS))))
    placed = rows.select(F.pmod(_hash(key, 0), F.lit(blocks)).alias("block"), F.explode(F.array(*_bits(key, hashes))).alias("bit"))
    return placed.groupBy("block").agg(F.bitmap_construct_agg(F.col("bit").cast("bigint")).alias("bitmap")).select(
        F.lit(blocks).cast("bigint").alias("blocks"), F.col("block").cast("bigint").alias("block"), "bitmap"
    )


def _is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substr(bitmap, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, bit % 8) % 2 == 1


def may_hold(keys: DataFrame, key: list[str], filters: DataFrame, part: str, hashes: int = 4) -> DataFrame:
    """(part, key): the partitions that may hold each distinct key; no partition that does hold it is missing.

    ``filters``: part and the columns of :func:`key_filter`. Filters of one size meet the keys on the
    block; there are few sizes, since they are powers of two.
    """
    sizes = [r[0] for r in filters.select("blocks").distinct().collect()]  # at most 60
    if not sizes:
        return keys.select(*key).limit(0).withColumn(part, F.lit(None).cast(filters.schema[part].dataType)).select(part, *key)
    asked = keys.select(*key).distinct().withColumn("_h", _hash(key, 0)).withColumn("blocks", F.explode(F.array(*[F.lit(s).cast("bigint") for s in sizes])))
    asked = asked.withColumn("block", F.pmod("_h", "blocks"))
    met = asked.join(filters.select(part, "blocks", "block", "bitmap"), ["blocks", "block"])
    for bit in _bits(key, hashes):
        met = met.filter(_is_set(F.col("bitmap"), bit))
    return met.select(part, *key)
