"""Pieces that several operators share: appended columns, sorted-run readers, components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordweave.session import stage


def text_bytes(column: str = "text"):
    """The UTF-8 bytes of a text column, null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def map_rows(df: DataFrame, fn: Callable[[Iterable], Iterator[tuple]], schema: str, rows: int = 4096) -> DataFrame:
    """``fn(rows) -> tuples`` over each partition's rows as tuples of Python values, sent on in batches.

    Rows are streamed, so a task holds one Arrow batch and what ``fn`` keeps.
    """
    fields = T._parse_datatype_string(schema)
    arrow = pa.schema([(f.name, arrow_type(f.dataType)) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def feed():
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    yield from zip(*(c.to_pylist() for c in part.columns))

        out: list[tuple] = []
        for row in fn(feed()):
            out.append(row)
            if len(out) >= rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return df.mapInArrow(run, fields)


def sig(column: str = "text"):
    """64-bit mark of a text; with doc_id it tells rows apart that share an id."""
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores after it a name that no column of ``df`` has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def append(df: DataFrame, inputs: list[str], fn: Callable[..., tuple], schema: str) -> DataFrame:
    """``df`` with the columns of ``schema`` added, ``fn(*input values) -> tuple`` for each row.

    All other columns pass through as Arrow buffers, whatever their types.
    """
    fields = T._parse_datatype_string(schema)
    arrow = pa.schema([(f.name, arrow_type(f.dataType)) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fn(*row) for row in zip(*(batch.column(c).to_pylist() for c in inputs))]
            made = [pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)] if rows else [pa.array([], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], schema=pa.schema([*batch.schema, *arrow]))

    return df.mapInArrow(run, T.StructType([*df.schema, *fields]))


def arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, arrow_type(f.dataType)) for f in kind])
    return {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
        "binary": pa.binary(), "boolean": pa.bool_(),
    }[kind.simpleString()]


def runs(rows: Iterable[tuple], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows with equal first ``width`` values; one run is held at a time."""
    key, held = None, []
    for row in rows:
        if row[:width] != key:
            if held:
                yield key, held
            key, held = row[:width], []
        held.append(row[width:])
    if held:
        yield key, held


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: (node, root), root the smallest node reachable.

    Alternating large-star and small-star steps: every node hangs its larger
    neighbours on its smallest one, then the others do, until nothing moves. Each
    round is two joins on the node with one-row-per-node minima (so a hub only
    makes a long probe side, which Spark splits) and is written to the shared
    folder. Nodes without an edge do not appear. An empty table gives an empty one.
    """
    now = stage(
        edges.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )
    last = None
    for _ in range(rounds):
        sign = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if sign == last or sign[0] == 0:
            break
        last = sign
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_low, "u")
        now = stage(
            joined.filter("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
            .union(small_low.select("u", F.col("m").alias("v")))
            .distinct(),
            "edges",
        )
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
