"""Prefix trie of conversations with totals rolled up in bands of depth."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordweave.llm.shared import map_rows
from recordweave.session import stage

PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"conversation prefixes").digest(), "big") % PRIME
CHUNK = 1024
HEAD = 8
BAND = 8
PIECE = 65_536
ROOT = bytes(16)


def extended(mark: int, digests: Iterable[bytes]) -> Iterator[int]:
    """Marks of a prefix with one more turn each time: a polynomial in the turns' digests."""
    for digest in digests:
        mark = (mark * BASE + int.from_bytes(digest, "big") + 1) % PRIME
        yield mark


def mark_of(digests: Iterable[bytes], mark: int = 0) -> int:
    for mark in extended(mark, digests):
        pass
    return mark


def crc32(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary"))


def digests(raw: bytes) -> list[bytes]:
    return [raw[i : i + 16] for i in range(0, len(raw), 16)]


def chunked(turns: DataFrame) -> DataFrame:
    """Turns in order as chunks of at most 1,024: (conv_id, part, chunk, n, digests, sizes).

    A turn is a 128-bit digest of its role and text and the text's length in bytes, so texts
    are not shuffled. Ranges of (conv_id, turn) are sorted, so a conversation of any
    length is spread over tasks; (part, chunk) is the order of its chunks.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    order = ["conv_id", "turn", "role", "digest", "tie"]
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"),
        F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32)).alias("digest"),
        F.octet_length(text).cast("bigint").alias("size"),
        F.monotonically_increasing_id().alias("tie"),  # equal rows need not stay together
    )

    def pack(rows):
        part = TaskContext.get().partitionId()
        at, number, marks, sizes = None, 0, [], []
        for conv_id, digest, size in rows:
            if conv_id != at or len(marks) == CHUNK:
                if marks:
                    yield at, part, number, len(marks), b"".join(marks), sizes
                number = number + 1 if conv_id == at else 0
                at, marks, sizes = conv_id, [], []
            marks.append(digest)
            sizes.append(size)
        if marks:
            yield at, part, number, len(marks), b"".join(marks), sizes

    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "size")
    return stage(map_rows(dealt, pack, "conv_id bigint, part int, chunk int, n int, digests binary, sizes array<bigint>", rows=512), "chunks")


def rebuilt_paths(turns: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """(conv_id, depth, node, up, size, last) along every rebuilt conversation.

    Conversation c starts with the first h = crc32(c) % ``most`` turns of conversation c - c % ``group`` (all if there are
    fewer, none if it is absent) and goes on with its own turns after its first h.
    ``node`` marks the sequence of turns up to there, ``up`` that before it, ``size`` is the
    length of the last text in bytes. Each conversation also has a row of depth 0, the
    root; ``last`` marks the row where it ends.
    """
    if most > HEAD + 1:
        raise ValueError(f"a head has {HEAD} turns at most")
    chunks = chunked(turns)

    def summed(rows):
        for conv_id, part, chunk, n, raw, sizes in rows:
            own = digests(raw)
            yield conv_id, part, chunk, n, mark_of(own).to_bytes(16, "big"), raw[: 16 * HEAD], sizes[:HEAD]

    marks = stage(
        map_rows(chunks, summed, "conv_id bigint, part int, chunk int, n int, mark binary, digests binary, sizes array<bigint>"), "marks"
    )

    def headed(rows):
        """The first turns and the length of each conversation, chunks in order."""
        for (conv_id,), group_rows in by_conv(rows):
            raw, sizes, total = b"", [], 0
            for n, own, its in group_rows:
                if len(sizes) < HEAD:
                    raw, sizes = (raw + own)[: 16 * HEAD], (sizes + its)[:HEAD]
                total += n
            yield conv_id, total, raw, sizes

    heads = stage(
        map_rows(
            marks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk").select("conv_id", "n", "digests", "sizes"),
            headed, "conv_id bigint, n bigint, digests binary, sizes array<bigint>",
        ),
        "heads",
    )
    base = heads.select(F.col("conv_id").alias("base"), F.col("digests").alias("base_digests"), F.col("sizes").alias("base_sizes"))
    convs = (
        heads.withColumn("base", F.expr(f"conv_id - conv_id % {group}"))
        .withColumn("h", F.pmod(crc32("conv_id"), F.lit(most)).cast("int"))
        .join(base, "base", "left")
        .select("conv_id", "n", "h", "digests", F.coalesce("base_digests", F.lit(b"")).alias("base_digests"),
                F.coalesce("base_sizes", F.array().cast("array<bigint>")).alias("base_sizes"))
    )
    convs = stage(convs, "conversations")

    def carried(rows):
        """For each chunk the rebuilt depth and mark before it, how many of its turns to leave out, and the depth of the end."""
        for (conv_id,), parts in by_conv(rows):
            depth = mark = offset = h = end = 0
            own: list[bytes] = []
            for kind, part, chunk, n, value, _, base in parts:
                if kind == 0:
                    h, own = part, digests(value)
                    taken = digests(base)[:h]
                    depth, mark, offset = len(taken), mark_of(taken), 0
                    end = depth + max(0, chunk - h)
                    continue
                skip = min(max(h - offset, 0), n)
                yield conv_id, part, chunk, skip, depth, mark.to_bytes(16, "big"), end
                mine = int.from_bytes(value, "big")
                if skip:
                    mine -= mark_of(own[offset : offset + skip]) * pow(BASE, n - skip, PRIME)
                mark = (mark * pow(BASE, n - skip, PRIME) + mine) % PRIME
                depth += n - skip
                offset += n

    nothing = F.lit(None).cast("binary")
    told = (
        convs.select("conv_id", F.lit(0).alias("kind"), F.col("h").alias("part"), F.col("n").alias("chunk"), F.lit(0).alias("n"),
                     F.col("digests").alias("value"), nothing.alias("_"), F.col("base_digests").alias("base"))
        .union(marks.select("conv_id", F.lit(1), "part", F.col("chunk").cast("bigint"), "n", "mark", nothing, nothing))
    )
    carries = map_rows(
        told.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "part", "chunk"), carried,
        "conv_id bigint, part int, chunk bigint, skip int, depth bigint, mark binary, end bigint",
    )

    def starts(rows):
        """The root and the turns taken from the base."""
        for conv_id, n, h, _, raw, sizes in rows:
            taken = digests(raw)[:h]
            end = len(taken) + max(0, n - h)
            yield conv_id, 0, ROOT, None, 0, end == 0
            up = ROOT
            for at, (mark, size) in enumerate(zip(extended(0, taken), sizes), 1):
                node = mark.to_bytes(16, "big")
                yield conv_id, at, node, up, size, at == end
                up = node

    def rest(rows):
        for conv_id, skip, depth, mark, end, raw, sizes in rows:
            up = mark
            for mark, size in zip(extended(int.from_bytes(mark, "big"), digests(raw)[skip:]), sizes[skip:]):
                depth += 1
                node = mark.to_bytes(16, "big")
                yield conv_id, depth, node, up, size, depth == end
                up = node

    schema = "conv_id bigint, depth bigint, node binary, up binary, size bigint, last boolean"
    chunk_rows = carries.join(chunks.withColumn("chunk", F.col("chunk").cast("bigint")), ["conv_id", "part", "chunk"])
    return stage(
        map_rows(convs, starts, schema).union(map_rows(chunk_rows.select("conv_id", "skip", "depth", "mark", "end", "digests", "sizes"), rest, schema)),
        "paths",
    )


def by_conv(rows: Iterable[tuple]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Runs of rows with one first value, streamed; a run must be read before the next one is asked for."""
    rows = iter(rows)
    row = next(rows, None)

    def one(key):
        nonlocal row
        while row is not None and row[0] == key:
            yield row[1:]
            row = next(rows, None)

    while row is not None:
        yield (row[0],), one(row[0])


def rolled_up(nodes: DataFrame, paths: DataFrame, values: list[str], band: int = BAND, scale: int = 1) -> DataFrame:
    """(node, depth, values): each value summed over the node's whole subtree.

    ``nodes`` has (node, depth, conv_id, values), depth a multiple of ``scale``; its
    ancestors are the nodes of conversation ``conv_id`` in ``paths`` at smaller depths.

    Within a band of ``band`` levels every node adds to itself and to its ancestors in
    the band, at most ``band`` rows. The tops of the bands are then a trie of their own, a
    ``band``-th as deep, with the totals of their bands as values: it is rolled up the same
    way, and the finished totals of band tops are added to their ancestors in the
    band above. So the rounds are the logarithm of the depth, and no row explodes to more than ``band``.
    """
    unit = band * scale
    keep = ["node", "depth", "conv_id", *values]

    def lifted(rows: DataFrame, first) -> DataFrame:
        """``rows`` once for each ancestor from depth ``first`` up to, and without, their own."""
        many = rows.select("conv_id", F.explode(F.expr(f"sequence({first}, depth - {scale}, {scale})")).alias("depth"), *values)
        return many.join(paths.select("conv_id", "depth", "node"), ["conv_id", "depth"]).select("node", "depth", *values)

    sums = [F.sum(v).alias(v) for v in values]
    inner = nodes.filter(f"depth % {unit} != 0")
    local = nodes.select("node", "depth", *values).union(lifted(inner, f"depth - depth % {unit}")).groupBy("node", "depth").agg(*sums)
    local = stage(local, "band")
    tops = nodes.filter(f"depth % {unit} = 0 AND depth > 0").select("node", "depth", "conv_id")
    if not tops.limit(1).count():
        return local
    above = local.join(nodes.filter(f"depth % {unit} = 0").select("node", "depth", "conv_id"), ["node", "depth"]).select(*keep)
    done = rolled_up(above, paths, values, band, unit)
    below = done.join(tops, ["node", "depth"]).select(*keep)
    return stage(local.select("node", "depth", *values).union(lifted(below, f"depth - {unit}")).groupBy("node", "depth").agg(*sums), "totals")


def id_digests(ends: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256) of the decimal ids that end at a node, ascending and comma-joined.

    Ids are sorted in ranges, so those of one node are spread over tasks, and joined to
    pieces of some 64 kB; each node's pieces are then hashed in order as they stream by.
    """
    order = ["node", "depth", "conv_id"]

    def pieces(rows):
        at, first, held, size = None, None, [], 0
        for node, depth, conv_id in rows:
            if (node, depth) != at or size >= PIECE:
                if held:
                    yield *at, first, ",".join(held)
                at, first, held, size = (node, depth), conv_id, [], 0
            held.append(str(conv_id))
            size += len(held[-1]) + 1
        if held:
            yield *at, first, ",".join(held)

    def hashed(rows):
        at, state = None, None
        for node, depth, piece in rows:
            if (node, depth) != at:
                if at:
                    yield *at, state.hexdigest()
                at, state = (node, depth), hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        if at:
            yield *at, state.hexdigest()

    some = map_rows(ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order), pieces, "node binary, depth bigint, first bigint, piece string", rows=512)
    dealt = some.repartition("node", "depth").sortWithinPartitions("node", "depth", "first").select("node", "depth", "piece")
    return map_rows(dealt, hashed, "node binary, depth bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, band: int = BAND) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations (:func:`rebuilt_paths`).

    conv_id is the node's smallest member, with depth its name; parent_conv_id is null
    for the root. n_convs counts members, n_children and n_leaves nodes, saved_tokens sums
    (n_convs - 1) times the bytes of the last text over the subtree, and ends_sha256 is
    the digest of the members that end there.

    Turns are ordered by turn, null first; equal ones by role, then by a digest of role
    and text, so equal rows follow each other and all count. A null role or text is
    empty. Rows without a conv_id belong to no conversation and are left out; the
    remainder of a negative conv_id is negative, as in SQL. No turns at all give no
    node, not even a root. Other columns are not looked at.
    """
    paths = rebuilt_paths(turns)
    nodes = stage(
        paths.groupBy("node", "depth").agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("up").alias("up"), F.min("size").alias("size")
        ),
        "nodes",
    )
    kids = nodes.filter("depth > 0").groupBy(F.col("up").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    full = stage(
        nodes.join(kids, ["node", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))), "children"
    )
    own = full.select(
        "node", "depth", "conv_id", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"),
    )
    totals = rolled_up(own, paths, ["n_leaves", "saved_tokens"], band)
    ends = id_digests(paths.filter("last"))
    # the root is every first turn's parent, so its name is put in as a value and not joined
    root = F.lit(nodes.filter("depth = 0").agg(F.min("conv_id")).first()[0]).cast("bigint")
    parents = nodes.filter("depth > 0").select(F.col("node").alias("up"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent"))
    return (
        full.join(totals, ["node", "depth"])
        .join(ends, ["node", "depth"], "left")
        .join(parents, ["up", "depth"], "left")
        .select(
            "conv_id", "depth", F.when(F.col("depth") == 1, root).otherwise(F.col("parent")).alias("parent_conv_id"), "n_convs", "n_children",
            "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )


SQL = """
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
    {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said
  FROM conversations WHERE conv_id IS NOT NULL
),
ids AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base,
    xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
      lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda b, y: xor(b >> 1, (b & 1) * 3988292384))), 4294967295) % 9 AS h
  FROM own
),
rebuilt AS (
  SELECT i.conv_id, 0 AS kind, o.pos, o.said FROM ids i JOIN own o ON o.conv_id = i.base AND o.pos <= i.h
  UNION ALL SELECT i.conv_id, 1, o.pos, o.said FROM ids i JOIN own o ON o.conv_id = i.conv_id AND o.pos > i.h
),
paths AS (
  SELECT conv_id, row_number() OVER path AS depth, list(said) OVER path AS seq, strlen(said.text) AS size
  FROM rebuilt WINDOW path AS (PARTITION BY conv_id ORDER BY kind, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL SELECT conv_id, 0, [], 0 FROM ids
),
nodes AS (SELECT seq, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(size) AS size FROM paths GROUP BY seq, depth),
named AS (SELECT p.conv_id AS member, p.depth, n.conv_id, n.n_convs, n.size FROM paths p JOIN nodes n USING (seq, depth)),
up AS (
  SELECT n.conv_id, n.depth, n.n_convs, n.size, p.conv_id AS parent
  FROM nodes n LEFT JOIN named p ON p.member = n.conv_id AND p.depth = n.depth - 1
),
kids AS (SELECT parent AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM up WHERE depth > 0 GROUP BY ALL),
sub AS (
  SELECT a.conv_id, a.depth, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.size)::BIGINT AS saved_tokens
  FROM up n JOIN named a ON a.member = n.conv_id AND a.depth <= n.depth LEFT JOIN kids k ON k.conv_id = n.conv_id AND k.depth = n.depth GROUP BY ALL
),
last AS (SELECT member, max(depth) AS depth FROM named GROUP BY member),
ends AS (SELECT n.conv_id, n.depth, string_agg(n.member::VARCHAR, ',' ORDER BY n.member) AS ids FROM last JOIN named n USING (member, depth) GROUP BY ALL)
SELECT u.conv_id, u.depth::BIGINT AS depth, u.parent AS parent_conv_id, u.n_convs, coalesce(k.n_children, 0) AS n_children,
  s.n_leaves, s.saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM up u JOIN sub s USING (conv_id, depth) LEFT JOIN kids k USING (conv_id, depth) LEFT JOIN ends e USING (conv_id, depth)
"""
