"""Near-duplicates: SimHash links by pigeonhole blocks, checked and widened by Jaccard similarity, components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordweave.llm.shared import components, map_rows, runs, sig, text_bytes
from recordweave.session import stage

BITS = 64
BANDS, ROWS = 40, 6
ORDERS = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
ORDERS[1] |= np.uint64(1)


def shingles(text: bytes, width: int, seed: int = 42) -> np.ndarray:
    """64-bit hashes of a text's word shingles, in order, repeats included.

    Words are runs of bytes other than ASCII white space, A-Z in lower case; fewer
    than ``width`` words make one shingle; no words give none.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, n)


def simhash(text: bytes, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles, repeats counted; no words give 0.

    A bit is 1 if it is set in over half of the shingle hashes.
    """
    hashes = shingles(text, width, seed)
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):
        part = hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def masks(blocks: int, distance: int) -> list[int]:
    """Block masks by the pigeonhole rule: with ``blocks`` blocks, two fingerprints within
    ``distance`` bits agree on all of some ``blocks - distance`` blocks."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(parts, blocks - distance)]


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def forest(values: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Spanning forest of the graph that links values within ``distance`` bits.

    Each value is compared once with those not yet reached, so a dense group costs
    little and gives one link a value instead of all pairs.
    """
    rest = np.unique(values)
    while len(rest):
        todo, rest = [rest[-1]], rest[:-1]
        while todo and len(rest):
            at = todo.pop()
            near = np.bitwise_count(rest ^ at) <= distance
            if near.any():
                found = rest[near]
                rest = rest[~near]
                todo.extend(found)
                for value in found.tolist():
                    yield int(at), value


def links(prints: DataFrame, distance: int = 4, blocks: int = 7, tile: int = 4096) -> DataFrame:
    """Links (a, b) that connect all values of the long column ``fp`` within ``distance`` bits.

    Values (distinct ones) meet on blocks: 35 keys of 27 or 28 bits by default, enough
    for buckets to stay small as the table grows. Only buckets with company go on. A
    bucket beyond ``tile`` values is dealt into tiles and each pair of tiles is one
    unit of work, so no task holds more than two tiles and no pair is left out. A unit
    gives a spanning forest of its links, never all pairs. The keys are never broadcast: Spark
    sizes them as if a value had one key and would send all of them through the driver.
    """
    keyed = prints.select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks(blocks, distance)])).alias("t", "k"),
    )
    sizes = keyed.groupBy("t", "k").count().filter("count > 1")
    tiles = F.ceil(F.col("count") / tile).cast("int")
    met = (
        keyed.hint("merge").join(sizes, ["t", "k"])
        .select("t", "k", "fp", tiles.alias("n"))
        .withColumn("i", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
        .select(
            "t", "k", "fp", "i",
            F.explode(F.when(F.col("n") == 1, F.array(F.lit(0))).otherwise(F.expr("filter(sequence(0, n - 1), j -> j != i)"))).alias("j"),
        )
        .select("t", "k", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "fp")
    )
    dealt = met.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j")

    def unit(rows: Iterable[tuple]) -> Iterator[tuple]:
        for _, group in runs(rows, 4):
            if len(group) == 2:
                (a,), (b,) = group
                if a != b and ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= distance:
                    yield a, b
            else:
                yield from forest(np.array([g[0] for g in group], np.int64), distance)

    return map_rows(dealt, unit, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Texts whose fingerprints differ in at most ``distance`` bits are linked;
    component_id is the smallest doc_id that can be reached. Copies share a fingerprint
    and stand for one node. A null text counts as empty (fingerprint zero), a null
    doc_id never names a component while another is there. Repeated rows come out as
    often as they went in; other columns are not looked at.
    """
    def each(rows):
        for doc_id, text in rows:
            yield doc_id, signed(simhash(text))

    rows = stage(map_rows(docs.select("doc_id", text_bytes().alias("text")), each, "doc_id bigint, fp bigint"), "simhash")
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(stage(links(prints, distance), "links")).withColumnsRenamed({"node": "fp"})
    named = stage(prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return (
        rows.join(named.join(lows, "root").select("fp", "component_id"), "fp")
        .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    )


def minhash(hashes: np.ndarray) -> np.ndarray:
    """Smallest value of a set of hashes under each of the ``BANDS * ROWS`` orders."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        part = (hashes[None, at : at + 512] ^ ORDERS[0][:, None]) * ORDERS[1][:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return low


def forest_over(rows: list[tuple], least: float, share: float | None = None) -> Iterator[tuple[int, int]]:
    """Links (a, b) that join different roots among (node, root, sketch) or (node, root, sketch, grams).

    Two nodes are linked if their sketches agree in ``least`` or more and, with a
    ``share``, their sets of grams have that Jaccard similarity. Only nodes of different roots are compared,
    likeliest first, and a link makes two roots one, so there are fewer links than roots.
    """
    nodes, roots, marks = (list(c) for c in list(zip(*rows))[:3])
    label = np.unique(np.array(roots), return_inverse=True)[1]
    marks = np.frombuffer(b"".join(marks), np.uint8).reshape(len(nodes), -1)
    sets = [np.frombuffer(r[3], np.uint64) for r in rows] if share is not None else None
    for i, node in enumerate(nodes):
        other = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if not len(other):
            continue
        agree = (marks[other] == marks[i]).mean(axis=1)
        near = np.flatnonzero(agree >= least)
        for j in other[near[np.argsort(-agree[near], kind="stable")]].tolist():
            if label[j] != label[i] and (share is None or alike(sets[i], sets[j], share)):
                label[label == label[j]] = label[i]
                yield min(node, nodes[j]), max(node, nodes[j])


def alike(x: np.ndarray, y: np.ndarray, share: float) -> bool:
    """Whether two sets of distinct grams have a Jaccard similarity of ``share`` or more."""
    most = min(len(x), len(y)) / max(len(x), len(y), 1)
    if most < share - 1e-6 and len(x) + len(y):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both * 10**6 >= round(share * 10**6) * (len(x) + len(y) - both)


def similar_rows(
    docs: DataFrame, width: int = 5, share: float = 0.8, tile: int = 4096, tile_bytes: int = 16_000_000, distance: int = 4
) -> DataFrame:
    """(doc_id, sig, root) for every row of ``docs``: rows of one root are linked, ``sig`` marks the text.

    Texts whose sets of shingles of ``width`` words have a similarity of ``share`` or more are linked.
    Equal sets are one node. Every link is verified on the sets themselves.

    1. SimHash: fingerprints within ``distance`` bits (:func:`links`) link the smallest nodes that have them,
       and nodes of one fingerprint are linked to the smallest of them.
    2. At ``share`` fingerprints differ by 5 to 13 bits as a rule, where SimHash has no short list of keys. So
       nodes meet in 40 bands of 6 smallest hashes too. Each band bucket is held against its
       smallest node, which joins up a dense group with one link a node.
    3. Buckets that still hold several components are dealt in tiles of nodes; sketches within four standard
       deviations of ``share`` join components into clusters, by fewer links than nodes.
    4. The sets of a cluster of several components meet once, in tiles of ``tile_bytes``. There
       nodes of different components are verified, and a link that holds makes them one; so a
       tile gives fewer links than it has nodes and no pair of texts leaves it unverified.

    A pair at 0.8 is missed by the bands with a chance of 5 in a million and by the sketches
    with one of about 3 in 100,000.
    """
    least = share - 4 * (share * (1 - share) / (BANDS * ROWS)) ** 0.5

    def sketched(rows):
        for doc_id, mark, text in rows:
            own = np.unique(shingles(text, width))
            low = minhash(own)
            keys = (low.reshape(BANDS, ROWS) * ORDERS[1][:ROWS]).sum(axis=1, dtype=np.uint64).view(np.int64)
            sketch = (low >> np.uint64(24)).astype(np.uint8).tobytes()
            yield doc_id, mark, signed(simhash(text)), signed(xxhash.xxh64_intdigest(own.tobytes())), keys.tolist(), sketch

    def whole(rows):
        for (text,) in rows:
            own = np.unique(shingles(text, width)).tobytes()
            yield signed(xxhash.xxh64_intdigest(own)), own

    def verified(rows):
        for a, b, x, y in rows:
            if alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), share):
                yield a, b

    def by_sketch(rows):
        for _, group in runs(rows, 4):
            yield from forest_over(group, least)

    def by_set(rows):
        for _, group in runs(rows, 3):
            yield from forest_over(group, least, share)

    def tiled(rows: DataFrame, count: str, keys: list[str], rest: list[str]) -> DataFrame:
        """Rows of each group dealt to its pairs of tiles, ``count`` tiles in all."""
        own = F.expr(f"filter(sequence(0, {count} - 1), j -> j != i)")
        return (
            rows.withColumn("i", F.pmod(F.xxhash64("node"), F.col(count)).cast("int"))
            .withColumn("j", F.explode(F.when(F.col(count) == 1, F.array(F.lit(0))).otherwise(own)))
            .select(*keys, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), *rest)
            .repartition(*keys, "i", "j")
            .sortWithinPartitions(*keys, "i", "j")
        )

    rows = stage(
        map_rows(docs.select("doc_id", sig().alias("sig"), text_bytes().alias("text")), sketched,
                 "doc_id bigint, sig bigint, fp bigint, node bigint, keys array<bigint>, sketch binary"),
        "prints",
    )
    # the links of fingerprints, as links of nodes
    prints = stage(rows.select("fp", "node").distinct(), "nodes")
    lows = prints.groupBy("fp").agg(F.min("node").alias("low"))
    one, two = (lows.select(F.col("fp").alias(f"_{c}"), F.col("low").alias(c)) for c in "ab")
    close = links(lows, distance, tile=tile).toDF("_a", "_b").join(one, "_a").join(two, "_b").select("a", "b")
    close = close.union(prints.join(lows, "fp").select(F.col("low").alias("a"), F.col("node").alias("b")))
    close = stage(close.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "close")

    keyed = rows.select("node", "keys").dropDuplicates(["node"]).select("node", F.posexplode("keys").alias("t", "k"))
    company = keyed.groupBy("t", "k").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).filter("n > 1")
    # Spark sizes the exploded keys as one a node, so a broadcast of them could be forty times what it expects
    met = stage(keyed.hint("merge").join(company, ["t", "k"]), "met")
    sets = stage(
        map_rows(docs.select(text_bytes().alias("text")), whole, "node bigint, grams binary", rows=128)
        .join(met.select("node").union(close.select(F.explode(F.array("a", "b")))).distinct(), "node", "left_semi")
        .dropDuplicates(["node"]),
        "sets",
    )
    marks = rows.select("node", "sketch").dropDuplicates(["node"])
    pair = "a bigint, b bigint"

    stars = met.filter("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).union(close).distinct()
    one, two = (sets.select(F.col("node").alias(c), F.col("grams").alias(f"_{c}")) for c in "ab")
    near = stage(map_rows(stars.join(one, "a").join(two, "b").select("a", "b", "_a", "_b"), verified, pair), "near")
    named = stage(met.join(components(near), "node", "left").withColumn("root", F.coalesce("root", "node")), "named")

    # of two nodes in a bucket the star was the only pair
    split = (
        named.groupBy("t", "k").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("n").alias("size"))
        .filter("lo != hi AND size > 2").select("t", "k", F.ceil(F.col("size") / tile).cast("int").alias("m"))
    )
    open_ = named.select("t", "k", "node", "root").join(split, ["t", "k"]).join(marks, "node")
    guessed = stage(map_rows(tiled(open_, "m", ["t", "k"], ["node", "root", "sketch"]), by_sketch, pair), "guessed")

    clusters = components(near.union(guessed))
    own = named.select("node", "root").distinct().join(clusters.withColumnRenamed("root", "c"), "node").join(sets, "node")
    sizes = own.groupBy("c").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.sum(F.length("grams") + 300).alias("size"))
    several = sizes.filter("lo != hi").select("c", F.ceil(F.col("size") / tile_bytes).cast("int").alias("m"))
    held = own.join(several, "c").join(marks, "node")
    rest = stage(map_rows(tiled(held, "m", ["c"], ["node", "root", "sketch", "grams"]), by_set, pair), "rest")
    roots = components(near.union(rest))
    return rows.select("doc_id", "sig", "node").join(roots, "node", "left").select("doc_id", "sig", F.coalesce("root", "node").alias("root"))


def similar(docs: DataFrame, width: int = 5, share: float = 0.8, tile: int = 4096, tile_bytes: int = 16_000_000) -> DataFrame:
    """(doc_id, component_id) for every row of ``docs``, linked as in :func:`similar_rows`.

    component_id is the smallest doc_id that can be reached, as in :func:`near_duplicates`.
    """
    rows = stage(similar_rows(docs, width, share, tile, tile_bytes), "alike")
    return rows.join(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of similar ones (:func:`similar_rows`): that of the smallest doc_id.

    Rows are told apart by doc_id and text, so unlike texts under one doc_id both stay
    and a known text under several goes but once. Of equal rows one stays, whatever is in
    their other columns. Rows without a doc_id cannot be told apart and all stay. Columns are those of
    ``docs``, whatever their names.
    """
    rows = similar_rows(docs).filter("doc_id IS NOT NULL")
    keep = rows.groupBy("root").agg(F.min(F.struct("doc_id", "sig")).alias("first")).select("first.*").toDF("_kept_id", "_kept_sig").distinct()
    known = docs.filter(F.col("doc_id").isNotNull())
    same = (known["doc_id"] == keep["_kept_id"]) & (F.xxhash64(F.coalesce(known["text"].cast("string"), F.lit(""))) == keep["_kept_sig"])
    return known.join(keep, same, "left_semi").dropDuplicates(["doc_id", "text"]).unionByName(docs.filter(F.col("doc_id").isNull()))
