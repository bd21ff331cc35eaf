"""Best-fit packing of documents into fixed-length sequences by linear grouping."""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordweave.llm.shared import append, map_rows, text_bytes
from recordweave.session import stage

VOCABULARY = "byte_bpe_50k"
LENGTH = 2048
PARTS, NUMBERS = (8, 3), (24, 48)  # tried bounds of small lengths, as parts of a sequence, and numbers of groups


# splits texts whose white space is single spaces and line feeds as the public pattern does, without looking ahead
SIMPLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"


class Encoder:
    """Token ids of the byte-level vocabulary, those of its ``tokenizers`` file.

    Its rank file gives the same ids in a third of the time. Texts with single gaps
    between visible characters are split by a pattern without look-ahead.
    """

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        special = {"<|endoftext|>": len(ranks)}
        self.special = set(special)
        self.simple, self.plain = (
            tiktoken.Encoding(vocabulary, pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
            for pattern in (SIMPLE, public_tokenizers.PATTERN)
        )

    def __call__(self, text: str) -> bytes:
        if regular(text):
            ids = self.simple.encode_to_numpy(text, disallowed_special=())
        else:
            ids = self.plain.encode_to_numpy(text, allowed_special=self.special)
        return ids.astype("<u4").tobytes()


def regular(text: str) -> bool:
    """Only single spaces and single line feeds as white space, each between visible characters."""
    if "<|" in text or "  " in text or "\n\n" in text or "\n " in text or " \n" in text:
        return False
    return bool(text) and not SPACE.search(text) and text[0] not in " \n" and text[-1] not in " \n"


# white space other than space and line feed, as patterns and str.split see it
SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f]")


@lru_cache(maxsize=1)
def encoder(vocabulary: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(vocabulary)


def tokens(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, end: int = 0, keep_ids: bool = True) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32, ids) of at most ``length`` tokens.

    A document is its ids and one ``end`` id. One beyond ``length`` is cut from its end
    into full pieces, so that only the first may be shorter. A null text is an empty one.
    """
    def each(rows):
        encode = encoder(vocabulary)
        tail = np.array([end], "<u4").tobytes()
        for doc_id, text in rows:
            ids = encode(text or "") + tail
            n = len(ids) // 4
            cuts = [0, *range(n % length or length, n + 1, length)]
            for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                part = ids[4 * a : 4 * b]
                yield doc_id, piece, a, b - a, zlib.crc32(part), part if keep_ids else None

    return map_rows(
        docs.select("doc_id", F.col("text").cast("string")), each,
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary", rows=512,
    )


# ------------------------------------------------------------------ the plan over lengths


def groups(counts: dict[int, int], small: int, number: int) -> list[list[tuple[int, int]]]:
    """Large lengths from the longest down, in ``number`` groups of equally many pieces.

    Each group is [(length, pieces)]; its first length is what all are rounded up to.
    With no more lengths than groups each is its own and nothing is rounded.
    """
    large = [(n, c) for n, c in sorted(counts.items(), reverse=True) if n > small and c]
    if len(large) <= number:
        return [[x] for x in large]
    each = -(-sum(c for _, c in large) // number) if large else 0
    out, room = [], 0
    for n, c in large:
        while c:
            if not room:
                out.append([])
                room = each
            take = min(c, room)
            out[-1].append((n, take))
            c, room = c - take, room - take
    return out


def configurations(sizes: list[int], wanted: list[int], length: int) -> list[tuple[tuple[int, ...], int]]:
    """[(slots per size, how many sequences)] that hold all wanted pieces of few sizes.

    Column generation: a linear programme over the known configurations, priced by
    its dual values; a knapsack over the capacity finds the configuration that saves
    most, until none does. The fractional answer is rounded down and what remains is
    filled with the fullest configurations left.
    """
    n = len(sizes)
    if not n:
        return []
    columns = [tuple((length // sizes[i]) * (i == j) for j in range(n)) for i in range(n)]
    basis = np.array(columns, float).T
    demand = np.array(wanted, float)
    held = list(columns)
    inverse = np.linalg.inv(basis)
    x = inverse @ demand
    for _ in range(8 * n):
        duals = np.ones(n) @ inverse
        worth, column = knapsack(sizes, duals, [length] * n, length)
        if worth <= 1 + 1e-7:
            break
        step = inverse @ np.array(column, float)
        up = step > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, step, 1), np.inf)
        out = int(np.argmin(ratio))
        theta = ratio[out]
        x = x - theta * step
        x[out] = theta
        held[out] = column
        basis[:, out] = column
        inverse = np.linalg.inv(basis)
    left = list(wanted)
    chosen: dict[tuple[int, ...], int] = defaultdict(int)
    for column, times in sorted(zip(held, x), key=lambda c: -c[1]):
        times = int(times + 1e-9)
        for i, slots in enumerate(column):
            if slots:
                times = min(times, left[i] // slots)
        if times > 0:
            chosen[column] += times
            left = [a - times * b for a, b in zip(left, column)]
    while any(left):
        _, column = knapsack(sizes, [float(s) for s in sizes], left, length)
        times = min(left[i] // slots for i, slots in enumerate(column) if slots)
        chosen[column] += times
        left = [a - times * b for a, b in zip(left, column)]
    return sorted(chosen.items(), reverse=True)


def knapsack(sizes, worth, most, length) -> tuple[float, tuple[int, ...]]:
    """The most valuable choice of sizes within ``length``, at most ``most[i]`` of each."""
    best = np.zeros(length + 1)
    took = []
    for size, value, limit in zip(sizes, worth, most):
        count = np.zeros(length + 1, np.int64)
        if value > 0 and limit:
            base = best
            best = base.copy()
            for k in range(1, min(limit, length // size) + 1):
                other = base[: length + 1 - k * size] + k * value
                better = other > best[k * size :] + 1e-12
                best[k * size :][better] = other[better]
                count[k * size :][better] = k
        took.append(count)
    room, out = int(np.argmax(best)), []
    for size, count in zip(reversed(sizes), reversed(took)):
        k = int(count[room])
        out.append(k)
        room -= k * size
    return float(best.max()), tuple(reversed(out))


def best_plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """The plan with the fewest sequences among a few bounds of small lengths and numbers of groups."""
    tries = [plan(counts, length, length // part, number) for part in PARTS for number in NUMBERS]
    return min(tries, key=lambda runs: max((r[3] + r[2] for r in runs), default=0))


def plan(counts: dict[int, int], length: int = LENGTH, small: int = LENGTH // 8, number: int = 24) -> list[tuple[int, int, int, int, int]]:
    """Runs (piece length, first rank, ranks, first sequence, offset) that place every piece.

    Piece number ``first + i`` of its length goes to sequence ``first sequence + i`` at
    the offset. ``counts`` has at most ``length`` entries, and the number of runs follows
    from them and not from the number of documents.

    Linear grouping: large lengths are rounded up within groups of equally many
    pieces, configurations are found for those few sizes, and the actual pieces take
    their slots. Room that rounding and configurations left is then filled with small pieces, largest
    first, each run in the sequences with the least room that suffices; the rest opens new ones.
    """
    out: list[tuple[int, int, int, int, int]] = []
    used: dict[int, int] = defaultdict(int)
    full = counts.get(length, 0)
    sequence = full
    if full:
        out.append((length, 0, full, 0, 0))
    parts = groups({n: c for n, c in counts.items() if n < length}, small, number)
    queues = parts
    heads = [[0, 0] for _ in parts]  # place in the group, pieces of that length gone
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> runs (first sequence, sequences)

    for column, times in configurations([g[0][0] for g in parts], [sum(c for _, c in g) for g in parts], length):
        todo = times
        slots = [i for i, k in enumerate(column) for _ in range(k)]
        while todo:
            # as many sequences as have the same lengths in all their slots
            need: dict[int, int] = defaultdict(int)
            for i in slots:
                need[i] += 1
            step = todo
            for i, k in need.items():
                have = queues[i][heads[i][0]][1] - heads[i][1]
                step = min(step, max(1, have // k))
            at = 0
            for i in slots:
                n, c = queues[i][heads[i][0]]
                out.append((n, used[n], step, sequence, at))
                used[n] += step
                heads[i][1] += step
                if heads[i][1] == c:
                    heads[i] = [heads[i][0] + 1, 0]
                at += n
            room[length - at].append((sequence, step))
            sequence += step
            todo -= step

    open_rooms = sorted(r for r in room if r)
    for n in sorted((n for n in counts if n <= small), reverse=True):
        left = counts[n]
        while left:
            k = bisect_left(open_rooms, n)
            if k == len(open_rooms):
                fits = length // n
                new = -(-left // fits)
                room[length].append((sequence, new))
                insort(open_rooms, length)
                sequence += new
                continue
            space = open_rooms[k]
            start, many = room[space].pop()
            take = min(left, many)
            out.append((n, used[n], take, start, length - space))
            used[n] += take
            left -= take
            if many > take:
                room[space].append((start + take, many - take))
            if not room[space]:
                open_rooms.pop(k)
            rest = space - n
            if rest:
                if not room[rest]:
                    insort(open_rooms, rest)
                room[rest].append((start, take))
    return out


# ------------------------------------------------------------------ over documents


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece.

    Only the counts per length (at most ``length`` rows) come to the driver, and only
    the runs of the plan go out. The number of a piece among those of its length is
    found without sorting a length in one task: pieces are dealt into cells, cell sizes are summed up,
    and each piece adds its place in its cell. Repeated rows are documents of their own;
    an empty table gives no rows.
    """
    pieces = stage(tokens(docs, length, vocabulary, keep_ids=False).drop("ids"), "pieces")
    cells = max(1, pieces.rdd.getNumPartitions()) * 8
    keyed = pieces.withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(cells)).cast("int"))
    sizes = stage(keyed.groupBy("length", "cell").count(), "cells")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    held = pieces.sparkSession.sparkContext.broadcast(lookup(best_plan(counts, length)))
    before = sizes.withColumn(
        "before",
        F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).drop("count")
    inside = F.row_number().over(Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = keyed.withColumn("inside", inside).join(before, ["length", "cell"]).withColumn("rank", F.col("before") + F.col("inside"))

    def place(n, rank):
        firsts, where = held.value[n]
        k = int(np.searchsorted(firsts, rank, side="right")) - 1
        return int(where[k][0] + rank - firsts[k]), int(where[k][1])

    return append(ranked, ["length", "rank"], place, "sequence_id bigint, offset bigint").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def lookup(runs: list[tuple[int, int, int, int, int]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    by = defaultdict(list)
    for n, first, many, sequence, offset in runs:
        by[n].append((first, sequence, offset))
    out = {}
    for n, rows in by.items():
        rows.sort()
        out[n] = np.array([r[0] for r in rows], np.int64), np.array([r[1:] for r in rows], np.int64)
    return out
