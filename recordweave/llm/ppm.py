"""LM scoring by partial matching: a byte-context trie counted over the corpus, kept as packed tables."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordweave.llm.shared import map_rows, text_bytes
from recordweave.session import stage

ORDER = 5
START, END, ALPHABET = 0xFE, 0xFF, 256  # bytes that UTF-8 never uses
BLOCK_BYTES = 16_000_000
SLICE_BYTES = 2_000_000
HELD_KEYS = 1_500_000
GRAM, WORD, TOTAL = 0, 1, 2
END_WORD = b"\n"


def grams(text: bytes, order: int = ORDER) -> np.ndarray:
    """Each byte of a text and its end mark with the ``order`` bytes before it, packed."""
    raw = np.frombuffer(bytes([START]) * order + text + bytes([END]), np.uint8).astype(np.uint64)
    out = np.zeros(len(raw) - order, np.uint64)
    for k in range(order + 1):
        out = (out << np.uint64(8)) | raw[k : k + len(out)]
    return out


def mask(k: int) -> np.uint64:
    return np.uint64((1 << 8 * k) - 1)


def level(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with summed counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def code_lengths(keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray, order: int = ORDER) -> np.ndarray:
    """log10 probability of the last byte of each key after its context.

    ``keys`` are distinct (order + 1)-grams that hold, with ``counts`` (0: not in the
    training texts), all there are with their last two context bytes; ``pairs`` counts
    (byte before, byte) over all training texts. A byte is looked for in its longest context seen;
    each context without it adds an escape, (kinds)/(total + kinds), and its bytes are
    left out of all shorter contexts (symbol exclusion). Below the empty context all
    bytes not yet left out are alike.
    """
    pairs = pairs.reshape(256, 256).astype(np.float64)
    single = pairs.sum(axis=0)
    out = np.zeros(len(keys))
    live = np.ones(len(keys), bool)
    trained = counts > 0
    tables = {order: (keys[trained], counts[trained].astype(np.float64))}
    for k in range(order - 1, 1, -1):
        tables[k] = level(tables[k + 1][0] & mask(k + 1), tables[k + 1][1])
    sym = (keys & mask(1)).astype(np.int64)
    above: tuple | None = None  # kinds left out here by the longer context, and their counts
    for k in range(order, -1, -1):
        gram = keys & mask(k + 1)
        if k >= 2:
            table, n = tables[k]
            ctx = table >> np.uint64(8)
            first = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1]))) if len(ctx) else np.zeros(0, np.int64)
            heads = ctx[first]
            total = np.add.reduceat(n, first) if len(first) else n[:0]
            kinds = np.diff(np.append(first, len(ctx))).astype(np.float64)
            if k > 2:
                lower, m = tables[k - 1]
                under = m[np.searchsorted(lower, table & mask(k))]
            else:
                under = pairs[(table >> np.uint64(8) & mask(1)).astype(np.int64), (table & mask(1)).astype(np.int64)]
            left = np.add.reduceat(under, first) if len(first) else under[:0]
            at, seen = find(heads, gram >> np.uint64(8))
            t = np.where(seen, pick(total, at), 0.0)
            d = np.where(seen, pick(kinds, at), 0.0)
            spot, there = find(table, gram)
            count = np.where(there, pick(n, spot), 0.0)
            next_gone = (np.where(seen, d, 0.0), np.where(seen, pick(left, at), 0.0))
        elif k == 1:
            before = (gram >> np.uint64(8)).astype(np.int64)
            row_t, row_d = pairs.sum(axis=1), (pairs > 0).sum(axis=1).astype(np.float64)
            row_left = ((pairs > 0) * single).sum(axis=1)
            t, d, count = row_t[before], row_d[before], pairs[before, sym]
            next_gone = (d, row_left[before])
        else:
            t, d, count = np.full(len(keys), single.sum()), np.full(len(keys), float((single > 0).sum())), single[sym]
            next_gone = (d, None)
        if above is not None:
            t, d = t - above[1], d - above[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = live & (count > 0)
            out[hit] += np.log10(count[hit] / (t + d)[hit])
            escape = live & ~hit & (d > 0)
            out[escape] += np.log10((d / (t + d))[escape])
        live &= ~hit
        above = next_gone
    out[live] -= np.log10(np.maximum(ALPHABET - above[0][live], 1.0))
    return out


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(table, keys)
    at = np.minimum(at, max(len(table) - 1, 0))
    return at, (table[at] == keys) if len(table) else np.zeros(len(keys), bool)


def pick(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return values[at] if len(values) else np.zeros(len(at))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return level(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))


class Lookup:
    """Values of known keys, by one probe of a hash table and a search for the few that clash."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - max(10, (4 * len(keys)).bit_length()))
        self.slot = np.zeros(1 << 64 - int(self.shift), np.int32)
        self.slot[self.place(self.keys)] = np.arange(len(keys), dtype=np.int32)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.slot[self.place(keys)]
        other = np.flatnonzero(self.keys[at] != keys)
        at[other] = np.searchsorted(self.keys, keys[other])
        return self.values[at]


def word_key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2


def packed(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Sorted keys as differences and their values, deflated."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return zlib.compress(np.uint32(len(keys)).tobytes() + steps.view(np.uint8).reshape(-1, 8).T.tobytes() + values.tobytes(), 1)


def unpacked(blob: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(blob)
    n = int(np.frombuffer(raw[:4], np.uint32)[0])
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 4).reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64), np.frombuffer(raw, kind, n, 4 + 8 * n)


def basics(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(counts of byte pairs in training texts, bytes of all texts): at most 65,537 rows come to the driver."""
    def each(rows):
        table, size = np.zeros(65536, np.int64), 0
        for held, text in rows:
            size += len(text)
            if not held:
                raw = np.frombuffer(bytes([START]) + text.lower() + bytes([END]), np.uint8).astype(np.int64)
                table += np.bincount(raw[:-1] * 256 + raw[1:], minlength=65536) if len(raw) > 4096 else 0
                if len(raw) <= 4096:
                    np.add.at(table, raw[:-1] * 256 + raw[1:], 1)
        yield -1, size
        for code in np.flatnonzero(table).tolist():
            yield code, int(table[code])

    rows = map_rows(docs.select("held", "text"), each, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect()
    pairs, size = np.zeros(65536, np.int64), 0
    for code, n in rows:
        if code < 0:
            size = n
        else:
            pairs[code] = n
    return pairs, size


def score(docs: DataFrame, order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    ``score`` is the model's log10 probability of the text in lower case (A-Z) and its
    end; the model is counted over all texts not held out. A null text is empty, a null doc_id
    counts as the empty string in the split. Repeated rows are learnt and scored each.

    The trie is never in one place. Texts are dealt into blocks of about
    ``block_bytes``; each block lists its distinct grams and words with their training
    counts, cut by key into shares. A share meets the same keys of all blocks (grams
    with equal last two context bytes meet, so all their longer contexts do), works out
    every code length, and sends each block the values of its own keys. A block then
    streams its texts past its part of the model. All sizes follow from the block
    size, whatever the corpus.
    """
    rows = docs.select("doc_id", held_out().alias("held"), text_bytes().alias("text"))
    pairs, size = basics(rows)
    blocks = max(1, -(-size // block_bytes))
    shares = max(1, -(-size // (block_bytes // 2)))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def listing(rows):
        now, state = None, None
        for block, held, text in rows:
            text = text.lower()
            if block != now:
                if state is not None:
                    yield from listed(now, state)
                now, state = block, [[], 0, [], Counter(), set()]
            state[0].append((held, text))
            state[1] += len(text)
            words = text.split()
            if held:
                state[4].update(words)
            else:
                state[3].update(words)
                state[3][END_WORD] += 1
            if state[1] >= SLICE_BYTES:
                squeeze(state)
        if state is not None:
            yield from listed(now, state)

    def listed(block, state):
        squeeze(state)
        keys, counts = merged(state[2])
        share = (((keys >> np.uint64(8)) & mask(2)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % shares
        for s in range(shares):
            own = share == s
            if own.any():
                yield s, GRAM, block, packed(keys[own], counts[own].astype("<u4"))
        table = state[3]
        words = [*table, *(state[4] - table.keys()), *([] if END_WORD in table else [END_WORD])]
        keys = np.fromiter(map(word_key, words), np.uint64, len(words))
        keys, counts = level(keys, np.fromiter((table[w] for w in words), np.int64, len(words)))
        share = (keys >> np.uint64(20)).astype(np.int64) % shares
        for s in range(shares):
            own = share == s
            if own.any():
                yield s, WORD, block, packed(keys[own], counts[own].astype("<u4"))

    def squeeze(state):
        if state[0]:
            keep = [grams(t, order) for held, t in state[0] if not held]
            other = [grams(t, order) for held, t in state[0] if held]
            if keep:
                keys, counts = np.unique(np.concatenate(keep), return_counts=True)
                state[2].append((keys, counts))
            if other:
                keys = np.unique(np.concatenate(other))
                state[2].append((keys, np.zeros(len(keys), np.int64)))
            state[0], state[1] = [], 0
            if sum(len(k) for k, _ in state[2]) > HELD_KEYS:
                state[2] = [merged(state[2])]

    def share_out(rows):
        for (_, kind), group in by_share(rows):
            own = [(block, *unpacked(blob, "<u4")) for block, blob in group]
            keys, counts = level(np.concatenate([k for _, k, _ in own]), np.concatenate([n for _, _, n in own]).astype(np.int64))
            if kind == GRAM:
                values = code_lengths(keys, counts, pairs, order).astype("<f4")
            else:
                values = counts.astype("<i8")
                yield -1, TOTAL, packed(np.array([0, 1], np.uint64), np.array([counts.sum(), (counts > 0).sum()], "<i8"))
            for block, k, _ in own:
                yield block, kind, packed(k, values[np.searchsorted(keys, k)])

    lists = map_rows(
        dealt.select("block", "held", "text").repartition(blocks, "block").sortWithinPartitions("block"), listing, "share int, kind int, block int, blob binary", rows=8
    )
    model = stage(
        map_rows(
            lists.repartition(shares, "share").sortWithinPartitions("share", "kind", "block"), share_out,
            "block int, kind int, blob binary", rows=8,
        ),
        "trie",
    )

    def totals(rows):
        for (blob,) in rows:
            yield tuple(unpacked(blob, "<i8")[1].tolist())

    n, v = map_rows(model.filter(F.col("kind") == TOTAL).select("blob"), totals, "n bigint, v bigint").agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))
    ).first()
    whole = math.log10(n + v + 1)

    def judge(rows):
        now, lookups = None, {}
        held: dict[int, list] = {}
        for block, kind, doc_id, out, text, blob in rows:
            if block != now:
                now, lookups, held = block, {}, {GRAM: [], WORD: []}
            if blob is not None:
                held[kind].append(unpacked(blob, "<f4" if kind == GRAM else "<i8"))
                continue
            if not lookups:
                for k in (GRAM, WORD):
                    lookups[k] = Lookup(np.concatenate([a for a, _ in held[k]]), np.concatenate([b for _, b in held[k]]))
                held = {}
            text = text.lower()
            words = [*text.split(), END_WORD]
            known = lookups[WORD](np.fromiter(map(word_key, words), np.uint64, len(words)))
            base = float(np.log10(known + 1.0).sum()) - len(words) * whole
            total = float(lookups[GRAM](grams(text, order)).sum(dtype=np.float64))
            yield doc_id, out, len(words), int((known > 0).sum()), n, base, total

    texts = dealt.select("block", F.lit(9).alias("kind"), "doc_id", "held", "text", F.lit(None).cast("binary").alias("blob"))
    parts = model.filter(F.col("kind") != TOTAL).select(
        "block", "kind", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("boolean").alias("held"),
        F.lit(None).cast("binary").alias("text"), "blob",
    )
    return map_rows(
        parts.unionByName(texts).repartition(blocks, "block").sortWithinPartitions("block", "kind"), judge,
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    )


def by_share(rows):
    key, group = None, []
    for share, kind, block, blob in rows:
        if (share, kind) != key:
            if group:
                yield key, group
            key, group = (share, kind), []
        group.append((block, blob))
    if group:
        yield key, group
