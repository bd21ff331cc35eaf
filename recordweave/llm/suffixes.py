"""Suffix-array dedup: repeated 50-byte strings by difference-cover suffix sorting in shares."""

from __future__ import annotations

import hashlib

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordweave.llm.shared import map_rows, text_bytes
from recordweave.session import stage

LENGTH, GRAM = 50, 26
REACH = LENGTH - GRAM + 1  # grams in a window
PIECE_BITS = 20
SEPARATOR = 0xFF  # never in UTF-8
BLOCK_BYTES = 8_000_000
SHARE_BYTES = 2_000_000
KEY_BYTES = 32_000_000
GROUP, GROUPS = 8, 128  # shares sent as one value at most, from as many groups on
RUNS = 1 << 16  # runs whose windows are laid out at once, at most REACH of each
NO_ID = (1 << 63) - 1

ONE = np.uint64(1)
POWER = [np.uint64(pow(0x9E3779B97F4A7C15, 1 << k, 1 << 64)) for k in range(6)]
MIX = np.uint64(0xD6E8FEB86659FD93)


# ------------------------------------------------------------------ the suffix array


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of positive integers by the difference cover {1, 2} mod 3.

    Suffixes at places 1 and 2 mod 3 are sorted by their first three symbols and
    named; where names repeat, the string of names is sorted the same way. The
    suffixes at places 0 mod 3 follow from a symbol and the rank after it, and are merged in.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: tuple(s[i:])), np.int64)
    t = np.concatenate([s, np.zeros(3, s.dtype)]).astype(np.int64)
    # a place beyond the end where n is 1 mod 3, so that every suffix at 0 mod 3 has a sampled one after it
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    wide = int(t.max()).bit_length()
    if 3 * wide <= 63:
        code = (t[sample] << (2 * wide)) | (t[sample + 1] << wide) | t[sample + 2]
        order = np.argsort(code)
        fresh = np.concatenate(([True], code[order][1:] != code[order][:-1]))
    else:
        order = np.lexsort((t[sample + 2], t[sample + 1], t[sample]))
        a = sample[order]
        fresh = np.concatenate(([True], (t[a[1:]] != t[a[:-1]]) | (t[a[1:] + 1] != t[a[:-1] + 1]) | (t[a[1:] + 2] != t[a[:-1] + 2])))
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(fresh)
    if names.max() < len(sample):
        order = suffix_array(names)
    sampled = sample[order]
    rank = np.zeros(n + 4, np.int64)
    rank[sampled] = np.arange(1, len(sampled) + 1)
    sampled = sampled[sampled < n]
    zero = np.arange(0, n, 3)
    near = (t[zero] << 32) | rank[zero + 1] if wide <= 31 else None
    zero = zero[np.argsort(near)] if near is not None else zero[np.lexsort((rank[zero + 1], t[zero]))]
    # where each suffix of one kind falls among the others
    if 2 * wide <= 62:
        pair = (t[:-1] << wide) | t[1:]
        if 2 * wide > 31:
            pair = np.unique(pair, return_inverse=True)[1]
    else:
        both = np.lexsort((t[1:], t[:-1]))
        x, y = t[:-1][both], t[1:][both]
        pair = np.empty(len(both), np.int64)
        pair[both] = np.cumsum(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
    ones = sampled[sampled % 3 == 1]
    twos = sampled[sampled % 3 == 2]
    key1, key2 = (lambda i: (t[i] << 32) | rank[i + 1]), (lambda i: (pair[i] << 32) | rank[i + 2])
    before_one = np.searchsorted(key1(ones), key1(zero))
    before_two = np.searchsorted(key2(twos), key2(zero))
    place = np.arange(len(zero)) + before_one + before_two
    out = np.empty(n, np.int64)
    rest = np.ones(n, bool)
    rest[place] = False
    out[place] = zero
    out[rest] = sampled
    return out


def smallest_owner(parts: list[bytes], owners: np.ndarray) -> np.ndarray:
    """For each 50-byte string of each part, one part after the other, the smallest owner of a part that has it.

    The parts, different ones, are put in one string and its suffixes sorted; of those that start a
    whole 50-byte string in their part, neighbours with equal prefixes make a group.
    """
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    raw = np.frombuffer(b"\x00".join(parts) + b"\x00" * (LENGTH + 8), np.uint8)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    n = int(starts[-1] + sizes[-1])
    many = sizes - LENGTH + 1
    first = np.repeat(starts - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
    owner = np.full(n, NO_ID, np.int64)
    owner[first] = np.repeat(owners, many)
    whole = np.zeros(n, bool)
    whole[first] = True
    order = suffix_array(raw[:n].astype(np.int64) + 1)
    order = order[whole[order]]
    eight = np.lib.stride_tricks.sliding_window_view(raw, 8)
    word = np.ascontiguousarray(eight[: n + LENGTH]).view("<u8").ravel()
    a, b = order[:-1], order[1:]
    same = np.ones(len(a), bool)
    for k in (0, 8, 16, 24, 32, 40, LENGTH - 8):
        same &= word[a + k] == word[b + k]
    heads = np.flatnonzero(np.concatenate(([True], ~same)))
    low = np.minimum.reduceat(owner[order], heads)
    owner[order] = np.repeat(low, np.diff(np.append(heads, len(order))))
    return owner[first]


# ------------------------------------------------------------------ which suffixes can matter


def minimiser_runs(raw: np.ndarray):
    """(first window, windows, key) of the runs of windows that share their smallest gram.

    A window is 50 bytes without a separator. Its key is the smallest hash of its
    26-byte grams, so equal windows have equal keys wherever they are.
    """
    step = (1 << PIECE_BITS) - REACH
    bad = np.concatenate(([0], np.cumsum(raw == SEPARATOR)))
    last = len(raw) - LENGTH + 1
    for low in range(0, max(last, 0), step):
        high = min(low + step, last)
        one = (raw[low : high + LENGTH - 1].astype(np.uint64) + ONE) * MIX
        two = one[:-1] * POWER[0] + one[1:]
        four = two[:-2] * POWER[1] + two[2:]
        eight = four[:-4] * POWER[2] + four[4:]
        sixteen = eight[:-8] * POWER[3] + eight[8:]
        n = high - low + REACH - 1
        h = (sixteen[:n] * POWER[3] + eight[16 : 16 + n]) * POWER[1] + two[24 : 24 + n]
        h ^= h >> np.uint64(29)
        h *= MIX
        h = ((h >> np.uint64(PIECE_BITS)) << np.uint64(PIECE_BITS)) | np.arange(n, dtype=np.uint64)
        for k in (1, 2, 4, 8):
            h = np.minimum(h[:-k], h[k:])
        h = np.minimum(h[: high - low], h[9 : 9 + high - low])
        good = bad[low + LENGTH : high + LENGTH] == bad[low:high]
        cut = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (good[1:] != good[:-1]))))
        size = np.diff(np.append(cut, high - low))
        keep = good[cut]
        yield cut[keep] + low, size[keep], (h[cut] >> np.uint64(PIECE_BITS))[keep]


def joined(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """Texts with a separator after each, and their first places."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return b"".join(t + b"\xff" for t in texts), np.concatenate(([0], np.cumsum(sizes + 1)[:-1])) if len(texts) else np.zeros(0, np.int64)


def squeeze(*arrays: np.ndarray | bytes) -> bytes:
    """Several arrays or byte strings in one compressed value."""
    raw = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    head = np.array([len(raw), *map(len, raw)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(raw))


def opened(value: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    at, out = 8 * (n + 1), []
    for size in np.frombuffer(raw, "<i8", n, 8).tolist():
        out.append(raw[at : at + size])
        at += size
    return out


def planes(numbers: np.ndarray) -> np.ndarray:
    """The bytes of numbers, those of one place together, which compress well."""
    return numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.copy()


def of_planes(raw: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def steps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as differences, byte planes apart."""
    return planes(np.diff(keys, prepend=np.uint64(0)).astype("<u8"))


def summed(raw: bytes) -> np.ndarray:
    return np.cumsum(of_planes(raw, "<u8"), dtype=np.uint64)


def grouped(rows, width: int = 1):
    key, group = None, []
    for row in rows:
        if row[:width] != key:
            if group:
                yield key, group
            key, group = row[:width], []
        group.append(row[width:])
    if group:
        yield key, group


def by_group(share: np.ndarray, per: int):
    """(group, places of its shares) of each group of ``per`` shares, by share and rising in each."""
    order = np.argsort(share, kind="stable")
    group = share[order] // per
    for own in np.split(order, np.flatnonzero(np.diff(group)) + 1):
        if len(own):
            yield int(share[own[0]]) // per, own


def spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each stretch, ``many`` of them, one stretch after the other."""
    return np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())


class Block:
    """The texts of one block in a fixed order, with the runs of them that may repeat.

    A run has its first window, its number of windows, its key and its document.
    """

    def __init__(self, blobs: list[bytes], known: list[bytes]) -> None:
        docs = []
        for blob in blobs:
            ids, sizes, body = opened(blob)
            at = 0
            for doc_id, size in zip(np.frombuffer(ids, "<i8").tolist(), np.frombuffer(sizes, "<i8").tolist()):
                docs.append((doc_id, body[at : at + size]))
                at += size
        docs.sort()
        self.ids = np.array([d for d, _ in docs], np.int64)
        self.texts = [t for _, t in docs]
        self.body, self.starts = joined(self.texts)
        known = np.unique(np.concatenate([summed(opened(k)[0]) for k in known])) if known else np.zeros(0, np.uint64)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        for first, many, key in minimiser_runs(np.frombuffer(self.body, np.uint8)) if len(known) else ():
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            ok = known[at] == key
            found.append((first[ok], many[ok], key[ok]))
        self.first, self.many, self.key = map(np.concatenate, zip(*found))
        self.doc = np.searchsorted(self.starts, self.first, side="right") - 1

    def distinct(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The different runs as bytes in order of first place, the first run of each, and the number of every run.

        Documents come by rising id, so the first run is one of the smallest document.
        """
        body, number = self.body, {}
        ends = self.first + (self.many + LENGTH - 1)
        which = np.array(
            [number.setdefault(body[a:b], len(number)) for a, b in zip(self.first.tolist(), ends.tolist())], np.int64
        )
        return list(number), np.flatnonzero(np.diff(np.maximum.accumulate(which), prepend=-1)), which


def removals(docs: DataFrame, block_bytes: int = BLOCK_BYTES, share_bytes: int = SHARE_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row.

    Every byte covered by a 50-byte string that also starts in a document with a
    smaller doc_id goes. A null text is empty; a null doc_id is larger than any other; rows with equal
    doc_id take nothing from each other.

    1. Each text's windows are keyed by their smallest gram. Keys meet in shares, and
       those in one document only are done with: their windows are nowhere else.
    2. Runs of windows with another key go, with their 49 bytes after, to the share of
       the key; equal runs of a block go once. A share sorts the suffixes of its different
       runs by difference cover and compares neighbours. Equal strings have equal keys,
       so shares need no merge among them.
    3. Each share answers every block with the smallest document of each window; blocks
       stream their texts again and cut them.

    A block holds about ``block_bytes`` of text, a share the runs of about
    ``share_bytes`` of it; both numbers grow with the corpus, their sizes do not. What goes from many
    places to many is sent in few values: keys of a batch of texts go to their share with the number of the block beside
    each, and blocks and shares talk in groups of up to ``GROUP`` shares.
    """
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), text_bytes().alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).first()[0]
    blocks, shares, key_shares = (max(1, -(-size // part)) for part in (block_bytes, share_bytes, KEY_BYTES))
    per = min(GROUP, -(-shares // GROUPS))
    groups = -(-shares // per)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def batches(rows, most):
        """Lists of rows of about ``most`` bytes."""
        some, held = [], 0
        for row in rows:
            some.append(row)
            held += len(row[1])
            if held >= most:
                yield some
                some, held = [], 0
        if some:
            yield some

    def keys(rows):
        for some in batches(rows, 16_000_000):
            body, starts = joined([t for _, t, _ in some])
            where = np.array([b for _, _, b in some], np.int64)
            first, key = [], []
            for at, _, k in minimiser_runs(np.frombuffer(body, np.uint8)):
                first.append(at)
                key.append(k)
            if not first or not sum(map(len, first)):
                continue
            key = np.concatenate(key)
            doc = np.searchsorted(starts, np.concatenate(first), side="right") - 1
            block, share = where[doc], (key % np.uint64(key_shares)).astype(np.int64)
            order = np.lexsort((block, key, share))  # documents of a key in a block stay in order
            key, doc, block, share = key[order], doc[order], block[order], share[order]
            heads = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (block[1:] != block[:-1]))))
            twice = doc[heads] != doc[np.append(heads[1:], len(key)) - 1]
            key, block, share = key[heads], block[heads].astype("<u4"), share[heads]
            cuts = np.flatnonzero(np.diff(share, prepend=-1)).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(key)]):
                yield int(share[a]), squeeze(steps(key[a:b]), planes(block[a:b]), twice[a:b])

    def known(rows):
        for _, group in grouped(rows):
            own = [(summed(raw[0]), of_planes(raw[1], "<u4"), np.frombuffer(raw[2], bool)) for raw in (opened(v) for (v,) in group)]
            key, block, twice = map(np.concatenate, zip(*own))
            del own
            _, at, count = np.unique(key, return_inverse=True, return_counts=True)
            some = count > 1
            some[at[twice]] = True
            again = some[at]
            key, block = key[again], block[again]
            order = np.lexsort((key, block))
            key, block = key[order], block[order]
            fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])))[: len(key)]
            key, block = key[fresh], block[fresh]
            cuts = np.flatnonzero(np.diff(block.astype(np.int64), prepend=-1)).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(key)]):
                yield int(block[a]), 0, squeeze(steps(key[a:b]))

    met = map_rows(dealt.select("doc_id", "text", "block"), keys, "share int, blob binary", rows=256)
    cand = stage(
        map_rows(met.repartition(key_shares, "share").sortWithinPartitions("share"), known, "block int, kind int, blob binary", rows=256), "keys"
    )

    def bundle(rows):
        for some in batches(rows, 32_000_000):
            by: dict[int, list] = {}
            for doc_id, text, block in some:
                by.setdefault(block, []).append((doc_id, text))
            for block, own in by.items():
                yield block, 2, squeeze(np.array([d for d, _ in own], "<i8"), np.array([len(t) for _, t in own], "<i8"), b"".join(t for _, t in own))

    def texts():
        return map_rows(dealt.select("doc_id", "text", "block"), bundle, "block int, kind int, blob binary", rows=16)

    def by_block(df):
        return df.repartition(blocks, "block").sortWithinPartitions("block", "kind")

    def send(rows):
        for (number,), group in grouped(rows):
            block = Block([v for k, v in group if k == 2], [v for k, v in group if k == 0])
            parts, head, _ = block.distinct()
            ids, sizes = block.ids[block.doc[head]].astype("<i8"), (block.many[head] + LENGTH - 1).astype("<i4")
            marks, share = (block.key[head] // np.uint64(shares)).astype("<u4"), (block.key[head] % np.uint64(shares)).astype(np.int64)
            for g, own in by_group(share, per):
                yield g, number, squeeze(
                    (share[own] % per).astype("u1"), ids[own], sizes[own], b"".join([parts[i] for i in own.tolist()]), marks[own]
                )

    def answer(rows):
        for (g,), group in grouped(rows):
            numbers, blobs = [number for number, _ in group], [opened(blob) for _, blob in group]
            del group
            inner, ids, sizes, marks = (
                np.concatenate([np.frombuffer(raw[k], kind) for raw in blobs]) for k, kind in ((0, "u1"), (1, "<i8"), (2, "<i4"), (4, "<u4"))
            )
            body, cuts = b"".join([raw[3] for raw in blobs]), np.cumsum([0, *(len(raw[0]) for raw in blobs)]).tolist()
            del blobs
            ends = np.cumsum(sizes, dtype=np.int64)
            begins = ends - sizes
            base, flat, lows, total = np.empty(len(sizes), np.int64), np.empty(len(sizes), bool), [], 0
            for _, own in by_group(inner.astype(np.int64), 1):
                place: dict[bytes, int] = {}
                mine = np.array(
                    [place.setdefault(body[a:b], len(place)) for a, b in zip(begins[own].tolist(), ends[own].tolist())], np.int64
                )
                parts = list(place)
                owners, keys = np.full(len(parts), NO_ID, np.int64), np.zeros(len(parts), np.uint32)
                np.minimum.at(owners, mine, ids[own])
                keys[mine] = marks[own]
                many = np.fromiter(map(len, parts), np.int64, len(parts)) - LENGTH + 1
                start = np.cumsum(many) - many
                _, where, count = np.unique(keys, return_inverse=True, return_counts=True)
                # a run alone with its key has windows of its own only; the others are sorted
                met = count[where] > 1
                low = np.repeat(owners, many)
                if met.any():
                    low[np.repeat(met, many)] = smallest_owner([parts[k] for k in np.flatnonzero(met).tolist()], owners[met])
                # one value for a run whose windows all have the same smallest document
                even = np.minimum.reduceat(low, start) == np.maximum.reduceat(low, start)
                sent = np.where(even, 1, many)
                base[own], flat[own] = (total + np.cumsum(sent) - sent)[mine], even[mine]
                lows.append(low[spread(start, sent)])
                total += len(lows[-1])
            del body
            low, sent = np.concatenate(lows), np.where(flat, 1, sizes - LENGTH + 1)
            for number, a, b in zip(numbers, cuts, cuts[1:]):
                yield number, 1, squeeze(np.array([g], "<i8"), flat[a:b], low[spread(base[a:b], sent[a:b])])

    sent = map_rows(by_block(cand.union(texts())).select("block", "kind", "blob"), send, "part int, block int, blob binary", rows=64)
    found = stage(
        map_rows(sent.repartition(groups, "part").sortWithinPartitions("part"), answer, "block int, kind int, blob binary", rows=64), "owners"
    )

    def cut(rows):
        for (_,), group in grouped(rows):
            block = Block([v for k, v in group if k == 2], [v for k, v in group if k == 0])
            replies = {}
            for v in (v for k, v in group if k == 1):
                g, even, low = opened(v)
                replies[int(np.frombuffer(g, "<i8")[0])] = np.frombuffer(even, bool), np.frombuffer(low, "<i8")
            start = np.zeros(len(block.body) + 1, bool)
            parts, head, which = block.distinct()
            sizes, total = block.many[head], 0
            base, flat, lows = np.empty(len(parts), np.int64), np.empty(len(parts), bool), [np.zeros(0, np.int64)]
            del parts
            for g, own in by_group((block.key[head] % np.uint64(shares)).astype(np.int64), per):
                even, low = replies[g]
                sent = np.where(even, 1, sizes[own])
                base[own], flat[own] = total + np.cumsum(sent) - sent, even
                total += len(low)
                lows.append(low)
            low = np.concatenate(lows)
            for at in range(0, len(which), RUNS):
                some = slice(at, at + RUNS)
                first, many, doc, part = block.first[some], block.many[some], block.doc[some], which[some]
                inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                value = low[np.repeat(base[part], many) + np.where(np.repeat(flat[part], many), 0, inside)]
                gone = value < np.repeat(block.ids[doc], many)
                start[(np.repeat(first, many) + inside)[gone]] = True
            total = np.cumsum(start[:-1], dtype=np.int32)
            covered = total.copy()
            covered[LENGTH:] -= total[:-LENGTH]
            covered = covered > 0
            for doc_id, text, a in zip(block.ids.tolist(), block.texts, block.starts.tolist()):
                own = covered[a : a + len(text)]
                lost = int(own.sum())
                spans = int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if lost else 0
                kept = np.frombuffer(text, np.uint8)[~own].tobytes() if lost else text
                yield None if doc_id == NO_ID else doc_id, len(text), lost, spans, hashlib.sha256(kept).hexdigest(), kept

    return map_rows(
        by_block(cand.union(found).union(texts())).select("block", "kind", "blob"), cut,
        "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary", rows=512,
    )
