"""Substring dedup: word windows found again by relative Lempel-Ziv factors against reference blocks."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordweave.llm.shared import map_rows, text_bytes
from recordweave.llm.suffixes import NO_ID, grouped, opened, squeeze, steps, summed
from recordweave.session import stage

WORDS, GRAM = 20, 8
REACH = WORDS - GRAM + 1  # grams in a window, and the most windows of a run
BLOCK_BYTES = 8_000_000
SHARE_BYTES = 4_000_000
KEY_BYTES = 64_000_000
HOT_BLOCKS = 64
PLACE_BITS = 22

ODD = [np.uint64(pow(0x9E3779B97F4A7C15, 1 << k, 1 << 64)) for k in range(3)]
MIX = np.uint64(0xD6E8FEB86659FD93)


# ------------------------------------------------------------------ runs of windows


class Words:
    """The words of several texts in a row, with a mark and a document for each."""

    def __init__(self, texts: list[bytes]) -> None:
        split = [t.split() for t in texts]
        self.sizes = np.fromiter(map(len, split), np.int64, len(split))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.words = [w for words in split for w in words]
        place: dict[bytes, int] = {}
        self.ids = np.fromiter((place.setdefault(w, len(place)) for w in self.words), np.int64, len(self.words))
        marks = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in place), np.uint64, len(place))
        self.marks = marks[self.ids] if len(place) else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(split)), self.sizes)

    def text(self, first: int, words: int) -> bytes:
        return b" ".join(self.words[first : first + words])

    def runs(self):
        """(first window, windows, key) of the runs of windows that share one smallest gram.

        A window is 20 words of one document. Its key is the smallest hash of its grams
        of 8 words, so equal windows have equal keys wherever they are. A run belongs to
        one place of that gram and has at most 13 windows.
        """
        last = len(self.marks) - WORDS + 1
        step = (1 << PLACE_BITS) - REACH
        low_bits = np.uint64((1 << PLACE_BITS) - 1)
        for low in range(0, max(last, 0), step):
            high = min(low + step, last)
            n = high - low + REACH - 1
            one = (self.marks[low : high + WORDS - 1] + np.uint64(1)) * MIX
            two = one[:-1] * ODD[0] + one[1:]
            four = two[:-2] * ODD[1] + two[2:]
            gram = (four[:-4] * ODD[2] + four[4:])[:n]
            gram ^= gram >> np.uint64(29)
            gram *= MIX
            h = (gram & ~low_bits) | np.arange(n, dtype=np.uint64)
            for k in (1, 2, 4):
                h = np.minimum(h[:-k], h[k:])
            h = np.minimum(h[: high - low], h[REACH - 8 : REACH - 8 + high - low])
            good = self.doc[low:high] == self.doc[low + WORDS - 1 : high + WORDS - 1]
            # a window that a document's end cuts never starts a run, and ends the one before it
            cut = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (good[1:] != good[:-1]) | (self.doc[low + 1 : high] != self.doc[low : high - 1]))))
            size = np.diff(np.append(cut, high - low))
            keep = good[cut]
            yield cut[keep] + low, size[keep], gram[(h[cut[keep]] & low_bits).astype(np.int64)]

    def repeats(self) -> np.ndarray:
        """Windows (by first word) whose words also start earlier in the same document."""
        n = len(self.marks) - WORDS + 1
        gone = np.zeros(max(n, 0), bool)
        if n < 2:
            return gone
        one = (self.ids.astype(np.uint64) + np.uint64(1)) * MIX
        two = one[:-1] * ODD[0] + one[1:]
        four = two[:-2] * ODD[1] + two[2:]
        eight = four[:-4] * ODD[2] + four[4:]
        whole = (eight[:n] * ODD[1] + eight[8 : 8 + n]) * ODD[2] + four[16 : 16 + n]
        good = np.flatnonzero(self.doc[:n] == self.doc[WORDS - 1 :])
        at = good[np.lexsort((good, whole[good], self.doc[good]))]
        same = (whole[at[1:]] == whole[at[:-1]]) & (self.doc[at[1:]] == self.doc[at[:-1]])
        for i in np.flatnonzero(same).tolist():
            # equal hashes only nominate: the words are compared with those of every earlier place in question
            j = i
            while j >= 0 and (j == i or same[j]):
                a, b = at[j], at[i + 1]
                if (self.ids[a : a + WORDS] == self.ids[b : b + WORDS]).all():
                    gone[b] = True
                    break
                j -= 1
        return gone


# ------------------------------------------------------------------ factors


class Reference:
    """Runs of words indexed by their 20-word windows, against which others are factored."""

    def __init__(self) -> None:
        self.runs: list[list[bytes]] = []
        self.index: dict[tuple, tuple[int, int]] = {}

    def add(self, words: list[bytes]) -> None:
        for at in range(len(words) - WORDS + 1):
            self.index.setdefault(tuple(words[at : at + WORDS]), (len(self.runs), at))
        self.runs.append(words)

    def factors(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(start, length) of the greedy factors of 20 words or more.

        A factor is made as long as its place in the reference allows. Windows over its
        end are then looked up one by one, since such a window may stand elsewhere in
        the reference: the first that does starts the next factor, which may overlap the
        one before. So the windows inside factors are all windows the reference has.
        """
        out, at, last = [], 0, len(words) - WORDS
        while at <= last:
            found = self.index.get(tuple(words[at : at + WORDS]))
            if found is None:
                at += 1
                continue
            run, place = self.runs[found[0]], found[1]
            size = WORDS
            while at + size < len(words) and place + size < len(run) and words[at + size] == run[place + size]:
                size += 1
            out.append((at, size))
            at += size - WORDS + 1
        return out


def parse_runs(runs: list[tuple[int, bytes]]) -> list[int]:
    """For each (owner, words) of one key a mask of the windows that a smaller owner has too.

    The runs, different ones, are factored in order of their owners, each against all
    that smaller owners brought in before.
    """
    split = [words.split(b" ") for _, words in runs]
    order = sorted(range(len(runs)), key=lambda i: runs[i][0])
    out, ref, waiting = [0] * len(runs), Reference(), []
    for i in order:
        if waiting and runs[waiting[0]][0] != runs[i][0]:
            for j in waiting:
                ref.add(split[j])
            waiting = []
        for at, size in ref.factors(split[i]) if ref.runs else ():
            out[i] |= ((1 << (size - WORDS + 1)) - 1) << at
        waiting.append(i)
    return out


# ------------------------------------------------------------------ over all documents


class Block:
    """The texts of one block in order of doc_id, with the runs of them that other documents may have."""

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
        self.words = Words([t for _, t in docs])
        lists = [opened(k) for k in known]
        keys = np.concatenate([summed(k) for k, _ in lists]) if lists else np.zeros(0, np.uint64)
        hot = np.concatenate([np.frombuffer(h, bool) for _, h in lists]) if lists else np.zeros(0, bool)
        order = np.argsort(keys)
        self.known, self.hot = keys[order], hot[order]

    def parts(self):
        """(first windows, windows, keys, hot or not, owners) of the runs with a known key."""
        for first, many, key in self.words.runs():
            if not len(self.known):
                continue
            at = np.minimum(np.searchsorted(self.known, key), len(self.known) - 1)
            ok = self.known[at] == key
            first = first[ok]
            yield first, many[ok], key[ok], self.hot[at[ok]], self.ids[self.words.doc[first]]

    def distinct(self, shares: int):
        """The different runs of each share, and the different windows of hot keys, with their smallest owner.

        Runs are {share: {(key, words): owner}} and windows {digest: owner}. Documents
        come by rising id, so the first to bring one in is the smallest.
        """
        runs: dict[int, dict[tuple[int, bytes], int]] = {}
        windows: dict[bytes, int] = {}
        for first, many, key, hot, owner in self.parts():
            for a, n, k, h, d in zip(first.tolist(), many.tolist(), key.tolist(), hot.tolist(), owner.tolist()):
                if h:
                    for w in range(a, a + n):
                        windows.setdefault(self.digest(w), d)
                else:
                    runs.setdefault(k % shares, {}).setdefault((k, self.words.text(a, n + WORDS - 1)), d)
        return runs, windows

    def digest(self, window: int) -> bytes:
        return xxhash.xxh3_128_digest(self.words.text(window, WORDS))


def removals(
    docs: DataFrame, block_bytes: int = BLOCK_BYTES, share_bytes: int = SHARE_BYTES, hot_blocks: int = HOT_BLOCKS
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for every row.

    A word goes if a window of 20 words over it also starts in a document with a smaller
    doc_id, or earlier in the same document. Words are split at ASCII white space and
    otherwise unchanged; ``kept`` joins the others by one space. A null text has no words,
    a null doc_id is larger than any other, rows with equal doc_id take nothing from each
    other, and columns other than doc_id and text are not looked at.

    1. Windows are keyed by their smallest 8-word gram. Keys meet in shares; those of one
       document only are done with, since their windows are in no other document.
    2. Runs of windows with another key go to the reference block that indexes the key;
       equal runs of a block of documents go once. In all other reference blocks such a
       run has no factor of 20 words, so being parsed there is being parsed against all of
       them. Runs are factored greedily, in order of their smallest document, and windows
       over the ends of factors are looked up too.
    3. A key that stands in more than ``hot_blocks`` blocks goes window by window instead,
       under a 128-bit digest of the window, and Spark takes the smallest document of each
       in two steps. So neither a phrase that all documents share nor what follows it
       meets in one task.
    4. Answers go back to the blocks, which add the repeats inside each document and cut.

    A block holds about ``block_bytes`` of text and a reference block the runs of
    ``share_bytes`` of it; both numbers grow with the corpus, their sizes do not.
    """
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), text_bytes().alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).first()[0]
    blocks, shares, key_shares = (max(1, -(-size // part)) for part in (block_bytes, share_bytes, KEY_BYTES))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def batches(rows):
        """Lists of rows of about 8 MB."""
        some, held = [], 0
        for row in rows:
            some.append(row)
            held += len(row[1])
            if held >= 8_000_000:
                yield some
                some, held = [], 0
        if some:
            yield some

    def keys(rows):
        for some in batches(rows):
            words = Words([t for _, t, _ in some])
            where, ids = np.array([b for _, _, b in some], np.int64), np.array([d for d, _, _ in some], np.int64)
            found = [(first, key) for first, _, key in words.runs()]
            if not sum(len(f) for f, _ in found):
                continue
            key = np.concatenate([k for _, k in found])
            doc = words.doc[np.concatenate([f for f, _ in found])]
            block, owner = where[doc], ids[doc]
            order = np.lexsort((owner, key, block))
            key, owner, block = key[order], owner[order], block[order]
            heads = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (block[1:] != block[:-1]))))
            ends = np.append(heads[1:], len(key)) - 1
            key, block, twice = key[heads], block[heads], owner[heads] != owner[ends]
            share = (key % np.uint64(key_shares)).astype(np.int64)
            order = np.lexsort((key, block, share))
            key, block, twice, share = key[order], block[order], twice[order], share[order]
            cuts = np.flatnonzero(np.concatenate(([True], (share[1:] != share[:-1]) | (block[1:] != block[:-1])))).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(key)]):
                yield int(share[a]), int(block[a]), squeeze(steps(key[a:b]), twice[a:b])

    def known(rows):
        for (_,), group in grouped(rows):
            by: dict[int, list] = {}
            for block, blob in group:
                k, twice = opened(blob)
                by.setdefault(block, []).append((summed(k), np.frombuffer(twice, bool)))
            own, alone = [], []
            for block, parts in by.items():  # once for each block, whatever tasks its rows came from
                key, at, count = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True, return_counts=True)
                some = count > 1
                np.logical_or.at(some, at, np.concatenate([t for _, t in parts]))
                own.append((block, key))
                alone.append(some)
            key, at, count = np.unique(np.concatenate([k for _, k in own]), return_inverse=True, return_counts=True)
            some = count > 1
            np.logical_or.at(some, at, np.concatenate(alone))
            again, hot, first = some[at], (count > hot_blocks)[at], 0
            for block, k in own:
                mine = again[first : first + len(k)]
                if mine.any():
                    yield block, 0, squeeze(steps(k[mine]), hot[first : first + len(k)][mine])
                first += len(k)

    met = map_rows(dealt.select("doc_id", "text", "block"), keys, "share int, block int, blob binary", rows=256)
    cand = stage(
        map_rows(met.repartition(key_shares, "share").sortWithinPartitions("share", "block"), known, "block int, kind int, blob binary", rows=256),
        "keys",
    )

    def bundle(rows):
        for some in batches(rows):
            by: dict[int, list] = {}
            for doc_id, text, block in some:
                by.setdefault(block, []).append((doc_id, text))
            for block, own in by.items():
                yield block, 2, squeeze(np.array([d for d, _ in own], "<i8"), np.array([len(t) for _, t in own], "<i8"), b"".join(t for _, t in own))

    def texts():
        return map_rows(dealt.select("doc_id", "text", "block"), bundle, "block int, kind int, blob binary", rows=16)

    def by_block(df):
        return df.repartition(blocks, "block").sortWithinPartitions("block", "kind").select("block", "kind", "blob")

    def opened_block(group):
        return Block([v for k, v in group if k == 2], [v for k, v in group if k == 0])

    def send(rows):
        for (number,), group in grouped(rows):
            runs, windows = opened_block(group).distinct(shares)
            for share, own in runs.items():
                order = sorted(own)
                yield share, number, squeeze(
                    np.array([k for k, _ in order], "<u8"), np.array([own[x] for x in order], "<i8"), b"\n".join(w for _, w in order)
                ), None, None
            for digest, owner in windows.items():
                yield None, number, None, digest, owner

    def answer(rows):
        for (_,), group in grouped(rows):
            by_key: dict[int, dict[bytes, list[int]]] = {}
            for number, blob in group:
                own, ids, body = opened(blob)
                for k, d, words in zip(np.frombuffer(own, "<u8").tolist(), np.frombuffer(ids, "<i8").tolist(), body.split(b"\n")):
                    held = by_key.setdefault(k, {}).setdefault(words, [d])
                    held[0] = min(held[0], d)
                    held.append(number)
            replies: dict[int, list[tuple[int, int, bytes]]] = {}
            for k, runs in by_key.items():
                told = parse_runs([(held[0], words) for words, held in runs.items()])
                for (words, held), mask in zip(runs.items(), told):
                    for number in held[1:]:
                        replies.setdefault(number, []).append((k, held[0], mask, words))
            for number, told in replies.items():
                told.sort(key=lambda x: (x[0], x[3]))
                yield number, 1, squeeze(np.array([x[1] for x in told], "<i8"), np.array([x[2] for x in told], "<i4"), np.array([told[0][0] % shares], "<i8"))

    sent = stage(
        map_rows(by_block(cand.union(texts())), send, "share int, block int, blob binary, digest binary, owner bigint", rows=256), "runs"
    )
    found = stage(
        map_rows(
            sent.filter("share is not null").select("share", "block", "blob").repartition(shares, "share").sortWithinPartitions("share"),
            answer, "block int, kind int, blob binary", rows=64,
        ),
        "factors",
    )
    hot = sent.filter("digest is not null").select("block", "digest", "owner")
    least = (
        hot.groupBy("digest", F.pmod("block", F.lit(hot_blocks)).alias("part")).agg(F.min("owner").alias("owner"))
        .groupBy("digest").agg(F.min("owner").alias("least"))
    )
    windows = (
        hot.join(least, "digest").withColumn("told", F.concat("digest", F.unhex(F.lpad(F.hex("least"), 16, "0"))))
        .groupBy("block", F.pmod(F.xxhash64("digest"), F.lit(16)).alias("part"))
        .agg(F.array_join(F.collect_list(F.hex("told")), "").alias("told"))
        .select("block", F.lit(3).alias("kind"), F.unhex("told").alias("blob"))
    )

    def cut(rows):
        for (_,), group in grouped(rows):
            block = opened_block(group)
            words, ids = block.words, block.ids
            runs, _ = block.distinct(shares)
            replies: dict[tuple[int, bytes], tuple[int, int]] = {}
            for kind, v in group:
                if kind == 1:
                    owners, told, share = opened(v)
                    order = sorted(runs[int(np.frombuffer(share, "<i8")[0])])
                    replies.update(zip(order, zip(np.frombuffer(owners, "<i8").tolist(), np.frombuffer(told, "<i4").tolist())))
            hot = {v[at : at + 16]: int.from_bytes(v[at + 16 : at + 24], "big", signed=True) for kind, v in group if kind == 3 for at in range(0, len(v), 24)}
            n = len(words.words)
            start = np.zeros(n + 1, bool)
            own = words.repeats()
            start[: len(own)] = own
            for first, many, key, is_hot, owner in block.parts():
                for a, m, k, h, d in zip(first.tolist(), many.tolist(), key.tolist(), is_hot.tolist(), owner.tolist()):
                    if h:
                        for w in range(a, a + m):
                            if hot[block.digest(w)] < d:
                                start[w] = True
                        continue
                    least, mask = replies[k, words.text(a, m + WORDS - 1)]
                    if least < d:
                        start[a : a + m] = True
                    elif mask:
                        for w in range(m):
                            if mask >> w & 1:
                                start[a + w] = True
            total = np.cumsum(start[:n], dtype=np.int64)
            covered = total.copy()
            covered[WORDS:] -= total[:-WORDS]
            covered = covered > 0
            for doc_id, at, many in zip(ids.tolist(), words.starts.tolist(), words.sizes.tolist()):
                gone = covered[at : at + many]
                lost = int(gone.sum())
                kept = words.text(at, many) if not lost else b" ".join([words.words[at + i] for i in np.flatnonzero(~gone).tolist()])
                yield None if doc_id == NO_ID else doc_id, many, lost, hashlib.sha256(kept).hexdigest(), kept

    return map_rows(
        by_block(cand.union(found).union(windows).union(texts())), cut,
        "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept binary", rows=512,
    )


SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
one AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM w),
win AS (
  SELECT doc_id, i, string_agg(word, ' ') OVER near AS said, count(*) OVER near AS n
  FROM one WINDOW near AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY said ORDER BY doc_id, i) AS r FROM win WHERE n = 20) WHERE r > 1
),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM again),
kept AS (
  SELECT one.doc_id, string_agg(word, ' ' ORDER BY i) AS said, count(*) AS n
  FROM one ANTI JOIN gone USING (doc_id, i) GROUP BY one.doc_id
)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(said, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
