"""Suffix sorting and removals against brute force."""

import hashlib
import random

import numpy as np
import pytest

from recordweave.llm import suffixes

SCHEMA = "doc_id bigint, text string, block int, kept string"


def slow(rows):
    docs = sorted(((suffixes.NO_ID if i is None else i, (t or "").encode()) for i, t in rows))
    first = {}
    for i, b in docs:
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    out = []
    for i, b in docs:
        gone = [False] * len(b)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = [True] * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((None if i == suffixes.NO_ID else i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **k):
    df = spark.createDataFrame([(i, t, 5, "k") for i, t in rows], SCHEMA)
    return sorted((tuple(r)[:5] for r in suffixes.removals(df, **k).collect()), key=str)


@pytest.mark.parametrize("letters", [1, 2, 5, 200])
def test_suffix_array(letters):
    rng = np.random.default_rng(letters)
    for n in [0, 1, 2, 3, 4, 5, 6, 7, 8, 30, 31, 32, 300]:
        s = rng.integers(1, letters + 1, n)
        want = sorted(range(n), key=lambda i: s[i:].tolist())
        assert suffixes.suffix_array(s).tolist() == want


def test_suffix_array_with_large_names():
    s = np.random.default_rng(1).integers(1, 1 << 30, 400) // (1 << 24) * (1 << 24) + 1
    assert suffixes.suffix_array(s).tolist() == sorted(range(400), key=lambda i: s[i:].tolist())


def test_whole_table_and_odd_rows(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    shared = "exactly these words are shared and have éà in them, over fifty bytes"
    docs += [(900, None), (901, ""), (902, "x" * 49), (903, "x" * 300), (904, "x" * 60 + shared), (905, shared + "y" * 55 + shared), (None, shared),
             (None, shared), (906, shared[:50]), (906, shared[:50]), (907, docs[3][1] + docs[5][1]), (-5, shared[3:58]), (908, "ab" * 20000)]
    assert got(spark, docs) == slow(docs)
    assert got(spark, docs, block_bytes=40_000, share_bytes=30_000) == slow(docs)


def test_pieces_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE_BITS", 8)
    rng = random.Random(5)
    word = ["".join(rng.choice("abcd") for _ in range(40)) for _ in range(12)]
    docs = [(i, "".join(rng.choice(word) for _ in range(rng.randint(0, 30)))) for i in range(12)]
    body, starts = suffixes.joined([t.encode() for _, t in docs])
    seen = [w for first, many, _ in suffixes.minimiser_runs(np.frombuffer(body, np.uint8)) for a, n in zip(first, many) for w in range(a, a + n)]
    assert seen == [s + p for s, (_, t) in zip(starts.tolist(), docs) for p in range(max(0, len(t) - 49))]
    assert got(spark, docs) == slow(docs)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_a_block_finds_its_runs_once(monkeypatch):
    rng = random.Random(5)
    shared = "".join(rng.choice("abcd") for _ in range(300))
    docs = [(i, (shared[rng.randrange(100) :] + "".join(rng.choice("abcd") for _ in range(60)) * (i % 3)).encode()) for i in (7, 3, 9, 4, 8)]
    blob = suffixes.squeeze(np.array([d for d, _ in docs], "<i8"), np.array([len(t) for _, t in docs], "<i8"), b"".join(t for _, t in docs))
    body, _ = suffixes.joined([t for _, t in docs])
    known = np.unique(np.concatenate([k for _, _, k in suffixes.minimiser_runs(np.frombuffer(body, np.uint8))]))[::2]
    calls, find = [], suffixes.minimiser_runs
    monkeypatch.setattr(suffixes, "minimiser_runs", lambda raw: calls.append(1) or find(raw))
    block = suffixes.Block([blob], [suffixes.squeeze(suffixes.steps(known))])
    parts, head, which = block.distinct()
    assert len(calls) == 1 and set(block.key.tolist()) == set(known.tolist())
    seen = [block.body[a : a + n + suffixes.LENGTH - 1] for a, n in zip(block.first.tolist(), block.many.tolist())]
    assert parts == list(dict.fromkeys(seen)) and len(parts) < len(seen)
    assert [parts[k] for k in which.tolist()] == seen
    assert head.tolist() == [seen.index(p) for p in parts]
    owner = {p: min(d for d, t in docs if p in t) for p in parts}
    assert [int(block.ids[block.doc[i]]) for i in head] == [owner[p] for p in parts]


def test_smallest_owner_of_each_string():
    rng = random.Random(6)
    core = bytes(rng.choice(b"ab") for _ in range(70))
    parts = [core[i : i + 50 + i] for i in range(0, 12, 2)] + [core + b"x", b"y" + core]
    owners = np.array([5, 3, 8, 1, 9, 2, 7, 4])
    want = [
        min(int(o) for q, o in zip(parts, owners) if p[k : k + 50] in q) for p in parts for k in range(len(p) - 49)
    ]
    assert suffixes.smallest_owner(parts, owners).tolist() == want


@pytest.mark.parametrize("group", [1, 3])
def test_values_sent_do_not_multiply_blocks_by_shares(spark, monkeypatch, group):
    monkeypatch.setattr(suffixes, "KEY_BYTES", 4000)
    monkeypatch.setattr(suffixes, "GROUP", group, raising=False)
    monkeypatch.setattr(suffixes, "GROUPS", 1, raising=False)
    made, plain = [], suffixes.map_rows
    monkeypatch.setattr(suffixes, "map_rows", lambda *a, **k: made.append(plain(*a, **k)) or made[-1])
    rng = random.Random(8)
    word = ["".join(rng.choice("abcdefgh") for _ in range(90)) for _ in range(60)]
    docs = [(i, "".join(rng.choice(word) for _ in range(6)) + "".join(rng.choice("abcdefgh") for _ in range(60))) for i in range(120)]
    size = sum(len(t) + 1 for _, t in docs)
    blocks, key_shares, shares = -(-size // 1000), -(-size // 4000), -(-size // 1500)
    assert got(spark, docs, block_bytes=1000, share_bytes=1500) == slow(docs)
    keys, sent = made[0].count(), made[3].count()
    # one value a share for each task that reads texts, not one for each block in it
    assert keys <= 4 * 2 * key_shares < blocks * key_shares
    assert sent <= blocks * -(-shares // group)
