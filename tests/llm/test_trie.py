"""The prefix trie of conversations against brute force."""

import hashlib
import random
import zlib

import pytest

from recordweave.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, node string"


def slow(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    told = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in told:
        h = zlib.crc32(str(c).encode()) % 9
        base = int(c - (abs(c) % 5) * (1 if c > 0 else -1))
        built[c] = told.get(base, [])[:h] + told[c][h:]
    members, kids = {}, {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    total = {}
    for node, who in members.items():
        value = (len(who) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves, saved = total.get(node[:d], (0, 0))
            total[node[:d]] = leaves + (node not in kids), saved + value
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(built[c]) == len(node))
        up = min(members[node[:-1]]) if node else None
        out.append((min(who), len(node), up, len(who), len(kids.get(node, ())), *total[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **k):
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in trie.prefix_trie(df, **k).collect()), key=str)


def made(seed, n=80, longest=14):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        script = rng.randrange(4)
        for turn in range(rng.choice([0, 1, 2, 5, longest])):
            text = f"é{script} {turn}" if rng.random() < 0.9 else f"other {rng.randrange(3)}"
            rows.append((c, turn, ("user", "assistant")[turn % 2], text))
    return rows


@pytest.mark.parametrize("band", [2, 3, 8])
def test_bands(spark, band, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 10)
    rows = made(band)
    assert got(spark, rows, band=band) == slow(rows)


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "lost"), (5, None, None, None), (5, 0, "user", ""), (5, 0, "user", ""), (6, 3, "a", "b"), (6, 1, None, "x" * 5000),
        (-7, 0, "user", "minus"), (-5, 0, "user", "minus"), (-5, 1, "user", "more"), (100, 0, "us", "er"), (101, 0, "use", "r"), (11, None, "user", "é"),
    ]
    rows += [(c, t, "user", f"turn {t}") for c in (20, 21, 22, 23, 24) for t in range(4)]
    assert got(spark, rows) == slow(rows)


def test_long_conversations_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 3)
    rows = [(c, t, "user", f"{t}") for c in (30, 31, 32) for t in range(70)] + [(33, t, "user", f"{min(t, 40)}") for t in range(90)] + made(9, 20)
    assert got(spark, rows, band=3) == slow(rows)


def test_empty_table(spark):
    assert got(spark, []) == []
