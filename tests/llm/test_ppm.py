"""Partial matching against a plain trie of dictionaries."""

import math
import zlib
from collections import Counter

import numpy as np

from recordweave.llm import ppm


def slow(rows, order):
    train = [(t or "").encode().lower() for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    c, trie = Counter(), [{} for _ in range(order + 1)]
    for t in train:
        c.update(t.split())
        c["end"] += 1
        b = bytes([ppm.START]) * order + t + bytes([ppm.END])
        for i in range(order, len(b)):
            for k in range(order + 1):
                node = trie[k].setdefault(b[i - k : i], {})
                node[b[i]] = node.get(b[i], 0) + 1
    n, v = sum(c.values()), len(c)

    def code(t):
        b, total = bytes([ppm.START]) * order + t + bytes([ppm.END]), 0.0
        for i in range(order, len(b)):
            gone = set()
            for k in range(order, -1, -1):
                node = {s: m for s, m in trie[k].get(b[i - k : i], {}).items() if s not in gone}
                size = sum(node.values()) + len(node)
                if b[i] in node:
                    total += math.log10(node[b[i]] / size)
                    break
                if node:
                    total += math.log10(len(node) / size)
                gone |= set(node)
            else:
                total -= math.log10(256 - len(gone))
        return total

    out = []
    for i, t in rows:
        t = (t or "").encode().lower()
        words = [*t.split(), "end"]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words)
        out.append((i, zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, len(words), sum(c[w] > 0 for w in words), n, round(base, 5), round(code(t), 1)))
    return sorted(out, key=str)


def got(spark, rows, **k):
    df = spark.createDataFrame([(i, t, 1, "h") for i, t in rows], "doc_id bigint, text string, block int, held string")
    return sorted(((*r[:5], round(r[5], 5), round(r[6], 1)) for r in ppm.score(df, **k).collect()), key=str)


def close(a, b):
    assert [r[:5] for r in a] == [r[:5] for r in b]
    assert np.allclose([r[5:] for r in a], [r[5:] for r in b], atol=0.11)


def test_table_and_odd_rows(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60).collect()]
    rows += [(900, None), (901, ""), (902, "A b\x0bÉ " * 2000), (None, "no id"), (901, ""), (903, "\x00\x01 \x7f")]
    close(got(spark, rows), slow(rows, 5))
    close(got(spark, rows, order=3, block_bytes=40_000), slow(rows, 3))


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    close(got(spark, [(held, "abc def")]), slow([(held, "abc def")], 5))
    assert got(spark, []) == []


def test_lookup():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 62, 5000).astype(np.uint64))
    values = np.arange(len(keys))
    at = rng.integers(0, len(keys), 20000)
    assert (ppm.Lookup(keys, values)(keys[at]) == at).all()
    assert (ppm.unpacked(ppm.packed(keys, values.astype("<i8")), "<i8")[0] == keys).all()
