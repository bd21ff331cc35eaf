"""Word-window removals by relative Lempel-Ziv factors, against brute force."""

import hashlib
import random

import pytest

from recordweave.llm import factors

SCHEMA = "doc_id bigint, text string, block int, kept string, words string"


def slow(rows):
    docs = [(factors.NO_ID if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in docs:
        for p in range(len(w) - 19):
            key = tuple(w[p : p + 20])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in docs:
        gone, seen = [False] * len(w), set()
        for p in range(len(w) - 19):
            key = tuple(w[p : p + 20])
            if first[key] < i or key in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((None if i == factors.NO_ID else i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **k):
    df = spark.createDataFrame([(i, t, 5, "k", "w") for i, t in rows], SCHEMA)
    return sorted((tuple(r)[:4] for r in factors.removals(df, **k).collect()), key=str)


def made(seed, n=60):
    """Texts stitched from a few passages, so that windows match in many different surroundings."""
    rng = random.Random(seed)
    bank = [[f"w{rng.randrange(40)}" for _ in range(rng.randint(5, 60))] for _ in range(8)]
    out = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 5)):
            part = rng.choice(bank)
            a = rng.randrange(len(part))
            words += part[a : a + rng.randint(1, 60)] if rng.random() < 0.7 else [f"w{rng.randrange(40)}" for _ in range(9)]
        out.append((rng.randrange(n), rng.choice([" ", "\n", "\t ", "\x0b"]).join(words)))
    return out


@pytest.mark.parametrize("options", [{}, {"block_bytes": 700, "share_bytes": 900}, {"block_bytes": 500, "hot_blocks": 2}])
def test_stitched_passages(spark, options):
    for seed in range(2):
        rows = made(seed)
        assert got(spark, rows, **options) == slow(rows)


def test_whole_table_and_odd_rows(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    part = " ".join(f"é{i}" for i in range(30))
    docs += [(900, None), (901, ""), (902, " \t\n "), (903, "x " * 19), (904, "x " * 20), (905, "x " * 300), (906, part + " " + part), (None, part),
             (None, part), (907, part), (907, part), (908, part.upper()), (909, docs[3][1] + " " + docs[5][1]), (-5, part[:80]), (-6, "a b " * 9000),
             (910, "x y " * 25), (911, "y x " * 25)]
    want = slow(docs)
    assert got(spark, docs) == want
    assert got(spark, docs, block_bytes=40_000, share_bytes=30_000, hot_blocks=3) == want


def test_pieces_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(factors, "PLACE_BITS", 6)
    words = factors.Words([t.encode() for _, t in made(3)])
    seen = [w for first, many, _ in words.runs() for a, n in zip(first, many) for w in range(a, a + n)]
    assert seen == [a + p for a, n in zip(words.starts.tolist(), words.sizes.tolist()) for p in range(max(0, n - 19))]


def test_factors_are_greedy_and_checked_at_their_ends():
    ref = factors.Reference()
    a, b = [b"a%d" % i for i in range(30)], [b"b%d" % i for i in range(30)]
    ref.add(a)
    ref.add(a[20:] + b)
    text = [b"z"] + a + b[:15] + [b"z"]
    # the second factor starts inside the first one, where only the second run goes on
    assert ref.factors(text) == [(1, 30), (21, 25)]
    assert factors.parse_runs([(7, b" ".join(text)), (3, b" ".join(a)), (3, b" ".join(a[5:] + b[:1]))]) == [((1 << 12) - 1) << 1, 0, 0]


def test_empty_table(spark):
    assert got(spark, []) == []
