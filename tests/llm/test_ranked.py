"""Search over length strata against brute force."""

import math
import random
import re
from collections import Counter

import pytest

from recordweave.llm import ranked

DOCS = "doc_id bigint, text string, m int, terms string"
ITEMS = "item_id bigint, text string, q int, rank string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def slow(docs, items, k=20):
    bags = [(ranked.NO_ID if i is None else i, Counter(terms(t))) for i, t in docs]
    bags = [b for b in bags if b[1]]
    n, length = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for doc, b in bags:
            m = 75 + 25 * b.total() * n // length
            score = 0
            for t in terms(text):
                if b[t]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 12 * m))
            if score > 0:
                found.append((-score, doc))
        out += [(item, r, None if d == ranked.NO_ID else d, -s) for r, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def got(spark, docs, items, most=ranked.STRATUM_POSTINGS, **k):
    index = ranked.build(spark.createDataFrame([(i, t, 1, "t") for i, t in docs], DOCS), most)
    return sorted((tuple(r) for r in ranked.search(index, spark.createDataFrame([(i, t, 1, "r") for i, t in items], ITEMS), **k).collect()), key=str)


def made(seed, n=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(60)], k=rng.choice([0, 1, 3, 10, 10, 40, 200])))) for i in range(n)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 8])))) for i in range(30)]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"most": 40}, {"most": 10, "block_terms": 12}, {"most": 40, "k": 3}])
def test_whole_ranking(spark, options):
    docs, items = made(len(options))
    assert got(spark, docs, items, **options) == slow(docs, items, options.get("k", 20))


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, ".,;"), (4, "Été ÉTÉ x1"), (5, "Alpha_beta-gamma 7"), (5, "alpha BETA"), (None, "alpha beta"), (None, "alpha beta"),
            (-9, "alpha beta"), (7, "alpha " * 5000 + "omega"), (8, "delta"), (9, "alpha beta"), (9, "alpha beta")]
    items = [(1, "alpha beta"), (1, "Alpha, alpha!"), (None, "omega delta"), (2, None), (3, "unknown words"), (4, "ÉTÉ Été"), (4, "beta beta beta x1")]
    assert got(spark, docs, items) == slow(docs, items)
    assert got(spark, docs, items, most=2, block_terms=1) == slow(docs, items)


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a")]) == []
    assert got(spark, [(1, "a b")], []) == []
    assert got(spark, [(1, None)], [(1, "a")]) == []
