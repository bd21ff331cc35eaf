"""The line CRF: exact marginals, gradient-free checks, held-out accuracy, odd rows."""

import itertools
import zlib

import numpy as np

from recordweave.llm import quality


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(2)
    chains = [rng.normal(size=(n, 2)) for n in (3, 1, 5, 3)]
    between = rng.normal(size=(2, 2))
    got, edges, total = quality.marginals(chains, between)
    pairs = np.zeros((2, 2))
    for k, s in enumerate(chains):
        every = []
        for y in itertools.product((0, 1), repeat=len(s)):
            every.append((sum(s[i, a] for i, a in enumerate(y)) + sum(between[a, b] for a, b in zip(y, y[1:])), y))
        z = np.logaddexp.reduce([v for v, _ in every])
        want = np.zeros_like(s)
        for v, y in every:
            for i, a in enumerate(y):
                want[i, a] += np.exp(v - z)
            for a, b in zip(y, y[1:]):
                pairs[a, b] += np.exp(v - z)
        assert np.allclose(got[k], want)
    assert np.allclose(edges, pairs)


def test_held_out_accuracy_and_order(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = quality.quality(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    out = [(r.predicted == truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert sum(out) / len(out) >= 0.97


def test_odd_rows(spark):
    junk, fine = "WORD!! OTHER!! THIRD!!\n" * 4, "Plain words stand here in order.\nAnd so does the next line.\n"
    docs = [(i, junk if i % 2 else fine) for i in range(40)] + [(100, None), (101, ""), (None, fine), (102, fine * 3000), (103, "\n" * 5000), (104, "\x00퟿ é|"), (0, fine)]
    d = spark.createDataFrame([(i, t, 0.5, "x") for i, t in docs], "doc_id bigint, text string, score double, quality string")
    l = spark.createDataFrame([(i, 0 if i % 2 else 1, 0) for i in range(40)] + [(0, 1, 0), (None, 1, 0), (41, None, 0)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality(d, l).collect()}
    assert got[1].predicted == 0 and got[2].predicted == 1 and got[100].score == got[101].score
    kept = quality.keep_good(d, l)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} >= {0, 2, 102, None}
    assert quality.quality(d.limit(0), l).count() == 0
    assert {r.score for r in quality.quality(d, l.limit(0)).collect()} == {0.5}
