"""Patterns against the plain expressions; the network on values it has not seen."""

import hashlib
import random
import re

import numpy as np
import pytest

from recordweave.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            d = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d[::-1]))
                if not 12 <= len(d) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], list(PLAIN).index(s[0])))


def test_patterns_on_noise():
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice(["@", "@", ".", ".", "-", "+", " ", "a", "b1", "7", "42", "255", "0", "4111111111111111", "(", ")", "é", "\n", "%"]) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == slow(text), text
    for text in ("a@b.c@d.e", "x@y@z.w.", "..@a.b", "1.2.3.4.5.6.7.8", "1234.1.1.1", "0001.2.3.004", "9" * 4000 + ".1.1.1", "a" * 5000 + "@", "+1 (2) 3", "4111 1111 1111 1111"):
        assert pii.base_spans(text) == slow(text), text


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_gradient():
    p = {k: v.astype(np.float64) for k, v in pii.start_weights(1).items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, pii.CLASSES, (3, 9)), np.array([[0, 1, 2, 0, 3, 4, 4, 0, 0]] * 3)
    _, g = pii.gradient(x, y, p)
    for k in p:
        at = tuple(rng.integers(0, n) for n in p[k].shape)
        if k == "embed":
            at = (x[0, 0], 1)
        if k == "move":
            at = (1, 2)
        p[k][at] += 1e-3
        up = pii.gradient(x, y, p)[0]
        p[k][at] -= 2e-3
        down = pii.gradient(x, y, p)[0]
        p[k][at] += 1e-3
        assert abs((up - down) / 2e-3 - g[k][at]) < 2e-3, k


def test_network_finds_unseen_forms_and_leaves_the_rest(model):
    rng = random.Random(99)
    hit = dict.fromkeys(pii.KINDS, 0)
    texts, wanted = [], []
    for k in range(400):
        kind = pii.KINDS[k % 4]
        value = pii.variant(kind, rng)
        texts.append("thereon and the ingly " + value + " of hereat tion and")
        wanted.append((kind, 22, 22 + len(value)))
    for want, spans in zip(wanted, pii.model_spans(texts, model)):
        hit[want[0]] += want in spans
    assert min(hit.values()) >= 80, hit
    calm = ["thereon and the ingly " + pii.harmless(rng) + " of hereat tion and" for _ in range(400)]
    assert sum(map(bool, pii.model_spans(calm, model))) <= 12
    assert pii.model_spans(["no such thing here", ""], model) == [[], []]


def test_table(spark, model):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    docs += [(5000, None), (5001, ""), (None, "mail a@b.co"), (5002, "x " * 50000 + "+1 (549) 555-8300"), (5001, "")]
    df = spark.createDataFrame([(i, t, "s", 2) for i, t in docs], "doc_id bigint, text string, spans string, n_ip int")
    extra = 0
    got = pii.find_all(df, model).collect()
    assert len(got) == len(docs)
    by = {}
    for r in got:
        by.setdefault(r[0], []).append(r)
    for i, text in docs:
        base = slow(text or "")
        row = by[i][0]
        mark = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert row.base_sha256 == hashlib.sha256(mark.encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[0] == k for s in base) for k in PLAIN]
        spans = [x for x in row.spans.split(",") if x]
        assert set(mark.split(",")) - {""} <= set(spans)
        extra += len(spans) - len(base)
    assert extra <= 3
    assert pii.find_all(df.limit(0), model).count() == 0


def test_fit_without_any(spark):
    model = pii.fit(spark.createDataFrame([], "doc_id bigint, text string"))
    assert set(model) == set(pii.start_weights(0))
