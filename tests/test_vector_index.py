"""The inverted file against a scan of every vector."""

import datetime as dt
import random

import pytest

from recordweave.operators import retrieval, vector_index

ROWS = "record_id bigint, embedding array<float>, desk array<string>, at timestamp"
DESKS = ["defense", "ai", "energy"]
DAY = dt.datetime(2024, 1, 1)


def clustered(rng, n, size=8, groups=12):
    """Vectors round a few directions, a third of them one and the same."""
    centres = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(groups)]
    for i in range(n):
        v = list(centres[0]) if i % 3 == 0 else [x + rng.gauss(0, 0.1) for x in centres[rng.randrange(groups)]]
        yield i, v, rng.sample(DESKS, rng.randint(1, 3)), DAY + dt.timedelta(hours=rng.randint(0, 24 * 30))


def asked(spark, vectors):
    return spark.createDataFrame([(f"q{i}", DESKS[i % 3], v) for i, v in enumerate(vectors)], "query_id string, desk string, query array<double>")


def brute(rows, queries, k, since=None):
    kept = [r for r in rows if since is None or (r[3] is not None and r[3] >= since)]
    out = set()
    for qid, desk, q in queries:
        near = []
        for rid, v, desks, _ in kept:
            if not v or desks is None or desk not in desks or any(x is None for x in v):
                continue
            dot, a, b = (sum(x * y for x, y in zip(p, r)) for p, r in ((v, q), (v, v), (q, q)))
            if a and b:
                near.append((round(1 - dot / (a * b) ** 0.5, 6), rid))
        out |= {(qid, desk, rid, d, n) for n, (d, rid) in enumerate(sorted(near)[:k], 1)}
    return out


def got(df):
    return {(r["query_id"], r["desk"], r["record_id"], round(r["distance"], 6), r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("since", [None, "2024-01-12 06:00:00"])
def test_same_rows_as_a_scan(spark, since):
    rng = random.Random(5)
    # distances are held in steps that floats keep apart
    rows = [(i, [round(x, 2) for x in v], d, at) for i, v, d, at in clustered(rng, 900)]
    queries = [(f"q{i}", DESKS[i % 3], rows[i * 7][1]) for i in range(6)]
    df = spark.createDataFrame(rows, ROWS)
    index = vector_index.build(df, cells=12, rings=16)
    found, told = vector_index.search(index, spark.createDataFrame(queries, "query_id string, desk string, query array<double>"), 10, since=since)
    scan = {
        (q, desk, r["record_id"], round(r["distance"], 6), r["rank"]) for q, desk, v in queries
        for r in retrieval.vector_topk(df, spark.createDataFrame([(desk, v)], "desk string, query array<double>"), 10, since=since).collect()
    }
    assert got(found) == scan
    read = told.collect()
    assert len(read) == 6 and all(r["rows_read"] < 0.6 * r["rows_all"] for r in read)


def test_far_queries_read_a_small_share(spark):
    rng = random.Random(9)
    rows = list(clustered(rng, 3000, groups=24))
    index = vector_index.build(spark.createDataFrame(rows, ROWS), cells=24, rings=32)
    queries = asked(spark, [rows[i][1] for i in (1, 2, 4, 5, 7, 8)])
    _, told = vector_index.search(index, queries, 5)
    read, every = (sum(r[c] for r in told.collect()) for c in ("rows_read", "rows_all"))
    assert read < 0.25 * every


def test_odd_rows_and_queries(spark):
    rows = [
        (1, [1.0, 0.0], ["ai"], DAY), (2, [0.0, 0.0], ["ai"], DAY), (3, None, ["ai"], DAY), (4, [1.0, None], ["ai"], DAY), (5, [1.0, 1.0], None, DAY),
        (6, [0.5, 0.5], ["ai", None, "ai"], None), (7, [], ["ai"], DAY), (8, [1.0, 0.0], ["ai"], DAY), (8, [1.0, 0.0], ["ai"], DAY),
    ]
    queries = [("a", "ai", [1.0, 0.0]), ("zero", "ai", [0.0, 0.0]), ("none", "energy", [1.0, 0.0])]
    index = vector_index.build(spark.createDataFrame(rows, ROWS), cells=4, rings=4)
    asked_for = spark.createDataFrame(queries, "query_id string, desk string, query array<double>")
    found, _ = vector_index.search(index, asked_for, 10)
    assert [(r["query_id"], r["record_id"]) for r in found.orderBy("rank").collect()] == [("a", 1), ("a", 8), ("a", 8), ("a", 6)]
    # a row without a time is not young enough
    found, _ = vector_index.search(index, asked_for, 10, since="2023-01-01")
    assert sorted(r["record_id"] for r in found.collect()) == [1, 8, 8]


def test_no_rows(spark):
    index = vector_index.build(spark.createDataFrame([], ROWS))
    found, told = vector_index.search(index, asked(spark, [[1.0, 0.0]]), 3)
    assert found.count() == 0 and told.count() == 0


def test_against_brute_force(spark):
    rng = random.Random(11)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(3)], rng.sample(DESKS, 2), DAY + dt.timedelta(days=rng.randint(0, 9))) for i in range(400)]
    queries = [(f"q{i}", DESKS[i % 3], [float(rng.randint(1, 3)) for _ in range(3)]) for i in range(9)]
    index = vector_index.build(spark.createDataFrame(rows, ROWS), cells=10, rings=8, sample=50)
    found, _ = vector_index.search(index, spark.createDataFrame(queries, "query_id string, desk string, query array<double>"), 7)
    assert got(found) == brute(rows, queries, 7)
