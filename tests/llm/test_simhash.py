"""SimHash links and components against brute force."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from recordweave.llm import simhash

SCHEMA = "doc_id bigint, text string, fp string, root string, t int"


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow(rows):
    prints = [slow_print(r[1]) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((r[0], f"{prints[i]:016x}", min(ids, default=None)))
    return sorted(out, key=str)


def test_whole_table_and_odd_rows(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    long = " ".join(f"w{i % 977}" for i in range(60000))
    odd = [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "One"), (1004, "one"), (None, "one"), (None, "alone here"),
           (1005, "A b\x0bC"), (1006, "Éa ÉB"), (1007, long), (1008, long + " end"), (3, docs[3][1]), (1004, "one")]
    rows = docs + odd
    df = spark.createDataFrame([(a, b, "x", "y", 1) for a, b in rows], SCHEMA)
    got = sorted(((r[0], r[1], r[2]) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == slow(rows)


def test_empty_table(spark):
    out = simhash.near_duplicates(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and out.count() == 0


@pytest.mark.parametrize("tile", [4, 4096])
def test_links_of_a_dense_bucket_and_far_chains(spark, tile):
    base = 0x0123456789ABCDEF
    ball = {base} | {base ^ (1 << i) for i in range(40)} | {base ^ (1 << i) ^ (1 << (i + 7)) for i in range(30)}
    chain = [0xFFFF0000FFFF0000 ^ ((1 << 4 * i) - 1) for i in range(8)]
    values = [simhash.signed(v) for v in [*ball, *chain]]
    out = simhash.components(simhash.links(spark.createDataFrame([(v,) for v in values], "fp bigint"), tile=tile))
    roots = {r.node: r.root for r in out.collect()}
    assert len({roots[simhash.signed(v)] for v in ball}) == 1
    assert len({roots[simhash.signed(v)] for v in chain}) == 1
    assert roots[values[0]] != roots[simhash.signed(chain[0])]


def test_one_of_each(spark):
    rows = [(5, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (9, "other words are in this"), (None, "a b c d e")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("k", F.lit(1))
    out = simhash.one_of_each(df)
    assert out.columns == ["doc_id", "text", "k"]
    assert sorted(str(r.doc_id) for r in out.collect()) == ["2", "9", "None"]


def test_one_of_each_tells_rows_apart_by_text(spark):
    a, b = "one text of a few words here", "and quite another one is there"
    for rows, want in (
        ([(1, a), (1, b)], [(1, a), (1, b)]),
        ([(1, a), (5, a), (5, b)], [(1, a), (5, b)]),
        ([(3, b), (3, b), (2, a)], [(2, a), (3, b)]),
    ):
        df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id bigint, text string, _kept_id int, _kept_sig int")
        out = simhash.one_of_each(df)
        assert out.columns == df.columns and sorted((r.doc_id, r.text) for r in out.collect()) == sorted(want)


def test_links_of_a_dense_cluster_are_fewer_than_its_nodes():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 100).astype(np.uint64)
    rows = []
    for i in range(120):
        own = base.copy()
        own[rng.integers(0, 100, 8)] = rng.integers(0, 1 << 62, 8)
        own = np.unique(own)
        sketch = (simhash.minhash(own) >> np.uint64(24)).astype(np.uint8).tobytes()
        rows.append((i, i, sketch, own.tobytes()))
    links = list(simhash.forest_over(rows, 0.69, 0.8))
    assert len(links) < len(rows)
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            x, y = (np.frombuffer(rows[k][3], np.uint64) for k in (i, j))
            if label[i] != label[j] and 5 * len(np.intersect1d(x, y)) >= 4 * len(np.union1d(x, y)):
                label = [label[i] if x == label[j] else x for x in label]
    mine = list(range(len(rows)))
    for a, b in links:
        mine = [mine[a] if x == mine[b] else x for x in mine]
    assert len(set(mine)) == len(set(label))


def grams(text):
    words = (text or "").lower().split()
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_similar_texts_against_all_pairs(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows = [(i, t) for i, t in docs if t and t.isascii()]
    base = [f"w{i * i % 9973}" for i in range(300)]
    for k in range(40):  # 1 to 8 words changed: similarities on both sides of 0.8
        own = list(base)
        for c in range(k % 8 + 1):
            own[(37 * c + 11 * k) % 300] = f"x{k}-{c}"
        rows.append((5000 + k, " ".join(own)))
    rows += [(6000, ""), (6001, None), (6002, "one two"), (6003, "One  two"), (None, "one two")]
    sets = [grams(t) for _, t in rows]
    label, found = list(range(len(rows))), 0
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                found += sets[i] != sets[j] and (simhash.simhash(rows[i][1].encode()) ^ simhash.simhash(rows[j][1].encode())).bit_count() > 4
                if label[i] != label[j]:
                    a, b = label[i], label[j]
                    label = [a if x == b else x for x in label]
    low = {x: min((rows[i][0] for i in range(len(rows)) if label[i] == x and rows[i][0] is not None), default=None) for x in label}
    want = sorted(((r[0], low[x]) for r, x in zip(rows, label)), key=str)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found and sorted((tuple(r) for r in simhash.similar(df).collect()), key=str) == want
    assert sorted((tuple(r) for r in simhash.similar(df, tile=5, tile_bytes=4000).collect()), key=str) == want
    assert {r.doc_id for r in simhash.one_of_each(df).collect()} == {c for _, c in want} | {None}
    assert simhash.similar(df.limit(0)).count() == 0


def test_near_dedup_goes_through_simhash_links_and_checks_them(spark, monkeypatch):
    base = [f"w{i * i % 9973}" for i in range(400)]
    texts = [" ".join(base), " ".join([*base[:200], "one", *base[201:]]), " ".join(f"v{i * 7 % 997}" for i in range(300)), " ".join(f"u{i * 11 % 997}" for i in range(200))]
    prints = [simhash.signed(simhash.simhash(t.encode())) for t in texts]
    assert ((prints[0] ^ prints[1]) & 0xFFFFFFFFFFFFFFFF).bit_count() <= 4
    given, plain = [], simhash.links

    def seen(df, distance, **more):
        out = plain(df, distance, **more)
        given.append({frozenset(r) for r in out.collect()})
        # two unlike texts as if their fingerprints were close: the check on their words must part them
        return out.union(spark.createDataFrame([(prints[2], prints[3])], "a bigint, b bigint"))

    monkeypatch.setattr(simhash, "links", seen)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = sorted(r.doc_id for r in simhash.one_of_each(df).collect())
    assert given == [{frozenset(prints[:2])}] and kept == [0, 2, 3]


def test_keys_of_the_blocks_are_not_broadcast(spark):
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") not in ("-1", "0")
    prints = spark.range(4000).select(F.xxhash64("id").alias("fp"))
    for df in (prints, prints.groupBy("fp").agg(F.count("*").alias("n"))):
        found = simhash.links(df)
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_exploded_bands_are_not_broadcast(spark, monkeypatch):
    plans, plain = {}, simhash.stage
    monkeypatch.setattr(simhash, "stage", lambda df, name, *a: plans.setdefault(name, df._jdf.queryExecution().sparkPlan().toString()) and plain(df, name, *a))
    df = spark.createDataFrame([(i, f"some words of text number {i % 5} stand here") for i in range(30)], "doc_id bigint, text string")
    assert simhash.one_of_each(df).count() == 5
    assert "SortMergeJoin" in plans["met"] and "Broadcast" not in plans["met"]
