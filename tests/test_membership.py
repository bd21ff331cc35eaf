"""Key filters, posting lists, mergeable pair states and interval joins against brute force."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from recordweave.operators import graph, ingest, membership, postings, ranking, reading
from recordweave.sources import sinks

RAW = "source_id string, native_id string, content_hash string, arrival bigint"


def batches(seed):
    rng = random.Random(seed)
    low = 0
    for k in range(5):
        rows = [(rng.choice("ab"), str(rng.randint(low, low + 60)) if rng.random() < 0.97 else None, "h", i) for i in range(80)]
        low += rng.choice([0, 40, 200])
        yield f"run {k}", rows


@pytest.mark.parametrize("options", [{}, {"bits_per_key": 0.001, "hashes": 1}])
def test_append_reads_only_partitions_that_may_hold_a_key(spark, tmp_path, options, monkeypatch):
    path = str(tmp_path / "raw")
    if options:  # nearly every partition looks as if it held everything
        monkeypatch.setattr(membership, "_is_set", lambda bitmap, bit: F.lit(True))
    stored = spark.createDataFrame([], RAW)
    for run, rows in batches(3):
        batch = spark.createDataFrame(rows, RAW)
        want = ingest.flag_new(batch, stored).filter("is_new").drop("is_new").collect()
        counts = sinks.append_new(spark, batch, path, run, **options).first()
        assert (counts["fetched"], counts["new"], counts["duplicate"]) == (len(rows), len(want), len(rows) - len(want))
        stored = spark.createDataFrame([*stored.collect(), *want], RAW)
        again = sinks.append_new(spark, batch, path, run, **options).first()  # a run that is repeated changes nothing
        assert again == counts
    assert sorted(map(str, spark.read.parquet(path).drop("run_id").collect())) == sorted(map(str, stored.collect()))


def test_runs_to_read(spark, tmp_path):
    path = str(tmp_path / "raw")
    for k in range(4):
        sinks.append_new(spark, spark.createDataFrame([("a", f"{k}-{i}", "h", i) for i in range(200)], RAW), path, f"r{k}")
    batch = spark.createDataFrame([("a", "2-7", "h", 1), ("a", "new", "h", 2)], RAW)
    assert sinks.runs_to_read(spark, batch, path, "x") == ["r2"]
    plan = spark.read.parquet(path).filter(F.col("run_id").isin(["r2"]))._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*run_id", plan)
    assert sinks.runs_to_read(spark, batch, str(tmp_path / "nothing"), "x") == []


@pytest.mark.parametrize("dense", [1, 3, 10**6])
def test_posting_lists(spark, dense):
    rng = random.Random(dense)
    members = [(rng.choice([0, -70000, 5, 32768, 32769, 100000]) + rng.randint(0, 40), rng.randint(0, 8)) for _ in range(600)]
    df = spark.createDataFrame(members, "item bigint, entity bigint")
    held = {e: {i for i, x in members if x == e} for e in range(9)}
    follows = [(u, e) for u in range(4) for e in range(9) if (u + e) % 3 == 0] + [(1, 99)]
    got = {tuple(r) for r in reading.followed_items(df, spark.createDataFrame(follows, "user_id bigint, entity bigint"), dense).collect()}
    assert got == {(u, i) for u, e in follows for i in held.get(e, ())}
    pairs = [(a, b) for a in range(9) for b in range(a)] + [(1, 99)]
    both = postings.common_items(postings.Postings(df, dense), spark.createDataFrame(pairs, "from_id bigint, to_id bigint")).collect()
    want = {(a, b, i) for a, b in pairs for i in held.get(a, set()) & held.get(b, set())}
    assert len(both) == len(want) and {tuple(r) for r in both} == want


def test_pair_state_is_mergeable(spark):
    rng = random.Random(1)
    start = dt.date(2026, 1, 1)
    rows = [(i, "ab"[i % 2], start + dt.timedelta(days=i % 60), rng.randint(1, 9)) for i in range(120) for _ in range(4)]
    df = spark.createDataFrame(rows, "item bigint, desk string, at date, entity bigint")
    as_of, ref = "2026-03-05", "2025-06-01"
    want = sorted(map(str, graph.convergence_edges(df, as_of, ["a", "b"]).collect()))
    parts = [graph.pair_state(df.filter(F.col("at").between(a, b)), ref, ["a", "b"]) for a, b in
             ((dt.date(2025, 1, 1), dt.date(2026, 1, 20)), (dt.date(2026, 1, 21), dt.date(2026, 1, 21)), (dt.date(2026, 1, 22), dt.date(2027, 1, 1)))]
    one = graph.merge_pair_states(graph.merge_pair_states(*parts[:2]), parts[2])
    assert want and sorted(map(str, graph.edges_of_state(one, as_of, ref, ["a", "b"]).collect())) == want


@pytest.mark.parametrize("levels", [1, 3, 12])
def test_edges_as_of_many_dates(spark, levels):
    rng = random.Random(levels)
    day = lambda n: dt.date(2026, 1, 1) + dt.timedelta(days=n)
    edges = [(i, day(a), rng.choice([None, day(a + rng.randint(-1, 70))]), day(a + rng.randint(0, 5))) for i in range(200) for a in [rng.randint(-20, 90)]]
    dates = [day(n) for n in rng.sample(range(100), 30)]
    df = spark.createDataFrame(edges, "id bigint, valid_from date, valid_to date, transaction_time date")
    out = graph.edges_as_of_dates(df, spark.createDataFrame([(d,) for d in dates] * 2, "date date"), levels=levels)
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()
    want = sorted((d, i) for d in dates for i, a, b, known in edges if a <= d and (b is None or b > d) and known <= d)
    assert sorted((r.date, r.id) for r in out.collect()) == want
    assert graph.edges_as_of_dates(df, spark.createDataFrame([], "date date")).count() == 0


def test_retention_asks_every_table_and_keeps_rows_without_a_date(spark):
    old, young = dt.datetime(2025, 1, 1), dt.datetime(2026, 1, 1)
    raw = spark.createDataFrame([(1, old), (2, old), (3, old), (4, old), (5, young), (6, None), (7, old)], "k bigint, created_at timestamp")
    normalized = spark.createDataFrame([(1, old), (2, young), (7, None)], "k bigint, created_at timestamp")
    cites, edges, queue = (spark.createDataFrame([(k,)], "k bigint") for k in (3, 4, 99))
    kept, left, counts = ingest.retain(raw, normalized, F.lit(dt.datetime(2025, 7, 1)), "k", cites, edges, queue)
    assert {r.k for r in kept.collect()} == {2, 3, 4, 5, 6, 7} and {r.k for r in left.collect()} == {2, 7}
    assert {tuple(r) for r in counts.collect()} == {("raw", 6, 1), ("normalized", 2, 1)}


def test_amounts_on_both_sides_of_the_window(spark):
    now = dt.datetime(2026, 6, 1)
    rows = [("d", now - dt.timedelta(days=n), a) for n, a in ((0, 5.0), (89, 7.0), (90, 1.0), (91, 900.0), (3, 0.0), (4, None))]
    df = spark.createDataFrame(rows, "desk string, at timestamp, amount_usd double")
    assert tuple(ranking.amount_window(df, "at", F.lit(now)).first()) == ("d", 1.0, 7.0, 3)
    assert tuple(ranking.amount_window(df).first()) == ("d", 1.0, 900.0, 4)
    by_day = {r.day: (r.low, r.high, r.points) for r in ranking.sliding_amounts(df, "at").collect()}
    assert by_day[now.date()] == (1.0, 7.0, 3) and by_day[(now - dt.timedelta(days=3)).date()] == (1.0, 900.0, 3)


def test_phrases_of_any_length(spark):
    from recordweave.operators.common import match_phrases

    rng = random.Random(5)
    texts = {i: [rng.choice("ABCD") for _ in range(rng.choice([0, 1, 3, 30, 120]))] for i in range(40)}
    phrases = {" ".join(rng.choice("ABCD") for _ in range(n)) for n in (1, 2, 2, 3, 3, 4, 5)}
    for n in (6, 7, 8, 13, 16, 29, 40, 40):
        words = rng.choice([w for w in texts.values() if len(w) >= 100])
        at = rng.randrange(len(words) - n)
        phrases.add(" ".join(words[at : at + n]))
    phrases |= {" ".join(p.split()[:-1] + ["Z"]) for p in list(phrases) if " " in p}
    rows = [(p, i) for i, p in enumerate(sorted(phrases))] + [("A B", 900), ("A B", 901)]
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, tokens array<string>")
    table = spark.createDataFrame(rows, "phrase string, owner bigint")

    def want(low, high):
        out = set()
        for d, words in texts.items():
            for p, owner in rows:
                own = p.split()
                at = next((i for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own), None)
                if at is not None and low <= len(own) <= high:
                    out.add((d, p, owner, at, len(own)))
        return out

    for low, high in ((1, None), (2, None), (2, 5)):
        got = match_phrases(docs, "doc_id", "tokens", table, "phrase", low, high).collect()
        assert {tuple(r) for r in got} == want(low, high or 99) and len(got) == len(want(low, high or 99))
    assert match_phrases(docs, "doc_id", "tokens", table.limit(0), "phrase", 1).count() == 0


def test_few_candidates_for_each_similar_pair(spark):
    from recordweave.operators import resolution

    rng = random.Random(2)
    parts = ["north", "river", "steel", "power", "atlas", "global", "union", "delta", "cobalt", "harbor", "vector", "summit"]
    pick = lambda: " ".join(rng.choice(parts) + rng.choice(["", "s", "co"]) for _ in range(rng.randint(1, 3)))
    left, right = (spark.createDataFrame([(pick(),) for _ in range(300)] + [("é ü",), ("",)], "name string") for _ in range(2))
    sims = resolution.similar_names(left, right, 0.6)
    sets = lambda df: {r.name: set(r.g) for r in df.distinct().select("name", resolution.trigrams(F.col("name")).alias("g")).collect()}
    a, b = sets(left), sets(right)
    want = {(x, y) for x, p in a.items() for y, q in b.items() if p and q and len(p & q) >= 0.6 * len(p | q) - 1e-9}
    got = [(r.name, r.alias) for r in sims.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    tried = resolution.candidate_names(left, right, 0.6).select("name", "alias").distinct().count()
    assert len(want) <= tried < 10 * len(want)
