"""Operators on small tables, against hand-computed or brute-force results."""

import datetime as dt
import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from recordweave import dims
from recordweave.operators import (
    common, funding, gazetteer, graph, ingest, ranking, reading, resolution, retrieval, telemetry, verdicts,
)
from recordweave.session import stage

DAY = dt.date(2026, 7, 1)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols or df.columns) for r in df.collect())


# --- shared pieces ---------------------------------------------------------------------

def test_positions_equal_one_global_sort(spark):
    data = [(d, round(random.Random(i).random(), 1), i) for i in range(400) for d in ("a", "b") if (i + len(d)) % 3 or d == "a"]
    df = spark.createDataFrame(data, "desk string, score double, id bigint")
    got = common.positions(df, ["desk"], "score", "id", "pos")
    plain = df.withColumn(
        "pos", F.expr("row_number() OVER (PARTITION BY desk ORDER BY score DESC, md5(cast(cast(id AS string) AS binary)), id)")
    )
    assert rows(got, "desk", "id", "pos") == [(r[0], r[1], r[2]) for r in rows(plain, "desk", "id", "pos")]


def test_match_phrases_against_brute_force(spark):
    rng = random.Random(7)
    words = ["A", "B", "C", "D"]
    docs = [(i, [rng.choice(words) for _ in range(rng.randint(0, 12))]) for i in range(60)]
    phrases = {" ".join(p) for n in (1, 2, 3) for p in itertools.product(words, repeat=n) if rng.random() < 0.4}
    want = set()
    for i, toks in docs:
        for ph in phrases:
            k = ph.split()
            at = [p for p in range(len(toks) - len(k) + 1) if toks[p : p + len(k)] == k]
            if at:
                want.add((i, ph, at[0]))
    ddf = spark.createDataFrame(docs, "doc bigint, toks array<string>")
    pdf = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    got = common.match_phrases(ddf, "doc", "toks", pdf, "phrase", 1, 3)
    assert set(rows(got, "doc", "phrase", "pos")) == want


# --- graph -----------------------------------------------------------------------------

def members(spark, data):
    return spark.createDataFrame(data, "item bigint, desk string, at date, entity bigint")


def test_convergence_edges_by_hand(spark):
    old = DAY - dt.timedelta(days=30)
    data = [(1, "ai", DAY, 1), (1, "ai", DAY, 2), (2, "energy", old, 2), (2, "energy", old, 1), (2, "energy", old, 1),
            (3, "ai", DAY, 1), (3, "ai", DAY, 3), (4, "ai", DAY, 3), (4, "ai", DAY, 4), (5, "ai", old, 3), (5, "ai", old, 4)]
    out = {(r["from_id"], r["to_id"]): r for r in graph.convergence_edges(members(spark, data), "2026-07-01", dims.DESKS).collect()}
    assert set(out) == {(1, 2), (3, 4)}
    assert out[1, 2]["weight"] == 3.0 and out[1, 2]["co_count"] == 2 and out[1, 2]["cross_desk"]
    assert out[1, 2]["confidence"] == 0.875 and out[1, 2]["desks"] == ["ai", "energy"] and out[1, 2]["last_seen"] == DAY
    assert out[3, 4]["weight"] == 1.5 and not out[3, 4]["cross_desk"]  # 1 + 0.5, no boost


def test_pairs_of_large_and_small_items_are_whole(spark):
    """One item with a third of all rows and many entities takes the block path."""
    data = [(0, "ai", DAY, e) for e in range(300)] + [(i, "ai", DAY, (i * 7 + k) % 50) for i in range(1, 120) for k in range(5)]
    want = set()
    for item, group in itertools.groupby(sorted(data), key=lambda r: r[0]):
        for a, b in itertools.combinations(sorted({r[3] for r in group}), 2):
            want.add((item, a, b))
    got = rows(graph.co_pairs(members(spark, data + data[:50])), "item", "a", "b")
    assert len(got) == len(want) and set(got) == want


def test_entity_bound_drops_no_edge(spark):
    rng = random.Random(3)
    data = [(i, rng.choice(dims.DESKS), DAY - dt.timedelta(days=rng.randint(0, 90)), rng.randint(0, 25)) for i in range(150) for _ in range(3)]
    first = {}
    data = [(i, *first.setdefault(i, (d, at)), e) for i, d, at, e in data]
    m = members(spark, data)
    weight = graph.recency_weight(F.date_diff(F.lit(DAY), F.col("at")), 30.0)
    brute = (
        graph.co_pairs(m).groupBy("a", "b")
        .agg(F.sum(weight).alias("w"), (F.count_distinct("desk") > 1).alias("x"))
        .withColumn("w", F.col("w") * F.when(F.col("x"), 2.0).otherwise(1.0)).filter("w >= 1.5")
    )
    got = graph.convergence_edges(m, "2026-07-01", dims.DESKS)
    assert rows(got, "from_id", "to_id") == rows(brute, "a", "b")


def test_unknown_desk_is_an_error_and_not_a_wrong_mask(spark):
    m = members(spark, [(1, "sports", DAY, 1), (1, "sports", DAY, 2), (2, "sports", DAY, 1), (2, "sports", DAY, 2)])
    with pytest.raises(Exception, match="desk not in the desk list"):
        graph.convergence_edges(m, "2026-07-01", dims.DESKS).collect()


def test_scd2_keeps_start_and_retires(spark):
    cols = "from_id string, to_id string, edge_type string, weight double"
    live = spark.createDataFrame([("a", "b", "C", 1.0, "2026-01-01"), ("a", "c", "C", 2.0, "2026-01-02")], cols + ", valid_from string")
    want = spark.createDataFrame([("a", "b", "C", 5.0), ("b", "c", "C", 3.0)], cols)
    out = {(r["from_id"], r["to_id"]): r for r in graph.scd2_edges(live, want, F.lit("2026-07-01")).collect()}
    assert out["a", "b"][3:] == (5.0, "2026-01-01", None, "refreshed")
    assert out["a", "c"][3:] == (2.0, "2026-01-02", "2026-07-01", "retired")
    assert out["b", "c"][3:] == (3.0, "2026-07-01", None, "inserted")


def test_funding_edges(spark):
    awards = spark.createDataFrame(
        [(" u1 ", " NASA ", "10.5", "2026-01-01"), ("U1", "NASA", "bad", "2026-03-01"), ("u9", "NASA", "5", None), ("u1", " ", "5", None)],
        "recipient_uei string, awarding_agency string, amount_usd string, start_date string",
    )
    known = spark.createDataFrame([("u1", "e1")], "uei string, entity string")
    assert rows(funding.funding_edges(awards, known)) == [("NASA", "e1", 10.5, 2, "2026-03-01")]


# --- resolution --------------------------------------------------------------------------

def test_similar_names_against_brute_force(spark):
    rng = random.Random(5)
    parts = ["ACME", "ENERGY", "FUELS", "POWER", "SYSTEMS", "NORTH", "GRID", "ATOM"]
    left = sorted({" ".join(rng.sample(parts, rng.randint(1, 3))) for _ in range(40)})
    right = sorted({" ".join(rng.sample(parts, rng.randint(1, 3))) for _ in range(40)})

    def grams(s):
        return {f"  {w} "[i : i + 3] for w in s.lower().split() for i in range(len(w) + 1)}

    want = {}
    for a, b in itertools.product(left, right):
        ga, gb = grams(a), grams(b)
        sim = len(ga & gb) / len(ga | gb)
        if sim >= 0.3:
            want[a, b] = round(sim, 9)
    l, r = (spark.createDataFrame([(x,) for x in side], "name string") for side in (left, right))
    got = {(x["name"], x["alias"]): round(x["sim"], 9) for x in resolution.similar_names(l, r).collect()}
    assert got == want


def test_similar_names_survive_a_hot_trigram(spark, monkeypatch):
    monkeypatch.setattr(resolution, "HOT_GRAM", 3)
    names = [(f"CO {i:03d}",) for i in range(40)]
    df = spark.createDataFrame(names, "name string")
    got = resolution.similar_names(df, df)
    assert got.filter("name = alias").count() == 40
    assert got.count() == got.distinct().count()


def test_decide_bands(spark):
    data = [("a", 1, 0.99, 1), ("a", 2, 0.96, 2), ("b", 1, 0.95, 1), ("b", 2, 0.5, 2), ("c", 1, 0.8, 1), ("d", 1, 0.6, 1), ("e", 1, 0.4, 1)]
    ranked = spark.createDataFrame(data, "name string, entity bigint, sim double, rank int")
    got = {r["name"]: (r["status"], r["entity"]) for r in resolution.decide(ranked).collect()}
    assert got == {"a": ("llm_disambiguate", None), "b": ("auto_link", 1), "c": ("llm_disambiguate", None),
                   "d": ("llm_expand_context", None), "e": ("auto_dismiss", None)}


def test_resolve_identifier_then_name_then_mint(spark):
    ids = "array<struct<id_type:string,id_value:string>>"
    mentions = spark.createDataFrame(
        [(1, "Whatever", [("ticker", "X"), ("cik", "0000000007")]), (2, "Energy Fuels Inc.", []), (3, "Unknown Ltd", [("uei", "U5")]),
         (4, "Unknown Two", [("uei", "U5")]), (5, "Nothing At All", []), (6, "Old One", [("ticker", "OLD")])],
        f"mention_id bigint, mention string, ids {ids}",
    )
    known = spark.createDataFrame(
        [("cik", "0000000007", "e7", None), ("ticker", "OLD", "e9", DAY)], "id_type string, id_value string, entity string, valid_to date"
    )
    aliases = spark.createDataFrame([("ENERGY FUELS", "e1"), ("URANIUM ENERGY", "e2")], "name string, entity string")
    out = {r["mention_id"]: r for r in resolution.resolve(mentions, known, aliases).collect()}
    assert (out[1]["entity"], out[1]["resolved_by"], out[1]["confidence"]) == ("e7", "identifier:cik", 1.0)
    assert (out[2]["entity"], out[2]["status"]) == ("e1", "auto_link")
    assert out[3]["entity"] == out[4]["entity"] is not None and out[3]["resolved_by"] == "minted"
    assert out[5]["entity"] is None and out[6]["entity"] is None and len(out) == 6


def test_link_metrics_with_nothing_linked(spark):
    got = resolution.link_metrics(spark.createDataFrame([("a", None)], "expected string, predicted string")).first()
    assert (got["precision"], got["recall"], got["false_link_rate"]) == (1.0, 0.0, 0.0)


# --- gazetteer -----------------------------------------------------------------------------

def test_gazetteer_precision_rules(spark):
    aliases = spark.createDataFrame(
        [("LOCKHEED MARTIN", 1), ("BLOCK", 2), ("OPEN TEXT", 3), ("TWIN NAME", 4), ("TWIN NAME", 5), ("A&B POWER", 6), ("LOCKHEED MARTIN", 1)],
        "alias string, entity bigint",
    )
    index = gazetteer.alias_index(aliases)
    assert rows(index) == [("A B POWER", 6), ("LOCKHEED MARTIN", 1)]
    docs = spark.createDataFrame([(1, "A&B Power buys; Lockheed-Martin, lockheed martin"), (2, "Lockheed Martinez"), (3, "")], "doc_id bigint, text string")
    links = gazetteer.link_mentions(docs, index)
    assert rows(links, "doc_id", "entity", "pos") == [(1, 1, 4), (1, 6, 0)]
    assert gazetteer.ordered_ids(links, "doc_id", ["pos", "n"]).first()["entity_ids"] == [6, 1]
    items = docs.select("doc_id", F.array(F.lit(6).cast("bigint")).alias("entity_ids"))
    assert rows(gazetteer.backfill(items, links, "doc_id"), "doc_id", "entity_ids", "additions") == [(1, [6, 1], [1])]


# --- ranking --------------------------------------------------------------------------------

def test_select_floors(spark):
    data = [("ai", i, "federal_award", "usaspending", 1.0 - i / 100) for i in range(60)]
    data += [("ai", 100 + i, "research_paper", "arxiv", 0.1 - i / 1000) for i in range(5)]
    data += [("ai", 200 + i, "news", "feeds", 0.2 - i / 1000) for i in range(6)]
    df = spark.createDataFrame(data, "desk string, record_id bigint, record_type string, source_id string, score double")
    got = {r[0] for r in ranking.select_facts(df, limit=50).select("record_id").collect()}
    assert len(got) == 50
    assert {i for i in got if 100 <= i < 200} == {100, 101, 102}
    assert {i for i in got if i >= 200} == {200, 201, 202, 203}
    assert {i for i in got if i < 100} == set(range(43))
    small = {r[0] for r in ranking.select_facts(df, limit=2).select("record_id").collect()}
    assert small == {100, 101}  # research fills the slots first
    none = {r[0] for r in ranking.select_facts(df, limit=10, research_floor=0, news_floor=0).select("record_id").collect()}
    assert none == set(range(10))


def test_outlet_diversity_only_touches_feeds(spark):
    data = [("ai", i, "feeds", "blog", 0.9 - i / 100) for i in range(6)] + [("ai", 50 + i, "edgar", "blog", 0.5) for i in range(6)]
    df = spark.createDataFrame(data, "desk string, record_id bigint, source_id string, outlet string, score double")
    got = {r["record_id"]: r["score"] for r in ranking.outlet_diversity(df).collect()}
    assert [got[i] for i in range(3)] == [0.9, 0.89, 0.88] and got[3] == pytest.approx(0.435) and got[50] == 0.5


def test_significance_never_empties_a_desk(spark):
    facts = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, 1)], "desk string, record_id bigint, selection_rank int")
    v = spark.createDataFrame([("a", 1, 0.2), ("a", 2, 0.3)], "desk string, record_id bigint, significance double")
    assert rows(ranking.apply_significance(facts, v), "desk", "record_id") == [("a", 2), ("b", 3)]


def test_title_dedupe_keeps_best_and_all_untitled(spark):
    data = [("a", 1, 0.5, "Same | x"), ("a", 2, 0.9, "same!"), ("a", 3, 0.1, "||"), ("a", 4, 0.1, ""), ("b", 5, 0.1, "Same")]
    df = spark.createDataFrame(data, "desk string, record_id bigint, score double, text string")
    assert rows(ranking.title_dedupe(df), "record_id") == [(2,), (3,), (4,), (5,)]


def test_award_chunks_with_one_description_collapse(spark, value):
    """Awards of different recipients share a headline up to the first bar: kept as it is."""
    from recordweave.functions.text import award_chunk, title_key

    lit = lambda s: F.lit(s)
    chunk = lambda who: award_chunk(lit("Radar"), lit(who), lit(2.5), lit("DoD"), lit("Navy"), lit("2026-01-01"), lit("2026-02-01"))
    assert value(chunk("A")) == "Federal award: Radar | Recipient: A | Amount: $2 | Agency: DoD / Navy | Period: 2026-01-01 to 2026-02-01"
    assert value(title_key(chunk("A"))) == value(title_key(chunk("B"))) == "federal award radar"


def test_vector_topk_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(50, 8)).astype("float32")
    df = spark.createDataFrame([(i, "ai", [float(x) for x in v]) for i, v in enumerate(vectors)], "record_id bigint, desk string, embedding array<float>")
    query = retrieval.seed_vector(df.filter("record_id < 5"))
    got = [r["record_id"] for r in retrieval.vector_topk(df, query, 7).orderBy("rank").collect()]
    q = vectors[:5].astype("float64").mean(axis=0)
    dist = 1 - vectors @ q / (np.linalg.norm(vectors, axis=1) * np.linalg.norm(q))
    assert got == list(np.argsort(dist)[:7])


# --- verdicts --------------------------------------------------------------------------------

def test_claims_without_verdict_fail(spark):
    items = spark.createDataFrame([(1, 10, "A [CITE:1]. B. C [CITE:2]."), (1, 11, "No cite."), (2, 12, "")], "brief_id bigint, item_id bigint, body string")
    v = spark.createDataFrame([(10, 0, True), (10, 1, True)], "item_id bigint, claim int, supported boolean")
    results = verdicts.item_results(verdicts.judge(verdicts.claims(items), v))
    got = {r["item_id"]: r for r in results.collect()}
    assert got[10]["cleaned_body"] == "A [CITE:1]." and got[10]["claims_passing"] == 1 and got[10]["claims_total"] == 3
    assert got[11]["excluded"] and 12 not in got
    briefs = {r["brief_id"]: r for r in verdicts.brief_results(items, results).collect()}
    assert briefs[1]["surviving_items"] == 1 and briefs[1]["faithfulness"] == pytest.approx(1 / 3) and briefs[1]["eval_passed"]
    assert briefs[2]["faithfulness"] == 0.0 and not briefs[2]["eval_passed"]


def test_best_attempt(spark):
    data = [(1, 1, False, 0, 9), (1, 2, True, 2, 1), (1, 3, True, 9, 9), (2, 1, False, 1, 2), (2, 2, False, 1, 3), (2, 3, False, 1, 3)]
    df = spark.createDataFrame(data, "brief_id bigint, attempt int, eval_passed boolean, surviving_items int, provable_claims int")
    assert rows(verdicts.best_attempt(df), "brief_id", "attempt") == [(1, 2), (2, 2)]


def test_dominant_source_tie_goes_to_first_passage(spark):
    df = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (2, "a", 3), (2, "b", 1), (2, "a", 5)], "item_id bigint, source_id string, index int")
    assert rows(verdicts.dominant_source(df)) == [(1, "b"), (2, "a")]


# --- ingest ----------------------------------------------------------------------------------

def test_merge_by_native_id(spark):
    data = [("e", "n1", ["defense", "ai", "energy"], 1, "first"), ("e", "n1", ["energy", "ai"], 2, "second"), ("e", "n1", [], 3, "none"),
            ("e", "n2", ["ai", "energy"], 4, "x"), ("e", "n2", ["energy", "ai"], 5, "y")]
    df = spark.createDataFrame(data, "source_id string, native_id string, desks array<string>, arrival int, payload string")
    got = {r["native_id"]: r for r in ingest.merge_by_native_id(df).collect()}
    assert got["n1"]["desks"] == ["energy", "ai", "defense"] and got["n1"]["payload"] == "first"
    assert got["n2"]["desks"] == ["energy", "ai"]  # tie: energy before ai


def test_enrich_cap_keeps_the_rest_as_metadata(spark):
    recs = spark.createDataFrame(
        [(i, "8-K", f"u{i}", None, None, "Co", None, "meta", None) for i in range(4)],
        "record_id int, form string, url string, cik string, accession string, company string, ticker string, text string, amount_usd double",
    )
    bodies = spark.createDataFrame([(f"u{i}", f"pays ${i}M", None, None, None) for i in range(1, 4)], "url string, body string, cik string, accession string, xml string")
    got = {r["record_id"]: (r["enriched"], r["amount_usd"]) for r in ingest.enrich(recs, bodies, cap=2).collect()}
    assert got == {0: (False, None), 1: (True, 1e6), 2: (True, 2e6), 3: (False, None)}


# --- telemetry -------------------------------------------------------------------------------

def test_momentum_short_series_makes_no_claim(spark):
    base = dt.date(2026, 1, 1)
    data = [("short", base + dt.timedelta(days=i), 5) for i in range(7)]
    data += [("up", base + dt.timedelta(days=i), 10 if i < 21 else 20) for i in range(28)]
    data += [("down", base + dt.timedelta(days=i), 10 if i < 3 else 5) for i in range(10)]
    got = {r["theme"]: r for r in telemetry.momentum(spark.createDataFrame(data, "theme string, day date, volume int")).collect()}
    assert got["short"]["delta_pct"] is None and got["short"]["direction"] is None
    assert got["up"]["delta_pct"] == 100.0 and got["up"]["direction"] == "up"
    assert got["down"]["delta_pct"] == -50.0 and got["down"]["direction"] == "down"


def test_breaker_counts_from_last_success(spark):
    at = lambda m: dt.datetime(2026, 1, 1, 0, m)
    data = [("a", at(1), 1, True), ("a", at(2), 2, False), ("a", at(3), 3, True), ("a", at(4), 4, True), ("a", at(5), 5, True),
            ("b", at(1), 6, True), ("b", at(2), 7, True), ("c", at(3), 8, True), ("c", at(3), 9, False)]
    df = spark.createDataFrame(data, "source_id string, at timestamp, seq int, failed boolean")
    now = F.lit(dt.datetime(2026, 1, 1, 0, 20))
    got = {r["source_id"]: r for r in telemetry.breaker_state(df, now).collect()}
    assert got["a"]["failures"] == 3 and got["a"]["state"] == "open" and got["a"]["opened_at"] == at(5) and got["a"]["blocked"]
    assert got["b"]["state"] == "closed" and got["b"]["failures"] == 2 and got["c"]["failures"] == 0


def test_all_health_codes_can_fire(spark):
    briefs = spark.createDataFrame(
        [(1, "thin", "published", 0.5, "h", "fine"), (2, "leak", "published", 1.0, "h", '{"text": 1'), (3, "gone", "failed", None, "h", ""),
         (4, "skip", "failed", None, "", ""), (5, "wait", "pending", None, "h", "")],
        "brief_id int, desk string, status string, faithfulness_score double, headline string, convergence_read string",
    ).withColumn("total_tokens", F.lit(100))
    items = spark.createDataFrame([(1, "analysis", "b", "", "")] + [(2, "confirmed", "b", "", "")] * 4, "brief_id int, attribution string, body string, read string, watch string")
    expected = spark.createDataFrame([(d,) for d in ("thin", "leak", "gone", "skip", "wait", "none")], "desk string")
    runs = spark.createDataFrame([("s1", "failed", " boom ")], "source_id string, status string, error_message string")
    sources = spark.createDataFrame([("s1", True, "open", dt.datetime(2026, 1, 1)), ("s2", False, "open", dt.datetime(2026, 1, 1))],
                                    "source_id string, is_active boolean, breaker_state string, last_fetch timestamp")
    out = telemetry.health_findings(expected, telemetry.brief_health_inputs(briefs, items), runs, sources, F.lit(dt.datetime(2026, 2, 1)), 100)
    got = {(r["code"], r["subject"]) for r in out.collect()}
    assert got == {("brief_missing", "none"), ("brief_thin", "thin"), ("brief_low_faithfulness", "thin"), ("confidence_collapsed", "thin"),
                   ("content_leak", "leak"), ("brief_items_collapsed", "gone"), ("brief_skipped", "skip"), ("brief_pending", "wait"),
                   ("source_failed", "s1"), ("circuit_open", "s1"), ("source_stale", "s1"), ("cost_anomaly", "all")}
    assert telemetry.health_verdict(out).first()["verdict"] == "degraded"
    empty = telemetry.health_findings(expected, telemetry.brief_health_inputs(briefs.filter("false"), items), runs, sources, F.lit(dt.datetime(2026, 2, 1)))
    assert telemetry.health_verdict(empty).first()["verdict"] == "critical"


def test_or_queries(spark):
    df = spark.createDataFrame([("ai", f"p{i}", i) for i in range(10)], "desk string, phrase string, position int")
    got = {r["grp"]: r["query"] for r in telemetry.or_queries(df).collect()}
    assert got[0].startswith('("p0" OR "p1"') and got[0].endswith('"p7")') and got[1] == '("p8" OR "p9")'


def test_subscription_state(spark):
    data = [(1, 1, "subscription_created", "on_trial", "p1", "url"), (1, 2, "subscription_updated", "active", "p2", None),
            (2, 1, "subscription_updated", "active", "p", "u"), (2, 2, "subscription_expired", "active", None, None)]
    df = spark.createDataFrame(data, "user_id int, seq int, event_name string, status string, period_end string, portal_url string")
    assert rows(reading.subscription_state(df)) == [(1, "active", "p2", "url", "pro"), (2, "cancelled", None, "u", "free")]


def test_graph_tasks_take_no_more_on_larger_tables(spark, monkeypatch):
    """Members are dealt by their number, not by compressed bytes, and no step of the floor keeps rows sorted to sum them."""
    monkeypatch.setattr(common, "TASK_ROWS", 20)
    monkeypatch.setattr(common, "FEW_TASKS", 2)
    rows = [(i % 40, "AB"[i % 2], dt.date(2001, 5, 1), i * 7 % 11) for i in range(400)] + [(None, "A", dt.date(2001, 5, 1), 1)]
    members = spark.createDataFrame(rows, "item int, desk string, at date, entity int")
    once = members.distinct().count()
    pairs = graph.co_pairs(members)
    assert pairs.rdd.getNumPartitions() >= once // 20
    want = {(i, d, min(a, b), max(a, b)) for i, d, _, a in rows for j, e, _, b in rows if i == j and i is not None and d == e and a != b}
    assert {(r.item, r.desk, r.a, r.b) for r in pairs.filter("item IS NOT NULL").collect()} == want
    bound = graph._could_reach_floor(members, F.lit(1.0), 1.5, 2.0)
    assert "SortAggregate" not in bound._jdf.queryExecution().executedPlan().toString()
    assert bound.count() == len(rows)


def test_resolve_works_mentions_out_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        read.add(1)
        return x

    ids = "array<struct<id_type:string,id_value:string>>"
    mentions = spark.createDataFrame([("m1", "Acme Corp", [("uei", "U1")]), ("m2", "Other Works", []), ("m3", "Acme", [("uei", "U9")])],
                                     f"mention_id string, mention string, ids {ids}").withColumn("mention_id", counted("mention_id"))
    known = spark.createDataFrame([("uei", "U1", 7, None)], "id_type string, id_value string, entity int, valid_to date")
    aliases = spark.createDataFrame([("OTHER WORKS", 8)], "name string, entity int")
    out = resolution.resolve(mentions, known, aliases).collect()
    assert read.value == 3
    assert {r.mention_id: r.resolved_by for r in out} == {"m1": "identifier:uei", "m2": "auto_high_confidence", "m3": "minted"}


def test_awards_are_dealt_by_their_number(spark, monkeypatch):
    from types import SimpleNamespace

    from recordweave.plans import graph as plans

    t = SimpleNamespace(
        lineitem=spark.range(400).selectExpr(
            "id div 4 AS l_orderkey", "id % 7 AS l_suppkey", "cast(id AS double) AS l_extendedprice", "DATE'1998-01-01' + cast(id % 9 AS int) AS l_shipdate", "id % 4 AS l_linenumber"
        ),
        orders=spark.range(100).selectExpr("id AS o_orderkey", "id % 10 AS o_custkey"),
        customer=spark.range(10).selectExpr("id AS c_custkey", "id % 3 AS c_nationkey"),
        nation=spark.range(3).selectExpr("id AS n_nationkey", "concat('N', id) AS n_name"),
    )
    whole = rows(plans.awards(t))
    monkeypatch.setattr(common, "TASK_ROWS", 20)
    dealt = plans.awards(t)
    assert dealt._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 2
    assert len(whole) == 400 and rows(dealt) == whole


def _plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_members_are_not_sorted_to_reach_the_floor(spark):
    """They stream past the entities: a partition that holds millions of rows takes no more memory."""
    rows = [(i, "AB"[i % 2], dt.date(2001, 5, 1), e) for i in range(60) for e in (i % 3, 50 + i, None)]
    members = spark.createDataFrame(rows, "item bigint, desk string, at date, entity bigint")
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    try:
        spark.conf.set(threshold, "-1")
        kept = graph._could_reach_floor(members, F.lit(1.0), 1.5, 1.0)
        assert "SortMergeJoin" not in _plan_of(kept)
        assert sorted((r["item"], r["entity"]) for r in kept.collect()) == [(i, i % 3) for i in range(60)]
    finally:
        spark.conf.set(threshold, before)


def test_pair_sums_are_cut_by_the_number_of_pairs(spark, monkeypatch):
    """However few partitions the session asks for."""
    tasks = []

    def noted(df, name, least=0):
        tasks.append((name, least))
        return stage(df, name, least)

    monkeypatch.setattr(common, "TASK_ROWS", 20)
    monkeypatch.setattr(graph, "stage", noted)
    rows = [(i, "AB"[i % 2], dt.date(2001, 5, 1), e) for i in range(40) for e in {i % 7, (i + 3) % 7, (i * i + 1) % 7, 70 + i % 5}]
    members = spark.createDataFrame(rows, "item bigint, desk string, at date, entity bigint")
    pairs = {(i, a, b) for i, _, _, a in rows for j, _, _, b in rows if i == j and a < b}
    least = -(-len(pairs) // 20)
    edges = graph.convergence_edges(members, "2001-05-01", ["A", "B"], half_life=0, floor=0.5)
    state = graph.pair_state(members, "2001-01-01", ["A", "B"])
    assert least > 8 and [t for t in tasks if t[1]] == [("edges", least), ("pair-state", least)]
    counts = Counter((a, b) for _, a, b in pairs)
    for df, a, b in ((edges, "from_id", "to_id"), (state, "a", "b")):
        assert {(r[a], r[b]): r["co_count"] for r in df.collect()} == counts
    assert graph.pair_state(members.limit(0), "2001-01-01", ["A", "B"]).count() == 0
