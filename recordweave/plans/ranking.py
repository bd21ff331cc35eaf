"""Scoring, de-dup, selection, wire and retrieval queries.

An order is a record: its priority stands for the source, the customer's market
segment for the entity type and the customer for the primary mention.
"""

from pyspark.sql import functions as F

from recordweave import dims
from recordweave.functions import scoring
from recordweave.operators import ranking, retrieval, vector_index
from recordweave.operators.common import positions, top_n
from recordweave.plans import sqltext as sq
from recordweave.plans.registry import query
from recordweave.session import stage

SOURCE = {
    "1-URGENT": "usaspending", "2-HIGH": "edgar", "3-MEDIUM": "feeds", "4-NOT SPECIFIED": "arxiv", "5-LOW": "gdelt",
}
RECORD_TYPE = {
    "1-URGENT": "federal_award", "2-HIGH": "filing", "3-MEDIUM": "news", "4-NOT SPECIFIED": "research_paper", "5-LOW": "news",
}
ENTITY_TYPE = {"AUTOMOBILE": "company", "BUILDING": "facility", "FURNITURE": "product", "HOUSEHOLD": "person"}
AS_OF = "2001-08-01"


def lookup(mapping, column, default="unknown"):
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(m, F.col(column)), F.lit(default))


def records(t):
    k = F.col("o_orderkey")
    desks = F.array(*[F.lit(d) for d in dims.DESKS])
    two = F.slice(F.concat(desks, desks), (k % 3 + 1).cast("int"), F.when(k % 4 == 0, 2).otherwise(1))
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        k.alias("record_id"), lookup(SOURCE, "o_orderpriority").alias("source_id"),
        lookup(RECORD_TYPE, "o_orderpriority").alias("record_type"), two.alias("desks"),
        F.when(k % 11 != 0, F.when(k % 13 == 0, 0.0).otherwise(F.col("o_totalprice"))).alias("amount_usd"),
        lookup(ENTITY_TYPE, "c_mktsegment").alias("entity_type"),
        F.when(k % 5 == 0, F.array("c_name", F.lit("Customer#000000001"))).otherwise(F.array("c_name")).alias("names"),
        F.concat(F.lit("outlet"), (F.col("o_custkey") % 20).cast("string")).alias("outlet"),
        F.concat(F.lit("n"), F.col("o_custkey").cast("string")).alias("native_id"),
        F.concat(F.lit("Order for "), "c_name", F.lit(" | no. "), k.cast("string")).alias("text"),
        F.col("o_orderdate").cast("date").alias("created"), F.col("o_orderstatus").alias("status"),
    )


RECORDS = f"""records AS (SELECT o_orderkey AS record_id,
  {sq.case('o_orderpriority', SOURCE, "'unknown'")} AS source_id, {sq.case('o_orderpriority', RECORD_TYPE, "'unknown'")} AS record_type,
  list_slice(['defense','ai','energy','defense','ai','energy'], o_orderkey % 3 + 1, o_orderkey % 3 + CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END) AS desks,
  CASE WHEN o_orderkey % 11 <> 0 THEN CASE WHEN o_orderkey % 13 = 0 THEN 0.0 ELSE o_totalprice END END AS amount_usd,
  {sq.case('c_mktsegment', ENTITY_TYPE, "'unknown'")} AS entity_type,
  CASE WHEN o_orderkey % 5 = 0 THEN [c_name, 'Customer#000000001'] ELSE [c_name] END AS names, 'outlet' || (o_custkey % 20) AS outlet,
  'n' || o_custkey AS native_id, 'Order for ' || c_name || ' | no. ' || o_orderkey AS text, CAST(o_orderdate AS DATE) AS created,
  o_orderstatus AS status FROM orders JOIN customer ON o_custkey = c_custkey),
tagged AS (SELECT *, unnest(desks) AS desk FROM records),
mention AS (SELECT DISTINCT desk, record_id, unnest(names) AS name FROM tagged),
per_name AS (SELECT desk, name, count(*) AS n FROM mention GROUP BY ALL),
corr AS (SELECT t.desk, record_id, greatest(coalesce(n, 0) - 1, 0) AS corroboration FROM tagged t
  LEFT JOIN per_name p ON p.desk = t.desk AND p.name = t.names[1])"""
_AUTHORITY = sq.case("source_id", dims.SOURCE_WEIGHTS, "0.6")
_IMPORTANCE = sq.case("entity_type", dims.ENTITY_IMPORTANCE, "0.5")
_BUCKET = "CAST(CASE WHEN amount_usd = 0 THEN 0.0 " + " ".join(
    f"WHEN amount_usd < {b} THEN {v}" for b, v in dims.MAGNITUDE_BUCKETS) + " ELSE 1.0 END AS DOUBLE)"
SCORED = f"""{RECORDS},
win AS (SELECT desk, min(nullif(amount_usd, 0)) AS low, max(nullif(amount_usd, 0)) AS high, count(nullif(amount_usd, 0)) AS points
  FROM tagged GROUP BY desk),
mag AS (SELECT t.*, corroboration, CASE WHEN amount_usd IS NULL THEN 0.0 WHEN points >= 10 THEN
    CASE WHEN low = high THEN 0.0 ELSE (amount_usd - low) / (high - low) END ELSE {_BUCKET} END AS magnitude
  FROM tagged t JOIN win USING (desk) JOIN corr c ON c.desk = t.desk AND c.record_id = t.record_id),
scored AS (SELECT *, round(least(CAST({_AUTHORITY} AS DOUBLE) * 0.3::DOUBLE + 0.2::DOUBLE + magnitude::DOUBLE * 0.25::DOUBLE
    + CAST({_IMPORTANCE} AS DOUBLE) * 0.15::DOUBLE + least(corroboration, 3) / 3::DOUBLE * 0.1::DOUBLE
    + least(greatest(len(desks) - 1, 0), 2) * 0.02::DOUBLE, 1.0::DOUBLE), 6) AS score FROM mag),
material AS (SELECT * FROM scored WHERE score >= 0.35 AND desks[1] = desk)"""


def tagged(t):
    return ranking.per_desk(records(t))


def scored(t):
    rows = tagged(t)
    out = ranking.score(rows, ranking.amount_window(rows), ranking.mention_counts(rows))
    return out.withColumn("score", F.round("score", 6))


def material(t):
    return ranking.material(scored(t))


@query("candidates_join", """SELECT l_orderkey, l_linenumber, l_partkey, o_orderstatus, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_orderdate >= TIMESTAMP '2001-05-01'""")
def candidates_join(t):
    recent = t.orders.filter(F.col("o_orderdate") >= F.lit("2001-05-01").cast("timestamp_ntz"))
    return t.lineitem.join(recent, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "o_orderstatus", "l_extendedprice"
    )


@query("corroboration", f"WITH {RECORDS} SELECT * FROM corr")
def corroboration(t):
    return ranking.corroboration(tagged(t)).select("desk", "record_id", "corroboration")


@query("magnitude", f"WITH {SCORED} SELECT desk, record_id, round(magnitude, 6) AS magnitude, {_BUCKET.replace('CASE WHEN', 'CASE WHEN amount_usd IS NULL THEN 0.0 WHEN', 1)} AS bucket FROM mag")
def magnitude(t):
    return scored(t).select(
        "desk", "record_id", F.round("magnitude", 6).alias("magnitude"),
        scoring.magnitude_bucket(F.col("amount_usd")).alias("bucket"),
    )


@query("materiality", f"WITH {SCORED} SELECT desk, record_id, source_id, score FROM material")
def materiality(t):
    return material(t).select("desk", "record_id", "source_id", "score")


@query("home_desk", f"WITH {RECORDS} SELECT desk, record_id FROM tagged WHERE desks[1] = desk")
def home_desk(t):
    return tagged(t).filter(ranking.is_home_desk(F.col("desks"), F.col("desk"))).select("desk", "record_id")


@query("window_start", """SELECT CAST(arg_max(o_orderdate - INTERVAL 1 DAY, (o_orderdate, o_orderdate)) AS VARCHAR) AS window_start
FROM orders WHERE o_orderstatus = 'F'""")
def window_start(t):
    status = F.when(F.col("o_orderstatus") == "F", "published").otherwise("failed")
    briefs = t.orders.select(
        status.alias("status"), F.col("o_orderdate").alias("published_at"),
        (F.col("o_orderdate") - F.expr("INTERVAL 1 DAY")).alias("generation_started_at"),
    )
    out = ranking.window_start(briefs, F.lit(AS_OF).cast("timestamp_ntz"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"))


_BRIEF_CUT = "2001-05-01"


@query("candidates_windowed", f"""WITH {RECORDS},
since AS (SELECT coalesce(arg_max(created - 1, (created, created)), DATE '{AS_OF}' - 2) AS s FROM records WHERE status = 'F' AND created < DATE '{_BRIEF_CUT}'),
recent AS (SELECT t.* FROM tagged t, since WHERE created >= s AND status <> 'P'),
ment AS (SELECT DISTINCT desk, record_id, unnest(names) AS name FROM recent), cnt AS (SELECT desk, name, count(*) AS n FROM ment GROUP BY ALL),
bounds AS (SELECT desk, min(nullif(amount_usd, 0)) AS low, max(nullif(amount_usd, 0)) AS high, count(nullif(amount_usd, 0)) AS points
  FROM tagged WHERE created >= DATE '{AS_OF}' - 90 GROUP BY desk),
m AS (SELECT r.*, greatest(coalesce(n, 0) - 1, 0) AS corroboration, CASE WHEN amount_usd IS NULL THEN 0.0 WHEN coalesce(points, 0) >= 10 THEN
    CASE WHEN low = high THEN 0.0 ELSE (amount_usd - low) / (high - low) END ELSE {_BUCKET} END AS magnitude
  FROM recent r LEFT JOIN bounds USING (desk) LEFT JOIN cnt c ON c.desk = r.desk AND c.name = r.names[1]),
s AS (SELECT *, round(least(CAST({_AUTHORITY} AS DOUBLE) * 0.3::DOUBLE + 0.2::DOUBLE + magnitude::DOUBLE * 0.25::DOUBLE
    + CAST({_IMPORTANCE} AS DOUBLE) * 0.15::DOUBLE + least(corroboration, 3) / 3::DOUBLE * 0.1::DOUBLE
    + least(greatest(len(desks) - 1, 0), 2) * 0.02::DOUBLE, 1.0::DOUBLE), 6) AS score FROM m)
SELECT desk, record_id, round(magnitude, 6) AS magnitude, corroboration, score FROM s WHERE score >= 0.35 AND desks[1] = desk""")
def candidates_windowed(t):
    """Window start, raw join and 90-day bounds in one flow; pending orders have lost their raw row."""
    rows = records(t).withColumn("created_at", F.col("created").cast("timestamp_ntz")).withColumn("raw_id", F.col("record_id"))
    raw = t.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("raw_id"), F.col("o_orderpriority").alias("url"))
    briefs = rows.filter((F.col("created") < F.lit(_BRIEF_CUT).cast("date"))).select(
        F.when(F.col("status") == "F", "published").otherwise("failed").alias("status"), F.col("created_at").alias("published_at"),
        (F.col("created_at") - F.expr("INTERVAL 1 DAY")).alias("generation_started_at"),
    )
    out = ranking.rank_candidates(rows, raw, briefs, F.lit(AS_OF).cast("timestamp_ntz"))
    return out.select("desk", "record_id", F.round("magnitude", 6).alias("magnitude"), "corroboration", F.round("score", 6).alias("score"))


@query("magnitude_sliding", f"""WITH {RECORDS}, cell AS (SELECT desk, created AS day, min(nullif(amount_usd, 0)) AS lo, max(nullif(amount_usd, 0)) AS hi,
  count(nullif(amount_usd, 0)) AS n FROM tagged GROUP BY ALL),
win AS (SELECT desk, day, min(lo) OVER w AS low, max(hi) OVER w AS high, sum(n) OVER w AS points FROM cell
  WINDOW w AS (PARTITION BY desk ORDER BY day RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW))
SELECT t.desk, record_id, CAST(points AS BIGINT) AS points, round(CASE WHEN amount_usd IS NULL THEN 0.0 WHEN points >= 10 THEN
    CASE WHEN low = high THEN 0.0 ELSE (amount_usd - low) / (high - low) END ELSE {_BUCKET} END, 6) AS magnitude
FROM tagged t JOIN win w ON w.desk = t.desk AND w.day = t.created""")
def magnitude_sliding(t):
    """Every record against the 90 days up to its own day, as runs of that day saw it."""
    rows = tagged(t)
    bounds = ranking.sliding_amounts(rows, "created").withColumnRenamed("day", "created")
    size = scoring.magnitude(F.col("amount_usd"), F.col("low"), F.col("high"), F.col("points"))
    return rows.join(bounds, ["desk", "created"]).select("desk", "record_id", "points", F.round(size, 6).alias("magnitude"))


def deduped(t):
    return ranking.title_dedupe(material(t))


_DEDUPED = f"""{SCORED}, deduped AS (SELECT * FROM material QUALIFY row_number() OVER (
  PARTITION BY desk, {sq.title_key('text')} ORDER BY score DESC, record_id) = 1)"""


@query("candidate_titles", f"WITH {_DEDUPED} SELECT desk, record_id, score FROM deduped")
def candidate_titles(t):
    return deduped(t).select("desk", "record_id", "score")


@query("title_dedupe", f"""WITH k AS (SELECT doc_id, n_chars, {sq.title_key('text')} AS key FROM documents)
SELECT doc_id, key FROM k QUALIFY key = '' OR row_number() OVER (PARTITION BY key ORDER BY n_chars DESC, doc_id) = 1""")
def title_dedupe(t):
    from recordweave.functions.text import title_key

    docs = t.documents.select(
        F.lit("all").alias("desk"), F.col("doc_id").alias("record_id"), F.col("n_chars").alias("score"), "text"
    )
    kept = ranking.title_dedupe(docs)
    return kept.select(F.col("record_id").alias("doc_id"), title_key(F.col("text")).alias("key"))


def featured(t):
    """Records of published briefs of the last week: the order's own desks and native id."""
    r = records(t)
    briefs = tagged(t).select(
        F.col("record_id").alias("brief_id"), "desk", F.col("created").alias("date"),
        F.when(F.col("status") == "F", "published").otherwise("failed").alias("status"),
    )
    cites = r.select(F.col("record_id").alias("brief_id"), "source_id", "native_id")
    return ranking.recently_featured(cites, briefs, AS_OF, days=120)


def fresh(t):
    return ranking.novelty(deduped(t), featured(t))


_FRESH = f"""{_DEDUPED}, featured AS (SELECT DISTINCT desk, source_id, native_id FROM tagged
  WHERE status = 'F' AND created >= DATE '{AS_OF}' - 120),
fresh AS (SELECT d.* EXCLUDE (score), f.desk IS NOT NULL AS featured, CASE WHEN f.desk IS NOT NULL THEN score * 0.5 ELSE score END AS score
  FROM deduped d LEFT JOIN featured f USING (desk, source_id, native_id))"""


@query("novelty", f"WITH {_FRESH} SELECT desk, record_id, featured, round(score, 9) AS score FROM fresh")
def novelty(t):
    return fresh(t).select("desk", "record_id", "featured", F.round("score", 9).alias("score"))


def diverse(t):
    return ranking.outlet_diversity(stage(fresh(t), "fresh"))


_DIVERSE = f"""{_FRESH}, diverse AS (SELECT * EXCLUDE (score), CASE WHEN source_id = 'feeds' AND row_number() OVER (
    PARTITION BY desk, source_id, outlet ORDER BY score DESC, record_id) > 3 THEN score * 0.5 ELSE score END AS score FROM fresh)"""


@query("outlet_diversity", f"WITH {_DIVERSE} SELECT desk, record_id, outlet, round(score, 9) AS score FROM diverse")
def outlet_diversity(t):
    return diverse(t).select("desk", "record_id", "outlet", F.round("score", 9).alias("score"))


def selected(t, candidates=None):
    chosen = ranking.select_facts(diverse(t) if candidates is None else candidates)
    return top_n(chosen, ["desk"], [F.desc("score"), "record_id"], dims.BRIEF_LIMIT, "selection_rank")


_SELECTED = f"""{_DIVERSE}, classed AS (SELECT *, row_number() OVER (PARTITION BY desk, record_type = 'research_paper',
    record_type <> 'research_paper' AND source_id = 'feeds' ORDER BY score DESC, record_id) AS cr FROM diverse),
flagged AS (SELECT *, (record_type = 'research_paper' AND cr <= 3) OR (record_type <> 'research_paper' AND source_id = 'feeds' AND cr <= 4) AS reserved
  FROM classed),
chosen AS (SELECT * FROM flagged QUALIFY row_number() OVER (PARTITION BY desk ORDER BY reserved DESC, score DESC, record_id) <= 50),
selected AS (SELECT *, row_number() OVER (PARTITION BY desk ORDER BY score DESC, record_id) AS selection_rank FROM chosen)"""


@query("select_floors", f"WITH {_SELECTED} SELECT desk, record_id, record_type, reserved, selection_rank FROM selected")
def select_floors(t):
    return selected(t).select("desk", "record_id", "record_type", "reserved", "selection_rank")


@query("candidate_rank", f"""WITH {_DIVERSE} SELECT desk, record_id, round(score, 6) AS score,
  row_number() OVER (PARTITION BY desk ORDER BY round(score, 6) DESC, md5(CAST(record_id AS VARCHAR)), record_id) AS rank FROM diverse""")
def candidate_rank(t):
    # every candidate has a rank, found in cells of a score rounded for that
    rows = diverse(t).select("desk", "record_id", F.round("score", 6).alias("score"))
    return positions(rows, ["desk"], "score", "record_id", "rank").select("desk", "record_id", "score", "rank")


def significance(t):
    """Verdicts for two thirds of the records; everything of the energy desk is froth."""
    k = F.col("record_id")
    return tagged(t).filter(k % 3 != 1).select(
        "desk", "record_id", F.when(F.col("desk") == "energy", (k % 40) / 100.0).otherwise((k % 100) / 100.0).alias("significance")
    )


def kept(t, facts=None):
    facts = stage(selected(t), "selected") if facts is None else facts
    return ranking.apply_significance(facts, significance(t))


_KEPT = f"""{_SELECTED}, judged AS (SELECT *, CASE WHEN record_id % 3 = 1 THEN 1.0
    WHEN desk = 'energy' THEN (record_id % 40) / 100.0 ELSE (record_id % 100) / 100.0 END AS significance FROM selected),
kept AS (SELECT * FROM judged QUALIFY significance >= 0.45 OR (max(significance) OVER (PARTITION BY desk) < 0.45
  AND row_number() OVER (PARTITION BY desk ORDER BY significance DESC, selection_rank) = 1))"""


@query("significance_facts", f"WITH {_KEPT} SELECT desk, record_id, round(significance, 6) AS significance FROM kept")
def significance_facts(t):
    return kept(t).select("desk", "record_id", F.round("significance", 6).alias("significance"))


@query("significance_keep", """WITH j AS (SELECT doc_id AS record_id, source AS desk, n_chars, CASE WHEN quality IS NULL THEN 1.0 WHEN quality = 1 THEN 0.9 ELSE doc_id % 45 / 100.0 END AS s
  FROM documents LEFT JOIN labels USING (doc_id))
SELECT desk, record_id, round(s, 6) AS significance FROM j QUALIFY s >= 0.45 OR (max(s) OVER (PARTITION BY desk) < 0.45
  AND row_number() OVER (PARTITION BY desk ORDER BY s DESC, record_id) = 1)""")
def significance_keep(t):
    facts = t.documents.select(
        F.col("source").alias("desk"), F.col("doc_id").alias("record_id"), F.col("doc_id").alias("selection_rank")
    )
    verdicts = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").select(
        F.col("source").alias("desk"), F.col("doc_id").alias("record_id"),
        F.when(F.col("quality") == 1, 0.9).otherwise(F.col("doc_id") % 45 / 100.0).alias("significance"),
    )
    return ranking.apply_significance(facts, verdicts).select(
        "desk", "record_id", F.round("significance", 6).alias("significance")
    )


_SHOWN = "record_id % 5 = 0"


@query("overflow_wire", f"""WITH {_KEPT}, froth AS (SELECT desk, record_id FROM selected EXCEPT SELECT desk, record_id FROM kept),
rest AS (SELECT desk, record_id, round(score, 4) AS score, text FROM diverse d WHERE NOT EXISTS (
    SELECT 1 FROM froth f WHERE f.desk = d.desk AND f.record_id = d.record_id)
  AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.desk = d.desk AND k.record_id = d.record_id AND k.{_SHOWN}))
SELECT desk, record_id, score, trim(text) AS headline, row_number() OVER (
  PARTITION BY desk ORDER BY score DESC, md5(CAST(record_id AS VARCHAR)), record_id) - 1 AS display_order FROM rest""")
def overflow_wire(t):
    candidates = stage(diverse(t), "candidates")
    facts = stage(selected(t, candidates), "selected")
    brief = stage(kept(t, facts), "kept")
    wire = ranking.overflow_wire(candidates, facts, brief, brief.filter(_SHOWN))
    none = F.lit(None).cast("string")
    return wire.select(
        "desk", "record_id", "score", ranking.wire_title(none, none, F.col("text")).alias("headline"), "display_order"
    )


@query("fact_passages", f"""WITH {_SELECTED} SELECT record_id, source_id, '' AS url, native_id, text AS excerpt,
  CAST(epoch(CAST(created AS TIMESTAMP)) AS BIGINT) AS published FROM selected""")
def fact_passages(t):
    facts = selected(t).withColumn("url", F.lit(None).cast("string"))
    out = ranking.fact_passages(facts, lambda key: F.when(F.lit(key == "date"), F.col("created").cast("string")))
    return out.select("record_id", "source_id", "url", "native_id", "excerpt", F.unix_seconds("published_at").alias("published"))


# --- retrieval ---------------------------------------------------------------------------

def vectors(t):
    desks = F.array(*[F.lit(d) for d in dims.DESKS])
    return t.embeddings.select(
        F.col("vec_id").alias("record_id"), F.element_at(desks, F.col("label") % 3 + 1).alias("desk"), "embedding"
    )


def seeds(t):
    return top_n(vectors(t), ["desk"], ["record_id"], 5)


_VEC = """vec AS (SELECT vec_id AS record_id, ['defense','ai','energy'][label % 3 + 1] AS desk, embedding FROM embeddings),
seed AS (SELECT * FROM vec QUALIFY row_number() OVER (PARTITION BY desk ORDER BY record_id) <= 5),
dim AS (SELECT desk, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM seed),
mean AS (SELECT desk, i, avg(x) AS x FROM dim GROUP BY desk, i),
q AS (SELECT desk, list(x ORDER BY i) AS v FROM mean GROUP BY desk),
near AS (SELECT desk, record_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], v), 9) AS d FROM vec JOIN q USING (desk)),
topk AS (SELECT *, row_number() OVER (PARTITION BY desk ORDER BY d, record_id) AS rank FROM near QUALIFY rank <= 20)"""


@query("seed_vector", f"WITH {_VEC} SELECT desk, i - 1 AS dim, round(x, 6) AS x FROM mean")
def seed_vector(t):
    out = retrieval.seed_vector(seeds(t)).select("desk", F.posexplode("query").alias("dim", "x"))
    return out.withColumn("x", F.round("x", 6)).withColumn("dim", F.col("dim").cast("bigint"))


def nearest(t):
    return retrieval.vector_topk(vectors(t), retrieval.seed_vector(seeds(t)))


@query("vector_topk", f"WITH {_VEC} SELECT desk, record_id, round(d, 6) AS distance, rank FROM topk")
def vector_topk(t):
    return nearest(t).withColumn("distance", F.round("distance", 6))


_SINCE = "2024-01-21 06:00:00"


@query("vector_topk_indexed", f"""WITH {_VEC}, dated AS (
  SELECT vec_id AS record_id, embedding, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (vec_id * 7 % 960) AS "at",
    list_distinct([['defense','ai','energy'][label % 3 + 1], ['defense','ai','energy'][vec_id % 3 + 1]]) AS desks FROM embeddings),
each AS (SELECT record_id, embedding, unnest(desks) AS desk FROM dated WHERE "at" >= TIMESTAMP '{_SINCE}'),
found AS (SELECT desk, record_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], v), 9) AS d FROM each JOIN q USING (desk))
SELECT desk, record_id, round(d, 6) AS distance, row_number() OVER (PARTITION BY desk ORDER BY d, record_id) AS rank FROM found QUALIFY rank <= 20""")
def vector_topk_indexed(t):
    desks = F.array(*[F.lit(d) for d in dims.DESKS])
    rows = t.embeddings.select(
        F.col("vec_id").alias("record_id"), "embedding",
        F.array(F.element_at(desks, F.col("label") % 3 + 1), F.element_at(desks, (F.col("vec_id") % 3 + 1).cast("int"))).alias("desk"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=(F.col("vec_id") * 7 % 960).cast("int"))).alias("at"),
    )
    queries = retrieval.seed_vector(seeds(t)).withColumn("query_id", F.col("desk"))
    found, _ = vector_index.search(vector_index.build(rows, cells=64), queries, since=_SINCE)
    return found.select("desk", "record_id", F.round("distance", 6).alias("distance"), "rank")


@query("passage_merge", f"""WITH {_SELECTED}, {_VEC},
parts AS (SELECT desk, record_id, selection_rank AS rank, 0 AS part FROM selected
  UNION ALL SELECT desk, record_id, rank, 1 FROM topk),
one AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY desk, record_id ORDER BY part, rank) = 1)
SELECT desk, record_id, idx AS "index" FROM (
  SELECT *, row_number() OVER (PARTITION BY desk ORDER BY part, rank, record_id) AS idx FROM one) WHERE idx <= 60""")
def passage_merge(t):
    facts = selected(t).select("desk", "record_id", F.col("selection_rank").alias("rank"))
    return ranking.merge_passages(facts, nearest(t).select("desk", "record_id", "rank"), 60)
