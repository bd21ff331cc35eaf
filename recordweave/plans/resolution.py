"""Names, identifiers, trigram candidates and gazetteer queries."""

from pyspark.sql import functions as F

from recordweave import dims
from recordweave.functions import names, text as tx
from recordweave.operators import gazetteer, ingest, resolution, telemetry
from recordweave.plans import sqltext as sq
from recordweave.plans.registry import query
from recordweave.sources import parsers

# --- scalar names ------------------------------------------------------------------

_MESSY = ("concat(' ', s_name, CASE s_suppkey % 7 WHEN 0 THEN ' Inc.' WHEN 1 THEN ', LLC' WHEN 2 THEN ' CORP /DE/' "
          "WHEN 3 THEN ' Company' WHEN 4 THEN ' Co  Ltd' WHEN 5 THEN ' AC/DC GmbH' ELSE '' END, ' ')")


@query("norm_name", f"SELECT s_suppkey, {sq.normalize_mention(_MESSY)} AS normalized FROM supplier")
def norm_name(t):
    return t.supplier.select("s_suppkey", names.normalize_mention(F.expr(_MESSY)).alias("normalized"))


@query("norm_award_name", f"SELECT s_suppkey, {sq.normalize_award_name(_MESSY)} AS normalized FROM supplier")
def norm_award_name(t):
    return t.supplier.select("s_suppkey", names.normalize_award_name(F.expr(_MESSY)).alias("normalized"))


@query("display_name", """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE
  array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') END AS shown
FROM part""")
def display_name(t):
    name = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.upper("p_name"))
    return t.part.select("p_partkey", tx.display_name(name).alias("shown"))


_L, _R = "upper(p_name)", "upper(p_brand || ' ' || p_name)"


@query("bigram_similarity", f"""SELECT p_partkey, round(CASE WHEN l = r THEN 1.0 ELSE {sq.jaccard('lb', 'rb')} END, 6) AS sim
FROM (SELECT p_partkey, {_L} AS l, {_R} AS r, {sq.shingles(_L, 2)} AS lb, {sq.shingles(_R, 2)} AS rb FROM part)""")
def bigram_similarity(t):
    return t.part.select(
        "p_partkey", F.round(names.bigram_similarity(F.expr(_L), F.expr(_R)), 6).alias("sim")
    )


# --- reference set -------------------------------------------------------------------

def landed_companies(t):
    """Customers as landed company maps, one payload per nation; two rows share most CIKs."""
    row = F.struct(
        (F.floor(F.col("c_custkey") / 2)).cast("string").alias("cik_str"),
        F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("ticker"),
        F.when(F.col("c_custkey") % 17 != 0, F.concat("c_name", F.lit(", Inc."))).alias("title"),
    )
    # one payload per customer keeps payloads small; the row number is the map key
    return t.customer.select(
        F.to_json(F.create_map(F.col("c_custkey").cast("string"), row)).alias("payload")
    )


_COMPANIES = f"""companies AS (
  SELECT lpad(CAST(c_custkey // 2 AS VARCHAR), 10, '0') AS cik, upper('t' || c_custkey) AS ticker, c_name || ', Inc.' AS name,
         {sq.normalize_mention("c_name || ', Inc.'")} AS name_normalized
  FROM customer WHERE c_custkey % 17 <> 0
  QUALIFY row_number() OVER (PARTITION BY c_custkey // 2 ORDER BY c_custkey) = 1)"""


@query("reference_entities", f"WITH {_COMPANIES} SELECT * FROM companies")
def reference_entities(t):
    return parsers.companies(landed_companies(t))


@query("seed_new_entities", f"""WITH {_COMPANIES}, fresh AS (
  SELECT * FROM companies WHERE CAST(substr(ticker, 2) AS BIGINT) % 3 <> 0)
SELECT sha256('cik:' || cik) AS entity, name, name_normalized AS alias, 'ticker' AS id_type, ticker AS id_value FROM fresh
UNION ALL SELECT sha256('cik:' || cik), name, name_normalized, 'cik', cik FROM fresh""")
def seed_new_entities(t):
    known = t.customer.filter("c_custkey % 3 = 0").select(
        F.lit("ticker").alias("id_type"), F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("id_value")
    )
    return ingest.seed_entities(reference_entities(t), known)


# --- identifiers -----------------------------------------------------------------------

def mention_records(t):
    """Orders as records with one mention that carries ticker, cik or an award uei."""
    k = F.col("o_custkey")
    return t.orders.select(
        F.col("o_orderkey").alias("mention_id"),
        F.when(F.col("o_orderkey") % 2 == 0, "usaspending").otherwise("edgar").alias("source_id"),
        F.struct(
            F.when(k % 3 == 0, F.concat(F.lit(" t"), k.cast("string"))).alias("ticker"),
            F.when(k % 4 == 0, k.cast("string")).alias("cik"),
            F.when(k % 5 == 0, F.concat(F.lit("u"), k.cast("string"))).alias("uei"),
        ).alias("mention"),
        F.when(F.col("o_orderkey") % 6 == 0, F.concat(F.lit("u"), k.cast("string"))).alias("award_uei"),
    )


def with_ids(t):
    r = mention_records(t)
    return r.select(
        "mention_id", names.resolution_ids(F.col("source_id"), F.col("mention"), F.col("award_uei")).alias("ids")
    )


_IDS = """ids AS (
  SELECT o_orderkey AS mention_id, pos, id_type, id_value FROM (
    SELECT o_orderkey, 1 AS pos, 'ticker' AS id_type, 'T' || o_custkey AS id_value FROM orders WHERE o_custkey % 3 = 0
    UNION ALL SELECT o_orderkey, 2, 'cik', lpad(CAST(o_custkey AS VARCHAR), 10, '0') FROM orders WHERE o_custkey % 4 = 0
    UNION ALL SELECT o_orderkey, 3, 'uei', 'U' || o_custkey FROM orders
      WHERE o_custkey % 5 = 0 OR o_orderkey % 6 = 0))"""


@query("resolution_inputs", f"""WITH {_IDS} SELECT o_orderkey AS mention_id,
  coalesce(string_agg(id_type || ':' || id_value, ';' ORDER BY pos), '') AS ids
FROM orders LEFT JOIN ids ON mention_id = o_orderkey GROUP BY o_orderkey""")
def resolution_inputs(t):
    joined = F.array_join(F.transform("ids", lambda i: F.concat_ws(":", i["id_type"], i["id_value"])), ";")
    return with_ids(t).select("mention_id", joined.alias("ids"))


def identifiers(t):
    k = F.col("c_custkey")
    kinds = F.array(
        F.struct(F.lit("ticker").alias("id_type"), F.concat(F.lit("T"), k.cast("string")).alias("id_value")),
        F.struct(F.lit("cik").alias("id_type"), F.lpad(k.cast("string"), 10, "0").alias("id_value")),
    )
    return t.customer.select(
        k.alias("entity"), F.explode(kinds).alias("i"),
        F.when(k % 7 == 0, F.lit("2000-01-01").cast("date")).alias("valid_to"),
    ).select("entity", "i.id_type", "i.id_value", "valid_to").filter("NOT (id_type = 'ticker' AND entity % 2 = 0)")


@query("resolve_identifier", f"""WITH {_IDS}, known AS (
  SELECT c_custkey AS entity, 'ticker' AS id_type, 'T' || c_custkey AS id_value FROM customer
    WHERE c_custkey % 7 <> 0 AND c_custkey % 2 <> 0
  UNION ALL SELECT c_custkey, 'cik', lpad(CAST(c_custkey AS VARCHAR), 10, '0') FROM customer WHERE c_custkey % 7 <> 0)
SELECT mention_id, entity, 'identifier:' || id_type AS resolved_by FROM ids JOIN known USING (id_type, id_value)
QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY pos) = 1""")
def resolve_identifier(t):
    return resolution.by_identifier(with_ids(t), identifiers(t))


# --- names ------------------------------------------------------------------------------

# part names with small edits stand for mentions; plain names stand for aliases
_MENTION = ("CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ', Inc.' "
            "WHEN 2 THEN substr(p_name, 1, length(p_name) - 1) ELSE replace(p_name, 'l', 'll') || ' works' END")


def part_mentions(t):
    return t.part.select(names.normalize_mention(F.expr(_MENTION)).alias("name"))


def part_aliases(t):
    """One entity per name; names of rings have a second entity with a near-equal alias."""
    own = t.part.groupBy(F.upper("p_name").alias("name")).agg(F.min("p_partkey").alias("entity"))
    plural = own.filter(F.endswith("name", F.lit("RING"))).select(
        F.concat("name", F.lit("S")).alias("name"), (F.col("entity") + 1000000000).alias("entity")
    )
    twin = own.filter(F.endswith("name", F.lit("BOLT"))).select("name", (F.col("entity") + 2000000000).alias("entity"))
    return own.unionByName(plural).unionByName(twin)


_ALIASES = """own AS (SELECT upper(p_name) AS name, min(p_partkey) AS entity FROM part GROUP BY 1),
aliases AS (SELECT * FROM own UNION ALL SELECT name || 'S', entity + 1000000000 FROM own WHERE name LIKE '%RING'
  UNION ALL SELECT name, entity + 2000000000 FROM own WHERE name LIKE '%BOLT')"""
_RANKED = f"""mentions AS (SELECT DISTINCT {sq.normalize_mention(_MENTION)} AS name FROM part), {_ALIASES},
m AS (SELECT name, {sq.trigrams('name')} AS g FROM mentions),
a AS (SELECT name AS alias, entity, {sq.trigrams('name')} AS g FROM aliases),
pairs AS (SELECT m.name, entity, max({sq.jaccard('m.g', 'a.g')}) AS sim FROM m, a GROUP BY m.name, entity),
ranked AS (SELECT name, entity, sim, row_number() OVER (PARTITION BY name ORDER BY sim DESC, entity) AS rank
  FROM pairs WHERE sim >= 0.3 - 1e-9 QUALIFY rank <= 5)"""
_DECIDED = f"""{_RANKED}, top AS (SELECT *, lead(sim) OVER (PARTITION BY name ORDER BY rank) AS second FROM ranked),
decided AS (SELECT name, CASE WHEN sim >= 0.92 AND sim - second < 0.05 THEN 'llm_disambiguate' WHEN sim >= 0.92 THEN 'auto_link'
  WHEN sim >= 0.7 THEN 'llm_disambiguate' WHEN sim >= 0.55 THEN 'llm_expand_context' ELSE 'auto_dismiss' END AS status,
  sim AS confidence, CASE WHEN sim >= 0.92 AND NOT coalesce(sim - second < 0.05, false) THEN entity END AS entity
  FROM top WHERE rank = 1)"""


@query("trigram_candidates", f"WITH {_RANKED} SELECT name, entity, round(sim, 6) AS sim, rank FROM ranked")
def trigram_candidates(t):
    return resolution.candidates(part_mentions(t), part_aliases(t)).withColumn("sim", F.round("sim", 6))


@query("resolve_decide", f"WITH {_DECIDED} SELECT name, status, round(confidence, 6) AS confidence, entity FROM decided")
def resolve_decide(t):
    out = resolution.decide(resolution.candidates(part_mentions(t), part_aliases(t)))
    return out.withColumn("confidence", F.round("confidence", 6)).drop("resolved_by")


@query("review_queue", f"""WITH {_DECIDED} SELECT d.name, d.status, round(confidence, 6) AS confidence, 'pending' AS review_status,
  string_agg(r.entity || '=' || printf('%.4f', r.sim), ';' ORDER BY rank) AS candidates
FROM decided d JOIN ranked r ON r.name = d.name WHERE status LIKE 'llm%' GROUP BY ALL""")
def review_queue(t):
    ranked = resolution.candidates(part_mentions(t), part_aliases(t))
    listed = F.array_join(
        F.transform("candidates", lambda c: F.format_string("%d=%.4f", c["entity"], c["sim"])), ";"
    )
    out = resolution.review_queue(ranked, resolution.decide(ranked))
    return out.select(
        "name", "status", F.round("confidence", 6).alias("confidence"), "review_status", listed.alias("candidates")
    )


@query("resolve_bulk", f"""WITH {_DECIDED}, asked AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS mention_id, {sq.normalize_mention(_MENTION)} AS name,
         CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey END AS supp
  FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT DISTINCT mention_id, CASE WHEN supp % 4 <> 0 THEN CAST(supp AS VARCHAR) WHEN entity IS NOT NULL THEN CAST(entity AS VARCHAR)
         WHEN supp IS NOT NULL THEN sha256('uei:U' || supp) END AS entity,
       CASE WHEN supp % 4 <> 0 THEN 'auto_link' ELSE coalesce(status, 'auto_dismiss') END AS status,
       CASE WHEN supp % 4 <> 0 THEN 'identifier:uei' WHEN entity IS NOT NULL THEN 'auto_high_confidence'
            WHEN supp IS NOT NULL THEN 'minted' END AS resolved_by
FROM asked LEFT JOIN decided USING (name)""")
def resolve_bulk(t):
    uei = F.concat(F.lit("U"), F.col("l_suppkey").cast("string"))
    has = F.col("l_linenumber") % 2 == 0
    mentions = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("mention_id"),
        F.expr(_MENTION).alias("mention"),
        F.array_compact(F.array(F.when(has, F.struct(F.lit("uei").alias("id_type"), uei.alias("id_value"))))).alias("ids"),
    ).dropDuplicates(["mention_id"])
    known = t.supplier.filter("s_suppkey % 4 <> 0").select(
        F.lit("uei").alias("id_type"), F.concat(F.lit("U"), F.col("s_suppkey").cast("string")).alias("id_value"),
        F.col("s_suppkey").alias("entity"), F.lit(None).cast("date").alias("valid_to"),
    )
    return resolution.resolve(mentions, known, part_aliases(t)).select("mention_id", "entity", "status", "resolved_by")


@query("entity_search", f"""WITH {_ALIASES}, scored AS (SELECT entity, name, starts_with(name, 'SMALL RIN') AS prefix,
  {sq.jaccard(sq.trigrams('name'), sq.trigrams("'SMALL RIN'"))} AS sim FROM aliases)
SELECT entity, name, prefix, round(sim, 6) AS sim FROM scored WHERE prefix OR sim >= 0.3 - 1e-9
ORDER BY prefix DESC, round(sim, 6) DESC, name, entity LIMIT 20""")
def entity_search(t):
    return resolution.search(part_aliases(t), "small rin").withColumn("sim", F.round("sim", 6))


_PAIRS = """(SELECT CASE WHEN quality = 1 THEN 'T' || doc_id END AS expected,
  CASE WHEN n_chars > 1200 THEN CASE WHEN doc_id % 9 = 0 THEN 'X' ELSE 'T' || doc_id END END AS predicted
  FROM documents JOIN labels USING (doc_id))"""


@query("link_eval", f"""WITH c AS (SELECT count(*) AS total, count(expected) AS resolvable, count(predicted) AS resolved,
  count(*) FILTER (predicted = expected) AS correct,
  count(*) FILTER (predicted IS NOT NULL AND predicted IS DISTINCT FROM expected) AS wrong FROM {_PAIRS})
SELECT *, round(coalesce(correct / nullif(resolved, 0)::DOUBLE, 1.0), 6) AS precision,
  round(coalesce(correct / nullif(resolvable, 0)::DOUBLE, 1.0), 6) AS recall,
  round(coalesce(wrong / nullif(resolved, 0)::DOUBLE, 0.0), 6) AS false_link_rate FROM c""")
def link_eval(t):
    name = F.concat(F.lit("T"), F.col("doc_id").cast("string"))
    pairs = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id").select(
        F.when(F.col("quality") == 1, name).alias("expected"),
        F.when(F.col("n_chars") > 1200, F.when(F.col("doc_id") % 9 == 0, "X").otherwise(name)).alias("predicted"),
    )
    return resolution.link_metrics(pairs)


@query("renormalize_diff", f"""SELECT s_suppkey, {sq.normalize_mention(_MESSY)} AS fresh FROM supplier
WHERE {sq.normalize_mention(_MESSY)} <> upper(trim({_MESSY}))""")
def renormalize_diff(t):
    stored = t.supplier.select(
        "s_suppkey", F.expr(_MESSY).alias("alias"), F.expr(f"upper(trim({_MESSY}))").alias("alias_normalized")
    )
    return ingest.renormalize(stored).select("s_suppkey", "fresh")


@query("minted_entities", """SELECT DISTINCT c_mktsegment || ' ' || c_nationkey AS name FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def minted_entities(t):
    entities = t.customer.select(
        F.col("c_custkey").alias("entity"),
        F.concat_ws(" ", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("name"),
    )
    ids = t.orders.select(
        F.col("o_custkey").alias("entity"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "brief_resolution").otherwise("seed").alias("source"),
    )
    return telemetry.minted_entities(entities, ids)


# --- gazetteer ----------------------------------------------------------------------------

def benchmark_aliases(t):
    return t.benchmark.select(
        F.array_join(F.slice(names.word_tokens(F.col("text")), 1, 3), " ").alias("alias"), F.col("item_id").alias("entity")
    )


_INDEX = f"""raw_alias AS (SELECT array_to_string(list_slice({sq.tokens('text')}, 1, 3), ' ') AS alias, item_id AS entity FROM benchmark),
idx AS (SELECT alias, min(entity) AS entity FROM raw_alias WHERE contains(alias, ' ')
  AND alias NOT IN ({', '.join(repr(a) for a in dims.STOPWORD_ALIASES)}) GROUP BY alias HAVING count(DISTINCT entity) = 1)"""
_HITS = f"""{_INDEX}, docs AS (SELECT doc_id, {sq.tokens('text')} AS tk FROM documents),
tok AS (SELECT doc_id, unnest(tk) AS w1, generate_subscripts(tk, 1) - 1 AS p FROM docs),
run AS (SELECT *, lead(w1, 1) OVER d AS w2, lead(w1, 2) OVER d AS w3, lead(w1, 3) OVER d AS w4, lead(w1, 4) OVER d AS w5,
  lead(w1, 5) OVER d AS w6 FROM tok WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
grams AS (SELECT doc_id, p, w1 || ' ' || w2 AS gram FROM run UNION ALL SELECT doc_id, p, w1 || ' ' || w2 || ' ' || w3 FROM run
  UNION ALL SELECT doc_id, p, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM run
  UNION ALL SELECT doc_id, p, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 FROM run
  UNION ALL SELECT doc_id, p, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 || ' ' || w6 FROM run),
hits AS (SELECT doc_id, alias, entity, min(p) AS pos FROM grams JOIN idx ON gram = alias GROUP BY ALL)"""


@query("alias_index", f"WITH {_INDEX} SELECT * FROM idx")
def alias_index(t):
    return gazetteer.alias_index(benchmark_aliases(t))


@query("gazetteer_links", f"WITH {_HITS} SELECT doc_id, entity, min(pos) AS pos FROM hits GROUP BY doc_id, entity")
def gazetteer_links(t):
    return gazetteer.link_mentions(t.documents, alias_index(t)).drop("n")


@query("alias_df", f"WITH {_HITS} SELECT alias, count(*) AS documents FROM hits GROUP BY alias")
def alias_df(t):
    return gazetteer.alias_document_frequency(t.documents, alias_index(t))


@query("backfill_links", f"""WITH {_HITS}, links AS (SELECT doc_id, entity, min(pos) AS pos FROM hits GROUP BY ALL)
SELECT doc_id, doc_id % 40 || ',' || string_agg(entity, ',' ORDER BY pos) AS entity_ids,
  string_agg(entity, ',' ORDER BY pos) AS additions FROM links WHERE entity <> doc_id % 40 GROUP BY doc_id""")
def backfill_links(t):
    items = t.documents.select("doc_id", F.array(F.col("doc_id") % 40).alias("entity_ids"))
    out = gazetteer.backfill(items, gazetteer.link_mentions(t.documents, alias_index(t)), "doc_id")
    return out.select(
        "doc_id", F.array_join("entity_ids", ",").alias("entity_ids"), F.array_join("additions", ",").alias("additions")
    )


@query("item_entities", f"""WITH {_HITS}, links AS (
  SELECT doc_id, entity, 1 AS part, min(pos) AS pos FROM hits GROUP BY ALL
  UNION ALL SELECT doc_id, doc_id % 40, 0, 0 FROM documents WHERE doc_id % 5 = 0),
firsts AS (SELECT doc_id, entity, min({{'part': part, 'pos': pos}}) AS k FROM links GROUP BY ALL)
SELECT doc_id, string_agg(entity, ',' ORDER BY k) AS entity_ids FROM firsts GROUP BY doc_id""")
def item_entities(t):
    by_id = t.documents.filter("doc_id % 5 = 0").select(
        "doc_id", (F.col("doc_id") % 40).alias("entity"), F.lit(0).alias("part"), F.lit(0).alias("pos")
    )
    by_name = gazetteer.link_mentions(t.documents, alias_index(t)).select("doc_id", "entity", F.lit(1).alias("part"), "pos")
    out = gazetteer.ordered_ids(by_id.unionByName(by_name), "doc_id", ["part", "pos"])
    return out.select("doc_id", F.array_join("entity_ids", ",").alias("entity_ids"))


def probe_table(t):
    """First two words of every benchmark text as a probe phrase; desks go round."""
    words = F.slice(names.word_tokens(F.col("text")), 1, 2)
    desks = F.array(*[F.lit(d) for d in dims.DESKS])
    return t.benchmark.select(
        F.lower(F.array_join(words, " ")).alias("phrase"),
        F.slice(desks, (F.col("item_id") % 3 + 1).cast("int"), 2).alias("desks"),
    )


_PROBES = f"""probes AS (SELECT DISTINCT lower(array_to_string(list_slice({sq.tokens('text')}, 1, 2), ' ')) AS phrase,
  list_slice(['defense', 'ai', 'energy'], item_id % 3 + 1, item_id % 3 + 2) AS desks FROM benchmark)"""


@query("theme_tags", f"""WITH {_PROBES}, docs AS (SELECT doc_id, {sq.tokens('text')} AS tk FROM documents),
tok AS (SELECT doc_id, unnest(tk) AS w, generate_subscripts(tk, 1) - 1 AS p FROM docs),
grams AS (SELECT doc_id, p, lower(w || ' ' || lead(w) OVER (PARTITION BY doc_id ORDER BY p)) AS gram FROM tok)
SELECT doc_id, phrase, array_to_string(desks, ',') AS desks, min(p) AS pos FROM grams JOIN probes ON gram = phrase GROUP BY ALL""")
def theme_tags(t):
    out = gazetteer.theme_tags(t.documents, probe_table(t))
    return out.withColumn("desks", F.array_join("desks", ","))


@query("themes_for_desk", f"WITH {_PROBES} SELECT phrase FROM probes WHERE list_contains(desks, 'energy')")
def themes_for_desk(t):
    return telemetry.themes_for_desk(probe_table(t).distinct(), "energy")


@query("or_query_groups", """WITH p AS (SELECT p_brand AS desk, p_name AS phrase, min(p_partkey) AS position FROM part GROUP BY ALL),
n AS (SELECT *, (row_number() OVER (PARTITION BY desk ORDER BY position) - 1) // 8 AS grp FROM p)
SELECT desk, grp, '(' || string_agg('"' || phrase || '"', ' OR ' ORDER BY position) || ')' AS query FROM n GROUP BY desk, grp""")
def or_query_groups(t):
    phrases = t.part.groupBy(F.col("p_brand").alias("desk"), F.col("p_name").alias("phrase")).agg(
        F.min("p_partkey").alias("position")
    )
    return telemetry.or_queries(phrases)


_COMPANY_WORDS = [("Ring Works", "RNG", ["ring", "small ring"]), ("Gizmo Labs", "GZM", ["gizmo"]), ("Bolt Bros", "BLT", ["red bolt", "old bolt"])]


@query("allowlist_mentions", r"""SELECT p_partkey, concat_ws(',', CASE WHEN regexp_matches(x, '\bring\b|\bsmall ring\b') THEN 'RNG' END,
  CASE WHEN regexp_matches(x, '\bgizmo\b') THEN 'GZM' END, CASE WHEN regexp_matches(x, '\bred bolt\b|\bold bolt\b') THEN 'BLT' END) AS tickers
FROM (SELECT p_partkey, lower(p_brand || ' ships a ' || p_name || CASE WHEN p_size % 5 = 0 THEN 's' ELSE '' END || '.') AS x FROM part)""")
def allowlist_mentions(t):
    text = F.expr("concat(p_brand, ' ships a ', p_name, CASE WHEN p_size % 5 = 0 THEN 's' ELSE '' END, '.')")
    found = gazetteer.allowlist_mentions(text, _COMPANY_WORDS)
    return t.part.select("p_partkey", F.array_join(F.transform(found, lambda m: m["ticker"]), ",").alias("tickers"))
