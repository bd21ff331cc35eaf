"""Citation, claim and verdict queries over documents with appended citations."""

from pyspark.sql import functions as F

from recordweave import dims
from recordweave.functions import citations, scoring
from recordweave.operators import verdicts
from recordweave.plans import sqltext as sq
from recordweave.plans.registry import query
from recordweave.session import stage
from recordweave.sources import parsers

# most sentence ends get a citation, spelled well or nearly well
_CITED = ("replace(text, '. ', concat(CASE doc_id % 4 WHEN 0 THEN ' [CITE:' WHEN 1 THEN ' [cite 0' WHEN 2 THEN ' (CITE: ' ELSE ' [' END, "
          "doc_id % 9 + 1, CASE doc_id % 4 WHEN 2 THEN '). ' ELSE ']. ' END))")
_BODY_SQL = _CITED.replace("concat(", "concat(").replace("doc_id % 9 + 1", "(doc_id % 9 + 1)")


def cited_docs(t):
    return t.documents.select("doc_id", "source", F.expr(_CITED).alias("body"))


def items(t):
    return cited_docs(t).select(
        F.col("source").alias("brief_id"), F.col("doc_id").alias("item_id"),
        citations.repair_citations(F.col("body")).alias("body"),
    )


_ITEMS = f"items AS (SELECT source AS brief_id, doc_id AS item_id, {sq.repair_citations(_BODY_SQL)} AS body FROM documents)"
_CLAIMS = rf"""{_ITEMS}, sent AS (SELECT brief_id, item_id, {sq.sentences('body')} AS s FROM items),
claims AS (SELECT brief_id, item_id, unnest(list_transform(s, lambda x: {sq.strip('x')})) AS text, generate_subscripts(s, 1) - 1 AS claim FROM sent),
good AS (SELECT *, regexp_matches(text, '\[CITE:\d+\]') AS cited FROM claims WHERE text <> ''),
judged AS (SELECT *, cited AND claim % 3 <> 0 AND claim % 5 <> 4 AS passes FROM good),
results AS (SELECT brief_id, item_id, count(*) AS claims_total, count(*) FILTER (passes) AS claims_passing,
  coalesce(string_agg(text, ' ' ORDER BY claim) FILTER (passes), '') AS cleaned_body FROM judged GROUP BY ALL)"""


@query("cite_repair", f"SELECT doc_id, md5({sq.repair_citations(_BODY_SQL)}) AS repaired FROM documents")
def cite_repair(t):
    return cited_docs(t).select("doc_id", F.md5(citations.repair_citations(F.col("body"))).alias("repaired"))


@query("cite_indices", rf"""WITH {_ITEMS} SELECT item_id, array_to_string(list_transform(regexp_extract_all(body, '\[CITE:(\d+)\]', 1), lambda x: CAST(x AS INT))[1:1], ',') AS indices FROM items""")
def cite_indices(t):
    return items(t).select("item_id", F.array_join(citations.citation_indices(F.col("body")), ",").alias("indices"))


@query("sentences", f"""WITH s AS (SELECT doc_id, {sq.sentences('text')} AS s FROM documents)
SELECT doc_id, len(s) AS n, md5(array_to_string(s, chr(10) || '~')) AS digest FROM s""")
def sentences(t):
    cut = citations.sentences(F.col("text"))
    return t.documents.select(
        "doc_id", F.size(cut).cast("bigint").alias("n"), F.md5(F.array_join(cut, "\n~")).alias("digest")
    )


@query("strip_uncited", rf"""WITH s AS (SELECT doc_id, {sq.sentences(sq.repair_citations(_BODY_SQL))} AS s FROM documents)
SELECT doc_id, md5(array_to_string(list_filter(list_transform(s, lambda x: {sq.strip('x')}), lambda x: regexp_matches(x, '\[CITE:\d+\]')), ' ')) AS kept FROM s""")
def strip_uncited(t):
    return cited_docs(t).select("doc_id", F.md5(citations.strip_uncited(F.col("body"))).alias("kept"))


@query("claims", f"WITH {_CLAIMS} SELECT item_id, claim, md5(text) AS text, cited FROM good")
def claims(t):
    out = verdicts.claims(items(t))
    return out.select("item_id", "claim", F.md5("text").alias("text"), (F.size("indices") > 0).alias("cited"))


def judged(t):
    rows = stage(verdicts.claims(items(t)), "claims")
    answers = rows.filter("claim % 5 <> 4").select("item_id", "claim", (F.col("claim") % 3 != 0).alias("supported"))
    return verdicts.judge(rows, answers)


def results(t):
    return verdicts.item_results(judged(t))


@query("cleaned_body", f"""WITH {_CLAIMS} SELECT item_id, claims_total, claims_passing,
  round(claims_passing / claims_total::DOUBLE, 6) AS faithfulness, md5(cleaned_body) AS cleaned_body, cleaned_body = '' AS excluded FROM results""")
def cleaned_body(t):
    return results(t).withColumn("cleaned_body", F.md5("cleaned_body")).withColumn("faithfulness", F.round("faithfulness", 6))


_BRIEFS = f"""{_CLAIMS}, alive AS (SELECT i.brief_id, r.claims_total, r.claims_passing, coalesce(r.claims_passing > 0, false) AS ok
  FROM items i LEFT JOIN results r USING (item_id)),
briefs AS (SELECT brief_id, count(*) FILTER (ok) AS surviving_items, CAST(coalesce(sum(claims_passing) FILTER (ok), 0) AS BIGINT) AS provable_claims,
  round(coalesce(sum(claims_passing) FILTER (ok) / nullif(sum(claims_total) FILTER (ok), 0)::DOUBLE, 0.0), 6) AS faithfulness,
  bool_or(ok) AS eval_passed FROM alive GROUP BY brief_id)"""


@query("claim_faithfulness", f"WITH {_BRIEFS} SELECT brief_id, provable_claims, faithfulness FROM briefs")
def claim_faithfulness(t):
    return publish_verdict(t).select("brief_id", "provable_claims", "faithfulness")


@query("publish_verdict", f"WITH {_BRIEFS} SELECT * FROM briefs")
def publish_verdict(t):
    # which items a brief has needs no text
    of_brief = t.documents.select(F.col("source").alias("brief_id"), F.col("doc_id").alias("item_id"))
    return verdicts.brief_results(of_brief, results(t)).withColumn("faithfulness", F.round("faithfulness", 6))


_SOURCES = "['usaspending','feeds','gdelt','edgar']"


@query("publish_items", rf"""WITH {_CLAIMS},
c AS (SELECT brief_id, item_id, text, row_number() OVER (PARTITION BY item_id ORDER BY claim) - 1 AS claim FROM good WHERE cited),
j AS (SELECT *, claim % 3 <> 0 AND claim % 5 <> 4 AS passes FROM c),
r AS (SELECT item_id, count(*) AS claims_total, count(*) FILTER (passes) AS claims_passing,
  string_agg(text, ' ' ORDER BY claim) FILTER (passes) AS body FROM j GROUP BY item_id HAVING count(*) FILTER (passes) > 0),
ix AS (SELECT DISTINCT brief_id, item_id, CAST(unnest(regexp_extract_all(text, '\[CITE:(\d+)\]', 1)) AS INT) AS i FROM j WHERE passes),
ps AS (SELECT DISTINCT source AS brief_id, i, {_SOURCES}[(i + length(source)) % 4 + 1] AS source_id FROM documents, (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS i)),
d AS (SELECT item_id, source_id FROM (SELECT item_id, source_id, count(*) AS n, min(i) AS f FROM ix JOIN ps USING (brief_id, i) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n DESC, f) = 1),
l AS (SELECT r.*, source_id, {sq.case("coalesce(source_id, '')", dims.EVIDENCE_CLASS, "'reported'")} AS cls FROM r LEFT JOIN d USING (item_id))
SELECT item_id, claims_total, claims_passing, md5(body) AS cleaned_body, source_id,
  CASE cls WHEN 'signal' THEN 'speculative' WHEN 'reported' THEN 'reported' ELSE 'confirmed' END AS attribution FROM l""")
def publish_items(t):
    """Uncited sentences out, claims judged, the rest graded by where its citations come from; one cut into sentences."""
    rows = stage(verdicts.cited_claims(items(t)), "cited-claims")
    answers = rows.filter("claim % 5 <> 4").select("item_id", "claim", (F.col("claim") % 3 != 0).alias("supported"))
    index = F.explode(F.sequence(F.lit(1), F.lit(7))).alias("index")
    sources = F.array(*[F.lit(s) for s in ("usaspending", "feeds", "gdelt", "edgar")])
    passages = t.documents.select(F.col("source").alias("brief_id")).distinct().select("brief_id", index).withColumn(
        "source_id", F.element_at(sources, ((F.col("index") + F.length("brief_id")) % 4 + 1).cast("int"))
    )
    out = verdicts.publish_items(rows, answers, passages)
    return out.select("item_id", "claims_total", "claims_passing", F.md5("cleaned_body").alias("cleaned_body"), "source_id", "attribution")


_ATTEMPTS = """attempts AS (SELECT o_custkey AS brief_id, o_orderkey AS attempt, o_orderstatus = 'F' AND o_totalprice > 400000 AS eval_passed,
  CAST(floor(o_totalprice / 100000) AS BIGINT) AS surviving_items, o_orderkey % 7 AS provable_claims FROM orders)"""


@query("best_attempt", f"""WITH {_ATTEMPTS} SELECT * FROM attempts QUALIFY row_number() OVER (PARTITION BY brief_id
  ORDER BY eval_passed DESC, CASE WHEN NOT eval_passed THEN -surviving_items END, CASE WHEN NOT eval_passed THEN -provable_claims END, attempt) = 1""")
def best_attempt(t):
    attempts = t.orders.select(
        F.col("o_custkey").alias("brief_id"), F.col("o_orderkey").alias("attempt"),
        ((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 400000)).alias("eval_passed"),
        F.floor(F.col("o_totalprice") / 100000).alias("surviving_items"), (F.col("o_orderkey") % 7).alias("provable_claims"),
    )
    return verdicts.best_attempt(attempts)


# --- cited passages: orders are items of their customer's brief, line items are citations ---

def order_items(t):
    index = (F.col("l_partkey") % 20 + 1).cast("int")
    cites = t.lineitem.groupBy(F.col("l_orderkey").alias("item_id")).agg(F.collect_set(index).alias("indices"))
    return t.orders.select(F.col("o_custkey").alias("brief_id"), F.col("o_orderkey").alias("item_id")).join(cites, "item_id")


def brief_passages(t):
    """Passages 1..15 of each brief, from the suppliers of its orders."""
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    sources = F.array(*[F.lit(s) for s in ("usaspending", "feeds", "gdelt", "edgar")])
    return (
        lines.select(F.col("o_custkey").alias("brief_id"), (F.col("l_suppkey") % 20 + 1).cast("int").alias("index"))
        .filter("index <= 15")
        .distinct()
        .withColumn("source_id", F.element_at(sources, F.col("index") % 4 + 1))
    )


_CITED_PASSAGES = """oi AS (SELECT DISTINCT o_custkey AS brief_id, o_orderkey AS item_id, CAST(l_partkey % 20 + 1 AS INT) AS idx
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ps AS (SELECT DISTINCT o_custkey AS brief_id, CAST(l_suppkey % 20 + 1 AS INT) AS idx,
  ['usaspending','feeds','gdelt','edgar'][(l_suppkey % 20 + 1) % 4 + 1] AS source_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey % 20 + 1 <= 15),
cited AS (SELECT brief_id, item_id, idx, source_id FROM oi JOIN ps USING (brief_id, idx)),
dom AS (SELECT item_id, source_id FROM (SELECT item_id, source_id, count(*) AS n, min(idx) AS f FROM cited GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n DESC, f) = 1)"""


@query("brief_citations", f"""WITH {_CITED_PASSAGES} SELECT brief_id, item_id, CAST(idx AS BIGINT) AS "index", source_id,
  CASE WHEN source_id IN ('gdelt', 'feeds') THEN 'scrape_gray' ELSE 'public_domain' END AS license_class,
  octet_length(encode('{{"index":' || idx || ',"source_id":"' || source_id || '"}}')) AS payload_size FROM cited""")
def brief_citations(t):
    cited = verdicts.cited_passages(order_items(t), brief_passages(t))
    return cited.withColumn("license_class", scoring.license_class(F.col("source_id"))).withColumn(
        "payload_size", F.octet_length(F.to_json(F.struct("index", "source_id"))).cast("bigint")
    )


@query("dominant_source", f"WITH {_CITED_PASSAGES} SELECT * FROM dom")
def dominant_source(t):
    return verdicts.dominant_source(verdicts.cited_passages(order_items(t), brief_passages(t)))


_LADDER = "CASE {c} WHEN 'signal' THEN 'speculative' WHEN 'reported' THEN 'reported' ELSE CASE WHEN passing > 0 THEN 'confirmed' ELSE 'analysis' END END"


@query("attribution", f"""WITH {_CITED_PASSAGES}, r AS (SELECT o_orderkey AS item_id, o_orderkey % 3 AS passing FROM orders WHERE o_orderkey % 5 <> 0),
j AS (SELECT item_id, passing, {sq.case("coalesce(source_id, '')", dims.EVIDENCE_CLASS, "'reported'")} AS cls FROM r LEFT JOIN dom USING (item_id)),
lab AS (SELECT item_id, {_LADDER.format(c='cls')} AS attribution FROM j)
SELECT *, CAST(CASE attribution WHEN 'confirmed' THEN 4 WHEN 'reported' THEN 3 WHEN 'analysis' THEN 2 ELSE 1 END AS BIGINT) AS confidence FROM lab""")
def attribution(t):
    sources = verdicts.dominant_source(verdicts.cited_passages(order_items(t), brief_passages(t)))
    rows = t.orders.select(
        F.col("o_orderkey").alias("item_id"), (F.col("o_orderkey") % 3).alias("claims_passing"),
        (F.col("o_orderkey") % 5 == 0).alias("excluded"),
    )
    out = verdicts.attribute(rows, sources)
    return out.select("item_id", "attribution", scoring.attribution_rank(F.col("attribution")).alias("confidence"))


@query("analysis_grounding", """SELECT conv_id || '-' || turn AS label, coalesce(CASE WHEN turn % 3 = 0 THEN CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END END, 0) AS findings,
  coalesce(CASE WHEN turn % 3 = 0 THEN conv_id % 2 <> 0 END, true) AS grounded FROM conversations""")
def analysis_grounding(t):
    label = F.concat_ws("-", "conv_id", "turn")
    answers = t.conversations.filter("turn % 3 = 0").select(
        label.alias("label"),
        F.array(F.lit("  "), F.when(F.col("conv_id") % 2 == 0, "made-up figure").otherwise("")).alias("new_facts"),
    )
    out = verdicts.analysis_grounding(t.conversations.select(label.alias("label")), answers)
    return out.select("label", F.size("new_facts").alias("findings"), "grounded")


@query("keep_drop_eval", """WITH r AS (SELECT CASE WHEN quality = 1 THEN 'keep' ELSE 'drop' END AS e, CASE WHEN n_chars > 600 THEN 'keep' ELSE 'drop' END AS a
  FROM documents JOIN labels USING (doc_id))
SELECT count(*) AS total, count(*) FILTER (e = a) AS correct, round(count(*) FILTER (e = a) / count(*)::DOUBLE, 6) AS accuracy,
  count(*) FILTER (e = 'drop') AS froth_total, count(*) FILTER (e = 'drop' AND a = 'drop') AS froth_caught,
  count(*) FILTER (e = 'keep') AS signal_total, count(*) FILTER (e = 'keep' AND a = 'keep') AS signal_kept FROM r""")
def keep_drop_eval(t):
    rows = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id").select(
        F.when(F.col("quality") == 1, "keep").otherwise("drop").alias("expected"),
        F.when(F.col("n_chars") > 600, "keep").otherwise("drop").alias("action"),
    )
    return verdicts.significance_metrics(rows)


@query("verdict_load", """SELECT doc_id AS item_id, CAST(c AS BIGINT) AS claim, quality = 1 AND c = 0 AS supported
FROM labels, (SELECT unnest([0, 1]) AS c) WHERE doc_id % 3 <> 2""")
def verdict_load(t):
    body = F.concat(
        F.lit('{"claim_evaluations": [{"id": "c0", "supported": '), (F.col("quality") == 1).cast("string"),
        F.lit('}, {"id": "c1"}]}'),
    )
    fence = F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))
    answer = F.when(F.col("doc_id") % 3 == 0, fence).when(F.col("doc_id") % 3 == 1, body).otherwise("no answer {")
    return parsers.verdicts(t.labels.select(F.col("doc_id").alias("item_id"), answer.alias("answer")))
