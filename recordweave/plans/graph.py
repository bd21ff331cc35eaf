"""Convergence and funding graph queries.

An order is an item, its suppliers are the entities, the market segment is the
desk and the order date is the day.
"""

from pyspark.sql import functions as F


from recordweave.operators import funding, graph
from recordweave.operators.common import dealt
from recordweave.plans import sqltext as sq
from recordweave.plans.registry import query
from recordweave.session import stage

AS_OF = "2001-08-01"
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def members(t):
    rows = t.lineitem.count()
    orders = dealt(t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")), rows, "o_orderkey")
    return dealt(t.lineitem, rows, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("item"), F.col("c_mktsegment").alias("desk"),
        F.col("o_orderdate").cast("date").alias("at"), F.col("l_suppkey").alias("entity"),
    )


def edges(t, as_of=AS_OF):
    m = members(t).filter(F.col("at") <= F.lit(as_of).cast("date"))
    return graph.convergence_edges(m, as_of, SEGMENTS)


def shown(e):
    """Flat columns: lists as text, dates as text."""
    return e.withColumn("desks", F.array_join("desks", ",")).withColumn("last_seen", F.col("last_seen").cast("string"))


MEMBERS = """members AS (
  SELECT o_orderkey AS item, c_mktsegment AS desk, CAST(o_orderdate AS DATE) AS dt, l_suppkey AS entity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def edges_sql(name="edges", as_of=AS_OF):
    weight = "w * CASE WHEN x THEN 2.0 ELSE 1.0 END"
    return f"""{name}_pairs AS (
      SELECT DISTINCT l.item, l.desk, l.dt, l.entity AS a, r.entity AS b
      FROM members l JOIN members r ON l.item = r.item AND l.entity < r.entity
      WHERE l.dt <= DATE '{as_of}'),
    {name}_raw AS (
      SELECT a, b, sum(pow(0.5, greatest(0, date_diff('day', dt, DATE '{as_of}')) / 30.0)) AS w,
             count(*) AS co_count, string_agg(DISTINCT desk, ',' ORDER BY desk) AS desks,
             count(DISTINCT desk) > 1 AS x, max(dt) AS last_seen
      FROM {name}_pairs GROUP BY a, b),
    {name} AS (
      SELECT a AS from_id, b AS to_id, round({weight}, 6) AS weight, round(1 - pow(0.5, {weight}), 6) AS confidence,
             co_count, desks, x AS cross_desk, CAST(last_seen AS VARCHAR) AS last_seen
      FROM {name}_raw WHERE {weight} >= 1.5)"""


WITH_EDGES = f"WITH {MEMBERS}, {edges_sql()}"


@query("co_pairs", f"""WITH {MEMBERS}
SELECT DISTINCT l.item, l.desk, CAST(l.dt AS VARCHAR) AS "at", l.entity AS a, r.entity AS b
FROM members l JOIN members r ON l.item = r.item AND l.entity < r.entity""")
def co_pairs(t):
    return graph.co_pairs(members(t)).withColumn("at", F.col("at").cast("string"))


@query("convergence_edges", f"{WITH_EDGES} SELECT * FROM edges")
def convergence_edges(t):
    return shown(edges(t))


# names with families: "GROUP 7", "GROUP 7 SYSTEMS", "GROUP 7 Corp /DE/"
_NAME = "concat('Group ', s_suppkey % 30, CASE s_suppkey % 3 WHEN 0 THEN ' Corp /DE/' WHEN 1 THEN ' Systems, Inc.' ELSE '' END)"
_NAMES = f"names AS (SELECT s_suppkey AS entity, {sq.normalize_mention(_NAME)} AS n FROM supplier)"
_SAME = "(f.n = g.n OR (contains(f.n, ' ') AND starts_with(g.n || ' ', f.n || ' ')) OR (contains(g.n, ' ') AND starts_with(f.n || ' ', g.n || ' ')))"


def supplier_names(t):
    return t.supplier.select(F.col("s_suppkey").alias("entity"), F.expr(_NAME).alias("name"))


@query("self_company_edges", f"""{WITH_EDGES}, {_NAMES}
SELECT from_id, to_id, weight, f.n AS from_name, g.n AS to_name
FROM edges JOIN names f ON f.entity = from_id JOIN names g ON g.entity = to_id WHERE {_SAME}""")
def self_company_edges(t):
    return graph.self_company_edges(edges(t), supplier_names(t)).select(
        "from_id", "to_id", "weight", "from_name", "to_name"
    )


@query("edges_without_self", f"""{WITH_EDGES}, {_NAMES}
SELECT e.* FROM edges e JOIN names f ON f.entity = from_id JOIN names g ON g.entity = to_id WHERE NOT {_SAME}""")
def edges_without_self(t):
    return shown(graph.drop_self_company(edges(t), supplier_names(t)))


@query("edge_scd2", f"""WITH {MEMBERS}, {edges_sql("live", "2001-05-01")}, {edges_sql("want", AS_OF)}
SELECT coalesce(l.from_id, w.from_id) AS from_id, coalesce(l.to_id, w.to_id) AS to_id,
       'CONVERGES_WITH' AS edge_type,
       CASE WHEN w.from_id IS NULL THEN l.weight ELSE w.weight END AS weight,
       CASE WHEN w.from_id IS NULL THEN l.confidence ELSE w.confidence END AS confidence,
       CASE WHEN l.from_id IS NULL THEN '{AS_OF}' ELSE '2001-05-01' END AS valid_from,
       CASE WHEN w.from_id IS NULL THEN '{AS_OF}' END AS valid_to,
       CASE WHEN w.from_id IS NULL THEN 'retired' WHEN l.from_id IS NULL THEN 'inserted' ELSE 'refreshed' END AS action
FROM live l FULL JOIN want w ON l.from_id = w.from_id AND l.to_id = w.to_id""")
def edge_scd2(t):
    def typed(e):
        return e.select("from_id", "to_id", F.lit("CONVERGES_WITH").alias("edge_type"), "weight", "confidence")

    live = typed(edges(t, "2001-05-01")).withColumn("valid_from", F.lit("2001-05-01"))
    return graph.scd2_edges(live, typed(edges(t)), F.lit(AS_OF))


_REF, _LIVE_AT = "2000-01-01", "2001-05-01"
_KEPT_EDGES = "SELECT e.* FROM {name} e JOIN names f ON f.entity = from_id JOIN names g ON g.entity = to_id WHERE NOT {same}"


@query("edge_scd2_incremental", f"""WITH {MEMBERS}, {_NAMES}, {edges_sql("old", _LIVE_AT)}, {edges_sql("new", AS_OF)},
live AS ({_KEPT_EDGES.format(name='old', same=_SAME)}), want AS ({_KEPT_EDGES.format(name='new', same=_SAME)})
SELECT coalesce(l.from_id, w.from_id) AS from_id, coalesce(l.to_id, w.to_id) AS to_id, 'CONVERGES_WITH' AS edge_type,
       CASE WHEN w.from_id IS NULL THEN l.weight ELSE w.weight END AS weight,
       CASE WHEN w.from_id IS NULL THEN l.confidence ELSE w.confidence END AS confidence,
       CASE WHEN l.from_id IS NULL THEN '{AS_OF}' ELSE '{_LIVE_AT}' END AS valid_from,
       CASE WHEN w.from_id IS NULL THEN '{AS_OF}' END AS valid_to,
       CASE WHEN w.from_id IS NULL THEN 'retired' WHEN l.from_id IS NULL THEN 'inserted' ELSE 'refreshed' END AS action
FROM live l FULL JOIN want w ON l.from_id = w.from_id AND l.to_id = w.to_id""")
def edge_scd2_incremental(t):
    """State of an earlier run, merged with the items since then; the open rows are those of that run."""
    every, names = members(t), supplier_names(t)
    at, day = F.col("at"), lambda d: F.lit(d).cast("date")
    stored = graph.pair_state(every.filter(at <= day(_LIVE_AT)), _REF, SEGMENTS)
    fresh = graph.pair_state(every.filter((at > day(_LIVE_AT)) & (at <= day(AS_OF))), _REF, SEGMENTS)
    live = graph.drop_self_company(graph.edges_of_state(stored, _LIVE_AT, _REF, SEGMENTS), names).select(
        "from_id", "to_id", F.lit("CONVERGES_WITH").alias("edge_type"), "weight", "confidence", F.lit(_LIVE_AT).alias("valid_from")
    )
    return graph.upsert_edges(live, graph.merge_pair_states(stored, fresh), names, AS_OF, _REF, SEGMENTS, F.lit(AS_OF))


@query("edges_as_of_dates", """WITH e AS (SELECT CAST(l_shipdate AS DATE) AS a, CASE WHEN l_returnflag <> 'A' THEN CAST(l_shipdate AS DATE) + CAST(l_quantity * 9 AS INT) END AS b,
  CAST(l_shipdate AS DATE) + l_linenumber * 5 AS known FROM lineitem),
d AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS d FROM orders)
SELECT CAST(d AS VARCHAR) AS date, count(*) AS edges, count(*) FILTER (b IS NULL) AS open_edges
FROM e JOIN d ON a <= d AND (b IS NULL OR b > d) AND known <= d GROUP BY d""")
def edges_as_of_dates(t):
    start = F.col("l_shipdate").cast("date")
    rows = t.lineitem.select(
        start.alias("valid_from"), F.when(F.col("l_returnflag") != "A", F.date_add(start, (F.col("l_quantity") * 9).cast("int"))).alias("valid_to"),
        F.date_add(start, (F.col("l_linenumber") * 5).cast("int")).alias("transaction_time"),
    )
    dates = t.orders.select(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("date")).distinct()
    out = graph.edges_as_of_dates(rows, dates).groupBy("date").agg(
        F.count("*").alias("edges"), F.count_if(F.col("valid_to").isNull()).alias("open_edges")
    )
    return out.withColumn("date", F.col("date").cast("string"))


@query("edges_as_of", """SELECT l_orderkey AS from_id, l_suppkey AS to_id, l_linenumber,
       CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS valid_from
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-06-01'
  AND (l_returnflag = 'A' OR l_shipdate + INTERVAL 90 DAY > TIMESTAMP '1998-06-01')
  AND l_shipdate + INTERVAL 2 DAY <= TIMESTAMP '1998-05-15'""")
def edges_as_of(t):
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("from_id"), F.col("l_suppkey").alias("to_id"), "l_linenumber",
        F.col("l_shipdate").alias("valid_from"),
        F.when(F.col("l_returnflag") != "A", F.col("l_shipdate") + F.expr("INTERVAL 90 DAYS")).alias("valid_to"),
        (F.col("l_shipdate") + F.expr("INTERVAL 2 DAYS")).alias("transaction_time"),
    )
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return graph.edges_as_of(rows, at("1998-06-01 00:00:00"), at("1998-05-15 00:00:00")).select(
        "from_id", "to_id", "l_linenumber", F.col("valid_from").cast("date").cast("string").alias("valid_from")
    )


_FILTERED = f"""confidence >= 0.7 AND cross_desk AND contains(',' || desks || ',', ',BUILDING,')
  AND CAST(last_seen AS DATE) >= DATE '{AS_OF}' - 60"""


@query("graph_edges_topn", f"{WITH_EDGES} SELECT * FROM edges WHERE {_FILTERED} "
       "ORDER BY confidence DESC, weight DESC, from_id, to_id LIMIT 100")
def graph_edges_topn(t):
    kept = graph.filter_edges(edges(t), 0.7, cross_desk_only=True, desk="BUILDING", days=60, as_of=AS_OF)
    return shown(graph.strongest_edges(kept, 100))


def awards(t):
    """Award rows: line items as awards of the customer's nation to the supplier."""
    rows = t.lineitem.count()
    buyers = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(
        t.nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    buyers = dealt(buyers, rows, "o_orderkey")
    return dealt(t.lineitem, rows, "l_orderkey").join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit(" uei"), F.col("l_suppkey").cast("string"), F.lit(" ")).alias("recipient_uei"),
        F.col("n_name").alias("awarding_agency"), F.col("l_extendedprice").alias("amount_usd"),
        F.col("l_shipdate").cast("date").cast("string").alias("start_date"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("native_id"),
    )


def recipients(t):
    """Suppliers we know; every tenth is not in the reference set."""
    return t.supplier.filter("s_suppkey % 10 <> 0").select(
        F.concat(F.lit("UEI"), F.col("s_suppkey").cast("string")).alias("uei"), F.col("s_suppkey").alias("entity")
    )


_AWARDS = """awards AS (
  SELECT l_suppkey AS entity, n_name AS agency, l_extendedprice AS usd, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS start_date,
         l_orderkey || '-' || l_linenumber AS native_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_suppkey = l_suppkey)"""
_FUNDING = """(SELECT agency, entity, round(sum(usd), 2) AS total_usd, CAST(count(*) AS BIGINT) AS award_count,
   max(start_date) AS last_award FROM {source} WHERE entity % 10 <> 0 GROUP BY agency, entity)"""


@query("funding_edges", f"WITH {_AWARDS} SELECT * FROM {_FUNDING.format(source='awards')}")
def funding_edges(t):
    return funding.funding_edges(awards(t), recipients(t))


@query("funding_edges_latest", f"""WITH {_AWARDS}, latest AS (
  SELECT * FROM awards QUALIFY row_number() OVER (PARTITION BY native_id ORDER BY start_date DESC, usd DESC) = 1)
SELECT * FROM {_FUNDING.format(source='latest')}""")
def funding_edges_latest(t):
    newest = funding.latest_awards(awards(t), "native_id", "start_date", "amount_usd")
    return funding.funding_edges(newest, recipients(t))


@query("funding_topn", f"WITH {_AWARDS} SELECT * FROM {_FUNDING.format(source='awards')} "
       "ORDER BY total_usd DESC NULLS LAST, agency, entity LIMIT 60")
def funding_topn(t):
    return funding.top_funding(funding_edges(t))


_OLD = "(SELECT * FROM awards WHERE start_date < '1998-06-01')"
_NEW = "(SELECT * FROM awards WHERE start_date >= '1996-01-01')"


@query("funding_scd2", f"""WITH {_AWARDS}, live AS {_FUNDING.format(source=_OLD)}, want AS {_FUNDING.format(source=_NEW)}
SELECT sha256('gov_agency:' || coalesce(l.agency, w.agency)) AS from_id, coalesce(l.entity, w.entity)::VARCHAR AS to_id, 'FUNDS' AS edge_type,
       coalesce(l.agency, w.agency) AS agency, coalesce(w.total_usd, l.total_usd) AS total_usd, coalesce(w.award_count, l.award_count) AS award_count,
       coalesce(w.last_award, l.last_award) AS last_award, CASE WHEN l.agency IS NULL THEN '{AS_OF}' ELSE '2001-05-01' END AS valid_from,
       CASE WHEN w.agency IS NULL THEN '{AS_OF}' END AS valid_to,
       CASE WHEN w.agency IS NULL THEN 'retired' WHEN l.agency IS NULL THEN 'inserted' ELSE 'refreshed' END AS action
FROM live l FULL JOIN want w ON l.agency = w.agency AND l.entity = w.entity""")
def funding_scd2(t):
    old, new = (funding.funding_edges(awards(t).filter(rule), recipients(t)) for rule in ("start_date < '1998-06-01'", "start_date >= '1996-01-01'"))
    live = funding.typed_edges(old).withColumn("valid_from", F.lit("2001-05-01"))
    return graph.scd2_edges(live, funding.typed_edges(new), F.lit(AS_OF))


_TOP = f"""{WITH_EDGES}, {_AWARDS}, top AS (
  SELECT * FROM edges ORDER BY confidence DESC, weight DESC, from_id, to_id LIMIT 100),
fund AS (SELECT * FROM {_FUNDING.format(source='awards')} ORDER BY total_usd DESC NULLS LAST, agency, entity LIMIT 60)"""


def top_view(t):
    return graph.strongest_edges(edges(t), 100), funding.top_funding(funding_edges(t))


def funding_as_edges(fund):
    return fund.select(
        F.col("agency").alias("from_id"), F.col("entity").cast("string").alias("to_id"), F.lit("awarded").alias("type"),
        F.col("total_usd").alias("amount_usd"), "award_count",
    )


@query("graph_edges_all", f"""{_TOP}
SELECT CAST(from_id AS VARCHAR) AS from_id, CAST(to_id AS VARCHAR) AS to_id, 'converges' AS type,
       round(confidence, 4) AS confidence, round(weight, 4) AS weight, co_count, NULL::DOUBLE AS amount_usd,
       NULL::BIGINT AS award_count FROM top
UNION ALL
SELECT agency, CAST(entity AS VARCHAR), 'awarded', NULL, NULL, NULL, total_usd, award_count FROM fund""")
def graph_edges_all(t):
    top, fund = top_view(t)
    converging = top.select(
        F.col("from_id").cast("string").alias("from_id"), F.col("to_id").cast("string").alias("to_id"),
        F.lit("converges").alias("type"), F.round("confidence", 4).alias("confidence"),
        F.round("weight", 4).alias("weight"), "co_count",
    )
    return converging.unionByName(funding_as_edges(fund), allowMissingColumns=True)


@query("graph_nodes", f"""{_TOP}, ends AS (
  SELECT CAST(from_id AS VARCHAR) AS entity FROM top UNION SELECT CAST(to_id AS VARCHAR) FROM top
  UNION SELECT agency FROM fund UNION SELECT CAST(entity AS VARCHAR) FROM fund)
SELECT entity, s_name AS name, CASE WHEN s_name IS NULL THEN 'agency' ELSE 'company' END AS kind
FROM ends LEFT JOIN supplier ON CAST(s_suppkey AS VARCHAR) = entity""")
def graph_nodes(t):
    top, fund = top_view(t)
    both = top.select(F.col("from_id").cast("string"), F.col("to_id").cast("string")).unionByName(
        funding_as_edges(fund).select("from_id", "to_id")
    )
    names = t.supplier.select(F.col("s_suppkey").cast("string").alias("entity"), F.col("s_name").alias("name"))
    return graph.endpoints(both).join(names, "entity", "left").withColumn(
        "kind", F.when(F.col("name").isNull(), "agency").otherwise("company")
    )


@query("graph_meta", f"""{_TOP}, ends AS (
  SELECT CAST(from_id AS VARCHAR) AS entity FROM top UNION SELECT CAST(to_id AS VARCHAR) FROM top
  UNION SELECT agency FROM fund UNION SELECT CAST(entity AS VARCHAR) FROM fund)
SELECT (SELECT count(*) FROM ends) AS node_count, (SELECT count(*) FROM top) + (SELECT count(*) FROM fund) AS edge_count,
       (SELECT count(*) FROM top WHERE cross_desk) AS cross_desk_edges, (SELECT count(*) FROM fund) AS funding_edges""")
def graph_meta(t):
    top, fund = top_view(t)
    text = top.withColumn("from_id", F.col("from_id").cast("string")).withColumn("to_id", F.col("to_id").cast("string"))
    return graph.graph_meta(text, funding_as_edges(fund))


@query("node_degree", f"""{WITH_EDGES} SELECT entity, count(*) AS degree FROM (
  SELECT from_id AS entity FROM edges UNION ALL SELECT to_id FROM edges) GROUP BY entity""")
def node_degree(t):
    return graph.node_degree(edges(t))


@query("edge_context", f"""{WITH_EDGES} SELECT * FROM edges WHERE from_id % 7 = 0 OR to_id % 7 = 0
ORDER BY last_seen DESC, confidence DESC, from_id, to_id LIMIT 50""")
def edge_context(t):
    wanted = t.supplier.filter("s_suppkey % 7 = 0").select(F.col("s_suppkey").alias("entity"))
    return shown(graph.edge_context(edges(t), wanted, newest="last_seen"))


@query("one_hop", """SELECT l_suppkey AS from_id, l_partkey AS to_id, l_orderkey AS source_record, p_name AS name
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R'""")
def one_hop(t):
    supplies = t.lineitem.select(
        F.col("l_suppkey").alias("from_id"), F.col("l_partkey").alias("to_id"), F.col("l_orderkey").alias("source_record"),
        F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("valid_to"),
    )
    nodes = t.part.select(F.col("p_partkey").alias("entity"), F.col("p_name").alias("name"))
    return graph.one_hop(supplies, nodes).drop("valid_to")


@query("one_hop_typed", """SELECT l_suppkey AS from_id, l_partkey AS to_id, 'SUPPLIES' AS edge_type, l_orderkey AS source_record, p_name AS name
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R' AND l_linenumber % 2 = 1""")
def one_hop_typed(t):
    supplies = t.lineitem.select(
        F.col("l_suppkey").alias("from_id"), F.col("l_partkey").alias("to_id"),
        F.when(F.col("l_linenumber") % 2 == 1, "SUPPLIES").otherwise("SHIPS").alias("edge_type"), F.col("l_orderkey").alias("source_record"),
        F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("valid_to"),
    )
    nodes = t.part.select(F.col("p_partkey").alias("entity"), F.col("p_name").alias("name"))
    return graph.one_hop(supplies, nodes, "SUPPLIES").drop("valid_to")


@query("edge_context_recorded", """WITH w AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 7 = 0),
e AS (SELECT l_suppkey AS from_id, l_partkey AS to_id, 'S' || l_linenumber AS edge_type, l_discount AS confidence,
  CAST(CAST(l_shipdate AS DATE) - CAST(l_orderkey % 900 AS INT) AS VARCHAR) AS transaction_time FROM lineitem)
SELECT * FROM e WHERE from_id IN (SELECT k FROM w) OR to_id IN (SELECT k FROM w)
ORDER BY transaction_time DESC, confidence DESC, from_id, to_id, edge_type LIMIT 50""")
def edge_context_recorded(t):
    """Newest by the time an edge was recorded, whatever it is about."""
    rows = t.lineitem.select(
        F.col("l_suppkey").alias("from_id"), F.col("l_partkey").alias("to_id"), F.concat(F.lit("S"), F.col("l_linenumber").cast("string")).alias("edge_type"),
        F.col("l_discount").alias("confidence"),
        F.date_sub(F.col("l_shipdate").cast("date"), (F.col("l_orderkey") % 900).cast("int")).cast("string").alias("transaction_time"),
    )
    return graph.edge_context(rows, t.supplier.filter("s_suppkey % 7 = 0").select(F.col("s_suppkey").alias("entity")), 50)


@query("pair_evidence", f"""{WITH_EDGES}, asked AS (
  SELECT from_id, to_id FROM edges ORDER BY confidence DESC, weight DESC, from_id, to_id LIMIT 100)
SELECT from_id, to_id, item, desk, CAST(dt AS VARCHAR) AS "at", headline, rank FROM (
  SELECT p.a AS from_id, p.b AS to_id, p.item, p.desk, p.dt, o_orderpriority AS headline,
         row_number() OVER (PARTITION BY p.a, p.b ORDER BY p.dt DESC, p.item) AS rank
  FROM edges_pairs p JOIN asked ON a = from_id AND b = to_id JOIN orders ON o_orderkey = p.item) WHERE rank <= 12""")
def pair_evidence(t):
    items = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("item"), F.col("c_mktsegment").alias("desk"),
        F.col("o_orderdate").cast("date").alias("at"), F.col("o_orderpriority").alias("headline"),
    )
    pairs = stage(graph.strongest_edges(edges(t), 100), "asked")
    out = graph.pair_evidence(members(t).select("item", "entity"), items, pairs)
    return out.select("from_id", "to_id", "item", "desk", F.col("at").cast("string").alias("at"), "headline", "rank")


