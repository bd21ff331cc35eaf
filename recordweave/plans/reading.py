"""Reader-side queries: briefs, entity pages, archives, glance figures, page hosts."""

from pyspark.sql import functions as F

from recordweave.functions import html, text as tx
from recordweave.operators import reading
from recordweave.plans import sqltext as sq
from recordweave.plans.graph import MEMBERS, members
from recordweave.plans.registry import query

AS_OF = "2001-08-01"
_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'pending' ELSE 'failed' END"


def day(c):
    return F.col(c).cast("date").cast("string")


def briefs(t, desk="o_orderpriority"):
    return t.orders.select(
        F.col("o_orderkey").alias("brief_id"), F.col(desk).alias("desk"), F.col("o_orderdate").cast("date").alias("date"),
        F.expr(_STATUS).alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("published_at"),
    )


@query("latest_with_fallback", f"""WITH b AS (SELECT o_orderkey AS brief_id, o_orderpriority AS desk, o_orderdate AS d, {_STATUS} AS status FROM orders),
n AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY desk ORDER BY d DESC, brief_id DESC) = 1),
p AS (SELECT * FROM b WHERE status = 'published' QUALIFY row_number() OVER (PARTITION BY desk ORDER BY d DESC, brief_id DESC) = 1)
SELECT p.desk, CASE WHEN n.status = 'published' THEN n.brief_id ELSE p.brief_id END AS brief_id, n.status AS current_status,
  CASE WHEN n.status <> 'published' THEN CAST(CAST(p.d AS DATE) AS VARCHAR) END AS last_updated,
  CASE n.status WHEN 'pending' THEN 'Today''s brief is being generated. Showing last published brief.'
    WHEN 'failed' THEN 'Today''s brief failed generation. Showing last published brief.' END AS note
FROM p JOIN n ON n.desk = p.desk""")
def latest_with_fallback(t):
    return reading.latest_with_fallback(briefs(t)).withColumn("last_updated", day("last_updated"))


@query("latest_wire", f"""WITH p AS (SELECT o_orderkey AS brief_id, o_orderpriority AS desk, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus = 'F'
  QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderdate DESC, o_orderkey DESC) = 1)
SELECT desk, CAST(d AS VARCHAR) AS date, brief_id, l_linenumber - 1 AS display_order, l_linestatus || l_returnflag AS headline
FROM lineitem JOIN p ON l_orderkey = brief_id""")
def latest_wire(t):
    wire = t.lineitem.select(
        F.col("l_orderkey").alias("brief_id"), (F.col("l_linenumber") - 1).alias("display_order"), F.concat("l_linestatus", "l_returnflag").alias("headline")
    )
    return reading.latest_wire(briefs(t), wire).withColumn("date", day("date"))


@query("archive_gate", f"""WITH r AS (SELECT c_custkey AS user_id, CASE WHEN c_acctbal > 5000 THEN 'pro' ELSE 'free' END AS tier,
  ['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW'][c_custkey % 5 + 1] AS desk FROM customer),
b AS (SELECT DISTINCT tier, o_orderkey AS brief_id, o_orderpriority AS desk, CAST(o_orderdate AS DATE) AS date
  FROM orders JOIN (SELECT DISTINCT desk, tier FROM r) k ON k.desk = o_orderpriority
  WHERE o_orderstatus = 'F' AND CAST(o_orderdate AS DATE) >= DATE '{AS_OF}' - CASE WHEN tier = 'pro' THEN 90 ELSE 0 END),
top AS (SELECT *, row_number() OVER (PARTITION BY desk, tier ORDER BY date DESC, brief_id) AS rank FROM b QUALIFY rank <= 20)
SELECT user_id, tier, desk, brief_id, CAST(date AS VARCHAR) AS date, rank FROM r JOIN top USING (desk, tier)""")
def archive_gate(t):
    desks = F.array(*[F.lit(d) for d in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])
    readers = t.customer.select(
        F.col("c_custkey").alias("user_id"), F.when(F.col("c_acctbal") > 5000, "pro").otherwise("free").alias("tier"),
        F.element_at(desks, (F.col("c_custkey") % 5 + 1).cast("int")).alias("desk"),
    )
    out = reading.archive_gate(readers, briefs(t), AS_OF)
    return out.select("user_id", "tier", "desk", "brief_id", day("date").alias("date"), "rank")


@query("calendar_range", """SELECT o_orderkey AS event_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS event_date,
  CASE WHEN o_orderkey % 3 <> 0 THEN lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':00' END AS event_time
FROM orders WHERE (o_orderpriority = '2-HIGH' OR o_orderkey % 10 = 0) AND CAST(o_orderdate AS DATE) BETWEEN DATE '2001-05-01' AND DATE '2001-07-31'
ORDER BY CAST(o_orderdate AS DATE), event_time NULLS LAST, o_orderkey LIMIT 200""")
def calendar_range(t):
    hour = F.concat(F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit(":00"))
    events = t.orders.select(
        F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").cast("date").alias("event_date"),
        F.when(F.col("o_orderkey") % 3 != 0, hour).alias("event_time"),
        F.array_compact(F.array("o_orderpriority", F.when(F.col("o_orderkey") % 10 == 0, "2-HIGH"))).alias("desk"),
    )
    out = reading.calendar_range(events, "2001-05-01", "2001-07-31", desk="2-HIGH")
    return out.select("event_id", day("event_date").alias("event_date"), "event_time")


def entities(t):
    return t.supplier.select(
        F.col("s_suppkey").alias("entity"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 13 != 0).alias("is_active")
    )


def identifiers(t):
    k = F.col("s_suppkey")
    text = k.cast("string")
    ids = F.array_compact(
        F.array(
            F.when(k % 2 == 0, F.struct(F.lit("ticker").alias("id_type"), F.concat(F.lit("T"), text).alias("id_value"))),
            F.when(k % 4 == 0, F.struct(F.lit("ticker").alias("id_type"), F.concat(F.lit("A"), text).alias("id_value"))),
            F.struct(F.lit("cik").alias("id_type"), F.lpad(text, 10, "0").alias("id_value")),
        )
    )
    return t.supplier.select(k.alias("entity"), F.explode(ids).alias("i"), F.lit(None).cast("date").alias("valid_to")).select(
        "entity", "i.*", "valid_to"
    )


def published_members(t):
    shown = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("item"))
    return members(t).join(shown, "item").distinct()


_PUB = f"""{MEMBERS}, pub AS (SELECT DISTINCT m.* FROM members m JOIN orders ON o_orderkey = item WHERE o_orderstatus = 'F'),
ent AS (SELECT s_suppkey AS entity, s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'A' || s_suppkey WHEN s_suppkey % 2 = 0 THEN 'T' || s_suppkey END AS ticker,
  CASE WHEN s_suppkey % 4 = 0 THEN 'cik:' || lpad(CAST(s_suppkey AS VARCHAR), 10, '0') || ';ticker:A' || s_suppkey || ';ticker:T' || s_suppkey
    WHEN s_suppkey % 2 = 0 THEN 'cik:' || lpad(CAST(s_suppkey AS VARCHAR), 10, '0') || ';ticker:T' || s_suppkey
    ELSE 'cik:' || lpad(CAST(s_suppkey AS VARCHAR), 10, '0') END AS identifiers
  FROM supplier WHERE s_suppkey % 13 <> 0)"""


@query("entity_summary", f"""WITH {_PUB}, d AS (SELECT entity, string_agg(DISTINCT desk, ',' ORDER BY desk) AS desks, count(DISTINCT desk) AS n FROM pub GROUP BY entity)
SELECT entity, name, ticker, ticker IS NULL AS is_private, desks, coalesce(n >= 2, false) AS convergence FROM ent LEFT JOIN d USING (entity)""")
def entity_summary(t):
    out = reading.entity_summary(entities(t), identifiers(t), published_members(t))
    return out.select("entity", "name", "ticker", "is_private", F.array_join("desks", ",").alias("desks"), "convergence")


@query("entity_360", f"""WITH {_PUB}, a AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY dt DESC, item) AS rank FROM pub QUALIFY rank <= 25),
s AS (SELECT entity, string_agg(rank || ':' || item || ':' || desk || ':' || CAST(dt AS VARCHAR), ';' ORDER BY rank) AS appearances,
  string_agg(DISTINCT desk, ',' ORDER BY desk) AS recent_desks, count(DISTINCT desk) >= 2 AS c FROM a GROUP BY entity)
SELECT entity, name, ticker, identifiers, appearances, recent_desks, coalesce(c, false) AS convergence FROM ent LEFT JOIN s USING (entity)""")
def entity_360(t):
    out = reading.entity_360(entities(t), identifiers(t), published_members(t))
    seen = lambda a: F.concat_ws(":", a["rank"], a["item"], a["desk"], a["at"].cast("string"))
    ids = lambda i: F.concat_ws(":", i["id_type"], i["id_value"])
    return out.select(
        "entity", "name", "ticker", F.array_join(F.transform("identifiers", ids), ";").alias("identifiers"),
        F.array_join(F.transform("appearances", seen), ";").alias("appearances"),
        F.array_join("recent_desks", ",").alias("recent_desks"), "convergence",
    )


def brief_items(t):
    """Orders as items of their customer's brief."""
    return t.orders.select(
        F.col("o_custkey").alias("brief_id"), F.col("o_orderkey").alias("item_id"), F.col("o_orderkey").alias("display_order"),
        F.col("o_orderpriority").alias("headline"),
    )


def item_members(t):
    return t.lineitem.select(F.col("l_orderkey").alias("item_id"), F.col("l_suppkey").alias("entity"))


@query("brief_assembled", """SELECT o_custkey AS brief_id, o_orderkey AS item_id, o_orderkey AS display_order, 'item' AS part,
  CAST(o_orderkey AS VARCHAR) AS ref, o_orderpriority AS label FROM orders
UNION ALL SELECT DISTINCT o_custkey, o_orderkey, o_orderkey, 'citation', l_linenumber || '/' || l_partkey, NULL FROM lineitem JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT DISTINCT o_custkey, o_orderkey, o_orderkey, 'chip', CAST(l_suppkey AS VARCHAR), s_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN supplier ON s_suppkey = l_suppkey WHERE s_suppkey % 13 <> 0""")
def brief_assembled(t):
    cites = t.lineitem.select(
        F.col("l_orderkey").alias("item_id"), F.concat_ws("/", "l_linenumber", "l_partkey").alias("citation_id")
    )
    chips = entities(t).filter("is_active").select("entity", "name")
    return reading.assemble_briefs(brief_items(t), cites, item_members(t), chips)


@query("followed_items", """SELECT DISTINCT s_nationkey AS user_id, l_orderkey AS item FROM lineitem JOIN supplier ON s_suppkey = l_suppkey""")
def followed_items(t):
    follows = t.supplier.select(F.col("s_nationkey").alias("user_id"), F.col("s_suppkey").alias("entity"))
    return reading.followed_items(item_members(t).withColumnRenamed("item_id", "item"), follows)


# texts with figures, rendered from orders
_HEAD = "CASE o_orderkey % 3 WHEN 0 THEN concat('Award of $', CAST(floor(o_totalprice / 1000) AS BIGINT), '.5 million to ', o_orderpriority) WHEN 1 THEN 'Weekly update' ELSE concat('Market size of $', o_orderkey % 900 + 1, 'bn projected') END"
_BODY = "CASE o_orderkey % 4 WHEN 0 THEN concat('Spending of $', o_orderkey % 70 + 2, ' billion is needed across the sector by 2030.') WHEN 1 THEN concat('It paid $', o_orderkey % 500 + 1, ',000 and $', o_orderkey % 90 + 1, 'K at ', o_orderkey % 40, '.5%.') WHEN 2 THEN 'No figures here.' ELSE concat('Deal closed on May ', o_orderkey % 28 + 1, ', 2026 for $', o_orderkey % 800 + 10, ' m.') END"


def figure_texts(t):
    return t.orders.select(
        F.col("o_custkey").alias("brief_id"), F.col("o_orderkey").alias("item_id"),
        F.expr(_HEAD).alias("headline"), F.expr(_BODY).alias("body"),
    )


FIGURES = f"""fig AS (SELECT o_custkey AS brief_id, o_orderkey AS item_id, {_HEAD} AS headline, {_BODY} AS body FROM orders),
amt AS (SELECT *, {sq.amounts('headline')} AS ha, {sq.amounts('body')} AS ba FROM fig),
typed AS (SELECT brief_id, item_id, coalesce(ha[1], list_max(ba)) AS amount,
  CASE WHEN len(ha) > 0 THEN CASE WHEN headline LIKE '%projected%' THEN 'projected' ELSE 'tracked' END
       WHEN len(ba) > 0 THEN CASE WHEN body LIKE '%by 2030%' THEN 'projected' ELSE 'tracked' END END AS kind FROM amt)"""


@query("glance", f"""WITH {FIGURES}, tot AS (SELECT brief_id, count(*) AS items, coalesce(sum(amount) FILTER (kind = 'tracked'), 0.0) AS tracked_usd,
  coalesce(max(amount) FILTER (kind = 'tracked'), 0.0) AS max_usd FROM typed GROUP BY brief_id)
SELECT brief_id, item_id, amount, kind, items, tracked_usd, max_usd, round(coalesce(amount / nullif(max_usd, 0), 0.0), 6) AS share
FROM typed JOIN tot USING (brief_id)""")
def glance(t):
    return reading.glance(figure_texts(t)).withColumn("share", F.round("share", 6))


def page_citations(t):
    k = F.col("page_id")
    plus = lambda start, n: F.date_add(F.lit(start).cast("date"), n.cast("int"))
    return t.pages.select(
        F.floor(k / 6).alias("item_id"), F.floor(k / 60).alias("brief_id"), k.alias("position"), "url",
        F.when((k % 3 == 0) & (F.floor(k / 6) % 4 != 0), plus("2024-01-01", k % 28)).alias("published_at"),
        plus("2024-03-01", k % 60).alias("fetched_at"),
    )


_CITES = f"""cites AS (SELECT page_id // 6 AS item_id, page_id // 60 AS brief_id, page_id AS position, {sq.host('url')} AS host,
  CASE WHEN page_id % 3 = 0 AND page_id // 6 % 4 <> 0 THEN DATE '2024-01-01' + CAST(page_id % 28 AS INT) END AS p,
  DATE '2024-03-01' + CAST(page_id % 60 AS INT) AS f FROM pages),
firsts AS (SELECT item_id, host, min(position) AS position FROM cites WHERE host <> '' GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY position, host) AS r, count(*) OVER (PARTITION BY item_id) AS n FROM firsts),
named AS (SELECT item_id, string_agg(host, ', ' ORDER BY r) || CASE WHEN max(n) > 2 THEN ' +' || (max(n) - 2) ELSE '' END AS outlets
  FROM ranked WHERE r <= 2 GROUP BY item_id)"""


@query("source_summary", f"""WITH {_CITES} SELECT item_id, coalesce(any_value(outlets), '') AS outlets,
  CASE WHEN max(p) IS NOT NULL THEN 'Published ' || strftime(max(p), '%-m/%-d/%Y') ELSE 'Retrieved ' || strftime(max(f), '%-m/%-d/%Y') END AS date_label
FROM cites LEFT JOIN named USING (item_id) GROUP BY item_id""")
def source_summary(t):
    return reading.source_summary(page_citations(t))


@query("distinct_outlets", f"WITH {_CITES} SELECT brief_id, count(DISTINCT host) AS outlets FROM cites WHERE host <> '' GROUP BY brief_id")
def distinct_outlets(t):
    return reading.distinct_outlets(page_citations(t))


@query("subscription_state", """WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'cancelled'
    ELSE ['active', 'trialing', 'past_due', 'cancelled', 'active'][event_id % 5 + 1] END AS status,
  CASE WHEN event_id % 2 = 0 THEN CAST(CAST(ts AS DATE) AS VARCHAR) END AS period_end,
  CASE WHEN event_id % 4 = 0 THEN 'https://pay.example/' || event_id END AS portal_url FROM events)
SELECT user_id, arg_max(status, event_id) AS status,
  (SELECT period_end FROM e x WHERE x.event_id = max(e.event_id)) AS period_end,
  arg_max(portal_url, event_id) FILTER (portal_url IS NOT NULL) AS portal_url,
  CASE WHEN arg_max(status, event_id) IN ('active', 'trialing') THEN 'pro' ELSE 'free' END AS tier
FROM e GROUP BY user_id""")
def subscription_state(t):
    raw = F.array(*[F.lit(s) for s in ("active", "on_trial", "unpaid", "paused", "something new")])
    k = F.col("event_id")
    log = t.events.select(
        "user_id", k.alias("seq"), F.when(F.col("event_type") == "error", "subscription_expired").otherwise("subscription_updated").alias("event_name"),
        F.element_at(raw, (k % 5 + 1).cast("int")).alias("status"), F.when(k % 2 == 0, day("ts")).alias("period_end"),
        F.when(k % 4 == 0, F.concat(F.lit("https://pay.example/"), k.cast("string"))).alias("portal_url"),
    )
    return reading.subscription_state(log)


@query("url_host", f"SELECT page_id, {sq.host('url')} AS host FROM pages")
def url_host(t):
    return t.pages.select("page_id", tx.url_host(F.col("url")).alias("host"))


_TAGLESS = sq.squash("regexp_replace(html, '<[^>]+>', ' ', 'g')")


@query("tag_strip", f"SELECT page_id, md5({_TAGLESS}) AS digest FROM pages")
def tag_strip(t):
    return t.pages.select("page_id", F.md5(tx.drop_tags(F.col("html"))).alias("digest"))


_PAGE = """regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>', ' ', 'g'),
  '(?s)<!--.*?-->', ' ', 'g'), '<[A-Za-z/!?][^>]*(>|$)', ' ', 'g')"""
for _name, _char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
    _PAGE = f"replace({_PAGE}, '{_name}', '{_char}')"


@query("html_text", f"SELECT page_id, trim(regexp_replace({_PAGE}, '\\s+', ' ', 'g')) AS text FROM pages")
def html_text(t):
    return t.pages.select("page_id", html.html_text(F.col("html")).alias("text"))


