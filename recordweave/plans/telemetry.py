"""Run log, momentum, health and quality queries over events, orders and customers."""

from pyspark.sql import functions as F

from recordweave.functions import text as tx
from recordweave.operators import ingest, telemetry
from recordweave.plans.graph import MEMBERS
from recordweave.plans.registry import query

NOW = "2024-01-31 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def runs(t):
    failed = F.col("event_type") == "error"
    return t.events.select(
        F.col("user_id").alias("source_id"), F.col("ts").alias("at"), F.col("ts").alias("started_at"),
        F.col("event_id").alias("seq"), F.col("event_id").alias("run_id"), failed.alias("failed"),
        F.when(failed, "failed").otherwise("success").alias("status"), F.col("props").alias("error_message"), "event_type",
        F.when(failed, 0).otherwise(F.get_json_object("props", "$.k").cast("int")).alias("records_new"),
    )


@query("latest_run", """SELECT user_id AS source_id, event_id AS run_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_run(t):
    return telemetry.latest_run(runs(t)).select("source_id", "run_id", "event_type")


BREAKER = """brk AS (SELECT e.user_id AS source_id, count(*) FILTER (f) AS failures, max(ts) FILTER (f) AS last FROM (
  SELECT *, event_type = 'error' AND coalesce((ts, event_id) > max((ts, event_id)) FILTER (event_type <> 'error') OVER (PARTITION BY user_id), true) AS f
  FROM events) e GROUP BY 1)"""


@query("failure_streak", f"""WITH {BREAKER} SELECT source_id, failures, CASE WHEN failures >= 2 THEN 'open' ELSE 'closed' END AS state,
  CASE WHEN failures >= 2 THEN strftime(last, '%Y-%m-%d %H:%M:%S') END AS opened_at,
  coalesce(failures >= 2 AND TIMESTAMP '{NOW}' < last + INTERVAL 30 MINUTE, false) AS blocked FROM brk""")
def failure_streak(t):
    out = telemetry.breaker_state(runs(t), now(), threshold=2)
    return out.withColumn("opened_at", F.date_format("opened_at", "yyyy-MM-dd HH:mm:ss")).withColumn(
        "blocked", F.coalesce("blocked", F.lit(False))
    )


@query("source_stale", f"""SELECT user_id AS source_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events
GROUP BY user_id HAVING max(ts) < TIMESTAMP '{NOW}' - INTERVAL 30 HOUR""")
def source_stale(t):
    out = telemetry.source_stale(runs(t), now())
    return out.withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss"))


@query("cursor_table", "SELECT user_id AS source_id, CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS last_date FROM events GROUP BY user_id")
def cursor_table(t):
    out = telemetry.cursors(runs(t), "source_id", "at")
    return out.withColumn("last_date", F.col("last_date").cast("string"))


def themes(t):
    bucket = (F.col("user_id") % 10).cast("string")
    return t.events.select(F.concat_ws("-", "event_type", bucket).alias("theme"), "ts")


_MOVES = """vol AS (SELECT event_type || '-' || (user_id % 10) AS theme, CAST(ts AS DATE) AS d, count(*) AS v FROM events GROUP BY ALL),
back AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY d DESC) AS b, count(*) OVER (PARTITION BY theme) AS points FROM vol),
mean AS (SELECT theme, avg(v) FILTER (b <= 7) AS recent, coalesce(avg(v) FILTER (b > 7), 0.0) AS baseline, any_value(points) AS points
  FROM back WHERE b <= 28 GROUP BY theme),
moves AS (SELECT *, CASE WHEN baseline > 0 THEN (recent - baseline) / baseline * 100.0 END AS delta_pct FROM mean),
dirs AS (SELECT *, CASE WHEN delta_pct >= 25 THEN 'up' WHEN delta_pct <= -25 THEN 'down' END AS direction FROM moves)"""


@query("theme_momentum", f"""WITH {_MOVES} SELECT theme, round(recent, 6) AS recent, round(baseline, 6) AS baseline, points,
  round(delta_pct, 6) AS delta_pct, direction FROM dirs""")
def theme_momentum(t):
    out = telemetry.momentum(telemetry.daily_volume(themes(t)))
    for c in ("recent", "baseline", "delta_pct"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query("signal_line", f"""WITH {_MOVES}, w AS (SELECT *, split_part(theme, '-', 1) AS desk, row_number() OVER (
    PARTITION BY split_part(theme, '-', 1) ORDER BY CAST(split_part(theme, '-', 2) AS INT), theme) AS pos FROM dirs QUALIFY pos <= 6),
n AS (SELECT *, row_number() OVER (PARTITION BY desk ORDER BY pos) AS k,
  theme || ' ' || CASE WHEN direction = 'up' THEN '+' ELSE '' END || CAST(round_even(delta_pct, 0) AS BIGINT) || '%' AS phrase FROM w WHERE direction IS NOT NULL)
SELECT desk, 'Attention: ' || string_agg(phrase, '; ' ORDER BY k) FILTER (k <= 5) || '.' AS line,
  arg_max(theme, (abs(delta_pct), -pos)) AS lead_theme, round(arg_max(delta_pct, (abs(delta_pct), -pos)), 6) AS lead_delta_pct FROM n GROUP BY desk""")
def signal_line(t):
    moves = telemetry.momentum(telemetry.daily_volume(themes(t)))
    named = moves.withColumn("desk", F.substring_index("theme", "-", 1)).withColumn(
        "position", F.substring_index("theme", "-", -1).cast("int")
    )
    return telemetry.signal_line(named, "Attention: ").withColumn("lead_delta_pct", F.round("lead_delta_pct", 6))


@query("exclude_sources", "SELECT doc_id, source FROM documents WHERE source NOT IN ('src1', 'src7')")
def exclude_sources(t):
    return telemetry.exclude_sources(t.documents.select("doc_id", "source"), " src1, ,src7 ", "source")


@query("constraint_report", """SELECT 'order_status' AS rule, CAST(o_orderkey AS VARCHAR) AS row_id FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT 'event_type', CAST(event_id AS VARCHAR) FROM events WHERE event_type NOT IN ('click', 'view', 'signup', 'purchase')
UNION ALL SELECT 'confidence', CAST(event_id AS VARCHAR) FROM events WHERE NOT value / 100 BETWEEN 0 AND 1
UNION ALL SELECT 'edge_type', l_orderkey || '-' || l_linenumber FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')
UNION ALL SELECT 'item_type', CAST(doc_id AS VARCHAR) FROM documents WHERE lang NOT IN ('en', 'fr', 'de')
UNION ALL SELECT 'attribution', CAST(doc_id AS VARCHAR) FROM labels WHERE toxic <> 0""")
def constraint_report(t):
    events = t.events
    edges = t.lineitem.withColumn("edge", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return telemetry.constraint_report(
        [
            ("order_status", t.orders, F.col("o_orderstatus").isin("F", "O"), "o_orderkey"),
            ("event_type", events, F.col("event_type").isin("click", "view", "signup", "purchase"), "event_id"),
            ("confidence", events, (F.col("value") / 100).between(0, 1), "event_id"),
            ("edge_type", edges, F.col("l_returnflag").isin("A", "N"), "edge"),
            ("item_type", t.documents, F.col("lang").isin("en", "fr", "de"), "doc_id"),
            ("attribution", t.labels, F.col("toxic") == 0, "doc_id"),
        ]
    )


@query("run_accounting", """WITH b AS (SELECT doc_id, source, md5(text) AS h, doc_id % 2 AS batch FROM documents),
n AS (SELECT *, batch = 1 AND NOT EXISTS (SELECT 1 FROM b s WHERE s.batch = 0 AND s.h = b.h AND s.source = b.source)
  AND row_number() OVER (PARTITION BY source, h, batch ORDER BY doc_id) = 1 AS is_new FROM b)
SELECT source AS run_id, count(*) AS fetched, count(*) FILTER (is_new) AS new, count(*) FILTER (NOT is_new) AS duplicate FROM n WHERE batch = 1 GROUP BY source""")
def run_accounting(t):
    stored, batch = document_batches(t)
    flagged = ingest.flag_new(batch, stored, "doc_id")
    return telemetry.run_accounting(flagged.withColumnRenamed("source_id", "run_id"))


def document_batches(t):
    """Documents of even id as stored, of odd id as the new batch; copies share their native id."""
    rows = t.documents.select(
        "doc_id", F.col("source").alias("source_id"), F.md5("text").alias("native_id"), F.sha2("text", 256).alias("content_hash")
    )
    return rows.filter("doc_id % 2 = 0"), rows.filter("doc_id % 2 = 1")


@query("run_failures", """WITH s AS (SELECT event_id // 3 AS run_id, user_id AS source_id, bool_and(event_type = 'error') AS failed FROM events GROUP BY ALL)
SELECT run_id, count(*) AS sources, count(*) FILTER (failed) AS failed_sources, bool_and(failed) AS total_failure FROM s GROUP BY run_id""")
def run_failures(t):
    return telemetry.run_failures(
        t.events.select(
            F.floor(F.col("event_id") / 3).alias("run_id"), F.col("user_id").alias("source_id"), (F.col("event_type") == "error").alias("failed")
        )
    )


@query("ingest_volume", """SELECT user_id AS source_id, CAST(sum(CAST(json_extract_string(props, '$.k') AS INT)) AS BIGINT) AS records_new FROM events
WHERE event_type <> 'error' GROUP BY user_id HAVING records_new > 0""")
def ingest_volume(t):
    return telemetry.ingest_volume(runs(t))


@query("zero_yield", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-01')")
def zero_yield(t):
    this_run = t.orders.filter(F.col("o_orderdate") >= F.lit("2001-07-01").cast("timestamp_ntz"))
    return telemetry.zero_yield(
        t.customer.select("c_custkey", "c_name"), this_run.select(F.col("o_custkey").alias("c_custkey")), "c_custkey"
    )


@query("leak_canary", """SELECT event_id, event_id % 10 = 0 AS leak FROM events""")
def leak_canary(t):
    wrapped = F.concat(F.lit(' {"text": '), "props", F.lit("}"))
    text = F.when(F.col("event_id") % 10 == 0, wrapped).when(F.col("event_id") % 10 == 1, F.concat(F.lit("see "), wrapped)).otherwise(F.col("props"))
    return t.events.select("event_id", tx.looks_like_leak(text).alias("leak"))


@query("json_unwrap", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN 'says ' || event_type WHEN 2 THEN 'deep'
  WHEN 3 THEN 'two ' || event_type ELSE event_type END AS text FROM events""")
def json_unwrap(t):
    kind = F.col("event_type")
    value = (
        F.when(F.col("event_id") % 5 == 0, F.col("props"))
        .when(F.col("event_id") % 5 == 1, F.concat(F.lit('  {"read": "says '), kind, F.lit('"}')))
        .when(F.col("event_id") % 5 == 2, F.lit('{"rewritten": "{\\"body\\": \\"deep\\"}"}'))
        .when(F.col("event_id") % 5 == 3, F.concat(F.lit('{"x": 1, "analysis": "two '), kind, F.lit('", "text": 5}')))
        .otherwise(kind)
    )
    return t.events.select("event_id", tx.json_unwrap(value).alias("text"))


# --- health ------------------------------------------------------------------------------



def health_briefs(t):
    """A customer is a desk with one brief; its orders are the items."""
    k = F.col("c_custkey")
    briefs = t.customer.filter("c_custkey % 9 <> 0").select(
        k.alias("brief_id"), F.col("c_name").alias("desk"),
        F.when(k % 4 == 1, "failed").when(k % 4 == 2, "pending").otherwise("published").alias("status"),
        (0.9 + (k % 11) / 100).alias("faithfulness_score"), F.when(k % 6 == 0, " ").otherwise(F.col("c_name")).alias("headline"),
        F.when(k % 50 == 0, F.lit('{"text": "x"}')).otherwise(F.lit("fine")).alias("convergence_read"), (k * 10).alias("total_tokens"),
    )
    o = F.col("o_orderkey")
    items = t.orders.select(
        F.col("o_custkey").alias("brief_id"),
        F.when(F.col("o_custkey") % 8 == 3, "speculative").when(F.col("o_orderpriority") == "1-URGENT", "confirmed")
        .when(F.col("o_orderpriority") == "2-HIGH", "reported").when(F.col("o_orderpriority") == "3-MEDIUM", "analysis")
        .otherwise("speculative").alias("attribution"),
        F.when(o % 97 == 0, F.lit(' {"body": 1')).otherwise(F.lit("prose")).alias("body"),
        F.when(o % 101 == 0, F.lit('{"watch": 1}')).otherwise(F.lit("")).alias("read"), F.lit(None).cast("string").alias("watch"),
    )
    return telemetry.brief_health_inputs(briefs, items)


_INPUTS = """it AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (a = 'confirmed') AS confirmed, count(*) FILTER (a = 'reported') AS reported,
    count(*) FILTER (a = 'analysis') AS analysis, count(*) FILTER (a = 'speculative') AS speculative, bool_or(leak) AS leak FROM (
  SELECT o_custkey, o_orderkey % 97 = 0 OR o_orderkey % 101 = 0 AS leak, CASE WHEN o_custkey % 8 = 3 THEN 'speculative' ELSE
    CASE o_orderpriority WHEN '1-URGENT' THEN 'confirmed' WHEN '2-HIGH' THEN 'reported' WHEN '3-MEDIUM' THEN 'analysis' ELSE 'speculative' END END AS a FROM orders) GROUP BY 1),
hb AS (SELECT c_custkey AS brief_id, c_name AS desk, CASE c_custkey % 4 WHEN 1 THEN 'failed' WHEN 2 THEN 'pending' ELSE 'published' END AS status,
    0.9 + (c_custkey % 11) / 100.0 AS faith, c_custkey % 6 <> 0 AS has_head, coalesce(n, 0) AS n, coalesce(confirmed, 0) AS confirmed, coalesce(reported, 0) AS reported,
    coalesce(analysis, 0) AS analysis, coalesce(speculative, 0) AS speculative, coalesce(leak, false) OR c_custkey % 50 = 0 AS leaky
  FROM customer LEFT JOIN it ON o_custkey = c_custkey WHERE c_custkey % 9 <> 0)"""


@query("health_inputs", f"WITH {_INPUTS} SELECT brief_id, desk, status, n AS item_count, confirmed, reported, analysis, speculative, leaky FROM hb")
def health_inputs(t):
    return health_briefs(t).select(
        "brief_id", "desk", "status", "item_count", "confirmed", "reported", "analysis", "speculative", "leaky"
    )


def findings(t):
    expected = t.customer.select(F.col("c_name").alias("desk"))
    last_ok = runs(t).filter(~F.col("failed")).groupBy("source_id").agg(F.max("at").alias("last_fetch"))
    sources = telemetry.breaker_state(runs(t), now(), threshold=2).join(last_ok, "source_id", "left").select(
        F.col("source_id").cast("string").alias("source_id"), (F.col("source_id") % 10 != 0).alias("is_active"),
        F.col("state").alias("breaker_state"), "last_fetch",
    )
    latest = telemetry.latest_run(runs(t)).withColumn("source_id", F.col("source_id").cast("string"))
    return telemetry.health_findings(expected, health_briefs(t), latest, sources, now(), token_budget=1000)


_FINDINGS = f"""{_INPUTS}, {BREAKER},
lr AS (SELECT CAST(user_id AS VARCHAR) AS sid, event_type, props FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
ok AS (SELECT user_id, max(ts) FILTER (event_type <> 'error') AS last FROM events GROUP BY 1),
fnd AS (
  SELECT 'critical' AS level, 'no_brief_published' AS code, 'all' AS subject, '0' AS detail WHERE NOT EXISTS (SELECT 1 FROM hb WHERE status = 'published')
  UNION ALL SELECT 'warn', 'brief_missing', c_name, '' FROM customer WHERE c_custkey % 9 = 0
  UNION ALL SELECT 'warn', 'brief_thin', desk, CAST(n AS VARCHAR) FROM hb WHERE status = 'published' AND n < 4
  UNION ALL SELECT 'warn', 'brief_low_faithfulness', desk, printf('%.3f', faith) FROM hb WHERE status = 'published' AND faith < 0.98
  UNION ALL SELECT 'warn', 'confidence_collapsed', desk, '' FROM hb WHERE status = 'published' AND n > 0 AND confirmed + reported = 0
  UNION ALL SELECT 'warn', 'content_leak', desk, '' FROM hb WHERE status = 'published' AND leaky
  UNION ALL SELECT 'warn', 'brief_items_collapsed', desk, '' FROM hb WHERE status = 'failed' AND n = 0 AND has_head
  UNION ALL SELECT 'info', 'brief_skipped', desk, '' FROM hb WHERE status = 'failed' AND NOT (n = 0 AND has_head)
  UNION ALL SELECT 'warn', 'brief_pending', desk, '' FROM hb WHERE status = 'pending'
  UNION ALL SELECT 'notice', 'source_failed', sid, props FROM lr WHERE event_type = 'error'
  UNION ALL SELECT 'notice', 'circuit_open', CAST(source_id AS VARCHAR), '' FROM brk WHERE source_id % 10 <> 0 AND failures >= 2
  UNION ALL SELECT 'notice', 'source_stale', CAST(user_id AS VARCHAR), '' FROM ok WHERE user_id % 10 <> 0 AND last < TIMESTAMP '{NOW}' - INTERVAL 30 HOUR
  UNION ALL SELECT 'warn', 'cost_anomaly', 'all', CAST(CAST(sum(c_custkey * 10) AS BIGINT) AS VARCHAR) FROM customer WHERE c_custkey % 9 <> 0 HAVING sum(c_custkey * 10) > 1000)"""


@query("health_findings", f"WITH {_FINDINGS} SELECT * FROM fnd")
def health_findings(t):
    out = findings(t)
    return out.orderBy(telemetry.level_rank(F.col("level")), "code", "subject")


@query("health_verdict", f"""WITH {_FINDINGS} SELECT count(*) FILTER (level = 'critical') AS critical, count(*) FILTER (level = 'warn') AS warn,
  count(*) FILTER (level = 'notice') AS notice, count(*) FILTER (level = 'info') AS info,
  CASE WHEN count(*) FILTER (level = 'critical') > 0 THEN 'critical' WHEN count(*) FILTER (level = 'warn') > 0 THEN 'degraded' ELSE 'ok' END AS verdict FROM fnd""")
def health_verdict(t):
    return telemetry.health_verdict(findings(t))


@query("token_totals", """WITH k AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT CAST(sum(k) AS BIGINT) AS calls, CAST(sum(k) AS BIGINT) AS total_tokens, round(sum(CAST(k AS DOUBLE)), 4) AS est_cost_usd, sum(k) > 1000 AS over_budget FROM k""")
def token_totals(t):
    return telemetry.token_totals(t.events, lambda _: F.get_json_object("props", "$.k"), budget=1000)


# --- quality -----------------------------------------------------------------------------

def quality_tables(t):
    orders = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    briefs = orders.select(
        F.col("o_orderkey").alias("brief_id"), F.col("c_mktsegment").alias("desk"), F.col("o_orderdate").cast("date").alias("date"),
        F.when(F.col("o_orderstatus") == "F", "published").otherwise("failed").alias("status"),
    )
    ids = F.when(F.col("l_suppkey") % 3 == 0, F.array("l_suppkey")).otherwise(F.array().cast("array<bigint>"))
    items = t.lineitem.select(F.col("l_orderkey").alias("brief_id"), ids.alias("entity_ids"), F.col("l_returnflag").alias("item_type"))
    cites = t.lineitem.filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("brief_id"), F.col("l_partkey").alias("native_id"))
    return briefs, items, cites


@query("quality_report", """WITH b AS (SELECT o_orderkey, c_mktsegment AS desk, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'),
i AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_suppkey % 3 = 0) AS l, count(*) FILTER (l_linestatus = 'F') AS c FROM lineitem GROUP BY 1)
SELECT desk, date, count(*) AS briefs, CAST(coalesce(sum(n), 0) AS BIGINT) AS items, CAST(coalesce(sum(l), 0) AS BIGINT) AS linked, CAST(coalesce(sum(c), 0) AS BIGINT) AS cites
FROM b LEFT JOIN i ON l_orderkey = o_orderkey GROUP BY ROLLUP (desk, date)""")
def quality_report(t):
    return telemetry.quality_report(*quality_tables(t)).withColumn("date", F.col("date").cast("string"))


@query("quality_mix", """SELECT c_mktsegment AS desk, l_returnflag AS item_type, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY ALL""")
def quality_mix(t):
    briefs, items, _ = quality_tables(t)
    rows = items.join(briefs.filter("status = 'published'"), "brief_id")
    return telemetry.mix(rows, "desk", "item_type")


@query("cross_desk_repeats", f"""WITH {MEMBERS} SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS date, l_returnflag AS source_id, l_partkey AS native_id,
  count(DISTINCT c_mktsegment) AS desk_count, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS desks
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL HAVING count(DISTINCT c_mktsegment) > 1""")
def cross_desk_repeats(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        t.customer, F.col("o_custkey") == F.col("c_custkey")
    ).select(
        F.col("l_shipdate").cast("date").cast("string").alias("date"), F.col("l_returnflag").alias("source_id"),
        F.col("l_partkey").alias("native_id"), F.col("c_mktsegment").alias("desk"),
    )
    return telemetry.cross_desk_repeats(rows).withColumn("desks", F.array_join("desks", ","))
