"""Streaming queries over the events table read as a file stream, with batch SQL twins."""

from pyspark.sql import functions as F

from recordweave import dims
from recordweave.plans.registry import query
from recordweave.session import run_dir
from recordweave.sources import sinks
from recordweave.streaming import jobs, pages, state


def events(t):
    """The events files as a stream; event time as a timestamp."""
    schema = t.events.schema
    return jobs.read_stream(t.spark, f"{t.folder}/events*.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def theme():
    return F.concat_ws("-", "event_type", (F.col("user_id") % 10).cast("string"))


@query("stream_dedup", "SELECT DISTINCT user_id, event_type, props FROM events")
def stream_dedup(t):
    return jobs.dedup(events(t), ["user_id", "event_type", "props"], "ts").select("user_id", "event_type", "props")


@query("stream_theme_volume", """SELECT event_type || '-' || (user_id % 10) AS theme, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS volume
FROM events GROUP BY ALL""")
def stream_theme_volume(t):
    table = jobs.volume(events(t).withColumn("theme", theme()), "theme", "ts")
    return table.select("theme", F.date_format("start", "yyyy-MM-dd").alias("day"), "volume")


@query("stream_theme_sliding", """SELECT event_type AS theme, strftime(CAST(ts AS DATE) - CAST(k AS INT), '%Y-%m-%d') AS start, count(*) AS volume
FROM events, (SELECT unnest(range(0, 7)) AS k) GROUP BY ALL""")
def stream_theme_sliding(t):
    table = jobs.volume(events(t).withColumnRenamed("event_type", "theme"), "theme", "ts", slide_days=7)
    return table.withColumn("start", F.date_format("start", "yyyy-MM-dd"))


_SEEN = "ts + INTERVAL 1 DAY * (event_id % 60)"
_SOURCE = "CASE event_type WHEN 'click' THEN 'usaspending' WHEN 'view' THEN 'sam_gov' WHEN 'signup' THEN 'edgar' WHEN 'purchase' THEN 'gdelt' ELSE 'other' END"


@query("stream_late", f"""WITH e AS (SELECT {_SOURCE} AS source_id, date_diff('day', CAST(ts AS DATE), CAST({_SEEN} AS DATE)) AS lag FROM events),
l AS (SELECT source_id, lag > CASE source_id WHEN 'usaspending' THEN 45 WHEN 'sam_gov' THEN 30 WHEN 'edgar' THEN 7 WHEN 'gdelt' THEN 2 ELSE 21 END AS late FROM e)
SELECT source_id, count(*) FILTER (NOT late) AS kept, count(*) FILTER (late) AS late FROM l GROUP BY source_id""")
def stream_late(t):
    rows = events(t).select(
        F.expr(_SOURCE).alias("source_id"), "ts", (F.col("ts") + F.expr("INTERVAL 1 DAY") * (F.col("event_id") % 60)).alias("seen")
    )
    return jobs.late_counts(rows, "source_id", "ts", "seen")


@query("stream_breaker", """WITH f AS (SELECT user_id AS source_id, ts, event_type = 'error' AND coalesce((ts, event_id) >
    max((ts, event_id)) FILTER (event_type <> 'error') OVER (PARTITION BY user_id), true) AS f FROM events),
s AS (SELECT source_id, count(*) FILTER (f) AS failures, max(ts) FILTER (f) AS last FROM f GROUP BY 1)
SELECT source_id, failures, CASE WHEN failures >= 2 THEN 'open' ELSE 'closed' END AS state,
  CASE WHEN failures >= 2 THEN strftime(last, '%Y-%m-%d %H:%M:%S') END AS opened_at FROM s""")
def stream_breaker(t):
    runs = events(t).select(
        F.col("user_id").alias("source_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"),
        (F.col("event_type") == "error").alias("failed"),
    )
    out = jobs.breaker(runs, threshold=2)
    return out.withColumn("opened_at", F.date_format("opened_at", "yyyy-MM-dd HH:mm:ss"))


@query("stream_silence", f"""SELECT user_id AS source_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events GROUP BY user_id
HAVING max(ts) + INTERVAL 30 HOUR < (SELECT max(ts) FROM events)""")
def stream_silence(t):
    return jobs.silence_alerts(events(t), "user_id", "ts").withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss"))


# the tables span thirty days, so within the longest lookback of a source every key counts once
@query("stream_dedup_within", "SELECT DISTINCT user_id, event_type, props FROM events")
def stream_dedup_within(t):
    rows, _ = state.dedup_within(events(t), ["user_id", "event_type", "props"], "ts", max(dims.LOOKBACK_DAYS.values()))
    return rows.select("user_id", "event_type", "props")


@query("stream_watch", """WITH w AS (SELECT epoch_ms(max(ts)) * 1000 - 86400000000 AS upto FROM events),
e AS (SELECT user_id::VARCHAR AS source_id, epoch_us(ts) AS us, event_id, event_type = 'error' AS failed, upto FROM events, w WHERE epoch_us(ts) <= upto),
o AS (SELECT *, lag(us) OVER s AS before, coalesce(lead(us) OVER s, upto) AS following, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER s AS run
  FROM e WINDOW s AS (PARTITION BY source_id ORDER BY us, event_id)),
k AS (SELECT *, sum(failed::INT) OVER (PARTITION BY source_id, run ORDER BY us, event_id) AS n FROM o),
l AS (SELECT *, lag(n) OVER (PARTITION BY source_id ORDER BY us, event_id) AS n_before FROM k)
SELECT source_id, 'silent' AS event, us + 108000000000 AS "at" FROM l WHERE following > us + 108000000000
UNION ALL SELECT source_id, 'back', us FROM l WHERE before + 108000000000 < us
UNION ALL SELECT source_id, 'half_open', us + 1800000000 FROM l WHERE failed AND n >= 2 AND following >= us + 1800000000
UNION ALL SELECT source_id, 'open', us FROM l WHERE failed AND (n = 2 OR n > 2 AND before + 1800000000 <= us)
UNION ALL SELECT source_id, 'closed', us FROM l WHERE NOT failed AND n_before >= 2""")
def stream_watch(t):
    runs = events(t).select(
        F.col("user_id").alias("source_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("failed")
    )
    return state.watch(runs, late="1 day", threshold=2)[0]


@query("stream_momentum", """WITH vol AS (SELECT event_type || '-' || (user_id % 10) AS theme, CAST(ts AS DATE) AS d, count(*) AS v FROM events GROUP BY ALL),
back AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY d DESC) AS b, count(*) OVER (PARTITION BY theme) AS points FROM vol),
mean AS (SELECT theme, avg(v) FILTER (b <= 7) AS recent, coalesce(avg(v) FILTER (b > 7), 0.0) AS baseline, any_value(points) AS points
  FROM back WHERE b <= 28 GROUP BY theme),
moves AS (SELECT *, CASE WHEN baseline > 0 THEN (recent - baseline) / baseline * 100.0 END AS delta_pct FROM mean)
SELECT theme, round(recent, 6) AS recent, round(baseline, 6) AS baseline, points, round(delta_pct, 6) AS delta_pct,
  CASE WHEN delta_pct >= 25 THEN 'up' WHEN delta_pct <= -25 THEN 'down' END AS direction FROM moves""")
def stream_momentum(t):
    # three landings of the events, days mixed: each call goes on from the one before
    root = run_dir(t.spark, "moves")
    rows = t.events.select("event_id", "event_type", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    for part in range(3):
        rows.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == part).write.mode("append").parquet(f"{root}/landed")
        stream = jobs.read_stream(t.spark, f"{root}/landed", rows.schema).withColumn("theme", theme())
        out = jobs.moves(stream, "theme", "ts", f"{root}/job")
    return out.withColumns({c: F.round(c, 6) for c in ("recent", "baseline", "delta_pct")})


# --- landed pages ------------------------------------------------------------------------

_PARTS = """days AS (SELECT event_type, CAST(ts AS DATE) AS day, min(event_id % 2) AS low FROM events GROUP BY ALL),
landed AS (SELECT e.*, CAST(e.ts AS DATE) AS day, e.event_id % 2 - low + 1 AS page FROM events e JOIN days d
  ON e.event_type IS NOT DISTINCT FROM d.event_type AND CAST(e.ts AS DATE) IS NOT DISTINCT FROM d.day)"""
LANDED = "event_id bigint, user_id bigint, props string"


def landing(t, root):
    """The events as pages, one or two of each type and day; gives a call that lands the page of a number."""
    rows = t.events.select("event_id", "user_id", "props", F.col("event_type").alias("source_id"), F.col("ts").cast("date").alias("date"))
    lows = rows.groupBy("source_id", "date").agg(F.min(F.col("event_id") % 2).alias("low"))
    paged = rows.join(lows, ["source_id", "date"]).withColumn("page", (F.col("event_id") % 2 - F.col("low") + 1).cast("int")).drop("low")
    typed = paged.withColumns({"event_id": F.col("event_id").cast("bigint"), "user_id": F.col("user_id").cast("bigint"), "props": F.col("props").cast("string")})

    def land(page):
        typed.filter(F.col("page") == page).write.mode("append").partitionBy("source_id", "date", "page").parquet(root)

    return land


@query("stream_pages", f"""WITH {_PARTS} SELECT event_type AS source_id, CAST(day AS VARCHAR) AS date, page, count(*) AS n_rows, sum(event_id)::BIGINT AS ids
FROM landed GROUP BY ALL""")
def stream_pages(t):
    root, job = run_dir(t.spark, "landed"), run_dir(t.spark, "pages")
    land = landing(t, root)

    def step(batch, batch_id, out):
        return batch.groupBy("source_id", "date", "page").agg(F.count("*").alias("n_rows"), F.sum("event_id").alias("ids"))

    for page in (1, 2):
        land(page)
        # the second call goes on from the cursors of the first
        told = jobs.fold(pages.stream_pages(t.spark, root, LANDED, default=45), "pages", step, job)
    return told.groupBy("source_id", F.col("date").cast("string").alias("date"), F.col("page").cast("bigint").alias("page")).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("ids").alias("ids")
    )


@query("ingest_runs", f"""WITH {_PARTS},
own AS (SELECT page, event_type, user_id, md5(props) AS h FROM landed
  QUALIFY row_number() OVER (PARTITION BY page, event_type, user_id ORDER BY event_id) = 1),
told AS (SELECT a.page, b.h IS NULL AS fresh FROM own a LEFT JOIN own b
  ON b.page = 1 AND a.page = 2 AND b.event_type = a.event_type AND b.user_id = a.user_id AND b.h IS NOT DISTINCT FROM a.h)
SELECT 'run-' || (page - 1) AS run_id, count(*) AS fetched, count(*) FILTER (fresh) AS "new", count(*) FILTER (NOT fresh) AS duplicate FROM told GROUP BY 1""")
def ingest_runs(t):
    root, job = run_dir(t.spark, "landed"), run_dir(t.spark, "ingest")
    land = landing(t, root)

    def parse(rows):
        return rows.select(
            "source_id", F.col("user_id").cast("string").alias("native_id"), F.md5(F.col("props").cast("binary")).alias("content_hash"),
            F.col("event_id").alias("arrival"), F.array(F.lit(dims.DESKS[0])).alias("desks"),
        )

    for page in (1, 2):
        land(page)
        _, runs = pages.ingest(pages.stream_pages(t.spark, root, LANDED, default=45), parse, job)
    return runs.select("run_id", "fetched", "new", "duplicate")


# --- published briefs --------------------------------------------------------------------

@query("published_briefs", """WITH e AS (SELECT ['defense','ai','energy'][user_id % 3 + 1] AS desk, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, event_id, ts FROM events),
newest AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY desk, date ORDER BY event_id % 2 DESC, ts DESC, event_id DESC) = 1)
SELECT desk, date, event_id AS brief_id, event_id % 4 AS n_items, event_id % 4 * 2 AS n_citations,
  (event_id % 4 * 2) * event_id + (event_id % 4) AS cited FROM newest""")
def published_briefs(t):
    root = run_dir(t.spark, "published")
    desks = F.array(*[F.lit(d) for d in dims.DESKS])
    e = t.events.select("event_id", "ts", F.element_at(desks, (F.col("user_id") % 3 + 1).cast("int")).alias("desk"), F.col("ts").cast("date").cast("string").alias("date"))
    cited = F.array(F.col("event_id"), F.col("event_id") + 1)
    item = lambda n: F.struct(n.alias("item_id"), F.transform(cited, lambda r: F.struct(r.alias("raw_id"))).alias("citations"))
    numbers = F.when(F.col("event_id") % 4 > 0, F.sequence(F.lit(1), (F.col("event_id") % 4).cast("int"))).otherwise(F.array().cast("array<int>"))
    made = e.select("desk", "date", F.col("event_id").alias("brief_id"), F.col("ts").alias("made_at"), F.transform(numbers, item).alias("items"))
    # briefs with odd ids land later and replace the others of their day
    for odd in (0, 1):
        made.filter(F.col("brief_id") % 2 == odd).write.mode("append").parquet(f"{root}/landed")
        jobs.publish(jobs.read_stream(t.spark, f"{root}/landed", made.schema), f"{root}/tables")
    items = sinks.read_briefs(t.spark, f"{root}/tables", "brief_items").groupBy("desk", "date").agg(F.count("*").alias("n_items"))
    told = sinks.read_briefs(t.spark, f"{root}/tables", "citations").groupBy("desk", "date").agg(F.count("*").alias("n_citations"), F.sum("raw_id").alias("cited"))
    out = sinks.read_briefs(t.spark, f"{root}/tables").select("desk", "date", "brief_id").join(items, ["desk", "date"], "left").join(told, ["desk", "date"], "left")
    return out.fillna(0, ["n_items", "n_citations", "cited"])
