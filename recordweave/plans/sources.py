"""Parser, filter, figure and ingest queries.

Landed payloads are rendered from the given tables and parsed back.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordweave import dims
from recordweave.functions import dates, html, money, text as tx
from recordweave.operators import ingest
from recordweave.plans import sqltext as sq
from recordweave.plans.reading import FIGURES, figure_texts
from recordweave.plans.registry import query
from recordweave.plans.telemetry import document_batches
from recordweave.session import run_dir
from recordweave.sources import parsers, sinks

AS_OF = "2001-08-01"


def day(c):
    return F.col(c).cast("date").cast("string")


def landed(df, payload, desk=None, theme=None):
    """The landed envelope around one payload per row."""
    desks = F.array(*[F.lit(d) for d in dims.DESKS])
    return df.select(
        payload.alias("payload"), (F.slice(desks, 1, 2) if desk is None else desk).alias("probe_desks"),
        (F.lit("probe") if theme is None else theme).alias("probe_theme"),
        F.lit("2026-01-01 00:00:00").cast("timestamp").alias("fetched_at"),
    )


def one_result(**columns):
    """JSON of ``{"results": [ {...} ]}`` with the given columns; nulls leave their key out."""
    return F.to_json(F.struct(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])).alias("results")))


def _award_payloads(t):
    k = F.col("l_orderkey")
    lines = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    payload = one_result(
        **{
            "Award ID": F.when(k % 19 == 0, "").otherwise(F.concat_ws("-", k, "l_linenumber", "l_partkey")),
            "Recipient Name": F.when(k % 7 != 0, F.concat("s_name", F.lit(" Inc LLC"))),
            "Recipient UEI": F.concat(F.lit("UEI"), F.col("l_suppkey").cast("string")),
            "Award Amount": F.col("l_extendedprice"), "Awarding Agency": F.lit("Agency"), "Awarding Sub Agency": F.col("l_returnflag"),
            "Start Date": F.when(k % 11 == 0, "soon").otherwise(day("l_shipdate")), "End Date": day("l_shipdate"),
            "Last Modified Date": day("l_shipdate"), "Award Description": F.concat(F.lit("Part "), F.col("l_partkey").cast("string")),
        }
    )
    return landed(lines, payload)


_RECENT = f"(l_orderkey % 11 = 0 OR CAST(l_shipdate AS DATE) >= DATE '{AS_OF}' - 1460)"
_SHIP = "CAST(CAST(l_shipdate AS DATE) AS VARCHAR)"


@query("src_awards", f"""SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS native_id, 'defense,ai' AS desk,
  CASE WHEN l_orderkey % 7 <> 0 THEN upper(s_name) END AS normalized, l_extendedprice AS amount_usd,
  'Federal award: Part ' || l_partkey || ' | Recipient: ' || CASE WHEN l_orderkey % 7 <> 0 THEN s_name || ' Inc LLC' ELSE 'None' END
   || ' | Amount: $' || format('{{:,}}', CAST(round_even(l_extendedprice, 0) AS BIGINT)) || ' | Agency: Agency / ' || l_returnflag
   || ' | Period: ' || CASE WHEN l_orderkey % 11 = 0 THEN 'soon' ELSE {_SHIP} END || ' to ' || {_SHIP} AS text_chunk
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_orderkey % 19 <> 0 AND {_RECENT}""")
def src_awards(t):
    out = parsers.awards(_award_payloads(t), AS_OF)
    return out.select(
        "native_id", F.array_join("desk", ",").alias("desk"), F.get("entity_mentions", 0)["normalized"].alias("normalized"),
        F.col("structured_data.amount_usd").alias("amount_usd"), "text_chunk",
    )


@query("recency_floor", f"SELECT l_orderkey, l_linenumber, l_partkey, {_SHIP} AS start_date FROM lineitem WHERE {_RECENT}")
def recency_floor(t):
    start = F.when(F.col("l_orderkey") % 11 == 0, F.when(F.col("l_orderkey") % 2 == 0, "soon")).otherwise(day("l_shipdate"))
    kept = t.lineitem.filter(~dates.award_too_old(start, AS_OF))
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", day("l_shipdate").alias("start_date"))


@query("src_opportunities", """SELECT 'N' || o_orderkey AS native_id, 'Notice ' || o_orderpriority AS title,
  CASE WHEN o_orderkey % 3 = 0 THEN 'https://sam.example/' || o_orderkey ELSE 'https://sam.gov/opp/N' || o_orderkey || '/view' END AS url,
  CASE WHEN o_orderkey % 4 = 0 THEN 'A federal agency' ELSE 'Dept of ' || o_orderstatus END || ' posted a Solicitation ('
   || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || '): "Notice ' || o_orderpriority || '".' AS text_chunk,
  sha256('N' || o_orderkey || chr(10) || 'Notice ' || o_orderpriority || chr(10) || CAST(CAST(o_orderdate AS DATE) AS VARCHAR)) AS content_hash
FROM orders WHERE o_orderkey % 13 <> 0""")
def src_opportunities(t):
    k = F.col("o_orderkey")
    row = F.struct(
        F.concat(F.lit(" N"), k.cast("string")).alias("noticeId"),
        F.when(k % 13 == 0, "  ").otherwise(F.concat(F.lit("Notice \n "), "o_orderpriority")).alias("title"),
        F.when(k % 4 != 0, F.concat(F.lit("Dept of "), "o_orderstatus")).alias("fullParentPathName"), F.lit("Solicitation").alias("type"),
        day("o_orderdate").alias("postedDate"), F.when(k % 3 == 0, F.concat(F.lit("https://sam.example/"), k.cast("string"))).alias("uiLink"),
    )
    payload = F.to_json(F.struct(F.lit(1).alias("totalRecords"), F.array(row).alias("opportunitiesData")))
    out = parsers.opportunities(landed(t.orders, payload))
    return out.select("native_id", F.col("structured_data.title").alias("title"), "url", "text_chunk", "content_hash")


@query("src_register", """SELECT 'R-' || p_partkey AS native_id, CASE WHEN p_size % 4 = 0 THEN 'Raw Agency' WHEN p_size % 4 = 1 THEN 'Nuclear Office' ELSE '' END AS agency,
  CASE WHEN p_size % 5 = 0 THEN 'OKLO,CEG' WHEN p_size % 5 = 1 THEN 'CCJ' ELSE '' END AS tickers,
  CASE WHEN p_size % 4 = 0 THEN 'Raw Agency' WHEN p_size % 4 = 1 THEN 'Nuclear Office' ELSE 'Nuclear Regulatory Commission' END
   || ' Rule (2026-01-02): "' || p_name || CASE WHEN p_size % 5 = 0 THEN ' by Oklo' ELSE '' END || '". Summary: '
   || CASE p_size % 5 WHEN 0 THEN 'Constellation joins.' WHEN 1 THEN 'With Cameco Corp.' ELSE 'Camecos and vistranet.' END AS text_chunk
FROM part WHERE p_partkey % 17 <> 0""")
def src_register(t):
    size = F.col("p_size")
    agency = F.when(size % 4 == 0, F.struct(F.lit("Raw Agency").alias("raw_name"), F.lit(None).cast("string").alias("name"))).when(
        size % 4 == 1, F.struct(F.lit("x").alias("raw_name"), F.lit(" Nuclear  Office").alias("name"))
    )
    payload = one_result(
        document_number=F.when(F.col("p_partkey") % 17 != 0, F.concat(F.lit("R-"), F.col("p_partkey").cast("string"))),
        title=F.concat("p_name", F.when(size % 5 == 0, " by Oklo").otherwise("")), type=F.lit("Rule"),
        abstract=F.when(size % 5 == 0, "Constellation joins.").when(size % 5 == 1, "With Cameco Corp.").otherwise("Camecos and vistranet."),
        publication_date=F.lit("2026-01-02"), agencies=F.array_compact(F.array(agency)),
    )
    out = parsers.register(landed(t.part, payload))
    return out.select(
        "native_id", F.col("structured_data.agency").alias("agency"),
        F.array_join(F.transform("entity_mentions", lambda m: m["ticker"]), ",").alias("tickers"), "text_chunk",
    )


@query("src_filings", """SELECT '0001-26-' || s_suppkey || ':doc.htm' AS native_id, s_name || ' Corp' AS company,
  CASE WHEN s_suppkey % 10 IN (2, 4, 6, 8) THEN 'T' || s_suppkey END AS ticker,
  CASE WHEN s_suppkey % 5 <> 0 THEN lpad(CAST(s_suppkey + 1 AS VARCHAR), 10, '0') END AS cik,
  CASE WHEN s_suppkey % 5 <> 0 THEN 'https://www.sec.gov/Archives/edgar/data/' || (s_suppkey + 1) || '/000126' || s_suppkey || '/doc.htm'
   ELSE 'https://www.sec.gov/cgi-bin/browse-edgar' END AS url,
  'SEC 8-K filing by ' || s_name || ' Corp' || CASE WHEN s_suppkey % 10 IN (2, 4, 6, 8) THEN ' (T' || s_suppkey || ')' ELSE '' END
   || ' on 2026-05-01, referencing "probe".' AS text_chunk FROM supplier""")
def src_filings(t):
    k = F.col("s_suppkey")
    accession = F.concat(F.lit("0001-26-"), k.cast("string"))
    cik = F.concat(F.lit("  (CIK "), F.lpad((k + 1).cast("string"), 10, "0"), F.lit(")"))
    ticker = F.when(k % 2 == 0, F.concat(F.lit("  (T"), k.cast("string"), F.lit(")"))).otherwise("")
    display = F.when(k % 5 == 0, F.concat("s_name", F.lit(" Corp"))).otherwise(F.concat("s_name", F.lit(" Corp"), ticker, cik))
    source = F.struct(
        F.array(display).alias("display_names"), F.lit("2026-05-01").alias("file_date"), F.array(F.lit("8-K")).alias("root_forms"),
        accession.alias("adsh"), F.array(F.lit("1.01")).alias("items"),
    )
    hit = F.struct(F.concat(accession, F.lit(":doc.htm")).alias("_id"), source.alias("_source"))
    payload = F.to_json(F.struct(F.struct(F.array(hit).alias("hits")).alias("hits")))
    out = parsers.filings(landed(t.supplier, payload))
    d = "structured_data"
    return out.select(
        "native_id", F.col(f"{d}.company_name").alias("company"), F.col(f"{d}.ticker").alias("ticker"),
        F.col(f"{d}.cik").alias("cik"), "url", "text_chunk",
    )


_FIRST_LINE = f"left({sq.squash('split_part(text, chr(10), 1)')}, 300)"


@query("src_news", f"""WITH d AS (SELECT *, {_FIRST_LINE} AS title FROM documents)
SELECT 'https://news.example/' || doc_id AS native_id, title, source || ' reported (20260102T030405Z): "' || title || '".' AS text_chunk
FROM d WHERE lang = 'en' AND title <> ''""")
def src_news(t):
    language = F.when(F.col("lang") == "en", F.when(F.col("doc_id") % 2 == 0, "English").otherwise("")).otherwise("French")
    row = F.struct(
        F.concat(F.lit("https://news.example/"), F.col("doc_id").cast("string")).alias("url"),
        F.regexp_extract("text", r"^[^\n]*", 0).alias("title"), F.col("source").alias("domain"),
        F.lit("20260102T030405Z").alias("seendate"), language.alias("language"),
    )
    payload = F.to_json(F.struct(F.array(row).alias("articles")))
    out = parsers.news(landed(t.documents, payload))
    return out.select("native_id", F.col("structured_data.title").alias("title"), "text_chunk")


@query("lang_filter", "SELECT doc_id, lang FROM documents WHERE lang IN ('', 'en')")
def lang_filter(t):
    return t.documents.filter(F.col("lang").isin("", "en")).select("doc_id", "lang")


@query("src_timeline", """SELECT user_id AS theme, event_id AS point_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN 0.0 ELSE value END AS volume,
  CASE WHEN event_id % 7 = 0 THEN 1 ELSE 2 END AS points FROM events""")
def src_timeline(t):
    k = F.col("event_id")
    points = F.array(
        F.struct(F.lit("d").alias("date"), k.cast("string").alias("value")),
        F.struct(F.lit("d").alias("date"), F.when(k % 7 == 0, "n/a").when(k % 7 != 1, F.col("value").cast("string")).alias("value")),
    )
    payload = F.to_json(F.struct(F.array(F.struct(F.lit("Volume").alias("series"), points.alias("data"))).alias("timeline")))
    out = parsers.timelines(landed(t.events, payload, theme=F.col("user_id").cast("string")))
    return out.select(
        F.col("probe_theme").cast("bigint").alias("theme"), F.get("series", 0).cast("bigint").alias("point_id"),
        F.get("series", 1).alias("volume"), F.size("series").alias("points"),
    )


def _xml(c):
    """Text safe inside XML: markup characters escaped, other control characters dropped."""
    kept = F.regexp_replace(c, r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{fffe}\x{ffff}]", "")
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        kept = F.replace(kept, F.lit(raw), F.lit(safe))
    return kept


# what an XML reader gives back of a text put into a payload by _xml
_KEPT = r"regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]', '', 'g')"
_LINE = r"regexp_extract(" + _KEPT + r", '^[^\n]*', 0)"


@query("src_atom", f"""WITH a AS (SELECT doc_id, source, {sq.squash(_LINE)} AS title, {sq.squash(_KEPT)} AS body FROM documents)
SELECT '2401.' || doc_id AS native_id, 'v2' AS version, upper('Ann ' || source) AS lead, 'cs.LG' AS primary_category, 'cs.LG,cs.AI' AS categories,
  'arXiv cs.LG paper "' || title || '" (2026-01-01) by Ann ' || source || ', Bo.' || CASE WHEN body = '' THEN ''
    ELSE ' Abstract: ' || CASE WHEN length(body) > {dims.PAPER_ABSTRACT_CHARS} THEN left(body, {dims.PAPER_ABSTRACT_CHARS}) || '…' ELSE body END END AS text_chunk,
  'https://arxiv.org/abs/2401.' || doc_id AS url FROM a""")
def src_atom(t):
    k = F.col("doc_id").cast("string")
    payload = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><entry><id>http://arxiv.org/abs/2401.'),
        k, F.lit("v2</id><updated>2026-02-01T00:00:00Z</updated><published>2026-01-01T00:00:00Z</published><title>"),
        _xml(F.regexp_extract("text", r"^[^\n]*", 0)), F.lit("</title><summary>"), _xml(F.col("text")),
        F.lit("</summary><author><name>Ann "), F.col("source"), F.lit("</name></author><author><name>Bo</name></author>"),
        F.lit('<arxiv:primary_category term="cs.LG"/><category term="cs.LG"/><category term="cs.AI"/></entry></feed>'),
    )
    out = parsers.papers(landed(t.documents, payload))
    d = "structured_data"
    return out.select(
        "native_id", f"{d}.version", F.get("entity_mentions", 0)["normalized"].alias("lead"), f"{d}.primary_category",
        F.array_join(f"{d}.categories", ",").alias("categories"), "text_chunk", "url",
    )


def _untag(e):
    return sq.squash(f"regexp_replace({e}, '<[^>]+>', ' ', 'g')")


_QUOTED = [w.replace("'", "''") for w in dims.COMMERCE_NOISE]
_NOISY = " OR ".join([f"contains(lower(title), '{w}')" for w in _QUOTED] + [f"regexp_matches(title, '{dims.COMMERCE_NOISE_PATTERN}')"])


@query("src_feed", f"""WITH a AS (SELECT doc_id, source, doc_id % 3 = 0 AS rss, left({_untag(_LINE)}, {dims.TITLE_CHARS}) AS title,
  CASE WHEN doc_id % 3 = 0 THEN left({_untag(_KEPT)}, {dims.SNIPPET_CHARS}) ELSE 'Short' END AS snippet FROM documents WHERE doc_id % 3 <> 2)
SELECT CASE WHEN rss THEN 'g' ELSE 'a' END || doc_id AS native_id, title, source AS outlet,
  CASE WHEN rss THEN 'Mon, 05 Jan 2026 10:00:00 GMT' ELSE '2026-01-05T10:00:00Z' END AS published, 'https://o.example/' || doc_id AS url,
  source || ' reported: "' || title || '".' || CASE WHEN snippet = '' THEN '' ELSE ' ' || snippet END AS text_chunk
FROM a WHERE title <> '' AND NOT ({_NOISY})""")
def src_feed(t):
    k = F.col("doc_id").cast("string")
    title = _xml(F.regexp_extract("text", r"^[^\n]*", 0))
    rss = F.concat(
        F.lit("<rss><channel><title>Outlet</title><item><title>"), title, F.lit("</title><link>https://o.example/"), k,
        F.lit("</link><guid>g"), k, F.lit("</guid><description>&lt;p&gt;"), _xml(F.col("text")),
        F.lit("&lt;/p&gt;</description><pubDate>Mon, 05 Jan 2026 10:00:00 GMT</pubDate></item></channel></rss>"),
    )
    atom = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>'), title,
        F.lit('</title><link rel="self" href="https://o.example/self"/><link rel="alternate" href="https://o.example/'), k,
        F.lit('"/><id>a'), k, F.lit("</id><summary>Short</summary><updated>2026-01-05T10:00:00Z</updated></entry></feed>"),
    )
    payload = F.when(F.col("doc_id") % 3 == 0, rss).when(F.col("doc_id") % 3 == 1, atom).otherwise(F.lit("<rss><channel>broken"))
    out = parsers.feeds(landed(t.documents, payload, theme=F.col("source")))
    d = "structured_data"
    return out.select("native_id", f"{d}.title", f"{d}.outlet", f"{d}.published", "url", "text_chunk")


@query("src_offering_xml", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(floor(o_totalprice) AS DOUBLE) END AS offering,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey AS DOUBLE) END AS sold, 'Oil ' || o_orderpriority AS industry,
  coalesce(CASE WHEN o_orderkey % 5 <> 0 THEN CAST(floor(o_totalprice) AS DOUBLE) END, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey AS DOUBLE) END) AS amount FROM orders""")
def src_offering_xml(t):
    k = F.col("o_orderkey")
    offering = F.when(k % 5 == 0, "Indefinite").otherwise(F.format_number(F.floor("o_totalprice"), 0))
    xml = F.concat(
        F.lit("<edgarSubmission><totalOfferingAmount> "), offering, F.lit("</totalOfferingAmount><industryGroupType> Oil "), "o_orderpriority",
        F.lit(" </industryGroupType>"), F.when(k % 3 != 0, F.concat(F.lit("<TotalAmountSold>"), k.cast("string"), F.lit("</TotalAmountSold>"))).otherwise(""),
    )
    facts = money.form_d(F.col("xml"))
    return t.orders.select("o_orderkey", xml.alias("xml")).select(
        "o_orderkey", facts["total_offering_usd"].alias("offering"), facts["total_sold_usd"].alias("sold"),
        facts["industry"].alias("industry"), money.form_d_amount(facts).alias("amount"),
    )


# --- filters -------------------------------------------------------------------------------

_TITLE = ("CASE p_size % 6 WHEN 0 THEN concat('Save Up To half on ', p_name) WHEN 1 THEN concat(p_name, ' now ', p_size, '% off') "
          "WHEN 2 THEN concat(p_name, ' plummets $5') WHEN 3 THEN concat('Get $1,200 off ', p_name) WHEN 4 THEN concat(p_name, ' for xBox') ELSE p_name END")


@query("noise_filter", f"SELECT p_partkey, {_TITLE} AS title FROM part WHERE p_size % 6 = 5")
def noise_filter(t):
    titles = t.part.select("p_partkey", F.expr(_TITLE).alias("title"))
    return titles.filter(~tx.is_commerce_noise(F.col("title")))


@query("cap_per_source", """SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents QUALIFY rank <= 12""")
def cap_per_source(t):
    return ingest.cap_per_source(t.documents.select("source", "doc_id"), "source", ["doc_id"], dims.MAX_ITEMS_PER_FEED)


@query("rolling_lookback", f"""SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d FROM orders
WHERE CAST(o_orderdate AS DATE) >= DATE '{AS_OF}' - {dims.LOOKBACK_DAYS['usaspending']}""")
def rolling_lookback(t):
    floor = F.date_sub(F.lit(AS_OF).cast("date"), dims.LOOKBACK_DAYS["usaspending"])
    return t.orders.filter(F.col("o_orderdate") >= floor.cast("timestamp_ntz")).select("o_orderkey", day("o_orderdate").alias("d"))


@query("content_hash", "SELECT o_orderkey, sha256(o_orderkey || chr(10) || o_orderpriority || chr(10) || o_orderstatus) AS hash FROM orders")
def content_hash(t):
    return t.orders.select(
        "o_orderkey", tx.content_hash(F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus")).alias("hash")
    )


@query("text_chunk", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'news source' ELSE o_orderstatus || '.example' END || ' reported (' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || '): "' || o_orderpriority || '".' AS news,
  o_orderstatus || ' reported: "' || o_orderpriority || '".' || CASE WHEN o_orderkey % 3 = 0 THEN ' snippet' ELSE '' END AS feed,
  'arXiv cs.LG paper "' || o_orderpriority || '" (' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || ') by A, B, C' || CASE WHEN o_orderkey % 2 = 0 THEN ' et al.' ELSE '' END || '. Abstract: ' || repeat('x', 600) || '…' AS paper FROM orders""")
def text_chunk(t):
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    authors = F.slice(F.array(*[F.lit(a) for a in "ABCD"]), 1, F.when(k % 2 == 0, 4).otherwise(3))
    return t.orders.select(
        "o_orderkey", tx.news_chunk(F.when(k % 2 == 0, "").otherwise(F.concat("o_orderstatus", F.lit(".example"))), day("o_orderdate"), p).alias("news"),
        tx.feed_chunk(F.col("o_orderstatus"), p, F.when(k % 3 == 0, "snippet").otherwise("")).alias("feed"),
        tx.paper_chunk(p, F.lit("cs.LG"), day("o_orderdate"), authors, F.lit("x" * 601)).alias("paper"),
    )


# --- figures ---------------------------------------------------------------------------------

def _list(c):
    return F.array_join(F.transform(c, lambda v: F.format_string("%.2f", v)), ";")


def _list_sql(e):
    return f"coalesce(array_to_string(list_transform({e}, lambda v: printf('%.2f', v)), ';'), '')"


@query("parse_amounts", f"WITH {FIGURES} SELECT item_id, {_list_sql('ha')} AS headline, {_list_sql('ba')} AS body FROM amt")
def parse_amounts(t):
    return figure_texts(t).select(
        "item_id", _list(money.amounts_usd(F.col("headline"))).alias("headline"), _list(money.amounts_usd(F.col("body"))).alias("body")
    )


@query("parse_percent_dates", f"""WITH {FIGURES} SELECT item_id, CASE WHEN item_id % 4 = 1 THEN item_id % 40 || '.50' ELSE '' END AS rates,
  CASE WHEN item_id % 4 = 3 THEN 'May ' || (item_id % 28 + 1) || ', 2026' ELSE '' END AS dates FROM fig""")
def parse_percent_dates(t):
    return figure_texts(t).select(
        "item_id", _list(money.percentages(F.col("body"))).alias("rates"), F.array_join(money.long_dates(F.col("body")), ";").alias("dates")
    )


@query("key_amount", f"WITH {FIGURES} SELECT item_id, amount FROM typed")
def key_amount(t):
    return figure_texts(t).select("item_id", money.key_amount(F.col("headline"), F.col("body")).alias("amount"))


@query("amount_kind", f"WITH {FIGURES} SELECT item_id, kind FROM typed")
def amount_kind(t):
    return figure_texts(t).select("item_id", money.amount_kind(F.col("headline"), F.col("body")).alias("kind"))


_USD = ("'$' || CASE WHEN {v} >= 1e9 THEN printf('%g', {v} / 1e9) || 'B' WHEN {v} >= 1e6 THEN printf('%g', {v} / 1e6) || 'M' "
        "WHEN {v} >= 1e3 THEN printf('%g', {v} / 1e3) || 'K' ELSE printf('%g', {v}) END")


@query("format_usd", f"SELECT o_orderkey, {_USD.format(v='v')} AS label FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_totalprice "
       "WHEN 1 THEN o_totalprice * 1000 WHEN 2 THEN o_totalprice * 1000000 ELSE CAST(o_orderkey % 1000 AS DOUBLE) END AS v FROM orders)")
def format_usd(t):
    v = F.expr(
        "CASE o_orderkey % 4 WHEN 0 THEN o_totalprice WHEN 1 THEN o_totalprice * 1000 "
        "WHEN 2 THEN o_totalprice * 1000000 ELSE CAST(o_orderkey % 1000 AS DOUBLE) END"
    )
    return t.orders.select("o_orderkey", money.format_usd(v).alias("label"))


@query("fact_summary", f"""WITH {FIGURES}, top AS (SELECT item_id, list_slice(list_reverse_sort(list_distinct(ba)), 1, 3) AS a FROM amt)
SELECT item_id, CASE item_id % 4 WHEN 2 THEN '' ELSE 'Key figures: amounts ' || array_to_string(list_transform(a, lambda v: {_USD.format(v='v')}), ', ')
  || CASE item_id % 4 WHEN 1 THEN ' | rates ' || (item_id % 40) || '.5%' WHEN 3 THEN ' | dates May ' || (item_id % 28 + 1) || ', 2026' ELSE '' END || '.' END AS summary FROM top""")
def fact_summary(t):
    body = F.col("body")
    summary = money.fact_summary(money.amounts_usd(body), money.percentages(body), money.long_dates(body))
    return figure_texts(t).select("item_id", summary.alias("summary"))


def long_texts(t):
    cover = F.expr("repeat('cover page ', CAST(item_id % 60 AS INT))")
    return figure_texts(t).select("item_id", F.concat(cover, "body", F.expr("repeat(' tail text', 80)")).alias("body"))


_EXCERPT = rf"""docs AS (SELECT item_id, repeat('cover page ', CAST(item_id % 60 AS INT)) || body || repeat(' tail text', 80) AS body FROM fig),
place AS (SELECT *, strpos(body, regexp_extract(body, '{dims.AMOUNT_PATTERN}', 0)) - 1 AS p, regexp_matches(body, '{dims.AMOUNT_PATTERN}') AS hit FROM docs),
exc AS (SELECT item_id, body, trim(substr(body, CASE WHEN hit THEN greatest(0, p - 400) ELSE least(length(body), 400) END + 1, 1200)) AS excerpt FROM place)"""


@query("excerpt", f"WITH {FIGURES}, {_EXCERPT} SELECT item_id, excerpt FROM exc")
def excerpt(t):
    return long_texts(t).select("item_id", money.excerpt(F.col("body")).alias("excerpt"))


@query("enriched_chunk", f"""WITH {FIGURES}, {_EXCERPT}, top AS (SELECT item_id, list_slice(list_reverse_sort(list_distinct(ba)), 1, 3) AS a FROM amt)
SELECT item_id, 'Filing ' || item_id || CASE item_id % 4 WHEN 2 THEN '' ELSE ' Key figures: amounts ' || array_to_string(list_transform(a, lambda v: {_USD.format(v='v')}), ', ')
  || CASE item_id % 4 WHEN 1 THEN ' | rates ' || (item_id % 40) || '.5%' WHEN 3 THEN ' | dates May ' || (item_id % 28 + 1) || ', 2026' ELSE '' END || '.' END || ' ' || excerpt AS chunk
FROM exc JOIN top USING (item_id)""")
def enriched_chunk(t):
    meta = F.concat(F.lit("Filing "), F.col("item_id").cast("string"))
    return long_texts(t).select("item_id", money.enriched_chunk(meta, F.col("body")).alias("chunk"))


@query("published_at", """SELECT event_id, CAST(CASE event_id % 6 WHEN 1 THEN floor(epoch(ts)) WHEN 2 THEN floor(epoch(ts)) WHEN 3 THEN floor(epoch(ts))
  WHEN 5 THEN NULL ELSE epoch(date_trunc('day', ts)) END AS BIGINT) AS published FROM events""")
def published_at(t):
    k, ts = F.col("event_id") % 6, F.col("ts")
    shown = (
        F.when(k == 0, F.date_format(ts, "yyyy-MM-dd"))
        .when(k == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(k == 2, F.concat(F.lit("Mon, "), F.date_format(ts, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
        .when(k == 3, F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'"))
        .when(k == 4, F.date_format(ts, "yyyyMMdd"))
        .otherwise("last week")
    )
    rows = t.events.select("event_id", F.element_at(F.array(F.lit("feeds"), F.lit("edgar"), F.lit("other")), (F.col("event_id") % 3 + 1).cast("int")).alias("source_id"), shown.alias("shown"))
    # the value sits under the first key of each source
    first_key = {"published": "feeds", "file_date": "edgar", "date": "other"}
    field = lambda key: F.when(F.col("source_id") == F.lit(first_key.get(key, "")), F.col("shown"))
    return rows.select("event_id", F.unix_seconds(dates.published_at(F.col("source_id"), field)).alias("published"))


@query("item_type", """SELECT event_id, CASE event_type WHEN 'click' THEN 'award' WHEN 'view' THEN 'policy' WHEN 'signup' THEN 'operational' WHEN 'purchase' THEN 'research' ELSE 'signal' END AS item_type FROM events""")
def item_type(t):
    label = F.expr(
        "CASE event_type WHEN 'click' THEN ' Contract-Award' WHEN 'view' THEN 'new policy change' WHEN 'signup' THEN 'LAUNCH' "
        "WHEN 'purchase' THEN 'big_arxiv_paper' ELSE 'something' END"
    )
    return t.events.select("event_id", tx.item_type(label).alias("item_type"))


# --- ingest ----------------------------------------------------------------------------------

@query("dedup_new", """WITH b AS (SELECT doc_id, source, md5(text) AS h, doc_id % 2 AS batch FROM documents)
SELECT doc_id, source AS source_id, h AS native_id FROM b WHERE batch = 1
  AND NOT EXISTS (SELECT 1 FROM b s WHERE s.batch = 0 AND s.h = b.h AND s.source = b.source)
QUALIFY row_number() OVER (PARTITION BY source, h ORDER BY doc_id) = 1""")
def dedup_new(t):
    stored, batch = document_batches(t)
    return ingest.new_records(batch, stored, "doc_id").select("doc_id", "source_id", "native_id")


@query("merge_native", """WITH e AS (SELECT event_id, user_id AS native_id,
  CASE event_type WHEN 'click' THEN ['ai', 'energy'] WHEN 'view' THEN ['energy', 'defense', 'ai'] WHEN 'signup' THEN ['defense', 'ai'] WHEN 'purchase' THEN ['energy', 'ai'] ELSE []::VARCHAR[] END AS desks FROM events),
k AS (SELECT *, list_position(['defense', 'energy', 'ai'], desks[1]) AS r FROM e WHERE len(desks) > 0),
h AS (SELECT native_id, desks[1] AS home FROM k QUALIFY row_number() OVER (PARTITION BY native_id ORDER BY len(desks), r) = 1),
u AS (SELECT native_id, string_agg(DISTINCT d, ',' ORDER BY d) AS others FROM (SELECT native_id, unnest(desks) AS d FROM k) JOIN h USING (native_id) WHERE d <> home GROUP BY 1),
f AS (SELECT native_id, min(event_id) AS event_id FROM k GROUP BY 1)
SELECT native_id, event_id, concat_ws(',', home, others) AS desks FROM h JOIN f USING (native_id) LEFT JOIN u USING (native_id)""")
def merge_native(t):
    desks = F.expr(
        "CASE event_type WHEN 'click' THEN array('ai', 'energy') WHEN 'view' THEN array('energy', 'defense', 'ai') "
        "WHEN 'signup' THEN array('defense', 'ai') WHEN 'purchase' THEN array('energy', 'ai') ELSE cast(array() AS array<string>) END"
    )
    rows = t.events.select("event_id", F.lit("edgar").alias("source_id"), F.col("user_id").alias("native_id"), desks.alias("desks"))
    out = ingest.merge_by_native_id(rows, "event_id")
    return out.select("native_id", "event_id", F.array_join("desks", ",").alias("desks"))


@query("retention_prune", """SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '2001-07-11'
  AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01')
  AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.09)""")
def retention_prune(t):
    raw = t.orders.select("o_orderkey", F.col("o_orderdate").alias("created_at"))
    # four tables may refer to a raw row; their keys are one list here, so that it is read once
    rules = ("l_returnflag = 'R'", "l_shipdate >= TIMESTAMP_NTZ '1998-01-01'", "l_linestatus = 'O'", "l_discount > 0.09")
    refs = [t.lineitem.filter(" OR ".join(rules)).select(F.col("l_orderkey").alias("o_orderkey"))]
    cutoff = F.date_sub(F.lit(AS_OF).cast("date"), dims.HOT_WINDOW_DAYS).cast("timestamp_ntz")
    return ingest.prune(raw, cutoff, "o_orderkey", *refs).select("o_orderkey")


@query("append_filtered", """WITH o AS (SELECT year(o_orderdate) AS y, 's' || o_orderkey % 3 AS s, CAST(o_custkey AS VARCHAR) AS n FROM orders),
a AS (SELECT s, n FROM o WHERE y <= 1996), b AS (SELECT s, n FROM o WHERE y BETWEEN 1996 AND 1998), c AS (SELECT s, n FROM o WHERE y <> 1997),
k(run_id, fetched, new) AS (SELECT 'a', (SELECT count(*) FROM a), (SELECT count(*) FROM (SELECT DISTINCT s, n FROM a))
  UNION ALL SELECT 'b', (SELECT count(*) FROM b), (SELECT count(*) FROM (SELECT s, n FROM b EXCEPT SELECT s, n FROM a))
  UNION ALL SELECT 'c', (SELECT count(*) FROM c), (SELECT count(*) FROM (SELECT s, n FROM c EXCEPT SELECT s, n FROM a EXCEPT SELECT s, n FROM b)))
SELECT run_id, fetched, new, fetched - new AS duplicate FROM k""")
def append_filtered(t):
    """Three runs into one table; each reads only partitions whose key filter says they may hold its keys."""
    rows = t.orders.select(
        F.year("o_orderdate").alias("y"), F.concat(F.lit("s"), (F.col("o_orderkey") % 3).cast("string")).alias("source_id"),
        F.col("o_custkey").cast("string").alias("native_id"), F.lit("h").alias("content_hash"), F.col("o_orderkey").alias("arrival"),
    )
    path = run_dir(t.spark, "appended")
    runs = (("a", "y <= 1996"), ("b", "y BETWEEN 1996 AND 1998"), ("c", "y <> 1997"))
    return reduce(DataFrame.unionByName, [sinks.append_new(t.spark, rows.filter(rule).drop("y"), path, run) for run, rule in runs])


_CUT = "TIMESTAMP '2001-07-11'"


@query("retention_apply", f"""WITH n AS (SELECT l_orderkey AS k, CASE WHEN l_partkey % 50 > 0 THEN l_shipdate + INTERVAL 3 YEAR END AS made FROM lineitem),
nk AS (SELECT k, made IS NULL OR made >= {_CUT} AS keep FROM n),
refs AS (SELECT k FROM nk WHERE keep UNION SELECT l_orderkey FROM lineitem WHERE l_discount > 0.09
  UNION SELECT l_orderkey FROM lineitem WHERE l_tax > 0.07 UNION SELECT event_id FROM events WHERE event_type = 'error'),
r AS (SELECT CASE WHEN o_custkey % 40 > 0 THEN o_orderdate END AS made, o_orderkey AS k FROM orders),
rk AS (SELECT made IS NULL OR made >= {_CUT} OR k IN (SELECT k FROM refs) AS keep FROM r)
SELECT 'raw' AS "table", count(*) FILTER (keep) AS kept, count(*) FILTER (NOT keep) AS removed FROM rk
UNION ALL SELECT 'normalized', count(*) FILTER (keep), count(*) FILTER (NOT keep) FROM nk""")
def retention_apply(t):
    raw = t.orders.select("o_orderkey", F.when(F.col("o_custkey") % 40 > 0, F.col("o_orderdate")).alias("created_at"))
    line = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    made = F.when(F.col("l_partkey") % 50 > 0, F.col("l_shipdate") + F.expr("INTERVAL 3 YEARS"))
    # some of a raw row's citations, edges and open reviews outlive its normalized rows
    citations, edges = line.filter("l_discount > 0.09"), line.filter("l_tax > 0.07")
    queue = t.events.filter("event_type = 'error'").withColumnRenamed("event_id", "o_orderkey")
    cutoff = F.date_sub(F.lit(AS_OF).cast("date"), dims.HOT_WINDOW_DAYS).cast("timestamp_ntz")
    return ingest.retain(raw, line.select("o_orderkey", made.alias("created_at")), cutoff, "o_orderkey", citations, edges, queue)[2]


@query("enrich_join", """SELECT o_orderkey AS record_id, o_orderkey % 3 <> 2 AND o_orderkey % 4 <> 1 AS enriched,
  CASE WHEN o_orderkey % 3 = 2 OR o_orderkey % 4 = 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN 5.0 END
       WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 70 + 1) * 1e6 ELSE (o_orderkey % 50 + 1) * 1000.0 END AS amount_usd,
  CASE WHEN o_orderkey % 3 = 2 OR o_orderkey % 4 = 1 THEN 'meta'
       WHEN o_orderkey % 3 = 0 THEN 'SEC Form D private placement by Co (T): offering $' || (o_orderkey % 70 + 1) || 'M; industry Oil.'
       ELSE 'meta Key figures: amounts $' || (o_orderkey % 50 + 1) || 'K. Raised $' || (o_orderkey % 50 + 1) || 'K & more' END AS text FROM orders""")
def enrich_join(t):
    k = F.col("o_orderkey")
    is_d = k % 3 == 0
    url = F.concat(F.lit("https://f.example/"), k.cast("string"))
    cik, accession = k.cast("string"), F.concat(F.lit("a-"), k.cast("string"))
    records = t.orders.select(
        k.alias("record_id"), F.when(is_d, "D/A").otherwise("8-K").alias("form"), url.alias("url"), cik.alias("cik"),
        accession.alias("accession"), F.lit("Co").alias("company"), F.lit("T").alias("ticker"), F.lit("meta").alias("text"),
        F.when(k % 2 == 0, 5.0).alias("amount_usd"),
    )
    page = F.concat(F.lit("<p>Raised $"), (k % 50 + 1).cast("string"), F.lit("K &amp; more</p>"))
    xml = F.concat(
        F.lit("<totalOfferingAmount>"), (k % 70 + 1).cast("string"), F.lit(",000,000</totalOfferingAmount><industryGroupType>Oil</industryGroupType>")
    )
    bodies = t.orders.filter("o_orderkey % 3 <> 2 AND o_orderkey % 4 <> 1").select(
        F.when(~is_d, url).alias("url"), html.html_text(F.when(~is_d, page)).alias("body"),
        F.when(is_d, cik).alias("cik"), F.when(is_d, accession).alias("accession"), F.when(is_d, xml).alias("xml"),
    )
    return ingest.enrich(records, bodies, cap=None).select("record_id", "enriched", "amount_usd", "text")
