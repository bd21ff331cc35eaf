"""Payload rows -> normalized records, one function per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordweave import dims, schemas
from recordweave.functions import text as tx
from recordweave.functions.dates import award_too_old
from recordweave.functions.names import normalize_award_name, normalize_mention, pad_cik
from recordweave.functions.text import blank_to_null, drop_tags, squash, strip
from recordweave.operators.gazetteer import allowlist_mentions

_MENTION_FIELDS = {
    "mention": "string", "normalized": "string", "ticker": "string", "cik": "string", "uei": "string",
    "entity_type": "string", "entity_id": "string", "confidence": "double", "resolved_by": "string",
}


def _mention(**given: Column) -> Column:
    return F.struct(
        *[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in _MENTION_FIELDS.items()]
    )


def _mentions(one: Column, when: Column) -> Column:
    return F.array_compact(F.array(F.when(when, one)))


def _no_mentions() -> Column:
    return F.array().cast(f"array<{schemas.MENTION}>")



def _records(rows: DataFrame, source_id: str, record_type: str, **columns: Column) -> DataFrame:
    fixed = {"source_id": F.lit(source_id), "record_type": F.lit(record_type), "fetched_at": F.col("fetched_at")}
    named = {**fixed, **columns}
    return rows.select(*[named[c].alias(c) for c in schemas.RECORD_COLUMNS])


def _json_rows(landed: DataFrame, schema: str, path: str, row: str = "r") -> DataFrame:
    # the outer form keeps Spark from adding a "not empty" filter that would parse every payload twice
    parsed = landed.withColumn("p", F.from_json("payload", schema))
    rows = parsed.select("probe_desks", "probe_theme", "fetched_at", F.explode_outer(f"p.{path}").alias(row))
    return rows.filter(F.col(row).isNotNull())


def awards(landed: DataFrame, as_of: str) -> DataFrame:
    """Award search answers. The hash covers every field, so a modified award is a new row."""
    rows = _json_rows(landed, schemas.AWARDS, "results").select("*", "r.*").filter(
        (F.coalesce("Award ID", F.lit("")) != "") & ~award_too_old(F.col("Start Date"), as_of)
    )
    data = F.struct(
        F.col("Award ID").alias("award_id"), F.col("Recipient Name").alias("recipient_name"),
        F.col("Recipient UEI").alias("recipient_uei"), F.col("Award Amount").alias("amount_usd"),
        F.col("Awarding Agency").alias("awarding_agency"), F.col("Awarding Sub Agency").alias("awarding_sub_agency"),
        F.col("Award Description").alias("description"), F.col("Start Date").alias("start_date"),
        F.col("End Date").alias("end_date"), F.col("Last Modified Date").alias("last_modified"),
    )
    who = F.col("Recipient Name")
    return _records(
        rows, "usaspending", "federal_award", desk=F.col("probe_desks"),
        entity_mentions=_mentions(_mention(mention=who, normalized=normalize_award_name(who)), F.coalesce(who, F.lit("")) != ""),
        structured_data=data,
        text_chunk=tx.award_chunk(
            F.col("Award Description"), who, F.col("Award Amount"), F.col("Awarding Agency"),
            F.col("Awarding Sub Agency"), F.col("Start Date"), F.col("End Date"),
        ),
        content_hash=tx.json_hash(data), native_id=F.col("Award ID"),
        url=F.concat(F.lit("https://www.usaspending.gov/award/"), "Award ID", F.lit("/")),
    )


def opportunities(landed: DataFrame) -> DataFrame:
    """Procurement notices. The hash leaves the probe out, so two probes give one row."""
    rows = _json_rows(landed, schemas.OPPORTUNITIES, "opportunitiesData").select(
        "probe_desks", "probe_theme", "fetched_at",
        squash(F.col("r.noticeId")).alias("notice_id"),
        F.left(squash(F.col("r.title")), F.lit(dims.TITLE_CHARS)).alias("title"),
        squash(F.col("r.fullParentPathName")).alias("agency"), squash(F.col("r.type")).alias("notice_type"),
        squash(F.col("r.postedDate")).alias("posted_date"),
        squash(F.col("r.solicitationNumber")).alias("solicitation_number"),
        squash(F.col("r.naicsCode")).alias("naics"), squash(F.col("r.uiLink")).alias("ui_link"),
        F.col("probe_theme").alias("query"),
    ).filter("notice_id != '' AND title != ''")
    data = F.struct(
        "notice_id", "title", "agency", "notice_type", "posted_date", "solicitation_number", "naics", "ui_link", "query"
    )
    return _records(
        rows, "sam_gov", "award", desk=F.col("probe_desks"), entity_mentions=_no_mentions(), structured_data=data,
        text_chunk=tx.opportunity_chunk(F.col("agency"), F.col("notice_type"), F.col("posted_date"), F.col("title")),
        content_hash=tx.content_hash(F.col("notice_id"), F.col("title"), F.col("posted_date")),
        native_id=F.col("notice_id"),
        url=F.coalesce(
            blank_to_null(F.col("ui_link")), F.concat(F.lit("https://sam.gov/opp/"), "notice_id", F.lit("/view"))
        ),
    )


def register(landed: DataFrame) -> DataFrame:
    """Regulatory documents; listed companies named in title or abstract become mentions."""
    first = F.get("r.agencies", 0)
    rows = _json_rows(landed, schemas.REGISTER, "results").select(
        "probe_desks", "fetched_at",
        squash(F.col("r.document_number")).alias("document_number"), squash(F.col("r.title")).alias("title"),
        squash(F.col("r.type")).alias("doc_type"), squash(F.col("r.abstract")).alias("abstract"),
        squash(F.col("r.publication_date")).alias("publication_date"),
        squash(F.coalesce(blank_to_null(first["name"]), first["raw_name"])).alias("agency"),
        squash(F.col("r.html_url")).alias("html_url"), F.col("probe_theme").alias("term"),
    ).filter("document_number != '' AND title != ''")
    data = F.struct(
        "document_number", "title", "doc_type", "abstract", "publication_date", "agency", "html_url", "term"
    )
    named = allowlist_mentions(F.concat_ws(" ", "title", "abstract"))
    return _records(
        rows, "nrc", "regulatory_document", desk=F.col("probe_desks"),
        entity_mentions=F.transform(
            named,
            lambda m: _mention(
                mention=m["mention"], normalized=F.upper(m["mention"]), ticker=m["ticker"], entity_type=F.lit("company")
            ),
        ),
        structured_data=data,
        text_chunk=tx.register_chunk(
            F.col("doc_type"), F.col("title"), F.col("agency"), F.col("publication_date"), F.col("abstract")
        ),
        content_hash=tx.json_hash(F.struct("abstract", "document_number", "title")),
        native_id=F.col("document_number"),
        url=F.coalesce(
            blank_to_null(F.col("html_url")), F.concat(F.lit("https://www.federalregister.gov/d/"), "document_number")
        ),
    )


def display_parts(display: Column) -> Column:
    """``NAME (TICKER) (CIK 123)`` -> company, ticker, cik; anything else is a bare name."""
    shown = strip(F.coalesce(display, F.lit("")))
    part = lambda i: F.regexp_extract(shown, dims.DISPLAY_NAME_PATTERN, i)
    matched = shown.rlike(dims.DISPLAY_NAME_PATTERN)
    return F.struct(
        F.when(matched, strip(part(1))).otherwise(shown).alias("company"),
        blank_to_null(part(2)).alias("ticker"), blank_to_null(part(3)).alias("cik"),
    )


def filing_url(cik: Column, accession: Column, native_id: Column) -> Column:
    file = F.when(F.contains(native_id, F.lit(":")), F.regexp_extract(native_id, r"^[^:]*:([\s\S]*)$", 1)).otherwise("")
    return F.when(cik.isNull(), "https://www.sec.gov/cgi-bin/browse-edgar").otherwise(
        F.concat(
            F.lit("https://www.sec.gov/Archives/edgar/data/"), F.regexp_replace(cik, "^0+(?=.)", ""), F.lit("/"),
            F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"), file,
        )
    )


def filings(landed: DataFrame) -> DataFrame:
    """Filing search hits. The hash covers the theme: run the native-id merge before the raw sink."""
    rows = (
        _json_rows(landed, schemas.FILINGS, "hits.hits", "h")
        .select(
            "probe_desks", F.col("probe_theme").alias("theme"), "fetched_at", F.col("h._id").alias("native_id"),
            F.col("h._source.adsh").alias("accession"), display_parts(F.get("h._source.display_names", 0)).alias("d"),
            F.coalesce(
                blank_to_null(F.col("h._source.form")), F.get("h._source.root_forms", 0), F.lit("")
            ).alias("form"),
            F.col("h._source.file_date").alias("file_date"),
            F.coalesce("h._source.items", F.array().cast("array<string>")).alias("items"),
            F.coalesce("h._source.sics", F.array().cast("array<string>")).alias("sics"),
        )
        .filter("coalesce(native_id, '') != '' AND coalesce(accession, '') != ''")
        .select("*", F.col("d.company").alias("company_name"), "d.ticker", "d.cik")
    )
    data = F.struct("accession", "cik", "company_name", "file_date", "form", "items", "sics", "theme", "ticker")
    company = F.col("company_name")
    return _records(
        rows, "edgar", "filing", desk=F.col("probe_desks"),
        entity_mentions=_mentions(
            _mention(mention=company, normalized=F.upper(strip(company)), ticker=F.col("ticker"), cik=F.col("cik")),
            company != "",
        ),
        structured_data=data,
        text_chunk=tx.filing_chunk(company, F.col("ticker"), F.col("form"), F.col("file_date"), F.col("theme")),
        content_hash=tx.json_hash(data), native_id=F.col("native_id"),
        url=filing_url(F.col("cik"), F.col("accession"), F.col("native_id")),
    )


def news(landed: DataFrame) -> DataFrame:
    """News lists: English or unmarked articles with url and title."""
    rows = _json_rows(landed, schemas.NEWS, "articles").select(
        "probe_desks", "fetched_at", squash(F.col("r.url")).alias("url"),
        F.left(squash(F.col("r.title")), F.lit(dims.TITLE_CHARS)).alias("title"),
        squash(F.col("r.domain")).alias("domain"), squash(F.col("r.seendate")).alias("seendate"),
        squash(F.col("r.sourcecountry")).alias("sourcecountry"), squash(F.col("r.language")).alias("language"),
        F.col("probe_theme").alias("query"),
    ).filter("url != '' AND title != '' AND lower(language) IN ('', 'english')")
    return _records(
        rows, "gdelt", "news", desk=F.col("probe_desks"), entity_mentions=_no_mentions(),
        structured_data=F.struct("title", "domain", "seendate", "sourcecountry", "language", "url", "query"),
        text_chunk=tx.news_chunk(F.col("domain"), F.col("seendate"), F.col("title")),
        content_hash=tx.content_hash(F.col("url"), F.col("title")), native_id=F.col("url"), url=F.col("url"),
    )


def papers(landed: DataFrame) -> DataFrame:
    """Atom answers of a paper archive; the lead author is the mention."""
    parsed = landed.withColumn("p", F.from_xml("payload", schemas.ATOM))
    entry = parsed.select("probe_desks", "probe_theme", "fetched_at", F.explode_outer("p.entry").alias("e"))
    link = squash(F.col("e.id"))
    tail = F.when(F.contains(link, F.lit("/abs/")), F.substring_index(link, "/abs/", -1)).otherwise(
        F.substring_index(link, "/", -1)
    )
    names = F.transform(F.coalesce("e.author", F.array().cast("array<struct<name:string>>")), lambda a: squash(a["name"]))
    terms = F.transform(F.coalesce("e.category", F.array().cast("array<struct<_term:string>>")), lambda c: c["_term"])
    rows = entry.select(
        "probe_desks", F.col("probe_theme").alias("theme"), "fetched_at", link.alias("link"),
        F.regexp_replace(tail, r"v\d+$", "").alias("arxiv_id"), F.regexp_extract(tail, r"(v\d+)$", 1).alias("version"),
        squash(F.col("e.title")).alias("title"), squash(F.col("e.summary")).alias("abstract"),
        F.filter(names, lambda n: n != "").alias("authors"),
        F.col("e.`arxiv:primary_category`._term").alias("primary_category"),
        F.filter(terms, lambda t: F.coalesce(t, F.lit("")) != "").alias("categories"),
        F.col("e.published").alias("published"), F.col("e.updated").alias("updated"),
    ).filter("link != ''")
    lead = F.get("authors", 0)
    return _records(
        rows, "arxiv", "research_paper", desk=F.col("probe_desks"),
        entity_mentions=_mentions(
            _mention(mention=lead, normalized=F.upper(lead), entity_type=F.lit("person")), lead.isNotNull()
        ),
        structured_data=F.struct(
            "arxiv_id", "version", "title", "abstract", "authors", "primary_category", "categories", "published",
            "updated", "theme",
        ),
        text_chunk=tx.paper_chunk(
            F.col("title"), F.col("primary_category"), F.col("published"), F.col("authors"), F.col("abstract")
        ),
        content_hash=tx.json_hash(F.struct("abstract", "arxiv_id", "title", "version")),
        native_id=F.col("arxiv_id"), url=F.concat(F.lit("https://arxiv.org/abs/"), "arxiv_id"),
    )


def feeds(landed: DataFrame, max_items: int | None = None) -> DataFrame:
    """RSS or Atom bodies of registered outlets; ``probe_theme`` carries the outlet name.

    With ``max_items`` only the first of a body count, in document order; a body that is not XML gives nothing.
    """
    item = "array<struct<title:string,link:string,guid:string,summary:string,published:string>>"
    rss = F.transform(
        F.col("rss.channel.item"),
        lambda i: F.struct(
            drop_tags(i["title"]).alias("title"), strip(F.coalesce(i["link"], F.lit(""))).alias("link"),
            drop_tags(i["guid"]).alias("guid"), drop_tags(i["description"]).alias("summary"),
            drop_tags(i["pubDate"]).alias("published"),
        ),
    )

    def atom_link(links: Column) -> Column:
        hrefs = F.filter(links, lambda x: F.coalesce(x["_href"], F.lit("")) != "")
        main = F.filter(hrefs, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
        return F.coalesce(F.get(main, 0)["_href"], F.get(hrefs, 0)["_href"], F.lit(""))

    atom = F.transform(
        F.col("atom.entry"),
        lambda e: F.struct(
            drop_tags(e["title"]).alias("title"), atom_link(e["link"]).alias("link"), drop_tags(e["id"]).alias("guid"),
            drop_tags(F.coalesce(blank_to_null(e["summary"]), e["content"])).alias("summary"),
            drop_tags(F.coalesce(e["published"], e["updated"])).alias("published"),
        ),
    )
    parsed = landed.withColumn("rss", F.from_xml("payload", schemas.RSS)).withColumn(
        "atom", F.from_xml("payload", schemas.ATOM_NEWS)
    )
    rows = (
        parsed.select(
            "probe_desks", F.col("probe_theme").alias("outlet"), "fetched_at",
            F.posexplode_outer(F.coalesce(rss.cast(item), atom.cast(item))).alias("pos", "i"),
        )
        .filter(F.col("pos").isNotNull() if max_items is None else F.col("pos") < max_items)
        .select(
            "probe_desks", "outlet", "fetched_at", F.left("i.title", F.lit(dims.TITLE_CHARS)).alias("title"),
            F.col("i.link").alias("url"), F.col("i.guid").alias("guid"), F.col("i.published").alias("published"),
            F.left("i.summary", F.lit(dims.SNIPPET_CHARS)).alias("snippet"),
        )
        .filter((F.col("title") != "") & ((F.col("url") != "") | (F.col("guid") != "")) & ~tx.is_commerce_noise(F.col("title")))
    )
    native = F.coalesce(blank_to_null(F.col("guid")), F.col("url"))
    return _records(
        rows, "feeds", "news", desk=F.col("probe_desks"), entity_mentions=_no_mentions(),
        structured_data=F.struct("title", "outlet", "url", "published", "snippet"),
        text_chunk=tx.feed_chunk(F.col("outlet"), F.col("title"), F.col("snippet")),
        content_hash=tx.content_hash(native, F.col("title")), native_id=native, url=F.col("url"),
    )


def timelines(landed: DataFrame) -> DataFrame:
    """Volume series per theme; points that are not numbers are skipped."""
    parsed = landed.withColumn("p", F.from_json("payload", schemas.TIMELINE))
    points = F.transform(
        F.get("p.timeline", 0)["data"], lambda d: F.coalesce(d["value"], F.lit("0")).try_cast("double")
    )
    return parsed.select(
        "probe_theme", F.coalesce(F.filter(points, lambda v: v.isNotNull()), F.array().cast("array<double>")).alias("series")
    )


def companies(landed: DataFrame) -> DataFrame:
    """Company reference rows from a map keyed by row number; the first row of a CIK wins."""
    parsed = landed.select(F.explode_outer(F.from_json("payload", schemas.COMPANIES)).alias("row", "c"))
    rows = parsed.select(
        F.col("row").cast("bigint").alias("row"), F.upper(strip(F.coalesce("c.ticker", F.lit("")))).alias("ticker"),
        strip(F.coalesce("c.title", F.lit(""))).alias("name"), pad_cik(F.col("c.cik_str")).alias("cik"),
    ).filter("ticker != '' AND name != '' AND cik IS NOT NULL")
    w = Window.partitionBy("cik").orderBy("row")
    return (
        rows.withColumn("_r", F.row_number().over(w))
        .filter("_r = 1")
        .select("cik", "ticker", "name", normalize_mention(F.col("name")).alias("name_normalized"))
    )


def verdicts(answers: DataFrame) -> DataFrame:
    """Verdict rows from raw model answers, fenced or bare. ``answers``: item_id, answer."""
    schema = "struct<claim_evaluations: array<struct<id: string, supported: boolean>>>"
    parsed = answers.select("item_id", F.from_json(tx.verdict_json(F.col("answer")), schema).alias("v"))
    return parsed.select("item_id", F.explode_outer("v.claim_evaluations").alias("e")).filter("e IS NOT NULL").select(
        "item_id", F.regexp_replace("e.id", "^c", "").try_cast("int").alias("claim"),
        F.coalesce("e.supported", F.lit(False)).alias("supported"),
    )
