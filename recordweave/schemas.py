"""Declared schemas: payload shapes per source and the normalized record.

Payloads omit keys freely, so shapes are always declared and never inferred; a
missing key reads as null.
"""

AWARDS = """limit int, results array<struct<
  `Award ID`: string, `Recipient Name`: string, `Recipient UEI`: string, `Award Amount`: double,
  `Awarding Agency`: string, `Awarding Sub Agency`: string, `Start Date`: string, `End Date`: string,
  `Last Modified Date`: string, `Award Description`: string>>"""

OPPORTUNITIES = """totalRecords int, opportunitiesData array<struct<
  noticeId: string, title: string, fullParentPathName: string, type: string, postedDate: string,
  solicitationNumber: string, naicsCode: string, uiLink: string>>"""

REGISTER = """count int, results array<struct<
  document_number: string, title: string, type: string, abstract: string, html_url: string,
  publication_date: string, agencies: array<struct<raw_name: string, name: string, slug: string>>>>"""

FILINGS = """hits struct<hits: array<struct<_id: string, _source: struct<
  ciks: array<string>, display_names: array<string>, file_date: string, form: string,
  root_forms: array<string>, adsh: string, items: array<string>, sics: array<string>>>>>"""

NEWS = """articles array<struct<
  url: string, title: string, domain: string, seendate: string, language: string, sourcecountry: string>>"""

TIMELINE = "timeline array<struct<series: string, data: array<struct<date: string, value: string>>>>"

COMPANIES = "map<string, struct<cik_str: string, ticker: string, title: string>>"

ATOM = """entry array<struct<
  id: string, updated: string, published: string, title: string, summary: string,
  author: array<struct<name: string>>,
  `arxiv:primary_category`: struct<_term: string>,
  category: array<struct<_term: string>>>>"""

RSS = """channel struct<item: array<struct<
  title: string, link: string, guid: string, description: string, pubDate: string>>>"""

ATOM_NEWS = """entry array<struct<
  title: string, link: array<struct<_href: string, _rel: string>>, id: string, summary: string,
  content: string, published: string, updated: string>>"""

MENTION = """struct<mention: string, normalized: string, ticker: string, cik: string, uei: string,
  entity_type: string, entity_id: string, confidence: double, resolved_by: string>"""

# Column order of every parser's output.
RECORD_COLUMNS = [
    "source_id", "record_type", "desk", "entity_mentions", "structured_data",
    "text_chunk", "content_hash", "native_id", "url", "fetched_at",
]
