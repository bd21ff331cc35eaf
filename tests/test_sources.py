"""Parsers on small payloads, sinks on a temporary folder."""

import datetime as dt
import json

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from recordweave.sources import landing, parsers, sinks

AT = dt.datetime(2026, 7, 1)


def landed(spark, payload, desks=("defense", "ai"), theme="probe"):
    text = payload if isinstance(payload, str) else json.dumps(payload)
    return spark.createDataFrame([(text, list(desks), theme, AT)], landing.LANDED)


def test_awards(spark):
    payload = {
        "limit": 5, "extra": {"ignored": 1},
        "results": [
            {"Award ID": "W1", "Recipient Name": "Acme Corp Inc", "Recipient UEI": "U1", "Award Amount": 2500000.5, "Awarding Agency": "DoD",
             "Awarding Sub Agency": "Navy", "Start Date": "2026-01-01", "End Date": "2027-01-01", "Award Description": "Radar"},
            {"Award ID": "W2", "Start Date": "1993-01-01"}, {"Award ID": ""}, {"Award ID": "W3", "Award Amount": 1},
        ],
    }
    got = {r["native_id"]: r for r in parsers.awards(landed(spark, payload), "2026-07-01").collect()}
    assert set(got) == {"W1", "W3"}
    one = got["W1"]
    assert one["source_id"] == "usaspending" and one["desk"] == ["defense", "ai"] and one["fetched_at"] == AT
    assert one["entity_mentions"][0]["normalized"] == "ACME" and one["structured_data"]["recipient_uei"] == "U1"
    assert one["text_chunk"].startswith("Federal award: Radar | Recipient: Acme Corp Inc | Amount: $2,500,000 |")
    assert one["url"] == "https://www.usaspending.gov/award/W1/" and len(one["content_hash"]) == 64
    assert got["W3"]["entity_mentions"] == []


def test_award_hash_covers_every_field(spark):
    def hashed(modified):
        payload = {"results": [{"Award ID": "W1", "Last Modified Date": modified}]}
        return parsers.awards(landed(spark, payload), "2026-07-01").first()["content_hash"]

    assert hashed("2026-01-01") != hashed("2026-01-02")


def test_opportunity_hash_leaves_the_probe_out(spark):
    payload = {"opportunitiesData": [{"noticeId": "N1", "title": " Two \n words ", "postedDate": "2026-06-01"}, {"noticeId": "N2", "title": " "}]}
    a = parsers.opportunities(landed(spark, payload, theme="a")).collect()
    b = parsers.opportunities(landed(spark, payload, theme="b")).collect()
    assert len(a) == 1 and a[0]["content_hash"] == b[0]["content_hash"]
    assert a[0]["text_chunk"] == 'A federal agency posted a opportunity (2026-06-01): "Two words".'
    assert a[0]["url"] == "https://sam.gov/opp/N1/view"


def test_filings(spark):
    source = {"display_names": ["BLUE HERON Labs  (BHL)  (CIK 0000042317)"], "file_date": "2026-06-01", "form": "8-K", "adsh": "0001-26-01"}
    payload = {"hits": {"hits": [
        {"_id": "0001-26-01:doc.htm", "_source": source}, {"_id": "x", "_source": {}},
        {"_id": "0001-26-02", "_source": {"display_names": ["Plain Name"], "root_forms": ["D"], "adsh": "0001-26-02"}},
    ]}}
    got = {r["native_id"]: r for r in parsers.filings(landed(spark, payload)).collect()}
    assert set(got) == {"0001-26-01:doc.htm", "0001-26-02"}
    one = got["0001-26-01:doc.htm"]
    assert one["url"] == "https://www.sec.gov/Archives/edgar/data/42317/00012601/doc.htm"
    assert one["entity_mentions"][0]["ticker"] == "BHL" and one["entity_mentions"][0]["cik"] == "0000042317"
    assert one["text_chunk"] == 'SEC 8-K filing by BLUE HERON Labs (BHL) on 2026-06-01, referencing "probe".'
    two = got["0001-26-02"]
    assert two["structured_data"]["form"] == "D" and two["structured_data"]["company_name"] == "Plain Name"
    assert two["url"] == "https://www.sec.gov/cgi-bin/browse-edgar"


def test_register(spark):
    payload = {"results": [{"document_number": "2026-1", "title": "Oklo and  Centrus", "type": "Notice", "abstract": "x" * 701,
                            "publication_date": "2026-06-01", "agencies": [{"raw_name": "RAW", "name": "NRC"}]}, {"title": "no number"}]}
    (one,) = parsers.register(landed(spark, payload)).collect()
    assert [m["ticker"] for m in one["entity_mentions"]] == ["OKLO", "LEU"]
    assert one["text_chunk"] == f'NRC Notice (2026-06-01): "Oklo and Centrus". Summary: {"x" * 700}…'


def test_news_language(spark):
    arts = [{"url": f"u{i}", "title": "T", "language": lang} for i, lang in enumerate(["English", "", "ENGLISH", "French"])] + [{"url": "u9"}]
    got = parsers.news(landed(spark, {"articles": arts})).collect()
    assert sorted(r["native_id"] for r in got) == ["u0", "u1", "u2"]
    assert got[0]["text_chunk"] == 'news source reported: "T".'


def test_papers(spark):
    xml = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><entry>
      <id>http://arxiv.org/abs/2406.01234v2</id><published>2026-06-01T00:00:00Z</published><title>A
      long   title</title><summary> Text </summary><author><name>Ann B</name></author><author><name>C</name></author>
      <arxiv:primary_category term="cs.LG"/><category term="cs.LG"/><category term="cs.AI"/></entry></feed>"""
    (one,) = parsers.papers(landed(spark, xml)).collect()
    assert one["native_id"] == "2406.01234" and one["structured_data"]["version"] == "v2"
    assert one["structured_data"]["categories"] == ["cs.LG", "cs.AI"] and one["entity_mentions"][0]["normalized"] == "ANN B"
    assert one["text_chunk"] == 'arXiv cs.LG paper "A long title" (2026-06-01) by Ann B, C. Abstract: Text'


def test_feeds(spark):
    items = "".join(f"<item><title>T{i}</title><link>https://o/{i}</link><description>&lt;b&gt;s&lt;/b&gt;</description></item>" for i in range(15))
    rss = f"<rss><channel><title>x</title><item><title>Save up to half</title><link>l</link></item>{items}</channel></rss>"
    assert parsers.feeds(landed(spark, rss, theme="Outlet")).count() == 15  # sixteen items, one of them is a deal
    got = parsers.feeds(landed(spark, rss, theme="Outlet"), max_items=12).collect()
    assert len(got) == 11
    assert {r["text_chunk"] for r in got} >= {'Outlet reported: "T0". s'} and got[0]["native_id"].startswith("https://o/")
    atom = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link rel="self" href="s"/><link href="main"/><id>i1</id>
      <updated>2026-06-01</updated></entry><entry><title>No link or id</title></entry></feed>"""
    (one,) = parsers.feeds(landed(spark, atom, theme="O")).collect()
    assert (one["native_id"], one["url"], one["structured_data"]["published"]) == ("i1", "main", "2026-06-01")
    assert parsers.feeds(landed(spark, "<rss><broken")).count() == 0


def test_timelines(spark):
    payload = {"timeline": [{"series": "V", "data": [{"date": "a", "value": 1.5}, {"value": "x"}, {"date": "b"}, {"value": 2}]}]}
    assert parsers.timelines(landed(spark, payload)).first()["series"] == [1.5, 0.0, 2.0]
    assert parsers.timelines(landed(spark, {"timeline": []})).first()["series"] == []


def test_companies_first_row_of_a_cik_wins(spark):
    payload = {"0": {"cik_str": 77, "ticker": "kite", "title": "Kite Mills Ltd"}, "2": {"cik_str": 9001, "ticker": "ORB", "title": "Orbit Foods Inc."},
               "1": {"cik_str": 9001, "ticker": "ORBA", "title": "Orbit Foods Inc."}, "3": {"cik_str": 5, "ticker": "", "title": "No"}}
    got = sorted((r["cik"], r["ticker"], r["name_normalized"]) for r in parsers.companies(landed(spark, payload)).collect())
    assert got == [("0000000077", "KITE", "KITE MILLS"), ("0000009001", "ORBA", "ORBIT FOODS")]


# --- sinks ---------------------------------------------------------------------------------

def batch(spark, ids):
    rows = [("s", f"n{i}", f"h{i}", k) for k, i in enumerate(ids)]
    return spark.createDataFrame(rows, "source_id string, native_id string, content_hash string, arrival int")


def test_append_new_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "raw")
    first = sinks.append_new(spark, batch(spark, [1, 2, 2, 3]), path, "run1").first()
    assert (first["fetched"], first["new"], first["duplicate"]) == (4, 3, 1)
    second = sinks.append_new(spark, batch(spark, [3, 4]), path, "run2").first()
    assert (second["new"], second["duplicate"]) == (1, 1)
    again = sinks.append_new(spark, batch(spark, [3, 4]), path, "run2").first()  # a rerun replaces itself
    assert (again["new"], again["duplicate"]) == (1, 1)
    assert spark.read.parquet(path).count() == 4
    third = sinks.append_new(spark, batch(spark, [1, 4]), path, "run3").first()
    assert (third["new"], third["duplicate"]) == (0, 2)


def test_replace_briefs_by_desk_and_date(spark, tmp_path):
    root = str(tmp_path)

    def write(version, desk, items, stray="none"):
        briefs = spark.createDataFrame([(desk, "2026-07-01", f"b{version}", "x")], "desk string, date string, brief_id string, headline string")
        children = spark.createDataFrame([(d, "2026-07-01", i) for i in items for d in (desk, stray)], "desk string, date string, item_id int")
        sinks.replace_briefs(briefs, children, children.withColumnRenamed("item_id", "citation_id"), root, version)

    write("001", "ai", [1, 2]), write("002", "energy", [3]), write("003", "ai", [9]), write("004", None, [4])
    rows = sinks.read_briefs(spark, root, "brief_items").collect()
    assert {(r["desk"], r["item_id"]) for r in rows} == {("ai", 9), ("energy", 3), (None, 4)} and len(rows) == 3
    write("005", "ai", [])  # a brief that lost its items takes the old ones with it
    assert {r["desk"] for r in sinks.read_briefs(spark, root, "brief_items").collect()} == {"energy", None}
    assert {r["brief_id"] for r in sinks.read_briefs(spark, root).collect()} == {"b005", "b002", "b004"}
    write("002", "energy", [7])  # tried again
    assert {r["citation_id"] for r in sinks.read_briefs(spark, root, "citations").collect()} == {7, 4}


@pytest.mark.parametrize("at", ["briefs", "brief_items", "citations"])
def test_a_write_that_fails_half_way_is_not_seen(spark, tmp_path, at, monkeypatch):
    root = str(tmp_path)
    briefs = spark.createDataFrame([("ai", "2026-07-01", "old")], "desk string, date string, brief_id string")
    kids = spark.createDataFrame([("ai", "2026-07-01", 1)], "desk string, date string, item_id int")
    sinks.replace_briefs(briefs, kids, kids, root, "001")
    fresh = briefs.withColumn("brief_id", F.lit("new"))
    write = DataFrameWriter.parquet

    def broken(self, path, *args, **kwargs):
        if f"/{at}/" in path:
            raise RuntimeError("lost")
        return write(self, path, *args, **kwargs)

    more = kids.withColumn("item_id", F.lit(2))
    with monkeypatch.context() as patch:
        patch.setattr(DataFrameWriter, "parquet", broken)
        with pytest.raises(RuntimeError):
            sinks.replace_briefs(fresh, more, more, root, "002")
    seen = [sinks.read_briefs(spark, root, name).collect() for name in ("briefs", "brief_items", "citations")]
    assert seen[0][0]["brief_id"] == "old" and [r["item_id"] for r in seen[1] + seen[2]] == [1, 1]
    sinks.replace_briefs(fresh, more, more, root, "002")
    seen = [sinks.read_briefs(spark, root, name).collect() for name in ("briefs", "brief_items", "citations")]
    assert seen[0][0]["brief_id"] == "new" and [r["item_id"] for r in seen[1] + seen[2]] == [2, 2]


def test_write_edges_versions(spark, tmp_path):
    state = spark.createDataFrame([("a", "b", None), ("a", "c", "2026-07-01")], "from_id string, to_id string, valid_to string")
    path = sinks.write_edges(state, str(tmp_path), "1")
    assert spark.read.parquet(path).filter("state = 'live'").count() == 1


def test_read_landed_and_files(spark, tmp_path):
    landed(spark, {"articles": [{"url": "u", "title": "T"}]}).write.parquet(str(tmp_path / "landed"))
    assert parsers.news(landing.read_landed(spark, str(tmp_path / "landed"))).count() == 1
    (tmp_path / "one.json").write_text('{"articles": [\n{"url": "u", "title": "T"}]}')
    assert parsers.news(landing.read_files(spark, str(tmp_path / "one.json"), ["ai"], "q")).first()["desk"] == ["ai"]


@pytest.mark.parametrize("answer, want", [("```json\n{\"claim_evaluations\": [{\"id\": \"c2\", \"supported\": true}, {\"id\": \"c3\"}]}\n```", [(2, True), (3, False)]), ("oops", [])])
def test_verdict_rows(spark, answer, want):
    df = spark.createDataFrame([(1, answer)], "item_id int, answer string")
    assert sorted((r["claim"], r["supported"]) for r in parsers.verdicts(df).select("claim", F.col("supported")).collect()) == want


def test_probe_table_feeds_the_phrase_operators(spark):
    from recordweave.operators import gazetteer, telemetry
    from recordweave.sources.probes import probe_table

    probes = probe_table(spark)
    assert {r["phrase"] for r in telemetry.themes_for_desk(probes.filter("source_id = 'nrc'"), "energy").collect()} >= {"TRISO"}
    news = probes.filter("source_id = 'gdelt'").select(F.get("desks", 0).alias("desk"), "phrase", "position")
    groups = telemetry.or_queries(news).collect()
    assert sum(r["query"].count('"') // 2 for r in groups) == news.count() and max(r["query"].count(" OR ") for r in groups) == 7
    docs = spark.createDataFrame([(1, "A hyperscale data center, grid-scale storage, high-assay low-enriched uranium"), (2, "nothing")], "doc_id int, text string")
    hits = gazetteer.theme_tags(docs, probes.filter("source_id = 'edgar'"))
    assert {(r["doc_id"], r["phrase"]) for r in hits.collect()} == {(1, "hyperscale data center"), (1, "grid-scale storage"), (1, "high-assay low-enriched uranium")}
