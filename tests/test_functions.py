import datetime as dt

import pytest
from pyspark.sql import functions as F

from recordweave.functions import citations, dates, html, money, names, scoring, text

c = F.col("v")


@pytest.mark.parametrize(
    "given, want",
    [
        ("Apple Inc.", "APPLE"), ("Palantir, Inc", "PALANTIR"), ("NORTHROP GRUMMAN CORP /DE/", "NORTHROP GRUMMAN"),
        ("AC/DC Ltd", "AC/DC"), ("Big Co Ltd", "BIG CO"), ("  Spaced   Out  LLC ", "SPACED OUT"), ("INC", "INC"), ("", ""),
        ("Siemens AG", "SIEMENS"), ("U.S. Steel Corporation", "U S STEEL"),
    ],
)
def test_normalize_mention(value, given, want):
    assert value(names.normalize_mention(c), v=given) == want


@pytest.mark.parametrize("given, want", [("Acme Corp Inc LLC", "ACME"), ("ACME", "ACME"), ("Co Works", "CO WORKS")])
def test_normalize_award_name(value, given, want):
    assert value(names.normalize_award_name(c), v=given) == want


def test_pad_cik(value):
    assert value(names.pad_cik(c), v="320193") == "0000320193"
    assert value(names.pad_cik(c), v="12345678901") == "12345678901"


@pytest.mark.parametrize(
    "a, b, want",
    [("ABC", "ABC", 1.0), ("", "ABC", 0.0), ("A", "B", 0.0), ("ABCD", "ABCE", 0.5), ("", "", 1.0)],
)
def test_bigram_similarity(value, a, b, want):
    assert value(names.bigram_similarity(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want)


def test_trigrams_pad_each_word(value):
    assert sorted(value(names.trigrams(c), v="Cat a")) == sorted(["  c", " ca", "cat", "at ", "  a", " a "])


@pytest.mark.parametrize(
    "a, b, want",
    [
        ("Northrop Grumman Corp /DE/", "Northrop Grumman Systems Corporation", True), ("General Dynamics", "General Electric", False),
        ("Acme Inc", "ACME", True), ("Acme", "Acme Systems", False), ("", "Acme", False), ("Blue Sea", "Blue Seas", False),
    ],
)
def test_same_company(value, a, b, want):
    assert value(names.same_company(F.col("a"), F.col("b")), a=a, b=b) is want


@pytest.mark.parametrize(
    "given, want",
    [
        ("a $1.5 billion deal", [1.5e9]), ("$1,200 million", [1.2e9]), ("$500,000", [500000.0]), ("$3.2B and $5 k", [3.2e9, 5000.0]),
        ("$2tn", [2e12]), ("no money", []), ("$ 7 MM", [7e6]), ("$5x", []),
    ],
)
def test_amounts(value, given, want):
    assert value(money.amounts_usd(c), v=given) == pytest.approx(want)


def test_all_amounts_or_the_first(value):
    text = " ".join(f"${i}" for i in range(1, 40))
    assert value(money.amounts_usd(c), v=text) == [float(i) for i in range(1, 40)]
    assert value(money.amounts_usd(c, 25), v=text) == [float(i) for i in range(1, 26)]


def test_display_amounts_know_no_tn(value):
    assert value(money.display_amounts(c), v="$2tn or $3bn") == [3e9]


@pytest.mark.parametrize(
    "headline, body, amount, kind",
    [
        ("Award of $55.9M", "worth $1B", 55.9e6, "tracked"), ("News", "pays $1B and $2B", 2e9, "tracked"),
        ("News", "$720B of grid investment is needed by 2030", 720e9, "projected"), ("Market size of $5B", "", 5e9, "projected"),
        ("Award of $5M", "projected $9B", 5e6, "tracked"), ("News", "none", None, None),
    ],
)
def test_key_amount_and_kind(value, headline, body, amount, kind):
    h, b = F.col("h"), F.col("b")
    assert value(money.key_amount(h, b), h=headline, b=body) == amount
    assert value(money.amount_kind(h, b), h=headline, b=body) == kind


@pytest.mark.parametrize(
    "given", [5.25e9, 999999.0, 1234567.0, 12.5, 1e12, 1500.0, 55.9e6, 10177.05, 0.5, 1e9, 7.0, 123456.5, 2.5e13]
)
def test_format_usd_like_g(value, given):
    for unit, label in ((1e9, "B"), (1e6, "M"), (1e3, "K"), (1, "")):
        if given >= unit or unit == 1:
            assert value(money.format_usd(c), v=given) == f"${given / unit:g}{label}"
            break


@pytest.mark.parametrize("given, want", [(1.5e9, "$1.5B"), (700e6, "$700M"), (55.9e6, "$55.9M"), (500e3, "$500K"), (1.25e6, "$1.3M"), (12.5, "$12.5"), (7.0, "$7")])
def test_format_usd_display(value, given, want):
    assert value(money.format_usd_display(c), v=given) == want


def test_fact_summary(value):
    body = "Paid $5M, $2B and $5M at 4.5% and 10% on May 7, 2026 and June 1 2026."
    got = value(money.fact_summary(money.amounts_usd(c), money.percentages(c), money.long_dates(c)), v=body)
    assert got == "Key figures: amounts $2B, $5M | rates 10%, 4.5% | dates May 7, 2026; June 1 2026."
    assert value(money.fact_summary(money.amounts_usd(c), money.percentages(c), money.long_dates(c)), v="plain") == ""


def test_excerpt(value):
    body = "x" * 1000 + " $5 " + "y" * 3000
    assert value(money.excerpt(c, 300), v=body) == body[901:1201].strip()
    assert value(money.excerpt(c, 300), v="z" * 1000) == "z" * 300
    assert value(money.excerpt(c, 300), v="short") == ""


def test_form_d(value):
    xml = "<totalOfferingAmount>Indefinite</totalOfferingAmount><totalAmountSold> 1,500 </totalAmountSold><industryGroupType> Oil </industryGroupType>"
    facts = value(money.form_d(c), v=xml)
    assert (facts["total_offering_usd"], facts["total_sold_usd"], facts["industry"]) == (None, 1500.0, "Oil")
    assert value(money.form_d_amount(money.form_d(c)), v=xml) == 1500.0
    assert value(money.form_d_chunk(F.lit("Co"), F.lit("T"), money.form_d(c)), v=xml) == (
        "SEC Form D private placement by Co (T): $1.5K sold to date; industry Oil."
    )
    assert value(money.form_d_chunk(F.lit("Co"), F.lit(None).cast("string"), money.form_d(c)), v="").endswith("amount not disclosed.")


@pytest.mark.parametrize(
    "given, want",
    [
        ("[CITE 12] [CITE: 3] [cite-4] (CITE:5) 【CITE:6】 [7] ［8］", "[CITE:12] [CITE:3] [CITE:4] [CITE:5] [CITE:6] [CITE:7] [CITE:8]"),
        ("[CITE:007] [00]", "[CITE:7] [CITE:0]"), ("(2) [1234] [1-3] [CITE:12345]", "(2) [1234] [1-3] [CITE:12345]"),
    ],
)
def test_repair_citations(value, given, want):
    assert value(citations.repair_citations(c), v=given) == want


def test_citation_indices(value):
    assert value(citations.citation_indices(c), v="a [CITE:3] b [CITE:1] c [CITE:3]") == [3, 1]


@pytest.mark.parametrize(
    "given, want",
    [
        ("One. Two! Three? four. Five", ["One.", "Two!", "Three? four.", "Five"]),
        ("The U.S. Space Force won. Gen. Lt. Smith left.", ["The U.S. Space Force won.", "Gen. Lt. Smith left."]),
        ("It is Inc! Then etc... More", ["It is Inc!", "Then etc... More"]), ("End.\nGen. Smith", ["End.", "Gen. Smith"]),
        ("(U.S. Army", ["(U.S.", "Army"]), ("", [""]),
    ],
)
def test_sentences(value, given, want):
    assert value(citations.sentences(c), v=given) == want


def test_strip_uncited_and_claims(value):
    body = "Cited [CITE:1]. Not cited. Also (CITE:2)."
    assert value(citations.strip_uncited(c), v=body) == "Cited [CITE:1]. Also [CITE:2]."
    got = value(citations.claims(c), v="A [CITE:1]. B.")
    assert [(x["position"], x["text"], x["indices"]) for x in got] == [(0, "A [CITE:1].", [1]), (1, "B.", [])]


@pytest.mark.parametrize(
    "given, want",
    [
        ("2026-01-15", "2026-01-15 00:00:00"), ("2026-01-15T12:00:00Z", "2026-01-15 12:00:00"),
        ("Mon, 29 Jun 2026 12:00:00 GMT", "2026-06-29 12:00:00"), ("29 Jun 2026 12:00:00 +0100", "2026-06-29 11:00:00"),
        ("20260628T120000Z", "2026-06-28 12:00:00"), ("20260628", "2026-06-28 00:00:00"), ("20260628120102", "2026-06-28 12:01:02"),
        ("yesterday", None), ("", None), (None, None), ("2026", None),
    ],
)
def test_parse_published(value, given, want):
    got = value(F.date_format(dates.parse_published(c), "yyyy-MM-dd HH:mm:ss"), v=given)
    assert got == want


def test_published_at_prefers_the_source_key(value):
    field = lambda key: {"last_modified": F.lit("2026-02-01"), "start_date": F.lit("2001-01-01"), "date": F.lit("2020-01-01")}.get(
        key, F.lit(None).cast("string")
    )
    day = lambda source: value(dates.published_at(F.lit(source), field)).date()
    assert day("usaspending") == dt.date(2026, 2, 1)
    assert day("nobody") == dt.date(2020, 1, 1)


@pytest.mark.parametrize("start, old", [("2020-01-01", True), ("2026-01-01", False), (None, False), ("soon", False), ("2022-07-02", False), ("2022-07-01T00:00:00", True)])
def test_award_too_old(value, start, old):
    assert value(dates.award_too_old(c, "2026-07-01"), v=start) is old


@pytest.mark.parametrize(
    "given, want",
    [
        ("Contract Award", "award"), ("policy_change", "policy"), ("LAUNCH", "operational"), ("weird", "signal"), (None, "signal"),
        ("new research-paper", "research"), ("macro", "macro"),
    ],
)
def test_item_type(value, given, want):
    assert value(text.item_type(c), v=given) == want


@pytest.mark.parametrize(
    "given, want",
    [
        ('{"text": "hi"}', "hi"), ('{"rewritten": "{\\"body\\": \\"deep\\"}"}', "deep"), ('{"x": 1, "analysis": "two"}', "two"),
        ('{"n": 5}', '{"n": 5}'), ("plain", "plain"), ("{broken", "{broken"), (None, ""), ('{"a": "x", "b": "y"}', '{"a": "x", "b": "y"}'),
    ],
)
def test_json_unwrap(value, given, want):
    assert value(text.json_unwrap(c), v=given) == want


@pytest.mark.parametrize(
    "given, want",
    [
        ("Big news | Radio 105\nmore", "big news"), ("  F - 35!  ", "f 35"), ("||", ""), ("", ""), (None, ""), ("\n\nFirst\r\nSecond", "first"),
    ],
)
def test_title_key(value, given, want):
    assert value(text.title_key(c), v=given) == want


@pytest.mark.parametrize("given, want", [("D-Wave Quantum Inc.", "D-Wave Quantum Inc."), ("CENTRUS ENERGY CORP", "Centrus Energy Corp"), ("O'NEIL A-MARK", "O'Neil A-Mark")])
def test_display_name(value, given, want):
    assert value(text.display_name(c), v=given) == want


@pytest.mark.parametrize(
    "given, want", [("https://www.NavalNews.com/a?b", "navalnews.com"), ("not a url", ""), ("/rel", ""), ("http://m.x.org:80/", "m.x.org")]
)
def test_url_host(value, given, want):
    assert value(text.url_host(c), v=given) == want


@pytest.mark.parametrize("given, want", [("Save Up To 40", True), ("GPU 30% off", True), ("$1,200 off", True), ("prices plummet $5", True), ("HBM supply tight", False)])
def test_commerce_noise(value, given, want):
    assert value(text.is_commerce_noise(c), v=given) is want


def test_leak(value):
    assert value(text.looks_like_leak(c), v=' {"text": 1}') is True
    assert value(text.looks_like_leak(c), v='{odd} "prose"') is False


def test_verdict_json(value):
    assert value(text.verdict_json(c), v='x ```json\n{"a": 1}\n``` y') == '{"a": 1}'
    assert value(text.verdict_json(c), v="nope") is None
    assert value(text.verdict_json(c), v=None) is None


def test_html_text(value):
    page = "<p>a &amp; b</p><script>x()</script><style>p{}</style>  c"
    assert value(html.html_text(c), v=page) == "a & b c"
    assert value(html.html_text(c), v="plain   text &amp;") == "plain text &amp;"
    assert value(html.html_text(c), v=None) == ""
    assert value(html.html_text(c), v="a <![foo[ x") == "a"
    assert value(html.html_text(c), v="5 < 6<!-- <p> hidden --> is\u00a0so<br/>&eacute;") == "5 < 6 is so é"
    assert value(html.html_text(c), v="<p>shown<script>var t = '</p>'") == "shown"


@pytest.mark.parametrize("amount, want", [(None, 0.0), (0.0, 0.0), (5e5, 0.05), (1e6, 0.15), (5e6, 0.2), (1e7, 0.4), (1e8, 0.7), (1e9, 1.0)])
def test_magnitude_bucket(value, amount, want):
    col = F.lit(amount).cast("double")
    assert value(scoring.magnitude_bucket(col)) == want


def test_magnitude_is_not_clamped(value):
    lit = lambda x: F.lit(float(x))
    assert value(scoring.magnitude(lit(0), lit(10), lit(20), F.lit(10))) == -1.0
    assert value(scoring.magnitude(lit(5e6), lit(1), lit(2), F.lit(9))) == 0.2
    assert value(scoring.magnitude(lit(5), lit(7), lit(7), F.lit(10))) == 0.0


def test_materiality(value):
    got = value(scoring.materiality(F.lit("usaspending"), F.lit(1.0), F.lit("company"), F.lit(5), F.lit(3)))
    assert got == 1.0  # capped
    got = value(scoring.materiality(F.lit("nobody"), F.lit(0.0), F.lit("odd"), F.lit(0), F.lit(2)))
    assert got == pytest.approx(0.6 * 0.3 + 0.2 + 0.5 * 0.15 + 0.02)


@pytest.mark.parametrize(
    "source, supported, only, want",
    [("edgar", True, False, "confirmed"), ("edgar", False, False, "analysis"), ("feeds", True, False, "reported"), ("gdelt", True, False, "speculative"), ("new", True, False, "reported"), ("edgar", True, True, "analysis")],
)
def test_attribution(value, source, supported, only, want):
    assert value(scoring.attribution(F.lit(source), F.lit(supported), F.lit(only))) == want


def test_decay(value):
    assert value(scoring.recency_weight(F.lit(60), 30.0)) == 0.25
    assert value(scoring.recency_weight(F.lit(-5), 30.0)) == 1.0
    assert value(scoring.recency_weight(F.lit(5), 0)) == 1.0
    assert value(scoring.confidence(F.lit(2.0))) == 0.75
