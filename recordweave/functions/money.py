"""Dollar amounts, rates and dates in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordweave import dims
from recordweave.functions.text import blank_to_null, let, strip


def _amounts(text: Column, pattern: str) -> Column:
    """Dollar values in text order: one pass over the text, then each short hit is read."""
    scales = F.create_map(*[F.lit(x) for kv in dims.AMOUNT_SCALES.items() for x in kv])

    def dollars(hit: Column) -> Column:
        number = F.replace(F.regexp_extract(hit, r"\d[\d,]*(?:\.\d+)?", 0), F.lit(","), F.lit(""))
        word = F.lower(F.regexp_extract(hit, "[A-Za-z]+", 0))
        return number.cast("double") * F.coalesce(F.try_element_at(scales, word), F.lit(1.0))

    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), dollars)


def first(items: Column, limit: int | None) -> Column:
    return items if limit is None else F.slice(items, 1, limit)


def amounts_usd(text: Column, limit: int | None = None) -> Column:
    """Amounts of a filing text in dollars, all or the first ``limit``."""
    return first(_amounts(text, dims.AMOUNT_PATTERN), limit)


def display_amounts(text: Column) -> Column:
    return _amounts(text, dims.DISPLAY_AMOUNT_PATTERN)


def percentages(text: Column, limit: int | None = None) -> Column:
    found = F.regexp_extract_all(text, F.lit(dims.PERCENT_PATTERN), F.lit(1))
    return F.transform(first(found, limit), lambda p: p.cast("double"))


def long_dates(text: Column, limit: int | None = None) -> Column:
    return first(F.regexp_extract_all(text, F.lit(dims.LONG_DATE_PATTERN), F.lit(0)), limit)


def excerpt(text: Column, chars: int = dims.EXCERPT_CHARS) -> Column:
    """A window that opens a third before the first amount, else after the cover page."""

    def start(at: Column) -> Column:
        return F.when(at > 0, F.greatest(F.lit(1), at - chars // 3)).otherwise(
            F.least(F.length(text), F.lit(dims.BOILERPLATE_CHARS)) + 1
        )

    return strip(F.substr(text, let(F.regexp_instr(text, F.lit(dims.AMOUNT_PATTERN)), start), F.lit(chars)))


def key_amount(headline: Column, body: Column) -> Column:
    """First figure of the headline, else the largest of the body."""
    return F.coalesce(F.get(display_amounts(headline), 0), F.array_max(display_amounts(body)))


def amount_kind(headline: Column, body: Column) -> Column:
    """``tracked`` or ``projected``, judged on the text that gave the figure."""

    def kind(text: Column) -> Column:
        forecast = text.rlike(dims.PROJECTION_PATTERN) | text.rlike(dims.HORIZON_PATTERN)
        return F.when(forecast, "projected").otherwise("tracked")

    return F.when(F.size(display_amounts(headline)) > 0, kind(headline)).when(
        F.size(display_amounts(body)) > 0, kind(body)
    )


def _scaled(value: Column) -> Column:
    """The figure in its display unit."""
    return F.when(value >= 1e9, value / 1e9).when(value >= 1e6, value / 1e6).when(value >= 1e3, value / 1e3).otherwise(value)


def _unit(value: Column) -> Column:
    return F.when(value >= 1e9, "B").when(value >= 1e6, "M").when(value >= 1e3, "K").otherwise("")


def _fixed(v: Column, digits: Column) -> Column:
    """Fixed decimals, rounded on the exact binary value, without group commas."""
    return F.replace(F.call_function("format_number", v, digits), F.lit(","), F.lit(""))


def general_format(v: Column) -> Column:
    """Six significant digits without trailing zeros (plain notation below 1e6, else exponent)."""
    trim = lambda c: F.regexp_replace(F.regexp_replace(c, r"(\.\d*?)0+$", "$1"), r"\.$", "")

    def shape(e: Column) -> Column:
        scaled = _fixed(v / F.pow(F.lit(10.0), e), F.lit(5))
        sign = F.when(e < 0, "-").otherwise("+")
        return F.when(e.between(-4, 5), trim(_fixed(v, F.greatest(F.lit(5) - e, F.lit(0))))).otherwise(
            F.concat(trim(scaled), F.lit("e"), sign, F.lpad(F.abs(e).cast("string"), 2, "0"))
        )

    exponent = F.substring_index(F.format_string("%.16e", v), "e", -1).try_cast("int")
    return F.when(v == 0, "0").when(v.isNotNull(), let(exponent, shape))


def format_usd(value: Column) -> Column:
    """``$1.5B`` with up to six significant digits."""
    return F.concat(F.lit("$"), general_format(_scaled(value)), _unit(value))


def format_usd_display(value: Column) -> Column:
    """``$1.5B`` with one decimal unless whole; small values as they are."""
    n = _scaled(value)
    whole = F.format_string("%d", n.cast("bigint"))
    # quarters are exact halves of a tenth and go up; everything else goes by its binary value
    tenth = F.when(n * 4 % 1 == 0, F.format_string("%.1f", n)).otherwise(_fixed(n, F.lit(1)))
    part = F.when(value >= 1e3, tenth).otherwise(n.cast("string"))
    return F.concat(F.lit("$"), F.when(n % 1 == 0, whole).otherwise(part), _unit(value))


def fact_summary(amounts: Column, rates: Column, dates: Column) -> Column:
    """Largest three amounts and rates and the first three dates, blank when there are none.

    A prefix goes only before a non-blank list, by pattern, so each list is built once.
    """

    def top(values: Column, shown, suffix: str = "") -> Column:
        best = F.slice(F.sort_array(F.array_distinct(values), asc=False), 1, 3)
        return F.array_join(F.transform(best, lambda v: F.concat(shown(v), F.lit(suffix))), ", ")

    lead = lambda word, c: F.regexp_replace(c, r"^(?=[\s\S])", f"{word} ")
    parts = F.array(
        lead("amounts", top(amounts, format_usd)), lead("rates", top(rates, general_format, "%")),
        lead("dates", F.array_join(F.slice(F.array_distinct(dates), 1, 3), "; ")),
    )
    joined = F.array_join(F.array_remove(parts, ""), " | ")
    return F.regexp_replace(joined, r"^([\s\S]+)$", "Key figures: $1.")


def enriched_chunk(metadata: Column, body: Column, chars: int = dims.EXCERPT_CHARS) -> Column:
    """Metadata line, key figures and excerpt, blanks dropped."""
    summary = fact_summary(amounts_usd(body), percentages(body), long_dates(body))
    return F.array_join(F.array_remove(F.array(metadata, summary, excerpt(body, chars)), ""), " ")


def form_d(xml: Column) -> Column:
    """Offering size, amount sold and industry of a private placement form."""

    def figure(tag: str) -> Column:
        raw = F.regexp_extract(xml, rf"(?i)<{tag}>\s*([\d,.]+)\s*</{tag}>", 1)
        return F.replace(blank_to_null(raw), F.lit(","), F.lit("")).try_cast("double")

    industry = F.regexp_extract(xml, r"(?i)<industryGroupType>\s*([^<]+?)\s*</industryGroupType>", 1)
    return F.struct(
        figure("totalOfferingAmount").alias("total_offering_usd"),
        figure("totalAmountSold").alias("total_sold_usd"),
        blank_to_null(F.trim(industry)).alias("industry"),
    )


def form_d_amount(facts: Column) -> Column:
    """The raise size, else what is sold so far; a zero offering falls through."""
    offering = facts["total_offering_usd"]
    return F.coalesce(F.when(offering != 0, offering), facts["total_sold_usd"])


def form_d_chunk(company: Column, ticker: Column, facts: Column) -> Column:
    detail = F.concat_ws(
        "; ",
        F.concat(F.lit("offering "), format_usd(facts["total_offering_usd"])),
        F.concat(format_usd(facts["total_sold_usd"]), F.lit(" sold to date")),
        F.concat(F.lit("industry "), facts["industry"]),
    )
    tick = F.when(F.coalesce(ticker, F.lit("")) != "", F.concat(F.lit(" ("), ticker, F.lit(")"))).otherwise("")
    return F.concat(
        F.lit("SEC Form D private placement by "), company, tick, F.lit(": "),
        F.coalesce(blank_to_null(detail), F.lit("amount not disclosed")), F.lit("."),
    )
