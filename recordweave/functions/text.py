"""Text clean-up, titles, hosts, hashes, JSON wrappers and chunk templates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordweave import dims

# every character Python or a browser would call white space
SPACE = (
    r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
    r"\x{202f}\x{205f}\x{3000}]"
)
LINE_END = r"\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}"


# the same characters as a plain list, for trimming without a pattern
SPACE_CHARS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def strip(c: Column) -> Column:
    """Trim every kind of white space, null stays null."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def squash(c: Column) -> Column:
    """Collapse white space runs to one blank and trim; null reads as blank."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE}+", " "))


def drop_tags(c: Column) -> Column:
    """Markup tags become a blank, then white space is collapsed."""
    return squash(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", " "))


def title_key(c: Column) -> Column:
    """Headline identity: first line up to ``|``, lower case, only a-z0-9 words."""
    head = F.regexp_extract(strip(F.coalesce(c, F.lit(""))), f"^[^|{LINE_END}]*", 0)
    return F.trim(F.regexp_replace(F.lower(head), "[^a-z0-9]+", " "))


def any_contains(text: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles])


def is_commerce_noise(title: Column) -> Column:
    """Retail-deal and consumer-gaming headlines."""
    return any_contains(F.lower(title), dims.COMMERCE_NOISE) | title.rlike(dims.COMMERCE_NOISE_PATTERN)


def looks_like_leak(text: Column) -> Column:
    """Text that opens as a JSON wrapper object rather than prose."""
    body = strip(F.coalesce(text, F.lit("")))
    return F.startswith(body, F.lit("{")) & any_contains(body, dims.LEAK_MARKERS)


def url_host(url: Column) -> Column:
    """Lower-case host without a leading ``www.``; blank when there is none."""
    host = F.lower(F.try_parse_url(F.trim(url), F.lit("HOST")))
    return F.coalesce(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def display_name(name: Column) -> Column:
    """Title-case all-caps names, leave names that already carry lower case."""
    lowered = F.lower(name)
    # a word starts at any word boundary, as in "O'NEIL" or "A-MARK"
    cased = F.array_join(
        F.transform(
            F.regexp_extract_all(lowered, F.lit(r"\w+|\W+"), F.lit(0)),
            lambda w: F.when(w.rlike("^[a-z]"), F.initcap(w)).otherwise(w),
        ),
        "",
    )
    return F.when(name.rlike("[a-z]"), name).otherwise(cased)


def content_hash(*parts: Column, sep: str = "\n") -> Column:
    return F.sha2(F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def json_hash(record: Column) -> Column:
    """Hash of every field of a struct, in declared order."""
    return F.sha2(F.to_json(record, {"ignoreNullFields": "false"}), 256)


def let(value: Column, use) -> Column:
    """Bind ``value`` to a name for ``use``, so a long expression is written and run once."""
    return F.get(F.transform(F.array(value), use), 0)


def _unwrap_once(text: Column) -> Column:
    is_object = F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}"))

    def inside(obj: Column) -> Column:
        # a variant map keeps each value's JSON type, so only strings are taken out
        entries = F.map_from_entries(
            F.filter(F.map_entries(obj), lambda e: F.schema_of_variant(e["value"]) == "STRING")
        )
        as_text = F.transform_values(entries, lambda _, v: F.try_variant_get(v, "$", "string"))
        only = F.get(F.map_values(as_text), 0)
        known = F.get(
            F.array_compact(F.array(*[F.try_element_at(as_text, F.lit(k)) for k in dims.WRAPPER_KEYS])), 0
        )
        return F.when(F.size(obj) == 1, only).otherwise(known)

    parsed = F.try_variant_get(F.try_parse_json(F.when(is_object, text)), "$", "map<string,variant>")
    return F.coalesce(strip(let(parsed, inside)), text)


def json_unwrap(value: Column, depth: int = 2) -> Column:
    """Take prose out of a stray JSON object, also when wrapped ``depth`` times."""
    out = strip(F.coalesce(value, F.lit("")))
    for _ in range(depth):
        out = let(out, _unwrap_once)
    return out


def verdict_json(text: Column) -> Column:
    """The JSON inside a fenced or bare model answer, null when it does not parse."""
    body = strip(F.coalesce(text, F.lit("")))
    fenced = strip(F.regexp_extract(body, r"```(?:json)?\s*([\s\S]*?)\s*```", 1))
    picked = F.when(body.rlike(r"```(?:json)?\s*[\s\S]*?\s*```"), fenced).otherwise(body)
    return F.when(F.try_parse_json(picked).isNotNull(), picked)


def item_type(value: Column) -> Column:
    """Coerce a free-text label to one of the allowed item types."""
    mapping = {**{t: t for t in dims.ITEM_TYPES}, **dims.ITEM_TYPE_SYNONYMS}
    lookup = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    label = F.translate(F.lower(strip(F.coalesce(value, F.lit("")))), "- ", "__")
    parts = F.transform(F.split(label, "_"), lambda p: F.try_element_at(lookup, p))
    first_part = F.try_element_at(F.array_compact(parts), F.lit(1))
    return F.coalesce(F.try_element_at(lookup, label), first_part, F.lit("signal"))


# --- chunk templates: one citable line per source ---------------------------------

def _labelled(label: str, value: Column) -> Column:
    return F.when(strip(value) != "", F.concat(F.lit(f"{label}: "), value))


def whole_dollars(amount: Column) -> Column:
    """``1234567`` -> ``1,234,567``, halves to even."""
    return F.format_number(amount, 0)


def award_chunk(description, recipient, amount, agency, sub_agency, start, end) -> Column:
    none = F.lit("None")  # an explicit null renders as the word, a blank stays blank
    shown = lambda c: F.coalesce(c, none)
    return F.concat_ws(
        " | ",
        _labelled("Federal award", shown(description)),
        _labelled("Recipient", shown(recipient)),
        _labelled("Amount", F.concat(F.lit("$"), whole_dollars(F.coalesce(amount, F.lit(0.0))))),
        _labelled("Agency", F.concat(shown(agency), F.lit(" / "), shown(sub_agency))),
        _labelled("Period", F.concat(shown(start), F.lit(" to "), shown(end))),
    )


def _dated(date: Column) -> Column:
    return F.when(F.coalesce(date, F.lit("")) != "", F.concat(F.lit(" ("), date, F.lit(")"))).otherwise("")


def _or(c: Column, fallback: str) -> Column:
    return F.coalesce(blank_to_null(c), F.lit(fallback))


def _cut(c: Column, n: int) -> Column:
    return F.concat(F.left(c, F.lit(n)), F.when(F.length(c) > n, "…").otherwise(""))


def opportunity_chunk(agency, notice_type, posted, title) -> Column:
    return F.concat(
        _or(agency, "A federal agency"), F.lit(" posted a "), _or(notice_type, "opportunity"),
        _dated(posted), F.lit(': "'), title, F.lit('".'),
    )


def register_chunk(doc_type, title, agency, published, abstract) -> Column:
    head = F.concat(
        _or(agency, "Nuclear Regulatory Commission"), F.lit(" "), _or(doc_type, "document"),
        _dated(published), F.lit(': "'), title, F.lit('".'),
    )
    tail = F.when(abstract != "", F.concat(F.lit("Summary: "), _cut(abstract, dims.REGISTER_ABSTRACT_CHARS)))
    return F.concat_ws(" ", head, tail)


def paper_chunk(title, category, published, authors, abstract) -> Column:
    who = F.concat(
        F.array_join(F.slice(authors, 1, 3), ", "), F.when(F.size(authors) > 3, " et al.").otherwise("")
    )
    day = F.left(F.coalesce(published, F.lit("")), F.lit(10))
    return F.concat_ws(
        " ",
        F.concat(
            F.lit("arXiv "), F.coalesce(F.concat(blank_to_null(category), F.lit(" ")), F.lit("")),
            F.lit('paper "'), title, F.lit('"'),
        ),
        F.when(day != "", F.concat(F.lit("("), day, F.lit(")"))),
        F.when(who != "", F.concat(F.lit("by "), who, F.lit("."))),
        F.when(abstract != "", F.concat(F.lit("Abstract: "), _cut(abstract, dims.PAPER_ABSTRACT_CHARS))),
    )


def filing_chunk(company, ticker, form, file_date, theme) -> Column:
    none = F.lit("None")
    return F.concat(
        F.lit("SEC "), F.coalesce(form, none), F.lit(" filing by "), company, _dated(ticker), F.lit(" on "),
        F.coalesce(file_date, none), F.lit(', referencing "'), theme, F.lit('".'),
    )


def news_chunk(domain, seen, title) -> Column:
    return F.concat(_or(domain, "news source"), F.lit(" reported"), _dated(seen), F.lit(': "'), title, F.lit('".'))


def feed_chunk(outlet, title, snippet) -> Column:
    base = F.concat(outlet, F.lit(' reported: "'), title, F.lit('".'))
    return F.concat_ws(" ", base, blank_to_null(snippet))
