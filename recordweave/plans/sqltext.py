"""SQL spellings of the scalar helpers, for the SQL twins only."""

from __future__ import annotations

from recordweave import dims
from recordweave.functions.text import LINE_END, SPACE

CUT = "chr(57344)"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def squash(e: str) -> str:
    return f"trim(regexp_replace(coalesce({e}, ''), '{SPACE}+', ' ', 'g'))"


def title_key(e: str) -> str:
    head = f"regexp_extract({strip(e)}, '^[^|{LINE_END}]*', 0)"
    return f"trim(regexp_replace(lower({head}), '[^a-z0-9]+', ' ', 'g'))"


def normalize_mention(e: str) -> str:
    tag = f"regexp_replace(upper({strip(e)}), '(^|[^A-Z0-9])/[A-Z]{{2,5}}/?', '\\1 ', 'g')"
    flat = squash(f"regexp_replace({tag}, '[.,]', ' ', 'g')")
    return f"trim(regexp_replace({flat}, ' ({'|'.join(dims.MENTION_SUFFIXES)})$', ''))"


def normalize_award_name(e: str) -> str:
    return strip(f"regexp_replace(upper({strip(e)}), '({SPACE}* ({'|'.join(dims.AWARD_SUFFIXES)}))+$', '')")


def tokens(e: str) -> str:
    folded = f"trim(regexp_replace(upper(replace({e}, 'ß', 'ss')), '[^A-Z0-9]+', ' ', 'g'))"
    return f"list_filter(string_split({folded}, ' '), lambda w: w <> '')"


def shingles(e: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, length({e}) - {n - 2}), lambda i: substr({e}, i, {n})))"


def trigrams(e: str) -> str:
    words = rf"list_filter(string_split(regexp_replace(lower({e}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
    grams = "list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))"
    return f"list_distinct(flatten(list_transform({words}, lambda w: {grams})))"


def jaccard(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    return f"coalesce({shared} / nullif((len({a}) + len({b}) - {shared})::DOUBLE, 0), 0.0)"


def sentences(e: str) -> str:
    short = "|".join(a.replace(".", r"\.") for a in dims.ABBREVIATIONS)
    out = f"regexp_replace({strip(e)}, '([.!?]){SPACE}+([A-Z])', '\\1' || {CUT} || '\\2', 'g')"
    for _ in range(2):  # neighbours share a boundary
        out = (
            f"regexp_replace({out}, '(?i)(^|[ ' || {CUT} || '])((?:{short})\\.+)' || {CUT}, '\\1\\2 ', 'g')"
        )
    return f"string_split({out}, {CUT})"


def repair_citations(e: str) -> str:
    out = f"regexp_replace({e}, '{dims.CITE_KEYWORD_PATTERN}', '[CITE:\\1]', 'g')"
    out = f"regexp_replace({out}, '{dims.CITE_BARE_PATTERN}', '[CITE:\\1]', 'g')"
    for digits in (r"\d{2}", r"\d"):
        out = f"regexp_replace({out}, '\\[CITE:0({digits})\\]', '[CITE:\\1]', 'g')"
    return out


def case(e: str, mapping: dict, default: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN {repr(v) if isinstance(v, str) else v}" for k, v in mapping.items())
    return f"CASE {e} {arms} ELSE {default} END"


def amounts(e: str, pattern: str = dims.AMOUNT_PATTERN) -> str:
    scale = case("lower(coalesce(s, ''))", dims.AMOUNT_SCALES, "1.0")
    pairs = f"list_zip(regexp_extract_all({e}, '{pattern}', 1), regexp_extract_all({e}, '{pattern}', 2))"
    scale = scale.replace("coalesce(s, '')", "coalesce(p[2], '')")
    return f"list_transform({pairs}, lambda p: CAST(replace(p[1], ',', '') AS DOUBLE) * ({scale}))"


def host(e: str) -> str:
    return f"regexp_replace(lower(regexp_extract({e}, '^[a-zA-Z]+://([^/?#:]*)', 1)), '^www\\.', '')"
