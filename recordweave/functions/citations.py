"""Citation tokens, sentences and claims."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordweave import dims
from recordweave.functions.text import SPACE, strip

# private-use character that marks a sentence boundary inside a string
_CUT = ""


def repair_citations(text: Column) -> Column:
    """Bring near-miss tokens to ``[CITE:N]``; four digits and ranges stay as they are."""
    out = F.regexp_replace(text, dims.CITE_KEYWORD_PATTERN, "[CITE:$1]")
    out = F.regexp_replace(out, dims.CITE_BARE_PATTERN, "[CITE:$1]")
    for digits in (r"\d{2}", r"\d"):  # 007 -> 07 -> 7
        out = F.regexp_replace(out, rf"\[CITE:0({digits})\]", "[CITE:$1]")
    return out


def citation_indices(text: Column) -> Column:
    """Distinct cited indices in text order."""
    found = F.regexp_extract_all(text, F.lit(dims.CITE_PATTERN), F.lit(1))
    return F.array_distinct(F.transform(found, lambda n: n.try_cast("int")))


def is_cited(text: Column) -> Column:
    return text.rlike(dims.CITE_PATTERN)


def sentences(body: Column) -> Column:
    """Split after ``.!?`` before a capital, but not after a known abbreviation.

    Boundaries are first marked, then marks that follow an abbreviation are
    turned back into a blank, so the whole text is walked a fixed number of times.
    """
    marked = F.regexp_replace(strip(body), rf"(?<=[.!?]){SPACE}+(?=[A-Z])", _CUT)
    short = "|".join(a.replace(".", r"\.") for a in dims.ABBREVIATIONS)
    # the mark comes first in the pattern, so words are only looked at where a mark stands
    joined = F.regexp_replace(marked, rf"(?i){_CUT}(?<=(?:^|[ {_CUT}])(?:{short})\.{{1,40}}{_CUT})", " ")
    return F.split(joined, _CUT)


def strip_uncited(body: Column) -> Column:
    """Keep only sentences that carry a citation."""
    kept = F.filter(F.transform(sentences(repair_citations(body)), strip), is_cited)
    return F.coalesce(F.array_join(kept, " "), F.lit(""))


def claims(body: Column) -> Column:
    """``(position, text, indices)`` per non-blank sentence."""
    every = F.transform(
        sentences(body),
        lambda s, i: F.struct(
            i.alias("position"), strip(s).alias("text"), citation_indices(s).alias("indices")
        ),
    )
    return F.filter(every, lambda c: c["text"] != "")
