"""Visible text of HTML bodies."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# what shows no text, up to its end or the end of the page
UNSEEN = r"(?is)<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)"
COMMENT = r"(?s)<!--.*?(?:-->|\z)"
MARKUP = r"<[A-Za-z/!?][^>]*(?:>|\z)"


def decode_entities(c: Column) -> Column:
    """Character references as characters. There are over two thousand names, so this is
    the one column helper that needs Python; values without ``&`` pass untouched."""

    def batches(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from html import unescape

        for batch in values:
            yield batch.map(lambda v: unescape(v) if v and "&" in v else v)

    return F.pandas_udf(batches, T.StringType())(c)


def html_text(c: Column) -> Column:
    """Text without scripts, styles, comments and tags, entities decoded, white space collapsed.

    A value without ``<`` is plain text and keeps its entities; null gives "".
    Broken markup never fails: an open tag or comment hides what follows it.
    """
    raw = F.coalesce(c, F.lit(""))
    shown = raw
    for pattern in (UNSEEN, COMMENT, MARKUP):
        shown = F.regexp_replace(shown, pattern, " ")
    page = F.contains(raw, F.lit("<"))
    text = F.when(page, decode_entities(F.when(page, shown))).otherwise(raw)
    return F.trim(F.regexp_replace(text, r"[\s\x{a0}]+", " "))
