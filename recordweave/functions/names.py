"""Company-name normalization, identifiers and set similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordweave import dims
from recordweave.functions.text import SPACE, let, squash, strip


def normalize_mention(c: Column) -> Column:
    """Upper case, no ``/DE/`` style tag, no dots or commas, one legal suffix dropped."""
    upper = F.upper(strip(F.coalesce(c, F.lit(""))))
    untagged = F.regexp_replace(upper, r"(?<![A-Z0-9])/[A-Z]{2,5}/?", " ")
    flat = squash(F.regexp_replace(untagged, "[.,]", " "))
    return F.trim(F.regexp_replace(flat, f" ({'|'.join(dims.MENTION_SUFFIXES)})$", ""))


def normalize_award_name(c: Column) -> Column:
    """Upper case with every trailing legal suffix dropped."""
    upper = F.upper(strip(F.coalesce(c, F.lit(""))))
    return strip(F.regexp_replace(upper, f"({SPACE}* ({'|'.join(dims.AWARD_SUFFIXES)}))+$", ""))


def word_tokens(c: Column) -> Column:
    """Upper-case alphanumeric words in text order."""
    folded = F.trim(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]+", " "))
    return F.when(folded == "", F.array().cast("array<string>")).otherwise(F.split(folded, " "))


def pad_cik(c: Column) -> Column:
    raw = strip(c.cast("string"))
    return F.when(F.length(raw) < 10, F.lpad(raw, 10, "0")).otherwise(raw)


def shingles(c: Column, n: int) -> Column:
    """Distinct character n-grams."""
    last = F.length(c) - (n - 1)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(c, i, F.lit(n)))
    return F.when(last >= 1, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def trigrams(c: Column) -> Column:
    """Trigram set of lower-case words, each padded by two blanks before and one after."""
    words = F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")

    def of_word(w: Column) -> Column:
        padded = F.concat(F.lit("  "), w, F.lit(" "))
        return F.transform(
            F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))
        )

    return F.array_distinct(F.flatten(F.transform(words, of_word)))


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return let(shared, lambda n: F.coalesce(F.try_divide(n, F.size(a) + F.size(b) - n), F.lit(0.0)))


def bigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard over character bigrams: equal -> 1, any blank -> 0."""
    return F.when(a == b, 1.0).otherwise(jaccard(shingles(a, 2), shingles(b, 2)))


def same_normalized_company(x: Column, y: Column) -> Column:
    """Normalized names are equal, or one (two words or more) opens the other."""
    words = lambda c: F.size(F.split(c, " "))
    opens = lambda s, l: F.contains(s, F.lit(" ")) & F.startswith(l, F.concat(s, F.lit(" ")))  # noqa: E731,E741
    prefix = F.when(words(x) <= words(y), opens(x, y)).otherwise(opens(y, x))
    return (x != "") & (y != "") & ((x == y) | prefix)


def same_company(a: Column, b: Column) -> Column:
    return same_normalized_company(normalize_mention(a), normalize_mention(b))


def resolution_ids(source_id: Column, mention: Column, recipient_uei: Column) -> Column:
    """Ordered distinct identifiers of one mention: ticker, cik, uei, then the award's uei."""

    def one(kind: str, value: Column, shaped: Column) -> Column:
        return F.when(
            F.coalesce(value.cast("string"), F.lit("")) != "",
            F.struct(F.lit(kind).alias("id_type"), shaped.alias("id_value")),
        )

    upper = lambda c: F.upper(strip(c))
    award_uei = F.when(source_id == "usaspending", recipient_uei)
    return F.array_distinct(
        F.array_compact(
            F.array(
                one("ticker", mention["ticker"], upper(mention["ticker"])),
                one("cik", mention["cik"], pad_cik(mention["cik"])),
                one("uei", mention["uei"], upper(mention["uei"])),
                one("uei", award_uei, upper(award_uei)),
            )
        )
    )
