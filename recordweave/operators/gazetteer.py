"""Linking by names as they stand in the text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordweave import dims
from recordweave.functions.names import word_tokens
from recordweave.operators.common import match_phrases


def alias_index(aliases: DataFrame) -> DataFrame:
    """Aliases of two words or more, not generic, that belong to exactly one entity.

    Aliases are folded to words the way the text is, so "A&B CO" can match.
    """
    folded = aliases.select(F.array_join(word_tokens(F.col("alias")), " ").alias("alias"), "entity")
    return (
        folded.filter(F.contains("alias", F.lit(" ")) & ~F.col("alias").isin(dims.STOPWORD_ALIASES))
        .groupBy("alias")
        .agg(F.min("entity").alias("entity"), F.max("entity").alias("_last"))
        .filter(F.col("entity") == F.col("_last"))
        .drop("_last")
    )


def alias_hits(docs: DataFrame, index: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, alias, entity, pos, n)``: first place of each alias in each text."""
    tokenized = docs.select(doc_id, word_tokens(F.col(text)).alias("tokens"))
    return match_phrases(
        tokenized, doc_id, "tokens", index, "alias", dims.ALIAS_MIN_TOKENS
    )


def link_mentions(docs: DataFrame, index: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, entity, pos, n)``: one row per linked entity, at its first mention."""
    hits = alias_hits(docs, index, doc_id, text)
    return hits.groupBy(doc_id, "entity").agg(F.min(F.struct("pos", "n")).alias("at")).select(
        doc_id, "entity", "at.pos", "at.n"
    )


def alias_document_frequency(docs: DataFrame, index: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Documents hit per alias: a phrase found everywhere is ordinary language."""
    return alias_hits(docs, index, doc_id).groupBy("alias").agg(F.count("*").alias("documents"))


def ordered_ids(links: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Entity ids per item in link order; an item links few entities, so the array stays short."""
    firsts = links.groupBy(key, "entity").agg(F.min(F.struct(*order)).alias("at"))
    return firsts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "entity"))).alias("l")).select(
        key, F.transform("l", lambda x: x["entity"]).alias("entity_ids")
    )


def backfill(items: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Items whose id array gains ids, with the gained ids appended in text order."""
    found = ordered_ids(links, key, ["pos", "n"]).withColumnRenamed("entity_ids", "found")
    current = F.coalesce("entity_ids", F.array().cast("array<bigint>"))
    return (
        items.join(found, key)
        .withColumn("additions", F.array_except("found", current))
        .filter(F.size("additions") > 0)
        .withColumn("entity_ids", F.concat(current, "additions"))
        .drop("found")
    )


def theme_tags(docs: DataFrame, probes: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that hold a probe phrase, with the phrase and its desks.

    ``probes``: phrase, desks. Phrases and text are folded to words and matched word by word.
    """
    folded = probes.select(
        F.array_join(word_tokens(F.col("phrase")), " ").alias("words"), "phrase", "desks"
    ).dropDuplicates(["words", "phrase", "desks"])
    tokenized = docs.select(doc_id, word_tokens(F.col(text)).alias("tokens"))
    hits = match_phrases(tokenized, doc_id, "tokens", folded, "words", 1)
    return hits.select(doc_id, "phrase", "desks", "pos")


def allowlist_mentions(text, companies=None):
    """Array of ``(mention, ticker)`` for listed companies named as whole words.

    The list is short and fixed, so it is a set of literal patterns and not a join.
    """
    import re

    companies = companies or dims.NUCLEAR_COMPANIES
    low = F.lower(text)
    found = [
        F.when(
            low.rlike("|".join(rf"\b{re.escape(a)}\b" for a in aliases)),
            F.struct(F.lit(name).alias("mention"), F.lit(ticker).alias("ticker")),
        )
        for name, ticker, aliases in companies
    ]
    return F.array_compact(F.array(*found))
