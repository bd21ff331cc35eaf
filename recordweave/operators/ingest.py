"""From parsed records to the stored tables: merge, de-dup, retention, seeds, body enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordweave import dims
from recordweave.functions import money
from recordweave.functions.names import normalize_mention
from recordweave.operators.common import first_row, top_n

RAW_KEY = ["source_id", "native_id", "content_hash"]


def merge_by_native_id(records: DataFrame, arrival: str = "arrival") -> DataFrame:
    """One row per (source_id, native_id) with the union of the desks of all its copies.

    The home desk comes from the copy with the fewest desks, ties in fixed desk
    order; the other desks follow in alphabetical order. All other columns come
    from the first copy. Copies without a desk drop out.
    """
    key = ["source_id", "native_id"]
    tagged = records.filter(F.size("desks") > 0)
    rank = F.array_position(F.array(*[F.lit(d) for d in dims.HOME_DESK_TIEBREAK]), F.get("desks", 0))
    home = F.min(
        F.struct(F.size("desks"), F.when(rank > 0, rank).otherwise(len(dims.HOME_DESK_TIEBREAK) + 1), F.get("desks", 0).alias("home"))
    )
    homes = tagged.groupBy(*key).agg(home.alias("h")).select(*key, "h.home")
    # distinct (record, desk) first: a record with countless copies still has few desks
    union = (
        tagged.select(*key, F.explode("desks").alias("d")).distinct().groupBy(*key).agg(
            F.array_sort(F.collect_list("d")).alias("all_desks")
        )
    )
    first = first_row(tagged, key, [arrival]).drop("desks")
    return (
        first.join(homes, key)
        .join(union, key)
        .withColumn("desks", F.array_distinct(F.concat(F.array("home"), "all_desks")))
        .drop("home", "all_desks")
    )


def new_records(batch: DataFrame, stored: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Rows of a batch whose (source, native id, hash) is neither stored nor seen before in it."""
    return first_row(batch, RAW_KEY, [arrival]).join(stored.select(*RAW_KEY), RAW_KEY, "left_anti")


def flag_new(batch: DataFrame, stored: DataFrame, arrival: str = "arrival") -> DataFrame:
    """The whole batch with ``is_new``: first copy of a key that is not stored yet."""
    # per key only its first arrival and whether it is stored, both map-side aggregates
    firsts = batch.groupBy(*RAW_KEY).agg(F.min(arrival).alias("_first"))
    known = stored.select(*RAW_KEY).distinct().withColumn("_known", F.lit(True))
    keys = firsts.join(known, RAW_KEY, "left")
    return (
        batch.join(keys, RAW_KEY)
        .withColumn("is_new", F.col("_known").isNull() & (F.col(arrival) == F.col("_first")))
        .drop("_first", "_known")
    )


def cap_per_source(rows: DataFrame, source: str, order: list[Column], cap: int) -> DataFrame:
    """First ``cap`` items of each feed, in document order."""
    return top_n(rows, [source], order, cap)


def prune(raw: DataFrame, cutoff: Column, key: str, *references: DataFrame) -> DataFrame:
    """Raw rows older than the cutoff that no table refers to any more."""
    out = raw.filter(F.col("created_at") < cutoff)
    for ref in references:
        out = out.join(ref.select(key), key, "left_anti")
    return out


def retain(
    raw: DataFrame, normalized: DataFrame, cutoff: Column, key: str, *references: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept raw rows, kept normalized rows, counts) after retention.

    Normalized rows older than the cutoff go first; then raw rows older than it to which
    neither a kept normalized row nor a row of ``references`` (citations, edges, review queue; each
    with ``key``) refers. Both tables have ``created_at``; a row without one is not older
    and stays. ``counts`` has one row per table: table, kept, removed.
    """
    young = F.coalesce(F.col("created_at") >= cutoff, F.lit(True))
    used = normalized.filter(young).select(key)
    for ref in references:
        used = used.unionAll(ref.select(key))
    used = used.distinct().withColumn("_used", F.lit(True))
    judged = raw.join(used, key, "left").withColumn("_keep", young | F.coalesce("_used", F.lit(False))).drop("_used")
    told = judged.select(F.lit("raw").alias("table"), "_keep").unionAll(
        normalized.select(F.lit("normalized").alias("table"), young.alias("_keep"))
    )
    counts = told.groupBy("table").agg(F.count_if("_keep").alias("kept"), F.count_if(~F.col("_keep")).alias("removed"))
    return judged.filter("_keep").drop("_keep"), normalized.filter(young), counts


def seed_entities(companies: DataFrame, identifiers: DataFrame) -> DataFrame:
    """New companies as (entity, name, alias, id_type, id_value); known tickers are left alone.

    Of companies that share a ticker the one with the smallest cik, then name, is taken.

    ``companies``: cik, ticker, name. The entity id is a hash of its cik.
    """
    known = identifiers.filter("id_type = 'ticker'").select(F.col("id_value").alias("ticker"))
    fresh = companies.join(known, "ticker", "left_anti")
    fresh = first_row(fresh.filter("ticker is not null"), ["ticker"], [F.col("cik"), F.col("name")])
    pair = lambda kind, col: F.struct(F.lit(kind).alias("id_type"), F.col(col).alias("id_value"))
    return fresh.select(
        F.sha2(F.concat(F.lit("cik:"), "cik"), 256).alias("entity"), "name",
        normalize_mention(F.col("name")).alias("alias"),
        F.explode(F.array(pair("ticker", "ticker"), pair("cik", "cik"))).alias("id"),
    ).select("entity", "name", "alias", "id.id_type", "id.id_value")


def renormalize(aliases: DataFrame) -> DataFrame:
    """Aliases whose stored normal form is out of date."""
    fresh = aliases.withColumn("fresh", normalize_mention(F.col("alias")))
    return fresh.filter(F.col("fresh") != F.col("alias_normalized"))


def enrich(records: DataFrame, bodies: DataFrame, cap: int | None = None) -> DataFrame:
    """Fold landed bodies into filing records: figures, dates, text.

    ``records``: record_id, form, url, cik, accession, company, ticker, text,
    amount_usd; ``bodies``: url or (cik, accession) keys with ``body`` (visible
    text) and ``xml``. With a ``cap`` only that many bodies are used, in record order;
    records beyond it, or without a body, keep their metadata.
    """
    is_form_d = F.startswith(F.upper(F.coalesce("form", F.lit(""))), F.lit("D"))
    page = bodies.filter(F.col("body") != "").select("url", "body")
    doc = bodies.filter(F.col("xml").isNotNull()).select("cik", "accession", "xml")
    joined = (
        records.withColumn("_url", F.when(~is_form_d, F.col("url")))
        .withColumn("_cik", F.when(is_form_d, F.col("cik")))
        .join(page.withColumnRenamed("url", "_url"), "_url", "left")
        .join(doc.withColumnRenamed("cik", "_cik"), ["_cik", "accession"], "left")
        .drop("_url", "_cik")
    )
    hit = F.col("body").isNotNull() | F.col("xml").isNotNull()
    if cap is not None:
        used = joined.filter(hit).select("record_id").orderBy("record_id").limit(cap).withColumn("_used", F.lit(True))
        joined = joined.join(used, "record_id", "left")
        use = F.coalesce("_used", F.lit(False))
    else:
        use = hit
    facts = money.form_d(F.col("xml"))
    figure = F.when(F.col("xml").isNotNull(), money.form_d_amount(facts)).otherwise(
        F.array_max(money.amounts_usd(F.col("body")))
    )
    text = F.when(
        F.col("xml").isNotNull(), money.form_d_chunk(F.coalesce("company", F.lit("")), F.col("ticker"), facts)
    ).otherwise(money.enriched_chunk(F.col("text"), F.col("body")))
    return (
        joined.withColumn("body_dates", F.when(use, money.long_dates(F.col("body"))))
        .withColumn("body_amounts_usd", F.when(use, money.amounts_usd(F.col("body"))))
        .withColumn("amount_usd", F.coalesce(F.when(use, figure), "amount_usd"))
        .withColumn("text", F.when(use, text).otherwise(F.col("text")))
        .withColumn("enriched", use)
        .drop("body", "xml", "_used")
    )
