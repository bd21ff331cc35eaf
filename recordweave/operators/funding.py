"""Funding graph: who awards how much to whom."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordweave.functions.text import strip
from recordweave.operators.common import first_row


def funding_edges(awards: DataFrame, recipients: DataFrame) -> DataFrame:
    """Dollars, count and latest start per (agency, recipient).

    ``awards``: recipient_uei, awarding_agency, amount_usd, start_date;
    ``recipients``: uei, entity. Awards of unknown recipients or blank agencies drop out.
    """
    keyed = awards.select(
        F.upper(strip(F.col("recipient_uei"))).alias("uei"),
        strip(F.col("awarding_agency")).alias("agency"),
        F.coalesce(F.col("amount_usd").try_cast("double"), F.lit(0.0)).alias("amount"),
        # a date, not text: the aggregate then runs in hash tables instead of sorting all awards
        F.col("start_date").try_cast("date").alias("start_date"),
    ).filter("agency != ''")
    known = recipients.select(F.upper("uei").alias("uei"), "entity")
    return (
        # add up per uei first: a hot recipient is then a handful of rows at the join
        keyed.groupBy("agency", "uei")
        .agg(F.sum("amount").alias("usd"), F.count("*").alias("n"), F.max("start_date").alias("last"))
        .join(known, "uei")
        .groupBy("agency", "entity")
        .agg(
            F.round(F.sum("usd"), 2).alias("total_usd"), F.sum("n").alias("award_count"),
            F.max("last").cast("string").alias("last_award"),
        )
    )


def latest_awards(awards: DataFrame, native_id: str, modified: str, tie: str) -> DataFrame:
    """Newest version of each award, so a modified award counts once."""
    return first_row(awards, [native_id], [F.desc(modified), F.desc(tie)])


def agency_id(agency):
    return F.sha2(F.concat(F.lit("gov_agency:"), agency), 256)


def typed_edges(edges: DataFrame) -> DataFrame:
    """Funding as typed edges of the graph table, each agency under an id made from its name."""
    return edges.select(
        agency_id(F.col("agency")).alias("from_id"), F.col("entity").cast("string").alias("to_id"), F.lit("FUNDS").alias("edge_type"),
        "agency", "total_usd", "award_count", "last_award",
    )


def top_funding(edges: DataFrame, limit: int = 60) -> DataFrame:
    return edges.orderBy(F.desc_nulls_last("total_usd"), "agency", "entity").limit(limit)
