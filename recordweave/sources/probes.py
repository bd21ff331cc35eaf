"""The built-in probe phrases as a table: source_id, phrase, desks (home desk first), position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordweave import dims


def probe_table(spark: SparkSession) -> DataFrame:
    """A short hand-kept list; pass your own table of this shape to use other phrases."""
    rows = [("usaspending", phrase, desks) for phrases, desks in dims.AWARD_PROBES for phrase in phrases]
    rows += [("sam_gov", phrase, [desk]) for phrase, desk in dims.OPPORTUNITY_PROBES]
    rows += [("nrc", phrase, desks) for phrase, desks in dims.REGISTER_PROBES]
    rows += [("edgar", phrase, desks) for phrase, desks in dims.FILING_PROBES]
    rows += [("gdelt", phrase, [desk]) for phrase, desk in dims.NEWS_PROBES]
    return spark.createDataFrame(
        [(*row, i) for i, row in enumerate(rows)], "source_id string, phrase string, desks array<string>, position int"
    )
