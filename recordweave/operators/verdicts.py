"""Claims against verdict tables: faithfulness, cleaned bodies, attribution, publish decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordweave.functions import citations, scoring
from recordweave.operators.common import first_row


def claims(items: DataFrame, item: str = "item_id", body: str = "body") -> DataFrame:
    """One row per claim: item, claim (position in the body), text, indices."""
    # outer: the plain form would cut every body into sentences twice, once to test for emptiness
    return items.select(item, F.explode_outer(citations.claims(F.col(body))).alias("c")).filter("c IS NOT NULL").select(
        item, F.col("c.position").alias("claim"), F.col("c.text").alias("text"), F.col("c.indices").alias("indices")
    )


def judge(claim_rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Claims with ``passes``: cited and supported; a claim without a verdict fails."""
    return claim_rows.join(verdicts, ["item_id", "claim"], "left").withColumn(
        "passes", (F.size("indices") > 0) & F.coalesce("supported", F.lit(False))
    )


def item_results(judged: DataFrame) -> DataFrame:
    """Per item: totals, score, the supported sentences in order, and whether it drops out.

    The sentences of one item are gathered into one array: an item is one short text.
    """
    kept = F.array_sort(F.collect_list(F.when(F.col("passes"), F.struct("claim", "text"))))
    return (
        judged.groupBy("item_id")
        .agg(F.count("*").alias("claims_total"), F.count_if("passes").alias("claims_passing"), kept.alias("kept"))
        .select(
            "item_id", "claims_total", "claims_passing",
            (F.col("claims_passing") / F.col("claims_total")).alias("faithfulness"),
            F.array_join(F.transform("kept", lambda k: k["text"]), " ").alias("cleaned_body"),
            (F.col("claims_passing") == 0).alias("excluded"),
        )
    )


def brief_results(items: DataFrame, results: DataFrame) -> DataFrame:
    """Per brief: surviving items, provable claims, faithfulness, publish verdict.

    ``items``: brief_id, item_id. An item without any claim drops out.
    """
    joined = items.select("brief_id", "item_id").join(results, "item_id", "left")
    alive = ~F.coalesce("excluded", F.lit(True))
    passing = F.sum(F.when(alive, F.col("claims_passing")).otherwise(0))
    total = F.sum(F.when(alive, F.col("claims_total")).otherwise(0))
    return joined.groupBy("brief_id").agg(
        F.count_if(alive).alias("surviving_items"),
        passing.alias("provable_claims"),
        F.coalesce(F.try_divide(passing, total), F.lit(0.0)).alias("faithfulness"),
        F.bool_or(alive).alias("eval_passed"),
    )


def best_attempt(attempts: DataFrame, by: str = "brief_id") -> DataFrame:
    """First passing attempt, else the one with most survivors, then most provable claims.

    ``attempts``: by, attempt, eval_passed, surviving_items, provable_claims.
    """
    failed = lambda c: F.when(~F.col("eval_passed"), -F.col(c))
    return first_row(
        attempts, [by],
        [F.desc("eval_passed"), failed("surviving_items"), failed("provable_claims"), "attempt"],
    )


def analysis_grounding(fields: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per analysis field: invented findings and whether it is grounded (no verdict = grounded)."""
    findings = F.filter(
        F.coalesce("new_facts", F.array().cast("array<string>")), lambda f: F.trim(f) != ""
    )
    return fields.join(verdicts, "label", "left").withColumn("new_facts", findings).withColumn(
        "grounded", F.size("new_facts") == 0
    )


def cited_passages(items: DataFrame, passages: DataFrame) -> DataFrame:
    """Item citations joined to passages of the same brief; unknown indices drop out."""
    cites = items.select("brief_id", "item_id", F.explode("indices").alias("index"))
    return cites.join(passages, ["brief_id", "index"])


def dominant_source(cited: DataFrame) -> DataFrame:
    """Most cited source per item, a tie goes to the source of the earliest passage."""
    counts = cited.groupBy("item_id", "source_id").agg(F.count("*").alias("n"), F.min("index").alias("first"))
    return counts.groupBy("item_id").agg(
        F.max_by("source_id", F.struct("n", -F.col("first"))).alias("source_id")
    )


def attribute(results: DataFrame, sources: DataFrame) -> DataFrame:
    """Evidence label per surviving item from its dominant source and support."""
    return (
        results.filter(~F.col("excluded"))
        .join(sources, "item_id", "left")
        .withColumn(
            "attribution",
            scoring.attribution(F.coalesce("source_id", F.lit("")), F.col("claims_passing") > 0),
        )
    )


def significance_metrics(rows: DataFrame) -> DataFrame:
    """Accuracy, froth caught, signal kept of ``(expected, action)`` rows (keep/drop)."""
    ok = F.col("expected") == F.col("action")
    drop = F.col("expected") == "drop"
    return rows.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("correct"),
        F.round(F.coalesce(F.try_divide(F.count_if(ok), F.count("*")), F.lit(0.0)), 6).alias("accuracy"),
        F.count_if(drop).alias("froth_total"), F.count_if(drop & ok).alias("froth_caught"),
        F.count_if(~drop).alias("signal_total"), F.count_if(~drop & ok).alias("signal_kept"),
    )


def cited_claims(items: DataFrame) -> DataFrame:
    """The claims of each item once its uncited sentences are gone, numbered anew.

    ``items``: brief_id, item_id, body with repaired citations. Bodies are cut into sentences
    here and nowhere else, so the table should be stored by whoever reads it twice. An item's claims
    are one short list, so they are numbered inside it.
    """
    cited = F.filter(citations.claims(F.col("body")), lambda c: citations.is_cited(c["text"]))
    each = items.select("brief_id", "item_id", F.posexplode_outer(cited).alias("claim", "c")).filter("c IS NOT NULL")
    return each.select("brief_id", "item_id", "claim", F.col("c.text").alias("text"), F.col("c.indices").alias("indices"))


def publish_items(claim_rows: DataFrame, verdicts: DataFrame, passages: DataFrame) -> DataFrame:
    """From cited claims to the items a brief prints: results, cited source and evidence label.

    ``claim_rows``: as :func:`cited_claims` gives them; ``verdicts``: item_id, claim, supported; ``passages``:
    brief_id, index, source_id. An item none of whose claims holds is not printed. Indices and the
    source they come from are those of the sentences that stay; an item whose passages are unknown is
    graded without a source.
    """
    judged = judge(claim_rows, verdicts)
    results = item_results(judged)
    kept = judged.filter("passes").select("brief_id", "item_id", F.explode("indices").alias("index")).distinct()
    sources = dominant_source(kept.join(passages, ["brief_id", "index"]))
    return attribute(results, sources)
