"""Candidate scoring, de-duplication, diversity and selection for all desks at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordweave import dims
from recordweave.functions import scoring
from recordweave.functions.dates import published_at
from recordweave.functions.text import blank_to_null, strip, title_key
from recordweave.operators.common import positions, top_n


def window_start(briefs: DataFrame, now: Column) -> DataFrame:
    """Generation start of the latest published brief of any desk, else two days back."""
    return briefs.filter("status = 'published'").agg(
        F.coalesce(
            F.max_by("generation_started_at", F.struct("published_at", "generation_started_at")),
            now - F.expr(f"INTERVAL {dims.WINDOW_HOURS_FALLBACK} HOURS"),
        ).alias("window_start")
    )


def is_home_desk(desks: Column, desk: Column) -> Column:
    return F.coalesce(F.get(desks, 0) == desk, F.lit(False))


def per_desk(records: DataFrame) -> DataFrame:
    """One row per (record, tagged desk): every desk's neighbourhood in one table."""
    return records.select("*", F.explode("desks").alias("desk"))


def mention_counts(tagged: DataFrame) -> DataFrame:
    """Records per (desk, mentioned name), each record counted once.

    ``tagged``: desk, record_id, names (all normalized mention names, first = primary).
    """
    mentions = tagged.select("desk", "record_id", F.explode(F.array_distinct("names")).alias("name"))
    return mentions.filter("name != ''").groupBy("desk", "name").agg(F.count("*").alias("n"))


def corroboration(tagged: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Rows with the number of other records of the desk that mention their primary name.

    Names are counted once per (desk, name) and looked up, instead of comparing all rows.
    """
    counts = mention_counts(tagged) if counts is None else counts
    named = tagged.withColumn("name", F.get("names", 0))
    return (
        named.join(counts, ["desk", "name"], "left")
        .withColumn("corroboration", F.greatest(F.coalesce("n", F.lit(0)) - 1, F.lit(0)))
        .drop("name", "n")
    )


def amount_window(tagged: DataFrame, at: str | None = None, now: Column | None = None, days: int = dims.AMOUNT_WINDOW_DAYS) -> DataFrame:
    """Per desk bounds of the amounts; null and zero do not count.

    With ``at`` only amounts of the ``days`` days before ``now`` do.
    """
    counts = F.col("amount_usd") != 0
    if at is not None:
        counts = counts & (F.col(at) >= now - F.make_interval(days=F.lit(days)))
    used = F.when(counts, F.col("amount_usd"))
    return tagged.groupBy("desk").agg(
        F.min(used).alias("low"), F.max(used).alias("high"), F.count(used).alias("points")
    )


def sliding_amounts(tagged: DataFrame, day: str = "day", days: int = dims.AMOUNT_WINDOW_DAYS) -> DataFrame:
    """(desk, day, low, high, points): bounds of the amounts of each day and the ``days`` days before it.

    Amounts are first summed up in one cell for each desk and day; the range frame runs
    over these cells, of which a desk has as many as days, however many records it has.
    """
    used = F.when(F.col("amount_usd") != 0, F.col("amount_usd"))
    cells = tagged.groupBy("desk", F.col(day).cast("date").alias("day")).agg(F.min(used).alias("low"), F.max(used).alias("high"), F.count(used).alias("points"))
    frame = Window.partitionBy("desk").orderBy(F.unix_date("day")).rangeBetween(-days, 0)
    return cells.select("desk", "day", F.min("low").over(frame).alias("low"), F.max("high").over(frame).alias("high"), F.sum("points").over(frame).alias("points"))


def score(tagged: DataFrame, windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Materiality per (desk, record). ``windows`` has one row per desk."""
    return (
        corroboration(tagged, counts)
        .join(windows, "desk", "left")
        .withColumn("magnitude", scoring.magnitude(F.col("amount_usd"), F.col("low"), F.col("high"), F.col("points")))
        .withColumn(
            "score",
            scoring.materiality(
                F.col("source_id"), F.col("magnitude"), F.col("entity_type"), F.col("corroboration"), F.size("desks")
            ),
        )
        .drop("low", "high", "points")
    )


def rank_candidates(normalized: DataFrame, raw: DataFrame, briefs: DataFrame, now: Column) -> DataFrame:
    """The candidates of a run, from stored records to scored rows on their home desks.

    ``normalized``: record_id, raw_id, created_at, desks, names, source_id, entity_type,
    amount_usd; ``raw``: raw_id, url, fetched_at; ``briefs``: as for :func:`window_start`. Records
    since the window start that still have their raw row are candidates and count for
    corroboration; amounts are held against those of the last 90 days of all records.
    """
    since = window_start(briefs, now).first()[0]
    recent = per_desk(normalized.filter(F.col("created_at") >= F.lit(since)).join(raw, "raw_id"))
    bounds = amount_window(per_desk(normalized), "created_at", now)
    return material(score(recent, bounds, mention_counts(recent)))


def material(scored: DataFrame, threshold: float = dims.MATERIALITY_THRESHOLD) -> DataFrame:
    """Material rows, each on its home desk only."""
    return scored.filter((F.col("score") >= threshold) & is_home_desk(F.col("desks"), F.col("desk")))


def title_dedupe(candidates: DataFrame, text: str = "text") -> DataFrame:
    """Best-scored copy per (desk, headline); rows without a headline all stay."""
    key = title_key(F.col(text))
    keyed = candidates.withColumn(
        "_title", F.when(key == "", F.concat(F.lit("\u0000"), F.col("record_id").cast("string"))).otherwise(key)
    )
    return top_n(keyed, ["desk", "_title"], [F.desc("score"), "record_id"], 1, "_r").drop("_title", "_r")


def recently_featured(citations: DataFrame, briefs: DataFrame, as_of: str, days: int = dims.NOVELTY_WINDOW_DAYS) -> DataFrame:
    """(desk, source_id, native_id) cited by the desk's published briefs of the last days."""
    recent = briefs.filter(
        (F.col("status") == "published")
        & (F.col("date") >= F.date_sub(F.lit(as_of).cast("date"), days))
    ).select("brief_id", "desk")
    return citations.join(recent, "brief_id").select("desk", "source_id", "native_id").distinct()


def novelty(candidates: DataFrame, featured: DataFrame, penalty: float = dims.NOVELTY_PENALTY) -> DataFrame:
    """Halve the score of records a recent brief already showed."""
    key = ["desk", "source_id", "native_id"]
    flagged = candidates.join(featured.select(*key).distinct().withColumn("featured", F.lit(True)), key, "left")
    shown = F.coalesce("featured", F.lit(False))
    return flagged.withColumn("featured", shown).withColumn(
        "score", F.when(shown, F.col("score") * penalty).otherwise(F.col("score"))
    )


def outlet_diversity(
    candidates: DataFrame, cap: int = dims.OUTLET_CAP, penalty: float = dims.OUTLET_PENALTY
) -> DataFrame:
    """Halve the score of a feed outlet's rows beyond its best ``cap`` per desk.

    Only each outlet's best rows are ranked; everybody else is compared with the
    last of them, so a prolific outlet is never sorted as a whole.
    """
    if cap <= 0 or penalty >= 1.0:
        return candidates
    is_feed = (F.col("source_id") == "feeds") & (F.coalesce("outlet", F.lit("")) != "")
    best = top_n(
        candidates.filter(is_feed).select("desk", "outlet", "score", "record_id"),
        ["desk", "outlet"], [F.desc("score"), "record_id"], cap, "_r",
    )
    last = best.filter(F.col("_r") == cap).select(
        "desk", "outlet", F.col("score").alias("_cut"), F.col("record_id").alias("_cut_id")
    )
    beyond = (F.col("score") < F.col("_cut")) | (
        (F.col("score") == F.col("_cut")) & (F.col("record_id") > F.col("_cut_id"))
    )
    hit = is_feed & F.coalesce(beyond, F.lit(False))
    return (
        candidates.join(last, ["desk", "outlet"], "left")
        .withColumn("score", F.when(hit, F.col("score") * penalty).otherwise(F.col("score")))
        .drop("_cut", "_cut_id")
    )


def select_facts(
    candidates: DataFrame, limit: int = dims.BRIEF_LIMIT,
    research_floor: int = dims.RESEARCH_FLOOR, news_floor: int = dims.NEWS_FLOOR,
) -> DataFrame:
    """Best ``limit`` rows per desk with slots reserved for research and for feeds.

    Research slots come first, then feeds within what is left, then everybody by score.
    """
    order = [F.desc("score"), "record_id"]
    research = F.col("record_type") == "research_paper"
    news = ~research & (F.col("source_id") == "feeds")
    research_cut = min(max(research_floor, 0), limit)
    group = F.when(research, "research").when(news, "news").otherwise("other")
    pool = max(limit, research_cut, news_floor)
    # a row can only be chosen if it is near the top of its own class
    short = top_n(candidates.withColumn("_class", group), ["desk", "_class"], order, pool, "_class_rank")
    # from here a desk has at most three short lists, so a window over them is small
    held = F.count_if((F.col("_class") == "research") & (F.col("_class_rank") <= research_cut)).over(
        Window.partitionBy("desk")
    )
    short = short.withColumn("_held", held)
    news_cut = F.least(F.lit(max(news_floor, 0)), F.lit(limit) - F.col("_held"))
    reserved = (
        (F.col("_class") == "research") & (F.col("_class_rank") <= research_cut)
        | (F.col("_class") == "news") & (F.col("_class_rank") <= news_cut)
    )
    ranked = short.withColumn("reserved", reserved)
    return top_n(ranked, ["desk"], [F.desc("reserved"), *order], limit, "_slot").drop(
        "_class", "_class_rank", "_held", "_slot"
    )


def apply_significance(facts: DataFrame, verdicts: DataFrame, threshold: float = dims.SIGNIFICANCE_THRESHOLD) -> DataFrame:
    """Keep facts with a verdict at or above the threshold; unscored facts pass.

    A desk that would keep nothing keeps its single best fact. ``verdicts``:
    desk, record_id, significance.
    """
    judged = facts.join(verdicts, ["desk", "record_id"], "left").withColumn(
        "significance", F.coalesce("significance", F.lit(1.0))
    )
    best = judged.groupBy("desk").agg(
        F.max("significance").alias("_top"),
        F.max_by("record_id", F.struct("significance", -F.col("selection_rank"))).alias("_best"),
    )
    keep = (F.col("significance") >= threshold) | (
        (F.col("_top") < threshold) & (F.col("record_id") == F.col("_best"))
    )
    return judged.join(best, "desk").filter(keep).drop("_top", "_best")


def wire_title(title: Column, headline: Column, text: Column) -> Column:
    """First non-blank of structured title, structured headline and text, 300 characters."""
    first = F.coalesce(blank_to_null(title), blank_to_null(headline), text, F.lit(""))
    return F.left(strip(first), F.lit(dims.TITLE_CHARS))


def overflow_wire(
    candidates: DataFrame, selected: DataFrame, kept: DataFrame, featured: DataFrame
) -> DataFrame:
    """Candidates minus what the significance check dropped and what the brief shows, in score order."""
    key = ["desk", "record_id"]
    froth = selected.select(*key).join(kept.select(*key), key, "left_anti")
    rest = candidates.join(froth, key, "left_anti").join(featured.select(*key), key, "left_anti")
    scored = rest.withColumn("score", F.round("score", 4))
    placed = positions(scored, ["desk"], "score", "record_id", "position")
    return placed.withColumn("display_order", F.col("position") - 1).drop("position")


def fact_passages(facts: DataFrame, field) -> DataFrame:
    """Citable passages of facts; blanks instead of nulls."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return facts.select(
        "record_id", "source_id", blank(F.col("url")).alias("url"), blank(F.col("native_id")).alias("native_id"),
        blank(F.col("text")).alias("excerpt"), published_at(F.col("source_id"), field).alias("published_at"),
    )


def merge_passages(facts: DataFrame, retrieved: DataFrame, cap: int) -> DataFrame:
    """Facts before retrieved passages, one per record, numbered 1..cap per desk.

    Both inputs: desk, record_id, rank (their own order).
    """
    both = facts.withColumn("_part", F.lit(0)).unionByName(
        retrieved.withColumn("_part", F.lit(1)), allowMissingColumns=True
    )
    one = top_n(both, ["desk", "record_id"], ["_part", "rank"], 1, "_r").drop("_r")
    return top_n(one, ["desk"], ["_part", "rank", "record_id"], cap, "index").drop("_part", "rank")


