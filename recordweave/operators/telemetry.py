"""Runs, breakers, momentum, health findings and quality tallies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordweave import dims
from recordweave.functions.text import looks_like_leak, squash
from recordweave.operators.common import first_row, top_n


# --- ingest runs -------------------------------------------------------------------

def latest_run(runs: DataFrame, source: str = "source_id") -> DataFrame:
    return first_row(runs, [source], [F.desc("started_at"), F.desc("run_id")])


def run_accounting(records: DataFrame) -> DataFrame:
    """Fetched, new and duplicate records per run. ``records``: run_id, is_new."""
    return records.groupBy("run_id").agg(
        F.count("*").alias("fetched"), F.count_if("is_new").alias("new"), F.count_if(~F.col("is_new")).alias("duplicate")
    )


def run_failures(source_runs: DataFrame) -> DataFrame:
    """Per run how many sources ran and failed; the run has failed only if all of them did.

    ``source_runs``: run_id, source_id, failed; a source counts as failed if it never got through.
    """
    per_source = source_runs.groupBy("run_id", "source_id").agg(F.bool_and("failed").alias("failed"))
    return per_source.groupBy("run_id").agg(
        F.count("*").alias("sources"), F.count_if("failed").alias("failed_sources"), F.bool_and("failed").alias("total_failure")
    )


def ingest_volume(runs: DataFrame) -> DataFrame:
    """New records per source, busiest first, silent sources left out."""
    total = runs.groupBy("source_id").agg(F.sum("records_new").alias("records_new"))
    return total.filter("records_new > 0").orderBy(F.desc("records_new"), "source_id")


def zero_yield(registry: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Registered sources that delivered nothing."""
    return registry.join(records.select(key), key, "left_anti")


def breaker_state(
    runs: DataFrame, now: Column, threshold: int = dims.BREAKER_THRESHOLD, cooldown: int = dims.BREAKER_COOLDOWN_MINUTES
) -> DataFrame:
    """Breaker per source from its run log: failures since the last success.

    Two map-side aggregates instead of a walk over a source's whole history, so a
    source with a third of all runs costs no more than the others.
    ``runs``: source_id, at, seq, failed.
    """
    order = F.struct("at", "seq")
    last_ok = runs.groupBy("source_id").agg(F.max(F.when(~F.col("failed"), order)).alias("last_ok"))
    after = F.col("failed") & (F.col("last_ok").isNull() | (order > F.col("last_ok")))
    state = (
        runs.join(last_ok, "source_id")
        .groupBy("source_id")
        .agg(F.count_if(after).alias("failures"), F.max(F.when(after, F.col("at"))).alias("last_failure"))
    )
    is_open = F.col("failures") >= threshold
    return state.select(
        "source_id", "failures", F.when(is_open, "open").otherwise("closed").alias("state"),
        F.when(is_open, F.col("last_failure")).alias("opened_at"),
        (is_open & (now < F.col("last_failure") + F.expr(f"INTERVAL {cooldown} MINUTES"))).alias("blocked"),
    )


def source_stale(events: DataFrame, now: Column, hours: int = dims.SOURCE_STALE_HOURS) -> DataFrame:
    """Sources silent for longer than the limit."""
    last = events.groupBy("source_id").agg(F.max("at").alias("last_seen"))
    return last.filter(F.col("last_seen") < now - F.expr(f"INTERVAL {hours} HOURS"))


def cursors(records: DataFrame, source: str, at: str) -> DataFrame:
    """Where each source continues: its newest date."""
    return records.groupBy(source).agg(F.max(F.col(at).cast("date")).alias("last_date"))


# --- attention momentum --------------------------------------------------------------

def daily_volume(events: DataFrame, theme: str = "theme", at: str = "ts") -> DataFrame:
    return events.groupBy(theme, F.col(at).cast("date").alias("day")).agg(F.count("*").alias("volume"))


def momentum(volumes: DataFrame, recent: int = dims.RECENT_DAYS, baseline: int = dims.BASELINE_DAYS) -> DataFrame:
    """Mean of the last points against the mean of the points before them, per theme."""
    points = volumes.groupBy("theme").agg(F.count("*").alias("points"))
    last = top_n(volumes, ["theme"], [F.desc("day")], recent + baseline, "back")
    means = last.groupBy("theme").agg(
        F.avg(F.when(F.col("back") <= recent, F.col("volume"))).alias("recent"),
        F.coalesce(F.avg(F.when(F.col("back") > recent, F.col("volume"))), F.lit(0.0)).alias("baseline"),
    )
    delta = F.when(F.col("baseline") > 0, (F.col("recent") - F.col("baseline")) / F.col("baseline") * 100.0)
    return (
        means.join(points, "theme")
        .withColumn("delta_pct", delta)
        .withColumn(
            "direction",
            F.when(F.col("delta_pct") >= dims.MOVE_PERCENT, "up").when(F.col("delta_pct") <= -dims.MOVE_PERCENT, "down"),
        )
    )


def signal_line(moves: DataFrame, prefix: str, by: str = "desk") -> DataFrame:
    """Per desk: the first themes that moved, and the one that moved most.

    ``moves``: by, theme, position (order of themes), delta_pct, direction.
    """
    watched = top_n(moves, [by], ["position", "theme"], dims.MAX_THEMES, "_t")
    noted = watched.filter(F.col("direction").isNotNull())
    sign = F.when(F.col("direction") == "up", "+").otherwise("")
    phrase = F.concat(
        "theme", F.lit(" "), sign, F.bround("delta_pct", 0).cast("bigint").cast("string"), F.lit("%")
    )
    return (
        noted.withColumn("phrase", phrase)
        .groupBy(by)
        .agg(
            F.slice(F.array_sort(F.collect_list(F.struct("_t", "phrase"))), 1, dims.MAX_PHRASES).alias("p"),
            F.max_by("theme", F.struct(F.abs("delta_pct"), -F.col("_t"))).alias("lead_theme"),
            F.max_by("delta_pct", F.struct(F.abs("delta_pct"), -F.col("_t"))).alias("lead_delta_pct"),
        )
        .select(
            by,
            F.concat(F.lit(prefix), F.array_join(F.transform("p", lambda x: x["phrase"]), "; "), F.lit(".")).alias("line"),
            "lead_theme", "lead_delta_pct",
        )
    )


# --- registries --------------------------------------------------------------------

def or_queries(phrases: DataFrame, size: int = dims.QUERY_GROUP_SIZE) -> DataFrame:
    """Per desk: phrases joined with OR in groups of ``size``, in given order.

    ``phrases``: desk, phrase, position. A probe registry is a hand-kept list.
    """
    w = Window.partitionBy("desk").orderBy("position", "phrase")
    numbered = phrases.withColumn("grp", F.floor((F.row_number().over(w) - 1) / size).cast("int"))
    quoted = F.concat(F.lit('"'), F.col("phrase"), F.lit('"'))
    return numbered.groupBy("desk", "grp").agg(
        F.array_sort(F.collect_list(F.struct("position", quoted.alias("q")))).alias("q")
    ).select(
        "desk", "grp",
        F.concat(F.lit("("), F.array_join(F.transform("q", lambda x: x["q"]), " OR "), F.lit(")")).alias("query"),
    )


def themes_for_desk(probes: DataFrame, desk: str) -> DataFrame:
    return probes.filter(F.array_contains("desks", desk)).select("phrase")


def exclude_sources(rows: DataFrame, names: str, column: str = "source_id") -> DataFrame:
    """Drop the sources of a comma-separated list."""
    listed = [n.strip() for n in names.split(",") if n.strip()]
    return rows.filter(~F.col(column).isin(listed)) if listed else rows


def constraint_report(rules: list[tuple[str, DataFrame, Column, str]]) -> DataFrame:
    """Rows that break a rule: ``(rule name, table, condition that must hold, id column)``.

    All rules over one table (the same DataFrame object and id column) are judged in one pass.
    """
    tables: dict[tuple[int, str], tuple[DataFrame, list[Column]]] = {}
    for rule, df, holds, key in rules:
        tables.setdefault((id(df), key), (df, []))[1].append(F.when(~F.coalesce(holds, F.lit(True)), F.lit(rule)))
    parts = [
        df.select(F.explode(F.array_compact(F.array(*broken))).alias("rule"), F.col(key).cast("string").alias("row_id"))
        for (_, key), (df, broken) in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


# --- health ------------------------------------------------------------------------

def brief_health_inputs(briefs: DataFrame, items: DataFrame) -> DataFrame:
    """Briefs with item count, attribution counts and a leak flag over their texts.

    ``items``: brief_id, attribution, body, read, watch.
    """
    leak = F.lit(False)
    for part in ("body", "read", "watch"):
        leak = leak | looks_like_leak(F.col(part))
    counts = items.groupBy("brief_id").agg(
        F.count("*").alias("item_count"),
        *[F.count_if(F.col("attribution") == a).alias(a) for a in dims.ATTRIBUTIONS],
        F.bool_or(leak).alias("leaky_items"),
    )
    joined = briefs.join(counts, "brief_id", "left")
    zero = {c: 0 for c in ["item_count", *dims.ATTRIBUTIONS]}
    return joined.fillna(zero).withColumn(
        "leaky", F.coalesce("leaky_items", F.lit(False)) | looks_like_leak(F.col("convergence_read"))
    ).drop("leaky_items")


def health_findings(
    expected: DataFrame, briefs: DataFrame, runs: DataFrame, sources: DataFrame, now: Column, token_budget: int = 0
) -> DataFrame:
    """All findings of one day: level, code, subject, detail.

    ``expected``: desk; ``briefs``: :func:`brief_health_inputs` with desk, status,
    faithfulness_score, headline, total_tokens; ``runs``: latest run per source with
    source_id, status, error_message; ``sources``: source_id, is_active,
    breaker_state, last_fetch.
    """
    desk = expected.join(briefs, "desk", "left")
    published = F.col("status") == "published"
    # an item row without a known label counts as neither grounded nor empty
    labelled = sum((F.col(a) for a in dims.ATTRIBUTIONS[1:]), F.col(dims.ATTRIBUTIONS[0])) > 0
    collapsed = (F.col("item_count") == 0) & (squash(F.col("headline")) != "")

    def rule(df: DataFrame, level: str, code: str, when: Column, subject: str, detail: Column) -> DataFrame:
        return df.filter(when).select(
            F.lit(level).alias("level"), F.lit(code).alias("code"),
            F.col(subject).alias("subject"), detail.cast("string").alias("detail"),
        )

    none_out = (
        desk.agg(F.count_if(published).alias("n"))
        .filter("n = 0")
        .select(
            F.lit("critical").alias("level"), F.lit("no_brief_published").alias("code"),
            F.lit("all").alias("subject"), F.lit("0").alias("detail"),
        )
    )
    parts = [
        none_out,
        rule(desk, "warn", "brief_missing", F.col("status").isNull(), "desk", F.lit("")),
        rule(desk, "warn", "brief_thin", published & (F.col("item_count") < dims.MIN_ITEMS_PER_BRIEF), "desk", F.col("item_count")),
        rule(
            desk, "warn", "brief_low_faithfulness", published & (F.col("faithfulness_score") < dims.MIN_FAITHFULNESS),
            "desk", F.format_string("%.3f", "faithfulness_score"),
        ),
        rule(
            desk, "warn", "confidence_collapsed",
            published & labelled & (F.col("confirmed") + F.col("reported") == 0), "desk", F.lit(""),
        ),
        rule(desk, "warn", "content_leak", published & F.col("leaky"), "desk", F.lit("")),
        rule(desk, "warn", "brief_items_collapsed", (F.col("status") == "failed") & collapsed, "desk", F.lit("")),
        rule(desk, "info", "brief_skipped", (F.col("status") == "failed") & ~collapsed, "desk", F.lit("")),
        rule(desk, "warn", "brief_pending", F.col("status") == "pending", "desk", F.lit("")),
        rule(runs, "notice", "source_failed", F.col("status") == "failed", "source_id", F.left(squash(F.col("error_message")), F.lit(120))),
        rule(sources, "notice", "circuit_open", F.col("is_active") & (F.col("breaker_state") == "open"), "source_id", F.lit("")),
        rule(
            sources, "notice", "source_stale",
            F.col("is_active") & (F.col("last_fetch") < now - F.expr(f"INTERVAL {dims.SOURCE_STALE_HOURS} HOURS")),
            "source_id", F.lit(""),
        ),
    ]
    if token_budget:
        parts.append(
            briefs.agg(F.sum("total_tokens").alias("t"))
            .filter(F.col("t") > token_budget)
            .select(
                F.lit("warn").alias("level"), F.lit("cost_anomaly").alias("code"),
                F.lit("all").alias("subject"), F.col("t").cast("string").alias("detail"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in dims.FINDING_LEVELS]), level)


def health_verdict(findings: DataFrame) -> DataFrame:
    counts = findings.agg(*[F.count_if(F.col("level") == v).alias(v) for v in dims.FINDING_LEVELS])
    return counts.withColumn(
        "verdict", F.when(F.col("critical") > 0, "critical").when(F.col("warn") > 0, "degraded").otherwise("ok")
    )


def token_totals(briefs: DataFrame, field, budget: int) -> DataFrame:
    """Calls, tokens and cost over all briefs, and whether the budget is exceeded.

    ``field`` maps ``calls`` / ``total_tokens`` / ``est_cost_usd`` to a column.
    """
    total = lambda name, kind: F.coalesce(F.sum(F.coalesce(field(name).try_cast(kind), F.lit(0))), F.lit(0))
    return briefs.agg(
        total("calls", "bigint").alias("calls"), total("total_tokens", "bigint").alias("total_tokens"),
        F.round(total("est_cost_usd", "double"), 4).alias("est_cost_usd"),
    ).withColumn("over_budget", (F.col("total_tokens") > budget) & F.lit(budget > 0))


# --- quality -----------------------------------------------------------------------

def quality_report(briefs: DataFrame, items: DataFrame, citations: DataFrame) -> DataFrame:
    """Items, linked items and citations per brief, per desk and over the window."""
    per_item = items.groupBy("brief_id").agg(
        F.count("*").alias("items"), F.count_if(F.size("entity_ids") > 0).alias("linked")
    )
    per_cite = citations.groupBy("brief_id").agg(F.count("*").alias("cites"))
    joined = (
        briefs.filter("status = 'published'").join(per_item, "brief_id", "left").join(per_cite, "brief_id", "left")
    )
    return joined.rollup("desk", "date").agg(
        F.count("*").alias("briefs"),
        F.coalesce(F.sum("items"), F.lit(0)).alias("items"),
        F.coalesce(F.sum("linked"), F.lit(0)).alias("linked"),
        F.coalesce(F.sum("cites"), F.lit(0)).alias("cites"),
    )


def mix(rows: DataFrame, by: str, kind: str) -> DataFrame:
    """How often each kind occurs per group."""
    return rows.groupBy(by, kind).agg(F.count("*").alias("n"))


def cross_desk_repeats(citations: DataFrame) -> DataFrame:
    """Records that several desks cite on one day. ``citations``: date, source_id, native_id, desk."""
    each = citations.select("date", "source_id", "native_id", "desk").distinct()
    return each.groupBy("date", "source_id", "native_id").agg(
        F.count("*").alias("desk_count"), F.array_sort(F.collect_list("desk")).alias("desks")
    ).filter("desk_count > 1")


def minted_entities(entities: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Names of entities that got an identifier from resolution."""
    minted = identifiers.filter("source = 'brief_resolution'").select("entity")
    return entities.join(minted, "entity", "left_semi").select("name").distinct()
