"""What a reader sees: briefs, items, entities, archives, glance figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordweave import dims
from recordweave.functions import money
from recordweave.functions.text import url_host
from recordweave.operators.common import first_row, top_n
from recordweave.operators.postings import DENSE, Postings, union_by


def latest_with_fallback(briefs: DataFrame) -> DataFrame:
    """Per desk the newest brief if published, else the last published with a status note.

    Desks without any published brief have no row.
    """
    newest = first_row(briefs, ["desk"], [F.desc("date"), F.desc("created_at"), F.desc("brief_id")])
    published = first_row(
        briefs.filter("status = 'published'"), ["desk"], [F.desc("published_at"), F.desc("brief_id")]
    )
    new = newest.select("desk", F.col("brief_id").alias("new_id"), F.col("status").alias("new_status"))
    note = F.when(F.col("new_status") == "pending", dims.NOTE_PENDING).when(F.col("new_status") == "failed", dims.NOTE_FAILED)
    fresh = F.col("new_status") == "published"
    return published.join(new, "desk").select(
        "desk", F.when(fresh, F.col("new_id")).otherwise(F.col("brief_id")).alias("brief_id"),
        F.col("new_status").alias("current_status"),
        F.when(~fresh, F.col("published_at")).alias("last_updated"), F.when(~fresh, note).alias("note"),
    )


def latest_wire(briefs: DataFrame, wire: DataFrame) -> DataFrame:
    """The wire of each desk's latest published brief, in display order.

    ``wire``: brief_id, display_order and what it shows. Desks without a published brief have none.
    """
    latest = first_row(
        briefs.filter("status = 'published'"), ["desk"], [F.desc("date"), F.desc("published_at"), F.desc("brief_id")]
    ).select("brief_id", "desk", "date")
    return wire.join(latest, "brief_id").select("desk", "date", *wire.columns)


def archive_gate(readers: DataFrame, briefs: DataFrame, as_of: str, limit: int = 20) -> DataFrame:
    """Published briefs each reader may open: today for free readers, 90 days for pro readers.

    ``readers``: user_id, tier, desk.
    """
    floor = F.when(F.col("tier") == "pro", F.date_sub(F.lit(as_of).cast("date"), dims.ARCHIVE_DAYS)).otherwise(
        F.lit(as_of).cast("date")
    )
    oldest = F.date_sub(F.lit(as_of).cast("date"), dims.ARCHIVE_DAYS)
    # rank once per desk and tier, then hand the same short list to every reader
    tiers = readers.select("desk", "tier").distinct()
    open_ = (
        briefs.filter((F.col("status") == "published") & (F.col("date") >= oldest))
        .join(tiers, "desk")
        .filter(F.col("date") >= floor)
    )
    return readers.join(top_n(open_, ["desk", "tier"], [F.desc("date"), "brief_id"], limit), ["desk", "tier"])


def calendar_range(events: DataFrame, start: str, end: str, desk: str | None = None, limit: int = 200) -> DataFrame:
    """Events of an inclusive date range by date, then time with nulls last.

    ``desk`` of an event is the array of desks it concerns.
    """
    out = events.filter(F.col("event_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if desk is not None:
        out = out.filter(F.array_contains("desk", desk))
    return out.orderBy("event_date", F.asc_nulls_last("event_time"), "event_id").limit(limit)


def entity_desks(members: DataFrame) -> DataFrame:
    """Distinct desks per entity over all published items; a desk list is short."""
    return members.select("entity", "desk").distinct().groupBy("entity").agg(
        F.array_sort(F.collect_list("desk")).alias("desks")
    )


def first_ticker(identifiers: DataFrame) -> DataFrame:
    """One live ticker per entity, the smallest when there are several."""
    return identifiers.filter("id_type = 'ticker' AND valid_to IS NULL").groupBy("entity").agg(
        F.min("id_value").alias("ticker")
    )


def entity_summary(entities: DataFrame, identifiers: DataFrame, members: DataFrame) -> DataFrame:
    """Chip per active entity: name, ticker, private flag, desks, convergence."""
    return (
        entities.filter("is_active")
        .join(first_ticker(identifiers), "entity", "left")
        .join(entity_desks(members), "entity", "left")
        .withColumn("is_private", F.col("ticker").isNull())
        .withColumn("convergence", F.coalesce(F.size("desks") >= 2, F.lit(False)))
    )


def appearances(members: DataFrame, limit: int = 25) -> DataFrame:
    """Newest appearances per entity, for all entities at once."""
    return top_n(members, ["entity"], [F.desc("at"), "item"], limit)


def entity_360(entities: DataFrame, identifiers: DataFrame, members: DataFrame, limit: int = 25) -> DataFrame:
    """Entity page: identifiers, newest appearances and the desks *those* span."""
    ids = identifiers.filter(F.col("valid_to").isNull()).groupBy("entity").agg(
        F.array_sort(F.collect_set(F.struct("id_type", "id_value"))).alias("identifiers"),
        F.min(F.when(F.col("id_type") == "ticker", F.col("id_value"))).alias("ticker"),
    )
    shown = appearances(members, limit).groupBy("entity").agg(
        F.array_sort(F.collect_list(F.struct("rank", "item", "desk", "at"))).alias("appearances"),
        F.array_sort(F.collect_set("desk")).alias("recent_desks"),
    )
    return (
        entities.filter("is_active")
        .join(ids, "entity", "left")
        .join(shown, "entity", "left")
        .withColumn("convergence", F.coalesce(F.size("recent_desks") >= 2, F.lit(False)))
    )


def assemble_briefs(items: DataFrame, citations: DataFrame, members: DataFrame, chips: DataFrame) -> DataFrame:
    """Everything a brief shows, one row per part, keyed by brief and item.

    Parts are ``item`` (the item itself), ``citation`` (ref = citation id) and
    ``chip`` (ref = entity, label = its name). The rows stay flat, so a brief or an
    item of any size is spread over tasks; a reader takes the rows of one brief in
    (display_order, part, ref) order.

    ``items``: brief_id, item_id, display_order, headline; ``citations``: item_id,
    citation_id; ``members``: item_id, entity; ``chips``: entity, name.
    """
    place = items.select("item_id", "brief_id", "display_order")
    part = lambda name, ref, label: [
        "brief_id", "item_id", "display_order", F.lit(name).alias("part"), ref.cast("string").alias("ref"), label.alias("label")
    ]
    none = F.lit(None).cast("string")
    own = items.select(*part("item", F.col("item_id"), F.col("headline")))
    cited = citations.select("item_id", "citation_id").distinct().join(place, "item_id").select(
        *part("citation", F.col("citation_id"), none)
    )
    linked = members.select("item_id", "entity").distinct().join(chips.select("entity", "name"), "entity")
    shown = linked.join(place, "item_id").select(*part("chip", F.col("entity"), F.col("name")))
    return own.unionByName(cited).unionByName(shown)


def followed_items(members: DataFrame, follows: DataFrame, dense: int = DENSE) -> DataFrame:
    """(user, item) for items that hold an entity the user follows. ``members``: item, entity.

    A user's posting lists are united (:func:`union_by`), so a hot entity's items do not
    come once for every user and entity.
    """
    return union_by(Postings(members, dense), follows, "user_id").select("user_id", "item")


def glance(items: DataFrame) -> DataFrame:
    """Key figure per item, its kind, and its share of the brief's largest tracked figure."""
    typed = items.select(
        "brief_id", "item_id",
        money.key_amount(F.col("headline"), F.col("body")).alias("amount"),
        money.amount_kind(F.col("headline"), F.col("body")).alias("kind"),
    )
    tracked = F.when(F.col("kind") == "tracked", F.col("amount"))
    totals = typed.groupBy("brief_id").agg(
        F.count("*").alias("items"), F.coalesce(F.sum(tracked), F.lit(0.0)).alias("tracked_usd"),
        F.coalesce(F.max(tracked), F.lit(0.0)).alias("max_usd"),
    )
    return typed.join(totals, "brief_id").withColumn(
        "share", F.coalesce(F.try_divide(F.col("amount"), F.col("max_usd")), F.lit(0.0))
    )


def distinct_outlets(citations: DataFrame) -> DataFrame:
    """Distinct outlets per brief."""
    hosts = citations.select("brief_id", url_host(F.col("url")).alias("host")).filter("host != ''")
    return hosts.distinct().groupBy("brief_id").agg(F.count("*").alias("outlets"))


def source_summary(citations: DataFrame, by: str = "item_id") -> DataFrame:
    """First two outlets with "+N", and the latest published date, else the latest fetch date.

    ``citations``: by, position, url, published_at, fetched_at (date columns).
    """
    hosts = citations.withColumn("host", url_host(F.col("url")))
    firsts = hosts.filter("host != ''").groupBy(by, "host").agg(F.min("position").alias("position"))
    count = firsts.groupBy(by).agg(F.count("*").alias("n"))
    two = top_n(firsts, [by], ["position", "host"], 2).groupBy(by).agg(
        F.array_sort(F.collect_list(F.struct("rank", "host"))).alias("l")
    )
    named = F.array_join(F.transform("l", lambda x: x["host"]), ", ")
    more = F.when(F.col("n") > 2, F.concat(F.lit(" +"), (F.col("n") - 2).cast("string"))).otherwise("")
    dates = citations.groupBy(by).agg(F.max("published_at").alias("p"), F.max("fetched_at").alias("f"))
    label = lambda word, day: F.concat(F.lit(word), F.date_format(day, "M/d/yyyy"))
    return (
        dates.join(two, by, "left")
        .join(count, by, "left")
        .select(
            by, F.coalesce(F.concat(named, more), F.lit("")).alias("outlets"),
            F.coalesce(label("Published ", F.col("p")), label("Retrieved ", F.col("f"))).alias("date_label"),
        )
    )


def subscription_state(events: DataFrame) -> DataFrame:
    """Current subscription per user from its event log.

    ``events``: user_id, seq (orders events), event_name, status, period_end, portal_url.
    The portal address keeps its last known value.
    """
    status = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for kv in dims.SUBSCRIPTION_STATUS.items() for x in kv]), F.col("status")),
        F.lit("active"),
    )
    final = F.when(F.col("event_name").isin(dims.CANCEL_EVENTS), "cancelled").otherwise(status)
    latest = F.max(F.struct("seq", final.alias("status"), "period_end"))
    portal = F.max(F.when(F.col("portal_url").isNotNull(), F.struct("seq", "portal_url")))
    return (
        events.groupBy("user_id")
        .agg(latest.alias("last"), portal.alias("portal"))
        .select(
            "user_id", "last.status", "last.period_end", F.col("portal.portal_url").alias("portal_url"),
            F.when(F.col("last.status").isin(dims.PRO_STATUSES), "pro").otherwise("free").alias("tier"),
        )
    )


