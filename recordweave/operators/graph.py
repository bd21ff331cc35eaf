"""Co-appearance graph: pairs, decayed edges, history, read views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordweave import dims
from recordweave.functions.names import normalize_mention, same_normalized_company
from recordweave.functions.scoring import confidence, recency_weight
from recordweave.operators.common import dealt, tasks_for
from recordweave.operators.postings import DENSE, Postings, common_items
from recordweave.session import stage

# largest item whose entities are held in one array; larger items are paired block by block
SMALL_ITEM = 64


def explode_items(items: DataFrame, item: str = "item", entities: str = "entity_ids") -> DataFrame:
    """``(item, desk, at, entity)`` from rows that hold an array of entity ids."""
    return items.select(item, "desk", "at", F.explode(entities).alias("entity"))


def _small_pairs(members: DataFrame) -> DataFrame:
    sets = members.groupBy("item", "desk", "at").agg(F.array_sort(F.collect_set("entity")).alias("e"))
    left = sets.filter(F.size("e") >= 2).select("item", "desk", "at", "e", F.posexplode("e").alias("i", "a"))
    return left.select(
        "item", "desk", "at", "a", F.explode(F.slice("e", F.col("i") + 2, F.size("e"))).alias("b")
    )


def _large_pairs(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs of large items, cut into blocks of about ``SMALL_ITEM`` entities.

    Every block meets every later block once, so a task sees at most a few
    thousand pairs of an item at a time, however large the item is.
    """
    blocks = F.ceil(F.col("size") / SMALL_ITEM)
    keyed = (
        members.join(sizes, "item")
        .withColumn("blocks", blocks.cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("entity"), F.col("blocks")).cast("int"))
    )
    left = keyed.select(
        "item", "desk", "at", F.col("entity").alias("x"), F.col("block").alias("i"),
        F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"),
    )
    right = keyed.select(
        "item", F.col("entity").alias("y"), F.col("block").alias("j"),
        F.explode(F.sequence(F.lit(0), "block")).alias("i"),
    )
    return (
        left.join(right, ["item", "i", "j"])
        .filter((F.col("i") < F.col("j")) | (F.col("x") < F.col("y")))
        .select("item", "desk", "at", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    )


def pair_up(members: DataFrame) -> DataFrame:
    """Every unordered pair of entities of an item, smaller id first.

    ``members`` holds each (item, desk, at, entity) once and is read several times,
    so it should be a stored table. It is dealt by item once, by its number of rows: no task
    takes more for being on a larger table. Item sizes are counted first (a map-side
    aggregate over one column); only the few items above ``SMALL_ITEM`` take the
    block path.
    """
    members = dealt(members, members.count(), "item")
    sizes = members.groupBy("item").agg(F.count("*").alias("size")).filter(F.col("size") > SMALL_ITEM)
    small = members.join(sizes.select("item"), "item", "left_anti")
    large = members.join(sizes.select("item"), "item", "left_semi")
    return _small_pairs(small).unionByName(_large_pairs(large, sizes))


def co_pairs(members: DataFrame) -> DataFrame:
    """All pairs of distinct entities per item; input rows may repeat.

    Repeats go first, by a shuffle on item *and* entity: an item that holds a third
    of all rows is then no longer than its list of distinct entities.
    """
    return pair_up(stage(members.distinct(), "members"))


def _desk_bit(desk: Column, desks: list[str]) -> Column:
    position = F.array_position(F.array(*[F.lit(d) for d in sorted(desks)]), desk)
    bad = F.raise_error(F.concat(F.lit("desk not in the desk list: "), desk))
    return F.when(position > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), (position - 1).cast("int"))).otherwise(
        bad.cast("bigint")
    )


def _desks_of(mask: Column, desks: list[str]) -> Column:
    return F.array_compact(
        F.array(*[F.when(mask.bitwiseAND(1 << i) != 0, F.lit(d)) for i, d in enumerate(sorted(desks))])
    )


def _could_reach_floor(members: DataFrame, weight: Column, floor: float, boost: float) -> DataFrame:
    """Entities whose whole decayed weight can still carry an edge over the floor.

    An edge weighs at most what the lighter of its two entities weighs over all
    items, so dropping the others before pairing loses nothing. This removes the
    long tail of entities seen once, which would make most of the pairs.
    Members stream past a task's entities and are not sorted, so its memory does not depend on how many come.
    """
    best = (
        members.groupBy("entity")
        # desks by number: sums of texts are kept by sorting all rows
        .agg(F.sum(weight).alias("w"), (F.min(F.xxhash64("desk")) != F.max(F.xxhash64("desk"))).alias("cross"))
        .filter(F.col("w") * F.when(F.col("cross"), max(boost, 1.0)).otherwise(1.0) >= floor - 1e-6)
    )
    return members.join(best.select("entity").hint("shuffle_hash"), "entity", "left_semi")


def _pair_sums(members: DataFrame, weight: Column, name: str, desks: list[str]) -> tuple[DataFrame, int]:
    """(a, b, ``name``, co_count, mask, last_seen) of every pair, and the tasks to sum them in.

    The tasks go by the number of pairs, which grows faster than that of members where items
    are large. ``members`` as in :func:`pair_up`.
    """
    n = F.col("n")
    sizes = dealt(members.select("item"), members.count(), "item").groupBy("item").agg(F.count("*").alias("n"))
    pairs = sizes.agg(F.sum(n * (n - 1) / 2)).first()[0]
    summed = pair_up(members).groupBy("a", "b").agg(
        F.sum(weight).alias(name),
        F.count("*").alias("co_count"),
        F.bit_or(_desk_bit(F.col("desk"), desks)).alias("mask"),
        F.max(F.col("at").cast("date")).alias("last_seen"),
    )
    return summed, tasks_for(int(pairs or 0))


def convergence_edges(
    members: DataFrame, as_of: str, desks: list[str],
    half_life: float = dims.HALF_LIFE_DAYS, floor: float = dims.WEIGHT_FLOOR, boost: float = dims.CROSS_DESK_BOOST,
) -> DataFrame:
    """Decayed co-appearance edges above the floor, pairs over several desks boosted first; stored."""
    age = F.date_diff(F.lit(as_of).cast("date"), F.col("at").cast("date"))
    decay = recency_weight(age, half_life)
    # members are worked out once, and of them only those that can reach the floor are paired
    once = stage(members.distinct(), "members")
    pairable = stage(_could_reach_floor(once, decay, floor, boost), "pairable")
    summed, tasks = _pair_sums(pairable, decay, "raw", desks)
    return stage(_edge_rows(summed, desks, floor, boost), "edges", tasks)


def _edge_rows(summed: DataFrame, desks: list[str], floor: float, boost: float) -> DataFrame:
    """Edges from (a, b, raw, co_count, mask, last_seen)."""
    cross = F.bit_count("mask") > 1
    return (
        summed.withColumn("cross_desk", cross)
        .withColumn("full", F.col("raw") * F.when(F.col("cross_desk"), boost).otherwise(1.0))
        .filter(F.col("full") >= floor)
        .select(
            F.col("a").alias("from_id"), F.col("b").alias("to_id"),
            F.round("full", 6).alias("weight"), F.round(confidence(F.col("full")), 6).alias("confidence"),
            "co_count", _desks_of(F.col("mask"), desks).alias("desks"), "cross_desk", "last_seen",
        )
    )


def pair_state(
    members: DataFrame, ref: str, desks: list[str], half_life: float = dims.HALF_LIFE_DAYS
) -> DataFrame:
    """Mergeable state of the pairs of some items, stored: (a, b, scaled, co_count, mask, last_seen).

    A pair's decayed sum at a day is the sum of 2^(t/h) over its items times 2^(-day/h),
    so ``scaled``, the sum of 2^((t - ref)/h), holds for every later day: it is added up and never worked
    out again. ``ref`` is a fixed date near the data, to keep the numbers small.
    """
    if half_life <= 0:
        scaled = F.lit(1.0)
    else:
        scaled = F.pow(F.lit(2.0), F.date_diff(F.col("at").cast("date"), F.lit(ref).cast("date")) / half_life)
    summed, tasks = _pair_sums(stage(members.distinct(), "members"), scaled, "scaled", desks)
    return stage(summed, "pair-state", tasks)


def merge_pair_states(*states: DataFrame) -> DataFrame:
    """One state from those of different items, all with the same reference date and desks."""
    every = states[0]
    for state in states[1:]:
        every = every.unionByName(state)
    return every.groupBy("a", "b").agg(
        F.sum("scaled").alias("scaled"), F.sum("co_count").alias("co_count"), F.bit_or("mask").alias("mask"), F.max("last_seen").alias("last_seen")
    )


def edges_of_state(
    state: DataFrame, as_of: str, ref: str, desks: list[str],
    half_life: float = dims.HALF_LIFE_DAYS, floor: float = dims.WEIGHT_FLOOR, boost: float = dims.CROSS_DESK_BOOST,
) -> DataFrame:
    """The edges of :func:`convergence_edges` from a state, whose items are of ``as_of`` or earlier."""
    days = F.date_diff(F.lit(as_of).cast("date"), F.lit(ref).cast("date"))
    raw = F.col("scaled") * (F.pow(F.lit(0.5), days / half_life) if half_life > 0 else F.lit(1.0))
    return _edge_rows(state.withColumn("raw", raw), desks, floor, boost)


def upsert_edges(
    live: DataFrame, state: DataFrame, names: DataFrame, as_of: str, ref: str, desks: list[str], now: Column,
    half_life: float = dims.HALF_LIFE_DAYS, floor: float = dims.WEIGHT_FLOOR, boost: float = dims.CROSS_DESK_BOOST,
) -> DataFrame:
    """The daily job: edges of the merged state, without a company's edges to itself, against the open rows."""
    edges = drop_self_company(edges_of_state(state, as_of, ref, desks, half_life, floor, boost), names)
    return scd2_edges(live, edges.withColumn("edge_type", F.lit("CONVERGES_WITH")).select("from_id", "to_id", "edge_type", "weight", "confidence"), now)


def drop_self_company(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges without those that join a company to itself under two entity rows.

    ``names`` has ``entity`` and ``name``; names are normalized once per entity.
    """
    return _with_names(edges, names).filter(
        ~same_normalized_company(F.coalesce("from_name", F.lit("")), F.coalesce("to_name", F.lit("")))
    ).drop("from_name", "to_name")


def self_company_edges(edges: DataFrame, names: DataFrame) -> DataFrame:
    """The edges :func:`drop_self_company` removes."""
    return _with_names(edges, names).filter(
        same_normalized_company(F.coalesce("from_name", F.lit("")), F.coalesce("to_name", F.lit("")))
    )


def _with_names(edges: DataFrame, names: DataFrame) -> DataFrame:
    flat = names.select("entity", normalize_mention(F.col("name")).alias("norm"))
    return edges.join(
        flat.select(F.col("entity").alias("from_id"), F.col("norm").alias("from_name")), "from_id", "left"
    ).join(flat.select(F.col("entity").alias("to_id"), F.col("norm").alias("to_name")), "to_id", "left")


def scd2_edges(live: DataFrame, desired: DataFrame, now: Column) -> DataFrame:
    """Next state of the edge table: refreshed, new and retired rows.

    ``live`` holds the open rows. An edge that stays keeps its ``valid_from``; one
    that left the desired set gets ``valid_to``.
    """
    key = ["from_id", "to_id", "edge_type"]
    joined = live.select(*key, "valid_from", F.struct(*[c for c in live.columns if c not in (*key, "valid_from")]).alias("old")).join(
        desired.select(*key, F.struct(*[c for c in desired.columns if c not in key]).alias("new")), key, "full_outer"
    )
    fields = [f.name for f in joined.schema["new"].dataType.fields]
    gone = F.col("new").isNull()
    return joined.select(
        *key,
        *[F.when(gone, F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")).alias(c) for c in fields],
        F.coalesce("valid_from", now).alias("valid_from"),
        F.when(gone, now).alias("valid_to"),
        F.when(gone, "retired").when(F.col("old").isNull(), "inserted").otherwise("refreshed").alias("action"),
    )


def edges_as_of(edges: DataFrame, valid_at: Column, known_at: Column) -> DataFrame:
    """Edges true at one time as they were known at another."""
    return edges.filter(
        (F.col("valid_from") <= valid_at)
        & (F.col("valid_to").isNull() | (F.col("valid_to") > valid_at))
        & (F.col("transaction_time") <= known_at)
    )


def _blocks(low: Column, high: Column, levels: int) -> Column:
    """The dyadic blocks (level, number) that make up the whole numbers from ``low`` up to, without, ``high``.

    At most two a level: the first whole block if it is an odd one, the last if it is an
    even one, since all others lie in a block of the next level that is whole too.
    """
    out = []
    for level in range(levels):
        size = 1 << level
        first, end = F.ceil(low / size).cast("bigint"), F.floor(high / size).cast("bigint")
        top = F.lit(level == levels - 1)
        block = lambda n: F.struct(F.lit(level).alias("level"), n.alias("block"))
        out.append(F.when((first < end) & ((first % 2 != 0) | (first + 1 >= end)) & ~top, block(first)))
        out.append(F.when((first < end) & (end % 2 != 0) & (end - 1 > first) & ~top, block(end - 1)))
        if level == levels - 1:  # no level above: all whole blocks of the top one
            whole = F.transform(F.sequence(first, end - 1), lambda n: F.struct(F.lit(level).alias("level"), n.alias("block")))
            rest = F.when(first < end, whole)
    return F.concat(F.array_compact(F.array(*out)), F.coalesce(rest, F.array().cast("array<struct<level:int,block:bigint>>")))


def edges_as_of_dates(edges: DataFrame, dates: DataFrame, known: str | None = None, levels: int = 12) -> DataFrame:
    """Each date of ``dates`` with the edges valid on it that were known by then.

    ``edges``: valid_from, valid_to (null: open), transaction_time; ``dates``: date, with ``known``
    as the column up to which an edge must have been recorded (default: the date itself). All are days.

    An interval join by equality: a validity is cut into dyadic blocks of days, at most two
    for each of ``levels`` sizes and whole ones of the largest, and a date lies in one block of each size. So
    an edge meets exactly the dates inside its validity; only the recording time is compared after that.
    """
    origin = F.lit("1970-01-01").cast("date")
    day = lambda c: F.date_diff(c.cast("date"), origin).cast("bigint")
    asked = dates.select("date", F.coalesce(F.col(known) if known else F.col("date")).cast("date").alias("_known")).distinct()
    last = asked.agg(F.max("date")).first()[0]
    if last is None:
        last = "1970-01-01"
    low, high = day(F.col("valid_from")), F.least(F.coalesce(day(F.col("valid_to")), day(F.lit(last)) + 1), day(F.lit(last)) + 1)
    cut = edges.filter(low < high).withColumn("_b", F.explode(_blocks(low, high, levels)))
    numbers = F.array(*[F.struct(F.lit(i).alias("level"), F.floor(day(F.col("date")) / (1 << i)).cast("bigint").alias("block")) for i in range(levels)])
    points = asked.select("date", "_known", F.explode(numbers).alias("_b"))
    met = cut.join(points, "_b")
    return met.filter(F.col("transaction_time").cast("date") <= F.col("_known")).drop("_b", "_known")


def filter_edges(
    edges: DataFrame, min_confidence: float = 0.0, cross_desk_only: bool = False, desk: str | None = None,
    days: int | None = None, as_of: str | None = None,
) -> DataFrame:
    """Optional read filters; one that is not given leaves no trace in the plan."""
    out = edges.filter(F.col("confidence") >= min_confidence)
    if cross_desk_only:
        out = out.filter("cross_desk")
    if desk is not None:
        out = out.filter(F.array_contains("desks", desk))
    if days is not None:
        out = out.filter(F.col("last_seen") >= F.date_sub(F.lit(as_of).cast("date"), days))
    return out


def strongest_edges(edges: DataFrame, limit: int = 100) -> DataFrame:
    order = [F.desc("confidence"), F.desc("weight"), "from_id", "to_id"]
    return edges.orderBy(*order).limit(limit)


def endpoints(edges: DataFrame) -> DataFrame:
    """Distinct nodes the edges touch."""
    return edges.select(F.explode(F.array("from_id", "to_id")).alias("entity")).distinct()


def node_degree(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("from_id", "to_id")).alias("entity")).groupBy("entity").agg(
        F.count("*").alias("degree")
    )


def graph_meta(edges: DataFrame, funding: DataFrame) -> DataFrame:
    """Node, edge, cross-desk and funding counts of one graph view, in one aggregate."""
    every = edges.select("from_id", "to_id", "cross_desk", F.lit("edge").alias("kind")).unionByName(
        funding.select("from_id", "to_id", F.lit(False).alias("cross_desk"), F.lit("funding").alias("kind"))
    )
    nodes = endpoints(every).select(F.lit(False).alias("cross_desk"), F.lit("node").alias("kind"))
    return every.select("cross_desk", "kind").unionByName(nodes).agg(
        F.count_if(F.col("kind") == "node").alias("node_count"),
        F.count_if(F.col("kind") != "node").alias("edge_count"),
        F.count_if("cross_desk").alias("cross_desk_edges"),
        F.count_if(F.col("kind") == "funding").alias("funding_edges"),
    )


def edge_context(
    edges: DataFrame, entities: DataFrame, limit: int = dims.EDGE_CONTEXT_LIMIT, newest: str = "transaction_time"
) -> DataFrame:
    """Edges that touch the given entities, newest by ``newest`` first.

    Each edge comes once, whichever of its ends is asked for; edges of other types
    between the same ends are edges of their own.
    """
    asked = entities.select("entity").distinct()
    start = edges.join(asked.withColumnRenamed("entity", "from_id"), "from_id", "left_semi").select(*edges.columns)
    end = (
        edges.join(asked.withColumnRenamed("entity", "to_id"), "to_id", "left_semi")
        .join(asked.withColumnRenamed("entity", "from_id"), "from_id", "left_anti")
        .select(*edges.columns)
    )
    rest = [c for c in ("from_id", "to_id", "edge_type") if c in edges.columns]
    return start.union(end).orderBy(F.desc(newest), F.desc("confidence"), *rest).limit(limit)


def one_hop(edges: DataFrame, nodes: DataFrame, edge_type: str | None = None) -> DataFrame:
    """Outgoing live edges, of one type if given, with the node they lead to."""
    if edge_type is not None:
        edges = edges.filter(F.col("edge_type") == edge_type)
    return edges.filter(F.col("valid_to").isNull()).join(nodes, F.col("to_id") == F.col("entity")).drop("entity")


def pair_evidence(members: DataFrame, items: DataFrame, edges: DataFrame, limit: int = 12, dense: int = DENSE) -> DataFrame:
    """Newest items that hold both ends of each given edge.

    Posting lists of the ends only are intersected (:func:`common_items`), so a hot
    entity's items are not joined with those of all its partners.
    """
    ends = edges.select("from_id", "to_id")
    asked = endpoints(ends)
    both = common_items(Postings(members.join(asked, "entity", "left_semi"), dense), ends)
    w = Window.partitionBy("from_id", "to_id").orderBy(F.desc("at"), "item")
    return both.join(items, "item").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
