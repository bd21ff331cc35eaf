"""Bulk entity resolution: identifiers first, then name similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordweave import dims
from recordweave.functions.names import jaccard, normalize_mention, trigrams
from recordweave.operators.common import top_n
from recordweave.session import stage

# a trigram in more aliases than this is spread over several salts
HOT_GRAM = 5000


def by_identifier(mentions: DataFrame, identifiers: DataFrame) -> DataFrame:
    """First identifier, in list order, that names a live entity.

    ``mentions``: mention_id, ids array<struct<id_type,id_value>>;
    ``identifiers``: id_type, id_value, entity, valid_to.
    """
    live = (
        identifiers.filter(F.col("valid_to").isNull())
        .groupBy("id_type", "id_value")
        .agg(F.min("entity").alias("entity"))
    )
    asked = mentions.select("mention_id", F.posexplode("ids").alias("pos", "id")).select(
        "mention_id", "pos", "id.id_type", "id.id_value"
    )
    hits = asked.filter("id_value != ''").join(live, ["id_type", "id_value"])
    return hits.groupBy("mention_id").agg(F.min(F.struct("pos", "id_type", "entity")).alias("h")).select(
        "mention_id", F.col("h.entity").alias("entity"),
        F.concat(F.lit("identifier:"), F.col("h.id_type")).alias("resolved_by"),
    )


def _gram_id(gram: Column) -> Column:
    """A trigram as one number, its three code points side by side."""
    at = lambda i: F.ascii(F.substr(gram, F.lit(i), F.lit(1))).cast("bigint")
    return at(1) * (1 << 42) + at(2) * (1 << 21) + at(3)


def _grams(name: Column) -> Column:
    return F.transform(trigrams(name), _gram_id)


LANES = 4


def _signature(ids: Column) -> Column:
    """256 bits, one set for each gram: two names differ in at least as many grams as bits."""
    bit = lambda g: F.pmod(F.xxhash64(g), F.lit(64 * LANES)).cast("int")
    return F.array(*[
        F.aggregate(
            F.filter(F.transform(ids, bit), _between(64 * lane)),
            F.lit(0).cast("bigint"), lambda s, b: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), b % 64)),
        )
        for lane in range(LANES)
    ])


def _between(low: int):
    return lambda b: b.between(low, low + 63)


def _ordered_grams(names: DataFrame, frequency: DataFrame) -> DataFrame:
    """(name, grams, signature): each name's trigram numbers, rarest first by (df, gram), with their df."""
    each = names.select("name", F.explode("ids").alias("gram")).join(frequency, "gram", "left")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")))
    return each.groupBy("name").agg(order.alias("grams")).withColumn("signature", _signature(F.transform("grams", lambda g: g["gram"])))


def _prefix(ordered: DataFrame, threshold: float) -> DataFrame:
    """One row for each of a name's rarest grams: two names this similar must share one of them.

    With ``n`` grams and Jaccard >= t, the overlap is at least ``ceil(t*n)``, so some
    shared gram lies among the first ``n - ceil(t*n) + 1`` in any fixed order. ``after``
    counts the grams from this one on.
    """
    size = F.size("grams")
    keep = size - F.ceil(size * threshold - 1e-9) + 1
    return ordered.select(
        "name", "signature", size.alias("size"), F.posexplode(F.slice("grams", F.lit(1), keep.cast("int"))).alias("pos", "g")
    ).select("name", "signature", "size", F.col("g.gram").alias("gram"), F.col("g.df").alias("df"), (F.col("size") - F.col("pos")).alias("after"))


def candidate_names(left: DataFrame, right: DataFrame, threshold: float = dims.TRIGRAM_THRESHOLD) -> DataFrame:
    """Pairs (name, alias, ...) that pass all filters, each once for every rare gram they share.

    Four filters, none of which loses a pair: one of the rarest grams is shared; the sizes
    allow the similarity; bit signatures of the two sets do not differ in too many grams; and at the shared gram enough grams are left on both sides, since those before it
    are not shared (position filter: all of a name's grams are in one order, and the shared one
    taken is the first). A gram that is common all the same is salted.
    """
    mentions = left.distinct().withColumn("ids", _grams(F.col("name")))
    aliases = right.distinct().withColumn("ids", _grams(F.col("name")))
    frequency = aliases.select(F.explode("ids").alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    salts = (F.floor(F.col("df") / HOT_GRAM) + 1).cast("int")
    indexed = _prefix(_ordered_grams(aliases, frequency), threshold).select(
        F.col("name").alias("alias"), F.col("signature").alias("alias_signature"), "gram", F.col("size").alias("alias_size"), F.col("after").alias("alias_after"),
        F.pmod(F.xxhash64("name"), salts).cast("int").alias("salt"),
    )
    asked = _prefix(_ordered_grams(mentions, frequency), threshold).filter("df > 0").select(
        "name", "signature", "gram", "size", "after", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")
    )
    near = (F.col("alias_size") >= F.col("size") * threshold - 1e-9) & (F.col("size") >= F.col("alias_size") * threshold - 1e-9)
    least = (F.col("size") + F.col("alias_size")) * (threshold / (1 + threshold)) - 1e-9
    differ = sum((F.bit_count(F.get("signature", F.lit(i)).bitwiseXOR(F.get("alias_signature", F.lit(i)))) for i in range(LANES)), F.lit(0))
    bits = differ <= F.col("size") + F.col("alias_size") - 2 * least
    return asked.join(indexed, ["gram", "salt"]).filter(near & (F.least("after", "alias_after") >= least) & bits)


def similar_names(left: DataFrame, right: DataFrame, threshold: float = dims.TRIGRAM_THRESHOLD) -> DataFrame:
    """``(name, alias, sim)`` for all pairs with trigram similarity at or above the threshold.

    Both inputs are single ``name`` columns and are made distinct first. Grams are worked out once a
    name; candidates are made distinct as names, and the gram numbers of the two sides are looked up then.
    """
    pairs = candidate_names(left, right, threshold).select("name", "alias").distinct()
    ids = lambda df, name, out: df.distinct().select(F.col("name").alias(name), _grams(F.col("name")).alias(out))
    met = pairs.join(ids(left, "name", "_x"), "name").join(ids(right, "alias", "_y"), "alias")
    shared = F.size(F.array_intersect("_x", "_y"))
    counted = met.select("name", "alias", shared.alias("_n"), (F.size("_x") + F.size("_y")).alias("_all"))
    sim = F.coalesce(F.try_divide(F.col("_n"), F.col("_all") - F.col("_n")), F.lit(0.0))
    return counted.select("name", "alias", sim.alias("sim")).filter(F.col("sim") >= threshold - 1e-9)


def candidates(
    mentions: DataFrame, aliases: DataFrame, threshold: float = dims.TRIGRAM_THRESHOLD, limit: int = dims.MAX_CANDIDATES
) -> DataFrame:
    """Best entities per normalized mention.

    ``mentions``: name; ``aliases``: name, entity. An entity counts once, with its best alias,
    so two aliases of one company do not look ambiguous.
    """
    pairs = similar_names(mentions.select("name"), aliases.select("name"), threshold)
    owners = aliases.select(F.col("name").alias("alias"), "entity").distinct()
    best = pairs.join(owners, "alias").groupBy("name", "entity").agg(F.max("sim").alias("sim"))
    return top_n(best, ["name"], [F.desc("sim"), "entity"], limit)


def decide(ranked: DataFrame) -> DataFrame:
    """One decision per mention from its two best candidates."""
    w = Window.partitionBy("name").orderBy("rank")
    top = ranked.filter("rank <= 2").withColumn("second", F.lead("sim").over(w)).filter("rank = 1")
    tied = (F.col("sim") >= dims.SIM_HIGH) & (F.col("sim") - F.col("second") < dims.AMBIGUITY_MARGIN)
    status = (
        F.when(F.coalesce(tied, F.lit(False)), "llm_disambiguate")
        .when(F.col("sim") >= dims.SIM_HIGH, "auto_link")
        .when(F.col("sim") >= dims.SIM_MEDIUM, "llm_disambiguate")
        .when(F.col("sim") >= dims.SIM_LOW, "llm_expand_context")
        .otherwise("auto_dismiss")
    )
    return top.select(
        "name", status.alias("status"), F.col("sim").alias("confidence"),
        F.when(status == "auto_link", F.col("entity")).alias("entity"),
        F.when(status == "auto_link", "auto_high_confidence").alias("resolved_by"),
    )


def minted_id(ids):
    """Entity id of a mention nobody knows, from its first mintable identifier (cik, then uei)."""
    mintable = F.filter(ids, lambda i: i["id_type"].isin(dims.MINTABLE_ID_TYPES) & (i["id_value"] != ""))
    first = F.get(mintable, 0)
    return F.when(first.isNotNull(), F.sha2(F.concat_ws(":", first["id_type"], first["id_value"]), 256))


def resolve(mentions: DataFrame, identifiers: DataFrame, aliases: DataFrame) -> DataFrame:
    """Identifier match, else name match, else an entity minted from the identifier.

    ``mentions``: mention_id, mention, ids. Names are resolved once per distinct
    normalized name; mentions of the same unknown identifier get the same minted id.
    """
    # each is read several times below; a plan worked out anew joins and sorts all mentions again
    mentions = stage(mentions, "mentions")
    exact = stage(by_identifier(mentions, identifiers), "exact")
    unknown = stage(mentions.join(exact.select("mention_id"), "mention_id", "left_anti"), "unknown")
    # every spelling is normalized and resolved once, however many mentions use it
    spelled = stage(
        unknown.select("mention").distinct().withColumn("name", normalize_mention(F.col("mention"))), "spellings"
    )
    verdicts = decide(candidates(spelled.filter("name != ''").select("name"), aliases))
    by_name = unknown.join(spelled.join(verdicts, "name", "left"), "mention", "left")
    minted = minted_id(F.col("ids"))
    fuzzy = by_name.select(
        "mention_id",
        F.coalesce(F.col("entity").cast("string"), minted).alias("entity"),
        F.coalesce("status", F.lit("auto_dismiss")).alias("status"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.when(F.col("entity").isNotNull(), F.col("resolved_by")).when(minted.isNotNull(), "minted").alias("resolved_by"),
    )
    linked = exact.select(
        "mention_id", F.col("entity").cast("string").alias("entity"), F.lit("auto_link").alias("status"),
        F.lit(1.0).alias("confidence"), "resolved_by",
    )
    return linked.unionByName(fuzzy)


def review_queue(ranked: DataFrame, decisions: DataFrame) -> DataFrame:
    """Mentions a person should look at, with their candidates (at most a handful each)."""
    open_ = decisions.filter(F.col("status").isin("llm_disambiguate", "llm_expand_context"))
    shortlist = ranked.groupBy("name").agg(
        F.array_sort(F.collect_list(F.struct("rank", "entity", F.round("sim", 6).alias("sim")))).alias("candidates")
    )
    return open_.join(shortlist, "name").withColumn("review_status", F.lit("pending"))


def search(aliases: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Entities by name: prefix matches first, then by similarity to the search text."""
    wanted = normalize_mention(F.lit(text))
    scored = aliases.select(
        "entity", "name", F.startswith("name", wanted).alias("prefix"),
        jaccard(trigrams(F.col("name")), trigrams(wanted)).alias("sim"),
    ).filter(F.col("prefix") | (F.col("sim") >= dims.TRIGRAM_THRESHOLD - 1e-9))
    return scored.orderBy(F.desc("prefix"), F.desc(F.round("sim", 6)), "name", "entity").limit(limit)


def link_metrics(pairs: DataFrame) -> DataFrame:
    """Precision, recall and false-link rate of ``(expected, predicted)`` rows, nulls = no link."""
    linked = F.col("predicted").isNotNull()
    right = linked & F.coalesce(F.col("predicted") == F.col("expected"), F.lit(False))
    counts = pairs.agg(
        F.count("*").alias("total"), F.count_if(F.col("expected").isNotNull()).alias("resolvable"),
        F.count_if(linked).alias("resolved"), F.count_if(right).alias("correct"),
        F.count_if(linked & ~right).alias("wrong"),
    )
    ratio = lambda a, b, empty: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(empty))
    return counts.select(
        "*", F.round(ratio("correct", "resolved", 1.0), 6).alias("precision"),
        F.round(ratio("correct", "resolvable", 1.0), 6).alias("recall"),
        F.round(ratio("wrong", "resolved", 0.0), 6).alias("false_link_rate"),
    )
