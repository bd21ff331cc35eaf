"""Document fingerprints by winnowing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRIME, BASE = (1 << 31) - 1, 1_103_515_245
LAST = (1 << 31) - 1
BUCKET_BITS = 12


def window_pairs(df: DataFrame, column: str, width: int, join) -> DataFrame:
    """``column`` replaced by ``join`` over each run of ``width`` elements, built by doubling.

    ``join(left, right, n)`` puts together the values of two neighbouring runs, the
    right one of ``n`` elements. A run of any width so takes a few linear passes. Arrays shorter than
    ``width`` become empty.
    """
    def of(df: DataFrame, a: str, b: str, shift: int, n: int, out: str) -> DataFrame:
        many = F.greatest(F.least(F.size(a), F.size(b) - shift), F.lit(0))
        return df.withColumn(
            out,
            F.when(many > 0, F.zip_with(F.slice(a, F.lit(1), many), F.slice(b, F.lit(shift + 1), many), lambda x, y: join(x, y, n)))
            .otherwise(F.array().cast("array<bigint>")),
        )

    have, parts = 1, {1: column}
    while have * 2 <= width:
        df = of(df, parts[have], parts[have], have, have, f"_w{have * 2}")
        have *= 2
        parts[have] = f"_w{have}"
    name, done, rest = parts[have], have, width - have
    while rest:
        take = 1 << rest.bit_length() - 1
        df = of(df, name, parts[take], done, take, f"_x{done}")
        name, done, rest = f"_x{done}", done + take, rest - take
    keep = [c for c in df.columns if not c.startswith(("_w", "_x")) and c != column]
    return df.select(*keep, F.col(name).alias(column))


def prints(df: DataFrame, text: str, out: str, words: int = 5, window: int = 8) -> DataFrame:
    """``df`` with ``out``: the winnowed k-grams of ``text`` in order of place.

    Words are split at ASCII white space and put in lower case. A gram is the rolling
    hash of ``words`` word hashes mod 2^31 - 1 (fewer words: all of them and zeros). Of
    each run of ``window`` grams the smallest is chosen, the rightmost of equals (fewer
    grams: of all). Entries are gram * 2^31 + (2^31 - 1 - place), so that the minimum of
    numbers is that choice; two texts with a common run of words + window - 1 words share an entry's
    gram. No words give an empty array.
    """
    df = df.withColumn("_h", F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), ""))
    df = df.withColumn("_h", F.transform("_h", lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME).cast("bigint"))))
    few = F.size("_h").between(1, words - 1)
    df = df.withColumn("_h", F.when(few, F.concat("_h", F.array_repeat(F.lit(0).cast("bigint"), F.lit(words) - F.size("_h")))).otherwise(F.col("_h")))
    df = window_pairs(df, "_h", words, lambda x, y, n: (x * F.lit(pow(BASE, n, PRIME)).cast("bigint") + y) % F.lit(PRIME).cast("bigint"))
    df = df.withColumn("_h", F.transform("_h", lambda g, i: g * F.lit(1 << 31).cast("bigint") + (F.lit(LAST).cast("bigint") - i)))
    short = F.when(F.size("_h").between(1, window - 1), F.array(F.array_min("_h")))
    df = df.withColumn("_short", short)
    df = window_pairs(df, "_h", window, lambda x, y, n: F.least(x, y))
    return df.withColumn(out, F.coalesce("_short", F.array_distinct("_h"))).drop("_h", "_short")


def shown(entries: str) -> Column:
    """A fingerprint as text: ``gram:place`` in hexadecimal and decimal, comma-joined."""
    return F.array_join(
        F.transform(entries, lambda e: F.concat(F.hex(F.shiftright(e, 31)), F.lit(":"), (F.lit(LAST).cast("bigint") - e.bitwiseAND(F.lit(LAST).cast("bigint"))).cast("string"))),
        ",",
    )


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of the grams of two fingerprints; two empty ones are alike."""
    x, y = (F.transform(c, lambda e: F.shiftright(e, 31)) for c in (a, b))
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(
        both / (F.size(F.array_distinct(x)) + F.size(F.array_distinct(y)) - both)
    )


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, fp, next_text, next_fp): each row beside the next one, descending doc_id, the first after the last.

    Rows meet in ranges of 4096 ids, so the only sort is inside a range; the last of a
    range takes the first of the range below, found among one row for each range.
    Rows with equal doc_id follow by descending text; a null id counts as the smallest.
    """
    o = F.coalesce("doc_id", F.lit(-(1 << 63)).cast("bigint"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), o.alias("o"), F.shiftright(o, BUCKET_BITS).alias("bucket"))
    tops = rows.groupBy("bucket").agg(F.max(F.struct("o", "text")).alias("top"))
    down = Window.orderBy(F.desc("bucket"))
    wide = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    below = rows.select("bucket").distinct().select(
        "bucket", F.coalesce(F.lead("bucket").over(down), F.first("bucket").over(wide)).alias("from")
    )
    heads = below.join(tops.select(F.col("bucket").alias("from"), F.col("top.text").alias("head_text")), "from").drop("from")
    heads = prints(heads, "head_text", "head_fp")
    rows = prints(rows.repartition("bucket"), "text", "fp")  # only texts are dealt, and once
    order = Window.partitionBy("bucket").orderBy(F.desc("o"), F.desc("text"))
    return (
        rows.withColumn("_n", F.lead(F.struct("text", "fp")).over(order))
        .join(heads, "bucket")
        .select(
            "doc_id", "text", "fp",
            F.when(F.col("_n").isNull(), F.col("head_text")).otherwise(F.col("_n.text")).alias("next_text"),
            F.when(F.col("_n").isNull(), F.col("head_fp")).otherwise(F.col("_n.fp")).alias("next_fp"),
        )
    )


def edited_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The edited text has its last third replaced by the start of the next document's. A
    null text counts as empty; in a table of one row the next document is that row.
    """
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("bigint")).withColumn("take", F.expr("n_chars div 3"))
    rows = rows.withColumn(
        "edited", F.concat(F.expr("left(text, int(n_chars - take))"), F.expr("left(next_text, int(take))"))
    ).drop("text", "next_text", "take")
    rows = prints(rows, "edited", "edited_fp")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), shown("fp").alias("fingerprint"),
        shown("edited_fp").alias("edited_fingerprint"), likeness("fp", "edited_fp").alias("near_edited"),
        likeness("fp", "next_fp").alias("near_next"),
    )
