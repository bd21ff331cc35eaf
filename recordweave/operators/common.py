"""Shared pieces: bounded ranks, distributed positions, phrase matching."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordweave.session import stage


# a task of a join or an aggregate on keys gets about so many rows, whatever the table's size
TASK_ROWS = 250_000
FEW_TASKS = 8


def tasks_for(rows: int) -> int:
    """Tasks of about ``TASK_ROWS`` rows."""
    return -(-rows // TASK_ROWS)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` into tasks of about ``TASK_ROWS`` of the job's ``rows`` rows.

    Spark merges partitions by their compressed bytes, and ids and dates compress to a byte or two
    a row, so a merged one may hold millions of rows to sort and hash. A table
    that makes only a few tasks is left as it is.
    """
    tasks = tasks_for(rows)
    return df.repartition(tasks, *keys) if tasks > FEW_TASKS else df


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per group with their rank.

    Spark cuts every group to ``n`` rows before the shuffle (window group limit),
    so one huge group never lands whole in a task.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def first_row(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_n(df, by, order, 1, "_first").drop("_first")


def tie_key(row_id: Column) -> Column:
    """Even, repeatable order among equal scores; both Spark and SQL databases know md5."""
    return F.md5(row_id.cast("string").cast("binary"))


def positions(df: DataFrame, by: Sequence[str], score: str, row_id: str, out: str) -> DataFrame:
    """1-based position per group by score (descending), ties in :func:`tie_key` order.

    A group may hold a third of the table, so it is never sorted in one task: rows
    are cut into (group, score, first two tie digits) cells, the few cell sizes are
    summed up in order, and each row adds its rank inside its own cell. Give a
    rounded score, then the number of cells is bounded whatever the table size.
    """
    cells = [*by, score, "_cell"]
    keyed = df.withColumn("_tie", tie_key(F.col(row_id))).withColumn("_cell", F.left("_tie", F.lit(2)))
    before = (
        keyed.groupBy(*cells)
        .count()
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("count").over(
                    Window.partitionBy(*by)
                    .orderBy(F.desc(score), "_cell")
                    .rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("count")
    )
    inside = F.row_number().over(Window.partitionBy(*cells).orderBy("_tie", row_id))
    return (
        keyed.withColumn("_inside", inside)
        .join(before, cells)
        .withColumn(out, F.col("_before") + F.col("_inside"))
        .drop("_tie", "_cell", "_inside", "_before")
    )


def _marks(words: Column) -> Column:
    """Two 64-bit marks of each word."""
    return F.transform(words, lambda w: F.struct(F.xxhash64(w).alias("a"), F.xxhash64(F.lit(7), w).alias("b")))


def _doubled(marks: str, step: int) -> Column:
    """Marks of runs twice as long as the ``step`` words that ``marks`` stands for."""
    many = F.greatest(F.size(marks) - step, F.lit(0))
    pair = lambda x, y: F.struct(F.xxhash64(x["a"], y["a"]).alias("a"), F.xxhash64(F.lit(7), x["b"], y["b"]).alias("b"))
    return F.zip_with(F.slice(marks, F.lit(1), many), F.slice(marks, F.lit(step + 1), many), pair)


def _with_marks(df: DataFrame, words: Column, classes: int) -> DataFrame:
    """``df`` with columns ``_m0``, ``_m1``, ...: marks of the runs of 1, 2, 4, ... words from each place on."""
    df = df.withColumn("_m0", _marks(words))
    for k in range(1, classes):
        df = df.withColumn(f"_m{k}", _doubled(f"_m{k - 1}", 1 << (k - 1)))
    return df


SHORT = 4


def match_phrases(
    docs: DataFrame, doc_id: str, tokens: str, phrases: DataFrame, phrase: str, low: int, high: int | None = None
) -> DataFrame:
    """Word-exact phrase hits: one row per (document, phrase row) with its first position.

    Phrases of up to four words are found by :func:`_short_hits`, longer ones by :func:`_long_hits`,
    so a position never carries more than four words, whatever the longest phrase is. Which
    lengths there are takes one small job. Whether a lookup side is small enough to broadcast is left to
    Spark, which checks its size.
    """
    size = F.size(F.split(phrase, " "))
    wanted = phrases.filter(size.between(low, high if high is not None else 1 << 30))
    k_of = (F.length(F.bin(size)) - 1).cast("int")
    lengths = wanted.select(F.when(size <= SHORT, -size).otherwise(k_of).alias("k")).distinct().collect()  # at most 35
    short, classes = max((-r[0] for r in lengths if r[0] < 0), default=0), sorted(r[0] for r in lengths if r[0] >= 0)
    found = []
    if short:
        found.append(_short_hits(docs, doc_id, tokens, wanted, phrase, max(low, 1), short))
    if classes:
        found.append(_long_hits(docs, doc_id, tokens, wanted.filter(size > SHORT), phrase, classes))
    others = [doc_id, *phrases.columns]
    if not found:
        return docs.select(doc_id).crossJoin(phrases.limit(0)).limit(0).select(*others, F.lit(0).alias("pos"), F.lit(0).alias("n"))
    hits = reduce(DataFrame.union, found).join(phrases, phrase)
    return hits.groupBy(*others).agg(F.min(F.struct("pos", "n")).alias("at")).select(*others, "at.pos", "at.n")


def _short_hits(docs: DataFrame, doc_id: str, tokens: str, phrases: DataFrame, phrase: str, low: int, high: int) -> DataFrame:
    """(doc, phrase, pos, n) of the phrases of ``low`` to ``high`` words, a few.

    Two equi-joins. The first looks up each position's first ``low`` words among the
    distinct phrase openings, which says how long the phrases with that opening are;
    the second looks up just those runs of words. Both lookup keys are unique, so
    neither a common opening nor a phrase found in every document multiplies rows.
    """
    words = [f"_w{k}" for k in range(high)]
    shifted = [F.slice(tokens, k + 1, F.size(tokens)).alias(w) for k, w in enumerate(words)]
    runs = docs.select(doc_id, F.posexplode_outer(F.arrays_zip(*shifted)).alias("pos", "_run")).select(
        doc_id, "pos", *[F.col(f"_run.{w}").alias(w) for w in words]
    )
    # outer above: the plain form would zip every text twice, once to test for emptiness
    runs = runs.filter(F.col(words[low - 1]).isNotNull()).withColumn("_open", F.concat_ws(" ", *words[:low]))
    split = F.split(phrase, " ")
    fitting = phrases.filter(F.size(split).between(low, high))
    openings = fitting.groupBy(F.array_join(F.slice(split, 1, low), " ").alias("_open")).agg(F.collect_set(F.size(split)).alias("_sizes"))
    grams = (
        runs.join(openings, "_open")
        .select(doc_id, "pos", F.explode("_sizes").alias("n"), F.array(*words).alias("_run"))
        .filter(F.get("_run", F.col("n") - 1).isNotNull())
        .select(doc_id, F.array_join(F.slice("_run", 1, F.col("n")), " ").alias(phrase), "pos", "n")
    )
    return grams.join(fitting.select(phrase).distinct(), phrase, "left_semi").select(doc_id, phrase, "pos", "n")


def _long_hits(docs: DataFrame, doc_id: str, tokens: str, wanted: DataFrame, phrase: str, classes: list[int]) -> DataFrame:
    """(doc, phrase, pos, n) of phrases by length class.

    One of n words, 2^k <= n < 2^(k+1), stands where the mark of its first 2^k
    words does and, n - 2^k words on, that of its last 2^k. So a position is one short row
    for each class that has phrases; marks of 128 bits are built by doubling. Places of first and
    of last halves are looked up on unique keys and then meet by place.
    """
    words = F.split(phrase, " ")
    size = F.size(words)
    k_of = (F.length(F.bin(size)) - 1).cast("int")
    # the marks of a phrase: of its first and of its last run, under its class
    each = _with_marks(wanted.select(phrase).distinct().withColumn("_k", k_of), words, classes[-1] + 1)
    at = F.coalesce(*[F.when(F.col("_k") == k, F.struct(F.get(f"_m{k}", F.lit(0)).alias("x"), F.get(f"_m{k}", F.size(f"_m{k}") - 1).alias("y"))) for k in classes])
    known = each.select(phrase, F.col("_k").alias("k"), at.alias("e"), size.alias("n")).select(
        phrase, "k", F.col("e.x").alias("x"), F.col("e.y").alias("y"), "n", (F.col("n") - F.pow(F.lit(2), F.col("k")).cast("int")).alias("step")
    )
    # one table of unique marks: where phrases begin, with the steps to their ends, and where they end
    marks = (
        known.select("k", "x", "step").union(known.filter("step > 0").select("k", "y", F.lit(None).cast("int"))).toDF("k", "m", "step")
        .groupBy("k", "m").agg(F.collect_set("step").alias("steps"), F.bool_or(F.col("step").isNull()).alias("ends"))
    )
    # stored, so that Spark knows its size before it plans to move all places
    marks = stage(marks.select("k", "m.a", "m.b", "steps", "ends"), "marks")
    places = _places(docs, doc_id, tokens, classes).select(doc_id, "k", "pos", F.col("m.a").alias("a"), F.col("m.b").alias("b"))
    found = places.join(marks, ["k", "a", "b"]).select(doc_id, "k", "pos", F.struct("a", "b").alias("m"), "steps", "ends")
    found = stage(found, "places")  # read three times, and few of all places
    begun = found.select(doc_id, "k", "pos", F.col("m").alias("x"), F.explode("steps").alias("step"))
    whole = begun.filter("step = 0").join(known.filter("step = 0").select(phrase, "k", "x", "n"), ["k", "x"])
    hits = whole.select(doc_id, phrase, "pos", "n")
    ended = found.filter("ends").select(doc_id, "k", F.col("pos").alias("end"), F.col("m").alias("y"))
    longer = begun.filter("step > 0").withColumn("end", F.col("pos") + F.col("step")).join(ended, [doc_id, "k", "end"])
    return hits.union(longer.join(known, ["k", "x", "y", "step"]).select(doc_id, phrase, "pos", "n"))


def _mark(words: list[Column]) -> Column:
    """Two 64-bit marks of some words in a row, from those of each."""
    while len(words) > 1:
        words = [F.struct(F.xxhash64(x["a"], y["a"]).alias("a"), F.xxhash64(F.lit(7), x["b"], y["b"]).alias("b")) for x, y in zip(words[::2], words[1::2])]
    return words[0]


def _places(docs: DataFrame, doc_id: str, tokens: str, classes: list[int]) -> DataFrame:
    """(doc, k, pos, m): the mark of the 2^k words from each place on, for each class from 2 on.

    Runs of four words are marked as columns of their place's row; only longer ones take arrays
    of marks, built by doubling.
    """
    parts = []
    if 2 in classes:
        shifted = [F.slice(tokens, i + 1, F.size(tokens)).alias(f"_w{i}") for i in range(4)]
        # outer: the plain form would zip every text twice, once to test for emptiness
        runs = docs.select(doc_id, F.posexplode_outer(F.arrays_zip(*shifted)).alias("pos", "_run"))
        four = [F.struct(F.xxhash64(F.col(f"_run._w{i}")).alias("a"), F.xxhash64(F.lit(7), F.col(f"_run._w{i}")).alias("b")) for i in range(4)]
        parts.append(runs.filter(F.col("_run._w3").isNotNull()).select(doc_id, F.lit(2).alias("k"), "pos", _mark(four).alias("m")))
    long = [k for k in classes if k > 2]
    if long:
        def placed(k: int) -> Column:
            return F.transform(f"_m{k}", lambda m, i: F.struct(F.lit(k).alias("k"), i.alias("pos"), m.alias("m")))

        marked = _with_marks(docs.select(doc_id, tokens), F.col(tokens), long[-1] + 1)
        rows = marked.select(doc_id, F.explode_outer(F.flatten(F.array(*[placed(k) for k in long]))).alias("r")).filter("r IS NOT NULL")
        parts.append(rows.select(doc_id, "r.k", "r.pos", "r.m"))
    return reduce(DataFrame.union, parts)
