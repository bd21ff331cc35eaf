"""De-dup, late data, theme volume, breaker, silence alerts and published briefs as streams.

Every job but the last writes one small result per micro-batch under ``root`` and merges them
when read. The merged rows do not depend on how files fall into batches or in
which order they come, no row is lost for being late, and a batch that is tried again overwrites
its own folder. With the same ``root`` the next call reads only new files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordweave import dims
from recordweave.operators.common import first_row
from recordweave.operators.telemetry import momentum
from recordweave.session import run_dir, stage
from recordweave.sources.sinks import BRIEF_KEY, read_or_empty, replace_briefs


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schema).format("parquet").option("maxFilesPerTrigger", files_per_trigger).load(path)
    )


def fold(stream: DataFrame, name: str, step: Callable[[DataFrame, int, str], DataFrame], root: str | None = None) -> DataFrame:
    """Run a stream over what has landed; the written results of all batches, with ``batch``.

    ``step(rows, batch id, out)`` gives what one batch adds. ``root`` holds results and
    checkpoint (default: a fresh folder, which then starts from the first file).
    """
    spark = stream.sparkSession
    root = root or run_dir(spark, name)
    out = f"{root}/out"

    def store(batch: DataFrame, batch_id: int) -> None:
        step(batch, batch_id, out).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    # a folder without a single file has no batch; the step over no rows tells the columns
    schema = step(spark.createDataFrame([], stream.schema), 0, out).schema
    return read_or_empty(spark, out, spark.createDataFrame([], T.StructType([*schema, T.StructField("batch", T.IntegerType())])))


def dedup(
    events: DataFrame, key: list[str], at: str, window_days: int | None = None, root: str | None = None
) -> DataFrame:
    """One row of each key. ``events`` is a stream.

    A batch keeps one row per key (a hot key is thinned out before the shuffle) that
    no earlier batch has stored. With ``window_days`` only stored rows within so many days of the
    batch's event times are looked at: bounded work, and a key may come again after that time.
    """
    columns = events.columns

    def step(batch: DataFrame, batch_id: int, out: str) -> DataFrame:
        fresh = batch.groupBy(*key).agg(F.min_by(F.struct(*columns), F.struct(at, F.xxhash64(*columns))).alias("v")).select("v.*")
        if batch_id == 0:
            return fresh
        old = batch.sparkSession.read.parquet(out).filter(F.col("batch") < batch_id)
        if window_days is not None:
            low, high = batch.agg(F.min(at), F.max(at)).first()
            reach = F.make_interval(days=F.lit(window_days))
            old = old.filter(F.col(at).between(F.lit(low) - reach, F.lit(high) + reach))
        same = [F.col(f"o.{c}").eqNullSafe(F.col(f"f.{c}")) for c in key]
        return fresh.alias("f").join(old.select(*key).alias("o"), same, "left_anti")

    return fold(events, "dedup", step, root).drop("batch")


def volume(events: DataFrame, theme: str, at: str, slide_days: int = 1, root: str | None = None) -> DataFrame:
    """(theme, start, volume): rows per theme and span of ``slide_days`` days, a span starting every day.

    Batches store counts; late rows count like any others.
    """
    span = F.window(at, f"{slide_days} days", "1 day") if slide_days > 1 else F.window(at, "1 day")

    def step(batch: DataFrame, batch_id: int, out: str) -> DataFrame:
        return batch.groupBy(theme, span.alias("w")).agg(F.count("*").alias("volume")).select(theme, F.col("w.start").alias("start"), "volume")

    return fold(events, "volume", step, root).groupBy(theme, "start").agg(F.sum("volume").alias("volume"))


def moves(events: DataFrame, theme: str, at: str, root: str | None = None) -> DataFrame:
    """Momentum per theme (see ``telemetry.momentum``), told batch by batch for the themes the batch holds.

    A batch stores its daily counts, adds up those of its themes over all batches so far, and stores what has
    become of their momentum. The newest word on each theme is returned: the same as over all
    rows at once, since a theme without new rows stays as it was. Late rows count like any others; rows
    without a theme belong to none.
    """
    spark = events.sparkSession
    root = root or run_dir(spark, "moves")
    volumes = "theme string, day date, volume bigint"

    def store(batch: DataFrame, batch_id: int) -> None:
        counted = batch.groupBy(F.col(theme).cast("string").alias("theme"), F.col(at).cast("date").alias("day")).agg(F.count("*").alias("volume"))
        counted.write.mode("overwrite").parquet(f"{root}/volume/batch={batch_id}")
        told = batch.sparkSession.read.schema(f"{volumes}, batch int").parquet(f"{root}/volume").filter(F.col("batch") <= batch_id)
        touched = told.filter(F.col("batch") == batch_id).select("theme").distinct()
        mine = told.join(touched, "theme", "left_semi").groupBy("theme", "day").agg(F.sum("volume").alias("volume"))
        momentum(mine).write.mode("overwrite").parquet(f"{root}/moves/batch={batch_id}")

    query = events.writeStream.foreachBatch(store).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    none = momentum(spark.createDataFrame([], volumes)).withColumn("batch", F.lit(0))
    told = read_or_empty(spark, f"{root}/moves", none)
    columns = [c for c in told.columns if c not in ("theme", "batch")]
    return told.groupBy("theme").agg(F.max_by(F.struct(*columns), "batch").alias("m")).select("theme", "m.*")


def late_rows(events: DataFrame, source: str, at: str, seen: str) -> Column:
    """True for a row that arrives beyond its source's lookback."""
    days = F.create_map(*[F.lit(x) for kv in dims.LOOKBACK_DAYS.items() for x in kv])
    allowed = F.coalesce(F.try_element_at(days, F.col(source)), F.lit(dims.HOT_WINDOW_DAYS))
    return F.date_diff(F.col(seen).cast("date"), F.col(at).cast("date")) > allowed


def late_counts(events: DataFrame, source: str, at: str, seen: str, root: str | None = None) -> DataFrame:
    """Per source: rows kept and rows beyond the lookback (counted, not lost silently)."""
    late = late_rows(events, source, at, seen)

    def step(batch: DataFrame, batch_id: int, out: str) -> DataFrame:
        return batch.groupBy(source).agg(F.count_if(~late).alias("kept"), F.count_if(late).alias("late"))

    return fold(events, "late", step, root).groupBy(source).agg(F.sum("kept").alias("kept"), F.sum("late").alias("late"))


def breaker(
    runs: DataFrame, threshold: int = dims.BREAKER_THRESHOLD, root: str | None = None,
    now: str | None = None, cooldown_minutes: int = 30,
) -> DataFrame:
    """Failures since the last success per source, from a stream of runs (source_id, at, seq, failed).

    A batch stores each source's last success and its failures per hour after that;
    reading takes the newest success of all batches and counts the failures beyond it, so batches may
    come in any order. An open breaker lets a run through again ``cooldown_minutes``
    after its last failure: with ``now`` its state is then ``half_open``.
    """
    order = F.struct("at", "seq")

    def step(batch: DataFrame, batch_id: int, out: str) -> DataFrame:
        last_ok = batch.groupBy("source_id").agg(F.max(F.when(~F.col("failed"), order)).alias("last_ok"))
        after = F.col("last_ok").isNull() | (order > F.col("last_ok"))
        failures = (
            batch.filter("failed").join(last_ok, "source_id").filter(after)
            .select("source_id", F.lit(None).cast(last_ok.schema["last_ok"].dataType).alias("last_ok"), order.alias("failure"))
        )
        return last_ok.select("source_id", "last_ok", F.lit(None).cast(last_ok.schema["last_ok"].dataType).alias("failure")).union(failures)

    told = fold(runs, "breaker", step, root).drop("batch")
    newest = told.groupBy("source_id").agg(F.max("last_ok").alias("ok"))
    live = F.col("failure").isNotNull() & (F.col("ok").isNull() | (F.col("failure") > F.col("ok")))
    out = told.join(newest, "source_id").groupBy("source_id").agg(
        F.count_if(live).alias("failures"), F.max(F.when(live, F.col("failure.at"))).alias("last_failure")
    )
    is_open = F.col("failures") >= threshold
    state = F.when(is_open, "open").otherwise("closed")
    if now is not None:
        cool = F.col("last_failure") + F.make_interval(mins=F.lit(cooldown_minutes)) <= F.lit(now).cast("timestamp")
        state = F.when(is_open & cool, "half_open").otherwise(state)
    return out.select("source_id", "failures", state.alias("state"), F.when(is_open, F.col("last_failure")).alias("opened_at"))


def silence_alerts(
    events: DataFrame, source: str, at: str, hours: int = dims.SOURCE_STALE_HOURS, root: str | None = None
) -> DataFrame:
    """(source_id, last_seen) of sources silent for over ``hours`` up to the newest event of all.

    Batches store the newest time per source. A source that came back is no longer
    silent, and a silence inside one batch counts like one between batches.
    """
    def step(batch: DataFrame, batch_id: int, out: str) -> DataFrame:
        return batch.groupBy(F.col(source).alias("source_id")).agg(F.max(F.col(at).cast("timestamp")).alias("last_seen"))

    seen = fold(events, "silence", step, root).groupBy("source_id").agg(F.max("last_seen").alias("last_seen"))
    newest = seen.agg(F.max("last_seen").alias("newest"))
    limit = F.col("newest") - F.make_interval(hours=F.lit(hours))
    return seen.join(F.broadcast(newest), F.col("last_seen") < limit).select("source_id", "last_seen")


def publish(briefs: DataFrame, root: str) -> None:
    """Send a stream of finished briefs to the brief tables under ``root`` (read them with ``read_briefs``).

    ``briefs``: desk, date, brief_id, made_at, items array of structs that hold an array ``citations``, and any other
    columns. A batch is one version: of its briefs of one (desk, date) the newest counts (ties: the largest brief_id), and
    replaces what earlier batches stored, with all its items and citations, at once. A batch that is tried again replaces itself.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        newest = stage(first_row(batch, BRIEF_KEY, [F.desc("made_at"), F.desc("brief_id")]), "briefs")
        key = [*BRIEF_KEY, "brief_id"]
        items = newest.select(*key, F.posexplode("items").alias("display_order", "item"))
        citations = items.select(*key, "display_order", F.explode("item.citations").alias("citation")).select(*key, "display_order", "citation.*")
        items = items.select(*key, "display_order", F.col("item").dropFields("citations").alias("item")).select(*key, "display_order", "item.*")
        replace_briefs(newest.drop("items"), items, citations, root, f"{batch_id:012d}")

    query = briefs.writeStream.foreachBatch(store).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
