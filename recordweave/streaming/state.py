"""Streams with keyed state that expires: bounded de-dup, and a watch over sources with timers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordweave import dims
from recordweave.session import run_dir
from recordweave.sources.sinks import read_or_empty

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROGRESS = "batch bigint, rows bigint, state_rows bigint, late bigint"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State on local disk with changelogs in the checkpoint; a query keeps the store it was started with."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def run(stream: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """(rows, progress) of a stream over what has landed, kept under ``root``.

    Rows go through the file sink, whose log makes each batch count once. ``progress`` has one
    row per batch: batch, rows read, rows in state, and rows dropped for being late.
    """
    spark = stream.sparkSession
    told: dict[int, tuple[int, int, int, int]] = {}

    def note(query) -> None:
        for p in query.recentProgress:
            state = p["stateOperators"]
            told[p["batchId"]] = (
                p["batchId"], p["numInputRows"], sum(s["numRowsTotal"] for s in state),
                max(told.get(p["batchId"], (0, 0, 0, 0))[3], sum(s["numRowsDroppedByWatermark"] for s in state)),
            )

    with rocksdb(spark):
        query = (
            stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
            .trigger(availableNow=True).start()
        )
        # Spark keeps the last hundred reports only, so they are read as the query goes
        while not query.awaitTermination(1):
            note(query)
        note(query)
    if told:
        spark.createDataFrame(sorted(told.values()), PROGRESS).coalesce(1).write.mode("append").parquet(f"{root}/progress")
    rows = read_or_empty(spark, f"{root}/out", spark.createDataFrame([], stream.schema))
    return rows, read_or_empty(spark, f"{root}/progress", spark.createDataFrame([], PROGRESS))


def dedup_within(
    events: DataFrame, key: list[str], at: str, days: int = dims.HOT_WINDOW_DAYS, root: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(one row of each key, progress per batch), with recent keys as state.

    A key that comes again within ``days`` days of event time is dropped. Once the watermark, ``days`` days
    behind the newest row, is ``days`` days past it, it may come again and its state is gone: so
    state holds the keys of twice ``days`` days and one batch, however long the stream runs. Rows more than ``days`` days older than the newest row before their batch are late:
    they are dropped and counted. No stored row is read again, whatever the age of the stream.
    """
    fresh = events.withWatermark(at, f"{days} days").dropDuplicatesWithinWatermark(key)
    return run(fresh, root or run_dir(events.sparkSession, "dedup-within"))


WATCH = "source_id string, event string, at bigint"


def watch(
    runs: DataFrame, late: str = "1 day", silent_hours: int = dims.SOURCE_STALE_HOURS, threshold: int = dims.BREAKER_THRESHOLD,
    cooldown_minutes: int = 30, root: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(source_id, event, at), progress: what happens to each source, told when it happens.

    ``runs`` is a stream of (source_id, at timestamp, seq, failed). Events, with ``at`` in microseconds:
    ``silent`` when ``silent_hours`` have passed without a run, ``back`` at the next one; ``open`` at the failure that
    is the ``threshold``-th since the last success, or that follows a half-open breaker; ``half_open`` when
    ``cooldown_minutes`` have passed since the last failure of an open one; ``closed`` at the next success.

    Timers on event time tell ``silent`` and ``half_open`` without any new run of the source. Runs of the last
    ``late`` stretch wait in state and are taken in order of (at, seq), so the log does not depend on how
    files come, as long as none is later than that. State is one summary per source and those runs. The log
    is complete up to the newest run minus ``late``.
    """
    silence, cool = silent_hours * 3_600_000_000, cooldown_minutes * 60_000_000

    from pyspark.sql.streaming import StatefulProcessor

    # defined here so that it travels with the query: executors need no copy of this package
    class Watch(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", "at bigint, seq bigint, failed boolean")
            self.summary = handle.getValueState("summary", "last bigint, silent boolean, failures bigint, failed_at bigint, state string")

        # every call to the handle is a round trip to the JVM, and so a large part of the time of a
        # source with few runs: none is made whose answer is known
        def handleInputRows(self, key, rows, timerValues):
            new = [r for pdf in rows for r in zip(pdf["at_us"].tolist(), pdf["seq"].tolist(), pdf["failed"].tolist())]
            yield from self.advance(key, timerValues, new, False)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            # a source has one timer, and Spark removes one that has expired by itself
            yield from self.advance(key, timerValues, [], True)

        def close(self) -> None:
            pass

        def advance(self, key, timerValues, new, fired):
            import pandas as pd

            now = timerValues.getCurrentWatermarkInMs() * 1000
            summary = self.summary.get()
            last, silent, failures, failed_at, state = before = tuple(summary) if summary else (None, False, 0, None, "closed")
            stored = [tuple(r) for r in self.waiting.get()]
            waiting = sorted(stored + new)
            out = []

            def tick(to):
                """What time alone brings before ``to``; at ``to`` itself a breaker cools down, a silence does not begin."""
                nonlocal silent, state
                if state == "open" and failed_at + cool <= to:
                    out.append(("half_open", failed_at + cool))
                    state = "half_open"
                if last is not None and not silent and last + silence < to:
                    out.append(("silent", last + silence))
                    silent = True

            done = 0
            for at, _, failed in waiting:
                if at > now:
                    break
                done += 1
                tick(at)
                if silent:
                    out.append(("back", at))
                    silent = False
                last = at if last is None else max(last, at)
                if failed:
                    failures, failed_at = failures + 1, at
                    if failures >= threshold and state != "open":
                        out.append(("open", at))
                        state = "open"
                else:
                    if state != "closed":
                        out.append(("closed", at))
                    failures, failed_at, state = 0, None, "closed"
            tick(now)
            if done and waiting[done:]:
                self.waiting.put(waiting[done:])
            elif done and stored:
                self.waiting.clear()
            elif not done and new:
                self.waiting.appendList(new)
            if last is not None and (last, silent, failures, failed_at, state) != before:
                self.summary.update((last, silent, failures, failed_at, state))
            # the next moment at which something may happen by itself
            due = [waiting[done][0]] if done < len(waiting) else []
            if last is not None and not silent:
                due.append(last + silence + 1)
            if state == "open":
                due.append(failed_at + cool)
            # a source without summary and stored runs has no timer yet
            if not fired and (summary or stored):
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
            if due:
                self.handle.registerTimer(max(-(-min(due) // 1000), now // 1000 + 1))
            if out:
                yield pd.DataFrame({"source_id": [key[0]] * len(out), "event": [e for e, _ in out], "at": [a for _, a in out]})

    rows = runs.select(
        F.col("source_id").cast("string").alias("source_id"), F.col("at"), F.unix_micros("at").alias("at_us"),
        F.col("seq").cast("bigint").alias("seq"), "failed",
    )
    spark = runs.sparkSession
    with rocksdb(spark):
        log = rows.withWatermark("at", late).groupBy("source_id").transformWithStateInPandas(
            statefulProcessor=Watch(), outputStructType=WATCH, outputMode="Append", timeMode="EventTime"
        )
    return run(log, root or run_dir(spark, "watch"))
