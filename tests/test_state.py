"""Streams with expiring state: bounded over many batches, and the same log whatever the order of files."""

import datetime as dt
import random

from pyspark.sql import functions as F

from recordweave.streaming import jobs, state

START = dt.datetime(2026, 1, 1)
SCHEMA = "source_id bigint, at timestamp, seq bigint, failed boolean"


def land(spark, path, files):
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return jobs.read_stream(spark, f"{path}/*.parquet", spark.createDataFrame([], SCHEMA).schema, files_per_trigger=1)


def test_keys_leave_the_state_after_their_days(spark, tmp_path):
    path, root = str(tmp_path / "in"), str(tmp_path / "root")
    days = 40
    # each day ten new keys, the ten of the day before once more, and one key of long ago
    files = [
        [(0, START + dt.timedelta(days=d, minutes=k), 10 * d + k, False) for k in range(10)]
        + [(0, START + dt.timedelta(days=d, minutes=30 + k), 10 * d + k - 10, False) for k in range(10) if d]
        for d in range(days)
    ]
    land(spark, path, files)
    rows, progress = state.dedup_within(stream(spark, path), ["seq"], "at", days=5, root=root)
    assert rows.count() == rows.select("seq").distinct().count() == 10 * days
    assert progress.count() >= days
    told = progress.agg(F.max("state_rows"), F.sum("late")).first()
    # a key stays until the watermark, five days behind, is five days past it
    assert told[0] <= 10 * 11 and told[1] == 0
    # a key whose days are over may come again; a row older than all that is late, and counted
    land(spark, path, [[(0, START + dt.timedelta(days=days), 3, False)], [(0, START + dt.timedelta(days=2), 999, False)]])
    rows, progress = state.dedup_within(stream(spark, path), ["seq"], "at", days=5, root=root)
    assert rows.filter("seq = 3").count() == 2 and rows.filter("seq = 999").count() == 0
    assert progress.agg(F.sum("late")).first()[0] == 1


def slow(rows, now, threshold=2, silence=dt.timedelta(hours=30), cool=dt.timedelta(minutes=30)):
    out = []
    for source in {r[0] for r in rows}:
        last = failed_at = None
        silent, failures, how = False, 0, "closed"
        for _, at, _, failed in [*sorted(r for r in rows if r[0] == source and r[1] <= now), (None, now, None, None)]:
            if how == "open" and failed_at + cool <= at:
                out.append((str(source), "half_open", failed_at + cool))
                how = "half_open"
            if last is not None and not silent and last + silence < at:
                out.append((str(source), "silent", last + silence))
                silent = True
            if failed is None:
                continue
            if silent:
                out.append((str(source), "back", at))
                silent = False
            last = at
            if not failed:
                if how != "closed":
                    out.append((str(source), "closed", at))
                failures, how = 0, "closed"
                continue
            failures, failed_at = failures + 1, at
            if failures >= threshold and how != "open":
                out.append((str(source), "open", at))
                how = "open"
    return sorted(out)


def test_watch_does_not_depend_on_the_order_of_files(spark, tmp_path):
    rng = random.Random(7)
    rows, at = [], START
    for i in range(150):
        at += dt.timedelta(minutes=rng.choice([5, 20, 40, 300, 2000]))
        rows.append((rng.choice([1, 1, 1, 2, 3]), at, i, rng.random() < 0.6))
    late = dt.timedelta(days=10)
    parts = [rows[k : k + 15] for k in range(0, 150, 15)]
    # neighbours change places, which is within the lateness allowed
    swapped = [p for k in range(0, len(parts), 2) for p in (parts[k + 1], parts[k])]
    want = slow(rows, at - late)
    assert {e for _, e, _ in want} == {"silent", "back", "open", "half_open", "closed"}
    for name, files in (("one", [rows]), ("sorted", parts), ("swapped", swapped)):
        path = str(tmp_path / name)
        land(spark, path, files)
        log, progress = state.watch(stream(spark, path), late="10 days", threshold=2)
        got = sorted((r.source_id, r.event, dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=r.at)) for r in log.collect())
        assert got == want, name
        assert progress.agg(F.sum("late")).first()[0] == 0


def test_a_restart_goes_on_where_it_was(spark, tmp_path):
    path, root = str(tmp_path / "in"), str(tmp_path / "root")
    rows = [(1, START + dt.timedelta(minutes=m), m, True) for m in (0, 1, 500, 501)]
    land(spark, path, [rows[:2]])
    first, _ = state.watch(stream(spark, path), late="1 minute", threshold=2, root=root)
    assert first.count() == 0  # the second failure is not older than the lateness allowed
    land(spark, path, [rows[2:], [(2, START + dt.timedelta(days=3), 9, False)]])
    log, _ = state.watch(stream(spark, path), late="1 minute", threshold=2, root=root)
    assert [r.event for r in log.filter("source_id = '1'").orderBy("at").collect()] == ["open", "half_open", "open", "half_open", "silent"]


def test_streams_without_files(spark, tmp_path):
    path = str(tmp_path / "none")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    empty = lambda: jobs.read_stream(spark, f"{path}/none*.parquet", spark.createDataFrame([], SCHEMA).schema)
    (tmp_path / "none" / "nonefile.parquet").mkdir()
    assert jobs.silence_alerts(empty(), "source_id", "at").count() == 0
    assert jobs.breaker(empty()).count() == 0
    assert jobs.dedup(empty(), ["seq"], "at").count() == 0
    assert state.dedup_within(empty(), ["seq"], "at")[0].count() == 0


def test_watch_asks_the_state_store_only_for_what_it_cannot_know(monkeypatch):
    """A source with one run: put aside at first, told when its timer fires; every call to the store is counted."""
    from unittest.mock import MagicMock

    import pandas as pd

    calls, kept = [], {}

    class Kept:
        def __init__(self, name):
            self.name = name

        def get(self):
            calls.append("get")
            return kept.get(self.name) if self.name == "summary" else iter(kept.get(self.name, []))

        def exists(self):
            calls.append("exists")
            return self.name in kept

        def update(self, value):
            calls.append("update")
            kept[self.name] = value

        put = update

        def appendList(self, rows):
            calls.append("append")
            kept[self.name] = [*kept.get(self.name, []), *rows]

        def clear(self):
            calls.append("clear")
            del kept[self.name]

    class Handle:
        timers: set = set()

        def getListState(self, name, schema):
            return Kept(name)

        getValueState = getListState

        def listTimers(self):
            calls.append("list")
            return iter(self.timers)

        def deleteTimer(self, at):
            calls.append("delete")
            self.timers = self.timers - {at}

        def registerTimer(self, at):
            calls.append("register")
            self.timers = self.timers | {at}

    runs = MagicMock()
    monkeypatch.setattr(state, "run", lambda log, root: log)
    state.watch(runs, silent_hours=1, threshold=1, root="unused")
    grouped = runs.select.return_value.withWatermark.return_value.groupBy.return_value
    watcher = grouped.transformWithStateInPandas.call_args.kwargs["statefulProcessor"]
    handle, clock, hour = Handle(), MagicMock(), 3_600_000
    watcher.init(handle)
    clock.getCurrentWatermarkInMs.return_value = 0
    row = pd.DataFrame({"at_us": [hour * 1000], "seq": [1], "failed": [True]})
    assert list(watcher.handleInputRows(("s",), iter([row]), clock)) == []
    assert sorted(calls) == ["append", "get", "get", "register"] and handle.timers == {hour}
    calls.clear()
    clock.getCurrentWatermarkInMs.return_value = 3 * hour
    told = [tuple(r) for out in watcher.handleExpiredTimer(("s",), clock, MagicMock()) for r in out.itertuples(index=False)]
    assert told == [("s", "open", hour * 1000), ("s", "half_open", hour * 1000 + 1_800_000_000), ("s", "silent", 2 * hour * 1000)]
    # Spark drops the expired timer by itself; nothing is due any more
    assert sorted(calls) == ["clear", "get", "get", "update"] and "waiting" not in kept
