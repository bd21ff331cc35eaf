"""Cursors over landed pages: every page once, whatever lands when, through restarts."""

import random

from pyspark.sql import functions as F

from recordweave.streaming import pages

SCHEMA = "id bigint, text string"


def land(spark, root, source, day, page, ids):
    spark.createDataFrame([(i, f"t{i}") for i in ids], SCHEMA).coalesce(1).write.parquet(f"{root}/source_id={source}/date={day}/page={page}")


def take(spark, root, out, **options):
    """Rows read by one call, as (id, source, date, page)."""
    got = []

    def store(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/out/batch={batch_id}")
        got.append(batch_id)

    query = pages.stream_pages(spark, root, SCHEMA, **options).writeStream.foreachBatch(store)
    query.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    rows = []
    for b in got:
        rows += [(r["id"], r["source_id"], str(r["date"]), r["page"]) for r in spark.read.parquet(f"{out}/out/batch={b}").collect()]
    return sorted(rows)


def test_walks_pages_then_dates(spark, tmp_path):
    root, out = str(tmp_path / "landed"), str(tmp_path / "job")
    options = {"lookback": {"a": 2, "b": 45}, "default": 5}
    assert take(spark, root, out, **options) == []
    land(spark, root, "a", "2024-01-01", 1, [1, 2])
    land(spark, root, "a", "2024-01-09", 1, [3])
    land(spark, root, "b", "2023-11-30", 1, [4])
    # the first walk reads dates older than the lookback too
    assert take(spark, root, out, **options) == [(1, "a", "2024-01-01", 1), (2, "a", "2024-01-01", 1), (3, "a", "2024-01-09", 1), (4, "b", "2023-11-30", 1)]
    assert take(spark, root, out, **options) == []
    # in the middle of a walk: page 2 is missing, so page 3 waits
    land(spark, root, "a", "2024-01-09", 3, [6])
    land(spark, root, "b", "2023-12-01", 1, [7])
    assert take(spark, root, out, **options) == [(7, "b", "2023-12-01", 1)]
    land(spark, root, "a", "2024-01-09", 2, [5])
    assert take(spark, root, out, **options) == [(5, "a", "2024-01-09", 2), (6, "a", "2024-01-09", 3)]
    # a lagging date within the lookback is read, one beyond it is not
    land(spark, root, "a", "2024-01-07", 1, [8])
    land(spark, root, "a", "2024-01-01", 2, [9])
    land(spark, root, "b", "2023-10-20", 1, [10])
    assert take(spark, root, out, **options) == [(8, "a", "2024-01-07", 1), (10, "b", "2023-10-20", 1)]
    # a date that leaves the lookback in the same batch as its last page
    land(spark, root, "a", "2024-01-07", 2, [11])
    land(spark, root, "a", "2024-02-01", 1, [12])
    assert take(spark, root, out, **options) == [(11, "a", "2024-01-07", 2), (12, "a", "2024-02-01", 1)]


def test_any_landing_order_reads_each_page_once(spark, tmp_path):
    rng = random.Random(3)
    root, out = str(tmp_path / "landed"), str(tmp_path / "job")
    todo = [(s, f"2024-03-{d:02d}", p) for s in ("x y", "z") for d in (1, 2, 5) for p in (1, 2, 3)]
    rng.shuffle(todo)
    seen = []
    for at in range(0, len(todo), 6):
        for k, (s, d, p) in enumerate(todo[at : at + 6], at):
            land(spark, root, s, d, p, [k * 10, k * 10 + 1])
        seen += take(spark, root, out, lookback={}, pages_per_task=2)
    assert sorted(seen) == sorted((k * 10 + j, s, d, p) for k, (s, d, p) in enumerate(todo) for j in (0, 1))


def test_a_failed_batch_is_read_again(spark, tmp_path):
    root, out = str(tmp_path / "landed"), str(tmp_path / "job")
    land(spark, root, "a", "2024-01-01", 1, [1])

    def broken(batch, batch_id):
        raise RuntimeError("lost")

    query = pages.stream_pages(spark, root, SCHEMA).writeStream.foreachBatch(broken)
    try:
        query.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
        raise AssertionError("the batch should have failed")
    except Exception as e:
        assert "lost" in str(e)
    land(spark, root, "a", "2024-01-01", 2, [2])
    # Spark may end the call with the batch that was under way
    first = [r[0] for r in take(spark, root, out)]
    assert first in ([1], [1, 2])
    assert first + [r[0] for r in take(spark, root, out)] == [1, 2]
    assert take(spark, root, out) == []


def test_ingest_job(spark, tmp_path):
    root, out = str(tmp_path / "landed"), str(tmp_path / "job")

    def parse(rows):
        return rows.select(
            "source_id", (F.col("id") % 10).cast("string").alias("native_id"), F.md5(F.col("text").cast("binary")).alias("content_hash"),
            F.col("id").alias("arrival"), F.array(F.when(F.col("id") < 20, "ai").otherwise("energy")).alias("desks"), "text",
        )

    def run():
        raw, runs = pages.ingest(pages.stream_pages(spark, root, SCHEMA), parse, out)
        return raw, sorted((r["fetched"], r["new"], r["duplicate"]) for r in runs.collect())

    raw, told = run()
    assert raw.count() == 0 and told == [(0, 0, 0)]
    land(spark, root, "a", "2024-01-01", 1, [1, 2, 11, 21])
    raw, told = run()
    assert told == [(0, 0, 0), (2, 2, 0)]
    assert sorted((r["native_id"], r["text"], sorted(r["desks"])) for r in raw.collect()) == [("1", "t1", ["ai", "energy"]), ("2", "t2", ["ai"])]
    land(spark, root, "a", "2024-01-02", 1, [2, 3])
    raw, told = run()
    assert told == [(0, 0, 0), (2, 1, 1), (2, 2, 0)] and raw.count() == 3
    assert run()[1] == told
